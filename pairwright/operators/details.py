"""Details of chosen CV-JD pairs: keywords, claims, lines and edits.

All take ``pairs`` (doc_id, item_id), normally the top of a ranking, so their
work follows the number of JDs rather than the number of all pairs.  They read the
stored terms; only the text of evidence lines comes from the CVs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.functions import values as V
from pairwright.functions.text import as_column, has_digit, is_blank, lines, word_count
from pairwright.operators import terms
from pairwright.operators.matching import MatchInputs
from pairwright.plans import scale


def pair_terms(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, item_id, term, tf): the JD's key terms for each pair."""
    return pairs.select("doc_id", "item_id").join(keys.select("item_id", "term", "tf"), "item_id")


def chosen(cv_rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of the CVs that occur in ``pairs``; the rest goes before anything is moved."""
    return cv_rows.join(pairs.select("doc_id"), "doc_id", "left_semi")


def matched_keywords(pairs: DataFrame, inputs: MatchInputs) -> DataFrame:
    """Key terms of the JD that the CV holds."""
    return pair_terms(pairs, inputs.keys).join(
        chosen(inputs.hits, pairs), ["doc_id", "term"], "left_semi"
    )


def missing_keywords(pairs: DataFrame, inputs: MatchInputs) -> DataFrame:
    """Key terms of the JD that the CV lacks, all of them."""
    return pair_terms(pairs, inputs.keys).join(
        chosen(inputs.hits, pairs), ["doc_id", "term"], "left_anti"
    )


def top_missing_keywords(missing: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` missing terms the JD repeats most; ties go to the earlier term."""
    order = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("tf"), "term")
    return missing.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_claims(keys: DataFrame, k: int = 5) -> DataFrame:
    """(item_id, claim): the key terms to look for evidence of, most repeated first."""
    order = Window.partitionBy("item_id").orderBy(F.desc("tf"), "term")
    return (
        keys.withColumn("r", F.row_number().over(order))
        .filter(F.col("r") <= k)
        .select("item_id", F.col("term").alias("claim"))
    )


def claims_with_evidence(pairs: DataFrame, claims: DataFrame, inputs: MatchInputs) -> DataFrame:
    """(doc_id, item_id, claim, line_no, has_digit, n_words): every claim of each pair with the CV
    lines that mention it.

    ``inputs`` are prepared by line and ``graded``.  A claim without a line keeps one row whose
    ``line_no`` is NULL.  Claims are key terms, so the line index holds all their lines.
    """
    wanted = pairs.select("doc_id", "item_id").join(claims, "item_id")
    mentions = chosen(inputs.index, pairs).select("doc_id", F.col("term").alias("claim"), "line_no", "has_digit", "n_words")
    return wanted.join(mentions, ["doc_id", "claim"], "left").select(
        "doc_id", "item_id", "claim", "line_no", "has_digit", "n_words"
    )


def with_lines(evidence: DataFrame, cvs: DataFrame) -> DataFrame:
    """Evidence with the text of its lines, from the CVs that have some."""
    at = evidence.filter(F.col("line_no").isNotNull()).select("doc_id", "line_no").distinct()
    texts = chosen(cvs, at).select("doc_id", F.posexplode(lines("text")).alias("line_no", "line"))
    return evidence.join(texts.join(at, ["doc_id", "line_no"], "left_semi"), ["doc_id", "line_no"], "left")


def evidence_strength(evidence: DataFrame) -> DataFrame:
    """One grade per claim: the strongest of its lines."""
    grade = (
        F.when(F.col("line_no").isNull(), 0)
        .when(F.col("has_digit"), 3)
        .when(F.col("n_words") >= 8, 2)
        .otherwise(1)
    )
    labels = F.array(*[F.lit(x) for x in reversed(V.EVIDENCE_STRENGTHS)])
    return (
        evidence.groupBy("doc_id", "item_id", "claim")
        .agg(F.max(grade).alias("grade"))
        .select("doc_id", "item_id", "claim", F.element_at(labels, F.col("grade") + 1).alias("strength"))
    )


def keyword_priority(jds: DataFrame, high: int = 3, medium: int = 2) -> DataFrame:
    """(item_id, keyword, tf, priority): how much each JD insists on a term."""
    return terms.jd_postings(jds).select(
        "item_id",
        F.col("term").alias("keyword"),
        "tf",
        F.when(F.col("tf") >= high, V.PRIORITIES[0])
        .when(F.col("tf") >= medium, V.PRIORITIES[1])
        .otherwise(V.PRIORITIES[2])
        .alias("priority"),
    )


def enum_rank(col: Column | str, order: tuple[str, ...]) -> Column:
    """1 for the first value of ``order``; values outside it come last."""
    ranks = F.create_map(*[F.lit(x) for i, v in enumerate(order, 1) for x in (v, i)])
    return F.coalesce(F.try_element_at(ranks, as_column(col)), F.lit(len(order) + 1))


def order_by_priority(keywords: DataFrame) -> DataFrame:
    """Keywords of each JD numbered High, Medium, Low, then by name."""
    rows = keywords.withColumn("priority_rank", enum_rank("priority", V.PRIORITIES))
    order = Window.partitionBy("item_id").orderBy("priority_rank", "keyword")
    return rows.withColumn("position", F.row_number().over(order))


def weakest_lines(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, rank, line_no, line): non-blank lines most in need of editing.

    Lines without a digit first, then those with fewest words, then by position.
    A text's lines are ordered inside its own row, without a shuffle.
    """
    graded = F.transform(
        lines("text"),
        lambda x, i: F.struct(
            has_digit(x).cast("int").alias("digit"),
            word_count(x).alias("n_words"),
            i.alias("line_no"),
            x.alias("line"),
        ),
    )
    filled = F.filter(graded, lambda s: ~is_blank(s["line"]))
    worst = F.slice(F.array_sort(filled), 1, k)
    return docs.select("doc_id", F.posexplode(worst).alias("i", "w")).select(
        "doc_id", (F.col("i") + 1).alias("rank"), "w.line_no", "w.line"
    )


# --- edits: (doc_id, ord, original_text, upgraded_text) -----------------------------


def check_verbatim_edits(edits: DataFrame, docs: DataFrame) -> DataFrame:
    """Edits with ``verbatim``: whether the original text stands exactly in the CV."""
    return edits.join(docs.select("doc_id", "text"), "doc_id", "left").select(
        *edits.columns,
        F.coalesce(F.contains("text", "original_text") & (F.col("original_text") != ""), F.lit(False))
        .alias("verbatim"),
    )


def apply_edits(docs: DataFrame, edits: DataFrame, block: int = 1024) -> DataFrame:
    """(doc_id, revised): each CV with its edits made in order.

    Edits are ordered by ``ord``, NULL first, then by their texts.  Those with an empty original are
    skipped; a CV without edits stays as it is.  A round makes the next ``block`` edits of
    each CV that has some left, whatever their ``ord``; nearly always one round is all.  Only CVs with
    edits left are written for a further round.
    """
    order = Window.partitionBy("doc_id").orderBy(F.asc_nulls_first("ord"), "original_text", "upgraded_text")
    made = edits.filter(F.col("original_text") != "").withColumn("__n", F.row_number().over(order) - 1)
    made = scale.materialize(made.select("doc_id", "__n", "original_text", "upgraded_text"), "edits")
    texts, finished, done = docs.select("doc_id", "text"), None, 0
    while True:
        now = _edit_round(texts, made.filter((F.col("__n") >= done) & (F.col("__n") < done + block)))
        done += block
        later = made.filter(F.col("__n") >= done).select("doc_id").distinct()
        if later.isEmpty():
            revised = now if finished is None else finished.unionByName(now)
            return revised.withColumnRenamed("text", "revised")
        ended = now.join(later, "doc_id", "left_anti")
        finished = ended if finished is None else finished.unionByName(ended)
        texts = scale.materialize(now.join(later, "doc_id", "left_semi"), f"edited-{done}")


def _edit_round(texts: DataFrame, edits: DataFrame) -> DataFrame:
    edit = F.struct(
        "__n", F.col("original_text").alias("o"), F.coalesce("upgraded_text", F.lit("")).alias("u")
    )
    packed = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(edit)).alias("edits"))
    revised = F.aggregate("edits", F.col("text"), lambda acc, x: F.replace(acc, x["o"], x["u"]))
    return texts.join(packed, "doc_id", "left").select(
        "doc_id", F.when(F.col("edits").isNull(), F.col("text")).otherwise(revised).alias("text")
    )
