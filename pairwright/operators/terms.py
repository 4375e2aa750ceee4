"""Terms of CVs and JDs, document frequency, and the key terms of a JD."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.functions.text import distinct_tokens, has_digit, lines, tokens, word_count
from pairwright.plans import scale

MIN_TERM_LENGTH = 3
MAX_DF_PERCENT = 10


def doc_terms(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, term): the distinct terms of each text, without a shuffle."""
    return docs.select(doc, F.explode(distinct_tokens(text)).alias("term"))


def line_terms(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), graded: bool = False
) -> DataFrame:
    """(doc, line_no, term, *keep): distinct terms of each line, without a shuffle.

    ``graded`` adds ``has_digit`` and ``n_words`` of the line.
    """
    grades = {"has_digit": has_digit("line"), "n_words": word_count("line")} if graded else {}
    split = docs.select(doc, *keep, F.posexplode(lines(text)).alias("line_no", "line"))
    rows = split.select(doc, "line_no", distinct_tokens("line").alias("__t"), *keep, *[c.alias(n) for n, c in grades.items()])
    return rows.select(doc, "line_no", F.explode("__t").alias("term"), *keep, *grades)


def marked_terms(text: str = "text") -> Column:
    """The distinct terms of each line as an array of (term, line_no, first), ordered by term and line.

    ``first`` marks the first line of the text that holds the term.  A text is sorted by itself, so
    nothing is moved or spilled.
    """

    def of_line(line: Column, line_no: Column) -> Column:
        return F.transform(distinct_tokens(line), lambda term: F.struct(term.alias("term"), line_no.alias("line_no")))

    def marked(each: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("string")), each["term"])
        return F.zip_with(
            each, F.slice(before, F.lit(1), F.size(each)),
            lambda x, last: F.struct(x["term"], x["line_no"], (~x["term"].eqNullSafe(last)).alias("first")),
        )

    return F.transform(F.array(F.sort_array(F.flatten(F.transform(lines(text), of_line)))), marked)[0]


def line_index(
    docs: DataFrame, vocabulary: DataFrame, keep: tuple[str, ...] = (), graded: bool = False
) -> DataFrame:
    """:func:`line_terms` of the vocabulary, stored by document, with ``first``.

    ``first`` marks the first line of the document that holds the term, so what counts a
    document's terms needs no second copy of them and no distinct.
    """
    rows = in_vocabulary(line_terms(docs, keep=keep, graded=graded), vocabulary)
    order = Window.partitionBy("doc_id", "term").orderBy("line_no")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = rows.repartition(n, "doc_id").withColumn("first", F.row_number().over(order) == 1)
    return scale.stored_by(marked, "doc_id", "line-index", ("doc_id", "term", "line_no"), n)


def postings(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, term, tf): how often each term occurs in each text."""
    return (
        docs.select(doc, F.explode(tokens(text)).alias("term"))
        .groupBy(doc, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def row_count(df: DataFrame) -> Column:
    """Number of rows, as a scalar subquery."""
    return df.agg(F.count(F.lit(1))).scalar()


def term_document_freq(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, df, n_docs): document frequency of every term of the corpus."""
    return (
        doc_terms(docs, doc, text)
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
        .withColumn("n_docs", row_count(docs))
    )


def jd_postings(jds: DataFrame, min_length: int = MIN_TERM_LENGTH) -> DataFrame:
    """(item_id, term, tf) of every JD term long enough to be a key term."""
    return postings(jds, "item_id").filter(F.length("term") >= min_length)


def in_vocabulary(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows whose term is in ``vocabulary``.

    No broadcast hint: adaptive execution broadcasts the vocabulary when its
    measured size allows, and otherwise joins by term, splitting hot terms.
    """
    return terms.join(vocabulary.select("term"), "term", "left_semi")


def with_totals(keys: DataFrame) -> DataFrame:
    """Key terms with the size of their JD's list, ``n_key_terms`` and ``key_tf``.

    Each row carries the totals, so that scores per pair need no further join
    with the JDs.
    """
    totals = keys.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n_key_terms"), F.sum("tf").alias("key_tf")
    )
    return keys.join(totals, "item_id")


def key_terms(
    jd_terms: DataFrame, cv_hits: DataFrame, n_docs: Column, max_df_percent: int = MAX_DF_PERCENT
) -> DataFrame:
    """(item_id, term, tf, df): JD terms at most ``max_df_percent`` of the CVs hold.

    ``cv_hits`` are the (doc_id, term) rows of the corpus, at least for the JD
    vocabulary.  A term that no CV has stays, with df 0.
    """
    df = cv_hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return (
        jd_terms.join(df, "term", "left")
        .withColumn("df", F.coalesce("df", F.lit(0)))
        .filter(F.col("df") * 100 <= n_docs * max_df_percent)
        .select("item_id", "term", "tf", "df")
    )


def corpus_key_terms(
    cvs: DataFrame, jds: DataFrame, min_length: int = MIN_TERM_LENGTH, max_df_percent: int = MAX_DF_PERCENT
) -> tuple[DataFrame, DataFrame]:
    """(key terms with totals, JD postings), for what needs no terms of single CVs.

    Document frequencies are counted in one pass over the texts, and nothing of them is stored.
    """
    postings_ = scale.materialize(jd_postings(jds, min_length), "jd-terms")
    found = in_vocabulary(doc_terms(cvs), postings_)
    keys = scale.materialize(key_terms(postings_, found, row_count(cvs), max_df_percent), "key-terms")
    return with_totals(keys), postings_
