"""Scoring CVs against JDs.

A term joins CVs and JDs; pairs that share no key term score 0 and are never
built.  The texts are tokenised once: their terms, cut down to the vocabulary of
the JDs, are stored by document as a narrow table that document frequency, pair
scores and pair details all read.  All rows of a document lie in one bucket, so
where the key terms of the JDs are small enough to broadcast, scoring the pairs
moves no row.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.functions import values as V
from pairwright.functions.rules import int_div, pct
from pairwright.functions.text import SERVER_SPACE, has_digit, is_blank, lines
from pairwright.operators import terms
from pairwright.plans import scale

SCORE_COLUMNS = (
    "keyword_coverage", "technical_match", "experience_relevance",
    "impact_evidence", "ats_readiness",
)


FILLED = "[^" + SERVER_SPACE[1:]  #: a character that makes its line not blank


@dataclass(frozen=True)
class MatchInputs:
    """Narrow tables the pair operators share.

    ``hits``: (doc_id, term) for terms of the JD vocabulary, with the carried CV scores.
    ``keys``: (item_id, term, tf, df, n_key_terms, key_tf).  ``index``: the terms by
    line, with ``first`` and, where asked for, the grades of the line.
    """

    cvs: DataFrame
    jds: DataFrame
    hits: DataFrame
    keys: DataFrame
    index: DataFrame | None = None


def prepare(
    cvs: DataFrame,
    jds: DataFrame,
    by_line: bool = False,
    carry: Mapping[str, Column] | None = None,
    min_length: int = terms.MIN_TERM_LENGTH,
    max_df_percent: int = terms.MAX_DF_PERCENT,
    graded: bool = False,
) -> MatchInputs:
    """Tokenise the CVs once and derive the key terms.

    ``carry`` are CV-level scores to keep on the rows, so that scoring pairs needs
    neither the texts nor a join with the CVs again.  ``graded`` keeps what the evidence
    grades need of a line.
    """
    jd_terms = scale.materialize(terms.jd_postings(jds, min_length), "jd-terms")
    names, index = tuple(carry or ()), None
    if by_line:
        index = terms.line_index(cvs.withColumns(dict(carry or {})), jd_terms, names, graded)
        hits = index.filter("first").select("doc_id", "term", *names)
    else:
        found = terms.in_vocabulary(terms.doc_terms(cvs), jd_terms)
        hits = scale.stored_by(found.select("doc_id", "term"), "doc_id", "hits")
    keys = terms.key_terms(jd_terms, hits, terms.row_count(cvs), max_df_percent)
    keys = scale.materialize(terms.with_totals(keys), "key-terms")
    return MatchInputs(cvs, jds, hits, keys, index)


def candidate_pairs(cv_terms: DataFrame, jd_terms: DataFrame, min_hits: int = 1) -> DataFrame:
    """(doc_id, item_id, hits, hit_tf, n_key_terms, key_tf): pairs sharing a term.

    An equi-join on the term.  With terms stored by document and few JDs the pairs are counted
    where the documents are; otherwise the counts are combined before the shuffle.
    ``min_hits`` leaves out pairs that share fewer terms.
    """
    pairs = (
        cv_terms.join(jd_terms.drop("df"), "term")
        .groupBy("doc_id", "item_id")
        .agg(F.count(F.lit(1)).alias("hits"), F.sum("tf").alias("hit_tf"), *_totals())
    )
    return pairs.filter(F.col("hits") >= min_hits) if min_hits > 1 else pairs


def _totals() -> list[Column]:
    """The totals of a pair's JD, the same on each of its rows."""
    return [F.max(c).alias(c) for c in ("n_key_terms", "key_tf")]


def pair_coverage(inputs: MatchInputs) -> DataFrame:
    """(doc_id, item_id, hits, n_key_terms, keyword_coverage, technical_match)."""
    return candidate_pairs(inputs.hits, inputs.keys).select(
        "doc_id", "item_id", "hits", "n_key_terms",
        pct("hits", "n_key_terms").alias("keyword_coverage"),
        pct("hit_tf", "key_tf").alias("technical_match"),
    )


def keyword_coverage(inputs: MatchInputs) -> DataFrame:
    """Share of a JD's key terms that a CV holds."""
    return pair_coverage(inputs).drop("technical_match")


def technical_match(inputs: MatchInputs, skills: DataFrame | None = None) -> DataFrame:
    """Coverage weighted by how often the JD repeats a term, optionally for a
    skill vocabulary only."""
    if skills is not None:
        chosen = terms.in_vocabulary(inputs.keys, skills).select("item_id", "term", "tf", "df")
        keys = scale.materialize(terms.with_totals(chosen), "skill-terms")
        inputs = MatchInputs(inputs.cvs, inputs.jds, inputs.hits, keys)
    return pair_coverage(inputs).select("doc_id", "item_id", "technical_match")


def _per_line(met: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """(doc_id, item_id, line_no, n, firsts, tf, ...) of joined index and key rows.

    ``n`` terms are met on the line; ``firsts`` of them, with their ``tf``, for the first time in
    the document, so that over all lines each term counts once.
    """
    once = F.col("first")
    return met.groupBy("doc_id", "item_id", "line_no").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(once).alias("firsts"),
        F.sum(F.when(once, F.col("tf")).otherwise(0)).alias("tf"),
        *_totals(),
        *[F.max(c).alias(c) for c in carried],
    )


def _met(inputs: MatchInputs) -> DataFrame:
    """Every index row with the JDs that hold its term as key term."""
    return inputs.index.join(inputs.keys.drop("df"), "term")


def experience_relevance(inputs: MatchInputs) -> DataFrame:
    """Coverage of the best single line of the CV."""
    return (
        _per_line(_met(inputs))
        .groupBy("doc_id", "item_id")
        .agg(F.max("n").alias("best"), *_totals())
        .select("doc_id", "item_id", pct("best", "n_key_terms").alias("experience_relevance"))
    )


def impact_evidence(text: str = "text") -> Column:
    """Share of non-blank lines that hold a digit, in one walk over the lines."""
    start = F.struct(F.lit(0).alias("filled"), F.lit(0).alias("digit"))
    return F.aggregate(
        lines(F.coalesce(F.col(text), F.lit(""))),
        start,
        lambda n, x: F.struct(
            (n["filled"] + (~is_blank(x)).cast("int")).alias("filled"),
            (n["digit"] + has_digit(x).cast("int")).alias("digit"),
        ),
        lambda n: pct(n["digit"], n["filled"]),
    )


def ats_checks(text: str = "text", headings: Sequence[str] = V.HEADINGS) -> dict[str, Column]:
    """The five layout checks as booleans."""
    t = F.coalesce(F.col(text), F.lit(""))
    names = "|".join(re.escape(h) for h in headings)
    heading = F.lower(t).rlike(rf"(?md:^)[ \t]*#*[ \t]*(?:{names})(?:[^\p{{L}}\p{{N}}]|$)")
    return {
        "has_text": ~is_blank(text),
        "no_table": ~(F.contains(t, F.lit("|")) | F.contains(t, F.lit("\t"))),
        "no_symbol": ~t.rlike(r"\p{So}"),
        "two_lines": t.rlike(rf"\A{SERVER_SPACE}*+[^\n]*+\n{SERVER_SPACE}*+{FILLED}"),
        "has_heading": heading,
    }


def _points(checks: Mapping[str, Column]) -> Column:
    each = 100 // len(checks)
    return sum((c.cast("bigint") for c in checks.values()), start=F.lit(0).cast("bigint")) * each


def ats_readiness(
    cvs: DataFrame, headings: Sequence[str] = V.HEADINGS, text: str = "text"
) -> DataFrame:
    """CVs with the five checks and their score, 20 points each."""
    checks = ats_checks(text, headings)
    return cvs.withColumns(checks).withColumn(
        "ats_readiness", _points({c: F.col(c) for c in checks})
    )


def cv_scores(headings: Sequence[str] = V.HEADINGS, text: str = "text") -> dict[str, Column]:
    """The scores that depend on the CV alone, to carry through :func:`prepare`."""
    return {
        "impact_evidence": impact_evidence(text),
        "ats_readiness": _points(ats_checks(text, headings)),
    }


OWN = ("impact_evidence", "ats_readiness")
EQUAL = (1, 1, 1, 1, 1)


def match_score(inputs: MatchInputs, weights: Sequence[int] = EQUAL) -> DataFrame:
    """All sub-scores of each pair and their weighted integer mean.

    ``inputs`` come from ``prepare(..., by_line=True, carry=cv_scores())``.  The weights
    follow ``SCORE_COLUMNS``.
    """
    return score_lines(_met(inputs), weights)


def score_lines(met: DataFrame, weights: Sequence[int] = EQUAL) -> DataFrame:
    """The scores of the pairs in ``met``, joined rows of a line index and key terms."""
    pairs = (
        _per_line(met, OWN)
        .groupBy("doc_id", "item_id")
        .agg(
            F.sum("firsts").alias("hits"),
            F.sum("tf").alias("hit_tf"),
            F.max("n").alias("best"),
            *_totals(),
            *[F.max(c).alias(c) for c in OWN],
        )
    )
    scored = pairs.select(
        "doc_id", "item_id",
        pct("hits", "n_key_terms").alias("keyword_coverage"),
        pct("hit_tf", "key_tf").alias("technical_match"),
        pct("best", "n_key_terms").alias("experience_relevance"),
        *OWN,
    )
    total = sum((F.col(c) * w for c, w in zip(SCORE_COLUMNS, weights, strict=True)), start=F.lit(0))
    return scored.withColumn("match_score", _mean(total, weights))


def _mean(total: Column, weights: Sequence[int]) -> Column:
    """Integer mean of a weighted total, halves up."""
    return int_div(2 * total + sum(weights), F.lit(2 * sum(weights))).cast("bigint")


def rank_candidates(scores: DataFrame, k: int, score: str = "match_score") -> DataFrame:
    """The ``k`` best CVs of each JD with their rank; ties go to the lower doc_id.

    Each task keeps its own best ``k`` per JD before the shuffle, so a JD that
    matches very many CVs moves no more rows than any other.
    """
    best_first = Window.partitionBy("item_id").orderBy(F.desc(score), "doc_id")
    return scores.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)
