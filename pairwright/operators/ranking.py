"""The best CVs of each JD without scoring every pair.

A pair's score is what the CV brings by itself (layout, evidence) and what its key
terms add.  The second part is bounded term by term: with the key terms of a JD in
order, most frequent in the corpus first, a CV whose rarest term of that JD is the
r-th holds at most the first r.  So:

1. *Floors.*  A JD first tries the CVs that hold its rarest terms and, for each other term, the
   champions: those that bring most by themselves.  The best of these by these terms are scored
   in full; their k-th score is a lower bound of the JD's k-th score.
2. *Candidates.*  From the floor follows what a CV must bring by itself for its r-th term
   to matter at all.  The postings are laid out by that impact, in levels; a key term meets
   only the levels that can matter, so frequent terms of weak CVs are never joined.
3. A candidate's terms above its level are all known now; those below it are bounded.
   Candidates that still cannot reach the floor go.
4. *Scores.*  The remaining pairs are scored in full and ranked.

A pair goes only where its bound, rounded as the score is, lies below the floor, so the ranking and its
ties are those over all pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.functions.rules import int_div, pct
from pairwright.operators.matching import EQUAL, OWN, MatchInputs, _mean, match_score, rank_candidates, score_lines
from pairwright.plans import scale

LEVELS = 40  #: of what a CV brings by itself
DIRECT = 50_000_000  #: postings


def _added(hits: Column, tf: Column, line: Column, weights: Sequence[int]) -> Column:
    """The weighted total that so many terms add, ``line`` of them on one line."""
    cover, technical, relevance = weights[:3]
    n, key_tf = F.col("n_key_terms"), F.col("key_tf")
    return cover * pct(hits, n) + technical * pct(tf, key_tf) + relevance * pct(line, n)


def _postings(inputs: MatchInputs, weights: Sequence[int]) -> DataFrame:
    """(doc_id, term, own): each CV's terms with what it brings by itself."""
    own = sum((F.col(c) * w for c, w in zip(OWN, weights[3:], strict=True)), start=F.lit(0))
    return inputs.hits.select("doc_id", "term", own.cast("bigint").alias("own"))


def floors(inputs: MatchInputs, k: int, weights: Sequence[int] = EQUAL, seeds: int = 50) -> DataFrame:
    """(item_id, floor): a score that the ``k``-th best CV of the JD reaches at least.

    CVs are tried by a JD's rarest terms, as long as these have at most ``seeds`` times ``k``
    postings in all, and by the ``k`` champions of each other term; more seeds give a higher
    floor.  The ``2 k`` that these terms favour are scored in full.  A JD that meets fewer than
    ``k`` CVs so has no row.
    """
    rarest = Window.partitionBy("item_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, 0)
    keys = inputs.keys.withColumn("rare", F.sum("df").over(rarest) <= seeds * k).drop("df")
    strongest = Window.partitionBy("term").orderBy(F.desc("own"), "doc_id")
    postings = _postings(inputs, weights)
    best = postings.withColumn("place", F.row_number().over(strongest)).filter(F.col("place") <= k).drop("place")
    met = postings.join(keys.filter("rare"), "term").unionByName(best.join(keys.filter(~F.col("rare")), "term"))
    pairs = met.groupBy("item_id", "doc_id").agg(
        F.count(F.lit(1)).alias("h"), F.sum("tf").alias("t"),
        *[F.max(c).alias(c) for c in ("own", "n_key_terms", "key_tf")],
    )
    bound = F.col("own") + _added(F.col("h"), F.col("t"), F.lit(1), weights)
    tried = rank_candidates(pairs.select("item_id", "doc_id", bound.alias("bound")), 2 * k, "bound")
    scored = score_lines(pair_lines(inputs, by_document(tried)), weights)
    return rank_candidates(scored, k).filter(F.col("rank") == k).select("item_id", F.col("match_score").alias("floor"))


def needs(keys: DataFrame, least: DataFrame, weights: Sequence[int] = EQUAL) -> DataFrame:
    """Key terms with ``r``, their place, and ``need``: what a CV must bring for them to matter.

    A CV without any of the terms after the r-th adds at most ``cum_tf`` and r hits.
    """
    frequent = Window.partitionBy("item_id").orderBy(F.desc("df"), "term")
    placed = keys.withColumns(
        {"r": F.row_number().over(frequent), "cum_tf": F.sum("tf").over(frequent.rowsBetween(Window.unboundedPreceding, 0))}
    )
    reach = _added(F.col("r"), F.col("cum_tf"), F.col("r"), weights)
    placed = placed.join(least, "item_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0)))
    # the smallest total that rounds to the floor, less what the terms can add
    total = F.ceil(sum(weights) * (2 * F.col("floor") - 1) / F.lit(2))
    return placed.withColumn("need", (total - reach).cast("bigint"))


def _width(weights: Sequence[int]) -> int:
    """Impacts from 0 to the most a CV can bring, in at most ``LEVELS`` + 1 levels."""
    return max(1, -(-100 * sum(weights[3:]) // LEVELS))


def leveled(keys: DataFrame, weights: Sequence[int] = EQUAL) -> DataFrame:
    """Key terms once for each level of impact at which they can matter.

    Needs fall along a JD's terms, so what does not matter at a level are its first ``below``
    terms, with ``below_tf`` in all.
    """
    width = _width(weights)
    lowest = F.greatest(int_div(F.col("need"), F.lit(width)), F.lit(0)).cast("int")
    top = 100 * sum(weights[3:]) // width
    rows = keys.filter(lowest <= top).withColumn("level", F.explode(F.sequence(lowest, F.lit(top))))
    same = Window.partitionBy("item_id", "level")
    return rows.select(
        "item_id", "term", "level", "tf", "n_key_terms", "key_tf", "floor",
        (F.min("r").over(same) - 1).alias("below"),
        F.min(F.col("cum_tf") - F.col("tf")).over(same).alias("below_tf"),
    )


def essential_hits(inputs: MatchInputs, levels: DataFrame, weights: Sequence[int] = EQUAL) -> DataFrame:
    """Postings with the key terms that can lift their pair to the floor."""
    level = int_div(F.col("own"), F.lit(_width(weights))).cast("int")
    return _postings(inputs, weights).withColumn("level", level).join(levels, ["term", "level"])


def candidates(inputs: MatchInputs, k: int, weights: Sequence[int] = EQUAL) -> DataFrame:
    """(doc_id, item_id): the pairs that can be among the ``k`` best of their JD."""
    least = floors(inputs, k, weights)
    levels = scale.materialize(leveled(needs(inputs.keys, least, weights), weights), "key-levels")
    same = ("own", "n_key_terms", "key_tf", "floor", "below", "below_tf")
    pairs = essential_hits(inputs, levels, weights).groupBy("doc_id", "item_id").agg(
        F.count(F.lit(1)).alias("h"), F.sum("tf").alias("t"), *[F.max(c).alias(c) for c in same]
    )
    hits = F.col("h") + F.col("below")
    bound = _mean(F.col("own") + _added(hits, F.col("t") + F.col("below_tf"), hits, weights), weights)
    return pairs.filter(bound >= F.col("floor")).select("doc_id", "item_id")


def by_document(pairs: DataFrame) -> DataFrame:
    """(doc_id, items): the JDs that each CV is a candidate of, stored like the index."""
    asked = pairs.groupBy("doc_id").agg(F.collect_list("item_id").alias("items"))
    return scale.stored_by(asked, "doc_id", "candidates")


def pair_lines(inputs: MatchInputs, asked: DataFrame) -> DataFrame:
    """Index rows that hold a key term of a JD their CV is a candidate of.

    Index and candidates lie by document, so both joins happen where the index is.
    """
    rows = inputs.index.join(asked, "doc_id")
    keys = inputs.keys.drop("df").withColumnRenamed("term", "key_term")
    wanted = (F.col("term") == F.col("key_term")) & F.array_contains("items", F.col("item_id"))
    return rows.join(keys, wanted).drop("items", "key_term")


def top_candidates(inputs: MatchInputs, k: int, weights: Sequence[int] = EQUAL, direct: int = DIRECT) -> DataFrame:
    """The ``k`` best CVs of each JD by match score, with all scores and ``rank``.

    Equals ``rank_candidates(match_score(inputs, weights), k)``.  Weights are not negative.
    How many postings all pairs would join is the sum of ``df`` over the key terms; up to
    ``direct`` of them are joined at once, as the search for candidates would take longer.
    """
    if min(weights) < 0:
        raise ValueError("weights must not be negative")
    joined = inputs.keys.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    if joined <= direct:
        return rank_candidates(match_score(inputs, weights), k)
    asked = by_document(candidates(inputs, k, weights))
    return rank_candidates(score_lines(pair_lines(inputs, asked), weights), k)
