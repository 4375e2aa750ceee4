"""Metrics of interview answers, their roll-up, and category scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.functions import values as V
from pairwright.functions.rules import int_div, pct, rounded_mean, score_band
from pairwright.functions.text import distinct_tokens, is_blank, phrase_count, tokens, word_count

SHORT_ANSWER_WORDS = 5
SHORT_ANSWER_SCORE = 30
VOCABULARY_CUTS = (5, 15, 30)


def answers(turns: DataFrame) -> DataFrame:
    return turns.filter(F.col("role") == "user")


def confidence_score(text: str = "text", fillers: Sequence[str] = V.FILLERS) -> Column:
    """Fluency of an answer: filler words cost points, very short answers score 30."""
    n = word_count(text)
    spoken = int_div(F.lit(500) * phrase_count(tokens(text), fillers), n)
    return (
        F.when(n < SHORT_ANSWER_WORDS, F.lit(SHORT_ANSWER_SCORE))
        .otherwise(F.greatest(F.lit(100) - spoken, F.lit(0)))
        .cast("bigint")
    )


def jd_term_lists(keys: DataFrame, postings: DataFrame) -> DataFrame:
    """(item_id, key_list, n_key_terms, vocabulary): a JD's key terms and all its terms as arrays.

    ``postings``: (item_id, term, tf).  Every list comes from a single JD text, so its size is
    that of one row.
    """
    listed = keys.groupBy("item_id").agg(
        F.collect_list("term").alias("key_list"), F.count(F.lit(1)).alias("n_key_terms")
    )
    vocabulary = postings.groupBy("item_id").agg(F.collect_list("term").alias("vocabulary"))
    return vocabulary.join(listed, "item_id", "left")


def vocabulary_rating(share: Column, cuts: Sequence[int] = VOCABULARY_CUTS) -> Column:
    """Rating of a percentage: the cuts separate the four levels from below."""
    out = None
    for cut, label in zip(cuts, V.VOCABULARY_RATINGS, strict=False):
        out = F.when(share < cut, label) if out is None else out.when(share < cut, label)
    return out.otherwise(V.VOCABULARY_RATINGS[-1])


def turn_metrics(
    turns: DataFrame, interviews: DataFrame, lists: DataFrame, fillers: Sequence[str] = V.FILLERS
) -> DataFrame:
    """Turns with ``answered``, ``tech_share`` and the three metrics of each answer, in one pass.

    ``interviews``: (conv_id, item_id).  ``lists`` come from :func:`jd_term_lists`; write them
    first, so that the planner knows their size.  An answer is measured by the interview's own JD:
    relevance by its key terms, vocabulary by all its terms.  NULL metrics mark turns that
    are no answers.  Works on a stream as on a table, as both joins are with static tables.
    """
    about = interviews.join(lists, "item_id", "left")
    rows = turns.join(about, "conv_id", "left")
    none = F.array().cast("array<string>")
    said, user = tokens("text"), F.col("role") == "user"
    hits = F.size(F.array_intersect(distinct_tokens("text"), F.coalesce("key_list", none)))
    technical = F.size(F.filter(said, lambda t: F.array_contains(F.coalesce("vocabulary", none), t)))
    share = pct(technical, F.size(said))
    return rows.select(
        "conv_id", "turn", "role", "text", "item_id",
        (user & ~is_blank("text")).alias("answered"),
        F.when(user, confidence_score("text", fillers)).alias("confidence_score"),
        F.when(user, F.coalesce(pct(hits, "n_key_terms"), F.lit(0))).alias("jd_relevance_score"),
        F.when(user, share).alias("tech_share"),
        F.when(user, vocabulary_rating(share)).alias("tech_vocab_rating"),
    )


def jd_relevance_score(metrics: DataFrame) -> DataFrame:
    """Answers with the share of the interview's JD key terms they mention; 0 without key terms."""
    return answers(metrics).select("conv_id", "turn", "item_id", "jd_relevance_score")


def tech_vocab_rating(metrics: DataFrame) -> DataFrame:
    """Answers with the share of technical tokens and its rating."""
    return answers(metrics).select("conv_id", "turn", "tech_share", "tech_vocab_rating")


def metrics_rollup(metrics: DataFrame) -> DataFrame:
    """Latest metrics and integer means per conversation.

    ``metrics`` come from :func:`turn_metrics`.  A conversation without an answer shows the
    initial 100 / 100 / TỐT, and NULL means.
    """
    user = F.col("role") == "user"
    names = ("confidence_score", "jd_relevance_score", "tech_vocab_rating")
    rolled = metrics.groupBy("conv_id").agg(
        F.max_by(F.struct(*names), F.when(user, F.col("turn"))).alias("l"),
        F.count_if(user).alias("n_answers"),
        F.sum("confidence_score").alias("cs"),
        F.sum("jd_relevance_score").alias("rs"),
    )
    return rolled.select(
        "conv_id", "n_answers",
        F.coalesce("l.confidence_score", F.lit(V.INITIAL_CONFIDENCE)).alias("confidence_score"),
        F.coalesce("l.jd_relevance_score", F.lit(V.INITIAL_RELEVANCE)).alias("jd_relevance_score"),
        F.coalesce("l.tech_vocab_rating", F.lit(V.INITIAL_VOCABULARY)).alias("tech_vocab_rating"),
        rounded_mean("cs", "n_answers").alias("avg_confidence"),
        rounded_mean("rs", "n_answers").alias("avg_relevance"),
    )


# --- category scores: (interview_id, category, score) ---------------------------------


def category_means(scores: DataFrame) -> DataFrame:
    """(interview_id, category, score): integer mean per category."""
    return scores.groupBy("interview_id", "category").agg(
        rounded_mean(F.sum("score"), F.count("score")).alias("score")
    )


def sub_score_grid(scores: DataFrame, categories: Sequence[str] = V.REPORT_CATEGORIES) -> DataFrame:
    """One column per named category, and whether exactly the named ones are there."""
    means = category_means(scores)
    # Categories are few after the means, so plain conditional sums make the grid.
    cells = [
        F.max(F.when(F.col("category") == c, F.col("score"))).alias(c) for c in categories
    ]
    named = F.count_if(F.col("category").isin(list(categories)))
    return means.groupBy("interview_id").agg(
        *cells,
        ((F.count(F.lit(1)) == len(categories)) & (named == len(categories))).alias("complete"),
    )


def overall_score(scores: DataFrame) -> DataFrame:
    """(interview_id, overall_score, label): integer mean of the category means."""
    total = rounded_mean(F.sum("score"), F.count("score"))
    return (
        category_means(scores)
        .groupBy("interview_id")
        .agg(total.alias("overall_score"))
        .withColumn("label", score_band("overall_score", "report_label"))
    )


def strengths_and_gaps(scores: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` best and ``k`` worst categories of each interview, ties by name."""
    means = category_means(scores)
    sides = {
        "strength": Window.partitionBy("interview_id").orderBy(F.desc("score"), "category"),
        "gap": Window.partitionBy("interview_id").orderBy("score", "category"),
    }
    ranked = means.withColumns({f"r_{s}": F.row_number().over(w) for s, w in sides.items()})
    chosen = F.filter(
        F.array(
            *[F.struct(F.lit(s).alias("side"), F.col(f"r_{s}").alias("rank")) for s in sides]
        ),
        lambda x: x["rank"] <= k,
    )
    return ranked.select("interview_id", "category", "score", F.inline(chosen))
