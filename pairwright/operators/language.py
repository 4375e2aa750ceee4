"""Main language of texts, language agreement, grounding and topics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.functions import values as V
from pairwright.functions.text import tokens
from pairwright.operators import terms

StopWords = Mapping[str, Sequence[str]]


def language_votes(token_array: Column, stop_words: StopWords = V.STOP_WORDS) -> dict[str, Column]:
    """Stop-word hits per language, counted inside the row."""

    def hits(words: Sequence[str]) -> Column:
        return F.size(F.filter(token_array, lambda t: t.isin(list(words)))).cast("bigint")

    return {lang: hits(words) for lang, words in sorted(stop_words.items())}


def most_votes(votes: Mapping[str, Column]) -> Column:
    """Language with most votes; ties go to the first code, no votes give NULL."""
    best = F.greatest(*votes.values()) if len(votes) > 1 else next(iter(votes.values()))
    out = None
    for lang, n in sorted(votes.items()):
        hit = (n == best) & (best > 0)
        out = F.when(hit, lang) if out is None else out.when(hit, lang)
    return out


def main_language(
    docs: DataFrame, text: str = "text", stop_words: StopWords = V.STOP_WORDS
) -> DataFrame:
    """Texts with ``main_lang``; row by row, without a shuffle."""
    votes = language_votes(F.col("__t"), stop_words)
    rows = docs.withColumn("__t", tokens(text)).withColumns({f"__v_{k}": v for k, v in votes.items()})
    return rows.withColumn(
        "main_lang", most_votes({k: F.col(f"__v_{k}") for k in votes})
    ).drop("__t", *[f"__v_{k}" for k in votes])


def language_consistency(
    turns: DataFrame, key: str = "conv_id", stop_words: StopWords = V.STOP_WORDS
) -> DataFrame:
    """(conv_id, user_lang, assistant_lang, consistent) per conversation.

    Votes are summed per side, so only counters are shuffled and no text.
    """
    votes = language_votes(F.col("__t"), stop_words)
    counted = turns.select(
        key, (F.col("role") == "assistant").alias("__a"), tokens("text").alias("__t")
    ).select(key, "__a", *[v.alias(k) for k, v in votes.items()])
    sides = {"user": ~F.col("__a"), "assistant": F.col("__a")}
    summed = counted.groupBy(key).agg(
        *[
            F.coalesce(F.sum(F.when(cond, F.col(k))), F.lit(0)).alias(f"{side}_{k}")
            for side, cond in sides.items()
            for k in votes
        ]
    )
    langs = {
        f"{side}_lang": most_votes({k: F.col(f"{side}_{k}") for k in votes}) for side in sides
    }
    return (
        summed.withColumns(langs)
        .select(key, *langs)
        .withColumn("consistent", F.equal_null(F.col("user_lang"), F.col("assistant_lang")))
    )


def ungrounded_terms(generated: DataFrame, held: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, term): skill terms a generated text claims and its CV lacks.

    ``held``: the stored (doc_id, term) of the CVs, at least for the vocabulary.  The generated texts are
    cut to the vocabulary before they meet it.
    """
    claimed = terms.in_vocabulary(terms.doc_terms(generated), vocabulary)
    return claimed.join(held.select("doc_id", "term"), ["doc_id", "term"], "left_anti").select("doc_id", "term")


def top_topics(
    turns: DataFrame,
    key: str = "conv_id",
    k: int = 5,
    stop_words: StopWords = V.STOP_WORDS,
    min_length: int = terms.MIN_TERM_LENGTH,
) -> DataFrame:
    """(conv_id, rank, topic, n): most frequent terms that are no stop-words."""
    stop = sorted({w for ws in stop_words.values() for w in ws})
    counted = (
        turns.select(key, F.explode(tokens("text")).alias("topic"))
        .filter(~F.col("topic").isin(stop) & (F.length("topic") >= min_length))
        .groupBy(key, "topic")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    order = Window.partitionBy(key).orderBy(F.desc("n"), "topic")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
