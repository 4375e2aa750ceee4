"""Interviews in progress: history length, question number, latest metrics.

What is kept of a conversation does not depend on the order in which its turns come: which
turns were seen, its first answers in turn order, and its last one.  Two such summaries merge
into one, and merging a summary twice changes nothing.  So a turn may come a batch late or again, and
state may be dropped at a timeout: what is emitted after it merges with what was before.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pairwright.functions import values as V
from pairwright.functions.rules import int_div
from pairwright.operators.conversations import question_progress

BLOCK = 4096
METRICS = ("confidence_score", "jd_relevance_score", "tech_vocab_rating")
# ``seen``: a bit for each turn of the block, lowest first.  ``first_answers``: JSON list of the
# first answers of the block, as many as an interview has questions.
STATE_SCHEMA = "seen binary, answers binary, first_answers string, last_answer string"
OUTPUT_SCHEMA = f"conv_id bigint, block bigint, {STATE_SCHEMA}"
ANSWER = T.StructType(
    [
        T.StructField("turn", T.LongType()),
        T.StructField("confidence_score", T.LongType()),
        T.StructField("jd_relevance_score", T.LongType()),
        T.StructField("tech_vocab_rating", T.StringType()),
    ]
)
INITIAL = dict(zip(METRICS, (V.INITIAL_CONFIDENCE, V.INITIAL_RELEVANCE, V.INITIAL_VOCABULARY), strict=True))


def _bits(held: bytes) -> int:
    return int.from_bytes(held, "little")


def _bytes(bits: int) -> bytes:
    return bits.to_bytes((bits.bit_length() + 7) // 8, "little")


def _advance(total: int, ttl_ms: int, block: int):
    def step(
        key: tuple, frames: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = tuple(state.get) if state.exists else (b"", b"", "[]", None)
        seen, answers = _bits(held[0]), _bits(held[1])
        firsts = {a["turn"]: a for a in json.loads(held[2])}
        latest = json.loads(held[3]) if held[3] else None
        for rows in frames:
            for row in rows.itertuples(index=False):
                bit = 1 << int(row.turn) % block
                if seen & bit:
                    continue
                seen |= bit
                if not row.answered:
                    continue
                answers |= bit
                answer = {
                    "turn": int(row.turn),
                    "confidence_score": int(row.confidence_score),
                    "jd_relevance_score": int(row.jd_relevance_score),
                    "tech_vocab_rating": row.tech_vocab_rating,
                }
                if latest is None or answer["turn"] > latest["turn"]:
                    latest = answer
                firsts[answer["turn"]] = answer
                if len(firsts) > total:
                    firsts.pop(max(firsts))
        listed = [firsts[t] for t in sorted(firsts)]
        last = json.dumps(latest, ensure_ascii=False) if latest else None
        after = (_bytes(seen), _bytes(answers), json.dumps(listed, ensure_ascii=False), last)
        if after != held:
            state.update(after)
            yield pd.DataFrame([(*key, *after)], columns=["conv_id", "block", "seen", "answers", "first_answers", "last_answer"])
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)

    return step


def stream_interviews(
    scored: DataFrame, total: int = V.DEFAULT_TOTAL_QUESTIONS, ttl_ms: int = 0, block: int = BLOCK
) -> DataFrame:
    """Stream of turns with metrics to a stream of summaries per conversation and block.

    Of turns that come again the first counts, as far as state remembers it.  Where an interview ends
    depends on all its blocks, so :func:`current_states` decides it.  ``ttl_ms`` drops idle
    state of a stream that runs on; leave it 0 for a run over what is there now.
    """
    timeout = (
        GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    )
    return (
        scored.select(
            "conv_id", int_div(F.col("turn"), F.lit(block)).cast("bigint").alias("block"), "turn",
            F.coalesce("answered", F.lit(False)).alias("answered"), *METRICS,
        )
        .groupBy("conv_id", "block")
        .applyInPandasWithState(_advance(total, ttl_ms, block), OUTPUT_SCHEMA, STATE_SCHEMA, "append", timeout)
    )


def _up_to(bits: Column, place: Column) -> Column:
    """Number of bits set at places up to ``place``."""
    whole = int_div(place, F.lit(8)).cast("int")
    next_byte = F.conv(F.hex(F.substring(bits, whole + 1, F.lit(1))), 16, 10).cast("int")
    mask = F.element_at(F.array(*[F.lit((2 << i) - 1) for i in range(8)]), (place % 8 + 1).cast("int"))
    return F.bitmap_count(F.substring(bits, F.lit(1), whole)) + F.coalesce(F.bit_count(next_byte.bitwiseAND(mask)), F.lit(0))


def _top_bit(bits: Column) -> Column:
    """Place of the highest bit set; bitmaps carry no empty bytes at their end."""
    digits = F.conv(F.hex(F.substring(bits, F.octet_length(bits), F.lit(1))), 16, 2)
    return (F.octet_length(bits) - 1) * 8 + F.length(digits) - 1


def merged_blocks(emitted: DataFrame, total: int) -> DataFrame:
    """(conv_id, block, seen, answers, firsts, latest): all summaries of a block in one.

    A block has at most as many summaries as batches that brought it something new.
    """
    turn = F.struct(F.col("f.turn").alias("turn"), F.col("f").alias("a"))
    listed = F.from_json("first_answers", T.ArrayType(ANSWER))
    firsts = emitted.select("conv_id", "block", F.explode(listed).alias("f")).groupBy("conv_id", "block", "f.turn")
    firsts = firsts.agg(F.min(turn)["a"].alias("f")).groupBy("conv_id", "block").agg(
        F.slice(F.sort_array(F.collect_list("f")), 1, total).alias("firsts")
    )
    latest = F.from_json("last_answer", ANSWER)
    union = {c: F.bitmap_or_agg(c) for c in ("seen", "answers")}
    bits = emitted.groupBy("conv_id", "block").agg(
        *[u.alias(c) for c, u in union.items()],
        F.max(F.octet_length("seen")).alias("n_bytes"),
        F.max_by(latest, latest["turn"]).alias("latest"),
    )
    cut = [F.substring(c, F.lit(1), F.col("n_bytes")).alias(c) for c in union]
    return bits.select("conv_id", "block", *cut, "latest").join(firsts, ["conv_id", "block"], "left")


def current_states(emitted: DataFrame, total: int = V.DEFAULT_TOTAL_QUESTIONS, block: int = BLOCK) -> DataFrame:
    """The state of each interview, up to the answer that ends it.

    Blocks are few per conversation; their answers are added up in order, and the
    block that reaches ``total`` is cut at its finishing answer.
    """
    counted = merged_blocks(emitted, total).withColumn("n_answers", F.bitmap_count("answers"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counted.withColumn("before", F.coalesce(F.sum("n_answers").over(earlier), F.lit(0))).filter(
        F.col("before") < total
    )
    left = F.lit(total) - F.col("before")
    ends = F.col("n_answers") >= left
    closing = F.when(ends, F.get("firsts", (left - 1).cast("int")))
    place = F.col("closing.turn") - F.col("block") * block
    top = F.col("block") * block + _top_bit(F.col("seen"))
    rows = blocks.select(
        "conv_id", "block", "seen",
        ends.alias("ends"),
        F.least("n_answers", left).alias("answers"),
        closing.alias("closing"),
        F.coalesce(closing, "latest").alias("answer"),
    )
    return (
        rows.groupBy("conv_id")
        .agg(
            F.max(F.coalesce("closing.turn", top)).alias("last_turn"),
            F.sum(F.when(F.col("ends"), _up_to(F.col("seen"), place)).otherwise(F.bitmap_count("seen"))).alias("n_messages"),
            F.least(F.sum("answers") + 1, F.lit(total)).alias("question_no"),
            F.bool_or("ends").alias("finished"),
            F.max_by("answer", F.when(F.col("answer").isNotNull(), F.col("block"))).alias("m"),
        )
        .select(
            "conv_id", "last_turn", "n_messages", "question_no", "finished",
            *[F.coalesce(F.col(f"m.{c}"), F.lit(INITIAL[c])).alias(c) for c in METRICS],
        )
    )


def interview_states(scored: DataFrame, total: int = V.DEFAULT_TOTAL_QUESTIONS) -> DataFrame:
    """Batch twin of :func:`stream_interviews` with :func:`current_states`."""
    metrics = scored.select("conv_id", "turn", "answered", *METRICS)
    kept = question_progress(scored, total).select("conv_id", "turn", "finishes")
    rows = kept.join(metrics, ["conv_id", "turn"])
    latest = F.max_by(F.struct(*METRICS), F.when(F.col("answered"), F.col("turn"))).alias("m")
    return (
        rows.groupBy("conv_id")
        .agg(
            F.max("turn").alias("last_turn"),
            F.count(F.lit(1)).alias("n_messages"),
            F.least(F.count_if("answered") + 1, F.lit(total)).alias("question_no"),
            F.bool_or("finishes").alias("finished"),
            latest,
        )
        .select(
            "conv_id", "last_turn", "n_messages", "question_no", "finished",
            *[F.coalesce(F.col(f"m.{c}"), F.lit(INITIAL[c])).alias(c) for c in METRICS],
        )
    )
