"""Interview turns: roles, messages, pairing, progress and counts.

A turn is (conv_id, turn, role, text) with ``turn`` a position from 0, unique
within its conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions import values as V
from pairwright.functions.rules import progress_pct
from pairwright.functions.text import is_blank
from pairwright.plans import scale


def _is_user() -> Column:
    return F.col("role") == "user"


def _is_assistant() -> Column:
    return F.col("role") == "assistant"


def normalize_roles(turns: DataFrame) -> DataFrame:
    """``assistant`` stays, every other role becomes ``user``."""
    return turns.withColumn("role", F.when(_is_assistant(), "assistant").otherwise("user"))


def project_history(turns: DataFrame) -> DataFrame:
    """Role and content only; feedback and hints stay behind."""
    return turns.select("conv_id", "turn", "role", F.col("text").alias("content"))


# --- building messages ---------------------------------------------------------------


def build_messages(history: DataFrame, system: DataFrame) -> DataFrame:
    """(conv_id, position, role, content): the system row at 0, the history after it."""
    first = system.select(
        "conv_id", F.lit(0).cast("bigint").alias("position"), F.lit("system").alias("role"), "content"
    )
    rest = history.select("conv_id", (F.col("turn") + 1).alias("position"), "role", "content")
    return first.unionByName(rest)


def append_response(turns: DataFrame, responses: DataFrame, brand: str = V.BRAND) -> DataFrame:
    """History with each response as a further assistant row.

    ``responses``: (conv_id, next_question, hint_for_user).  A NULL question is a
    failed call and adds the fixed apology without a hint.
    """
    ends = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    failed = F.col("next_question").isNull()
    added = responses.join(ends, "conv_id", "left").select(
        "conv_id",
        (F.coalesce("last", F.lit(-1)) + 1).alias("turn"),
        F.lit("assistant").alias("role"),
        F.when(failed, V.APOLOGY.replace("{brand}", brand)).otherwise(F.col("next_question")).alias("text"),
        F.when(~failed, F.col("hint_for_user")).alias("hint_for_user"),
    )
    return turns.unionByName(added, allowMissingColumns=True)


def seed_empty_history(turns: DataFrame, interviews: DataFrame) -> DataFrame:
    """Turns plus one start cue for each interview without any."""
    empty = interviews.select("conv_id").join(
        turns.select("conv_id").distinct(), "conv_id", "left_anti"
    )
    seeds = empty.select(
        "conv_id",
        F.lit(0).cast("bigint").alias("turn"),
        F.lit("user").alias("role"),
        F.lit(V.START_CUE).alias("text"),
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(seeds)


def flatten_history(turns: DataFrame, block: int = scale.BLOCK, limit: int = scale.SEGMENT) -> DataFrame:
    """(conv_id, segment, history): ``role: text`` lines in order, in segments beyond ``limit`` characters."""
    line = F.concat(F.col("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    size = F.coalesce(F.length(line), F.lit(0))
    return scale.ordered_segments(turns, "conv_id", "turn", line, size, "lines", block, limit).select(
        "conv_id", "segment", F.array_join("lines", "\n").alias("history")
    )


# --- order-dependent walks -------------------------------------------------------------


def qa_pairs(turns: DataFrame, block: int = scale.BLOCK) -> DataFrame:
    """(conv_id, turn, question, answer): answers with the latest earlier question.

    Answers before any question are dropped.
    """
    rows = scale.carry_forward(
        turns.select("conv_id", "turn", "role", "text"),
        "conv_id",
        "turn",
        lasts={"question": F.when(_is_assistant(), F.col("text"))},
        block=block,
    )
    return rows.filter(_is_user() & F.col("question").isNotNull()).select(
        "conv_id", "turn", "question", F.col("text").alias("answer")
    )


def attach_feedback(turns: DataFrame, feedback: str, block: int = scale.BLOCK) -> DataFrame:
    """User rows with the feedback that came with the response right after them."""
    rows = scale.next_value(
        turns.select("conv_id", "turn", "role", "text", feedback),
        "conv_id",
        "turn",
        F.when(_is_assistant(), F.col(feedback)),
        "received_feedback",
        block,
    )
    return rows.filter(_is_user()).select(
        "conv_id", "turn", "text", F.col("received_feedback").alias("feedback")
    )


def latest_prompt(turns: DataFrame, hint: str = "hint_for_user") -> DataFrame:
    """(conv_id, prompt, hint): the last assistant text, and the hint to show.

    The hint is the last message's own, if that message is the assistant's and
    its hint is not empty; otherwise the fixed waiting text.
    """
    last = F.max_by(F.struct("role", F.col(hint).alias("hint")), F.col("turn")).alias("last")
    rows = turns.groupBy("conv_id").agg(
        F.max_by("text", F.when(_is_assistant(), F.col("turn"))).alias("prompt"), last
    )
    usable = (F.col("last.role") == "assistant") & (F.length("last.hint") > 0)
    return rows.select(
        "conv_id", "prompt", F.when(usable, F.col("last.hint")).otherwise(V.DEFAULT_HINT).alias("hint")
    )


def question_progress(
    turns: DataFrame, total: int = V.DEFAULT_TOTAL_QUESTIONS, block: int = scale.BLOCK
) -> DataFrame:
    """Turns with ``question_no`` and ``finishes``, up to the answer that ends the interview.

    ``question_no`` counts earlier answers from 1 and stops at ``total``.  The
    answer given at ``total`` ends the interview; later rows are left out.
    Blank answers are never sent, so they do not count.
    """
    answered = _is_user() & ~is_blank("text")
    rows = scale.carry_forward(
        turns.select("conv_id", "turn", "role", "text"),
        "conv_id",
        "turn",
        sums={"answers_before": answered.cast("bigint")},
        block=block,
    )
    return rows.filter(F.col("answers_before") < total).select(
        "conv_id", "turn", "role", "text",
        F.least(F.col("answers_before") + 1, F.lit(total)).alias("question_no"),
        (answered & (F.col("answers_before") == total - 1)).alias("finishes"),
    )


# --- counts ------------------------------------------------------------------------------


def role_counts(turns: DataFrame) -> DataFrame:
    """Messages per role, and whether the first question is completed."""
    return (
        turns.groupBy("conv_id")
        .agg(
            F.count_if(_is_user()).alias("n_user"), F.count_if(_is_assistant()).alias("n_assistant")
        )
        .withColumn("first_completed", (F.col("n_user") >= 1) & (F.col("n_assistant") >= 2))
    )


def question_totals(turns: DataFrame, block: int = scale.BLOCK) -> DataFrame:
    """(conv_id, n_questions): analysed question-answer turns, 0 where there are none."""
    rows = scale.carry_forward(
        turns.select("conv_id", "turn", "role", F.col("text").isNotNull().alias("has_text")),
        "conv_id",
        "turn",
        sums={"asked_before": (_is_assistant() & F.col("has_text")).cast("bigint")},
        block=block,
    )
    return rows.groupBy("conv_id").agg(
        F.count_if(_is_user() & (F.col("asked_before") > 0)).alias("n_questions")
    )


def completion(turns: DataFrame, total: int = V.DEFAULT_TOTAL_QUESTIONS) -> DataFrame:
    """(conv_id, answered, progress): answered questions as a share of the total.

    Blank answers are never sent, so they do not count, as in ``question_progress``.
    """
    sent = F.count_if(_is_user() & ~is_blank("text"))
    answered = F.least(sent, F.lit(total)).alias("answered")
    return (
        turns.groupBy("conv_id")
        .agg(answered)
        .withColumn("progress", progress_pct(F.col("answered"), F.lit(total)))
    )
