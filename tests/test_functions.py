"""Traps and boundaries of the column functions."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from pairwright.functions import prompts, rules, text
from pairwright.functions import values as V
from pairwright.operators import completion, interview


def one(spark, *columns, **values):
    names = list(values)
    schema = ", ".join(f"{n} {'double' if isinstance(v, float) else 'bigint' if isinstance(v, int) else 'string'}"
                       for n, v in values.items())
    df = spark.createDataFrame([tuple(values.values())], schema) if names else spark.range(1)
    return tuple(df.select(*columns).first())


@pytest.mark.parametrize(
    ("raw", "want"),
    [("\n\t a b \n", "a b"), (" x ", "x"), ("   ", ""), ("", ""), ("a  b", "a  b"), (None, None)],
)
def test_strip_text(spark, raw, want):
    assert one(spark, text.strip_text("t"), text.is_blank("t"), t=raw) == (want, not want)


def test_one_sided_strips(spark):
    got = one(spark, text.strip_left("t"), text.strip_right("t"), t="  a b \n")
    assert got == ("a b \n", "  a b")
    assert one(spark, text.strip_right("t"), t=" \n ") == ("",)


@pytest.mark.parametrize(
    ("raw", "n", "label"),
    [("", 0, "Chưa có nội dung"), (" \n", 0, "Chưa có nội dung"), ("a b  c", 3, "3 từ")],
)
def test_word_count(spark, raw, n, label):
    assert one(spark, text.word_count("t"), text.word_label("t"), t=raw) == (n, label)


def test_tokens_keep_vietnamese_letters(spark):
    assert one(spark, text.tokens("t"), t="Kỹ-năng: SQL3, và Đội!") == (["kỹ", "năng", "sql3", "và", "đội"],)


@pytest.mark.parametrize(("v", "want"), [(-5.0, 0.0), (50.0, 50.0), (140.0, 100.0)])
def test_clamp(spark, v, want):
    assert one(spark, rules.clamp("v", 0.0, 100.0), v=v) == (want,)


def test_clamp_keeps_null_and_nan(spark):
    nan, null = spark.range(1).select(
        rules.clamp(F.lit(float("nan")), 0.0, 100.0), rules.clamp(F.lit(None).cast("double"), 0.0, 100.0)
    ).first()
    assert math.isnan(nan) and null is None


@pytest.mark.parametrize("n", [30, 31])
def test_preview_text(spark, n):
    want = V.PREVIEW_LABEL if n == 30 else "x" * 30 + "…"
    assert one(spark, text.preview_text("t"), t=" " + "x" * n + "\n") == (want,)


def test_small_renderings(spark):
    assert one(spark, text.slug_to_name("t"), t="a-b-c") == ("a b c",)
    assert one(spark, text.slug_to_name("t"), t="") == (V.DEFAULT_INDUSTRY,)
    assert one(spark, text.copy_text("s", "c"), s="Hi", c="body") == ("Subject: Hi\n\nbody",)
    assert one(spark, text.copy_text("s", "c"), s="", c="body") == ("body",)


def test_request_key_separates_texts(spark):
    def key(a, b):
        return one(spark, text.request_key("k", "t", "a", "b"), k="email", t="x", a=a, b=b)[0]

    keys = {key("ab", "c"), key("a", "bc"), key("", "abc"), key(None, "abc"), key("a:b", "c")}
    assert len(keys) == 5
    assert all(k.startswith("email:x:") for k in keys)


@pytest.mark.parametrize(
    ("score", "report", "result", "message", "rubric"),
    [
        (39, "Cần Cố Gắng", 2, "needs_work", "Below expectations"),
        (40, "Cần Cố Gắng", 2, "needs_work", "Average"),
        (59, "Cần Cố Gắng", 2, "needs_work", "Average"),
        (60, "Cần Cố Gắng", 1, "needs_work", "Average"),
        (64, "Cần Cố Gắng", 1, "needs_work", "Average"),
        (65, "Khá Tốt", 1, "needs_work", "Good"),
        (74, "Khá Tốt", 1, "needs_work", "Good"),
        (75, "Khá Tốt", 1, "ready", "Good"),
        (84, "Khá Tốt", 1, "ready", "Good"),
        (85, "Rất Tốt", 0, "ready", "Excellent"),
    ],
)
def test_score_bands(spark, score, report, result, message, rubric):
    kinds = ("report_label", "result_label", "result_message", "rubric")
    got = one(spark, *[rules.score_band("s", k, brand="X") for k in kinds], s=score)
    label = V.RESULT_LABEL_BANDS[result][1].replace("{brand}", "X")
    assert got == (report, label, message, rubric)


@pytest.mark.parametrize(("s", "band"), [(49, "0-49"), (50, "50-89"), (89, "50-89"), (90, "90-100")])
def test_confidence_band(spark, s, band):
    assert one(spark, rules.confidence_band("s"), s=s) == (band,)


def test_question_strategy_prefers_the_opening(spark):
    pick = rules.question_strategy("c", "t")
    assert one(spark, pick, c=1, t=1) == (V.STRATEGY_INTRO,)
    assert one(spark, pick, c=5, t=5) == (V.STRATEGY_FINAL,)
    assert one(spark, pick, c=2, t=5) == (V.STRATEGY_DEEP,)


def test_progress_and_pct(spark):
    assert one(spark, rules.progress_pct("c", "t"), c=1, t=4) == (25.0,)
    assert one(spark, rules.progress_pct("c", "t"), c=1, t=0) == (None,)
    assert one(spark, rules.pct("c", "t"), c=1, t=0) == (0,)
    assert one(spark, rules.pct("c", "t"), c=1, t=8) == (13,)


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ("ờ ừm", 30),
        ("tôi làm việc với React và TypeScript", 100),
        ("ờ tôi thì là làm việc à thì là React", 0),
        ("một hai ba bốn năm sáu bảy tám chín ờ", 50),
        ("Alibaba đã thì làm việc ở đây nhiều năm", 100),
    ],
)
def test_confidence_score(spark, answer, want):
    assert one(spark, interview.confidence_score("t"), t=answer) == (want,)


@pytest.mark.parametrize(
    ("kind", "subject", "n", "want"),
    [
        ("zalo", "", 149, []), ("zalo", "", 150, ["too_long"]), ("zalo", "s", 1, ["subject_not_allowed"]),
        ("linkedin", "", 199, []), ("linkedin", " ", 200, ["too_long"]),
        ("email", "", 1, ["subject_missing"]), ("email", "s", 900, []), ("other", "", 900, []),
    ],
)
def test_channel_rules(spark, kind, subject, n, want):
    check = completion.check_channel_rules("k", "s", "c")
    assert one(spark, check, k=kind, s=subject, c="w " * n) == (want,)


def test_prompts(spark):
    assert one(spark, prompts.ensure_json_instruction("p"), p="as json") == ("as json",)
    assert one(spark, prompts.ensure_json_instruction("p"), p="x") == ("x" + V.JSON_INSTRUCTION,)
    assert one(spark, prompts.channel_label("k"), k="fax") == ("fax",)
    zalo, custom, ignored = (
        one(spark, prompts.writer_prompt("k", F.lit("t"), "c"), k=k, c=c)[0]
        for k, c in (("zalo", "extra"), ("custom", "extra"), ("custom", ""))
    )
    assert "150" in zalo and "extra" not in zalo
    assert "extra" in custom and "YÊU CẦU" not in ignored


def test_prompt_text_with_braces_is_not_a_slot(spark):
    got = one(spark, prompts.match_input("c", "j"), c="{jd}", j="J")
    assert got == ("CV:\n{jd}\n\nJob Description:\nJ",)
