"""Scoring rules: percentages, bands, progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright.functions import values as V
from pairwright.functions.text import as_column


def int_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def pct(part: Column | str, whole: Column | str) -> Column:
    """Integer percentage, halves up; 0 when there is nothing to cover."""
    h, n = as_column(part).cast("bigint"), as_column(whole).cast("bigint")
    return F.when(n == 0, F.lit(0).cast("bigint")).otherwise(int_div(200 * h + n, 2 * n))


def rounded_mean(total: Column | str, count: Column | str) -> Column:
    """Integer mean of non-negative integers, halves up; NULL without values."""
    t, n = as_column(total).cast("bigint"), as_column(count).cast("bigint")
    return F.when(n > 0, int_div(2 * t + n, 2 * n))


def clamp(col: Column | str, lo: float, hi: float) -> Column:
    """Bound to [lo, hi]; NULL and NaN stay what they are."""
    c = as_column(col)
    return F.when(c.isNull() | F.isnan(c), c).otherwise(
        F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
    )


def banded(col: Column, bands: Sequence[tuple[int | None, str]]) -> Column:
    """Label of the first band whose closed lower bound is reached."""
    out = None
    for bound, label in bands:
        if bound is None:
            continue
        out = F.when(col >= bound, label) if out is None else out.when(col >= bound, label)
    rest = next(label for bound, label in bands if bound is None)
    return out.when(col.isNotNull(), rest)


BANDS = {
    "report_label": V.REPORT_LABEL_BANDS,
    "report_colour": V.REPORT_COLOUR_BANDS,
    "result_label": V.RESULT_LABEL_BANDS,
    "result_message": V.RESULT_MESSAGE_BANDS,
    "rubric": V.RUBRIC_BANDS,
}


def score_band(col: Column | str, kind: str, brand: str = V.BRAND) -> Column:
    """Label of a 0-100 score under one of the band sets in ``BANDS``."""
    bands = [(bound, label.replace("{brand}", brand)) for bound, label in BANDS[kind]]
    return banded(as_column(col), bands)


def confidence_band(col: Column | str) -> Column:
    return banded(as_column(col), V.CONFIDENCE_BANDS)


def question_strategy(current: Column | str, total: Column | str) -> Column:
    """Opening, closing or deep-dive question; the opening rule wins when total is 1."""
    c, t = as_column(current), as_column(total)
    return (
        F.when(c == 1, V.STRATEGY_INTRO)
        .when(c == t, V.STRATEGY_FINAL)
        .otherwise(V.STRATEGY_DEEP)
    )


def progress_pct(current: Column | str, total: Column | str) -> Column:
    """Share of the interview done, in percent; NULL when the total is 0."""
    c, t = as_column(current).cast("double"), as_column(total).cast("double")
    return F.try_divide(c, t) * F.lit(100.0)
