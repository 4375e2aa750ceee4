"""Text columns: trimming, splitting, counting and small renderings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright.functions import values as V

# Whitespace as the server side strips it, and as the client side trims it.
# Java's plain \s is ASCII only, so the Unicode separators are spelled out.
SERVER_SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
CLIENT_SPACE = r"[\t-\r\ufeff\p{Z}]"
NOT_WORD = r"[^\p{L}\p{N}]+"
LINE_BREAK = r"\r?\n"


def as_column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _strip(col: Column, space: str, left: bool = True, right: bool = True) -> Column:
    # The look-behind keeps long inner runs of blanks linear.
    parts = ([rf"\A{space}+"] if left else []) + ([rf"(?<!{space}){space}++\z"] if right else [])
    return F.regexp_replace(col, "|".join(parts), "")


def strip_text(col: Column | str) -> Column:
    """Remove leading and trailing Unicode whitespace."""
    return _strip(as_column(col), SERVER_SPACE)


def strip_left(col: Column | str) -> Column:
    return _strip(as_column(col), SERVER_SPACE, right=False)


def strip_right(col: Column | str) -> Column:
    return _strip(as_column(col), SERVER_SPACE, left=False)


def trim_text(col: Column | str) -> Column:
    """Client-side twin of :func:`strip_text`."""
    return _strip(as_column(col), CLIENT_SPACE)


def is_blank(col: Column | str) -> Column:
    """True for NULL, empty and all-whitespace text."""
    return ~F.coalesce(as_column(col).rlike("[^" + SERVER_SPACE[1:]), F.lit(False))


def words(col: Column | str) -> Column:
    """Non-empty whitespace-separated pieces."""
    return F.array_remove(F.split(as_column(col), CLIENT_SPACE + "+"), "")


def word_count(col: Column | str) -> Column:
    return F.size(words(col))


def word_label(col: Column | str) -> Column:
    """``N từ``, or the fixed label for a text without words."""
    n = word_count(col)
    return F.when(n == 0, V.EMPTY_TEXT_LABEL).otherwise(
        F.concat_ws(" ", n.cast("string"), F.lit(V.WORD_UNIT))
    )


def tokens(col: Column | str) -> Column:
    """Lower-cased runs of letters and digits, in order, with repeats."""
    return F.array_remove(F.split(F.lower(as_column(col)), NOT_WORD), "")


def distinct_tokens(col: Column | str) -> Column:
    return F.array_distinct(tokens(col))


def lines(col: Column | str) -> Column:
    """All lines of a text, blank ones included."""
    return F.split(as_column(col), LINE_BREAK)


def has_digit(col: Column | str) -> Column:
    return as_column(col).rlike("[0-9]")


def preview_text(col: Column | str, label: str = V.PREVIEW_LABEL) -> Column:
    """First 30 characters and an ellipsis; a short text shows the label instead."""
    t = trim_text(col)
    return F.when(
        F.length(t) > V.PREVIEW_LENGTH, F.concat(F.left(t, F.lit(V.PREVIEW_LENGTH)), F.lit("…"))
    ).otherwise(F.lit(label))


def slug_to_name(col: Column | str, default: str = V.DEFAULT_INDUSTRY) -> Column:
    """Hyphens to spaces; a missing or empty slug gives the default."""
    c = as_column(col)
    return F.coalesce(F.nullif(F.replace(c, F.lit("-"), F.lit(" ")), F.lit("")), F.lit(default))


def join_keywords(col: Column | str) -> Column:
    return F.array_join(as_column(col), ", ")


def copy_text(subject: Column | str, content: Column | str) -> Column:
    """Clipboard form of a generated text: the subject line only if there is one."""
    s, c = as_column(subject), as_column(content)
    return F.when(F.length(s) > 0, F.concat(F.lit("Subject: "), s, F.lit("\n\n"), c)).otherwise(c)


def request_key(kind: Column | str, tone: Column | str, *content: Column | str) -> Column:
    """``type:tone`` plus a hash of every text the result depends on.

    Each text enters by its own hash, so no two text lists share a key by
    running into each other, and NULL differs from the empty text.
    """
    parts = [as_column(kind), as_column(tone)]
    if content:
        hashes = [F.coalesce(F.sha2(as_column(c), 256), F.lit("-")) for c in content]
        parts.append(F.sha2(F.concat_ws(":", *hashes), 256))
    return F.concat_ws(":", *parts)


def phrase_count(token_array: Column, phrases: Sequence[str]) -> Column:
    """How often any of ``phrases`` occurs as whole tokens.

    Single tokens are counted in the array; longer phrases in the token text,
    where every token carries its own pair of blanks so neighbours never share one.
    """
    singles = [p for p in phrases if " " not in p]
    total = F.size(F.filter(token_array, lambda t: t.isin(singles))) if singles else F.lit(0)
    padded = F.concat(F.lit(" "), F.array_join(token_array, "  "), F.lit(" "))
    for phrase in (p for p in phrases if " " in p):
        needle = " " + phrase.replace(" ", "  ") + " "
        gone = F.length(F.replace(padded, F.lit(needle), F.lit("")))
        total = total + F.call_function("div", F.length(padded) - gone, F.lit(len(needle)))
    return total


def render_nested_record(record: Column | str) -> Column:
    """Nested record to sectioned plain text.

    ``record`` holds name, title, contact, summary, skills, experience (role,
    company, period, achievements) and education.
    """
    r = as_column(record)
    role = lambda e: F.concat(
        F.lit("\n"),
        F.concat_ws(" | ", e["role"], e["company"], e["period"]),
        F.lit("\n"),
        F.array_join(F.transform(e["achievements"], lambda a: F.concat(F.lit("• "), a)), "\n"),
        F.lit("\n"),
    )
    return F.concat_ws(
        "\n",
        F.coalesce(r["name"], F.lit("")),
        F.coalesce(r["title"], F.lit("")),
        r["contact"],
        F.lit("\nSUMMARY"),
        r["summary"],
        F.lit("\nSKILLS"),
        F.array_join(r["skills"], "\n"),
        F.lit("\nEXPERIENCE"),
        F.array_join(F.transform(r["experience"], role), "\n"),
        F.lit("\nEDUCATION"),
        r["education"],
    )
