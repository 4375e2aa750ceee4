"""Repeated lines, equal or within one word, by a deletion-neighbourhood join.

A line is a sequence of words.  Two lines are linked if they are equal or, where both
have at least ``SHORT`` words, differ by one inserted, deleted or replaced word.  A line
goes if an earlier line (by doc_id, then place; null ids last) is linked to it; so the
earliest of its kind stays.  Lines without words are neither compared nor dropped.

1. Equal lines form one class with its earliest place, combined before the shuffle.
2. Whatever the one edit is, the first or the last half of the words is untouched.
   Classes that share neither half with another class need no more work.
3. The others emit their variants as hashed keys: the line itself and, for each word, the
   line without it.  Equal variants meet by an aggregate that keeps the earliest class
   for each key and place, never by pairing all classes of a key.
4. The words of a class and of the earliest class it met decide.

Rows that repeat an id are rows of their own, told apart by their number in the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.columns import fresh, whole, with_rows, words
from pairwright.plans.scale import materialize

SHORT = 8  #: words from which on one edit is allowed
STEP = 256


def _lines(docs: DataFrame) -> DataFrame:
    """row, doc_id, place and text of each line."""
    return docs.select("row", "doc_id", F.posexplode(F.split(whole(F.col("text")), "\n", -1)).alias("place", "line"))


def _halves(n: Column, w: Column) -> Column:
    """Hashes of the first and last half of the words, for a partner as long or one longer or shorter."""

    def at(s: Column) -> Column:
        h = F.floor(s / 2).cast("int")
        return F.array(
            F.xxhash64(F.lit("first"), s, F.slice(w, 1, h)), F.xxhash64(F.lit("last"), s, F.slice(w, n - h + 1, h))
        )

    return F.concat(at(n), at(n - 1))


def _keys(w: Column) -> Column:
    """The line itself (place -1) and the line without each word, as hashed keys.

    The key of a sequence is the exclusive or of the hashes of (word, place): words before
    the one left out keep their place, and those after it move one place ahead.  Words are
    taken ``STEP`` at a time, as an array that grows is copied at every step.
    """
    placed = F.transform(
        w, lambda x, i: F.struct(F.xxhash64(x, i).alias("here"), F.xxhash64(x, i - 1).alias("moved"))
    )
    zero, none = F.lit(0).cast("bigint"), F.array().cast("array<bigint>")

    def running(h: Column, value: Callable[[Column], Column], start: Column) -> Column:
        """``all``: exclusive or of the values and ``start``; ``before``: the same up to each element."""
        first = F.struct(start.alias("all"), none.alias("before"))
        return F.aggregate(
            h,
            first,
            lambda t, x: F.struct(
                t["all"].bitwiseXOR(value(x)).alias("all"), F.concat(t["before"], F.array(t["all"])).alias("before")
            ),
        )

    def keys(h: Column) -> Column:
        """``key`` of the whole line, and ``without`` each word."""
        starts = F.sequence(F.lit(1), F.greatest(F.size(h), F.lit(1)), F.lit(STEP))
        parts = F.transform(starts, lambda i: F.slice(h, i, STEP))
        # what words up to a place bring, over having moved: that of all moved is the start
        moved = F.aggregate(h, zero, lambda t, x: t.bitwiseXOR(x["moved"]))
        inside = F.transform(
            parts,
            lambda p: F.struct(
                running(p, lambda x: x["here"].bitwiseXOR(x["moved"]), zero).alias("run"), p.alias("words")
            ),
        )
        return F.transform(
            F.array(F.struct(inside.alias("inside"), moved.alias("moved"))),
            lambda t: F.transform(
                F.array(running(t["inside"], lambda x: x["run"]["all"], t["moved"])),
                lambda outer: F.struct(
                    outer["all"].alias("key"),
                    F.flatten(
                        F.zip_with(
                            t["inside"],
                            outer["before"],
                            lambda part, base: F.zip_with(
                                part["run"]["before"],
                                part["words"],
                                lambda k, x: k.bitwiseXOR(base).bitwiseXOR(x["moved"]),
                            ),
                        )
                    ).alias("without"),
                ),
            )[0],
        )[0]

    done = F.transform(F.array(placed), keys)
    listed = F.transform(
        done,
        lambda t: F.concat(
            F.array(F.struct(t["key"].alias("key"), F.lit(-1).alias("gone"))),
            F.transform(t["without"], lambda k, i: F.struct(k.alias("key"), i.alias("gone"))),
        ),
    )
    return listed[0]


def _within_one(x: Column, y: Column) -> Column:
    """One inserted, deleted or replaced word makes x from y, or none does."""

    def gone(long: Column, short: Column) -> Column:
        """``short`` is ``long`` without one word: equal up to some place, shifted after it."""
        ahead = F.array_position(F.zip_with(long, short, lambda a, b: F.coalesce(a != b, F.lit(True))), True).cast("int")
        return F.slice(long, ahead + 1, F.size(long)) == F.slice(short, ahead, F.size(long))

    replaced = F.size(F.filter(F.zip_with(x, y, lambda a, b: a != b), lambda d: d)) <= 1
    return (
        F.when(F.size(x) == F.size(y), replaced)
        .when(F.size(x) == F.size(y) + 1, gone(x, y))
        .when(F.size(y) == F.size(x) + 1, gone(y, x))
        .otherwise(False)
    )


def repeated_lines(docs: DataFrame) -> DataFrame:
    """row, doc_id and place of every line that goes; ``docs`` has a number ``row`` for each row."""
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "place")
    lines = _lines(docs).withColumn("w", words(F.col("line"))).filter(F.size("w") > 0)
    hashed = lines.select(
        "row", "doc_id", "place", F.size("w").alias("n"), F.xxhash64("w").alias("h"), F.xxhash64(F.lit(1), "w").alias("h2"),
        F.when(F.size("w") >= SHORT, _halves(F.size("w"), F.col("w"))).alias("halves"),
    )
    lines = materialize(hashed, "lines")
    found = lines.groupBy("h", "h2", "n").agg(F.min(order).alias("first"), F.first("halves").alias("halves"))
    classes = materialize(found, "line-classes")

    # classes that share a half with another class
    halves = classes.select("h", "h2", F.explode(F.array_distinct("halves")).alias("half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > 1)
    open_ = halves.join(shared, "half", "left_semi").select("h", "h2").distinct()
    open_ = materialize(classes.select("h", "h2", "first").join(open_, ["h", "h2"], "left_semi"), "open-lines")
    # their words, from the row and place where each is first met
    at = open_.select("h", "h2", "first", F.col("first.row").alias("row"), F.col("first.place").alias("place"))
    texts = docs.select("row", "text")
    split = texts.join(at.hint("merge"), "row").withColumn("line", F.get(F.split(whole(F.col("text")), "\n", -1), F.col("place")))
    worded = materialize(split.select("h", "h2", "first", words(F.col("line")).alias("w")), "line-words")

    keys = worded.select("first", F.explode(_keys(F.col("w"))).alias("v"))
    keys = keys.select("first", "v.key", "v.gone")
    # a whole line meets variants of longer ones; variants meet where the same word is left out
    whole_line = F.col("gone") < 0
    per_key = keys.groupBy("key").agg(
        F.min(F.when(whole_line, F.col("first"))).alias("whole"),
        F.min(F.when(~whole_line, F.col("first"))).alias("variant"),
        F.count(F.lit(1)).alias("c"),
    ).filter(F.col("c") > 1)
    met = materialize(keys.join(per_key.drop("c"), "key"), "met-variants")
    per_place = met.groupBy("key", "gone").agg(F.min("first").alias("earliest"))
    met = met.join(per_place, ["key", "gone"])
    partner = F.when(whole_line, F.col("variant")).otherwise(F.least("earliest", F.coalesce("whole", "earliest")))
    pairs = met.withColumn("partner", partner).filter(F.col("partner") < F.col("first"))
    # several keys may name a partner; each is looked at until one holds
    pairs = materialize(pairs.select("first", "partner").distinct(), "line-pairs")
    x = worded.select("first", F.col("w").alias("x"))
    y = worded.select(F.col("first").alias("partner"), F.col("w").alias("y"))
    near = pairs.join(x, "first").join(y, "partner").filter(_within_one(F.col("x"), F.col("y")))
    near = near.select("first").distinct().withColumn("linked", F.lit(True))
    repeated = classes.select("h", "h2", "n", "first").join(near, "first", "left")
    repeated = materialize(repeated.select("h", "h2", "n", "first", "linked"), "line-verdicts")
    gone = lines.join(repeated, ["h", "h2", "n"])
    later = (F.col("row") != F.col("first.row")) | (F.col("place") != F.col("first.place"))
    return gone.filter(later | F.col("linked")).select("row", "doc_id", "place")


def line_counts(docs: DataFrame) -> DataFrame:
    """For every row: doc_id, n_lines, n_removed, and the places of the removed lines."""
    docs = with_rows(docs).select("row", "doc_id", "text")
    gone = repeated_lines(docs).groupBy("row").agg(F.sort_array(F.collect_list("place")).alias("removed"))
    rows = docs.select(
        "row", "doc_id",
        F.size(F.split(whole(F.col("text")), "\n", -1)).cast("long").alias("n_lines"),
    )
    found = rows.join(gone, "row", "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return found.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), F.array_join(removed, ",").alias("removed"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines that go cut from their texts."""
    row, places = fresh(docs, "row_number"), fresh(docs, "places")
    tagged = with_rows(docs, row)
    gone = repeated_lines(tagged.select(F.col(row).alias("row"), "doc_id", "text"))
    gone = gone.groupBy("row").agg(F.collect_set("place").alias(places))
    tagged = tagged.join(gone.withColumnRenamed("row", row), row, "left")
    numbered = F.transform(F.split("text", "\n", -1), lambda line, i: F.struct(line.alias("line"), i.alias("i")))
    stay = F.filter(numbered, lambda s: ~F.array_contains(places, s["i"]))
    cut = F.array_join(F.transform(stay, lambda s: s["line"]), "\n")
    return tagged.withColumn("text", F.when(F.col(places).isNull(), F.col("text")).otherwise(cut)).select(*docs.columns)


SQL = r"""
WITH l AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place
    FROM documents
), w AS (
    SELECT doc_id, place, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM l
), c AS (
    SELECT w, min((doc_id, place)) AS first FROM w WHERE len(w) > 0 GROUP BY w
), v AS (
    SELECT w, first, unnest(list_transform(range(1, len(w) + 1), lambda i: hash(w[1:i - 1] || w[i + 1:]))) AS key,
           unnest(range(1, len(w) + 1)) AS gone
    FROM c WHERE len(w) >= 8
), near AS (
    SELECT v.w FROM v JOIN (SELECT key, gone, min(first) AS f FROM v GROUP BY key, gone) m
        ON v.key = m.key AND v.gone = m.gone AND m.f < v.first
    UNION
    SELECT v.w FROM v JOIN c ON hash(c.w) = v.key AND len(c.w) >= 8 WHERE c.first < v.first
    UNION
    SELECT c.w FROM v JOIN c ON hash(c.w) = v.key AND len(c.w) >= 8 WHERE v.first < c.first
), gone AS (
    SELECT w.doc_id, w.place FROM w JOIN c ON w.w = c.w LEFT JOIN near ON near.w = w.w
    WHERE (w.doc_id, w.place) <> c.first OR near.w IS NOT NULL
), per AS (
    SELECT doc_id, count(*) AS n, string_agg(CAST(place AS VARCHAR), ',' ORDER BY place) AS removed FROM gone GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(string_split(coalesce(d.text, ''), chr(10))) AS BIGINT) AS n_lines,
       coalesce(per.n, 0) AS n_removed, coalesce(per.removed, '') AS removed
FROM documents d LEFT JOIN per ON per.doc_id = d.doc_id
"""
