"""Mixing sources to target weights by Pareto order sampling.

Sources in code point order, null last, weigh 1, 2, 3, 1, 2, ... and share the words of
all documents; a target stops at ``most`` times its source's words, and what is over is
shared again.  A source due 2.3 times its words takes every document twice for certain
and samples the rest: documents are ranked by the odds of a random number divided by the
odds of their inclusion, and taken in that order until the words due are reached.  The
last place goes to the document whose size comes closest to what is then missing.

Random numbers come from the document's id and ``seed``, so reruns agree.  The cut is
found without ordering a source in one place: words are summed by ``BUCKETS`` ranges of
the rank, and just the range with the cut is ordered.  The outcome is one row for each
source, which can be applied to any scan of the documents.

Null text has size 0; null sources are one source; a null id is drawn by its text.  Rows
of a source that repeat an id go together.  An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.llm.columns import WORD, fresh, whole
from pairwright.plans.scale import materialize

BUCKETS = 4096
MOST = 3
SEED = "mix"
DRAWS = 1 << 52


def size(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def draw(seed: str) -> Column:
    """A whole number below ``DRAWS`` for each document."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), whole(F.col("text"))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), name)), 1, 13), 16, 10).cast("long")


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """``target`` of each source of a table (source, source_size): one row a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
    # from the source that fills up first: those before it are full, those from it share
    order = Window.orderBy((F.col("source_size") * F.lit(1.0) / F.col("weight")), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) - most * before).cast("double") / weights.cast("double")
    levels = weighed.withColumns({"level": level, "nth": F.row_number().over(order)})
    open_ = F.when(F.col("level") * F.col("weight") <= most * F.col("source_size"), F.col("nth"))
    shared = F.min_by("level", open_).over(everything)
    levels = levels.withColumn("share", shared * F.col("weight"))
    full = (most * F.col("source_size")).cast("double")
    return levels.select(
        "source", "source_size", F.coalesce(F.least("share", full), full).alias("target")
    )


def _ranked(units: DataFrame, plan: DataFrame, weight: Column) -> DataFrame:
    """Units with the bucket and place of their rank in the order sample of their source."""
    inclusion = F.least(F.greatest(F.col("rest") / F.greatest("source_size", F.lit(1)) * weight, F.lit(1e-12)), F.lit(1 - 1e-12))
    u = (F.col("u") + F.lit(0.5)) / F.lit(float(DRAWS))
    rank = (u / (1 - u)) / (inclusion / (1 - inclusion))
    joined = units.join(plan, units["source"].eqNullSafe(plan["src"])).withColumn("rank", rank)
    bucket = F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * BUCKETS), F.lit(BUCKETS - 1))
    place = F.struct("rank", "u", "doc_id")
    return joined.withColumns({"bucket": bucket, "place": place})


def plan_mix(units: DataFrame, most: int = MOST, weight: Column | None = None) -> DataFrame:
    """What each source takes: (source, source_size, target, whole, rest, cut, last).

    units: (source, u, doc_id, size), one row for each document.  Each document is taken
    ``whole`` times, and once more if its place is up to ``cut`` or is ``last``.  ``weight``
    makes some documents likelier than others of their source; the default is 1.
    """
    weight = F.lit(1.0) if weight is None else weight
    per = materialize(units.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    due = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))).otherwise(0)
    plan = targets(per, most).withColumn("whole", due)
    plan = plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = materialize(plan.withColumn("src", F.col("source")), "targets")
    some = plan.filter(F.col("rest") > 0).select("src", "source_size", "rest")

    ranked = _ranked(units, some, weight)
    cells = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("bucket")
    crossed = cells.withColumn("upto", F.sum("n").over(upto)).filter(F.col("upto") > F.col("rest"))
    crossing = materialize(
        crossed.groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("at"))
        .select(F.col("source").alias("s"), F.col("at.bucket").alias("cut_bucket"), F.col("at.before").alias("before")),
        "crossing",
    )

    near = ranked.join(crossing, ranked["source"].eqNullSafe(crossing["s"]))
    inside = near.filter(F.col("bucket") == F.col("cut_bucket"))
    running = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    reached = inside.withColumn("reached", F.col("before") + F.sum("size").over(running))
    fits = reached.filter(F.col("reached") <= F.col("rest")).groupBy("source").agg(
        F.max("place").alias("cut"), F.max("reached").alias("reached")
    )
    cuts = materialize(
        crossing.join(fits.withColumnRenamed("source", "fs"), F.col("s").eqNullSafe(F.col("fs")), "left")
        .select("s", "cut_bucket", "cut", F.coalesce("reached", "before").alias("reached")),
        "cuts",
    )

    missing = F.col("rest") - F.col("reached")
    later = ranked.join(cuts, ranked["source"].eqNullSafe(cuts["s"])).filter(~_within())
    closest = later.filter(F.abs(missing - F.col("size")) < missing).groupBy("source").agg(
        F.min(F.struct(F.abs(missing - F.col("size")).alias("off"), "place")).alias("found")
    )
    last = closest.select(F.col("source").alias("ls"), F.col("found.place").alias("last"))
    return materialize(
        plan.join(cuts, plan["src"].eqNullSafe(cuts["s"]), "left")
        .join(last, plan["src"].eqNullSafe(last["ls"]), "left")
        .select("src", "source_size", "target", "whole", "rest", "cut_bucket", "cut", "last"),
        "mix",
    )


def _within() -> Column:
    """The place lies before the cut, or at it."""
    at_cut = (F.col("bucket") == F.col("cut_bucket")) & F.col("cut").isNotNull() & (F.col("place") <= F.col("cut"))
    return F.coalesce((F.col("bucket") < F.col("cut_bucket")) | at_cut, F.lit(False))


def copies(units: DataFrame, mix: DataFrame, weight: Column | None = None) -> DataFrame:
    """``units`` (source, u, doc_id, ...) with source_size, target and ``copies`` of each row."""
    ranked = _ranked(units, mix, F.lit(1.0) if weight is None else weight)
    once = _within() | F.coalesce(F.col("place") == F.col("last"), F.lit(False))
    sampled = (F.col("rest") > 0) & once
    return ranked.withColumn("copies", (F.col("whole") + sampled.cast("long")).cast("long"))


def _units(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source", "u", "doc_id").agg(F.sum("size").alias("size"))


def mix_words(docs: DataFrame, most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken words of every row."""
    rows = docs.select("doc_id", "source", size(F.col("text")).alias("size"), draw(seed).alias("u"))
    rows = materialize(rows, "sizes")
    found = copies(rows, plan_mix(_units(rows), most))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The documents of the mix, each as often as it is taken."""
    rows = docs.select("doc_id", "source", size(F.col("text")).alias("size"), draw(seed).alias("u"))
    mix = plan_mix(_units(materialize(rows, "sizes")), most)
    held = fresh(docs, "held")
    wide = docs.select(F.struct(*docs.columns).alias(held), "doc_id", "source", draw(seed).alias("u"))
    taken = copies(wide, mix).filter(F.col("copies") > 0)
    again = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return taken.withColumn("copy", again).select(*[F.col(held)[c].alias(c) for c in docs.columns])


SQL = r"""
WITH rows AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
           CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || coalesce(text, ''))), 1, 13)
                AS BIGINT) AS u
    FROM documents
), units AS (
    SELECT source, u, doc_id, CAST(sum(size) AS BIGINT) AS size FROM rows GROUP BY ALL
), weighed AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
    FROM units GROUP BY source
), levels AS (
    SELECT *, row_number() OVER o AS nth,
           CAST((SELECT sum(source_size) FROM weighed)
                - 3 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
           / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
    FROM weighed WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST)
), shared AS (
    SELECT arg_min(level, nth) FILTER (WHERE level * weight <= 3 * source_size) AS level FROM levels
), target AS (
    SELECT source, source_size,
           coalesce(least(shared.level * weight, CAST(3 * source_size AS DOUBLE)), CAST(3 * source_size AS DOUBLE)) AS target
    FROM levels, shared
), due AS (
    SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM target
), ranked AS (
    SELECT u.*, d.target - d.whole * d.source_size AS rest,
           sum(u.size) OVER (PARTITION BY u.source ORDER BY u.u, u.doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto
    FROM units u JOIN due d ON u.source IS NOT DISTINCT FROM d.source
), first_part AS (
    SELECT *, upto <= rest AS sampled,
           rest - coalesce(max(upto) FILTER (WHERE upto <= rest) OVER (PARTITION BY source), 0) AS missing
    FROM ranked
), last_one AS (
    SELECT *, row_number() OVER (
        PARTITION BY source ORDER BY sampled OR abs(missing - size) >= missing, abs(missing - size), u, doc_id NULLS FIRST
    ) = 1 AND NOT sampled AND abs(missing - size) < missing AS topped
    FROM first_part
)
SELECT r.doc_id, r.size, d.source_size, d.target,
       CAST(r.size * (d.whole + CASE WHEN l.rest > 0 AND (l.sampled OR l.topped) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rows r
JOIN due d ON r.source IS NOT DISTINCT FROM d.source
JOIN last_one l ON r.source IS NOT DISTINCT FROM l.source AND r.u = l.u AND r.doc_id IS NOT DISTINCT FROM l.doc_id
"""
