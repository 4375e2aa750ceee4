"""Best-fit packing of token sequences, decided on the counts of lengths.

Two items of one length are alike to a packer, so the plan needs the number of items of
each length alone: at most ``capacity`` counts, however many documents there are.  The
driver matches and fits counts, and Spark gives each item a place by its rank among
those of its length.  The plan is a few thousand intervals at most and does not grow
with the data.

* Items above a third of the capacity share a sequence with at most one other such item.
  From the longest down, each takes the longest partner that still fits.
* Smaller items, from the longest down, go to the tightest gap that holds them.

Null texts count as empty (the end id alone).  Rows may repeat; each is packed.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairwright.llm.tokens import encoder
from pairwright.plans.scale import materialize

AT_ONCE = 1024
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, rank long"
SLOTS = "length int, first long, next long, sequence long, each long, place long"


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple], int]:
    """Slots (length, first rank, rank after the last, sequence of the first, items of this
    slot in a sequence, place of the first of them), and the number of sequences."""
    left, used, slots = Counter(counts), Counter(), []
    gaps: list[tuple[int, int, int]] = []  # room, first sequence, number of sequences; sorted
    made = 0

    def put(length: int, n: int, sequence: int, each: int, room: int) -> None:
        slots.append((length, used[length], used[length] + n, sequence, each, capacity - room))
        used[length] += n
        left[length] -= n

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for s in large:
        while left[s]:
            partner = next((p for p in large if p <= min(s, capacity - s) and left[p] > (p == s)), 0)
            n = min(left[s], left[partner]) if partner else left[s]
            n = left[s] // 2 if partner == s else n
            put(s, n, made, 1, capacity)
            if partner:
                put(partner, n, made, 1, capacity - s)
            if room := capacity - s - partner:
                bisect.insort(gaps, (room, made, n))
            made += n
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while n := left[s]:
            at = bisect.bisect_left(gaps, (s, -1, -1))
            if at == len(gaps):
                opened = -(-n // (capacity // s))
                gaps.append((capacity, made, opened))
                made += opened
            room, base, bins = gaps.pop(at)
            each = room // s
            full, rest = min(bins, n // each), 0
            if full:
                put(s, full * each, base, each, room)
            if full < bins:
                rest = min(left[s], each - 1)
            if rest:
                put(s, rest, base + full, rest, room)
            for gap, first, many in (
                (room - each * s, base, full),
                (room - rest * s, base + full, 1 if rest else 0),
                (room, base + full + bool(rest), bins - full - bool(rest)),
            ):
                if gap and many:
                    bisect.insort(gaps, (gap, first, many))
    return slots, made


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of each document, with their rank among those of their length in the task."""

    def cut(batches):
        enc, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for a in range(0, batch.num_rows, AT_ONCE):
                ids, texts = (c.to_pylist() for c in batch.slice(a, AT_ONCE).columns)
                out: dict[str, list] = {k.split()[0]: [] for k in PIECES.split(", ")}
                for doc, got in zip(ids, enc.encode_all(texts)):
                    got, start = got + end, 0
                    n = len(got) // 4
                    ends = range(n - (n - 1) // capacity * capacity, n + 1, capacity)
                    for k, stop in enumerate(ends):
                        crc = zlib.crc32(got[4 * start : 4 * stop])
                        row = (doc, k, start, stop - start, crc, part, seen[stop - start])
                        for held, value in zip(out.values(), row):
                            held.append(value)
                        seen[stop - start] += 1
                        start = stop
                yield pa.RecordBatch.from_pydict(out, schema=CUT)

    whole = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), whole.alias("text")).mapInArrow(cut, PIECES)


CUT = pa.schema(
    [
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()),
        ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank", pa.int64()),
    ]
)


def best_fit(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024) -> DataFrame:
    """Place of every piece of every document: sequence_id, and offset within it.

    A document longer than ``capacity`` is cut into pieces of that length; the first may
    be shorter.
    """
    spark = docs.sparkSession
    found = materialize(pieces(docs, tokenizer, end_id, capacity), "pieces")
    counts = materialize(found.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, _ = plan(totals, capacity)
    # at most a few intervals for each of the `capacity` lengths
    places = F.broadcast(spark.createDataFrame(slots or [(0,) * 6], SLOTS))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = found.join(base, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base"))
    k = F.col("rank") - F.col("first")
    return (
        ranked.join(places, "length")
        .filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("next")))
        .select(
            "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
            (F.col("sequence") + F.floor(k / F.col("each"))).alias("sequence_id"),
            (F.col("place") + k % F.col("each") * F.col("length")).cast("long").alias("offset"),
        )
    )
