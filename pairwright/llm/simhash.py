"""Near-duplicate documents by SimHash fingerprints and multi-index hashing.

1. A text gives its ``n``-word shingles, repeats included, and their XXH64 values (seed
   ``SEED``).  A bit of the fingerprint is 1 where more than half of the values have it.
2. Equal fingerprints form one class, counted before the shuffle.
3. Multi-index hashing: a fingerprint is cut into two segments of 32 bits.  Two that differ
   in at most ``MAX_BITS`` = 3 bits have a segment that differs in at most one.  Each
   fingerprint stands in a table by each of its segments and looks up the ball of radius one
   about it.  Of two segments one bit apart, only the one with the 0 needs to look.
4. Complete distances decide.

A segment may be common to very many fingerprints, as in a large group of near copies, so
what meets at a key is not paired off.  Everything first meets the key's leader; what is
close enough joins its component.  Only keys that still hold several components go on, and
there only those outside the key's largest component meet the rest.  Where these are more
than ``DENSE``, shared midpoints take the place of pairs: two fingerprints within three
bits have a point at most one bit from one and two from the other, so all within one bit of
a point are linked, and all at two bits are linked to those.  That is a fixed number of rows for
each fingerprint.  No link between components is missed, and none is capped.  Joins are by
sorting; no table of fingerprints or of their keys is broadcast.

Null and blank texts have the fingerprint 0 and are linked like any other.  A text with
fewer words than ``n`` is one shingle.  Repeated rows stay rows; a component has the smallest
id of its rows, null only where none has an id.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.near import components
from pairwright.plans.scale import materialize, merged

SEED = 42
WORDS = 3
MAX_BITS = 3
DENSE = 64
_HALF = 32
_AT_ONCE = 1 << 16  #: shingles whose bits are counted together


def shingle_hashes(text: bytes, n: int = WORDS) -> list[int]:
    """XXH64 of each shingle of the text, A-Z lower-cased, words joined by a blank."""
    words = text.lower().split()  # of bytes: A-Z, and the ASCII white space
    line = b" ".join(words)
    if len(words) <= n:
        return [xxhash.xxh64_intdigest(line, SEED)] if words else []
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return [xxhash.xxh64_intdigest(line[a : b - 1], SEED) for a, b in zip(starts, ends[n - 1 :], strict=False)]


def majority(hashes: list[int]) -> int:
    """The bits that more than half of the values have, as a signed 64-bit number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _AT_ONCE):
        part = np.array(hashes[at : at + _AT_ONCE], dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """doc_id and fp (signed) of every row; a batch holds no more than one text's hashes."""

    @F.pandas_udf("bigint")
    def fingerprint(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([majority(shingle_hashes(bytes(t or b""), n)) for t in texts], dtype="int64")

    return docs.select("doc_id", fingerprint(F.col("text").cast("binary")).alias("fp"))


def _keys(fp: Column) -> Column:
    """The two table keys of a fingerprint (exact), and the keys of the balls about them.

    A key is a segment with the number of its half above it.  A ball has the segments with one
    more bit set; those with one bit less find this one from their side.
    """

    def side(which: int, segment: Column) -> Column:
        def key(s: Column, exact: bool) -> Column:
            return F.struct((s + (which << _HALF)).alias("key"), F.lit(exact).alias("exact"))

        masks = F.array(*[F.lit(1 << j).cast("bigint") for j in range(_HALF)])
        ball = F.filter(masks, lambda m: segment.bitwiseAND(m) == 0)
        return F.concat(F.array(key(segment, True)), F.transform(ball, lambda m: key(segment.bitwiseOR(m), False)))

    high = F.shiftrightunsigned(fp, _HALF)
    low = fp.bitwiseAND(F.lit((1 << _HALF) - 1))
    return F.concat(side(0, high), side(1, low))


def _close(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MAX_BITS


def _met(fps: DataFrame) -> DataFrame:
    """(key, fp, exact, leader, several): who meets whom at a key of the tables.

    ``leader`` stands in the table at that key, and so do more where ``several`` is set.
    """
    rows = fps.select("fp", F.explode(_keys(F.col("fp"))).alias("k")).select("fp", "k.key", "k.exact")
    table = rows.filter("exact").groupBy("key").agg(F.min("fp").alias("leader"), (F.count(F.lit(1)) > 1).alias("several"))
    met = rows.join(merged(table), "key").filter((F.col("fp") != F.col("leader")) | F.col("several"))
    return materialize(met, "simhash-met")


def _open(met: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, fp, exact, label, top, others): rows of keys that hold several components.

    ``top`` is the component with the most rows at the key, ``others`` the number of the rest.
    """
    labels = components(edges).withColumnRenamed("node", "fp")
    named = met.filter("several").join(merged(labels), "fp", "left")
    named = materialize(named.select("key", "fp", "exact", F.coalesce("label", "fp").alias("label")), "simhash-labelled")
    sizes = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    tops = sizes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"))
    tops = tops.filter(F.col("top.n") < F.col("n"))
    tops = tops.select("key", F.col("top.label").alias("top"), (F.col("n") - F.col("top.n")).alias("others"))
    return materialize(named.join(merged(tops), "key"), "simhash-open")


def _pairs(rows: DataFrame) -> DataFrame:
    """Edges (a, b) between those outside a key's largest component and all at the key."""
    x = rows.filter(F.col("label") != F.col("top")).select("key", F.col("fp").alias("a"), F.col("exact").alias("ea"), F.col("label").alias("la"))
    y = rows.select(F.col("key"), F.col("fp").alias("b"), F.col("exact").alias("eb"), F.col("label").alias("lb"))
    linked = (F.col("la") != F.col("lb")) & (F.col("ea") | F.col("eb")) & _close("a", "b")
    return x.join(merged(y), "key").filter(linked).select("a", "b").distinct()


def _midpoints(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that link all fingerprints within ``MAX_BITS`` bits, by shared points."""
    single = [1 << i for i in range(64)]
    masks = [0, *single, *[single[i] | single[j] for i in range(64) for j in range(i)]]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    reach = F.array(*[F.lit(m).cast("bigint") for m in signed])
    rows = fps.select("fp", F.posexplode(F.transform(reach, lambda m: F.col("fp").bitwiseXOR(m))).alias("i", "point"))
    rows = rows.select("fp", "point", (F.col("i") <= 64).alias("next_to"))
    heads = rows.filter("next_to").groupBy("point").agg(F.min("fp").alias("a"))
    met = rows.join(merged(heads), "point").filter(F.col("fp") != F.col("a"))
    return met.select("a", F.col("fp").alias("b")).distinct()


def links(fps: DataFrame, dense: int = DENSE) -> DataFrame:
    """(node, label) of the fingerprints in components of several."""
    met = _met(fps)
    near = met.filter((F.col("fp") != F.col("leader")) & _close("fp", "leader"))
    led = materialize(near.select(F.col("leader").alias("a"), F.col("fp").alias("b")).distinct(), "simhash-led")
    left = _open(met, led)
    found = _pairs(left.filter(F.col("others") <= dense))
    crowded = materialize(left.filter(F.col("others") > dense).select("fp").distinct(), "simhash-dense")
    edges = led.union(found)
    if not crowded.isEmpty():
        edges = edges.union(_midpoints(crowded))
    return components(materialize(edges, "simhash-edges"))


def near_groups(docs: DataFrame, n: int = WORDS, dense: int = DENSE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    rows = materialize(fingerprints(docs, n), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-classes")
    named = fps.join(merged(links(fps.select("fp"), dense)), F.col("fp") == F.col("node"), "left")
    named = named.select("fp", "first", F.coalesce("label", "fp").alias("label"))
    firsts = named.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = materialize(named.join(merged(firsts), "label").select("fp", "component_id"), "simhash-components")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.join(merged(classes), "fp").select("doc_id", digits.alias("fingerprint"), "component_id")
