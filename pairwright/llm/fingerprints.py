"""Document fingerprints: bottom-k sketches of word shingles, as text.

A fingerprint is the ``k`` smallest of the distinct 48-bit hashes of a text's five-word
shingles, in ascending order, twelve hex digits each.  Sketches of parts merge into the
sketch of the whole, and two of them estimate resemblance, containment and the number of
distinct shingles.  With fewer than five words the whole sequence is the one shingle; a
text without words has the empty fingerprint.  Two empty ones have resemblance 1, an
empty and another one 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.llm.columns import whole, words
from pairwright.plans.scale import materialize

K = 128
SHINGLE = 5
BITS = 48
BLOCK = 4096  #: ids of a block in which documents are put in order
HEADER = "bk48:"


def sketch(text: Column, k: int = K, n: int = SHINGLE) -> Column:
    """The ``k`` smallest shingle hashes of a text, ascending."""
    hashes = F.transform(words(text), lambda w: F.xxhash64(w))
    return F.transform(
        F.array(hashes),  # binds the hashes to a name, so they are computed once
        lambda h: F.slice(F.sort_array(F.array_distinct(_shingles(h, n))), 1, k),
    )[0]


def _shingles(hashes: Column, n: int) -> Column:
    def at(i: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(*[F.get(hashes, i + d) for d in range(n)]), 64 - BITS)

    several = F.transform(F.sequence(F.lit(0), F.size(hashes) - n), at)
    one = F.array(F.shiftrightunsigned(F.xxhash64(hashes), 64 - BITS))
    none = F.array().cast("array<bigint>")
    return F.when(F.size(hashes) >= n, several).when(F.size(hashes) > 0, one).otherwise(none)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    full = (k - 1) / ((F.element_at(a, -1) + 1) / F.lit(float(1 << BITS)))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(full)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the union that both have."""
    both = F.transform(F.array(merge(a, b, k)), lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both[0])


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a`` that ``b`` has, 0 to 1; an empty ``a`` is contained in all."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(shared / distinct_shingles(a, k), F.lit(1.0)))


def as_text(a: Column) -> Column:
    return F.concat(F.lit(HEADER), F.array_join(F.transform(a, lambda v: F.lpad(F.lower(F.hex(v)), BITS // 4, "0")), ""))


def from_text(fingerprint: Column) -> Column:
    digits = F.substr(fingerprint, F.lit(len(HEADER) + 1))
    hexes = F.regexp_extract_all(digits, F.lit(f"[0-9a-f]{{{BITS // 4}}}"), F.lit(0))
    return F.transform(hexes, lambda h: F.conv(h, 16, 10).cast("bigint"))


def with_next(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, Window]:
    """doc_id, text, and the ``head`` row (its text) of the document next in id order.

    Rows are ordered within blocks of ids, never all in one place; the last row of a block
    goes on to the first of the next, and the last of all to the first of all.  Null ids
    come first; rows with equal ids follow a hash of their text.
    """
    text = whole(F.col("text"))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tie"))
    rows = rows.withColumn("block", F.floor(F.col("doc_id") / block))
    order = Window.partitionBy("block").orderBy(F.col("doc_id").asc_nulls_first(), "tie")
    firsts = rows.groupBy("block").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias("i"), "tie")).alias("first"))
    firsts = firsts.select("block", F.when(F.col("block").isNotNull(), F.col("first.i")).alias("id"), "first.tie")
    blocks = Window.orderBy(F.col("block").asc_nulls_first())  # one row a block
    start = F.struct("id", "tie")
    after = F.coalesce(F.lead(start).over(blocks), F.first(start).over(blocks))
    links = materialize(firsts.select("block", after.alias("to")).select("block", "to.*"), "block-links")
    links = links.select(F.col("block").alias("b"), "id", F.col("tie").alias("t"))
    met = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tie") == F.col("t"))
    heads = rows.join(links, met).groupBy("b").agg(F.first("text").alias("other"))
    heads = materialize(heads, "block-heads")
    ordered = rows.withColumn("following", F.lead("text").over(order))
    joined = ordered.join(heads, F.col("block").eqNullSafe(F.col("b")), "left")
    return joined, order


def fingerprints(docs: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """Fingerprints of every text and of its edited form, with their likeness.

    The edited text has its last quarter (in code points, rounded down) replaced by the
    first as many of the next document.
    """
    joined, order = with_next(docs, block)
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    head = F.substr(F.coalesce("following", "other"), F.lit(1), quarter)
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - quarter), head)
    own = joined.select(
        "doc_id", "block", "tie", n.cast("long").alias("n_chars"), "text", edited.alias("edited"),
        F.when(F.col("following").isNull(), F.col("other")).alias("beyond"),
    )
    made = own.select(
        "doc_id", "block", "tie", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        sketch(F.col("text"), k).alias("a"), sketch(F.col("edited"), k).alias("b"),
        F.when(F.col("beyond").isNotNull(), sketch(F.col("beyond"), k)).alias("after"),
    )
    made = made.withColumn("next", F.coalesce("after", F.lead("a").over(order)))
    return made.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("a")).alias("fingerprint"),
        as_text(F.col("b")).alias("edited_fingerprint"),
        resemblance(F.col("a"), F.col("b"), k).alias("near_edited"),
        resemblance(F.col("a"), F.col("next"), k).alias("near_next"),
    )
