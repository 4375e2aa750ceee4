"""Spelling variants of words, by blocked Gram matrices of letter counts.

1. A word is a maximal run of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of
   at least ``LENGTH`` code points, seen at least ``SEEN`` times in all texts.  By the hash of
   ``<doc_id>:<run>``, one run in ``DAMAGED`` loses a letter first, wherever it stands in
   that document.  Tasks add up their words before the shuffle.
2. Two words are near if one inserted, deleted or replaced letter makes one from the other.  The edit lies in
   one of three parts of the shorter word and leaves the letters around it alone, so a
   block is: a length, a part, and the letters outside it.  A word of length L is in the
   blocks of length L, and in those of L - 1 as the longer one.  A block over ``TILE`` words
   is cut again within its part, until the part is one letter; then the letter is all
   that its words differ in.
3. In a block, the letter counts of its words are the rows of a matrix X.  NumPy products X X'
   give all squared distances |x|^2 + |y|^2 - 2 xy at once; an edit moves at most two
   counts by one, so pairs at more than two go.  Blocks of like size go through one product.
4. The letters decide.  A pair is counted in the one block whose part holds its edit.  Counts
   and best neighbours of a word are combined in the task, then over all blocks.
5. A word's form is its near word with the largest count n (ties: smallest in code-point order)
   if that is at least twice its own; its root follows forms to the last.  Counts at
   least double at each step, so it ends, and each round of joins doubles the steps.

Null and empty texts have no words; a null doc_id is the empty string in the hash.  Repeated
rows count again.  Runs of any length are taken whole.  Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.plans.scale import materialize, merged

LENGTH = 5
SEEN = 3
DAMAGED = 97
TILE = 1024
HELD = 200_000  #: words that a task adds up before it hands them on
BATCHED = 64  #: largest block that shares a product with others
_RUN = re.compile(rb"[a-z\xc0-\xff]{%d,}" % LENGTH)
_LETTERS = np.zeros(256, np.int64)
_LETTERS[ord("a") : ord("z") + 1] = np.arange(1, 27)
_LETTERS[0xC0:] = np.arange(27, 91)
_N_LETTERS = 91


# --- words ---------------------------------------------------------------------------------


def document_words(doc_id: object, text: str) -> Iterator[tuple[bytes, int]]:
    """(word, count) of one text in Latin-1, after the damage."""
    start = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    start = zlib.crc32(b":", start)
    # any other character becomes '?', which ends a run as the character did
    for run, n in Counter(_RUN.findall(text.encode("latin-1", "replace").lower())).items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % DAMAGED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LENGTH:
                continue
        yield run, n


def _counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: Counter[bytes] = Counter()

    def out() -> pd.DataFrame:
        return pd.DataFrame({"w": list(held.keys()), "n": list(held.values())})

    for batch in parts:
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            if text:
                for word, n in document_words(doc_id, text):
                    held[word] += n
                if len(held) > HELD:
                    yield out()
                    held.clear()
    yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(w, n): words in Latin-1 with their counts."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    counts = rows.mapInPandas(_counted, "w binary, n bigint")
    return counts.groupBy("w").agg(F.sum("n").alias("n")).filter(F.col("n") >= SEEN)


# --- blocks --------------------------------------------------------------------------------


def _parts(low: Column, high: Column) -> Column:
    """The three parts of the letters from ``low`` to ``high``, without empty ones."""

    def cut(q: int) -> Column:
        return low + F.floor((high - low) * q / 3).cast("int")

    listed = F.array(*[F.struct(cut(q).alias("a"), cut(q + 1).alias("b")) for q in range(3)])
    return F.filter(listed, lambda p: p["a"] < p["b"])


def _keyed(rows: DataFrame) -> DataFrame:
    """With the key of the block: the shorter length, its part, and the letters around it."""
    end = F.col("s") - F.col("b")
    rest = F.substring(F.col("w"), F.octet_length("w") - end + 1, end)
    return rows.withColumn("key", F.xxhash64("s", "a", "b", F.substring(F.col("w"), F.lit(1), F.col("a")), rest))


def blocks(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(key, w, n, s, a, b): the words of all blocks that can hold a pair."""
    size = F.octet_length("w")
    both = F.filter(F.array(size, size - 1), lambda s: s >= LENGTH)
    rows = words.select("w", "n", F.explode(both).alias("s"))
    rows = rows.select("w", "n", "s", F.explode(_parts(F.lit(0), F.col("s"))).alias("p")).select("w", "n", "s", "p.a", "p.b")
    done = None
    while True:
        keyed = _keyed(rows)
        # a block needs a word of the shorter length, and another one
        sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.bool_or(F.octet_length("w") == F.col("s")).alias("short"))
        sizes = sizes.filter((F.col("size") > 1) & F.col("short")).drop("short")
        met = materialize(keyed.join(merged(sizes), "key"), "word-blocks")
        large = (F.col("size") > tile) & (F.col("b") - F.col("a") > 1)
        fit = met.filter(~large).drop("size")
        done = fit if done is None else done.unionByName(fit)
        over = met.filter(large)
        if over.isEmpty():
            return done
        rows = over.select("w", "n", "s", F.explode(_parts(F.col("a"), F.col("b"))).alias("p")).select("w", "n", "s", "p.a", "p.b")


class Words:
    """Words of one length class as arrays: letters padded with 0, lengths, letter counts."""

    def __init__(self, words: list[bytes]):
        self.size = np.array([len(w) for w in words], np.int64)
        width = int(self.size.max(initial=1)) + 1
        packed = np.array(words, dtype=f"S{width}")
        self.letters = packed.view(np.uint8).reshape(len(words), width)
        self.rank = np.empty(len(words), np.int64)
        self.rank[np.argsort(packed, kind="stable")] = np.arange(len(words))
        row = np.repeat(np.arange(len(words)), width)
        counts = np.bincount(row * _N_LETTERS + _LETTERS[self.letters].ravel(), minlength=len(words) * _N_LETTERS)
        self.counts = counts.reshape(len(words), _N_LETTERS).astype(np.float32)
        self.counts[:, 0] = 0  # the padding
        self.norm = (self.counts**2).sum(axis=1)

    def close(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of blocks (rows of word numbers, -1 where none) at squared distance two or less."""
        product = np.matmul(self.counts[x], self.counts[y].transpose(0, 2, 1))
        near = self.norm[x][:, :, None] + self.norm[y][:, None, :] - 2 * product <= 2.5
        near &= (x[:, :, None] >= 0) & (y[:, None, :] >= 0)
        block, i, j = np.nonzero(near)
        return x[block, i], y[block, j]

    def edits(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Where the only edit of each pair is; -1 if it takes another number of edits.

        ``i`` is no longer than ``j``, by one letter at most.
        """
        x, y = self.letters[i], self.letters[j]
        differ = x != y
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), -1)
        same_length = self.size[i] == self.size[j]
        one = np.where(same_length, differ.sum(axis=1) == 1, False)
        shifted = x[:, :-1] != y[:, 1:]
        after = np.arange(shifted.shape[1]) >= first[:, None]
        one |= ~same_length & (first >= 0) & ~(shifted & after).any(axis=1)
        return np.where(one, first, -1)


_AT_ONCE = 1 << 19  #: distances, and pairs, that are held at a time


def near_pairs(words: Words, cuts: np.ndarray, s: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs of the blocks that start at ``cuts``; s, a and b of each word."""
    sizes = np.diff(cuts)
    small = 2
    while small // 2 < sizes.max(initial=0) and small <= BATCHED:
        chosen = np.nonzero((sizes <= small) & (sizes > small // 2))[0]
        for at in range(0, len(chosen), step := max(1, _AT_ONCE // small**2)):
            of = chosen[at : at + step]
            place = cuts[of][:, None] + np.arange(small)
            yield from _verified(words, np.where(np.arange(small) < sizes[of][:, None], place, -1), None, s, a, b)
        small *= 2
    for k in np.nonzero(sizes > BATCHED)[0]:
        members = np.arange(cuts[k], cuts[k + 1])
        rows = max(1, _AT_ONCE // TILE)
        for p in range(0, len(members), rows):
            for q in range(0, len(members), TILE):
                if q + TILE > p:
                    yield from _verified(words, members[None, p : p + rows], members[None, q : q + TILE], s, a, b)


def _verified(
    words: Words, x: np.ndarray, y: np.ndarray | None, s: np.ndarray, a: np.ndarray, b: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    i, j = words.close(x, x if y is None else y)
    kept = i < j  # each pair once
    i, j = i[kept], j[kept]
    for at in range(0, len(i), step := max(1, (_AT_ONCE << 3) // words.letters.shape[1])):
        u, v = i[at : at + step], j[at : at + step]
        u, v = np.where(words.size[u] <= words.size[v], u, v), np.where(words.size[u] <= words.size[v], v, u)
        right = words.size[u] == s[u]  # the shorter word has the length of the block
        u, v = u[right], v[right]
        edit = words.edits(u, v)
        here = (edit >= a[u]) & ((edit < b[u]) | ((edit == s[u]) & (b[u] == s[u])))
        yield u[here], v[here]


def _best(words: list[bytes], n: np.ndarray, rank: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """near, n and word of the best neighbour of each word that has one."""
    i = np.concatenate([p for pair in pairs for p in pair])
    j = np.concatenate([p for pair in pairs for p in reversed(pair)])
    order = np.lexsort((rank[j], -n[j], i))
    i, j = i[order], j[order]
    found, first, near = np.unique(i, return_index=True, return_counts=True)
    best = j[first]
    return pd.DataFrame({"w": [words[k] for k in found], "near": near, "best_n": n[best], "best": [words[k] for k in best]})


def _compared(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Neighbours of words by block.  Rows come block after block; the last block of a batch waits
    for the next, as it may go on there."""

    def compare(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        length = rows["s"].to_numpy()
        for s in np.unique(length):  # words of like length, so that padding stays small
            part = rows[length == s]
            key = part["key"].to_numpy()
            cuts = np.append(np.append(0, np.nonzero(key[1:] != key[:-1])[0] + 1), len(key))
            listed = [bytes(w) for w in part["w"]]
            words = Words(listed)
            of = [part[c].to_numpy() for c in ("s", "a", "b")]
            n, pairs, held = part["n"].to_numpy(), [], 0
            for pair in near_pairs(words, cuts, *of):
                pairs.append(pair)
                held += len(pair[0])
                if held > _AT_ONCE << 1:
                    yield _best(listed, n, words.rank, pairs)
                    pairs, held = [], 0
            if held:
                yield _best(listed, n, words.rank, pairs)

    kept: list[pd.DataFrame] = []
    for batch in parts:
        if not len(batch):
            continue
        key = batch["key"].to_numpy()
        start = int(np.nonzero(key != key[-1])[0].max(initial=-1)) + 1
        if start or (kept and kept[-1]["key"].iloc[-1] != key[-1]):
            yield from compare(pd.concat([*kept, batch.iloc[:start]]))
            kept = []
        kept.append(batch.iloc[start:])
    if kept:
        yield from compare(pd.concat(kept))


def neighbours(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(w, n_near, best_n, best) of the words that have near ones."""
    rows = blocks(words, tile)
    dealt = rows.repartition("key").sortWithinPartitions("key", "w")
    found = dealt.mapInPandas(_compared, "w binary, near bigint, best_n bigint, best binary")
    first = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("first")
    some = found.groupBy("w").agg(F.sum("near").alias("n_near"), first)
    return some.select("w", "n_near", (-F.col("first.less")).alias("best_n"), F.col("first.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(w, root) from (w, form): the end of the forms that each word leads to."""
    ends = forms.select("w", F.col("form").alias("root"))
    while True:
        further = ends.select(F.col("w").alias("root"), F.col("root").alias("next"))
        ends = ends.join(merged(further), "root", "left").select("w", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        ends = materialize(ends, "word-roots")
        if ends.filter("moved").isEmpty():
            return ends.drop("moved")


def spelling_variants(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word."""
    words = materialize(vocabulary(docs), "vocabulary")
    near = materialize(neighbours(words, tile), "near-words")
    larger = F.col("best_n") >= 2 * F.col("n")
    named = words.join(merged(near), "w", "left").select(
        "w", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(larger, F.col("best")).alias("form"), F.when(larger, F.col("best_n")).alias("form_n"),
    )
    named = materialize(named, "word-forms")
    ends = roots(named.filter(F.col("form").isNotNull()))

    def text(c: str) -> Column:
        return F.decode(F.col(c), "ISO-8859-1")

    return named.join(merged(ends), "w", "left").select(
        text("w").alias("word"), "n", "n_near", text("form").alias("form"), "form_n",
        F.coalesce(text("root"), text("w")).alias("root"),
    )


#: crc32 by its table of 256 entries; near words by what is left of them without one letter.
SQL = r"""
WITH RECURSIVE crc AS (
    SELECT list(list_reduce(list_prepend(i, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
    FROM range(256) r(i)
), run AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents
), per_doc AS (
    SELECT doc_id, r, count(*) AS n FROM run WHERE length(r) >= 5 GROUP BY 1, 2
), hashed AS (
    SELECT r, n, xor(list_reduce(list_prepend(4294967295, list_transform(
            regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r)), '..'),
            lambda x: CAST('0x' || x AS BIGINT))),
        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h
    FROM per_doc, crc
), word AS (
    SELECT w, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT CASE WHEN h % 97 = 0 THEN r[:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS w, n FROM hashed)
    WHERE length(w) >= 5 GROUP BY w HAVING sum(n) >= 3
), gone AS (
    SELECT w, n, unnest(range(0, length(w))) AS i FROM word
), less AS (
    SELECT w, n, i, w[:i] || w[i + 2:] AS v FROM gone
), pair AS (
    SELECT a.w AS x, a.n AS nx, b.w AS y, b.n AS ny FROM less a JOIN less b ON a.v = b.v AND a.i = b.i AND a.w <> b.w
    UNION SELECT a.w, a.n, b.w, b.n FROM less a JOIN word b ON a.v = b.w
    UNION SELECT b.w, b.n, a.w, a.n FROM less a JOIN word b ON a.v = b.w
), best AS (
    SELECT x, count(*) AS n_near, first({'y': y, 'n': ny} ORDER BY ny DESC, encode(y)) AS b FROM pair GROUP BY x
), form AS (
    SELECT w, n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 2 * n THEN b.y END AS form,
        CASE WHEN b.n >= 2 * n THEN b.n END AS form_n
    FROM word LEFT JOIN best ON x = w
), walk(w, place) AS (
    SELECT w, w FROM form UNION ALL SELECT walk.w, form.form FROM walk JOIN form ON form.w = walk.place WHERE form.form IS NOT NULL
), ends AS (
    SELECT walk.w, walk.place AS root FROM walk JOIN form ON form.w = walk.place WHERE form.form IS NULL
)
SELECT form.w AS word, n, n_near, form, form_n, root FROM form JOIN ends ON ends.w = form.w
"""
