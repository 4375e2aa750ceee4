"""The trie of conversation prefixes, by double arrays over shards of the prefixes.

A conversation is a sequence of turns (role, text).  Each distinct sequence of its first d
turns is a node of depth d, under the textless root (depth 0); the conversations that start
with it are its members.

1. Turns become hash pairs (two of 64 bits), so the texts leave the plan at its first step.
   Equal conversations form one class with its size, smallest id and the digest of its ids.
   The ids of a class are packed into ordered pieces first, so a class of any size goes
   through the digest as a stream.
2. Classes are dealt out by the range of their first turns, then by their hash, so that
   a shard holds neighbouring prefixes and even one prefix that all share is split.
3. A shard numbers its turns densely and packs its trie into BASE and CHECK arrays: the child
   of state s by turn t is BASE[s] + t if CHECK there is s.  Its sequences walk through the
   arrays; what they add up at the states is the shard's part of each node.
4. Shards share upper nodes, so the parts are merged by node over all shards.  A first pass finds the
   smallest member of each node and whether it ends a branch.  A node belongs to its
   smallest member, so in the second pass each node's words and leaf are counted by just one
   class, and sums over subtrees add up over shards, too.

Rows without conv_id belong to no conversation and are left out; an id with rows is a member
of the root at least.  A null role or text is the empty string.  Turns are ordered by number,
null first, and rows with one number by their hashes.  Repeated rows are turns of their own.
Other columns are not read.  One conversation is held in one task, at 30 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.columns import whole, words
from pairwright.plans.scale import materialize

PIECE = 2048  #: ids of a class digested together
DEEP = 3  #: turns that the shards are dealt out by
EMPTY = hashlib.sha256(b"").hexdigest()
TURN = "struct<h1:bigint,h2:bigint,words:bigint>"


# --- double arrays -------------------------------------------------------------------------


class DoubleArray:
    """A trie of number sequences in BASE and CHECK arrays.

    ``flat`` holds the sequences one after the other, ``starts`` where each begins and, last,
    the end.  Labels are numbers from 0 to ``n_labels`` - 1.  State 0 is the root; ``check`` is -1
    where no state is.
    """

    def __init__(self, flat: np.ndarray, starts: np.ndarray, n_labels: int):
        parents, labels = self._children(flat, starts, n_labels)
        self.base, self.check = self._packed(parents, labels, n_labels)

    @staticmethod
    def _children(flat: np.ndarray, starts: np.ndarray, n_labels: int) -> tuple[np.ndarray, np.ndarray]:
        """Parent and label of each node but the root, by depth, then parent, then label."""
        size = np.diff(starts)
        live = np.nonzero(size > 0)[0]
        at = np.zeros(len(size), np.int64)
        parents, labels, made, depth = [], [], 1, 0
        while len(live):
            pair = at[live] * n_labels + flat[starts[live] + depth]
            found, which = np.unique(pair, return_inverse=True)
            parents.append(found // n_labels)
            labels.append(found % n_labels)
            at[live] = made + which
            made, depth = made + len(found), depth + 1
            live = live[size[live] > depth]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *parents]), np.concatenate([none, *labels])

    @staticmethod
    def _packed(parents: np.ndarray, labels: np.ndarray, n_labels: int) -> tuple[np.ndarray, np.ndarray]:
        """Bases that give all children places of their own: wide families first, then the
        single children into what is left."""
        n = len(parents) + 1
        first = np.searchsorted(parents, np.arange(n))
        width = np.diff(np.append(first, len(parents)))
        taken = np.zeros(1 + n + n_labels, bool)
        taken[0] = True  # the root's place
        base, low = np.zeros(n, np.int64), 1
        wide = np.nonzero(width > 1)[0]
        for node in wide[np.argsort(-width[wide], kind="stable")]:
            own = labels[first[node] : first[node] + width[node]]
            while taken[low]:
                low += 1
            place = low
            for _ in range(32):  # else the family goes behind all others
                span = place + own[-1] - own[0] + 1
                if span > len(taken):
                    taken = np.append(taken, np.zeros(max(len(taken), span), bool))
                if not taken[place + own - own[0]].any():
                    break
                place += 1 + int(np.argmin(taken[place + 1 :]))
            else:
                place = int(np.nonzero(taken)[0][-1]) + 1
                if (span := place + own[-1] - own[0] + 1) > len(taken):
                    taken = np.append(taken, np.zeros(max(len(taken), span), bool))
            base[node] = place - own[0]
            taken[base[node] + own] = True
        single = np.nonzero(width == 1)[0]
        free = np.nonzero(~taken)[0]
        if len(free) < len(single):
            free = np.append(free, len(taken) + np.arange(len(single) - len(free)))
        free = free[: len(single)]
        base[single] = free - labels[first[single]]
        slot = np.append(np.zeros(1, np.int64), base[parents] + labels)
        size = int(slot.max()) + 1
        bases, check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        bases[slot] = base
        check[slot[1:]] = slot[parents]
        return bases, check

    def step(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The children of the states by the labels; -1 where there is none."""
        to = self.base[states] + labels
        inside = (to >= 0) & (to < len(self.check))
        found = self.check[np.where(inside, to, 0)] == states
        return np.where(inside & found, to, -1)

    def walk(self, flat: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(sequences, states before, states after) by depth, of all that are as long."""
        size = np.diff(starts)
        at, live, depth = np.zeros(len(size), np.int64), np.nonzero(size > 0)[0], 0
        while len(live):
            before = at[live]
            at[live] = self.step(before, flat[starts[live] + depth])
            yield live, before, at[live]
            depth += 1
            live = live[size[live] > depth]


# --- a shard -------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shard:
    """The classes of one batch as a double array, with their node keys by state."""

    def __init__(self, batch: pd.DataFrame):
        self.rows = batch
        size = batch["h1"].map(len).to_numpy()
        self.starts = np.append(0, np.cumsum(size)).astype(np.int64)

        def flat(name: str) -> np.ndarray:
            return np.concatenate([np.zeros(0, np.int64), *batch[name]]).astype(np.int64)

        turn = np.stack([flat("h1"), flat("h2")], axis=1).view(np.uint64)
        self.words = flat("words")
        known, ids = np.unique(turn, axis=0, return_inverse=True)
        self.flat = ids.reshape(-1).astype(np.int64)
        self.trie = DoubleArray(self.flat, self.starts, max(len(known), 1))
        n = len(self.trie.check)
        self.key = np.zeros((n, 2), np.uint64)
        self.parent = np.zeros((n, 2), np.uint64)
        self.depth = np.full(n, -1, np.int64)
        self.depth[0], self.own_words = 0, np.zeros(n, np.int64)
        self.levels, odd = [], np.uint64(0x9E3779B97F4A7C15)
        self.end = np.zeros(len(batch), np.int64)
        for depth, (which, before, after) in enumerate(self.trie.walk(self.flat, self.starts), 1):
            place = self.starts[which] + depth - 1
            self.key[after] = _mixed(_mixed(self.key[before] + odd) + known[self.flat[place]])
            self.parent[after] = self.key[before]
            self.depth[after], self.own_words[after] = depth, self.words[place]
            self.end[which] = after
            self.levels.append((which, before, after))

    def lowest(self, ids: np.ndarray) -> np.ndarray:
        """The smallest id among the classes through each state."""
        low = np.full(len(self.depth), np.iinfo(np.int64).max)
        low[0] = ids.min()
        for which, _, after in self.levels:
            np.minimum.at(low, after, ids[which])
        return low

    def counted(self, n: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.depth), np.int64)
        total[0] = n.sum()
        for which, _, after in self.levels:
            np.add.at(total, after, n[which])
        return total

    def below(self, own: np.ndarray) -> np.ndarray:
        """Sums of ``own`` over the subtrees of all states."""
        total = own.copy()
        for _, before, after in reversed(self.levels):
            states, first = np.unique(after, return_index=True)
            np.add.at(total, before[first], total[states])
        return total

    def nodes(self, **columns: np.ndarray) -> pd.DataFrame:
        """A row for each state, with its node key and its parent's."""
        found = np.nonzero(self.depth >= 0)[0]
        key, parent = self.key.view(np.int64)[found], self.parent.view(np.int64)[found]
        named = {"k1": key[:, 0], "k2": key[:, 1], "p1": parent[:, 0], "p2": parent[:, 1], "depth": self.depth[found]}
        return pd.DataFrame(named | {c: x[found] for c, x in columns.items()})


FOUND = "k1 bigint, k2 bigint, p1 bigint, p2 bigint, depth bigint, conv_id bigint, n bigint, n_ends bigint, ending bigint"


def _smallest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First pass: smallest member and number of members of each node of a shard."""
    for batch in parts:
        if len(batch):
            shard, ids, n = Shard(batch), batch["conv_id"].to_numpy(), batch["n"].to_numpy()
            ends, ending = np.zeros(len(shard.depth), np.int64), np.full(len(shard.depth), np.iinfo(np.int64).max)
            ends[shard.end], ending[shard.end] = n, ids
            yield shard.nodes(conv_id=shard.lowest(ids), n=shard.counted(n), n_ends=ends, ending=ending)


SUMMED = (
    "k1 bigint, k2 bigint, p1 bigint, p2 bigint, depth bigint, conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved bigint, ends_sha256 string"
)


def _summed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Second pass: what a shard adds to each node.  ``own_from`` is the depth of the first node that
    belongs to the class, ``leaf`` whether its last node ends a branch."""
    for batch in parts:
        if not len(batch):
            continue
        shard, ids, n = Shard(batch), batch["conv_id"].to_numpy(), batch["n"].to_numpy()
        size = len(shard.depth)
        owned = np.zeros(size, bool)
        children = np.zeros(size, np.int64)
        from_ = batch["own_from"].to_numpy()
        for depth, (which, before, after) in enumerate(shard.levels, 1):
            mine = from_[which] <= depth
            owned[after[mine]] = True
            np.add.at(children, before[mine], 1)
        members = shard.counted(n)
        leaves, shas = np.zeros(size, np.int64), np.full(size, None, object)
        leaves[shard.end] = batch["leaf"].to_numpy().astype(np.int64)
        shas[shard.end] = batch["sha"].to_numpy()
        saved = (members - owned) * shard.own_words
        yield shard.nodes(
            conv_id=shard.lowest(ids), n_convs=members, n_children=children, n_leaves=shard.below(leaves),
            saved=shard.below(saved), ends_sha256=shas,
        )


# --- the whole ----------------------------------------------------------------------------


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the hashed turns of each conversation in order."""
    role, text = whole(F.col("role")), whole(F.col("text"))
    hashed = turns.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn",
        F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit("turn"), role, text).alias("h2"),
        F.size(words(text)).cast("bigint").alias("words"),
    )
    listed = F.sort_array(F.collect_list(F.struct("turn", "h1", "h2", "words")))
    kept = F.transform(listed, lambda t: F.struct(t["h1"].alias("h1"), t["h2"].alias("h2"), t["words"].alias("words")))
    return hashed.groupBy("conv_id").agg(kept.alias("turns"))


def rebuilt(turns: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """(conv_id, turns) with the opening of each ``family`` of ids put before their own turns.

    ``h = crc32(conv_id) % heads`` turns come from conversation ``conv_id - conv_id % family``;
    they take the place of the conversation's own first ``h`` turns.
    """
    own = materialize(sequences(turns), "conversations")
    first = own.select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("opening"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % family
    rows = own.withColumns({"h": h, "base": base}).join(first, "base", "left")
    opening = F.slice(F.coalesce("opening", F.array().cast(f"array<{TURN}>")), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return rows.select("conv_id", F.concat(opening, rest).alias("turns"))


def _pieces(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of ids of one class in one partition, at most ``PIECE`` to a row."""
    for batch in parts:
        same = batch[["c1", "c2", "size"]].to_numpy()
        ids = batch["conv_id"].tolist()
        cuts = np.append(0, np.nonzero((same[1:] != same[:-1]).any(axis=1))[0] + 1) if len(ids) else []
        rows = []
        for start, stop in zip(cuts, [*cuts[1:], len(ids)], strict=True):
            for at in range(start, stop, PIECE):
                part = ids[at : min(at + PIECE, stop)]
                rows.append((*same[at].tolist(), part[0], len(part), ",".join(map(str, part))))
        yield pd.DataFrame(rows, columns=["c1", "c2", "size", "conv_id", "n", "ids"])


def _digests(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """conv_id (the smallest), n and sha of each class, from its pieces in order."""
    now, low, n, digest = None, 0, 0, hashlib.sha256()
    done: list[tuple] = []
    for batch in parts:
        for c1, c2, size, first, count, ids in batch[["c1", "c2", "size", "conv_id", "n", "ids"]].itertuples(index=False):
            if (c1, c2, size) != now:
                if now is not None:
                    done.append((low, n, digest.hexdigest()))
                now, low, n, digest = (c1, c2, size), first, 0, hashlib.sha256()
            digest.update((("," if n else "") + ids).encode())
            n += count
        yield pd.DataFrame(done, columns=["conv_id", "n", "sha"])
        done = []
    if now is not None:
        yield pd.DataFrame([(low, n, digest.hexdigest())], columns=["conv_id", "n", "sha"])


def classes(convs: DataFrame) -> DataFrame:
    """(conv_id, n, sha, h1, h2, words): one row for each distinct sequence, dealt out by prefix."""

    def all_of(c: str) -> Column:
        return F.transform("turns", lambda t: t[c])

    rows = convs.select(
        "conv_id", F.xxhash64(all_of("h1")).alias("c1"), F.xxhash64(all_of("h2")).alias("c2"), F.size("turns").alias("size"),
        *[all_of(c).alias(c) for c in ("h1", "h2", "words")],
    )
    rows = materialize(rows, "conversation-turns")
    same = ["c1", "c2", "size"]
    ids = rows.select(*same, "conv_id").repartitionByRange(*same, "conv_id").sortWithinPartitions(*same, "conv_id")
    pieces = ids.mapInPandas(_pieces, "c1 bigint, c2 bigint, size int, conv_id bigint, n bigint, ids string")
    packed = pieces.repartition(*same).sortWithinPartitions(*same, "conv_id")
    found = packed.mapInPandas(_digests, "conv_id bigint, n bigint, sha string")
    firsts = [F.get("h1", F.lit(i)).alias(f"t{i}") for i in range(DEEP)]
    kept = rows.join(materialize(found, "conversation-classes"), "conv_id").select("*", *firsts)
    dealt = kept.repartitionByRange(*[f"t{i}" for i in range(DEEP)], "c1")
    return materialize(dealt.select("conv_id", "n", "sha", "h1", "h2", "words"), "trie-shards")


def nodes(convs: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv_id, turns): conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    shards = classes(convs)
    key = ["k1", "k2"]
    found = shards.select("conv_id", "n", "h1", "h2", "words").mapInPandas(_smallest, FOUND)
    merged = found.groupBy(*key, "depth").agg(
        F.min("conv_id").alias("conv_id"), F.min("ending").alias("ending"), F.sum("n").alias("n"), F.sum("n_ends").alias("n_ends")
    )
    merged = materialize(merged, "trie-nodes")
    owners = merged.groupBy("conv_id").agg(F.min("depth").alias("own_from"))
    leaves = merged.filter("n_ends > 0").select(F.col("ending").alias("conv_id"), (F.col("n") == F.col("n_ends")).alias("leaf"))
    known = shards.join(leaves, "conv_id").join(owners, "conv_id", "left")
    # a class that is no node's smallest member owns none
    known = known.withColumn("own_from", F.coalesce("own_from", F.lit(np.iinfo(np.int64).max)))
    parts = known.mapInPandas(_summed, SUMMED)
    totals = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    whole_ = materialize(
        parts.groupBy(*key, "depth").agg(
            F.min("conv_id").alias("conv_id"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), *totals,
            F.max("ends_sha256").alias("ends_sha256"),
        ),
        "trie-totals",
    )
    above = whole_.select(
        F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id")
    )
    return whole_.join(above, ["p1", "p2", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The nodes over the rebuilt conversations of (conv_id, turn, role, text)."""
    return nodes(rebuilt(turns))


#: crc32 by its table of 256 entries; then each prefix by its list of turns.
SQL = r"""
WITH crc AS (
    SELECT list(list_reduce(list_prepend(i, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
    FROM range(256) r(i)
), own AS (
    SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS s
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
    SELECT conv_id, s, CAST(xor(list_reduce(list_prepend(4294967295,
        list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 4 AS BIGINT) AS h
    FROM own, crc
), conv AS (
    SELECT h.conv_id, list_concat(coalesce(b.s, [])[1:h.h], h.s[h.h + 1:]) AS s
    FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 20
), prefix AS (
    SELECT conv_id, len(s) AS size, unnest(range(0, len(s) + 1)) AS depth, s FROM conv
), node AS (
    SELECT depth, s[1:depth] AS p, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256,
        any_value(CASE WHEN depth > 0 THEN len(list_filter(regexp_split_to_array(s[depth]['text'], '[\x20\x09-\x0D]+'), lambda w: w <> ''))
            ELSE 0 END) AS words
    FROM prefix GROUP BY 1, 2
), kids AS (
    SELECT depth - 1 AS depth, p[1:depth - 1] AS p, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1, 2
), full_node AS (
    SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (depth, p)
), up AS (
    SELECT unnest(range(0, depth + 1)) AS place, p, n_children, (n_convs - 1) * words AS saved FROM full_node
), total AS (
    SELECT place AS depth, p[1:place] AS p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
    FROM up GROUP BY 1, 2
)
SELECT x.conv_id, x.depth, y.conv_id AS parent_conv_id, x.n_convs, x.n_children, total.n_leaves,
    CAST(total.saved_tokens AS BIGINT) AS saved_tokens, x.ends_sha256
FROM full_node x JOIN total ON total.depth = x.depth AND total.p = x.p
LEFT JOIN node y ON y.depth = x.depth - 1 AND y.p = x.p[1:x.depth - 1]
"""
