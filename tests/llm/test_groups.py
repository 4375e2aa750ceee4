"""Spelling variants, SimHash groups and the prefix trie against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pairwright.llm import prefix_trie, simhash, variants
from pairwright.llm import queries as llm

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)
DOCS = "doc_id long, text string, fp long, key long, w string, label string, n long"
ODD = [
    (5, "One two three four five"), (5, "One two three four five"), (9, "ONE TWO three four five"), (1, ""), (2, None),
    (None, "no id here at all"), (7, " \n\t "), (8, "long words " * 30_000), (3, "É é × 日本 ÀÉÎÕÜ àéîõü ÀÉÎÕÜ"), (4, "a\x0bb\x1cc"),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, "w", "l", 1) for r in rows], DOCS)


def union(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    return [find(x) for x in range(n)]


# --- simhash -------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = WORD.findall((text or "").translate(FOLD))
    found = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in found]
    return sum((2 * sum(v >> b & 1 for v in values) > len(values)) << b for b in range(64))


def plain_groups(ids, fps):
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    labels = union(len(fps), pairs)
    first = {}
    for doc, label in zip(ids, labels, strict=True):
        if doc is not None:
            first[label] = min(first.get(label, doc), doc)
    return [first.get(label) for label in labels]


def test_fingerprints_of_odd_rows(spark):
    rows = ODD + duckdb.sql(f"select doc_id + 100, text from '{SF}/documents.parquet' order by 1").fetchall()
    got = simhash.near_groups(table(spark, rows))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    fps = [plain_fingerprint(t) for _, t in rows]
    want = sorted(zip([d for d, _ in rows], [f"{f:016x}" for f in fps], plain_groups([d for d, _ in rows], fps), strict=True), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert simhash.near_groups(table(spark, rows).filter("false")).collect() == []


@pytest.mark.parametrize("dense", [0, 2, 64])
def test_links_of_crowded_segments(spark, dense):
    """Groups about common centres, with one half alike or both damaged; each link by brute force."""
    rng = random.Random(dense)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            bits = rng.sample(range(32) if rng.random() < 0.6 else range(64), rng.choice([0, 1, 2, 3, 4, 7, 9]))
            fps.add(centre ^ sum(1 << b for b in bits))
    fps = sorted(fps | {0, 1, (1 << 64) - 1, 1 << 63})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), dense)
    label = {r.node: r.label for r in found.collect()}
    got = [label.get(f, f) for f in signed]
    want = plain_groups(signed, fps)
    first = {}
    for g, w in zip(got, want, strict=True):
        assert first.setdefault(g, w) == w
    assert len(set(got)) == len(set(want))


def test_three_bits_are_linked_and_four_are_not(spark):
    rows = [(0b111,), (0,), (0b11110000 << 32,)]
    got = {r.node: r.label for r in simhash.links(spark.createDataFrame(rows, "fp long")).collect()}
    assert set(got) == {0, 7} and len(set(got.values())) == 1


def written_plans(monkeypatch, module):
    """Gets the plan of each table that the module writes, as it is before it runs."""
    plans, write = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    return plans


def test_keys_of_fingerprints_are_not_broadcast(spark, monkeypatch):
    plans = written_plans(monkeypatch, simhash)
    simhash._met(spark.range(50).select(F.col("id").alias("fp")))
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]


def test_shared_points_and_labels_are_not_broadcast(spark, monkeypatch):
    fps = spark.range(200).select((F.col("id") * 37 % 4096).alias("fp"))
    plan = simhash._midpoints(fps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    plans = written_plans(monkeypatch, simhash)
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of text "), F.col("id") % 90).alias("text"))
    got = simhash.near_groups(docs)
    assert got.count() == 200 and "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert plans and not any("Broadcast" in p for p in plans)


# --- prefix trie ---------------------------------------------------------------------------


def plain_trie(rows):
    own = {}
    for c, t, r, x in sorted(((c, -1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c is not None)):
        own.setdefault(c, []).append((r, x))
    return plain_nodes({c: own.get(c - c % 20, [])[: (h := zlib.crc32(str(c).encode()) % 4)] + s[h:] for c, s in own.items()})


def plain_nodes(convs):
    members, ends, kids = {}, {}, {}
    for c, s in convs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
        ends.setdefault(tuple(s), []).append(c)
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved, out = Counter(), Counter(), []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += p not in kids
        saved[p] += (len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    for p, m in members.items():
        ids = ",".join(map(str, sorted(ends.get(p, []))))
        above = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), above, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string, n long, h long, depth string"


def talk(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "d") for r in rows], TURNS)


def test_trie_of_odd_rows(spark):
    rng = random.Random(3)
    rows = [(None, 0, "user", "no conversation"), (41, None, None, None), (41, 0, "user", ""), (60, 0, "user", "only " * 9)]
    rows += [(c, t, rng.choice(["user", None]), rng.choice(["a b", "A b", "", None, "x" * 5])) for c in range(30) for t in range(rng.randrange(7))]
    rows += [(c, t, "user", f"turn {t}") for c in range(100, 160) for t in range(40 + (c == 107))]
    rows += [(200, t, "user", str(t % 3)) for t in range(3000)]
    for parts in (1, 5):
        got = prefix_trie.prefix_trie(talk(spark, rows).repartition(parts))
        assert sorted(map(tuple, got.collect()), key=str) == plain_trie(rows)
    assert prefix_trie.prefix_trie(talk(spark, rows).filter("false")).collect() == []


def test_trie_in_many_small_shards(spark):
    """Upper nodes in all shards: batches of two classes, one group of a third of all conversations."""
    rng = random.Random(5)
    convs = {c: [("u", rng.choice("abc")) for _ in range(rng.randrange(6))] for c in range(300)}
    convs |= {c: [("u", "a"), ("u", "b"), ("u", "c")] for c in range(300, 450)}
    rows = [(c, t, *x) for c, s in convs.items() for t, x in enumerate(s)]
    sized = {c: s for c, s in convs.items() if s}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = sorted(map(tuple, prefix_trie.nodes(prefix_trie.sequences(talk(spark, rows))).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == plain_nodes(sized)


@pytest.mark.parametrize("labels", [1, 3, 500])
def test_double_array_holds_its_sequences_and_no_others(labels):
    rng = np.random.default_rng(labels)
    held = {tuple(rng.integers(0, labels, rng.integers(0, 7)).tolist()) for _ in range(400)}
    listed = sorted(held)
    starts = np.append(0, np.cumsum([len(s) for s in listed])).astype(np.int64)
    flat = np.array([x for s in listed for x in s], np.int64)
    trie = prefix_trie.DoubleArray(flat, starts, labels)
    prefixes = {s[:d] for s in held for d in range(len(s) + 1)}
    state = {(): 0}
    for p in sorted(prefixes, key=len):
        found = trie.step(np.full(labels, state[p]), np.arange(labels))
        for x, to in enumerate(found.tolist()):
            assert (to >= 0) == ((*p, x) in prefixes)
            if to >= 0:
                state[(*p, x)] = to
    assert len(set(state.values())) == len(prefixes)
    assert (trie.check >= 0).sum() == len(prefixes) - 1


# --- spelling variants ---------------------------------------------------------------------


def plain_words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    if len(x) > len(y):
        x, y = y, x
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def plain_variants(rows):
    words = plain_words(rows)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, words[w], len(near[w]), form[w], words.get(form[w]), root))
    return sorted(out)


@pytest.mark.parametrize("tile", [2, 8, 1024])
def test_variants_of_odd_rows(spark, tile):
    rng = random.Random(7)
    base = ["house", "mouse", "aaaaa", "aaaaaa", "straße", "ÀÉÎÕÜé", "zzzzzzzzzzzz", "x" * 300, "ab" * 60]
    rows = list(ODD)
    for i in range(400):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = [rng.choice("abé")] * rng.randrange(2)
        rows.append((rng.randrange(200), " ".join(["".join(w)] * rng.randrange(1, 9)) + ", Mouse-trap 日" + "house" * (i % 3)))
    got = variants.spelling_variants(table(spark, rows), tile)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == plain_variants(rows)
    assert variants.spelling_variants(table(spark, rows).filter("false"), tile).collect() == []


def test_blocks_of_every_size(spark):
    """Blocks from two words to hundreds, which meet in one product or in tiles."""
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.choice([5, 6]))) for _ in range(1500)})
    rows = [(w.encode("latin-1"), rng.randrange(3, 40)) for w in words]
    count = {w.decode(): n for w, n in rows}
    got = {bytes(r.w).decode(): (r.n_near, bytes(r.best).decode()) for r in variants.neighbours(spark.createDataFrame(rows, "w binary, n long")).collect()}
    for w in words[::10]:
        vs = [v for v in words if one_edit(w, v)]
        want = (len(vs), min(vs, key=lambda v: (-count[v], v))) if vs else None
        assert got.get(w) == want


def test_words_and_blocks_are_not_broadcast(spark, monkeypatch):
    plans = written_plans(monkeypatch, variants)
    words = [f"{a}{b}ouse{c}" for a in "abcd" for b in "ef" for c in ("", "s")]
    rows = [(f"{w} " * (k % 5 + 3),) for k, w in enumerate(words)]
    docs = spark.createDataFrame(rows, "text string").withColumn("doc_id", F.xxhash64("text"))
    got = variants.spelling_variants(docs, tile=4)
    assert got.count() >= len(words) - 1 and "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sum("SortMergeJoin" in p for p in plans) >= 3 and not any("Broadcast" in p for p in plans)


# --- queries -------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op13_prefix_trie"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(llm.ORACLES[name])
    columns = [c[0] for c in found.description]
    df = llm.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(found.fetchall(), key=str)


def test_simhash_query(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by 1").fetchall()
    fps = [plain_fingerprint(t) for _, t in rows]
    want = sorted(zip([d for d, _ in rows], [f"{f:016x}" for f in fps], plain_groups([d for d, _ in rows], fps), strict=True))
    got = llm.QUERIES["op12_simhash_dedup"](spark, SF).select("doc_id", "fingerprint", "component_id")
    assert sorted(map(tuple, got.collect())) == want
    assert got.filter(F.length("fingerprint") != 16).isEmpty()
