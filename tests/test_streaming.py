"""Streams against their batch twins, over split, duplicate and late input."""

from __future__ import annotations

import random
import time

import numpy as np
import pandas as pd
import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

from pairwright.operators import interview, matching, terms
from pairwright.plans import fixtures as fx
from pairwright.streaming import interviews, scoring, transcripts

FRAGMENT = "session_id bigint, ord bigint, text string, is_final boolean, control string"


def run(stream, where, name):
    out = f"{where}/{name}"
    job = (
        stream.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
    )
    job.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def drip(spark, parts, schema, where):
    """A stream that gets one part per micro-batch, in order."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(where)
        if i + 1 < len(parts):
            time.sleep(1.1)  # files are taken by modification time
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(where)


def by_hand(fragments):
    text, interim = {}, {}
    for session, _, body, final, control in sorted(fragments, key=lambda f: (f[0], f[1])):
        t = text.setdefault(session, "")
        interim.setdefault(session, "")
        if control == "reset":
            text[session] = interim[session] = ""
        elif control == "stop":
            interim[session] = ""
        elif body and final:
            text[session] = t + " " + body.strip() if t else body.strip()
        elif body:
            interim[session] = body
    return {s: (text[s], interim[s]) for s in text}


def fragments(seed):
    rng = random.Random(seed)
    out = []
    for session in range(3):
        for order in range(40):
            control = rng.choice([None] * 12 + ["stop", "reset"])
            out.append((session, order, rng.choice([f" w{order} ", " ", "", None, f"x{order}"]), rng.random() < 0.6, control))
    return out


def joined(batch):
    out = {}
    for r in batch.orderBy("session_id", "segment").collect():
        out.setdefault(r.session_id, ([], r.interim))[0].append(r.transcript)
    return {k: (" ".join(v[0]).lstrip(" "), v[1]) for k, v in out.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("block", [1, 7, 65536])
def test_transcripts_batch(spark, seed, block):
    data = fragments(seed)
    assert joined(transcripts.transcripts(spark.createDataFrame(data, FRAGMENT), block)) == by_hand(data)


@pytest.mark.parametrize("block", [7, 65536])
def test_transcripts_stream(spark, tmp_path, block):
    data = fragments(5)
    cut = [[f for f in data if lo <= f[1] < hi] for lo, hi in ((0, 15), (15, 16), (16, 40))]
    random.Random(0).shuffle(cut[0])
    # Duplicates change nothing, and late fragments find their place.
    late, cut[0] = cut[0][::6], [f for i, f in enumerate(cut[0]) if i % 6]
    parts = [cut[0], cut[1] + cut[0][:10], cut[2] + cut[2][:5] + late]
    stream = drip(spark, parts, FRAGMENT, str(tmp_path / "in"))
    deltas = run(transcripts.stream_transcripts(stream, block=block), tmp_path, "out")
    assembled = transcripts.assemble_deltas(deltas)
    assert joined(assembled) == by_hand(data)
    assert rows(assembled) == rows(transcripts.transcripts(spark.createDataFrame(data, FRAGMENT), block))


@pytest.mark.parametrize("seed", range(4))
def test_transcripts_after_timeouts(spark, seed):
    """State dropped between batches, fragments late and again, deltas in any order."""
    rng, block = random.Random(seed), 16
    data = [(1, 0, " a ", True, None), (1, 1, "b", True, None), (1, 2, "0c", True, None)] if seed == 0 else fragments(seed)
    prepared = transcripts._prepared(spark.createDataFrame(data, FRAGMENT), block).toPandas()
    prepared = prepared.astype(object).where(prepared.notna(), None)
    step, emitted = transcripts._advance(1000, block), []
    for key, own in prepared.groupby(["session_id", "segment"]):
        state, order = Forgetful(), own if seed == 0 else own.sample(frac=1, random_state=seed)
        batches = [order.iloc[i : i + 2] for i in range(0, len(order), 2)] + [order.iloc[:3]]
        for batch in batches:
            emitted += [tuple(x) for f in step(key, iter([batch]), state) for x in f.itertuples(index=False)]
            if seed == 0 or rng.random() < 0.5:
                state.hasTimedOut = True
                assert list(step(key, iter([]), state)) == [] and not state.exists
                state.hasTimedOut = False
    rng.shuffle(emitted)
    deltas = spark.createDataFrame([tuple(int(x) if isinstance(x, np.integer) else x for x in e) for e in emitted], transcripts.DELTA_SCHEMA)
    assert joined(transcripts.assemble_deltas(deltas)) == by_hand(data)


def test_many_sessions_share_few_keys_of_state(spark, tmp_path):
    data = [(k % 300, k, f"w{k}", k % 3 > 0, None) for k in range(900)] + [(None, 7, "x", True, None)]
    stream = drip(spark, [data[:500], data[400:]], FRAGMENT, str(tmp_path / "in"))
    job = (
        transcripts.stream_transcripts(stream, block=64, groups=4).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    job.awaitTermination()
    assert job.lastProgress["stateOperators"][0]["numRowsTotal"] == 5
    deltas = spark.read.schema(transcripts.DELTA_SCHEMA).parquet(str(tmp_path / "out"))
    assert deltas.select(F.sum(F.size("ords"))).first()[0] == sum(f[3] for f in data)  # repeats stay out of the log
    batch = transcripts.transcripts(spark.createDataFrame(data, FRAGMENT), 64)
    assert rows(transcripts.assemble_deltas(deltas)) == rows(batch)


def test_an_idle_session_is_dropped_though_others_of_its_key_go_on(spark, monkeypatch):
    step, state, at = transcripts._advance(1000, 16), Forgetful(), [0.0]
    monkeypatch.setattr(transcripts.time, "time", lambda: at[0])
    said = lambda *ids: pd.DataFrame([(i, 0, 3, True, None, "a") for i in ids], columns=transcripts.FRAGMENT)
    out = []
    for at[0], ids in ((1.0, (1, 2)), (1.6, (2, 1)), (2.4, (2,)), (3.0, (1, 2))):
        out.append([r.session_id for f in step((0,), iter([said(*ids)]), state) for r in f.itertuples()])
    assert out == [[1, 2], [], [], [1]]


def test_interim_outlives_a_final(spark):
    data = [(1, 0, "hel", False, None), (1, 1, "hello", True, None)]
    assert joined(transcripts.transcripts(spark.createDataFrame(data, FRAGMENT))) == {1: ("hello", "hel")}


def talk_lists(spark):
    jds = terms.jd_postings(fx.jds(spark, SF))
    return interview.jd_term_lists(jds, jds)


@pytest.mark.parametrize(("total", "block"), [(1, 4096), (3, 1), (3, 3), (3, 4096)])
def test_interviews(spark, tmp_path, total, block):
    """Turns come shuffled, a batch late and again; the result is that of the table."""
    turns = fx.turns(spark, SF)
    data = [tuple(r) for r in turns.collect()]
    late = [t for t in data if (t[0] + t[1]) % 5 == 0]
    parts = [[t for t in data if t[1] < 4 and t not in late], data[::7] + [t for t in data if t[1] >= 3 and t not in late], late + data[::9]]
    stream = drip(spark, parts, turns.schema, str(tmp_path / "in"))
    scored = interview.turn_metrics(stream, fx.interviews(spark, SF), talk_lists(spark))
    emitted = run(interviews.stream_interviews(scored, total, block=block), tmp_path, "out")
    batch = interviews.interview_states(interview.turn_metrics(turns, fx.interviews(spark, SF), talk_lists(spark)), total)
    assert rows(interviews.current_states(emitted, total, block).select(*batch.columns)) == rows(batch)


class Forgetful:
    """State as the engine hands it to a stateful step; ``expire`` is a timeout."""

    exists, value, hasTimedOut, set_for = False, None, False, None

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.exists, self.value = True, value

    def remove(self):
        self.exists, self.value = False, None

    def setTimeoutDuration(self, ms):
        self.set_for = ms


@pytest.mark.parametrize("seed", range(3))
def test_interviews_after_timeouts(spark, seed):
    """State dropped between batches, turns late and again: the summaries still merge to the result."""
    rng = random.Random(seed)
    turns = fx.turns(spark, SF)
    metrics = interview.turn_metrics(turns, fx.interviews(spark, SF), talk_lists(spark))
    block, total = 4, 3
    frame = metrics.select("conv_id", "turn", "answered", *interviews.METRICS).toPandas()
    step = interviews._advance(total, 1000, block)
    emitted = []
    for (conv, part), own in frame.groupby(["conv_id", frame["turn"] // block]):
        state, order = Forgetful(), own.sample(frac=1, random_state=seed)
        batches = [order.iloc[i : i + 1] for i in range(len(order))] + [order.iloc[:2]]
        for batch in batches:
            emitted += [tuple(x) for f in step((conv, part), iter([batch]), state) for x in f.itertuples(index=False)]
            assert state.set_for == 1000
            if rng.random() < 0.5:
                state.hasTimedOut = True
                assert list(step((conv, part), iter([]), state)) == [] and not state.exists
                state.hasTimedOut = False
    rng.shuffle(emitted)
    summaries = spark.createDataFrame([(int(c), int(b), *rest) for c, b, *rest in emitted], interviews.OUTPUT_SCHEMA)
    batch = interviews.interview_states(metrics, total)
    assert rows(interviews.current_states(summaries, total, block).select(*batch.columns)) == rows(batch)


def test_an_interview_without_answers_shows_initial_metrics(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", "q")], "conv_id bigint, turn bigint, role string, text string")
    ids = spark.createDataFrame([(1, 1)], "conv_id bigint, item_id bigint")
    lists = spark.createDataFrame([(1, ["a"], 1, ["a"])], "item_id bigint, key_list array<string>, n_key_terms bigint, vocabulary array<string>")
    metrics = interview.turn_metrics(turns, ids, lists)
    assert rows(interviews.interview_states(metrics)) == [(1, 0, 1, 1, False, 100, 100, "TỐT")]
    assert rows(interview.metrics_rollup(metrics)) == [(1, 0, 100, 100, "TỐT", None, None)]


DOC = "doc_id bigint, text string, version int"


def scored(spark, texts, keys):
    """All scores of the documents as they are, from scratch."""
    cvs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    index = scoring._index(cvs, matching.cv_scores())
    return rows(matching.score_lines(index.join(keys.drop("df"), "term")).select(*scoring.OUTPUT))


def keys_of(spark, jds):
    listed = [(item, word, 1 + len(word) % 2, 0) for item, words in jds.items() for word in words.split()]
    return terms.with_totals(spark.createDataFrame(listed, "item_id bigint, term string, tf bigint, df bigint"))


def test_incremental_scoring(spark, tmp_path):
    keys = keys_of(spark, {1: "spark kafka", 2: "nurse"})
    parts = [
        [(1, "spark", 1), (2, "kafka\nspark", 1), (3, "nurse 1", 1)],
        [(1, "spark", 1), (2, "kafka spark", 2), (3, "nothing", 2)],
        [(2, "kafka", 3), (2, "spark kafka nurse", 4)],
    ]
    out = str(tmp_path / "out")
    stream = drip(spark, parts, DOC, str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        scoring.stream_incremental_scoring(stream, keys, out, out + "-state").awaitTermination()
    got = rows(scoring.current_scores(spark, out))
    assert got == scored(spark, {1: "spark", 2: "spark kafka nurse", 3: "nothing"}, keys)
    assert [r[:2] for r in got] == [(1, 1), (2, 1), (2, 2)]
    assert rows(spark.read.parquet(out + "/versions").groupBy("turn").count()) == [(0, 3), (2, 2), (4, 1)]

    # Replaying a batch changes nothing.
    scoring.score_batch(spark.createDataFrame(parts[2], DOC), 2, keys, out)
    assert rows(scoring.current_scores(spark, out)) == got


def test_state_is_compacted_and_jds_change_without_documents(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{i}x" for i in range(12)]
    jds = {1: "w0x w1x w2x", 2: "w3x w4x", 3: "w5x"}
    texts, out = {}, str(tmp_path / "out")
    for batch in range(9):
        drop = {rng.randrange(30): "\n".join(" ".join(rng.sample(words, 3)) for _ in range(2)) for _ in range(6 if batch else 20)}
        texts |= drop
        docs = spark.createDataFrame([(k, t, batch) for k, t in drop.items()], DOC)
        for _ in range(1 + (batch in (3, 6, 7))):  # a replay changes nothing, not even of a batch that compacts
            scoring.score_batch(docs, batch, keys_of(spark, jds), out, compact=3)
        if batch in (2, 4, 7):
            jds |= {1: rng.choice(words), 3: " ".join(rng.sample(words, 2))}
            if batch == 4:
                jds.pop(2)
            for _ in range(2):
                scoring.refresh(spark, lambda session: keys_of(session, jds), out)
        if batch in (0, 2, 5, 7, 8):
            assert rows(scoring.current_scores(spark, out)) == scored(spark, texts, keys_of(spark, jds))
    # a later batch reads the snapshot and what came since, and of the snapshot the parts it needs
    store = scoring.Store(spark, out, 18)
    assert store.base == 11 and store.log == [12, 14, 15, 16]
    files = store.read("terms").inputFiles()
    assert all("snapshot/terms/turn=11" in f or any(f"terms/turn={t}/" in f for t in store.log) for f in files)
    one = spark.createDataFrame([("w0x",)], "term string")
    opened = {r[0] for r in store.read("terms", one).select(F.input_file_name()).collect() if "snapshot" in r[0]}
    assert len({f.split("part=")[1].split("/")[0] for f in opened}) == 1 < sum("snapshot" in f for f in files)
    before = rows(scoring.current_scores(spark, out))
    scoring.expire(spark, out)
    assert rows(scoring.current_scores(spark, out)) == before
    assert scoring._turns(spark, out + "/terms") == [12, 14, 15, 16] and scoring._turns(spark, out + "/snapshot/terms") == [11]


def test_terms_of_a_batch_are_marked_where_the_text_is(spark):
    texts = ["b a\na c a\n\nB d", "", None, "one", "x\nx\nx y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = scoring._index(docs, matching.cv_scores())
    want = []
    for k, text in enumerate(texts):
        seen = set()
        for i, line in enumerate((text or "").lower().split("\n")):
            want += [(k, i, t, t not in seen) for t in set(line.split())]
            seen |= set(line.split())
    assert rows(index.select("doc_id", "line_no", "term", "first")) == sorted(want)
    assert "Window" not in index._jdf.queryExecution().executedPlan().toString()


def test_metrics_take_one_pass(spark):
    from conftest import plan

    from pairwright.plans.queries import QUERIES

    shape = plan(QUERIES["metrics_rollup"](spark, SF))
    assert shape.count("conversations.parquet") == 1 and shape.count("Exchange hashpartitioning") <= 2


def test_state_is_small():
    assert "array" not in transcripts.STATE_SCHEMA + interviews.STATE_SCHEMA


def test_events_stream_equals_batch(spark):
    from pairwright.plans.queries import QUERIES

    batch = transcripts.transcripts(fx.as_fragments(fx.table(spark, SF, "events")))
    assert rows(QUERIES["stream_transcripts"](spark, SF)) == rows(batch)


@pytest.mark.parametrize("name", ["stream_interviews", "stream_transcripts"])
def test_streams_read_tables_in_folders(spark, tmp_path, name):
    """A table may be one file or a folder of part files."""
    from pairwright.plans.queries import QUERIES

    for table in ("events", "conversations", "benchmark", "documents"):
        fx.table(spark, SF, table).repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    got = rows(QUERIES[name](spark, str(tmp_path)))
    assert got and got == rows(QUERIES[name](spark, SF))
