"""Speech fragments to transcripts.

A fragment is (session_id, ord, text, is_final, control), ``ord`` being a position
unique within its session.  Final fragments are trimmed and joined by blanks; an
interim one replaces the interim shown so far.  A later final does not clear the
interim: only the controls ``stop`` and ``reset`` do, and ``reset`` also starts the
transcript anew.

Both the batch and the streaming form give (session_id, segment, transcript,
interim).  A segment covers ``BLOCK`` consecutive positions, so a session of any
length is worked on in parallel and no list grows with it; its segments in order,
joined by blanks and left-trimmed, are the whole transcript.

The stream writes a log of deltas.  A delta holds its final pieces by position, and the latest
reset, clearing and interim it saw, so deltas merge in any order and one that comes twice changes
nothing.  State only remembers positions, to keep repeats out of the log; when it is dropped at a
timeout, repeats get into the log and go when it is merged.
"""

from __future__ import annotations

import pickle
import time
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pairwright.functions.rules import int_div
from pairwright.functions.text import trim_text
from pairwright.plans import scale

BLOCK = 65536
GROUPS = 4096
# Of each session and block in the group: when it was last heard of, and a packed bit for each
# position seen, lowest first.
STATE_SCHEMA = "seen binary"
FRAGMENT = ("session_id", "segment", "ord", "is_final", "control", "text")
MARKS = ("reset_at", "cleared_at", "interim_ord", "interim")
DELTA_SCHEMA = (
    "session_id bigint, segment bigint, reset_at bigint, cleared_at bigint, interim_ord bigint, interim string, "
    "ords array<bigint>, pieces array<string>"
)


def _prepared(fragments: DataFrame, block: int) -> DataFrame:
    control = F.col("control") if "control" in fragments.columns else F.lit(None).cast("string")
    final = F.coalesce("is_final", F.lit(False))
    return fragments.select(
        "session_id",
        int_div(F.col("ord"), F.lit(block)).cast("bigint").alias("segment"),
        "ord",
        final.alias("is_final"),
        control.alias("control"),
        F.when(F.length("text") > 0, F.when(final, trim_text("text")).otherwise(F.col("text"))).alias("text"),
    )


def _present(marks: DataFrame, texts: DataFrame) -> DataFrame:
    """Transcript rows of every session; one empty row where nothing was said."""
    interim = F.when(F.col("interim_ord") > F.col("cleared_at"), F.col("interim")).otherwise("")
    first = F.col("segment") == F.col("first_segment")
    firsts = texts.groupBy("session_id").agg(F.min("segment").alias("first_segment"))
    heads = marks.join(firsts, "session_id", "left").select(
        "session_id", interim.alias("interim"), "first_segment"
    )
    heads = scale.materialize(heads, "transcript-heads")
    return heads.join(texts, "session_id", "left").select(
        "session_id",
        F.coalesce("segment", F.lit(0)).alias("segment"),
        F.coalesce(F.when(first, F.ltrim("body")).otherwise(F.col("body")), F.lit("")).alias("transcript"),
        "interim",
    )


# --- streaming ---------------------------------------------------------------------------


def _unseen(rows: list[tuple], seen: bytearray, block: int) -> list[tuple]:
    """(ord, is_final, control, text) at new positions, each position once, in order; marks them as seen."""
    new = []
    for row in rows:
        byte, bit = row[0] % block // 8, 1 << row[0] % block % 8
        if byte >= len(seen):
            seen.extend(bytes(byte + 1 - len(seen)))
        if not seen[byte] & bit:
            seen[byte] |= bit
            new.append(row)
    return sorted(new, key=lambda r: r[0])


def _delta(rows: list[tuple]) -> tuple:
    """What fragments in order add: latest marks and the final pieces by position."""
    reset = cleared = shown = -1
    interim, ords, pieces = None, [], []
    for place, final, control, text in rows:
        if isinstance(control, str):
            reset = place if control == "reset" else reset
            cleared = place if control in ("reset", "stop") else cleared
        elif isinstance(text, str) and final:
            ords.append(place)
            pieces.append(text)
        elif isinstance(text, str):
            shown, interim = place, text
    return reset, cleared, shown, interim, ords, pieces


def _advance(ttl_ms: int, block: int):
    def step(
        key: tuple, frames: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = int(time.time() * 1000) if ttl_ms else 0
        before = pickle.loads(state.get[0]) if state.exists else {}
        # the group lives on while any of its sessions does, so idle ones go by their own times
        held = {k: v for k, v in before.items() if v[0] + ttl_ms > now} if ttl_ms else dict(before)
        for frame in frames:  # an Arrow batch at most, whatever the size of the group
            parts: dict[tuple, list] = {}
            for session, segment, *row in zip(*(frame[c].tolist() for c in FRAGMENT), strict=True):
                session = None if session is None or session != session else int(session)
                parts.setdefault((session, int(segment)), []).append(row)
            deltas = []
            for part, rows in parts.items():
                seen = bytearray(zlib.decompress(held[part][1])) if part in held else bytearray()
                new = _unseen(rows, seen, block)
                held[part] = (now, zlib.compress(seen, 1) if new else held[part][1])
                if new:
                    deltas.append((*part, *_delta(new)))
            if deltas:
                yield pd.DataFrame(deltas, columns=["session_id", "segment", *MARKS, "ords", "pieces"])
        if held != before:
            state.update((pickle.dumps(held),))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)

    return step


def stream_transcripts(fragments: DataFrame, ttl_ms: int = 0, block: int = BLOCK, groups: int = GROUPS) -> DataFrame:
    """Stream of fragments to a stream of transcript deltas.

    State is kept per session and block of positions, a bit for each, never the
    text: each micro-batch emits only what it adds.  Fragments at a seen position are
    ignored; late ones at a new position find their place when deltas are assembled.
    Sessions and blocks are dealt out to ``groups`` keys of state, as a call for each of
    them would cost more than its few fragments.
    ``ttl_ms`` of processing time drops idle state.  Set it for a stream
    that runs on; a run over what is available now would never end, as it goes on
    waiting for timeouts, so there it stays 0.
    """
    timeout = (
        GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    )
    dealt = F.pmod(F.xxhash64("session_id", "segment"), F.lit(groups))
    return (
        _prepared(fragments, block)
        .withColumn("dealt", F.when(F.col("session_id").isNull(), -1).otherwise(dealt))
        .groupBy("dealt")
        .applyInPandasWithState(_advance(ttl_ms, block), DELTA_SCHEMA, STATE_SCHEMA, "append", timeout)
    )


def assemble_deltas(deltas: DataFrame) -> DataFrame:
    """Transcripts from the emitted deltas, in whatever order they come and however often."""
    marks = scale.materialize(
        deltas.groupBy("session_id").agg(
            *[F.max(c).alias(c) for c in ("reset_at", "cleared_at", "interim_ord")],
            F.max_by("interim", "interim_ord").alias("interim"),
        ),
        "transcript-marks",
    )
    pieces = F.arrays_zip("ords", "pieces")
    lists = deltas.filter(F.size("ords") > 0).groupBy("session_id", "segment").agg(
        F.array_sort(F.flatten(F.collect_list(pieces))).alias("p")
    )
    current = lists.join(marks.select("session_id", "reset_at"), "session_id")
    first = lambda x, i: (i == 0) | (F.get("p", i - 1)["ords"] != x["ords"])
    kept = F.filter("p", lambda x, i: (x["ords"] > F.col("reset_at")) & first(x, i))
    texts = current.withColumn("kept", kept).filter(F.size("kept") > 0)
    body = F.array_join(F.transform("kept", lambda x: x["pieces"]), " ")
    return _present(marks, texts.select("session_id", "segment", body.alias("body")))


def _bodies(rows: DataFrame, order: str, text: Column) -> DataFrame:
    """(session_id, segment, body): texts of a segment in order, joined by blanks."""
    packed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return rows.groupBy("session_id", "segment").agg(packed.alias("p")).select(
        "session_id", "segment", F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("body")
    )


# --- batch -------------------------------------------------------------------------------


def transcripts(fragments: DataFrame, block: int = BLOCK) -> DataFrame:
    """Batch twin of :func:`stream_transcripts` with :func:`assemble_deltas`."""
    rows = _prepared(fragments, block)
    said = F.col("text").isNotNull() & F.col("control").isNull()
    shown = F.when(said & ~F.col("is_final"), F.col("ord"))
    none = F.lit(-1)
    marks = scale.materialize(
        rows.groupBy("session_id").agg(
            F.coalesce(F.max(F.when(F.col("control") == "reset", F.col("ord"))), none).alias("reset_at"),
            F.coalesce(F.max(F.when(F.col("control").isin("stop", "reset"), F.col("ord"))), none)
            .alias("cleared_at"),
            F.coalesce(F.max(shown), none).alias("interim_ord"),
            F.max_by("text", shown).alias("interim"),
        ),
        "transcript-marks",
    )
    finals = rows.filter(said & F.col("is_final")).join(
        marks.select("session_id", "reset_at"), "session_id"
    )
    return _present(marks, _bodies(finals.filter("ord > reset_at"), "ord", F.col("text")))
