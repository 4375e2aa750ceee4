"""Token ids in bit-packed files: fixed width, block offsets, random access.

A file is a run of chunks.  A chunk holds whole documents in ascending id order: a
header, the documents' ids and ends, the byte offset of each block, and the token ids,
each in the fewest bits that hold the vocabulary.  A block has ``BLOCK`` ids and starts
at a whole byte, so a reader unpacks just the blocks a document lies in, all ids at once.

Spark writes and reads the files, so they can lie in any store that Spark reaches.
Null texts count as empty and give the end id alone.  Rows may repeat: equal ids are
ordered by a hash of the text.  Null ids come first.  Columns other than the id and
the text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwright.llm.tokens import encoder
from pairwright.plans.scale import materialize

BLOCK = 4096  #: ids of a block
CHUNK = 1 << 20  #: ids of a chunk, more only where one document has more
CHUNKS_PER_FILE = 4
AT_ONCE = 1024  #: documents a worker encodes together
MAGIC = b"BPK1"
HEAD = np.dtype(
    [
        ("magic", "S4"), ("bits", "<u4"), ("block", "<u4"), ("n_docs", "<u4"), ("n_blocks", "<u4"),
        ("size", "<u8"), ("part", "<u8"), ("start", "<u8"), ("n_ids", "<u8"),
    ]
)
WRITTEN = "chunk binary"
READ = "part long, at long, doc_id long, n_tokens long, ids_crc32 long"


def width(vocabulary: int) -> int:
    """Bits of the largest id."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids of one block, lowest bit first."""
    places = (ids.astype("<u4")[:, None] >> np.arange(bits, dtype="u4")) & 1
    return np.packbits(places.astype("u1").ravel(), bitorder="little").tobytes()


def unpack(packed: bytes, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of a block, by shifting the eight bytes from where each begins."""
    raw = np.frombuffer(packed + b"\0" * 8, "u1")
    at = np.arange(n, dtype="i8") * bits
    window = np.zeros(n, "u8")
    for k in range((bits + 14) // 8):
        window |= raw[(at >> 3) + k].astype("u8") << np.uint64(8 * k)
    return ((window >> (at & 7).astype("u8")) & np.uint64((1 << bits) - 1)).astype("<u4")


def write_chunk(part: int, start: int, bits: int, docs: list[tuple[int | None, bytes]]) -> bytes:
    """docs: id and token ids (unsigned 32-bit) of each document."""
    ids = np.frombuffer(b"".join(d for _, d in docs), "<u4")
    if bits == 16:  # the same layout without going through single bits
        blocks = [ids[a : a + BLOCK].astype("<u2").tobytes() for a in range(0, len(ids), BLOCK)]
    else:
        blocks = [pack(ids[a : a + BLOCK], bits) for a in range(0, len(ids), BLOCK)]
    body = b"".join(
        [
            np.array([d is not None for d, _ in docs], "u1").tobytes(),
            np.array([d or 0 for d, _ in docs], "<i8").tobytes(),
            np.cumsum([len(d) // 4 for _, d in docs], dtype="<u8").tobytes(),
            np.cumsum([0, *map(len, blocks)], dtype="<u8").tobytes(),
            *blocks,
        ]
    )
    head = np.array((MAGIC, bits, BLOCK, len(docs), len(blocks), HEAD.itemsize + len(body), part, start, len(ids)), HEAD)
    return head.tobytes() + body


class Chunk:
    """A chunk at some place of a buffer."""

    def __init__(self, buffer: bytes, at: int = 0) -> None:
        head = np.frombuffer(buffer, HEAD, 1, at)[0]
        if head["magic"] != MAGIC:
            raise ValueError(f"no chunk at byte {at}")
        self.bits, self.block, self.n_ids = int(head["bits"]), int(head["block"]), int(head["n_ids"])
        self.part, self.start, self.end = int(head["part"]), int(head["start"]), at + int(head["size"])
        n, self.buffer, at = int(head["n_docs"]), buffer, at + HEAD.itemsize
        has = np.frombuffer(buffer, "u1", n, at)
        ids = np.frombuffer(buffer, "<i8", n, at + n)
        self.doc_ids = [int(i) if h else None for i, h in zip(ids, has)]
        self.ends = np.frombuffer(buffer, "<u8", n, at + 9 * n).astype("i8")
        n_blocks = int(head["n_blocks"])
        self.offsets = np.frombuffer(buffer, "<u8", n_blocks + 1, at + 17 * n).astype("i8")
        self.payload = at + 17 * n + 8 * (n_blocks + 1)

    def ids(self, a: int, b: int) -> np.ndarray:
        """Token ids from place ``a`` up to ``b`` of the chunk, read from their blocks alone."""
        if a >= b:
            return np.zeros(0, "<u4")
        first, last = a // self.block, (b - 1) // self.block
        got = []
        for k in range(first, last + 1):
            n = min(self.block, self.n_ids - k * self.block)
            raw = self.buffer[self.payload + self.offsets[k] : self.payload + self.offsets[k + 1]]
            got.append(unpack(raw, n, self.bits))
        return np.concatenate(got)[a - first * self.block : b - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


def chunks(content: bytes) -> Iterator[Chunk]:
    """The chunks of a file; Spark ends each with a line break."""
    at = 0
    while at < len(content):
        yield (c := Chunk(content, at))
        at = c.end + 1


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text: str = "text") -> None:
    """Encode each text, append ``end_id`` and write the ids in ascending order of ``id_col``."""

    def encode(batches):
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        bits, start, held, n = width(max(enc.vocabulary, end_id + 1)), 0, [], 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for a in range(0, batch.num_rows, AT_ONCE):
                ids, texts = (c.to_pylist() for c in batch.slice(a, AT_ONCE).columns[:2])
                for doc, got in zip(ids, enc.encode_all(texts)):
                    held.append((doc, got + end))
                    n += len(got) // 4 + 1
                    if n >= CHUNK:
                        yield pa.RecordBatch.from_pydict({"chunk": [write_chunk(part, start, bits, held)]})
                        start, held, n = start + n, [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"chunk": [write_chunk(part, start, bits, held)]})

    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole.alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    packed = rows.mapInArrow(encode, WRITTEN).select(F.col("chunk").cast("string").alias("value"))
    packed.write.option("maxRecordsPerFile", CHUNKS_PER_FILE).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: id, place of its first id, number of ids, and their CRC-32."""

    def decode(batches):
        for batch in batches:
            for content in batch.column(0):
                for c in chunks(content.as_py()):
                    ids, ends = c.ids(0, c.n_ids), c.ends.tolist()
                    starts = [0, *ends[:-1]]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "part": [c.part] * len(ends),
                            "at": [c.start + a for a in starts],
                            "doc_id": pa.array(c.doc_ids, pa.int64()),
                            "n_tokens": [b - a for a, b in zip(starts, ends)],
                            "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)],
                        }
                    )

    files = spark.read.format("binaryFile").load(path).select("content")
    found = materialize(files.mapInArrow(decode, READ), "token-files")
    # one row for each part, so the running total over them is short
    totals = found.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return found.join(base, "part").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )
