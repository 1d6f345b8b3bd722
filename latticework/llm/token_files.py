"""Token-ID files: concatenated ids with Elias-Fano document boundaries.

A file is a run of blobs, in ascending document order. A blob is

    magic 'LTK1', uint64 documents, uint64 ids, uint8 id width, uint8 low bits,
    uint8 low bits of the document ids, int64 first document id,
    Elias-Fano document ids, Elias-Fano boundaries, ids

Boundaries are the running counts of ids after each document; document ids are
kept as their distances from the first one. Of either sequence the low bits
are packed; the high parts are a unary bit vector of at most 2 bits a
document, with the place of every 256th one sampled, so an entry is found by
a short scan from a sample (`EliasFano.select`). Blobs are kept as rows of a
Parquet table, so that any store that Spark reaches can hold them.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, shared_dir
from .tokens import crcs, encoded, encoder

HEAD = struct.Struct("<4sQQBBBq")
#: Documents and ids in a blob at most (a longer single document is one blob).
BLOB_DOCS, BLOB_IDS = 8192, 1 << 20
SAMPLE = 256
#: Blobs up to which their starts are broadcast.
BROADCAST_BLOBS = 500_000


class EliasFano:
    """A non-decreasing sequence of n numbers below 2**64 in about n * (2 + log2(last / n)) bits."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        last = int(values[-1]) if n else 0
        low_bits = max(0, (last // max(n, 1)).bit_length() - 1)
        v = values.astype(np.uint64)
        low = np.packbits(((v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(ones[-1]) + 8) // 8 * 8 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype(np.uint64))

    def lows(self, i: np.ndarray) -> np.ndarray:
        """Low bits of the given entries."""
        at = i.astype(np.int64)[:, None] * self.low_bits + np.arange(self.low_bits)
        bits = (self.low[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1)
        return (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: np.ndarray | int) -> np.ndarray:
        """The given entries, ascending: each is found by counting ones from the sample before it."""
        i = np.atleast_1d(np.asarray(i, np.int64))
        if len(i) and not (0 <= i[0] and i[-1] < self.n):
            raise IndexError(i)
        out = np.empty(len(i), np.uint64)
        for sample in np.unique(i // SAMPLE).tolist():
            a, b = np.searchsorted(i, (sample * SAMPLE, (sample + 1) * SAMPLE))
            start = int(self.samples[sample]) // 8
            # Up to the byte of the next sample there are all ones that are asked for.
            stop = int(self.samples[sample + 1]) // 8 + 1 if sample + 1 < len(self.samples) else len(self.high)
            ones = np.flatnonzero(np.unpackbits(self.high[start:stop], bitorder="little")) + 8 * start
            ones = ones[ones >= int(self.samples[sample])]
            own = i[a:b]
            out[a:b] = (ones[own - sample * SAMPLE] - own).astype(np.uint64) << np.uint64(self.low_bits)
        return out | self.lows(i)

    def pack(self) -> bytes:
        return struct.pack("<QQQ", len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u8").tobytes()

    @classmethod
    def unpack(cls, n: int, low_bits: int, data: memoryview) -> tuple[EliasFano, int]:
        a, b, c = struct.unpack_from("<QQQ", data)
        at = 24
        low = np.frombuffer(data, np.uint8, a, at)
        high = np.frombuffer(data, np.uint8, b, at + a)
        samples = np.frombuffer(data, "<u8", c, at + a + b)
        return cls(n, low_bits, low, high, samples), at + a + b + 8 * c


def write_blob(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """doc_ids ascend."""
    bounds = EliasFano.of(np.cumsum(lengths))
    # Distances wrap to unsigned numbers, so any two 64-bit ids have one.
    names = EliasFano.of(doc_ids.astype(np.int64).view(np.uint64) - doc_ids[:1].astype(np.int64).view(np.uint64))
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    head = HEAD.pack(b"LTK1", len(doc_ids), len(ids), width, bounds.low_bits, names.low_bits, int(doc_ids[0]))
    return head + names.pack() + bounds.pack() + ids.astype(f"<u{width}").tobytes()


class Blob:
    """A blob read back: document ids, boundaries and ids; `document(i)` by select."""

    def __init__(self, data: bytes):
        magic, n, total, width, low_bits, name_bits, first = HEAD.unpack_from(data)
        if magic != b"LTK1":
            raise ValueError("not a token blob")
        view, at = memoryview(data), HEAD.size
        names, used = EliasFano.unpack(n, name_bits, view[at:])
        self.bounds, more = EliasFano.unpack(n, low_bits, view[at + used :])
        self.ids = np.frombuffer(view, f"<u{width}", total, at + used + more)
        self.doc_ids = (names.select(np.arange(n)) + np.int64(first).astype(np.uint64)).view(np.int64)

    def document(self, i: int) -> np.ndarray:
        return self.ids[int(self.bounds.select(i - 1)[0]) if i else 0 : int(self.bounds.select(i)[0])]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, text: str = "text", row_id: str = "doc_id", words_only: bool = False, partitions: int | None = None) -> str:
    """Encode whole texts and write blobs under `path` in ascending row_id order.

    Null text counts as empty (the end id alone). A null id is written as the
    least 64-bit number and comes first. Repeated rows are written as often as
    they come; those with one id stand side by side, in the order of a hash of
    their texts. A text of any length is encoded whole and is in one blob. An
    empty table gives a table without blobs. Other columns are ignored. Texts
    move once, to range partitions by id.
    """
    rows = docs.select(F.coalesce(F.col(row_id).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tie"), F.monotonically_increasing_id().alias("row"))
    # Bounds of ranges are sampled, so their keys are numbers, never a text; the last one splits rows that are alike.
    keys = ["doc_id", "tie", "row"]
    ranged = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_ = encoder(tokenizer, end_id, words_only)
        seq, held = 0, []

        def flush():
            nonlocal seq, held
            doc_ids, lengths, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            held, seq = [], seq + 1
            return pa.RecordBatch.from_pydict({"seq": [seq], "first_id": [int(doc_ids[0])], "n_ids": [len(ids)], "blob": [write_blob(doc_ids, lengths, ids)]}, schema)

        for batch in batches:
            doc_ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for rows, ids, lengths in encoded(batch.column("text"), with_):
                held.append((doc_ids[rows], lengths, ids))
                if sum(len(x[0]) for x in held) >= BLOB_DOCS or sum(len(x[2]) for x in held) >= BLOB_IDS:
                    yield flush()
        if held:
            yield flush()

    schema = pa.schema([("seq", pa.int64()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("blob", pa.large_binary())])
    out = ranged.sortWithinPartitions(*keys).drop("tie", "row").mapInArrow(blobs, "seq long, first_id long, n_ids long, blob binary")
    out.withColumn("part", F.spark_partition_id()).write.option("compression", "zstd").parquet(path)
    return path


def blob_starts(files: DataFrame) -> DataFrame:
    """(part, seq, start): ids before each blob. Partial sums first, so one task sees a row per part only."""
    small = files.select("part", "seq", "n_ids")
    parts = small.groupBy("part").agg(F.sum("n_ids").alias("own"))
    before = F.coalesce(F.sum("own").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return small.select("part", "seq", inside.alias("inside")).join(parts.select("part", before.alias("before")), "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("start"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: (doc_id, start, n_tokens, ids_crc32).

    Rows are as `write_tokens` wrote them: empty and null texts have the end token alone, a text of any length is whole, and
    repeated rows and those without id are a row each, in the order of the files. A table without blobs gives no rows."""
    files = spark.read.parquet(path)
    starts = cut(blob_starts(files))
    # Blobs stay where they are read while the table of starts (24 bytes a blob
    # of up to a million ids) is small; beyond that, a shuffled join.
    located = files.join(F.broadcast(starts) if starts.count() <= BROADCAST_BLOBS else starts, ["part", "seq"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column("start").to_pylist(), batch.column("blob"), strict=True):
                blob = Blob(data.as_py())
                ends = blob.bounds.select(np.arange(blob.bounds.n)).astype(np.int64)
                lengths = np.diff(ends, prepend=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(blob.doc_ids), pa.array(start + ends - lengths), pa.array(lengths), pa.array(crcs(blob.ids, ends - lengths, lengths))],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return located.select("start", "blob").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def scratch_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/latticework-tokens-{uuid.uuid4().hex}"
