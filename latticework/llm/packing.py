"""Best-fit-decreasing packing of token pieces into fixed-length sequences.

Best fit decreasing needs only the number of pieces of each length, and there
are at most `capacity` lengths. The plan is made from that histogram: a segment
tree over remaining capacities finds the tightest open bin in logarithmic time,
and equal pieces that meet equal bins are placed as one run. Each piece then
finds its place from its rank among the pieces of its length, so the plan is
the one that placing piece after piece would give, at any input size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut
from .tokens import crcs, encoded, encoder

#: Text bytes that are encoded in one step: other stages' memory stays with the executor.
STEP_BYTES = 3 << 20
RUNS = "length int, first long, stop long, bin long, each long, base int"


class TightestFit:
    """Segment tree over remaining capacities 0..capacity that holds which are open."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1).bit_length()
        self.open = bytearray(2 * self.leaves)

    def put(self, at: int, is_open: bool) -> None:
        node = at + self.leaves
        self.open[node] = is_open
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] | self.open[2 * node + 1]

    def least(self, wanted: int) -> int:
        """The smallest open capacity >= wanted, or -1."""
        node = wanted + self.leaves
        if self.open[node]:
            return wanted
        while node > 1:
            if not node & 1 and self.open[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return -1


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over {length: pieces}.

    Rows (length, first, stop, bin, each, base): pieces of this length with
    ranks first .. stop-1 go `each` to a bin, from bin number `bin` on, the
    first of each bin at offset `base`. Bins with the same remaining capacity
    are alike, so they are kept as runs of bin numbers, and there are at most a
    few runs for each length.
    """
    tree = TightestFit(capacity)
    cohorts: dict[int, list[tuple[int, int]]] = {}  # remaining capacity -> runs (first bin, bins)
    rows, bins = [], 0

    def keep(left: int, first: int, count: int) -> None:
        if count and left:
            cohorts.setdefault(left, []).append((first, count))
            tree.put(left, True)

    for length in sorted(histogram, reverse=True):
        rank, count = 0, histogram[length]
        while rank < count:
            left = tree.least(length)
            if left < 0:
                each = capacity // length
                need = -(-(count - rank) // each)
                left, first, have = capacity, bins, need
                bins += need
            else:
                first, have = cohorts[left].pop()
                if not cohorts[left]:
                    tree.put(left, False)
            # The tightest bin stays the tightest until no further piece fits in it.
            each = left // length
            full = min(have, (count - rank) // each)
            base = capacity - left
            if full:
                rows.append((length, rank, rank + full * each, first, each, base))
                keep(left - each * length, first, full)
                rank += full * each
            used = full
            if used < have and rank < count:
                rest = count - rank
                rows.append((length, rank, count, first + used, each, base))
                keep(left - rest * length, first + used, 1)
                rank, used = count, used + 1
            keep(left, first + used, have - used)
    return rows




def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, text: str = "text", row_id: str = "doc_id", words_only: bool = True, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): whole texts as ids with the
    end id, cut at `capacity` only where longer. Null text counts as empty."""

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_ = encoder(tokenizer, end_id, words_only)
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for rows, ids, sizes in encoded(batch.column("text"), with_, STEP_BYTES):
                n = -(-sizes // capacity)
                owner = np.repeat(np.arange(len(sizes)), n)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, sizes[owner] - start)
                at = (np.cumsum(sizes) - sizes)[owner] + start
                out = [doc_ids.slice(rows.start, rows.stop - rows.start).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crcs(ids, at, length))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cuts, schema)


def pack(cut_pieces: DataFrame, capacity: int) -> DataFrame:
    """Add (sequence_id, offset) to pieces with a `length` of 1..capacity.

    Of equal lengths, ranks follow the task that made a piece, then doc_id and
    piece. Repeated rows are packed as often as they come. An empty table gives
    no rows. The driver holds one count per length and the plan's runs (a few
    per length, whatever the input); no task holds more than the pieces that
    one task made.
    """
    spark = cut_pieces.sparkSession
    rows = cut(cut_pieces.withColumn("__part", F.spark_partition_id()))
    counts = rows.groupBy("__part", "length").agg(F.count(F.lit(1)).alias("__own"))
    before = F.sum("__own").over(Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = cut(counts.select("__part", "length", F.coalesce(before, F.lit(0)).alias("__before"), "__own"))
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("__own")).collect()}
    runs = spark.createDataFrame(plan(histogram, capacity), RUNS) if histogram else spark.createDataFrame([], RUNS)
    inside = F.row_number().over(Window.partitionBy("__part", "length").orderBy("doc_id", "piece", "start")) - 1
    # Sorted by the keys of the window, so that the join needs no shuffle of its own; counts grow with the number of tasks.
    ranked = rows.join(counts.drop("__own").hint("merge"), ["__part", "length"]).withColumn("__rank", F.col("__before") + inside)
    runs = F.broadcast(runs.withColumnRenamed("length", "__length"))
    placed = ranked.join(runs, (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("first")) & (F.col("__rank") < F.col("stop")))
    place = F.col("__rank") - F.col("first")
    return placed.select(
        *cut_pieces.columns,
        (F.col("bin") + F.floor(place / F.col("each")).cast("long")).alias("sequence_id"),
        (F.col("base") + (place % F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, **options) -> DataFrame:
    """Whole documents to sequences: `pieces`, then `pack`. Columns of `docs` other
    than id and text are ignored; a null id stays null. A text of any length is
    encoded whole, alone in its step if it is longer than STEP_BYTES; pieces of
    equal length are interchangeable, so ties change no sequence's fill."""
    return pack(pieces(docs, tokenizer, end_id, capacity, **options), capacity)
