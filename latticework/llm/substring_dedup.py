"""Removal of long repeated byte strings by a logarithmic family of suffix indexes.

Every string of `length` bytes that starts at two places anywhere is found.
Suffixes are sampled first: in each such string the place with the least hash
of the half as many bytes that follow it is its anchor, and those bytes are its
context, so equal strings have equal anchors at equal distances. Anchors whose
context occurs once need no look; anchors whose whole surrounding is repeated
are settled by its 128-bit digest; only the rest, where a repeat begins or
ends, go to the suffix indexes.

There, contexts are dealt to tasks. Each batch of suffixes becomes a suffix
array in the order of its bytes, is merge-scanned against the levels of the
task's family, and levels of like size merge, so each suffix is merged a
logarithmic number of times. Only matches of the full `length` count, so
suffixes are ordered by, and compared in, their first `length` bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash import finish
from .shared import chunks, cut, drop, large, ragged

#: Bytes hashed in one piece; a longer text is taken in overlapping pieces.
PIECE = 2 << 20
PLACE_BITS = np.uint64(23)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Surroundings of one context that one index holds; the suffixes of more are dealt by their own digests.
HOT = 10_000
#: Suffixes that one task indexes, about, and surroundings in one of its batches.
SUFFIXES, BATCH = 150_000, 1000
#: Open places up to which they are broadcast to the texts (32 bytes each).
NAMED = 1_000_000


@cache
def letters() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64)


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        down = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, INVERSE, np.uint64))))
        up = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, BASE, np.uint64))))
    return down, up


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of data[i : i + width] for every i."""
    n = len(data)
    if n < width:
        return np.zeros(0, np.uint64)
    down, up = powers(1 << max(16, (n - 1).bit_length()))
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(letters()[data] * down[:n], out=sums[1:])
    return finish((sums[width:] - sums[: n - width + 1]) * up[: n - width + 1])


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """min(keys[i : i + width]) for every i, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        keys = np.minimum(keys[:-step], keys[step:])
        have += step
    return keys


def anchors(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, first, offset, more, context hash): strings starting at first .. first +
    more of a text share the anchor at first + offset. Places are within the text."""
    context = length // 2
    g = window_hashes(data, context)
    keys = (g >> PLACE_BITS << PLACE_BITS) | np.arange(len(g), dtype=np.uint64)
    least = sliding_least(keys, length - context + 1)
    sizes = np.diff(bounds)
    usable = np.maximum(sizes - length + 1, 0)
    starts = ragged(bounds[:-1], usable)
    at = (least[starts] & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), usable)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    more = np.diff(np.append(first, len(at))) - 1
    owner = owner[first]
    return owner, starts[first] - bounds[owner], at[first] - starts[first], more, g[at[first]]


def pieces(texts: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, bounds, text of each piece, its place in the text) of a bounded size.
    Long texts come in pieces that overlap by length - 1."""
    for a, b in chunks(texts, PIECE):
        own = texts.slice(a, b - a)
        offsets = np.frombuffer(own.buffers()[1], np.int64, len(own) + 1, own.offset * 8)
        data = np.frombuffer(own.buffers()[2], np.uint8) if own.buffers()[2] is not None else np.zeros(0, np.uint8)
        data = data[offsets[0] : offsets[-1]]
        if len(data) <= 2 * PIECE:
            yield data, offsets - offsets[0], np.arange(a, b), np.zeros(b - a, np.int64)
        else:
            for at in range(0, len(data) - length + 1, PIECE):
                part = data[at : at + PIECE + length - 1]
                yield part, np.array([0, len(part)]), np.array([a]), np.array([at])


def find_anchors(rows: DataFrame, length: int) -> DataFrame:
    """(g, h1, h2, rid, tag, lo, off, more) of rows (rid, tag, text): context hash, digest of the whole surrounding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, tag = batch.column("rid").to_numpy(zero_copy_only=False), batch.column("tag").to_numpy(zero_copy_only=False)
            for data, bounds, text, place in pieces(large(batch.column("text")), length):
                owner, lo, off, more, g = anchors(data, bounds, length)
                view, begin = memoryview(data), bounds[owner] + lo
                seed = off * (length + 1) + more
                h = b"".join([xxhash.xxh3_128_digest(view[a:b], s) for a, b, s in zip(begin.tolist(), (begin + more + length).tolist(), seed.tolist(), strict=True)])
                h = np.frombuffer(h, np.int64).reshape(-1, 2)
                columns = [g.view(np.int64), h[:, 0].copy(), h[:, 1].copy(), rid[text[owner]], tag[text[owner]], lo + place[owner], off.astype(np.int32), more.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["g", "h1", "h2", "rid", "tag", "lo", "off", "more"])

    return rows.mapInArrow(run, "g long, h1 long, h2 long, rid long, tag int, lo long, off int, more int")


class Levels:
    """Suffix arrays of geometrically growing size; equal suffixes are held once.

    A level is the suffixes' first bytes in their order, and for each its row, its place and
    whether it has been matched."""

    def __init__(self):
        self.levels: list[list[np.ndarray]] = []

    def add(self, keys: np.ndarray, members: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Take a batch in; the (members, places) now known to be repeated, older ones too."""
        order = np.argsort(keys, kind="stable")
        keys, members, places = keys[order], members[order], places[order]
        same = keys[1:] == keys[:-1]
        matched = np.zeros(len(keys), bool)
        matched[1:] |= same
        matched[:-1] |= same
        fresh = np.ones(len(keys), bool)
        fresh[1:] = ~same
        found = []
        for level in self.levels:
            at = np.searchsorted(level[0], keys)
            at[at == len(level[0])] = 0
            hit = level[0][at] == keys
            matched |= hit
            fresh &= ~hit
            older = np.unique(at[hit])
            older = older[~level[3][older]]
            level[3][older] = True
            found.append((level[1][older], level[2][older]))
        found.append((members[matched], places[matched]))
        self.levels.append([keys[fresh], members[fresh], places[fresh], matched[fresh]])
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            small, big = self.levels.pop(), self.levels.pop()
            order = np.argsort(np.concatenate((big[0], small[0])), kind="stable")  # two sorted runs: one merge
            self.levels.append([np.concatenate(x)[order] for x in zip(big, small, strict=True)])
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def runs_of(rid: np.ndarray, tag: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Places as runs (rid, tag, p0, p1)."""
    order = np.lexsort((place, tag, rid))
    rid, tag, place = rid[order], tag[order], place[order]
    new = np.ones(len(rid), bool)
    new[1:] = (rid[1:] != rid[:-1]) | (tag[1:] != tag[:-1]) | (place[1:] > place[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rid)) - 1
    return pa.RecordBatch.from_arrays([pa.array(rid[first]), pa.array(tag[first]), pa.array(place[first]), pa.array(place[last])], names=["rid", "tag", "p0", "p1"])


def suffixes(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first bytes, row of the batch, place) of every start in a batch of surroundings (lo, more, bytes)."""
    column = batch.column("bytes").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    number = batch.column("more").to_numpy().astype(np.int64) + 1
    within = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
    starts = np.repeat(offsets[:-1] - offsets[0], number) + within
    every = np.ndarray((len(data) - length + 1,), f"S{length}", data, 0, (1,))  # a view: the suffixes' first bytes overlap
    return every[starts], np.repeat(np.arange(len(batch)), number), np.repeat(batch.column("lo").to_numpy(), number) + within


def match_batches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Levels()
        rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]  # rid and tag of the surroundings seen
        seen = 0
        for batch in batches:
            for a in range(0, len(batch), BATCH):
                own = batch.slice(a, BATCH)
                keys, row, place = suffixes(own, length)
                for kept, name in zip(rows, ("rid", "tag"), strict=True):
                    kept[:] = [np.concatenate((*kept, own.column(name).to_numpy()))]
                row, place = family.add(keys, row + seen, place)
                seen += len(own)
                if len(row):
                    yield runs_of(rows[0][0][row], rows[1][0][row], place)

    return run


def hot_places(around: DataFrame, length: int) -> DataFrame:
    """For contexts with very many surroundings: suffixes dealt by the digests of their first bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), BATCH):
                own = batch.slice(a, BATCH)
                keys, row, place = suffixes(own, length)
                view = memoryview(np.ascontiguousarray(keys)).cast("B")
                digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[k : k + length]) for k in range(0, len(view), length)]), np.int64).reshape(-1, 2)
                rid, tag = (own.column(n).to_numpy()[row] for n in ("rid", "tag"))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (digests[:, 0].copy(), digests[:, 1].copy(), rid, tag, place)], names=["k1", "k2", "rid", "tag", "p0"])

    single = cut(around.mapInArrow(run, "k1 long, k2 long, rid long, tag int, p0 long"), "suffixes")
    counts = single.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k1", "k2")
    return single.join(counts, ["k1", "k2"]).select("rid", "tag", "p0", F.col("p0").alias("p1"))


def repeated_places(rows: DataFrame, length: int) -> DataFrame:
    """(rid, tag, p0, p1): runs of starts of strings that also start elsewhere, of rows (rid, tag, text).

    Any context or surrounding may be that of very many anchors: sums over them are combined before
    they are shuffled, and the joins are plain ones, which adaptive execution splits. Each table is
    deleted when what is made from it has been written."""
    found = cut(find_anchors(rows, length), "anchors")
    # Sums are written, so that the joins stand on plain exchanges.
    contexts = cut(found.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("g"), "contexts")
    shared = cut(found.join(contexts, "g"), "shared")
    drop(found, contexts)
    one = F.xxhash64("rid", "tag", "lo")
    whole = cut(shared.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("g").alias("g1"), F.min(one).alias("one")), "whole")
    settled = cut(shared.join(whole.drop("g1"), ["h1", "h2"]).select("g", "rid", "tag", "lo", "off", "more", F.col("n").alias("times"), (one == F.col("one")).alias("first")), "settled")
    drop(shared)
    # One of each surrounding, of contexts that have several.
    several = cut(whole.groupBy(F.col("g1").alias("g")).agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "several")
    open_ = cut(settled.where("first").select("g", "rid", "tag", "lo", "more").join(several, "g"), "open")
    drop(whole, several)
    number, starts = open_.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("more") + 1), F.lit(0))).first()
    lists = open_.groupBy("rid", "tag").agg(F.collect_list(F.struct("g", "lo", "more", "kinds")).alias("places"))
    # Rows alike in id and text share rid and tag; they repeat each other, so what stands
    # twice here is repeated throughout.
    texts = rows.join(F.broadcast(lists) if number <= NAMED else lists, ["rid", "tag"])

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["g", "lo", "more", "kinds"]
        for batch in batches:
            for rid, tag, text, places in zip(batch.column("rid").to_pylist(), batch.column("tag").to_pylist(), batch.column("text"), batch.column("places"), strict=True):
                view, places = memoryview(text.as_buffer()), places.values
                lo, more = places.field("lo").to_pylist(), places.field("more").to_pylist()
                for k in range(0, len(lo), 10_000):
                    own = pa.array([bytes(view[a : a + m + length]) for a, m in zip(lo[k : k + 10_000], more[k : k + 10_000], strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([rid] * len(own), pa.int64()), pa.array([tag] * len(own), pa.int32()), *[places.field(x).slice(k, 10_000) for x in names], own], names=["rid", "tag", *names, "bytes"])

    around = cut(texts.mapInArrow(surroundings, "rid long, tag int, g long, lo long, more int, kinds long, bytes binary"), "around")
    drop(open_)
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-starts // SUFFIXES))
    runs = around.where(F.col("kinds") <= HOT).repartition(parts, "g").mapInArrow(match_batches(length), "rid long, tag int, p0 long, p1 long")
    hot = around.where(F.col("kinds") > HOT)
    if not hot.isEmpty():
        runs = runs.unionByName(hot_places(hot, length))
    full = settled.where("times > 1").select("rid", "tag", F.col("lo").alias("p0"), (F.col("lo") + F.col("more")).alias("p1"))
    places = cut(full.unionByName(runs), "places")
    drop(settled, around)
    return places


def remove_repeats(docs: DataFrame, text: str = "text", row_id: str = "doc_id", length: int = 400, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, removed, kept]), one row per input row.

    Each UTF-8 byte that is covered by a string of `length` bytes which also
    starts anywhere else, in the same text too, is removed; strings are judged
    on the input. n_spans counts maximal removed runs; the digest is of the
    other bytes joined. With keep_text, `removed` has the runs as (start, stop)
    in bytes and `kept` the other bytes as binary. Null text counts as
    empty. Repeated rows are texts of their own, so they repeat each other. A
    null id stays null. A text longer than PIECE bytes is searched in pieces
    that overlap, so memory does not follow its length there; in the last step
    a text and a mark per byte are held. An empty table gives no rows. Other
    columns are ignored. Texts that are repeated as a whole surrounding of an
    anchor, or in very hot contexts, are equal by a 128-bit digest, others by
    their bytes. Texts move once, to their runs.
    """
    rows = docs.select(F.col(row_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # 96 bits name a row, so that rows of a large corpus do not share a name.
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), F.hash("text", "doc_id").alias("tag"), "text")
    places = repeated_places(rows.select("rid", "tag", "text").where(F.octet_length("text") >= length), length)
    lists = places.groupBy("rid", "tag").agg(F.collect_list(F.struct("p0", "p1")).alias("runs"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["removed", "kept"] * keep_text
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = large(whole.column("text"))
            for a, b in chunks(texts):
                out, batch = [], whole.slice(a, b - a)
                for doc_id, text, runs in zip(batch.column("doc_id").to_pylist(), texts.slice(a, b - a), batch.column("runs"), strict=True):
                    data = text.as_buffer().to_pybytes()
                    bounds, kept = np.zeros((0, 2), np.int64), data
                    if runs.is_valid:
                        edge = np.zeros(len(data) + 1, np.int32)
                        np.add.at(edge, runs.values.field("p0").to_numpy(), 1)
                        np.add.at(edge, runs.values.field("p1").to_numpy() + length, -1)
                        gone = np.cumsum(edge) > 0
                        bounds = np.flatnonzero(np.diff(gone, prepend=False)).reshape(-1, 2)
                        kept = np.frombuffer(data, np.uint8)[~gone[:-1]].tobytes()
                    spans = [{"start": x, "stop": y} for x, y in bounds.tolist()] if keep_text else None
                    out.append((doc_id, len(data), int((bounds[:, 1] - bounds[:, 0]).sum()), len(bounds), hashlib.sha256(kept).hexdigest(), spans, kept))
                kinds = [pa.int64()] * 4 + [pa.string()] + [span, pa.binary()] * keep_text
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", removed array<struct<start:long,stop:long>>, kept binary" * keep_text
    return rows.join(lists, ["rid", "tag"], "left").select("doc_id", "text", "runs").mapInArrow(run, schema)
