"""MinHash near-dedup: one-permutation hashing with optimal densification,
banded buckets, star-shaped candidate edges, exact confirmation, components.

Stars bound the pairs of a bucket by its size. A star can miss a link between
two members that are both unlike its centre, so buckets whose members the stars
leave in more than one piece are looked at once more. Members of small ones
(SMALL) are compared across pieces, in pairs that are counted out beforehand.
Larger ones that share members make a crowd. A crowd is dealt into cells of
about CELL sets, one task compares two cells by a product of their incidence
matrices, and only the links that join pieces leave it. Cells that the stars
have made one piece already are not compared with each other. So every pair
that shares a bucket is settled on the full sets, no group is in one task, and
no list of pairs grows with the square of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import chunks, cut, large, words

BINS, BANDS = 192, 32
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Draws of a donor bin before the first filled bin is taken.
DRAWS = 2048
#: Members of a bucket that are compared pair by pair.
SMALL = 48
#: Sets in a cell, about, and shingles that a comparison of two cells holds as columns.
CELL, COLUMNS = 256, 1 << 14
#: Rows up to which the texts with a partner are named to the scan by broadcast (16 bytes each).
NAMED = 1_500_000
#: An id, with a mark for null: it comes after every other.
ID = "struct<none:boolean,value:long>"
#: Text bytes whose shingles are held at once.
STEP_BYTES = 3 << 20


def finish(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, and their number per text.

    Shingles are runs of k words (A-Z lower-cased); fewer words make one shingle.
    """
    distinct, codes, counts = words(texts)
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))
    w = hashed[codes] if len(codes) else np.zeros(0, np.uint64)
    times = np.uint64(0x9E3779B97F4A7C15)
    ends = np.cumsum(counts)
    starts = ends - counts
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    length = np.repeat(np.minimum(counts, k), n)
    h = length.astype(np.uint64)
    for j in range(k):
        there = length > j
        if there.all():
            h = h * times + w[first + j]
        else:
            h[there] = h[there] * times + w[first[there] + j]
    h = finish(h)
    bounds = np.concatenate(([0], np.cumsum(n)))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[bounds[:-1][n > 0]] = True
    upto = np.concatenate(([0], np.cumsum(new)))
    return h[new], upto[bounds[1:]] - upto[bounds[:-1]]


@cache
def donors() -> np.ndarray:
    return np.random.default_rng(7).integers(0, BINS, (DRAWS, BINS))


def signatures(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One-permutation MinHash: a text's shingles fall into BINS ranges of the hash,
    the least of each range stands for it; an empty range takes the value of a
    range drawn by a hash of its own number, the same for all texts."""
    owner = np.repeat(np.arange(len(n)), n)
    bins = ((h >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    key = owner * BINS + bins
    first = np.ones(len(h), bool)
    first[1:] = key[1:] != key[:-1]
    sig = np.full(len(n) * BINS, EMPTY)
    sig[key[first]] = h[first]
    sig = sig.reshape(-1, BINS)
    filled = sig != EMPTY
    rows, cols = np.nonzero(~filled & (n > 0)[:, None])
    for draw in donors():
        if not len(rows):
            break
        hit = filled[rows, draw[cols]]
        sig[rows[hit], cols[hit]] = sig[rows[hit], draw[cols[hit]]]
        rows, cols = rows[~hit], cols[~hit]
    if len(rows):
        sig[rows, cols] = sig[rows, filled[rows].argmax(axis=1)]
    return sig


def bands(sig: np.ndarray) -> np.ndarray:
    width = BINS // BANDS
    grouped = sig.reshape(-1, BANDS, width)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), grouped.shape[:2]).copy()
    for j in range(width):
        h = h * np.uint64(0xD6E8FEB86659FD93) + finish(grouped[:, :, j])
    return finish(h).view(np.int64)


def sign(docs: DataFrame, k: int, banded: bool = True) -> DataFrame:
    """(id, t, n, digest, bands) of rows (id, t, text): set size, 128-bit digest of the set, band hashes (none if not asked for)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = large(batch.column("text"))
            for a, b in chunks(texts, STEP_BYTES):
                h, n = shingles(texts.slice(a, b - a), k)
                ends = np.cumsum(n)
                view = memoryview(h).cast("B")
                digests = [xxhash.xxh3_128_hexdigest(view[8 * (e - m) : 8 * e]) if m else None for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
                if banded:
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(n > 0, BANDS, 0)))).astype(np.int32)), pa.array(bands(signatures(h, n))[n > 0].ravel()))
                else:
                    lists = pa.nulls(len(n), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), batch.column("t").slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(digests, pa.string()), lists], names=["id", "t", "n", "digest", "bands"])

    return docs.mapInArrow(run, f"id {ID}, t long, n long, digest string, bands array<long>")


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    """(v, hashes) of rows (v, text): the sorted shingle hashes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = large(batch.column("text"))
            for a, b in chunks(texts, STEP_BYTES):
                h, n = shingles(texts.slice(a, b - a), k)
                view, ends = memoryview(h).cast("B"), np.cumsum(n)
                yield pa.RecordBatch.from_arrays([batch.column("v").slice(a, b - a), pa.array([bytes(view[8 * (e - m) : 8 * e]) for e, m in zip(ends.tolist(), n.tolist(), strict=True)], pa.binary())], names=["v", "hashes"])

    return docs.mapInArrow(run, "v long, hashes binary")


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Of two sorted sets: 100 * intersection >= percent * union."""
    both = np.concatenate((x, y))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, na, b, nb) whose full sets have 100 * intersection >= percent * union, as (a, b).

    Sizes that rule a link out are left before any set moves. Many edges may share an end: the
    joins are plain ones, which adaptive execution splits.
    """
    fit = edges.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b")
    pairs = fit.join(sets.select(F.col("v").alias("a"), "hashes"), "a").join(sets.select(F.col("v").alias("b"), F.col("hashes").alias("other")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column("hashes"), batch.column("other"), strict=True)
            keep = [alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in sides]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "hashes", "other").mapInArrow(run, "a long, b long")


def pieces(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members of buckets that the links leave in more than one piece: (bucket, v, n, root, size).
    Two members with one root are surely linked by way of others."""
    up = links.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("up"))  # a centre is less than its members
    top = up.join(up.select(F.col("v").alias("up"), F.col("up").alias("top")), "up", "left").select("v", F.coalesce("top", "up").alias("root"))
    rooted = members.join(top, "v", "left").select("bucket", "v", "n", F.coalesce("root", "v").alias("root"))
    open_ = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high").select("bucket", "size", "low")
    return cut(rooted.join(open_, "bucket"), "open")


def small_pairs(open_: DataFrame, crowds: DataFrame | None, percent: int) -> DataFrame:
    """Pairs (a, na, b, nb) of pieces in buckets of up to SMALL members, but for pairs within a crowd."""
    rows = open_.where(F.col("size") <= SMALL).select("bucket", "v", "n", "root")
    rows = rows.withColumn("crowd", F.lit(None).cast("long")) if crowds is None else rows.join(crowds, "v", "left")
    one, two = (rows.select("bucket", *[F.col(c).alias(c + s) for c in ("v", "n", "root", "crowd")]) for s in "ab")
    apart = (F.col("va") > F.col("vb")) & (F.col("roota") != F.col("rootb")) & ~F.coalesce(F.col("crowda") == F.col("crowdb"), F.lit(False))
    fit = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return one.join(two, "bucket").where(apart & fit).select(F.col("va").alias("a"), "na", F.col("vb").alias("b"), "nb").distinct()


def compare(sets: list[np.ndarray], roots: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) that join pieces, i of `left` and j of `right`: sets are rows of incidence matrices over
    COLUMNS shingles at a time, so one product counts all intersections. Products of 0 and 1 are exact."""
    n = np.array([len(s) for s in sets])
    owner, shingle = np.repeat(np.arange(len(sets)), n), np.concatenate(sets)
    _, column = np.unique(shingle, return_inverse=True)
    shared = np.zeros((len(left), len(right)), np.float32)
    row_l, row_r = np.full(len(sets), -1), np.full(len(sets), -1)
    row_l[left], row_r[right] = np.arange(len(left)), np.arange(len(right))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (first, first + COLUMNS))
        own, at = owner[a:b], column[a:b] - first
        one, two = (np.zeros((len(side), COLUMNS), np.float32) for side in (left, right))
        for matrix, rows in ((one, row_l[own]), (two, row_r[own])):
            matrix[rows[rows >= 0], at[rows >= 0]] = 1
        shared += one @ two.T
    union = n[left][:, None] + n[right][None, :] - shared
    i, j = np.nonzero((100 * shared >= percent * union) & (roots[left][:, None] != roots[right][None, :]))
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    out = []
    for x, y in zip(left[i].tolist(), right[j].tolist(), strict=True):
        p, q = top(int(roots[x])), top(int(roots[y]))
        if p != q:
            up[p] = q
            out.append((x, y))
    return out


def crowd_links(crowds: DataFrame, open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join pieces of a crowd (v, crowd), found cell by cell."""
    rows = open_.select("v", "root").distinct().join(crowds, "v")
    sizes = rows.groupBy("crowd", "root").agg(F.count(F.lit(1)).alias("members"))
    wide = F.col("members") >= CELL
    # A piece of many sets has cells of its own; small pieces share theirs.
    shared = sizes.where(~wide).groupBy("crowd").agg(F.ceil(F.sum("members") / F.lit(CELL)).alias("parts"))
    dealt = sizes.join(shared, "crowd", "left").select("crowd", "root", wide.alias("own"), F.when(wide, F.ceil(F.col("members") / F.lit(CELL))).otherwise(F.col("parts")).alias("parts"))
    cell = F.struct(F.col("own"), F.when(F.col("own"), F.col("root")).otherwise(0).alias("of"), F.pmod(F.xxhash64(F.when(F.col("own"), F.col("v")).otherwise(F.col("root"))), F.col("parts")).alias("part"))
    placed = cut(rows.join(dealt, ["crowd", "root"]).select("v", "root", "crowd", cell.alias("cell")), "cells")
    cells = placed.select("crowd", "cell").distinct()
    low, high = cells.select("crowd", F.col("cell").alias("low")), cells.select("crowd", F.col("cell").alias("high"))
    one_piece = F.col("low.own") & F.col("high.own") & (F.col("low.of") == F.col("high.of"))
    tasks = low.join(high, "crowd").where((F.col("low") <= F.col("high")) & ~one_piece).withColumn("task", F.struct("crowd", "low", "high"))
    sides = tasks.select("crowd", "task", F.lit(True).alias("left"), (F.col("low") == F.col("high")).alias("same"), F.col("low").alias("cell"))
    sides = sides.unionByName(tasks.where("low <> high").select("crowd", "task", F.lit(False).alias("left"), F.lit(False).alias("same"), F.col("high").alias("cell")))
    sent = placed.join(sides, ["crowd", "cell"]).select("task", "v", "root", "left", "same").join(sets, "v")

    def run(group: pa.Table) -> pa.Table:
        v, roots = group["v"].to_numpy(), group["root"].to_numpy()
        own = [np.frombuffer(h.as_buffer(), np.uint64) for h in group["hashes"]]
        is_left = group["left"].to_numpy()
        left = np.flatnonzero(is_left)
        right = left if group["same"][0].as_py() else np.flatnonzero(~is_left)
        got = compare(own, roots, left, right, percent)
        return pa.table({"a": pa.array([v[x] for x, _ in got], pa.int64()), "b": pa.array([v[y] for _, y in got], pa.int64())})

    return sent.groupBy("task").applyInArrow(run, "a long, b long")


def linked(classes: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """(v, root) of classes that have a link, from classes (v, n, id, t, bands) and rows (id, t, text)."""
    spread = classes.select("v", "n", F.explode("bands").alias("bucket"))
    # A centre is a member with its size: the least of a random order. Written, so that the join below can be split where a bucket is hot.
    centres = spread.groupBy("bucket").agg(F.min(F.struct("v", "n")).alias("c"), F.max("v").alias("last")).where("c.v <> last").select("bucket", F.col("c.v").alias("b"), F.col("c.n").alias("nb"))
    members = cut(spread.join(cut(centres, "centres"), "bucket"), "members")
    stars = members.where("v <> b").select(F.col("v").alias("a"), F.col("n").alias("na"), "b", "nb").distinct()
    return settled(members.select("bucket", "v", "n"), stars, members.select("v").distinct(), classes, rows, k, percent)


def settled(members: DataFrame, edges: DataFrame, partners: DataFrame, classes: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """(v, root) of classes that have a link: candidate edges (a, na, b, nb), b less than a, are confirmed on the full sets of
    `partners` (v), then buckets of members (bucket, v, n) that they leave in pieces are settled."""
    named = cut(partners.join(classes.select("v", "id", "t"), "v"), "named")
    number = named.count()
    if not number:
        return named.select("v", F.col("v").alias("root"))
    # A further scan makes the full sets of texts that have a partner.
    sets = cut(sets_of(rows.join(F.broadcast(named) if number <= NAMED else named, ["id", "t"]).select("v", "text"), k), "sets")
    if sets.count() > number:  # rows alike in id and text
        sets = cut(sets.dropDuplicates(["v"]), "sets")
    links = cut(confirmed(edges, sets, percent), "links")
    open_ = pieces(members, links)
    crowds, found = None, links
    hot = open_.where(F.col("size") > SMALL)
    if not hot.isEmpty():
        # All members of a bucket meet in its least root.
        crowds = cut(components(hot.select(F.col("v").alias("a"), F.col("low").alias("b"))).select(F.col("node").alias("v"), F.col("root").alias("crowd")), "crowds")
        found = found.unionByName(cut(crowd_links(crowds, open_, sets, percent), "links"))
    found = found.unionByName(cut(confirmed(small_pairs(open_, crowds, percent), sets, percent), "links"))
    return components(found).select(F.col("node").alias("v"), "root")


def marked(docs: DataFrame, text: str, row_id: str, k: int, percent: int, link: Callable[..., DataFrame] = linked) -> DataFrame:
    """(id, t, n, component, kept), one row per input row: ids as ID, and a hash of the text that tells the texts of one id
    apart. `link` finds the classes that have a link."""
    rows = docs.select(own_id(row_id).alias("id"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    signed = cut(sign(rows, k, banded=link is linked).withColumn("row", F.monotonically_increasing_id()), "signatures")
    # A class is a digest. xxhash64 is one-to-one on longs: v is the number of the class's first row in a random order.
    classes = signed.where("n > 0").groupBy("digest").agg(F.min(F.struct("id", "row", "t", "n", "bands")).alias("first"))
    classes = cut(classes.select("digest", F.col("first.id").alias("id"), F.col("first.t").alias("t"), F.col("first.n").alias("n"), F.xxhash64("first.row").alias("v"), F.col("first.bands").alias("bands")), "classes")
    named = cut(link(classes, rows, k, percent).join(classes.select("v", "id", "digest"), "v"), "roots")
    # Sums are written, so that the joins below stand on two plain exchanges, which adaptive execution splits
    # for a component of very many classes and for a class of very many copies.
    least = cut(named.groupBy("root").agg(F.min(F.struct("id", "digest")).alias("least")), "least")
    stands = named.join(least, "root").select("digest", F.col("least.id").alias("component"), (F.col("least.digest") == F.col("digest")).alias("chosen"))
    by_class = cut(classes.select("digest", "id").join(stands, "digest", "left").select("digest", F.coalesce("component", "id").alias("component"), F.coalesce("chosen", F.lit(True)).alias("chosen")), "by-class")
    own = signed.where("n > 0").select("id", "t", "n", "digest").join(by_class, "digest")
    own = own.select("id", "t", "n", "component", ((F.col("id") == F.col("component")) & F.col("chosen")).alias("kept"))
    return own.unionByName(signed.where("n = 0").select("id", "t", "n", F.col("id").alias("component"), F.lit(True).alias("kept")))


def own_id(row_id: str) -> Column:
    given = F.col(row_id).cast("long")
    return F.struct(given.isNull().alias("none"), F.coalesce(given, F.lit(0)).alias("value"))


def shown(column: str) -> Column:
    """An ID as it was given."""
    return F.when(~F.col(f"{column}.none"), F.col(f"{column}.value"))


def near_dedup(docs: DataFrame, text: str = "text", row_id: str = "doc_id", k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row.

    Two documents are linked when their sets of k-word shingles (A-Z
    lower-cased) have 100 * intersection >= percent * union. Texts of fewer
    words are one shingle; null, empty and blank texts have no shingle and are
    linked with nothing. component_id is the smallest id that links reach;
    `kept` marks the document with that id. Equal sets form one class and take
    part once, so a group of copies of any size costs one row. A document is an
    id with a set: rows repeated under one id share its component and mark, while
    different texts of one id (or without id) are linked each on its own, and of
    those that stand for one component under its id, that of least digest is
    kept. A null id counts as greater than every other. An empty table gives no
    rows. Other columns are ignored.

    At the default and at 85 % a link shares no bucket with a probability of
    6e-5 (at exactly 0.8) and 3e-7 (at exactly 0.85), less above.
    """
    return marked(docs, text, row_id, k, percent).select(shown("id").alias("doc_id"), F.col("n").alias("n_shingles"), shown("component").alias("component_id"), "kept")


def keep_one(docs: DataFrame, text: str = "text", row_id: str = "doc_id", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` whose document stands for its component, whole and with
    their columns (any names). Documents with null, empty or blank text and those
    linked with nothing all stay; rows repeated under a kept id and text stay as
    often as they come; texts of any length are compared whole; an empty table
    gives no rows."""
    kept = cut(marked(docs, text, row_id, k, percent).where("kept").select(F.col("id").alias("__id"), F.col("t").alias("__t")).distinct())
    whole = docs.select(own_id(row_id).alias("__id"), F.xxhash64(text).alias("__t"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    return whole.join(kept.hint("shuffle_hash"), ["__id", "__t"], "left_semi").select("__row.*")
