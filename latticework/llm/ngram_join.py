"""Jaccard join of n-gram sets by universe partition and pigeonhole, verified on the full sets.

Sizes fall into bands. In the context of a band meet its sets, and the larger ones
that may link with one of them. A hash deals all tokens (shingles) over the units
of the context, more units than two linked sets can differ in tokens, so in
some units two linked sets are equal. A set's tokens in a segment are indexed
by one key, the hash of that subset. Some segments take two units: there the key of
the subset and those of its one-deletion neighbourhood are indexed, so two sets
that differ by one token meet as well, and the segment counts twice.

Units beyond what a set of its size needs are allocated nothing: the set leaves out its smallest
subsets, which are the most frequent keys and so the costly ones. Both sets of a pair
order subsets alike (by size, then key), so of the units that they share at least one
stays with both. How many units and double segments a band has is chosen by cost.

Two or three sets under a key are compared pair by pair, more of them as buckets of
stars, crowds and cells, as for near-duplicates, so a large group never makes all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash import NAMED, STEP_BYTES, finish, marked, settled, shingles, shown
from .shared import chunks, cut, large, ragged

#: Sizes of a band, largest to least.
RATIO = 1.3
#: For costs only: the share of its tokens that a set has in common with an unlinked one, how many keys a comparison costs, and how
#: many bands the sets are spread over.
COMMON, COMPARE, SPREAD = 0.01, 20, 10


def apart(total: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Tokens in which two linked sets of `total` tokens together differ, at most."""
    return total * (100 - percent) // (100 + percent)


@cache
def starts(upto: int) -> np.ndarray:
    """First sizes of the bands; the last is beyond `upto`."""
    out = [1]
    while out[-1] <= upto:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
    return np.array(out, np.int64)


def poisson(mean: float) -> np.ndarray:
    c = np.arange(int(mean + 8 * math.sqrt(mean) + 12))
    return np.exp(c * math.log(mean) - mean - np.cumsum(np.log(np.maximum(c, 1))))


def cost(units: int, double: int, low: int, high: int, percent: int, rows: int) -> float:
    """Keys and comparisons of sets of the band: a key costs a comparison if an unlinked set has it too."""
    total, others = 0.0, rows / SPREAD
    for n in (low, (low + high) // 2, high):
        keep = max(0, apart(n + n * 100 // percent, percent) + 1 - 2 * double)
        p = poisson(n / units)
        have = (units - 2 * double) * p
        above = np.cumsum(have[::-1])[::-1] - have
        taken = np.clip(keep - above, 0, have)
        met = float((taken * -np.expm1(-others * p * COMMON ** np.arange(len(p)))).sum())
        q = poisson(2 * n / units)
        c = np.arange(len(q))
        met += double * float((q * -np.expm1(-others * np.maximum(q, np.append(0, q[:-1])) * (1 + 2 * c) * COMMON ** np.maximum(c - 1, 0))).sum())
        total += keep + double * (1 + 2 * n / units) + COMPARE * met
    return total


@cache
def allocation(low: int, high: int, percent: int, rows: int) -> tuple[int, int]:
    """(units, double segments) of the context of the band of sizes low .. high; no units where only equal sets link."""
    most = apart(high + high * 100 // percent, percent)
    if not most:
        return 0, 0
    doubles = [0] + [2**e for e in range(most.bit_length()) if 2 ** (e + 1) <= apart(low + low * 100 // percent, percent) + 1]
    spare = sorted({most + 1 + int(most * share) for share in (0, 0.05, 0.1, 0.2, 0.35, 0.5)})
    return min(((u, d) for u in spare for d in doubles), key=lambda x: (cost(*x, low, high, percent, rows), x))


def keys(h: np.ndarray, n: np.ndarray, percent: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of sets given as hashes, n of each set, and their number per set."""
    n = n.astype(np.int64)
    first = np.cumsum(n) - n
    start = starts(int(n.max(initial=1)))
    band = np.searchsorted(start, n, side="right") - 1
    least = -(-n * percent // 100)  # size of the least partner
    found, owners = [], []
    for back in range(len(start)):
        j = band - back
        last = start[np.maximum(j, 0) + 1] - 1  # largest size of the band
        sets = np.flatnonzero((n > 0) & (j >= 0) & (last >= least))
        if not len(sets):
            break
        planned = {b: allocation(int(start[b]), int(start[b + 1]) - 1, percent, rows) for b in np.unique(j[sets]).tolist()}
        own, size, of = sets, n[sets], j[sets]
        differ = apart(size + (size * 100 // percent if not back else np.minimum(last[sets], size)), percent)
        units, double = (np.array([planned[b][x] for b in of.tolist()], np.int64) for x in (0, 1))
        use = (differ > 0) & (units > 0)
        own, size, of, differ, units, double = (x[use] for x in (own, size, of, differ, units, double))
        if not len(own):
            continue
        salt = finish(of.astype(np.uint64) + np.uint64(1))
        token = finish(h[ragged(first[own], size)] ^ np.repeat(salt, size))
        slot = ((token >> np.uint64(32)) * np.repeat(units, size).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        twice = np.repeat(double, size)
        segment = np.where(slot < 2 * twice, slot >> 1, slot - twice)
        segments = units - double
        base = np.cumsum(segments) - segments
        flat = np.repeat(base, size) + segment
        sums, count = np.zeros(int(segments.sum()), np.uint64), np.bincount(flat, minlength=int(segments.sum()))
        np.add.at(sums, flat, token)
        holder = np.repeat(np.arange(len(own)), segments)
        number = np.arange(len(sums)) - base[holder]
        place = finish(salt[holder] + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        key = finish(sums + place)
        single = number >= double[holder]
        # Of single segments the largest subsets stay, as many as this set's size needs.
        at = np.flatnonzero(single)
        at = at[np.lexsort((key[at], -count[at], holder[at]))]
        singles = segments - double
        rank = np.arange(len(at)) - np.repeat(np.cumsum(singles) - singles, singles)
        kept = np.concatenate((np.flatnonzero(~single), at[rank < np.repeat(differ + 1 - 2 * double, singles)]))
        near = np.flatnonzero(segment < twice)
        found += [key[kept], finish(sums[flat[near]] - token[near] + place[flat[near]])]
        owners += [own[holder[kept]], own[holder[flat[near]]]]
    if not found:
        return np.zeros(0, np.int64), np.zeros(len(n), np.int64)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(found)[order].view(np.int64), np.bincount(owner, minlength=len(n))


def keyed(docs: DataFrame, k: int, percent: int, rows: int) -> DataFrame:
    """(v, keys) of rows (v, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = large(batch.column("text"))
            for a, b in chunks(texts, STEP_BYTES):
                found, counts = keys(*shingles(texts.slice(a, b - a), k), percent, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(found))
                yield pa.RecordBatch.from_arrays([batch.column("v").slice(a, b - a), lists], names=["v", "keys"])

    return docs.mapInArrow(run, "v long, keys array<long>")


def linked(classes: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """(v, root) of classes that have a link, from classes (v, n, id, t) and rows (id, t, text)."""
    number = classes.count()
    named = classes.select("id", "t", "v")
    texts = rows.join(F.broadcast(named) if number <= NAMED else named, ["id", "t"]).select("v", "text")
    spread = cut(keyed(texts, k, percent, number), "keys").select("v", F.explode("keys").alias("bucket"))
    # Of up to three members all are known from their least, greatest and exclusive or.
    shared = spread.groupBy("bucket").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.bit_xor("v").alias("mixed"), F.count(F.lit(1)).alias("c")).where("low <> high")
    # Buckets with the same members are one.
    shared = cut(shared.groupBy("low", "high", "mixed", "c").agg(F.min("bucket").alias("bucket")), "buckets")
    third = F.col("low").bitwiseXOR(F.col("high")).bitwiseXOR(F.col("mixed"))
    two = F.array(F.struct(F.col("high").alias("a"), F.col("low").alias("b")))
    three = F.array(*[F.struct(x.alias("a"), y.alias("b")) for x, y in ((F.col("high"), F.col("low")), (F.col("high"), third), (third, F.col("low")))])
    few = shared.where("c <= 3").select(F.inline(F.when(F.col("c") == 2, two).otherwise(three)))
    many = shared.where("c > 3").select("bucket", "low")
    members = cut(spread.join(F.broadcast(many) if many.count() <= NAMED else many, "bucket"), "members")
    sizes = classes.select("v", "n")
    edges = few.unionByName(members.select(F.col("v").alias("a"), F.col("low").alias("b"))).where("a > b").distinct()
    edges = edges.join(sizes.select(F.col("v").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("v").alias("b"), F.col("n").alias("nb")), "b")
    edges = cut(edges.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")), "edges")
    partners = members.select("v").unionByName(edges.select(F.col("a").alias("v"))).unionByName(edges.select(F.col("b").alias("v"))).distinct()
    return settled(members.join(sizes, "v").select("bucket", "v", "n"), edges, partners, classes, rows, k, percent)


def join_sets(docs: DataFrame, text: str = "text", row_id: str = "doc_id", k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per input row.

    Two documents link when their sets of k-word shingles (A-Z lower-cased) have
    100 * intersection >= percent * union; no link is missed (equality of shingles and
    subsets is that of 64-bit hashes). component_id is the smallest id that links reach, the own
    one included. Texts of fewer words are one shingle; null, empty and blank texts
    have none and link with nothing. Texts of any length are whole. Equal sets are one class and
    take part once, however many they are. Rows repeated under one id share a component;
    different texts of one id are linked each on its own. A null id comes after every
    other. No rows give no rows. Other columns are ignored, whatever their names.
    """
    return marked(docs, text, row_id, k, percent, linked).select(shown("id").alias("doc_id"), F.col("n").alias("n_shingles"), shown("component").alias("component_id"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3])) END) AS s FROM w),
k AS MATERIALIZED (SELECT doc_id, list_sort(s) AS s, len(s)::BIGINT AS n FROM l),
r AS MATERIALIZED (SELECT min(doc_id) AS v, s, len(s)::BIGINT AS n FROM k WHERE n > 0 GROUP BY s),
u AS MATERIALIZED (SELECT v, n, unnest(s) AS g FROM r),
e AS MATERIALIZED (SELECT a.v AS a, b.v AS b FROM u a JOIN u b ON a.g = b.g AND a.v < b.v AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.v, b.v, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
t AS (SELECT v AS a, v AS b FROM r UNION SELECT t.a, x.b FROM t JOIN (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) x ON x.a = t.b),
m AS (SELECT a AS v, min(b) AS component_id FROM t GROUP BY a)
SELECT k.doc_id, k.n AS n_shingles, coalesce(m.component_id, k.doc_id) AS component_id
FROM k LEFT JOIN r ON k.s = r.s LEFT JOIN m ON m.v = r.v
"""
