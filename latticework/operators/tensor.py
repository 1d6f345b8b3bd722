"""Contraction of index-labelled tensors over any semiring, in an order chosen from sizes.

A tensor is a frame with a column per index and `val`. An index that neither the
result nor another tensor has is summed out first; then the two tensors whose product
is estimated least are joined on the indices they share and summed over those that
nothing else needs, and so on. Each product is written, so its true size decides the next
choice, and every join stands on two plain sides, which adaptive execution splits where an index value is hot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .sparse import PLUS_TIMES, Semiring


@dataclass(frozen=True)
class Tensor:
    """Entries of a sparse tensor; entries that are not there do not count, repeated ones are added."""

    frame: DataFrame
    indices: tuple[str, ...]

    def named(self, *indices: str) -> Tensor:
        """The same entries under other labels, in order: a view, as for a transposition or a second use."""
        if len(indices) != len(self.indices) or len(set(indices)) != len(indices):
            raise ValueError("a label for each index, all different")
        return Tensor(self.frame.select(*[F.col(a).alias(b) for a, b in zip(self.indices, indices, strict=True)], "val"), indices)


def summed(t: Tensor, keep: set[str], ring: Semiring) -> Tensor:
    """Add up over all indices but those to keep; partly before rows are shuffled."""
    own = tuple(i for i in t.indices if i in keep)
    return Tensor(t.frame.groupBy(*own).agg(ring.add(F.col("val")).alias("val")), own)


def estimate(a: tuple[Tensor, int, dict[str, int]], b: tuple[Tensor, int, dict[str, int]]) -> float:
    """Entries of the product before it is summed: of shared indices, values are taken to be spread evenly."""
    shared = [i for i in a[0].indices if i in b[0].indices]
    if not shared:
        return float("inf")
    out = a[1] * b[1]
    for i in shared:
        out /= max(1, a[2][i], b[2][i])
    return out


def measured(t: Tensor) -> tuple[Tensor, int, dict[str, int]]:
    """A written tensor with its number of entries and, about, of values of each index: all that the driver sees of it."""
    t = Tensor(cut(t.frame), t.indices)
    r = t.frame.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(i).alias(f"of_{i}") for i in t.indices]).first()
    return t, r["n"], {i: r[f"of_{i}"] for i in t.indices}


def contract(tensors: list[Tensor], out: tuple[str, ...], ring: Semiring = PLUS_TIMES) -> Tensor:
    """The sum over all indices not in `out` of the product of the tensors' entries.

    Rows with a null index meet nothing. Tensors that share no index, by way of others either, would make an outer product of
    whole tables: that is refused. Without tensors, or with an `out` that none has, an error says so."""
    known = {i for t in tensors for i in t.indices}
    if not tensors or not set(out) <= known:
        raise ValueError(f"no tensor has all of {out}")
    left = []
    for k, t in enumerate(tensors):
        others = {i for j, o in enumerate(tensors) if j != k for i in o.indices}
        left.append(measured(summed(t, set(out) | others, ring)))
    while len(left) > 1:
        cost, i, j = min((estimate(left[i], left[j]), i, j) for i in range(len(left)) for j in range(i + 1, len(left)))
        if cost == float("inf"):
            raise ValueError("tensors without a shared index make an outer product")
        (a, _, _), (b, _, _) = left[i], left[j]
        left = [t for k, t in enumerate(left) if k not in (i, j)]
        shared = [x for x in a.indices if x in b.indices]
        product = a.frame.withColumnRenamed("val", "__a").join(b.frame.withColumnRenamed("val", "__b"), shared)
        indices = (*a.indices, *[x for x in b.indices if x not in shared])
        both = Tensor(product.select(*indices, ring.multiply(F.col("__a"), F.col("__b")).alias("val")), indices)
        left.append(measured(summed(both, set(out) | {x for t, _, _ in left for x in t.indices}, ring)))
    return Tensor(left[0][0].frame.select(*out, "val"), tuple(out))
