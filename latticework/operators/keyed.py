"""Hash-keyed operators: distinct keys with dense ids, lookup, membership, ordered-map writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import numbered

def dense_ids(df: DataFrame, keys: list[str], out: str = "id") -> DataFrame:
    """Distinct keys with ids 0 .. n-1 in the order of the keys, nulls first."""
    return numbered(df.select(*keys).distinct(), *[F.col(k) for k in keys], out=out).drop("__part")


def renumber(table: DataFrame, mapping: DataFrame, out: str = "id") -> DataFrame:
    """Ids moved along `mapping` (id, target), which is one-to-one."""
    return table.join(mapping.select(F.col("id").alias(out), F.col("target").alias("__to")), out).withColumn(out, F.col("__to")).drop("__to")


def lookup(probes: DataFrame, table: DataFrame, keys: list[str], out: str = "id") -> DataFrame:
    """Left lookup; -1 where the key is unknown."""
    return probes.join(table, keys, "left").withColumn(out, F.coalesce(F.col(out), F.lit(-1)))


def present(probes: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    return probes.join(table, keys, "left_semi")


def absent(probes: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    return probes.join(table, keys, "left_anti")


def last_write(df: DataFrame, key: str, sequence: str, value: str) -> DataFrame:
    """The value written last under each key."""
    return df.groupBy(key).agg(F.max_by(value, sequence).alias(value))


def merge_writes(table: DataFrame, writes: DataFrame, key: str, value: str) -> DataFrame:
    """Insert or replace."""
    return table.join(writes, key, "left_anti").select(key, value).unionByName(writes.select(key, value))


def erase_at(table: DataFrame, key: str, places: DataFrame) -> DataFrame:
    """Without the entries at the given positions (`place`) of the key order."""
    return numbered(table, F.col(key)).join(places.select("place"), "place", "left_anti").drop("__part", "place")


def visit(table: DataFrame, key: str, f) -> DataFrame:
    """Entries in key order with their place, a function of columns applied to each."""
    placed = numbered(table, F.col(key)).drop("__part")
    return placed.withColumns(f(placed))


def remove_if(table: DataFrame, predicate: Column) -> DataFrame:
    """Without the entries for which the predicate is true (null counts as false)."""
    return table.where(~F.coalesce(predicate, F.lit(False)))


def histogram(df: DataFrame, bin_: Column, out: str = "n") -> DataFrame:
    """Rows per bin, combined before they are shuffled."""
    return df.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias(out))


def scatter_aggregate(df: DataFrame, cell: str, **sums: Column) -> DataFrame:
    """Atomic updates of cells as one grouped aggregation; each keyword is an aggregate expression."""
    return df.groupBy(cell).agg(*[c.alias(n) for n, c in sums.items()])
