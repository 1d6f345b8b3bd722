"""Sorts as ranks, sorts by a range of bits, and searches in sorted data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Rows that one task sorts, about, where their number is known.
TASK_ROWS = 200_000


def ranged(df: DataFrame, *order: Column | str, rows: int | None = None) -> DataFrame:
    """Sorted by `order` over ranges: of TASK_ROWS each, about, if `df` has `rows` rows, but no fewer than there are cores;
    without `rows` as many as there are shuffle partitions, whose rows grow with the table."""
    parts = [] if rows is None else [max(-(-rows // TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism)]
    return df.repartitionByRange(*parts, *order).sortWithinPartitions(*order)


def numbered(df: DataFrame, *order: Column, out: str = "place", rows: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add the 0-based place in a global order, and `__part`, the range it is in.

    Rows are range-partitioned and sorted once and written with their place in the range; ranges are
    those of `ranged`, and the table of their sizes is all that one task sees. With `keep`, only these columns are written.
    `order` should end in something that tells rows apart, so that ties of any number are split."""
    # The id that Spark gives to the k-th row of range p is p * 2**33 + k.
    placed = ranged(df, *order, rows=rows).withColumn("__in", F.monotonically_increasing_id()).select(*(keep or df.columns), "__in")
    rows = cut(placed.withColumn("__part", F.shiftright("__in", 33).cast("int")).withColumn("__in", F.col("__in").bitwiseAND((1 << 33) - 1)))
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(sizes.select("__part", before.alias("__before"))), "__part").withColumn(out, F.col("__before") + F.col("__in")).drop("__before", "__in")


def rank(df: DataFrame, key: Column, tie: Column, out: str = "place") -> DataFrame:
    """Add the 0-based place in the stable order by key, then tie, of any types. Nulls come first."""
    return numbered(df, key, tie, out=out).drop("__part")


def bits_key(key: Column, start: int, end: int, width: int = 64) -> Column:
    """Bits start .. end - 1 of an integer, its sign bit flipped so that order is kept."""
    flipped = key.cast("long").bitwiseXOR(F.lit(-(1 << 63))) if width == 64 else key.cast("long") + F.lit(1 << (width - 1))
    return F.shiftrightunsigned(flipped, start).bitwiseAND(F.lit((1 << (end - start)) - 1 if end - start < 64 else -1))


def search(data: DataFrame, probes: DataFrame, value: str, probe: str) -> DataFrame:
    """As-of search: for each row of `probes` (idx, probe) the place of the last element <= probe, or -1.

    `data` has (place, value). Elements and probes stand in one global order; the last element before a
    probe is in its own range or the last of an earlier one. Elements without value are before nothing;
    a null probe finds nothing."""
    elements = data.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), F.lit(0).alias("kind"), F.col("place").cast("long").alias("p"), F.lit(None).cast("long").alias("id"))
    asked = probes.select(F.col(probe).alias("v"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("p"), F.col("idx").cast("long").alias("id"))
    both = numbered(elements.unionByName(asked), F.col("v"), F.col("kind"), F.coalesce("p", "id"), out="at")
    tops = both.groupBy("__part").agg(F.max("p").alias("top"))
    tops = tops.select("__part", F.max("top").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    inside = F.max("p").over(Window.partitionBy("__part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("inside", inside).where("kind = 1").join(F.broadcast(tops), "__part")
    return found.select(F.col("id").alias("idx"), F.col("v").alias(probe), F.coalesce(F.greatest("inside", "earlier"), F.lit(-1)).cast("long").alias("place"))


def bound(table: DataFrame, probes: DataFrame, key: str, probe: str, upper: bool = False) -> DataFrame:
    """Ordered-map bounds: for each row of `probes` (idx, probe) the first key >= probe (lower), or > probe
    (upper), of `table`; null where there is none, and for a null probe."""
    keys = table.where(F.col(key).isNotNull()).select(F.col(key).alias("v"), F.lit(0 if upper else 1).alias("kind"), F.col(key).alias("k"), F.lit(None).cast("long").alias("id")).distinct()
    asked = probes.select(F.col(probe).alias("v"), F.lit(1 if upper else 0).alias("kind"), F.lit(None).cast(table.schema[key].dataType).alias("k"), F.col("idx").cast("long").alias("id"))
    both = numbered(keys.unionByName(asked), F.col("v"), F.col("kind"), F.col("id"), out="at")
    firsts = both.groupBy("__part").agg(F.min("k").alias("first"))
    # A row per range. Both windows run from the end, so that each row is added once.
    firsts = firsts.select("__part", F.min("first").over(Window.orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)).alias("later"))
    inside = F.min("k").over(Window.partitionBy("__part").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("inside", inside).where(F.col("kind") == (1 if upper else 0)).join(F.broadcast(firsts), "__part")
    return found.select(F.col("id").alias("idx"), F.col("v").alias(probe), F.when(F.col("v").isNotNull(), F.coalesce("inside", "later")).alias("bound"))
