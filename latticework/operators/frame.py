"""Positional operators on indexed frames: every frame carries its position in a column `idx`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .order import numbered


def index_range(spark: SparkSession, begin: int, end: int, step: int = 1) -> DataFrame:
    """begin, begin + step, ..; the end is first trimmed to a whole number of steps."""
    return spark.range(begin, end - (end - begin) % step, step).withColumnRenamed("id", "idx")


def nd_range(spark: SparkSession, *extents: int) -> DataFrame:
    """All index tuples i0, i1, .. of a box, the last one fastest, with their linear `idx`.
    Derived from one range by division, so nothing is crossed."""
    total = 1
    for n in extents:
        total *= n
    df, stride = spark.range(total).withColumnRenamed("id", "idx"), total
    for k, n in enumerate(extents):
        stride //= n
        df = df.withColumn(f"i{k}", F.floor(F.col("idx") / stride).cast("long") % n)
    return df


def linear_index(coordinates: list[Column], extents: list[int]) -> Column:
    out = F.lit(0).cast("long")
    for c, n in zip(coordinates, extents, strict=True):
        out = out * n + c
    return out


def zip_frames(left: DataFrame, *others: DataFrame) -> DataFrame:
    """Side by side by position; as long as the shortest."""
    for other in others:
        left = left.join(other, "idx")
    return left


def chunk(df: DataFrame, size: int) -> DataFrame:
    """Add the number of the chunk of `size` consecutive rows."""
    return df.withColumn("chunk", F.floor(F.col("idx") / size).cast("long"))


def gather(data: DataFrame, mapping: DataFrame) -> DataFrame:
    """out[i] = data[map[i]]; `mapping` has (idx, source)."""
    return mapping.select("idx", F.col("source").alias("__s")).join(data.withColumnRenamed("idx", "__s"), "__s").drop("__s")


def scatter(data: DataFrame, mapping: DataFrame) -> DataFrame:
    """out[map[i]] = data[i]; `mapping` has (idx, target)."""
    return data.join(mapping, "idx").drop("idx").withColumnRenamed("target", "idx")


def append_channels(df: DataFrame, channels: dict[str, int]) -> DataFrame:
    """Add properties of so many channels, filled with 0. Adding one again changes
    nothing; adding it with another width is an error."""
    for name, width in channels.items():
        if name in df.columns:
            kind = df.schema[name].dataType.typeName()
            if (kind == "array") != (width > 1):
                raise ValueError(f"{name} exists with another number of channels")
            continue
        zero = F.lit(0.0)
        df = df.withColumn(name, zero if width == 1 else F.array_repeat(zero, width))
    return df


def pack(column: str, start: int, width: int) -> Column:
    """Channels start .. start + width - 1 of an array property."""
    return F.slice(F.col(column), start + 1, width)


def axpby(a: float, x: Column, b: float, y: Column) -> Column:
    return F.lit(a) * x + F.lit(b) * y


def set_value(df: DataFrame, column: str, position: int, value) -> DataFrame:
    return df.withColumn(column, F.when(F.col("idx") == position, F.lit(value)).otherwise(F.col(column)))


def append_rows(df: DataFrame, more: DataFrame, length: int) -> DataFrame:
    """Append `more` behind a frame of known length."""
    return df.unionByName(more.withColumn("idx", F.col("idx") + length))


def resize(df: DataFrame, length: int) -> DataFrame:
    """The first `length` positions of a frame; where it is shorter, rows of nulls follow."""
    have = df.count()
    kept = df.where(F.col("idx") < length)
    return kept if have >= length else kept.unionByName(df.sparkSession.range(have, length).select(F.col("id").alias("idx")), allowMissingColumns=True)


def tiles(df: DataFrame, lanes: int) -> DataFrame:
    """Add each row's tile of `lanes` rows and its lane in it; one tile is a filter on `tile`."""
    return df.withColumns({"tile": F.floor(F.col("idx") / lanes).cast("long"), "lane": F.col("idx") % lanes})


def reshape(df: DataFrame, extents: list[int]) -> DataFrame:
    stride = 1
    for n in extents:
        stride *= n
    for k, n in enumerate(extents):
        stride //= n
        df = df.withColumn(f"i{k}", F.floor(F.col("idx") / stride).cast("long") % n)
    return df


def transform(df: DataFrame, column: str, f: Callable[..., Column], *params) -> DataFrame:
    """Apply f to each element in place (for_each, and the parallel map), with further constant parameters."""
    return df.withColumn(column, f(F.col(column), *[F.lit(p) for p in params]))


def for_each(df: DataFrame, f: Callable[..., dict[str, Column]], *columns: str) -> DataFrame:
    """A function of several columns of a row that sets some."""
    return df.withColumns(f(*[F.col(c) for c in columns]))


def nested(spark: SparkSession, extents: list[int], order: list[int], body: Callable[..., dict[str, Column]]) -> DataFrame:
    """A loop nest, one level per extent, whose innermost body sees the indices in a permuted order."""
    df = nd_range(spark, *extents)
    return df.withColumns(body(*[F.col(f"i{k}") for k in order]))


def enumerate_rows(df: DataFrame, *order: Column, out: str = "number") -> DataFrame:
    """Number the rows from 0 in the given order."""
    return numbered(df, *order, out=out).drop("__part")


def fill(df: DataFrame, columns: list[str], value) -> DataFrame:
    """All elements of the given columns set to a value; array columns keep their length."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    return df.withColumns({c: F.transform(c, lambda _: F.lit(value)) if kinds[c] == "array" else F.lit(value) for c in columns})


def get_value(df: DataFrame, column: str, position: int):
    """One element; None beyond the end."""
    row = df.where(F.col("idx") == position).select(column).first()
    return row and row[0]


def channel_view(df: DataFrame, column: str, width: int) -> DataFrame:
    """(dof, v): an array property as one long column, channel after channel of each row."""
    return df.select("idx", F.posexplode(column).alias("k", "v")).select((F.col("idx") * width + F.col("k")).alias("dof"), "v")


def bins(df: DataFrame, lanes: int, columns: list[str]) -> DataFrame:
    """(bin, ..): rows stored in bins of `lanes`, each column an array in position order."""
    rows = F.array_sort(F.collect_list(F.struct("idx", *columns)))
    packed = df.groupBy(F.floor(F.col("idx") / lanes).cast("long").alias("bin")).agg(rows.alias("rows"))
    return packed.select("bin", *[F.col(f"rows.{c}").alias(c) for c in columns])


def from_rows(spark: SparkSession, values: list, kind: str = "double") -> DataFrame:
    """(idx, v) of a list on the driver."""
    return spark.createDataFrame(list(enumerate(values)), f"idx long, v {kind}")
