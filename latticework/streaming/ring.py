"""Streaming counterparts: a ring buffer per key, and windowed sums with a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def ring_buffer(stream: DataFrame, key: str, value: str, capacity: int = 8) -> DataFrame:
    """(key, items): after each batch, the last `capacity` values of every key that got one."""
    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for f in frames:
            held = (held + f[value].tolist())[-capacity:]
        state.update((held,))
        yield pd.DataFrame({"key": [k[0]], "items": [held]})

    return stream.select(F.col(key).cast("long").alias(key), F.col(value).cast("double").alias(value)).groupBy(key).applyInPandasWithState(update, "key long, items array<double>", "items array<double>", "update", GroupStateTimeout.NoTimeout)


def windowed_sums(stream: DataFrame, time: str, key: str, value: str, width: str, late: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))


def last_items(df: DataFrame, key: str, order: str, value: str, capacity: int = 8) -> DataFrame:
    """The same on a finished frame: the last `capacity` values in order."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    last = df.withColumn("__p", place).where(F.col("__p") <= capacity)
    return last.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias("items"))
