"""User code over frames: expression scripts, dispatch on a tag, state machines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run(df: DataFrame, script: str, parameters: dict[str, float] | None = None) -> DataFrame:
    """Run `name = expression; ..` over the channels of each row, one after the other, as SQL expressions that the
    engine compiles; parameters are constants by name. A channel that is new is added."""
    for name, value in (parameters or {}).items():
        df = df.withColumn(name, F.lit(value))
    for line in filter(None, (part.strip() for part in script.replace("\n", ";").split(";"))):
        target, _, text = line.partition("=")
        if not target.strip().isidentifier() or not text.strip():
            raise ValueError(f"not an assignment: {line}")
        df = df.withColumn(target.strip(), F.expr(text.strip()))
    return df.drop(*(parameters or {}))


def match(tag: Column, cases: dict[str, Column], otherwise: Column) -> Column:
    """The case of a variant's tag."""
    out = None
    for name, value in cases.items():
        out = F.when(tag == name, value) if out is None else out.when(tag == name, value)
    return otherwise if out is None else out.otherwise(otherwise)


def machine(df: DataFrame, key: str, order: str, signal: str, start: str, step: Callable[[Column, Column], Column], shown: Callable[[Column, Column], Column]) -> DataFrame:
    """(key, state, shown): per key a finite-state machine fed with its signals in order; `shown` of the state before
    and the signal is kept for each. A key's signals meet in one row, so they must fit in one."""
    signals = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(signal).alias("x")))), lambda r: r["x"])
    begin = F.struct(F.lit(start).alias("state"), F.array().cast("array<string>").alias("shown"))
    fold = lambda acc, x: F.struct(step(acc["state"], x).alias("state"), F.concat(acc["shown"], F.array(shown(acc["state"], x))).alias("shown"))
    ended = df.groupBy(key).agg(signals.alias("__x")).withColumn("__end", F.aggregate("__x", begin, fold))
    return ended.select(key, F.col("__end.state").alias("state"), F.col("__end.shown").alias("shown"))
