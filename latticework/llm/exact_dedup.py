"""Exact dedup: 128-bit content hash, byte comparison inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, lookup

BLANKS = r"[\x20\x09-\x0D]+"


def without_blanks(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS, "")


def exact_dedup(
    docs: DataFrame,
    text: str = "text",
    row_id: str = "doc_id",
    normalise: Callable[[Column], Column] = without_blanks,
    prefer_longest: bool = True,
    content_hash: Callable[[Column], Column] = F.md5,
    with_points: bool = False,
) -> DataFrame:
    """One row per input row: (row_id, keep_id, group_size, kept, text_sha256).

    Rows whose normalised texts are byte-equal form a group. The row with the
    most code points in its original text stays (`prefer_longest`), then the
    one with the smallest id; with `prefer_longest=False` the smallest id.
    The grouping key is the 128-bit content hash together with the bytes of
    the normalised text, so colliding hashes never merge different texts;
    copies collapse to one row per task before anything is shuffled.

    Null text counts as empty; empty texts are equal to each other. Of rows with
    the id that stays, those with fewer code points go. Rows alike in id and
    length (repeated rows) all count in group_size and all bear the mark
    `kept`; `keep_first` leaves one of them. A null id sorts after every id.
    Texts of any length are grouped whole. An empty table gives no rows. Other
    columns of `docs` are ignored, whatever their names.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(row_id).cast("long").alias("__id"), raw.alias("__raw"))
    rows = rows.select("__id", normalise(F.col("__raw")).alias("__norm"), (F.char_length("__raw") if prefer_longest else F.lit(0)).alias("__points"))
    rows = rows.withColumn("__hash", content_hash(F.col("__norm")))
    # One number that is greatest for the preferred row: points first, then a small id.
    # It stays a decimal, so the aggregation works on fixed-width buffers.
    worst = F.lit("9223372036854775808").cast("decimal(20,0)")
    rank = F.col("__points").cast("decimal(11,0)") * F.lit("20000000000000000000").cast("decimal(20,0)") - F.coalesce(F.col("__id").cast("decimal(20,0)"), worst)
    groups = rows.groupBy("__hash", "__norm").agg(F.max(rank.cast("decimal(38,0)")).alias("__rank"), F.count(F.lit(1)).alias("group_size"), F.min("__id").alias("__least"), F.max("__points").alias("__most"))
    best = F.col("__most").cast("decimal(11,0)") * F.lit("20000000000000000000").cast("decimal(20,0)") - F.col("__rank")
    groups = cut(groups.select(F.sha2(F.col("__norm"), 256).alias("text_sha256"), F.when(best < worst, best).cast("long").alias("keep_id"), "group_size", "__most"))
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    marked = rows.select("__id", "__points", F.sha2(F.col("__norm"), 256).alias("text_sha256"))
    out = lookup(marked, groups, "text_sha256", "group_size", total, F.xxhash64("__id"))
    marks = out.select(F.col("__id").alias(row_id), "keep_id", "group_size", (F.col("__id").eqNullSafe(F.col("keep_id")) & (F.col("__points") == F.col("__most"))).alias("kept"), "text_sha256", "__points")
    return marks if with_points else marks.drop("__points")


def keep_first(docs: DataFrame, text: str = "text", row_id: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs` that `exact_dedup` keeps, whole and with their columns
    (any names). A row stays by its id, its normalised text and its length, so
    different texts under one id are judged apart; of rows alike in all three,
    the one of least text stays. A null text counts as empty, a null id comes after
    every other, a text of any length is compared whole; no rows give no rows.
    """
    normalise, longest = options.get("normalise", without_blanks), options.get("prefer_longest", True)
    raw = F.coalesce(F.col(text), F.lit(""))
    kept = exact_dedup(docs, text, row_id, with_points=True, **options).where("kept").select(F.col(row_id).alias("__kept"), F.col("text_sha256").alias("__kept_text"), F.col("__points").alias("__kept_points"))
    marks = cut(kept.groupBy(*kept.columns).agg(F.count(F.lit(1)).alias("__times")))
    repeated = not marks.where(F.col("__times") > 1).isEmpty()
    points = F.char_length(raw) if longest else F.lit(0)
    whole = docs.select(F.col(row_id).cast("long").alias("__id"), F.sha2(normalise(raw), 256).alias("__text"), points.alias("__points"), raw.alias("__raw"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    # Marks are one short row a key, so a partition's hash table is a small part of its texts' size, and texts need no sort.
    out = whole.join(marks.drop("__times").hint("shuffle_hash"), F.col("__id").eqNullSafe(F.col("__kept")) & (F.col("__text") == F.col("__kept_text")) & (F.col("__points") == F.col("__kept_points")), "left_semi")
    if repeated:
        out = out.groupBy("__id", "__text").agg(F.min_by("__row", "__raw").alias("__row"))
    return out.select("__row.*")
