"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source's documents stand in a shuffled order. A document's virtual finish
time is the running count of its source's words divided by the source's
target. All copies are then range-sorted by finish time across sources, and the
order is cut at the total budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, lookup, numbered, offsets

#: Rows of one source that one task orders, about.
BLOCK_ROWS = 4096


def word_count(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`; 0 for null."""
    blank = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(F.length(blank) == 0, F.lit(0)).otherwise(F.length(blank) - F.length(F.replace(blank, F.lit(" "), F.lit(""))) + 1).cast("long")


def targets(sources: DataFrame, max_repeat: int) -> DataFrame:
    """Add `target` to (source, source_size, ..): shares of the total by weight 1, 2, 3,
    repeating in the order of the sources' code points (null last), none above
    max_repeat times its size, the excess shared again by weight.

    That is min(max_repeat * size, level * weight) at the one level where the
    targets sum to the total. The level rises from round to round: what the
    sources below their bound share is the total less the bounds of the others.
    A round is one sum over the sources, of which any task sees a part.
    """
    ranked = numbered(sources, F.col("source").isNull(), F.col("source"))
    ranked = cut(ranked.withColumn("weight", (F.col("__at") % 3 + 1).cast("double")).withColumn("bound", F.col("source_size") * F.lit(float(max_repeat))).drop("__at", "__part"))
    total = float(ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, capped = 0.0, -1
    while True:
        over = F.col("bound") < F.col("weight") * F.lit(level) if level else F.lit(False)
        bounds, weights, now = ranked.agg(F.coalesce(F.sum(F.when(over, F.col("bound"))), F.lit(0.0)), F.coalesce(F.sum(F.when(over, F.lit(0.0)).otherwise(F.col("weight"))), F.lit(0.0)), F.count(F.when(over, 1))).first()
        if now == capped or not weights:
            break
        level, capped = (total - bounds) / weights, now
    return ranked.withColumn("target", F.least(F.col("bound"), F.col("weight") * F.lit(level))).drop("bound")


def shuffle_key(row_id: Column, text: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(row_id.cast("string"), F.lit("null")), F.coalesce(text, F.lit(""))))


def copies_of(docs: DataFrame, text: str = "text", row_id: str = "doc_id", source: str = "source", max_repeat: int = 3, seed: int = 17) -> DataFrame:
    """(row, doc_id, size, source_size, target, shuffle_key, pass, finish, position, taken), a row per copy
    that a source's target reaches: its place in the global order of finish times, and whether the budget
    does. Same rules as `mix`."""
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source")).alias("__key")
    raw = docs.select(F.col(row_id).cast("long").alias("doc_id"), word_count(F.col(text)).alias("size"), F.col(source).cast("string").alias("source"), shuffle_key(F.col(row_id), F.col(text), seed).alias("shuffle_key"))
    raw = cut(raw.select("doc_id", "size", "source", "shuffle_key", key, F.monotonically_increasing_id().alias("__row")))
    sources = raw.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    sources = cut(targets(sources, max_repeat).select(key, "source_size", "source_rows", "target"))
    budget, rows_in = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("source_rows"), F.lit(0))).first()
    rows = lookup(raw.drop("source"), sources, "__key", "source_rows", rows_in, F.col("__row"))
    # Running words of a source: blocks of its shuffled order, then rows inside a block.
    blocks = F.ceil(F.col("source_rows") / F.lit(BLOCK_ROWS))
    part = F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    rows = cut(rows.withColumn("__block", F.floor(part * blocks).cast("long")))
    # Blocks of all sources stand in one order, in which a source's blocks are side by side.
    sums = rows.groupBy("__key", "__block").agg(F.sum("size").alias("__own"))
    sums = numbered(sums, F.col("__key"), F.col("__block"))
    inside = F.coalesce(F.sum("__own").over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = cut(sums.withColumn("__inside", inside).join(F.broadcast(offsets(sums, F.sum("__own"))), "__part").select("__key", "__block", (F.col("__before") + F.col("__inside")).alias("__all_before")))
    begins = sums.groupBy("__key").agg(F.min("__all_before").alias("__begin"))
    sums = sums.join(begins, "__key").select("__key", "__block", (F.col("__all_before") - F.col("__begin")).alias("__before"))
    inside = F.sum("size").over(Window.partitionBy("__key", "__block").orderBy("shuffle_key", "__row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    queued = rows.withColumn("__inside", inside).join(sums, ["__key", "__block"]).withColumn("__upto", F.col("__before") + F.col("__inside"))
    # A copy per pass through the source that its target reaches.
    passes = F.when(F.col("source_size") > 0, F.ceil(F.col("target") / F.col("source_size"))).otherwise(F.lit(1))
    passes = F.greatest(F.lit(1), F.least(F.lit(max_repeat), passes)).cast("int")
    copies = queued.withColumn("pass", F.explode(F.sequence(F.lit(0), passes - 1)))
    finish = F.when(F.col("target") > 0, (F.col("__upto") + F.col("pass") * F.col("source_size")) / F.col("target")).otherwise(F.lit(0.0))
    copies = copies.select(F.col("__row").alias("row"), "doc_id", "size", "source_size", "target", "shuffle_key", "pass", finish.alias("finish"))
    # The global range sort, and the cut where the running words exceed the budget.
    sorted_ = numbered(copies, F.col("finish"), F.col("shuffle_key"), F.col("pass"), F.col("row"), out="position")
    inside = F.sum("size").over(Window.partitionBy("__part").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sorted_ = sorted_.withColumn("__inside", inside).join(F.broadcast(offsets(sorted_, F.sum("size"))), "__part")
    return cut(sorted_.withColumn("taken", F.col("__before") + F.col("__inside") <= budget).drop("__before", "__inside", "__part"))


def mix(docs: DataFrame, text: str = "text", row_id: str = "doc_id", source: str = "source", max_repeat: int = 3, seed: int = 17) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken, first_position, shuffle_key), one row per input row.

    The budget is the size of all rows. A source whose target exceeds its size
    starts again, up to max_repeat times through. Null text has size 0, and
    rows of size 0 take nothing from the budget. A null source is a source, the
    last. first_position is the place of the document's first copy in the mixed
    order, null if none is taken. The shuffle is by a hash of id and text, so
    reruns and other partitionings agree; rows alike in both are
    interchangeable. Texts are counted whole, whatever their length. An empty
    table gives no rows. Extra columns are ignored.
    """
    copies = copies_of(docs, text, row_id, source, max_repeat, seed)
    taken = F.col("taken").cast("long")
    out = copies.groupBy("row").agg(*[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target", "shuffle_key")], F.sum(taken).alias("copies"), F.min(F.when(F.col("taken"), F.col("position"))).alias("first_position"))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "first_position", "shuffle_key")


def mixed_rows(docs: DataFrame, text: str = "text", row_id: str = "doc_id", source: str = "source", keep_order: bool = True, **options) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it, with their columns (any names), in the mixed
    order (`keep_order`: a global range sort by position). Nulls, repeated rows and empty tables as in `mix`."""
    key = shuffle_key(F.col(row_id), F.col(text), options.get("seed", 17)).alias("__shuffle")
    whole = docs.select(key, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    places = copies_of(docs, text, row_id, source, **options).where("taken")
    marks = cut(places.groupBy(F.col("shuffle_key").alias("__shuffle")).agg(F.collect_list("position").alias("__places"), F.count_distinct("row").alias("__alike")))
    if not marks.where("__alike > 1").isEmpty():
        whole = whole.dropDuplicates(["__shuffle"])
    # Marks are one short row a key, so a partition's hash table is a small part of its texts' size.
    out = whole.join(marks.hint("shuffle_hash"), "__shuffle").withColumn("__place", F.explode("__places"))
    return (out.orderBy("__place") if keep_order else out).select("__row.*")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS bound, sum(source_size) OVER ()::DOUBLE AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(bound) OVER (ORDER BY bound / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY bound / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(bound, (SELECT arg_min(level, bound / weight) FROM l WHERE level <= bound / weight) * weight) AS target FROM l),
q AS (SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY k) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT q.*, p, CASE WHEN target > 0 THEN (upto::DOUBLE + p * source_size) / target ELSE 0 END AS finish
      FROM q, range(3) r(p) WHERE p < greatest(1, CASE WHEN source_size > 0 THEN least(3, ceil(target / source_size)) ELSE 1 END)),
o AS (SELECT *, row_number() OVER (ORDER BY finish, k, p) - 1 AS position, sum(size) OVER (ORDER BY finish, k, p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= (SELECT sum(size) FROM d) AS taken_in FROM c)
SELECT doc_id, size, source_size, target, sum(CASE WHEN taken_in THEN 1 ELSE 0 END)::BIGINT AS copies, sum(CASE WHEN taken_in THEN size ELSE 0 END)::BIGINT AS taken,
       min(CASE WHEN taken_in THEN position END)::BIGINT AS first_position
FROM o GROUP BY doc_id, k, size, source_size, target
"""
