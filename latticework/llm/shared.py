"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: At most this many groups are broadcast by `lookup`.
FAT_GROUPS = 100_000
#: Text bytes that one numpy step holds at most (a longer single text is one step).
CHUNK_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a
    local session gets a temporary one (tests); on a cluster that is an error, since executors
    would write to disks of their own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="latticework-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame, tag: str = "cut") -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back.

    This cuts its lineage: what follows survives lost executors, is not
    computed again, and is planned with true sizes and without the constraints
    that pile up in loops. The tables stay until `clear`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/latticework-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that `cut` wrote, once all that is made from them has been written itself."""
    for table in tables:
        spark = table.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.cut_path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Remove the tables that `cut` and the token files left in the shared folder.
    Call it when no result that was made from them is needed any more."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for entry in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "latticework-*")) or []:
        fs.delete(entry.getPath(), True)


def numbered(df: DataFrame, *order: Column, out: str = "__at") -> DataFrame:
    """Add each row's 0-based place in a global order, written once, and `__part`, the range it is in.

    Rows are range-partitioned and sorted, each range is counted, and only the table of counts
    (a row per range) is summed in one task. `order` should end in something that tells all rows
    apart, so that no range holds many ties. Ranges are as many as spark.sql.shuffle.partitions."""
    # The id that Spark gives to the k-th row of range p is p * 2**33 + k.
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__in", F.monotonically_increasing_id())
    rows = cut(sorted_.withColumn("__part", F.shiftright("__in", 33).cast("int")).withColumn("__in", F.col("__in").bitwiseAND((1 << 33) - 1)), "numbered")
    return rows.join(F.broadcast(offsets(rows, F.count(F.lit(1)))), "__part").withColumn(out, F.col("__before") + F.col("__in")).drop("__before", "__in")


def offsets(rows: DataFrame, own: Column) -> DataFrame:
    """(__part, __before): the sum of `own` over earlier ranges; a row per range, so small enough for one task and to broadcast."""
    sums = rows.groupBy("__part").agg(own.alias("__own"))
    return sums.select("__part", F.coalesce(F.sum("__own").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))


def lookup(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, salt: Column) -> DataFrame:
    """rows LEFT JOIN groups on `key`, where any key may hold most of the rows.

    `groups` has one row per key and the number of its rows in `size`. Groups
    of more than total / FAT_GROUPS rows are at most FAT_GROUPS in number, so
    they are broadcast; rows they serve leave the shuffled join under a salted
    key that matches nothing, so no partition of it holds a large group. Null
    keys match nothing.
    """
    limit = max(64, -(-total // FAT_GROUPS))
    values = [c for c in groups.columns if c != key]
    fat = groups.where(F.col(size) > limit).select(F.col(key), *[F.col(c).alias(f"__fat_{c}") for c in values])
    thin = groups.where(F.col(size) <= limit).select(F.col(key).cast("string").alias("__joined_on"), *[F.col(c).alias(f"__thin_{c}") for c in values])
    hit = F.col(f"__fat_{size}").isNotNull()
    spread = F.concat(F.lit("\u0000salt\u0000"), salt.cast("string"))
    out = rows.join(F.broadcast(fat), key, "left").withColumn("__joined_on", F.when(hit | F.col(key).isNull(), spread).otherwise(F.col(key).cast("string")))
    out = out.join(thin, "__joined_on", "left")
    merged = [F.coalesce(F.col(f"__fat_{c}"), F.col(f"__thin_{c}")).alias(c) for c in values]
    return out.select(*rows.columns, *merged)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES):
    """(start, stop) slices of a string array of at most `limit` bytes, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, stop
        start = stop
    release()


def release() -> None:
    """Give memory that a finished batch has freed back to the system: a worker is
    reused by later stages, and its pools would keep their peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def large(texts: pa.Array) -> pa.Array:
    """Null as empty, with 64-bit offsets so that a long batch cannot overflow.

    Apply it to a whole batch and slice afterwards: Arrow's ascii_lower misreads
    a slice that was cast.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.type == pa.large_string() and not texts.null_count:
        return texts
    if texts.offset:
        texts = texts.take(pa.array(np.arange(len(texts))))
    return pc.fill_null(texts.cast(pa.large_string()), "")


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs starts[i] .. starts[i]+lengths[i], concatenated."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased: (distinct words, code of
    each word in order, words per text)."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, lists = split.flatten(), split.offsets.to_numpy()
    full = np.asarray(pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False), dtype=bool)
    seen = np.concatenate(([0], np.cumsum(full)))
    counts = seen[lists[1:] - lists[0]] - seen[lists[:-1] - lists[0]]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), counts.astype(np.int64)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
