"""OBJ triangle and VTK tetrahedron meshes as frames, read and written as text.

A path is one file or a folder of parts, whose lines follow each other in the order of the files' names, shorter names first.
Files are read in the byte ranges that Spark splits them into. Elements are numbered by counts within a range, taken as its
lines stream through a task, and a running sum over the small table of ranges, so no task sees a whole file and lines are
neither shuffled nor sorted; the writers leave one part per range of a global sort.
Lines that are not understood are passed over; a number that cannot be read is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import order
from ..operators.lineage import cut

SPLIT = ["path", "start"]
#: Headers of wanted sections that are broadcast; a grid has two.
FEW_SECTIONS = 1000
#: Lines of cell types that are one row, about as long as a cell's.
TYPES = 32


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines (path, start, value): the range of a file that they are in. Each range's lines are in one partition, in their order."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.trim(F.regexp_replace("value", r"\s+", " ")).alias("value"))


def _running(names: list[str]):
    """Append `__<name>`, the sum over the lines before in the same range, to batches of lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sums = None, [0] * len(names)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            columns = [batch[n].to_numpy() for n in names]
            befores = [np.empty(batch.num_rows, np.int64) for _ in names]
            ids = pc.run_end_encode(batch["start"]), pc.run_end_encode(batch["path"])
            ends = np.unique(np.concatenate([x.run_ends.to_numpy() for x in ids]))
            for begin, end in zip([0, *ends[:-1]], ends, strict=True):
                split = batch["path"][begin].as_py(), batch["start"][begin].as_py()
                if split != last:
                    last, sums = split, [0] * len(names)
                for k, c in enumerate(columns):
                    upto = sums[k] + np.cumsum(c[begin:end])
                    befores[k][begin:end] = upto - c[begin:end]
                    sums[k] = int(upto[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, befores)], [*batch.schema.names, *[f"__{n}" for n in names]])

    return run


def _counted(lines: DataFrame, **counts: Column) -> DataFrame:
    """Lines with each of `counts` and, as `<name>_before`, its sum over all lines before."""
    own = lines.withColumns(counts)
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in own.schema], *[f"__{n} long" for n in counts]])
    own = cut(own.mapInArrow(_running(list(counts)), schema))
    ranges = Window.orderBy(F.length("path"), "path", "start").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy(*SPLIT).agg(*[F.sum(n).alias(n) for n in counts])
    sums = cut(sums.select(*SPLIT, *[F.coalesce(F.sum(n).over(ranges), F.lit(0)).alias(f"__all_{n}") for n in counts]))
    placed = own.join(F.broadcast(sums), SPLIT)  # a row per range that a scan is planned with
    return placed.select(*lines.columns, *counts, *[(F.col(f"__all_{n}") + F.col(f"__{n}")).alias(f"{n}_before") for n in counts])


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices: vid, x, y, z; triangles: eid, a, b, c), counted from 0; polygons become fans, negative corners count back
    from the vertices before their line."""
    lines = _lines(spark, path).where(F.substring_index("value", " ", 1).isin("v", "f"))
    is_v = F.substring("value", 1, 1) == "v"
    corners_and_f = F.size(F.split("value", " "))
    counted = _counted(lines, v=is_v.cast("long"), f=F.when(is_v, 0).otherwise(F.greatest(corners_and_f - 3, F.lit(0))).cast("long")).withColumn("p", F.split("value", " "))
    vertices = counted.where(is_v).select(F.col("v_before").alias("vid"), *[F.get("p", F.lit(k + 1)).try_cast("double").alias(n) for k, n in enumerate("xyz")])
    number = lambda s: F.split(s, "/")[0].try_cast("long")
    corners = F.transform(F.slice("p", 2, F.size("p") - 1), lambda s: F.when(number(s) < 0, F.col("v_before") + number(s)).otherwise(number(s) - 1))
    fans = counted.where("f > 0").select("f_before", corners.alias("c"), F.explode(F.sequence(F.lit(1), F.col("f").cast("int"))).alias("k"))
    return vertices, fans.select((F.col("f_before") + F.col("k") - 1).alias("eid"), F.col("c")[0].alias("a"), F.get("c", F.col("k")).alias("b"), F.get("c", F.col("k") + 1).alias("c"))


def _write(rows: DataFrame, path: str, single: bool, number: int) -> None:
    """Rows (s, n, value), `number` of them, as text in their order; Spark's committer moves finished parts only. `single`
    gathers them in one file."""
    placed = order.ranged(rows, "s", "n", rows=number)
    (placed.coalesce(1) if single else placed).select("value").write.text(path)


def write_obj(vertices: DataFrame, triangles: DataFrame, path: str, single: bool = False) -> None:
    """Parts of an OBJ file in the folder `path`: vertices by vid, then triangles by eid; one file if `single`, for small meshes."""
    v = vertices.select(F.lit(0).alias("s"), F.col("vid").alias("n"), F.concat_ws(" ", F.lit("v"), *[F.col(c).cast("string") for c in "xyz"]).alias("value"))
    f = triangles.select(F.lit(1).alias("s"), F.col("eid").alias("n"), F.concat_ws(" ", F.lit("f"), *[(F.col(c) + 1).cast("string") for c in "abc"]).alias("value"))
    _write(v.unionByName(f), path, single, vertices.count() + triangles.count())


def _records(lines: DataFrame, width: int, names: list[tuple[int, str]], kind: str) -> DataFrame:
    """(id, *names): words of lines (at, w), from place `at` on, in records of `width`. Only words of records that lines break meet in a shuffle."""
    end = F.col("at") + F.size("w")
    first, behind = F.ceil(F.col("at") / width).cast("long"), F.floor(end / width).cast("long")
    spans = lines.withColumns({"first": first, "behind": behind})
    of = lambda k: F.get("w", (F.col("id") * width - F.col("at") + k).cast("int")).try_cast(kind)
    whole = spans.where("first < behind").select("at", "w", F.explode(F.sequence(F.col("first"), F.col("behind") - 1)).alias("id")).select("id", *[of(k).alias(c) for k, c in names])
    words = spans.where((F.col("at") % width != 0) | (end % width != 0)).select("at", "first", "behind", F.posexplode("w").alias("k", "word")).withColumn("n", F.col("at") + F.col("k"))
    words = words.where((F.col("n") < F.col("first") * width) | (F.col("n") >= F.col("behind") * width))
    broken = words.groupBy(F.floor(F.col("n") / width).cast("long").alias("id")).agg(*[F.max(F.when(F.col("n") % width == k, F.col("word"))).try_cast(kind).alias(c) for k, c in names])
    return whole.unionByName(broken)


def read_vtk(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices: vid, x, y, z; tetrahedra: eid, a, b, c, d) of an ASCII unstructured grid, however its numbers are broken into lines."""
    head = F.col("value").rlike(r"^[A-Za-z]") & ~F.lower("value").rlike(r"^(nan|inf)")
    lines = _lines(spark, path).where("value <> ''").withColumn("head", head)
    counted = _counted(lines, heads=F.col("head").cast("long"), words=F.when(F.col("head"), 0).otherwise(F.size(F.split("value", " "))).cast("long"))
    sections = counted.where("head").select((F.col("heads_before") + 1).alias("heads_before"), F.regexp_extract("value", r"^(\w+)", 1).alias("section"), F.col("words_before").alias("__first"))
    wanted = sections.where("section in ('POINTS', 'CELLS')")
    wanted = F.broadcast(wanted) if wanted.count() <= FEW_SECTIONS else wanted
    marked = counted.where("not head").join(wanted, "heads_before").select("section", F.split("value", " ").alias("w"), (F.col("words_before") - F.col("__first")).alias("at"))
    points = _records(marked.where("section = 'POINTS'"), 3, list(enumerate("xyz")), "double").withColumnRenamed("id", "vid")
    tets = _records(marked.where("section = 'CELLS'"), 5, [(1, "a"), (2, "b"), (3, "c"), (4, "d")], "long").withColumnRenamed("id", "eid")
    return points, tets


def write_vtk(vertices: DataFrame, tets: DataFrame, path: str, single: bool = False) -> None:
    """Parts of an ASCII unstructured grid in the folder `path`; one file if `single`, for small meshes."""
    spark = vertices.sparkSession
    nv, ne = vertices.count(), tets.count()
    fixed = spark.createDataFrame([(0, 0, "# vtk DataFile Version 3.0"), (0, 1, "mesh"), (0, 2, "ASCII"), (0, 3, "DATASET UNSTRUCTURED_GRID"), (1, -1, f"POINTS {nv} double"), (2, -1, f"CELLS {ne} {5 * ne}"), (3, -1, f"CELL_TYPES {ne}")], "s int, n long, value string")
    v = vertices.select(F.lit(1).alias("s"), F.col("vid").alias("n"), F.concat_ws(" ", "x", "y", "z").alias("value"))
    c = tets.select(F.lit(2).alias("s"), F.col("eid").alias("n"), F.concat_ws(" ", F.lit(4), "a", "b", "c", "d").alias("value"))
    t = spark.range(0, ne, TYPES).select(F.lit(3).alias("s"), F.col("id").alias("n"), F.concat(F.repeat(F.lit("10\n"), (F.least(F.lit(TYPES), ne - F.col("id")) - 1).cast("int")), F.lit("10")).alias("value"))
    _write(fixed.unionByName(v).unionByName(c).unionByName(t), path, single, nv + ne + -(-ne // TYPES))


def at_corner(elements: DataFrame, vertices: DataFrame, corner: str, suffix: str = "") -> DataFrame:
    """Elements with the place x, y, z of one corner. Their rows are not sorted for it: a task holds its vertices, which are
    few against the elements, and its elements stream."""
    at = vertices.select(F.col("vid").alias(corner), *[F.col(x).alias(f"{x}{suffix}") for x in "xyz"])
    return elements.join(at.hint("shuffle_hash"), corner)


def vertex_normals(vertices: DataFrame, triangles: DataFrame, scale: float = 1.0) -> DataFrame:
    """(vid, nx, ny, nz): sums of the triangles' cross products, to length `scale`."""
    t = triangles
    for c in "abc":
        t = at_corner(t, vertices, c, c)
    u, w = [F.col(f"{x}b") - F.col(f"{x}a") for x in "xyz"], [F.col(f"{x}c") - F.col(f"{x}a") for x in "xyz"]
    n = [u[1] * w[2] - u[2] * w[1], u[2] * w[0] - u[0] * w[2], u[0] * w[1] - u[1] * w[0]]
    each = t.select(F.explode(F.array("a", "b", "c")).alias("vid"), *[x.alias(c) for x, c in zip(n, ("nx", "ny", "nz"), strict=True)])
    s = each.groupBy("vid").agg(F.sum("nx").alias("nx"), F.sum("ny").alias("ny"), F.sum("nz").alias("nz"))
    size = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    return s.select("vid", *[F.when(size > 0, F.col(c) * scale / F.when(size > 0, size).otherwise(1.0)).otherwise(0.0).alias(c) for c in ("nx", "ny", "nz")])
