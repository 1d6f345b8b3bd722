"""Queries: sparse matrices, semirings, graphs, solvers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, solvers, sparse, tensor
from ..operators.lineage import cut
from .registry import Tables, query

COO = "(SELECT l_partkey AS r, l_suppkey AS c, sum(l_quantity)::BIGINT AS v FROM lineitem GROUP BY ALL)"


def matrix(spark, sf_dir):
    """Parts by suppliers: quantities, repeated places summed."""
    lines = Tables(spark, sf_dir).lineitem
    return sparse.build(lines.select(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col"), F.col("l_quantity").cast("long").alias("val")))


def vector(spark, sf_dir):
    return Tables(spark, sf_dir).supplier.select(F.col("s_suppkey").alias("idx"), F.round(F.col("s_acctbal") * 100).cast("long").alias("x"))


def part_rows(spark, sf_dir):
    return Tables(spark, sf_dir).part.select(F.col("p_partkey").alias("row"))


@query(f"SELECT r::BIGINT AS row, c::BIGINT AS col, v AS val FROM {COO}")
def csr_build(spark, sf_dir):
    return matrix(spark, sf_dir)


@query("SELECT row::BIGINT AS row, col::BIGINT AS col FROM (SELECT o_custkey AS row, o_orderkey AS col FROM orders UNION SELECT o_orderkey, o_custkey FROM orders)")
def csr_build_mirrored(spark, sf_dir):
    return sparse.topology(Tables(spark, sf_dir).orders.select(F.col("o_custkey").alias("row"), F.col("o_orderkey").alias("col")), mirror=True)


@query("SELECT o_orderkey::BIGINT AS row, o_custkey::BIGINT AS col FROM orders")
def csr_fast_build(spark, sf_dir):
    return sparse.topology(Tables(spark, sf_dir).orders.select(F.col("o_orderkey").alias("row"), F.col("o_custkey").alias("col")), unique=True)


@query(f"SELECT p_partkey::BIGINT AS row, coalesce(n, 0)::BIGINT AS degree, coalesce(sum(coalesce(n, 0)) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM part LEFT JOIN (SELECT r, count(*) AS n FROM {COO} GROUP BY r) ON p_partkey = r")
def csr_pointers(spark, sf_dir):
    return sparse.pointers(matrix(spark, sf_dir), part_rows(spark, sf_dir), block=512)


@query(f"SELECT c::BIGINT AS row, r::BIGINT AS col, v AS val FROM {COO}")
def csr_transpose(spark, sf_dir):
    return sparse.transpose(matrix(spark, sf_dir))


def _spmv_sql(add, term, empty, kind="DOUBLE", mask=""):
    return f"SELECT p_partkey::BIGINT AS row, coalesce(y, {empty})::{kind} AS y FROM part LEFT JOIN (SELECT r, {add}({term}) AS y FROM {COO} JOIN (SELECT s_suppkey, CAST(round(s_acctbal * 100) AS BIGINT) AS x FROM supplier) ON c = s_suppkey {mask} GROUP BY r) ON p_partkey = r"


@query(_spmv_sql("sum", "v * x", 0, "BIGINT"))
def spmv_plus_times(spark, sf_dir):
    return sparse.spmv(matrix(spark, sf_dir), vector(spark, sf_dir), part_rows(spark, sf_dir))


@query(_spmv_sql("min", "v + x", "'inf'::DOUBLE"))
def spmv_min_plus(spark, sf_dir):
    return sparse.spmv(matrix(spark, sf_dir), vector(spark, sf_dir), part_rows(spark, sf_dir), sparse.MIN_PLUS).withColumn("y", F.col("y").cast("double"))


@query(_spmv_sql("max", "v + x", "'-inf'::DOUBLE"))
def spmv_max_plus(spark, sf_dir):
    return sparse.spmv(matrix(spark, sf_dir), vector(spark, sf_dir), part_rows(spark, sf_dir), sparse.MAX_PLUS).withColumn("y", F.col("y").cast("double"))


@query(_spmv_sql("min", "v * x", "'inf'::DOUBLE"))
def spmv_min_times(spark, sf_dir):
    return sparse.spmv(matrix(spark, sf_dir), vector(spark, sf_dir), part_rows(spark, sf_dir), sparse.MIN_TIMES).withColumn("y", F.col("y").cast("double"))


@query(_spmv_sql("max", "v * x", "'-inf'::DOUBLE"))
def spmv_max_times(spark, sf_dir):
    return sparse.spmv(matrix(spark, sf_dir), vector(spark, sf_dir), part_rows(spark, sf_dir), sparse.MAX_TIMES).withColumn("y", F.col("y").cast("double"))


@query(_spmv_sql("bool_or", "v > 40 AND x > 500000", "false", "BOOLEAN"))
def spmv_boolean(spark, sf_dir):
    m, x = matrix(spark, sf_dir).withColumn("val", F.col("val") > 40), vector(spark, sf_dir).withColumn("x", F.col("x") > 500000)
    return sparse.spmv(m, x, part_rows(spark, sf_dir), sparse.BOOLEAN)


@query(_spmv_sql("sum", "v * x", 0, "BIGINT", "WHERE r NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)"))
def spmv_masked(spark, sf_dir):
    mask = Tables(spark, sf_dir).part.where("p_size > 25").select(F.col("p_partkey").alias("row"))
    return sparse.spmv(matrix(spark, sf_dir), vector(spark, sf_dir), part_rows(spark, sf_dir), mask=mask)


@query(f"SELECT p_partkey::BIGINT AS row, (p_size + coalesce(y, 0))::BIGINT AS y FROM part LEFT JOIN (SELECT r, sum(v * x) AS y FROM {COO} JOIN (SELECT s_suppkey, CAST(round(s_acctbal * 100) AS BIGINT) AS x FROM supplier) ON c = s_suppkey GROUP BY r) ON p_partkey = r")
def spmv_accumulating(spark, sf_dir):
    y = Tables(spark, sf_dir).part.select(F.col("p_partkey").alias("row"), F.col("p_size").cast("long").alias("y"))
    return sparse.accumulate(y, spmv_plus_times(spark, sf_dir))


@query("WITH a AS (SELECT c_nationkey::BIGINT AS r, c_mktsegment AS c, count(*)::BIGINT AS v FROM customer GROUP BY ALL) SELECT x.r AS row, y.r AS col, sum(x.v * y.v)::BIGINT AS val FROM a x JOIN a y ON x.c = y.c GROUP BY ALL")
def matrix_product(spark, sf_dir):
    a = Tables(spark, sf_dir).customer.groupBy(F.col("c_nationkey").cast("long").alias("row"), F.col("c_mktsegment").alias("col")).agg(F.count(F.lit(1)).alias("val"))
    return sparse.spgemm(a, sparse.transpose(a))


def nation_edges(spark, sf_dir):
    """Customers to nations to regions; nations and regions are numbered from 1e12 and 2e12 on."""
    t = Tables(spark, sf_dir)
    edges = t.customer.select(F.col("c_custkey").cast("long").alias("src"), (F.col("c_nationkey") + 1_000_000_000_000).alias("dst"))
    return edges.unionByName(t.nation.select((F.col("n_nationkey") + 1_000_000_000_000).alias("src"), (F.col("n_regionkey") + 2_000_000_000_000).alias("dst")))


@query("WITH g AS (SELECT n_regionkey, min(c_custkey)::BIGINT AS label FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT c_custkey::BIGINT AS v, label FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN g USING (n_regionkey) UNION ALL SELECT n_nationkey + 1000000000000, coalesce(label, n_nationkey + 1000000000000) FROM nation LEFT JOIN g USING (n_regionkey) UNION ALL SELECT DISTINCT n_regionkey + 2000000000000, label FROM nation JOIN g USING (n_regionkey)")
def connected_components(spark, sf_dir):
    return graph.components(nation_edges(spark, sf_dir))


@query("SELECT c_custkey::BIGINT AS v, min(c_custkey) OVER (PARTITION BY c_nationkey)::BIGINT AS label FROM customer UNION ALL SELECT n_nationkey + 1000000000000, min(c_custkey) FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def components_with_skipped_edges(spark, sf_dir):
    return graph.components(nation_edges(spark, sf_dir), skip=F.col("dst") >= 2_000_000_000_000)


def neighbours(spark, sf_dir):
    """Suppliers of one nation, each joined to the next two by key."""
    from pyspark.sql import Window

    s, w = Tables(spark, sf_dir).supplier, Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    s = s.select(F.col("s_suppkey").cast("long").alias("src"), F.lead("s_suppkey", 1).over(w).cast("long").alias("a"), F.lead("s_suppkey", 2).over(w).cast("long").alias("b"))
    return s.select("src", F.explode(F.array("a", "b")).alias("dst")).where("dst is not null")


def supplier_weights(spark, sf_dir):
    return Tables(spark, sf_dir).supplier.select(F.col("s_suppkey").cast("long").alias("v"), F.xxhash64("s_suppkey").alias("weight"))


def _conflicts(colors, edges):
    a, b = colors.select(F.col("v").alias("src"), F.col("color").alias("ca")), colors.select(F.col("v").alias("dst"), F.col("color").alias("cb"))
    bad = edges.join(a, "src").join(b, "dst").agg(F.coalesce(F.sum((F.col("ca") == F.col("cb")).cast("long")), F.lit(0)).alias("conflicts"))
    return bad.withColumn("colored", F.lit(colors.where("color > 0").count()).cast("long"))


@query("SELECT 0::BIGINT AS conflicts, count(*)::BIGINT AS colored FROM supplier")
def coloring_fast(spark, sf_dir):
    edges = neighbours(spark, sf_dir)
    return _conflicts(graph.color(edges, supplier_weights(spark, sf_dir)), edges)


@query("SELECT 0::BIGINT AS conflicts, count(*)::BIGINT AS colored FROM supplier")
def coloring_maximal_sets(spark, sf_dir):
    edges = neighbours(spark, sf_dir)
    return _conflicts(graph.maximal_independent_color(edges, supplier_weights(spark, sf_dir)), edges)


@query("WITH c AS (SELECT c_nationkey AS n, sum(1 + c_custkey % 3)::DOUBLE AS c FROM customer GROUP BY 1), n AS (SELECT n_regionkey AS r, sum(least(coalesce(c, 0), (5 + n_nationkey)::DOUBLE)) AS c FROM nation LEFT JOIN c ON n = n_nationkey GROUP BY 1) SELECT sum(least(c, (3 + 20 * r)::DOUBLE)) AS flow FROM n")
def maximum_flow(spark, sf_dir):
    """From a source through regions of capacity 3 + 20 key and nations of capacity 5 + key to all their customers, of capacity 1 + key % 3 together as many as they are."""
    t = Tables(spark, sf_dir)
    e = t.region.select(F.lit(-1).cast("long").alias("src"), (F.col("r_regionkey") + 1000).cast("long").alias("dst"), (20.0 * F.col("r_regionkey") + 3).alias("cap"))
    e = e.unionByName(t.nation.select((F.col("n_regionkey") + 1000).cast("long").alias("src"), F.col("n_nationkey").cast("long").alias("dst"), (F.col("n_nationkey") + 5).cast("double").alias("cap")))
    e = e.unionByName(t.customer.groupBy(F.col("c_nationkey").cast("long").alias("src")).agg(F.sum(1 + F.col("c_custkey") % 3).cast("double").alias("cap")).select("src", F.lit(-2).cast("long").alias("dst"), "cap"))
    return spark.createDataFrame([(graph.maximum_flow(e, -1, -2),)], "flow double")


def spd_system(spark, sf_dir):
    """(16 I + L) x = b over all suppliers: L is the Laplacian of `neighbours`, and b is made from x = key % 10 - 3."""
    both = graph.mirrored(neighbours(spark, sf_dir))
    x = Tables(spark, sf_dir).supplier.select(F.col("s_suppkey").cast("long").alias("idx"), (F.col("s_suppkey") % 10 - 3).cast("double").alias("x"))
    degrees = x.join(both.groupBy(F.col("src").alias("idx")).agg(F.count(F.lit(1)).alias("n")), "idx", "left")
    m = degrees.select(F.col("idx").alias("row"), F.col("idx").alias("col"), (F.coalesce("n", F.lit(0)) + 16.0).alias("val"))
    m = cut(m.unionByName(both.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.lit(-1.0).alias("val"))))
    return m, cut(solvers.Operator(m).multiply(x))


SOLUTION = "SELECT s_suppkey::BIGINT AS idx, (s_suppkey % 10 - 3)::DOUBLE + 0.0 AS x FROM supplier"


def solved(x):
    return x.select("idx", (F.round("x", 5) + F.lit(0.0)).alias("x"))


@query(SOLUTION)
def solve_cg(spark, sf_dir):
    m, b = spd_system(spark, sf_dir)
    diagonal = m.where("row = col").select(F.col("row").alias("idx"), (1 / F.col("val")).alias("x"))
    return solved(solvers.conjugate_gradient(solvers.Operator(m, diagonal), b, 1e-7))


@query(SOLUTION)
def solve_cr(spark, sf_dir):
    m, b = spd_system(spark, sf_dir)
    return solved(solvers.conjugate_residual(solvers.Operator(m), b, 1e-16))


@query(SOLUTION)
def solve_minres(spark, sf_dir):
    m, b = spd_system(spark, sf_dir)
    return solved(solvers.minres(solvers.Operator(m), b, 1e-8))


@query("SELECT round(sum(s_acctbal * s_suppkey), 1) AS dot, round(sqrt(sum(s_acctbal * s_acctbal)), 3) AS norm FROM supplier")
def vector_dot(spark, sf_dir):
    s = Tables(spark, sf_dir).supplier
    a, k = s.select(F.col("s_suppkey").alias("idx"), F.col("s_acctbal").alias("x")), s.select(F.col("s_suppkey").alias("idx"), F.col("s_suppkey").cast("double").alias("x"))
    return spark.createDataFrame([(solvers.dot(a, k), solvers.dot(a, a) ** 0.5)], "dot double, norm double").select(F.round("dot", 1).alias("dot"), F.round("norm", 3).alias("norm"))


QUANTITIES = "SELECT l_partkey AS p, l_suppkey AS s, l_quantity AS a, p_size % 5 AS b, p_size AS v, s_nationkey AS n, s_suppkey % 7 + 1 AS w FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey"


def factors(spark, sf_dir):
    """Quantities by part and supplier, parts by size class, suppliers by nation."""
    t = Tables(spark, sf_dir)
    return [
        tensor.Tensor(t.lineitem.select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("val")), ("p", "s")),
        tensor.Tensor(t.part.select(F.col("p_partkey").alias("p"), (F.col("p_size") % 5).alias("b"), F.col("p_size").cast("double").alias("val")), ("p", "b")),
        tensor.Tensor(t.supplier.select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("n"), (F.col("s_suppkey") % 7 + 1).cast("double").alias("val")), ("s", "n")),
    ]


@query(f"SELECT b, n, sum(a * v * w) AS val FROM ({QUANTITIES}) GROUP BY b, n")
def tensor_contraction(spark, sf_dir):
    """Three factors contracted over parts and suppliers, by size class and nation."""
    return tensor.contract(factors(spark, sf_dir), ("b", "n")).frame


@query(f"WITH q AS (SELECT p, s, b, v, n, w, min(a) AS a FROM ({QUANTITIES}) GROUP BY ALL) SELECT n, b, min(a + v + w)::DOUBLE AS val FROM q GROUP BY n, b")
def tensor_contraction_min_plus(spark, sf_dir):
    """The same factors in another order of indices, over the semiring of least sums."""
    return tensor.contract(factors(spark, sf_dir)[::-1], ("n", "b"), sparse.MIN_PLUS).frame


@query("SELECT l_partkey % 10 AS i, l_suppkey % 10 AS j, sum(l_quantity * l_linenumber)::DOUBLE AS val FROM lineitem GROUP BY 1, 2")
def tensor_of_hot_index(spark, sf_dir):
    """Two tensors of lines that share one index of which few values hold all entries, each summed before they meet: an index
    that only one tensor has goes first."""
    t = Tables(spark, sf_dir).lineitem
    rows = tensor.Tensor(t.select((F.col("l_partkey") % 10).alias("i"), (F.col("l_suppkey") % 10).alias("j"), F.col("l_linenumber").alias("k"), F.col("l_quantity").alias("val")), ("i", "j", "k"))
    weights = tensor.Tensor(t.groupBy(F.col("l_linenumber").alias("k")).agg(F.max("l_linenumber").cast("double").alias("val")), ("k",))
    return tensor.contract([rows, weights], ("i", "j")).frame
