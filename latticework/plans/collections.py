"""Queries: adaptors, ordered maps, array scans, and other operators on collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import frame, keyed, order, scan, sparse
from .arrays import CENTS, EXTENTS, extents, indexed_events, indexed_parts
from .registry import Tables, query


@query(f"SELECT event_id::BIGINT AS idx, {CENTS} * 3 + 7 AS v FROM events")
def map_with_parameters(spark, sf_dir):
    return frame.transform(indexed_events(spark, sf_dir).select("idx", "v"), "v", lambda v, a, b: v * a + b, 3, 7)


@query("SELECT p_partkey::BIGINT AS idx, p_retailprice * 0.5 AS size, p_size + 1.0::DOUBLE AS price FROM part")
def for_each_part(spark, sf_dir):
    return frame.for_each(indexed_parts(spark, sf_dir), lambda s, p: {"size": p * 0.5, "price": s + 1.0}, "size", "price")


@query(f"SELECT ((a * 25 + b) * (SELECT count(*) FROM supplier) + c)::BIGINT AS idx, (c * 1000 + a * 100 + b)::BIGINT AS code FROM {EXTENTS}")
def nested_loops(spark, sf_dir):
    return frame.nested(spark, extents(spark, sf_dir), [2, 0, 1], lambda x, y, z: {"code": x * 1000 + y * 100 + z}).select("idx", "code")


@query("SELECT c_custkey::BIGINT AS c_custkey, (row_number() OVER (ORDER BY c_name DESC, c_custkey) - 1)::BIGINT AS number FROM customer")
def enumerate_customers(spark, sf_dir):
    return frame.enumerate_rows(Tables(spark, sf_dir).customer, F.col("c_name").desc(), F.col("c_custkey")).select("c_custkey", "number")


@query("SELECT p_partkey::BIGINT AS idx, -1.0::DOUBLE AS size, 6.0::DOUBLE AS total FROM part")
def fill_channels(spark, sf_dir):
    df = indexed_parts(spark, sf_dir).withColumn("tv", F.array("size", "price", F.lit(1.0)))
    df = frame.fill(frame.fill(df, ["size"], -1.0), ["tv"], 2.0)
    return df.select("idx", "size", F.aggregate("tv", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("SELECT (p_partkey * 2 + k)::BIGINT AS dof, CASE k WHEN 0 THEN p_size::DOUBLE ELSE p_retailprice END AS v FROM part, (VALUES (0), (1)) t(k)")
def degrees_of_freedom(spark, sf_dir):
    return frame.channel_view(indexed_parts(spark, sf_dir).withColumn("tv", F.array("size", "price")), "tv", 2)


@query(f"SELECT (event_id // 64)::BIGINT AS bin, string_agg(({CENTS})::VARCHAR, ',' ORDER BY event_id) AS v, count(*)::INTEGER AS n FROM events GROUP BY 1")
def binned_storage(spark, sf_dir):
    b = frame.bins(indexed_events(spark, sf_dir), 64, ["v", "user_id"])
    return b.select("bin", F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("v"), F.size("user_id").alias("n"))


@query(f"SELECT event_id::BIGINT AS idx, {CENTS} AS v, 1.0::DOUBLE AS ratio, 1.0::DOUBLE AS trace, 0::BIGINT AS source FROM events UNION ALL SELECT event_id + (SELECT count(*) FROM events), -({CENTS}), 1.0, 3.0, 1 FROM events")
def append_particles(spark, sf_dir):
    own = indexed_events(spark, sf_dir).select("idx", "v")
    with_f = lambda df, d, s: frame.fill(frame.append_channels(df, {"ratio": 1}), ["ratio"], 1.0).withColumn("f", F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: F.when(k % 4 == 0, d).otherwise(0.0))).withColumn("source", F.lit(s).cast("long"))
    both = frame.append_rows(with_f(own, 1.0 / 3, 0), with_f(own.withColumn("v", -F.col("v")), 1.0, 1), own.count())
    return both.select("idx", "v", "ratio", (F.col("f")[0] + F.col("f")[4] + F.col("f")[8]).alias("trace"), "source")


@query("WITH p AS (SELECT c_custkey::BIGINT AS idx, c_acctbal * 60 AS probe FROM customer) SELECT idx, probe, (SELECT min(o_totalprice) FROM orders WHERE o_totalprice >= probe) AS bound FROM p")
def lower_bound(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return order.bound(t.orders, t.customer.select(F.col("c_custkey").cast("long").alias("idx"), (F.col("c_acctbal") * 60).alias("probe")), "o_totalprice", "probe")


@query("SELECT p_partkey::BIGINT AS idx, p_size::BIGINT AS probe, (SELECT min(s_nationkey) FROM supplier WHERE s_nationkey > p_size)::BIGINT AS bound FROM part")
def upper_bound(spark, sf_dir):
    t = Tables(spark, sf_dir)
    keys = t.supplier.select(F.col("s_nationkey").cast("long").alias("k"))
    return order.bound(keys, t.part.select(F.col("p_partkey").cast("long").alias("idx"), F.col("p_size").cast("long").alias("probe")), "k", "probe", upper=True)


LAST = f"(SELECT user_id, arg_max({CENTS}, event_id) AS v FROM events GROUP BY user_id)"


@query(f"SELECT user_id, v, (row_number() OVER (ORDER BY user_id) - 1)::BIGINT AS place, v * 2 AS twice FROM {LAST}")
def iterate_map(spark, sf_dir):
    table = keyed.last_write(indexed_events(spark, sf_dir), "user_id", "idx", "v")
    return keyed.visit(table, "user_id", lambda t: {"twice": t["v"] * 2})


@query(f"SELECT user_id, v FROM (SELECT *, row_number() OVER (ORDER BY user_id) - 1 AS place, count(*) OVER () AS n FROM {LAST}) WHERE place % 5 <> 0 AND place <> n - 1")
def erase_at_positions(spark, sf_dir):
    table = keyed.last_write(indexed_events(spark, sf_dir), "user_id", "idx", "v")
    n = table.count()
    places = spark.range(0, n, 5).select(F.col("id").alias("place")).unionByName(spark.range(n - 1, n).select(F.col("id").alias("place")))
    return keyed.erase_at(table, "user_id", places)


@query("SELECT p_partkey::BIGINT AS idx, p_retailprice AS price, (row_number() OVER (ORDER BY p_size & 15, p_partkey) - 1)::BIGINT AS place FROM part")
def radix_sort_pairs(spark, sf_dir):
    df = indexed_parts(spark, sf_dir)
    return order.rank(df, order.bits_key(F.col("size").cast("long"), 0, 4), F.col("idx")).select("idx", "price", "place")


@query("SELECT s_suppkey::BIGINT AS s_suppkey, (row_number() OVER (ORDER BY s_name, s_suppkey) - 1)::BIGINT AS place FROM supplier")
def sort_by_text(spark, sf_dir):
    return order.rank(Tables(spark, sf_dir).supplier, F.col("s_name"), F.col("s_suppkey")).select("s_suppkey", "place")


@query("SELECT p_partkey::BIGINT AS idx, (row_number() OVER (ORDER BY abs(p_size - 25), p_size % 7 DESC, p_partkey) - 1)::BIGINT AS place FROM part")
def sort_by_comparator(spark, sf_dir):
    df = indexed_parts(spark, sf_dir)
    return order.rank(df, F.struct(F.abs(F.col("size") - 25), -(F.col("size") % 7)), F.col("idx")).select("idx", "place")


def _spread(cell: str, shift: int) -> str:
    return " + ".join(f"(({cell} >> {k}) & 1) * {1 << (3 * k + shift)}" for k in range(10))


@query(f"SELECT id AS idx, code, (row_number() OVER (ORDER BY code, id) - 1)::BIGINT AS place FROM (SELECT id, ({_spread('a', 2)} + {_spread('b', 1)} + {_spread('c', 0)})::BIGINT AS code FROM (SELECT p_partkey::BIGINT AS id, floor(p_size / 64.0 * 1024)::BIGINT AS a, floor(p_retailprice / 4096 * 1024)::BIGINT AS b, floor((p_partkey % 13) / 16.0 * 1024)::BIGINT AS c FROM part))")
def morton_order(spark, sf_dir):
    df = indexed_parts(spark, sf_dir).withColumn("code", scalars.morton_3d(F.col("size") / 64.0, F.col("price") / 4096, (F.col("idx") % 13) / 16.0))
    return order.rank(df, F.col("code"), F.col("idx")).select("idx", "code", "place")


@query("SELECT l_orderkey::BIGINT AS prim, l_suppkey::BIGINT AS node, (row_number() OVER (ORDER BY l_suppkey, l_orderkey) - 1)::BIGINT AS place FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)")
def front_order(spark, sf_dir):
    pairs = Tables(spark, sf_dir).lineitem.select(F.col("l_orderkey").alias("prim"), F.col("l_suppkey").alias("node")).distinct()
    return order.rank(pairs, F.col("node"), F.col("prim"))


def _array(f: str) -> str:
    return f"SELECT vec_id::BIGINT AS id, {f} FROM (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS v FROM embeddings)"


@query(_array("list_transform(range(1, len(v) + 1), lambda k: round(list_sum(v[1:k]), 6)) AS sums, list_transform(range(1, len(v) + 1), lambda k: round(coalesce(list_sum(v[1:k - 1]), 0), 6)) AS before, list_transform(range(1, len(v) + 1), lambda k: round(list_sum(v[k:]), 6)) AS after"))
def prefix_of_arrays(spark, sf_dir):
    """Zeros keep the sign that rounding gives them, as in the SQL; sums over nulls alone are null."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    near = lambda a: F.transform(a, lambda x: scalars.half_away(x, 6))

    def given(reverse=False):
        sums = near(scan.array_scan(v, scan.PLUS, reverse=reverse))
        known = scan.array_scan(F.transform(v, lambda x: x.isNotNull().cast("double")), scan.PLUS, reverse=reverse)
        return F.when(F.exists(v, lambda x: x.isNull()), F.zip_with(sums, known, lambda s, n: F.when(n > 0, s))).otherwise(sums)

    return Tables(spark, sf_dir).embeddings.select(F.col("vec_id").cast("long").alias("id"), given().alias("sums"), near(scan.array_scan(v, scan.PLUS, inclusive=False)).alias("before"), given(reverse=True).alias("after"))


@query("SELECT p_partkey::BIGINT AS id, ((p_size % 3 + 2) * (p_size % 5 + 3) * 4)::DOUBLE AS total, ((p_size % 5 + 3) * 4)::DOUBLE AS stride0, 4.0::DOUBLE AS stride1, 1.0::DOUBLE AS stride2 FROM part")
def strides_of_shapes(spark, sf_dir):
    size = F.col("p_size")
    shape = F.array((size % 3 + 2).cast("double"), (size % 5 + 3).cast("double"), F.lit(4.0))
    strides = scan.array_scan(shape, scan.TIMES, inclusive=False, reverse=True)
    return Tables(spark, sf_dir).part.select(F.col("p_partkey").cast("long").alias("id"), scan.array_reduce(shape, scan.TIMES).alias("total"), *[strides[k].alias(f"stride{k}") for k in range(3)])


@query("SELECT p_partkey::BIGINT AS row, s.s_suppkey::BIGINT AS col, coalesce(v, 0)::BIGINT AS val FROM part p JOIN supplier s ON s.s_suppkey = p.p_partkey % 10 LEFT JOIN (SELECT l_partkey, l_suppkey, sum(l_quantity)::BIGINT AS v FROM lineitem GROUP BY ALL) m ON m.l_partkey = p.p_partkey AND m.l_suppkey = s.s_suppkey")
def matrix_coefficients(spark, sf_dir):
    t = Tables(spark, sf_dir)
    m = sparse.build(t.lineitem.select(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col"), F.col("l_quantity").cast("long").alias("val")))
    asked = t.part.select(F.col("p_partkey").alias("row"), (F.col("p_partkey") % 10).alias("col"))
    return sparse.coefficients(m, asked, t.supplier.select(F.col("s_suppkey").alias("col")))
