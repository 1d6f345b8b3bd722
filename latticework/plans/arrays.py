"""Queries: positional maps, reductions, scans, sorts, searches, keyed operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frame, keyed, order, scan
from ..streaming import ring
from .registry import Tables, query

CENTS = "CAST(round(value * 100) AS BIGINT)"


def indexed_events(spark, sf_dir):
    """Events by position: `idx`, and the value in hundredths `v`."""
    return Tables(spark, sf_dir).events.select(F.col("event_id").cast("long").alias("idx"), F.round(F.col("value") * 100).cast("long").alias("v"), "user_id", "event_type")


def indexed_parts(spark, sf_dir):
    return Tables(spark, sf_dir).part.select(F.col("p_partkey").cast("long").alias("idx"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))


@query("SELECT idx::BIGINT AS idx FROM (SELECT unnest(range(3, (SELECT count(*) FROM orders), 5)) AS idx) WHERE idx + 5 <= (SELECT count(*) FROM orders)")
def index_range(spark, sf_dir):
    """Every fifth position of the orders, from the fourth on, in whole steps."""
    return frame.index_range(spark, 3, Tables(spark, sf_dir).orders.count(), 5)


EXTENTS = "(SELECT unnest(range((SELECT count(*) FROM region))) AS a), (SELECT unnest(range((SELECT count(*) FROM nation))) AS b), (SELECT unnest(range((SELECT count(*) FROM supplier))) AS c)"


def extents(spark, sf_dir):
    """Numbers of regions, nations and suppliers."""
    t = Tables(spark, sf_dir)
    return [t.region.count(), t.nation.count(), t.supplier.count()]


@query(f"SELECT a::BIGINT AS i0, b::BIGINT AS i1, c::BIGINT AS i2, ((a * 25 + b) * (SELECT count(*) FROM supplier) + c)::BIGINT AS idx FROM {EXTENTS}")
def nd_range(spark, sf_dir):
    return frame.nd_range(spark, *extents(spark, sf_dir))


@query(f"SELECT CAST(event_id AS BIGINT) AS idx, {CENTS} AS v, p_size::DOUBLE AS size FROM events JOIN part ON event_id = p_partkey")
def zip_events_parts(spark, sf_dir):
    return frame.zip_frames(indexed_events(spark, sf_dir).select("idx", "v"), indexed_parts(spark, sf_dir).select("idx", "size"))


@query(f"SELECT CAST(event_id // 100 AS BIGINT) AS chunk, count(*)::BIGINT AS n, sum({CENTS})::BIGINT AS total FROM events GROUP BY 1")
def chunk_events(spark, sf_dir):
    return frame.chunk(indexed_events(spark, sf_dir), 100).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query("WITH n AS (SELECT count(*) AS n FROM part) SELECT p_partkey::BIGINT AS idx, ((p_partkey * 7) % n)::BIGINT AS source, g.p_size::DOUBLE AS size FROM (SELECT p.p_partkey, n.n FROM part p, n) m JOIN (SELECT p_partkey AS k, p_size FROM part) g ON g.k = (m.p_partkey * 7) % m.n")
def gather_parts(spark, sf_dir):
    data = indexed_parts(spark, sf_dir).select("idx", "size")
    mapping = data.select("idx", ((F.col("idx") * 7) % data.count()).alias("source"))
    return frame.gather(data, mapping).join(mapping, "idx")


@query("SELECT ((p_partkey * 7) % (SELECT count(*) FROM part))::BIGINT AS idx, p_size::DOUBLE AS size FROM part")
def scatter_parts(spark, sf_dir):
    data = indexed_parts(spark, sf_dir).select("idx", "size")
    return frame.scatter(data, data.select("idx", ((F.col("idx") * 7) % data.count()).alias("target")))


@query("SELECT p_partkey::BIGINT AS idx, p_size::DOUBLE AS size, 0.0::DOUBLE AS mass, 3 AS width, p_retailprice * 2 AS second FROM part")
def append_and_pack_channels(spark, sf_dir):
    df = frame.append_channels(indexed_parts(spark, sf_dir), {"mass": 1, "velocity": 3}).withColumn("tv", F.array("price", F.col("price") * 2, F.col("price") * 3))
    return df.select("idx", "size", "mass", F.size("velocity").alias("width"), frame.pack("tv", 1, 2)[0].alias("second"))


@query("SELECT p_partkey::BIGINT AS idx, round(2.0 * p_size + 0.5 * p_retailprice, 6) AS v FROM part")
def axpby_parts(spark, sf_dir):
    return indexed_parts(spark, sf_dir).select("idx", F.round(frame.axpby(2.0, F.col("size"), 0.5, F.col("price")), 6).alias("v"))


@query("SELECT p_partkey::BIGINT AS idx, CASE WHEN p_partkey = 5 THEN -1.0 ELSE p_size END::DOUBLE AS size FROM part UNION ALL SELECT p_partkey + (SELECT count(*) FROM part), p_size FROM part")
def set_and_append(spark, sf_dir):
    df = indexed_parts(spark, sf_dir).select("idx", "size")
    return frame.append_rows(frame.set_value(df, "size", 5, -1.0), df, df.count())


@query("SELECT p_partkey::BIGINT AS idx, p_size::DOUBLE AS size, (p_partkey // 32)::BIGINT AS tile, (p_partkey % 32)::BIGINT AS lane, (p_partkey // 60)::BIGINT AS i0, (p_partkey // 10 % 6)::BIGINT AS i1, (p_partkey % 10)::BIGINT AS i2 FROM part")
def tile_and_reshape(spark, sf_dir):
    df = frame.tiles(indexed_parts(spark, sf_dir).select("idx", "size"), 32)
    return frame.reshape(df, [1 << 40, 6, 10]).select("idx", "size", "tile", "lane", "i0", "i1", "i2")


@query(f"SELECT sum({CENTS})::BIGINT AS total, max({CENTS}) AS high, min({CENTS}) AS low, bool_or({CENTS} > 9000) AS some, bool_and({CENTS} >= 0) AS every, round(product(1 + value / 1e6), 6) AS prod FROM events")
def reductions(spark, sf_dir):
    df = indexed_events(spark, sf_dir)
    v = F.col("v")
    parts = [(v, scan.PLUS, "total"), (v, scan.MAX, "high"), (v, scan.MIN, "low"), (v > 9000, scan.ANY, "some"), (v >= 0, scan.ALL, "every"), (1 + v / 1e8, scan.TIMES, "prod")]
    return df.agg(*[F.coalesce(m.aggregate(e), F.lit(m.identity)).alias(n) for e, m, n in parts]).withColumn("prod", F.round("prod", 6))


@query(f"SELECT 7 + coalesce(sum({CENTS}), 0)::BIGINT AS value FROM events WHERE value < -1e9")
def reduce_empty(spark, sf_dir):
    return scan.reduce(indexed_events(spark, sf_dir).where("v < -1e11"), F.col("v"), scan.PLUS, init=7)


@query(f"SELECT user_id, sum({CENTS})::BIGINT AS total, count(*)::BIGINT AS n, max({CENTS}) AS high, min({CENTS}) AS low, bit_or({CENTS}) AS ors, bit_and({CENTS}) AS ands, bit_xor({CENTS}) AS xors FROM events GROUP BY user_id")
def reduce_by_key(spark, sf_dir):
    df = indexed_events(spark, sf_dir)
    return keyed.scatter_aggregate(df, "user_id", total=F.sum("v"), n=F.count(F.lit(1)), high=F.max("v"), low=F.min("v"), ors=F.bit_or("v"), ands=F.bit_and("v"), xors=F.bit_xor("v"))


@query("SELECT floor(l_extendedprice / 1000)::BIGINT AS bin, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def histogram(spark, sf_dir):
    return keyed.histogram(Tables(spark, sf_dir).lineitem, F.floor(F.col("l_extendedprice") / 1000).cast("long"))


def _scan_sql(f, bounds, empty):
    return f"SELECT CAST(event_id AS BIGINT) AS idx, {CENTS} AS v, coalesce({f}({CENTS}) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND {bounds}), {empty})::BIGINT AS s FROM events"


@query(_scan_sql("sum", "CURRENT ROW", 0))
def inclusive_scan_sum(spark, sf_dir):
    return scan.scan(indexed_events(spark, sf_dir).select("idx", "v"), "v", scan.PLUS, "s")


@query(_scan_sql("sum", "1 PRECEDING", 0))
def exclusive_scan_sum(spark, sf_dir):
    return scan.scan(indexed_events(spark, sf_dir).select("idx", "v"), "v", scan.PLUS, "s", inclusive=False)


@query(_scan_sql("max", "CURRENT ROW", "NULL"))
def inclusive_scan_max(spark, sf_dir):
    return scan.scan(indexed_events(spark, sf_dir).select("idx", "v"), "v", scan.MAX, "s", block=512)


@query(_scan_sql("min", "1 PRECEDING", "NULL"))
def exclusive_scan_min(spark, sf_dir):
    return scan.scan(indexed_events(spark, sf_dir).select("idx", "v"), "v", scan.MIN, "s", inclusive=False, block=512)


@query("SELECT CAST(event_id AS BIGINT) AS idx, round(product(1 + value / 1e6) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS s FROM events")
def running_product(spark, sf_dir):
    df = Tables(spark, sf_dir).events.select(F.col("event_id").cast("long").alias("idx"), (1 + F.col("value") / 1e6).alias("f"))
    return scan.scan(df, "f", scan.TIMES, "s").select("idx", F.round("s", 6).alias("s"))


@query("SELECT o_orderkey::BIGINT AS o_orderkey, (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1)::BIGINT AS place FROM orders")
def stable_sort(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    return order.rank(o, F.col("o_totalprice"), F.col("o_orderkey")).select("o_orderkey", "place")


@query("SELECT p_partkey::BIGINT AS idx, p_size::DOUBLE AS size, (row_number() OVER (ORDER BY p_size DESC, p_partkey) - 1)::BIGINT AS place FROM part")
def sort_pairs_descending(spark, sf_dir):
    return order.rank(indexed_parts(spark, sf_dir).select("idx", "size"), -F.col("size"), F.col("idx"))


@query(f"SELECT CAST(event_id AS BIGINT) AS idx, (row_number() OVER (ORDER BY ({CENTS} >> 3) & 255, event_id) - 1)::BIGINT AS place FROM events")
def radix_sort_bits(spark, sf_dir):
    df = indexed_events(spark, sf_dir)
    return order.rank(df, order.bits_key(F.col("v"), 3, 11), F.col("idx")).select("idx", "place")


@query("WITH s AS (SELECT o_totalprice AS v, (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1)::BIGINT AS place FROM orders), p AS (SELECT c_custkey::BIGINT AS idx, c_acctbal * 60 AS probe FROM customer) SELECT p.idx, p.probe, coalesce((SELECT max(place) FROM s WHERE s.v <= p.probe), -1)::BIGINT AS place FROM p")
def binary_search(spark, sf_dir):
    t = Tables(spark, sf_dir)
    data = order.rank(t.orders, F.col("o_totalprice"), F.col("o_orderkey")).select(F.col("o_totalprice").alias("v"), "place")
    return order.search(data, t.customer.select(F.col("c_custkey").cast("long").alias("idx"), (F.col("c_acctbal") * 60).alias("probe")), "v", "probe")


@query("SELECT l_partkey::BIGINT AS row, string_agg(l_suppkey::VARCHAR || ':' || q::VARCHAR, ',' ORDER BY l_suppkey) AS entries FROM (SELECT l_partkey, l_suppkey, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY ALL) GROUP BY 1")
def rows_in_column_order(spark, sf_dir):
    from ..operators import sparse

    m = Tables(spark, sf_dir).lineitem.select(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col"), F.col("l_quantity").cast("long").alias("val"))
    shown = F.transform("entries", lambda e: F.concat_ws(":", e["col"].cast("string"), e["val"].cast("string")))
    return sparse.ordered_rows(sparse.build(m)).select("row", F.array_join(shown, ",").alias("entries"))


@query("SELECT l_partkey::BIGINT AS l_partkey, l_suppkey::BIGINT AS l_suppkey FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")
def distinct_keys(spark, sf_dir):
    return Tables(spark, sf_dir).lineitem.select("l_partkey", "l_suppkey").distinct()


@query("SELECT l_partkey::BIGINT AS l_partkey, l_suppkey::BIGINT AS l_suppkey, (row_number() OVER (ORDER BY l_partkey, l_suppkey) - 1)::BIGINT AS id FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")
def dense_ids(spark, sf_dir):
    return keyed.dense_ids(Tables(spark, sf_dir).lineitem, ["l_partkey", "l_suppkey"])


@query("WITH i AS (SELECT l_suppkey, (row_number() OVER (ORDER BY l_suppkey) - 1)::BIGINT AS id, count(*) OVER () AS n FROM (SELECT DISTINCT l_suppkey FROM lineitem)) SELECT l_suppkey::BIGINT AS l_suppkey, (n - 1 - id)::BIGINT AS id FROM i")
def renumbered_ids(spark, sf_dir):
    ids = keyed.dense_ids(Tables(spark, sf_dir).lineitem, ["l_suppkey"])
    return keyed.renumber(ids, ids.select("id", (F.lit(ids.count() - 1) - F.col("id")).alias("target")))


@query("SELECT s_suppkey::BIGINT AS s_suppkey, coalesce(c_custkey, -1)::BIGINT AS id FROM (SELECT s_suppkey, s_suppkey * 40 AS k FROM supplier) LEFT JOIN customer ON c_custkey = k")
def hash_lookup(spark, sf_dir):
    t = Tables(spark, sf_dir)
    table = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_custkey").cast("long").alias("id"))
    return keyed.lookup(t.supplier.select("s_suppkey", (F.col("s_suppkey") * 40).alias("k")), table, ["k"]).select("s_suppkey", "id")


@query("SELECT c_custkey::BIGINT AS c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def members(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return keyed.present(t.customer, t.orders.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey")


@query("SELECT c_custkey::BIGINT AS c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def erased_keys(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return keyed.absent(t.customer, t.orders.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey")


@query(f"SELECT user_id, arg_max({CENTS}, event_id) AS v FROM events GROUP BY user_id")
def last_write_wins(spark, sf_dir):
    return keyed.last_write(indexed_events(spark, sf_dir), "user_id", "idx", "v")


@query(f"WITH w AS (SELECT user_id, arg_max({CENTS}, event_id) AS v FROM events GROUP BY user_id) SELECT c_custkey::BIGINT AS user_id, coalesce(v, 0) AS v FROM customer LEFT JOIN w ON c_custkey = user_id UNION ALL SELECT user_id, v FROM w WHERE user_id NOT IN (SELECT c_custkey FROM customer)")
def merge_writes(spark, sf_dir):
    table = Tables(spark, sf_dir).customer.select(F.col("c_custkey").alias("user_id"), F.lit(0).cast("long").alias("v"))
    return keyed.merge_writes(table, last_write_wins(spark, sf_dir), "user_id", "v")


@query("SELECT o_orderkey::BIGINT AS o_orderkey FROM orders WHERE o_totalprice >= 1000")
def remove_all(spark, sf_dir):
    return keyed.remove_if(Tables(spark, sf_dir).orders, F.col("o_totalprice") < 1000).select("o_orderkey")


@query("SELECT user_id, sum(value)::BIGINT AS total FROM (SELECT user_id, CAST(round(value * 100) AS BIGINT) AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS p FROM events) WHERE p <= 8 GROUP BY user_id")
def ring_buffer(spark, sf_dir):
    last = ring.last_items(indexed_events(spark, sf_dir), "user_id", "idx", "v")
    return last.select("user_id", F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT 'longer' AS kind, i.idx::BIGINT AS idx, p_size::DOUBLE AS size, (SELECT p_size::DOUBLE FROM part WHERE p_partkey = 7) AS seventh FROM (SELECT unnest(range((SELECT count(*) FROM orders))) AS idx) i LEFT JOIN part ON p_partkey = i.idx UNION ALL SELECT 'shorter', p_partkey, p_size::DOUBLE, (SELECT p_size::DOUBLE FROM part WHERE p_partkey = 7) FROM part WHERE p_partkey < (SELECT count(*) FROM customer)")
def resize_parts(spark, sf_dir):
    """Parts made as many as there are orders, and as there are customers, each with the element at position 7."""
    t, parts = Tables(spark, sf_dir), indexed_parts(spark, sf_dir).select("idx", "size")
    sized = [frame.resize(parts, n).select(F.lit(kind).alias("kind"), "idx", "size") for kind, n in (("longer", t.orders.count()), ("shorter", t.customer.count()))]
    return sized[0].unionByName(sized[1]).withColumn("seventh", F.lit(frame.get_value(parts, "size", 7)))
