"""Queries over the other tables: splits, samples, money, periods, latencies, grids and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.functions import text as X
from tillroll.operators import analytics as A
from tillroll.operators import grids as T
from tillroll.operators import metrics as M
from tillroll.operators import spans as B
from tillroll.operators import splits as Z
from tillroll.plans.fixture import WORDS_SQL, words
from tillroll.queries._registry import registry
from tillroll.session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
query = registry(QUERIES, ORACLE_SQL)


@query("WITH k AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey DESC) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders)) SELECT o_orderkey, o_custkey, CASE WHEN r <= greatest(1, least(n - 1, round_even(n * 0.15, 0))) THEN 'validation' ELSE 'train' END AS split FROM orders JOIN k USING (o_custkey)")
def split_tail(spark, sf_dir):
    return Z.tail_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 0.15)


@query("WITH k AS (SELECT min(o_custkey) AS cut FROM (SELECT DISTINCT o_custkey FROM orders ORDER BY o_custkey DESC LIMIT 20)) SELECT o_orderkey, o_custkey, CASE WHEN o_custkey >= cut THEN 'validation' ELSE 'train' END AS split FROM orders, k WHERE NOT (o_custkey >= cut AND o_orderkey % 3 = 0)")
def split_by_parent(spark, sf_dir):
    return Z.parent_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", F.col("o_orderkey") % 3 == 0, 20)


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, (o_orderkey % 3 > 0)::INT AS a, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 > 0 ORDER BY o_orderkey) AS k FROM orders) ORDER BY a, CASE WHEN a = 1 THEN k ELSE 0 END, o_custkey, o_orderkey LIMIT (SELECT (count(*) * 0.6)::BIGINT FROM orders)")
def balanced_sample(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return Z.balanced_sample(orders, "o_custkey", F.col("o_orderkey") % 3 > 0, "o_orderkey", int(orders.count() * 0.6 + 0.5))


@query("WITH s AS (SELECT doc_id, quality * 2 + toxic AS label, CASE WHEN doc_id % 10 = 0 THEN 'validation' ELSE 'train' END AS split FROM labels), h AS (SELECT label, count_if(split = 'validation') AS have FROM s GROUP BY label) SELECT doc_id, s.label, CASE WHEN split = 'train' AND row_number() OVER (PARTITION BY s.label, split ORDER BY doc_id) <= 9 - have THEN 'validation' ELSE split END AS split FROM s JOIN h ON s.label = h.label")
def coverage_rebalance(spark, sf_dir):
    made = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("label"), F.when(F.col("doc_id") % 10 == 0, "validation").otherwise("train").alias("split"))
    return Z.cover_labels(made, "label", "split", 9, "doc_id")


@query("SELECT c_custkey, c_mktsegment, repeat::INT AS repeat FROM customer, unnest(generate_series(0, CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 0 END)) AS x(repeat)")
def oversample(spark, sf_dir):
    return Z.oversample(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.when(F.col("c_mktsegment") == "BUILDING", 3).otherwise(1))


@query("SELECT o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) <= 25")
def capped_per_split(spark, sf_dir):
    return Z.capped(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 25)


@query("SELECT p_name, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY p_name ORDER BY n DESC, p_name LIMIT 40")
def frequent_texts(spark, sf_dir):
    return Z.frequent(table(spark, sf_dir, "part"), "p_name", "p_partkey", 40)


@query("SELECT source, key, balance FROM (SELECT 'customer' AS source, c_custkey AS key, c_acctbal AS balance FROM customer UNION ALL SELECT 'part', p_partkey, NULL FROM part)")
def source_union(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    return Z.tagged_union(customer=c, part=table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"))).select("source", "key", "balance")


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'right' WHEN b.doc_id IS NULL THEN 'left' ELSE 'both' END AS side FROM (SELECT DISTINCT doc_id FROM documents) a FULL JOIN (SELECT DISTINCT doc_id FROM labels) b ON a.doc_id = b.doc_id")
def unmatched(spark, sf_dir):
    return Z.paired(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, count(value) AS n FROM events GROUP BY event_type")
def latency_stats(spark, sf_dir):
    made = M.latency(table(spark, sf_dir, "events"), "value", "event_type")
    return made.withColumns({c: F.round(c, 6) for c in ("mean", "p50", "p95")})


@query("SELECT event_id, ts::DATE = DATE '2024-01-20' AS day, ts::DATE >= DATE '2024-01-14' AS week, year(ts) = 2024 AND month(ts) = 1 AS month FROM events")
def period_filter(spark, sf_dir):
    date, today = F.to_date("ts"), F.lit("2024-01-20").cast("date")
    return table(spark, sf_dir, "events").select("event_id", *[A.in_period(date, p, today).alias(p.lower()) for p in ("DAY", "WEEK", "MONTH")])


@query("WITH i AS (SELECT l_orderkey, sum(round(l_extendedprice * 100)::BIGINT) AS cents FROM lineitem GROUP BY l_orderkey) SELECT c_mktsegment, count(*) AS n, sum(CASE WHEN o_orderkey % 4 > 0 THEN round(o_totalprice * 100)::BIGINT ELSE coalesce(cents, 0) END)::BIGINT AS cents FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN i ON l_orderkey = o_orderkey GROUP BY c_mktsegment")
def spend_summary(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"))
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(items, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    total = F.when(F.col("o_orderkey") % 4 > 0, F.round(F.col("o_totalprice") * 100).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    made = orders.withColumn("spent", A.spend(total, F.col("cents")).cast("bigint"))
    return made.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("spent").alias("cents"))


@query("SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS cents, o_orderkey % 2 = 0 AS valid FROM orders")
def money_parse(spark, sf_dir):
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    text = F.concat(F.lit("CAD $ "), ((cents - cents % 100) / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    capture = F.when(F.col("o_orderkey") % 2 == 0, "20240120T101112Z_x").otherwise("yesterday_x")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(X.amount(text) * 100).cast("bigint").alias("cents"), X.capture_date(capture).isNotNull().alias("valid"))


@query(f"WITH words AS ({WORDS_SQL}), s AS (SELECT *, x0 - 60 AS a0, x1 + 200 AS a1, CASE WHEN word_idx % 5 = 0 THEN y0 ELSE y1 END AS b1 FROM words) SELECT doc_id, count(*) AS n, count_if(NOT (a1 > a0 AND b1 > y0)) AS invalid, count_if(a0 < 0 OR y0 < 0 OR a1 > page_w OR b1 > page_h) AS outside, count_if(a0 < 0 OR y0 < 0 OR a1 >= page_w OR b1 >= page_h) AS at_edge, min(confidence) AS least_confidence, max(confidence) AS most_confidence FROM s GROUP BY doc_id")
def export_box_validation(spark, sf_dir):
    shifted = words(spark, sf_dir).withColumns({"x0": F.col("x0") - 60, "x1": F.col("x1") + 200, "y1": F.when(F.col("word_idx") % 5 == 0, F.col("y0")).otherwise(F.col("y1"))})
    return A.box_report(shifted)


@query("WITH each AS (SELECT label, i, round(avg(embedding[i]), 6) AS value, count(*) AS n FROM embeddings, unnest(generate_series(1, len(embedding))) AS x(i) GROUP BY ALL) SELECT label, list(value ORDER BY i) AS vector, max(n) AS n FROM each GROUP BY label")
def span_pool_mean(spark, sf_dir):
    made = B.pool(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", "label")
    return made.withColumn("vector", F.transform("vector", lambda v: F.round(v, 6)))


@query("SELECT label, arg_min(embedding, vec_id) AS vector, count(*) AS n FROM embeddings GROUP BY label")
def span_pool_first(spark, sf_dir):
    return B.pool(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", "label", mode="first")


_CELLS = "SELECT n_regionkey AS table_id, n_nationkey AS cell_id, (k // 3)::INT AS start_row, (k // 3)::INT AS end_row, (k % 3)::INT AS start_col, (k % 3)::INT AS end_col, n_nationkey % 7 = 3 AS blank FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k FROM nation)"


def _cells(spark, sf_dir):
    return spark.sql("SELECT n_regionkey AS table_id, n_nationkey AS cell_id, int(k div 3) AS start_row, int(k div 3) AS end_row, int(k % 3) AS start_col, int(k % 3) AS end_col, n_nationkey % 7 = 3 AS blank FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k FROM {nation})", nation=table(spark, sf_dir, "nation"))


@query(f"""WITH c AS ({_CELLS}), f AS (SELECT * FROM c WHERE NOT blank)
    SELECT a.table_id, a.cell_id AS from_cell, arg_min(b.cell_id, b.start_col) AS to_cell, 'right' AS direction FROM f a JOIN f b ON a.table_id = b.table_id AND a.start_row = b.start_row AND b.start_col > a.start_col GROUP BY a.table_id, a.cell_id
    UNION ALL SELECT a.table_id, a.cell_id, arg_min(b.cell_id, b.start_row), 'down' FROM f a JOIN f b ON a.table_id = b.table_id AND a.start_col = b.start_col AND b.start_row > a.start_row GROUP BY a.table_id, a.cell_id""")
def table_adjacency(spark, sf_dir):
    return T.adjacency(_cells(spark, sf_dir))


_BOXED = "SELECT table_id, cell_id, start_col * 10.0 AS x0, start_row * 10.0 AS y0, start_col * 10.0 + 9 AS x1, start_row * 10.0 + 9 AS y1 FROM c"


@query(f"""WITH c AS ({_CELLS}), t AS ({_BOXED}), f AS (SELECT table_id, cell_id, x0 + cell_id % 4 AS x0, y0, x1 + cell_id % 4 AS x1, y1 FROM t),
    j AS (SELECT t.table_id, t.cell_id, f.cell_id AS f_cell_id, greatest(0, least(t.x1, f.x1) - greatest(t.x0, f.x0)) * greatest(0, least(t.y1, f.y1) - greatest(t.y0, f.y0)) AS shared, (t.x1 - t.x0) * (t.y1 - t.y0) + (f.x1 - f.x0) * (f.y1 - f.y0) AS areas FROM t JOIN f ON t.table_id = f.table_id)
    SELECT table_id, cell_id, f_cell_id, round(shared / (areas - shared), 6) AS iou FROM j WHERE shared / (areas - shared) >= 0.6 QUALIFY row_number() OVER (PARTITION BY table_id, cell_id ORDER BY f_cell_id) = 1""")
def table_cell_match(spark, sf_dir):
    c = _cells(spark, sf_dir)
    box = c.select("table_id", "cell_id", (F.col("start_col") * 10.0).alias("x0"), (F.col("start_row") * 10.0).alias("y0"), (F.col("start_col") * 10.0 + 9).alias("x1"), (F.col("start_row") * 10.0 + 9).alias("y1"))
    moved = box.withColumns({"x0": F.col("x0") + F.col("cell_id") % 4, "x1": F.col("x1") + F.col("cell_id") % 4})
    return T.match_cells(box, moved, 0.6).withColumn("iou", F.round("iou", 6))
