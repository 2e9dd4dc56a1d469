"""The engine's queries over the driver's tables: statements of the dialect, each with plain SQL for the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsql.engine import Engine
from docsql.sources.catalog import Catalog, Child

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DIGITS = 4


def engine(spark: SparkSession, sf_dir: str, **options) -> Engine:
    """An engine over the tables, with views of them that have nulls, places, nested lines and child lines."""
    catalog = Catalog(spark, sf_dir, TABLES)
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    catalog.register("documents", read("documents"), "doc_id", text=("text",))
    orders = read("orders")
    third = F.col("o_orderkey") % 3 == 0
    catalog.register("sparse", orders.select("o_orderkey", "o_custkey", F.when(~third, F.col("o_orderpriority")).alias("prio"), F.when(~third, F.col("o_totalprice")).alias("price"), "o_orderdate"), "o_orderkey")
    key = F.col("c_custkey")
    point = F.struct(((key * 37 % 3600) / 10 - 180).alias("lon"), ((key * 91 % 1800) / 10 - 90).alias("lat"))
    catalog.register("places", read("customer").select("c_custkey", "c_mktsegment", point.alias("center")), "c_custkey")
    lines = read("lineitem")
    item = F.struct("l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    nested = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("lines"))
    catalog.register("order_docs", orders.join(nested, orders.o_orderkey == nested.l_orderkey).drop("l_orderkey"), "o_orderkey")
    square = lambda x, y: F.array(x, y)
    ring = F.array(*[square(F.col("center.lon") + dx, F.col("center.lat") + dy) for dx, dy in ((-2, -2), (2, -2), (2, 2), (-2, 2), (-2, -2))])
    areas = catalog.one("places").df.select("c_custkey", "center", F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("area"))
    catalog.register("areas", areas.filter("abs(center.lon) < 20 and abs(center.lat) < 20"), "c_custkey")
    catalog.register("order_tree", orders, "o_orderkey", children={"line": Child("lineitem", "l_orderkey")})
    return Engine(spark, catalog, **options)


@dataclass(frozen=True)
class Query:
    text: str
    sql: str | None
    rounded: tuple[str, ...] = ()
    as_json: tuple[str, ...] = ()
    picked: tuple[str, str] | None = None  # of a column of rows, the field shown

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = engine(spark, sf_dir).sql(self.text)
        df = df.withColumn(self.picked[0], F.to_json(F.transform(self.picked[0], lambda r: r[self.picked[1]]))) if self.picked else df
        df = df.withColumns({c: F.to_json(F.col(f"`{c}`")) for c in self.as_json}) if self.as_json else df
        return df.withColumns({c: F.round(F.col(f"`{c}`").cast("double"), DIGITS) for c in self.rounded}) if self.rounded else df

    def oracle(self) -> str | None:
        if self.sql is None or not self.rounded:
            return self.sql
        parts = ", ".join(f'round(CAST("{c}" AS DOUBLE), {DIGITS}) AS "{c}"' for c in self.rounded)
        return f"SELECT * REPLACE ({parts}) FROM ({self.sql})"


_SPARSE = """(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS prio,
 CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS price, o_orderdate FROM orders) sparse"""
_PLACES = "(SELECT c_custkey, c_mktsegment, (c_custkey * 37 % 3600) / 10 - 180 AS lon, (c_custkey * 91 % 1800) / 10 - 90 AS lat FROM customer) places"
_WORDS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_\p{M}]+'), lambda w: w <> '')"
_TOKENS = f"(SELECT doc_id, source, {_WORDS} AS t FROM documents)"
_FLAT = "(SELECT o.*, l.* FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey)"
_STATS = 'count({0}) AS "{1}.count", sum({0}) AS "{1}.sum", avg({0}) AS "{1}.avg", min({0}) AS "{1}.min", max({0}) AS "{1}.max"'


def _bm25(words: list[str], where: str, limit: int) -> str:
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len(t) / mean))" for i in range(len(words)))
    dfs = ", ".join(f"sum(CASE WHEN list_contains(t, '{w}') THEN 1 ELSE 0 END) AS df{i}" for i, w in enumerate(words))
    tfs = ", ".join(f"CAST(len(list_filter(t, lambda w: w = '{w}')) AS DOUBLE) AS tf{i}" for i, w in enumerate(words))
    return f"WITH d AS {_TOKENS}, s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(t)) AS mean, {dfs} FROM d), c AS (SELECT d.*, {tfs} FROM d) SELECT doc_id, {score} AS _score FROM c, s WHERE {where} ORDER BY _score DESC, doc_id LIMIT {limit}"


def _date_buckets(step: str, value: str = "") -> str:
    return f"SELECT strftime(time_bucket(INTERVAL '{step}', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS h, count(*) AS n{value} FROM events GROUP BY 1"


QUERIES: dict[str, Query] = {
    # buckets
    "terms_topk": Query(
        "SELECT COUNT(*) AS n FROM orders GROUP BY o_custkey LIMIT 10",
        "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10"),
    "terms_nested_topk": Query(
        "SELECT COUNT(*) AS n FROM lineitem GROUP BY l_suppkey, l_linenumber LIMIT 3",
        """WITH a AS (SELECT l_suppkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3),
 b AS (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM a) GROUP BY 1, 2)
 SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_linenumber) <= 3"""),
    "terms_missing": Query(
        "SELECT COUNT(*) AS n FROM sparse GROUP BY terms(field='prio',alias='prio',missing='none')",
        f"SELECT coalesce(prio, 'none') AS prio, count(*) AS n FROM {_SPARSE} GROUP BY 1"),
    "terms_null_keys_go": Query(
        "SELECT COUNT(*) AS n, SUM(price) AS s FROM sparse GROUP BY prio",
        f"SELECT prio, count(*) AS n, sum(price) AS s FROM {_SPARSE} WHERE prio IS NOT NULL GROUP BY 1", ("s",)),
    "terms_include_exclude": Query(
        "SELECT COUNT(*) AS n FROM orders GROUP BY terms(field='o_orderpriority',alias='p',include='[1-3].*',exclude='[\"2-HIGH\"]',order='desc',size=5)",
        "SELECT o_orderpriority AS p, count(*) AS n FROM orders WHERE regexp_full_match(o_orderpriority, '[1-3].*') AND o_orderpriority <> '2-HIGH' GROUP BY 1"),
    "terms_order_by_metric": Query(
        "SELECT o_custkey, AVG(o_totalprice) AS a, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY a DESC LIMIT 7",
        "SELECT o_custkey, avg(o_totalprice) AS a, count(*) AS n FROM orders GROUP BY 1 ORDER BY a DESC, 1 LIMIT 7", ("a",)),
    "terms_expression": Query(
        "SELECT COUNT(*) AS n FROM part GROUP BY terms('alias'='k',substring(p_name,0,3))",
        "SELECT substring(p_name, 1, 3) AS k, count(*) AS n FROM part GROUP BY 1"),
    "group_by_case_alias": Query(
        "SELECT CASE WHEN o_totalprice > 250000 THEN 'high' ELSE 'low' END AS level, COUNT(*) AS n FROM orders GROUP BY level",
        "SELECT CASE WHEN o_totalprice > 250000 THEN 'high' ELSE 'low' END AS level, count(*) AS n FROM orders GROUP BY 1"),
    "terms_order_option": Query(
        "SELECT SUM(o_totalprice) AS s FROM orders GROUP BY terms(field='o_custkey',alias='k',size=9,order='[{\"s\":\"desc\"},{\"_key\":\"asc\"}]')",
        "SELECT o_custkey AS k, sum(o_totalprice) AS s FROM orders GROUP BY 1 ORDER BY s DESC, 1 LIMIT 9", ("s",)),
    "terms_least_above": Query(
        "SELECT COUNT(*) AS n FROM orders GROUP BY terms(field='o_custkey',alias='k',min_doc_count=16), o_orderstatus",
        "SELECT o_custkey AS k, o_orderstatus, count(*) AS n FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 16) GROUP BY 1, 2"),
    "grouping_lists": Query(
        "SELECT COUNT(*) AS n, MAX(o_totalprice) AS m FROM orders GROUP BY (o_orderstatus), (o_orderpriority, o_orderstatus)",
        """SELECT 0 AS _grouping, o_orderstatus, NULL AS o_orderpriority, count(*) AS n, max(o_totalprice) AS m FROM orders GROUP BY o_orderstatus
 UNION ALL SELECT 1, o_orderstatus, o_orderpriority, count(*), max(o_totalprice) FROM orders GROUP BY o_orderstatus, o_orderpriority"""),
    "range_buckets": Query(
        "SELECT COUNT(*) AS n, SUM(p_retailprice) AS s FROM part GROUP BY range(p_size,0,10,20,35,60,100,alias='size')",
        """WITH b(i, a, z, size) AS (VALUES (0, 0, 10, '0.0-10.0'), (1, 10, 20, '10.0-20.0'), (2, 20, 35, '20.0-35.0'), (3, 35, 60, '35.0-60.0'), (4, 60, 100, '60.0-100.0'))
 SELECT size, count(p_partkey) AS n, sum(p_retailprice) AS s FROM b LEFT JOIN part ON p_size >= a AND p_size < z GROUP BY size""", ("s",)),
    "date_range_buckets": Query(
        "SELECT COUNT(*) AS n FROM orders GROUP BY date_range(field='o_orderdate',format='yyyy-MM-dd',alias='d','1995-01-01','1996-01-01','1996-07-01','1998-01-01')",
        """WITH b(a, z) AS (VALUES (DATE '1995-01-01', DATE '1996-01-01'), (DATE '1996-01-01', DATE '1996-07-01'), (DATE '1996-07-01', DATE '1998-01-01'))
 SELECT strftime(a, '%Y-%m-%d') || '-' || strftime(z, '%Y-%m-%d') AS d, count(o_orderkey) AS n FROM b LEFT JOIN orders ON o_orderdate >= a AND o_orderdate < z GROUP BY 1"""),
    "date_range_zone": Query(
        "SELECT COUNT(*) AS n FROM events GROUP BY date_range(field='ts',format='yyyy-MM-dd',time_zone='Asia/Tokyo',alias='d','2024-01-05','2024-01-10','2024-02-01')",
        """WITH b(a, z) AS (VALUES (TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-10'), (TIMESTAMP '2024-01-10', TIMESTAMP '2024-02-01'))
 SELECT strftime(a, '%Y-%m-%d') || '-' || strftime(z, '%Y-%m-%d') AS d, count(event_id) AS n FROM b LEFT JOIN events ON ts + INTERVAL 9 HOUR >= a AND ts + INTERVAL 9 HOUR < z GROUP BY 1"""),
    "month_buckets": Query(
        "SELECT COUNT(*) AS n FROM orders GROUP BY month(field='o_orderdate',format='yyyy-MM',alias='m','1995-01','1995-02','1995-05')",
        """WITH b(a, z) AS (VALUES (DATE '1995-01-01', DATE '1995-02-01'), (DATE '1995-02-01', DATE '1995-05-01'))
 SELECT strftime(a, '%Y-%m') || '-' || strftime(z, '%Y-%m') AS m, count(o_orderkey) AS n FROM b LEFT JOIN orders ON o_orderdate >= a AND o_orderdate < z GROUP BY 1"""),
    "histogram": Query(
        "SELECT COUNT(*) AS n, AVG(o_totalprice) AS a FROM orders GROUP BY histogram(field='o_totalprice',interval=50000,alias='h')",
        "SELECT floor(o_totalprice / 50000) * 50000 AS h, count(*) AS n, avg(o_totalprice) AS a FROM orders GROUP BY 1", ("a",)),
    "histogram_gaps": Query(
        "SELECT COUNT(*) AS n FROM nation WHERE n_nationkey < 4 OR n_nationkey > 17 GROUP BY histogram(field='n_nationkey',interval=3,alias='h',min_doc_count=0,extended_bounds='0:33')",
        "SELECT CAST(h AS DOUBLE) AS h, count(n_nationkey) AS n FROM range(0, 34, 3) r(h) LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 4 OR n_nationkey > 17) ON floor(n_nationkey / 3) * 3 = h GROUP BY 1"),
    "histogram_gaps_below": Query(
        "SELECT COUNT(*) AS n FROM orders WHERE o_totalprice > 300000 GROUP BY o_orderpriority, histogram(field='o_totalprice',interval=2500,alias='h',min_doc_count=0)",
        """WITH r AS (SELECT o_orderpriority AS p, CAST(floor(o_totalprice / 2500) AS BIGINT) AS i FROM orders WHERE o_totalprice > 300000),
 g AS (SELECT p, unnest(generate_series(min(i), max(i))) AS i FROM r GROUP BY p)
 SELECT g.p AS o_orderpriority, CAST(g.i * 2500 AS DOUBLE) AS h, count(r.i) AS n FROM g LEFT JOIN r ON r.p = g.p AND r.i = g.i GROUP BY 1, 2"""),
    "date_histogram_zone": Query(
        "SELECT COUNT(*) AS n FROM events GROUP BY date_histogram(field='ts',interval='1d',format='yyyy-MM-dd',time_zone='Asia/Shanghai',alias='d')",
        "SELECT strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS d, count(*) AS n FROM events GROUP BY 1"),
    "date_histogram_gaps_below": Query(
        "SELECT COUNT(*) AS n FROM events WHERE value > 150 GROUP BY event_type, date_histogram(field='ts',interval='1h',min_doc_count=0,alias='h')",
        """WITH e AS (SELECT event_type, date_trunc('hour', ts) AS t FROM events WHERE value > 150), g AS (SELECT event_type, unnest(generate_series(min(t), max(t), INTERVAL 1 HOUR)) AS t FROM e GROUP BY 1)
 SELECT g.event_type, strftime(g.t, '%Y-%m-%d %H:%M:%S') AS h, count(e.t) AS n FROM g LEFT JOIN e ON e.t = g.t AND e.event_type = g.event_type GROUP BY 1, 2"""),
    "date_histogram_fixed": Query("SELECT COUNT(*) AS n, SUM(value) AS s FROM events GROUP BY date_histogram(field='ts',interval='90m',alias='h')", _date_buckets("90 minutes", ", sum(value) AS s"), ("s",)),
    "date_histogram_calendar": Query(
        "SELECT COUNT(*) AS n FROM orders GROUP BY date_histogram(field='o_orderdate',interval='month',format='yyyy-MM',alias='m')",
        "SELECT strftime(o_orderdate, '%Y-%m') AS m, count(*) AS n FROM orders GROUP BY 1"),
    "date_histogram_gaps": Query(
        "SELECT COUNT(*) AS n FROM events WHERE event_type = 'error' AND value > 150 GROUP BY date_histogram(field='ts',interval='1h',min_doc_count=0,alias='h')",
        """WITH e AS (SELECT date_trunc('hour', ts) AS t FROM events WHERE event_type = 'error' AND value > 150), g AS (SELECT unnest(generate_series(min(t), max(t), INTERVAL 1 HOUR)) AS t FROM e)
 SELECT strftime(g.t, '%Y-%m-%d %H:%M:%S') AS h, count(e.t) AS n FROM g LEFT JOIN e ON e.t = g.t GROUP BY 1"""),
    "filter_bucket": Query(
        "SELECT COUNT(*) AS n FROM orders GROUP BY filter('big',o_totalprice > 300000), o_orderstatus",
        "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 300000 GROUP BY 1"),
    "filters_other": Query(
        "SELECT COUNT(*) AS n FROM orders GROUP BY filters(kind,other,filter(big,o_totalprice > 300000),filter(urgent,o_orderpriority = '1-URGENT'))",
        """SELECT kind, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN o_totalprice > 300000 THEN 'big' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END,
 CASE WHEN NOT (o_totalprice > 300000 OR o_orderpriority = '1-URGENT') THEN 'other' END], lambda x: x IS NOT NULL)) AS kind FROM orders) GROUP BY 1"""),
    "significant_text": Query(
        "SELECT * FROM documents WHERE source = 'src3' GROUP BY significant_text(field='text',alias='word',size=12,min_doc_count=5)",
        f"""WITH d AS {_TOKENS}, w AS (SELECT doc_id, source, unnest(list_distinct(t)) AS word FROM d),
 b AS (SELECT word, count(*) AS bg_count, count(*) FILTER (source = 'src3') AS doc_count FROM w GROUP BY 1),
 s AS (SELECT CAST(count(*) AS DOUBLE) AS nb, CAST(count(*) FILTER (source = 'src3') AS DOUBLE) AS nf FROM d)
 SELECT word, doc_count, bg_count, (doc_count / nf - bg_count / nb) * ((doc_count / nf) / (bg_count / nb)) AS score FROM b, s
 WHERE doc_count >= 5 AND doc_count / nf > bg_count / nb ORDER BY score DESC, word LIMIT 12""", ("score",)),
    "significant_text_below": Query(
        "SELECT COUNT(*) AS n, MAX(n_chars) AS longest FROM documents GROUP BY source, significant_text(field='text',alias='word',size=4,min_doc_count=6)",
        f"""WITH d AS (SELECT *, {_WORDS} AS t FROM documents), w AS (SELECT doc_id, source, n_chars, unnest(list_distinct(t)) AS word FROM d),
 b AS (SELECT word, count(*) AS bg_count FROM w GROUP BY 1), f AS (SELECT source, word, count(*) AS doc_count, max(n_chars) AS longest FROM w GROUP BY 1, 2),
 s AS (SELECT source, CAST(count(*) AS DOUBLE) AS nf FROM d GROUP BY 1), a AS (SELECT CAST(count(*) AS DOUBLE) AS nb FROM d)
 SELECT source, word, doc_count AS n, CAST(longest AS DOUBLE) AS longest, doc_count, bg_count, (doc_count / nf - bg_count / nb) * ((doc_count / nf) / (bg_count / nb)) AS score
 FROM f JOIN b USING (word) JOIN s USING (source), a WHERE doc_count >= 6 AND doc_count / nf > bg_count / nb
 QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, word) <= 4""", ("score",)),
    # metrics
    "stats": Query("SELECT stats(l_quantity) AS q FROM lineitem GROUP BY l_returnflag", f"SELECT l_returnflag, {_STATS.format('l_quantity', 'q')} FROM lineitem GROUP BY 1", ("q.sum", "q.avg")),
    "extended_stats": Query(
        "SELECT extended_stats(l_discount) AS d FROM lineitem",
        f'SELECT {_STATS.format("l_discount", "d")}, sum(l_discount * l_discount) AS "d.sumOfSquares", var_pop(l_discount) AS "d.variance", stddev_pop(l_discount) AS "d.stdDeviation" FROM lineitem',
        ("d.sum", "d.avg", "d.sumOfSquares", "d.variance", "d.stdDeviation")),
    "percentiles": Query(
        "SELECT percentiles(o_totalprice,1.0,25.0,50.0,99.0) AS p FROM orders GROUP BY o_orderstatus",
        "SELECT o_orderstatus, " + ", ".join(f'quantile_cont(o_totalprice, {p / 100}) AS "p.{p}"' for p in (1.0, 25.0, 50.0, 99.0)) + " FROM orders GROUP BY 1", tuple(f"p.{p}" for p in (1.0, 25.0, 50.0, 99.0))),
    "percentile_ranks": Query(
        "SELECT percentile_ranks(o_totalprice,100000,400000) AS r FROM orders",
        'SELECT 100 * avg(CASE WHEN o_totalprice <= 100000 THEN 1.0 ELSE 0 END) AS "r.100000.0", 100 * avg(CASE WHEN o_totalprice <= 400000 THEN 1.0 ELSE 0 END) AS "r.400000.0" FROM orders', ("r.100000.0", "r.400000.0")),
    "count_distinct_exact": Query("SELECT COUNT(DISTINCT l_partkey) AS parts, COUNT(*) AS n FROM lineitem GROUP BY l_linestatus", "SELECT l_linestatus, count(DISTINCT l_partkey) AS parts, count(*) AS n FROM lineitem GROUP BY 1"),
    "count_non_null": Query("SELECT COUNT(price) AS n, COUNT(*) AS a FROM sparse", f"SELECT count(price) AS n, count(*) AS a FROM {_SPARSE}"),
    "metric_of_expression": Query(
        "SELECT SUM(l_extendedprice * (1 - l_discount)) AS revenue, AVG(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS big FROM lineitem GROUP BY l_returnflag, l_linestatus",
        "SELECT l_returnflag, l_linestatus, sum(l_extendedprice * (1 - l_discount)) AS revenue, avg(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS big FROM lineitem GROUP BY 1, 2", ("revenue", "big")),
    "having": Query(
        "SELECT COUNT(*) AS n, SUM(o_totalprice) AS s FROM orders GROUP BY o_custkey HAVING n > 14 OR s > 4000000",
        "SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1 HAVING count(*) > 14 OR sum(o_totalprice) > 4000000", ("s",)),
    "tophits": Query(
        "SELECT topHits('size'=2,o_totalprice='desc','include'='o_orderkey') AS top FROM orders GROUP BY o_orderpriority",
        """SELECT o_orderpriority, CAST(to_json(list({'o_orderkey': o_orderkey} ORDER BY rn)) AS VARCHAR) AS top FROM (SELECT o_orderpriority, o_orderkey,
 row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2 GROUP BY 1""", as_json=("top",)),
    "scripted_metric": Query(
        "SELECT scripted_metric('map_script'='o_totalprice * x','combine_script'='sum','reduce_script'='_agg / 1000','@x'='2') AS k FROM orders GROUP BY o_orderstatus",
        "SELECT o_orderstatus, sum(o_totalprice * 2) / 1000 AS k FROM orders GROUP BY 1", ("k",)),
    "moving_avg": Query(
        "SELECT AVG(value) AS v, movingavg(v,3) AS ma FROM events GROUP BY date_histogram(field='ts',interval='1d',format='yyyy-MM-dd',alias='d')",
        "SELECT *, avg(v) OVER (ORDER BY d ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS ma FROM (SELECT strftime(ts, '%Y-%m-%d') AS d, avg(value) AS v FROM events GROUP BY 1)", ("v", "ma")),
    "rolling_std": Query(
        "SELECT SUM(value) AS v, rollingstd(v,4) AS sd FROM events GROUP BY date_histogram(field='ts',interval='1d',format='yyyy-MM-dd',alias='d')",
        "SELECT *, stddev_pop(v) OVER (ORDER BY d ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS sd FROM (SELECT strftime(ts, '%Y-%m-%d') AS d, sum(value) AS v FROM events GROUP BY 1)", ("v", "sd")),
    "max_bucket": Query(
        "SELECT SUM(value) AS s, max_bucket(s) AS best FROM events GROUP BY event_type",
        "WITH b AS (SELECT event_type, sum(value) AS s FROM events GROUP BY 1) SELECT min(event_type) AS keys, max(s) AS best FROM b WHERE s = (SELECT max(s) FROM b)", ("best",)),
    "min_bucket": Query(
        "SELECT COUNT(*) AS n, min_bucket(n) AS least FROM orders GROUP BY o_orderpriority",
        "WITH b AS (SELECT o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1) SELECT min(k) AS keys, max(n) AS least FROM b WHERE n = (SELECT min(n) FROM b)"),
    "sibling_metrics": Query(
        "SELECT SUM(value) AS s, COUNT(*) AS n, max_bucket(s) AS best, min_bucket(n) AS least FROM events GROUP BY event_type",
        """WITH b AS (SELECT event_type AS k, sum(value) AS s, count(*) AS n FROM events GROUP BY 1)
 SELECT (SELECT min(k) FROM b WHERE s = (SELECT max(s) FROM b)) AS "best.keys", (SELECT max(s) FROM b) AS best, (SELECT min(k) FROM b WHERE n = (SELECT min(n) FROM b)) AS "least.keys", (SELECT min(n) FROM b) AS least""", ("best",)),
    # predicates
    "pred_compare": Query(
        "SELECT o_orderkey FROM orders WHERE (o_totalprice >= 400000 AND o_orderstatus = 'F') OR (o_totalprice < 5000 AND NOT o_orderpriority = '5-LOW')",
        "SELECT o_orderkey FROM orders WHERE (o_totalprice >= 400000 AND o_orderstatus = 'F') OR (o_totalprice < 5000 AND o_orderpriority <> '5-LOW')"),
    "pred_not_two_valued": Query("SELECT o_orderkey FROM sparse WHERE prio <> '1-URGENT'", f"SELECT o_orderkey FROM {_SPARSE} WHERE prio IS DISTINCT FROM '1-URGENT'"),
    "pred_not_range_turns": Query("SELECT o_orderkey FROM sparse WHERE NOT (price > 200000)", f"SELECT o_orderkey FROM {_SPARSE} WHERE price <= 200000"),
    "pred_between": Query(
        "SELECT o_orderkey FROM sparse WHERE price NOT BETWEEN 50000 AND 450000 AND o_orderdate BETWEEN '1995-01-01' AND '1996-12-31'",
        f"SELECT o_orderkey FROM {_SPARSE} WHERE NOT coalesce(price BETWEEN 50000 AND 450000, false) AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'"),
    "pred_in": Query("SELECT n_name FROM nation WHERE n_nationkey IN (1, 3, 5) OR n_name IN ('NATION_7', 'NATION_9')", "SELECT n_name FROM nation WHERE n_nationkey IN (1, 3, 5) OR n_name IN ('NATION_7', 'NATION_9')"),
    "pred_not_in": Query("SELECT o_orderkey FROM sparse WHERE prio NOT IN ('1-URGENT', '2-HIGH')", f"SELECT o_orderkey FROM {_SPARSE} WHERE prio IS NULL OR prio NOT IN ('1-URGENT', '2-HIGH')"),
    "pred_null": Query("SELECT o_orderkey FROM sparse WHERE prio IS NULL OR price IS NOT missing AND price < 3000", f"SELECT o_orderkey FROM {_SPARSE} WHERE prio IS NULL OR price IS NOT NULL AND price < 3000"),
    "pred_like": Query("SELECT c_custkey FROM customer WHERE c_name LIKE '%_1_%' AND c_mktsegment NOT LIKE 'B%'", "SELECT c_custkey FROM customer WHERE c_name LIKE '%_1_%' AND c_mktsegment NOT LIKE 'B%'"),
    "pred_regexp": Query("SELECT p_partkey FROM part WHERE p_brand = REGEXP_QUERY('Brand#[1-2].*') AND p_type <> regexp('.*A.*')", "SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, 'Brand#[1-2].*') AND NOT regexp_full_match(p_type, '.*A.*')"),
    "pred_terms": Query("SELECT o_orderkey FROM orders WHERE o_orderstatus = IN_TERMS(F,P) AND o_orderpriority = term('1-URGENT') AND o_orderkey <> IDS_QUERY(1)", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority = '1-URGENT' AND o_orderkey <> 1"),
    "pred_ids": Query("SELECT o_orderkey FROM order_tree WHERE _id = IDS_QUERY(1,2,3,77)", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (1, 2, 3, 77)"),
    "pred_case_in": Query(
        "SELECT o_orderkey FROM orders WHERE CASE WHEN o_totalprice > 400000 THEN 'a' WHEN o_totalprice > 300000 THEN 'b' ELSE 'c' END IN ('a', 'b')",
        "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000"),
    "pred_field_field": Query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = l_linenumber AND l_tax >= l_discount AND 1 = 1", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = l_linenumber AND l_tax >= l_discount"),
    "pred_function": Query(
        "SELECT o_orderkey FROM orders WHERE floor(o_totalprice) % 1000 = 7 AND cast(o_custkey as string) LIKE '1%' AND substring(o_orderpriority,0,1) <> '1'",
        "SELECT o_orderkey FROM orders WHERE floor(o_totalprice) % 1000 = 7 AND CAST(o_custkey AS VARCHAR) LIKE '1%' AND substring(o_orderpriority, 1, 1) <> '1'"),
    "pred_subquery_in": Query(
        "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 420000)",
        "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 420000)"),
    "pred_subquery_not_in_nulls": Query(
        "SELECT o_orderkey FROM sparse WHERE prio NOT IN (SELECT prio FROM sparse WHERE price > 499000) AND o_custkey = IN_TERMS(SELECT c_custkey FROM customer WHERE c_acctbal > 8000)",
        f"SELECT o_orderkey FROM {_SPARSE} WHERE (prio IS NULL OR prio NOT IN (SELECT prio FROM {_SPARSE} WHERE price > 499000 AND prio IS NOT NULL)) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 8000)"),
    "pred_subquery_or": Query(
        "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) OR c_acctbal < 0",
        "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) OR c_acctbal < 0"),
    "pred_script": Query("SELECT o_orderkey FROM orders WHERE script('doc[\\'o_totalprice\\'].value > limit && o_totalprice < 400000','limit'=250000)", "SELECT o_orderkey FROM orders WHERE o_totalprice > 250000 AND o_totalprice < 400000"),
    "pred_odbc_time": Query("SELECT o_orderkey FROM orders WHERE o_orderdate < {ts '1995-02-01 00:00:00.000'}", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-02-01'"),
    "min_score": Query(
        "SELECT /*! MIN_SCORE(2) */ doc_id FROM documents WHERE text = score(matchQuery('thing'),3) OR text = score(matchQuery('other'),1)",
        f"SELECT doc_id FROM {_TOKENS} WHERE list_contains(t, 'thing')"),
    # scalars
    "scalar_math": Query(
        "SELECT o_orderkey, abs(0 - o_totalprice) AS a, round(o_totalprice / 7, 2) AS r, floor(o_totalprice) AS f, ceil(o_totalprice) AS c, sqrt(o_totalprice) AS q, pow(o_custkey, 2) AS p, log10(o_totalprice) AS l, log(2, o_totalprice) AS l2, o_orderkey % 7 AS m, max_bw(o_orderkey, o_custkey) AS mx, min_bw(o_orderkey, o_custkey) AS mn, cbrt(o_totalprice) AS cb, round(0 - 2.5) AS h FROM orders",
        "SELECT o_orderkey, abs(o_totalprice) AS a, floor(o_totalprice / 7 * 100 + 0.5) / 100 AS r, floor(o_totalprice) AS f, ceil(o_totalprice) AS c, sqrt(o_totalprice) AS q, pow(o_custkey, 2) AS p, log10(o_totalprice) AS l, ln(o_totalprice) / ln(2) AS l2, o_orderkey % 7 AS m, greatest(o_orderkey, o_custkey) AS mx, least(o_orderkey, o_custkey) AS mn, cbrt(o_totalprice) AS cb, CAST(-2 AS BIGINT) AS h FROM orders",
        ("a", "r", "q", "l", "l2", "cb")),
    "scalar_calls": Query(
        "SELECT o_orderkey, log2(o_custkey + 1) AS l2, exp(o_custkey % 10) AS e, rint(o_totalprice) AS ri, add(o_orderkey, 5) AS a, subtract(o_orderkey, o_custkey) AS s, multiply(o_custkey, 3) AS m, divide(o_orderkey, 4) AS d, modulus(o_orderkey, 9) AS r, field(o_orderstatus) AS f FROM orders",
        "SELECT o_orderkey, log2(o_custkey + 1) AS l2, exp(o_custkey % 10) AS e, round_even(o_totalprice, 0) AS ri, o_orderkey + 5 AS a, o_orderkey - o_custkey AS s, o_custkey * 3 AS m, o_orderkey / 4 AS d, o_orderkey % 9 AS r, o_orderstatus AS f FROM orders",
        ("l2", "e", "ri", "d")),
    "scalar_string": Query(
        "SELECT p_partkey, substring(p_name,1,4) AS s, concat_ws('-', p_brand, p_type) AS c, split(p_brand, '#')[1] AS b, trim(concat_ws('', '  ', p_brand, ' ')) AS t FROM part",
        "SELECT p_partkey, substring(p_name, 2, 3) AS s, p_brand || '-' || p_type AS c, string_split(p_brand, '#')[2] AS b, trim(p_brand) AS t FROM part"),
    "scalar_date": Query(
        "SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM') AS m, from_unixtime(o_orderkey * 1000, 'yyyy-MM-dd HH:mm', '+08:00') AS u, date_format(date_add(o_orderdate, interval 40 day), 'yyyy-MM-dd') AS d FROM orders",
        "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS m, strftime(TIMESTAMP '1970-01-01 08:00:00' + to_seconds(o_orderkey * 1000), '%Y-%m-%d %H:%M') AS u, strftime(o_orderdate + INTERVAL 40 DAY, '%Y-%m-%d') AS d FROM orders"),
    "scalar_case": Query(
        "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' OR o_totalprice BETWEEN 1 AND 5000 THEN 'x' WHEN o_orderpriority IN ('1-URGENT') THEN 'y' ELSE 'z' END AS k, if(o_totalprice > 200000, 'hi', 'lo') AS i, case_new(o_orderstatus = 'O', 1, o_orderstatus = 'P', 2, default, 3) AS n FROM orders",
        "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' OR o_totalprice BETWEEN 1 AND 5000 THEN 'x' WHEN o_orderpriority = '1-URGENT' THEN 'y' ELSE 'z' END AS k, CASE WHEN o_totalprice > 200000 THEN 'hi' ELSE 'lo' END AS i, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END AS n FROM orders"),
    "scalar_cast": Query(
        "SELECT l_orderkey, l_linenumber, cast(l_quantity as int) AS i, cast(l_partkey as string) AS s, cast('12.7' as long) AS g, cast('x' as double) AS d FROM lineitem",
        "SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity) AS INTEGER) AS i, CAST(l_partkey AS VARCHAR) AS s, CAST(12 AS BIGINT) AS g, CAST(NULL AS DOUBLE) AS d FROM lineitem"),
    "scalar_parse": Query(
        "SELECT c_custkey, parse(c_name, 'Customer#0*([0-9]+)', 'none') AS n, parse(c_name, 'x(.*)', 'none') AS o, coalesce(null, c_mktsegment) AS s FROM customer",
        "SELECT c_custkey, regexp_extract(c_name, '^Customer#0*([0-9]+)$', 1) AS n, 'none' AS o, c_mktsegment AS s FROM customer"),
    "projection_include": Query("SELECT include('o_*'), exclude('*date','*price') FROM orders", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders"),
    # joins and sets
    "join_inner": Query(
        "SELECT c.c_name, o.o_orderkey, o.o_totalprice AS price FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 450000 AND c.c_mktsegment = 'BUILDING'",
        'SELECT c.c_name AS "c.c_name", o.o_orderkey AS "o.o_orderkey", o.o_totalprice AS price FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 450000 AND c.c_mktsegment = \'BUILDING\''),
    "join_left": Query(
        "SELECT c.c_custkey AS k, o.o_orderkey AS o FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey",
        "SELECT c_custkey AS k, o_orderkey AS o FROM customer LEFT JOIN orders ON c_custkey = o_custkey"),
    "join_or": Query(
        "SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a JOIN region b ON a.n_regionkey = b.r_regionkey OR a.n_nationkey = b.r_regionkey",
        "SELECT n_nationkey AS a, r_regionkey AS b FROM nation JOIN region ON n_regionkey = r_regionkey OR n_nationkey = r_regionkey"),
    "join_or_large": Query(
        "SELECT c.c_custkey AS k, o.o_orderkey AS o FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey OR c.c_custkey = o.o_orderkey",
        "SELECT c_custkey AS k, o_orderkey AS o FROM customer JOIN orders ON c_custkey = o_custkey OR c_custkey = o_orderkey"),
    "join_tables_limit": Query(
        "SELECT /*! JOIN_TABLES_LIMIT(2, null) */ a.r_regionkey AS a, COUNT(*) AS n FROM region a JOIN nation b GROUP BY a.r_regionkey",
        'SELECT a.r_regionkey AS a, count(*) AS n FROM (SELECT * FROM region WHERE r_regionkey < 2) a, nation b GROUP BY 1'),
    "join_geo": Query(
        "SELECT a.c_custkey AS a, b.c_custkey AS b FROM areas a JOIN areas b ON GEO_INTERSECTS(a.area, b.area) WHERE a.c_custkey < b.c_custkey",
        f"WITH p AS (SELECT * FROM {_PLACES} WHERE abs(lon) < 20 AND abs(lat) < 20) SELECT a.c_custkey AS a, b.c_custkey AS b FROM p a JOIN p b ON a.c_custkey < b.c_custkey AND abs(a.lon - b.lon) <= 4 AND abs(a.lat - b.lat) <= 4"),
    "join_theta": Query(
        "SELECT /*! USE_NL */ a.n_nationkey AS a, b.r_regionkey AS b FROM nation a JOIN region b ON b.r_regionkey < a.n_regionkey",
        "SELECT n_nationkey AS a, r_regionkey AS b FROM nation JOIN region ON r_regionkey < n_regionkey"),
    "join_cross": Query("SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b", "SELECT a.r_name AS a, b.r_name AS b FROM region a, region b"),
    "join_nullsafe": Query(
        "SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM sparse a JOIN sparse b ON a.prio = b.prio AND a.o_custkey = b.o_custkey",
        f"SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM {_SPARSE.replace(') sparse', ') a')} JOIN {_SPARSE.replace(') sparse', ') b')} ON a.prio IS NOT DISTINCT FROM b.prio AND a.o_custkey = b.o_custkey"),
    "join_subquery": Query(
        "SELECT c.c_custkey AS k, n.n_name AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%') AND c.c_acctbal > 9000",
        "SELECT c_custkey AS k, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%') AND c_acctbal > 9000"),
    "union_all": Query("SELECT n_name AS name FROM nation UNION SELECT r_name AS name FROM region UNION ALL SELECT n_name AS name FROM nation WHERE n_nationkey < 3", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation WHERE n_nationkey < 3"),
    "minus": Query("SELECT prio, o_custkey FROM sparse MINUS SELECT prio, o_custkey FROM sparse WHERE price > 100000", f"SELECT prio, o_custkey FROM {_SPARSE} EXCEPT SELECT prio, o_custkey FROM {_SPARSE} WHERE price > 100000"),
    "intersect": Query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 INTERSECT SELECT s_nationkey AS k FROM supplier", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 INTERSECT SELECT s_nationkey FROM supplier"),
    "comma_from_union": Query("SELECT n_name, r_name FROM nation, region", "SELECT n_name, NULL AS r_name FROM nation UNION ALL SELECT NULL, r_name FROM region"),
    # nested and child rows
    "nested_match": Query(
        "SELECT o_orderkey FROM order_docs WHERE nested('lines', lines.l_returnflag = 'R' AND lines.l_quantity > 45) AND NOT nested(lines.l_linenumber = 7)",
        f"SELECT o_orderkey FROM {_FLAT} GROUP BY 1 HAVING bool_or(l_returnflag = 'R' AND l_quantity > 45) AND NOT bool_or(l_linenumber = 7)"),
    "nested_agg": Query("SELECT COUNT(*) AS n, SUM(nested(lines.l_quantity)) AS q FROM order_docs GROUP BY nested(lines.l_returnflag) ", f'SELECT l_returnflag AS "nested(lines.l_returnflag)", count(*) AS n, sum(l_quantity) AS q FROM {_FLAT} GROUP BY 1'),
    "nested_histogram": Query(
        "SELECT COUNT(*) AS n FROM order_docs GROUP BY histogram('field'='lines.l_quantity','nested'='lines','interval'='10','alias'='h')",
        f"SELECT floor(l_quantity / 10) * 10 AS h, count(*) AS n FROM {_FLAT} GROUP BY 1"),
    "nested_other_path": Query(
        "SELECT COUNT(*) AS n FROM order_docs GROUP BY nested(lines.l_returnflag), filter('late', lines.l_linenumber > 5), reverse_nested(lines.l_linestatus,'~lines')",
        f"""WITH a AS (SELECT DISTINCT o_orderkey, l_returnflag FROM {_FLAT} WHERE l_linenumber > 5), b AS (SELECT o_orderkey, l_linestatus FROM {_FLAT})
 SELECT l_returnflag AS "nested(lines.l_returnflag)", l_linestatus AS "reverse_nested(lines.l_linestatus,'~lines')", count(*) AS n FROM a JOIN b USING (o_orderkey) GROUP BY 1, 2"""),
    "nested_metric": Query("SELECT SUM(nested(lines.l_quantity)) AS q, MAX(nested(lines.l_linenumber)) AS m FROM order_docs GROUP BY o_orderstatus", f"SELECT o_orderstatus, sum(l_quantity) AS q, CAST(max(l_linenumber) AS DOUBLE) AS m FROM {_FLAT} GROUP BY 1", ("q",)),
    "reverse_nested": Query(
        "SELECT COUNT(*) AS n FROM order_docs GROUP BY nested(lines.l_returnflag), reverse_nested(o_orderstatus)",
        f'SELECT l_returnflag AS "nested(lines.l_returnflag)", o_orderstatus AS "reverse_nested(o_orderstatus)", count(DISTINCT o_orderkey) AS n FROM {_FLAT} GROUP BY 1, 2'),
    "children_match": Query(
        "SELECT o_orderkey FROM order_tree WHERE children(line, l_quantity > 49 AND l_returnflag = 'A') AND NOT children(line, l_linenumber) = 6",
        "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49 AND l_returnflag = 'A') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 6)"),
    "children_agg": Query(
        "SELECT SUM(children(line, l_quantity)) AS q, COUNT(*) AS n FROM order_tree GROUP BY o_orderstatus, children(line, l_returnflag)",
        f'SELECT o_orderstatus, l_returnflag AS "children(line,l_returnflag)", sum(l_quantity) AS q, count(*) AS n FROM {_FLAT} GROUP BY 1, 2'),
    # text
    "text_match": Query("SELECT doc_id FROM documents WHERE text = matchQuery('thing with',operator='and')", f"SELECT doc_id FROM {_TOKENS} WHERE list_contains(t, 'thing') AND list_contains(t, 'with')"),
    "text_equals_phrase": Query("SELECT doc_id FROM documents WHERE text = 'of the'", f"SELECT doc_id FROM {_TOKENS} WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' of the ')"),
    "text_phrase_prefix": Query("SELECT doc_id FROM documents WHERE text = match_phrase_prefix(query='of th')", f"SELECT doc_id FROM {_TOKENS} WHERE contains(' ' || array_to_string(t, ' '), ' of th')"),
    "text_multi_match": Query("SELECT doc_id FROM documents WHERE q = multi_match(query='src3 thing',fields='text,source')", f"SELECT doc_id FROM {_TOKENS} WHERE list_has_any(t, ['src3', 'thing']) OR source = 'src3'"),
    "text_wildcard": Query("SELECT doc_id FROM documents WHERE text = wildcardQuery('thin?s*')", f"SELECT doc_id FROM {_TOKENS} WHERE len(list_filter(t, lambda w: regexp_full_match(w, 'thin.s.*'))) > 0"),
    "text_query_string": Query(
        "SELECT doc_id FROM documents WHERE q = query('text:(thing OR with) AND -source:src0')",
        f"SELECT doc_id FROM {_TOKENS} WHERE list_has_any(t, ['thing', 'with']) AND source <> 'src0'"),
    "text_span_near": Query(
        "SELECT doc_id FROM documents WHERE q = span_near(slop=2,in_order=true,clauses='[{\"span_term\":{\"text\":\"of\"}},{\"span_term\":{\"text\":\"the\"}}]')",
        f"SELECT doc_id FROM {_TOKENS} WHERE regexp_matches(' ' || array_to_string(t, '  ') || ' ', ' of (?: [^ ]+ ){{0,2}} the ')"),
    "text_bm25_topk": Query("SELECT doc_id, _score FROM documents WHERE text = matchQuery('thing that') ORDER BY _score DESC, doc_id LIMIT 20", _bm25(["thing", "that"], "list_has_any(t, ['thing', 'that'])", 20), ("_score",)),
    # places
    "geo_bbox": Query("SELECT c_custkey FROM places WHERE GEO_BOUNDING_BOX(center,-60.0,40.0,70.5,-10.5)", f"SELECT c_custkey FROM {_PLACES} WHERE lon BETWEEN -60 AND 70.5 AND lat BETWEEN -10.5 AND 40"),
    "geo_distance": Query(
        "SELECT c_custkey FROM places WHERE GEO_DISTANCE(center,'2500km',10.0,20.0)",
        f"SELECT c_custkey FROM {_PLACES} WHERE 2 * 6371008.8 * asin(sqrt(least(1, pow(sin((radians(lat) - radians(20)) / 2), 2) + cos(radians(lat)) * cos(radians(20)) * pow(sin(radians(lon - 10) / 2), 2)))) <= 2500000"),
    "geo_polygon": Query(
        "SELECT c_custkey FROM places WHERE GEO_POLYGON(center,-100.05,-50.05,100.05,-50.05,0.05,60.05)",
        f"SELECT c_custkey FROM {_PLACES} WHERE lat >= -50.05 AND (lon + 100.05) * 110.1 - (lat + 50.05) * 100.1 >= 0 AND (100.05 - lon) * 110.1 - (lat + 50.05) * 100.0 >= 0"),
    "geohash_grid": Query(
        "SELECT COUNT(*) AS n FROM places GROUP BY geohash_grid(field='center',precision=1,alias='cell')",
        f"""SELECT substring('0123456789bcdefghjkmnpqrstuvwxyz', CAST(1 + (x // 4) * 16 + (y // 2) * 8 + (x // 2 % 2) * 4 + (y % 2) * 2 + x % 2 AS INTEGER), 1) AS cell, count(*) AS n
 FROM (SELECT CAST(least(floor((lon + 180) / 45), 7) AS INTEGER) AS x, CAST(least(floor((lat + 90) / 45), 3) AS INTEGER) AS y FROM {_PLACES}) GROUP BY 1"""),
    "geo_bounds": Query(
        "SELECT * FROM places GROUP BY c_mktsegment, geo_bounds(field='center',alias='b')",
        f'SELECT c_mktsegment, min(lon) AS "b.topLeft.lon", max(lat) AS "b.topLeft.lat", max(lon) AS "b.bottomRight.lon", min(lat) AS "b.bottomRight.lat" FROM {_PLACES} GROUP BY 1'),
    "geo_intersects": Query(
        "SELECT c_custkey FROM areas WHERE GEO_INTERSECTS(area,'POLYGON ((-5.05 -5.05, 7.05 -5.05, 7.05 3.05, -5.05 3.05, -5.05 -5.05))')",
        f"SELECT c_custkey FROM {_PLACES} WHERE abs(lon) < 20 AND abs(lat) < 20 AND lon + 2 >= -5.05 AND lon - 2 <= 7.05 AND lat + 2 >= -5.05 AND lat - 2 <= 3.05"),
    "geo_distance_range": Query(
        "SELECT c_custkey FROM places WHERE GEO_DISTANCE_RANGE(center,'1000km','4000km',10.0,20.0)",
        f"SELECT c_custkey FROM {_PLACES} WHERE 2 * 6371008.8 * asin(sqrt(least(1, pow(sin((radians(lat) - radians(20)) / 2), 2) + cos(radians(lat)) * cos(radians(20)) * pow(sin(radians(lon - 10) / 2), 2)))) BETWEEN 1000000 AND 4000000"),
    # order and pages
    "order_nested": Query(
        "SELECT o_orderkey FROM order_docs ORDER BY NESTED('lines.l_quantity','lines') DESC, o_orderkey LIMIT 60",
        f"SELECT o_orderkey FROM {_FLAT} GROUP BY 1 ORDER BY max(l_quantity) DESC, 1 LIMIT 60"),
    "collapse_inner_hits": Query(
        "SELECT /*! COLLAPSE({\"field\":\"o_orderstatus\",\"inner_hits\":{\"name\":\"h\",\"size\":2,\"sort\":[{\"o_totalprice\":\"asc\"}]}}) */ o_orderstatus, o_orderkey, h FROM orders ORDER BY o_orderkey",
        """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS a, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) AS b FROM orders)
 SELECT x.o_orderstatus, x.o_orderkey, (SELECT CAST(to_json(list(y.o_orderkey ORDER BY y.b)) AS VARCHAR) FROM r y WHERE y.o_orderstatus = x.o_orderstatus AND y.b <= 2) AS h FROM r x WHERE x.a = 1""", picked=("h", "o_orderkey")),
    "order_limit_offset": Query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20, 15", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 20"),
    "order_nulls_last": Query("SELECT o_orderkey FROM sparse ORDER BY price DESC, o_orderkey", f"SELECT o_orderkey FROM {_SPARSE} ORDER BY price DESC NULLS LAST, o_orderkey"),
    "order_field_sort_missing": Query("SELECT o_orderkey FROM sparse ORDER BY field_sort(price,missing=1000000) DESC, o_orderkey LIMIT 40", f"SELECT o_orderkey FROM {_SPARSE} ORDER BY coalesce(price, 1000000) DESC, o_orderkey LIMIT 40"),
    "order_case": Query("SELECT o_orderkey FROM orders ORDER BY CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END, o_orderkey LIMIT 25", "SELECT o_orderkey FROM orders ORDER BY CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END, o_orderkey LIMIT 25"),
    "search_after": Query("SELECT /*! SEARCH_AFTER(400000, 7) */ o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30", "SELECT o_orderkey FROM orders WHERE o_totalprice < 400000 OR (o_totalprice = 400000 AND o_orderkey > 7) ORDER BY o_totalprice DESC, o_orderkey LIMIT 30"),
    "collapse": Query(
        "SELECT /*! COLLAPSE({\"field\":\"o_custkey\"}) */ o_custkey, o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey",
        "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1"),
    "post_filter": Query("SELECT /*! POST_FILTER({\"bool\":{\"must\":[{\"term\":{\"o_orderstatus\":\"F\"}}],\"must_not\":[{\"range\":{\"o_totalprice\":{\"gte\":20000}}}]}}) */ o_orderkey FROM orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 20000"),
    "highlight": Query(
        "SELECT /*! HIGHLIGHT(text,pre_tags : ['<b>'], post_tags : ['</b>']) */ doc_id FROM documents WHERE text = matchQuery('thing')",
        f"SELECT doc_id, regexp_replace(text, '(?i)\\b(thing)\\b', '<b>\\1</b>', 'g') AS \"text.highlight\" FROM (SELECT doc_id, text, {_WORDS} AS t FROM documents) WHERE list_contains(t, 'thing')"),
    "runtime_mapping": Query("SELECT /*! RUNTIME_MAPPINGS({\"half\":{\"type\":\"double\",\"script\":{\"source\":\"emit(o_totalprice / 2)\"}}}) */ o_orderkey, half FROM orders WHERE half > 200000", "SELECT o_orderkey, o_totalprice / 2 AS half FROM orders WHERE o_totalprice / 2 > 200000", ("half",)),
    "select_distinct": Query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
    # other statements
    "show_mapping": Query("SHOW nation", "SELECT 'nation' AS \"table\", * FROM (VALUES ('n_nationkey', 'integer'), ('n_name', 'keyword'), ('n_regionkey', 'integer')) t(field, type)"),
    "delete_rows": Query("DELETE FROM orders WHERE o_totalprice < 100000 AND o_orderstatus <> 'F'", "SELECT count(*) AS deleted FROM orders WHERE o_totalprice < 100000 AND o_orderstatus <> 'F'"),
}


FLAGSHIP = "SELECT o_orderstatus, COUNT(*) AS c, SUM(o_totalprice) AS s FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus ORDER BY c DESC LIMIT 10"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, q in QUERIES.items() if (sql := q.oracle()) is not None}
