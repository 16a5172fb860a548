"""One query for each relational, window, set, nested, function and streaming construct, with SQL that DuckDB runs.

Where the two engines read the same SQL alike, one text serves both.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataflow.functions import udfs
from strataflow.operators import joins, sessions, windows
from strataflow.sources import tables
from strataflow.streaming import events as streams

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def both(name: str, sql: str, duck: str | None = None) -> None:
    """Register a query in SQL; duck: the text for DuckDB where it differs."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables.register(spark, sf_dir, used)
        return spark.sql(sql)

    QUERIES[name], ORACLES[name] = run, duck or sql


def frame(duck: str | None) -> Callable[[Query], Query]:
    """Register a query on DataFrames under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if duck:
            ORACLES[f.__name__] = duck
        return f

    return add


REVENUE = "round(sum(l_extendedprice * (1 - l_discount)), 2)"

# projections, filters, aggregates
both("filter_project", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS double_quantity FROM lineitem WHERE l_quantity < 5 AND l_returnflag IN ('A', 'R') AND l_discount BETWEEN 0.02 AND 0.06")
both("like_case", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS size_class FROM part WHERE p_type LIKE '%A%' OR p_brand IS NULL")
both("pricing_summary", f"SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, {REVENUE} AS revenue, round(avg(l_discount), 4) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")
both("aggregate_filter_having", "SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, round(max(o_totalprice), 2) AS top FROM orders GROUP BY o_custkey HAVING count(*) > 12")
both("count_distinct_two", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
both("grouping_sets", "SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus) AS g, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())", "SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus)::TINYINT AS g, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
both("rollup_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
both("cube_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
both("statistics", "SELECT l_returnflag, round(stddev_samp(l_quantity), 4) AS sd, round(var_pop(l_quantity), 4) AS vp, round(corr(l_quantity, l_extendedprice), 4) AS r, round(covar_pop(l_quantity, l_discount), 4) AS cov, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY l_returnflag")
both("median_exact", "SELECT o_orderpriority, round(percentile(o_totalprice, 0.5), 2) AS med FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 2) AS med FROM orders GROUP BY o_orderpriority")
both("collect_sorted", "SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
both("bool_and_max_by", "SELECT o_custkey, bool_and(o_totalprice > 1000) AS all_large, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS top_order FROM orders GROUP BY o_custkey", "SELECT o_custkey, bool_and(o_totalprice > 1000) AS all_large, max_by(o_orderkey, (o_totalprice, o_orderkey)) AS top_order FROM orders GROUP BY o_custkey")
both("global_aggregate", "SELECT count(*) AS n, round(sum(l_tax), 2) AS tax, min(l_shipdate) AS first_ship FROM lineitem")

# joins
both("revenue_by_nation", f"SELECT c_mktsegment, n_name, {REVENUE} AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY c_mktsegment, n_name")
both("left_join_nulls", "SELECT o_orderkey, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 45 GROUP BY o_orderkey")
both("full_outer", "SELECT coalesce(a.k, b.k) AS k, a.n AS n_cust, b.n AS n_supp FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey < 15 GROUP BY c_nationkey) a FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 8 GROUP BY s_nationkey) b ON a.k = b.k")
both("semi_exists", "SELECT o_orderkey, o_orderpriority FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49)")
both("anti_not_exists", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
both("not_in", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
both("not_in_nulls", "SELECT p.k, q.k AS kept FROM (SELECT DISTINCT o_orderstatus AS k FROM orders) p LEFT JOIN (SELECT DISTINCT o_orderstatus AS k FROM orders WHERE nullif(o_orderstatus, 'F') NOT IN (SELECT nullif(o_orderstatus, 'O') FROM orders WHERE o_orderstatus <> 'F')) q ON p.k = q.k")
both("not_in_null_left", "SELECT count(*) AS n FROM customer WHERE nullif(c_nationkey, 3) NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
both("self_join", "SELECT a.n_name AS one, b.n_name AS two FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
both("null_safe_join", "SELECT count(*) AS n FROM (SELECT nullif(c_nationkey, 3) AS k FROM customer) c JOIN (SELECT nullif(n_nationkey, 3) AS k FROM nation) n ON c.k IS NOT DISTINCT FROM n.k")
both("scalar_subquery", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part) AND p_size = (SELECT max(p_size) FROM part)")
both("correlated_subquery", "SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS n_lines FROM supplier")
both("lateral_join", "SELECT r_name, t.n FROM region, LATERAL (SELECT count(*) AS n FROM nation WHERE n_regionkey = r_regionkey) t")
both("using_values", "SELECT r_name, v.label FROM region JOIN (VALUES (0, 'zero'), (1, 'one'), (9, 'nine')) AS v(r_regionkey, label) USING (r_regionkey)")

both("right_join", "SELECT n_name, count(s_suppkey) AS suppliers FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY n_name")
both("cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE r_regionkey <> n_regionkey")
both("merge_hint", "SELECT /*+ MERGE(s) */ s_suppkey, n_name FROM supplier s JOIN nation ON s_nationkey = n_nationkey", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
both("shuffle_hash_hint", "SELECT /*+ SHUFFLE_HASH(c) */ o_orderkey, c_mktsegment FROM orders JOIN customer c ON o_custkey = c_custkey", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
both("semi_anti_nulls", "SELECT 'semi' AS kind, count(*) AS n FROM (SELECT nullif(c_nationkey, 3) AS k FROM customer) c LEFT SEMI JOIN (SELECT nullif(n_nationkey, 5) AS k FROM nation) n ON c.k = n.k UNION ALL SELECT 'anti', count(*) FROM (SELECT nullif(c_nationkey, 3) AS k FROM customer) c LEFT ANTI JOIN (SELECT nullif(n_nationkey, 5) AS k FROM nation) n ON c.k = n.k", "SELECT 'semi' AS kind, count(*) AS n FROM (SELECT nullif(c_nationkey, 3) AS k FROM customer) c SEMI JOIN (SELECT nullif(n_nationkey, 5) AS k FROM nation) n ON c.k = n.k UNION ALL SELECT 'anti', count(*) FROM (SELECT nullif(c_nationkey, 3) AS k FROM customer) c ANTI JOIN (SELECT nullif(n_nationkey, 5) AS k FROM nation) n ON c.k = n.k")
both("lateral_top", "SELECT n_name, t.s_name FROM nation, LATERAL (SELECT s_name FROM supplier WHERE s_nationkey = n_nationkey ORDER BY s_acctbal DESC, s_suppkey LIMIT 2) t")

# more aggregates
both("group_by_all", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
both("listagg_ordered", "SELECT n_regionkey, listagg(n_name, ';') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
both("max_string", "SELECT c_mktsegment, max(c_name) AS last_name, min(c_name) AS first_name FROM customer GROUP BY c_mktsegment")
both("grouping_id", "SELECT l_returnflag, l_linestatus, cast(grouping_id(l_returnflag, l_linestatus) AS int) AS gid, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus)::INT AS gid, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
both("mode_median", "SELECT p_brand, median(p_size) AS med, mode(p_type, true) AS often FROM part GROUP BY p_brand", "SELECT p_brand, median(p_size) AS med, (SELECT p_type FROM part q WHERE q.p_brand = p.p_brand GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 1) AS often FROM part p GROUP BY p_brand")
both("shape_statistics", "SELECT l_returnflag, round(skewness(l_extendedprice), 5) AS skew, round(kurtosis(l_extendedprice), 5) AS kurt, round(stddev_pop(l_tax), 6) AS sd FROM lineitem GROUP BY l_returnflag", "WITH m AS (SELECT l_returnflag AS f, avg(l_extendedprice) AS a FROM lineitem GROUP BY 1), c AS (SELECT f, avg((l_extendedprice - a) ** 2) AS m2, avg((l_extendedprice - a) ** 3) AS m3, avg((l_extendedprice - a) ** 4) AS m4, stddev_pop(l_tax) AS sd FROM lineitem JOIN m ON l_returnflag = f GROUP BY f) SELECT f AS l_returnflag, round(m3 / m2 ** 1.5, 5) AS skew, round(m4 / m2 ** 2 - 3, 5) AS kurt, round(sd, 6) AS sd FROM c")
both("percentiles", "SELECT l_returnflag, round(percentile(l_quantity, 0.25), 4) AS q1, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS p90, percentile_disc(0.5) WITHIN GROUP (ORDER BY l_quantity) AS d50 FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(quantile_cont(l_quantity, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, quantile_disc(l_quantity, 0.5) AS d50 FROM lineitem GROUP BY l_returnflag")
both("null_aggregates", "SELECT c_mktsegment, count(v) AS n, sum(v) AS total, avg(v) AS mean, max(v) AS top FROM (SELECT c_mktsegment, CASE WHEN c_mktsegment <> 'BUILDING' THEN nullif(c_nationkey, 3) END AS v FROM customer) c GROUP BY c_mktsegment", "SELECT c_mktsegment, count(v) AS n, sum(v)::BIGINT AS total, avg(v) AS mean, max(v) AS top FROM (SELECT c_mktsegment, CASE WHEN c_mktsegment <> 'BUILDING' THEN nullif(c_nationkey, 3) END AS v FROM customer) c GROUP BY c_mktsegment")

# set operations, order, CTEs
both("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
both("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
both("intersect_rows", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
both("except_rows", "SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
both("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
both("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
both("order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
both("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25")
both("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
both("cte_chain", "WITH spend AS (SELECT o_custkey AS k, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), top AS (SELECT k FROM spend WHERE total > 1000000) SELECT c_mktsegment, count(*) AS n FROM customer JOIN top ON c_custkey = k GROUP BY c_mktsegment")
both("recursive_cte", "WITH RECURSIVE steps(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM steps WHERE n < 20) SELECT n, total FROM steps")

both("pipe_syntax", "FROM orders |> WHERE o_orderstatus = 'F' |> AGGREGATE count(*) AS n GROUP BY o_orderpriority |> SELECT o_orderpriority, n", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
both("order_nulls", "SELECT k, row_number() OVER (ORDER BY k DESC NULLS LAST) AS at FROM (SELECT DISTINCT nullif(n_regionkey, 2) AS k FROM nation) d", "SELECT k, (row_number() OVER (ORDER BY k DESC NULLS LAST))::INT AS at FROM (SELECT DISTINCT nullif(n_regionkey, 2) AS k FROM nation) d")


@frame("SELECT n_name AS name, n_regionkey AS region, NULL::DOUBLE AS acctbal FROM nation UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = tables.load(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return nations.unionByName(tables.load(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("acctbal"), F.col("s_name").alias("name")), allowMissingColumns=True)


# windows
both("window_ranks", "SELECT c_custkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS quarter FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey)", "SELECT c_custkey, (row_number() OVER w)::INT AS rn, (rank() OVER w)::INT AS rk, (dense_rank() OVER w)::INT AS dr, (ntile(4) OVER w)::INT AS quarter FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey)")
both("window_distribution", "SELECT c_custkey, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)")
both("window_offsets", "SELECT event_id, lag(value, 1) OVER w AS before, lead(value, 2, -1.0D) OVER w AS after, first_value(value) OVER w AS first_v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)", "SELECT event_id, lag(value, 1) OVER w AS before, lead(value, 2, -1.0) OVER w AS after, first_value(value) OVER w AS first_v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
both("window_rows_frame", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 2) AS moving FROM events")
both("window_range_frame", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n_day FROM events")
both("window_ignore_nulls", "SELECT event_id, last_value(v) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY event_id) AS filled FROM (SELECT event_id, user_id, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS v FROM events) e", "SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS filled FROM (SELECT event_id, user_id, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS v FROM events) e")


@frame("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables.load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return windows.top_k(orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


@frame("SELECT c_custkey, c_nationkey FROM customer QUALIFY c_acctbal > avg(c_acctbal) OVER (PARTITION BY c_nationkey)")
def qualify_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return windows.qualify(rows, F.col("c_acctbal") > F.avg("c_acctbal").over(Window.partitionBy("c_nationkey"))).drop("c_acctbal")


@frame("SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING)::BIGINT AS near_size FROM part")
def groups_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tables.load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return windows.groups_frame(part, "p_brand", "p_size", "p_size", 1, 1, "near_size").select("p_partkey", "near_size")


both("nth_values", "SELECT event_id, nth_value(value, 2) OVER w AS second_v, last_value(value) OVER w AS last_v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")


@frame("SELECT p_partkey, (sum(nullif(p_size, 7)) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW))::BIGINT AS others FROM part")
def exclude_current_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tables.load(spark, sf_dir, "part").select("p_partkey", "p_brand", F.nullif("p_size", F.lit(7)).alias("p_size"))
    return windows.exclude_current(part, "p_brand", "p_size", "others").select("p_partkey", "others")


@frame("SELECT p.event_id, p.user_id, v.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.load(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = events.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("view_value"))
    return joins.asof_join(bought, seen, "user_id", "ts", ["view_value"]).select("event_id", "user_id", "view_value")


@frame("SELECT p_partkey, r.label FROM part JOIN (SELECT s_suppkey AS label, 900.0 + s_suppkey % 50 * 20 AS low, 900.0 + s_suppkey % 50 * 20 + 35 AS high FROM supplier) r ON p_retailprice >= low AND p_retailprice < high")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lit(900.0) + F.col("s_suppkey") % 50 * 20
    ranges = tables.load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("label"), low.alias("low"), (low + 35).alias("high"))
    points = tables.load(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return joins.range_join(points, ranges, "p_retailprice", "low", "high", 40.0).select("p_partkey", "label")


@frame("SELECT l_linestatus, s_nationkey, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")
def salted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables.load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus", F.col("l_suppkey").alias("k"))
    suppliers = tables.load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_nationkey")
    return joins.salted_join(lines, suppliers, "k").groupBy("l_linestatus", "s_nationkey").agg(F.count(F.lit(1)).alias("n"))


@frame("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(*) AS n_events, min(ts) AS first_at, max(ts) AS last_at FROM s GROUP BY user_id, k")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessionize(tables.load(spark, sf_dir, "events"), "user_id", "ts", "6 hours")


@frame("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)


@frame("SELECT l_orderkey, l_linenumber, measure, amount FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem) UNPIVOT (amount FOR measure IN (l_quantity, l_tax))")
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables.load(spark, sf_dir, "lineitem")
    return lines.unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"], "measure", "amount")


# nested data, functions
both("json_fields", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
both("variant_fields", "SELECT variant_get(parse_json(props), '$.k', 'int') AS k, count(*) AS n FROM events GROUP BY 1", "SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY 1")
both("array_functions", "SELECT vec_id, size(filter(embedding, x -> x > 0)) AS n_positive, round(aggregate(embedding, 0.0D, (a, x) -> a + x * x), 4) AS norm2, cast(element_at(embedding, 1) AS double) AS first_v FROM embeddings", "SELECT vec_id, len(list_filter(embedding, lambda x: x > 0))::INT AS n_positive, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS norm2, embedding[1]::DOUBLE AS first_v FROM embeddings")
both("explode_words", "SELECT word, count(*) AS n FROM (SELECT explode(split(text, ' ')) AS word FROM benchmark) w GROUP BY word", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM benchmark) w GROUP BY word")
both("posexplode_all", "SELECT vec_id, pos, cast(v AS double) AS v FROM (SELECT vec_id, posexplode(embedding) AS (pos, v) FROM embeddings) e", "SELECT vec_id, (i - 1)::INT AS pos, embedding[i]::DOUBLE AS v FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i)")
both("struct_map", "SELECT n_regionkey, element_at(map_from_entries(array_sort(collect_list(struct(n_nationkey, n_name)))), min(n_nationkey)) AS first_name FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, min_by(n_name, n_nationkey) AS first_name FROM nation GROUP BY n_regionkey")
both("string_functions", "SELECT c_custkey, upper(c_name) AS u, substring(c_name, 1, 4) AS s, length(c_name) AS n, lpad(cast(c_nationkey AS string), 4, '0') AS p, reverse(c_mktsegment) AS r, md5(c_name) AS h, levenshtein(c_mktsegment, 'BUILDING') AS d FROM customer", "SELECT c_custkey, upper(c_name) AS u, substring(c_name, 1, 4) AS s, length(c_name)::INT AS n, lpad(c_nationkey::VARCHAR, 4, '0') AS p, reverse(c_mktsegment) AS r, md5(c_name) AS h, levenshtein(c_mktsegment, 'BUILDING')::INT AS d FROM customer")
both("regex_functions", "SELECT c_custkey, regexp_extract(c_name, '([0-9]+)', 1) AS digits, regexp_replace(c_name, '[0-9]', '#') AS masked, c_name RLIKE '1$' AS ends FROM customer", "SELECT c_custkey, regexp_extract(c_name, '([0-9]+)', 1) AS digits, regexp_replace(c_name, '[0-9]', '#', 'g') AS masked, regexp_matches(c_name, '1$') AS ends FROM customer")
both("url_parts", "SELECT page_id, parse_url(url, 'HOST') AS host FROM pages", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages")
both("date_functions", "SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, date_format(o_orderdate, 'yyyy-MM') AS ym, date_diff(DATE '2002-01-01', o_orderdate) AS age, cast(date_trunc('month', o_orderdate) AS date) AS m FROM orders", "SELECT o_orderkey, year(o_orderdate)::INT AS y, quarter(o_orderdate)::INT AS q, strftime(o_orderdate, '%Y-%m') AS ym, date_diff('day', o_orderdate::DATE, DATE '2002-01-01')::INT AS age, date_trunc('month', o_orderdate)::DATE AS m FROM orders")
both("math_functions", "SELECT p_partkey, round(sqrt(p_retailprice), 4) AS s, abs(p_size - 25) AS a, p_size % 7 AS m, round(ln(p_retailprice), 4) AS l, floor(p_retailprice / 100) AS f, greatest(p_size, 10) AS g FROM part", "SELECT p_partkey, round(sqrt(p_retailprice), 4) AS s, abs(p_size - 25) AS a, p_size % 7 AS m, round(ln(p_retailprice), 4) AS l, floor(p_retailprice / 100)::BIGINT AS f, greatest(p_size, 10) AS g FROM part")
both("null_functions", "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, CASE WHEN nullif(c_nationkey, 3) IS NULL THEN 1 ELSE 0 END AS was_three FROM customer")
both("tumbling_window", "SELECT w.start AS start, event_type, count(*) AS n FROM (SELECT window(ts, '1 day') AS w, event_type FROM events) e GROUP BY w.start, event_type", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
both("conditional_sum", "SELECT user_id, sum(if(event_type = 'purchase', 1, 0)) AS n_buy, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 2) AS spent FROM events GROUP BY user_id", "SELECT user_id, sum(if(event_type = 'purchase', 1, 0))::BIGINT AS n_buy, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 2) AS spent FROM events GROUP BY user_id")


both("from_to_json", "SELECT event_id, from_json(props, 'k INT').k AS k, to_json(named_struct('u', user_id, 'k', from_json(props, 'k INT').k)) AS j, schema_of_json('{\"k\": 1}') AS s FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, '{\"u\":' || user_id || ',\"k\":' || json_extract_string(props, '$.k') || '}' AS j, 'STRUCT<k: BIGINT>' AS s FROM events")
both("array_zip_transform", "SELECT vec_id, round(aggregate(zip_with(transform(embedding, x -> cast(x AS double)), sequence(1, size(embedding)), (x, i) -> x * i), 0.0D, (a, x) -> a + x), 4) AS weighted, exists(embedding, x -> x > 2) AS any_large, cast(array_max(embedding) AS double) AS top FROM embeddings", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * i)), 4) AS weighted, len(list_filter(embedding, lambda x: x > 2)) > 0 AS any_large, list_max(embedding)::DOUBLE AS top FROM embeddings")
both("map_functions", "SELECT n_regionkey, array_join(array_sort(transform(map_keys(map_filter(m, (k, v) -> k % 2 = 0)), x -> cast(x AS string))), ',') AS even_keys, element_at(transform_values(m, (k, v) -> upper(substring(v, 1, 2))), min_key) AS first_two, size(m) AS n FROM (SELECT n_regionkey, map_from_entries(collect_list(struct(n_nationkey, n_name))) AS m, min(n_nationkey) AS min_key FROM nation GROUP BY n_regionkey) g", "SELECT n_regionkey, array_to_string(list_transform(list_sort(list_transform(list(n_nationkey) FILTER (WHERE n_nationkey % 2 = 0), lambda x: x::VARCHAR)), lambda x: x), ',') AS even_keys, upper(substring(min_by(n_name, n_nationkey), 1, 2)) AS first_two, count(*)::INT AS n FROM nation GROUP BY n_regionkey")
both("date_arithmetic", "SELECT o_orderkey, date_add(cast(o_orderdate AS date), 45) AS later, cast(cast(o_orderdate AS date) + INTERVAL 1 MONTH AS date) AS next_month, extract(DOW FROM o_orderdate) AS dow, last_day(o_orderdate) AS month_end FROM orders", "SELECT o_orderkey, o_orderdate::DATE + 45 AS later, (o_orderdate::DATE + INTERVAL 1 MONTH)::DATE AS next_month, (extract(DOW FROM o_orderdate) + 1)::INT AS dow, last_day(o_orderdate) AS month_end FROM orders")
both("hash_functions", "SELECT count(*) AS n, count(DISTINCT xxhash64(c_name, c_custkey)) AS hashes, max(soundex('Robert')) AS code, max(sha2('a', 256)) AS digest FROM customer", "SELECT count(*) AS n, count(DISTINCT (c_name, c_custkey)) AS hashes, 'R163' AS code, sha256('a') AS digest FROM customer")
both("sliding_window", "SELECT w.start AS start, count(*) AS n FROM (SELECT window(ts, '2 days', '1 day') AS w FROM events) e GROUP BY w.start", "SELECT date_trunc('day', ts) - to_days(k) AS start, count(*) AS n FROM events, (VALUES (0), (1)) t(k) GROUP BY ALL")


# sources and sinks: written to the shared folder and read again
for kind in ("orc", "csv", "json", "xml", "parquet"):

    @frame("SELECT s_suppkey, s_name, nullif(s_nationkey, 3) AS s_nationkey, s_acctbal FROM supplier")
    def format_round_trip(spark: SparkSession, sf_dir: str, kind: str = kind) -> DataFrame:
        rows = tables.load(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.nullif("s_nationkey", F.lit(3)).alias("s_nationkey"), "s_acctbal")
        return tables.round_trip(rows, kind)

    QUERIES[f"{kind}_round_trip"], ORACLES[f"{kind}_round_trip"] = QUERIES.pop("format_round_trip"), ORACLES.pop("format_round_trip")


@frame("SELECT p_type || ' ' || p_brand AS value FROM part")
def text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.round_trip(tables.load(spark, sf_dir, "part").select(F.concat_ws(" ", "p_type", "p_brand").alias("value")), "text")


@frame("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def partitioned_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.round_trip(tables.load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "parquet", ("o_orderstatus",))
    return rows.where("o_orderstatus IN ('F', 'O')").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@frame("SELECT n_regionkey, sum(octet_length(encode(n_name)) + 1)::BIGINT AS bytes FROM nation GROUP BY 1")
def binary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.shared_folder(spark)
    tables.save(tables.load(spark, sf_dir, "nation").select("n_name", "n_regionkey").repartition("n_regionkey"), path, "text", ("n_regionkey",))
    found = tables.files(spark, path, "*.txt").withColumn("n_regionkey", F.regexp_extract("path", r"n_regionkey=(\d+)", 1).cast("int"))
    return found.groupBy("n_regionkey").agg(F.sum(F.octet_length("content").cast("bigint")).alias("bytes"))


@frame("SELECT n, n * n AS square FROM range(0, 1000) t(n)")
def python_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.dataSource.register(tables.Squares)
    return spark.read.format("squares").option("end", 1000).load()


# Python functions
@frame("SELECT n_nationkey, array_to_string(list_transform(string_split(n_name, ' '), lambda w: lower(w[1])), '') AS initials FROM nation")
def python_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "nation").select("n_nationkey", udfs.title_initials("n_name").alias("initials"))


@frame("SELECT l_returnflag, round(sum(1 / (1 + pow(2.0, -((l_quantity - 25) / 5)))), 4) AS total FROM lineitem GROUP BY 1")
def pandas_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables.load(spark, sf_dir, "lineitem").select("l_returnflag", udfs.clipped_rank("l_quantity").alias("v"))
    return lines.groupBy("l_returnflag").agg(F.round(F.sum("v"), 4).alias("total"))


@frame("WITH q AS (SELECT c_nationkey AS k, quantile_cont(c_acctbal, 0.25) AS low, quantile_cont(c_acctbal, 0.75) AS high FROM customer GROUP BY 1) SELECT k AS c_nationkey, count(*)::DOUBLE AS mid FROM customer JOIN q ON c_nationkey = k AND c_acctbal BETWEEN low AND high GROUP BY 1")
def pandas_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(udfs.mid_count("c_acctbal").alias("mid"))


@frame("WITH d AS (SELECT user_id, event_id, CASE WHEN value > lag(value) OVER w THEN 1 ELSE 0 END AS up FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), g AS (SELECT *, sum(1 - up) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM d), r AS (SELECT user_id, run, sum(up) AS n FROM g GROUP BY 1, 2) SELECT user_id, max(n)::BIGINT AS rise FROM r GROUP BY 1")
def pandas_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.load(spark, sf_dir, "events").select("user_id", "event_id", "value").groupBy("user_id").applyInPandas(udfs.longest_rise, "user_id long, rise long")


@frame("SELECT n_nationkey, 2 * n_regionkey + 1 AS twice FROM nation")
def sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark, sf_dir, ["nation"])
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION twice_and_one(x INT) RETURNS INT RETURN 2 * x + 1")
    return spark.sql("SELECT n_nationkey, twice_and_one(n_regionkey) AS twice FROM nation")


@frame("SELECT item_id, words[i] AS word, (i - 1)::INT AS at FROM (SELECT item_id, string_split_regex(trim(text), '\\s+') AS words FROM benchmark) x, LATERAL (SELECT unnest(range(1, len(words) + 1)) AS i) WHERE words[i] <> ''")
def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.register(spark, sf_dir, ["benchmark"])
    spark.udtf.register("words_of", udfs.Words)
    return spark.sql("SELECT item_id, w.word, w.at FROM benchmark, LATERAL words_of(text) w")


# streams, drained
@frame("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drained(spark, streams.tumbling, sf_dir, "complete")


@frame("SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drained(spark, streams.deduplicated, sf_dir, "append")


@frame("SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY user_id")
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drained(spark, streams.running_counts, sf_dir, "update")


@frame("SELECT event_id, user_id, round(value * 2, 2) AS doubled FROM events WHERE event_type = 'purchase'")
def stream_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drained(spark, streams.purchases, sf_dir, "append")


CLOSED = "(SELECT max(ts) - INTERVAL 1 DAY FROM events)"


@frame(f"SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= {CLOSED} GROUP BY ALL")
def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drained(spark, streams.tumbling, sf_dir, "append")


@frame("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drained(spark, streams.tumbling, sf_dir, "update")


@frame("SELECT date_trunc('day', ts) - to_days(k) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events, (VALUES (0), (1)) t(k) GROUP BY ALL")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drained(spark, streams.sliding, sf_dir, "complete")


@frame(f"WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= {CLOSED}")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drained(spark, streams.sessions, sf_dir, "append")


@frame("SELECT event_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey")
def stream_static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = tables.load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return streams.drained(spark, lambda events: streams.with_static(events, users), sf_dir, "append")


@frame("SELECT p.event_id AS purchase_id, v.event_id AS view_id FROM events p JOIN events v ON p.user_id = v.user_id AND v.ts <= p.ts AND v.ts >= p.ts - INTERVAL 1 HOUR WHERE p.event_type = 'purchase' AND v.event_type = 'view'")
def stream_stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drained(spark, streams.views_before, sf_dir, "append")


@frame("SELECT user_id, max(value) AS largest FROM events GROUP BY 1")
def stream_transform_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drained(spark, streams.largest, sf_dir, "update", rocksdb=True)


# approximate and sampling operators: held against the exact figures, within their stated errors
@frame("SELECT DISTINCT l_returnflag, true AS parts_near, true AS orders_near, true AS prices_near FROM lineitem")
def approximate_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates within 10 % of the exact counts, and an approximate median between the exact 48th and 52nd percentiles."""
    found = tables.load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.count_distinct("l_partkey").alias("all_parts"), F.hll_sketch_estimate(F.hll_sketch_agg("l_orderkey", 14)).alias("orders"), F.count_distinct("l_orderkey").alias("all_orders"),
        F.percentile_approx("l_extendedprice", 0.5, 10_000).alias("price"), F.percentile("l_extendedprice", 0.48).alias("low"), F.percentile("l_extendedprice", 0.52).alias("high"),
    )
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.1 * F.col(b)
    return found.select("l_returnflag", near("parts", "all_parts").alias("parts_near"), near("orders", "all_orders").alias("orders_near"), F.col("price").between(F.col("low"), F.col("high")).alias("prices_near"))


@frame("SELECT true AS share_near, true AS repeatable, true AS rows_of_table")
def table_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of a tenth: its size within five standard deviations, the same again with one seed, rows of the table."""
    tables.register(spark, sf_dir, ["orders"])
    sample = lambda: spark.sql("SELECT o_orderkey, o_custkey FROM orders TABLESAMPLE (10 PERCENT) REPEATABLE (7)")
    own = sample().agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("o_orderkey", "o_custkey").cast("decimal(38,0)")).alias("h"))
    again = sample().agg(F.sum(F.xxhash64("o_orderkey", "o_custkey").cast("decimal(38,0)")).alias("h2"))
    whole = spark.table("orders").agg(F.count(F.lit(1)).alias("all"))
    strange = sample().join(spark.table("orders"), ["o_orderkey", "o_custkey"], "left_anti").agg(F.count(F.lit(1)).alias("strange"))
    share = F.abs(F.col("n") - F.col("all") * 0.1) <= 5 * F.sqrt(F.col("all") * 0.09)
    return own.crossJoin(again).crossJoin(whole).crossJoin(strange).select(share.alias("share_near"), (F.col("h") == F.col("h2")).alias("repeatable"), (F.col("strange") == 0).alias("rows_of_table"))
