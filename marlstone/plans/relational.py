"""The relational surface as named queries.

Each entry is Spark SQL over the snapshot views; where DuckDB spells something differently the
second text is the oracle's.  Sums of doubles are rounded on both sides, ranked output is totally
ordered, and integer aggregates are cast to BIGINT so that both sides have one type.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..rewrite import rewritten
from ..session import metadata_reads
from .percentiles import percentiles

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

SQL: dict[str, str | tuple[str, str]] = {
    # scans, projection, filters, expressions
    "scan_project": "SELECT event_id, user_id + 1 AS next_user, value * 2 AS twice, event_type FROM events",
    "filter_3vl": "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 1000) AND o_orderpriority IS NOT NULL AND (NULLIF(o_orderstatus, 'P') IS NULL OR o_custkey % 3 = 1)",
    "filter_is_null": "SELECT event_id, NULLIF(event_type, 'click') AS t FROM events WHERE NULLIF(event_type, 'click') IS NULL OR value IS NULL",
    "between_like_in_case": "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'small' WHEN p_size <= 30 THEN 'mid' ELSE 'big' END AS bucket FROM part WHERE p_brand LIKE 'Brand%' AND p_size IN (1, 5, 7, 20, 33, 44) AND p_name NOT LIKE '%zzz%'",
    "arith_ops": "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, -l_tax AS neg, CAST(l_orderkey % 7 AS BIGINT) AS m FROM lineitem",
    "arith_decimal": "SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DECIMAL(24,2)) AS exact_sum, CAST(max(CAST(l_tax AS DECIMAL(6,3))) AS DECIMAL(6,3)) AS top_tax FROM lineitem GROUP BY l_returnflag",
    "division_null": ("SELECT o_orderkey, try_divide(o_totalprice, NULLIF(o_custkey % 2, 0)) AS q, CAST(o_orderkey DIV 7 AS BIGINT) AS d FROM orders WHERE o_orderkey < 400", "SELECT o_orderkey, o_totalprice / NULLIF(o_custkey % 2, 0) AS q, CAST(o_orderkey // 7 AS BIGINT) AS d FROM orders WHERE o_orderkey < 400"),
    "date_range": "SELECT count(*) AS n, round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1996-01-01 00:00:00' AND l_discount BETWEEN 0.02 AND 0.09",
    "predicate_as_value": "SELECT s_suppkey, s_acctbal > 0 AS in_credit, (s_nationkey = 3 OR s_nationkey IS NULL) AS is_three FROM supplier",
    "constant_select": "SELECT 1 AS one, 'x' AS s, CAST(NULL AS BIGINT) AS n, TRUE AS t, CAST(9.99 AS DECIMAL(6,2)) * 3 AS d",
    "values_rows": "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a'), (CAST(2 AS BIGINT), 'b'), (CAST(3 AS BIGINT), NULL)) AS v(id, name)",
    "count_star": "SELECT count(*) AS n FROM lineitem",
    "count_column": "SELECT count(NULLIF(event_type, 'view')) AS n, count(*) AS total FROM events",
    "min_max_meta": "SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi, min(o_orderdate) AS d0, max(o_orderdate) AS d1 FROM orders",
    "point_lookup": "SELECT * FROM orders WHERE o_orderkey = 77",
    "point_lookup_missing": "SELECT * FROM orders WHERE o_orderkey = -1",
    "key_range": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 260",
    "pruned_or": "SELECT o_orderkey FROM orders WHERE o_orderkey < 40 OR (300 <= o_orderkey AND o_orderkey < 340)",
    # aggregation
    "group_agg": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "group_having": "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) >= 12",
    "group_expression": "SELECT date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders GROUP BY date_trunc('month', o_orderdate)",
    "count_distinct": "SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types FROM events",
    "global_empty": "SELECT count(*) AS n, sum(o_totalprice) AS s, min(o_orderkey) AS lo FROM orders WHERE o_orderkey < 0",
    "distinct_rows": "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem",
    "rollup": "SELECT n_regionkey, n_name, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY ROLLUP (n_regionkey, n_name)",
    "cube": "SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS BIGINT) AS g1, CAST(grouping(o_orderpriority) AS BIGINT) AS g2, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "filter_agg": "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, round(sum(value) FILTER (WHERE value > 10), 3) AS big FROM events GROUP BY user_id",
    "stat_aggs": "SELECT l_returnflag, round(stddev_samp(l_quantity), 5) AS sd, round(var_pop(l_quantity), 5) AS vp, round(corr(l_quantity, l_extendedprice), 5) AS c, round(covar_samp(l_quantity, l_discount), 5) AS cs FROM lineitem GROUP BY l_returnflag",
    "median_percentile": ("SELECT l_returnflag, round(median(l_extendedprice), 3) AS med, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY l_extendedprice), 3) AS p90 FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(median(l_extendedprice), 3) AS med, round(quantile_cont(l_extendedprice, 0.9), 3) AS p90 FROM lineitem GROUP BY l_returnflag"),
    "bool_aggs": "SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS all_big, bool_or(o_totalprice > 400000) AS any_huge FROM orders GROUP BY o_orderstatus",
    "regression_aggs": "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_r2(l_extendedprice, l_quantity), 4) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag",
    "list_aggs": ("SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey"),
    "arg_max_agg": ("SELECT o_custkey, max_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY o_custkey", "SELECT o_custkey, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS latest FROM orders GROUP BY o_custkey"),
    # order, limit, distinct, sets
    "topk": "SELECT event_id, value FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 25",
    "topk_hidden_key": "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10",
    "limit_offset": "SELECT event_id, ts FROM events ORDER BY ts NULLS FIRST, event_id LIMIT 20 OFFSET 15",
    "order_nulls": "SELECT event_id, NULLIF(event_type, 'view') AS t FROM events ORDER BY t ASC NULLS FIRST, event_id LIMIT 30",
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect_sets": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "except_sets": "SELECT l_orderkey AS k FROM lineitem EXCEPT SELECT l_orderkey FROM lineitem WHERE l_quantity > 20",
    "except_all": "SELECT l_linenumber AS k FROM lineitem WHERE l_orderkey < 200 EXCEPT ALL SELECT l_linenumber FROM lineitem WHERE l_orderkey < 100",
    # joins
    "inner_join": "SELECT c_custkey, n_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 150000",
    "left_join": "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'F' GROUP BY c.c_custkey",
    "right_join": "SELECT n.n_name, s.s_suppkey FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000",
    "full_join": "SELECT a.k AS a, b.k AS b FROM (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_custkey < 30) a FULL OUTER JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_suppkey < 30) b ON a.k = b.k",
    "cross_join": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "theta_join": "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal AND a.s_nationkey = b.s_nationkey",
    "semi_join": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
    "in_subquery": "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "anti_join": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)",
    "not_in_subquery": "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)",
    "self_join": "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.event_type = b.event_type AND b.event_id - a.event_id < 300",
    "scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)",
    "correlated_subquery": "SELECT o.o_orderkey FROM orders o WHERE o.o_totalprice > (SELECT 1.4 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "lateral_join": ("SELECT n_name, t.s_suppkey FROM nation, LATERAL (SELECT s_suppkey FROM supplier WHERE s_nationkey = n_nationkey ORDER BY s_acctbal DESC, s_suppkey LIMIT 2) t", "SELECT n_name, t.s_suppkey FROM nation, LATERAL (SELECT s_suppkey FROM supplier WHERE s_nationkey = n_nationkey ORDER BY s_acctbal DESC, s_suppkey LIMIT 2) t"),
    "cte": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE t > 500000) SELECT c_mktsegment, count(*) AS n, round(sum(t), 1) AS total FROM top JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment",
    "recursive_cte": "WITH RECURSIVE s(n, total) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, total + n + 1 FROM s WHERE n < 20) SELECT n, total FROM s",
    # windows
    "row_number": "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn FROM orders",
    "rank_family": "SELECT p_partkey, CAST(rank() OVER w AS BIGINT) AS r, CAST(dense_rank() OVER w AS BIGINT) AS dr, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)",
    "ntile_window": "SELECT s_suppkey, CAST(ntile(4) OVER (ORDER BY s_acctbal, s_suppkey) AS BIGINT) AS q FROM supplier",
    "lag_lead": "SELECT event_id, lag(value, 1) OVER w AS prev, lead(event_type, 2, 'none') OVER w AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "first_last_nth": "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "frame_rows": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 5) AS m FROM events",
    "frame_range": "SELECT p_partkey, round(sum(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING), 2) AS s FROM part",
    "window_ignore_nulls": ("SELECT event_id, last_value(NULLIF(event_type, 'view')) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t FROM events", "SELECT event_id, last_value(NULLIF(event_type, 'view') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t FROM events"),
    "qualify": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
    "groups_frame": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM part",
    # functions
    "string_functions": ("SELECT n_nationkey, upper(n_name) AS u, lower(n_name) AS l, trim('  x ') AS t, lpad(n_name, 12, '*') AS lp, rpad(n_name, 12, '-') AS rp, CAST(length(n_name) AS BIGINT) AS len, substring(n_name, 2, 3) AS sub, left(n_name, 2) AS le, right(n_name, 2) AS ri, replace(n_name, 'A', 'b') AS rep, concat(n_name, '-', n_nationkey) AS c, concat_ws('/', n_name, 'z') AS cw, split_part(concat(n_name, ':b'), ':', 2) AS sp, repeat('ab', 3) AS r3, reverse(n_name) AS rev, CAST(position('A' IN n_name) AS BIGINT) AS pos, regexp_replace(n_name, '[AEIOU]', '_') AS rx, CAST(ascii(n_name) AS BIGINT) AS a, chr(65) AS ch, md5(n_name) AS m, translate(n_name, 'AE', 'xy') AS tr, CAST(levenshtein(n_name, 'NATION') AS BIGINT) AS lv FROM nation",
        "SELECT n_nationkey, upper(n_name) AS u, lower(n_name) AS l, trim('  x ') AS t, lpad(n_name, 12, '*') AS lp, rpad(n_name, 12, '-') AS rp, CAST(length(n_name) AS BIGINT) AS len, substring(n_name, 2, 3) AS sub, left(n_name, 2) AS le, right(n_name, 2) AS ri, replace(n_name, 'A', 'b') AS rep, concat(n_name, '-', n_nationkey) AS c, concat_ws('/', n_name, 'z') AS cw, split_part(concat(n_name, ':b'), ':', 2) AS sp, repeat('ab', 3) AS r3, reverse(n_name) AS rev, CAST(position('A' IN n_name) AS BIGINT) AS pos, regexp_replace(n_name, '[AEIOU]', '_', 'g') AS rx, CAST(ascii(n_name) AS BIGINT) AS a, chr(65) AS ch, md5(n_name) AS m, translate(n_name, 'AE', 'xy') AS tr, CAST(levenshtein(n_name, 'NATION') AS BIGINT) AS lv FROM nation"),
    "math_functions": "SELECT s_suppkey, abs(s_acctbal) AS a, CAST(ceil(s_acctbal) AS BIGINT) AS c, CAST(floor(s_acctbal) AS BIGINT) AS f, round(s_acctbal, 1) AS r, CAST(sign(s_acctbal) AS BIGINT) AS sg, round(sqrt(abs(s_acctbal)), 6) AS sq, round(power(s_suppkey, 2), 2) AS pw, round(exp(s_suppkey / 1000.0), 6) AS ex, round(ln(s_suppkey + 1), 6) AS lg, round(log10(s_suppkey + 1), 6) AS l10, greatest(s_suppkey, 5) AS g, least(s_suppkey, 5) AS le, round(sin(s_suppkey), 6) AS sn, round(atan2(s_suppkey, 3), 6) AS at, round(degrees(1.0), 6) AS dg, round(pi(), 6) AS p FROM supplier",
    "date_functions": ("SELECT o_orderkey, date_trunc('year', o_orderdate) AS y, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS yr, CAST(extract(MONTH FROM o_orderdate) AS BIGINT) AS mo, CAST(extract(DAY FROM o_orderdate) AS BIGINT) AS dy, CAST(datediff(DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS dd, date_add(CAST(o_orderdate AS DATE), 10) AS plus, last_day(CAST(o_orderdate AS DATE)) AS ld, make_date(2020, 2, 29) AS md, date_format(o_orderdate, 'yyyy/MM/dd') AS fm FROM orders WHERE o_orderkey < 2000",
        "SELECT o_orderkey, date_trunc('year', o_orderdate) AS y, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS yr, CAST(extract(MONTH FROM o_orderdate) AS BIGINT) AS mo, CAST(extract(DAY FROM o_orderdate) AS BIGINT) AS dy, date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS dd, CAST(CAST(o_orderdate AS DATE) + 10 AS DATE) AS plus, last_day(CAST(o_orderdate AS DATE)) AS ld, make_date(2020, 2, 29) AS md, strftime(o_orderdate, '%Y/%m/%d') AS fm FROM orders WHERE o_orderkey < 2000"),
    "conditional_functions": ("SELECT event_id, coalesce(NULLIF(event_type, 'view'), 'none') AS c, ifnull(NULLIF(value, 0), -1) AS i, if(value > 50, 'hi', 'lo') AS f FROM events", "SELECT event_id, coalesce(NULLIF(event_type, 'view'), 'none') AS c, ifnull(NULLIF(value, 0), -1) AS i, CASE WHEN value > 50 THEN 'hi' ELSE 'lo' END AS f FROM events"),
    "cast_functions": "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(14,2)) AS d, CAST(o_orderkey AS STRING) AS s, try_cast(o_orderstatus AS BIGINT) AS bad, CAST('42' AS BIGINT) AS n, CAST(o_orderdate AS DATE) AS dt FROM orders",
    "json_props": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "array_functions": ("SELECT vec_id, CAST(size(embedding) AS BIGINT) AS n, round(CAST(aggregate(transform(embedding, x -> CAST(x AS DOUBLE) * x), CAST(0 AS DOUBLE), (a, x) -> a + x) AS DOUBLE), 4) AS norm2 FROM embeddings", "SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 4) AS norm2 FROM embeddings"),
    # wide-table analytics shapes
    "cb_filtered_count": "SELECT count(*) AS n FROM events WHERE event_type <> 'view'",
    "cb_sum_count_avg": "SELECT round(sum(value), 2) AS s, count(*) AS n, round(avg(user_id), 6) AS a FROM events",
    "cb_avg_key": "SELECT round(avg(o_custkey), 6) AS a FROM orders",
    "cb_group_filtered": "SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY event_type ORDER BY n DESC, event_type",
    "cb_distinct_per_group": "SELECT event_type, count(DISTINCT user_id) AS u FROM events GROUP BY event_type ORDER BY u DESC, event_type LIMIT 10",
    "cb_top_groups": "SELECT user_id, count(*) AS c FROM events GROUP BY user_id ORDER BY c DESC, user_id LIMIT 10",
    "cb_time_topk": "SELECT event_id, event_type FROM events WHERE event_type <> 'view' ORDER BY ts, event_id LIMIT 10",
    "cb_width_groups": "SELECT l_linenumber, count(*) AS c FROM lineitem GROUP BY l_linenumber ORDER BY c DESC, l_linenumber LIMIT 10",
    "cb_range_narrow": "SELECT count(*) AS n, round(sum(value), 3) AS s FROM events WHERE event_id BETWEEN 500 AND 520",
    "cb_range_percent": "SELECT event_type, count(*) AS n FROM events WHERE event_id >= 1000 AND event_id < 1100 GROUP BY event_type",
}


_WORD = re.compile(r"\w+")
#: Schemas of files read before, with the time of their last change, so that a query needn't look again.
_schemas: dict[tuple[str, int], StructType] = {}


def table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; a local one whose schema is known isn't opened before it is read."""
    try:
        key = (path, os.stat(path).st_mtime_ns)
    except OSError:
        return spark.read.parquet(path)
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


def views(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """The test tables that a query names, as views of this session."""
    for t in sorted(set(_WORD.findall(sql)) & set(TABLES)):
        table(spark, f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


#: Bare COUNT, MIN and MAX: answered from the files' footers.
METADATA = ("count_star", "min_max_meta")


def query(name: str):
    text = SQL[name] if isinstance(SQL[name], str) else SQL[name][0]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if name in METADATA:
            for t in sorted(set(_WORD.findall(text)) & set(TABLES)):
                metadata_reads(spark, f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        else:
            views(spark, sf_dir, text)
        return spark.sql(rewritten(text))

    run.__name__ = name
    return run


def median_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What its SQL says, without one task for each group."""
    views(spark, sf_dir, SQL["median_percentile"][0])
    found = percentiles(spark.table("lineitem"), "l_returnflag", "l_extendedprice", {"med": 0.5, "p90": 0.9})
    return found.select("l_returnflag", F.round("med", 3).alias("med"), F.round("p90", 3).alias("p90"))


QUERIES = {name: query(name) for name in SQL} | {"median_percentile": median_percentile}
ORACLES = {name: text if isinstance(text, str) else text[1] for name, text in SQL.items()}
