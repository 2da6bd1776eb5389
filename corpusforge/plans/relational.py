"""Relational operators over the star schema and the vector table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.operators import corpus as C
from corpusforge.plans.analytics import both
from corpusforge.plans.registry import query, table

both("pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, CAST(count(*) AS BIGINT) AS n FROM {lineitem} WHERE l_shipdate <= $d GROUP BY l_returnflag, l_linestatus", d=("TIMESTAMP_NTZ'1998-09-02 00:00:00'", "TIMESTAMP '1998-09-02 00:00:00'"))
both("join_inner", "SELECT n_name, CAST(count(*) AS BIGINT) AS orders, round(sum(o_totalprice), 2) AS total FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name")
both("join_left", "SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY c_custkey")
both("join_semi", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
both("join_anti", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)")
both("join_full", "SELECT coalesce(s_nationkey, c_nationkey) AS nationkey, CAST(s AS BIGINT) AS suppliers, CAST(c AS BIGINT) AS customers FROM (SELECT s_nationkey, count(*) AS s FROM {supplier} GROUP BY s_nationkey) x FULL OUTER JOIN (SELECT c_nationkey, count(*) AS c FROM {customer} GROUP BY c_nationkey) y ON s_nationkey = c_nationkey")
both("join_asof", "SELECT event_id, seen_at FROM (SELECT e.event_id, max(p.ts) AS seen_at FROM {events} e JOIN {events} p ON e.user_id = p.user_id AND p.ts < e.ts AND p.event_type = 'view' WHERE e.event_type = 'purchase' GROUP BY e.event_id) t")
both("cube", "SELECT coalesce(o_orderstatus, '*') AS status, coalesce(o_orderpriority, '*') AS priority, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
both("grouping_sets", "SELECT coalesce(c_mktsegment, '*') AS segment, coalesce(c_nationkey, -1) AS nation, CAST(count(*) AS BIGINT) AS n FROM {customer} GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
both("set_operations", "(SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}) EXCEPT SELECT n_nationkey FROM {nation} WHERE n_regionkey = 0")
both("rank_dense_ntile", "SELECT c_custkey, CAST(rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS BIGINT) AS rnk, CAST(dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS BIGINT) AS dense, CAST(ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS BIGINT) AS quarter FROM {customer}")
both("frames_rows_range", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3, CAST(count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS BIGINT) AS near FROM {orders}")
both("topk_per_group", "SELECT l_returnflag, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM {lineitem}) WHERE r <= 5")


@query("SELECT p_partkey, CAST(count(*) AS BIGINT) AS n FROM part JOIN supplier ON s_nationkey = p_size % 25 AND s_acctbal BETWEEN p_retailprice AND p_retailprice + 4000 GROUP BY p_partkey")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.col("p_retailprice").cast("double")
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 25).alias("k"), low.alias("low"), (low + 4000).alias("high"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").cast("double").alias("at"))
    return C.count_between(p, s, "k", "low", "high", "at", "n").where("n > 0").groupBy("p_partkey").agg(F.sum("n").cast("bigint").alias("n"))
