"""Queries of joins, sets and predicates over the supplied tables."""

from __future__ import annotations

import functools

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .queries import query, read


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON c_name = concat('Customer#', lpad(o_custkey::VARCHAR, 9, '0'))")
def expression_key_join(spark, sf_dir):
    """Names made of numbers as the key, worked out before the exchange."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("c_name"))
    return o.join(read(spark, sf_dir, "customer").select("c_name"), "c_name").select("o_orderkey", "c_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def left_join_constants(spark, sf_dir):
    """The set of constants filters the right side before an equi-join, so nothing is nearly crossed."""
    o = read(spark, sf_dir, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_custkey", "o_orderkey")
    return read(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT coalesce(a.l_partkey, b.p_partkey) AS k, a.n, b.p_size, a.l_partkey IS NOT NULL AS left_there, b.p_partkey IS NOT NULL AS right_there FROM (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey % 3 > 0 GROUP BY 1) a FULL JOIN (SELECT * FROM part WHERE p_partkey % 2 = 0) b ON l_partkey = p_partkey")
def merged_streams(spark, sf_dir):
    """Two streams in the order of one key, side by side, with what only one has."""
    a = read(spark, sf_dir, "lineitem").filter("l_partkey % 3 > 0").groupBy("l_partkey").agg(F.count("*").alias("n"))
    b = read(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select("p_partkey", "p_size")
    both = a.join(b, F.col("l_partkey") == F.col("p_partkey"), "full")
    return both.select(F.coalesce("l_partkey", "p_partkey").alias("k"), "n", "p_size", F.col("l_partkey").isNotNull().alias("left_there"), F.col("p_partkey").isNotNull().alias("right_there"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_join(spark, sf_dir):
    large = read(spark, sf_dir, "orders").filter("o_totalprice > 300000")
    return read(spark, sf_dir, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti_join(spark, sf_dir):
    large = read(spark, sf_dir, "orders").filter("o_totalprice > 300000")
    return read(spark, sf_dir, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def intersected(spark, sf_dir):
    return read(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_nationkey").alias("k")).intersect(read(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
def excepted(spark, sf_dir):
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).exceptAll(read(spark, sf_dir, "supplier").filter("s_acctbal > 9000").select("s_nationkey").distinct())


@query("SELECT p_partkey FROM part WHERE (p_brand, p_size) IN (SELECT (p_brand, max(p_size)) FROM part GROUP BY p_brand)")
def tuples_in(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.join(p.groupBy("p_brand").agg(F.max("p_size").alias("p_size")), ["p_brand", "p_size"], "left_semi").select("p_partkey")


@query("SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%E%' AND p_name NOT LIKE 'b%'")
def like_patterns(spark, sf_dir):
    return read(spark, sf_dir, "part").filter(F.col("p_type").like("%A%E%") & ~F.col("p_name").like("b%")).select("p_partkey", "p_type")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 36 HOUR FROM events)")
def latest_hours(spark, sf_dir):
    """Rows of the last hours before the newest; the moment is one value."""
    e = read(spark, sf_dir, "events")
    newest = e.agg((F.max("ts") - F.make_dt_interval(hours=F.lit(36))).alias("since"))
    return e.join(F.broadcast(newest), F.col("ts") >= F.col("since")).select("event_id")


def any_of(conditions: list[Column]) -> Column:
    """One predicate of a list; false for none."""
    return functools.reduce(lambda a, b: a | b, conditions, F.lit(False))


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 200000) OR (o_orderstatus = 'O' AND o_totalprice < 20000) OR (o_orderstatus = 'P' AND o_orderpriority LIKE '5%')")
def chained_or(spark, sf_dir):
    parts = [("F", F.col("o_totalprice") > 200000), ("O", F.col("o_totalprice") < 20000), ("P", F.col("o_orderpriority").like("5%"))]
    return read(spark, sf_dir, "orders").filter(any_of([(F.col("o_orderstatus") == s) & c for s, c in parts])).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def record_range(spark, sf_dir):
    """A page of an ordered listing, by top-k and an offset."""
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(25)


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
def top_of_groups(spark, sf_dir):
    """The three richest customers of each nation; the engine keeps three a task before the exchange."""
    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return read(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal", rank.alias("rank")).filter("rank <= 3").drop("rank")


@query("SELECT c_nationkey, any_value(n_name) AS n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def any_values(spark, sf_dir):
    """A column that depends on the key; customers are counted before the join."""
    n = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return n.join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("c_nationkey").agg(F.any_value("n_name").alias("n_name"), F.any_value("n").alias("n"))
