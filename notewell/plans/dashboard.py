"""Queries: counts and histograms of the overview, and the run history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Catalogue, table

CATALOGUE = Catalogue()
add = CATALOGUE.add


@add("""SELECT (SELECT count(*) FROM orders)::BIGINT AS n_orders, (SELECT count_if(o_orderstatus = 'F') FROM orders)::BIGINT AS resolved,
       (SELECT count_if(o_orderstatus = 'O') FROM orders)::BIGINT AS open, (SELECT count(*) FROM lineitem)::BIGINT AS n_lines""")
def overview_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").agg(
        F.count("*").alias("n_orders"), F.count_if(F.col("o_orderstatus") == "F").alias("resolved"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    # one row on either side
    return orders.crossJoin(table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n_lines")))


@add("SELECT coalesce(nullif(o_orderstatus, ''), 'unknown') AS status, count(*)::BIGINT AS n FROM orders GROUP BY 1 ORDER BY n DESC, status")
def by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.coalesce(F.nullif("o_orderstatus", F.lit("")), F.lit("unknown"))
    return table(spark, sf_dir, "orders").groupBy(status.alias("status")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status")


@add("""SELECT n_name AS project, count(DISTINCT c_custkey)::BIGINT AS members, count(o_orderkey)::BIGINT AS n
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name""")
def by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    owners = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return owners.join(per, "c_custkey", "left").groupBy(F.col("n_name").alias("project")).agg(
        F.countDistinct("c_custkey").alias("members"), F.sum(F.coalesce("orders", F.lit(0))).alias("n"))


@add("SELECT tag, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part) GROUP BY tag ORDER BY n DESC, tag LIMIT 30")
def tag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 most frequent tags."""
    tags = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(30)


@add("""SELECT month, sum(placed)::BIGINT AS placed, sum(shipped)::BIGINT AS shipped FROM (
  SELECT strftime(o_orderdate, '%Y-%m') AS month, 1 AS placed, 0 AS shipped FROM orders
  UNION ALL SELECT strftime(l_shipdate, '%Y-%m'), 0, 1 FROM lineitem) GROUP BY month""")
def monthly_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    def per_month(name: str, ts: str, measure: str) -> DataFrame:
        return table(spark, sf_dir, name).groupBy(F.date_format(ts, "yyyy-MM").alias("month")).agg(F.count("*").alias(measure))

    both = per_month("orders", "o_orderdate", "placed").join(per_month("lineitem", "l_shipdate", "shipped"), "month", "full_outer")
    return both.select("month", F.coalesce("placed", F.lit(0)).alias("placed"), F.coalesce("shipped", F.lit(0)).alias("shipped"))


@add("""SELECT l_returnflag AS kind, l_linestatus AS scope, count(*)::BIGINT AS chunks, sum(l_quantity) AS quantity
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())""")
def store_stats_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("scope"), "l_quantity")
    kind, scope = F.col("kind"), F.col("scope")
    return lines.groupingSets([[kind], [scope], []], kind, scope).agg(F.count("*").alias("chunks"), F.sum("l_quantity").alias("quantity"))


@add("""SELECT p_partkey, p_name, p_brand, p_size FROM part
WHERE p_size BETWEEN 10 AND 30 AND list_contains(string_split(p_name, ' '), 'blue') AND contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'economy')
ORDER BY p_size DESC, p_partkey DESC LIMIT 500""")
def browse_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list page of at most 500 rows: by size, tag and a case-blind substring."""
    parts = table(spark, sf_dir, "part")
    found = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")).contains("economy")
    tagged = F.array_contains(F.split("p_name", " "), "blue")
    return parts.where(F.col("p_size").between(10, 30) & tagged & found).orderBy(F.desc("p_size"), F.desc("p_partkey")).limit(500).select("p_partkey", "p_name", "p_brand", "p_size")


RUNS = """
runs AS (
  SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*)::BIGINT AS captures, count_if(o_orderstatus = 'P')::BIGINT AS backfills,
         count_if(o_orderstatus = 'F')::BIGINT AS finalizes, count_if(o_orderpriority = '1-URGENT')::BIGINT AS errors, count(DISTINCT o_custkey)::BIGINT AS touched
  FROM orders GROUP BY 1)
"""


def daily_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("captures"), F.count_if(F.col("o_orderstatus") == "P").alias("backfills"), F.count_if(F.col("o_orderstatus") == "F").alias("finalizes"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("errors"), F.countDistinct("o_custkey").alias("touched"))


@add(f"WITH {RUNS} SELECT *, captures + finalizes = 0 AS idle FROM runs")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_runs(spark, sf_dir).withColumn("idle", F.col("captures") + F.col("finalizes") == 0)


@add(f"WITH {RUNS} SELECT * FROM runs ORDER BY day DESC LIMIT 100")
def run_history_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history keeps its last 100 runs."""
    return daily_runs(spark, sf_dir).orderBy(F.desc("day")).limit(100)


@add("""SELECT user_id, event_type, round(sum(value), 2) AS tokens, round(sum(value) / sum(sum(value)) OVER (PARTITION BY user_id), 4) AS share FROM events GROUP BY user_id, event_type""")
def section_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    share = F.round(F.col("v") / F.sum("v").over(Window.partitionBy("user_id")), 4)
    return per.select("user_id", "event_type", F.round("v", 2).alias("tokens"), share.alias("share"))
