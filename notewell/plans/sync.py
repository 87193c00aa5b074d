"""Queries: incremental capture, gates, merges and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import hooks as H
from ..operators import incremental as I
from ..operators import sessions as S
from .common import Catalogue, table

CATALOGUE = Catalogue()
add = CATALOGUE.add


def shipped(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    """(part, signature): what was shipped of each part in a year, as a snapshot."""
    lines = table(spark, sf_dir, "lineitem").where((F.col("l_shipdate") >= F.lit(f"{year}-01-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit(f"{year + 1}-01-01").cast("timestamp_ntz")))
    signature = F.concat_ws(":", F.count("*"), F.sum(F.col("l_quantity").cast("long")))
    return lines.groupBy(F.col("l_partkey").alias("part")).agg(signature.alias("signature"))


SHIPPED = """
a AS (SELECT l_partkey AS part, count(*) || ':' || sum(l_quantity::BIGINT) AS sig FROM lineitem WHERE year(l_shipdate) = 1996 GROUP BY 1),
b AS (SELECT l_partkey AS part, count(*) || ':' || sum(l_quantity::BIGINT) AS sig FROM lineitem WHERE year(l_shipdate) = 1997 GROUP BY 1),
diff AS (
  SELECT coalesce(a.part, b.part) AS part,
         CASE WHEN a.part IS NULL THEN 'added' WHEN b.part IS NULL THEN 'removed' WHEN a.sig = b.sig THEN 'skipped' ELSE 'updated' END AS action
  FROM a FULL JOIN b ON a.part = b.part)
"""


@add(f"WITH {SHIPPED} SELECT action, count(*)::BIGINT AS n FROM diff GROUP BY action")
def incremental_diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = I.snapshot_diff(shipped(spark, sf_dir, 1996), shipped(spark, sf_dir, 1997), "part", "signature")
    return diff.groupBy("action").agg(F.count("*").alias("n"))


@add(f"WITH {SHIPPED} SELECT part, action FROM diff WHERE action IN ('added', 'updated')")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed between snapshots; deletions do not count."""
    return I.snapshot_diff(shipped(spark, sf_dir, 1996), shipped(spark, sf_dir, 1997), "part", "signature").where(F.col("action").isin("added", "updated"))


@add(r"""
WITH s AS (SELECT doc_id, md5(text) AS raw, md5(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents WHERE lang <> 'es'),
t AS (SELECT doc_id, md5(CASE WHEN source = 'src1' THEN replace(text, chr(10), ' ') WHEN source = 'src2' THEN lower(text) ELSE text END) AS raw,
             md5(regexp_replace(CASE WHEN source = 'src2' THEN lower(text) ELSE text END, '\s+', ' ', 'g')) AS flat FROM documents WHERE lang <> 'de')
SELECT state, count(*)::BIGINT AS n FROM (
  SELECT CASE WHEN s.doc_id IS NULL THEN 'missing-src' WHEN t.doc_id IS NULL THEN 'new' WHEN s.raw = t.raw THEN 'same' WHEN s.flat = t.flat THEN 'eol-only' ELSE 'changed' END AS state
  FROM s FULL JOIN t USING (doc_id)) GROUP BY state""")
def snapshot_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deployed copy of the documents: one language absent, another extra, one source on single lines, one in lower case."""
    docs = table(spark, sf_dir, "documents")
    flat = lambda c: F.md5(F.regexp_replace(c, r"\s+", " "))
    lower = F.when(F.col("source") == "src2", F.lower("text")).otherwise(F.col("text"))
    raw = F.when(F.col("source") == "src1", F.replace("text", F.lit("\n"), F.lit(" "))).otherwise(lower)
    source = docs.where("lang <> 'es'").select("doc_id", F.md5("text").alias("raw"), flat(F.col("text")).alias("unix"))
    target = docs.where("lang <> 'de'").select("doc_id", F.md5(raw).alias("raw"), flat(lower).alias("unix"))
    return I.classify_deploy(source, target, "doc_id").groupBy("state").agg(F.count("*").alias("n"))


CUTOFF = "1999-01-01"


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits: customer = branch, key = position, date = commit date."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("branch"), F.col("o_orderkey").alias("sha"), F.col("o_orderdate").alias("ts"), "o_orderstatus")


@add("SELECT o_custkey AS branch, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS hwm FROM orders GROUP BY 1")
def hwm_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.advance(commits(spark, sf_dir), ["branch"], F.col("ts"), "sha")


def branches(spark: SparkSession, sf_dir: str, condition: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(condition).select(F.col("o_custkey").alias("branch")).distinct()


@add("SELECT c_custkey AS branch FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def seal_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.seal(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("branch")), branches(spark, sf_dir, "o_orderpriority = '1-URGENT'"))


@add("""SELECT o_custkey AS branch FROM orders WHERE o_orderstatus = 'O' UNION SELECT o_custkey FROM orders WHERE o_totalprice > 400000
UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0""")
def relevant_union3(spark: SparkSession, sf_dir: str) -> DataFrame:
    poor = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("branch"))
    return branches(spark, sf_dir, "o_orderstatus = 'O'").union(branches(spark, sf_dir, "o_totalprice > 400000")).union(poor).distinct()


@add("SELECT o_custkey AS branch FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def intersect_marked_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return branches(spark, sf_dir, "o_orderstatus = 'O'").intersect(branches(spark, sf_dir, "o_totalprice > 400000"))


@add("SELECT c_custkey AS branch, c_mktsegment AS segment FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0) OR c_nationkey IS NULL")
def exclude_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    excluded = table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, sf_dir, "customer").join(excluded, "c_nationkey", "left_anti").select(F.col("c_custkey").alias("branch"), F.col("c_mktsegment").alias("segment"))


@add("SELECT o_custkey AS branch, o_orderkey AS sha FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_returnflag = 'R')")
def anti_own_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A branch's own commits: those that no integration ref (returned lines) reaches."""
    reached = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("sha"))
    return commits(spark, sf_dir).join(reached, "sha", "left_anti").select("branch", "sha")


@add("SELECT conv_id, count(*)::BIGINT AS turns FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY conv_id")
def semi_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of the conversations that are marked by a system turn."""
    turns = table(spark, sf_dir, "conversations")
    return turns.join(turns.where("role = 'system'").select("conv_id"), "conv_id", "left_semi").groupBy("conv_id").agg(F.count("*").alias("turns"))


@add("""SELECT o_orderkey AS sha FROM orders WHERE o_orderdate >= TIMESTAMP '1995-02-01' AND o_orderdate < TIMESTAMP '1995-06-01'
AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-02-01')
AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'R')""")
def backfill_crack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work that appeared and closed inside one interval: known to no earlier run, and not open."""
    day, rows = lambda d: F.lit(d).cast("timestamp_ntz"), commits(spark, sf_dir)
    known = rows.where(F.col("ts") < day("1995-02-01")).select("branch")
    still = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O' AND l_returnflag = 'R'").select(F.col("l_orderkey").alias("sha"))
    inside = rows.where((F.col("ts") >= day("1995-02-01")) & (F.col("ts") < day("1995-06-01")))
    return inside.join(known, "branch", "left_anti").join(still, "sha", "left_anti").select("sha")


@add("""SELECT n_name AS branch, arg_min(o_orderstatus, (n, o_orderstatus)) AS base, min(n)::BIGINT AS ahead FROM (
  SELECT n_name, o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) GROUP BY n_name""")
def nearest_base_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    ahead = table(spark, sf_dir, "orders").join(named, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name", "o_orderstatus").agg(F.count("*").alias("n"))
    return ahead.groupBy(F.col("n_name").alias("branch")).agg(F.min_by("o_orderstatus", F.struct("n", "o_orderstatus")).alias("base"), F.min("n").alias("ahead"))


@add("""SELECT p_name AS name, count(DISTINCT p_brand)::BIGINT AS owners, CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) END AS owner FROM part GROUP BY p_name""")
def unambiguous_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.unambiguous(table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("owner")), "name", "owner")


@add("""WITH p AS (SELECT p_partkey, nullif(p_name, 'blue bolt') AS origin, p_type FROM part)
SELECT p_partkey, origin FROM p WHERE origin IS NULL
UNION ALL SELECT p_partkey, origin FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY length(p_type), p_partkey) AS rn FROM p WHERE origin IS NOT NULL) WHERE rn = 1""")
def dedupe_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clone per origin, the shortest first; clones without an origin all stay."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.nullif("p_name", F.lit("blue bolt")).alias("origin"), "p_type")
    return I.canonical(parts, "origin", [F.length("p_type"), F.col("p_partkey")]).select("p_partkey", "origin")


@add("""SELECT o_custkey AS branch, o_orderstatus AS status, o_orderkey AS sha FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = I.latest(commits(spark, sf_dir), ["branch", "o_orderstatus"], [F.desc("ts"), F.desc("sha")])
    return latest.select("branch", F.col("o_orderstatus").alias("status"), "sha")


@add("""SELECT o_orderkey AS sha, o_orderpriority AS class, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m'), o_orderpriority ORDER BY o_orderdate DESC, o_orderkey)::INT AS nth,
       row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m'), o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) > CASE WHEN o_orderpriority = '1-URGENT' THEN 25 ELSE 5 END AS deferred FROM orders""")
def cap_and_defer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly runs take 25 urgent rows and 5 of each other class; the rest is flagged for the next run."""
    rows = table(spark, sf_dir, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    caps = F.when(F.col("o_orderpriority") == "1-URGENT", 25).otherwise(5)
    numbered = I.cap_and_defer(rows, ["month", "o_orderpriority"], [F.desc("o_orderdate"), F.col("o_orderkey")], caps)
    return numbered.select(F.col("o_orderkey").alias("sha"), F.col("o_orderpriority").alias("class"), "nth", "deferred")


@add("""WITH cur AS (SELECT conv_id, count(*) AS lines FROM conversations GROUP BY 1), prev AS (SELECT conv_id, count(*) AS lines FROM conversations WHERE role = 'user' GROUP BY 1)
SELECT conv_id, (coalesce(p.lines, 0) + 1)::BIGINT AS from_line, greatest(c.lines, coalesce(p.lines, 0))::BIGINT AS to_line,
       greatest(c.lines - coalesce(p.lines, 0), 0)::BIGINT AS new_lines, c.lines < coalesce(p.lines, 0) AS shrunk FROM cur c LEFT JOIN prev p USING (conv_id)""")
def offset_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to read of each conversation, as if its user turns' number had been consumed."""
    turns = table(spark, sf_dir, "conversations")
    count = lambda df: df.groupBy("conv_id").agg(F.count("*").alias("lines"))
    return I.offset_ranges(count(turns), count(turns.where("role = 'user'")), "conv_id")


@add(r"""WITH t AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS pair FROM conversations WHERE role IN ('user', 'assistant')),
p AS (SELECT conv_id, pair, string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user') AS u, string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant') AS a FROM t WHERE text <> '' GROUP BY ALL)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pair) - 1 AS pair, length(coalesce(u, '')) AS user_chars, length(coalesce(a, '')) AS assistant_chars,
       substr(regexp_replace(concat_ws(chr(10), 'USER:' || chr(10) || u, 'ASSISTANT:' || chr(10) || a), '^\s+|\s+$', '', 'g'), 1, 1500) AS text FROM p""")
def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.turn_pairs(table(spark, sf_dir, "conversations"))


@add("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations""")
def section_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fill_section(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user", F.col("text")).select("conv_id", "turn", "section")


FLAGS = """
f AS (SELECT o_custkey AS branch, o_orderkey, o_orderstatus, bool_or(l_returnflag = 'R') AS returned, bool_and(l_linestatus = 'F') AS closed, count(*) > 4 AS big
      FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
"""


def order_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("returned"), F.bool_and(F.col("l_linestatus") == "F").alias("closed"), (F.count("*") > 4).alias("big"))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey")


@add(f"WITH {FLAGS} SELECT o_orderkey AS sha, CASE WHEN closed THEN 'ancestor' WHEN big AND NOT returned THEN 'cherry' WHEN returned THEN 'patchid' ELSE 'none' END AS method FROM f")
def merge_method_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = I.merge_method(F.col("closed"), F.col("big") & ~F.col("returned"), F.col("returned"))
    return order_flags(spark, sf_dir).select(F.col("o_orderkey").alias("sha"), method.alias("method"))


@add(f"WITH {FLAGS} SELECT branch, CASE WHEN bool_or(closed) THEN 'merged' WHEN bool_or(o_orderstatus = 'O') THEN 'open' WHEN bool_or(returned) THEN 'manual' ELSE 'gone' END AS state FROM f GROUP BY branch")
def branch_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = I.branch_state(F.bool_or("closed"), F.bool_or(F.col("o_orderstatus") == "O"), F.bool_or("returned"))
    return order_flags(spark, sf_dir).groupBy(F.col("o_custkey").alias("branch")).agg(state.alias("state"))


#: Answers of a judge and of a resolver, by order; the same in Spark and DuckDB.
ANSWER = """CASE o_orderkey % 8 WHEN 0 THEN concat('VERDICT: DROP', chr(10), 'CONFIDENCE: HIGH', chr(10), 'REASON: known ') WHEN 1 THEN concat('verdict: trim', chr(10), 'confidence: high', chr(10), '---TRIMMED---', chr(10), ' body ', o_custkey, ' ', chr(10), '---END---')
 WHEN 2 THEN concat('VERDICT: TRIM', chr(10), 'CONFIDENCE: high') WHEN 3 THEN concat('  VERDICT: KEEP', chr(10), 'CONFIDENCE: high') WHEN 4 THEN concat('VERDICT: DROP', chr(10), 'CONFIDENCE: maybe') WHEN 5 THEN 'VERDICT: ERASE'
 WHEN 6 THEN concat('DECISION: MERGE', chr(10), '---BODY---', chr(10), 'both ', o_custkey, chr(10), '---END---') ELSE 'DECISION: MERGE' END"""


@add("""SELECT o_orderkey, k[1] AS verdict, k[2] AS confidence, CASE o_orderkey % 8 WHEN 0 THEN 'known' WHEN 1 THEN '' WHEN 3 THEN '' WHEN 4 THEN '' END AS reason,
       CASE WHEN o_orderkey % 8 = 1 THEN 'body ' || o_custkey || chr(10) END AS trimmed, CASE o_orderkey % 8 WHEN 0 THEN 'drop' WHEN 1 THEN 'trim' ELSE 'keep' END AS policy
FROM (SELECT *, CASE o_orderkey % 8 WHEN 0 THEN ['DROP', 'high'] WHEN 1 THEN ['TRIM', 'high'] WHEN 3 THEN ['KEEP', 'high'] WHEN 4 THEN ['DROP', 'low'] END AS k FROM orders)""")
def verdict_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only a verdict of high confidence drops or trims a note, and a trim only with a body; anything else keeps it."""
    told = table(spark, sf_dir, "orders").select("o_orderkey", T.verdict(F.expr(ANSWER)).alias("v"))
    return told.select("o_orderkey", "v.verdict", "v.confidence", "v.reason", "v.trimmed", H.ablation_policy(F.col("v.verdict"), F.col("v.confidence")).alias("policy"))


@add("""SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 6 THEN 'MERGE' END AS decision, CASE WHEN o_orderkey % 8 = 6 THEN 'both ' || o_custkey || chr(10) END AS body,
       CASE WHEN o_orderkey % 8 = 6 THEN 'merge' ELSE 'keep_both' END AS policy FROM orders""")
def merge_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twins are merged only where a resolver says so and gives the body of both."""
    told = table(spark, sf_dir, "orders").select("o_orderkey", T.merge_decision(F.expr(ANSWER)).alias("d"))
    return told.select("o_orderkey", "d.decision", "d.body", H.merge_policy(F.col("d.decision")).alias("policy"))
