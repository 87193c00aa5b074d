"""Queries: session counters over events, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import sessions as S
from ..operators import tickets as K
from ..session import discard, durable, scratch
from ..streaming import counters as C
from ..streaming import state
from .common import Catalogue, table

CATALOGUE = Catalogue()
add = CATALOGUE.add


def hit() -> F.Column:
    """A prompt that found something: the tier is mid or high."""
    return F.col("event_type").isin("purchase", "signup")


@add("""SELECT event_id, user_id, count(*) OVER w AS running_total, (count_if(event_type IN ('purchase', 'signup')) OVER w)::BIGINT AS running_hits
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.running_hits(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], hit()).select("event_id", "user_id", "running_total", "running_hits")


@add("""SELECT user_id, count(*)::BIGINT AS total, count_if(event_type IN ('purchase', 'signup'))::BIGINT AS hits,
       arg_max(event_type, (ts, event_id)) AS last_tier, round(count_if(event_type IN ('purchase', 'signup')) / count(*), 6) AS hit_rate FROM events GROUP BY user_id""")
def session_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.session_counters(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"], hit())


KINDS = ("view", "click", "purchase", "signup", "error")


@add("SELECT user_id, " + ", ".join(f"round(coalesce(sum(value) FILTER (event_type = '{k}'), 0.0), 2) AS {k}" for k in KINDS) + " FROM events GROUP BY user_id")
def tokens_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    pivoted = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", list(KINDS)).agg(F.sum("value"))
    return pivoted.select("user_id", *(F.round(F.coalesce(k, F.lit(0.0)), 2).alias(k) for k in KINDS))


#: Reads of notes and citations of them, by event; the same in Spark and DuckDB.
READ, CITED = "concat('V:\\\\Notes/Learnings/Note', event_id % 7, '.md')", "concat('x/note', event_id % 5, '.MD')"


@add("""WITH r AS (SELECT user_id, 'note' || (event_id % 7) AS k, (value * 100)::BIGINT AS tokens FROM events WHERE event_type = 'view'),
c AS (SELECT DISTINCT user_id, 'note' || (event_id % 5) AS k FROM events WHERE event_type = 'click')
SELECT r.user_id AS session_id, count(*)::BIGINT AS vault_reads, sum(tokens)::BIGINT AS vault_tokens, count(c.k)::BIGINT AS cited_reads, coalesce(sum(CASE WHEN c.k IS NOT NULL THEN tokens END), 0)::BIGINT AS cited_tokens
FROM r LEFT JOIN c ON r.user_id = c.user_id AND r.k = c.k GROUP BY r.user_id""")
def conditional_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of notes in each session, and of these the reads of notes that it cited."""
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "session_id")
    reads = events.where("event_type = 'view'").select("session_id", F.expr(READ).alias("path"), F.round(F.col("value") * 100).cast("long").alias("tokens"))
    reads = reads.where(T.is_vault_read(F.col("path"), "v:/notes"))
    cited = events.where("event_type = 'click'").select("session_id", F.expr(CITED).alias("cited"))
    return K.cited_reads(reads, cited)


@add("""SELECT user_id AS session_id, string_agg(DISTINCT 'note' || (event_id % 5), ',' ORDER BY 'note' || (event_id % 5)) AS cited FROM events WHERE event_type = 'click' GROUP BY user_id""")
def cited_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct keys that each session cites."""
    cited = table(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("user_id").alias("session_id"), T.stem(F.expr(CITED)).alias("key"))
    return cited.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set("key")), ",").alias("cited"))


@add("""WITH RECURSIVE e AS (SELECT user_id, event_type, ts, min(event_id) AS event_id FROM events GROUP BY ALL),
n AS (SELECT event_id, first_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR FOLLOWING AND UNBOUNDED FOLLOWING) AS next_id FROM e),
a AS (SELECT arg_min(event_id, (ts, event_id)) AS event_id FROM e GROUP BY user_id, event_type UNION ALL SELECT next_id FROM a JOIN n USING (event_id) WHERE next_id IS NOT NULL)
SELECT event_id, user_id, event_type FROM events WHERE event_id IN (SELECT event_id FROM a)""")
def ttl_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one user and type less than an hour after the last one that was kept are repeats."""
    return S.drop_repeats(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", 3600, "event_id").select("event_id", "user_id", "event_type")


@add("SELECT date_trunc('day', ts)::TIMESTAMP AS started, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def event_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra: events of each day."""
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), "event_type", "n")


@add("""SELECT started::TIMESTAMP AS started, count(*)::BIGINT AS n FROM (
  SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 18 HOUR, time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 12 HOUR, time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR, time_bucket(INTERVAL 6 HOUR, ts)]) AS started FROM events) GROUP BY 1""")
def event_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra: days that start every six hours."""
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day", "6 hours").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), "n")


@add("""WITH s AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM s)
SELECT user_id, session::BIGINT AS session, min(ts) AS started, max(ts) AS ended, count(*)::BIGINT AS events FROM n GROUP BY user_id, session""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra: sessions that a gap of more than 30 minutes ends."""
    return S.sessions_by_gap(table(spark, sf_dir, "events"), "user_id", "ts", 30, "event_id")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a stream reads a folder; the pattern takes the table whether it is a file or a folder
    return C.event_stream(spark, f"{sf_dir}/[e]vents.parquet")


@add("SELECT user_id, event_type, count(*)::BIGINT AS n, sum(value::DECIMAL(18, 2))::DOUBLE AS total, max(event_id) AS last_event FROM events GROUP BY ALL")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters as a stream over all that is there: equal to the batch totals."""
    folder = scratch(spark, "stream_counts")
    done = durable(C.run_available(C.session_totals(_stream(spark, sf_dir)), folder))
    discard(spark, folder)
    return done.withColumn("total", F.col("total").cast("double"))



@add("""SELECT user_id, count(*)::BIGINT AS total, count_if(event_type IN ('purchase', 'signup'))::BIGINT AS hits,
       arg_max(event_type, (ts, event_id)) AS last_tier, arg_max(event_id, (ts, event_id)) AS last_event FROM events GROUP BY user_id""")
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counters as keyed state of a stream; the last row of each user holds its state."""
    folder = scratch(spark, "stream_state")
    rows = durable(C.run_available(C.keyed_state(_stream(spark, sf_dir)), folder, "update"))
    discard(spark, folder)
    last = rows.groupBy("user_id").agg(F.max_by(F.struct("total", "hits", "last_tier", "last_event"), "total").alias("s"))
    return last.select("user_id", "s.*")


#: Rows of a file of a batch, at least.
FILE_ROWS = 1 << 16


def in_batches(spark: SparkSession, events: DataFrame, path: str, n: int = 4) -> DataFrame:
    """Events written as ``n`` parts in order of time, and read as a stream of one part a batch. A part is as many files as the smallest part can fill, so that many tasks write and read it."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = events.agg(F.percentile_approx(us, [k / n for k in range(1, n)], 10_000)).first()[0]
    parts = [(us > cuts[k - 1]) if k == n - 1 else (us <= cuts[k]) if k == 0 else (us > cuts[k - 1]) & (us <= cuts[k]) for k in range(n)]
    # rows are dealt out in turn, so each file gets some: a batch is a fixed number of files, and an empty one is not written
    files = max(1, min(events.agg(*(F.count_if(p) for p in parts)).first()) // FILE_ROWS)
    for part in parts:
        rows = events.where(part)
        (rows.repartition(files) if files > 1 else rows.coalesce(1)).write.mode("append").parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_result(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """All that the stream's batches wrote, kept beyond the folder."""
    with state.rocks(stream.sparkSession):
        return durable(C.run_available(stream, folder, mode))


@add("""WITH RECURSIVE e AS (SELECT user_id, event_type, ts, min(event_id) AS event_id FROM events GROUP BY ALL),
n AS (SELECT event_id, first_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR FOLLOWING AND UNBOUNDED FOLLOWING) AS next_id FROM e),
a AS (SELECT arg_min(event_id, (ts, event_id)) AS event_id FROM e GROUP BY user_id, event_type UNION ALL SELECT next_id FROM a JOIN n USING (event_id) WHERE next_id IS NOT NULL)
SELECT event_id, user_id FROM events WHERE event_id IN (SELECT event_id FROM a)""")
def stream_ttl_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats suppressed in a stream of four batches: what the batch operator keeps."""
    folder = scratch(spark, "stream_ttl")
    stream = in_batches(spark, table(spark, sf_dir, "events"), f"{folder}/in")
    kept = stream_result(state.suppress_repeats(stream, "user_id", "event_type", "event_id", 3600, 36_000), folder, "append")
    discard(spark, folder)
    return kept.select("event_id", "user_id")


#: What an event's session was shown, the same in Spark and DuckDB.
SHOWN = """concat('<vault-context>', chr(10), CASE WHEN event_id % 4 = 0 THEN '## No strong match' ELSE '## Top matches (3)' END, chr(10), '- [[x/note', event_id % 5, '.MD]] ', repeat('m', CAST(event_id % 90 AS INT)), chr(10),
 CASE WHEN event_id % 3 = 0 THEN concat('### Body excerpt', chr(10), repeat('b', CAST(event_id % 37 AS INT)), chr(10)) ELSE '' END, '  Read body: [[n', event_id % 2, '#part]]', chr(10), '</vault-context>')"""


@add(f"""WITH o AS (SELECT *, {SHOWN} AS output FROM events),
p AS (
  SELECT user_id, ts, event_id, event_type, greatest(1, strlen(output) // 4) AS tokens, 16 // 4 AS header,
         greatest(1, (strlen(CASE WHEN event_id % 4 = 0 THEN '## No strong match' ELSE '## Top matches (3)' END) + 1 + strlen('- [[x/note0.MD]] ') + event_id % 90 + 1) // 4) AS matches,
         CASE WHEN event_id % 3 = 0 THEN (strlen('### Body excerpt') + 1 + event_id % 37 + 1) // 4 END AS body, (strlen('  Read body: [[n0#part]]') + 1 + strlen('</vault-context>')) // 4 AS footer FROM o),
k AS (SELECT user_id, string_agg(DISTINCT key, ',' ORDER BY key) AS cited FROM (SELECT user_id, unnest(['note' || (event_id % 5), 'n' || (event_id % 2)]) AS key FROM events) GROUP BY user_id),
t AS (SELECT user_id, '{{' || string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}}' AS by_tier FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id),
r AS (SELECT user_id, string_agg(tokens::VARCHAR, ',' ORDER BY ts, event_id) AS recent FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5) GROUP BY user_id)
SELECT p.user_id AS session, count(*)::BIGINT AS prompts, sum(tokens)::BIGINT AS total, any_value(by_tier) AS by_tier, any_value(cited) AS cited, any_value(recent) AS recent, arg_max(event_type, (ts, event_id)) AS last_tier,
       '{{' || CASE WHEN count(body) > 0 THEN '"body_excerpt":' || sum(body)::BIGINT || ',' ELSE '' END || '"footer":' || sum(footer)::BIGINT || ',"header":' || sum(header)::BIGINT || ',"matches":' || sum(matches)::BIGINT || '}}' AS by_section,
       epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us
FROM p JOIN k USING (user_id) JOIN t USING (user_id) JOIN r USING (user_id) GROUP BY p.user_id""")
def stream_token_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each session was shown, kept as state over four batches; the last row that each session sent out."""
    folder = scratch(spark, "stream_tokens")
    stream = in_batches(spark, table(spark, sf_dir, "events"), f"{folder}/in")
    prompts = stream.select(F.col("user_id").alias("session"), "ts", F.col("event_id").alias("ord"), F.col("event_type").alias("tier"), F.expr(SHOWN).alias("output"))
    rows = stream_result(state.session_state(prompts), folder, "update")
    discard(spark, folder)
    names = [c for c in rows.columns if c != "session"]
    return rows.groupBy("session").agg(F.max_by(F.struct(*names), "prompts").alias("s")).select("session", "s.*")
