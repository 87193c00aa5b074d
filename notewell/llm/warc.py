"""WARC archives: writing records, and reading them back by verified boundaries.

Archives are plain text files of Spark's own writer: a record ends with two CRLFs, which is the
line separator. Reading splits files at the magic ``WARC/1.1`` wherever it stands, so a payload
that holds the magic gives false candidates. Each candidate names the offset of its successor;
pointer jumping from the start of the file keeps those that are reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, compact, join_hot, join_measured, prepare

MAGIC = "WARC/1.1\r\n"
CRLF = "\r\n"
GAP = CRLF + CRLF
#: Bytes of one file, about.
FILE_BYTES = 256 << 20
#: The digits of base32 (RFC 4648).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a SHA-1 in hex: each five hex digits are four base32 digits."""
    digits = []
    for g in range(8):
        value = F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            at = F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1
            digits.append(F.substr(F.lit(BASE32), at, F.lit(1)))
    return F.concat(*digits)


def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, digest, bytes) of each page, checkpointed; the texts are read once for it."""
    payload = F.coalesce("html", F.lit(""))
    return pages.select("page_id", F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("bytes")).checkpoint()


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", per_file: int | None = None) -> None:
    """Write a record per row of (page_id, url, html) to ``path``, ``per_file`` of them or as many as have some FILE_BYTES.

    Of the rows with one payload (of ``min_bytes`` or more), that with the smallest page_id is
    the response and the others revisit it; a null id comes last. Rows that repeat that smallest id
    together with its payload are responses too. A null html is empty, a null url ``about:blank``; control
    characters and spaces of a url are percent-encoded. Other columns are ignored; an empty table
    writes no record.
    """
    prepare(pages.sparkSession)
    small = plan_records(pages)
    again = (
        small.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").checkpoint()
    )
    n, total = small.agg(F.count("*"), F.sum(F.col("bytes") + 512)).first()
    per_file = per_file or max(1, n * FILE_BYTES // (total or 1))
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"),
                        F.octet_length(payload).cast("long").alias("bytes"))
    few = again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # a payload of many pages stays where it is; the others may be shuffled
    rows = rows.join(F.broadcast(again.drop("n")), ["digest", "bytes"], "left") if few else join_hot(rows, again, ["digest", "bytes"], "n", n, "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    url = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\x00-\x20\x7f]", "%20")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes"), F.lit(GAP))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(CRLF)), F.lit(""))
    head = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.coalesce(urn(F.col("page_id")), F.lit("<urn:page:none>"))), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("digest")))),
        line("WARC-Refers-To", F.when(revisit, urn(F.col("first")))),
        line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF))
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", GAP).option("maxRecordsPerFile", per_file).text(path)


def _fields(head: Column) -> dict[str, Column]:
    """What a candidate's header says."""
    said = lambda name, rest: F.regexp_extract(head, rf"(?m)^{name}: {rest}\r?$", 1)
    return {"start": F.octet_length(head) + 4, "_len": said("Content-Length", r"(\d{1,12})"),
            "kind": said("WARC-Type", r"(\w+)"), "page_id": said("WARC-Record-ID", r"<urn:page:(-?\d+)>"),
            "refers": said("WARC-Refers-To", r"<urn:page:(-?\d+)>"), "digest": said("WARC-Payload-Digest", r"sha1:(\w+)")}


def _parse(df: DataFrame) -> DataFrame:
    """Add the fields of the candidate in ``value``, and bytes and SHA-1 of its payload."""
    df = df.withColumn("_head", F.substring_index("value", GAP, 1)).withColumns(_fields(F.col("_head")))
    length = F.expr("try_cast(_len AS BIGINT)")
    df = df.withColumn("length", F.when(F.contains("value", F.lit(GAP)), length))
    block = F.substring(F.col("value").cast("binary"), F.col("start") + 1, F.col("length").cast("int"))
    df = df.withColumn("_block", block)
    inner = F.substring_index(F.col("_block").cast("string"), GAP, 1)
    payload = F.substring(F.col("_block"), F.octet_length(inner) + 5, F.octet_length("_block"))
    return df.withColumn("_payload", payload).select(
        *(c for c in df.columns if c not in ("value", "_head", "_len", "_block")),
        F.octet_length("_payload").cast("long").alias("bytes"), F.sha1("_payload").alias("sha1"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, kind, refers, digest (as the record says), bytes and sha1 (of its own payload).

    A record whose payload holds the magic lies in several segments; just those segments are
    read again and put together. They are known again by file and content, as a later scan may be
    cut into other partitions than the first: numbers of rows hold inside one scan only.
    """
    prepare(spark)
    lines = spark.read.option("lineSep", MAGIC).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.md5("value").alias("mark"), F.col("_metadata.file_block_start").alias("part"))
    raw = lines.select("*", F.monotonically_increasing_id().alias("nth"), F.octet_length("value").cast("long").alias("seg"))
    seen = _parse(raw).checkpoint()

    # offsets: the segments and the magics between them tile the file
    m = len(MAGIC)
    inside = Window.partitionBy("file", "part").orderBy("nth")
    parts = seen.groupBy("file", "part").agg(F.sum(F.col("seg") + m).alias("_sum"))
    ahead = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("file", "part", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_before"))
    start = F.sum(F.col("seg") + m).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    placed = seen.withColumn("_in", F.coalesce(start, F.lit(0))).join(parts, ["file", "part"])
    placed = placed.withColumn("off", F.col("_in") + F.col("_before") - m).where("off >= 0")
    size = F.col("start") + F.col("length") + 4
    placed = placed.withColumn("next", F.col("off") + m + size).withColumn("whole", size == F.col("seg"))
    placed = placed.drop("_in", "_before", "part", "nth").checkpoint()

    true = reachable(placed.select("file", "off", "next"))
    marked = placed.join(true.withColumn("_true", F.lit(True)), ["file", "off"], "left").withColumn("_true", F.coalesce("_true", F.lit(False))).checkpoint()
    fields = ["page_id", "kind", "refers", "digest", "bytes", "sha1"]
    records = marked.where("_true AND whole").select(*fields)

    # records in several segments
    owner = F.max(F.when(F.col("_true"), F.struct("off", "whole"))).over(Window.partitionBy("file").orderBy("off"))
    torn = marked.select("file", "off", "mark", "_true", "whole").withColumn("own", owner).where("own IS NOT NULL AND NOT own.whole")
    torn = torn.select("file", "mark", F.col("own.off").alias("own"), F.col("off").alias("at")).checkpoint()
    if torn.isEmpty():
        return records
    wanted = torn.select("file", "mark").distinct().checkpoint()
    texts = join_measured(lines.select("file", "mark", "value"), wanted, ["file", "mark"]).dropDuplicates(["file", "mark"])
    bits = texts.join(torn, ["file", "mark"]).groupBy("file", "own").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("bits"))
    whole = bits.select(F.array_join(F.transform("bits", lambda b: b["value"]), MAGIC).alias("value"))
    return records.unionByName(_parse(whole).select(*fields))


def reachable(candidates: DataFrame) -> DataFrame:
    """(file, off) of the candidates (file, off, next) that are reached from offset 0.

    Doubling: in round k, what lies within 2^k steps of the start jumps 2^k steps further.
    """
    n = candidates.count()
    kept = lambda df: compact(df, n).checkpoint()
    known = candidates.select("file", F.col("off").alias("next"))
    jump = kept(candidates.where("next > off").join(known, ["file", "next"], "left_semi").select("file", "off", "next"))
    reach = kept(candidates.where("off = 0").select("file", "off"))
    while True:
        front = kept(reach.join(jump, ["file", "off"]).select("file", F.col("next").alias("off")))
        if front.isEmpty():
            return reach
        reach = compact(reach.union(front), n)
        then = jump.select("file", F.col("off").alias("next"), F.col("next").alias("far"))
        jump = kept(jump.join(then, ["file", "next"]).select("file", "off", F.col("far").alias("next")))


def resolve(records: DataFrame) -> DataFrame:
    """One row per record with the figures of the full payload: a revisit has those of the response whose id and digest it refers to.

    Where responses repeat an id with other payloads, the digest tells which one is meant. A revisit without its response has no figures.
    """
    records = records.withColumn("digest_read", base32_of_hex(F.col("sha1"))).checkpoint()
    own = F.struct("bytes", "digest_read")
    revisits = records.where(F.col("kind") == "revisit")
    responses = records.where("kind = 'response' AND page_id <> ''").groupBy(F.col("page_id").alias("refers"), "digest").agg(F.min(own).alias("full"))
    wanted = revisits.groupBy("refers", "digest").agg(F.count("*").alias("n")).join(responses, ["refers", "digest"], "left").checkpoint()
    found = join_hot(revisits, wanted, ["refers", "digest"], "n", revisits.count())
    rows = found.select("page_id", "kind", "refers", "full").unionByName(
        records.where(F.col("kind") != "revisit").select("page_id", "kind", "refers", own.alias("full")))
    number = lambda c: F.expr(f"try_cast({c} AS BIGINT)")
    return rows.select(
        number("page_id").alias("page_id"), F.col("full.bytes").alias("payload_bytes"), F.col("full.digest_read").alias("payload_digest"),
        F.col("kind").alias("record_type"), number("refers").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p),
g AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(h, (5 * i + 1)::INT, 5))::INT) AS v FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((v[i // 4 + 1] >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
"""
