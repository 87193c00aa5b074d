"""Queries: a whole vault of notes rendered from the documents, and lookups over sessions, tickets and logs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import Vault
from ..functions import text as T
from ..functions import vectors as V
from ..operators import incremental as I
from ..operators import retrieval as R
from ..operators import sessions as S
from ..operators import tickets as K
from ..session import discard, durable, scratch, ship, spread
from ..sources import notes as N
from ..sources.growing import follow_lines
from ..sources.notes import file_system
from ..streaming import counters as C
from .common import BM25_SQL, PATH, PATHS_SQL, Catalogue, rendered_paths, table

CATALOGUE = Catalogue()
add = CATALOGUE.add

#: A document as a note's text; the same in Spark and DuckDB.
RAW = """concat('---', chr(10), 'title: "T ', doc_id, '"', chr(10), 'tags: [', lang, ', ', source, ']', chr(10), 'module: m', doc_id % 4, chr(10),
 CASE doc_id % 3 WHEN 0 THEN concat('status: open', chr(10)) WHEN 1 THEN concat('status: ', CASE WHEN doc_id % 7 = 0 THEN 'discarded' ELSE 'resolved' END, chr(10)) ELSE '' END,
 CASE WHEN doc_id % 2 = 0 THEN concat('description: D', doc_id, chr(10)) ELSE '' END, 'opened: 2026-0', doc_id % 9 + 1, '-11', chr(10), CASE WHEN doc_id % 5 = 2 THEN concat('resolved: 2026-1', doc_id % 3, '-05', chr(10)) ELSE '' END,
 '---', chr(10), '# Head ', doc_id, chr(10), coalesce(text, ''), chr(10), '[[n', doc_id + 1, ']] [[x/n', doc_id + 3, '|see]] [[nowhere]]')"""


def notes(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    """The manifest of all notes, parsed once and written; or, for what reads it ``once``, parsed where it is read, and only what is asked of it."""
    files = rendered_paths(spark, sf_dir).select("path", F.expr(RAW).alias("raw"), F.lit("2026-01-01").cast("timestamp").alias("mtime"), F.md5(F.col("doc_id").cast("string")).alias("sha"))
    found = N.parse_notes(files)
    return found if once else durable(found)


#: What a vault holds of each note, straight from how it was rendered.
NOTES = f"""
{PATHS_SQL},
kept AS (SELECT *, string_split(path, '/') AS s, doc_id % 10 AS place FROM p WHERE doc_id % 10 NOT IN (7, 9)),
n0 AS (
  SELECT doc_id, path, lang, source, CASE WHEN place = 0 THEN 'workspace' WHEN place = 1 THEN 'project' WHEN place IN (2, 4, 6) THEN 'index' ELSE 'ticket' END AS scope,
         CASE WHEN ends_with(path, '/_index.md') THEN '_index' ELSE replace(s[-1], '.md', '') END AS name, s[1] AS workspace, CASE WHEN place <> 0 THEN s[2] END AS project,
         CASE WHEN ends_with(path, '/_index.md') THEN substr(path, 1, length(path) - 10) ELSE split_part(path, '/Learnings/', 1) END AS ticket_dir,
         CASE doc_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN CASE WHEN doc_id % 7 = 0 THEN 'discarded' ELSE 'resolved' END END AS own,
         CASE WHEN doc_id % 2 = 0 THEN 'D' || doc_id ELSE 'T ' || doc_id END AS description, 'm' || (doc_id % 4) AS module,
         CASE WHEN doc_id % 5 = 2 THEN make_date(2026, (10 + doc_id % 3)::INT, 5) ELSE make_date(2026, (doc_id % 9 + 1)::INT, 11) END AS dated,
         trim('# Head ' || doc_id || chr(10) || coalesce(text, '') || chr(10) || '[[n' || (doc_id + 1) || ']] [[x/n' || (doc_id + 3) || '|see]] [[nowhere]]') AS body
  FROM kept),
n AS (
  SELECT n0.*, coalesce(n0.own, i.own, '') AS status, coalesce(i.dated, n0.dated) AS authored FROM n0 LEFT JOIN (SELECT ticket_dir, own, dated FROM n0 WHERE scope = 'index') i USING (ticket_dir))
"""


@add(f"WITH {NOTES} SELECT path, name, scope, workspace, project, ticket_dir, 'T ' || doc_id AS title, description, module, lang || ',' || source AS tags, status, strftime(authored, '%Y-%m-%d') AS authored, md5(body) AS body FROM n")
def vault_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with what their front matter says, and what they take from their ticket's index."""
    return notes(spark, sf_dir).select("path", "name", "scope", "workspace", "project", "ticket_dir", "title", "description", "module", F.array_join("tags", ",").alias("tags"), "status", F.date_format("authored", "yyyy-MM-dd").alias("authored"), F.md5("body").alias("body"))


LEXICAL = "concat_ws(' ', name, lang || ' ' || source, module, description, project)"
ASKED = "SELECT item_id AS query_id, 'T D' || item_id * 7 || ' m' || (item_id % 4) || ' src' || (item_id % 20) || ' p' || item_id AS text FROM benchmark"
FOUND = f"""
{NOTES}, docs AS (SELECT path AS id, {LEXICAL} AS text FROM n), asked AS ({ASKED}),
{BM25_SQL.replace("round(sum(", "(sum(").replace(", 6) AS bm25", ") AS bm25")},
w AS (SELECT query_id, b.id, round(bm25 * (CASE scope WHEN 'workspace' THEN 1.3::DOUBLE WHEN 'project' THEN 1.2::DOUBLE WHEN 'index' THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END)
  * (CASE status WHEN 'discarded' THEN 0.0::DOUBLE WHEN 'experimental' THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END), 6) AS score FROM bm25 b JOIN n ON n.path = b.id),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM w WHERE score > 0 QUALIFY rank <= 8)
"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat('T D', item_id * 7, ' m', item_id % 4, ' src', item_id % 20, ' p', item_id)")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("query"))


@add(f"""WITH {FOUND} SELECT query_id, id, score, rank::INT AS rank, CASE WHEN top >= 8 THEN 'high' WHEN top >= 5 THEN 'mid' ELSE 'low' END AS tier
FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM hits)""")
def vault_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best notes of each prompt by what they are called and tagged, weighed by scope and status."""
    return Vault(notes(spark, sf_dir)).search(asked(spark, sf_dir)).select("query_id", "id", "score", "rank", "tier")


@add(f"""WITH {FOUND}, t AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM hits),
shown AS (SELECT t.*, n.description, n.body FROM t JOIN n ON n.path = t.id WHERE top >= 5),
lines AS (SELECT query_id, rank AS place, printf('- [[%s]] (score=%.2f) %s', id, score, substr(description, 1, 120)) AS line FROM shown
  UNION ALL SELECT query_id, 100, CASE WHEN length(body) > 1200 THEN substr(body, 1, 1200) || chr(10) || '[...truncated]' ELSE body END FROM shown WHERE rank = 1 AND top >= 8),
names AS (SELECT name, min(path) AS path FROM n GROUP BY name),
e AS (SELECT n.path AS src, unnest([1, 2, 3]) AS pos, unnest(['n' || (n.doc_id + 1), 'x/n' || (n.doc_id + 3), 'nowhere']) AS raw, unnest(['n' || (n.doc_id + 1), 'n' || (n.doc_id + 3), 'nowhere']) AS name FROM n
  WHERE n.path IN (SELECT id FROM shown WHERE rank <= 2)),
found AS (SELECT s.query_id, coalesce(names.path, e.raw) AS dst, min((s.rank, e.pos)) AS first_at FROM shown s JOIN e ON e.src = s.id LEFT JOIN names USING (name) WHERE s.rank <= 2 GROUP BY ALL),
related AS (SELECT query_id, 200 + row_number() OVER (PARTITION BY query_id ORDER BY first_at, dst) AS place, '- related [[' || dst || ']]' AS line FROM found f
  WHERE NOT EXISTS (SELECT 1 FROM shown s WHERE s.query_id = f.query_id AND s.id = f.dst) QUALIFY place <= 205)
SELECT query_id, md5(string_agg(line, chr(10) ORDER BY place)) AS block FROM (FROM lines UNION ALL FROM related) GROUP BY query_id""")
def vault_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that is shown with each prompt: matches, an excerpt of the best one, and what the best two link to."""
    return Vault(notes(spark, sf_dir)).context(asked(spark, sf_dir)).select("query_id", F.md5("block").alias("block"))


@add(f"WITH {NOTES}, m AS (SELECT path, name, unnest(['n' || (doc_id + 1), 'n' || (doc_id + 3), 'nowhere']) AS target FROM (SELECT path, replace(string_split(path, '/')[-1], '.md', '') AS name, doc_id FROM n)), "
     "k AS (SELECT path, replace(string_split(path, '/')[-1], '.md', '') AS name FROM n) SELECT k.path AS id, count(DISTINCT m.path)::BIGINT AS inbound FROM k LEFT JOIN m ON m.target = k.name AND m.name <> k.name GROUP BY k.path")
def vault_inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other notes mention each note, besides what their documents' own texts link to (nothing)."""
    return Vault(notes(spark, sf_dir, once=True)).inbound()


@add(f"WITH {NOTES} SELECT path, description, strftime(authored, '%Y-%m-%d') AS authored FROM n WHERE scope <> 'index' AND project = 'p1' ORDER BY n.authored DESC NULLS LAST, path DESC LIMIT 500")
def vault_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One project's learnings, newest first: a page of at most 500."""
    return Vault(notes(spark, sf_dir)).list(project="p1").select("path", "description", F.date_format("authored", "yyyy-MM-dd").alias("authored"))


@add(f"""WITH {NOTES}, l AS (SELECT * FROM n WHERE scope <> 'index'), t AS (SELECT * FROM n WHERE scope = 'index')
SELECT 'learnings' AS kind, '' AS key, count(*)::BIGINT AS n FROM l UNION ALL SELECT 'tickets', '', count(*) FROM t UNION ALL SELECT 'status', CASE status WHEN '' THEN 'unknown' ELSE status END, count(*) FROM t GROUP BY 2
UNION ALL SELECT 'project', coalesce(project, ''), count(*) FROM l GROUP BY 2 UNION ALL SELECT 'month', strftime(authored, '%Y-%m'), count(*) FROM l GROUP BY 2
UNION ALL SELECT 'tag', tag, count(*) FROM (SELECT unnest([lang, source]) AS tag FROM l) GROUP BY 2""")
def vault_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, tickets by status, learnings by project, month and tag."""
    return Vault(notes(spark, sf_dir)).overview()


@add(f"WITH {NOTES} SELECT scope, project, count(*)::BIGINT AS n FROM n GROUP BY GROUPING SETS ((scope), (project), ())")
def vault_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Vault(notes(spark, sf_dir)).stats()


@add(f"WITH {NOTES} SELECT path, name, status, octet_length(encode(body)) > 64000 AS long FROM n WHERE doc_id % 4 = 1")
def vault_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that are asked for by path; paths that are none give nothing."""
    wanted = rendered_paths(spark, sf_dir).where("doc_id % 4 = 1").select("path").union(spark.sql("SELECT '../../etc/passwd' AS path"))
    read = Vault(notes(spark, sf_dir, once=True)).read(wanted)
    return read.select("path", "name", "status", (F.octet_length("body") >= 63_997).alias("long"))


@add(f"""WITH {NOTES}, old AS (SELECT path, CASE WHEN doc_id % 6 = 0 THEN 'other' ELSE md5(doc_id::VARCHAR) END AS sha FROM p WHERE doc_id % 5 <> 1)
SELECT action, count(*)::BIGINT AS n FROM (SELECT CASE WHEN old.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN old.sha = md5(n.doc_id::VARCHAR) THEN 'skipped' ELSE 'updated' END AS action FROM n FULL JOIN old USING (path)) GROUP BY action""")
def vault_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index of earlier notes has to do, vanished ones included."""
    old = rendered_paths(spark, sf_dir).where("doc_id % 5 <> 1").select("path", F.when(F.col("doc_id") % 6 == 0, "other").otherwise(F.md5(F.col("doc_id").cast("string"))).alias("sha"))
    return Vault(notes(spark, sf_dir)).reindex(old).groupBy("action").agg(F.count("*").alias("n"))


@add(f"""WITH {NOTES}, i AS (SELECT path, substr(path, 1, length(path) - 10) AS folder FROM n WHERE scope = 'index')
SELECT n.path, coalesce(a.path, b.path, c.path) AS index FROM (SELECT path, array_to_string(s[1:len(s) - 2], '/') AS f0, array_to_string(s[1:len(s) - 3], '/') AS f1, array_to_string(s[1:len(s) - 4], '/') AS f2
  FROM (SELECT path, string_split(path, '/') AS s FROM n WHERE scope <> 'index')) n LEFT JOIN i a ON a.folder = f0 LEFT JOIN i b ON b.folder = f1 LEFT JOIN i c ON c.folder = f2""")
def nearest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index that governs each learning."""
    found = notes(spark, sf_dir).select("path", "scope")
    return K.nearest_index(found.where("scope <> 'index'").select("path"), found.where("scope = 'index'").select("path"))


@add(f"""WITH {NOTES}, l AS (SELECT ticket_dir, path, row_number() OVER (PARTITION BY ticket_dir ORDER BY path) AS k FROM n WHERE scope = 'ticket' QUALIFY k <= 8)
SELECT t.ticket_dir, concat_ws(chr(10), 'description: ' || t.description, CASE WHEN t.status <> '' THEN 'status: ' || t.status END, string_agg('- ' || l.path, chr(10) ORDER BY l.path)) AS block
FROM n t LEFT JOIN l USING (ticket_dir) WHERE t.scope = 'index' GROUP BY t.ticket_dir, t.description, t.status""")
def ticket_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ticket's fields that are set, and its first learnings."""
    found = notes(spark, sf_dir)
    return K.ticket_block(found.where("scope = 'index'"), found.where("scope = 'ticket'"), ("description", "status"))


@add(f"""WITH {NOTES} SELECT path, CASE WHEN doc_id % 8 = 0 THEN 'closed' ELSE coalesce(own, '') END AS status FROM n0""")
def set_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status written into some notes, in place or new; the others keep what their own front matter says."""
    files = rendered_paths(spark, sf_dir).select("doc_id", "path", F.expr(RAW).alias("raw"))
    own = F.coalesce(F.get(T.front_matter(F.col("raw"))["status"], F.lit(0)), F.lit(""))
    before = files.where(T.scope_of(F.col("path")).isNotNull()).select("path", own.alias("status"))
    new = files.where("doc_id % 8 = 0").select("path", F.lit("closed").alias("status"))
    return N.set_status(before, new)


@add(f"""WITH {PATHS_SQL}, r AS (SELECT path, {RAW} AS raw, doc_id FROM p)
SELECT path, md5(CASE WHEN doc_id % 3 = 2 THEN replace(raw, '-11' || chr(10) || CASE WHEN doc_id % 5 = 2 THEN 'resolved: 2026-1' || (doc_id % 3) || '-05' || chr(10) ELSE '' END || '---',
    '-11' || CASE WHEN doc_id % 5 = 2 THEN chr(10) || 'resolved: 2026-1' || (doc_id % 3) || '-05' ELSE '' END || chr(10) || 'status: closed' || chr(10) || chr(10) || '---')
  ELSE regexp_replace(raw, 'status: [a-z]+', 'status: closed') END) AS note FROM r""")
def patched_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes' own texts with a status written into them, in place of the old one or as a last line of the front matter."""
    files = rendered_paths(spark, sf_dir).select("path", F.expr(RAW).alias("raw"))
    return files.select("path", F.md5(T.patch_status(F.col("raw"), F.lit("closed"))).alias("note"))


@add(f"""WITH {NOTES} SELECT path, md5('---' || chr(10) || 'title: "T ' || doc_id || '"' || chr(10) || 'module: m' || (doc_id % 4) || chr(10)) AS head, substr(description || chr(10) || 'Head ' || doc_id, 1, 40) AS claim FROM n""")
def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note's head without its tags, and what it claims."""
    files = rendered_paths(spark, sf_dir).where(T.scope_of(F.col("path")).isNotNull()).select("doc_id", "path", F.expr(RAW).alias("raw"))
    bare = T.drop_field(F.substring_index("raw", "module: ", 1), "tags")
    head = F.concat(bare, F.expr("concat('module: m', doc_id % 4, chr(10))"))
    described = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("D"), F.col("doc_id"))).otherwise(F.concat(F.lit("T "), F.col("doc_id")))
    claim = T.claim(described, T.note_body(F.col("raw")))
    cut = F.substring_index(claim, "\n", 2)
    return files.select("path", F.md5(head).alias("head"), F.substring(cut, 1, 40).alias("claim"))


@add("""SELECT c_custkey, '-w-' || c_mktsegment || '-' || c_custkey AS cwd, replace(c_name, '#', '') AS session, '1.' || (c_custkey % 30) || '.' || CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 7 ELSE 0 END AS version,
       '["0' || (c_custkey % 10) || ':' || lpad((c_custkey % 60)::VARCHAR, 2, '0') || '"]' AS times, '[' || repeat('#', bar) || repeat('-', 18 - bar) || '] ' || printf('%.1f', (c_custkey % 101)::DOUBLE) || '%' AS share,
       'a' || chr(10) || c_custkey || chr(10) || 'b' AS lines, CASE WHEN len(k) > 1 THEN k[1] ELSE '' END AS kind, 'w/' || c_custkey AS pair
FROM (SELECT *, round((c_custkey % 101) / 100 * 18)::INT AS bar, string_split(CASE WHEN c_custkey % 2 = 0 THEN 'feat/' || c_custkey ELSE 'main' END, '/') AS k FROM customer)""")
def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders, session names, versions, times, bars, line ends and labels of rendered texts."""
    e = F.expr
    times = T.clock_times(e("array(concat(c_custkey % 10, ':', lpad(CAST(c_custkey % 60 AS STRING), 2, '0')), '24:00', concat('0', c_custkey % 10, ':', lpad(CAST(c_custkey % 60 AS STRING), 2, '0')))"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", T.encode_cwd(e("concat('/w/', c_mktsegment, '_', c_custkey)")).alias("cwd"), T.clean_session_id(F.col("c_name")).alias("session"),
        F.array_join(T.version_triple(e("concat('v1.', c_custkey % 30, CASE WHEN c_custkey % 2 = 0 THEN concat('.', c_custkey % 7) ELSE '' END)")).cast("array<string>"), ".").alias("version"), F.to_json(times).alias("times"),
        T.percent_bar(e("CAST(c_custkey % 101 AS DOUBLE) / 100")).alias("share"), T.unix_lines(e("concat('a', chr(13), chr(10), c_custkey, chr(13), 'b')")).alias("lines"),
        T.split_branch(e("CASE WHEN c_custkey % 2 = 0 THEN concat('feat/', c_custkey) ELSE 'main' END"))["type"].alias("kind"), T.pair_label(e("concat('v/w/', c_custkey)")).alias("pair"))


@add("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'M' ELSE '-' END AS glyph, printf('%,d', page_id * 1001) AS n, 'b' || page_id || ' | s1 | ' || url || ' | st' AS query, 'Do b' || page_id || ' for ' || url || '.' AS prompt FROM pages""")
def prompt_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs, numbers, search texts and filled templates."""
    branch = F.concat(F.lit("b"), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select(
        "page_id", T.tier_glyph(F.expr("CASE page_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'mid' ELSE NULL END")).alias("glyph"), T.thousands(F.col("page_id") * 1001).alias("n"),
        T.query_text(branch, F.array(F.lit("s1"), F.col("url")), F.lit("st")).alias("query"), T.fill("Do <<BRANCH>> for <<URL>>.", BRANCH=branch, URL=F.col("url")).alias("prompt"))


@add("""SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE text IS NOT NULL""")
def transcript_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as JSON lines, a third each plain, .gz and .zst, with broken and blank lines among them, and read back."""
    path = scratch(spark, "transcripts")
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    blocks = F.to_json(F.array(F.struct(F.lit("text").alias("type"), "text")))
    # the value alone of {"s":value}
    plain = F.regexp_replace(F.to_json(F.struct(F.col("text").alias("s"))), r'^\{"s":|\}$', "")
    said = F.when(F.col("turn") % 2 == 0, blocks).otherwise(plain)
    stamp = F.concat_ws(":", "conv_id", "turn")
    line = F.concat(F.lit('{"timestamp":"'), stamp, F.lit('","item":{"type":"message","role":"'), F.col("role"), F.lit('","content":'), said, F.lit("}}"))
    broken = F.when(F.col("turn") == 0, F.array(line, F.lit("{nope"), F.lit(""))).otherwise(F.array(line))
    lines = rows.select("conv_id", F.explode(broken).alias("value"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = file_system(f"{path}/zst")
        store.create_dir(folder)
        for n, b in enumerate(batches):
            with store.open_output_stream(f"{folder}/{TaskContext.get().partitionId()}-{n}.jsonl.zst", compression="zstd") as out:
                out.write("".join(f"{x}\n" for x in b.column(1).to_pylist()).encode())
            yield b.select(["conv_id"])

    lines.where("conv_id % 3 = 0").select("value").write.option("compression", "gzip").text(f"{path}/gz")
    lines.where("conv_id % 3 = 1").select("value").write.text(f"{path}/plain")
    lines.where("conv_id % 3 = 2").mapInArrow(write, "conv_id long").count()
    at = F.split("timestamp", ":")
    read = durable(N.read_transcripts(spark, path).select(at[0].cast("long").alias("conv_id"), at[1].cast("long").alias("turn"), "role", "text"))
    discard(spark, path)
    return read


@add("""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations),
r AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN [text] WHEN 1 THEN [text, '[tool_use:grep]', '[tool_use:?]'] WHEN 2 THEN ['[tool_result]: ' || substr(text, 1, 400), text]
  ELSE ['[tool_result]: ' || substr(text, 1, 400) || chr(10) || '[tool_result]: turn ' || turn] END AS parts FROM t)
SELECT conv_id, turn, md5(coalesce(array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)), '')) AS text FROM r""")
def transcript_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as strings, text blocks, tool calls, and tool results of a string or a list, rendered from their JSON."""
    text = F.coalesce("text", F.lit(""))
    said = F.struct(F.lit("text").alias("type"), text.alias("text"))
    js = lambda *parts: F.concat(F.lit("["), F.array_join(F.array(*(F.to_json(p) for p in parts)), ", "), F.lit("]"))
    call = F.struct(F.lit("tool_use").alias("type"), F.lit("grep").alias("name"), F.struct(F.lit("x").alias("pattern")).alias("input"))
    listed = F.concat(F.lit('[{"type":"tool_result","id":7,"content":['), F.to_json(said), F.lit(',{"type":"image","text":"no"},{"type":"text","text":"turn '), F.col("turn").cast("string"), F.lit('"}]}]'))
    # the value alone of {"s":value}
    plain = F.regexp_replace(F.to_json(F.struct(text.alias("s"))), r'^\{"s":|\}$', "")
    kind = F.col("turn") % 4
    content = (F.when(kind == 0, plain).when(kind == 1, js(said, call, F.struct(F.lit("tool_use").alias("type")), F.struct(F.lit("thinking").alias("type"))))
               .when(kind == 2, js(F.struct(F.lit("tool_result").alias("type"), text.alias("content")), said)).otherwise(listed))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", content.alias("content")).select("conv_id", "turn", F.md5(N.record_text("content")).alias("text"))


@add("SELECT sha1(o_orderkey::VARCHAR) AS sha, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS subject FROM orders")
def commit_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as a tab-separated log, and read back."""
    path = scratch(spark, "commits")
    line = F.concat_ws("\t", F.sha1(F.col("o_orderkey").cast("string")), F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority")
    table(spark, sf_dir, "orders").select(line.alias("value")).write.text(path)
    read = durable(N.read_commits(spark, path))
    discard(spark, path)
    return read


@add("""SELECT c_custkey AS session_id, CASE WHEN c_custkey % 3 = 0 THEN 'id' || c_custkey WHEN c_nationkey % 2 = 0 THEN 'cwd' || c_nationkey END AS path FROM customer""")
def session_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts by session, else by working folder."""
    customers = table(spark, sf_dir, "customer")
    sessions = customers.select(F.col("c_custkey").alias("session_id"), F.concat(F.lit("/w/n_"), F.col("c_nationkey")).alias("cwd"))
    by_id = customers.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("session_id"), F.concat(F.lit("id"), F.col("c_custkey")).alias("path"))
    by_cwd = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("-w-n-"), F.col("n_nationkey")).alias("folder"), F.concat(F.lit("cwd"), F.col("n_nationkey")).alias("path"))
    return K.session_transcripts(sessions, by_id, by_cwd)


#: Every third document's session left a mark, a piece of its text; logs are the documents, changed over thirty days.
MARKED = "substr(text, 9, CAST(24 + doc_id % 9 AS INT))"


@add(f"""WITH m AS (SELECT doc_id AS session_id, {MARKED} AS token, doc_id % 31 AS day FROM documents WHERE doc_id % 3 = 0),
l AS (SELECT 'd' || doc_id AS path, text, doc_id * 7 % 30 AS day FROM documents)
SELECT session_id, min(path) AS path FROM m LEFT JOIN l ON token <> '' AND contains(l.text, token) AND l.day >= m.day - 1 GROUP BY session_id""")
def marked_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first log that holds each session's mark and was changed no more than a day before it."""
    docs = table(spark, sf_dir, "documents")
    day = lambda c: F.timestamp_seconds(F.expr(c) * 86_400)
    marks = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("session_id"), F.expr(MARKED).alias("mark_token"), day("doc_id % 31").alias("marked_at"))
    logs = spread(docs.select("doc_id", "text")).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "text", day("doc_id * 7 % 30").alias("mtime"))
    return K.marked_transcripts(marks, logs)


@add("""SELECT branch, arg_min(path, (other, path)) AS path FROM (SELECT p_name AS branch, 'w/' || p_brand || '/' || p_partkey AS path, CASE WHEN p_brand = 'Brand#1' THEN 0 ELSE 1 END AS other FROM part) GROUP BY branch""")
def folder_of_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A branch's folder: in the project of the working folder, else the first."""
    parts = table(spark, sf_dir, "part")
    folders = parts.select(F.col("p_name").alias("branch"), F.col("p_brand").alias("project"), F.concat_ws("/", F.lit("w"), "p_brand", "p_partkey").alias("path"))
    return K.folder_of_branch(parts.select(F.col("p_name").alias("branch"), F.lit("/src/Brand#1").alias("cwd")).distinct(), folders)


@add("""SELECT p_brand AS key, arg_min(path, (len(string_split(path, '/')), path)) AS path FROM (SELECT p_brand, repeat('d/', (p_size % 3)::INT) || 'f' || p_partkey AS path FROM part) GROUP BY p_brand""")
def shallowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a key's files the one least deep."""
    path = F.expr("concat(repeat('d/', p_size % 3), 'f', p_partkey)")
    return K.shallowest(table(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), path.alias("path")), "key")


@add("SELECT c_custkey AS t, CASE WHEN k IN (0, 1, 2, 4) THEN true ELSE false END AS open, k IN (0, 1, 4) AS capture FROM (SELECT c_custkey, c_custkey % 6 AS k FROM customer)")
def ticket_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tickets are open, and which still take captures."""
    status = F.element_at(F.array(*map(F.lit, ("open", "in-progress", "experimental", "resolved", "", "discarded"))), (F.col("c_custkey") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("t"), status.alias("status"))
    still = K.open_tickets(rows).select("t", F.lit(True).alias("_open"))
    return rows.join(still, "t", "left").select("t", F.col("_open").isNotNull().alias("open"), K.may_capture(F.col("status")).alias("capture"))


@add("SELECT label AS path, b AS other, max(score) AS score FROM (SELECT 'w/Learnings/' || (a.vec_id % 7) || '.md' AS label, 'w/Learnings/' || (b.label) || '.md' AS b, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score "
     "FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id) WHERE label <> b GROUP BY ALL")
def best_per_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all chunk pairs of one label the best for each pair of notes."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label", (F.col("vec_id") % 7).alias("chunk"))
    note = lambda c: F.concat(F.lit("w/Learnings/"), F.col(c).cast("string"), F.lit(".md"))
    # of a note's chunks only the best one of each label is a hit that can count
    hits = R.best_within(rows, "label", "chunk").select(note("chunk").alias("path"), note("label").alias("other"), F.round("score", 6).alias("score"))
    return K.best_per_neighbour(hits)


@add("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 9) AS norm, CASE WHEN vec_id % 3 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS scaled FROM embeddings")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norms, and those of normalised vectors, of which a third is zero."""
    v = F.when(F.col("vec_id") % 3 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.transform("embedding", lambda x: x * 3))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 9).alias("norm"), F.round(V.norm(V.normalize(v)), 6).alias("scaled"))


@add("""WITH c AS (SELECT conv_id, count(*) AS n, count_if(role = 'user') AS u FROM conversations GROUP BY 1)
SELECT conv_id, printf('lines %d to %d are new; %d were read before', u + 1, n, u) AS hint FROM c WHERE n > u""")
def resume_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where reading of each session goes on."""
    turns = table(spark, sf_dir, "conversations")
    count = lambda df: df.groupBy("conv_id").agg(F.count("*").alias("lines"))
    return S.resume_hint(I.offset_ranges(count(turns), count(turns.where("role = 'user'")), "conv_id"))


@add(f"""WITH {PATHS_SQL} SELECT path FROM p WHERE ends_with(path, '.md') AND doc_id % 2 = 0""")
def touched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run wrote: changed at its start or later."""
    at = F.expr("timestamp_seconds(1000 + (doc_id + 1) % 2 * 100)")
    return I.touched_since(rendered_paths(spark, sf_dir).select("path", at.alias("mtime")), F.timestamp_seconds(F.lit(1100))).select("path")


@add(f"""WITH {NOTES} SELECT path, md5(CASE WHEN doc_id % 5 = 0 THEN regexp_replace(body, '\\s+$', '') || chr(10) || chr(10) || '## Audit' || chr(10) || 'kept ' || doc_id || chr(10) ELSE body END) AS body FROM n""")
def audit_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines appended to the audit section of some notes."""
    traces = rendered_paths(spark, sf_dir).where("doc_id % 5 = 0").select("path", F.concat(F.lit("kept "), F.col("doc_id").cast("string")).alias("line"))
    return I.audit_trace(notes(spark, sf_dir), traces).select("path", F.md5("body").alias("body"))


#: A turn as a line of its session's log; fifty conversations make a session. The same in Spark and DuckDB.
TURN_LINE = """concat('{"conv":', conv_id, ',"turn":', turn, ',"role":"', role, '","text":"', md5(coalesce(text, '')), '"}')"""


def write_sessions(lines: DataFrame, root: str, share: float, closed: bool) -> None:
    """Write each session's log, or the first ``share`` of its bytes, as tasks of a recording tool would; a third each is plain, .gz and .zst, and only plain ones are written early."""
    ship(lines.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = file_system(root)
        store.create_dir(folder)
        for b in batches:
            for session, text in zip(*(c.to_pylist() for c in b.columns)):
                raw, codec = text.encode(), (None, "gzip", "zstd")[session % 3]
                if codec and share < 1:
                    continue
                if closed and session % 4 == 0:
                    store.open_output_stream(f"{folder}/{session}.closed").close()
                    continue
                path = f"{folder}/{session}.jsonl" + {None: "", "gzip": ".gz", "zstd": ".zst"}[codec]
                with store.open_output_stream(path, compression=codec) as out:
                    out.write(raw[: int(len(raw) * share)])
            yield b.select(["session"])

    whole = lines.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "turn", "line"))), lambda x: F.concat(x["line"], F.lit("\n"))), "").alias("text"))
    whole.mapInArrow(write, "session long").count()


@add(f"""WITH l AS (SELECT conv_id, turn, conv_id // 50 AS session, {TURN_LINE} AS line FROM conversations),
p AS (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY session ORDER BY conv_id, turn) AS ends, sum(strlen(line) + 1) OVER (PARTITION BY session) AS total FROM l)
SELECT session, (ends - strlen(line) - 1)::BIGINT AS at, line FROM p WHERE session % 4 <> 0 OR session % 3 = 0 AND ends <= floor(total * 0.6)""")
def stream_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs that were read up to the middle of a line, grew, and were read on by a second run; some sessions were closed in between, and compressed logs came later."""
    folder = scratch(spark, "growing")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr("conv_id DIV 50").alias("session"), F.expr(TURN_LINE).alias("line"))
    for share, closed in ((0.6, False), (1.0, True)):
        write_sessions(rows, f"{folder}/logs", share, closed)
        read = C.run_available(follow_lines(spark, f"{folder}/logs"), folder, "append")
    read = durable(read.select(F.col("session").cast("long").alias("session"), "at", "line"))
    discard(spark, folder)
    return read
