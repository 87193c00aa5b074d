"""Queries: note metadata, links, twins and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import links as L
from ..operators import tickets as K
from ..operators import twins as W
from ..session import spread
from .common import PATHS_SQL, STATUS_SQL, Catalogue, rendered_paths, rounded, statuses, table, tok_sql

CATALOGUE = Catalogue()
add = CATALOGUE.add


@add(f"""WITH {PATHS_SQL}
SELECT doc_id, path,
       CASE WHEN n < 3 OR NOT ends_with(path, '.md') THEN NULL WHEN s[2] = 'Learnings' THEN 'workspace' WHEN n = 4 AND s[3] = 'Learnings' THEN 'project'
            WHEN s[n] = '_index.md' AND n >= 4 THEN 'index' WHEN list_contains(s[3:n - 1], 'Learnings') THEN 'ticket' END AS scope,
       CASE WHEN ends_with(path, '/_index.md') THEN substr(path, 1, length(path) - 10) WHEN contains(path, '/Learnings/') THEN split_part(path, '/Learnings/', 1) END AS ticket_dir,
       CASE WHEN contains(path, '/Learnings/') THEN array_to_string(s[1:n - list_position(list_reverse(s), 'Learnings') + 1], '/') END AS learnings_dir,
       contains(path, '/Learnings/') AND ends_with(path, '.md') AND NOT ends_with(path, '/_index.md') AS learning,
       lower(CASE WHEN ends_with(s[n], '.md') THEN substr(s[n], 1, length(s[n]) - 3) ELSE s[n] END) AS stem,
       array_to_string(s[greatest(n - 1, 1):n], '/') AS label, s[2] AS project
FROM (SELECT *, string_split(path, '/') AS s, len(string_split(path, '/')) AS n FROM p)""")
def classify_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the paths of rendered notes say of them."""
    path = F.col("path")
    return rendered_paths(spark, sf_dir).select(
        "doc_id", "path", T.scope_of(path).alias("scope"), T.ticket_dir(path).alias("ticket_dir"), T.learnings_dir(path).alias("learnings_dir"),
        T.is_learning(path).alias("learning"), T.stem(path).alias("stem"), T.pair_label(path).alias("label"), T.project_of(path).alias("project"))


@add(r"""
SELECT page_id, nullif(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(origin, '^\s+|\s+$', '', 'g'), '/+$', ''), '\.git$', ''), '^(git@|https?://)[^/:]+[/:]', '')), '') AS origin
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN url || '.git' WHEN 2 THEN ' git@' || replace(url, 'http://', '') ELSE upper(url) || '/' END AS origin FROM pages)""")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses in the forms that origins have."""
    origin = F.expr("CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN url || '.git' WHEN 2 THEN ' git@' || replace(url, 'http://', '') ELSE upper(url) || '/' END")
    return table(spark, sf_dir, "pages").select("page_id", T.url_normalize(origin).alias("origin"))


@add("SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:]*)', 1)) AS host, count(*)::BIGINT AS n FROM pages GROUP BY 1")
def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(T.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


HREF = '<a href="([^"]*)"'
TITLE = r"<title>([^\s<.,%*&#$!|]+)"


def page_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as notes (id, name, body, length): named by the first word of their title, their anchors turned into wiki links."""
    html = T.text_or_empty(F.col("html"))
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), F.regexp_extract(html, TITLE, 1).alias("name"), F.regexp_replace(html, HREF, "[[$1]]").alias("body"), F.length("html").alias("length"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, pos, target): the first ten links of each page."""
    return page_notes(spark, sf_dir).select(F.col("id").alias("src"), F.posexplode(T.wiki_links(F.col("body"))).alias("pos", "target"))


LINKS = f"""
n AS (SELECT page_id AS id, regexp_extract(coalesce(html, ''), '{TITLE}', 1) AS name, length(html) AS length, regexp_replace(coalesce(html, ''), '{HREF}', '[[\\1]]', 'g') AS body FROM pages),
e0 AS (SELECT id AS src, list_transform(list_slice(regexp_extract_all(body, '\\[\\[([^\\]|#]+)(?:[|#][^\\]]+)?\\]\\]', 1), 1, 10), lambda x: trim(x)) AS h FROM n),
e AS (SELECT src, unnest(h) AS target, unnest(range(0, len(h)))::INT AS pos FROM e0),
r AS (SELECT e.*, f.id AS dst FROM e LEFT JOIN (SELECT name, min(id) AS id FROM n GROUP BY name) f ON regexp_replace(string_split(e.target, '/')[-1], '\\.md$', '') = f.name)
"""


@add(f"WITH {LINKS} SELECT src, pos, target FROM e")
def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_links(spark, sf_dir)


@add(f"WITH {LINKS} SELECT src, pos, target, dst FROM r")
def link_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.resolve(page_links(spark, sf_dir), page_notes(spark, sf_dir)).select("src", "pos", "target", "dst")


@add(f"""WITH {LINKS},
ranked AS (
  SELECT regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) AS query_id, page_id AS id,
         row_number() OVER (PARTITION BY query_id ORDER BY length(html) DESC, page_id) AS rank FROM pages),
reached AS (SELECT k.query_id, coalesce(r.dst::VARCHAR, r.target) AS dst, min((k.rank, r.pos)) AS first_at FROM ranked k JOIN r ON k.id = r.src WHERE k.rank <= 2 AND r.pos < 5 AND r.target <> '' GROUP BY ALL),
fresh AS (SELECT * FROM reached x WHERE NOT EXISTS (SELECT 1 FROM ranked k WHERE k.rank <= 8 AND k.query_id = x.query_id AND k.id::VARCHAR = x.dst))
SELECT query_id, dst, row_number() OVER (PARTITION BY query_id ORDER BY first_at, dst)::INT AS place FROM fresh QUALIFY place <= 5""")
def graph_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest pages of each section stand for its ranked list."""
    from ..operators.retrieval import top_k

    section = F.regexp_extract("url", r"^https?://[^/]+/([^/?#]*)", 1)
    pages = table(spark, sf_dir, "pages").select(section.alias("query_id"), F.col("page_id").alias("id"), F.length("html").alias("length"))
    resolved = L.resolve(page_links(spark, sf_dir), page_notes(spark, sf_dir))
    return L.one_hop(top_k(pages, "length", 8), resolved)


@add(rf"""WITH {LINKS}, m AS (SELECT DISTINCT id AS src, name AS own, string_split(unnest(regexp_extract_all(body, '\[\[([^\]|]*)(?:\||\]\])', 1)), '/')[-1] AS name FROM n)
SELECT n.id, count(DISTINCT m.src)::BIGINT AS inbound FROM n LEFT JOIN m ON m.name = n.name AND m.own <> m.name GROUP BY n.id""")
def inbound_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links of all pages count."""
    notes = page_notes(spark, sf_dir)
    return L.inbound(L.mentions(notes, "body"), notes)


@add(f"""WITH {LINKS} SELECT id, md5(regexp_replace(body, '\\[\\[(?:[^\\]|]*/)?la(\\|[^\\]]*)?\\]\\]', '[[los\\1]]', 'g')) AS body FROM n""")
def repoint_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to one name, with any path before it, led to another."""
    return page_notes(spark, sf_dir).select("id", F.md5(T.repoint(F.col("body"), "la", "los")).alias("body"))


#: Text with code in it, made of a document's first words; the same in Spark and DuckDB.
CODE = """concat('See `', w1, '.', w2, w3, '`, `x`, `', w3, '()` and ', upper(substr(w1, 1, 1)), lower(substr(w1, 2)), upper(substr(w2, 1, 1)), lower(substr(w2, 2)), 'Abc, MyHTTPServer, `', w2, '_', w1, '`')"""
WORDS = "coalesce(nullif(regexp_extract(text, '([A-Za-z]+)', 1), ''), 'none')"
SYMBOLS = f"""
w AS (SELECT doc_id, source, {WORDS} AS w1, source AS w2, lang AS w3 FROM documents),
c AS (SELECT doc_id, source, {CODE} AS text FROM w),
k AS (SELECT doc_id, source, regexp_extract_all(text, '`([A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)*)`', 1) AS ticked, regexp_extract_all(text, '\\b([A-Z][a-z0-9]+[A-Z][A-Za-z0-9]{{3,}})\\b', 1) AS camel FROM c),
o AS (SELECT doc_id, source, list_concat(list_filter(flatten(list_transform(ticked, lambda x: [x, string_split(x, '.')[-1]])), lambda x: length(x) >= 6), camel) AS found FROM k),
y AS (SELECT doc_id, source, s, min(i) AS i FROM (SELECT doc_id, source, unnest(found) AS s, unnest(range(0, len(found))) AS i FROM o) GROUP BY ALL),
top AS (SELECT doc_id, source, s AS symbol, row_number() OVER (PARTITION BY doc_id ORDER BY length(s) DESC, i) AS place FROM y QUALIFY place <= 6)
"""


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, symbols): the code symbols of a note about each document."""
    words = table(spark, sf_dir, "documents").select("doc_id", "source", F.expr(WORDS).alias("w1"), F.col("source").alias("w2"), F.col("lang").alias("w3"))
    return words.select("doc_id", "source", T.symbols(F.expr(CODE)).alias("symbols"))


@add(f"WITH {SYMBOLS} SELECT doc_id, string_agg(symbol, ' ' ORDER BY place) AS symbols FROM top GROUP BY doc_id")
def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(spark, sf_dir).select("doc_id", F.array_join("symbols", " ").alias("symbols"))


@add(f"WITH {SYMBOLS} SELECT DISTINCT symbol FROM top WHERE source = 'src0' AND symbol NOT IN (SELECT symbol FROM top WHERE source <> 'src0')")
def stale_symbols_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of one source's notes that no other source knows."""
    found = coded(spark, sf_dir).select("source", F.explode("symbols").alias("symbol"))
    return found.where("source = 'src0'").select("symbol").distinct().join(found.where("source <> 'src0'").select("symbol"), "symbol", "left_anti")


@add("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, substr(md5(text), 1, 16) AS short FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"), F.substring(F.md5("text"), 1, 16).alias("short"))


#: What fetches said, by page; the same in Spark and DuckDB.
MESSAGE = """CASE page_id % 12 WHEN 0 THEN 'fatal: Authentication failed for x' WHEN 1 THEN 'The requested URL returned error: 403' WHEN 2 THEN 'could not read Password' WHEN 3 THEN 'interactivity has been disabled'
 WHEN 4 THEN 'Permission denied (publickey)' WHEN 5 THEN 'timeout after 4013 ms' WHEN 6 THEN 'HTTP Basic: Access denied' WHEN 7 THEN 'terminal prompts disabled' WHEN 8 THEN 'http 401' WHEN 9 THEN 'invalid credentials'
 WHEN 10 THEN 'could not resolve host' ELSE NULL END"""
FAILED = "regexp_matches(message, '(?i)authentication failed|could not read username|could not read password|interactivity has been disabled|terminal prompts disabled|invalid credentials|access denied|\\b401\\b|\\b403\\b')"


@add(f"SELECT page_id, coalesce({FAILED}, false) AS failed FROM (SELECT page_id, {MESSAGE} AS message FROM pages)")
def regex_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which failed fetches lack credentials."""
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.expr(MESSAGE).rlike(T.AUTH_FAILURE), F.lit(False)).alias("failed"))


@add(f"""SELECT run, lower(regexp_extract(url, '^[A-Za-z+]+://(?:[^/@]+@)?([^/:]+)', 1)) AS host, min(url) AS origin FROM (SELECT page_id % 2 AS run, url, {MESSAGE} AS message FROM pages)
WHERE {FAILED} AND regexp_extract(url, '^[A-Za-z+]+://(?:[^/@]+@)?([^/:]+)', 1) <> '' GROUP BY ALL""")
def first_try_per_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One new login for each host and run."""
    return K.first_try_per_host(table(spark, sf_dir, "pages").select((F.col("page_id") % 2).alias("run"), F.col("url").alias("origin"), F.expr(MESSAGE).alias("message")))


#: Reports of runs, as free text with a line of counts in it; the same in Spark and DuckDB.
REPORT = """CASE o_orderkey % 5 WHEN 0 THEN concat('done', chr(10), 'RUN-COUNTS: adds=', o_custkey % 3, ' confirms=', o_custkey % 2, ' adjusts=0 refutes=0', chr(10), 'adds=9')
 WHEN 1 THEN concat('run-counts: CONFIRMS = ', o_custkey % 4, ', refutes =0; Adds= ', o_custkey % 2, ' adjusts=0') WHEN 2 THEN concat('COUNTS: adds=1 confirms=2 refutes=', o_custkey % 3)
 WHEN 3 THEN concat('COUNTS:adds=7 adds=0 adjusts=', o_custkey % 2, ' refutes=0 confirms=12') ELSE 'nothing said' END"""
COUNTED = """
said AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'finalize' ELSE 'capture' END AS kind, o_orderkey % 5 AS form, o_custkey AS c FROM orders),
counted AS (
  SELECT o_orderkey, kind, CASE form WHEN 0 THEN c % 3 WHEN 1 THEN c % 2 WHEN 3 THEN 0 END AS adds, CASE form WHEN 0 THEN c % 2 WHEN 1 THEN c % 4 WHEN 3 THEN 12 END AS confirms,
         CASE form WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 3 THEN c % 2 END AS adjusts, CASE form WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 3 THEN 0 END AS refutes FROM said)
"""


@add(f"""WITH {COUNTED} SELECT o_orderkey, adds::BIGINT AS adds, confirms::BIGINT AS confirms, adjusts::BIGINT AS adjusts, refutes::BIGINT AS refutes,
       coalesce(adds + adjusts + refutes = 0 AND (kind = 'finalize' OR confirms > 0), false) AS nothing_new FROM counted""")
def kv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that runs report in free text, and which runs found nothing new."""
    kind = F.when(F.col("o_orderstatus") == "F", "finalize").otherwise("capture")
    said = table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"), T.counts_marker(F.expr(REPORT)).alias("c"))
    return said.select("o_orderkey", *(F.col(f"c.{k}").alias(k) for k in ("adds", "confirms", "adjusts", "refutes")), K.nothing_new(F.col("c"), F.col("kind")).alias("nothing_new"))


@add("SELECT event_type, (json_extract(props, '$.k')::INT)::INT AS k, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


@add("""SELECT o_orderkey, CASE WHEN instr(o_orderpriority, '-') > 0 THEN split_part(o_orderpriority, '-', 1) ELSE '' END AS type,
       CASE WHEN instr(o_orderpriority, '-') > 0 THEN substr(o_orderpriority, instr(o_orderpriority, '-') + 1) ELSE o_orderpriority END AS slug FROM orders""")
def split_type_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = T.split_branch(F.replace("o_orderpriority", F.lit("-"), F.lit("/")))
    return table(spark, sf_dir, "orders").select("o_orderkey", parts["type"].alias("type"), parts["slug"].alias("slug"))


@add(f"""WITH {STATUS_SQL}, d AS (SELECT doc_id AS id, source FROM documents),
own AS (SELECT d.*, nullif(status, '') AS own FROM d JOIN status USING (id)),
idx AS (SELECT source, arg_min(own, id) AS idx FROM own WHERE own IS NOT NULL GROUP BY source)
SELECT own.id AS doc_id, own.source, coalesce(own.own, idx.idx, '') AS status FROM own LEFT JOIN idx ON own.source = idx.source""")
def inherit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document without a status takes that of its source's first document with one."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    own = docs.join(statuses(spark, sf_dir), "id").withColumn("own", F.nullif("status", F.lit("")))
    index = own.where("own IS NOT NULL").groupBy("source").agg(F.min_by("own", "id").alias("idx"))
    return own.join(index, "source", "left").select(F.col("id").alias("doc_id"), "source", F.coalesce("own", "idx", F.lit("")).alias("status"))


@add("""SELECT source, count(*)::BIGINT AS notes, count(DISTINCT lang)::BIGINT AS langs, string_agg(DISTINCT lang, ',' ORDER BY lang) AS lang_list,
       min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY source HAVING count(*) > 0""")
def project_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").alias("notes"), F.countDistinct("lang").alias("langs"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("lang_list"),
        F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("notes > 0")


@add("""SELECT a.vec_id AS a, b.vec_id AS b, a.label IS NOT DISTINCT FROM b.label AS same, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
WHERE list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= CASE WHEN a.label IS NOT DISTINCT FROM b.label THEN 0.35::DOUBLE ELSE 0.40::DOUBLE END""")
def twin_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("folder"), F.col("embedding").alias("v"))
    return W.vector_twins(rows, 0.40, 0.35).withColumn("score", rounded("score"))


def term_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, folder, terms) of documents."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(F.col("doc_id").alias("id"), F.col("source").alias("folder"), T.term_set(F.col("text")).alias("terms"))


TEXT_TWINS = f"""
s0 AS (SELECT doc_id AS id, source AS folder, list_sort(list_distinct({tok_sql('text')})) AS t FROM documents),
s AS (SELECT folder, t, min(id) AS id, len(t) AS n FROM s0 WHERE len(t) > 0 GROUP BY folder, t),
x AS (SELECT id, unnest(t) AS term FROM s),
common AS (SELECT a.id AS a, b.id AS b, count(*) AS shared FROM x a JOIN x b ON a.term = b.term AND a.id < b.id GROUP BY ALL),
scored AS (
  SELECT a, b, sa.folder IS NOT DISTINCT FROM sb.folder AS same, shared / sqrt(sa.n * sb.n::DOUBLE) AS score
  FROM common JOIN s sa ON sa.id = a JOIN s sb ON sb.id = b),
twins AS (SELECT a, b, same, round(score, 6) AS score FROM scored WHERE score >= CASE WHEN same THEN 0.72::DOUBLE ELSE 0.80::DOUBLE END)
"""


@add(f"WITH {TEXT_TWINS} SELECT * FROM twins")
def twin_pairs_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.set_twins(term_sets(spark, sf_dir)).withColumn("score", rounded("score"))


@add(f"WITH {TEXT_TWINS} SELECT a, b, same, score, row_number() OVER (ORDER BY same DESC, score DESC, a, b)::INT AS place FROM twins QUALIFY place <= 25")
def twin_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.rank_set_twins(term_sets(spark, sf_dir))


COPIES = """
h AS (SELECT doc_id AS id, md5(text) AS digest, length(text) AS length FROM documents),
g AS (SELECT digest, min(id) AS "group", count(*)::BIGINT AS members FROM h GROUP BY digest HAVING count(*) > 1)
"""


@add(f'WITH {COPIES} SELECT h.id, digest, "group", members FROM h JOIN g USING (digest)')
def exact_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.copies(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), F.col("text"))


@add(f"""WITH {COPIES}
SELECT "group", arg_max(id, (quality, length, -id)) AS keeper, max(members)::BIGINT AS members
FROM (SELECT h.*, g."group", g.members, coalesce(l.q, 0) AS quality FROM h JOIN g USING (digest) LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) l ON l.doc_id = h.id) GROUP BY "group" """)
def pick_keeper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each group of copies the one to keep; a good label counts as a link to it."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.length("text").alias("length"))
    marks = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("q"))
    members = W.copies(docs, F.col("text")).join(docs.select("id", "length"), "id").join(marks, "id", "left")
    return L.keepers(members.select("group", "id", F.coalesce("q", F.lit(0)).alias("inbound"), "length"))
