"""Queries: tokens, lexical and vector ranking, fusion, budgets and relevance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..operators.index import TextIndex
from ..session import discard, durable, scratch, spread
from .common import BM25_SQL, STATUS_SQL, Catalogue, first_line_sql, long, rounded, statuses, table, tok_sql

CATALOGUE = Catalogue()
add = CATALOGUE.add


@add(f"""
SELECT doc_id, len(t)::BIGINT AS n_terms, len(list_distinct(t))::BIGINT AS n_distinct
FROM (SELECT doc_id, {tok_sql('text')} AS t FROM documents)""")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.tokens(F.col("text")).alias("t"), T.term_set(F.col("text")).alias("d"))
    return toks.select("doc_id", long(F.size("t")).alias("n_terms"), long(F.size("d")).alias("n_distinct"))


@add(f"""
SELECT term, count(DISTINCT doc_id)::BIGINT AS df FROM (SELECT doc_id, unnest({tok_sql('text')}) AS term FROM documents)
GROUP BY term HAVING count(DISTINCT doc_id) >= 2""")
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.doc_freq(table(spark, sf_dir, "documents"), F.col("text")).where("df >= 2")


def passages_by_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = R.bm25(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), table(spark, sf_dir, "benchmark"), "item_id", F.col("text"))
    return scored.withColumn("bm25", rounded("bm25"))


PASSAGES = f"WITH docs AS (SELECT doc_id AS id, text FROM documents), asked AS (SELECT item_id AS query_id, text FROM benchmark), {BM25_SQL}"
TOP_5 = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, id) AS rank FROM bm25 QUALIFY rank <= 5"


@add(f"{PASSAGES} SELECT query_id, id, bm25, rank::INT AS rank FROM ({TOP_5})")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_k(passages_by_bm25(spark, sf_dir), "bm25", 5)


@add(f"""{PASSAGES}, {STATUS_SQL},
w AS (SELECT query_id, b.id, round(bm25 * CASE status WHEN 'discarded' THEN 0.0 WHEN 'experimental' THEN 0.4 ELSE 1.0 END, 6) AS score FROM bm25 b JOIN status USING (id))
SELECT query_id, id, score, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM w WHERE score > 0 QUALIFY rank <= 5)""")
def bm25_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = passages_by_bm25(spark, sf_dir).join(statuses(spark, sf_dir), "id")
    scored = scored.select("query_id", "id", rounded(F.col("bm25") * R.weight_of(F.col("status"), R.STATUS_WEIGHT)).alias("score")).where("score > 0")
    return R.top_k(scored, "score", 5)


def changed_index(spark: SparkSession, sf_dir: str) -> tuple[TextIndex, DataFrame]:
    """An index of two thirds of the documents, some with other texts, and of documents that are gone since; and what bringing it up to date did."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("signature"))
    index = TextIndex(spark, scratch(spark, "index"))
    stale = F.col("id") % 5 == 1
    before = docs.where("id % 3 <> 0").select("id", F.when(stale, F.reverse("text")).otherwise(F.col("text")).alias("text"), F.when(stale, "old").otherwise(F.col("signature")).alias("signature"))
    index.build(before.union(docs.where("id % 10 = 0").select(-1 - F.col("id"), "text", "signature")))
    return index, index.update(docs)


def asked_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@add(f"{PASSAGES} SELECT query_id, id, bm25 AS score, rank::INT AS rank FROM ({TOP_5})")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents of each passage from an index that was built before a third of them came and others changed or went."""
    index, _ = changed_index(spark, sf_dir)
    found = durable(index.search(asked_passages(spark, sf_dir), 5))
    discard(spark, index.root)
    return found


@add("""SELECT action, count(*)::BIGINT AS n FROM (
  SELECT CASE WHEN doc_id % 3 = 0 THEN 'added' WHEN doc_id % 5 = 1 THEN 'updated' ELSE 'skipped' END AS action FROM documents UNION ALL SELECT 'removed' FROM documents WHERE doc_id % 10 = 0) GROUP BY action""")
def indexed_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What bringing the index up to date did."""
    index, actions = changed_index(spark, sf_dir)
    discard(spark, index.root)
    return actions.groupBy("action").agg(F.count("*").alias("n"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, id): the documents that hold a benchmark passage word for word."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    return R.containing(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), items)


@add(f"""{PASSAGES}, ranked AS ({TOP_5}),
best AS (
  SELECT b.item_id, min(r.rank) AS best FROM benchmark b JOIN documents d ON contains(d.text, b.text)
  LEFT JOIN ranked r ON r.query_id = b.item_id AND r.id = d.doc_id GROUP BY b.item_id)
SELECT count(*)::BIGINT AS n_queries, count_if(best <= 1)::BIGINT AS hit_1, count_if(best <= 3)::BIGINT AS hit_3, count_if(best <= 5)::BIGINT AS hit_5 FROM best""")
def hit_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.hit_at_k(R.top_k(passages_by_bm25(spark, sf_dir), "bm25", 5), answers(spark, sf_dir))


@add("SELECT b.item_id AS query_id, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir)


def neighbours(spark: SparkSession, sf_dir: str, k: int, within: str | None = None) -> DataFrame:
    """The k nearest of all vectors to every twentieth one, among its label's or all."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return R.nearest(rows, rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"), "label"), k, within)


NEIGHBOURS = """
near AS (
  SELECT q.vec_id AS query_id, r.vec_id AS id, q.label AS query_label, r.label, round(list_inner_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0)
"""


@add(f"WITH {NEIGHBOURS} SELECT query_id, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM near QUALIFY rank <= 5)")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark, sf_dir, 5)


@add(f"""WITH {NEIGHBOURS} SELECT query_id, id, score, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM near WHERE label = query_label QUALIFY rank <= 5) WHERE score >= 0.25""")
def topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark, sf_dir, 5, "label").where("score >= 0.25")


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors and the best texts of each query, CANDIDATES of either; a query's prompt is its document's first line."""
    cosines = neighbours(spark, sf_dir, R.CANDIDATES).select("query_id", "id", F.col("score").alias("cos"))
    docs = table(spark, sf_dir, "documents")
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").join(docs, F.col("vec_id") == F.col("doc_id")).select("vec_id", T.first_line(F.col("text")).alias("prompt"))
    weight = statuses(spark, sf_dir).select("id", R.weight_of(F.col("status"), R.STATUS_WEIGHT).alias("weight"))
    # the lexical side is weighed before it is ranked, and once more in the fusion
    lexical = R.bm25_top(docs.select(F.col("doc_id").alias("id"), "text"), weight, asked.select(F.col("vec_id").alias("query_id"), F.col("prompt").alias("text")), R.CANDIDATES)
    both = R.fuse(cosines, lexical, weight)
    return both.select("query_id", "id", "cos", rounded("bm25_n").alias("bm25_n"), rounded("score", 9).alias("score"), "provenance")


FUSED = f"""WITH {NEIGHBOURS}, docs AS (SELECT doc_id AS id, text FROM documents),
asked AS (SELECT vec_id AS query_id, {first_line_sql('text')} AS text FROM embeddings JOIN documents ON vec_id = doc_id WHERE vec_id % 20 = 0),
{BM25_SQL}, {STATUS_SQL},
c AS (SELECT query_id, id, score AS cos FROM near QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 40),
lw AS (
  SELECT query_id, b.id, round(bm25 * CASE status WHEN 'discarded' THEN 0.0 WHEN 'experimental' THEN 0.4 ELSE 1.0 END, 6) AS bm25 FROM bm25 b JOIN status USING (id)),
l0 AS (SELECT query_id, id, bm25 FROM lw WHERE bm25 > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, id) <= 40),
l AS (SELECT query_id, id, CASE WHEN max(bm25) OVER (PARTITION BY query_id) > 0 THEN bm25 / max(bm25) OVER (PARTITION BY query_id) ELSE 0.0 END AS bm25_n FROM l0),
u AS (
  SELECT query_id, id, coalesce(cos, 0.0) AS cos, coalesce(bm25_n, 0.0) AS bm25_n,
         CASE WHEN cos IS NOT NULL AND bm25_n IS NOT NULL THEN 'both' WHEN cos IS NOT NULL THEN 'cosine' ELSE 'lexical' END AS provenance
  FROM c FULL JOIN l USING (query_id, id)),
fused AS (
  SELECT query_id, id, cos, round(bm25_n, 6) AS bm25_n, round((0.7::DOUBLE * cos + 0.3::DOUBLE * bm25_n) * w, 9) AS score, provenance
  FROM (SELECT u.*, CASE status WHEN 'discarded' THEN 0.0::DOUBLE WHEN 'experimental' THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END AS w FROM u LEFT JOIN status USING (id)) WHERE w > 0)
"""


@add(f"{FUSED} SELECT * FROM fused")
def hybrid_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir)


@add(f"""{FUSED} SELECT query_id, id, score, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.45 THEN 'mid' ELSE 'low' END AS tier
FROM fused QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) = 1""")
def tier_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_k(fused(spark, sf_dir), "score", 1).select("query_id", "id", "score", R.tier(F.col("score")).alias("tier"))


@add(f"{FUSED} SELECT provenance, count(*)::BIGINT AS n FROM fused GROUP BY provenance")
def union_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir).groupBy("provenance").agg(F.count("*").alias("n"))


@add("""SELECT lang, doc_id, n_chars, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 2)""")
def diverse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_k(table(spark, sf_dir, "documents"), "n_chars", 2, "doc_id", "lang").select("lang", "doc_id", "n_chars", "rank")


@add("""SELECT source, doc_id, running FROM (
  SELECT source, doc_id, sum(strlen(coalesce(text, ''))) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM documents) WHERE running <= 15000""")
def budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length(T.text_or_empty(F.col("text"))).cast("long").alias("size"))
    return R.budget(sized, ["source"], [F.col("doc_id")], F.col("size"), 15_000).select("source", "doc_id", "running")


@add("SELECT doc_id, CASE WHEN length(text) > 1200 THEN substr(text, 1, 1200) || chr(10) || '[...truncated]' ELSE text END AS excerpt, length(text) > 1200 AS cut FROM documents")
def excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"), (F.length("text") > 1200).alias("cut"))


@add(f"SELECT doc_id, {first_line_sql('text')} AS description FROM documents")
def desc_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "documents").select("doc_id", T.describe(none, none, F.col("text")).alias("description"))


@add("""SELECT source, sum(greatest(1, strlen(coalesce(text, '')) // 4))::BIGINT AS tokens, count(*)::BIGINT AS notes,
       sum(greatest(1, strlen(coalesce(text, '')) // 4)) > 60000 AS over FROM documents GROUP BY source""")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(T.token_estimate(F.col("text"))).alias("tokens"), F.count("*").alias("notes")).withColumn("over", F.col("tokens") > 60_000)
