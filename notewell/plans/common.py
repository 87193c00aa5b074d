"""What the query modules share: table access, and SQL pieces for the oracle side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import MARKED, MARKS, PLAIN, SHORTEST, STOP_WORDS

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column | str, places: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places)


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


class Catalogue:
    """Queries by name, each with its SQL where there is one."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def register(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return register


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def tok_sql(column: str) -> str:
    """Terms of a text; characters that become several are left to the unit tests."""
    return (f"list_filter(regexp_extract_all(translate(lower(coalesce({column}, '')), '{MARKED + MARKS}', '{PLAIN}'), '[a-z0-9]+'), "
            f"lambda w: len(w) >= {SHORTEST} AND NOT list_contains({STOP_SQL}, w))")


def first_line_sql(column: str, n: int = 200) -> str:
    lines = f"list_filter(list_transform(string_split(coalesce({column}, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')"
    return f"substr(coalesce(list_filter({lines}, lambda x: NOT starts_with(x, '#') AND NOT starts_with(x, '---'))[1], {lines}[1], ''), 1, {n})"


#: (query_id, id, bm25) from views docs(id, text) and asked(query_id, text), rounded to 6 places.
BM25_SQL = f"""
toks AS (SELECT id, {tok_sql('text')} AS t FROM docs),
stats AS (SELECT count(*) AS n, greatest(1.0, sum(len(t)) / count(*)) AS mean FROM toks),
post AS (SELECT id, len(t) AS length, unnest(t) AS term FROM toks),
tf AS (SELECT id, length, term, count(*) AS tf FROM post GROUP BY ALL),
idf AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf, mean FROM tf, stats GROUP BY term, n, mean),
qt AS (SELECT query_id, unnest({tok_sql('text')}) AS term FROM asked),
q AS (SELECT query_id, term, count(*) AS qtf FROM qt GROUP BY ALL),
bm25 AS (
  SELECT query_id, id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / mean)) * qtf), 6) AS bm25
  FROM tf JOIN q USING (term) JOIN idf USING (term) GROUP BY query_id, id)
"""

#: Documents as notes: ten to a project, a hundred to a workspace, in every layout that there is; the same in Spark and DuckDB.
WORKSPACE, PROJECT = "concat('w', CAST((doc_id - doc_id % 100) / 100 AS BIGINT))", "concat('p', CAST((doc_id - doc_id % 10) / 10 AS BIGINT))"
TICKET = "CAST((doc_id - doc_id % 10) / 10 AS BIGINT)"
PATH = f"""concat({WORKSPACE}, CASE doc_id % 10 WHEN 0 THEN concat('/Learnings/n', doc_id, '.md') WHEN 1 THEN concat('/', {PROJECT}, '/Learnings/n', doc_id, '.md')
 WHEN 2 THEN concat('/', {PROJECT}, '/feat/', {TICKET}, '/_index.md') WHEN 3 THEN concat('/', {PROJECT}, '/feat/', {TICKET}, '/Learnings/N', doc_id, '.md')
 WHEN 4 THEN concat('/', {PROJECT}, '/t', {TICKET}, '/_index.md') WHEN 5 THEN concat('/', {PROJECT}, '/t', {TICKET}, '/Learnings/sub/n', doc_id, '.md')
 WHEN 6 THEN concat('/', {PROJECT}, '/Learnings/sub/_index.md') WHEN 7 THEN concat('/readme', doc_id, '.md')
 WHEN 8 THEN concat('/', {PROJECT}, '/feat/', {TICKET}, '/Learnings/n', doc_id, '.md') ELSE concat('/', {PROJECT}, '/feat/', {TICKET}, '/notes', doc_id, '.TXT') END)"""
PATHS_SQL = f"p AS (SELECT doc_id, text, lang, source, {PATH} AS path FROM documents)"


def rendered_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, lang, source, path): documents with the paths of notes."""
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", F.expr(PATH).alias("path"))


#: Status of a document by its labels.
STATUS_SQL = """
status AS (
  SELECT d.doc_id AS id, CASE WHEN max(l.toxic) = 1 THEN 'discarded' WHEN min(l.quality) = 0 THEN 'experimental' ELSE '' END AS status
  FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.doc_id)
"""


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, status): toxic documents are discarded, poor ones experimental."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    status = F.when(F.max("toxic") == 1, "discarded").when(F.min("quality") == 0, "experimental").otherwise("")
    return docs.join(labels, "doc_id", "left").groupBy(F.col("doc_id").alias("id")).agg(status.alias("status"))
