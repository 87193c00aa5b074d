"""Mixing sources to target weights.

Each source gets a target of words in proportion to its weight. A target stops at a
multiple of what the source holds, and the excess goes to the others by weight. A
source's repetition rate is its target over its size: every document is taken
floor(rate) times, and once more if a number hashed from its id is below the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, join_measured, with_position


def word_count(text: Column) -> Column:
    """Words of a text; none in a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size, target, rate) from (source, size) rows.

    Sources in code-point order, null last, take the weights in turn. ``share`` of all words is
    dealt out; no target exceeds ``cap`` times its source's size. The level that a unit of weight gets rises round by
    round, as sources that are full leave the rest to the others, until no more are full. A round is one
    aggregation, and positions are dealt by range, so that there may be a source to each host.
    """
    per = with_position(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), [F.asc_nulls_last("source")], "_nth")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_nth") % len(weights) + 1).cast("int")).cast("double")
    per = per.select("source", "source_size", weight.alias("w"), (F.lit(float(cap)) * F.col("source_size")).alias("full")).checkpoint()
    whole = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.sum("w").alias("w")).first()
    words, level, before = share * whole["words"], share * whole["words"] / (whole["w"] or 1), None
    while level != before:
        full = F.lit(level) * F.col("w") > F.col("full")
        r = per.agg(F.coalesce(F.sum(F.when(full, F.col("full"))), F.lit(0.0)).alias("gone"), F.sum(F.when(~full, F.col("w"))).alias("open")).first()
        # with every source full there is no level left: all targets are at their caps
        level, before = (words - r["gone"]) / r["open"] if r["open"] else float("inf"), level if r["open"] else float("inf")
    target = F.least(F.col("full"), F.lit(level) * F.col("w"))
    return per.select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def hashed_uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"mix:{seed}:"), key)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17,
        keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document with the number of times the mix takes it.

    Returns doc_id, source and the columns in ``keep``, then size, source_size, target, rate,
    copies and taken (= copies x size). Documents without words and sources without words are taken as
    often as their rate says (0 for such sources). A null doc_id draws by its text's hash; rows
    that repeat a doc_id draw alike; null is a source of its own. An empty table gives no rows.
    Other columns are ignored, whatever their names. The sizes are checkpointed when no wide
    column is kept, so that texts are read once.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("_key"), *keep)
    if not keep:
        sized = sized.checkpoint()
    targets = source_targets(sized.select("source", "size"), weights, share, cap).checkpoint()
    right = targets.withColumnRenamed("source", "_source")
    joined = join_measured(sized, right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    whole = F.floor("rate")
    extra = (hashed_uniform(F.col("_key"), seed) < F.col("rate") - whole).cast("long")
    return joined.withColumn("copies", whole + extra).withColumn("taken", F.col("copies") * F.col("size")).drop("_key")


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves: each row of ``docs``, all its columns whatever their names, as often as it is taken.

    A null text has no words and is taken by its source's rate like any other row; a null source is one of its own; a null doc_id draws by
    its text. Rows that repeat an id draw alike, so a repeated row is emitted as often again. An empty table gives no rows.
    """
    whole = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("_row"))
    mixed = mix(whole, keep=("_row",), **options).where("copies > 0")
    return mixed.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(doc_id::VARCHAR, md5(text), '') AS k
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS w
  FROM per),
levels AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size)::BIGINT FROM per)
             - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
          / ((SELECT sum(w) FROM weighed)
             - coalesce(sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level
  FROM weighed),
chosen AS (SELECT arg_min(level, (cap / w, level)) AS level FROM levels WHERE level * w <= cap),
targets AS (
  SELECT l.source, l.source_size, coalesce(least(l.cap, c.level * l.w), l.cap) AS target
  FROM levels l LEFT JOIN chosen c ON true),
drawn AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('mix:17:' || d.k), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM drawn
"""
