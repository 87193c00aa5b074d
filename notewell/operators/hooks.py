"""Pluggable callables: embedders, token counters, stemmers, judges and consolidation.

Callables work on whole batches, are loaded once in each task, and are never given by the library
itself: without one, the built-in fallback is used or the step is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions import text as T
from ..session import durable, ship


def with_batches(df: DataFrame, column: str, load: Callable[[], Callable[[list], list]], name: str, kind: str) -> DataFrame:
    """Add ``name`` (a Spark type ``kind``): ``load()`` gives a function from a list of values to one of results."""
    ship(df.sparkSession)
    at = df.columns.index(column)
    schema = StructType([*df.schema.fields, *StructType.fromDDL(f"{name} {kind}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = load()
        for b in batches:
            told = pa.array(work(b.column(at).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns, told], names=[*b.schema.names, name])

    return df.mapInArrow(run, schema)


def embed(df: DataFrame, column: str, load: Callable[[], Callable[[list], list]], name: str = "embedding") -> DataFrame:
    return with_batches(df, column, load, name, "array<double>")


def count_tokens(df: DataFrame, column: str, load: Callable[[], Callable[[list], list]] | None = None, name: str = "n_tokens") -> DataFrame:
    """Token counts by a tokenizer, or a quarter of the bytes without one."""
    if load is None:
        return df.withColumn(name, T.token_estimate(F.col(column)))
    return with_batches(df, column, load, name, "bigint")


def judge(df: DataFrame, prompt: Column, load: Callable[[], Callable[[list], list]]) -> DataFrame:
    """Add verdict, confidence, reason and the trimmed body as a judge's text states them; null where it states none."""
    told = with_batches(df.withColumn("_prompt", prompt), "_prompt", load, "_said", "string")
    v = T.verdict(F.col("_said"))
    return told.select(*df.columns, v["verdict"].alias("verdict"), v["confidence"].alias("confidence"), v["reason"].alias("reason"), v["trimmed"].alias("trimmed"))


def ablation_policy(verdict: Column, confidence: Column) -> Column:
    """drop or trim at high confidence only; keep in every other case, null included."""
    return F.when((confidence == "high") & verdict.isin("DROP", "TRIM"), F.lower(verdict)).otherwise("keep")


def merge_policy(decision: Column) -> Column:
    """merge where a resolver said so and gave a body; keep_both in every other case, null included."""
    return F.when(decision == "MERGE", "merge").otherwise("keep_both")


def consolidate(notes: DataFrame, group: str, text: str, order: str, summarise: Callable[[list], list], reduce: Callable[[list], list], chunk: int = 200) -> DataFrame:
    """(group, summary, overall): texts are summarised in chunks, chunks by group, and groups together.

    Each step works on texts of at most ``chunk`` parts: while a group, or the whole, has more summaries than that, these
    are summarised chunk by chunk again.
    """
    ship(notes.sparkSession)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_t"))), lambda x: x["_t"]), "\n")

    def step(rows: DataFrame, keys: list[str], work: Callable[[list], list]) -> DataFrame:
        """(keys, _n, _t): one summary for each chunk of ``chunk`` texts."""
        told = rows.groupBy(*keys, F.floor(F.col("_n") / chunk).cast("long").alias("_m")).agg(joined.alias("_text"))
        return durable(with_batches(told, "_text", lambda: work, "_t", "string").select(*keys, F.col("_m").alias("_n"), "_t"))

    nth = (F.row_number().over(_by(group, order)) - 1).cast("long")
    parts = step(notes.select(group, nth.alias("_n"), F.col(text).alias("_t")), [group], summarise)
    while True:
        several = parts.groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        parts = step(parts, [group], summarise)
        if (several or 0) <= chunk:
            break
    groups = parts.select(group, F.col("_t").alias("summary"))
    # positions over all groups: a count for each partition is all that one task ranks
    rest = durable(groups.select(F.col(group).alias("_g"), F.col("summary").alias("_t")).repartitionByRange("_g").sortWithinPartitions("_g").withColumn("_id", F.monotonically_increasing_id()))
    sizes = rest.groupBy(F.shiftright("_id", 33).alias("_p")).agg(F.count("*").alias("_c"))
    before = sizes.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_b"))
    rest = rest.withColumn("_p", F.shiftright("_id", 33)).join(F.broadcast(before), "_p").select((F.col("_b") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias("_n"), "_t")
    n = rest.count()
    while n > chunk:
        rest, n = step(rest, [], summarise), -(-n // chunk)
    overall = step(rest, [], reduce).select(F.col("_t").alias("overall"))
    return groups.crossJoin(F.broadcast(overall))  # one row on the right


def _by(group: str, order: str):
    return Window.partitionBy(group).orderBy(order)
