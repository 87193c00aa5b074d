"""Helpers that several corpus operators share: durable intermediates, joins whose
small side is measured before it is broadcast, distributed row positions and
connected components.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import discard, scratch, shared_dir, ship  # noqa: F401 (for the operators)

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which the small side of a join may be broadcast.
BROADCAST_ROWS = 20_000
#: A key is hot with more than HOT rows and more than one in SPREAD of all.
HOT, SPREAD = 1024, 1024


def prepare(spark: SparkSession) -> None:
    """Checkpoints have a folder, executors the package, and Arrow batches are short because one text may be megabytes."""
    shared_dir(spark)
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def compact(df: DataFrame, rows: int, per_task: int = 16_384) -> DataFrame:
    """``df`` in as few partitions as its ``rows`` fill, for small tables that many rounds go over."""
    return df.coalesce(max(1, -(-rows // per_task)))


def join_measured(left: DataFrame, right: DataFrame, on, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join, broadcasting ``right`` only when a count shows that it has at most ``rows`` rows.

    ``right`` should be cheap to count (a checkpoint). Beyond the bound Spark shuffles both
    sides, and adaptive execution splits the partitions of a hot key.
    """
    if right.limit(rows + 1).count() <= rows:
        right = F.broadcast(right)
    return left.join(right, on, how)


def with_position(df: DataFrame, order: list[Column], name: str = "position", keep: Callable[[DataFrame], DataFrame] = lambda df: df.checkpoint()) -> DataFrame:
    """Number all rows from 0 without gaps, in the order of ``order``.

    Rows are dealt by range and sorted inside partitions; only one count per partition
    is ranked in one place. The result is checkpointed, or written and read again by ``keep``, so numbers stay as they are.
    Give ``order`` a last column that tells equal rows apart, so that a hot value is split.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = keep(placed.withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        join_measured(placed.withColumn("_part", part), offsets, "_part")
        .withColumn(name, F.col("_before") + at)
        .drop("_row", "_part", "_before")
    )


def join_hot(left: DataFrame, right: DataFrame, on: list[str], weight: str, n: int, how: str = "inner") -> DataFrame:
    """Inner or left join with a ``right`` that has one row a key, whose ``weight`` says how many of the ``n`` rows of ``left`` have it.

    Keys of more than a SPREADth of all rows (and of more than HOT rows) are fewer than SPREAD, so these are broadcast, and
    their rows stay where they are; the others shuffle, where no key is large. ``right`` should be a checkpoint.
    """
    if n <= BROADCAST_ROWS:
        return left.join(F.broadcast(right.drop(weight)), on, how)
    bound = max(HOT, n // SPREAD)
    hot = right.where(F.col(weight) > bound).drop(weight)
    if hot.isEmpty():
        return left.join(right.drop(weight), on, how)
    cold = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right.where(F.col(weight) <= bound).drop(weight), on, how)
    return left.join(F.broadcast(hot), on).unionByName(cold)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b); root is the smallest node that is reachable.

    Alternates large-star and small-star steps until each node has one edge, and that to a node without a smaller
    neighbour, which is counted exactly. Each step is a pre-aggregated minimum and a join that does not
    gather a hub's edges; each round's edges are checkpointed.
    """
    edges = (
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v").distinct().checkpoint()
    )
    while True:
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            edges.select("v", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        seen = ends.agg(F.coalesce(F.sum("up"), F.lit(0)).alias("n"), F.count_if((F.col("up") > 1) | (F.col("up") == 1) & (F.col("down") == 1)).alias("open")).first()
        if not seen["open"]:
            break
        n = seen["n"]
        # large star: an edge's larger end moves to the least neighbour of the smaller end, if that is less than the end itself
        least = edges.select("u", "v").union(edges.select("v", "u")).groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("w"))
        least = compact(least.where("w > 0").select(F.col("u").alias("v"), F.least("u", "m").alias("m"), "w"), n).checkpoint()
        large = join_hot(edges, least, ["v"], "w", n).select("u", F.col("m").alias("v")).where("u <> v").distinct()
        large = compact(large, n).checkpoint()
        # small star: a node and its smaller neighbours move to the least of these
        small = compact(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("w")), n).checkpoint()
        moved = join_hot(large, small, ["u"], "w", n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = compact(moved.union(small.select("u", "m")).distinct(), 2 * n).checkpoint()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", F.col("v")).distinct())


def sound_vector(vector: Column) -> Column:
    """Is it an array without null, NaN or infinite components, and not all zero?"""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def common_length(df: DataFrame, vector: str) -> int:
    """The length that most vectors have (the larger of equally frequent ones), 0 for none."""
    n = F.size(vector)
    row = df.groupBy(n.alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return row["n"] if row else 0


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A list column without nulls as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, first by their largest component so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def least_labels(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the pairs (p, q) connect it with."""
    label = np.arange(n)
    while True:
        least, before = np.minimum(label[p], label[q]), label.copy()
        np.minimum.at(label, p, least)
        np.minimum.at(label, q, least)
        label = label[label]
        if (label == before).all():
            return label


def nearest_means(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Centres of Lloyd's algorithm over a bounded sample; empty clusters restart at random rows."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        size = np.bincount(own, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centres
