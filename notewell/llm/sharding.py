"""Sharding by a hierarchical weighted hash tree.

The tree has regions, racks and shards; an inner node weighs what its shards weigh
together. A key descends level by level: every child draws an exponential number
hashed from the key and the child's path, divided by the child's weight, and the
smallest draw wins. A child whose weight stays as it is keeps its draws, so a change
moves keys only into or out of the subtrees whose weights change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_measured, with_position

#: Rows of (region, rack, shard, weight).
Tree = list[tuple[int, int, int, float]]


def full_tree(shards: int, racks: int = 2, per_rack: int = 4) -> Tree:
    """Shards 0 to ``shards`` - 1 in order, ``per_rack`` to a rack and ``racks`` racks to a region."""
    return [(s // (per_rack * racks), s // per_rack, s, 1.0) for s in range(shards)]


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a new region of its own.

    Only the root sees a new weight, so rows move into the new shard and nowhere else. A shard
    that joins an existing rack would also raise its region and rack, and rows drawn into those
    could land on a sibling.
    """
    region, rack, shard = (max(row[i] for row in tree) + 1 for i in range(3))
    return [*tree, (region, rack, shard, weight)]


def _draw(key: Column, path: str, weight: float) -> Column:
    uniform = (F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 11) + 1) / F.lit(float(1 << 53))
    return -F.ln(uniform) / F.lit(float(weight))


def _choose(key: Column, children: dict[int, list], path: str) -> Column:
    if len(children) == 1:
        return F.lit(next(iter(children)))
    draws = [
        F.struct(_draw(key, f"{path}/{c}", sum(r[-1] for r in rows)).alias("draw"), F.lit(c).alias("child"))
        for c, rows in sorted(children.items())
    ]
    return F.array_min(F.array(*draws))["child"]


def _split(rows: list, level: int) -> dict[int, list]:
    out: dict[int, list] = {}
    for r in rows:
        if r[-1] > 0:
            out.setdefault(r[level], []).append(r)
    return out


def descend(df: DataFrame, key: Column, tree: Tree, name: str) -> DataFrame:
    """Add column ``name``: the shard that ``key`` comes to (a null key: that of the empty string)."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    regions = _split(tree, 0)
    df = df.withColumn("_region", _choose(key, regions, "root"))
    rack, shard = F.lit(None).cast("int"), F.lit(None).cast("int")
    for r, rows in regions.items():
        racks = _split(rows, 1)
        rack = F.when(F.col("_region") == r, _choose(key, racks, f"region {r}")).otherwise(rack)
        for k, leaves in racks.items():
            shard = F.when(F.col("_rack") == k, _choose(key, _split(leaves, 2), f"rack {k}")).otherwise(shard)
    return df.withColumn("_rack", rack).withColumn(name, shard.cast("int")).drop("_region", "_rack")


def shard(docs: DataFrame, tree: Tree) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 8. Law ``key``: doc_id and tree decide, so rows that
    repeat a doc_id share a shard. ``slot`` counts a shard's rows from 0 without gaps, by doc_id (null first), checksum
    and size. A null text has size 8 and a null checksum; an empty table gives no rows; other
    columns are ignored. Only the narrow columns are kept and dealt by range, with a row number
    as the last sort column, so that a repeated doc_id is split over partitions.
    """
    text = F.col("text")
    base = docs.select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    base = descend(descend(base, F.col("doc_id"), tree, "shard"), F.col("doc_id"), grown(tree), "grown_shard")
    base = base.withColumn("_same", F.monotonically_increasing_id()).checkpoint()
    order = [F.col(c) for c in ("shard", "doc_id", "text_crc32", "size", "_same")]
    placed = with_position(base, order, "_at")
    first = placed.groupBy("shard").agg(F.min("_at").alias("_first")).checkpoint()
    return join_measured(placed, first, "shard").select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("_at") - F.col("_first")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, tree: Tree, path: str) -> None:
    """Write the documents, all their columns, into one folder a shard. Nothing is shuffled: each task writes to the shards it holds.

    A null doc_id goes where the empty string does; rows that repeat a doc_id share a shard; null and empty texts are written like any
    other; an empty table writes no rows. Columns named ``__key`` or ``__shard`` are taken.
    """
    descend(docs.withColumn("__key", F.col("doc_id")), F.col("__key"), tree, "__shard").drop("__key").write.partitionBy("__shard").parquet(path)
