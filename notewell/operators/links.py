"""Links between notes: resolution by name, one-hop expansion, inbound counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def first_per_name(notes: DataFrame) -> DataFrame:
    """(name, id): the smallest id of each name."""
    return notes.groupBy("name").agg(F.min("id").alias("id"))


def resolve(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """Edges (src, pos, target) with ``dst``, the first note of the name that the target's last path segment gives; null where there is none."""
    names = first_per_name(notes).withColumnsRenamed({"name": "_key", "id": "dst"})
    return edges.withColumn("_key", T.link_key(F.col("target"))).join(names, "_key", "left").drop("_key")


def one_hop(ranked: DataFrame, resolved: DataFrame, sources: int = 2, links: int = 5, most: int = 5, shown: int = 8) -> DataFrame:
    """(query_id, dst, place): what the best notes of each query link to and its shown notes do not hold.

    From the first ``sources`` notes by rank the first ``links`` links each, without repeats, ``most`` in all. ``dst`` is a
    note's id as a string, or the link's own text where it leads to no note.
    """
    seeds = ranked.where(F.col("rank") <= sources).select("query_id", "rank", F.col("id").alias("src"))
    target = F.coalesce(F.col("dst").cast("string"), F.trim("target"))
    reached = seeds.join(resolved.where((F.col("pos") < links) & (F.trim("target") != "")).select("src", "pos", target.alias("dst")), "src")
    shown_ids = ranked.where(F.col("rank") <= shown).select("query_id", F.col("id").cast("string").alias("dst"))
    fresh = reached.join(shown_ids, ["query_id", "dst"], "left_anti").groupBy("query_id", "dst").agg(F.min(F.struct("rank", "pos")).alias("at"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("at", "dst"))
    return fresh.withColumn("place", place).where(F.col("place") <= most).select("query_id", "dst", "place")


def mentions(notes: DataFrame, text: str) -> DataFrame:
    """(src, own, name): every name that each note's links end in, once a note, with the note's own name."""
    return notes.select(F.col("id").alias("src"), F.col("name").alias("own"), F.explode(T.mentioned(F.col(text))).alias("name"))


def inbound(mentioned: DataFrame, notes: DataFrame) -> DataFrame:
    """(id, inbound): how many notes of another name mention each note's name, 0 for none. All links count, whatever path is before the name."""
    counts = mentioned.where(~F.col("own").eqNullSafe(F.col("name"))).groupBy("name").agg(F.countDistinct("src").alias("inbound"))
    return notes.select("id", "name").join(counts, "name", "left").select("id", F.coalesce("inbound", F.lit(0)).alias("inbound"))


def keepers(members: DataFrame) -> DataFrame:
    """Of each group of (group, id, inbound, length): most inbound links, then the longest, then the smallest id."""
    best = F.min_by("id", F.struct((-F.col("inbound")).alias("a"), (-F.col("length")).alias("b"), F.col("id").alias("c")))
    return members.groupBy("group").agg(best.alias("keeper"), F.count("*").alias("members"))
