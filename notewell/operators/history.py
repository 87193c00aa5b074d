"""Commit histories in compressed form: every commit has a place on a chain, and what a commit reaches is one place on each chain met.

A chain follows first parents, one heir for each parent, so a commit on it reaches all places below its own. Only edges between
chains are walked. Sets of commits are written out only where they are asked for, and then by place.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import durable, settled, ship

#: Places of a chain that are looked through at once; and edges between chains, narrow rows, up to which every task holds them.
BLOCK, HELD = 4096, 200_000
#: How names of chains begin that are one commit which no line lists; those of others begin with a number.
ALONE = "="


def _kept(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by keys and written, so that joins by them do not shuffle it again."""
    return settled(df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys))


def place(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(origin, sha, chain, pos) of commits (origin, sha) on the paths that (origin, sha, parent) links make; a chain is named by its root.

    Jumps get three times as long with each round. What still moves is equally far from where it jumps to, so no two rows of a path meet the same row.
    """
    known = nodes.join(links, ["origin", "sha"], "left").select(
        "origin", "sha", F.coalesce("parent", "sha").alias("to"), F.col("parent").isNotNull().cast("long").alias("pos"), F.col("parent").isNull().alias("last"))
    known = durable(known)

    def jumped(rows: DataFrame, by: DataFrame) -> DataFrame:
        ahead = by.select("origin", F.col("sha").alias("to"), F.col("to").alias("_to"), F.col("pos").alias("_pos"), F.col("last").alias("_last"))
        moved = rows.where("NOT last").join(ahead, ["origin", "to"]).select("origin", "sha", F.col("_to").alias("to"), (F.col("pos") + F.col("_pos")).alias("pos"), F.col("_last").alias("last"))
        return rows.where("last").union(moved)

    while True:
        # two steps over what one round has written make three times its length
        known = durable(jumped(jumped(known, known), known))
        if known.where("NOT last").isEmpty():
            return known.select("origin", "sha", F.col("to").alias("chain"), "pos")


@dataclass
class History:
    """Places of all commits (origin, sha, chain, pos, ...), and the edges that lead from one chain to another (origin, chain, pos, to_chain, to_pos)."""

    commits: DataFrame
    crossing: DataFrame

    @classmethod
    def of(cls, edges: DataFrame, others: DataFrame | None = None) -> History:
        """From (origin, sha, parent) edges, ``nth`` telling first parents (0) from others where it is there; and commits (origin, sha) that may have none."""
        edges = edges if "nth" in edges.columns else edges.withColumn("nth", F.lit(0))
        edges = durable(edges.where("parent IS NOT NULL").groupBy("origin", "sha", "parent").agg(F.min("nth").alias("nth")))
        main = edges.groupBy("origin", "sha").agg(F.min_by("parent", F.struct("nth", "parent")).alias("parent"))
        links = durable(main.groupBy("origin", "parent").agg(F.min("sha").alias("sha")).select("origin", "sha", "parent"))
        nodes = edges.select("origin", "sha").union(edges.select("origin", "parent"))
        nodes = (nodes if others is None else nodes.union(others.select("origin", "sha").where("sha IS NOT NULL"))).distinct()
        placed = place(nodes, links)
        crossing = edges.join(links, ["origin", "sha", "parent"], "left_anti").join(placed, ["origin", "sha"])
        there = placed.select("origin", F.col("sha").alias("parent"), F.col("chain").alias("to_chain"), F.col("pos").alias("to_pos"))
        crossing = crossing.join(there, ["origin", "parent"]).groupBy("origin", "chain", "pos", "to_chain").agg(F.max("to_pos").alias("to_pos"))
        return cls(placed, durable(crossing))

    @classmethod
    def of_lines(cls, lines: DataFrame, merged: DataFrame, others: DataFrame | None = None) -> History:
        """From commits as their source lists them, (origin, line, at, sha, parent), each once and with its first parent; edges (origin, sha, parent) to further parents; and commits that may be in neither.

        A commit that follows its first parent in a line is on that one's chain, so places come from one window over the lines instead of jumps over all commits. Where a line
        does not go on with an heir, another chain begins, with an edge to the parent: lines that say little make more chains, not other results. A chain is named by the number of
        its root in a line, which is shorter than a commit's name. Further columns of the lines stay with the places and are null for commits that no line lists.
        """
        also = [c for c in lines.columns if c not in ("origin", "line", "at", "sha", "parent")]
        w = Window.partitionBy("origin", "line").orderBy("at")
        rows = lines.withColumn("_heir", F.coalesce(F.col("parent") == F.lag("sha").over(w), F.lit(False))).withColumn("_nth", F.row_number().over(w))
        root = F.max(F.when(~F.col("_heir"), F.col("_nth"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
        line = F.coalesce(F.concat(F.lit(":"), F.col("line").cast("string")), F.lit(""))
        placed = rows.withColumn("_root", root).select("origin", "sha", F.concat(F.col("_root").cast("string"), line).alias("chain"), (F.col("_nth") - F.col("_root")).cast("long").alias("pos"), *also)
        placed = _kept(placed, "origin", "sha")
        leaving = durable(rows.where("NOT _heir AND parent IS NOT NULL").select("origin", "sha", "parent").union(merged.where("parent IS NOT NULL").select("origin", "sha", "parent")).distinct())
        named = [leaving.select("origin", "sha"), leaving.select("origin", F.col("parent").alias("sha"))] + ([] if others is None else [others.select("origin", "sha").where("sha IS NOT NULL")])
        alone = durable(reduce(DataFrame.union, named).distinct().join(placed, ["origin", "sha"], "left_anti"))
        if not alone.isEmpty():
            bare = [F.lit(None).cast(placed.schema[c].dataType).alias(c) for c in also]
            alone = alone.select("origin", "sha", F.concat(F.lit(ALONE), F.hex("sha")).alias("chain"), F.lit(0).cast("long").alias("pos"), *bare)
            placed = _kept(placed.union(alone), "origin", "sha")
        there = placed.select("origin", F.col("sha").alias("parent"), F.col("chain").alias("to_chain"), F.col("pos").alias("to_pos"))
        crossing = leaving.join(placed, ["origin", "sha"]).join(there, ["origin", "parent"]).groupBy("origin", "chain", "pos", "to_chain").agg(F.max("to_pos").alias("to_pos"))
        return cls(placed, _kept(crossing, "origin", "chain"))

    def reach(self, starts: DataFrame, group: list[str], held: int = HELD) -> DataFrame:
        """(origin, group..., chain, upto): the highest place on each chain that the starts (origin, group..., sha) reach, these included.

        Where the edges between chains are no more than ``held``, every task has them and follows each group's to the end. Beyond that a round joins the edges that leave
        what the round before has covered anew, so there are as many rounds as chains are changed on the way. A start that is no known commit reaches nothing.
        """
        keys = ["origin", *group, "chain"]
        front = starts.join(self.commits, ["origin", "sha"]).groupBy(*keys).agg(F.max("pos").alias("upto"))
        if self.crossing.limit(held + 1).count() <= held:
            return durable(self._followed(front, group))
        return self._joined(front, group)

    def _followed(self, front: DataFrame, group: list[str]) -> DataFrame:
        """The edges of a chain, sorted by place, are a list in every task. What is still to be covered of a chain is taken highest place first."""
        ship(front.sparkSession)
        edges: dict[tuple, tuple[list, list]] = {}
        for r in self.crossing.orderBy("origin", "chain", "pos").toLocalIterator():
            places, ends = edges.setdefault((r["origin"], r["chain"]), ([], []))
            places.append(r["pos"])
            ends.append((r["to_chain"], r["to_pos"]))
        told = front.sparkSession.sparkContext.broadcast(edges)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            leaving = told.value
            for b in batches:
                of, chains, uptos = [], [], []
                for i, (origin, starts) in enumerate(zip(b.column("origin").to_pylist(), b.column("starts").to_pylist())):
                    upto, todo = {}, [(s["chain"], s["upto"]) for s in starts]
                    while todo:
                        chain, top = todo.pop()
                        low = upto.get(chain, -1)
                        if top <= low:
                            continue
                        upto[chain] = top
                        places, ends = leaving.get((origin, chain), ((), ()))
                        todo.extend(ends[bisect_right(places, low): bisect_right(places, top)])
                    of += [i] * len(upto)
                    chains += upto
                    uptos += upto.values()
                rows = b.select(["origin", *group]).take(pa.array(of, pa.int64()))
                named = b.schema.field("starts").type.value_type.field("chain").type
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(chains, named), pa.array(uptos, pa.int64())], ["origin", *group, "chain", "upto"])

        starts = front.groupBy("origin", *group).agg(F.collect_list(F.struct("chain", "upto")).alias("starts"))
        return starts.mapInArrow(run, front.schema)

    def _joined(self, front: DataFrame, group: list[str]) -> DataFrame:
        """Rows stay dealt out by group. A round sends the edges that leave what is new there, and adds what they meet; groups that a round adds nothing to are left where they were written."""
        whose, n = ["origin", *group], int(front.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        edges = self.crossing.withColumnRenamed("chain", "_chain").withColumnRenamed("origin", "_origin")
        # places up to low are followed already
        moves = F.max(F.col("upto") > F.col("low")).over(Window.partitionBy(*whose))
        seen = settled(front.repartition(n, *whose).withColumn("low", F.lit(-1).cast("long")).withColumn("moves", moves))
        done = []
        while not (moving := seen.where("moves")).isEmpty():
            done.append(seen.where("NOT moves"))
            left = moving.where("upto > low").join(edges, (F.col("origin") == F.col("_origin")) & (F.col("chain") == F.col("_chain")) & (F.col("pos") > F.col("low")) & (F.col("pos") <= F.col("upto")))
            met = left.groupBy(*whose, "chain", "to_chain").agg(F.max("to_pos").alias("upto")).select(*whose, F.col("to_chain").alias("chain"), "upto", F.lit(-1).cast("long").alias("low"))
            both = moving.select(*whose, "chain", "upto", F.col("upto").alias("low")).union(met.repartition(n, *whose))
            seen = settled(both.groupBy(*whose, "chain").agg(F.max("upto").alias("upto"), F.max("low").alias("low")).withColumn("moves", moves))
        return reduce(DataFrame.union, [x.select(*whose, "chain", "upto") for x in (*done, seen)])

    def holds(self, reach: DataFrame, asked: DataFrame, group: list[str]) -> DataFrame:
        """``asked`` (origin, group..., sha, ...) with ``held``: does the group's reach take the commit in? Not so for commits that nobody knows."""
        placed = asked.join(self.commits, ["origin", "sha"], "left").join(reach, ["origin", *group, "chain"], "left")
        return placed.withColumn("held", F.coalesce(F.col("pos") <= F.col("upto"), F.lit(False))).select(*asked.columns, "held")

    def _spans(self, reach: DataFrame, known: DataFrame, group: list[str]) -> tuple[DataFrame, list[str]]:
        """``reach`` with the place ``low`` up to which ``known`` has each chain, and the further columns of ``reach``."""
        spans = reach.join(known.select("origin", *group, "chain", F.col("upto").alias("low")), ["origin", *group, "chain"], "left")
        return spans.withColumn("low", F.coalesce("low", F.lit(-1).cast("long"))).where("upto > low"), [c for c in reach.columns if c not in ("origin", *group, "chain", "upto")]

    def beyond(self, reach: DataFrame, known: DataFrame, group: list[str]) -> DataFrame:
        """(origin, group..., sha, ...): what ``reach`` takes in and ``known`` does not, written out place by place, with further columns of ``reach`` and of the places, of which commits that no line lists have none."""
        spans, further = self._spans(reach, known, group)
        places = spans.select("origin", *group, "chain", *further, F.explode(F.sequence(F.col("low") + 1, F.col("upto"))).alias("pos"))
        return places.join(self.commits, ["origin", "chain", "pos"]).drop("chain", "pos")

    def among(self, reach: DataFrame, known: DataFrame, group: list[str], commits: DataFrame) -> DataFrame:
        """The rows of ``commits`` (origin, sha, ...) that ``reach`` takes in and ``known`` does not, by group and with further columns of ``reach``: for few commits and long histories. They may have their places with them."""
        spans, further = self._spans(reach, known, group)
        placed = commits if "chain" in commits.columns else commits.join(self.commits.select("origin", "sha", "chain", "pos"), ["origin", "sha"])
        met = placed.join(spans, ["origin", "chain"]).where("pos > low AND pos <= upto")
        return met.select(*group, *further, *commits.columns)

    def summary(self, reach: DataFrame, group: list[str]) -> DataFrame:
        """(origin, group..., commits, first_sha): how many commits a group reaches, and the least of them, from blocks of places and never commit by commit."""
        # commits and the places that are asked for in one window: the least up to each place of a block, and at a whole block's end that of the block
        sha = self.commits.schema["sha"].dataType
        asked = reach.select("origin", "chain", F.col("upto").alias("pos"), F.lit(None).cast(sha).alias("sha"), F.lit(1).alias("_asked"), *group)
        rows = self.commits.select("origin", "chain", "pos", "sha", F.lit(0).alias("_asked"), *(F.lit(None).cast(reach.schema[g].dataType).alias(g) for g in group)).union(asked)
        rows = rows.withColumn("block", F.expr(f"pos DIV {BLOCK}"))
        upto = F.min("sha").over(Window.partitionBy("origin", "chain", "block").orderBy("pos", "_asked").rowsBetween(Window.unboundedPreceding, 0))
        # the window is over all commits, so it is taken once for both that read it
        rows = durable(rows.withColumn("least", upto).where(f"_asked = 1 OR pos % {BLOCK} = {BLOCK - 1}").drop("sha"))
        blocks = rows.where("_asked = 0").select("origin", "chain", "block", "least")
        ends = reach.withColumn("_end", F.expr(f"upto DIV {BLOCK}"))
        whole = ends.where("_end > 0").join(blocks, ["origin", "chain"]).where("block < _end").select("origin", *group, F.lit(0).cast("long").alias("n"), "least")
        tops = rows.where("_asked = 1").select("origin", *group, (F.col("pos") + 1).alias("n"), "least")
        return whole.union(tops).groupBy("origin", *group).agg(F.sum("n").alias("commits"), F.min("least").alias("first_sha"))


def reachable_from(edges: DataFrame, starts: DataFrame, group: list[str] = []) -> DataFrame:  # noqa: B006 (never changed)
    """(origin, group..., sha) reachable from the starts, these included, over (origin, sha, parent) edges, written out."""
    history = History.of(edges, starts)
    reach = history.reach(starts, group)
    return history.beyond(reach, reach.limit(0), group)


def is_ancestor(pairs: DataFrame, edges: DataFrame | History) -> DataFrame:
    """(origin, old, tip, ancestor) of (origin, old, tip): does the tip reach the old commit?"""
    history = edges if isinstance(edges, History) else History.of(edges, pairs.select("origin", F.col("tip").alias("sha")))
    reach = history.reach(pairs.select("origin", "tip", F.col("tip").alias("sha")).distinct(), ["tip"])
    held = history.holds(reach, pairs.select("origin", "tip", F.col("old").alias("sha")), ["tip"])
    return held.select("origin", F.col("sha").alias("old"), "tip", F.col("held").alias("ancestor"))
