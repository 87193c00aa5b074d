"""Near-duplicate embeddings through an inverted multi-index.

Either half of a unit vector has a codebook of its own; pairs of centres form a grid of cells. For a
vector, a cell's distance is bounded from below by how far the vector's halves lie from the
bisecting planes between their nearest centres and the cell's. A vector's traversal merges the sequences of
cells that its sorted bounds make, and so visits cells nearest first, until the next one is beyond the distance of the
asked cosine: that is the stop at which recall is one. Each cell has an inverted list of its members; only the
lists of visited cells are multiplied with the visitor. Vectors are shipped by SPAN cells of the first half at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import common_length, connected_components, join_hot, join_measured, least_labels, matrix, nearest_means, sound_vector, unit_rows

#: Vectors that the codebooks are fitted on: so many, and so many for each centre; most centres of a half.
SAMPLE, EACH, CENTRES = 8192, 16, 2048
#: Members that a cell of the largest label has on average, and what is added to the stop for rounding.
MEMBERS, MARGIN = 64, 1e-6
#: Rows of either kind that meet in one task, and cells of the first half that are shipped together.
BLOCK, SPAN = 4096, 4


@dataclass
class MultiIndex:
    """Centres of both halves, and the stop of the traversal."""

    halves: tuple[np.ndarray, np.ndarray]
    stop: float
    cut: int

    @classmethod
    def fit(cls, x: np.ndarray, k: int, cosine: float) -> MultiIndex:
        """``x``: unit rows. The stop is the squared distance of unit vectors at ``cosine``, and a margin
        for rounding. As bounds are never above the true distance, no link lies in a cell beyond it."""
        cut = x.shape[1] // 2
        k = min(k, len(x))
        halves = (nearest_means(x[:, :cut], k, seed=1), nearest_means(x[:, cut:], k, seed=2)) if cut else (np.zeros((1, 0)), nearest_means(x, k))
        return cls(halves, 2 - 2 * cosine + MARGIN, cut)

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.cut], x[:, self.cut:]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.argmin((c**2).sum(1) - 2 * h @ c.T, axis=1) for h, c in zip(self.parts(x), self.halves))

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared lower bound of the distance to each centre's cell, for both halves."""
        out = []
        for h, c in zip(self.parts(x), self.halves):
            score = (c**2).sum(1) - 2 * h @ c.T
            own = np.argmin(score, axis=1)
            # a divisor above the distance of centres that all but coincide keeps rounding below MARGIN, and the bound a bound
            apart = np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(-1), 1e-12))[own]
            out.append((np.maximum(score - score[np.arange(len(h)), own][:, None], 0) / (2 * apart)) ** 2)
        return tuple(out)

    def visits(self, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all visits, each row's nearest first; cell (i, j) is numbered i * kb + j.

        A row's cells of one first-half centre are a sequence that rises with the second half's sorted bounds.
        The least head of all sequences is visited next, until it is beyond the stop. Of two rows, the one in the
        earlier cell visits the other's, so visits to cells before a row's own are not returned.
        """
        a, b = self.bounds(x)
        over, ka, kb = np.argsort(b, axis=1), a.shape[1], b.shape[1]
        # beyond its last cell a sequence has ended
        b = np.c_[np.take_along_axis(b, over, 1), np.full(len(x), np.inf)]
        at, heads, live = np.zeros((len(x), ka), int), a + b[:, :1], np.arange(len(x))
        out = [(np.array([], int),) * 2]
        while True:
            nth = np.arange(len(live))
            first = heads.argmin(axis=1)
            going = heads[nth, first] <= self.stop
            if 2 * going.sum() < len(live) or not len(live):
                if not going.any():
                    return tuple(np.concatenate(z) for z in zip(*out))
                live, at, heads, first = live[going], at[going], heads[going], first[going]
                nth, going = np.arange(len(live)), np.ones(len(live), bool)
            nth, first = nth[going], first[going]
            row = live[nth]
            cell = first * kb + over[row, at[nth, first]]
            ahead = cell >= i[row] * kb + j[row]
            out.append((row[ahead], cell[ahead]))
            at[nth, first] += 1
            heads[nth, first] = a[row, first] + b[row, at[nth, first]]


def link_vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str, cosine: float) -> DataFrame:
    """One row per row of ``df``: vec_id, n_links, component_id, kept.

    Rows with one label (not null) link when their cosine is ``cosine`` or more, whole vectors in
    double precision. n_links counts the other rows linked directly, copies included;
    component_id is the smallest vec_id reachable by links, itself included; kept says that it is
    the row's own. Rows without a label, and rows whose vector is null or all zero, has null or non-finite
    components or not the common length, link with nothing. Repeated rows are copies of
    each other. A null vec_id stays null, and is kept only in a component without ids. An empty
    table gives no rows; other columns are ignored.

    Equal vectors of a label are one node with a count (two 64-bit hashes of a vector tell them apart), so a large group of
    copies is never paired. A cell that many vectors fall in is cut into blocks that are compared pairwise; a
    block returns counts and a spanning forest, never its pairs.
    """
    kind = df.select(vec_col).schema[0].dataType.simpleString()
    vector = F.col(vec_col).cast(kind if kind in ("array<float>", "array<double>") else "array<double>")
    all_rows = df.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("v"), F.col(label_col).alias("label"))
    sound = F.col("label").isNotNull() & sound_vector(F.col("v"))
    dim = common_length(all_rows.where(sound), "v")
    sound = sound & (F.size("v") == dim)
    # a vector's name: 128 bits of hash, which narrow tables carry in its place
    named = all_rows.where(sound).select("vec_id", "label", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    key = ["label", "h1", "h2"]
    nodes = named.groupBy(*key).agg(F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    nodes = nodes.withColumn("node", F.monotonically_increasing_id()).checkpoint()
    alone = all_rows.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    sizes = nodes.groupBy("label").agg(F.count("*").alias("n"), F.sum("copies").alias("rows")).agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("rows").alias("rows")).first()
    n = sizes["n"]
    if n:
        found = _compare(nodes, sizes["most"], dim, cosine).checkpoint()
        roots = connected_components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
        counts = found.groupBy("node").agg(F.sum("links").alias("links"))
        placed = nodes.select("node", *key, "least", "copies").join(counts, "node", "left").join(roots, "node", "left").select(
            *key, "least", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")).checkpoint()
        least = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")).checkpoint()
        placed = join_hot(placed, least, ["root"], "members", n).select(*key, "copies", "n_links", "component_id").checkpoint()
        linked = join_hot(named.drop("v"), placed, key, "copies", sizes["rows"]).select("vec_id", "n_links", "component_id")
        alone = linked.union(alone)
    return alone.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _compare(nodes: DataFrame, most: int, dim: int, cosine: float) -> DataFrame:
    """(node, links, root): partial link counts of nodes, and edges of spanning forests. ``most``: nodes of the largest label."""
    k = max(4, min(CENTRES, int((most / MEMBERS) ** 0.5)))
    picked = nodes.orderBy("h1", "node").limit(max(SAMPLE, EACH * k)).select("v").toArrow()
    index = MultiIndex.fit(unit_rows(matrix(picked.column("v"), dim)), k, cosine)
    width = SPAN * len(index.halves[1])
    label, vector = (nodes.schema[c].dataType.simpleString() for c in ("label", "v"))

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each node with its own cell, and with the cells that it visits, by span."""
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                x = unit_rows(matrix(part.column(3), dim))
                i, j = index.cells(x)
                row, cell = index.visits(x, i, j)
                order = np.lexsort((cell, row))
                row, cell = row[order], cell[order]
                span = cell // width
                first = np.nonzero(np.r_[True, (row[1:] != row[:-1]) | (span[1:] != span[:-1])][: len(row)])[0]
                cells = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)], pa.int32()), pa.array(cell, pa.int32()))
                looks = pa.StructArray.from_arrays([pa.array(span[first], pa.int32()), cells], ["span", "cells"])
                ends = pa.array(np.searchsorted(row[first], np.arange(len(x) + 1)), pa.int32())
                own = pa.array(i * (width // SPAN) + j, pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, own, pa.ListArray.from_arrays(ends, looks)], names=[*part.schema.names, "own", "looks"])

    told = nodes.select("label", "node", "copies", "v").mapInArrow(
        traverse, f"label {label}, node long, copies long, v {vector}, own int, looks array<struct<span: int, cells: array<int>>>").checkpoint()
    own_span = F.floor(F.col("own") / width).cast("int")
    blocks = lambda df, name: df.groupBy("label", "span").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    sizes = blocks(told.select("label", own_span.alias("span")), "mb").join(
        blocks(told.select("label", F.explode("looks.span").alias("span")), "vb"), ["label", "span"]).checkpoint()
    members = told.select("label", own_span.alias("span"), F.lit(False).alias("visits"), "node", "copies", "v", "own", F.array().cast("array<int>").alias("cells"))
    visitors = told.select("label", "node", "copies", "v", "own", F.explode("looks").alias("look")).select(
        "label", "look.span", F.lit(True).alias("visits"), "node", "copies", "v", "own", "look.cells")
    routed = join_measured(members.union(visitors), sizes, ["label", "span"])
    block = lambda count: F.pmod(F.xxhash64("node"), F.col(count)).cast("int")
    every = lambda count: F.sequence(F.lit(0), F.col(count) - 1)
    routed = routed.withColumn("_v", F.explode(F.when(F.col("visits"), F.array(block("vb"))).otherwise(every("vb"))))
    routed = routed.withColumn("_m", F.explode(F.when(F.col("visits"), every("mb")).otherwise(F.array(block("mb")))))

    def verify(unit: pa.Table) -> pa.Table:
        return _verify(unit, dim, cosine)

    return routed.drop("vb", "mb").groupBy("label", "span", "_v", "_m").applyInArrow(verify, "node long, links long, root long")


def _verify(unit: pa.Table, dim: int, cosine: float) -> pa.Table:
    visits = unit.column("visits").to_numpy()
    left, right = unit.filter(pa.array(visits)), unit.filter(pa.array(~visits))
    a, b = left.column("node").to_numpy(), right.column("node").to_numpy()
    nodes = np.unique(np.r_[a, b])
    pa_, pb = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    links, pairs = np.zeros(len(nodes), np.int64), [(np.array([], int),) * 2]
    if len(a) and len(b):
        x, y = unit_rows(matrix(left.column("v"), dim)), unit_rows(matrix(right.column("v"), dim))
        ca, cb = left.column("copies").to_numpy(), right.column("copies").to_numpy()
        own, of = left.column("own").to_numpy(), right.column("own").to_numpy()
        looks = left.column("cells").combine_chunks()
        visitor, cell = np.repeat(np.arange(len(a)), np.diff(looks.offsets.to_numpy())), looks.flatten().to_numpy()
        # both sides by cell: the members' inverted lists, and who looks into each
        lists, asks = np.argsort(of, kind="stable"), np.argsort(cell, kind="stable")
        of, visitor, cell = of[lists], visitor[asks], cell[asks]
        for c in np.unique(of):
            m = lists[slice(*np.searchsorted(of, (c, c + 1)))]
            who = visitor[slice(*np.searchsorted(cell, (c, c + 1)))]
            for at in range(0, len(who), 256):
                w = who[at: at + 256]
                hit = x[w] @ y[m].T >= cosine
                # inside its own cell a row meets only those with a larger node
                hit &= (own[w] != c)[:, None] | (a[w][:, None] < b[m][None])
                p, q = np.nonzero(hit)
                p, q = w[p], m[q]
                np.add.at(links, pa_[p], cb[q])
                np.add.at(links, pb[q], ca[p])
                pairs.append((pa_[p], pb[q]))
    p, q = (np.concatenate(x) for x in zip(*pairs))
    root = nodes[least_labels(len(nodes), p, q)] if len(p) else nodes
    met = links > 0
    return pa.table({"node": nodes[met], "links": links[met], "root": root[met]})


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT vec_id, min(other) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
