"""A stored inverted index: built once, kept up by what changed, and searched by reading the query's terms alone.

Documents are dealt into ranges. A block holds the postings of one term in one range, with bounds on what any of them can add to a
score. A search reads the bounds of its terms, scores the most promising ranges, and then those whose bounds still reach the k-th best score: the result is
exact, however little of the index is read. Changes go into a segment of their own, and replaced documents are listed as dead until the index is compacted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import STOP_WORDS, tokens, words
from ..session import discard, durable, scratch, ship, spread
from ..sources import versions
from .incremental import snapshot_diff
from .retrieval import B, K1, broadcast_if_small, top_k

#: Documents of a range, folders that terms are dealt into, and ranges that are scored first for each query.
RANGE, BUCKETS, FIRST = 4096, 64, 4
#: Bytes of query texts that are searched for at once.
QUERY_BYTES = 8 << 20
#: Dead documents among all, and segments, beyond which an update compacts the index.
DEAD_SHARE, SEGMENTS = 0.25, 8


def blocks_of(docs: DataFrame, base: int, size: int) -> DataFrame:
    """(term, range, n, max_tf, min_length, postings, signatures) of (id, text, signature) rows: a row for each term of each range, and one without a term that lists the range's documents.

    ``size`` documents that are read one after another make a range, so its blocks are made where it is read. Range numbers begin at ``base`` and are not repeated.
    """
    ship(docs.sparkSession)

    def gather(lists: pa.ListArray, ids: pa.Array, signatures: pa.Array, nth: int) -> pa.RecordBatch:
        n, flat = len(lists), lists.flatten().dictionary_encode()
        row = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
        code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        kept = pc.invert(pc.is_in(flat.dictionary, pa.array(STOP_WORDS))).to_numpy(zero_copy_only=False)[code]
        row, code = row[kept], code[kept]
        # by term, then by document
        both, tf = np.unique(code * n + row, return_counts=True)
        length = np.bincount(row, minlength=n)
        term, doc = both // n, both % n
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        at = np.r_[doc, np.arange(n)]
        postings = pa.StructArray.from_arrays([ids.take(pa.array(at)), pa.array(np.r_[tf, length]), pa.array(length[at])], ["id", "tf", "length"])
        offsets = pa.array(np.r_[first, len(term), len(term) + n].astype(np.int32))
        most, least = (f.reduceat(x, first) if len(first) else np.zeros(0, np.int64) for f, x in ((np.maximum, tf), (np.minimum, length[doc])))
        told = pa.ListArray.from_arrays(pa.array(np.r_[np.zeros(len(first) + 1), n].astype(np.int32)), signatures)
        return pa.RecordBatch.from_arrays([
            pa.concat_arrays([flat.dictionary.take(pa.array(term[first])), pa.nulls(1, pa.string())]), pa.array(np.full(len(first) + 1, nth)), pa.array(np.diff(offsets.to_numpy()).astype(np.int64)),
            pa.array(np.r_[most, 0].astype(np.int64)), pa.array(np.r_[least, 0].astype(np.int64)), pa.ListArray.from_arrays(offsets, postings), told],
            ["term", "range", "n", "max_tf", "min_length", "postings", "signatures"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth, held = base + (TaskContext.get().partitionId() << 28), None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            while held.num_rows >= size:
                ids, signatures, lists = (c.combine_chunks() for c in held.slice(0, size).columns)
                yield gather(lists, ids, signatures, nth)
                held, nth = held.slice(size), nth + 1
        if held is not None and held.num_rows:
            ids, signatures, lists = (c.combine_chunks() for c in held.columns)
            yield gather(lists, ids, signatures, nth)

    rows = spread(docs.select("id", F.col("signature").cast("string").alias("signature"), "text")).select("id", "signature", words(F.col("text")).alias("terms"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"term string, range long, n long, max_tf long, min_length long, postings array<struct<id: {kind}, tf: long, length: long>>, signatures array<string>")


def alive(blocks: DataFrame, dead: DataFrame) -> DataFrame:
    """(term, range, n, max_tf, min_length, postings) without the postings of dead (id, range) documents, and without blocks that are left empty.

    Blocks of ranges that lost no document stay where they are. A range's other blocks come together with its dead documents once, and each batch of them is looked through as one array, so the
    work is that of its postings and not of postings times dead documents.
    """
    ship(blocks.sparkSession)
    names = ["term", "range", "n", "max_tf", "min_length", "postings"]
    blocks, hurt = blocks.select(*names), broadcast_if_small(dead.select("range").distinct())
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema)

    def drop(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left
        gone, parts = right.column("id").combine_chunks(), []
        for b in left.combine_chunks().to_batches(4096):
            lists = b.column(5)
            flat, sizes = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lists)), sizes)
            kept = pc.invert(pc.is_in(flat.field("id"), gone))
            flat, row = flat.filter(kept), row[kept.to_numpy(zero_copy_only=False)]
            n = np.bincount(row, minlength=len(lists))
            some = np.flatnonzero(n)
            ends = np.r_[0, np.cumsum(n[some])]
            most, least = (f.reduceat(flat.field(c).to_numpy(zero_copy_only=False), ends[:-1]) if len(some) else np.zeros(0, np.int64) for f, c in ((np.maximum, "tf"), (np.minimum, "length")))
            term, of = (b.column(k).take(pa.array(some)) for k in (0, 1))
            parts.append(pa.RecordBatch.from_arrays([term, of, pa.array(n[some].astype(np.int64)), pa.array(most), pa.array(least), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)], names))
        return pa.Table.from_batches(parts)

    left = blocks.join(hurt, "range", "left_semi").select(*names).toDF(*names)
    kept = left.groupBy("range").cogroup(dead.select("range", "id").groupBy("range")).applyInArrow(drop, schema)
    return blocks.join(hurt, "range", "left_anti").select(*names).union(kept)


def part(tf: Column, length: Column, mean: float) -> Column:
    """What a term's frequency adds to a score, before its rarity; it rises with ``tf`` and falls with ``length``, whatever the mean length is."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean)))


def bucket(term: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(n)).cast("int")


@dataclass
class TextIndex:
    """An index below ``root``, a folder that driver and executors share. Several sessions may read it while one changes it."""

    spark: SparkSession
    root: str
    _buckets: int = BUCKETS

    def _state(self) -> dict:
        number, state = versions.latest(self.spark, self.root)
        if not number:
            raise FileNotFoundError(f"no index at {self.root}")
        return state

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/data/{name}")

    def _write(self, df: DataFrame, name: str, *by: str) -> str:
        folder = versions.new_folder(self.root, name)
        writer = df.write.partitionBy(*by) if by else df.write
        writer.parquet(folder)
        return folder.rsplit("/", 1)[1]

    def _segment(self, blocks: DataFrame) -> str:
        """Write blocks by folder and term; the folder of them all."""
        placed = blocks.withColumn("bucket", bucket(F.col("term"), self._buckets)).repartitionByRange("bucket", "term", "range").sortWithinPartitions("bucket", "term", "range")
        return self._write(placed, "segment=s", "bucket")

    def _counted(self, docs: DataFrame, base: int, size: int, folder: str) -> tuple[DataFrame, DataFrame]:
        """Blocks and documents of (id, text, signature) rows; both come from what one pass has written to ``folder``."""
        blocks_of(docs, base, size).write.parquet(folder)
        rows = self.spark.read.parquet(folder)
        told = rows.where("term IS NULL").select("range", F.explode(F.arrays_zip("postings", "signatures")).alias("d"))
        return rows.where("term IS NOT NULL").drop("signatures"), told.select("d.postings.id", F.col("d.signatures").alias("signature"), "d.postings.length", "range")

    def _commit(self, segments: list[str], documents: str, dead: str | None, size: int, buckets: int) -> None:
        told = self._read(documents).agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        number, _ = versions.latest(self.spark, self.root)
        versions.commit(self.spark, self.root, number + 1, {"segments": segments, "documents": documents, "dead": dead, "size": size, "buckets": buckets,
                                                            "n": told[0], "total": told[1]})
        versions.vacuum(self.spark, self.root, 2)

    def build(self, docs: DataFrame, size: int = RANGE, buckets: int = BUCKETS) -> None:
        """Index all of (id, text, signature), with ``size`` documents a range and terms in ``buckets`` folders. Ids are not null and not repeated."""
        at, self._buckets = scratch(self.spark, "blocks"), buckets
        number, _ = versions.latest(self.spark, self.root)
        blocks, told = self._counted(docs, number << 56, size, at)
        self._commit([self._segment(blocks)], self._write(told, "documents"), None, size, buckets)
        discard(self.spark, at)

    def update(self, docs: DataFrame) -> DataFrame:
        """(id, action) against (id, text, signature): what was added, updated, removed or skipped. Only the texts of the first two are read into terms."""
        state, at = self._state(), scratch(self.spark, "blocks")
        number, _ = versions.latest(self.spark, self.root)
        known = self._read(state["documents"])
        diff = durable(snapshot_diff(known, docs, "id", "signature"))
        fresh = docs.join(broadcast_if_small(diff.where("action IN ('added', 'updated')").select("id")), "id", "left_semi")
        blocks, told = self._counted(fresh, number << 56, state["size"], at)
        kept = known.join(diff.where("action = 'skipped'").select("id"), "id", "left_semi")
        documents = self._write(kept.unionByName(told), "documents")
        gone = known.join(diff.where("action IN ('updated', 'removed')").select("id"), "id", "left_semi").select("id", "range")
        dead = self._write(gone if state["dead"] is None else gone.unionByName(self._read(state["dead"])), "dead")
        segments, self._buckets = state["segments"], state["buckets"]
        if not blocks.isEmpty():
            segments = [*segments, self._segment(blocks)]
        self._commit(segments, documents, dead, state["size"], state["buckets"])
        discard(self.spark, at)
        if len(segments) > SEGMENTS or self._read(dead).count() > DEAD_SHARE * max(1, state["n"]):
            self.compact()
        return diff

    def compact(self) -> None:
        """Put all segments together and leave dead documents out of their blocks. Texts are not needed, and ranges stay as they are."""
        state = self._state()
        blocks, self._buckets = self._blocks(state).drop("bucket"), state["buckets"]
        if state["dead"] is not None:
            blocks = alive(blocks, self._read(state["dead"]))
        self._commit([self._segment(blocks)], state["documents"], None, state["size"], state["buckets"])

    def documents(self) -> DataFrame:
        """(id, signature, length, range) of the documents that are indexed."""
        return self._read(self._state()["documents"])

    def _blocks(self, state: dict) -> DataFrame:
        ids = self._read(state["documents"]).schema["id"].dataType.simpleString()
        schema = f"term string, range long, n long, max_tf long, min_length long, postings array<struct<id: {ids}, tf: long, length: long>>, bucket int"
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/data").parquet(*(f"{self.root}/data/{s}" for s in state["segments"])).drop("segment")

    def _asked(self, state: dict, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Query terms (query_id, term, qtf, idf), and the blocks of their terms; folders that hold none of them are never opened."""
        asked = durable(queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf")))
        terms = durable(asked.select("term").distinct().withColumn("bucket", bucket(F.col("term"), state["buckets"])))
        wanted = [r["bucket"] for r in terms.select("bucket").distinct().collect()]
        blocks = self._blocks(state).where(F.col("bucket").isin(wanted)).join(broadcast_if_small(terms), ["bucket", "term"], "left_semi")
        df = blocks.groupBy("term").agg(F.sum("n").alias("df"))
        if state["dead"] is not None:
            # only blocks of ranges that lost documents are looked into
            dead = self._read(state["dead"])
            hit = blocks.join(broadcast_if_small(dead.select("range").distinct()), "range", "left_semi").select("term", "range", F.explode("postings.id").alias("id"))
            lost = hit.join(broadcast_if_small(dead), ["id", "range"], "left_semi").groupBy("term").agg(F.count("*").alias("lost"))
            df = df.join(lost, "term", "left").select("term", (F.col("df") - F.coalesce("lost", F.lit(0))).alias("df")).where("df > 0")
        idf = df.select("term", F.ln((F.lit(state["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
        return durable(asked.join(idf, "term")), blocks

    def _scores(self, state: dict, pairs: DataFrame, asked: DataFrame, blocks: DataFrame, mean: float, k: int | None) -> DataFrame:
        """(query_id, id, score) of the documents in the ranges of (query_id, range), of each range a query's ``k`` best and what comes close to them, or all.

        A range's blocks of all asked terms come together once, however many queries ask for it, and are scored as arrays; a range is bounded, and so is its result.
        """
        ship(self.spark)
        weights: dict[str, list] = {}
        kinds = pairs.schema["query_id"].dataType
        for r in asked.select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w")).toLocalIterator():
            weights.setdefault(r["term"], []).append((r["query_id"], r["w"]))
        told = self.spark.sparkContext.broadcast(weights)

        def score(left: pa.Table, right: pa.Table) -> pa.Table:
            wanted = set(right.column("query_id").drop_null().to_pylist())
            postings = left.column("postings").combine_chunks() if left.num_rows else pa.array([], left.schema.field("postings").type)
            flat = postings.flatten()
            ids, doc = np.unique(flat.field("id").to_numpy(zero_copy_only=False), return_inverse=True) if len(flat) else (np.zeros(0), np.zeros(0, int))
            tf, length = (flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("tf", "length"))
            part_of = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
            ends = np.cumsum(postings.value_lengths().to_numpy(zero_copy_only=False)) if len(postings) else np.zeros(0, int)
            dead = np.isin(ids, right.column("dead").drop_null().to_numpy()) if len(ids) else np.zeros(0, bool)
            total: dict = {}
            for at, term in enumerate(left.column("term").to_pylist()):
                own = slice(ends[at - 1] if at else 0, ends[at])
                for query, w in told.value.get(term, ()):
                    if query in wanted:
                        # a document stands once in a block
                        total.setdefault(query, np.zeros(len(ids)))[doc[own]] += w * part_of[own]
            queries, found, scores = [], [], []
            for query, s in total.items():
                s[dead] = 0
                best = np.flatnonzero(s > 0)
                if k is not None and len(best) > k:
                    best = best[s[best] >= np.partition(s[best], len(best) - k)[len(best) - k] - 0.00001]
                queries += [query] * len(best)
                found.append(ids[best])
                scores.append(s[best])
            of = right.schema.field("query_id").type
            kept = pa.array(np.concatenate(found), left.schema.field("postings").type.value_type.field("id").type) if found else pa.array([], left.schema.field("postings").type.value_type.field("id").type)
            return pa.table({"query_id": pa.array(queries, of), "id": kept, "score": pa.array(np.concatenate(scores) if scores else [], pa.float64())})

        id_type = self._read(state["documents"]).schema["id"].dataType
        none = lambda kind: F.lit(None).cast(kind)
        sides = pairs.select("range", "query_id", none(id_type).alias("dead"))
        if state["dead"] is not None:
            sides = sides.union(self._read(state["dead"]).join(F.broadcast(pairs.select("range").distinct()), "range", "left_semi").select("range", none(kinds), "id"))
        open_blocks = blocks.join(broadcast_if_small(durable(pairs.select("range").distinct())), "range", "left_semi").select("range", "term", "postings")
        scored = open_blocks.groupBy("range").cogroup(sides.groupBy("range")).applyInArrow(score, f"query_id {kinds.simpleString()}, id {id_type.simpleString()}, score double")
        return scored

    def _weighed(self, scored: DataFrame, weights: DataFrame | None) -> DataFrame:
        if weights is not None:
            scored = scored.join(broadcast_if_small(weights), "id", "left").select("query_id", "id", (F.round("score", 6) * F.coalesce("weight", F.lit(1.0))).alias("score"))
        return scored.select("query_id", "id", F.round("score", 6).alias("score")).where("score > 0")

    def bounds(self, state: dict, asked: DataFrame, blocks: DataFrame, mean: float, most: float = 1.0) -> DataFrame:
        """(query_id, range, bound, blocks): what no document of a range can exceed, from the blocks' bounds alone."""
        heads = blocks.select("term", "range", part(F.col("max_tf"), F.col("min_length"), mean).alias("part"))
        return heads.join(broadcast_if_small(asked), "term").groupBy("query_id", "range").agg(
            F.sum(F.col("qtf") * F.col("idf") * F.col("part") * most).alias("bound"), F.count("*").alias("blocks"))

    def search(self, queries: DataFrame, k: int, weights: DataFrame | None = None) -> DataFrame:
        """(query_id, id, score, rank): the k best documents of each query (query_id, text) by BM25, ties to the smaller id; scores are rounded to six places first.

        With ``weights`` (id, weight), scores are multiplied before they are ranked, and what has none left is out.
        """
        state = self._state()
        n = queries.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        # query terms are held by every task, so queries of more text than that are searched in parts
        parts, found = max(1, -(-n // QUERY_BYTES)), None
        for part_no in range(parts):
            mine = queries if parts == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part_no)
            one = self._search(state, mine, k, weights)
            found = one if found is None else found.union(one)
        return found

    def _search(self, state: dict, queries: DataFrame, k: int, weights: DataFrame | None) -> DataFrame:
        mean = max(1.0, state["total"] / max(1, state["n"]))
        most = 1.0 if weights is None else float(max(1.0, weights.agg(F.max("weight")).first()[0] or 1.0))
        cut = k if weights is None else None
        asked, blocks = self._asked(state, queries)
        bounds = durable(self.bounds(state, asked, blocks, mean, most))
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "range"))
        ranked = durable(bounds.withColumn("nth", nth))
        first = durable(self._weighed(self._scores(state, ranked.where(F.col("nth") <= FIRST).select("query_id", "range"), asked, blocks, mean, cut), weights))
        least = top_k(first, "score", k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        # a bound that comes within the rounding of the k-th score is still looked into
        open_ranges = durable(ranked.where(F.col("nth") > FIRST).join(least, "query_id", "left").where("least IS NULL OR bound >= least - 0.00001").select("query_id", "range"))
        return top_k(first.union(self._weighed(self._scores(state, open_ranges, asked, blocks, mean, cut), weights)), "score", k)
