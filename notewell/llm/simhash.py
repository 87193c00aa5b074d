"""SimHash near-duplicates over word shingles.

Fingerprints are compared through an inverted index on their bytes by position. Two
64-bit fingerprints that differ in at most three bits share at least five of eight
bytes. Postings are keyed by four of the first seven positional bytes (35 keys for each
fingerprint; postings of single bytes would pair a 32nd of all fingerprints). How many postings a pair
meets in tells how many of the seven bytes it shares; with the eighth byte that gives its tally. Pairs
with a tally of five or more are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, join_hot, join_measured, least_labels

#: Words in a shingle, seed of its hash, differing bits of a link, bytes that a link shares at least.
SHINGLE, SEED, BITS = 3, 42, 3
SHARED = 8 - BITS
#: Bytes of a posting's key, of the first SPAN; pairs that share four, five, six and all seven of these meet in MET postings.
SPAN, WIDTH = 7, 4
KEYS = list(combinations(range(SPAN), WIDTH))
MET = [comb(shared, WIDTH) for shared in range(WIDTH, SPAN + 1)]
#: Postings up to this size are joined; larger ones are compared block by block, exactly as well.
SMALL, BLOCK = 256, 2048
#: Keys of two values each that may be broadcast to say which documents go.
DROPPED = 200_000


def fingerprint(text: str | None) -> int:
    """Unsigned fingerprint of a text (lower-cased A-Z; 3-word shingles with repeats); 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(len(words) - SHINGLE + 1, 1)
    if not words:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        part = words[at: at + (1 << 15) + SHINGLE - 1]
        shingles = zip(*(part[i:] for i in range(SHINGLE))) if len(part) >= SHINGLE else [part]
        hashes = [xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in shingles]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, fp) of each row, and the columns ``keep``; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), *batch.columns[2:]], names=["doc_id", "fp", *keep])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *keep)
    return rows.mapInArrow(run, rows.select("doc_id", F.lit(0).cast("long").alias("fp"), *keep).schema)


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))


def _key(fp: Column, k: int) -> Column:
    key = F.lit(k).cast("long")
    for i in KEYS[k]:
        key = F.shiftleft(key, 8).bitwiseOR(_byte(fp, i))
    return key


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that join all those within three bits.

    Small postings give every verified pair. A posting of more than SMALL fingerprints is cut into
    blocks by hash; each pair of blocks is one group, which tallies its pairs itself and returns no more than a spanning forest of
    the verified ones, so nothing grows with the square of a posting but comparisons. A pair that meets in a large
    posting is found there, so the tally over small postings alone need not be whole for it.
    """
    keyed = fps.select("fp", F.explode(F.array(*(_key(F.col("fp"), k) for k in range(len(KEYS))))).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").checkpoint()
    members = join_measured(keyed, shared, "key").checkpoint()
    pairs = tallied(members.where(F.col("n") <= SMALL)).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS).select("a", "b")

    large = members.where(F.col("n") > SMALL)
    if large.isEmpty():
        return pairs
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    large = large.withColumn("block", F.pmod(F.xxhash64("fp"), blocks).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    units = large.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp")
    forests = units.groupBy("key", "i", "j").applyInArrow(_forest, "a long, b long")
    return pairs.union(forests)


def tallied(postings: DataFrame) -> DataFrame:
    """(a, b, shared) of the pairs a < b that meet in (key, fp) postings and share SHARED positional bytes or more."""
    a, b = postings.select("key", F.col("fp").alias("a")), postings.select("key", F.col("fp").alias("b"))
    met = a.join(b, "key").where("a < b").groupBy("a", "b").agg(F.count("*").alias("met"))
    last = (_byte(F.col("a"), SPAN) == _byte(F.col("b"), SPAN)).cast("int")
    shared = sum(((F.col("met") >= m).cast("int") for m in MET[1:]), F.lit(WIDTH) + last)
    return met.select("a", "b", shared.alias("shared")).where(F.col("shared") >= SHARED)


def _forest(unit: pa.Table) -> pa.Table:
    fps = np.unique(unit.column("fp").to_numpy())
    plain = fps.view(np.uint64)
    left, right = [], []
    for at in range(0, len(fps), 64):
        xor = plain[at: at + 64, None] ^ plain[None, :]
        tally = (xor.view(np.uint8).reshape(*xor.shape, 8) == 0).sum(axis=2)
        p, q = np.nonzero((tally >= SHARED) & (np.bitwise_count(xor) <= BITS))
        keep = p + at < q
        left.append(p[keep] + at)
        right.append(q[keep])
    p, q = np.concatenate(left), np.concatenate(right)
    label = least_labels(len(fps), p, q)
    moved = label != np.arange(len(fps))
    return pa.table({"a": fps[label[moved]], "b": fps[moved]})


def groups(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fp, root, component_id, and the columns ``keep``.

    component_id is the smallest doc_id whose fingerprint is reachable by links, itself included; it is
    null only where all doc_ids of the component are. A null or empty text and one of white space have fingerprint
    zero and link like any other; repeated rows give repeated rows; an empty table gives none;
    other columns are ignored. Equal fingerprints are one node, so a large group of copies is one
    row in the index.
    """
    found = fingerprints(docs, *keep).checkpoint()
    reps = found.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")).checkpoint()
    n = reps.agg(F.count("*").alias("fps"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    roots = connected_components(links(reps.select("fp"))).checkpoint()
    placed = reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")).checkpoint()
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("fps")).checkpoint()
    placed = join_hot(placed, least, ["root"], "fps", n["fps"]).select("fp", "root", "component_id", "rows").checkpoint()
    return join_hot(found, placed, ["fp"], "rows", n["rows"]).select("doc_id", "fp", "root", "component_id", *keep)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group, with all its columns: that with the smallest doc_id (null last), then the smallest digest of its text.

    Null and empty texts are one group. Of rows that agree in both, one stays. An empty table gives no rows; other
    columns are kept, whatever their names. What goes is decided on narrow rows; texts move only where
    the keys that go are more than DROPPED, and then once.
    """
    columns = docs.columns
    marked = docs.withColumn("__mark", F.coalesce(F.md5(F.col("text").cast("string")), F.lit("null")))
    members = groups(marked.select("doc_id", "text", "__mark"), "__mark").groupBy("root", "doc_id", "__mark").agg(F.count("*").alias("__n")).checkpoint()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__mark"))
    best = members.groupBy("root").agg(first.alias("__best"), F.count("*").alias("__w")).checkpoint()
    decided = join_hot(members, best, ["root"], "__w", members.count())
    stays = F.col("doc_id").eqNullSafe(F.col("__best.doc_id")) & (F.col("__mark") == F.col("__best.__mark"))
    away = decided.select(F.col("doc_id").alias("__id"), F.col("__mark").alias("__away"), "__n", stays.alias("__stays")).where("__n > 1 OR NOT __stays").checkpoint()
    key = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__mark") == F.col("__away"))
    kept = join_measured(marked, away.select("__id", "__away"), key, "left_anti", rows=DROPPED).select(*columns)
    repeated = away.where("__stays").select("__id", "__away")
    if repeated.isEmpty():
        return kept
    again = join_measured(marked, repeated, key, "left_semi").dropDuplicates(["doc_id", "__mark"])
    return kept.union(again.select(*columns))
