"""Benchmark decontamination by winnowing.

Words become 64-bit hashes, and of the hashes of k consecutive words the least one of each sliding window of them is a
fingerprint. A window of ``span`` words holds ``span - k + 1`` such hashes, so a run of ``span`` words that a document and an
item share has its fingerprint in both. Fingerprints are joined, and each hit is extended word by word to both sides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_measured, prepare

#: Consecutive words of an item that count when they stand in a document; a shorter item counts as a whole.
SPAN = 10
#: Bytes of text that are hashed at once, and fingerprints of items up to which the join broadcasts them.
AT_ONCE, BROADCAST_PRINTS = 1 << 20, 200_000
#: Bits of the filter that documents' fingerprints pass first: so many for each of the items', but never more than 32 MB in all.
BITS_EACH, MOST_BITS = 32, 1 << 28
#: The characters that words consist of, in UTF-8: digits, small letters, and all bytes of other characters than ASCII.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
BETWEEN = re.compile(rb"[^0-9a-z\x80-\xff]")
#: Fixed random numbers: one for each byte and for each place in a group of words; and the odd base of the words' polynomials with its inverse.
RNG = np.random.default_rng(29)
VALUES = RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
PLACES = RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Stand for the words beyond an item's and a document's ends; they never match.
BEYOND_ITEM, BEYOND_DOC = np.uint64(0), np.uint64(1)

PRINTS = "array<struct<level: int, hash: long, at: long, around: binary>>"


@lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    both = np.ones((2, n), np.uint64)
    both[0, 1:], both[1, 1:] = np.uint64(BASE), np.uint64(INVERSE)
    np.multiply.accumulate(both, axis=1, out=both)
    return both[0], both[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def pieces(raw: bytes) -> Iterator[bytes]:
    """A text in pieces of some AT_ONCE bytes, cut where no word is; only a longer word makes a longer piece."""
    at = 0
    while at < len(raw):
        cut = BETWEEN.search(raw, at + AT_ONCE)
        end = cut.start() if cut else len(raw)
        yield raw[at:end]
        at = end


def hashes_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of lower-cased UTF-8, and the byte that it begins at."""
    data = np.frombuffer(raw, np.uint8)
    inside = IN_WORD[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begins, ends = edges[::2], edges[1::2]
    if not len(begins):
        return np.zeros(0, np.uint64), begins
    power, inverse = powers(max(2 * AT_ONCE, 1 << len(raw).bit_length()))
    total = np.cumsum(VALUES[data] * inside * power[: len(data)], dtype=np.uint64)
    before = np.where(begins > 0, total[begins - 1], np.uint64(0))
    return mix((total[ends - 1] - before) * inverse[begins]) | np.uint64(2), begins


def words_of(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first, hashes, counts): the words of the texts from the one numbered ``first`` on, some AT_ONCE bytes at a time, in order."""
    group, size, first = [], 0, 0

    def flush():
        raw = b"\n".join(group)
        h, begins = hashes_of(raw)
        ends = np.cumsum([len(g) + 1 for g in group])
        return h, np.diff(np.searchsorted(begins, ends), prepend=0)

    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass").translate(LOWER)
        if group and size + len(raw) > AT_ONCE:
            yield first, *flush()
            group, size, first = [], 0, i
        if len(raw) > AT_ONCE:
            h = np.concatenate([hashes_of(p)[0] for p in pieces(raw)])
            yield i, h, np.array([len(h)])
            first = i + 1
        else:
            group.append(raw)
            size += len(raw)
    if group:
        yield first, *flush()


def gram(level: int) -> int:
    """Words of a fingerprint for runs of ``level`` words."""
    return (level + 1) // 2


def winnow(h: np.ndarray, counts: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the fingerprints of texts whose words ``h`` holds one text after another."""
    k = gram(level)
    if len(h) < level:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(h) - k + 1
    grams = np.zeros(n, np.uint64)
    for j in range(k):
        grams += h[j: j + n] * PLACES[j]
    grams = mix(grams)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(h))
    windows = np.flatnonzero(left[: len(h) - level + 1] >= level)
    least = np.lib.stride_tricks.sliding_window_view(grams, level - k + 1)[windows].argmin(axis=1)
    at = np.unique(windows + least)
    return grams[at], at


def around(h: np.ndarray, counts: np.ndarray, at: np.ndarray, level: int, beyond: np.uint64) -> np.ndarray:
    """The words of each fingerprint and of as many to each side as a run of ``level`` words can have."""
    reach = level - gram(level)
    ends = np.cumsum(counts)
    text = np.searchsorted(ends, at, side="right")
    where = at[:, None] + np.arange(-reach, level)
    inside = (where >= (ends - counts)[text][:, None]) & (where < ends[text][:, None])
    return np.where(inside, h[np.clip(where, 0, len(h) - 1)], beyond)


def _prints(h: np.ndarray, counts: np.ndarray, levels: list[int], beyond: np.uint64, passes=None) -> tuple[pa.Array, np.ndarray]:
    """Fingerprints as an Arrow array of structs, ordered by text, and how many each text has."""
    ends = np.cumsum(counts)
    parts = []
    for level in levels:
        g, at = winnow(h, counts, level)
        if passes is not None:
            good = passes(g)
            g, at = g[good], at[good]
        wide = around(h, counts, at, level, beyond) if len(at) else np.zeros((0, 2 * level - gram(level)), np.uint64)
        text = np.searchsorted(ends, at, side="right")
        parts.append((text, np.full(len(at), level, np.int32), g.view(np.int64), at - (ends - counts)[text] if len(at) else at, [r.tobytes() for r in wide]))
    text = np.concatenate([p[0] for p in parts])
    order = np.argsort(text, kind="stable")
    bits = [b for p in parts for b in p[4]]
    columns = [pa.array(np.concatenate([p[c] for p in parts])[order]) for c in (1, 2, 3)] + [pa.array([bits[i] for i in order], pa.binary())]
    return pa.StructArray.from_arrays(columns, ["level", "hash", "at", "around"]), np.bincount(text, minlength=len(counts))


def _fingerprint(df: DataFrame, levels: list[int] | None, beyond: np.uint64, bitmap=None) -> DataFrame:
    """(id, n_words, prints) of rows (id, text); ``levels`` None: the text's own, its number of words up to SPAN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = None
        if bitmap is not None:
            bits = bitmap.value
            shift = np.uint64(64 - (len(bits) * 8).bit_length() + 1)
            passes = lambda g: (bits[(g >> shift) >> np.uint64(3)] >> ((g >> shift) & np.uint64(7)).astype(np.uint8)) & 1 == 1
        for b in batches:
            for first, h, counts in words_of(b.column(1).to_pylist()):
                if levels is None:
                    each, ends = [], np.cumsum(counts)
                    for end, n in zip(ends, counts):
                        each.append(_prints(h[end - n: end], np.array([n]), [min(SPAN, n)], beyond) if n else (None, [0]))
                    found = pa.concat_arrays([p for p, _ in each if p is not None]) if counts.any() else _prints(h, counts, [SPAN], beyond)[0]
                    sizes = np.concatenate([s for _, s in each])
                else:
                    found, sizes = _prints(h, counts, levels, beyond, passes)
                offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(counts)), pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(offsets, found)], ["id", "n_words", "prints"])

    schema = f"id {df.schema[0].dataType.simpleString()}, n_words long, prints {PRINTS}"
    return df.mapInArrow(run, schema)


def bitmap_of(prints: DataFrame, n: int) -> np.ndarray:
    """A bit for each value that the leading bits of the fingerprints take, of BITS_EACH times ``n`` bits, and MOST_BITS at most.

    Beyond that more of the documents' fingerprints pass and fail in the join: the filter only saves work.
    """
    size = min(MOST_BITS, max(64, 1 << (BITS_EACH * n).bit_length()))
    place = F.expr(f"shiftrightunsigned(hash, {64 - size.bit_length() + 1})")
    byte = prints.select(place.alias("place")).selectExpr("place DIV 8 AS byte", "shiftleft(1, CAST(place % 8 AS INT)) AS bit").groupBy("byte").agg(F.bit_or("bit").alias("bits"))
    told = byte.toArrow()
    bitmap = np.zeros(size // 8, np.uint8)
    bitmap[told.column("byte").to_numpy()] = told.column("bits").to_numpy().astype(np.uint8)
    return bitmap


def extend(pairs: DataFrame) -> DataFrame:
    """(row, item_id, begin, end): the runs of document words around pairs of equal fingerprints that make a whole window.

    Words are compared outwards from the fingerprint, as far as a window that holds it can reach; all windows
    that hold it lie inside that run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            levels = b.column("level").to_numpy()
            begin, end = np.zeros((2, len(levels)), np.int64)
            for level in np.unique(levels):
                of, k = np.flatnonzero(levels == level), gram(int(level))
                reach = int(level) - k
                mine, theirs = (np.frombuffer(b"".join(b.column(c).take(pa.array(of)).to_pylist()), np.uint64).reshape(len(of), -1) for c in ("around", "theirs"))
                same = mine == theirs
                left = np.cumprod(same[:, :reach][:, ::-1], axis=1).sum(axis=1)
                right = np.cumprod(same[:, reach + k:], axis=1).sum(axis=1)
                whole = same[:, reach: reach + k].all(axis=1) & (left + k + right >= level)
                at = b.column("at").to_numpy()[of]
                begin[of], end[of] = np.where(whole, at - left, 0), np.where(whole, at + k + right, 0)
            hit = pa.array(end > begin)
            yield pa.RecordBatch.from_arrays(
                [b.column("row").filter(hit), b.column("item_id").filter(hit), pa.array(begin).filter(hit), pa.array(end).filter(hit)], ["row", "item_id", "begin", "end"])

    kind = pairs.schema["item_id"].dataType.simpleString()
    return pairs.select("row", "item_id", "level", "at", "around", "theirs").mapInArrow(run, f"row long, item_id {kind}, begin long, end long")


def match(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, n_words) for each row of ``docs``, and (row, item_id, begin, end): its runs of words that hold windows of items.

    ``begin`` and ``end`` number the words of a document from 0. Documents are read once and never shuffled: what leaves
    them are fingerprints that also pass a filter of those of the items. A null text has no words. Rows that
    repeat are found each, whatever their ids; items that repeat an id are one item with all their windows. Tables may be empty.
    """
    prepare(docs.sparkSession)
    theirs = _fingerprint(benchmark.select("item_id", "text"), None, BEYOND_ITEM).select(F.col("id").alias("item_id"), F.explode("prints").alias("p"))
    theirs = theirs.select("item_id", "p.level", "p.hash", F.col("p.around").alias("theirs")).distinct().checkpoint()
    sizes = {r["level"]: r["count"] for r in theirs.groupBy("level").count().collect()}
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(theirs, sum(sizes.values())))
    read = _fingerprint(docs.select("doc_id", "text"), sorted(sizes) or [SPAN], BEYOND_DOC, bitmap)
    read = read.withColumn("row", F.monotonically_increasing_id()).checkpoint()
    found = read.where(F.size("prints") > 0).select("row", F.explode("prints").alias("p")).select("row", "p.*")
    pairs = join_measured(found, theirs, ["level", "hash"], rows=BROADCAST_PRINTS)
    return read.select("row", F.col("id").alias("doc_id"), "n_words"), extend(pairs).distinct().checkpoint()


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit (words inside windows of items), n_items and items (their ids as sorted strings).

    Ids that are null count as one item, whose string is empty. No window found: no words hit, and an empty list.
    """
    rows, spans = match(docs, benchmark)
    # words in the union of a row's runs: each adds what reaches beyond all before it
    before = Window.partitionBy("row").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    runs = spans.select("row", "begin", "end").distinct().withColumn("_until", F.coalesce(F.max("end").over(before), F.lit(0)))
    hits = runs.groupBy("row").agg(F.sum(F.greatest(F.col("end") - F.greatest("begin", "_until"), F.lit(0))).alias("n_hit"))
    named = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    items = spans.select("row", named.alias("item")).distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    met = hits.join(items, "row").checkpoint()
    none: Column = F.array().cast("array<string>")
    found = join_measured(rows, met, "row", "left")
    return found.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                        F.coalesce(F.size(F.coalesce("items", none)), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"))


def _words_sql(column: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words_sql('text')} AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_words_sql('text')} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda p: array_to_string(w[p:p + least(10, len(w)) - 1], ' '))) AS s FROM i WHERE len(w) > 0),
dw AS (
  SELECT r, n, unnest(range(1, len(w) - n + 2)) AS p, unnest(list_transform(range(1, len(w) - n + 2), lambda p: array_to_string(w[p:p + n - 1], ' '))) AS s
  FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n),
hit AS (SELECT r, dw.n, p, item FROM dw JOIN iw ON dw.n = iw.n AND dw.s = iw.s),
n_hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hit) GROUP BY r),
n_items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (r) LEFT JOIN n_items USING (r)
"""
