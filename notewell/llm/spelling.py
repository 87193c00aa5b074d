"""Spelling variants: words at one edit from each other, and the most frequent form of each.

Every word's edits are generated as hashes and probed against Bloom filters of the vocabulary, one for each word length;
only positives become strings and are joined with the vocabulary, which removes the false ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compact, join_measured, prepare

#: Code points of a word at least, and occurrences.
LEAST, COMMON = 6, 5
#: A form is so many times as frequent as what it replaces.
FACTOR = 5
#: One run in so many loses a character.
DAMAGED = 199
#: The characters of runs; of these only A-Z are lower-cased.
RUN = re.compile("[A-Za-z\\u00C0-\\u00FF]{%d,}" % LEAST)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LETTERS = np.array([*range(97, 123), *range(0xC0, 0x100)], np.uint8)
#: Bits of a filter for each word; blocks (of 64 bits) that one filter has at most; bytes of the filters that are broadcast at once;
#: words that a task counts before it passes them on; words that a task edits; and places of a long word that are edited at once.
BITS, BLOCKS, AT_ONCE, HELD, WORDS, PLACES = 32, 1 << 20, 64 << 20, 200_000, 16_384, 4096
#: Fixed odd numbers: the base of the words' polynomials and its inverse; and a number for each letter.
BASE = 0xD6E8FEB86659FD93
VALUES = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.uint64)


def count_runs(docs: DataFrame) -> DataFrame:
    """(word, n): runs of letters of whole texts, of LEAST or more code points, and how often they occur, partly summed by task.

    A run loses one character where the CRC-32 of ``<doc_id>:<run>`` says so. Null texts have no runs; a null id is written as nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                low = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass")
                for word, n in Counter(RUN.findall(low)).items():
                    h = crc32(f"{key}:{word}".encode())
                    if h % DAMAGED == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < LEAST:
                            continue
                    tally[word] += n
                if len(tally) > HELD:
                    yield told()
                    tally.clear()
        if tally:
            yield told()

    keyed = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    return keyed.mapInArrow(run, "word string, n long")


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that occur COMMON times or more in all documents, checkpointed."""
    return count_runs(docs).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON).checkpoint()


def codes(word: str) -> np.ndarray:
    """Code points of a word, all of which lie below 256."""
    return np.frombuffer(word.encode("latin-1"), np.uint8)


def powers(n: int) -> np.ndarray:
    p = np.full(n, BASE, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def hash_of(word: str) -> int:
    """The sum of the letters' numbers times powers of the base: an edit changes it by a few terms."""
    return int(mix((VALUES[codes(word)] * powers(len(word))).sum(dtype=np.uint64, keepdims=True))[0])


def masks(h: np.ndarray) -> np.ndarray:
    """Four bits of a block of 64."""
    one, mask = np.uint64(1), np.zeros(len(h), np.uint64)
    for k in range(4):
        mask |= one << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return mask


def blocks(h: np.ndarray, n: np.ndarray | np.uint64) -> np.ndarray:
    """Which of ``n`` blocks (a power of two) a hash belongs to."""
    return (h >> np.uint64(24)) & (n - np.uint64(1))


def filter_blocks(vocab: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """(length, block, bits) of the blocked Bloom filters, one for each word length, checkpointed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            h = np.array([hash_of(w) for w in words], np.uint64)
            lengths = np.array([len(w) for w in words], np.int32)
            block = blocks(h, np.array([filter_size(sizes[len(w)]) for w in words], np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(lengths), pa.array(block.view(np.int64)), pa.array(masks(h).view(np.int64))], ["length", "block", "bits"])

    placed = vocab.select("word").mapInArrow(run, "length int, block long, bits long")
    return placed.groupBy("length", "block").agg(F.bit_or("bits").alias("bits")).checkpoint()


def filter_size(words: int) -> int:
    """Blocks of the filter of so many words: a power of two, so that each word has BITS or more."""
    return 1 << max(0, (words * BITS // 64 - 1).bit_length())


def passes(sizes: dict[int, int], blocks_each: int, at_once: int) -> list[list[tuple[int, int]]]:
    """Parts (length, number) of filters, of ``blocks_each`` at most, grouped so that ``at_once`` bytes are broadcast at a time."""
    groups: list[list[tuple[int, int]]] = [[]]
    held = 0
    for length in sorted(sizes):
        total = filter_size(sizes[length])
        for part in range(-(-total // blocks_each)):
            size = 8 * min(total, blocks_each)
            if groups[-1] and held + size > at_once:
                groups.append([])
                held = 0
            groups[-1].append((length, part))
            held += size
    return groups


def edits(word: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, hashes, places, letters): what one deletion (letter 0) or a replacement by a later letter makes of a word.

    Of equal neighbours only the first is deleted. So each pair of words at one edit is generated once, from the longer one or from
    that with the earlier letter.
    """
    c = codes(word)
    n = len(c)
    p = powers(n)
    terms = VALUES[c] * p
    total = terms.sum(dtype=np.uint64)
    before = np.cumsum(terms, dtype=np.uint64) - terms
    # the terms behind a place, each moved one place down
    moved = VALUES[c[1:]] * p[:-1]
    behind = np.r_[np.cumsum(moved[::-1], dtype=np.uint64)[::-1], np.uint64(0)]
    first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    yield n - 1, mix(before[first] + behind[first]), first, np.zeros(len(first), np.uint8)
    for at in range(0, n, PLACES):
        place = np.arange(at, min(at + PLACES, n))
        later = LETTERS[None, :] > c[place, None]
        own = VALUES[c[place]]
        h = total + (VALUES[LETTERS][None, :] - own[:, None]) * p[place][:, None]
        row, column = np.nonzero(later)
        yield n, mix(h[row, column]), place[row], LETTERS[column]


def positives(vocab: DataFrame, filters: Broadcast, sizes: dict[int, int], blocks_each: int) -> DataFrame:
    """(word, n, other): the edits of words that the broadcast parts of filters, {(length, part): bits}, do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = filters.value
        for b in batches:
            words, counts, others = [], [], []
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for length, h, place, letter in edits(word):
                    if length not in sizes:
                        continue
                    size = filter_size(sizes[length])
                    block, mask = blocks(h, np.uint64(size)), masks(h)
                    part = block // np.uint64(blocks_each)
                    for k in range(-(-size // blocks_each)):
                        bits = held.get((length, k))
                        if bits is None:
                            continue
                        mine = np.flatnonzero(part == k)
                        m = mask[mine]
                        for i in mine[(bits[block[mine] % np.uint64(blocks_each)] & m) == m]:
                            at = place[i]
                            words.append(word)
                            counts.append(n)
                            others.append(word[:at] + (chr(letter[i]) if letter[i] else "") + word[at + 1:])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64()), pa.array(others, pa.string())], ["word", "n", "other"])

    return vocab.select("word", "n").mapInArrow(run, "word string, n long, other string")


def near_pairs(vocab: DataFrame, blocks_each: int = BLOCKS, at_once: int = AT_ONCE) -> DataFrame:
    """(word, n, other, m): each pair of words of the vocabulary at one edit, once, with both frequencies; checkpointed.

    The filters take 4 to 8 bytes a word; they are built by Spark and broadcast in bounded parts, one pass over the vocabulary for each.
    """
    spark = vocab.sparkSession
    sizes = {r["length"]: r["count"] for r in vocab.groupBy(F.length("word").alias("length")).count().collect()}
    table = filter_blocks(vocab, sizes)
    # edits are much work for few bytes, so words are dealt out by their number
    spread = vocab.repartition(max(spark.sparkContext.defaultParallelism, sum(sizes.values()) // WORDS), "word")
    name = F.concat_ws(":", "length", F.expr(f"block DIV {blocks_each}"))
    found = None
    for group in passes(sizes, blocks_each, at_once):
        held = {(length, part): np.zeros(min(filter_size(sizes[length]), blocks_each), np.uint64) for length, part in group}
        told = table.where(name.isin(*(f"{length}:{part}" for length, part in group))).toArrow()
        length, block, bits = (told.column(c).to_numpy() for c in ("length", "block", "bits"))
        for (at, part), filled in held.items():
            mine = (length == at) & (block // blocks_each == part)
            filled[block[mine] % blocks_each] = bits[mine].view(np.uint64)
        met = positives(spread, spark.sparkContext.broadcast(held), sizes, blocks_each)
        met = met.join(vocab.select(F.col("word").alias("other"), F.col("n").alias("m")), "other").select("word", "n", "other", "m").checkpoint()
        found = met if found is None else found.union(met)
    return found


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where following forms from word to word ends. Jumps double, so a chain costs its logarithm in rounds."""
    n = forms.count()
    jump = compact(forms.select("word", F.col("form").alias("root")), n).checkpoint()
    while True:
        onward = jump.select(F.col("word").alias("root"), F.col("root").alias("_far"))
        ahead = compact(join_measured(jump, onward, "root", "left").select("word", F.coalesce("_far", "root").alias("root"), F.col("_far").isNotNull().alias("_moved")), n).checkpoint()
        if ahead.where("_moved").isEmpty():
            return ahead.select("word", "root")
        jump = ahead.drop("_moved")


def variants(docs: DataFrame) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    The form is the most frequent near word (ties: the smallest in code-point order), if it is FACTOR times as frequent; the root is where forms lead to.
    Only ``doc_id`` and ``text`` are read. Null and empty texts add nothing; repeated rows count each; an empty table has no words.
    """
    prepare(docs.sparkSession)
    vocab = vocabulary(docs)
    pairs = near_pairs(vocab)
    both = pairs.union(pairs.select("other", "m", "word", "n")).toDF("word", "n", "other", "m")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    known = vocab.join(best, "word", "left")
    strong = -F.col("best.less") >= FACTOR * F.col("n")
    known = known.select("word", F.when(strong, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                         F.when(strong, -F.col("best.less")).alias("form_n")).checkpoint()
    roots = follow(known.where("form IS NOT NULL").select("word", "form"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: CRC-32 of an ASCII or UTF-8 string by its table of 256 remainders.
CRC_TABLE = "(SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) FROM range(256) AS t(b))"
SQL = rf"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT {CRC_TABLE} AS t),
runs AS (
  SELECT doc_id, word, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS word FROM documents)
  WHERE length(word) >= {LEAST} GROUP BY ALL),
bytes AS (
  SELECT doc_id, word, n, list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || word)), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM runs),
hashed AS (
  SELECT word, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM bytes, tab),
vocab AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % {DAMAGED} = 0 THEN substr(word, 1, (h % length(word))::BIGINT) || substr(word, (h % length(word))::BIGINT + 2) ELSE word END AS word, n FROM hashed)
  WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(n) >= {COMMON}),
cut AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
hole AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS pattern FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM hole a JOIN hole b USING (pattern) WHERE a.word <> b.word
  UNION ALL SELECT c.word, c.n, v.word, v.n FROM cut c JOIN vocab v ON v.word = c.less
  UNION ALL SELECT v.word, v.n, c.word, c.n FROM cut c JOIN vocab v ON v.word = c.less),
best AS (SELECT word, count(*) AS n_near, min({{'less': -m, 'other': other}}) AS b FROM near GROUP BY word),
known AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b.less >= {FACTOR} * n THEN b.other END AS form, CASE WHEN -b.less >= {FACTOR} * n THEN -b.less END AS form_n
  FROM vocab LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root, form AS onward FROM known
  UNION ALL SELECT c.word, c.onward, k.form FROM chain c JOIN known k ON k.word = c.onward)
SELECT k.word, k.form, c.root, k.n, k.n_near, k.form_n FROM known k JOIN chain c ON c.word = k.word AND c.onward IS NULL
"""
