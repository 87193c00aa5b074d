"""Byte-pair encoding and decoding with word ends, merging many words at once in numpy.

Texts are normalised and cut as the vocabulary file says. Distinct pieces are encoded
together: the symbols of all pieces lie in one flat array; each round finds the rank of every
neighbouring pair by binary search over sorted pair keys, merges every piece's lowest
pair, and drops the pieces that are done.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks between white space that a worker remembers, and the longest that it remembers.
REMEMBERED, LONGEST = 400_000, 48
#: Rank of a pair that no merge joins.
NONE = np.iinfo(np.int64).max
#: Beyond these characters there are some that only newer Unicode versions assign.
LATER = regex.compile(r"[^\x00-\u0557]")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class Vocabulary:
    """Tables of one vocabulary file, and the encoder over them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in (ids | self.special).items()}
        self.base = max(names) + 1
        self.tokens = [names.get(i, "") for i in range(self.base)]
        self.digits = [str(i) for i in range(self.base)]
        characters = byte_characters()
        self.inner = np.array([ids[c] for c in characters], np.int64)
        self.last = np.array([ids[c + end] for c in characters], np.int64)
        pairs = [(ids[a] * self.base + ids[b], rank, ids[a + b]) for rank, (a, b) in enumerate(model["merges"])]
        self.keys, self.ranks, self.merged = (np.array(x, np.int64) for x in zip(*sorted(pairs)))
        self.padded = np.append(self.keys, -1)
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # the library's white space is Unicode's; separators 1C to 1F are not part of it
        self.split = split
        self.piece = regex.compile(split.replace(r"^\s", r"^\p{White_Space}"))
        self.path = path
        self.stop = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.known: dict[str, tuple[str, int, str]] = {}

    def merge(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece (none of them empty)."""
        raw = [p.encode() for p in pieces]
        sizes = np.array([len(r) for r in raw])
        stream = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(sizes)
        symbols = self.inner[stream]
        symbols[ends - 1] = self.last[stream[ends - 1]]
        owner = np.repeat(np.arange(len(raw)), sizes)
        done_symbols, done_owner = [], []
        while len(symbols):
            key = symbols[:-1] * self.base + symbols[1:]
            at = np.searchsorted(self.keys, key)
            found = np.flatnonzero((self.padded[at] == key) & (owner[:-1] == owner[1:]))
            rank, at = np.full(len(symbols), NONE), at[found]
            rank[found] = self.ranks[at]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            spread = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(owner)]))
            over = spread == NONE
            done_symbols.append(symbols[over])
            done_owner.append(owner[over])
            hit = (rank == spread) & ~over
            after = np.r_[False, hit[:-1]]
            if (hit & after).any():
                # in a run such as "aaa" every second hit overlaps the one before it
                order = np.arange(len(hit))
                hit &= (order - np.maximum.accumulate(np.where(hit & ~after, order, 0))) % 2 == 0
                after = np.r_[False, hit[:-1]]
            chosen = hit[found]
            symbols[found[chosen]] = self.merged[at[chosen]]
            keep = ~(over | after)
            symbols, owner = symbols[keep], owner[keep]
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        flat, cuts = symbols[order].tolist(), np.flatnonzero(np.diff(owner[order])) + 1
        cuts = [0, *cuts.tolist(), len(flat)]
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    def decode(self, ids) -> str:
        """The tokens joined by spaces, as the file names no decoder; special tokens stay."""
        return " ".join([self.tokens[i] for i in ids])

    def newer(self, text: str) -> bool:
        """Does the text hold characters that Python's Unicode tables do not know?"""
        return not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(LATER.findall(text)))

    @cached_property
    def library(self) -> tuple:
        """Normaliser and splitter for such texts, whose Unicode version is that of the library."""
        return (tokenizers.Tokenizer.from_file(self.path).normalizer,
                tokenizers.pre_tokenizers.Split(tokenizers.Regex(self.split), "removed", invert=True))

    def pieces(self, chunk: str) -> list[str]:
        if self.newer(chunk):
            return [p for p, _ in self.library[1].pre_tokenize_str(chunk)]
        return self.piece.findall(chunk)

    def normalise(self, text: str) -> str:
        if self.newer(text):
            return self.library[0].normalize_str(text)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # each character by itself: a sigma at a word's end is no exception
        return text.replace("Σ", "σ").lower()

    def chunks(self, text: str) -> list[str]:
        """Normalised text between white space; pieces never reach across it."""
        text = self.normalise(text)
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return regex.findall(r"\P{White_Space}+", text)
        return text.split()

    def learn(self, chunks: set[str]) -> dict[str, tuple[str, int, str]]:
        """(ids as text, number of ids, decoded) of each chunk."""
        cut = {c: self.pieces(c) for c in chunks}
        pieces = list({p for ps in cut.values() for p in ps})
        ids = dict(zip(pieces, self.merge(pieces))) if pieces else {}
        out, digits, tokens = {}, self.digits, self.tokens
        for c, ps in cut.items():
            own = ids[ps[0]] if len(ps) == 1 else [i for p in ps for i in ids[p]]
            out[c] = (" ".join([digits[i] for i in own]), len(own), " ".join([tokens[i] for i in own]))
        return out

    def encode(self, texts: list[str]) -> tuple[list[str], list[int], list[str]]:
        """Ids as text, their number and the decoded text of each text."""
        parts = []
        for text in texts:
            at, own = 0, []
            for m in self.stop.finditer(text) if "<|" in text else ():
                own += [self.chunks(text[at: m.start()]), m[0]]
                at = m.end()
            parts.append([*own, self.chunks(text[at:] if at else text)])
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = {c for own in parts for p in own if isinstance(p, list) for c in p if c not in known}
        learnt = self.learn(new)
        brief = {c: x for c, x in learnt.items() if len(c) <= LONGEST}
        known.update(brief)
        long = {c: x for c, x in learnt.items() if len(c) > LONGEST}
        ids, numbers, decoded = [], [], []
        for own in parts:
            told = []
            for p in own:
                if isinstance(p, str):
                    told.append((str(self.special[p]), 1, p))
                else:
                    told += [known.get(c) or long[c] for c in p]
            told = [x for x in told if x[1]]
            ids.append(" ".join([x[0] for x in told]))
            numbers.append(sum([x[1] for x in told]))
            decoded.append(" ".join([x[2] for x in told]))
        return ids, numbers, decoded


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, n_tokens, ids (decimal, joined by spaces), decoded.

    ``path`` is the vocabulary file, which every worker has. Whole texts are encoded; null and empty texts and
    those of white space give no ids and empty strings. Repeated rows repeat; other columns are ignored.
    Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids, numbers, decoded = words.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(numbers, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        run, docs.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids"), F.lit("").alias("decoded")).schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded) of (doc_id, ids) rows, ids as ``encode`` gives them; null and empty ids decode to an empty text.

    Repeated rows repeat, an empty table gives no rows, other columns (one named ``decoded`` too) are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for b in batches:
            texts = [words.decode(map(int, (x or "").split())) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, encoded.select("doc_id", F.lit("").alias("decoded")).schema)
