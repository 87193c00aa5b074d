"""Toxicity by weak supervision.

Voters for toxic are lexicon entries (fixed ones, and word stems mined from training labels) and
patterns; voters for clean are patterns of texts without such words. A generative label model with a hidden
class estimates each voter's rates by expectation maximisation from the votes alone, and from their correlations inside
the classes how much of its evidence repeats that of others. A linear classifier is trained on its posterior labels.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compact, join_measured
from .learning import held_out, labelled_sample, sigmoid

# Words and phrases that vote for toxic wherever they stand.
LEXICON = (
    "asshole", "bastard", "bitch", "clown", "cretin", "crap", "damn you", "degenerate", "disgusting", "dumbass",
    "filthy", "freak", "garbage", "go to hell", "hate you", "idiot", "imbecile", "jerk", "kill yourself", "loser",
    "lowlife", "moron", "pathetic", "pig", "retard", "scum", "shut up", "shit", "slut", "stupid", "trash", "vermin",
    "whore", "worthless", "you are a", "you people",
)
#: At most so many training documents of the classes 1 and 0 are read.
LIMITS = {1: 4000, 0: 12_000}
#: Stems are word beginnings of these lengths; whole words count as well.
STEMS = (4, 5, 6, 7, 8)
#: A mined entry stands in so many different toxic documents and in such a share of them, which together with the bar on evidence bounds their number.
LEAST, SHARE = 4, 0.01
#: An entry or pattern that stands in clean training documents is so much likelier in toxic ones.
LIFT = 8.0
WORD = re.compile(r"[^\W\d_]+")
#: The patterns: exclamation marks in a row, mostly capitals, and entries that stand twice, four times and densely (per 100 characters);
#: for clean: no entry and no exclamation marks in a row, and at most one entry in LONG characters or more.
PATTERNS = ("!!", "CAPITALS", "twice", "four times", "densely", "none", "sparse")
CLEAN = 2
DENSE, LONG = 0.25, 1000


def features(text: str) -> set[str]:
    """Whole words (marked by a final space) and stems of a text."""
    found = set()
    for w in set(WORD.findall(text.lower())):
        found.add(w + " ")
        found.update(w[:n] for n in STEMS if len(w) > n)
    return found


def sketch(text: str) -> int:
    """Least hash of the text's five-word shingles; near copies mostly share it."""
    words = text.lower().split()
    shingles = [" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))]
    return min(xxhash.xxh64_intdigest(s) >> 1 for s in shingles)


def matcher(entries: list[str]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for i, e in enumerate(entries):
        automaton.add_word(e.rstrip(" "), [*automaton.get(e.rstrip(" "), ()), i])
    if entries:
        automaton.make_automaton()
    return automaton


def votes(text: str, automaton: ahocorasick.Automaton, entries: list[str]) -> Counter:
    """How often each entry stands at a word's start (a whole word: also up to its end), then the patterns."""
    low, found = text.lower(), Counter()
    if entries:
        for end, at in automaton.iter(low):
            for i in at:
                start = end - len(entries[i].rstrip(" ")) + 1
                if start and low[start - 1].isalpha():
                    continue
                if entries[i][-1] == " " and end + 1 < len(low) and low[end + 1].isalpha():
                    continue
                found[i] += 1
    total = found.total()
    silent = not total and "!!" not in text
    for k, holds in enumerate((total > 1, total > 3, total * 100 > DENSE * len(text), silent, total < 2 and len(text) >= LONG)):
        if holds:
            found[len(entries) + 2 + k] = 1
    if "!!" in text:
        found[len(entries)] = text.count("!!")
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    capitals, smalls = np.count_nonzero((raw >= 65) & (raw <= 90)), np.count_nonzero((raw >= 97) & (raw <= 122))
    if capitals > smalls:
        found[len(entries) + 1] = 1
    return found


@dataclass
class LabelModel:
    """P(vote | class) of each voter, the class prior, and each voter's share of evidence."""

    toxic: np.ndarray
    clean: np.ndarray
    prior: float
    share: np.ndarray

    def evidence(self) -> tuple[np.ndarray, float]:
        """Weight of each vote, and the log-odds of no vote at all."""
        yes, no = np.log(self.toxic / self.clean), np.log((1 - self.toxic) / (1 - self.clean))
        return self.share * (yes - no), float(np.log(self.prior / (1 - self.prior)) + (self.share * no).sum())

    @classmethod
    def fit(cls, v: np.ndarray, clean: int = CLEAN, rounds: int = 40, weights: np.ndarray | None = None) -> LabelModel:
        """``v``: documents by voters, 0/1, of which the last ``clean`` voters are for clean; a document counts by its weight. Labels play no part.

        Starts from the majority of each document's votes. After each tenth round the correlations of the votes inside the classes
        are estimated; a voter among m that always vote together keeps 1/m of its evidence.
        """
        w = np.ones(len(v)) if weights is None else weights
        n, m = w.sum(), v.shape[1]
        side = np.r_[np.ones(m - clean), np.full(clean, -1.0)]
        post, self = sigmoid(2 * (v @ side)), cls(np.full(m, 0.5), np.full(m, 0.5), 0.5, np.ones(m))
        for r in range(rounds):
            one, none = w * post, w * (1 - post)
            self.prior = float(np.clip((one.sum() + 1) / (n + 2), 0.01, 0.99))
            self.toxic = (one @ v + 0.02) / (one.sum() + 1)
            self.clean = (none @ v + 0.02) / (none.sum() + 1)
            # a voter never speaks against the side that it votes for
            wrong = side * (self.toxic - self.clean) < 0
            mean = (w @ v + 0.02) / (n + 1)
            self.toxic, self.clean = np.where(wrong, mean, self.toxic).clip(1e-6, 1 - 1e-6), np.where(wrong, mean, self.clean).clip(1e-6, 1 - 1e-6)
            if r % 10 == 9:
                rest = v - (post[:, None] * self.toxic + (1 - post[:, None]) * self.clean)
                cov = rest.T @ (w[:, None] * rest) / n
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                rho = np.clip(cov / sd[:, None] / sd, 0, 1)
                self.share = 1 / np.where(rho > 0.3, rho, 0).sum(1).clip(1)
            post = self.posterior(v)
        return self

    def posterior(self, v: np.ndarray) -> np.ndarray:
        weight, base = self.evidence()
        return sigmoid(base + v @ weight)


@dataclass
class Scorer:
    """Entries, which voters are trusted, the classifier's weights, and the label model's evidence of each vote and of none."""

    entries: list[str]
    live: np.ndarray
    weight: np.ndarray
    evidence: np.ndarray
    base: float

    def design(self, v: np.ndarray) -> np.ndarray:
        """Votes, their summed evidence, and a constant."""
        return np.c_[v, np.minimum(v @ self.evidence, 12), np.ones(len(v))]

    def score(self, texts: list[str]) -> np.ndarray:
        automaton, v = matcher(self.entries), np.zeros((len(texts), len(self.entries) + len(PATTERNS)))
        for i, t in enumerate(texts):
            for j in votes(t, automaton, self.entries):
                v[i, j] = 1
        return sigmoid(self.design(v * self.live) @ self.weight)


def mine(sample: DataFrame) -> list[str]:
    """Stems and words that mark toxic documents of the sample (y, weight, text), strongest first; a document counts by its weight."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = (Counter(), Counter())
        for b in batches:
            for y, weight, text in zip(*(c.to_pylist() for c in b.columns)):
                tally = tallies[y]
                for x in features(text):
                    tally[x] += weight
        for y in (1, 0):
            names = list(tallies[y])
            told, none = pa.array([tallies[y][x] for x in names], pa.float64()), pa.array(np.zeros(len(names)))
            yield pa.RecordBatch.from_pydict({"entry": pa.array(names, pa.string()), "clean": none if y else told, "toxic": told if y else none})

    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.round(F.sum("weight"), 6).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return []
    # rounded, so that the order of summation does not matter
    tallies = sample.select("y", "weight", "text").mapInArrow(count, "entry string, clean double, toxic double").groupBy("entry").agg(
        F.round(F.sum("clean"), 6).alias("clean"), F.round(F.sum("toxic"), 6).alias("toxic"))
    share = F.lit(n1 / (n1 + n0))
    total = F.col("clean") + F.col("toxic")
    part = lambda k, p: F.when(k > 0, k * F.log(k / (total * p))).otherwise(0.0)
    g = 2 * (part(F.col("toxic"), share) + part(F.col("clean"), 1 - share))
    lift = (F.col("toxic") / n1) / ((F.col("clean") + 0.5) / n0)
    tallies = tallies.where(F.col("toxic") >= max(LEAST, SHARE * n1)).checkpoint()
    # evidence beyond what chance gives the best of so many entries
    bar = 2 * np.log(max(tallies.count(), 2))
    best = tallies.where((lift >= LIFT) & (g >= bar)).orderBy(F.desc(g), "entry")
    kept: list[str] = []
    for r in best.select("entry").collect():
        stem = r["entry"].rstrip()
        # of a stem and its extensions the one with the strongest statistic votes
        if not any(stem.startswith(k.rstrip()) or k.startswith(stem) for k in kept):
            kept.append(r["entry"])
    return kept


def trusted(v: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Which voters for toxic to keep: those that labelled documents (of weights ``w``) do not belie by making them stand in clean ones nearly as often."""
    n1, n0 = w[y == 1].sum(), w[y == 0].sum()
    if not n1 or not n0:
        return np.ones(v.shape[1], bool)
    toxic, clean = w[y == 1] @ v[y == 1], w[y == 0] @ v[y == 0]
    return (clean == 0) | (toxic / n1 >= LIFT * clean / n0)


def _votes(sample: DataFrame, entries: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, weights and votes of the sample's documents: workers read the texts, and only the numbers of voters come back."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = matcher(entries)
        for b in batches:
            cast = [sorted(votes(t, automaton, entries)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({"y": b.column(0), "weight": b.column(1), "v": pa.array(cast, pa.list_(pa.int32()))})

    told = sample.select("y", "weight", "text").mapInArrow(vote, "y int, weight double, v array<int>").toArrow()
    v = np.zeros((told.num_rows, len(entries) + len(PATTERNS)), np.float32)
    for i, cast in enumerate(told.column("v").to_pylist()):
        v[i, cast] = 1
    return told.column("y").to_numpy(), told.column("weight").to_numpy(), v


def fit(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Mine voters, fit the label model and train the classifier, on at most LIMITS labelled documents.

    All of them are learnt from; those of one label whose texts share their least shingle hash weigh one document together, as the words that near
    copies have in common would otherwise pass for signs.
    Without labels the fixed lexicon votes with default rates.
    """
    sample = labelled_sample(docs, labels, "toxic", LIMITS)

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "y": b.column(1), "text": b.column(2), "sketch": pa.array([sketch(t) for t in b.column(2).to_pylist()], pa.int64())})

    # few partitions, so that the partial aggregation leaves few rows of a large group of copies
    sample = compact(sample.select("doc_id", "y", "text"), sum(LIMITS.values()), 2048)
    sketched = sample.mapInArrow(sketches, sample.select("doc_id", "y", "text", F.lit(0).cast("long").alias("sketch")).schema)
    sketched = sketched.checkpoint()
    groups = sketched.groupBy("sketch", "y").agg((1 / F.count("*")).alias("weight"))
    sample = join_measured(sketched, groups.checkpoint(), ["sketch", "y"]).select("y", "weight", "text").checkpoint()
    entries = list(LEXICON)
    entries += [e for e in mine(sample) if not any(e.startswith(x) or x.startswith(e.rstrip()) for x in LEXICON)]

    y, w, v = _votes(sample, entries)
    good = trusted(v[:, : len(entries)], y, w)
    if not good.all():
        # the patterns count entries, so all votes are cast anew
        entries = [e for e, keep in zip(entries, good) if keep]
        y, w, v = _votes(sample, entries)
    live = np.r_[trusted(v[:, :-CLEAN], y, w), np.ones(CLEAN, bool)]
    order = np.lexsort([w, *v.T])
    v, w = v[order] * live, w[order]
    if not len(y) or y.min() == y.max():
        # without labels of both kinds: a toxic document for each entry, and as many clean ones
        made = np.zeros((2 * len(entries), v.shape[1]))
        made[: len(entries), : len(entries)] = np.eye(len(entries))
        made[len(entries):, -CLEAN:] = 1
        v, w = np.r_[v, made], np.r_[w, np.ones(len(made))]
    model = LabelModel.fit(v, weights=w)
    weight, base = model.evidence()
    scorer = Scorer(entries, live, np.zeros(v.shape[1] + 2), weight, base)
    scorer.weight = _logistic(scorer.design(v), model.posterior(v), w)
    return scorer


def _logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 0.3, rounds: int = 25) -> np.ndarray:
    """Newton's method on soft labels of weighted rows; the constant is not shrunk."""
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (weights * (p * (1 - p) + 1e-6))[:, None]).T @ x + np.diag(shrink), x.T @ (weights * (y - p)) - shrink * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-4:
            break
    return w


def score(docs: DataFrame, scorer: Scorer, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Whole texts are read. A null or empty text has no votes, and the score of that. A null doc_id counts as held
    out. Repeated rows repeat; an empty table gives no rows; other columns are not inputs. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "score": pa.array(scorer.score([t or "" for t in b.column(1).to_pylist()]))})

    schema = docs.select("doc_id", F.lit(0.0).alias("score")).schema
    return docs.select("doc_id", "text").mapInArrow(run, schema).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, scorer: Scorer, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, that are not predicted toxic.

    A null or empty text has no entries, and stays; equal texts are judged alike, so repeated rows stay or go
    together; an empty table gives no rows. Texts are not shuffled.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = scorer.score([t or "" for t in b.column(at).to_pylist()])
            yield b.filter(pa.array(scores < threshold))

    return docs.mapInArrow(run, docs.schema)
