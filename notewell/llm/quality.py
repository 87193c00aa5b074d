"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages that together cover its whole text. Each passage is encoded; a gated
attention network, learnt from document labels alone, weighs the passages; the
weighted mean of their encodings gives the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import held_out, labelled_sample, sigmoid

#: At most so many training documents of the classes 1 and 0 are read, and so many bytes of text in all; each is learnt from as a whole.
LIMITS, BYTES = {1: 5000, 0: 2500}, {1: 32 << 20, 0: 16 << 20}
#: Bytes of a passage, and of what is encoded at once.
PASSAGE, AT_ONCE = 512, 1 << 20
#: Sizes of the encoding and of the attention's hidden layer.
CODE, HIDDEN = 24, 12
#: The character classes of single bytes, in this order; then all other ASCII, UTF-8 leads and UTF-8 continuations.
CLASSES = (" ", "\t\n\r\x0b\x0c", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", "!", "?", "|", "'\"`", "()[]{}<>", "#$%&*@^~+=/\\_")
N = len(CLASSES) + 3
WIDTH = N + N * N + 5


def _class_table() -> np.ndarray:
    table = np.full(256, len(CLASSES), np.uint8)
    for k, characters in enumerate(CLASSES):
        for c in characters:
            table[ord(c)] = k
    table[128:192], table[192:] = len(CLASSES) + 2, len(CLASSES) + 1
    return table


TABLE = _class_table()
#: Fixed random numbers, one for each byte, to hash words by.
HASHES = np.random.default_rng(11).integers(1, 1 << 62, 256, dtype=np.uint64)
NO_CODES = np.zeros(0, np.uint64)
WHITE = re.compile(b"[ \t\n\r\x0b\x0c]")


def passages(raw: list[bytes], inside_word: bool = False, ahead: int = 0, before: np.ndarray = NO_CODES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the passages of all texts, the text that each belongs to, and codes of the last three words; an empty text has one empty passage.

    Frequencies of character classes and of pairs of them, mean word length, and the shares of words that
    repeat the word one to three places back. A part of a longer text says whether it begins inside a word, how many bytes at its
    end only complete its last word, and what codes the three words before it had.
    """
    sizes = np.array([len(r) for r in raw], np.int64)
    sizes[-1] -= ahead
    count = np.maximum(1, -(-sizes // PASSAGE))
    owner, first = np.repeat(np.arange(len(raw)), count), np.r_[0, np.cumsum(count)[:-1]]
    data = np.frombuffer(b"".join(raw), np.uint8)
    begins = np.r_[0, np.cumsum(sizes)[:-1]]
    total, body = int(count.sum()), len(data) - ahead
    x = np.zeros((total, WIDTH), np.float32)
    if not body:
        return x, owner, before
    doc = np.repeat(np.arange(len(raw)), sizes)
    where = first[doc] + (np.arange(body) - begins[doc]) // PASSAGE
    kind = TABLE[data].astype(np.int64)
    per = np.bincount(where, minlength=total).clip(1)
    single = np.bincount(where * N + kind[:body], minlength=total * N).reshape(total, N)
    same = where[1:] == where[:-1]
    pair = np.bincount((where[:-1] * N * N + kind[: body - 1] * N + kind[1:body])[same], minlength=total * N * N).reshape(total, N * N)
    x[:, :N], x[:, N: N + N * N] = np.sqrt(single / per[:, None]), np.sqrt(pair / per[:, None])
    # words: runs outside the two classes of white space
    black = kind > 1
    edge = black[:body] & ~np.r_[inside_word, black[: body - 1] & (doc[1:] == doc[:-1])]
    starts = np.flatnonzero(edge)
    words = np.bincount(where[starts], minlength=total)
    x[:, -1] = np.minimum(words, 100) / 100
    words = words.clip(1)
    x[:, -5] = np.bincount(where[black[:body]], minlength=total) / words / 16
    if len(starts):
        nth = np.cumsum(np.r_[edge, np.zeros(ahead, bool)]) - 1
        inside = (np.arange(len(data)) - starts[np.maximum(nth, 0)] + 1).astype(np.uint64)
        own = np.add.reduceat(np.where(black, HASHES[data] * inside, np.uint64(0)), starts)
        code, word_doc, k = np.r_[before, own], np.r_[np.zeros(len(before), np.int64), doc[starts]], len(before)
        word_at = np.r_[np.zeros(k, np.int64), where[starts]]
        for lag in (1, 2, 3):
            again = (code[lag:] == code[:-lag]) & (word_doc[lag:] == word_doc[:-lag]) & (np.arange(lag, len(code)) >= k)
            x[:, -5 + lag] = np.bincount(word_at[lag:][again], minlength=total) / words
        before = code[-3:]
    return x, owner, before


def parts(whole: bytes) -> Iterator[np.ndarray]:
    """Features of a long text's passages, part by part; they are those of the whole text."""
    step, before = max(1, AT_ONCE // PASSAGE) * PASSAGE, NO_CODES
    for at in range(0, len(whole), step):
        end = min(at + step, len(whole))
        # the last word is read to its end
        white = WHITE.search(whole, end) if TABLE[whole[end - 1]] > 1 else None
        stop = end if TABLE[whole[end - 1]] <= 1 else white.start() if white else len(whole)
        x, _, before = passages([whole[at:stop]], at > 0 and TABLE[whole[at - 1]] > 1, stop - end, before)
        yield x


def portions(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of all passages of the texts and the text that each belongs to, some AT_ONCE bytes at a time, in order."""
    raw, of, size = [], [], 0
    for i, text in enumerate(texts):
        whole = text.encode("utf-8", "surrogatepass")
        if raw and size + len(whole) > AT_ONCE:
            x, owner, _ = passages(raw)
            yield x, np.array(of)[owner]
            raw, of, size = [], [], 0
        if len(whole) > AT_ONCE:
            for x in parts(whole):
                yield x, np.full(len(x), i)
        else:
            raw.append(whole)
            of.append(i)
            size += len(whole)
    if raw:
        x, owner, _ = passages(raw)
        yield x, np.array(of)[owner]


@dataclass
class Attention:
    """Weights of the encoder, the gated attention and the classifier, and the features' scale."""

    p: dict[str, np.ndarray]
    mean: np.ndarray
    sd: np.ndarray

    def encode(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Encodings of passages, and the logit ``e`` of each one's attention."""
        p = self.p
        z = np.clip((x - self.mean) / self.sd, -4, 4)
        h = np.tanh(z @ p["w0"] + p["b0"])
        gate, tone = sigmoid(h @ p["u"]), np.tanh(h @ p["v"])
        return {"z": z, "h": h, "gate": gate, "tone": tone, "e": (gate * tone) @ p["w"]}

    def forward(self, x: np.ndarray, owner: np.ndarray, bags: int) -> dict[str, np.ndarray]:
        f = self.encode(x)
        most = np.full(bags, -np.inf)
        np.maximum.at(most, owner, f["e"])
        a = np.exp(f["e"] - most[owner])
        a /= np.bincount(owner, a, minlength=bags)[owner]
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        mixed = np.add.reduceat(a[:, None] * f["h"], starts)
        return f | {"a": a, "starts": starts, "mixed": mixed, "score": sigmoid(mixed @ self.p["c"] + self.p["b"])}

    def gradient(self, f: dict[str, np.ndarray], owner: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
        """``off``: score minus label of each bag, over the number of bags."""
        p, h, a = self.p, f["h"], f["a"]
        up = (off[:, None] * p["c"])[owner]
        pull = (h * up).sum(1)
        de = a * (pull - np.add.reduceat(a * pull, f["starts"])[owner])
        dtone = de[:, None] * f["gate"] * p["w"] * (1 - f["tone"] ** 2)
        dgate = de[:, None] * f["tone"] * p["w"] * f["gate"] * (1 - f["gate"])
        dh = (a[:, None] * up + dtone @ p["v"].T + dgate @ p["u"].T) * (1 - h**2)
        return {"w0": f["z"].T @ dh, "b0": dh.sum(0), "v": h.T @ dtone, "u": h.T @ dgate, "w": (f["gate"] * f["tone"]).T @ de,
                "c": f["mixed"].T @ off, "b": np.array([off.sum()])}

    @classmethod
    def train(cls, bags: list[np.ndarray], y: np.ndarray, epochs: int = 24, batch: int = 128, rate: float = 0.01, shrink: float = 1e-3, seed: int = 5) -> Attention:
        """Adam on the cross entropy, with weight decay and a falling rate."""
        rng = np.random.default_rng(seed)
        n = sum(map(len, bags))
        mean = sum(b.sum(0, dtype=np.float64) for b in bags) / n
        sd = np.sqrt(sum(((b - mean) ** 2).sum(0) for b in bags) / n)
        normal = lambda *s: rng.normal(size=s) / np.sqrt(s[0])
        p = {"w0": normal(WIDTH, CODE), "b0": np.zeros(CODE), "v": normal(CODE, HIDDEN), "u": normal(CODE, HIDDEN), "w": normal(HIDDEN),
             "c": normal(CODE), "b": np.array([np.log((y.sum() + 1) / (len(y) - y.sum() + 1))])}
        p = {k: v.astype(np.float32) for k, v in p.items()}
        self = cls(p, mean.astype(np.float32), (sd + 0.02).astype(np.float32))
        m, s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        step, steps = 0, epochs * -(-len(bags) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), batch):
                own = order[at: at + batch]
                x, owner = np.concatenate([bags[i] for i in own]).astype(np.float32), np.repeat(np.arange(len(own)), [len(bags[i]) for i in own])
                f = self.forward(x, owner, len(own))
                g = self.gradient(f, owner, (f["score"] - y[own]) / len(own))
                step += 1
                for k in p:
                    d = g[k] + (shrink * p[k] if k not in ("b", "b0") else 0)
                    m[k] += 0.1 * (d - m[k])
                    s[k] += 0.01 * (d * d - s[k])
                    p[k] -= (rate * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def score(self, texts: list[str]) -> np.ndarray:
        """Scores of whole texts. The attention's maximum and sums run over portions of passages, so that long texts need no more memory."""
        n = len(texts)
        most, total, mixed = np.full(n, -np.inf), np.zeros(n), np.zeros((n, len(self.p["c"])))
        for x, owner in portions(texts):
            f = self.encode(x)
            above = most.copy()
            np.maximum.at(above, owner, f["e"])
            known = total > 0
            shrink = np.where(known, np.exp(np.where(known, most, 0) - np.where(known, above, 0)), 0)
            a = np.exp(f["e"] - above[owner])
            total = total * shrink + np.bincount(owner, a, minlength=n)
            mixed *= shrink[:, None]
            np.add.at(mixed, owner, a[:, None] * f["h"])
            most = above
        return sigmoid(mixed / total[:, None] @ self.p["c"] + self.p["b"]).astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame) -> Attention:
    """Train on labelled documents, at most LIMITS of them and BYTES of text, with all their passages, which workers encode. Without labels every score is one half."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = []
            for text in b.column(2).to_pylist():
                bags.append(np.concatenate([x for x, _ in portions([text])]).astype(np.float16).tobytes())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "y": b.column(1), "x": pa.array(bags, pa.binary())})

    sample = labelled_sample(docs, labels, "quality", LIMITS, BYTES).select("doc_id", "y", "text")
    told = sample.mapInArrow(encode, sample.select("doc_id", "y", F.lit(b"").alias("x")).schema).toArrow().sort_by("doc_id")
    y = told.column("y").to_numpy().astype(np.float32)
    bags = [np.frombuffer(x, np.float16).reshape(-1, WIDTH) for x in told.column("x").to_pylist()]
    if not bags:
        bags, y = [np.zeros((1, WIDTH), np.float16)] * 2, np.array([0.0, 1.0], np.float32)
    return Attention.train(bags, y)


def score(docs: DataFrame, model: Attention, threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Whole texts are read. A null or empty text is one empty passage. A null doc_id counts as held out. Repeated rows
    repeat; an empty table gives no rows; other columns are not inputs. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "score": pa.array(model.score([t or "" for t in b.column(1).to_pylist()]))})

    schema = docs.select("doc_id", F.lit(0.0).alias("score")).schema
    return docs.select("doc_id", "text").mapInArrow(run, schema).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Attention, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, that are predicted good.

    A null or empty text is judged as one empty passage; equal texts are judged alike, so repeated rows stay or go
    together; an empty table gives no rows. Texts are not shuffled.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.score([t or "" for t in b.column(at).to_pylist()]) >= threshold))

    return docs.mapInArrow(run, docs.schema)
