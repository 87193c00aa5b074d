"""Nearest neighbours by inner product, with score-aware quantisation.

Unit vectors are cut into short subspaces with sixteen codewords each. Codewords are fitted,
and codes chosen, under an anisotropic loss: the part of the residual that is parallel to the
vector, which shifts large inner products most, weighs more than the rest. A search adds up
four-bit table entries (two codes to a byte) over all codes of a block. The best by that
estimate are scored exactly, and then every row whose estimate and error bound reach the k-th
best exact score so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import common_length, matrix, nearest_means, sound_vector, unit_rows

#: Vectors that codewords are fitted on, components of a subspace, codewords of a subspace.
SAMPLE, WIDTH, WORDS = 4096, 2, 16
#: The loss counts inner products above this share of a vector's length.
THRESHOLD = 0.2
#: Rows and queries that meet in one task; rows that are scored exactly at a time for each query.
ROWS, QUERIES, RERANK = 8192, 2048, 256
#: Added to the error bound for the rounding of estimates, which are summed in single precision.
MARGIN = 1e-5


@dataclass
class Quantiser:
    """books[m, c] is codeword c of subspace m; ``eta`` is the weight of parallel to other residual."""

    books: np.ndarray
    eta: float
    dim: int

    @classmethod
    def fit(cls, x: np.ndarray, rounds: int = 3) -> Quantiser:
        dim = x.shape[1]
        eta = max(1.0, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        parts = cls.cut(x)
        books = np.stack([nearest_means(parts[:, m], WORDS, seed=m) for m in range(parts.shape[1])])
        self = cls(books, eta, dim)
        for _ in range(rounds):
            self._refit(parts, self.assign(x))
        return self

    @staticmethod
    def cut(x: np.ndarray) -> np.ndarray:
        pad = -x.shape[1] % (2 * WIDTH)
        return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, WIDTH)

    def assign(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes of unit vectors: nearest codewords, then coordinate descent on the loss."""
        parts = self.cut(x)
        codes = np.stack([
            np.argmin(((parts[:, m, None] - b) ** 2).sum(-1), axis=1) for m, b in enumerate(self.books)], axis=1)
        picked = self.books[np.arange(len(self.books)), codes]
        along = ((parts - picked) * parts).sum(-1)
        total = along.sum(1)
        for _ in range(sweeps):
            for m, book in enumerate(self.books):
                rest = parts[:, m, None] - book
                parallel = np.einsum("ncw,nw->nc", rest, parts[:, m])
                others = (total - along[:, m])[:, None]
                loss = (rest**2).sum(-1) + (self.eta - 1) * (others + parallel) ** 2
                codes[:, m] = np.argmin(loss, axis=1)
                along[:, m] = np.take_along_axis(parallel, codes[:, m, None], 1)[:, 0]
                total = others[:, 0] + along[:, m]
        return codes

    def _refit(self, parts: np.ndarray, codes: np.ndarray, rounds: int = 40) -> None:
        """Codewords that minimise the loss under fixed codes: one least-squares problem for all of them.

        Conjugate gradients, which need products with its matrix only: memory is that of the sample and the codewords,
        however many components there are.
        """
        n, m, w = parts.shape
        slot = (np.arange(m) * WORDS + codes).ravel()
        used = np.bincount(slot, minlength=m * WORDS).astype(float)

        def spread(y: np.ndarray) -> np.ndarray:
            """Sum of the parts that have each codeword, a row counting y."""
            rows = (parts * y[:, None, None]).reshape(-1, w)
            return np.stack([np.bincount(slot, rows[:, c], minlength=m * WORDS) for c in range(w)], axis=1)

        def product(books: np.ndarray) -> np.ndarray:
            along = (parts * books[slot].reshape(n, m, w)).sum((1, 2))
            return (self.eta - 1) * spread(along) + (used[:, None] + 1e-6) * books

        books = self.books.reshape(-1, w).copy()
        rest = self.eta * spread(np.ones(n)) - product(books)
        scale = 1 / (used[:, None] + 1)
        step = scale * rest
        size = first = (rest * step).sum()
        for _ in range(rounds):
            if size <= 1e-12 * max(first, 1e-300):
                break
            pushed = product(step)
            ahead = size / (step * pushed).sum()
            books, rest = books + ahead * step, rest - ahead * pushed
            size, before = (rest * scale * rest).sum(), size
            step = scale * rest + size / before * step
        self.books = np.where((used > 0).reshape(m, WORDS, 1), books.reshape(m, WORDS, w), self.books)

    def residuals(self, x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the unit rows' residuals the part along the row (signed), and the length of the rest."""
        rest = (self.cut(x) - self.books[np.arange(len(self.books)), codes]).reshape(len(x), -1)[:, : self.dim]
        along = (rest * x).sum(1)
        return along, np.linalg.norm(rest - along[:, None] * x, axis=1)

    @staticmethod
    def least_estimate(score: np.ndarray, along: np.ndarray, across: np.ndarray) -> np.ndarray:
        """Below this estimate no row with such a residual has a cosine of ``score`` or more.

        A unit query at cosine s to the row is s times the row and at most sqrt(1 - s^2) of anything
        else, so its estimate is at least (1 - along) s - across sqrt(1 - s^2). Over all s from
        ``score`` to 1 that is least at an end, or at the bottom of its one dip.
        """
        slope = 1 - along
        dip = -slope / np.maximum(np.hypot(slope, across), 1e-300)
        at = lambda s: slope * s - across * np.sqrt(np.maximum(1 - s**2, 0))
        score = np.clip(score, -1, 1)
        return np.minimum(at(np.maximum(score, dip)), at(1.0)) - MARGIN

    def pack(self, codes: np.ndarray) -> np.ndarray:
        return (codes[:, 0::2] | codes[:, 1::2] << 4).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query and packed byte, the inner products of its 256 values."""
        t = np.einsum("qmw,mcw->qmc", self.cut(q), self.books).astype(np.float32)
        return (t[:, 1::2, :, None] + t[:, 0::2, None, :]).reshape(len(q), -1, WORDS * WORDS)


def search(df: DataFrame, id_col: str, vec_col: str, is_query: Column, k: int) -> DataFrame:
    """The k nearest rows by cosine of each query row: (query_id, rank, vec_id, score).

    Queries are the rows of ``df`` that meet ``is_query``; candidates are all rows but those with the
    query's id. Nearest first, ties to the smaller id; all candidates where there are fewer. Scores are cosines in double
    precision on the vectors as given. Rows whose vector is null or all zero, has null or non-finite
    components or not the common length take no part, nor do rows without an id. Rows that
    repeat an id count as one, with the smallest of their vectors. Without queries or vectors there are
    no rows. Other columns are ignored.

    Every row is encoded and scanned; codewords come from at most SAMPLE rows, chosen by hash. They
    only decide how many rows are scored exactly, not which are found.
    Rows and queries meet in a grid of bounded blocks, vectors as they are stored (half the bytes of doubles where they are floats);
    they go along with the codes because a row that the bound leaves open is scored where it is met. Equal vectors of a block are scanned once, and
    their smallest ids stand for the rest.
    """
    spark = df.sparkSession
    ids, schema = F.col(id_col).cast("long").alias("id"), "query_id long, vec_id long, score double"
    kind = df.select(vec_col).schema[0].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    vector = F.col(vec_col).cast(kind)
    rows = df.select(ids, vector.alias("v"), is_query.alias("q")).where(F.col("id").isNotNull() & sound_vector(F.col("v")))
    dim = common_length(rows, "v")
    rows = rows.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q")).checkpoint()
    n, n_queries = rows.count(), rows.where("q").count()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
    quantiser = Quantiser.fit(unit_rows(matrix(picked.column("v"), dim)))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = unit_rows(matrix(b.column(1), dim))
            codes = quantiser.assign(x)
            along, across = quantiser.residuals(x, codes)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([c.tobytes() for c in quantiser.pack(codes)], pa.binary()), pa.array(along), pa.array(across)],
                names=["id", "v", "code", "along", "across"])

    def blocks(total: int, size: int) -> int:
        return -(-total // size)

    row_blocks, query_blocks = blocks(n, ROWS), blocks(n_queries, QUERIES)
    # another hash for queries, so that they do not gather in a few of the rows' blocks
    rb, qb = F.pmod(F.xxhash64("id"), F.lit(row_blocks)), F.pmod(F.xxhash64("id", F.lit("q")), F.lit(query_blocks))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)).cast("array<bigint>"))
    coded = rows.select("id", "v").mapInArrow(code, f"id long, v {kind}, code binary, along double, across double")
    coded = coded.select("id", "v", "code", "along", "across", rb.alias("rb"), every(query_blocks).alias("qb"))
    queries = rows.where("q").select("id", "v", qb.alias("qb"), every(row_blocks).alias("rb"))

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        return _scan(left, right, quantiser, dim, k)

    met = coded.groupBy("rb", "qb").cogroup(queries.groupBy("rb", "qb")).applyInArrow(scan, schema)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scan(rows: pa.Table, queries: pa.Table, quantiser: Quantiser, dim: int, k: int) -> pa.Table:
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if rows.num_rows and queries.num_rows:
        ids, v = rows.column("id").to_numpy(), matrix(rows.column("v"), dim)
        codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        along, across = rows.column("along").to_numpy(), rows.column("across").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, v, codes, along, across = ids[order], v[order], codes[order], along[order], across[order]
        _, first, own = np.unique(v, axis=0, return_index=True, return_inverse=True)
        members = np.split(np.argsort(own.ravel(), kind="stable"), np.cumsum(np.bincount(own.ravel()))[:-1])
        # smallest ids of each distinct vector: k, and one in case the query is among them
        kept = np.full((len(first), k + 1), -1)
        for g, rows_of in enumerate(members):
            kept[g, : len(rows_of)] = rows_of[: k + 1]
        v, codes, along, across, unit = v[first], codes[first], along[first], across[first], unit_rows(v[first])
        q_ids, q_all = queries.column("id").to_numpy(), unit_rows(matrix(queries.column("v"), dim))
        for at in range(0, len(q_ids), 64):
            q, qi = q_all[at: at + 64], q_ids[at: at + 64]
            tables, score = quantiser.tables(q), np.zeros((len(q), len(v)), np.float32)
            for byte in range(codes.shape[1]):
                score += tables[:, byte][:, codes[:, byte]]
            c = min(max(RERANK, k + 1), len(v))
            near = np.argpartition(-score, c - 1, axis=1)[:, :c]
            exact = np.einsum("qcd,qd->qc", unit[near], q)
            # k + 1 distinct vectors by score, ties to the smaller first id
            best = np.lexsort((ids[first][near], -exact), axis=1)[:, : k + 1]
            taken = near
            near, exact = np.take_along_axis(near, best, 1), np.take_along_axis(exact, best, 1)
            if c < len(v):
                np.put_along_axis(score, taken, -np.inf, 1)
                # the (k + 1)-th score of the first batch only rises, so none but these rows can be among the best
                open_ = score >= Quantiser.least_estimate(exact[:, -1:], along, across)
                for r in np.nonzero(open_.any(axis=1))[0]:
                    rest = np.nonzero(open_[r])[0]
                    rest = rest[np.argsort(-score[r, rest])]
                    for start in range(0, len(rest), RERANK):
                        more = rest[start: start + RERANK]
                        more = more[score[r, more] >= Quantiser.least_estimate(exact[r, -1], along[more], across[more])]
                        rows_, scores_ = np.r_[near[r], more], np.r_[exact[r], np.einsum("cd,d->c", unit[more], q[r])]
                        best = np.lexsort((ids[first][rows_], -scores_))[: k + 1]
                        near[r], exact[r] = rows_[best], scores_[best]
            at_rows = kept[near]
            found = np.where(at_rows >= 0, ids[at_rows], np.iinfo(np.int64).max)
            s = np.where((at_rows >= 0) & (found != qi[:, None, None]), exact[:, :, None], -np.inf)
            found, s = found.reshape(len(q), -1), s.reshape(len(q), -1)
            last = np.lexsort((found, -s), axis=1)[:, :k]
            found, s = np.take_along_axis(found, last, 1), np.take_along_axis(s, last, 1)
            ok = np.isfinite(s)
            out.append((np.repeat(qi, ok.sum(1)), found[ok], s[ok]))
    parts = [np.concatenate(x) for x in zip(*out)] if out else [np.array([], np.int64)] * 2 + [np.array([], float)]
    return pa.table(dict(zip(("query_id", "vec_id", "score"), parts)))
