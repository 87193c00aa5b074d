"""Near-duplicate notes: pairs above a threshold that depends on whether they share a folder."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import durable, ship

# Thresholds across folders and inside one, and the cap of a report.
ACROSS, INSIDE, REPORT = 0.80, 0.72, 25
#: Vectors that centres are taken from, centres at most, vectors of a centre, and what rounding may take from an angle.
SAMPLE, BALLS, PER_BALL, MARGIN = 4096, 512, 32, 1e-6
#: Vectors of a block, at least and at most, by default; rows that are held against all cells at once; and pairs of a batch that leaves a unit.
BLOCKS, SLICE, SENT = (2048, 16384), 1024, 1 << 16
#: Terms that get numbers, the most frequent ones; terms of a block of sets at least and at most, blocks that are aimed at, and tallies that are held at once.
NAMED, TERMS, PARTS, COUNTS = 1 << 18, (1 << 18, 1 << 24), 12, 1 << 20
#: Terms that near sets share in their prefixes at least: so many, and one more for each so many terms. A multiplier that spreads numbers over 64 bits.
SHARED, SPREAD = (3, 64), 0x9E3779B97F4A7C15
#: Scores from which a report is filled first, before it takes lower ones.
STEPS = (0.97, 0.9)
#: Angles (radians) between the shells around a centre, so that a few far members do not widen what the others are met by.
SHELLS = np.array([0.2, 0.45, 0.7, 1.0])


def is_twin(score: Column, same: Column, across: float = ACROSS, inside: float = INSIDE) -> Column:
    return score >= F.when(same, inside).otherwise(across)


@dataclass
class Balls:
    """Centres that vectors are dealt to. A cell is a shell around a centre: the least and largest angle of its members. Cells that follow one another share a shelf
    of about one block of members, and a cell of more than a block spans several shelves."""

    centres: np.ndarray
    reach: float
    low: np.ndarray
    high: np.ndarray
    #: The first cell of each group of cells, its first shelf, and how many shelves it spans; and into how many blocks the visitors of each shelf are cut.
    first: np.ndarray
    shelf: np.ndarray
    parts: np.ndarray
    visitors: np.ndarray

    def angles(self, x: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(x @ self.centres.T, -1, 1))

    def cell(self, angle: np.ndarray) -> np.ndarray:
        """The cell of each row, of the nearest centre."""
        own = angle.argmin(axis=1)
        return own * (len(SHELLS) + 1) + np.searchsorted(SHELLS, angle[np.arange(len(own)), own])

    def visits(self, x: np.ndarray, low: int = 0, high: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Own cell of each row, and which later cells (of those from ``low`` to ``high``) may hold vectors within reach: by the triangle inequality, members of the others are further away."""
        angle, of = self.angles(x), np.arange(low, len(self.low) if high is None else high)
        own, wide = self.cell(angle), angle[:, of // (len(SHELLS) + 1)]
        near = (wide <= self.high[of] + self.reach + MARGIN) & (wide >= self.low[of] - self.reach - MARGIN)
        return own, near & (of > own[:, None])

    def shelves(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Own shelf of each row, and (row, shelf) of the later ones that it visits."""
        own, near = self.visits(x)
        group = np.searchsorted(self.first, own, side="right") - 1
        met = np.logical_or.reduceat(near, self.first, axis=1)
        # the rows of a shelf meet there
        met[np.arange(len(own)), group] = False
        mine = self.shelf[group] + h % self.parts[group]
        row, to = np.nonzero(met)
        # all shelves of a group that is visited, and the later ones of the own group
        row, start, n = np.r_[row, np.arange(len(own))], np.r_[self.shelf[to], mine + 1], np.r_[self.parts[to], self.shelf[group] + self.parts[group] - mine - 1]
        return mine, np.repeat(row, n), np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())

    def cells_of(self, shelf: int) -> tuple[int, int]:
        """The cells that a shelf holds members of."""
        group = int(np.searchsorted(self.shelf, shelf, side="right")) - 1
        return int(self.first[group]), int(self.first[group + 1]) if group + 1 < len(self.first) else len(self.low)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that are small enough to be held against all cells at once."""
    for at in range(0, b.num_rows, SLICE):
        yield b.slice(at, SLICE)


def _pooled(found: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First cell, first shelf and number of shelves of each group of cells: as many cells in a row as fill no more than a block, or one larger cell."""
    first, parts, used = [], [], block + 1
    for cell, n in enumerate(found):
        if used + n > block:
            first.append(cell)
            parts.append(max(1, -(-int(n) // block)))
            used = 0
        used += n
    return np.array(first), np.cumsum([0, *parts])[:-1], np.array(parts)


def _centres(x: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    """Directions of k groups of a sample's vectors, each moved to its group's mean a few times."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 0, total / np.where(size > 0, size, 1), centres)
    return centres


def fit_balls(rows: DataFrame, least: float, block: int | None = None) -> tuple[Balls, int]:
    """Balls for unit vectors (id, v), and the rows of a block: centres from at most SAMPLE vectors, everything else counted over all rows."""
    n = rows.count()
    block = block or min(BLOCKS[1], max(BLOCKS[0], n // 16))
    sample = rows.orderBy(F.xxhash64("id")).select("v").limit(SAMPLE).toArrow().column("v")
    k = int(min(BALLS, max(1, n // PER_BALL), max(1, len(sample))))
    cells, one = k * (len(SHELLS) + 1), np.zeros(1, int)
    balls = Balls(_centres(_matrix(sample), k) if n else np.ones((1, 1)), float(np.arccos(np.clip(least, -1, 1))), np.full(cells, 9.0), np.full(cells, -9.0), one, one, one + 1, one)

    def owns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for y in batches for x in _slices(y)):
            angle = balls.angles(_matrix(b.column("v")))
            own, near = balls.cell(angle), pa.array(angle.min(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.ones(len(own), np.int64)), near, near], ["at", "n", "low", "high"])

    told = rows.select("v").mapInArrow(owns, "at long, n long, low double, high double").groupBy("at").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
    at, found = told.column("at").to_numpy(), np.zeros(cells, int)
    for of, c in ((found, "n"), (balls.low, "low"), (balls.high, "high")):
        of[at] = told.column(c).to_numpy()
    balls.first, balls.shelf, balls.parts = _pooled(found, block)

    def comes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for y in batches for x in _slices(y)):
            at, n = np.unique(balls.shelves(_matrix(b.column("v")), b.column("h").to_numpy())[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.astype(np.int64))], ["at", "n"])

    told = rows.select("v", _spot().alias("h")).mapInArrow(comes, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    balls.visitors = np.ones(int(balls.parts.sum()), int)
    balls.visitors[told.column("at").to_numpy()] = np.maximum(1, -(-told.column("n").to_numpy() // block))
    return balls, block


def _spot() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(1 << 40))


def vector_twins(rows: DataFrame, across: float = ACROSS, inside: float = INSIDE, block: int | None = None) -> DataFrame:
    """(a, b, same, score) for pairs a < b of (id, folder, v), v a unit vector; null vectors are left out.

    Exact. Vectors are dealt to shells around centres; one meets the members of its own shell and of those later ones that can hold vectors within the angle of the lower threshold.
    Shells are pooled on shelves of about ``block`` vectors (by default a sixteenth of all, within BLOCKS), and a vector is sent once to each shelf that holds a shell it meets, so however wide the
    angle is, its copies are no more than shelves. A shelf's visitors are cut into blocks as well, so near copies of any number are many bounded units. A unit is compared shell by shell, and its
    pairs leave it while it is compared.
    """
    return _met(rows, across, inside, block).where("a IS NOT NULL").drop("pairs")


def pair_share(rows: DataFrame, least: float, block: int | None = None) -> float:
    """Pairs that ``vector_twins`` multiplies for a lower threshold, of all pairs."""
    n = rows.where("v IS NOT NULL").count()
    multiplied = _met(rows, 2.0, least, block).where("a IS NULL").agg(F.sum("pairs")).first()[0] or 0
    return multiplied / max(1, n * (n - 1) / 2)


def _met(rows: DataFrame, across: float, inside: float, block: int | None) -> DataFrame:
    """Twins, and for each unit a row without ids that says how many pairs were multiplied."""
    ship(rows.sparkSession)
    rows = durable(rows.where("v IS NOT NULL").select("id", "folder", "v"))
    least = min(across, inside)
    balls, _ = fit_balls(rows, least, block)
    schema = rows.schema

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for y in batches for x in _slices(y)):
            h = b.column("h").to_numpy()
            mine, row, to = balls.shelves(_matrix(b.column("v")), h)
            # a row is a member in every block of visitors of its shelf
            n = balls.visitors[mine]
            own = np.repeat(np.arange(len(mine)), n)
            visit = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            shelf, block_of = np.r_[mine[own], to], np.r_[visit, h[row] % balls.visitors[to]]
            moved = b.select(["id", "folder", "v"]).take(pa.array(np.r_[own, row]))
            yield pa.RecordBatch.from_arrays([*moved.columns, pa.array(shelf), pa.array(block_of), pa.array(np.arange(len(shelf)) < len(own))], ["id", "folder", "v", "shelf", "visit", "member"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = pa.Table.from_batches(list(batches))
        kind = unit.schema.field("id").type
        member = unit.column("member").to_numpy(zero_copy_only=False)
        ids, x = unit.column("id").to_numpy(), _matrix(unit.column("v"))
        # folders as numbers, without one -1
        folder = pc.fill_null(unit.column("folder").combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        low, high = balls.cells_of(unit.column("shelf")[0].as_py())
        told = [balls.visits(x[at: at + SLICE], low, high) for at in range(0, len(x), SLICE)]
        own, near = (np.concatenate(z) for z in zip(*told))
        members, visitors = np.flatnonzero(member), np.flatnonzero(~member)
        lone, pairs, held, size = unit.column("visit")[0].as_py() == 0, 0, [], 0

        def out(a: np.ndarray, b: np.ndarray, same: np.ndarray, score: np.ndarray, pairs: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind), pa.array(same, pa.bool_()), pa.array(score, pa.float64()), pa.array(pairs, pa.int64())],
                                              ["a", "b", "same", "score", "pairs"])

        for cell in np.unique(own[members]):
            rows = members[own[members] == cell]
            # rows of this cell's other shelves, and those of cells before it that come near enough
            come = visitors[near[visitors, cell - low] | (own[visitors] == cell)]
            come = np.r_[come, members[near[members, cell - low]]] if lone else come
            for others, inner in ((come, False), (rows, True)) if lone else ((come, False),):
                if not len(others):
                    continue
                y = x[others].T
                pairs += len(rows) * (len(rows) - 1) // 2 if inner else len(rows) * len(others)
                for at in range(0, len(rows), 64):
                    part = rows[at: at + 64]
                    score = x[part] @ y
                    p, q = np.nonzero(score >= least)
                    score, p, q = score[p, q], part[p], others[q]
                    same, a, b = folder[p] == folder[q], ids[p], ids[q]
                    good = (score >= np.where(same, inside, across)) & ((a < b) if inner else (a != b))
                    a, b = a[good], b[good]
                    held.append((np.minimum(a, b), np.maximum(a, b), same[good], score[good], np.zeros(len(a), int)))
                    size += len(a)
                    if size >= SENT:
                        yield out(*(np.concatenate(z) for z in zip(*held)))
                        held, size = [], 0
        if size:
            yield out(*(np.concatenate(z) for z in zip(*held)))
        yield out([None], [None], [None], [None], [pairs])

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    units = rows.withColumn("h", _spot()).mapInArrow(deal, f"{names}, shelf long, visit long, member boolean")
    id_type = schema["id"].dataType.simpleString()
    return units.groupBy("shelf", "visit").applyInArrow(compare, f"a {id_type}, b {id_type}, same boolean, score double, pairs long")


def _upto(n: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of some lengths, one after another."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _packed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Sets of rising codes, one after another, as bytes: eight for each code below 0, and one to three for each difference of the numbers after them. With how many of each set are below 0."""
    start, low = np.cumsum(n) - n, codes < 0
    rare = np.add.reduceat(low, start, dtype=np.int64) if len(n) else n
    step = np.diff(codes, prepend=0)
    first = (start + rare)[rare < n]
    step[first] = codes[first]
    width = np.where(low, 8, 1 + (step >> 7 > 0) + (step >> 14 > 0))
    end = np.cumsum(width)
    at, data = end - width, np.zeros(width.sum(), np.uint8)
    data[(at[low][:, None] + np.arange(8)).ravel()] = codes[low].astype("<i8").view(np.uint8)
    for k in range(3):
        more = ~low & (width > k)
        data[at[more] + k] = step[more] >> 7 * k & 127 | (width[more] > k + 1) << 7
    return rare, pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.r_[0, end][np.r_[0, start + n]].astype(np.int32)), pa.py_buffer(data)])


def _unpacked(packed: pa.Array | pa.ChunkedArray, n: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """All codes of the sets, one set after another."""
    codes, at = np.empty(n.sum(), np.int64), 0
    chunks = packed.chunks if isinstance(packed, pa.ChunkedArray) else [packed]
    begin = 0
    for part in (c.slice(k, SLICE).cast(pa.large_binary()) for c in chunks for k in range(0, len(c), SLICE)):
        size, few = n[begin: begin + len(part)], rare[begin: begin + len(part)]
        begin += len(part)
        ends = np.frombuffer(part.buffers()[1], np.int64)[part.offset: part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2], np.uint8)[ends[0]: ends[-1]]
        ends, low = ends - ends[0], np.repeat(8 * few, np.diff(ends)) > _upto(np.diff(ends))
        to = codes[at: at + size.sum()]
        at += len(to)
        named = _upto(size) >= np.repeat(few, size)
        to[~named] = data[low].view("<i8")
        data = data[~low]
        stop = np.flatnonzero(data < 128)
        first = np.r_[0, stop[:-1] + 1][: len(stop)]
        step = data[first].astype(np.int64) & 127
        for k in (1, 2):
            more = stop - first >= k
            step[more] |= (data[first[more] + k].astype(np.int64) & 127) << 7 * k
        total, many = np.cumsum(step), size - few
        since = (np.cumsum(many) - many)[many > 0]
        to[named] = total - np.repeat(total[since] - step[since], many[many > 0])
    return codes


def set_twins(docs: DataFrame, across: float = ACROSS, inside: float = INSIDE, block: int | None = None) -> DataFrame:
    """(a, b, same, score) for pairs a < b of (id, folder, terms) by cosine of their term sets.

    Documents with one term set and folder are one class, represented by its smallest id; pairs are between
    representatives. Terms are compared by 63 bits of hash or more, and sets by MD5 of those. Exact besides, by prefix: with terms in order of rising frequency, two sets of n and m terms that are
    near enough share t sqrt(n m) terms, and of these all but n - p come among the first p of the one whose first p end first.

    Sets are dealt to blocks of one range of sizes and about ``block`` terms (by default a twelfth of all, within TERMS), and each two blocks whose sizes can meet are a unit. There prefixes, as
    short as the sizes that meet there allow, are tallied by postings, for pairs across folders and inside one apart; pairs that can still be near enough are compared whole, so only twins leave it.
    The NAMED most frequent terms are numbers, and held by every task; the rest are hashes.
    """
    return _near(_term_sets(docs), across, inside, block)


def _term_sets(docs: DataFrame) -> DataFrame:
    """(id, folder, n, rare, code, cell, h) of each class: its number of terms and of those without a number, their packed codes, a range of sizes and a hash."""
    spark = docs.sparkSession
    ship(spark)
    # read and cut into terms once, for the counts and for the sets
    rows = durable(docs.select("id", "folder", F.transform(F.array_distinct("terms"), lambda t: F.xxhash64(t)).alias("h")))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Terms and their numbers, of about COUNTS terms at a time."""
        held, size = [], 0
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held.append(b.column("h").flatten().to_numpy(zero_copy_only=False))
                size += len(held[-1])
            if size >= COUNTS or b is None and size:
                t, df = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(df.astype(np.int64))], ["t", "df"])
                held, size = [], 0

    counted = rows.select("h").mapInArrow(tally, "t long, df long").groupBy("t").agg(F.sum("df").alias("df"))
    named = counted.where("df > 1").orderBy(F.desc("df"), "t").limit(NAMED).select("t").toArrow().column("t").to_numpy()
    # hashes in order, and the number of each: the higher, the more frequent
    by_hash = np.argsort(named)
    told = spark.sparkContext.broadcast((named[by_hash], (NAMED - 1 - by_hash).astype(np.int64)))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = told.value
        for b in (x for y in batches for x in _slices(y)):
            h = b.column("h")
            n = pc.fill_null(pc.list_value_length(h), 0).to_numpy(zero_copy_only=False)
            flat = h.flatten().to_numpy(zero_copy_only=False)
            codes = flat | np.iinfo(np.int64).min
            if len(known):
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                codes = np.where(known[at] == flat, number[at], codes)
            codes = codes[np.lexsort((codes, np.repeat(np.arange(len(n)), n)))]
            full = np.flatnonzero(n)
            rare, packed = _packed(codes, n[full])
            kept = b.select(["id", "folder"]).take(pa.array(full))
            keys = [hashlib.md5(b"%d:%b" % (k, x.as_py())).digest() for k, x in zip(rare.tolist(), packed)]
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(n[full], pa.int64()), pa.array(rare, pa.int64()), pa.array(keys, pa.binary()), packed], ["id", "folder", "n", "rare", "key", "code"])

    sets = rows.mapInArrow(encode, f"id {types['id']}, folder {types['folder']}, n long, rare long, key binary, code binary")
    sets = sets.groupBy("folder", "key").agg(F.min(F.struct("id", "n", "rare", "code")).alias("s")).select("s.id", "folder", "s.n", "s.rare", "s.code", F.floor(F.log2("s.n") * 16).alias("cell"))
    return durable(sets.withColumn("h", _spot()))


def _near(sets: DataFrame, across: float, inside: float, block: int | None = None) -> DataFrame:
    """Twins of ``_term_sets``. A threshold above 1 leaves its pairs out."""
    least, types = min(across, inside), {f.name: f.dataType.simpleString() for f in sets.schema}
    sizes = sets.groupBy("cell").agg(F.sum("n").alias("terms"), F.min("n").alias("low"), F.max("n").alias("high")).toArrow().to_pydict()
    found = np.zeros(max(sizes["cell"], default=0) + 1, np.int64)
    found[sizes["cell"]] = sizes["terms"]
    block = block or min(TERMS[1], max(TERMS[0], int(found.sum()) // PARTS))
    first, start, parts = _pooled(found, block)
    group = np.searchsorted(first, sizes["cell"], side="right") - 1
    low, high = np.full(len(first), np.iinfo(np.int64).max), np.zeros(len(first), np.int64)
    np.minimum.at(low, group, sizes["low"])
    np.maximum.at(high, group, sizes["high"])
    # blocks in order of size; the later of two may hold sets that are no larger than 1 / t^2 times the earlier's
    blocks, of = int(parts.sum()), np.repeat(np.arange(len(first)), parts)
    ends = np.array([np.searchsorted(of, np.flatnonzero(low * least * least <= high[g] + 1e-9).max(initial=g), side="right") for g in range(len(first))])[of]
    units = [np.array([min(x, y) * blocks + max(x, y) for y in range(blocks) if max(x, y) < ends[min(x, y)]]) for x in range(blocks)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for y in batches for x in _slices(y)):
            at = np.searchsorted(first, b.column("cell").to_numpy(), side="right") - 1
            own = start[at] + b.column("h").to_numpy() % parts[at]
            if not len(own):
                continue
            to = np.concatenate([units[x] for x in own])
            row = np.repeat(np.arange(len(own)), [len(units[x]) for x in own])
            moved = b.select(["id", "folder", "n", "rare", "code"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*moved.columns, pa.array(to), pa.array(to // blocks == own[row])], ["id", "folder", "n", "rare", "code", "unit", "member"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = pa.Table.from_batches(list(batches))
        kind = unit.schema.field("id").type
        member, ids, n = (unit.column(c).to_numpy() for c in ("member", "id", "n"))
        folder = pc.fill_null(unit.column("folder").combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        codes = _unpacked(unit.column("code"), n, unit.column("rare").to_numpy())
        x, y = divmod(unit.column("unit")[0].as_py(), blocks)
        members, visitors = np.flatnonzero(member), np.flatnonzero(member if x == y else ~member)
        if not len(members) or not len(visitors):
            return
        for t, alike in ((across, False), (inside, True)):
            if t <= 1 + 1e-9:
                yield from near(t, alike, ids, kind, n, folder, codes, members, visitors, x == y)

    def near(t: float, alike: bool, ids: np.ndarray, kind: pa.DataType, n: np.ndarray, folder: np.ndarray, codes: np.ndarray, members: np.ndarray, visitors: np.ndarray, inner: bool) -> Iterator[pa.RecordBatch]:
        """Pairs of a member and a visitor, across folders or inside one; in one block, of a member and a visitor that is no smaller."""
        m, start = len(members), np.cumsum(n) - n

        def first_of(of: np.ndarray, k: np.ndarray) -> np.ndarray:
            """The first k codes of each set."""
            return codes[np.repeat(start[of], k) + _upto(k)]

        def prefix(of: np.ndarray, partner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
            """For sets and the least size of what they meet: length and last code of each prefix, its terms and whose they are, and what is shared there at least."""
            need = np.ceil(t * np.sqrt(n[of] * np.maximum(partner, t * t * n[of])) - 1e-9).astype(np.int64)
            # a set that nothing here is near to has no prefix
            head = np.where(need > n[of], 0, np.minimum(n[of], n[of] - need + SHARED[0] + n[of] // SHARED[1]))
            full = head > 0
            last, terms = codes[start[of] + np.maximum(head, 1) - 1], first_of(of, head)
            if alike:
                # one term in two folders is two; those few that fall together are told apart when sets are compared
                terms += np.repeat(folder[of].astype(np.int64).view(np.uint64) * np.uint64(SPREAD), head).view(np.int64)
            return head, last, terms, np.repeat(np.arange(len(of)), head), int((need - n[of] + head)[full].min(initial=1 << 40))

        head_m, last_m, terms, holder, least_m = prefix(members, n[members] if inner else np.full(m, n[visitors].min()))
        head_v, last_v, asked, who, least_v = prefix(visitors, np.full(len(visitors), n[members].min()))
        if not len(terms) or not len(asked):
            return
        order = np.argsort(terms)
        holder, (known, start_of, size_of) = holder[order], np.unique(terms[order], return_index=True, return_counts=True)
        del terms, order
        at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        hit = known[at] == asked
        at, who, shared = at[hit], who[hit], min(least_m, least_v)
        del asked, hit
        # visitors in runs of about COUNTS tallies
        first = np.searchsorted(who, np.arange(len(visitors) + 1))
        upto = np.r_[0, np.cumsum(size_of[at])][first]
        cuts = np.flatnonzero(np.diff(upto[:-1] // COUNTS, prepend=-1))
        held, size = [], 0

        def out(held: list) -> pa.RecordBatch:
            a, b, score = (np.concatenate(z) for z in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind), pa.array(np.full(len(a), alike)), pa.array(score, pa.float64())], ["a", "b", "same", "score"])

        for begin, end in zip(cuts, [*cuts[1:], len(visitors)]):
            part = at[first[begin]: first[end]]
            n_of = size_of[part]
            place = np.repeat(start_of[part] - np.cumsum(n_of) + n_of, n_of) + np.arange(n_of.sum())
            key = np.repeat((who[first[begin]: first[end]] - begin) * m, n_of) + holder[place]
            del place
            if (end - begin) * m <= 4 * len(key):
                tally = np.bincount(key, minlength=1)
                pair = np.flatnonzero(tally)
                tally = tally[pair]
            else:
                # pairs are far more than tallies: those that come often enough, by a table of a few places for each tally that pairs may share, are counted one by one
                spot = key.view(np.uint64) * np.uint64(SPREAD) >> np.uint64(63 - len(key).bit_length())
                spot = spot.view(np.int64)
                pair, tally = np.unique(key[np.bincount(spot, minlength=1)[spot] >= shared], return_counts=True)
                del spot
            del key
            i, j = begin + pair // m, pair % m
            v, w = visitors[i], members[j]
            need = t * np.sqrt(n[v] * n[w].astype(np.float64)) - 1e-9
            left = np.where(last_v[i] <= last_m[j], n[v] - head_v[i], n[w] - head_m[j])
            good = (np.minimum(tally + left, np.minimum(n[v], n[w])) >= need) & ((folder[v] == folder[w]) == alike)
            if inner:
                good &= (n[w] < n[v]) | ((n[w] == n[v]) & (w < v))
            v, w = v[good], w[good]
            seen, since = np.unique(v, return_index=True)
            for row, lo, hi in zip(seen, since, [*since[1:], len(v)]):
                own = codes[start[row]: start[row] + n[row]]
                for k in range(lo, hi, SLICE):
                    others = w[k: min(k + SLICE, hi)]
                    all_of = first_of(others, n[others])
                    there = own[np.minimum(np.searchsorted(own, all_of), len(own) - 1)] == all_of
                    score = np.add.reduceat(there, np.cumsum(n[others]) - n[others], dtype=np.int64) / np.sqrt(n[row] * n[others].astype(np.float64))
                    twin = score >= t
                    a, b = np.full(twin.sum(), ids[row], ids.dtype), ids[others[twin]]
                    held.append((np.minimum(a, b), np.maximum(a, b), score[twin]))
                    size += len(a)
                    if size >= SENT:
                        yield out(held)
                        held, size = [], 0
        if size:
            yield out(held)

    dealt = sets.mapInArrow(deal, f"id {types['id']}, folder {types['folder']}, n long, rare long, code binary, unit long, member boolean")
    return dealt.groupBy("unit").applyInArrow(compare, f"a {types['id']}, b {types['id']}, same boolean, score double")


def rank_set_twins(docs: DataFrame, cap: int = REPORT, across: float = ACROSS, inside: float = INSIDE, places: int = 6) -> DataFrame:
    """The report of ``set_twins``, by scores of so many ``places``. As pairs inside a folder come first, those above a high score fill it if they are enough, and lower ones are joined only if not."""
    sets = _term_sets(docs)
    for least in (x for x in STEPS if x > inside):
        near = _near(sets, 2.0, least).withColumn("score", F.round("score", places))
        # what is left out rounds to this score at most
        top = durable(rank_twins(near.where(F.col("score") > least), cap))
        if top.count() == cap:
            return top
    return rank_twins(_near(sets, across, inside).withColumn("score", F.round("score", places)), cap)


def rank_twins(pairs: DataFrame, cap: int = REPORT) -> DataFrame:
    """The report: same folder first, then by score; ``cap`` rows."""
    order = [F.desc("same"), F.desc("score"), F.col("a"), F.col("b")]
    top = pairs.orderBy(*order).limit(cap)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def copies(docs: DataFrame, text: Column) -> DataFrame:
    """(id, digest, group, members): documents whose text another one repeats byte for byte."""
    hashed = docs.select("id", F.md5(text).alias("digest"))
    groups = hashed.groupBy("digest").agg(F.min("id").alias("group"), F.count("*").alias("members")).where("members > 1")
    return hashed.join(groups, "digest")
