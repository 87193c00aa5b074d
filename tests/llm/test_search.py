"""SimHash, nearest neighbours and embedding dedup against brute force."""

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from notewell.llm import ann, common, embdedup, queries, simhash
from notewell.llm.common import least_labels, prepare
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def ready(spark):
    prepare(spark)


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, linked):
    """Smallest id reachable, by repeated relaxation over all pairs."""
    root = list(range(len(ids)))
    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [least.get(find(i)) for i in range(len(ids))]


def check_groups(rows, docs):
    fps = [plain_fingerprint(t) for _, t in docs]
    want = components([d for d, _ in docs], lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 3)
    got = sorted(((r[0], r[1], r[2]) for r in rows), key=repr)
    assert got == sorted(((d, f, c) for (d, _), f, c in zip(docs, fps, want)), key=repr)


def test_simhash_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_groups([(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in queries.op1_simhash(spark, SF).collect()], docs)


ODD = [(1, None), (2, ""), (2, ""), (3, " \n\x0b"), (4, "one"), (5, "ONE"), (6, "one two"), (None, "lone words here"), (7, "ÀB c d"), (8, "Àb C D"),
       (9, "w " * 40_000), (None, "one two"), (10, "a b c d")]


def test_simhash_odd_rows(spark):
    df = spark.createDataFrame([(*r, 1, "k") for r in ODD], "doc_id long, text string, fp int, key string")
    check_groups([(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.groups(df).collect()], ODD)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect() if r.text) == sorted(
        (d or 0, t) for d, t in [(4, "one"), (6, "one two"), (None, "lone words here"), (7, "ÀB c d"), (9, "w " * 40_000), (10, "a b c d")])
    assert [r.doc_id for r in kept.where("text IS NULL OR trim(text) = ''").collect()] == [1]
    assert simhash.groups(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def test_simhash_large_postings(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63)
    fps = np.unique([int(centre) ^ sum(1 << int(b) for b in rng.choice(16, rng.integers(0, 7), replace=False)) for _ in range(900)])
    monkeypatch.setattr(simhash, "SMALL", 20)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    edges = simhash.links(spark.createDataFrame([(int(f),) for f in fps], "fp long")).collect()
    ids = [int(f) for f in fps]
    want = components(ids, lambda i, j: bin(ids[i] ^ ids[j]).count("1") <= 3)
    at = {f: i for i, f in enumerate(ids)}
    pairs = {frozenset((at[a], at[b])) for a, b in edges}
    assert components(ids, lambda i, j: frozenset((i, j)) in pairs) == want


def test_simhash_counts_shared_bytes(spark):
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, (400, 8), dtype=np.uint8)
    for i in range(0, 398, 2):
        shared = rng.choice(8, 3 + i // 2 % 5, replace=False)
        data[i + 1, shared] = data[i, shared]
    fps = data.view("<i8").ravel().tolist()
    keyed = spark.createDataFrame([(f,) for f in fps], "fp long").select(
        "fp", F.explode(F.array(*(simhash._key(F.col("fp"), k) for k in range(len(simhash.KEYS))))).alias("key"))
    equal = (data[:, None] == data[None]).sum(-1)
    want = {(min(fps[i], fps[j]), max(fps[i], fps[j]), int(equal[i, j])) for i in range(400) for j in range(i) if 5 <= equal[i, j] < 8}
    assert {tuple(r) for r in simhash.tallied(keyed).collect()} == want and len(want) > 100


@pytest.mark.parametrize("small", [0, 10**6])
def test_components_with_hubs(spark, monkeypatch, small):
    monkeypatch.setattr(common, "BROADCAST_ROWS", small)
    monkeypatch.setattr(common, "HOT", 20)
    rng = np.random.default_rng(3)
    n = 900
    edges = [(0, i) for i in range(1, 200)] + [(899, i) for i in range(300, 500)] + [(600 + i, 601 + i) for i in range(60)] + [tuple(e) for e in rng.integers(700, 890, (80, 2)).tolist()]
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    p, q = np.array(edges).T
    label = least_labels(n, p, q)
    assert got == {int(i): int(label[i]) for i in set(p.tolist() + q.tolist()) if (i != label[i]) or (label == label[i]).sum() > 1}


def cosines(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return u @ u.T


def brute_nearest(ids, x, queries, k):
    c, out = cosines(x), set()
    for q in queries:
        i = ids.index(q)
        order = sorted((-c[i, j], ids[j]) for j in range(len(ids)) if j != i)[:k]
        out |= {(q, n + 1, d) for n, (_, d) in enumerate(order)}
    return out


def test_nearest_query(spark):
    data = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = [r.vec_id for r in data], np.array([r.embedding for r in data], float)
    got = queries.op3_nearest(spark, SF).collect()
    want = brute_nearest(ids, x, [i for i in ids if i % 50 == 0], 5)
    found = {(r.query_id, r["rank"], r.vec_id) for r in got}
    assert len(found) == len(want) and len(found & want) >= 0.95 * len(want)
    c = cosines(x)
    assert all(abs(r.score - c[ids.index(r.query_id), ids.index(r.vec_id)]) < 1e-12 for r in got)


def test_nearest_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 40)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 6))
    x[50:120] = x[0]
    data = [(i, [float(v) for v in row], "q") for i, row in enumerate(x)]
    data += [(300, None, "q"), (301, [0.0] * 6, "q"), (302, [1.0, None] * 3, "q"), (303, [float("nan")] * 6, "q"), (304, [float("inf")] * 6, "q"), (305, [1.0], "q"), (None, [1.0] * 6, "q"), data[3]]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, q string")
    got = ann.search(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, 5).collect()
    found, want = {(r.query_id, r["rank"], r.vec_id) for r in got}, brute_nearest(list(range(200)), x, [0, 50, 100, 150], 5)
    assert found == want
    few = ann.search(df.where("vec_id < 3"), "vec_id", "embedding", F.col("vec_id") == 0, 5).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2]
    assert ann.search(df.limit(0), "vec_id", "embedding", F.col("vec_id") == 0, 5).count() == 0


def planted(seed, groups, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = rng.normal(size=dim)
        for _ in range(rng.integers(1, 12)):
            rows.append(centre + rng.normal(size=dim) * rng.uniform(0, 0.35))
    return np.array(rows, np.float32).astype(float)


@pytest.mark.parametrize("block", [4096, 7])
def test_embedding_dedup_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embdedup, "BLOCK", block)
    x = planted(4, 120)
    x[100:140] = x[7]
    labels = [i % 3 if i % 11 else None for i in range(len(x))]
    odd = [(None, 1), ([0.0] * 16, 1), ([float("nan")] * 16, 1), ([1.0, None] * 8, 1), ([1.0], 1)]
    data = [(i, [float(v) for v in row], label, 5) for i, (row, label) in enumerate(zip(x, labels))] + [(1000 + i, v, label, 5) for i, (v, label) in enumerate(odd)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, node int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embdedup.link_vectors(df, "vec_id", "embedding", "label", 0.93).collect()}
    c = cosines(x)
    link = lambda i, j: labels[i] is not None and labels[i] == labels[j] and c[i, j] >= 0.93
    root = components(list(range(len(x))), link)
    want = {i: (sum(link(i, j) for j in range(len(x)) if j != i), root[i], root[i] == i) for i in range(len(x))}
    want |= {1000 + i: (0, 1000 + i, True) for i in range(len(odd))}
    assert got == want
    assert embdedup.link_vectors(df.limit(0), "vec_id", "embedding", "label", 0.93).count() == 0


def test_embedding_dedup_loses_no_link_on_low_rank_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 4)) @ rng.normal(size=(4, 64))
    df = spark.createDataFrame([(i, [float(v) for v in row], 1) for i, row in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embdedup.link_vectors(df, "vec_id", "embedding", "label", 0.93).collect()}
    link = cosines(x) >= 0.93
    root = least_labels(len(x), *np.nonzero(link))
    assert got == {i: (int(link[i].sum()) - 1, int(root[i])) for i in range(len(x))}


def test_nearest_in_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 64))
    x[:2000] = x[0] / np.linalg.norm(x[0]) + rng.normal(size=(2000, 64)) * 0.018
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    asked = [i for i in range(6000) if i % 100 == 0]
    got = ann.search(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0, 5).collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == brute_nearest(list(range(6000)), x, asked, 5)


def test_multi_index_walk_and_inverted_lists(monkeypatch):
    x = np.random.default_rng(7).normal(size=(2000, 6)) @ np.random.default_rng(8).normal(size=(6, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = embdedup.MultiIndex.fit(x, 12, 0.93)
    i, j = index.cells(x)
    a, b = index.bounds(x)
    within = (a[:, :, None] + b[:, None] <= index.stop).reshape(len(x), -1) & (np.arange(144) >= (i * 12 + j)[:, None])
    row, cell = index.visits(x, i, j)
    assert sorted(zip(row.tolist(), cell.tolist())) == [tuple(z) for z in np.argwhere(within).tolist()]
    far = a[row, cell // 12] + b[row, cell % 12]
    for r in range(len(x)):
        assert (np.diff(far[row == r]) >= 0).all()  # nearest first

    multiplied = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            multiplied.append(self.shape[0] * other.shape[1])
            return np.asarray(self) @ np.asarray(other)

    monkeypatch.setattr(embdedup, "unit_rows", lambda m: m.view(Counted))
    visits = np.arange(560) < 10
    own, cells = np.where(visits, 3, np.where(np.arange(560) < 60, 4, 5)), [[4] if v else [o] for v, o in zip(visits, np.where(np.arange(560) < 60, 4, 5).tolist())]
    unit = pa.table({"visits": visits, "node": np.arange(560), "copies": np.ones(560, np.int64), "v": pa.array(x[:560].tolist()), "own": own, "cells": cells})
    got = {r["node"]: r["links"] for r in embdedup._verify(unit, 32, 0.5).to_pylist()}
    hit = x[:10] @ x[10:60].T >= 0.5
    want = np.r_[hit.sum(1), hit.sum(0)]
    assert got == {n: int(c) for n, c in enumerate(want) if c} and sum(multiplied) == 10 * 50


def test_keep_one_with_repeated_ids(spark):
    texts = ["red apples fall in autumn", "two ships left the harbour", "seven birds sang all night", "the old mill stands still"]
    fps = [plain_fingerprint(t) for t in texts]
    assert all((fps[i] ^ fps[j]).bit_count() > 3 for i in range(4) for j in range(i))
    # id 5 stands for three texts; the last of them is in id 1's group
    docs = [(1, texts[2]), (5, texts[0]), (5, texts[1]), (5, texts[2]), (5, texts[1]), (6, texts[0]), (7, texts[3]), (7, texts[3])]
    kept = simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == sorted([(1, texts[2]), (5, texts[0]), (5, texts[1]), (7, texts[3])])


def test_codewords_solve_the_least_squares_problem():
    x = np.random.default_rng(9).normal(size=(500, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    quantiser = ann.Quantiser.fit(x, rounds=1)
    codes, parts = quantiser.assign(x), quantiser.cut(x)
    n, m, w = parts.shape
    z = np.zeros((n, m, ann.WORDS, w))
    z[np.arange(n)[:, None], np.arange(m)[None], codes] = parts
    z = z.reshape(n, -1)
    used = np.repeat(np.bincount((np.arange(m) * ann.WORDS + codes).ravel(), minlength=m * ann.WORDS), w)
    want = np.linalg.solve((quantiser.eta - 1) * z.T @ z + np.diag(used + 1e-6), quantiser.eta * z.sum(0))
    quantiser._refit(parts, codes, rounds=400)
    assert np.allclose(quantiser.books.ravel()[used > 0], want[used > 0], atol=1e-4)
