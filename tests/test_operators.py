"""Operators on small tables with known answers."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from notewell.operators import incremental as I
from notewell.operators.history import History, is_ancestor, reachable_from
from notewell.operators import links as L
from notewell.operators import retrieval as R
from notewell.operators import sessions as S
from notewell.operators import twins as W


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


NOTES = [(1, "Retry the payment webhook with backoff"), (2, "Cache invalidation for the ledger service"), (3, "Webhook signature check: rotate the payment key"), (4, ""), (5, None)]


def test_bm25_against_formula(spark):
    docs = spark.createDataFrame(NOTES, "id int, text string")
    asked = spark.createDataFrame([(9, "payment webhook webhook"), (8, "nothing shared")], "q int, text string")
    got = {(r.query_id, r.id): r.bm25 for r in R.bm25(docs, "id", F.col("text"), asked, "q", F.col("text")).collect()}
    terms = {1: "retry payment webhook backoff".split(), 2: "cache invalidation ledger service".split(), 3: "webhook signature check rotate payment key".split(), 4: [], 5: []}
    mean = sum(map(len, terms.values())) / 5

    def score(d):
        s = 0
        for t, qtf in (("payment", 1), ("webhook", 2)):
            n, tf = sum(t in v for v in terms.values()), terms[d].count(t)
            s += qtf * math.log((5 - n + 0.5) / (n + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(terms[d]) / mean))
        return s

    assert set(got) == {(9, 1), (9, 3)} and all(abs(got[9, d] - score(d)) < 1e-9 for d in (1, 3))


def test_fuse_and_tier(spark):
    cos = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.5)], "query_id int, id int, cos double")
    lex = spark.createDataFrame([(1, 10, 4.0), (1, 12, 2.0)], "query_id int, id int, bm25 double")
    weight = spark.createDataFrame([(11, 0.0), (12, 0.4)], "id int, weight double")
    got = {r.id: (round(r.score, 9), r.provenance) for r in R.fuse(cos, lex, weight).collect()}
    assert got == {10: (0.93, "both"), 12: (0.06, "lexical")}
    tiers = spark.createDataFrame([(0.7,), (0.45,), (0.1,), (None,)], "s double").select(R.tier(F.col("s")))
    assert [r[0] for r in tiers.collect()] == ["high", "mid", "low", "none"]


def test_links(spark):
    notes = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c"), (5, "d")], "id int, name string")
    edges = spark.createDataFrame([(1, 0, "b"), (1, 1, "c"), (1, 2, "gone"), (2, 0, "d"), (4, 0, "a"), (5, 0, "d")], "src int, pos int, target string")
    resolved = L.resolve(edges, notes).cache()
    assert rows(resolved.select("src", "pos", "dst")) == rows(spark.createDataFrame([(1, 0, 2), (1, 1, 4), (1, 2, None), (2, 0, 5), (4, 0, 1), (5, 0, 5)]))
    ranked = spark.createDataFrame([(7, 1, 1), (7, 2, 2), (7, 4, 3)], "query_id int, id int, rank int")
    # a link that leads to no note keeps its own text
    assert rows(L.one_hop(ranked, resolved)) == [(7, "5", 2), (7, "gone", 1)]
    texts = spark.createDataFrame([(1, "a", "[[b]] [[x/c|see]] [[b]]" + "[[q]]" * 12 + "[[d]]"), (2, "b", "[[b]] [[d#part]]"), (3, "b", "[[b]]"), (4, "c", "[[dir/b]]"), (5, "d", None)], "id int, name string, body string")
    assert dict(rows(L.inbound(L.mentions(texts, "body"), texts))) == {1: 0, 2: 2, 3: 2, 4: 1, 5: 1}
    members = spark.createDataFrame([(1, 10, 0, 5), (1, 11, 2, 1), (1, 12, 2, 3), (1, 13, 2, 3)], "group int, id int, inbound int, length int")
    assert rows(L.keepers(members)) == [(1, 12, 4)]


def test_set_twins_are_exact(spark):
    rng = random.Random(5)
    base = [[f"t{rng.randrange(60)}" for _ in range(rng.randrange(1, 14))] for _ in range(30)]
    data = [(i, f"f{i % 3}", [t for t in base[i % 30] if rng.random() > 0.1] or ["x"]) for i in range(90)]
    got = {(r.a, r.b) for r in W.set_twins(spark.createDataFrame(data, "id int, folder string, terms array<string>")).collect()}
    first = {}
    for i, f, t in data:
        first.setdefault((f, frozenset(t)), i)
    want = set()
    for ((fa, ta), a), ((fb, tb), b) in itertools.combinations(first.items(), 2):
        score = len(ta & tb) / math.sqrt(len(ta) * len(tb))
        if score >= (0.72 if fa == fb else 0.80):
            want.add((min(a, b), max(a, b)))
    assert got == want and len(want) > 20


@pytest.mark.parametrize("block, named, counts", [(25, 7, 40), (300, 0, 1 << 22), (None, 1 << 18, 1 << 22)])
def test_set_twins_by_blocks(spark, monkeypatch, block, named, counts):
    """Sets of any size share frequent terms; blocks of any size find the same twins, and no join writes out the others."""
    monkeypatch.setattr(W, "NAMED", named)
    monkeypatch.setattr(W, "COUNTS", counts)
    rng = random.Random(8)
    base = [{f"t{int(rng.paretovariate(0.6)) % 90}" for _ in range(rng.choice((2, 9, 40, 120)))} for _ in range(25)]
    data = [(i, rng.choice(("x", "y", None)), sorted(t for t in base[i % 25] if rng.random() > 0.08)) for i in range(150)]
    first = {}
    for i, f, t in data:
        if t:
            first.setdefault((f, frozenset(t)), i)
    want = {}
    for ((fa, ta), a), ((fb, tb), b) in itertools.combinations(first.items(), 2):
        score = len(ta & tb) / math.sqrt(len(ta) * len(tb))
        if score >= (0.72 if fa == fb else 0.80):
            want[min(a, b), max(a, b)] = (fa == fb, round(score, 9))
    found = W.set_twins(spark.createDataFrame(data, "id int, folder string, terms array<string>"), block=block)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = [((r.a, r.b), (r.same, round(r.score, 9))) for r in found.collect()]
    assert len(got) == len(want) > 100 and dict(got) == want


def test_terms_are_made_once(spark):
    """Before, texts were read and cut once to count terms and once more for the sets."""
    made = spark.sparkContext.accumulator(0)

    def cut(text):
        made.add(1)
        return text.split()

    docs = spark.createDataFrame([(i, "f", f"a b c{i % 3} d e") for i in range(30)], "id int, folder string, text string").withColumn("terms", F.udf(cut, "array<string>")("text"))
    assert W.set_twins(docs).count() == 3 and made.value == 30


@pytest.mark.parametrize("shared, counts", [((1, 64), 1 << 20), ((3, 64), 300), ((9, 2), 5000)])
def test_set_twins_of_sparse_pairs(spark, monkeypatch, shared, counts):
    """Few of the pairs share a term of their prefixes, so tallies are far fewer than pairs; prefixes are those of the sizes that meet."""
    monkeypatch.setattr(W, "SHARED", shared)
    monkeypatch.setattr(W, "COUNTS", counts)
    rng = random.Random(3)
    base = [[f"t{int(rng.paretovariate(0.5))}" for _ in range(rng.choice((3, 20, 30, 60)))] for _ in range(250)]
    data = [(i, rng.choice(("x", "y", None)), sorted({t for t in base[i % 250] if rng.random() > 0.12})) for i in range(500)]
    first = {}
    for i, f, t in data:
        if t:
            first.setdefault((f, frozenset(t)), i)
    want = {}
    for ((fa, ta), a), ((fb, tb), b) in itertools.combinations(first.items(), 2):
        score = len(ta & tb) / math.sqrt(len(ta) * len(tb))
        if score >= (0.72 if fa == fb else 0.80):
            want[min(a, b), max(a, b)] = (fa == fb, round(score, 9))
    for block in (None, 900):
        got = W.set_twins(spark.createDataFrame(data, "id int, folder string, terms array<string>"), block=block).collect()
        assert len(got) == len(want) > 100 and {(r.a, r.b): (r.same, round(r.score, 9)) for r in got} == want


def test_packed_sets():
    rng = random.Random(2)
    sets = [sorted({rng.choice((-1, 1)) * rng.randrange(1 << rng.choice((3, 10, 18))) for _ in range(rng.randrange(1, 40))}) for _ in range(3000)] + [[0], [-1 << 63, -1], [(1 << 18) - 1]]
    flat, n = np.array([c for s in sets for c in s], np.int64), np.array([len(s) for s in sets])
    rare, packed = W._packed(flat, n)
    assert rare.tolist() == [sum(c < 0 for c in s) for s in sets]
    assert (W._unpacked(packed, n, rare) == flat).all() and (W._unpacked(pa.chunked_array([packed[5:900], packed[900:]]), n[5:], rare[5:]) == flat[n[:5].sum():]).all()
    assert len(W._unpacked(*(x[:0] for x in (packed, n, rare)))) == 0


@pytest.mark.parametrize("cap", [3, 35, 60, 900])
def test_a_report_joins_no_lower_scores_than_it_shows(spark, monkeypatch, cap):
    """Before, all twins were joined for the first few."""
    terms = [f"t{i}" for i in range(60)]
    data = [(i, "x", terms[: 60 - i]) for i in range(9)] + [(20 + i, "y", terms[i * 3: 59]) for i in range(7)] + [(40, None, terms), (41, None, terms[:45])]
    docs = spark.createDataFrame(data, "id int, folder string, terms array<string>")
    every = W.rank_twins(W.set_twins(docs).withColumn("score", F.round("score", 6)), cap).collect()
    asked, near = [], W._near
    monkeypatch.setattr(W, "STEPS", (0.97, 0.9))
    monkeypatch.setattr(W, "_near", lambda sets, across, inside, *a: asked.append(inside) or near(sets, across, inside, *a))
    top = W.rank_set_twins(docs, cap)
    assert sorted(map(tuple, top.select(every[0].__fields__).collect())) == sorted(map(tuple, every)) and len(every) <= cap
    found = [sum(r.same and r.score > t for r in every) >= cap for t in (0.97, 0.9)]
    assert asked == ([0.97] if found[0] else [0.97, 0.9] if found[1] else [0.97, 0.9, 0.72])


def test_vector_twins_thresholds(spark):
    unit = lambda a: [math.cos(a), math.sin(a)]
    data = [(1, "x", unit(0)), (2, "x", unit(math.acos(0.73))), (3, "y", unit(-math.acos(0.79))), (4, "y", unit(-math.acos(0.81)))]
    df = spark.createDataFrame(data, "id int, folder string, v array<double>")
    for block in (1, 100):
        assert {(r.a, r.b, r.same) for r in W.vector_twins(df, block=block).collect()} == {(1, 2, True), (1, 4, False), (3, 4, True)}


def test_only_late_rows_of_long_runs_are_folded(spark, monkeypatch):
    """Rows far apart and short runs are told apart by Spark alone; before, each run went through Python."""
    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    near = [(i, "k", at(i // 2 * 200 + i % 2 * 59)) for i in range(20)] + [(20, None, at(0)), (21, "k", None), (22, "k", None)]
    events = spark.createDataFrame(near, "id int, key string, ts timestamp")
    with monkeypatch.context() as m:
        m.setattr(S, "np", None)
        assert sorted(r.id for r in S.drop_repeats(events, ["key"], "ts", 60, "id").collect() if r.ts) == [*range(0, 20, 2), 20]
    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), at(rng.choice((rng.randrange(900), 5000 + rng.randrange(400), 9000)))) for i in range(300)]
    want, last = [], {}
    for i, k, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        if k not in last or (ts - last[k]).total_seconds() >= 60:
            last[k] = ts
            want.append(i)
    assert sorted(r.id for r in S.drop_repeats(spark.createDataFrame(rows, events.schema), ["key"], "ts", 60, "id").collect()) == sorted(want)


def test_snapshots_and_marks(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], "k int, s string")
    after = spark.createDataFrame([(1, "a"), (2, "x"), (3, None), (5, "e")], "k int, s string")
    assert rows(I.snapshot_diff(before, after, "k", "s")) == [(1, "skipped"), (2, "updated"), (3, "skipped"), (4, "removed"), (5, "added")]
    src = spark.createDataFrame([(1, "a", "a"), (2, "b", "b"), (3, "c\r", "c"), (4, "d", "d")], "k int, raw string, unix string")
    dst = spark.createDataFrame([(1, "a", "a"), (3, "c", "c"), (4, "x", "x"), (5, "e", "e")], "k int, raw string, unix string")
    assert rows(I.classify_deploy(src, dst, "k")) == [(1, "same"), (2, "new"), (3, "eol-only"), (4, "changed"), (5, "missing-src")]
    one = lambda *x: spark.createDataFrame([(v,) for v in x], "k string")
    assert rows(I.seal(one("A", "B"), one("B", "C"))) == [("A",)]
    assert rows(I.upsert(before, after, "k")) == rows(after.union(before.where("k = 4")))


def test_caps_canonical_offsets(spark):
    df = spark.createDataFrame([("c", i) for i in range(4)] + [("b", 9)], "class string, ts int")
    got = I.cap_and_defer(df, ["class"], [F.desc("ts")], F.when(F.col("class") == "c", 3).otherwise(1))
    assert [r.ts for r in got.where("deferred").collect()] == [0] and got.count() == 5
    clones = spark.createDataFrame([("o", "/long/path"), ("o", "/x"), (None, "/a"), (None, "/b")], "origin string, path string")
    assert rows(I.canonical(clones, "origin", [F.length("path"), F.col("path")])) == [("o", "/x"), (None, "/a"), (None, "/b")]
    lines = lambda *x: spark.createDataFrame(list(x), "k string, lines int")
    got = I.offset_ranges(lines(("a", 5), ("b", 2), ("c", 1)), lines(("a", 3), ("b", 4)), "k")
    assert rows(got) == [("a", 4, 5, 2, False), ("b", 5, 4, 0, True), ("c", 1, 1, 1, False)]
    names = spark.createDataFrame([("x", "o1"), ("x", "o1"), ("y", "o1"), ("y", "o2")], "name string, owner string")
    assert rows(I.unambiguous(names, "name", "owner")) == [("x", 1, "o1"), ("y", 2, None)]


def test_merges_and_reachability(spark):
    flags = spark.createDataFrame([(True, True, True), (False, True, True), (False, False, True), (False, False, False)], "a boolean, b boolean, c boolean")
    assert [r[0] for r in flags.select(I.merge_method(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["ancestor", "cherry", "patchid", "none"]
    assert [r[0] for r in flags.select(I.branch_state(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["merged", "open", "manual", "gone"]
    edges = spark.createDataFrame([("o", str(i), str(i - 1)) for i in range(1, 90)] + [("o", "88", "200"), ("o", "200", "3"), ("o", "200", "300"), ("p", "3", "99"), ("o", "5", None)], "origin string, sha string, parent string")
    got = reachable_from(edges, spark.createDataFrame([("o", "88")], "origin string, sha string"))
    assert {r.sha for r in got.collect()} == {*map(str, range(89)), "200", "300"} and got.count() == 91
    pairs = spark.createDataFrame([("o", "3", "88"), ("o", "89", "88"), ("o", "300", "88"), ("o", "88", "88"), ("o", "99", "88")], "origin string, old string, tip string")
    assert {r.old: r.ancestor for r in is_ancestor(pairs, edges).collect()} == {"3": True, "89": False, "300": True, "88": True, "99": False}
    assert reachable_from(edges, pairs.limit(0).select("origin", F.col("tip").alias("sha"))).count() == 0


def test_marks_and_windows(spark):
    day = lambda d: dt.date(2026, 1, d)
    # identifiers in no order: branch a is f -> 0 -> e -> 1, branch b was rewritten, branch c is new
    edges = spark.createDataFrame([("o", "0", "f"), ("o", "e", "0"), ("o", "1", "e"), ("o", "b2", "b1"), ("q", "c2", "c1")], "origin string, sha string, parent string")
    commits = spark.createDataFrame([("o", "f", day(1)), ("o", "0", day(2)), ("o", "e", day(3)), ("o", "1", day(2)), ("o", "b1", day(3)), ("o", "b2", day(9)), ("q", "c1", day(5)), ("q", "c2", day(15))], "origin string, sha string, day date")
    tips = spark.createDataFrame([("o", "a", "1"), ("o", "b", "b2"), ("q", "c", "c2")], "origin string, branch string, tip string")
    marks = spark.createDataFrame([("o", "a", "0"), ("o", "b", "zz")], "origin string, branch string, hwm string")
    examined = spark.createDataFrame([("o", day(8))], "origin string, last_examined date")
    history = History.of(edges, tips.select("origin", F.col("tip").alias("sha")))
    reach, seen = I.reach_and_seen(history, tips, marks)
    since = I.effective_since(tips, marks, examined, history, reach, F.lit(day(4)), F.lit(day(20)))
    assert rows(since.select("branch", "kind", "sha", "since", "source")) == [("a", "commit", "0", None, "mark"), ("b", "date", None, day(8), "examined"), ("c", "date", None, day(13), "capped")]
    assert rows(I.new_commits(history, reach, seen, commits, since).select("branch", "sha")) == [("a", "1"), ("a", "e"), ("b", "b2"), ("c", "c2")]
    days = tips.join(commits.withColumnRenamed("sha", "tip"), ["origin", "tip"])
    assert rows(I.skippable(days, marks.union(spark.createDataFrame([("q", "c", "c2")], marks.schema)), examined).select("branch", "skip")) == [("a", True), ("b", False), ("c", True)]


def test_flags_refs_and_traces(spark):
    marks = spark.createDataFrame([("s1", "x", True), ("s2", "x", True), ("s3", "y", True), ("s4", "z", None)], "session string, branch string, done boolean")
    assert rows(I.flagged(marks, "done")) == [("x",), ("y",)]
    assert rows(I.clear_flag(marks, spark.createDataFrame([("x",)], "branch string"), "done").select("session", "done")) == [("s1", False), ("s2", False), ("s3", True), ("s4", None)]
    refs = spark.createDataFrame([("o", "a"), ("o", "origin/a"), ("o", "b")], "origin string, ref string")
    assert rows(I.prefer_ref(refs)) == [("o", "a", "origin/a"), ("o", "b", "b")]
    heads = spark.createDataFrame([("o", "master", False), ("o", "main", True), ("p", "main", True)], "origin string, branch string, head boolean")
    assert rows(I.default_branch(heads, ["dev", "master"])) == [("o", "master"), ("p", "main")]
    notes = spark.createDataFrame([("a", "text\n"), ("b", "t\n\n## Audit\nold\n"), ("c", "t")], "path string, body string")
    traces = spark.createDataFrame([("a", "l1"), ("b", "l2")], "path string, line string")
    assert rows(I.audit_trace(notes, traces)) == [("a", "text\n\n## Audit\nl1\n"), ("b", "t\n\n## Audit\nold\nl2\n"), ("c", "t")]


def test_sessions(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "assistant", "early"), (1, 2, "user", "u1"), (1, 3, "assistant", "a1"), (1, 4, "assistant", "a2"), (1, 5, "tool", "t"), (1, 6, "user", None)]
    got = S.turn_pairs(spark.createDataFrame(turns + [(1, 7, "user", ""), (1, 8, "user", "u3"), (2, 0, "user", None)], "conv_id int, turn int, role string, text string"))
    assert rows(got) == [(1, 0, 0, 5, "ASSISTANT:\nearly"), (1, 1, 2, 5, "USER:\nu1\nASSISTANT:\na1\na2"), (1, 2, 2, 0, "USER:\nu3")]
    events = spark.createDataFrame([(i, "k", 50 * i) for i in range(6)] + [(6, "k", 10_000), (7, "z", 1), (8, "z", 1), (9, None, 5)], "id int, key string, s int").withColumn("ts", F.timestamp_seconds("s"))
    # measured from the last row that was kept, so a steady repeat comes through now and then
    assert [r.id for r in S.drop_repeats(events, ["key"], "ts", 60, "id").orderBy("id").collect()] == [0, 2, 4, 6, 7, 9]
    events = events.where("id IN (0, 1, 2, 7)").union(spark.createDataFrame([(4, "k", 161)], "id int, key string, s int").withColumn("ts", F.timestamp_seconds("s")))
    assert rows(S.sessions_by_gap(events, "key", "ts", 1, "id").select("key", "session", "events")) == [("k", 1, 3), ("k", 2, 1), ("z", 1, 1)]


def test_budget_and_hits(spark):
    df = spark.createDataFrame([("g", i, 10) for i in range(5)], "g string, i int, n int")
    assert R.budget(df, ["g"], [F.col("i")], F.col("n"), 30).count() == 3
    ranked = spark.createDataFrame([(1, 10, 1), (2, 20, 3)], "query_id int, id int, rank int")
    truth = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (3, 30)], "query_id int, id int")
    assert rows(R.hit_at_k(ranked, truth)) == [(3, 1, 2, 2)]


def test_containing(spark):
    texts = spark.createDataFrame([(1, "so it is: one two three four five six, yes"), (2, "xone two three four five sixy"), (3, "one two  three four five six"), (4, "two three four"), (5, None), (6, ""), (1, "again one two three four five six")], "id int, text string")
    passages = spark.createDataFrame([(7, "one two three four five six"), (8, "three four"), (9, "two\tthree four five six seven"), (10, "e t")], "query_id int, passage string")
    want = [(q, i) for i, t in texts.collect() for q, p in passages.collect() if t and p in t]
    assert rows(R.containing(texts, passages)) == sorted(want, key=repr) and len(want) == 12


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "ROWS", 20)
    monkeypatch.setattr(R, "QUERIES", 3)
    rng = random.Random(1)
    v = {i: [rng.choice((0.0, 0.5, 1.0)) for _ in range(4)] for i in range(70)}
    rows_ = spark.createDataFrame([(i, x, i % 3) for i, x in v.items()] + [(99, None, 1)], "id int, v array<double>, kind int")
    asked = rows_.where("id % 7 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"), "kind")
    for within in (None, "kind"):
        want = []
        for q in range(0, 70, 7):
            scores = sorted((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in v if i != q and (within is None or i % 3 == q % 3))[:4]
            want += [(q, i, -s, n + 1) for n, (s, i) in enumerate(scores)]
        assert rows(R.nearest(rows_, asked, 4, within)) == sorted(want, key=repr)


@pytest.mark.parametrize("block", [16, 4096])
def test_vector_twins_of_clusters(spark, block):
    """Clusters, a large group of near copies, a line and noise: nothing is lost, and most pairs never meet."""
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    around = unit(rng.normal(size=(12, 16)))
    v = np.r_[*(unit(c + rng.normal(size=(40, 16)) * 0.08) for c in around), unit(around[0] + rng.normal(size=(150, 16)) * 0.001), unit(rng.normal(size=(40, 16))), around[:1], around[:1]]
    folder = rng.integers(0, 3, len(v))
    df = spark.createDataFrame([(i, int(f), [float(c) for c in x]) for i, (f, x) in enumerate(zip(folder, v))] + [(9999, 0, None)], "id long, folder int, v array<double>")
    got = {(r.a, r.b): r.same for r in W.vector_twins(df, block=block).collect()}
    score = v @ v.T
    want = {(i, j): bool(folder[i] == folder[j]) for i in range(len(v)) for j in range(i + 1, len(v)) if abs(score[i, j] - (t := 0.72 if folder[i] == folder[j] else 0.80)) > 1e-9 and score[i, j] >= t}
    assert got == want
    assert W.vector_twins(df, block=block).count() == len(want)
    assert W.pair_share(df, 0.72, block) < 0.35 and W.vector_twins(df.limit(0)).count() == 0


def test_vector_twins_of_a_wide_angle_are_sent_to_shelves(spark):
    """Without structure and at a low threshold nearly all pairs meet: a vector goes once to each shelf, not to each cell, and the pairs are those of brute force."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(1500, 12))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, None if i % 3 else "f", [float(c) for c in x]) for i, x in enumerate(v)], "id long, folder string, v array<double>")
    balls, block = W.fit_balls(df, 0.35, 200)
    row = balls.shelves(v, np.arange(len(v)))[1]
    assert block == 200 and len(balls.visitors) < len(balls.low) / 10 and np.bincount(row).max() < len(balls.visitors) <= 2 * len(v) / block + 1
    score, kind = v @ v.T, np.arange(len(v)) % 3 == 0
    want = np.triu(score >= np.where(kind[:, None] == kind[None], 0.45, 0.5), 1)
    got = W.vector_twins(df, 0.5, 0.45, 200).select("a", "b").collect()
    assert {tuple(r) for r in got} == set(zip(*map(np.ndarray.tolist, np.nonzero(want)))) and len(got) == want.sum() > 1000


@pytest.mark.parametrize("block", [7, 100])
def test_best_within_blocks(spark, block):
    rng = random.Random(2)
    data = [(i, rng.choice(("a", "b", None)), i % 3, None if i % 11 == 0 else [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)] + [(100, "lone", 1, [1.0] * 4), (101, "dark", 1, None), (102, "dark", 2, [1.0] * 4)]
    want = {}
    for (i, w, k, v), (j, u, _, x) in itertools.permutations(data, 2):
        if w is not None and w == u and i < j:
            score = None if v is None or x is None else sum(a * b for a, b in zip(v, x))
            want[w, k] = max((s for s in (want.get((w, k)), score) if s is not None), default=None)
    got = {(r.w, r.k): r.score for r in R.best_within(spark.createDataFrame(data, "id long, w string, k int, v array<double>"), "w", "k", block).collect()}
    assert got.keys() == want.keys() and got["dark", 1] is None and all(got[x] == pytest.approx(want[x]) for x in want)


def test_pieces_hold_few_words():
    """A batch of many words is counted in parts, and a long text is one of its own."""
    import pyarrow as pa

    sizes = [3, 0, 4, 20, 1, 1, 0, 9, 2]
    b = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array([["w"] * n for n in sizes], pa.list_(pa.string()))], ["id", "terms"])
    for part in (b, b.slice(2)):
        got = list(R.pieces(part, 1, 8))
        assert pa.Table.from_batches(got) == pa.Table.from_batches([part]) and all(x.num_rows == 1 or len(x.column(1).flatten()) <= 8 for x in got)


def test_bm25_top_equals_ranking_all_pairs(spark, monkeypatch):
    """Scored piece by piece with bounded lists: copies tie to the smaller id, weights count, and a weight of 0 is out."""
    monkeypatch.setattr(R, "SCORED", 60)
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(30)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 12))) for _ in range(60)] + ["word1 word2 the word3"] * 25 + [None, "the of"]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, (1.0, 0.4, 0.0)[i % 3]) for i, t in enumerate(texts)], "id long, text string, weight double")
    asked = spark.createDataFrame([(1, "word1 word2 word1"), (2, "word7 word8 nothing"), (3, "nothing"), (4, None), (5, " ".join(vocabulary))], "query_id long, text string")
    every = R.bm25(docs, "id", F.col("text"), asked, "query_id", F.col("text")).join(docs.select("id", "weight"), "id")
    every = every.select("query_id", "id", F.round(F.round("bm25", 6) * F.col("weight"), 6).alias("bm25")).where("bm25 > 0")
    for k in (4, 40):
        want = rows(R.top_k(every, "bm25", k).select("query_id", "id", "bm25"))
        assert rows(R.bm25_top(docs.select("id", "text"), docs.select("id", "weight"), asked, k)) == want and len(want) > 2 * k
