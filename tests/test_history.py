"""Compressed histories against plain walks over random graphs."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from notewell.operators import history as H
from notewell.operators import incremental as I


def random_graph(seed, n, width):
    """Commits 0..n-1 by age, each with one to three older parents, most of them the last of some branch; and their names, in no order."""
    rng = random.Random(seed)
    name = [f"{rng.getrandbits(40):010x}" for _ in range(n)]
    tips, edges = [0], []
    for i in range(1, n):
        at = rng.randrange(len(tips))
        parents = [tips[at]] + [rng.choice(tips) for _ in range(rng.choice((0, 0, 0, 1, 2)))]
        edges += [(i, p, k) for k, p in enumerate(dict.fromkeys(parents)) if p != i]
        if rng.random() < 0.15 and len(tips) < width:
            tips.append(i)
        else:
            tips[at] = i
    return name, edges


def reached(edges, start):
    by = defaultdict(list)
    for a, b, _ in edges:
        by[a].append(b)
    seen, todo = {start}, [start]
    while todo:
        for p in by[todo.pop()]:
            if p not in seen:
                seen.add(p)
                todo.append(p)
    return seen


@pytest.mark.parametrize("seed, n, width, block", [(1, 120, 6, 4096), (2, 200, 30, 4), (3, 150, 1, 8)])
def test_reach_equals_a_plain_walk(spark, monkeypatch, seed, n, width, block):
    monkeypatch.setattr(H, "BLOCK", block)
    name, edges = random_graph(seed, n, width)
    df = spark.createDataFrame([("o", name[a], name[b], k) for a, b, k in edges] + [("p", name[1], "other", 0), ("o", name[1], name[0], 0)], "origin string, sha string, parent string, nth int")
    starts = {f"s{i}": i for i in (0, 1, n // 3, n // 2, n - 2, n - 1)}
    asked = spark.createDataFrame([("o", k, name[i]) for k, i in starts.items()] + [("o", "both", name[n - 1]), ("o", "both", name[n // 2]), ("o", "none", "unknown")], "origin string, g string, sha string")
    history = H.History.of(df)
    # every commit has one place, and a chain's places have no gaps
    assert history.commits.where("origin = 'o'").count() == n
    per = history.commits.groupBy("origin", "chain").agg(F.count("*").alias("n"), F.max("pos").alias("top"), F.countDistinct("pos").alias("d"))
    assert per.where("n <> top + 1 OR d <> n").count() == 0
    reach = history.reach(asked, ["g"])
    assert sorted(map(tuple, history.reach(asked, ["g"], held=0).collect())) == sorted(map(tuple, reach.collect()))
    want = {k: {name[x] for x in reached(edges, i)} for k, i in starts.items()} | {"both": {name[x] for x in reached(edges, n - 1) | reached(edges, n // 2)}}
    got = defaultdict(set)
    for r in history.beyond(reach, reach.limit(0), ["g"]).collect():
        assert r.sha not in got[r.g]
        got[r.g].add(r.sha)
    assert got == want
    assert {(r.g, r.commits, r.first_sha) for r in history.summary(reach, ["g"]).collect()} == {(k, len(v), min(v)) for k, v in want.items()}
    # what one reaches beyond another, and what it holds
    ahead, base = (reach.where(F.col("g") == g).withColumn("g", F.lit("x")) for g in (f"s{n - 1}", f"s{n // 2}"))
    fresh = want[f"s{n - 1}"] - want[f"s{n // 2}"]
    assert {r.sha for r in history.beyond(ahead, base, ["g"]).collect()} == fresh
    some = spark.createDataFrame([("o", s, 1) for s in name[: n // 2]] + [("o", "unknown", 1)], "origin string, sha string, extra int")
    assert {r.sha for r in history.among(ahead, base, ["g"], some).collect()} == fresh & set(name[: n // 2])
    held = history.holds(reach, some.withColumn("g", F.lit(f"s{n - 2}")).select("origin", "g", "sha"), ["g"]).collect()
    assert {r.sha for r in held if r.held} == want[f"s{n - 2}"] & set(name[: n // 2]) and len(held) == n // 2 + 1


def test_history_of_nothing(spark):
    none = spark.createDataFrame([], "origin string, sha string, parent string")
    history = H.History.of(none, spark.createDataFrame([("o", "a"), ("o", None)], "origin string, sha string"))
    reach = history.reach(spark.createDataFrame([("o", "g", "a"), ("o", "h", "b")], "origin string, g string, sha string"), ["g"])
    assert [tuple(r) for r in reach.collect()] == [("o", "g", "a", 0)]
    assert history.summary(reach, ["g"]).first().commits == 1


@pytest.mark.parametrize("held", [0, 200_000])
def test_lines_give_the_same_history(spark, held):
    """Lines of any quality place all commits in one window; what is reached is that of the edges. Whole lines are never shuffled for a join by commit again."""
    rng = random.Random(7)
    name, edges = random_graph(7, 160, 12)
    main = {a: b for a, b, k in edges if k == 0}
    # lines that jump between branches, and a merged parent that no line lists
    lines = spark.createDataFrame([("o", i % 3 if rng.random() < 0.4 else 9, i, name[i], name[main[i]] if i in main else None) for i in range(160)], "origin string, line int, at int, sha string, parent string")
    merged = spark.createDataFrame([("o", name[a], name[b]) for a, b, k in edges if k] + [("o", name[159], "elsewhere"), ("o", name[3], None)], "origin string, sha string, parent string")
    starts = {f"s{i}": i for i in (0, 50, 120, 158, 159)}
    asked = spark.createDataFrame([("o", k, name[i]) for k, i in starts.items()] + [("o", "alone", "alone"), ("o", "none", "unknown")], "origin string, g string, sha string")
    history = H.History.of_lines(lines, merged, spark.createDataFrame([("o", "alone"), ("o", None)], "origin string, sha string"))
    assert history.commits.count() == 162 == history.commits.select("chain", "pos").distinct().count()
    reach = history.reach(asked, ["g"], held=held)
    want = {k: {name[x] for x in reached(edges, i)} for k, i in starts.items()} | {"alone": {"alone"}}
    want["s159"].add("elsewhere")
    got = defaultdict(set)
    for r in history.beyond(reach, reach.limit(0), ["g"]).collect():
        assert r.sha not in got[r.g]
        got[r.g].add(r.sha)
    assert got == want
    assert {(r.g, r.commits, r.first_sha) for r in history.summary(reach, ["g"]).collect()} == {(k, len(v), min(v)) for k, v in want.items()}
    plan = asked.join(history.commits.hint("merge"), ["origin", "sha"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("held", [0, 200_000])
def test_places_carry_days(spark, monkeypatch, held):
    """What is new is the same where places have the days with them, names of commits may be bytes, and only the places of new commits are dealt out for it: no commits by name again."""
    monkeypatch.setattr(H.History.reach, "__defaults__", (held,))
    sha = lambda x: x.encode() * 20
    days = {"a": 1, "b": None, "c": 9, "d": 3, "m": 8, "n": 20}
    named = [("o", 1, i, sha(x), sha("abc"[i - 1]) if i else None, days[x]) for i, x in enumerate("abcd")] + [("o", 2, 0, sha("m"), None, days["m"]), ("o", 2, 1, sha("n"), sha("m"), days["n"])]
    lines = spark.createDataFrame(named, "origin string, line int, at int, sha binary, parent binary, day int")
    merged = spark.createDataFrame([("o", sha("n"), sha("c")), ("o", sha("d"), sha("z"))], "origin string, sha binary, parent binary")
    history = H.History.of_lines(lines, merged)
    # a commit that no line lists has a place and no day; the names of chains are short
    places = {bytes(r.sha)[:1].decode(): (r.chain, r.pos, r.day) for r in history.commits.collect()}
    assert {k: v[1:] for k, v in places.items()} == {"a": (0, 1), "b": (1, None), "c": (2, 9), "d": (3, 3), "m": (0, 8), "n": (1, 20), "z": (0, None)}
    assert [places[x][0] for x in "adn"] == ["1:1", "1:1", "1:2"] and places["z"][0].startswith(H.ALONE)
    tips = spark.createDataFrame([("o", "x", sha("d")), ("o", "y", sha("n"))], "origin string, branch string, tip binary")
    marks = spark.createDataFrame([("o", "x", sha("a"))], "origin string, branch string, hwm binary")
    since = spark.createDataFrame([("o", "x", "commit", sha("a"), None, "mark"), ("o", "y", "date", None, 8, "examined")], "origin string, branch string, kind string, sha binary, since int, source string")
    reach, seen = I.reach_and_seen(history, tips, marks)
    got, asked = I.new_commits(history, reach, seen, None, since), I.new_commits(history, reach, seen, lines.select("origin", "sha", "day"), since)
    found = sorted((r.branch, bytes(r.sha)[:1].decode(), r.day, r.source) for r in got.collect())
    assert found == [("x", "b", None, "mark"), ("x", "c", 9, "mark"), ("x", "d", 3, "mark"), ("y", "c", 9, "examined"), ("y", "m", 8, "examined"), ("y", "n", 20, "examined")]
    assert sorted((r.branch, bytes(r.sha)[:1].decode(), r.day, r.source) for r in asked.collect()) == found
    assert "(sha#" not in got._jdf.queryExecution().optimizedPlan().toString() and "(sha#" in asked._jdf.queryExecution().optimizedPlan().toString()
    assert {r.branch: (bytes(r.first_sha), r.commits) for r in history.summary(reach, ["branch"]).collect()} == {"x": (sha("a"), 5), "y": (sha("a"), 5)}
