"""The whole vault over a small note tree, and the hooks."""

import datetime

import pytest
from pyspark.sql import functions as F

from notewell.api import Vault
from notewell.operators import hooks as H
from notewell.sources.notes import read_notes


@pytest.fixture(scope="module")
def vault(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("vault")
    for path, text in {
        "ws/Learnings/commit-style.md": "---\ntags: [git]\ndescription: subject lines are short\n---\nbody [[token-expiry]] [[nowhere]]",
        "ws/gateway/Learnings/rate-limit.md": "---\ntags:\n  - auth\n---\n# Limits\nburst of requests is cut at the edge",
        "ws/gateway/feat/7-login/_index.md": "---\ntitle: Login\nstatus: resolved\nresolved: 2026-05-10\n---\n",
        "ws/gateway/feat/7-login/Learnings/token-expiry.md": "---\ntags: [auth]\ndescription: expiry of refresh tokens after rotation\n---\n" + "long " * 400 + "[[rate-limit]]",
        "ws/gateway/feat/8-cache/_index.md": "---\nstatus: open\nlast_update: 2026-04-05\n---\n",
        "ws/gateway/feat/9-dead/_index.md": "---\nstatus: discarded\n---\n",
        "ws/gateway/feat/9-dead/Learnings/old.md": "---\ndescription: expiry of refresh tokens, abandoned idea\n---\nx",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return Vault(read_notes(spark, str(root)).cache())


def names(df):
    return [r.id.split("/")[-1] for r in df.orderBy("query_id", "rank").collect()]


def test_search_and_context(spark, vault):
    asked = spark.createDataFrame([(1, "refresh tokens expiry rotation"), (2, "zebra")], "query_id int, query string")
    assert names(vault.search(asked)) == ["token-expiry.md"]
    vectors = vault.notes.select("path", F.when(F.col("name") == "rate-limit", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("v"))
    hybrid = Vault(vault.notes, vectors)
    asked = spark.createDataFrame([(1, "refresh tokens expiry rotation", [0.0, 1.0])], "query_id int, query string, q array<double>")
    top = hybrid.search(asked).orderBy("rank").collect()
    assert top[0].id.endswith("token-expiry.md") and top[0].tier == "high" and abs(top[0].score - 1.0) < 1e-9
    assert not any("old.md" in r.id for r in top)
    (block,) = hybrid.context(asked, 2).collect()
    assert "token-expiry.md]] (score=1.00)" in block.block and "[...truncated]" in block.block and "related [[ws/gateway/Learnings/rate-limit.md]]" in block.block


def test_read_mark_reindex(spark, vault):
    wanted = spark.createDataFrame([("ws/Learnings/commit-style.md",), ("../../etc/passwd",)], "path string")
    assert [r.name for r in vault.read(wanted).collect()] == ["commit-style"]
    one = spark.createDataFrame([("s/1", "feat/x")], "session_id string, branch string")
    vault.mark(one)
    assert [tuple(r) for r in vault.mark(one.withColumn("branch", F.lit("feat/y"))).collect()] == [("s1", "feat/y")]
    old = vault.notes.limit(0).select("path", "sha").union(spark.createDataFrame([("gone.md", "1"), ("ws/Learnings/commit-style.md", "other")], "path string, sha string"))
    actions = {r.path: r.action for r in vault.reindex(old).collect()}
    assert actions["gone.md"] == "removed" and actions["ws/Learnings/commit-style.md"] == "updated" and actions["ws/gateway/Learnings/rate-limit.md"] == "added"


def test_index_version_and_recheck(spark, vault):
    index = vault.notes.where(F.length("body") > 0).select("path", "sha", F.lit("1").alias("version"))
    assert {r.action for r in vault.reindex(index).collect()} == {"skipped"}
    assert {r.action for r in vault.reindex(index, version="2").collect()} == {"updated"}
    mine, asked = Vault(vault.notes.limit(1)), []
    load = lambda: asked.append(1) or vault.notes.limit(len(asked))
    assert mine.recheck(load) and not mine.recheck(load) and mine.recheck(load, 0) and len(asked) == 2 and mine.notes.count() == 2


def test_dashboard(spark, vault):
    got = {(r.kind, r.key): r.n for r in vault.overview().collect()}
    assert got["learnings", ""] == 4 and got["tickets", ""] == 3 and got["status", "resolved"] == 1 and got["project", "gateway"] == 3
    assert got["tag", "auth"] == 2 and got["month", "2026-05"] == 1
    assert [r.name for r in vault.list(q="expiry").collect()] == ["token-expiry", "old"]
    assert vault.list(project="gateway").count() == 3 and vault.list(scope="ticket", tag="auth").count() == 1
    assert vault.stats().where("scope IS NULL AND project IS NULL").agg(F.max("n")).first()[0] == 7
    vault.runs = spark.createDataFrame([(datetime.datetime(2026, 1, d),) for d in (1, 2, 3)], "ts timestamp")
    assert [r.ts.day for r in vault.history(2).collect()] == [3, 2]


def test_capture(spark, vault):
    day = lambda d: datetime.date(2026, 1, d)
    edges = spark.createDataFrame([("o", "9a", "f0"), ("o", "1c", "9a"), ("o", "77", "f0")], "origin string, sha string, parent string")
    commits = spark.createDataFrame([("o", s, day(2)) for s in ("f0", "9a", "1c", "77")], "origin string, sha string, day date")
    tips = spark.createDataFrame([("o", "feat/7-login", "77"), ("o", "feat/8-cache", "1c")], "origin string, branch string, tip string")
    marks = spark.createDataFrame([("o", "feat/8-cache", "9a")], "origin string, branch string, hwm string")
    examined = spark.createDataFrame([], "origin string, last_examined date")
    found = lambda **k: sorted((r.branch, r.sha, r.deferred) for r in vault.capture(tips, commits, edges, marks, examined, F.lit(day(1)), F.lit(day(4)), **k).collect())
    assert found() == [("feat/8-cache", "1c", False)]
    assert len(found(include_resolved=True, ignore_marks=True)) == 5
    assert {r.id.split("/")[-1]: r.inbound for r in vault.inbound().collect()}["rate-limit.md"] == 1


def test_hooks(spark):
    df = spark.createDataFrame([(1, "ab", "g"), (2, None, "g"), (3, "abcd", "h")], "id int, text string, grp string")
    lengths = lambda: lambda texts: [len(t or "") for t in texts]
    assert [r.n_tokens for r in H.count_tokens(df, "text", lengths).orderBy("id").collect()] == [2, 0, 4]
    assert [r.n_tokens for r in H.count_tokens(df, "text").orderBy("id").collect()] == [1, 1, 1]
    assert [r.embedding for r in H.embed(df, "text", lambda: lambda texts: [[float(len(t or ""))] for t in texts]).orderBy("id").collect()] == [[2.0], [0.0], [4.0]]
    judged = H.judge(df, F.col("text"), lambda: lambda p: ["VERDICT: drop\nCONFIDENCE: " + ("high" if x else "low") for x in p])
    assert [r[0] for r in judged.orderBy("id").select(H.ablation_policy(F.col("verdict"), F.col("confidence"))).collect()] == ["drop", "keep", "drop"]
    done = H.consolidate(df, "grp", "text", "id", lambda texts: [f"<{t}>" for t in texts], lambda texts: [t.upper() for t in texts], chunk=200)
    assert {(r.grp, r.summary, r.overall) for r in done.collect()} == {("g", "<<ab>>", "<<AB>>\n<<ABCD>>"), ("h", "<<abcd>>", "<<AB>>\n<<ABCD>>")}
    many = spark.range(50).select("id", (F.col("id") % 9).alias("grp"), F.col("id").cast("string").alias("text"))
    longest = lambda texts: [str(max(t.count("\n") for t in [x]) + 1) for x in texts]
    assert all(int(r.overall) <= 4 and int(r.summary) <= 4 for r in H.consolidate(many, "grp", "text", "id", longest, longest, chunk=4).collect())
