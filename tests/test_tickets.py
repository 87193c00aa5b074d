"""Ticket, branch and transcript lookups."""

import datetime as dt

from pyspark.sql import functions as F

from notewell.functions import text as T
from notewell.operators import incremental as I
from notewell.operators import tickets as K
from notewell.operators.history import History


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_statuses(spark):
    df = spark.createDataFrame([("a", "open"), ("b", None), ("c", "resolved"), ("d", "experimental"), ("e", "discarded")], "t string, status string")
    assert [r.t for r in K.open_tickets(df).orderBy("t").collect()] == ["a", "b", "d"]
    assert [r.t for r in df.where(K.may_capture(F.col("status"))).orderBy("t").collect()] == ["a", "b"]


def test_transcripts(spark):
    day = lambda d: dt.datetime(2026, 5, d)
    marks = spark.createDataFrame([("s1", "TOK1", day(10)), ("s2", "TOK2", day(10)), ("s3", "", day(10))], "session_id string, mark_token string, marked_at timestamp")
    logs = spark.createDataFrame([("b.jsonl", "x TOK1 y", day(10)), ("a.jsonl", "TOK1", day(10)), ("c.jsonl", "TOK2", day(8))], "path string, text string, mtime timestamp")
    assert rows(K.marked_transcripts(marks, logs)) == [("s1", "a.jsonl"), ("s2", None), ("s3", None)]
    files = spark.createDataFrame([("k", "a/b/k.jsonl"), ("k", "z/k.jsonl"), ("k", "y/k.jsonl")], "key string, path string")
    assert rows(K.shallowest(files, "key")) == [("k", "y/k.jsonl")]
    sessions = spark.createDataFrame([("s1", "/w/x"), ("s2", "/w/y"), ("s3", "/no")], "session_id string, cwd string")
    by_id = spark.createDataFrame([("s1", "p1")], "session_id string, path string")
    by_cwd = spark.createDataFrame([("-w-x", "other"), ("-w-y", "p2")], "folder string, path string")
    assert rows(K.session_transcripts(sessions, by_id, by_cwd)) == [("s1", "p1"), ("s2", "p2"), ("s3", None)]


def test_folders_and_merges(spark):
    folders = spark.createDataFrame([("f/1", "pay", "w/pay/f/1"), ("f/1", "led", "w/led/f/1"), ("f/2", "led", "w/led/f/2")], "branch string, project string, path string")
    asked = spark.createDataFrame([("f/1", "/src/pay"), ("f/2", "/src/none")], "branch string, cwd string")
    assert rows(K.folder_of_branch(asked, folders)) == [("f/1", "w/pay/f/1"), ("f/2", "w/led/f/2")]
    tips = spark.createDataFrame([("o", "b1", "t1"), ("o", "b2", "t2"), ("q", "b3", "t1")], "origin string, branch string, sha string")
    commits = spark.createDataFrame([("o", ["m0", "t1"]), ("o", ["t2"]), ("o", [])], "origin string, parents array<string>")
    assert [r.branch for r in K.merged_by_parent(tips, commits).collect()] == ["b1"]
    own = spark.createDataFrame([("o", "b1", "p1"), ("o", "b1", "p2"), ("o", "b2", "p1")], "origin string, branch string, patch_id string")
    base = spark.createDataFrame([("o", "p1"), ("o", "p1")], "origin string, patch_id string")
    assert rows(K.merged_by_patch(own, base)) == [("b1", 2, 1, False), ("b2", 1, 1, True)]
    day = lambda d: dt.date(2026, 1, d)
    edges = spark.createDataFrame([("o", "m1", "m0"), ("o", "x1", "m1"), ("o", "x2", "x1"), ("o", "y1", "m0"), ("o", "y2", "y1")], "origin string, sha string, parent string")
    commits = spark.createDataFrame([("o", s, day(d)) for s, d in (("m0", 1), ("m1", 2), ("x1", 18), ("x2", 19), ("y1", 3), ("y2", 4))], "origin string, sha string, day date")
    merged = spark.createDataFrame([("o", "x", "x2"), ("o", "y", "y2")], "origin string, branch string, tip string")
    bases = spark.createDataFrame([("o", "x", "m1")], "origin string, branch string, sha string")
    since = spark.createDataFrame([("o", "x", "date", None, day(1), "examined"), ("o", "y", "commit", "y1", None, "mark")], "origin string, branch string, kind string, sha string, since date, source string")
    history = History.of(edges)
    reach, seen = I.reach_and_seen(history, merged, since.where("sha IS NOT NULL").select("origin", "branch", F.col("sha").alias("hwm")))
    assert rows(K.landed(history, reach, seen, bases, since, commits).select("branch", "sha")) == [("x", "x1"), ("x", "x2"), ("y", "y2")]
    notes = spark.createDataFrame([("w/p/feat/1/Learnings/a.md",), ("w/p/Learnings/b.md",), ("w/p/t/Learnings/sub/c.md",)], "path string")
    indexes = spark.createDataFrame([("w/p/feat/1/_index.md",), ("w/p/t/_index.md",)], "path string")
    assert rows(K.nearest_index(notes, indexes)) == [("w/p/Learnings/b.md", None), ("w/p/feat/1/Learnings/a.md", "w/p/feat/1/_index.md"), ("w/p/t/Learnings/sub/c.md", "w/p/t/_index.md")]
    hits = spark.createDataFrame([("a", "w/p/Learnings/b.md", 0.5), ("a", "w/p/Learnings/b.md", 0.7), ("a", "w/p/t/_index.md", 0.9), ("w/p/Learnings/b.md", "w/p/Learnings/b.md", 1.0)], "path string, other string, score double")
    assert rows(K.best_per_neighbour(hits)) == [("a", "w/p/Learnings/b.md", 0.7)]


def test_gates_and_reads(spark):
    said = spark.createDataFrame([("capture", "RUN-COUNTS: adds=0 confirms=2 adjusts=0 refutes=0"), ("finalize", "RUN-COUNTS: adds=0 confirms=2 adjusts=0 refutes=0"), ("capture", "none"), ("capture", "COUNTS: adds=0 confirms=0 adjusts=0 refutes=0"), ("finalize", "COUNTS: adds=0 confirms=0 adjusts=0 refutes=0")], "kind string, x string")
    assert [r[0] for r in said.select(K.nothing_new(T.counts_marker(F.col("x")), F.col("kind"))).collect()] == [True, True, False, False, True]
    failures = spark.createDataFrame([(1, "https://h/a", "HTTP 403"), (1, "https://h/b", "HTTP 403"), (1, "https://i/a", "timeout"), (2, "https://h/b", "could not read Password"), (2, "https://k/b", "Permission denied (publickey)")], "run int, origin string, message string")
    assert rows(K.first_try_per_host(failures)) == [(1, "h", "https://h/a"), (2, "h", "https://h/b")]
    reads = spark.createDataFrame([("s", "v/Learnings/A.md", 10), ("s", "v/x.md", 5), ("t", "v/a.md", 7)], "session_id string, path string, tokens int")
    cited = spark.createDataFrame([("s", "w/a.md")], "session_id string, cited string")
    assert rows(K.cited_reads(reads, cited)) == [("s", 2, 15, 1, 10), ("t", 1, 7, 0, 0)]
    tickets = spark.createDataFrame([("d1", "T", None), ("d2", "", "open")], "ticket_dir string, title string, status string")
    learnings = spark.createDataFrame([("d1", "b.md"), ("d1", "a.md")], "ticket_dir string, path string")
    assert rows(K.ticket_block(tickets, learnings, ("title", "status"))) == [("d1", "title: T\n- a.md\n- b.md"), ("d2", "status: open")]
