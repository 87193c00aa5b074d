"""Sources over files of our own, and streams against batch totals."""

import gzip
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from notewell.functions import text as T
from notewell.operators import sessions as S
from notewell.sources import notes as N
from notewell.streaming import counters as C
from notewell.streaming import state


def write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_read_notes(spark, tmp_path):
    write(tmp_path, {
        "ws/Learnings/rule.md": "---\nname: rule\ntags: [auth, web]\n---\nSee [[gateway|the gate]].\n",
        "ws/gateway/Learnings/limits.md": "# Limits\nA burst is cut.\n",
        "ws/gateway/feat/7/_index.md": "---\ntítulo: Seven\nstatus: resolved\nopened: 2026-04-01\nresolved: 2026-05-10\n---\n",
        "ws/gateway/feat/7/Learnings/token.md": "---\ndescription: expiry of tokens\n---\nbody",
        "ws/gateway/feat/7/Learnings/own.md": b"---\nstatus: experimental\n---\nbad \xff byte",
        "ws/.trash/x/Learnings/gone.md": "x", "ws/gateway/readme.md": "no scope", "ws/gateway/Learnings/a.txt": "no note"})
    got = {r.path: r for r in N.read_notes(spark, str(tmp_path)).collect()}
    assert {p: r.scope for p, r in got.items()} == {
        "ws/Learnings/rule.md": "workspace", "ws/gateway/Learnings/limits.md": "project", "ws/gateway/feat/7/_index.md": "index",
        "ws/gateway/feat/7/Learnings/token.md": "ticket", "ws/gateway/feat/7/Learnings/own.md": "ticket"}
    rule, token = got["ws/Learnings/rule.md"], got["ws/gateway/feat/7/Learnings/token.md"]
    assert (rule.name, rule.tags, rule.links, rule.project, rule.status) == ("rule", ["auth", "web"], ["gateway"], None, "")
    assert (token.status, str(token.authored), token.description, token.name) == ("resolved", "2026-05-10", "expiry of tokens", "token")
    assert got["ws/gateway/feat/7/Learnings/own.md"].status == "experimental"
    assert got["ws/gateway/feat/7/_index.md"].title == "Seven" and got["ws/gateway/Learnings/limits.md"].description == "A burst is cut."


def test_underscored_files_of_any_scheme(spark, tmp_path):
    write(tmp_path, {"a/_index.md": "x", "a/b/c/_index.md": "y", "a/b/_other.md": "n", ".git/_index.md": "n"})
    for root in (str(tmp_path), f"file://{tmp_path}"):
        assert sorted(bytes(r.content).decode() for r in N.underscored_files(spark, root).collect()) == ["x", "y"]
        assert [r.name for r in N.read_notes(spark, root).select("name").collect()] == ["_index"]
    assert N.underscored_files(spark, str(tmp_path / "a/b/c")).count() == 1


def test_index_at_any_depth(spark, tmp_path):
    """A ticket's index counts however deep it lies, and its notes take its status."""
    folder = "ws/p/" + "/".join(f"d{i}" for i in range(9))
    write(tmp_path, {f"{folder}/_index.md": "---\nstatus: resolved\n---\n", f"{folder}/Learnings/a.md": "text"})
    assert {r.name: r.status for r in N.read_notes(spark, str(tmp_path)).collect()} == {"_index": "resolved", "a": "resolved"}


def test_readme_example(spark, tmp_path, capsys):
    write(tmp_path, {"ws/Learnings/tokens.md": "---\ndescription: expiry of refresh tokens\n---\n", "ws/p/Learnings/other.md": "---\ndescription: colours of the lamp\n---\n"})
    code = (Path(__file__).parents[1] / "README.md").read_text().split("```python\n")[1].split("```")[0]
    exec(code.replace("file:///data/vault", f"file://{tmp_path}"), {})
    assert "ws/Learnings/toke" in capsys.readouterr().out


def test_json_lines_and_transcripts(spark, tmp_path):
    lines = [json.dumps({"timestamp": "1", "item": {"type": "message", "role": "user", "content": c}}) for c in ("plain", [{"type": "text", "text": "a"}, {"type": "tool_use", "name": "grep"}, {"type": "tool_result", "content": "z" * 900}])]
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.jsonl").write_text("\n".join([*lines, "", "{broken"]))
    with gzip.open(tmp_path / "log/b.jsonl.gz", "wt") as f:
        f.write(lines[0])
    got = sorted(r.text for r in N.read_transcripts(spark, str(tmp_path / "log")).collect())
    assert got == ["a\n[tool_use:grep]\n[tool_result]: " + "z" * 400, "plain", "plain"]
    write(tmp_path, {"marks/1.json": '{"session_id": "s1", "branch": "feat/x"}', "marks/2.json": "{nope"})
    assert [r.branch for r in N.read_marks(spark, str(tmp_path / "marks")).collect()] == ["feat/x"]
    write(tmp_path, {"log.tsv": "abc\t2026-01-01\tfirst: thing\n"})
    assert tuple(N.read_commits(spark, str(tmp_path / "log.tsv")).first()) == ("abc", "2026-01-01", "first: thing")


def test_context_block_and_status(spark):
    rows = spark.createDataFrame([(1, i, "x" * 9) for i in range(5)] + [(2, 0, "y")], "q int, rank int, line string")
    got = {r.q: r.block for r in N.context_block(rows, "q", "rank", "line", 30).collect()}
    assert got == {1: "\n".join(["x" * 9] * 3) + "\n[...truncated]", 2: "y"}
    notes = spark.createDataFrame([("a", "open"), ("b", None)], "path string, status string")
    assert {tuple(r) for r in N.set_status(notes, spark.createDataFrame([("b", "resolved")], "path string, status string")).collect()} == {("a", "open"), ("b", "resolved")}


def test_streams_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: C.event_stream(spark, str(tmp_path / "in"))
    got = C.run_available(C.session_totals(stream()), str(tmp_path / "c1"))
    want = C.session_totals(events)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    state = C.run_available(C.keyed_state(stream()), str(tmp_path / "c2"), "update").groupBy("user_id").agg(F.max("total").alias("n"))
    assert {tuple(r) for r in state.collect()} == {tuple(r) for r in events.groupBy("user_id").count().collect()}


def test_gate_repeats_incomplete_batches(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(tmp_path / "in"))
    source = lambda: C.event_stream(spark, str(tmp_path / "in"))
    with pytest.raises(Exception):
        C.gated_capture(source(), str(tmp_path / "out"), str(tmp_path / "ck"), lambda batch: False)
    assert not (tmp_path / "out").exists()
    C.gated_capture(source(), str(tmp_path / "out"), str(tmp_path / "ck"), lambda batch: True)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1000


@pytest.mark.parametrize("batches", [1, 4])
def test_suppress_repeats(spark, tmp_path, batches):
    """A repeat is less than the time to live after the last row that was kept, however the stream is cut."""
    data = [("a", s) for s in (0, 30, 59, 61, 100, 3600, 7200, 7259)] + [("b", 10), (None, 20), (None, 70), (None, 81)]
    rows = spark.createDataFrame([(1, k, s, i) for i, (k, s) in enumerate(data)], "session int, k string, s int, n long").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000))
    for part in range(batches):
        lo, hi = (part * 8000 // batches, (part + 1) * 8000 // batches)
        rows.where((F.col("s") >= lo) & (F.col("s") < hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with state.rocks(spark):
        got = C.run_available(state.suppress_repeats(stream, "session", "k", "n"), str(tmp_path / "c"), "append").collect()
    want = S.drop_repeats(rows, ["session", "k"], "ts", 60, "n").collect()
    assert sorted(r.n for r in got) == sorted(r.n for r in want) == [0, 3, 5, 6, 8, 9, 11]
    assert spark.conf.get(state.STORE, None) != state.ROCKS


def test_silent_keys_are_forgotten():
    """A timer drops what has been silent for the purge time, and nothing younger."""
    import pandas as pd

    class Map(dict):
        def iterator(self):
            return iter(list(self.items()))

        def updateValue(self, k, v):  # noqa: N802
            self[k] = v

        removeKey = dict.pop  # noqa: N815

    class Handle:
        def __init__(self):
            self.timers, self.map = [], Map()

        def getMapState(self, *_):  # noqa: N802
            return self.map

        def registerTimer(self, at):  # noqa: N802
            self.timers.append(at)

    class Now:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.ms

    handle, repeats = Handle(), state.Repeats(60_000_000, 600_000)
    repeats.init(handle)
    frame = pd.DataFrame({"session": [1, 1], "ts": [0, 0], "key_": ["a", "b"], "us_": [0, 400_000_000], "order_": [1, 2]})
    assert len(next(repeats.handleInputRows((1,), iter([frame]), None))) == 2 and handle.timers == [1_000_000]
    list(repeats.handleExpiredTimer((1,), Now(700_000), None))
    assert set(handle.map) == {("b",)}
    assert list(repeats.handleInputRows((1,), iter([frame.iloc[:0]]), None)) == []


def test_sections_and_citations(spark):
    text = "<vault-context>\n## Top matches (2)\n- [[w/Note-A.md|x]]\n  ### Body excerpt of\nabc\n\n## Top matches again\nRead body: [[note-a#p]] [[ ]]\n</vault-context>"
    got = spark.createDataFrame([(1, text), (2, ""), (3, "plain")], "i int, t string").select("i", T.section_tokens(F.col("t")).alias("s"), T.cited_keys(F.col("t")).alias("c")).orderBy("i").collect()
    size = lambda *lines: max(1, len("".join(lines).encode()) // 4)
    assert got[0].s == {"header": size("<vault-context>\n"), "matches": size("## Top matches (2)\n- [[w/Note-A.md|x]]\n", "## Top matches again\n"),
                        "body_excerpt": size("  ### Body excerpt of\nabc\n\n"), "footer": size("Read body: [[note-a#p]] [[ ]]\n</vault-context>")}
    assert got[0].c == ["note-a"] and got[1].s == {} and got[2].s == {"header": 1}


class Store:
    """A handle of one key's state that counts how often the store is asked."""

    def __init__(self):
        self.asked, self.value = 0, None

    def getValueState(self, name, schema):  # noqa: N802
        return self

    getMapState = getListState = getValueState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        pass

    def __getattr__(self, name):
        def access(*value):
            self.asked += 1
            if name == "update":
                self.value = value[0]
            return {"get": self.value, "exists": self.value is not None}.get(name, [])

        return access


def test_state_is_one_read_and_one_write_a_batch():
    """However many keys, tiers and sections a session has."""
    from types import SimpleNamespace

    import pandas as pd

    seen = pd.DataFrame({"us": range(40), "ord": range(40), "tier": [f"t{i % 8}" for i in range(40)], "tokens": [2] * 40, "sections": [{f"s{i}": 1} for i in range(40)], "cited": [[f"k{i}"] for i in range(40)]})
    shown, store = state.Shown(), Store()
    shown.init(store)
    for nth in (1, 2):
        last = list(shown.handleInputRows(("s",), iter([seen]), None))[-1]
        assert store.asked == 2 * nth and last["prompts"][0] == 40 * nth and last["total"][0] == 80 * nth
    assert len(last["cited"][0].split(",")) == 40 and last["recent"][0] == "2,2,2,2,2"
    rows = pd.DataFrame({"session": ["s"] * 30, "ts": pd.Timestamp(0), "key_": [f"k{i}" for i in range(30)], "us_": range(30), "order_": range(30)})
    repeats, store = state.Repeats(1_000_000, 2000), Store()
    repeats.init(store)
    assert [len(list(repeats.handleInputRows(("s",), iter([rows]), None))[0]) for _ in range(2)] == [30, 0] and store.asked == 3
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 10_000)
    list(repeats.handleExpiredTimer(("s",), now, None))
    assert store.asked == 5


def test_a_block_of_sessions_is_one_state():
    """Before, each session was a key of its own, which costs some milliseconds a batch whatever it holds."""
    import pandas as pd

    shown, store = state.Shown(), Store()
    shown.init(store)
    names = ["=a", "", "=b"] * 20
    seen = pd.DataFrame({"session": names, "us": range(60), "ord": range(60), "tier": ["t"] * 30 + [None] * 30, "tokens": range(60), "sections": [{"header": 1}] * 60, "cited": [["k"], [], ["é"]] * 20})
    for nth in (1, 2):
        last = list(shown.handleInputRows((7,), iter([seen, seen]), None))
        assert store.asked == 2 * nth and len(last) == 1 and list(last[0]["session"]) == ["=a", "", "=b"]
    assert list(last[0]["prompts"]) == [80] * 3 and list(last[0]["recent"]) == ["54,57,57,57,57", "55,58,58,58,58", "56,59,59,59,59"] and list(last[0]["cited"]) == ["k", "", "é"] and last[0]["by_tier"][0] == '{"null":40,"t":40}'
    assert list(shown.handleInputRows((7,), iter([]), None)) == []
    one = list(shown.handleInputRows((7,), iter([seen.iloc[:1]]), None))[-1]
    assert list(one["session"]) == ["=a"] and list(one["prompts"]) == [81]


def test_parts_of_a_stream_are_many_files(spark, tmp_path, monkeypatch):
    """Before, a part was one file of one group of rows, so a single task read it."""
    from notewell.plans import telemetry as P

    monkeypatch.setattr(P, "FILE_ROWS", 50)
    events = spark.range(0, 1000, 1, 3).select(F.col("id").alias("event_id"), F.timestamp_micros(F.col("id") * 1_000_000).alias("ts"), (F.col("id") % 7).alias("user_id"))
    stream = P.in_batches(spark, events, str(tmp_path / "in"))
    seen = []
    stream.writeStream.foreachBatch(lambda b, i: seen.append(b.withColumn("f", F.input_file_name()).agg(F.count("*"), F.min("event_id"), F.max("event_id"), F.count_distinct("f")).first())).option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 4 and sum(x[0] for x in seen) == 1000 and all(a[2] < b[1] for a, b in zip(seen, seen[1:])) and {x[3] for x in seen} == {5}


def test_sessions_come_back_as_they_were(spark, tmp_path):
    """Null sessions and tiers, and more sessions than blocks, in one batch and in several."""
    rows = [(i % 5 or None, i, i, None if i % 3 else "hi", "<vault-context>\n## Top matches\n[[N%d.md]]" % (i % 2)) for i in range(60)]
    for n in (1, 3):
        path = str(tmp_path / f"in{n}")
        # 40 bytes each, which are 10 tokens
        for k in range(n):
            spark.createDataFrame(rows[60 // n * k: 60 // n * (k + 1)], "session int, s int, ord int, tier string, output string").coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema("session int, s int, ord int, tier string, output string").option("maxFilesPerTrigger", 1).parquet(path).withColumn("ts", F.timestamp_seconds("s"))
        with state.rocks(spark):
            got = C.run_available(state.session_state(stream, 2), str(tmp_path / f"out{n}"), "update")
            last = {r.session: r for r in got.orderBy("prompts").collect()}
        assert set(last) == {None, 1, 2, 3, 4} and all((r.prompts, r.total) == (12, 120) for r in last.values())
        assert last[1].cited == "n0,n1" and last[None].last_us == 55_000_000 and last[4].last_tier is None
