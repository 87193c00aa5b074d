"""Growing and compressed line files: torn, cut, shrunk, closed, and read on after a failure."""

import pyarrow as pa
import pytest

from notewell.operators import retrieval as R
from notewell.sources import growing as G
from notewell.sources import notes as N
from notewell.streaming import counters as C


def zst(data):
    out = pa.BufferOutputStream()
    with pa.CompressedOutputStream(out, "zstd") as f:
        f.write(data)
    return out.getvalue().to_pybytes()


def lines(rows):
    return sorted((r.session, r.at, r.line) for r in rows)


@pytest.mark.parametrize("chunk", [3, 7, 1 << 20])
def test_lines_belong_to_the_range_of_their_line_feed(tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(G, "CHUNK", chunk)
    text = b"first\nsecond line\n\nlast one is long\nno feed"
    (tmp_path / "a").write_bytes(text)
    store, path = N.file_system(str(tmp_path / "a"))
    whole = list(G.plain_lines(store, path, 0, len(text), False))
    assert [x for _, x in whole] == [b"first", b"second line", b"", b"last one is long"] and all(text[at: at + len(x)] == x for at, x in whole)
    for a in range(len(text)):
        for b in range(a, len(text) + 1, 5):
            parts = [y for lo, hi in ((0, a), (a, b), (b, len(text))) for y in G.plain_lines(store, path, lo, hi, False)]
            assert parts == whole
    assert list(G.plain_lines(store, path, 0, len(text), True))[-1][1] == b"no feed"


def test_compressed_files(spark, tmp_path):
    body = b"".join(b'{"i": %d, "x": "%s"}\n' % (i, bytes([97 + i % 26]) * 50) for i in range(20_000))
    packed = zst(body)
    (tmp_path / "whole.jsonl.zst").write_bytes(packed)
    (tmp_path / "frames.jsonl.zst").write_bytes(zst(b'{"i": 1}\n') + zst(b'{"i": 2}\n'))
    (tmp_path / "torn.jsonl.zst").write_bytes(packed[: len(packed) // 2])
    (tmp_path / "junk.jsonl.zst").write_bytes(b"no zstd at all")
    (tmp_path / "bad.jsonl").write_bytes(b'{"i": 7}\n\xff{"i": 8}\n{"i": 9}')
    got = N.read_json_lines(spark, str(tmp_path), "i int")
    n = {r.file.split("/")[-1]: r["count"] for r in got.groupBy("file").count().collect()}
    assert n["whole.jsonl.zst"] == 20_000 and n["frames.jsonl.zst"] == 2 and n.get("torn.jsonl.zst", 0) < 20_000 and "junk.jsonl.zst" not in n and n["bad.jsonl"] >= 2
    assert {r.line for r in G.read_lines(spark, str(tmp_path)).where("session = 'bad'").collect()} == {'{"i": 7}', '{"i": 8}', '{"i": 9}'}


def test_folders_without_files(spark, tmp_path):
    assert G.read_lines(spark, str(tmp_path)).count() == 0 and G.read_lines(spark, str(tmp_path / "none")).count() == 0
    assert C.run_available(G.follow_lines(spark, str(tmp_path / "none")), str(tmp_path / "s"), "append").count() == 0


def test_stream_reads_on(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    read = lambda: lines(C.run_available(G.follow_lines(spark, str(logs)), str(tmp_path / "s"), "append").collect())
    (logs / "a.jsonl").write_bytes(b"one\ntw")
    (logs / "b.jsonl").write_bytes(b"x\n")
    (logs / "c.jsonl").write_bytes(b"1\n2\n")
    assert read() == [("a", 0, "one"), ("b", 0, "x"), ("c", 0, "1"), ("c", 2, "2")]
    (logs / "a.jsonl").write_bytes(b"one\ntwo\nthree\n")
    (logs / "b.jsonl").write_bytes(b"x\ny\n")
    (logs / "b.closed").write_bytes(b"")
    (logs / "c.jsonl").write_bytes(b"1\n")
    (logs / "d.jsonl.zst").write_bytes(zst(b"late\n"))
    want = [("a", 0, "one"), ("a", 4, "two"), ("a", 8, "three"), ("b", 0, "x"), ("c", 0, "1"), ("c", 2, "2"), ("d", 0, "late")]
    assert read() == want and read() == want


def test_failed_batches_are_read_again(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.jsonl").write_bytes(b"one\n")
    run = lambda complete: C.gated_capture(G.follow_lines(spark, str(logs)), str(tmp_path / "out"), str(tmp_path / "ck"), complete)
    with pytest.raises(Exception):
        run(lambda batch: False)
    (logs / "a.jsonl").write_bytes(b"one\ntwo\n")
    run(lambda batch: True)
    run(lambda batch: True)
    assert lines(spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 0, "one"), ("a", 4, "two")]


@pytest.mark.parametrize("limit", [1 << 20, 6])
def test_tokens_within(spark, limit):
    texts = spark.createDataFrame([(1, "abcabc xyz"), (2, "bc"), (3, None), (4, ""), (5, "ünï abc")], "id int, text string")
    tokens = spark.createDataFrame([("abc",), ("bc",), ("bc",), ("ünï",), ("none",), ("",), (None,)], "token string")
    got = sorted(map(tuple, R.tokens_within(texts, tokens, limit).collect()))
    assert got == [(1, "abc"), (1, "bc"), (2, "bc"), (5, "abc"), (5, "bc"), (5, "ünï")]
    assert R.tokens_within(texts, tokens.limit(0), limit).count() == 0
