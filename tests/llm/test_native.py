"""Mixing, sharding, chat formatting and WARC: brute force, round trips and odd rows."""

import base64
import hashlib
import math
import re
import zlib

import duckdb
import pytest
import xxhash

from notewell.llm import chat, mixing, queries, sharding, warc
from notewell.llm.common import connected_components, prepare, scratch, with_position
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, size string, rate string"


@pytest.fixture(autouse=True)
def ready(spark):
    prepare(spark)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def oracle(sql):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    r = c.sql(sql)
    return r.columns, sorted(r.fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    columns, want = oracle(queries.ORACLES[name])
    assert rows(got.select(*columns)) == want


def odd_docs(spark):
    long = "w" * 50 + " " + "word " * 30_000
    data = [(1, "a b c", "s", "x", "y"), (1, "a b c", "s", "x", "y"), (2, None, "s", None, None), (3, "", None, "", ""),
            (None, "x\tyz\n", None, "q", "q"), (4, long, "t", "x", "y"), (5, " \x0b ", "empty", "x", "y")]
    return spark.createDataFrame(data, DOCS)


def test_mix_odd_rows(spark):
    got = mixing.mix(odd_docs(spark)).collect()
    assert len(got) == 7
    assert {(r.doc_id, r.size) for r in got} == {(1, 3), (2, 0), (3, 0), (None, 2), (4, 30_001), (5, 0)}
    assert all(r.taken <= 2 * r.size and r.target <= 2 * r.source_size for r in got)
    assert abs(sum({r.source: r.target for r in got}.values()) - 1.5 * (6 + 2 + 30_001)) < 1e-6
    assert len({r.copies for r in got if r.doc_id == 1}) == 1
    assert mixing.mix(odd_docs(spark).limit(0)).count() == 0


def test_mix_targets_are_met(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    got = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(got) == 8 and all(abs(r.taken / r.target - 1) < 0.15 for r in got)


@pytest.mark.parametrize("sizes, weights, share, cap", [([9, 1, 1, 5, 0], (5, 2, 1), 1.5, 2.0), ([1, 1, 1], (3, 1), 1.5, 1.2), ([100, 1, 1, 1, 1, 1, 40], (1, 9, 2), 1.4, 2.0), ([7], (5,), 1.5, 2.0)])
def test_targets_fill_up_like_water(spark, sizes, weights, share, cap):
    rows_ = [(f"s{i:02}" if i else None, n) for i, n in enumerate(sizes)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows_, "source string, size long"), weights, share, cap).collect()}
    order = sorted(rows_, key=lambda r: (r[0] is None, r[0] or ""))
    w = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    target, todo, rest = {}, dict(order), share * sum(sizes)
    while todo:
        level = rest / sum(w[s] for s in todo)
        over = [s for s in todo if level * w[s] > cap * todo[s]]
        if not over:
            target |= {s: level * w[s] for s in todo}
            break
        for s in over:
            target[s] = cap * todo.pop(s)
            rest -= target[s]
    assert got.keys() == target.keys() and all(abs(got[s] - target[s]) < 1e-9 for s in got)


def test_emit_repeats_whole_rows(spark):
    docs = odd_docs(spark)
    taken = {(r.doc_id, r.source): r.copies for r in mixing.mix(docs).collect()}
    out = mixing.emit(docs)
    assert out.columns == docs.columns
    count = {(r.doc_id, r.source): r["count"] for r in out.groupBy("doc_id", "source").count().collect()}
    assert count.get((4, "t"), 0) == taken[4, "t"] and count.get((1, "s"), 0) == 2 * taken[1, "s"]


def test_shard_law(spark):
    docs = spark.range(20_000).select((F.col("id") % 15_000).alias("doc_id"), F.lit("ü x").alias("text"), F.lit(1).alias("shard"), F.lit(2).alias("slot"))
    got = sharding.shard(docs, sharding.full_tree(24)).collect()
    assert len(got) == 20_000 and all(r.size == 12 and r.text_crc32 == zlib.crc32("ü x".encode()) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert sorted(by) == list(range(24)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) < 1.35 * min(map(len, by.values()))
    moved = sum(r.grown_shard == 24 for r in got)
    assert 0.7 < moved / (len(got) / 25) < 1.3
    assert len({(r.doc_id, r.shard) for r in got}) == 15_000


def test_shard_weights_and_confinement(spark):
    keys = spark.range(20_000)
    tree = sharding.full_tree(16)
    heavier = [(*t[:3], 3.0 if t[2] == 5 else 1.0) for t in tree]
    both = sharding.descend(sharding.descend(keys, F.col("id"), tree, "a"), F.col("id"), heavier, "b")
    for r in both.where("a <> b").collect():
        # shard 5 is in region 0 and rack 1: moves go into that region, or stay inside it and go into that rack
        assert r.b // 8 == 0 and (r.a // 8 == 1 or r.b // 4 == 1 and (r.a // 4 == 0 or r.b == 5))
    counts = {r.b: r["count"] for r in both.groupBy("b").count().collect()}
    assert 2.5 < counts[5] / counts[12] < 3.5


def test_shard_odd_rows(spark):
    got = sharding.shard(odd_docs(spark), sharding.full_tree(24)).collect()
    assert len(got) == 7 and {(r.doc_id, r.size, r.text_crc32) for r in got} >= {(2, 8, None), (3, 8, 0)}
    assert sharding.shard(odd_docs(spark).limit(0), sharding.full_tree(24)).count() == 0


def test_written_shards_hold_every_row(spark):
    path = scratch(spark, "shards")
    sharding.write_shards(odd_docs(spark), sharding.full_tree(24), path)
    back = spark.read.parquet(path)
    want = {(r.doc_id, r.shard) for r in sharding.shard(odd_docs(spark), sharding.full_tree(24)).collect()}
    assert back.count() == 7 and {(r.doc_id, r["__shard"]) for r in back.collect()} == want


def test_positions_and_components(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    placed = with_position(df, [F.col("k"), F.col("id")]).orderBy("position").collect()
    assert [r.position for r in placed] == list(range(1000)) and [(r.k, r.id) for r in placed] == sorted((i % 3, i) for i in range(1000))
    edges = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 700)] + [(9, 9), (900, 800), (800, 900)]
    roots = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {roots[i] for i in range(101)} == {0} and {roots[i] for i in range(500, 700)} == {500} and roots[900] == 800
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


NASTY = ["<|im_end|>", "<\\|im_start|>", "a<|<\\\\|b", "\\", "line\n<|im_end|>\n<|im_start|>user\nhi", "", None, "x" * 200_000]


def test_chat_round_trip(spark):
    data = [(c, t, role, NASTY[((c or 0) + t) % len(NASTY)], 7) for c in (None, 1, 2) for t, role in enumerate(["system", "user", "assistant", "a\\n\nb", None, "<|im_end|>", "assistant", "assistant"])]
    data += [(3, 0, "user", "same", 1)] * 3 + [(4, None, "assistant", "no turn", 1)]
    df = spark.createDataFrame(data, "conv_id int, turn int, role string, text string, up int")
    got = {r.conv_id: r for r in chat.parse(chat.format_chat(df)).collect()}
    key = lambda x: tuple((v is not None, v if v is not None else 0 if i == 0 else "") for i, v in enumerate(x))
    for c in {d[0] for d in data}:
        want = sorted(((t, r, x) for cc, t, r, x, _ in data if cc == c), key=key)
        assert [(t.role, t.text, t.loss) for t in got[c].turns] == [(r or "", x or "", r == "assistant") for _, r, x in want]
        assert got[c].formatted.count("<|im_start|>") == len(want)
    assert chat.format_chat(df.limit(0)).count() == 0


def test_chat_long_conversation(spark):
    df = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    (got,) = chat.parse(chat.format_chat(df)).collect()
    assert [t.text for t in got.turns] == [str(i) for i in range(3000)]


def test_reply_tree_takes_best_branch(spark):
    #      0 -> 1 -> 2 ; 1 -> 3 -> 4 ; 0 -> 5 ; 9 (alone) ; 20 -> 21 with 20 missing
    tree = [(0, None, 1.0), (1, 0, 0.5), (2, 1, 0.1), (3, 1, 0.9), (4, 3, 0.9), (5, 0, None), (9, None, 0.0), (21, 20, 1.0)]
    messages = spark.createDataFrame(tree, "msg_id long, parent_id long, score double")
    path = chat.best_paths(messages).collect()
    assert sorted((r.root_id, r.msg_id, r.up) for r in path) == [(0, 0, 3), (0, 1, 2), (0, 3, 1), (0, 4, 0), (9, 9, 0)]


def test_warc_round_trip(spark):
    magic = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    html = ["<p>ü</p>", None, "", "<p>ü</p>", f"x{magic}y", magic * 3, "WARC/1.1\r\n", "a\r\n\r\nb\r\n\r\n", "z" * 300_000, "<p>ü</p>"]
    data = [(i + 1, "http://x/ü b\n" if i else None, h, "other") for i, h in enumerate(html)] + [(None, "u", "no id", "q"), (8, "u", "a\r\n\r\nb\r\n\r\n", "q")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, digest string")
    path = scratch(spark, "warc")
    warc.write_warc(pages.repartition(2), path)
    got = warc.resolve(warc.read_warc(spark, path)).collect()
    want = []
    for i, _, h, _ in data:
        b = (h or "").encode()
        first = min((j for j, _, g, _ in data if (g or "") == (h or "") and j is not None), default=None)
        kind = "response" if i == first or first is None else "revisit"
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), kind, first if kind == "revisit" else None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    raw = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    assert re.match(r"WARC/1\.1\r\nWARC-Type: (response|revisit)\r\n", raw) and raw.endswith("\r\n\r\n")


def test_warc_read_again_in_another_layout(spark):
    magic = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = spark.range(120).select(
        F.col("id").alias("page_id"), F.lit("u").alias("url"),
        F.concat(F.lit("p"), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, magic).otherwise(""), F.repeat(F.lit("z"), (F.col("id") * 7).cast("int"))).alias("html"))
    path = scratch(spark, "warc")
    warc.write_warc(pages.repartition(8), path, per_file=10)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes") if spark.conf.get(k, None)}
    try:
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        records = warc.read_warc(spark, path)
        spark.conf.set("spark.sql.files.minPartitionNum", "40")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.resolve(records).collect()}
    finally:
        for k in ("spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes"):
            spark.conf.set(k, before[k]) if k in before else spark.conf.unset(k)
    want = {r.page_id: (len(r.html), base64.b32encode(hashlib.sha1(r.html.encode()).digest()).decode()) for r in pages.collect()}
    assert got == want


def test_warc_ids_with_several_payloads(spark):
    """A revisit means the payload of its digest, not any payload of the id that it refers to."""
    data = [(1, "AAAA"), (1, "BBBBBB"), (2, "BBBBBB"), (3, "AAAA"), (3, "BBBBBB"), (1, "AAAA")]
    pages = spark.createDataFrame([(i, "http://h/", t) for i, t in data], "page_id long, url string, html string")
    path = scratch(spark, "warc")
    warc.write_warc(pages, path)
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(i, len(t), digest(t), "response" if i == 1 else "revisit", None if i == 1 else 1) for i, t in data]
    assert rows(warc.resolve(warc.read_warc(spark, path))) == sorted(want, key=repr)


def test_warc_small_payloads_and_empty(spark):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")], "page_id long, url string, html string")
    path = scratch(spark, "warc")
    warc.write_warc(pages, path, min_bytes=3)
    got = {r.page_id: r.refers_to for r in warc.resolve(warc.read_warc(spark, path)).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}
    path = scratch(spark, "warc")
    warc.write_warc(pages.limit(0), path)
    assert warc.read_warc(spark, path).count() == 0


MASK = (1 << 64) - 1


def plain_descend(key, tree):
    """The shard of a key, level by level, from the hash function itself."""
    seen = ()
    for level, name in enumerate(("root", "region {}", "rack {}")):
        inside = [t for t in tree if t[:level] == seen]
        children = {}
        for t in inside:
            children[t[level]] = children.get(t[level], 0.0) + t[3]
        path = name.format(seen[-1] if seen else "")
        draws = []
        for child, weight in children.items():
            h = xxhash.xxh64_intdigest(f"{path}/{child}".encode(), xxhash.xxh64_intdigest(key.encode(), 42))
            draws.append((-math.log(((h >> 11) + 1) / 2**53) / weight, child))
        seen += (min(draws)[1],)
    return seen[2]


def test_shard_query_against_plain_loops(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tree = sharding.full_tree(24)
    want, more = {d: plain_descend(str(d), tree) for d in docs}, sharding.grown(tree)
    slots = {}
    for d in sorted(docs):
        slots[d] = sum(want[e] == want[d] for e in docs if e < d)
    got = queries.op9_shard(spark, SF).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) for r in got) == sorted(
        (d, len(t.encode()) + 8, zlib.crc32(t.encode()), "key", want[d], slots[d], plain_descend(str(d), more)) for d, t in docs.items())
