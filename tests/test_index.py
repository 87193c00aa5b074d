"""The stored inverted index against BM25 from scratch, through changes; and tables that are replaced as a whole."""

import pytest
from pyspark.sql import functions as F

from notewell.operators import index as X
from notewell.operators import retrieval as R
from notewell.operators.index import TextIndex, alive
from notewell.sources import versions

WORDS = "amber basin cedar delta ember fjord grove heath islet jetty knoll ledge marsh north ocean plaza quay ridge shore tower".split()


def corpus(spark, ids, seed):
    text = lambda i: " ".join(WORDS[(i * i * 7 + seed * 3 + k * (i % 5 + 1)) % len(WORDS)] for k in range(3 + (i * 13 + seed) % 40))
    return spark.createDataFrame([(i, text(i) if i % 17 else None, f"{seed}") for i in ids], "id long, text string, signature string")


def asked(spark):
    return spark.createDataFrame([(1, "amber basin cedar"), (2, "quay quay tower"), (3, "nowhere"), (4, " ".join(WORDS)), (5, None), (6, "Fjórd the ocean")], "query_id long, text string")


def plain(docs, queries, k):
    scored = R.bm25(docs, "id", F.col("text"), queries, "query_id", F.col("text")).select("query_id", "id", F.round("bm25", 6).alias("score"))
    return sorted(map(tuple, R.top_k(scored, "score", k).collect()))


def found(index, queries, k, **kw):
    return sorted(map(tuple, index.search(queries, k, **kw).collect()))


def test_index_through_changes(spark, tmp_path):
    index, queries = TextIndex(spark, str(tmp_path / "index")), asked(spark)
    with pytest.raises(FileNotFoundError):
        index.search(queries, 3)
    first = corpus(spark, range(300), 1)
    index.build(first, size=16, buckets=8)
    assert found(index, queries, 7) == plain(first, queries, 7)
    # some change, some go, some come
    second = first.where("id < 250 AND id % 11 <> 0").union(corpus(spark, range(300, 330), 1)).union(corpus(spark, range(0, 250, 11), 2))
    actions = {r.action: r["count"] for r in index.update(second).groupBy("action").count().collect()}
    assert actions == {"added": 30, "removed": 50, "updated": 23, "skipped": 227}
    assert index._state()["dead"] is not None and found(index, queries, 7) == plain(second, queries, 7)
    third = second.where("id >= 0")
    assert {r.action for r in index.update(third).collect()} == {"skipped"} and found(index, queries, 7) == plain(third, queries, 7)
    index.compact()
    assert index._state()["dead"] is None and found(index, queries, 7) == plain(third, queries, 7)
    # nearly all are replaced, so the update compacts by itself
    fourth = corpus(spark, range(100), 5)
    index.update(fourth)
    assert index._state()["dead"] is None and found(index, queries, 400) == plain(fourth, queries, 400)
    index.update(fourth.limit(0))
    assert found(index, queries, 5) == []


def test_index_weights_and_odd_rows(spark, tmp_path, monkeypatch):
    docs, queries = corpus(spark, range(200), 3), asked(spark)
    index = TextIndex(spark, str(tmp_path / "index"))
    index.build(docs.withColumn("term", F.lit("clash")), size=8, buckets=4)
    weights = spark.createDataFrame([(i, (0.0, 1.3, 0.4)[i % 3]) for i in range(150)], "id long, weight double")
    scored = R.bm25(docs, "id", F.col("text"), queries, "query_id", F.col("text")).join(weights, "id", "left")
    scored = scored.select("query_id", "id", F.round(F.round("bm25", 6) * F.coalesce("weight", F.lit(1.0)), 6).alias("score")).where("score > 0")
    assert found(index, queries, 6, weights=weights) == sorted(map(tuple, R.top_k(scored, "score", 6).collect()))
    assert found(index, queries.limit(0), 6) == []
    # queries of more text than is held at once
    monkeypatch.setattr(X, "QUERY_BYTES", 40)
    assert found(index, queries, 6) == plain(docs, queries, 6)


def test_search_opens_only_folders_of_its_terms(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "index"))
    index.build(corpus(spark, range(100), 1), size=16, buckets=16)
    one = spark.createDataFrame([(1, "amber")], "query_id long, text string")
    _, blocks = index._asked(index._state(), one)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.split("PartitionFilters")[1][:60]
    assert len({r[0].split("bucket=")[1].split("/")[0] for r in blocks.select(F.input_file_name()).distinct().collect()}) == 1
    # bounds hold for every document of a range
    state = index._state()
    asked_terms, blocks = index._asked(state, asked(spark))
    mean = state["total"] / state["n"]
    bounds = index.bounds(state, asked_terms, blocks, mean).checkpoint()
    scores = index._scores(state, bounds.select("query_id", "range"), asked_terms, blocks, mean, None).join(index.documents().select("id", "range"), "id")
    assert scores.join(bounds, ["query_id", "range"]).where("score > bound + 0.000001").count() == 0


def test_tables_are_replaced_as_a_whole(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        versions.read_table(spark, root)
    versions.write_table(spark.range(3), root)
    old = versions.read_table(spark, root)
    with pytest.raises(Exception):
        versions.write_table(spark.range(5).select(F.raise_error(F.lit("no")).alias("id")), root)
    assert versions.read_table(spark, root).count() == 3
    versions.write_table(spark.range(4), root)
    # who read before still can
    assert versions.read_table(spark, root).count() == 4 and old.count() == 3
    # of two writers of one state the second fails
    number, state = versions.latest(spark, root)
    versions.commit(spark, root, number + 1, state)
    with pytest.raises(Exception):
        versions.commit(spark, root, number + 1, state)
    versions.write_table(spark.range(5), root)
    versions.write_table(spark.range(6), root)
    assert versions.read_table(spark, root).count() == 6 and len(list((tmp_path / "t/data").iterdir())) == 2


def test_alive_drops_dead_postings(spark):
    """Dead documents leave the blocks of their range alone, bounds are those of what is left, and empty blocks go."""
    post = lambda *x: [(i, tf, 10 * tf) for i, tf in x]
    blocks = spark.createDataFrame(
        [("a", 0, 3, 5, 20, post((1, 5), (2, 2), (3, 3))), ("b", 0, 1, 1, 10, post((1, 1))), ("a", 1, 2, 4, 10, post((1, 1), (5, 4)))],
        "term string, range long, n long, max_tf long, min_length long, postings array<struct<id: long, tf: long, length: long>>")
    dead = spark.createDataFrame([(1, 0), (9, 0), (7, 2)], "id long, range long")
    got = {(r.term, r.range): (r.n, r.max_tf, r.min_length, [p.id for p in r.postings]) for r in alive(blocks, dead).collect()}
    assert got == {("a", 0): (2, 3, 20, [2, 3]), ("a", 1): (2, 4, 10, [1, 5])}
