"""The two trained scorers against plain versions of their features, votes and forward passes."""

import math
from pathlib import Path

import numpy as np
import pytest

from notewell.llm import learning, quality, queries, toxicity
from notewell.llm.common import prepare
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TEXTS = ["", " ", "one", "The cat sat. The cat sat! 12,5% [x] " * 40, "ünïcode ÄÖ € 漢字 " * 200, "a b a b a b a a a\n\t" * 300, "x" * 1500, "tail " * 103 + "\n"]


@pytest.fixture(autouse=True)
def ready(spark):
    prepare(spark)


def byte_class(b):
    if b >= 128:
        return len(quality.CLASSES) + (2 if b < 192 else 1)
    return next((k for k, c in enumerate(quality.CLASSES) if chr(b) in c), len(quality.CLASSES))


def plain_passages(text):
    """One feature list for each passage of the whole text, byte by byte."""
    n, out = quality.N, []
    raw = text.encode("utf-8")
    kinds = [byte_class(b) for b in raw]
    words, at = [], 0
    while at < len(raw):
        if kinds[at] > 1:
            end = at
            while end < len(raw) and kinds[end] > 1:
                end += 1
            words.append((at, raw[at:end]))
            at = end
        else:
            at += 1
    for p in range(0, max(len(raw), 1), quality.PASSAGE):
        inside = kinds[p: p + quality.PASSAGE]
        size = max(len(inside), 1)
        single, pair = [0.0] * n, [0.0] * (n * n)
        for k in inside:
            single[k] += 1
        for a, b in zip(inside, inside[1:]):
            pair[a * n + b] += 1
        mine = [i for i, (w, _) in enumerate(words) if p <= w < p + quality.PASSAGE]
        count = max(len(mine), 1)
        again = [sum(i >= lag and words[i][1] == words[i - lag][1] for i in mine) / count for lag in (1, 2, 3)]
        out.append([math.sqrt(x / size) for x in single + pair] + [sum(k > 1 for k in inside) / count / 16, *again, min(len(mine), 100) / 100])
    return out


def plain_score(model, text):
    p, total, mixed = {k: v.astype(float) for k, v in model.p.items()}, 0.0, np.zeros(quality.CODE)
    for x in plain_passages(text):
        z = np.clip((np.array(x) - model.mean) / model.sd, -4, 4)
        h = np.tanh(z @ p["w0"] + p["b0"])
        e = math.exp(float((1 / (1 + np.exp(-h @ p["u"])) * np.tanh(h @ p["v"])) @ p["w"]))
        total, mixed = total + e, mixed + e * h
    return 1 / (1 + math.exp(-float(mixed / total @ p["c"] + p["b"][0])))


@pytest.mark.parametrize("piece", [1 << 20, 3000, 512])
def test_passages_against_plain_loops(monkeypatch, piece):
    """Features do not depend on how texts are cut for the memory's sake."""
    monkeypatch.setattr(quality, "AT_ONCE", piece)
    want = [x for t in TEXTS for x in plain_passages(t)]
    x, owner = (np.concatenate(z) for z in zip(*quality.portions(TEXTS)))
    assert np.allclose(x, want, atol=1e-5)
    assert owner.tolist() == [i for i, t in enumerate(TEXTS) for _ in plain_passages(t)]


def test_quality_query_against_plain_loops(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in queries.op6_quality(spark, SF).collect()}
    for r in docs.collect():
        assert abs(got[r.doc_id] - plain_score(model, r.text or "")) < 1e-4


def test_long_documents_are_learnt_from_to_their_end(spark):
    """What tells good from poor stands behind the first 40,000 bytes only."""
    filler = "plain words stand here. " * 1700
    rows = [(i, filler + ("All is well, and the day was calm. " if i % 2 else "#$%& @@ ~~ ^^ == ++ ** ") * 30) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int"))
    assert all((s >= 0.5) == (i % 2) for (i, _), s in zip(rows, model.score([t for _, t in rows])))


def test_bytes_bound_the_sample_by_whole_documents(spark):
    docs = spark.createDataFrame([(i, "w" * (100 if i else 5000)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, quality int")
    told = learning.labelled_sample(docs, labels, "quality", {1: 1000, 0: 1000}, {1: 5000, 0: 5000}).collect()
    assert len(told) == 50 and all(len(r.text) == 100 for r in told)


def test_scores_do_not_depend_on_portions(monkeypatch):
    rng = np.random.default_rng(0)
    model = quality.Attention.train([rng.random((3, quality.WIDTH)).astype(np.float32) for _ in range(8)], np.arange(8) % 2, epochs=2)
    whole = model.score(TEXTS)
    monkeypatch.setattr(quality, "AT_ONCE", 700)
    assert np.allclose(model.score(TEXTS), whole) and np.allclose(whole, [plain_score(model, t) for t in TEXTS], atol=1e-5)


def plain_votes(text, entries):
    """Names of the voters that a text has, found position by position."""
    low, found = text.lower(), {}
    for e in entries:
        word = e.rstrip(" ")
        for at in range(len(low)):
            if low.startswith(word, at) and not (at and low[at - 1].isalpha()):
                after = at + len(word)
                if not (e.endswith(" ") and after < len(low) and low[after].isalpha()):
                    found[e] = found.get(e, 0) + 1
    total = sum(found.values())
    capitals, smalls = sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text)
    holds = {"!!": "!!" in text, "CAPITALS": capitals > smalls, "twice": total >= 2, "four times": total >= 4, "densely": total * 100 > toxicity.DENSE * len(text),
             "none": not total and "!!" not in text, "sparse": total <= 1 and len(text) >= toxicity.LONG}
    return set(found) | {k for k, v in holds.items() if v}


def plain_toxicity(scorer, text):
    names = [*scorer.entries, *toxicity.PATTERNS]
    cast = plain_votes(text, scorer.entries)
    trusted = [i for i, name in enumerate(names) if name in cast and scorer.live[i]]
    evidence = min(sum(scorer.evidence[i] for i in trusted), 12)
    logit = sum(scorer.weight[i] for i in trusted) + evidence * scorer.weight[-2] + scorer.weight[-1]
    return 1 / (1 + math.exp(-max(min(logit, 40), -40)))


def test_toxicity_query_against_plain_loops(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scorer = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in queries.op10_toxicity(spark, SF).collect()}
    for r in docs.collect():
        assert abs(got[r.doc_id] - plain_toxicity(scorer, r.text or "")) < 1e-9
    for text in ("", "IDIOT!! idiots, an idiot", "pre-idiot xidiot", "you people " * 200):
        assert abs(scorer.score([text])[0] - plain_toxicity(scorer, text)) < 1e-9


def test_label_model_posterior_by_bayes():
    """Rates from made votes alone: the hidden classes come out, and the posterior is that of Bayes' rule."""
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.2
    rates = np.array([[0.7, 0.02], [0.5, 0.01], [0.6, 0.05], [0.3, 0.01], [0.1, 0.8], [0.2, 0.7]])
    v = (rng.random((4000, 6)) < np.where(y[:, None], rates[:, 0], rates[:, 1])).astype(float)
    model = toxicity.LabelModel.fit(v)
    assert np.abs(model.toxic - rates[:, 0]).max() < 0.1 and np.abs(model.clean - rates[:, 1]).max() < 0.05 and abs(model.prior - 0.2) < 0.03
    post = model.posterior(v)
    assert ((post > 0.5) == y).mean() > 0.95
    for i in range(20):
        odds = math.log(model.prior / (1 - model.prior))
        for j in range(6):
            a, b = (model.toxic[j], model.clean[j]) if v[i, j] else (1 - model.toxic[j], 1 - model.clean[j])
            odds += model.share[j] * math.log(a / b)
        assert abs(post[i] - 1 / (1 + math.exp(-odds))) < 1e-9


def test_copied_voters_share_their_evidence():
    rng = np.random.default_rng(2)
    v = (rng.random((3000, 4)) < 0.3).astype(float)
    model = toxicity.LabelModel.fit(np.c_[v[:, :1], v[:, :1], v[:, :1], v[:, 1:]])
    assert np.allclose(model.share[:3], 1 / 3, atol=0.05) and model.share[3] > 0.9


@pytest.mark.skipif(not Path("/root/testdata/check_s").exists(), reason="needs the larger input")
def test_toxic_recall_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/check_s/{t}.parquet") for t in ("documents", "labels"))
    told = queries.op10_toxicity(spark, "/root/testdata/check_s").where("held_out").join(labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("y")), "doc_id")
    n = {(r.y, r.predicted): r["count"] for r in told.groupBy("y", "predicted").count().collect()}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.01 * n[0, 0]
