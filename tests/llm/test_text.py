"""BPE against the library, the two scorers on held-out labels, and the pipeline."""

import hashlib
import random
import re

import public_tokenizers
import pytest
import tokenizers

import corpus_pipeline
from notewell.llm import bpe, quality, queries, toxicity
from notewell.llm.common import prepare
from pyspark.sql import functions as F
from test_search import components, plain_fingerprint

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(autouse=True)
def ready(spark):
    prepare(spark)


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def same(library, texts):
    for text, ids, n, decoded in zip(texts, *bpe.Vocabulary(PATH).encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert (ids, n, decoded) == (" ".join(map(str, want)), len(want), library.decode(want, skip_special_tokens=False)), repr(text[:80])


def test_bpe_equals_library_on_odd_texts(library):
    rng = random.Random(3)
    letters = "aAbBcé ΣσςİI'stdmrvel'\n\t\x1c\x1d\x85\xa0​　éÅ漢字😀١2½Ⅳ<|endoftext|>$%!x\x00\x7f"
    texts = ["", " ", "a" * 20_000, "<|startoftext|><|endoftext|>x<|", "aaaaaaa hahahaha", "'s'ts"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(800)]
    texts += ["".join(chr(rng.choice([rng.randrange(1, 0x300), rng.randrange(0x370, 0xD800), rng.randrange(0xE000, 0x1FFFF)])) for _ in range(12)) for _ in range(400)]
    same(library, texts)


def test_bpe_query(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = queries.op8_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_bpe_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 2), (None, "", 2), (2, "a a", 2), (2, "a a", 2)], "doc_id long, text string, ids int")
    got = sorted(map(tuple, bpe.encode(df, PATH).collect()), key=repr)
    assert got == sorted([(1, 0, "", ""), (None, 0, "", ""), (2, 2, "320 320", "a</w> a</w>"), (2, 2, "320 320", "a</w> a</w>")], key=repr)
    again = bpe.decode(bpe.encode(df, PATH).select("doc_id", "ids"), PATH)
    assert sorted(map(tuple, again.collect()), key=repr) == sorted([(g[0], g[3]) for g in got], key=repr)
    assert bpe.encode(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("query, label, least", [("op6_quality", "quality", 0.97), ("op10_toxicity", "toxic", 0.94)])
def test_scores_on_held_out_labels(spark, query, label, least):
    got = queries.QUERIES[query](spark, SF).cache()
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    cut = 0.3 if label == "quality" else 0.5
    assert got.where(F.col("predicted") != (F.col("score") >= cut).cast("int")).count() == 0
    assert got.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)).count() == 0
    told = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    assert told.where(F.col("predicted") == F.col(label)).count() >= least * told.count()


@pytest.mark.parametrize("module, keep", [(quality, quality.keep_good), (toxicity, toxicity.keep_clean)])
def test_scorers_odd_rows(spark, module, keep):
    docs = spark.createDataFrame([(None, None, 1.0), (1, "", 1.0), (2, "Good words. " * 40_000, 1.0), (3, "x", 1.0), (3, "x", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = module.fit(docs, labels)
    got = module.score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and [r.held_out for r in got if r.doc_id is None] == [True]
    assert keep(docs, model).columns == docs.columns
    assert module.score(docs.limit(0), model).count() == 0
    again = spark.createDataFrame([(1, 1, 0), (1, 0, None), (2, 1, 1), (2, 1, 1), (99, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert module.score(docs, module.fit(docs, again)).count() == 5


def test_toxic_words_are_caught(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    high = model.score(["You are such an idiot, you stupid pathetic moron.", "A calm note on the weather of the coast and the sea."])
    assert high[0] > 0.5 > high[1]


def test_attention_gradient():
    import numpy as np
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(k, quality.WIDTH)).astype(np.float32) for k in (1, 3, 2)]
    model = quality.Attention.train(bags, np.array([0, 1, 1], np.float32), epochs=1)
    model.p = {k: v.astype(float) for k, v in model.p.items()}
    x, owner, y = np.concatenate(bags), np.repeat(np.arange(3), (1, 3, 2)), np.array([0, 1, 1.0])
    loss = lambda: -(y * np.log(s := model.forward(x, owner, 3)["score"]) + (1 - y) * np.log(1 - s)).mean()
    f = model.forward(x, owner, 3)
    for k, g in model.gradient(f, owner, (f["score"] - y) / 3).items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        keep, e = model.p[k][at], 1e-5
        model.p[k][at] = keep + e
        up = loss()
        model.p[k][at] = keep - e
        assert abs((up - loss()) / (2 * e) - g[at]) < 1e-5 + 1e-3 * abs(g[at])
        model.p[k][at] = keep


def test_pipeline(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF).checkpoint()
        assert out.columns == columns
        if name != "mixing":
            assert 0 < out.count() <= kept.count()
        kept = out
    assert kept.select("doc_id").subtract(docs.select("doc_id")).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert last.count() == kept.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in last.limit(50).collect():
        assert r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)


def plain_mix(docs, weights=(5, 2, 1), share=1.5, cap=2.0, seed=17):
    """How often each (doc_id, text, source) is taken, by plain water filling."""
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in docs]
    held = {}
    for (_, _, s), n in zip(docs, sizes):
        held[s] = held.get(s, 0) + n
    w = {s: weights[i % 3] for i, s in enumerate(sorted(held, key=lambda s: (s is None, s or "")))}
    target, todo, rest = {}, set(held), share * sum(held.values())
    while True:
        level = rest / sum(w[s] for s in todo) if todo else 0
        over = {s for s in todo if level * w[s] > cap * held[s]}
        if not over:
            break
        for s in over:
            target[s] = cap * held[s]
            rest -= target[s]
        todo -= over
    target |= {s: level * w[s] for s in todo}
    copies = []
    for (d, _, s), n in zip(docs, sizes):
        rate = target[s] / held[s] if held[s] else 0.0
        draw = int(hashlib.md5(f"mix:{seed}:{d}".encode()).hexdigest()[:13], 16) / 2**52
        copies.append(int(rate) + (draw < rate - int(rate)))
    return copies


def test_pipeline_against_brute_force(spark, library):
    small = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    kept = [tuple(r) for r in docs.select("doc_id", "text", "source").collect() if model.score([r.text])[0] < 0.5]
    second = quality.fit(docs.where(F.col("doc_id").isin([d for d, _, _ in kept])), labels)
    kept = [r for r in kept if second.score([r[1]])[0] >= 0.3]
    fps = [plain_fingerprint(t) for _, t, _ in kept]
    roots = components([d for d, _, _ in kept], lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 3)
    kept = [r for r, root in zip(kept, roots) if r[0] == root]
    want = []
    for (d, t, _), n in zip(kept, plain_mix(kept)):
        ids = library.encode(t, add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        want += [(d, len(ids), *sha)] * n
    assert sorted(map(tuple, corpus_pipeline.run(spark, small).collect())) == sorted(want)
