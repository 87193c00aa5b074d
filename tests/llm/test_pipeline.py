"""The pipeline's stages on odd rows."""

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, y int, fp string, copies int, _row string, __n string"


def odd(spark):
    rows = [(1, "plain words of a calm day at sea. " * 30, "en", "a"), (1, "plain words of a calm day at sea. " * 30, "en", "a"), (2, None, None, None), (3, "", "en", "a"), (None, "lone words here and there", "en", None),
            (4, "long " * 60_000, "en", "b"), (5, " \n", "en", "b"), (None, None, "en", "b")]
    return spark.createDataFrame([(*r, 1, 0.5, 1, "f", 2, "r", "n") for r in rows], COLUMNS)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_odd_rows(spark, name, stage):
    docs = odd(spark)
    out = stage(spark, docs, SF).collect()
    if name == "bpe":
        assert len(out) == 8 and sorted(r.n_tokens for r in out)[:4] == [0, 0, 0, 0]
        assert {r.doc_id for r in out} == {1, 2, 3, 4, 5, None}
    else:
        assert stage(spark, docs, SF).columns == docs.columns
    if name == "toxicity":
        assert len(out) == 8
    if name == "quality":
        assert len([r for r in out if r.doc_id == 1]) in (0, 2) and len({r.text in (None, "") for r in out if r.text in (None, "")}) <= 1
    if name == "simhash near-dedup":
        assert sorted((r.doc_id or 0) for r in out) == [0, 1, 2, 4] and len([r for r in out if not (r.text or "").strip()]) == 1
    if name == "mixing":
        assert len([r for r in out if r.doc_id == 1]) % 2 == 0 and len({r.doc_id for r in out} - {1, 2, 3, 4, 5, None}) == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_an_empty_table(spark, name, stage):
    empty = odd(spark).limit(0)
    out = stage(spark, empty, SF)
    assert out.count() == 0 and (name == "bpe" or out.columns == empty.columns)


def test_stages_without_labels(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, odd(spark), str(tmp_path)).count() == 8
