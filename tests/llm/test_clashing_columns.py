"""Every pipeline stage on documents whose extra columns bear the names the stages use."""

import pytest

import corpus_pipeline
from rewardforge.llm import mixing

EXTRA = ["_rid", "_size", "_cuts", "_metadata", "size", "cuts", "rid", "place", "fp", "kept", "key", "block", "a.b", "_RID_", "score", "digest", "_part", "idx"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("clash")
    texts = [f"das ist ein guter langer text nummer {i} mit vielen eigenen worten wie {i * 7} und {i * 13}" for i in range(30)]
    rows = [(i, t, "de", f"s{i % 3}", len(t), *[f"{c}{i}" for c in EXTRA]) for i, t in enumerate(texts + texts[:5])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    docs = spark.createDataFrame(rows, schema)
    docs.repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, "no such words here at all in these texts ever again")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base)


@pytest.mark.parametrize("stored", [True, False])
@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_extra_columns_stay(spark, folder, name, stage, stored):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs if stored else docs.where("doc_id >= 0")
    out = stage(spark, docs, folder)
    assert out.columns == docs.columns
    got = out.collect()
    assert got and all(r[c] == f"{c}{r['doc_id']}" for r in got for c in EXTRA)
    if name == "mixing":  # documents of which the mix takes a word
        whole = mixing.mix_documents(docs).where("taken > 0").count()
    else:
        whole = 30 if name == "near_dedup" else 35
    assert len(got) == whole


def test_last_stage_runs(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == 35
