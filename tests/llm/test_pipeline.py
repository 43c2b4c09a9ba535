import os

import pytest

import corpus_pipeline
from conftest import SF, prose
from pairloom.llm import decontaminate, jaccard, mixing, planes, toxicity


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
def test_every_stage_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= left, name
        left = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in docs.collect())


def test_decisions_on_planted_cases(spark, tmp_path):
    """Each stage drops what is planted for it and keeps the rest."""
    item = prose(77, 40)
    clean = [(i, prose(i, 60)) for i in range(40)]
    toxic = [(100 + i, prose(200 + i, 30) + " stupid worthless idiot") for i in range(5)]
    copies = [(200 + i, prose(i, 60)) for i in range(5)]
    leaks = [(300 + i, f"{prose(300 + i, 30)} {item} {prose(400 + i, 10)}") for i in range(5)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in clean + toxic + copies + leaks]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.collect()}
    steps = dict(corpus_pipeline.STAGES)
    after = steps["toxicity"](spark, docs, str(tmp_path))
    assert ids(docs) - ids(after) == {i for i, _ in toxic}
    before, after = ids(after), steps["near_duplicates"](spark, after, str(tmp_path))
    assert before - ids(after) == {i for i, _ in copies}
    before, after = ids(after), steps["decontamination"](spark, after, str(tmp_path))
    assert before - ids(after) == {i for i, _ in leaks}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert ids(out) == ids(steps["mixing"](spark, after, str(tmp_path)))


def test_stages_call_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_output"]
    assert all(m for m in (toxicity, jaccard, decontaminate, mixing, planes))
