import duckdb
import os
import pytest

from conftest import SF, prose
from pairloom.llm import toxicity as tox

SEEDED = tox.Model(dict.fromkeys(tox.SEED, 2.0), tox.DEFAULT_COEFFICIENTS)


@pytest.mark.parametrize("text", ["you idiot", "You IDIOT!", "you 1d1ot", "you іԁiоt", "you ｉｄｉｏｔ", "idiotic", "idiots..."])
def test_folding_finds_disguises(text):
    assert SEEDED.lexicon.total(tox.fold(text)) == 2.0


@pytest.mark.parametrize("text", ["", None, "put it in the trash can", "a clown fish", "anti-cid iot", "so sympathetic"])
def test_harmless(text):
    assert SEEDED.lexicon.total(tox.fold(text)) == 0.0
    assert 0 < SEEDED.score(text) < tox.THRESHOLD


def test_exception_spares_only_its_words():
    assert SEEDED.lexicon.total(tox.fold("trash in the trash can")) == 2.0


def test_length_normalises():
    assert SEEDED.score("idiot " + prose(1, 20)) > tox.THRESHOLD > SEEDED.score("idiot " + prose(1, 20_000))


def test_longest_stem_counts_once():
    lexicon = tox.Lexicon({"abcd": 1.0, "abcdef": 3.0})
    assert lexicon.total(tox.fold("abcdefg abcdx")) == 4.0


def test_learns_stems_and_spares_common_words(spark, documents):
    insults = (" grumwort", " grumwortel", " grumwort grumworts")
    rows = [(i, prose(i, 60) + (insults[i // 4 % 3] if i % 4 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0), None) for i in range(400)] + [(None, 1, None), (7, None, None)], "doc_id long, toxic int, text string")
    model = tox.fit(documents(rows), labels)
    assert any("grumwort".startswith(s) or s.startswith("grumwort") for s in model.weights)
    assert not any(s in w for s in model.weights for w in prose(3, 500).split())
    assert model.score(prose(9, 50) + " grumwort") > tox.THRESHOLD > model.score(prose(9, 50))


def test_odd_rows_and_no_labels(spark, documents, odd_rows):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    rows = tox.toxicity(documents(odd_rows), labels).collect()
    assert len(rows) == len(odd_rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= tox.THRESHOLD) for r in rows)
    assert tox.toxicity(documents([]), labels).count() == 0
    left = tox.without_toxic(documents([*odd_rows, (20, "you stupid worthless idiot")]), SEEDED)
    assert left.columns == documents([]).columns and left.count() == len(odd_rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = tox.toxicity(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).toPandas()
    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").df()
    held = got[got.held_out].merge(labels, on="doc_id")
    hit = ((held.predicted == 1) & (held.toxic == 1)).sum()
    assert hit / held.predicted.sum() > 0.9 and hit / held.toxic.sum() > 0.85
