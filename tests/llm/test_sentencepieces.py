import hashlib

from hypothesis import given, settings, strategies as st
import numpy as np
import pyarrow as pa
import pytest

from conftest import prose
from pairloom.llm import sentencepieces as sp

MODEL = sp.model_at(sp.MODEL)
AWKWARD = [
    " ", "  ", "a ", " a", "  a  b   c ", "▁", "a▁b", "▁▁x ▁", "a\n b\t\tc\r\n", "naïve 中文 字 😀 ²3", "</s> <s> <unk> <0x0A>", "a\0b \0",
    "﻿a b", "　 a", "x" * 5000 + " " + "x" * 5000, "é" * 2000, " " * 4000, "¡Hola! ¿qué tal?", "퟿ 􏿿",
]


def brute(rows):
    out = []
    for doc_id, text in rows:
        ids = MODEL.encode(text or "")
        texts = ",".join(map(str, ids)), MODEL.decode(ids)
        out.append((doc_id, len(ids), *(hashlib.sha256(t.encode()).hexdigest() for t in texts)))
    return sorted(out, key=repr)


def rows_of(df):
    assert df.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


# The whole table broadcast, a part of it, nothing of it.
BOUNDS = [{}, {"head_words": 40}, {"head_bytes": 900}, {"head_words": 0}]


@pytest.mark.parametrize("bounds", BOUNDS)
def test_equals_the_library(spark, documents, odd_rows, bounds):
    rows = odd_rows + [(100 + i, t) for i, t in enumerate(AWKWARD * 2)] + [(300 + i, prose(i, 200)) for i in range(30)]
    rows += [(400, prose(1, 50) + " onlyhere"), (401, prose(1, 50))]
    assert rows_of(sp.digests(documents(rows).repartition(5), **bounds)) == brute(rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("a b▁\n中 é.") | st.characters(codec="utf-8"), max_size=40), max_size=6))
def test_words_of_any_text(texts):
    words = sp.Words(pa.array(texts, pa.string()))
    at = 0
    for text, n in zip(texts, words.per_row.tolist()):
        parts = words.texts(np.arange(at, at + n))
        assert sum(sp.segmented(parts, sp.MODEL), []) == MODEL.encode(text)
        at += n
    everything = words.texts(np.arange(at))
    assert words.column(np.arange(at)).to_pylist() == everything
    assert sp.word_hashes_of(pa.array(everything, pa.string())).tolist() == words.hashes.tolist()


def test_ids_and_texts(spark, documents):
    rows = [(i, t) for i, t in enumerate(AWKWARD)]
    got = sp.decoded(sp.encoded(documents(rows))).collect()
    assert {r.doc_id: (r.ids, r.text) for r in got} == {i: (MODEL.encode(t), MODEL.decode(MODEL.encode(t))) for i, t in rows}


def test_decoding_any_list_of_ids(spark):
    rows = [(1, [1, 450, 2]), (2, []), (3, None), (4, [450, None]), (5, [32_000]), (6, [-1]), (7, [232, 0, 131, 300]), (8, [29871, 29871])]
    got = {r.k: r.text for r in sp.decoded(spark.createDataFrame(rows, "k int, ids array<int>")).collect()}
    assert got == {k: None if k in (3, 4, 5, 6) else MODEL.decode(ids) for k, ids in rows}


def test_each_repeated_word_is_in_the_table_once(spark, documents):
    rows = [(i, "one two two  three") for i in range(50)] + [(60, "single")]
    found = sp.word_table(documents(rows).select("doc_id", "text").repartition(7), sp.MODEL).collect()
    assert {r.word: r.n for r in found} == {"one": 50, "two": 100, " three": 50}
    assert len(found) == 3


def test_models_that_change_texts_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    for change in (lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True), lambda m: setattr(m.pieces[500], "piece", "a▁b")):
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(MODEL.serialized_model_proto())
        change(spec)
        path = tmp_path / "changed.model"
        path.write_bytes(spec.SerializeToString())
        with pytest.raises(ValueError):
            sp.model_at(str(path))
        sp.model_at.cache_clear()


def test_empty_table(spark, documents):
    assert rows_of(sp.digests(documents([]))) == []
