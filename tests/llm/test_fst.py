import random

from hypothesis import given, settings, strategies as st
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import prose
from pairloom.llm import fst, pretokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ALPHABET = ["a", "B", "é", "1", "²", " ", " ", "\n", "\t", "'", "'s", "'ll", "'re", "'x", "!", "%", "中", "’", "s", "\xa0", "\U0001f600", "l"]


@pytest.fixture(scope="module")
def kinds():
    return pretokens.character_classes(PATH)


def split(texts, kinds):
    got = [[] for _ in texts]
    for piece in pretokens.pieces(pa.array(texts, pa.string()), kinds):
        for k in range(len(piece.begin)):
            got[piece.owner[k]].append(piece.text(k))
    return got


def expected(text):
    return [text[a:b] for _, (a, b) in TOKENIZER.pre_tokenizer.pre_tokenize_str(text)]


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=40))
def test_any_text_splits_as_the_library_does(kinds, text):
    assert split([text, "x", text], kinds) == [expected(text), ["x"], expected(text)]


def test_awkward_texts_and_cut_long_ones(kinds, monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    assert split(texts, kinds) == [expected(t) for t in texts]
    monkeypatch.setattr(pretokens, "PIECE", 40)
    long = ["it's all 'll we're  fine\n\n x" * 30, "y" * 500, prose(1, 200)]
    assert split(long, kinds) == [expected(t) for t in long]


def test_scan_composes_chunk_maps():
    rng = np.random.default_rng(0)
    table = rng.integers(0, 10, (13, 7)).astype(np.uint8)
    scanned = pretokens.scanned(pretokens.chunk_maps(table))
    state = np.arange(8, dtype=np.uint8)
    for i, row in enumerate(table):
        for symbol in row:
            state = pretokens.NEXT[symbol * 8 + state]
        assert (scanned[i] == state).all()


def test_transducer_sums_to_the_library():
    words = [" " + w for w in prose(2, 200).split()] + ["therefore", "the", "there"]
    machine = fst.Transducer(words, fst._library_counts(PATH))
    codes = np.array([ord(c) for c in "".join(words) + " zzz"], np.uint32)
    ends = np.cumsum([len(w) for w in words] + [4])
    got = machine.run(codes, ends - [*map(len, words), 4], ends)
    assert got[:-1].tolist() == [len(TOKENIZER.encode(w)) for w in words] and got[-1] == -1
    assert len(fst.Transducer([], fst._library_counts(PATH)).keys)


def test_counts_equal_the_library(spark, documents, odd_rows):
    rows = odd_rows + [(20, "a <|endoftext|> b"), (21, "naïve 中文 😀 it's"), (22, "é" * 999)]
    got = fst.token_counts(documents(rows), over=5).collect()
    want = [(i, len((t or "").encode()), len(TOKENIZER.encode(t or "", add_special_tokens=False))) for i, t in rows]
    assert sorted(map(repr, (tuple(r)[:3] for r in got))) == sorted(map(repr, want))
    assert all(r.over_limit == (r.n_tokens > 5) for r in got)
    assert fst.token_counts(documents([])).count() == 0
