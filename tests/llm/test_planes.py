import zlib

from hypothesis import given, settings, strategies as st
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import prose
from pairloom.llm import planes
from pairloom.session import scratch_path

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
AWKWARD = ["it's we'll 'sun", " \n\n x  y\t", "a<|endoftext|>b <|endoftext|>", "naïve 中文 😀 ²3", "''s !'re", "x" * 5000, "   z"]


@pytest.mark.parametrize("mode", [planes.BYTE, planes.BIT])
@settings(max_examples=40, deadline=None)
@given(ids=st.lists(st.integers(0, 2**32 - 1), max_size=70), block=st.integers(1, 20))
def test_planes_round_trip(mode, ids, block):
    ids = np.array(ids, np.uint32)
    assert (planes.unpacked(*planes.packed(ids, mode, block), mode) == ids).all()


def brute(rows):
    out, at = [], 0
    for doc_id, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or "")):
        ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids + [planes.END_ID]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("mode", [planes.BYTE, planes.BIT])
def test_files_hold_the_ids_of_the_library(spark, documents, odd_rows, mode):
    rows = [r for r in odd_rows if r[0] not in (5, 6)] + [(100 + i, t) for i, t in enumerate(AWKWARD)] + [(50, prose(1, 3000))]
    got = planes.binary_output(documents(rows), mode=mode, block=64, chunk=500)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_ids_themselves(spark, documents):
    path = scratch_path(spark, "test-planes")
    planes.write_ids(documents([(2, "b c"), (1, "a")]), path, end_id=7)
    got = {r.doc_id: r.ids for r in planes.read_ids(spark, path).collect()}
    assert got == {1: TOKENIZER.encode("a").ids + [7], 2: TOKENIZER.encode("b c").ids + [7]}


def test_empty_table(spark, documents):
    assert planes.binary_output(documents([])).count() == 0
