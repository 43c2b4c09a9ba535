import pyarrow as pa

from pairloom.functions.nested import OBJECT, from_arrow, pieces, text_costs, to_arrow

KIND = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.list_(pa.string()))]))
GROUPS = [[dict(a=1, b=["x", "é"]), dict(a=None, b=[])], None, [], [dict(a=3, b=None)]]


def test_both_ways():
    assert to_arrow(GROUPS, KIND).to_pylist() == GROUPS
    assert to_arrow(GROUPS, KIND).type == KIND
    assert from_arrow(pa.array(GROUPS, KIND)) == [g or [] for g in GROUPS]
    assert from_arrow(pa.array(GROUPS, KIND).slice(2)) == [[], GROUPS[3]]
    for empty in ([], [[]], [None]):
        assert to_arrow(empty, KIND).to_pylist() == empty


def test_pieces_cover_all_rows_once():
    assert list(pieces([], 10)) == []
    assert list(pieces([4, 6, 1, 50, 2, 3], 10)) == [(0, 2), (2, 1), (3, 1), (4, 2)]
    assert list(pieces([50], 10)) == [(0, 1)]
    assert text_costs(pa.array(["ab", None, ""])).to_pylist() == [OBJECT + 2, OBJECT, OBJECT]
