"""The Python parser as an Arrow function: file text in, its functions out."""

import ast
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from pairloom.functions.nested import pieces, text_costs, to_arrow
from pairloom.schemas import PARSED

LINE_END = re.compile(rb"\r\n|\r|\n")

_FUNCTIONS = pa.list_(
    pa.struct(
        [
            ("fn_pos", pa.int32()),
            ("name", pa.string()),
            ("code", pa.string()),
            ("parse_status", pa.string()),
        ]
    )
)


def file_functions(source, last_only=False):
    """Rows for every plain ``def`` of a file, breadth first, methods and nested ones included.

    The code starts at the keyword: no decorators, no indentation of the first
    line. ``last_only`` keeps one row per name, the last. Text that does not
    parse gives one row without a name; so does a file without functions.
    """
    try:
        tree = ast.parse(source)
        found = [n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef)]
        status = "ok"
    except SyntaxError:
        found, status = [], "syntax_error"
    except (RecursionError, MemoryError, ValueError):
        found, status = [], "error"
    if not found:
        return [dict(fn_pos=None, name=None, code=None, parse_status=status)]

    # Node positions count bytes, so slice bytes; one pass finds all line starts.
    raw = source.encode()
    starts = [0, *(m.end() for m in LINE_END.finditer(raw))]
    numbered = list(enumerate(found))
    if last_only:
        numbered = sorted({node.name: (i, node) for i, node in numbered}.values())
    return [
        dict(
            fn_pos=i,
            name=node.name,
            code=raw[
                starts[node.lineno - 1] + node.col_offset : starts[node.end_lineno - 1]
                + node.end_col_offset
            ].decode(),
            parse_status=status,
        )
        for i, node in numbered
    ]


def _over_batches(batches, last_only):
    for sources in batches:
        for piece in pieces(text_costs(sources).to_pylist()):
            yield _over_piece(sources.slice(*piece), last_only)


def _over_piece(sources, last_only):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        found = [None if s is None else file_functions(s, last_only) for s in sources.to_pylist()]
    return to_arrow(found, _FUNCTIONS)


@arrow_udf(T.ArrayType(PARSED))
def functions_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return _over_batches(batches, last_only=False)


@arrow_udf(T.ArrayType(PARSED))
def last_functions_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return _over_batches(batches, last_only=True)
