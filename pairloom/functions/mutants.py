"""First-order mutants of a function.

Three steps. A worker lists the *sites* of a function (nodes that can change).
Plain SQL expands each site to its *edits*. A worker applies the edits and
renders the text. Counting needs no rendering, and the edits of one large
function can be spread over many tasks.
"""

import ast
import warnings
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from pairloom.functions.nested import from_arrow, pieces, text_costs, to_arrow

# Fixed values, in the order mutants are numbered.
ARITHMETIC = {
    "+": ast.Add,
    "-": ast.Sub,
    "*": ast.Mult,
    "/": ast.Div,
    "%": ast.Mod,
    "**": ast.Pow,
    "//": ast.FloorDiv,
}
COMPARISON = {
    "==": ast.Eq,
    "!=": ast.NotEq,
    "<": ast.Lt,
    "<=": ast.LtE,
    ">": ast.Gt,
    ">=": ast.GtE,
}
NUMBERS = {
    "0": lambda v: 0,
    "1": lambda v: 1,
    "-1": lambda v: -1,
    "v+1": lambda v: v + 1,
    "v-1": lambda v: v - 1,
}
STRINGS = {
    "empty": lambda v: "",
    "mutated": lambda v: "mutated",
    "suffix": lambda v: v + "_mutated",
}

# Edits that leave a block without what it needs.
UNSAFE = ("EHD", "EXS")

INDENT = "    "
DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
HEADED = (ast.If, ast.While, ast.For, ast.AsyncFor, ast.With, ast.AsyncWith)

SITE = T.StructType(
    [
        T.StructField("node_pos", T.IntegerType()),
        T.StructField("node_type", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("choices", T.ArrayType(T.StringType())),
    ]
)
EDIT = T.StructType(
    [
        T.StructField("operator", T.StringType()),
        T.StructField("node_type", T.StringType()),
        T.StructField("node_pos", T.IntegerType()),
        T.StructField("choice", T.StringType()),
    ]
)
MUTANT = T.StructType(
    [
        T.StructField("operator", T.StringType()),
        T.StructField("node_type", T.StringType()),
        T.StructField("node_pos", T.IntegerType()),
        T.StructField("code", T.StringType()),
        T.StructField("is_valid", T.BooleanType()),
    ]
)

_SITES = pa.list_(
    pa.struct(
        [
            ("node_pos", pa.int32()),
            ("node_type", pa.string()),
            ("op", pa.string()),
            ("choices", pa.list_(pa.string())),
        ]
    )
)
_MUTANTS = pa.list_(
    pa.struct(
        [
            ("operator", pa.string()),
            ("node_type", pa.string()),
            ("node_pos", pa.int32()),
            ("code", pa.string()),
            ("is_valid", pa.bool_()),
        ]
    )
)


def edits_sql(sites: str) -> str:
    """SQL for ``array<EDIT>`` from an ``array<SITE>`` expression, in mutant order.

    An operator outside the fixed set (``&``, ``in``) loses nothing to the
    filter, so it has one edit more.
    """
    arithmetic = "array({})".format(", ".join(f"'{s}'" for s in ARITHMETIC))
    comparison = "array({})".format(", ".join(f"'{s}'" for s in COMPARISON))

    def each(operator: str, choices: str) -> str:
        return (
            f"transform({choices}, c -> named_struct('operator', '{operator}', "
            "'node_type', s.node_type, 'node_pos', s.node_pos, 'choice', c))"
        )

    def one(operator: str) -> str:
        return each(operator, "array(cast(null as string))")

    def others(ops: str) -> str:
        return f"filter({ops}, o -> o <> s.op)"

    return f"""flatten(transform({sites}, s -> CASE s.node_type
        WHEN 'BinOp' THEN concat({each('AOR', others(arithmetic))}, {each('AOD', "array('left', 'right')")})
        WHEN 'AugAssign' THEN {each('ASR_AUG', others(arithmetic))}
        WHEN 'Break' THEN {one('BCR')}
        WHEN 'Continue' THEN {one('BCR')}
        WHEN 'BoolOp' THEN concat({each('LCR', "array(if(s.op = 'and', 'or', 'and'))")}, {each('LOD', 's.choices')})
        WHEN 'If' THEN concat({each('COI', "array('and', 'or')")}, {one('COD_IF')})
        WHEN 'Constant' THEN if(s.op = 'num', {each('CRP_NUM', 's.choices')}, {each('CRP_STR', 's.choices')})
        WHEN 'FunctionDef' THEN concat(
            if(array_contains(s.choices, 'decorated'), {one('DDL')}, array()),
            if(array_contains(s.choices, 'self'), {one('SCI')}, array()))
        WHEN 'Try' THEN {one('EHD')}
        WHEN 'ExceptHandler' THEN {one('EXS')}
        WHEN 'UnaryOp' THEN {one('LOR')}
        WHEN 'Compare' THEN {each('ROR', others(comparison))}
        WHEN 'Call' THEN {one('SCD')}
        WHEN 'Subscript' THEN {one('SIR')}
        WHEN 'Assign' THEN {one('ASR')}
        WHEN 'Return' THEN {one('COD_RET')}
        END))"""


def _symbol(op, table):
    return next((s for s, kind in table.items() if isinstance(op, kind)), "other")


def _site(node):
    """(op, choices) of a node that can change, else None."""
    match node:
        case ast.BinOp() | ast.AugAssign():
            return _symbol(node.op, ARITHMETIC), []
        case ast.Compare():
            return _symbol(node.ops[0], COMPARISON), []
        case ast.BoolOp():
            word = "and" if isinstance(node.op, ast.And) else "or"
            return word, [str(i) for i in range(len(node.values))]
        case ast.Constant(value=int() | float() as v):
            return "num", [c for c, make in NUMBERS.items() if make(v) != v]
        case ast.Constant(value=str() as v):
            return "str", [c for c, make in STRINGS.items() if make(v) != v]
        case ast.FunctionDef():
            is_method = node.args.args and node.args.args[0].arg == "self"
            return None, ["decorated"] * bool(node.decorator_list) + ["self"] * bool(is_method)
        case ast.Try(handlers=[_, *_]) | ast.Call(func=ast.Name(id="super")) | ast.Subscript(slice=ast.Slice()):
            return None, []
        case ast.Break() | ast.Continue() | ast.If() | ast.ExceptHandler() | ast.UnaryOp() | ast.Assign() | ast.Return():
            return None, []


def _edited(node, operator, choice):
    """The node that takes the place of ``node``."""
    match operator:
        case "AOR":
            return ast.BinOp(node.left, ARITHMETIC[choice](), node.right)
        case "AOD":
            return getattr(node, choice)
        case "ASR_AUG":
            return ast.AugAssign(node.target, ARITHMETIC[choice](), node.value)
        case "BCR":
            return ast.Continue() if isinstance(node, ast.Break) else ast.Break()
        case "LCR":
            return ast.BoolOp(ast.And() if choice == "and" else ast.Or(), node.values)
        case "LOD":
            return node.values[int(choice)]
        case "COI":
            op, value = (ast.And(), True) if choice == "and" else (ast.Or(), False)
            return ast.If(ast.BoolOp(op, [node.test, ast.Constant(value)]), node.body, node.orelse)
        case "COD_IF" | "COD_RET":
            return ast.Pass()
        case "CRP_NUM":
            return ast.Constant(NUMBERS[choice](node.value))
        case "CRP_STR":
            return ast.Constant(STRINGS[choice](node.value))
        case "DDL":
            return _copy(node, decorator_list=[])
        case "SCI":
            call = ast.Call(
                ast.Attribute(ast.Call(ast.Name("super"), [], []), node.name),
                [ast.Name(a.arg) for a in node.args.args[1:]],
                [],
            )
            return _copy(node, body=[ast.Expr(call), *node.body])
        case "EHD":
            return _copy(node, handlers=[])
        case "EXS":
            return _copy(node, body=[])
        case "LOR":
            return node.operand if isinstance(node.op, ast.Not) else ast.UnaryOp(ast.Not(), node.operand)
        case "ROR":
            return ast.Compare(node.left, [COMPARISON[choice]()], node.comparators)
        case "SCD":
            return ast.Constant(None)
        case "SIR":
            return ast.Subscript(node.value, ast.Constant(0), node.ctx)
        case "ASR":
            return _copy(node, value=ast.Constant(None))


def _copy(node, **changed):
    copied = type(node)(**{**dict(ast.iter_fields(node)), **changed})
    return ast.copy_location(copied, node)


def _root(code):
    """The first statement of the text; None if there is none or it does not parse."""
    try:
        body = ast.parse(code).body
    except (SyntaxError, RecursionError, MemoryError, ValueError):
        return None
    return body[0] if body else None


def _places(root):
    """Breadth-first (node, put, home, in_header).

    ``put`` sets another node in its place; the root has none. ``home`` is the
    innermost statement around the node whose text does not depend on its
    surroundings: an ``elif`` and an expression that leads a definition, which
    may be or become a docstring, belong to the statement around them.
    ``in_header`` tells that the node is in front of the blocks of its home.
    """
    queue = deque([(root, None, root, False)])
    while queue:
        node, _, home, in_header = place = queue.popleft()
        yield place
        for field, value in ast.iter_fields(node):
            opens = in_header or (node is home and isinstance(node, HEADED) and field not in ("body", "orelse"))
            if isinstance(value, ast.AST):
                queue.append((value, lambda new, n=node, f=field: setattr(n, f, new), home, opens))
            elif isinstance(value, list):
                for i, item in enumerate(value):
                    if isinstance(item, ast.AST):
                        leads = i == 0 and field == "body" and isinstance(item, ast.Expr) and isinstance(node, DEFINITIONS)
                        is_elif = field == "orelse" and len(value) == 1 and isinstance(item, ast.If)
                        own = isinstance(item, ast.stmt) and not leads and not is_elif
                        put = lambda new, v=value, i=i: v.__setitem__(i, new)
                        queue.append((item, put, item, False) if own else (item, put, home, opens))


def _text(node):
    try:
        return ast.unparse(node)
    except (RecursionError, ValueError):
        return None


def _printed(root):
    """The text lines of ``root``, and by node id where its statements stand in them.

    Empty when the text does not parse back to the same statements.
    """
    text = _text(root)
    again = _root(text) if text is not None else None
    if again is None:
        return [], {}
    old, new = ([n for n in ast.walk(t) if isinstance(n, ast.stmt)] for t in (root, again))
    if list(map(type, old)) != list(map(type, new)):
        return [], {}
    return text.split("\n"), {id(o): n for o, n in zip(old, new)}


def _first_line(place):
    return min([place.lineno, *(d.lineno for d in getattr(place, "decorator_list", ()))])


def _spliced(lines, place, statement, header_only):
    """The text with ``statement`` at ``place``, and what was printed for it.

    Only that statement is printed, or only what stands in front of its
    blocks. Blocks need their depth, so they are printed inside as many
    others; elsewhere a further line can only be the inside of a string.
    """
    first, last = _first_line(place), place.end_lineno
    depth = place.col_offset // 4
    if header_only:
        statement = _copy(statement, **{f: [ast.Pass()] if f == "body" else [] for f in ("body", "orelse") if hasattr(statement, f)})
        last = _first_line(place.body[0]) - 1
        while not lines[last - 1]:
            last -= 1
    inside = not header_only and hasattr(statement, "body") or isinstance(statement, ast.Match)
    for _ in range(depth if inside else 0):
        statement = ast.If(ast.Constant(True), [statement], [])
    alone = _text(statement)
    if alone is None:
        return None, None
    piece = alone.split("\n")
    if inside:
        piece = piece[depth:]
        while not piece[0]:
            piece = piece[1:]
    else:
        piece = [INDENT * depth + piece[0], *(piece[1:-1] if header_only else piece[1:])]
    return "\n".join([*lines[: first - 1], *piece, *lines[last:]]), alone


def _fragile(home):
    """Whether an edit can make text that does not parse: patterns take few expressions, f-strings limit quotes."""
    return any(isinstance(n, (ast.match_case, ast.JoinedStr)) for n in ast.walk(home))


def sites(code):
    root = _root(code)
    if root is None:
        return []
    found = ((i, node, _site(node)) for i, node in enumerate(ast.walk(root)))
    return [
        dict(node_pos=i, node_type=type(node).__name__, op=site[0], choices=site[1])
        for i, node, site in found
        if site is not None
    ]


def rendered(code, edits):
    """Apply each edit to the text on its own. The root itself can not be replaced: its edits change nothing."""
    root = _root(code)
    if root is None:
        return []
    places = list(_places(root))
    lines, printed = _printed(root)
    fragile = {}
    out = []
    for edit in edits:
        node, put, home, in_header = places[edit["node_pos"]]
        new = node
        if put is not None:
            new = _edited(node, edit["operator"], edit["choice"])
            put(new)
        place = printed.get(id(home))
        if place is None or home is root:
            text = printed_part = _text(root)
            check = True
        else:
            statement = new if home is node else home
            header_only = in_header or (home is node and isinstance(new, HEADED))
            text, printed_part = _spliced(lines, place, statement, header_only)
            if id(home) not in fragile:
                fragile[id(home)] = _fragile(home)
            check = fragile[id(home)] or edit["operator"] in UNSAFE
        if put is not None:
            put(node)
        valid = text is not None and (not check or _root(printed_part) is not None)
        out.append({**edit, "code": text, "is_valid": valid})
    return out


@arrow_udf(T.ArrayType(SITE))
def mutation_sites(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for codes in batches:
        for piece in pieces(text_costs(codes).to_pylist()):
            yield _sites_of(codes.slice(*piece))


def _sites_of(codes):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return to_arrow([None if c is None else sites(c) for c in codes.to_pylist()], _SITES)


@arrow_udf(T.ArrayType(MUTANT))
def render_edits(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for codes, edits in batches:
        texts = pc.add(pc.fill_null(pc.list_value_length(edits), 0).cast(pa.int64()), 1)
        for piece in pieces(pc.multiply(texts, text_costs(codes)).to_pylist()):
            yield _rendered_all(codes.slice(*piece), edits.slice(*piece))


def _rendered_all(codes, edits):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        work = zip(codes.to_pylist(), from_arrow(edits))
        return to_arrow([None if c is None else rendered(c, e) for c, e in work], _MUTANTS)
