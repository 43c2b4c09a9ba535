import ast
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairloom.functions import mutants as module, nested
from pairloom.functions.python_source import functions_of
from pairloom.functions.sql import register
from pairloom.operators.extract import extract_functions
from pairloom.operators.mutate import mutant_counts, mutant_plan, mutants

GOLDEN = {
    "tally": (
        "def tally(box, n):\n    box.note = 'full'\n    if n >= 10:\n        return n - 1",
        dict(ASR=1, CRP_STR=3, COI=2, COD_IF=1, ROR=5, CRP_NUM=9, COD_RET=1, AOR=6, AOD=2),
    ),
    "add": ("def add(a, b):\n    return a + b", dict(COD_RET=1, AOR=6, AOD=2)),
    "f": ("def f(a, b):\n    if a > 17:\n        return a + b\n    return b", dict(COI=2, COD_IF=1, COD_RET=2, ROR=5, CRP_NUM=5, AOR=6, AOD=2)),
    "g": (
        "def g(xs):\n    total = 0\n    for x in xs[1:]:\n        if x < 0 and not x == -1:\n            continue\n        total += x\n    return total",
        dict(ASR=1, COD_RET=1, CRP_NUM=16, SIR=1, COI=2, COD_IF=1, ASR_AUG=6, LCR=1, LOD=2, BCR=1, ROR=10, LOR=2),
    ),
    "h": (
        "@dec\ndef h(self, k=''):\n    try:\n        return super().h(k)\n    except ValueError:\n        return None",
        dict(DDL=1, SCI=1, EHD=1, CRP_STR=2, COD_RET=2, EXS=1, SCD=1),
    ),
    "r": ("def r(a, b, c): return a < b < c or a in b or a & b", dict(COD_RET=1, LCR=1, LOD=3, ROR=11, AOR=7, AOD=2)),
}


def table(spark, codes):
    return spark.createDataFrame(list(codes.items()), "id string, code string")


def rows(spark, code, **kw):
    return sorted(mutants(table(spark, {"x": code}), **kw).collect(), key=lambda r: r.mutant_idx)


def test_golden_counts(spark):
    df = table(spark, {k: v[0] for k, v in GOLDEN.items()})
    got = {}
    for r in mutant_counts(df, ["id"]).collect():
        got.setdefault(r.id, {})[r.operator] = r.num_mutants
    assert got == {k: v[1] for k, v in GOLDEN.items()}
    rendered = {r.id: r["count"] for r in mutants(df).groupBy("id").count().collect()}
    assert rendered == {k: sum(v[1].values()) for k, v in GOLDEN.items()}


def test_chunks_and_tasks_do_not_change_the_rows(spark):
    df = table(spark, {k: v[0] for k, v in GOLDEN.items()})
    want = sorted(mutants(df).collect())
    assert want == sorted(mutants(df, chunk=1, tasks=3).collect()) == sorted(mutants(df, chunk=7, tasks=1).collect())
    assert want == sorted(mutants(df, chunk_chars=100).collect()) == sorted(mutants(df, chunk_chars=1).collect())
    plan = mutant_plan(df).select("id", "mutant_idx", "operator", "node_pos")
    assert sorted(plan.collect()) == sorted((r.id, r.mutant_idx, r.operator, r.node_pos) for r in want)


def test_python_runs_once_per_step(spark, tmp_path):
    table(spark, {k: v[0] for k, v in GOLDEN.items()}).write.parquet(f"{tmp_path}/f")
    df = spark.read.parquet(f"{tmp_path}/f")
    for rows, steps in ((mutant_counts(df, ["id"]), 1), (mutant_plan(df), 1), (mutants(df), 2)):
        assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == steps


CASES = [
    ("ROR", "def f(a, b, c):\n    return a < b < c", "def f(a, b, c):\n    return a > b"),
    ("ROR", "def f(a, b):\n    return a in b", "def f(a, b):\n    return a == b"),
    ("COI", "def f(a):\n    if a:\n        g()", "def f(a):\n    if a and True:\n        g()"),
    ("COI", "def f(a):\n    if a:\n        g()", "def f(a):\n    if a or False:\n        g()"),
    ("COD_IF", "def f(a):\n    if a:\n        g()\n    else:\n        h()", "def f(a):\n    pass"),
    ("COD_IF", "def f(a):\n    if a:\n        g()\n    elif b:\n        h()", "def f(a):\n    if a:\n        g()\n    else:\n        pass"),
    ("BCR", "def f():\n    while x:\n        break", "def f():\n    while x:\n        continue"),
    ("BCR", "def f():\n    while x:\n        continue", "def f():\n    while x:\n        break"),
    ("LCR", "def f(a, b):\n    return a and b", "def f(a, b):\n    return a or b"),
    ("LOD", "def f(a, b):\n    return a and b", "def f(a, b):\n    return b"),
    ("AOD", "def f(a, b):\n    return a @ b", "def f(a, b):\n    return a"),
    ("AOR", "def f(a, b):\n    return (a + b) * 2", "def f(a, b):\n    return a + b + 2"),
    ("ASR_AUG", "def f(a):\n    a += 1", "def f(a):\n    a **= 1"),
    ("ASR", "def f(a):\n    a = b = 1", "def f(a):\n    a = b = None"),
    ("LOR", "def f(a):\n    return not a", "def f(a):\n    return a"),
    ("LOR", "def f(a):\n    return ~a", "def f(a):\n    return not a"),
    ("SIR", "def f(a):\n    return a[1:]", "def f(a):\n    return a[0]"),
    ("SCD", "def f(a):\n    super().g()", "def f(a):\n    None.g()"),
    ("CRP_STR", "def f():\n    'doc'", 'def f():\n    """mutated"""'),
    ("CRP_STR", "def f(x):\n    return f'a{x}'", "def f(x):\n    return f'a_mutated{x}'"),
    ("CRP_NUM", "def f():\n    return 1.5", "def f():\n    return 0.5"),
    ("CRP_NUM", "def f():\n    return True", "def f():\n    return 2"),
    ("SCI", "class C:\n    def f(self, a, *b, c=1):\n        pass", "class C:\n\n    def f(self, a, *b, c=1):\n        super().f(a)\n        pass"),
    ("DDL", "class C:\n    @d\n    def f(a):\n        pass", "class C:\n\n    def f(a):\n        pass"),
    ("EHD", "def f():\n    try:\n        g()\n    except E:\n        h()\n    finally:\n        i()", "def f():\n    try:\n        g()\n    finally:\n        i()"),
    ("COD_RET", "def f():\n    return 1", "def f():\n    pass"),
]


@pytest.fixture(scope="module")
def case_rows(spark):
    df = spark.createDataFrame([(i, c[1]) for i, c in enumerate(CASES)], "i int, code string")
    out = {}
    for r in mutants(df).collect():
        out.setdefault(r.i, []).append(r)
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_texts(case_rows, i):
    operator, _, want = CASES[i]
    found = [r for r in case_rows[i] if r.operator == operator and r.code == want]
    assert found and not any(r.is_noop for r in found)


def test_not_mutated(spark):
    for code in ("async def f():\n    x: int = None\n    return_ = b'1'[a:b, c:d] if (yield) else ...", "class C:\n    pass", "x", "", "def f(:"):
        got = {r.operator for r in rows(spark, code)}
        assert got <= {"ASR"}, (code, got)
    no_exc = {r.operator for r in rows(spark, "def f():\n    try:\n        g()\n    finally:\n        h()")}
    assert no_exc == set()


def test_numbers_compare_like_python(spark):
    def count(literal):
        return sum(r.operator == "CRP_NUM" for r in rows(spark, f"def f():\n    g({literal})"))

    assert [count(x) for x in ("0", "1", "2", "True", "False", "1e999", "1e16", "0.0", "1j", "10**2")] == [4, 4, 5, 4, 4, 3, 3, 4, 0, 10]


def test_root_edits_change_nothing_and_are_kept(spark):
    got = rows(spark, "@d\ndef f(self):\n    pass")
    assert [(r.operator, r.is_noop, r.code) for r in got] == [(o, True, "@d\ndef f(self):\n    pass") for o in ("DDL", "SCI")]
    assert [r.is_noop for r in rows(spark, "x = g() + h()")] == [True] + [False] * 8


def test_invalid_texts_are_flagged(spark):
    got = {r.operator: r.is_valid for r in rows(spark, "def f():\n    try:\n        g()\n    except E:\n        h()")}
    assert got == {"EHD": False, "EXS": False}
    match = rows(spark, "def f(x):\n    match x:\n        case -1:\n            pass")
    assert {r.operator: r.is_valid for r in match if r.operator == "LOR"} == {"LOR": False}


def test_huge_numbers_have_no_text(spark):
    got = rows(spark, "def f():\n    return 0x1" + "0" * 5000)
    by_text = {(r.operator, r.code) for r in got if r.is_valid}
    assert by_text == {("COD_RET", "def f():\n    pass"), *(("CRP_NUM", f"def f():\n    return {n}") for n in (0, 1, -1))}
    assert sum(r.code is None and not r.is_valid for r in got) == 2


def test_first_statement_is_the_target(spark):
    got = rows(spark, "def f():\n    return 1\n\ndef g():\n    return 2")
    assert all("def g" not in r.code for r in got)


def test_long_function_is_spread_over_rows(spark):
    code = "def f(a):\n" + "".join(f"    a += {i + 2}\n" for i in range(300))
    got = rows(spark, code, chunk=50)
    assert [r.mutant_idx for r in got] == list(range(300 * 11))


def library_codes(*names):
    folder = os.path.dirname(ast.__file__)
    codes = {}
    for name in names:
        source = open(f"{folder}/{name}.py", encoding="utf-8").read()
        for node in ast.walk(ast.parse(source)):
            if isinstance(node, ast.FunctionDef):
                codes[f"{name}.{node.name}.{node.lineno}"] = ast.get_source_segment(source, node)
    return codes


TRICKY = [
    """def f():
    'a\\n  b'
    def g():
        'x'
        return 1
    return g""",
    """def f():
    'a' + x
    return 1""",
    """def f(x):
    if x == 1:
        a()
    elif x == 2:
        b()
    elif x == 3:
        c()
    else:
        d(4)""",
    """def f(x):
    if x:
        return f'a\\n{x + 1:>{2}}\\nb' + 'c'""",
    """def f(x):
    match x:
        case 1 if x > 2:
            return x[1:]
        case 'a' | -2:
            x += 1""",
    """class C:
    @d(1)
    def f(self, a=1):
        with open('x') as g, h:
            try:
                return a + 1
            except (E, F) as e:
                raise G(2) from e
            else:
                return 3
            finally:
                del a[1:2]""",
    "def f(x): a = 1; b = 2; return not x",
]

SOME_EDITS = {
    "BinOp": [("AOR", "**"), ("AOD", "left")],
    "If": [("COI", "or"), ("COD_IF", None)],
    "Return": [("COD_RET", None)],
    "Compare": [("ROR", "<")],
    "Try": [("EHD", None)],
    "ExceptHandler": [("EXS", None)],
    "Assign": [("ASR", None)],
    "AugAssign": [("ASR_AUG", "/")],
    "UnaryOp": [("LOR", None)],
    "BoolOp": [("LOD", "0")],
    "Subscript": [("SIR", None)],
}


def some_edits(code):
    for s in module.sites(code):
        constants = [("CRP_NUM" if s["op"] == "num" else "CRP_STR", c) for c in s["choices"]]
        for operator, choice in constants if s["node_type"] == "Constant" else SOME_EDITS.get(s["node_type"], []):
            yield dict(operator=operator, node_type=s["node_type"], node_pos=s["node_pos"], choice=choice)


def test_printing_one_statement_equals_printing_all(monkeypatch):
    codes = [*library_codes("textwrap", "heapq", "fnmatch", "configparser").values(), *TRICKY]
    plans = [list(some_edits(code)) for code in codes]
    short = [module.rendered(c, e) for c, e in zip(codes, plans)]
    monkeypatch.setattr(module, "_printed", lambda root: ([], {}))
    assert short == [module.rendered(c, e) for c, e in zip(codes, plans)]
    assert sum(map(len, short)) > 1500


def test_library_functions_render(spark):
    codes = library_codes("textwrap", "bisect", "shlex", "heapq")
    got = mutants(table(spark, codes)).collect()
    assert len(got) > 1500
    for r in got:
        assert r.code == ast.unparse(ast.parse(codes[r.id])) if r.is_noop else r.code is not None
        if r.is_valid:
            ast.parse(r.code)


def test_sql_functions(spark):
    register(spark)
    df = table(spark, {k: v[0] for k, v in GOLDEN.items()})
    df.createOrReplaceTempView("golden")
    got = spark.sql(
        "SELECT id, m.* FROM (SELECT *, mutation_edits(code) AS edits FROM golden) g, LATERAL mutate_function(g.code, g.edits) m"
    )
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    want = mutants(df).select("id", "mutant_idx", "operator", "node_type", "node_pos", F.col("code").alias("mutant"), "is_noop", "is_valid")
    assert sorted(got.collect()) == sorted(want.collect())
    names = spark.sql("SELECT f.name FROM golden, LATERAL extract_functions(code) f")
    assert "Join" not in names._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.name for r in names.collect()) == sorted(GOLDEN)


def test_a_worker_holds_a_piece_of_a_batch():
    code = "def f(a):\n" + "    a += 1\n" * 500
    n, edits = 60, list(some_edits(code))[:64]
    codes = pa.array([code, None] * n)
    planned = nested.to_arrow([edits, None] * n, pa.list_(pa.struct([(k, pa.int32() if k == "node_pos" else pa.string()) for k in edits[0]])))
    sent = list(module.render_edits.func(iter([(codes, planned), (codes, planned)])))
    assert sum(a.nbytes for a in sent) > 8 * nested.PIECE
    assert max(a.nbytes for a in sent) <= nested.PIECE
    want = [{k: v for k, v in m.items() if k != "choice"} for m in module.rendered(code, edits)]
    assert [row for a in sent for row in a.to_pylist()] == [want, None] * 2 * n
    for function in (module.mutation_sites, functions_of):
        texts = pa.array(["def g():\n    # " + "c" * 100_000 + f"\n    return {i}" for i in range(100)])
        assert [len(a) for a in function.func(iter([texts]))] == [41, 41, 18]


def test_pieces_stay_with_their_rows(spark):
    n, comment = 2500, "c" * 4000
    text = F.concat(F.lit("def f_"), "id", F.lit(f"(x):\n    # {comment}\n    return x + "), F.col("id") + 10)
    files = spark.range(0, n, 1, 1).select(
        F.lit("r").alias("repository_full_name"), F.col("id").cast("string").alias("file_path"), F.col("id").alias("file_pos"), text.alias("content")
    )
    found = mutants(extract_functions(files).select("file_path", "name", "code"), tasks=1)
    own = F.col("name") == F.concat(F.lit("f_"), "file_path")
    same = own & F.startswith("code", F.concat(F.lit("def "), "name", F.lit("(x):\n")))
    got = found.groupBy("file_path").agg(F.count("*").alias("n"), F.count_if(same).alias("same"), F.max("mutant_idx").alias("last"))
    assert got.groupBy("n", "same", "last").count().collect() == [(14, 14, 13, n)]
