import random

from pairloom.operators.extract import collapse_across_files, extract_functions, files_with_tests, extract_tests
from pairloom.operators.joins import attach_content, heavy_keys, keep_known, narrow_to, skip_known
from pairloom.operators.pairing import KEYS, _both_sides, pair_by_test_file, pair_listed, unmatched_by_test_file, unmatched_listed
from pairloom.operators.stats import repo_stats, run_totals
from pairloom.operators.validate import source_files
from pairloom.operators.winners import file_order, numbered, winners
from pairloom.plans.mine import mine_by_test_file, mine_listed
from pairloom.session import stored

SCHEMA = "repository_full_name string, file_path string, file_pos long, content string"


def make(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def fn(name, mark):
    return f"def {name}():\n    return {mark}\n"


def listed_pairs(spark, rows):
    return sorted(tuple(r) for r in pair_listed(extract_functions(make(spark, rows))).collect())


def test_one_pair(spark):
    rows = [("o/a", "source.py", 0, "def add(a, b):\n    return a + b"), ("o/a", "test_source.py", 1, "def test_add():\n    assert add(1, 2) == 3")]
    assert listed_pairs(spark, rows) == [
        ("add", "def add(a, b):\n    return a + b", "source.py", "test_add", "def test_add():\n    assert add(1, 2) == 3", "test_source.py", "o/a")
    ]


def test_names_that_do_not_pair(spark):
    rows = [
        ("o/a", "a.py", 0, fn("test_foo", 1)),
        ("o/a", "t.py", 1, fn("test_test_foo", 2) + "\n" + fn("test_", 3)),
        ("o/b", "a.py", 0, fn("add", 4)),  # other repository
        ("o/a", "t2.py", 2, fn("test_add", 5)),
    ]
    assert listed_pairs(spark, rows) == []
    left = {r.test_function_name for r in unmatched_listed(extract_functions(make(spark, rows))).collect()}
    assert left == {"test_foo", "test_test_foo", "test_", "test_add"}


def test_candidates_of_mode_a_may_be_named_like_tests(spark):
    rows = make(spark, [("o/a", "a.py", 0, fn("test_foo", 1)), ("o/a", "tests/t.py", 1, fn("test_test_foo", 2))])
    pairs = pair_by_test_file(extract_tests(rows.where("file_path like 'tests/%'")), extract_functions(source_files(rows), True))
    assert [(r.code_file, r.test_file) for r in pairs.collect()] == [("a.py", "tests/t.py")]


def random_repository(seed, repos=3, files=40, names=12):
    """One repository has most files, and one name most functions."""
    rng = random.Random(seed)
    rows = []
    for i in range(files * repos):
        repo = "o/hot" if rng.random() < 0.6 else f"o/r{rng.randrange(repos)}"
        folder = rng.choice(["", "src/", "pkg/sub/", "tests/", "src/latest/"])
        bodies = []
        for _ in range(rng.randint(0, 4)):
            name = "main" if rng.random() < 0.4 else f"f{rng.randrange(names)}"
            bodies.append(fn(("test_" if rng.random() < 0.5 else "") + name, rng.randrange(10**6)))
        rows.append((repo, f"{folder}m{i}.py", i, "\n".join(bodies) if rng.random() < 0.95 else "def ("))
    return rows


def functions_in(content):
    """name -> code, later ones win; all functions here are one level deep."""
    if content == "def (":
        return {}
    return {b[4 : b.index("(")]: b.rstrip("\n") for b in content.split("\n\n") if b}


def brute_listed(rows):
    out = []
    for repo in {r[0] for r in rows}:
        tests, functions = {}, {}
        for _, path, _, content in sorted((r for r in rows if r[0] == repo), key=lambda r: r[2]):
            for name, code in functions_in(content).items():
                (tests if name.startswith("test_") else functions)[name] = (code, path)
        for name, (code, path) in tests.items():
            if name[5:] in functions:
                out.append((name[5:], *functions[name[5:]], name, code, path, repo))
    return sorted(out)


def breadth_first(path):
    return path.count("/"), path.split("/")


def brute_by_file(rows, listed):
    out = []
    for repo, test_path, _, content in listed:
        sources = sorted((r for r in rows if r[0] == repo and r[1].endswith(".py") and "test" not in r[1].lower()), key=lambda r: breadth_first(r[1]))
        for name, code in functions_in(content).items():
            if not name.startswith("test_"):
                continue
            for _, path, _, text in sources:
                if name[5:] in functions_in(text):
                    out.append((functions_in(text)[name[5:]], code, repo, path, test_path))
                    break
    return sorted(out)


def test_mode_b_against_brute_force(spark):
    for seed in range(4):
        rows = random_repository(seed)
        want = brute_listed(rows)
        assert listed_pairs(spark, rows) == want and want
        random.Random(seed).shuffle(rows)
        assert listed_pairs(spark, rows) == want


def test_mode_a_against_brute_force_with_and_without_salting(spark):
    for seed in range(3):
        rows = random_repository(seed)
        listed = [r for r in rows if r[1].startswith("tests/")]
        tests, candidates = extract_tests(make(spark, listed)), extract_functions(source_files(make(spark, rows)), True)
        want = brute_by_file(rows, listed)
        for hot in (None, heavy_keys(tests, KEYS, 2), heavy_keys(tests, KEYS)):
            assert sorted(tuple(r) for r in pair_by_test_file(tests, candidates, hot).collect()) == want
        unmatched = unmatched_by_test_file(tests, candidates).count()
        assert unmatched == unmatched_by_test_file(tests, candidates, heavy_keys(tests, KEYS, 2)).count()
        assert unmatched + len(want) == tests.count()


def test_narrowing_keeps_what_pairs(spark):
    functions = stored(extract_functions(make(spark, random_repository(6))), "functions")
    asked = stored(functions.where("is_test").select(*KEYS).distinct(), "asked")
    want = sorted(functions.join(asked, KEYS, "left_semi").select(*functions.columns).collect())
    assert 0 < len(want) < functions.count()
    assert sorted(narrow_to(functions, asked, KEYS).collect()) == want
    sieved = narrow_to(functions, asked, KEYS, rows=0)
    assert set(sieved.collect()) >= set(want)
    # A Bloom filter lets few others pass, and needs no exchange of the rows.
    assert sieved.count() <= len(want) + 5
    assert "Exchange hashpartitioning" not in plan_of(sieved)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_have_one_row_per_repository_and_name(spark):
    pairs = pair_listed(extract_functions(make(spark, random_repository(9))))
    assert pairs.count() == pairs.select("repository", "function_name").distinct().count()


def wide(plan):
    """Operators of a plan that sort, aggregate or shuffle and have code among their columns."""
    return [line for line in plan.split("\n") if "code#" in line and ("Aggregate" in line or "Exchange" in line)]


def test_names_find_the_pairs_by_hash(spark):
    functions = numbered(extract_functions(make(spark, random_repository(1))))
    plan = plan_of(_both_sides(functions))
    assert "SortAggregate" not in plan and "partial_max_by" in plan and not wide(plan)
    assert "ReadSchema: struct<file_pos:bigint,fn_pos:int,is_test:boolean" in plan.replace("repository_full_name:string,", "") and "code:string" not in plan
    plan = plan_of(pair_listed(functions))
    assert "SortAggregate" not in plan


def test_beyond_a_broadcast_only_winners_are_shuffled(spark):
    functions = numbered(extract_functions(make(spark, random_repository(2))))
    keys = ["repository_full_name", "name"]
    want = sorted(winners(functions, keys, file_order()).collect())
    far = winners(functions, keys, file_order(), most=0)
    assert sorted(far.collect()) == want and "SortAggregate" not in plan_of(far)
    assert len({(r.repository_full_name, r.name) for r in want}) == len(want)


def test_collapse_across_files_takes_the_last(spark):
    rows = [("o/a", "a.py", 5, fn("f", 1)), ("o/a", "b.py", 2, fn("f", 2)), ("o/b", "c.py", 1, fn("f", 3))]
    got = {(r.repository_full_name, r.file_path) for r in collapse_across_files(extract_functions(make(spark, rows))).collect()}
    assert got == {("o/a", "a.py"), ("o/b", "c.py")}


def test_ledger_joins_agree_on_both_paths(spark):
    rows = make(spark, random_repository(2))
    ledger = spark.createDataFrame([("o/hot",), ("o/hot",), ("o/none",)], "repository_full_name string")
    for join, want in ((skip_known, "repository_full_name <> 'o/hot'"), (keep_known, "repository_full_name = 'o/hot'")):
        expected = sorted(rows.where(want).collect())
        for bound in (0, 10):
            got = join(rows, ledger, ["repository_full_name"], rows=bound)
            assert sorted(got.collect()) == expected
            assert got.columns == rows.columns


def test_attach_content_drops_files_that_never_arrived(spark):
    listed = spark.createDataFrame([("o/a", "a.py", 3), ("o/a", "gone.py", 4)], "repository_full_name string, file_path string, file_pos long")
    landed = make(spark, [("o/a", "a.py", 0, "x"), ("o/a", "other.py", 0, "y")]).drop("file_pos")
    for bound in (0, 10):
        assert [(r.file_path, r.file_pos, r.content) for r in attach_content(listed, landed, bound).collect()] == [("a.py", 3, "x")]


def test_stats_keep_zeros_and_add_up(spark):
    rows = random_repository(3) + [("o/zero", "a.py", 0, "x = 1")]
    pairs = pair_listed(extract_functions(make(spark, rows)))
    stats = repo_stats(make(spark, rows), pairs)
    counts = {r.repository: r.num_pairs for r in stats.collect()}
    assert counts["o/zero"] == 0 and set(counts) == {r[0] for r in rows}
    totals = run_totals(stats).first()
    assert totals.total_pairs == sum(counts.values()) == pairs.count()
    assert (totals.repos_done, totals.repos_with_pairs) == (len(counts), sum(n > 0 for n in counts.values()))
    assert run_totals(stats.limit(0)).first().total_pairs == 0


def test_whole_jobs(spark):
    rows = random_repository(4)
    files = make(spark, rows)
    listed, contents = files.drop("content"), files.drop("file_pos")
    done = spark.createDataFrame([("o/r1",)], "repository_full_name string")
    mined = mine_listed(listed, contents, done)
    todo = [r for r in rows if r[0] != "o/r1"]
    assert sorted(tuple(r) for r in mined.pairs.collect()) == brute_listed(todo)
    assert {r[0] for r in mined.done.collect()} == {r[0] for r in todo}

    tests = listed.where("file_path like 'tests/%'")
    ledger = tests.where("file_pos % 2 = 0").select("repository_full_name", "file_path")
    wanted = [r for r in rows if r[1].startswith("tests/") and r[2] % 2]
    want = brute_by_file(rows, wanted)
    mined = mine_by_test_file(tests, contents, ledger)
    assert sorted(tuple(r) for r in mined.pairs.collect()) == want
    with_tests = {(r[0], r[1]) for r in wanted if any(n.startswith("test_") for n in functions_in(r[3]))}
    assert {tuple(r) for r in mined.done.collect()} == with_tests
    twice = mine_by_test_file(tests.unionByName(tests), contents, ledger, keep_duplicates=True)
    assert sorted(tuple(r) for r in twice.pairs.collect()) == sorted(want + want)


def test_files_with_tests(spark):
    rows = [("o/a", "tests/a.py", 0, fn("test_x", 1)), ("o/a", "tests/b.py", 1, fn("helper", 1))]
    assert [r.file_path for r in files_with_tests(extract_tests(make(spark, rows))).collect()] == ["tests/a.py"]
