"""Named queries over the given tables, and SQL that must give the same rows."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairloom.functions.names import file_key, is_source_file, tree_order
from pairloom.functions.sql import register
from pairloom.operators import curate, extract, joins, mutate, pairing, split, stats, validate
from pairloom.plans import inputs
from pairloom.plans.curate import merge_pair_files, write_input_output, write_instructions, write_item_splits
from pairloom.plans.mine import mine_by_test_file, mine_listed
from pairloom.schemas import FILE_LEDGER, FUNCTION_PAIRS
from pairloom.session import scratch_path, spread, stored, tune
from pairloom.sinks import tables
from pairloom.sources import archives, bucketed, files as file_sources, items as item_sources, json_arrays, state
from pairloom.streaming import dedup, incremental
from pairloom.streaming.commits import CommittedTable
from pairloom.streaming.merged import MergedSet
from pairloom.streaming.parse_cache import ParseCache

QUERIES = {}
ORACLES = {}


def query(oracle: str | None = None):
    def add(run):
        QUERIES[run.__name__] = lambda spark, sf_dir: run(tune(spark), sf_dir)
        if oracle is not None:
            ORACLES[run.__name__] = oracle
        return run

    return add


# --- inputs ---------------------------------------------------------------


def code_files(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.derived(spark, sf, inputs.CODE_FILES, "part")


def doc_files(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.derived(spark, sf, inputs.DOC_FILES, "documents")


def is_test_file() -> Column:
    return F.startswith(F.col("file_path"), F.lit("tests/"))


def listed(files: DataFrame) -> DataFrame:
    return files.select("repository_full_name", "file_path", "file_pos")


def contents(files: DataFrame) -> DataFrame:
    return files.select("repository_full_name", "file_path", "content")


def quarter_of_repos(files: DataFrame) -> DataFrame:
    """Ledger: the repositories whose number divides by four."""
    number = F.substring("repository_full_name", 6, 9).cast("int")
    return files.where(number % 4 == 0).select("repository_full_name").distinct()


def list_items(spark: SparkSession, sf: str) -> DataFrame:
    rows = inputs.derived(spark, sf, inputs.LIST_ITEMS, "orders")
    return rows.select("pos", F.parse_json("item_text").alias("item"))


def pair_items(spark: SparkSession, sf: str) -> DataFrame:
    rows = inputs.derived(spark, sf, inputs.PAIR_ITEMS, "documents", "labels")
    tail = F.substring(F.to_json(F.struct(F.col("text").alias("function_code"))), 2, 2**31 - 1)
    return rows.select("doc_id", F.parse_json(F.concat("head", tail)).alias("item"))


# --- shared SQL -----------------------------------------------------------

CF = inputs.CODE_FILES.format(part="part")
DOC_FN = inputs.DOC_FUNCTIONS.format(documents="documents")
ITEMS = inputs.LIST_ITEMS.format(orders="orders")

# Functions of CODE_FILES: every file that parses is one function.
FN = f"""
cf AS ({CF}),
fn AS (SELECT repository_full_name AS r, file_path AS p, file_pos, content AS c,
              regexp_extract(content, '^def ([a-z0-9_]+)\\(', 1) AS name
       FROM cf WHERE content <> 'def broken(:')"""

LAST = f"""{FN},
f AS (SELECT r, name, arg_max(c, file_pos) AS c, arg_max(p, file_pos) AS p
      FROM fn WHERE NOT starts_with(name, 'test_') GROUP BY ALL),
t AS (SELECT r, name, arg_max(c, file_pos) AS c, arg_max(p, file_pos) AS p
      FROM fn WHERE starts_with(name, 'test_') GROUP BY ALL)"""

PAIR_COLUMNS = """
SELECT f.name AS function_name, f.c AS function_code, f.p AS function_file, t.name AS test_function_name,
       t.c AS test_function_code, t.p AS test_function_file, f.r AS repository
FROM t JOIN f ON t.r = f.r AND t.name = 'test_' || f.name"""

PAIRS = f"WITH {LAST} {PAIR_COLUMNS}"

DOC_LAST = f"""
fn AS (SELECT repo AS r, path AS p, file_pos, fn_pos, name, code AS c FROM ({DOC_FN})),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r, name ORDER BY file_pos DESC, fn_pos DESC) AS k
      FROM fn WHERE NOT starts_with(name, 'test_')) WHERE k = 1),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r, name ORDER BY file_pos DESC, fn_pos DESC) AS k
      FROM fn WHERE starts_with(name, 'test_')) WHERE k = 1)"""

DOC_PAIRS = f"WITH {DOC_LAST} {PAIR_COLUMNS}"

FIRST = """
first AS (SELECT r, name, c, p FROM (
    SELECT *, row_number() OVER (PARTITION BY r, name
                                 ORDER BY len(string_split(p, '/')), string_split(p, '/'), fn_pos DESC) AS k
    FROM fn WHERE p LIKE '%.py' AND lower(p) NOT LIKE '%test%') WHERE k = 1)"""

BY_FILE = """
SELECT first.c AS input_code, t.c AS test_code, t.r AS repo_name, first.p AS code_file, t.p AS test_file
FROM t JOIN first ON t.r = first.r AND t.name = 'test_' || first.name"""

FILE_TESTS = "t AS (SELECT * FROM fn WHERE p LIKE 'tests/%' AND starts_with(name, 'test_'))"

BY_FILE_CTES = f"{FN.replace('file_pos, content', '0 AS fn_pos, file_pos, content')}, {FIRST}, {FILE_TESTS}"

DOC_BY_FILE_CTES = f"""
fn AS (SELECT repo AS r, path AS p, file_pos, fn_pos, name, code AS c FROM ({DOC_FN})), {FIRST}, {FILE_TESTS}"""


# --- sources --------------------------------------------------------------


@query(CF)
def code_files_scan(spark, sf):
    path = scratch_path(spark, "files")
    code_files(spark, sf).write.parquet(path)
    return file_sources.read_code_files(spark, path)


@query(
    f"""SELECT repository_full_name, file_path, content FROM ({CF})
WHERE file_path LIKE '%.py' AND lower(file_path) NOT LIKE '%test%'"""
)
def archive_scan(spark, sf):
    """Source files of landed archives; other members stay packed."""
    landed = stored(inputs.archives(code_files(spark, sf)), "archives")
    return archives.unpack(landed, is_source_file).drop("member_pos")


@query(PAIRS)
def mine_archives(spark, sf):
    """Pairs of listed files whose contents come from archives."""
    files = code_files(spark, sf)
    unpacked = archives.unpack(stored(inputs.archives(files), "archives")).drop("member_pos")
    return pairing.pair_listed(extract.extract_functions(joins.attach_content(listed(files), unpacked), last_only=True))


@query("SELECT doc_id, text AS content FROM documents")
def decode_base64(spark, sf):
    """Whole texts, with line breaks as a contents API sends them."""
    docs = spread(inputs.table(spark, sf, "documents"))
    lines = F.regexp_replace(F.base64(F.col("text").cast("binary")), "(.{60})", "$1\n")
    return file_sources.decode_files(docs.select("doc_id", lines.alias("content_b64")))


@query("SELECT doc_id, '�' || text || 'ok(' AS content FROM documents")
def decode_invalid_bytes(spark, sf):
    """Bad bytes before and after each text vanish; a U+FFFD of the text stays."""
    docs = spread(inputs.table(spark, sf, "documents"))
    raw = F.concat(
        F.unhex(F.lit("FFEFBFBDE4B8")), F.col("text").cast("binary"), F.unhex(F.lit("FF6F6BEDA080C328F09F98"))
    )
    return file_sources.decode_files(docs.select("doc_id", F.base64(raw).alias("content_b64")))


@query(
    f"""
SELECT pos // 1000 AS list_id, CAST(pos % 1000 AS INTEGER) AS pos,
       'org/r' || CAST(o_custkey % 40 AS VARCHAR) AS repository_full_name,
       'tests/test_' || CAST(pos AS VARCHAR) || '.py' AS file_path, CAST(NULL AS VARCHAR) AS download_url
FROM ({ITEMS}) JOIN orders ON o_orderkey = pos WHERE item_text LIKE '%org/r%'"""
)
def file_list_arrays(spark, sf):
    """JSON arrays of at most 1,000 items to valid rows with their place in the array."""
    rows = inputs.derived(spark, sf, inputs.LIST_ITEMS, "orders")
    chunk = F.floor(F.col("pos") / 1000).alias("list_id")
    members = F.sort_array(F.collect_list(F.struct("pos", "item_text")))["item_text"]
    arrays = rows.groupBy(chunk).agg(F.concat(F.lit("["), F.array_join(members, ","), F.lit("]")).alias("value"))
    return validate.split_valid_items(item_sources.array_items(arrays))[0]


@query(
    f"""SELECT pos, '{{"file_path":"tests/test_' || CAST(pos AS VARCHAR) || '.py","repository_full_name":"org/r'
       || CAST(o_custkey % 40 AS VARCHAR) || '"}}' AS item_json
FROM ({ITEMS}) JOIN orders ON o_orderkey = pos WHERE item_text LIKE '%org/r%'"""
)
def file_list_jsonl(spark, sf):
    """Through a JSON Lines file and back, in line order."""
    path = scratch_path(spark, "list")
    rows = inputs.derived(spark, sf, inputs.LIST_ITEMS, "orders").where("item_text like '%org/r%'")
    rows.orderBy("pos").select("item_text").write.text(path)
    items = item_sources.read_items(spark, path, "jsonl")
    ranked = split.with_position(items.select("ord", F.to_json("item").alias("item_json")), ["ord"], "line")
    # Line i of the file is the i-th usable order.
    usable = split.with_position(rows.select("pos"), ["pos"], "line")
    return ranked.join(usable, "line").select("pos", "item_json")


@query("SELECT doc_id, text, lang FROM documents")
def array_files_scan(spark, sf):
    """Whole documents in files that are one JSON array each, read in byte ranges."""
    path = scratch_path(spark, "arrays")
    docs = spread(inputs.table(spark, sf, "documents")).select("doc_id", "text", "lang")
    inputs.json_files(docs.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("item"))).write.text(path)
    elements = json_arrays.array_elements(spark, path)
    return elements.select(F.from_json("text", docs.schema).alias("d")).select("d.*")


# --- validation -----------------------------------------------------------


@query(
    f"""
SELECT pos, 'org/r' || CAST(o_custkey % 40 AS VARCHAR) AS repository_full_name,
       'tests/test_' || CAST(pos AS VARCHAR) || '.py' AS file_path, CAST(NULL AS VARCHAR) AS download_url
FROM ({ITEMS}) JOIN orders ON o_orderkey = pos WHERE item_text LIKE '%org/r%'"""
)
def file_list_valid(spark, sf):
    return validate.split_valid_items(list_items(spark, sf))[0]


@query(
    f"""
SELECT pos, replace(item_text, ', ', ',') AS item_json,
       CASE WHEN item_text LIKE '{{%' THEN 'no repository' ELSE 'not an object' END AS reason
FROM ({ITEMS}) WHERE item_text NOT LIKE '%org/r%'"""
)
def file_list_rejected(spark, sf):
    """JSON members of a variant are sorted by name when written back."""
    bad = validate.split_valid_items(list_items(spark, sf))[1]
    swapped = F.regexp_replace("item_json", r'^\{("file_path":"[^"]*"),("repository_full_name":.*)\}$', "{$2,$1}")
    return bad.withColumn("item_json", swapped)


@query(f"SELECT repository_full_name, file_path FROM ({CF}) WHERE file_path LIKE '%.py' AND lower(file_path) NOT LIKE '%test%'")
def source_file_selection(spark, sf):
    return validate.source_files(code_files(spark, sf)).select("repository_full_name", "file_path")


@query(
    f"""
SELECT repository_full_name, file_path, CAST(row_number() OVER (PARTITION BY repository_full_name
       ORDER BY len(string_split(file_path, '/')), string_split(file_path, '/')) - 1 AS BIGINT) AS place
FROM ({CF})"""
)
def file_tree_order(spark, sf):
    """Place of every file in the breadth-first listing of its repository."""
    listing = code_files(spark, sf).select("repository_full_name", "file_path", tree_order("file_path").alias("tree"))
    ranked = split.with_position(listing, ["repository_full_name", "tree"])
    start = ranked.groupBy("repository_full_name").agg(F.min("position").alias("start"))
    return ranked.join(start, "repository_full_name").select(
        "repository_full_name", "file_path", (F.col("position") - F.col("start")).alias("place")
    )


# --- extraction -----------------------------------------------------------


@query(
    f"""WITH {FN}
SELECT r AS repository_full_name, p AS file_path, file_pos, CAST(0 AS INTEGER) AS fn_pos, name, c AS code,
       starts_with(name, 'test_') AS is_test, regexp_replace(name, '^test_', '') AS base_name FROM fn"""
)
def functions_extracted(spark, sf):
    return extract.extract_functions(code_files(spark, sf))


@query(
    f"""
SELECT repo AS repository_full_name, path AS file_path, file_pos, CAST(fn_pos AS INTEGER) AS fn_pos, name, code,
       starts_with(name, 'test_') AS is_test, regexp_replace(name, '^test_', '') AS base_name FROM ({DOC_FN})"""
)
def functions_of_documents(spark, sf):
    return extract.extract_functions(doc_files(spark, sf))


@query(
    f"""
SELECT CASE WHEN content = 'def broken(:' THEN 'syntax_error' ELSE 'ok' END AS parse_status,
       count(*) AS num_files, count(*) FILTER (WHERE content <> 'def broken(:') AS num_functions
FROM ({CF}) GROUP BY 1"""
)
def parse_report(spark, sf):
    return extract.parse_report(extract.parse_files(code_files(spark, sf)))


@query(
    f"""SELECT repo AS repository_full_name, path AS file_path, name, CAST(fn_pos AS INTEGER) AS fn_pos, code
FROM ({DOC_FN})"""
)
def in_file_collapse(spark, sf):
    """Each file twice over: a repeated file must not add names."""
    functions = extract.extract_functions(doc_files(spark, sf))
    return extract.collapse_in_file(functions.unionByName(functions))


@query(
    f"""WITH fn AS ({DOC_FN})
SELECT repo AS repository_full_name, name, path AS file_path, file_pos, CAST(fn_pos AS INTEGER) AS fn_pos, code FROM (
    SELECT *, row_number() OVER (PARTITION BY repo, name ORDER BY file_pos DESC, fn_pos DESC) AS k FROM fn) WHERE k = 1"""
)
def cross_file_collapse(spark, sf):
    return extract.collapse_across_files(extract.extract_functions(doc_files(spark, sf)))


@query(f"WITH {FN} SELECT DISTINCT r AS repository_full_name, p AS file_path FROM fn WHERE starts_with(name, 'test_')")
def files_with_tests(spark, sf):
    return extract.files_with_tests(extract.extract_tests(code_files(spark, sf)))


@query(f"WITH {FN} SELECT r AS repository_full_name, p AS file_path, CAST(0 AS INTEGER) AS fn_pos, name, c AS code FROM fn")
def extract_udtf(spark, sf):
    register(spark)
    code_files(spark, sf).createOrReplaceTempView("pairloom_files")
    return spark.sql(
        "SELECT repository_full_name, file_path, f.* FROM pairloom_files, LATERAL extract_functions(content) f"
    )


@query(ORACLES["functions_extracted"])
def functions_by_content(spark, sf):
    """Two runs over overlapping tables with a cache: each distinct content is parsed once, every file has its functions."""
    files, cache = code_files(spark, sf), ParseCache(spark, scratch_path(spark, "parse-cache"))
    cache.add(files.where("file_pos % 3 <> 0"))
    cache.add(files)
    return cache.functions(files)


@query(
    f"""WITH cf AS ({CF}), old AS (SELECT DISTINCT content FROM cf WHERE file_pos % 3 <> 0)
SELECT CAST(0 AS BIGINT) AS batch_id, count(*) AS num_contents FROM old
UNION ALL SELECT 1, count(*) FROM (SELECT content FROM cf EXCEPT SELECT content FROM old)"""
)
def contents_parsed(spark, sf):
    """New contents of each of two runs; a third one over the same files has none and adds no batch."""
    files, cache = code_files(spark, sf), ParseCache(spark, scratch_path(spark, "parse-cache"))
    for some in (files.where("file_pos % 3 <> 0"), files, files):
        cache.add(some)
    return cache.index().groupBy("batch_id").agg(F.count("*").alias("num_contents"))


def _sparse_files(spark: SparkSession, sf: str) -> DataFrame:
    """Some contents empty or null, some with a byte that is not UTF-8, some test files without a test."""
    files = code_files(spark, sf)
    bad = F.concat(F.encode(F.lit("# "), "UTF-8"), F.unhex(F.lit("FF")), F.encode(F.concat(F.lit("\n"), "content"), "UTF-8"))
    content = (
        F.when(F.col("file_pos") % 7 == 0, "")
        .when(F.col("file_pos") % 11 == 0, None)
        .when(F.col("file_pos") % 5 == 0, F.replace("content", F.lit("def test_"), F.lit("def check_")))
        .when(F.col("file_pos") % 3 == 0, bad.cast("string"))
        .otherwise(F.col("content"))
    )
    return files.withColumn("content", content)


@query(
    f"""WITH {FN} SELECT DISTINCT r AS repository_full_name, p AS file_path FROM fn
WHERE starts_with(name, 'test_') AND file_pos % 7 <> 0 AND file_pos % 11 <> 0 AND file_pos % 5 <> 0"""
)
def files_with_tests_sparse(spark, sf):
    return extract.files_with_tests(extract.extract_tests(_sparse_files(spark, sf)))


@query(
    f"""WITH {FN} SELECT r AS repository_full_name, p AS file_path, CASE WHEN file_pos % 5 = 0 THEN regexp_replace(name, '^test_', 'check_')
ELSE name END AS name FROM fn WHERE file_pos % 7 <> 0 AND file_pos % 11 <> 0"""
)
def functions_of_sparse_files(spark, sf):
    """Empty files drop out, a bad byte in a file does not end the job."""
    return extract.extract_functions(_sparse_files(spark, sf)).select("repository_full_name", "file_path", "name")


# --- pairing --------------------------------------------------------------


@query(PAIRS)
def pairs_mode_b(spark, sf):
    return pairing.pair_listed(extract.extract_functions(code_files(spark, sf)))


@query(DOC_PAIRS)
def pairs_mode_b_documents(spark, sf):
    """A third of all rows in one repository, whole texts as payload."""
    return pairing.pair_listed(extract.extract_functions(doc_files(spark, sf)))


@query(
    f"""WITH {LAST}
SELECT t.r AS repository, t.name AS test_function_name, t.p AS test_function_file
FROM t LEFT JOIN f ON t.r = f.r AND t.name = 'test_' || f.name WHERE f.name IS NULL"""
)
def unmatched_tests(spark, sf):
    return pairing.unmatched_listed(extract.extract_functions(code_files(spark, sf)))


def _by_test_file(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    tests = extract.extract_tests(files.where(is_test_file()))
    return tests, extract.extract_functions(validate.source_files(files), last_only=True)


@query(f"WITH {BY_FILE_CTES} {BY_FILE}")
def pairs_mode_a(spark, sf):
    return pairing.pair_by_test_file(*_by_test_file(code_files(spark, sf)))


@query(f"WITH {DOC_BY_FILE_CTES} {BY_FILE}")
def pairs_mode_a_salted(spark, sf):
    """Heavy keys found and salted; the rows must not change."""
    tests, candidates = _by_test_file(doc_files(spark, sf))
    tests = stored(tests, "tests")
    return pairing.pair_by_test_file(tests, candidates, joins.heavy_keys(tests, pairing.KEYS, 20))


@query(
    f"""WITH {BY_FILE_CTES}
SELECT t.r AS repo_name, t.p AS test_file, t.name AS test_function_name
FROM t LEFT JOIN first ON t.r = first.r AND t.name = 'test_' || first.name WHERE first.name IS NULL"""
)
def unmatched_tests_mode_a(spark, sf):
    return pairing.unmatched_by_test_file(*_by_test_file(code_files(spark, sf)))


# --- ledgers, statistics, whole jobs --------------------------------------


@query(f"SELECT repository_full_name, file_path FROM ({CF}) WHERE CAST(substr(repository_full_name, 6) AS INTEGER) % 4 <> 0")
def skip_repos(spark, sf):
    files = listed(code_files(spark, sf))
    return joins.skip_known(files, quarter_of_repos(files), ["repository_full_name"]).drop("file_pos")


@query(f"SELECT repository_full_name, file_path FROM ({CF}) WHERE CAST(substr(repository_full_name, 6) AS INTEGER) % 4 <> 0")
def skip_repos_large_ledger(spark, sf):
    """The path for a ledger beyond the broadcast bound."""
    files = listed(code_files(spark, sf))
    return joins.skip_known(files, quarter_of_repos(files), ["repository_full_name"], rows=0).drop("file_pos")


@query(f"SELECT repository_full_name, file_path FROM ({CF}) WHERE file_path LIKE 'tests/%' AND file_pos % 5 <> 0")
def skip_files(spark, sf):
    """The ledger is a log of `repo:path` lines, written and read back."""
    tests = listed(code_files(spark, sf)).where(is_test_file())
    path = scratch_path(spark, "log")
    tests.where("file_pos % 5 = 0").select(file_key("repository_full_name", "file_path")).write.text(path)
    ledger = state.read_log_ledger(spark, path)
    return joins.skip_known(tests, ledger, FILE_LEDGER.fieldNames()).drop("file_pos")


@query(
    f"""SELECT repository_full_name, count(*) AS num_files, min(file_pos) AS first_pos, max(file_pos) AS last_pos
FROM ({CF}) GROUP BY 1"""
)
def files_by_repo(spark, sf):
    return stats.files_by_repo(code_files(spark, sf))


@query(f"SELECT * FROM ({PAIRS})")
def pairs_appended(spark, sf):
    """Pairs added to a table in two writes; before the first it reads as empty."""
    path = scratch_path(spark, "pairs")
    pairs = state.read_pairs_or_empty(spark, path)
    mined = stored(pairs_mode_b(spark, sf), "mined")
    hot = F.substring("repository", 6, 9).cast("int") < 12
    for part in (mined.where(hot), mined.where(~hot)):
        tables.append_pairs(part, path)
    return pairs.unionByName(state.read_pairs_or_empty(spark, path))


@query(f"SELECT * FROM ({PAIRS})")
def pairs_committed(spark, sf):
    """Pairs in five appends, each made twice under its key; folders are put together on the way."""
    table = CommittedTable(spark, scratch_path(spark, "committed"), FUNCTION_PAIRS, fan=2)
    mined = stored(pairs_mode_b(spark, sf), "mined")
    number = F.substring("repository", 6, 9).cast("int")
    for i in range(5):
        part = mined.where(number % 5 == i)
        table.append(part, f"run {i}")
        table.append(part, f"run {i}")
    return table.rows()


@query(f"SELECT DISTINCT repository_full_name FROM ({CF})")
def ledger_appended(spark, sf):
    path = scratch_path(spark, "ledger")
    files = code_files(spark, sf)
    done = quarter_of_repos(files)
    tables.append_ledger(done, path)
    rest = joins.skip_known(files, state.read_ledger(spark, path), ["repository_full_name"])
    tables.append_ledger(rest.select("repository_full_name").distinct(), path)
    return state.read_ledger(spark, path)


@query(f"SELECT repository, count(*) AS num_pairs FROM ({PAIRS}) GROUP BY 1")
def pairs_per_repo(spark, sf):
    return stats.pairs_per_repo(pairs_mode_b(spark, sf))


STATS = f"""
SELECT r.repository_full_name AS repository, count(p.repository) AS num_pairs
FROM (SELECT DISTINCT repository_full_name FROM ({CF})) r LEFT JOIN ({PAIRS}) p ON p.repository = r.repository_full_name
GROUP BY 1"""


@query(STATS)
def repo_stats(spark, sf):
    return stats.repo_stats(code_files(spark, sf), pairs_mode_b(spark, sf))


@query(STATS)
def stats_scan(spark, sf):
    """Statistics written as one JSON object for each task, and read back."""
    path = scratch_path(spark, "stats")
    member = F.substring(F.to_json(F.create_map("repository", "num_pairs")), 2, 2**31 - 1)
    inputs.json_files(repo_stats(spark, sf).select(F.regexp_replace(member, r"\}$", "")), "{", "}").write.text(path)
    return state.read_stats(spark, path)


@query(
    f"""SELECT count(*) AS repos_done, count(*) FILTER (WHERE num_pairs > 0) AS repos_with_pairs,
       CAST(sum(num_pairs) AS BIGINT) AS total_pairs, max(num_pairs) AS most_pairs FROM ({STATS})"""
)
def run_totals(spark, sf):
    return stats.run_totals(repo_stats(spark, sf))


@query(f"SELECT * FROM ({PAIRS}) WHERE CAST(substr(repository, 6) AS INTEGER) % 4 <> 0")
def mine_listed_files(spark, sf):
    """The whole mode B job with a ledger."""
    files = code_files(spark, sf)
    return mine_listed(listed(files), contents(files), quarter_of_repos(files)).pairs


@query(f"SELECT repository_full_name, file_path, file_pos, content FROM ({CF}) WHERE file_pos % 3 <> 0")
def listed_contents_sieved(spark, sf):
    """The path for a list beyond the broadcast bound: a Bloom filter keeps other contents from the shuffle."""
    files = code_files(spark, sf)
    wanted = stored(listed(files).where("file_pos % 3 <> 0"), "listed")
    return joins.attach_content(wanted, contents(files), rows=0)


@query(PAIRS)
def mine_bucketed_files(spark, sf):
    """List and contents in the same buckets, joined where they lie, then paired."""
    files, names = code_files(spark, sf), []
    for label, rows in (("listed", listed(files)), ("contents", contents(files))):
        path = scratch_path(spark, label)
        names.append(f"pairloom_{path.rsplit('-', 1)[-1]}_{label}")
        bucketed.write_bucketed(rows, names[-1], path, buckets=8)
    return pairing.pair_listed(extract.extract_functions(bucketed.attach_bucketed_content(spark, *names), last_only=True))


@query(f"WITH {BY_FILE_CTES} {BY_FILE} WHERE t.file_pos % 5 <> 0")
def mine_test_files(spark, sf):
    """The whole mode A job with a ledger; every list entry is given twice."""
    files = code_files(spark, sf)
    tests = listed(files).where(is_test_file())
    ledger = tests.where("file_pos % 5 = 0").select(*FILE_LEDGER.fieldNames())
    return mine_by_test_file(tests.unionByName(tests), contents(files), ledger).pairs


@query(f"WITH {BY_FILE_CTES} SELECT DISTINCT r AS repository_full_name, p AS file_path FROM t WHERE file_pos % 5 <> 0")
def mine_test_files_done(spark, sf):
    files = code_files(spark, sf)
    tests = listed(files).where(is_test_file())
    ledger = tests.where("file_pos % 5 = 0").select(*FILE_LEDGER.fieldNames())
    return mine_by_test_file(tests, contents(files), ledger).done


@query(
    f"""WITH {BY_FILE_CTES}
SELECT t.r AS repo_name, t.p AS test_file, t.name AS test_function_name
FROM t LEFT JOIN first ON t.r = first.r AND t.name = 'test_' || first.name WHERE first.name IS NULL AND t.file_pos % 5 <> 0"""
)
def mine_test_files_unmatched(spark, sf):
    """Tests without a function, from the same parse as the pairs."""
    files = code_files(spark, sf)
    tests = listed(files).where(is_test_file())
    ledger = tests.where("file_pos % 5 = 0").select(*FILE_LEDGER.fieldNames())
    return mine_by_test_file(tests, contents(files), ledger).unmatched


@query(PAIRS)
def mine_base64_files(spark, sf):
    """Contents as a contents API delivers them, decoded and mined in one job."""
    files = code_files(spark, sf)
    encoded = contents(files).withColumn("content_b64", F.base64(F.col("content").cast("binary"))).drop("content")
    ledger = spark.createDataFrame([], "repository_full_name string")
    return mine_listed(listed(files), file_sources.decode_files(encoded), ledger).pairs


# --- curation -------------------------------------------------------------


def _ranked_functions(spark: SparkSession, sf: str) -> DataFrame:
    functions = extract.extract_functions(code_files(spark, sf))
    return functions.select(
        (F.floor(F.col("file_pos") / 2) % 3).alias("file_ord"),
        F.col("file_pos").alias("pos"),
        F.col("name").alias("function_name"),
        F.col("code").alias("function_code"),
        F.col("repository_full_name").alias("repository"),
    )


def _first(key: str) -> str:
    return f"""WITH {FN}
SELECT file_ord, pos, function_name, function_code, repository FROM (
    SELECT CAST(floor(file_pos / 2) AS BIGINT) % 3 AS file_ord, file_pos AS pos, name AS function_name,
           c AS function_code, r AS repository, row_number() OVER (
               PARTITION BY {key} ORDER BY CAST(floor(file_pos / 2) AS BIGINT) % 3, file_pos) AS k
    FROM fn) WHERE k = 1"""


@query(_first("name"))
def merge_dedup_first(spark, sf):
    return curate.keep_first(_ranked_functions(spark, sf), order=["file_ord", "pos"])


@query(_first("name, r"))
def merge_dedup_first_by_repo(spark, sf):
    return curate.keep_first(_ranked_functions(spark, sf), ["function_name", "repository"], ["file_ord", "pos"])


@query(_first("name"))
def merged_in_any_order(spark, sf):
    """Inputs that arrive last to first, one of them twice: the order of the records decides, not that of the merges."""
    rows = stored(_ranked_functions(spark, sf), "ranked")
    merged = MergedSet(spark, scratch_path(spark, "merged"), rows.schema, order=["file_ord", "pos"], buckets=8)
    for file_ord in (2, 0, 1, 2):
        merged.merge(rows.where(F.col("file_ord") == file_ord))
    return merged.rows()


@query(
    f"""
SELECT function_name, function_code, function_file, test_function_name, test_function_code, test_function_file, repository
FROM (SELECT *, row_number() OVER (PARTITION BY function_name
                                   ORDER BY repository <> 'docs/hot', repository, function_file) AS k
      FROM ({DOC_PAIRS}))
WHERE k = 1"""
)
def merge_pair_files_first(spark, sf):
    """Two JSON Lines pair files, merged in the order given: the hot repository first."""
    pairs = stored(pairs_mode_b_documents(spark, sf), "pairs")
    hot = F.col("repository") == "docs/hot"
    paths = []
    for rows in (pairs.where(hot), pairs.where(~hot)):
        paths.append(scratch_path(spark, "pairs"))
        tables.write_jsonl(rows, paths[-1], order=["repository", "function_file"])
    return merge_pair_files(spark, paths).select(*FUNCTION_PAIRS.fieldNames())


SFT = f"SELECT function_code AS input, test_function_code AS output FROM ({PAIRS})"


@query(SFT)
def sft_two_field(spark, sf):
    return curate.input_output(pairs_mode_b(spark, sf))


@query(SFT)
def sft_two_field_items(spark, sf):
    """From raw items, where a missing key would fail the job."""
    pairs = pairs_mode_b(spark, sf)
    return curate.input_output_items(pairs.select(F.parse_json(F.to_json(F.struct("*"))).alias("item")))


LABELLED = "documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
LABEL_TEST = "CASE WHEN l.quality = 1 THEN 'def test_f():' || chr(10) || '    assert \"é\"' END"


@query(f"SELECT d.doc_id, '为以下 Python 函数编写对应的单元测试代码。' AS instruction, d.text AS input, {LABEL_TEST} AS output FROM {LABELLED} WHERE l.quality IS NOT NULL")
def sft_instruction(spark, sf):
    return curate.instruction_records(pair_items(spark, sf), keep=["doc_id"])


@query(
    f"""SELECT d.doc_id, CASE WHEN d.doc_id % 7 = 0 THEN '未知函数' ELSE 'f_' || CAST(d.doc_id AS VARCHAR) END AS function_name
FROM {LABELLED} WHERE l.quality IS NULL"""
)
def sft_skipped(spark, sf):
    return curate.skipped_items(pair_items(spark, sf), keep=["doc_id"])


@query(f"SELECT count(l.quality) AS converted, count(*) - count(l.quality) AS skipped FROM {LABELLED}")
def sft_counts(spark, sf):
    return pair_items(spark, sf).agg(*curate.instruction_counts())


@query(f"SELECT '为以下 Python 函数编写对应的单元测试代码。' AS instruction, d.text AS input, {LABEL_TEST} AS output FROM {LABELLED} WHERE l.quality IS NOT NULL")
def sft_jsonl_roundtrip(spark, sf):
    """Written as JSON Lines and read back; nulls and non-ASCII text survive."""
    path = scratch_path(spark, "records")
    records = curate.instruction_records(pair_items(spark, sf))
    tables.write_jsonl(records, path)
    return spark.read.schema(records.schema).json(path)


NAMED_ITEMS = "documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def _named_items(spark: SparkSession, sf: str) -> list[str]:
    """Two JSON Lines files of raw items, the second with names of the first and with names that are null."""
    rows = inputs.derived(spark, sf, inputs.PAIR_ITEMS, "documents", "labels")
    name = F.when(F.col("doc_id") % 11 == 0, "null").otherwise(
        F.concat(F.lit('"f_'), (F.col("doc_id") % 400).cast("string"), F.lit('"'))
    )
    test = F.regexp_replace("head", r'^\{("function_name":"[^"]*",)?', "")
    code = F.substring(F.to_json(F.struct(F.col("text").alias("function_code"))), 2, 2**31 - 1)
    item = F.concat(F.lit('{"function_name":'), name, F.lit(","), test, code)
    paths = []
    for file_ord in (0, 1):
        paths.append(scratch_path(spark, "items"))
        rows.where(F.col("doc_id") % 2 == file_ord).orderBy("doc_id").select(item).write.text(paths[-1])
    return paths


FIRST_NAMED = f"""SELECT * FROM (SELECT d.doc_id, d.text, l.quality, row_number() OVER (
    PARTITION BY CASE WHEN d.doc_id % 11 = 0 THEN 'null' ELSE CAST(d.doc_id % 400 AS VARCHAR) END
    ORDER BY d.doc_id % 2, d.doc_id) AS k FROM {NAMED_ITEMS}) l WHERE k = 1"""


@query(
    f"""SELECT '为以下 Python 函数编写对应的单元测试代码。' AS instruction, l.text AS input, {LABEL_TEST} AS output
FROM ({FIRST_NAMED}) l WHERE l.quality IS NOT NULL"""
)
def curate_instructions(spark, sf):
    """The whole job over two files: the first item of each name, a null name being one; read back."""
    out = scratch_path(spark, "records")
    write_instructions(spark, _named_items(spark, sf), out)
    return spark.read.schema("instruction string, input string, output string").json(out)


@query(
    f"""SELECT count(*) FILTER (WHERE quality IS NOT NULL) AS converted, count(*) FILTER (WHERE quality IS NULL) AS skipped
FROM {NAMED_ITEMS}"""
)
def curate_instructions_unmerged(spark, sf):
    """Every item, the nameless ones too: counts of the job that writes."""
    path, out = scratch_path(spark, "items"), scratch_path(spark, "records")
    pair_items(spark, sf).select(F.to_json("item")).write.text(path)
    counts = write_instructions(spark, [path], out, merge=False)
    return spark.createDataFrame([(counts["converted"], counts["skipped"])], "converted long, skipped long")


@query(
    f"""SELECT text AS input, 'def test_f(): pass' AS output FROM (SELECT text, row_number() OVER (
    PARTITION BY doc_id % 400 ORDER BY doc_id) AS k FROM documents) WHERE k = 1"""
)
def curate_input_output(spark, sf):
    """The whole strict job, read back."""
    path, out = scratch_path(spark, "items"), scratch_path(spark, "records")
    docs = inputs.table(spark, sf, "documents").orderBy("doc_id")
    docs.select(
        F.concat(F.lit("f_"), (F.col("doc_id") % 400).cast("string")).alias("function_name"),
        F.col("text").alias("function_code"),
        F.lit("def test_f(): pass").alias("test_function_code"),
    ).write.json(path)
    write_input_output(spark, [path], out)
    return spark.read.schema("input string, output string").json(out)


# --- positions and shards -------------------------------------------------


@query(
    """SELECT o_orderkey, o_orderpriority,
       CAST(row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS BIGINT) AS position FROM orders"""
)
def row_positions(spark, sf):
    orders = inputs.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return split.with_position(orders, ["o_orderpriority", "o_orderkey"])


def _split_oracle(order: str, n: int) -> str:
    return f"""SELECT o_orderkey, o_orderpriority, CAST(floor(
    (row_number() OVER (ORDER BY {order}) - 1) / ceil((SELECT count(*) FROM orders) / {n}.0)) + 1 AS BIGINT) AS split
FROM orders"""


@query(_split_oracle("o_orderkey", 7))
def split_assignment(spark, sf):
    orders = inputs.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return split.assign_split(orders, ["o_orderkey"], 7)


@query(_split_oracle("o_orderpriority, o_orderkey", 11))
def split_assignment_two_keys(spark, sf):
    orders = inputs.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return split.assign_split(orders, ["o_orderpriority", "o_orderkey"], 11)


def _sizes_oracle(table: str, n: int) -> str:
    size = f"CAST(ceil((SELECT count(*) FROM {table}) / {n}.0) AS BIGINT)"
    total = f"(SELECT count(*) FROM {table})"
    return f"""SELECT CAST(i AS BIGINT) AS split, CAST(least(i * {size}, {total}) - least((i - 1) * {size}, {total}) AS BIGINT) AS num_rows
FROM range(1, {n + 1}) r(i)"""


@query(_sizes_oracle("orders", 7))
def split_sizes(spark, sf):
    return split.split_sizes(inputs.table(spark, sf, "orders"), 7)


@query(_sizes_oracle("supplier", 150))
def split_sizes_sparse(spark, sf):
    """More shards than rows at small scale: the last ones are empty."""
    return split.split_sizes(inputs.table(spark, sf, "supplier"), 150)


@query(_split_oracle("o_orderkey", 7))
def split_files_roundtrip(spark, sf):
    path = scratch_path(spark, "splits")
    orders = inputs.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    tables.write_splits(orders, path, ["o_orderkey"], 7)
    rows = spark.read.schema("o_orderkey long, o_orderpriority string, split long").json(path)
    return rows.select("o_orderkey", "o_orderpriority", "split")


@query(
    """SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS BIGINT) AS position FROM orders"""
)
def output_order(spark, sf):
    """Rows written in an order, and their places in the files read back."""
    path = scratch_path(spark, "ordered")
    orders = inputs.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    tables.write_jsonl(orders, path, order=["o_orderpriority", "o_orderkey"])
    items = item_sources.read_items(spark, path)
    keys = items.select("ord", F.try_variant_get("item", "$.o_orderkey", "long").alias("o_orderkey"))
    return split.with_position(keys, ["ord"]).select("o_orderkey", "position")


@query(
    """SELECT p_partkey, p_name, CAST(floor((row_number() OVER (ORDER BY p_partkey % 2, p_partkey) - 1)
    / ceil((SELECT count(*) FROM part) / 9.0)) + 1 AS BIGINT) AS split FROM part"""
)
def split_item_files(spark, sf):
    """Two JSON Lines files cut into nine shards in file order."""
    parts, out, paths = inputs.table(spark, sf, "part").select("p_partkey", "p_name"), scratch_path(spark, "shards"), []
    for i in (0, 1):
        paths.append(scratch_path(spark, "items"))
        tables.write_jsonl(parts.where(F.col("p_partkey") % 2 == i), paths[-1], order=["p_partkey"])
    write_item_splits(spark, paths, out, 9)
    return spark.read.schema("p_partkey long, p_name string, split long").json(out)


# --- mutants --------------------------------------------------------------


def _mutants_sql() -> str:
    """Every mutant of the two function shapes in CODE_FILES.

    In a text `?` is the name, `$` the name under test, `#` the number in the
    condition, `@` the number that replaces it, `~` a line break.
    """
    shapes = []

    def add(where, operator, node_type, node_pos, text, number="NULL"):
        shapes.append((where, len(shapes), operator, node_type, node_pos, text, number))

    def source(cond="a > #", then="return a + b", last="return b"):
        return f"def ?(a, b):~    if {cond}:~        {then}~    {last}"

    add("f", "COI", "If", 2, source(cond="a > # and True"))
    add("f", "COI", "If", 2, source(cond="a > # or False"))
    add("f", "COD_IF", "If", 2, "def ?(a, b):~    pass~    return b")
    add("f", "COD_RET", "Return", 3, source(last="pass"))
    for op in ("==", "!=", "<", "<=", ">="):
        add("f", "ROR", "Compare", 6, source(cond=f"a {op} #"))
    add("f", "COD_RET", "Return", 7, source(then="pass"))
    for number in ("0", "1", "-1", "size + 1", "size - 1"):
        add("f", "CRP_NUM", "Constant", 11, source(cond="a > @"), number)
    for op in ("-", "*", "/", "%", "**", "//"):
        add("f", "AOR", "BinOp", 12, source(then=f"return a {op} b"))
    for name in ("a", "b"):
        add("f", "AOD", "BinOp", 12, source(then=f"return {name}"))
    for number in (0, -1, 2, 0):
        add("t", "CRP_NUM", "Constant", 5, f"def ?():~    assert $({number}, 2)")
    for number in (0, 1, -1, 3, 1):
        add("t", "CRP_NUM", "Constant", 6, f"def ?():~    assert $(1, {number})")
    one = """SELECT r, p, name, size, {seq} AS seq, '{operator}' AS operator, '{node_type}' AS node_type, {node_pos} AS node_pos,
       replace(replace(replace(replace(replace('{text}', '~', chr(10)), '?', name), '$', substr(name, 6)),
               '#', size::VARCHAR), '@', coalesce(CAST({number} AS VARCHAR), '')) AS code, {number} AS number
FROM sized WHERE starts_with(name, 'test_') = {is_test}"""
    union = "\nUNION ALL ".join(
        one.format(
            seq=seq, operator=operator, node_type=node_type, node_pos=node_pos, text=text, number=number,
            is_test=str(where == "t").lower(),
        )
        for where, seq, operator, node_type, node_pos, text, number in shapes
    )
    return f"""WITH {FN},
sized AS (SELECT r, p, name, CAST(coalesce(nullif(regexp_extract(c, 'if a > ([0-9]+):', 1), ''), '0') AS INTEGER) AS size FROM fn),
every AS ({union})
SELECT r AS repository_full_name, p AS file_path, name,
       CAST(row_number() OVER (PARTITION BY r, p ORDER BY seq) - 1 AS INTEGER) AS mutant_idx,
       operator, node_type, CAST(node_pos AS INTEGER) AS node_pos, code, false AS is_noop, true AS is_valid
FROM every WHERE number IS NULL OR number <> size"""


MUTANTS = _mutants_sql()


def _plain_functions(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extract_functions(code_files(spark, sf)).select(
        "repository_full_name", "file_path", "name", "code"
    )


@query(MUTANTS)
def mutants(spark, sf):
    """Rendered texts against closed-form templates."""
    return mutate.mutants(_plain_functions(spark, sf))


@query(f"SELECT operator, count(*) AS num_mutants FROM ({MUTANTS}) GROUP BY 1")
def mutant_counts(spark, sf):
    return mutate.mutant_counts(_plain_functions(spark, sf), [])


@query(f"SELECT repository_full_name, file_path, name, operator, count(*) AS num_mutants FROM ({MUTANTS}) GROUP BY ALL")
def mutants_per_function(spark, sf):
    return mutate.mutant_counts(_plain_functions(spark, sf), ["repository_full_name", "file_path", "name"])


@query(MUTANTS.replace("AS node_pos, code, false", "AS node_pos, code AS mutant, false"))
def mutate_udtf(spark, sf):
    register(spark)
    _plain_functions(spark, sf).createOrReplaceTempView("pairloom_code")
    return spark.sql(
        """SELECT repository_full_name, file_path, name, m.*
        FROM (SELECT *, mutation_edits(code) AS edits FROM pairloom_code) f, LATERAL mutate_function(f.code, f.edits) m"""
    )


@query(ORACLES["mutate_udtf"])
def mutate_chunks_udtf(spark, sf):
    """The same by chunks of edits: no row holds all mutants of a function."""
    register(spark)
    _plain_functions(spark, sf).createOrReplaceTempView("pairloom_code")
    return spark.sql(
        """SELECT repository_full_name, file_path, name, m.*
        FROM (SELECT *, mutation_edits(code) AS edits FROM pairloom_code) f,
             LATERAL mutation_chunks(f.code, f.edits) c, LATERAL mutate_chunk(f.code, c.start, c.part) m"""
    )


@query(
    f"""
SELECT repo AS repository_full_name, path AS file_path, CAST(fn_pos AS INTEGER) AS fn_pos,
       CAST(idx AS INTEGER) AS mutant_idx, operator, node_type, CAST(node_pos AS INTEGER) AS node_pos,
       'def ' || name || text AS code, idx = 0 AND operator = 'SCI' AS is_noop, true AS is_valid
FROM ({DOC_FN}) JOIN (VALUES
    ('g', 0, 'COD_RET', 'Return', 2, '(x):' || chr(10) || '    pass'),
    ('f', 0, 'SCI', 'FunctionDef', 0, '(self, x):' || chr(10) || '    return x'),
    ('f', 1, 'COD_RET', 'Return', 2, '(self, x):' || chr(10) || '    pass'),
    ('t', 0, 'CRP_NUM', 'Constant', 3, '():' || chr(10) || '    assert 0'),
    ('t', 1, 'CRP_NUM', 'Constant', 3, '():' || chr(10) || '    assert -1'),
    ('t', 2, 'CRP_NUM', 'Constant', 3, '():' || chr(10) || '    assert 2'),
    ('t', 3, 'CRP_NUM', 'Constant', 3, '():' || chr(10) || '    assert 0')
) m(kind, idx, operator, node_type, node_pos, text) ON left(name, 1) = kind"""
)
def mutants_of_documents(spark, sf):
    """Functions that carry whole texts; comments do not survive rendering."""
    functions = extract.extract_functions(doc_files(spark, sf))
    return mutate.mutants(functions.select("repository_full_name", "file_path", "fn_pos", "code"))


# Two shapes with the constructs the derived files lack; every mutant is written out.
LOOP_SHAPE = "def ?(xs, t):~    while xs:~        if t or xs:~            break~        t += xs[1:]~    return not t"
CALL_SHAPE = "@d~def ?(self):~    try:~        v = super().m('k')~    except E:~        raise"
SHAPES = f"""SELECT s_suppkey AS id, 'f_' || CAST(s_suppkey AS STRING) AS name,
       replace(replace(CASE WHEN s_suppkey % 2 = 0 THEN '{LOOP_SHAPE}'
                            ELSE '{CALL_SHAPE.replace("'", "''")}' END, '?', 'f_' || CAST(s_suppkey AS STRING)), '~', chr(10)) AS code
FROM {{supplier}}"""


def _shape_mutants_sql() -> str:
    loop = "def ?(xs, t):~    while xs:~        {test}~            {jump}~        {add}~    return {last}"
    call = "{dec}def ?(self):~    try:~        v = {value}{handler}"
    shapes = []

    def add(odd, operator, node_type, node_pos, text, is_noop=False, is_valid=True):
        at = sum(s[0] == odd for s in shapes)
        shapes.append((odd, at, operator, node_type, node_pos, text, is_noop, is_valid))

    def looped(operator, node_type, node_pos, test="if t or xs:", jump="break", add_="t += xs[1:]", last="not t"):
        add(0, operator, node_type, node_pos, loop.format(test=test, jump=jump, add=add_, last=last))

    add(0, "COD_RET", "Return", 3, "def ?(xs, t):~    while xs:~        if t or xs:~            break~        t += xs[1:]~    pass")
    looped("COI", "If", 7, test="if (t or xs) and True:")
    looped("COI", "If", 7, test="if (t or xs) or False:")
    add(0, "COD_IF", "If", 7, "def ?(xs, t):~    while xs:~        pass~        t += xs[1:]~    return not t")
    for op in ("-", "*", "/", "%", "**", "//"):
        looped("ASR_AUG", "AugAssign", 8, add_=f"t {op}= xs[1:]")
    looped("LOR", "UnaryOp", 9, last="t")
    looped("LCR", "BoolOp", 11, test="if t and xs:")
    looped("LOD", "BoolOp", 11, test="if t:")
    looped("LOD", "BoolOp", 11, test="if xs:")
    looped("BCR", "Break", 12, jump="continue")
    looped("SIR", "Subscript", 15, add_="t += xs[0]")
    for number in (0, -1, 2, 0):
        looped("CRP_NUM", "Constant", 29, add_=f"t += xs[{number}:]")

    def called(operator, node_type, node_pos, value="super().m('k')", handler="~    except E:~        raise", **flags):
        add(1, operator, node_type, node_pos, call.format(dec="@d~", value=value, handler=handler), **flags)

    called("DDL", "FunctionDef", 0, is_noop=True)
    called("SCI", "FunctionDef", 0, is_noop=True)
    called("EHD", "Try", 2, handler="", is_valid=False)
    called("ASR", "Assign", 5, value="None")
    called("EXS", "ExceptHandler", 6, handler="~    except E:", is_valid=False)
    for text in ("", "mutated", "k_mutated"):
        called("CRP_STR", "Constant", 14, value=f"super().m('{text}')")
    called("SCD", "Call", 16, value="None.m('k')")
    values = ",\n".join(
        f"({odd}, {at}, '{operator}', '{node_type}', {pos}, '{text.replace(chr(39), chr(39) * 2)}', {is_noop}, {is_valid})"
        for odd, at, operator, node_type, pos, text, is_noop, is_valid in shapes
    )
    return f"""SELECT s_suppkey AS id, CAST(place AS INTEGER) AS mutant_idx, operator, node_type, CAST(node_pos AS INTEGER) AS node_pos,
       replace(replace(text, '?', 'f_' || CAST(s_suppkey AS VARCHAR)), '~', chr(10)) AS code, is_noop, is_valid
FROM supplier JOIN (VALUES {values}) m(odd, place, operator, node_type, node_pos, text, is_noop, is_valid) ON s_suppkey % 2 = odd"""


SHAPE_MUTANTS = _shape_mutants_sql()


def _shapes(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.derived(spark, sf, SHAPES, "supplier").select("id", "code")


@query(SHAPE_MUTANTS)
def mutants_of_shapes(spark, sf):
    """Loops, jumps, boolean operators, slices, strings, handlers, decorators and super calls."""
    return mutate.mutants(_shapes(spark, sf))


@query(f"SELECT operator, count(*) AS num_mutants FROM ({SHAPE_MUTANTS}) GROUP BY 1")
def mutant_counts_of_shapes(spark, sf):
    return mutate.mutant_counts(_shapes(spark, sf), [])


# --- incremental and streaming --------------------------------------------


def _two_drops(spark: SparkSession, sf: str) -> str:
    """Mine after each of two drops; a third run finds nothing new. Returns the output folder.

    Every fifth repository has files in both drops. Some repositories have
    empty files only, and some files have no repository.
    """
    landing, out = scratch_path(spark, "landing"), scratch_path(spark, "mined")
    files = code_files(spark, sf)
    number = F.substring("repository_full_name", 6, 9).try_cast("int")
    empty = files.where("file_pos % 14 = 0").select(
        F.concat(F.lit("none/r"), (F.col("file_pos") % 5).cast("string")).alias("repository_full_name"),
        "file_path",
        "file_pos",
        F.when(F.col("file_pos") % 4 == 0, "").alias("content"),
    )
    homeless = files.withColumn("repository_full_name", F.when(F.col("file_pos") % 2 == 0, ""))
    every = stored(files.unionByName(empty).unionByName(homeless), "arriving")
    expected = every.groupBy("repository_full_name").agg(F.count_distinct("file_path").alias("num_files"))
    in_first = F.when(number % 5 == 0, F.col("file_pos") % 3 == 0).otherwise(number < 12)
    for is_first in (True, False):
        every.where(F.coalesce(in_first, F.lit(True)) == is_first).write.mode("append").parquet(landing)
        incremental.mine_available(spark, landing, out, expected)
    incremental.mine_available(spark, landing, out, expected)
    return out


@query(PAIRS)
def incremental_pairs(spark, sf):
    return incremental.committed_pairs(spark, _two_drops(spark, sf))


@query(
    f"""SELECT * FROM ({STATS})
UNION ALL SELECT DISTINCT 'none/r' || CAST(file_pos % 5 AS VARCHAR), CAST(0 AS BIGINT) FROM ({CF}) WHERE file_pos % 14 = 0"""
)
def incremental_stats(spark, sf):
    return incremental.committed_stats(spark, _two_drops(spark, sf))


def _committed_list(spark: SparkSession, sf: str) -> str:
    """The job over half of the repositories, over all, and over all again."""
    out = scratch_path(spark, "mined")
    files = code_files(spark, sf)
    half = listed(files).where(F.substring("repository_full_name", 6, 9).cast("int") < 12)
    for part in (half, listed(files), listed(files)):
        incremental.mine_file_list(spark, part, contents(files), out)
    return out


@query(PAIRS)
def mine_listed_committed(spark, sf):
    return incremental.committed_pairs(spark, _committed_list(spark, sf))


@query(STATS)
def mine_listed_committed_stats(spark, sf):
    return incremental.committed_stats(spark, _committed_list(spark, sf))


@query(f"WITH {BY_FILE_CTES} {BY_FILE}")
def incremental_test_files(spark, sf):
    """Mode A in three runs: a third of the test files, all of them, all of them again."""
    out = scratch_path(spark, "mined")
    files = code_files(spark, sf)
    tests = listed(files).where(is_test_file())
    for part in (tests.where("file_pos % 9 < 3"), tests, tests):
        incremental.mine_new_test_files(spark, part, contents(files), out)
    return incremental.committed_data_pairs(spark, out)


@query(f"WITH {FN} SELECT name AS function_name, count(DISTINCT name) AS num_rows FROM fn GROUP BY 1")
def streaming_dedup(spark, sf):
    """One row per name; which one depends on arrival, so only the names are compared."""
    landing, out = scratch_path(spark, "landing"), scratch_path(spark, "dedup")
    rows = _ranked_functions(spark, sf)
    rows.write.parquet(landing)
    dedup.start_dedup(spark, landing, rows.schema, out).awaitTermination()
    return spark.read.parquet(f"{out}/rows").groupBy("function_name").agg(F.count("*").alias("num_rows"))
