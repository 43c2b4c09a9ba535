"""URL filters: rules first, then naive Bayes over segmented names.

Host names and path parts are cut into words by a unigram Viterbi over word
counts of the page texts. A multinomial naive Bayes model over the host and
path words decides the urls that no rule fits. It learns from the urls that a
rule decides, with a few seed words as pseudo-counts.

The most frequent words and tokens are broadcast. Totals are those of all, and
words and tokens outside the broadcast head are joined to the names and urls
that hold them, so the head's size does not change a verdict. A word is what
the page texts have ``MIN_COUNT`` times.
"""

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.frames import most_frequent, small_or_dealt, tuned
from pairloom.session import stored

ALLOW, BLOCK = "allow", "block"
# Host and path prefix, verdict.
RULES = (
    ("org", "/", ALLOW),
    ("example.org", "/es/", BLOCK),
    ("example.org", "/en/1", BLOCK),
    ("com", "/fr/", ALLOW),
    ("com", "/de/", BLOCK),
)
# Words of unwanted hosts, each as so many block tokens.
SEEDS = ("spam", "farm", "cheap", "pills", "casino", "poker", "viagra", "loans", "porn", "xxx", "replica", "jackpot")
SEED_TOKENS = 50
MAX_WORDS, MAX_FEATURES = 30_000, 50_000
MIN_COUNT = 3
LONGEST = 20
FLUSH = 300_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = re.compile(r"[a-z]{2,20}")
_TAG = re.compile(r"<[^>]*>")
_PART = re.compile(r"[^\W\d_]+|\d+")


# --- url parts and rules ----------------------------------------------------


def with_parts(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """(page_id, host, path); both parts are empty for a null url or one without ``://``."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("_url"))
    rest = F.when(F.instr("_url", "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    rows = rows.withColumn("_rest", F.coalesce(rest, F.lit("")))
    rows = rows.withColumn("_host", F.regexp_extract("_rest", r"^[^/?#]*", 0))
    path = F.regexp_extract(F.expr("substring(_rest, length(_host) + 1)"), r"^[^?#]*", 0)
    return rows.select("page_id", F.translate("_host", _UPPER, _LOWER).alias("host"), path.alias("path"))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for name, prefix, said in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(prefix))
        rule = F.when(fits, name + prefix).otherwise(rule)
        verdict = F.when(fits, said).otherwise(verdict)
    return rule, verdict


# --- segmentation -----------------------------------------------------------


class Segmenter:
    """Unigram Viterbi: the split of a name with the most probable words."""

    def __init__(self, counts: dict[str, int], total: int | None = None) -> None:
        """``total`` is the count of all words, if ``counts`` has not all."""
        self.total = max(1, sum(counts.values()) if total is None else total)
        self.cost = {w: math.log(self.total / n) for w, n in counts.items()}
        self.split = lru_cache(100_000)(self._split)

    def __reduce__(self):
        return _segmenter, (self.cost, self.total)

    def _unknown(self, n: int) -> float:
        # Ten times less likely for every further letter.
        return math.log(self.total) + math.log(10) * n

    def split_with(self, name: str, counts: dict[str, int]) -> tuple[str, ...]:
        """The split with some more words."""
        return self._split(name, {w: math.log(self.total / n) for w, n in counts.items()})

    def _split(self, name: str, more: dict[str, float] | None = None) -> tuple[str, ...]:
        best = [(0.0, 0)]
        for end in range(1, len(name) + 1):
            options = []
            for begin in range(max(0, end - LONGEST), end):
                word = name[begin:end]
                cost = self.cost.get(word)
                if cost is None:
                    cost = (more or {}).get(word, self._unknown(end - begin))
                options.append((best[begin][0] + cost, begin))
            best.append(min(options))
        out, end = [], len(name)
        while end:
            begin = best[end][1]
            out.append(name[begin:end])
            end = begin
        return tuple(reversed(out))

    def tokens(self, host: str, path: str, splits=None) -> list[str]:
        """Host words, path words, and one token for any number; ``splits`` has the names split otherwise than by the head."""
        out, splits = [], dict(splits or ())
        for kind, text in (("h", host), ("p", path.lower())):
            for part in _PART.findall(text):
                out += [f"{kind}:#"] if part[0].isdigit() else [f"{kind}:{w}" for w in splits.get(part) or self.split(part)]
        return out


def _segmenter(cost: dict[str, float], total: int) -> Segmenter:
    out = Segmenter({})
    out.cost, out.total = cost, total
    return out


def _counter_rows(counts: Counter, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names)


def word_counts(pages: DataFrame, text_col: str = "html", keep: int = MAX_WORDS) -> tuple[Segmenter, DataFrame | None]:
    """A segmenter with the most frequent words of all page texts, at most ``keep``, and a table (word, n) of the rest, if any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(_WORD.findall(_TAG.sub(" ", text or "").lower()))
            if len(counts) > FLUSH:
                yield _counter_rows(counts, ["word", "n"])
                counts = Counter()
        yield _counter_rows(counts, ["word", "n"])

    rows = pages.select(F.col(text_col).cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = stored(rows.where(F.col("n") >= MIN_COUNT), "url-words")
    head = {r.word: r.n for r in most_frequent(rows, "n", keep).collect()}
    total, count = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    return Segmenter(head, total), _below(rows, head.values()) if count > len(head) else None


def _below(rows: DataFrame, counts) -> DataFrame:
    """The rows that ``most_frequent`` left out: it keeps all rows of a count, or none."""
    return rows.where(F.col("n") < min(counts)) if counts else rows


def _names(host: str, path: str) -> set[str]:
    return {p for text in (host, path.lower()) for p in _PART.findall(text) if not p[0].isdigit()}


def with_splits(parts: DataFrame, segmenter: Segmenter, rest: DataFrame | None) -> DataFrame:
    """``parts`` with a map of those names of a row that words outside the head split otherwise."""
    if rest is None:
        return parts.withColumn("splits", F.lit(None).cast("map<string, array<string>>"))
    shared = parts.sparkSession.sparkContext.broadcast(segmenter)

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r, n) for r, h, q in zip(*(c.to_pylist() for c in batch.columns)) for n in _names(h, q)]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int64()), pa.array([n for _, n in rows], pa.string())], ["_row", "name"])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, out = shared.value.cost, []
        rows = lambda: pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], ["name", "word"])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                parts_of = {name[i:j] for i in range(len(name)) for j in range(i + 2, min(len(name), i + LONGEST) + 1)}
                out += [(name, w) for w in parts_of if w not in known and _WORD.fullmatch(w)]
                if len(out) > FLUSH:
                    yield rows()
                    out = []
        yield rows()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name, words in zip(*(c.to_pylist() for c in batch.columns)):
                new = shared.value.split_with(name, {w["word"]: w["n"] for w in words})
                if new != shared.value.split(name):
                    found.append((name, new))
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in found], pa.string()), pa.array([list(x) for _, x in found], pa.list_(pa.string()))], ["name", "split"]
            )

    held = stored(parts.select("_row", "host", "path").mapInArrow(names, "_row long, name string"), "url-names")
    met = held.select("name").distinct().mapInArrow(candidates, "name string, word string").join(small_or_dealt(rest), "word")
    splits = met.groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("words")).select("name", "words")
    splits = stored(splits.mapInArrow(split, "name string, split array<string>"), "url-splits")
    of_row = held.join(small_or_dealt(splits), "name").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("name", "split"))).alias("splits"))
    return stored(parts.join(of_row, "_row", "left"), "url-split-parts")




# --- naive Bayes ------------------------------------------------------------


class Model:
    def __init__(self, segmenter: Segmenter, tokens: dict[str, tuple[int, int]], documents: tuple[int, int], totals: tuple[int, int, int]) -> None:
        """``tokens`` and ``documents`` count (allow, block); ``totals`` are allow, block and number of all tokens."""
        self.segmenter = segmenter
        self.allow, self.block = totals[0] + totals[2] + 1, totals[1] + totals[2] + 1
        self.odds = {t: math.log((b + 1) / self.block) - math.log((a + 1) / self.allow) for t, (a, b) in tokens.items()}
        self.prior = math.log((documents[1] + 1) / (documents[0] + 1))

    def evidence(self, host: str, path: str, splits=None) -> tuple[float, list[str]]:
        """Log odds of block by the tokens of the head, and the other tokens."""
        tokens = self.segmenter.tokens(host, path, splits)
        return self.prior + sum(self.odds.get(t, 0.0) for t in tokens), [t for t in tokens if t not in self.odds]


def fit(parts: DataFrame, segmenter: Segmenter, seeds=SEEDS, keep: int = MAX_FEATURES) -> tuple[Model, DataFrame | None]:
    """A model from rows (host, path, rule_verdict, splits) of all urls with a rule, and a table (token, odds) of tokens outside it, if any.

    The number of tokens kept bounds the model.
    """
    shared = parts.sparkSession.sparkContext.broadcast(segmenter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows() -> pa.RecordBatch:
            keys = list(counts)
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())],
                ["token", "verdict", "n"],
            )

        for batch in batches:
            for host, path, verdict, splits in zip(*(c.to_pylist() for c in batch.columns)):
                counts.update((t, verdict) for t in shared.value.tokens(host, path, splits))
                counts[("", verdict)] += 1  # documents
            if len(counts) > FLUSH:
                yield rows()
                counts = Counter()
        yield rows()

    decided = parts.where("rule_verdict IS NOT NULL").select("host", "path", "rule_verdict", "splits")
    count = lambda v: F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0))
    rows = decided.mapInArrow(run, "token string, verdict string, n long").groupBy("token").agg(count(ALLOW).alias("a"), count(BLOCK).alias("b"))
    rows = stored(rows.withColumn("n", F.col("a") + F.col("b")), "url-tokens")
    named = rows.where("token != ''")
    head = most_frequent(named, "n", keep).collect()
    tokens = {r.token: (r.a, r.b) for r in head}
    documents = next(((r.a, r.b) for r in rows.where("token = ''").collect()), (0, 0))
    zero = F.lit(0)
    allow, block, count = named.agg(F.coalesce(F.sum("a"), zero), F.coalesce(F.sum("b"), zero), F.count("*")).first()
    rest = _below(named, [r.n for r in head]) if count > len(head) else None
    names = [f"h:{word}" for word in seeds]
    if rest is not None:
        tokens.update({r.token: (r.a, r.b) for r in rest.where(F.col("token").isin(names)).collect()})
        rest = rest.where(~F.col("token").isin(names))
    count += len(set(names) - set(tokens))
    for name in names:
        a, b = tokens.get(name, (0, 0))
        tokens[name] = (a, b + SEED_TOKENS)
        block += SEED_TOKENS
    model = Model(segmenter, tokens, documents, (allow, block, count))
    if rest is not None:
        part = lambda n, total: F.log((F.col(n) + 1) / F.lit(float(total)))
        rest = rest.select("token", (part("b", model.block) - part("a", model.allow)).alias("odds"))
    return model, rest


def url_verdicts(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, seeds=SEEDS
) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_probability) of every page row.

    The verdict is the rule's, else block where the model finds that likelier.
    A null url, or one without ``://``, has an empty host and path, no rule and
    no words: it is allowed. A null id keeps its row.
    """
    spark = tuned(pages.sparkSession)
    parts = with_parts(pages, id_col, url_col)
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    row = F.monotonically_increasing_id().alias("_row")
    parts = stored(parts.select("*", rule.alias("rule"), said.alias("rule_verdict"), row), "url-parts")
    segmenter, words = word_counts(pages, html_col)
    parts = with_splits(parts, segmenter, words)
    model, tokens = fit(parts, segmenter, seeds)
    shared = spark.sparkContext.broadcast(model)
    joined = tokens is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, rest = [], []
            for h, q, splits in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("host", "path", "splits"))):
                odds, others = shared.value.evidence(h, q, splits) if h or q else (None, [])
                z.append(odds)
                rest.append(others if joined else [])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(z, pa.float64()), pa.array(rest, pa.list_(pa.string()))], [*batch.schema.names[:-1], "z", "rest"]
            )

    columns = ["page_id", "host", "path", "rule", "rule_verdict", "_row"]
    schema = "page_id long, host string, path string, rule string, rule_verdict string, _row long, z double, rest array<string>"
    scored = parts.select(*columns, "splits").mapInArrow(run, schema)
    if joined:
        scored = stored(scored, "url-scored")
        more = scored.select("_row", F.explode("rest").alias("token")).join(small_or_dealt(tokens), "token")
        more = more.groupBy("_row").agg(F.sum("odds").alias("_more"))
        scored = scored.join(more, "_row", "left").withColumn("z", F.col("z") + F.coalesce("_more", F.lit(0.0)))
    p = F.coalesce(1 / (1 + F.exp(-F.when(F.col("z") > 40, 40.0).when(F.col("z") < -40, -40.0).otherwise(F.col("z")))), F.lit(0.0))
    scored = scored.withColumn("block_probability", p)
    verdict = F.coalesce("rule_verdict", F.when(F.col("block_probability") > 0.5, BLOCK).otherwise(ALLOW))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_probability")
