"""Toxicity by a weighted lexicon.

Texts are folded first: homoglyphs, accents and digits that stand for letters
become the plain letter, everything else a blank. Lexicon stems match at the
start of a folded word with an Aho-Corasick automaton; a match inside an
exception phrase does not count. The summed weights, normalised by the length
of the text, are mapped to a probability.

Weights and mapping are learned from a bounded sample of labelled rows.
"""

from collections import Counter
from collections.abc import Iterator
import math
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.frames import id_and_text, mapped, tuned
from pairloom.session import stored

MAX_LABELLED = 15_000
STEM = range(4, 9)
MIN_SUPPORT, MIN_EVIDENCE, MAX_LEXICON = 6, 30.0, 2_000
# A stem counts for a document if this share of its words starts with it: one match in a long text says little.
MIN_SHARE = 0.004
THRESHOLD = 0.3
PRIOR_WORDS = 20

# Insults every lexicon starts with, and phrases in which their words are harmless.
SEED = ("idiot", "moron", "stupid", "loser", "trash", "scum", "worthless", "pathetic", "disgusting", "clown")
SEED_WEIGHT = 2.0
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown", "pond scum", "sore loser", "sympathetic", "apathetic")
# Digits and signs that stand for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("аеорсухівнкмтѕјԁһαεορτυνικ", "aeopcyxibhkmtsjdhaeoptuvik"))


class _Fold(dict):
    """A translation table that works characters out when it meets them."""

    def __missing__(self, code: int) -> str:
        c = chr(code).lower()
        c = HOMOGLYPHS.get(c) or DIGITS.get(c) or c
        plain = unicodedata.normalize("NFKD", c)
        plain = "".join(x for x in plain if not unicodedata.combining(x)).lower()
        plain = "".join(HOMOGLYPHS.get(x, x) for x in plain)
        self[code] = plain if plain.isalpha() else "" if unicodedata.category(c[0]) in ("Cf", "Mn") else " "
        return self[code]


_FOLD = _Fold()
_ASCII = [_FOLD[i] for i in range(128)]  # so that ASCII texts take the fast path of str.translate


def fold(text: str | None) -> str:
    return f" {(text or '').translate(_FOLD)} "


class Lexicon:
    """Stems with weights, and exception phrases, as one automaton."""

    def __init__(self, weights: dict[str, float], exceptions=EXCEPTIONS) -> None:
        self.machine = ahocorasick.Automaton()
        self.empty = not weights
        for stem, weight in weights.items():
            self.machine.add_word(" " + stem, (len(stem), weight))
        for phrase in exceptions:
            phrase = " " + fold(phrase).strip() + " "
            self.machine.add_word(phrase, (len(phrase), None))
        if len(self.machine):
            self.machine.make_automaton()

    def total(self, folded: str) -> float:
        """The summed weights of the longest stem at each word, without those inside exceptions."""
        if self.empty:
            return 0.0
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in self.machine.iter(folded):
            if weight is None:
                spared.append((end - length + 1, end))
            else:
                found[end - length] = weight  # a longer stem at the same word comes later
        for begin, end in spared:
            for at in [a for a in found if begin <= a < end]:
                del found[at]
        return sum(found.values())


def features_of(total: float, words: int) -> tuple[float, float]:
    """Weight for each word of a text, and how much of it there is."""
    return math.log1p(100.0 * total / (words + PRIOR_WORDS)), math.log1p(total)


class Model:
    def __init__(self, weights: dict[str, float], coefficients: np.ndarray, exceptions=EXCEPTIONS) -> None:
        self.weights, self.coefficients, self.exceptions = weights, coefficients, exceptions
        self._lexicon = None

    def __getstate__(self):
        return self.weights, self.coefficients, self.exceptions

    def __setstate__(self, state):
        self.__init__(*state)

    @property
    def lexicon(self) -> Lexicon:
        if self._lexicon is None:
            self._lexicon = Lexicon(self.weights, self.exceptions)
        return self._lexicon

    def measure(self, text: str | None) -> tuple[float, float]:
        folded = fold(text)
        total = self.lexicon.total(folded)
        return features_of(total, len(folded.split()) if total else 0)

    def score(self, text: str | None) -> float:
        a, b = self.measure(text)
        z = self.coefficients[0] + self.coefficients[1] * a + self.coefficients[2] * b
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


def _stem_counts(sample: DataFrame) -> DataFrame:
    """(stem, toxic, clean): documents of each class in which enough of the words start with the stem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def rows() -> pa.RecordBatch:
            stems = list(counts[0].keys() | counts[1].keys())
            return pa.RecordBatch.from_arrays(
                [pa.array(stems, pa.string()), *(pa.array([c[s] for s in stems], pa.int64()) for c in (counts[1], counts[0]))],
                ["stem", "toxic", "clean"],
            )

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = Counter(fold(text).split())
                stems: Counter = Counter()
                for w, n in words.items():
                    for k in STEM:
                        if len(w) >= k:
                            stems[w[:k]] += n
                    if STEM.stop <= len(w) <= 16:
                        stems[w] += n
                least = MIN_SHARE * words.total()
                counts[toxic].update(s for s, n in stems.items() if n >= least)
            if len(counts[0]) > 500_000:
                yield rows()
                counts = (Counter(), Counter())
        yield rows()

    return sample.select("text", "toxic").mapInArrow(run, "stem string, toxic long, clean long").groupBy("stem").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )


def _evidence(toxic, clean, toxic_docs: int, clean_docs: int):
    """The likelihood ratio statistic of a stem and the classes, as a column."""
    total = float(toxic_docs + clean_docs)
    seen = toxic + clean

    def part(observed, expected):
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

    return 2 * (
        part(toxic, seen * (toxic_docs / total))
        + part(clean, seen * (clean_docs / total))
        + part(F.lit(toxic_docs) - toxic, (total - seen) * (toxic_docs / total) + 1e-9)
        + part(F.lit(clean_docs) - clean, (total - seen) * (clean_docs / total) + 1e-9)
    )


def _chosen(rows, toxic_docs: int, clean_docs: int) -> dict[str, float]:
    """Stems by evidence, the longest of equals, none a prefix of another."""
    weights: dict[str, float] = {}
    taken: set[str] = set()
    for r in rows:
        prefixes = {r.stem[:k] for k in range(1, len(r.stem) + 1)}
        if prefixes & weights.keys() or r.stem in taken:
            continue
        weights[r.stem] = math.log((r.toxic + 0.5) / (toxic_docs + 1)) - math.log((r.clean + 0.5) / (clean_docs + 1))
        taken |= prefixes
    return weights


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method with a little ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        ridge = 1e-2 * np.eye(len(beta))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += np.clip(step, -5, 5)
    return beta


# Used where there is nothing to learn the mapping from: no match is 0.02, a match of a seed in 20 words 0.9.
DEFAULT_COEFFICIENTS = np.array([-3.9, 2.0, 1.0])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_labelled: int = MAX_LABELLED,
    exceptions=EXCEPTIONS,
) -> Model:
    """A model from at most ``max_labelled`` rows of ``labels``, chosen by the hash of their id.

    Rows with a null id or label are not used; of several labels of one id the
    largest counts. Without labelled documents of both classes the seed lexicon
    is used as it is.
    """
    tuned(docs.sparkSession)
    docs = id_and_text(docs, id_col, text_col).where("doc_id IS NOT NULL")
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
        .where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    known = stored(known, "toxicity-labels")
    total = known.count()
    if total > max_labelled:
        # A few per cent below the bound, which the hash then does not exceed; the limit only makes sure.
        share = int(0.97 * max_labelled / total * (1 << 20))
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share).limit(max_labelled)
    sample = stored(docs.join(F.broadcast(known), "doc_id").select("text", "toxic"), "toxicity-sample")
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    weights = dict.fromkeys(SEED, SEED_WEIGHT)
    if len(sizes) < 2:
        return Model(weights, DEFAULT_COEFFICIENTS, exceptions)
    counts = _stem_counts(sample).where((F.col("toxic") >= MIN_SUPPORT) & (F.col("toxic") * sizes[0] > F.col("clean") * sizes[1] * 2))
    evidence = counts.withColumn("g", F.round(_evidence(F.col("toxic"), F.col("clean"), sizes[1], sizes[0]), 6))
    rows = evidence.where(F.col("g") >= MIN_EVIDENCE).orderBy(F.desc("g"), F.desc(F.length("stem")), "stem").limit(MAX_LEXICON).collect()
    weights = {s: w for s, w in weights.items() if not any(r.stem.startswith(s) or s.startswith(r.stem) for r in rows)}
    weights |= _chosen(rows, sizes[1], sizes[0])
    model = Model(weights, DEFAULT_COEFFICIENTS, exceptions)

    def measured(batch: pa.RecordBatch):
        values = np.array([model.measure(t) for t in batch.column(0).to_pylist()])
        return {"a": values[:, 0], "b": values[:, 1], "toxic": batch.column(1)}

    points = mapped(sample, "a double, b double, toxic int", measured).toPandas()
    model.coefficients = _logistic(points[["a", "b"]].to_numpy(), points["toxic"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every document row; a null or empty text has no match, a null id keeps its row."""
    tuned(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        model = shared.value
        return {"doc_id": batch.column(0), "score": np.array([model.score(t) for t in batch.column(1).to_pylist()])}

    return mapped(id_and_text(docs, id_col, text_col), "doc_id long, score double", run)


def held_out(id_col: str = "doc_id"):
    """The fold that labels are never learned from."""
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document row, learned outside the held-out fold."""
    model = fit(docs, labels.where(~held_out()))
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below the threshold, all columns as they are; a null or empty text stays if its score does."""
    tuned(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
