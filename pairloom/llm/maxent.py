"""A hashed maximum-entropy language model with class-factored softmax.

The probability of a word is that of its class in the context times that of the
word in its class. The classes come from counts: the most frequent words are
clustered by the words that stand before them, each cluster is cut into bands
of frequency, and all other words are one class. The class softmax has features
of the context, hashed into a table: the word before, the two before, and a
skip feature of the word before the last alone.

Weights are trained by distributed gradient updates: documents are dealt to
groups by a hash, as many as there are tokens for; every group takes gradient
steps over its documents in order of their ids, and the tables of all groups
are averaged. So the model depends on the documents alone, not on how the table
is cut into tasks. Rounds use disjoint parts of the training documents, so
together they read each once. The table grows with the square root of the
number of training tokens, up to a bound.

Counts of the most frequent words are broadcast, up to a fixed number; counts of
all other words reach the documents by a join, so scores are exact for any
vocabulary.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.frames import id_and_text, mapped, most_frequent, tuned
from pairloom.llm.words import batches_of, column_bytes, mix, word_hashes
from pairloom.session import stored

HEAD = 400_000
CLUSTERED = 20_000
CLUSTERS, BANDS = 6, 5
CLASSES = CLUSTERS * BANDS + 1
REST = CLASSES - 1
SIGNS = 16
# Feature rows up to 2^25 training tokens. They double with each fourfold of the tokens, up to 2^19 rows or 65 MB of weights.
BUCKETS, BUCKET_TOKENS, DOUBLINGS = 1 << 15, 1 << 25, 4
LEADING = 20
ROUNDS = 2
RATE, STEP_TOKENS = 0.5, 4096
# Training tokens that one group steps through in a round with the smallest table, and bytes of text it takes at once.
GROUP_TOKENS = 2_000_000
PORTION = 1 << 19
# Sums of weights are taken in whole numbers of this part of one.
FIXED = float(1 << 24)
SMOOTH = 0.1
END_HASH = np.uint64(0x5E5E5E5E5E5E5E5E)
ANY_COUNTS = 1 << 19


# --- tokens -----------------------------------------------------------------


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and one end after them, and how many each text has."""
    hashes, counts = word_hashes(*column_bytes(texts))
    ends = np.cumsum(counts)
    return np.insert(hashes, ends, END_HASH), counts + 1


def doublings(tokens: int) -> int:
    """How often the table doubles for a number of training tokens."""
    return int(min(max(round(np.log2(max(tokens, 1) / BUCKET_TOKENS) / 2), 0), DOUBLINGS))


def contexts(tokens: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Feature buckets (tokens, 4): bias, word before, two before, the one before the last alone."""
    first = np.cumsum(counts) - counts
    one, two = np.empty_like(tokens), np.empty_like(tokens)
    one[1:], two[2:] = tokens[:-1], tokens[:-2]
    one[first] = END_HASH
    two[:2] = END_HASH
    two[first] = END_HASH
    second = first[counts > 1] + 1
    two[second] = END_HASH
    low = np.uint64(buckets - 1)
    return np.stack(
        [
            np.zeros(len(tokens), np.int32),
            (mix(one + np.uint64(1)) & low).astype(np.int32),
            (mix(one * np.uint64(3) + two * np.uint64(5) + np.uint64(2)) & low).astype(np.int32),
            (mix(two + np.uint64(3)) & low).astype(np.int32),
        ],
        1,
    )


def training(id_col: str = "doc_id"):
    """Documents the model learns from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 10 != 0, F.lit(False))


# --- counts and classes -----------------------------------------------------


def _signs(before: np.ndarray) -> np.ndarray:
    """A few pseudo-random signs of each word before."""
    bits = (mix(before + np.uint64(77))[:, None] >> np.arange(SIGNS, dtype=np.uint64)) & np.uint64(1)
    return bits.astype(np.int8) * 2 - 1


def _counted(docs: DataFrame) -> DataFrame:
    """(word, n, s0 ..): how often each token comes in all the documents, and the sum of signs of what is before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def merged():
            words = np.concatenate([h[0] for h in held])
            order = np.argsort(words)
            words = words[order]
            cuts = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
            return (
                words[cuts],
                np.add.reduceat(np.concatenate([h[1] for h in held])[order], cuts),
                np.add.reduceat(np.concatenate([h[2] for h in held])[order], cuts),
            )

        def rows(part) -> pa.RecordBatch:
            words, n, signs = part
            columns = [pa.array(words.view(np.int64)), pa.array(n), *(pa.array(signs[:, i].astype(np.int64)) for i in range(SIGNS))]
            return pa.RecordBatch.from_arrays(columns, ["word", "n", *(f"s{i}" for i in range(SIGNS))])

        for batch in batches:
            for a, b in batches_of(batch.column(0), 1 << 20):
                tokens, counts = tokens_of(batch.column(0).slice(a, b - a))
                before = np.empty_like(tokens)
                before[1:] = tokens[:-1]
                before[np.cumsum(counts) - counts] = END_HASH
                order = np.argsort(tokens)
                words = tokens[order]
                cuts = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
                n = np.diff(np.r_[cuts, len(words)])
                held.append((words[cuts], n, np.add.reduceat(_signs(before[order]), cuts, dtype=np.int32)))
                size += len(cuts)
                if size > ANY_COUNTS:
                    part = merged()
                    if len(part[0]) > ANY_COUNTS // 2:
                        yield rows(part)
                        held, size = [], 0
                    else:
                        held, size = [part], len(part[0])
        if held:
            yield rows(merged())

    fields = ", ".join(["word long", "n long", *(f"s{i} long" for i in range(SIGNS))])
    sums = [F.sum(c).alias(c) for c in ("n", *(f"s{i}" for i in range(SIGNS)))]
    return docs.select("text").mapInArrow(run, fields).groupBy("word").agg(*sums)


def _clusters(vectors: np.ndarray, weights: np.ndarray, k: int, rounds: int = 25) -> np.ndarray:
    """Weighted k-means from deterministic, mutually distant starts."""
    centres = [vectors[int(weights.argmax())]]
    for _ in range(1, min(k, len(vectors))):
        far = np.min([((vectors - c) ** 2).sum(1) for c in centres], 0)
        centres.append(vectors[int((far * weights).argmax())])
    centres = np.array(centres)
    label = np.zeros(len(vectors), int)
    for _ in range(rounds):
        label = ((vectors[:, None] - centres[None]) ** 2).sum(2).argmin(1) if len(vectors) else label
        for c in range(len(centres)):
            mine = label == c
            if mine.any():
                centres[c] = np.average(vectors[mine], axis=0, weights=weights[mine])
    return label


class Vocabulary:
    """The most frequent words with counts and classes, and the totals of all words."""

    def __init__(self, words, n, signs, total: int, distinct: int) -> None:
        order = np.lexsort((words, -n))
        words, n = words[order], n[order]
        kind = np.full(len(words), REST, np.int16)
        top = np.arange(min(CLUSTERED, len(words)))
        top = top[signs[order][top].any(1)]  # only these have been asked for
        if len(top):
            mean = signs[order][top] / n[top, None]
            cluster = _clusters(mean, np.log1p(n[top].astype(float)), CLUSTERS)
            for c in range(CLUSTERS):
                mine = top[cluster == c]
                share = np.cumsum(n[mine]) / max(1, n[mine].sum())
                kind[mine] = c * BANDS + np.minimum((share * BANDS - 1e-9).astype(int), BANDS - 1)
        by_word = np.argsort(words)
        self.words, self.n, self.kind = words[by_word], n[by_word], kind[by_word]
        # Words are hashes, evenly spread: their first bits lead to within a few places of any of them.
        self.starts = np.searchsorted(self.words, np.arange(1 << LEADING, dtype=np.uint64) << np.uint64(64 - LEADING)).astype(np.int32)
        self.total, self.distinct = total, distinct
        tokens = np.bincount(self.kind, self.n, CLASSES)
        types = np.bincount(self.kind, minlength=CLASSES).astype(float)
        tokens[REST] += total - n.sum()
        types[REST] += distinct - len(words) + 1  # one more for all unknown words
        self.log_class = np.log10(tokens + SMOOTH * types + 1e-300)
        self.log_all = np.log10(total + SMOOTH * (distinct + 1))

    def place(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the head, and which tokens are in it."""
        if not len(self.words):
            return np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
        last = len(self.words) - 1
        at = np.minimum(self.starts.take((tokens >> np.uint64(64 - LEADING)).astype(np.int64)), last)
        behind = np.flatnonzero((self.words.take(at) < tokens) & (at < last))
        while len(behind):
            at[behind] += 1
            now = at.take(behind)
            behind = behind[(self.words.take(now) < tokens.take(behind)) & (now < last)]
        return at, self.words.take(at) == tokens

    def classes(self, tokens: np.ndarray) -> np.ndarray:
        return self.classes_at(*self.place(tokens))

    def classes_at(self, at: np.ndarray, known: np.ndarray) -> np.ndarray:
        return np.where(known, self.kind[at] if len(self.kind) else REST, REST)


# --- the class softmax ------------------------------------------------------


def _sums(table: np.ndarray, features: np.ndarray) -> np.ndarray:
    """The sum of the weights of each row of features, shifted by its maximum where the exponential could leave the range of a float."""
    z = table.take(features[:, 0], axis=0)
    for i in range(1, features.shape[1]):
        z += table.take(features[:, i], axis=0)
    if z.size and max(z.max(), -z.min()) > 80:
        z -= z.max(1, keepdims=True)
    return z


def class_scores(table: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Natural log probabilities of all classes for each row of features."""
    z = _sums(table, features)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    return z


def chosen_scores(table: np.ndarray, features: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Natural log probability of one class for each row of features."""
    z = _sums(table, features)
    own = z[np.arange(len(z)), kind]
    return own - np.log(np.exp(z, out=z).sum(1))


def _stable_order(bucket: np.ndarray) -> np.ndarray:
    """Sorts 16 bits at a time, which numpy does by radix."""
    order = np.argsort(bucket.astype(np.uint16), kind="stable")
    high = bucket >> 16
    return order.take(np.argsort(high.take(order).astype(np.uint16), kind="stable")) if high.any() else order


def _by_bucket(bucket: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that occur, and the sum of the rows of each."""
    order = _stable_order(bucket)
    ordered = bucket.take(order)
    cuts = np.r_[0, np.flatnonzero(ordered[1:] != ordered[:-1]) + 1]
    sizes = np.diff(np.r_[cuts, len(order)])
    if len(cuts) == 1:
        return ordered[:1], g.sum(0, keepdims=True)
    total = g.take(order.take(cuts), axis=0)
    many = np.flatnonzero(sizes > 1)
    if len(many):
        # Most buckets of a step occur once: only the rows of the others are summed.
        repeated = g.take(order[np.repeat(sizes > 1, sizes)], axis=0)
        total[many] = np.add.reduceat(repeated, np.cumsum(sizes[many]) - sizes[many], axis=0)
    return ordered.take(cuts), total


def gradient_steps(table: np.ndarray, seen: np.ndarray, features: np.ndarray, kind: np.ndarray) -> None:
    """Adaptive gradient steps in place, over sparse batches; ``seen`` holds squared gradients."""
    for at in range(0, len(kind), STEP_TOKENS):
        f, k = features[at : at + STEP_TOKENS], kind[at : at + STEP_TOKENS]
        g = _sums(table, f)
        np.exp(g, out=g)
        g /= g.sum(1, keepdims=True)
        g[np.arange(len(k)), k] -= 1
        for i in range(f.shape[1]):
            rows, total = _by_bucket(f[:, i], g)
            squared = seen.take(rows, axis=0)
            squared += total * total
            seen[rows] = squared
            squared += 1.0
            total *= RATE
            total /= np.sqrt(squared, out=squared)
            table[rows] = table.take(rows, axis=0) - total


def _dealt(docs: DataFrame, groups: int) -> DataFrame:
    """(group, text): documents in groups by a hash of the document, in order of their ids. The layout of the table has no part in it."""
    group = F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int")
    rows = docs.select(group.alias("group"), "doc_id", "text")
    # A task for each group: a hash of the group would put several into one task.
    return rows.repartitionById(groups, "group").sortWithinPartitions("group", "doc_id", "text").select("group", "text")


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array]]:
    """(group, texts) in order, cut after the document that fills a portion, however the batches are cut."""
    group, held, size = None, [], 0
    for batch in batches:
        groups, texts = batch.column(0).to_numpy(), batch.column(1)
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(groups):
            if held and groups[at] != group:
                yield group, pa.concat_arrays(held)
                held, size = [], 0
            group = int(groups[at])
            stop = at + int(np.argmax(np.append(groups[at:], group - 1) != group))
            filled = size + np.cumsum(lengths[at:stop])
            full = int(np.searchsorted(filled, PORTION))
            end = min(at + full + 1, stop)
            held.append(texts.slice(at, end - at))
            size = int(filled[end - at - 1])
            if size >= PORTION:
                yield group, pa.concat_arrays(held)
                held, size = [], 0
            at = end
    if held:
        yield group, pa.concat_arrays(held)


def _trained(docs: DataFrame, vocabulary, rounds: int, tokens: int) -> np.ndarray:
    """The weight table (buckets, classes). Each round averages, bucket by bucket, what the groups that met it made of it.

    Groups, their number and the order in them follow from the documents; the
    averages come from sums of whole numbers, which have no order.
    """
    spark = docs.sparkSession
    larger = doublings(tokens)
    buckets = BUCKETS << larger
    table = np.zeros((buckets, CLASSES), np.float32)
    # Groups grow with the table, so that what they send stays in proportion to the text.
    groups = max(1, -(-tokens // (rounds * GROUP_TOKENS << larger)))
    for number in range(rounds):
        shared = spark.sparkContext.broadcast(table)
        part = docs.where(F.pmod(F.xxhash64(F.lit(number // rounds), "doc_id"), F.lit(rounds)) == number)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, at_work = vocabulary.value, None
            own = seen = met = None
            for group, texts in _portions(batches):
                if group != at_work:
                    if at_work is not None:
                        yield from moved_rows(own, met)
                    at_work, own, met = group, shared.value.copy(), np.zeros(buckets, np.int64)
                    seen = np.zeros_like(own)
                tokens, counts = tokens_of(texts)
                features = contexts(tokens, counts, buckets)
                gradient_steps(own, seen, features, words.classes(tokens))
                for i in range(features.shape[1]):
                    met += np.bincount(features[:, i], minlength=buckets)
            if at_work is not None:
                yield from moved_rows(own, met)

        moved = _dealt(part, groups).mapInArrow(run, "bucket int, weight float, value array<float>")
        whole = lambda c: F.sum(F.rint(c * FIXED).cast("long"))
        sums = [whole(F.col("value")[i]).alias(f"v{i}") for i in range(CLASSES)]
        totals = moved.groupBy("bucket").agg(whole(F.col("weight")).alias("weight"), *sums)
        means = totals.select("bucket", *((F.col(f"v{i}") / F.col("weight")).cast("float").alias(f"v{i}") for i in range(CLASSES))).toArrow()
        if means.num_rows:
            rows = means["bucket"].to_numpy()
            table = table.copy()
            for i in range(CLASSES):
                table[rows, i] = means[f"v{i}"].to_numpy()
    return table


def moved_rows(own: np.ndarray, met: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The weighted sum of a group: how often it met the bucket, times the weights."""
    rows = np.flatnonzero(met)
    weight = np.sqrt(met[rows]).astype(np.float32)
    values = own[rows] * weight[:, None]
    for at in range(0, len(rows), 4096):
        some = values[at : at + 4096]
        lists = pa.FixedSizeListArray.from_arrays(pa.array(some.ravel()), CLASSES).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[at : at + 4096], pa.int32()), pa.array(weight[at : at + 4096]), lists], ["bucket", "weight", "value"]
        )


# --- the model --------------------------------------------------------------


def language_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, head: int = HEAD
) -> DataFrame:
    """One row per document row, learned from the training documents.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score. A null or empty text is its end alone. A row with a null id is
    neither learned from nor held out (null) but scored. Without training
    documents every token is unknown.
    """
    spark = tuned(docs.sparkSession)
    docs = id_and_text(docs, id_col, text_col)
    learned = docs.where(training())
    counts = stored(_counted(learned), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = most_frequent(counts, "n", head).select("word", "n").toArrow()
    names = [f"s{i}" for i in range(SIGNS)]
    near = most_frequent(counts, "n", min(head, CLUSTERED)).select("word", *names).toArrow()
    words, n = top["word"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(words)
    signs = np.zeros((len(words), SIGNS))
    if near.num_rows:
        at = order[np.searchsorted(words[order], near["word"].to_numpy().view(np.uint64))]
        signs[at] = np.stack([near[c].to_numpy() for c in names], 1)
    vocabulary = spark.sparkContext.broadcast(Vocabulary(words, n, signs, total, distinct))
    table = spark.sparkContext.broadcast(_trained(learned, vocabulary, rounds, total))
    whole_head = distinct <= head

    def run(batch: pa.RecordBatch):
        words, weights = vocabulary.value, table.value
        out = []
        for a, b in batches_of(batch.column(1), 1 << 19):
            tokens, counts = tokens_of(batch.column(1).slice(a, b - a))
            at, known = words.place(tokens)
            n = np.where(known, words.n[at] if len(words.n) else 0, 0)
            kind = words.classes_at(at, known)
            features = contexts(tokens, counts, len(weights))
            chosen = np.empty(len(tokens))
            for i in range(0, len(tokens), STEP_TOKENS):
                piece = slice(i, i + STEP_TOKENS)
                chosen[piece] = chosen_scores(weights, features[piece], kind[piece])
            inside = np.log10(n + SMOOTH)
            base = inside - words.log_all
            full = chosen / np.log(10) + inside - words.log_class[kind]
            first = np.cumsum(counts) - counts
            rest = [[]] * len(counts)
            if not whole_head:
                # Words outside the head: their counts come by the join.
                owner = np.repeat(np.arange(len(counts)), counts)[~known]
                lost = tokens[~known].view(np.int64)
                cuts = np.searchsorted(owner, np.arange(len(counts) + 1))
                rest = [lost[x:y].tolist() for x, y in zip(cuts, cuts[1:])]
            out.append(
                (
                    counts,
                    np.add.reduceat(known.astype(np.int64), first),
                    np.add.reduceat(base, first),
                    np.add.reduceat(full, first),
                    rest,
                )
            )
        counts, known, base, full = (np.concatenate([o[i] for o in out]) for i in range(4))
        return {
            "doc_id": batch.column(0),
            "n_tokens": counts,
            "n_known": known,
            "base_score": base,
            "score": full,
            "rest": pa.array([r for o in out for r in o[4]], pa.list_(pa.int64())),
        }

    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double, rest array<long>"
    scored = mapped(docs, schema, run)
    if not whole_head:
        scored = _with_rest(stored(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored"), counts)
    return scored.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 10 == 0).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def _with_rest(scored: DataFrame, counts: DataFrame) -> DataFrame:
    """Add what the counts of words outside the broadcast head change."""
    rest = scored.select("row", F.explode("rest").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    more = (
        rest.join(counts.select("word", "n"), "word")
        .groupBy("row")
        .agg(
            F.sum("times").alias("_known"),
            F.sum(F.col("times") * (F.log10(F.col("n") + F.lit(SMOOTH)) - F.lit(float(np.log10(SMOOTH))))).alias("_more"),
        )
    )
    zero = F.lit(0.0)
    return scored.join(more, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        (F.col("base_score") + F.coalesce("_more", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("_more", zero)).alias("score"),
    )
