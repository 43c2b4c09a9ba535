"""Near duplicates among embeddings by iterative quantisation and multi-index Hamming tables.

A rotation learned on a bounded sample makes binary codes whose bits are
balanced. Codes are cut into chunks; every chunk is a table, and two vectors of
a label meet where they agree in a whole chunk. Met pairs are ranked again by
the cosine of the original vectors, so what is linked is exact; only a pair
that agrees in no chunk is missed. The length of a chunk grows with the
logarithm of the largest label, and so many tables are made that a pair at the
threshold meets with probability ``RECALL`` if its bits differed independently
(near ones differ less). The signs are those of centred and projected vectors:
the angles of pairs at the threshold are measured there, on the sample. Where
so many tables would cost more than all pairs of a label, all are compared.

Equal vectors are one vector with a multiplicity. A pair counts in the first
table where it meets. A bucket larger than ``BLOCK`` is cut into blocks, one
group of rows for each pair of blocks.
"""

from collections.abc import Iterator
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.components import components
from pairloom.llm.frames import shuffle_tasks, small_or_dealt, sorted_groups, tuned
from pairloom.session import stored

COSINE = 0.93
BITS = 64
SAMPLE = 20_000
ITQ_ROUNDS = 30
RECALL = 0.999
BLOCK = 1024
MIN_CHUNK, MAX_CHUNK, BUCKET_ROWS = 8, 16, 32
# A row sent costs about as much as so many comparisons.
MANY_TABLES, ROW_COST = 64, 1000


# --- codes ------------------------------------------------------------------


def learned_rotation(x: np.ndarray, bits: int, rounds: int = ITQ_ROUNDS, seed: int = 0) -> np.ndarray:
    """Projection (dimension, bits) to the main directions, rotated so that signs lose least."""
    _, _, main = np.linalg.svd(x, full_matrices=False)
    if len(main) < bits:
        main = np.linalg.qr(np.vstack([main, np.random.default_rng(seed).normal(size=(bits, x.shape[1]))]).T)[0].T
    main = main[:bits].T
    v = x @ main
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.sign(v @ rotation).T @ v)
        rotation = (u @ w).T
    return main @ rotation


class Codes:
    """Signs of several learned rotations, one set for each dimension seen in the sample."""

    def __init__(self, sample: list[np.ndarray], rotations: int, chunk: int) -> None:
        self.rotations, self.chunk = rotations, chunk
        by_dim: dict[int, list] = {}
        for v in sample:
            by_dim.setdefault(len(v), []).append(v)
        self.known = {d: self._made(np.array(vs), d) for d, vs in by_dim.items()}

    def _made(self, x: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """Centre and projection; a dimension that the sample lacks has random directions."""
        width = self.rotations * BITS
        step = min(BITS, dim)
        if not self.chunk:
            return np.zeros(dim), np.zeros((dim, 0))
        if len(x) < 2:
            return np.zeros(dim), np.random.default_rng(dim).normal(size=(dim, width))
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        centre = x.mean(0)
        parts = [learned_rotation(x - centre, step, seed=i) for i in range(-(-width // step))]
        return centre, np.concatenate(parts, 1)[:, :width]

    def chunks(self, x: np.ndarray) -> np.ndarray:
        """Chunk values (rows, tables) of unit vectors of one dimension."""
        dim = x.shape[1]
        if not self.chunk:
            return np.zeros((len(x), 1), np.int32)
        if dim not in self.known:
            self.known[dim] = self._made(np.zeros((0, dim)), dim)
        centre, projection = self.known[dim]
        signs = (x - centre) @ projection > 0
        per_code = BITS // self.chunk
        weights = 1 << np.arange(self.chunk)
        tables = []
        for r in range(self.rotations):
            for c in range(per_code):
                at = r * BITS + c * self.chunk
                tables.append(signs[:, at : at + self.chunk] @ weights)
        return np.stack(tables, 1).astype(np.int32)


def threshold_angles(sample: list[np.ndarray], cosine: float = COSINE, most: int = 2000) -> list[np.ndarray]:
    """Angles, as the signs see them, between sampled vectors and made partners at the cosine.

    One array for each dimension and kind of partner: away in any direction, or
    only in those that the codes project to.
    """
    by_dim: dict[int, list] = {}
    for v in sample:
        by_dim.setdefault(len(v), []).append(v)
    out = []
    for dim, vectors in by_dim.items():
        if len(vectors) < 2 or dim < 2:
            continue
        x = np.array(vectors)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        centre = x.mean(0)
        main = learned_rotation(x - centre, min(BITS, dim), rounds=0)
        rng = np.random.default_rng(dim)
        x = x[rng.permutation(len(x))[:most]]
        for away in (rng.normal(size=x.shape), rng.normal(size=(len(x), main.shape[1])) @ main.T):
            away = away - (away * x).sum(1, keepdims=True) * x
            away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
            one, other = (x - centre) @ main, (cosine * x + math.sqrt(1 - cosine**2) * away - centre) @ main
            lengths = np.linalg.norm(one, axis=1) * np.linalg.norm(other, axis=1)
            out.append(np.arccos(np.clip((one * other).sum(1) / np.maximum(lengths, 1e-300), -1, 1)))
    return out


def _tables_for(agree: np.ndarray, recall: float) -> int:
    """The fewest tables in which pairs meet that agree in one with these chances."""
    enough = lambda t: ((1 - agree) ** t).mean() <= 1 - recall
    high = 1
    while not enough(high) and high < 1 << 40:
        high *= 2
    low = high // 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if enough(middle) else (middle, high)
    return high


def plan(largest: int, cosine: float = COSINE, recall: float = RECALL, angles: list[np.ndarray] = ()) -> tuple[int, int]:
    """Bits of a chunk and number of rotations for a largest label of so many vectors; no bits if all pairs are to be compared."""
    chunk = min(MAX_CHUNK, max(MIN_CHUNK, math.ceil(math.log2(max(1, largest / BUCKET_ROWS)))))
    tables = max(_tables_for((1 - a / math.pi) ** chunk, recall) for a in [np.array([math.acos(cosine)]), *angles])
    if tables > MANY_TABLES and tables * ROW_COST > 2 * largest:
        return 0, 1
    return chunk, -(-tables // (BITS // chunk))


# --- buckets ----------------------------------------------------------------


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def linked_pairs(x: np.ndarray, tables: np.ndarray, table: int, side: np.ndarray | None, cosine: float):
    """Pairs (i, j) of rows that reach the cosine and meet in no table before this one."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    if side is None:
        rows = columns = np.arange(len(x))
    else:
        rows, columns = np.flatnonzero(side), np.flatnonzero(~side)
    i, j = np.nonzero(x[rows] @ x[columns].T >= cosine)
    i, j = rows[i], columns[j]
    if side is None:
        i, j = i[i < j], j[i < j]
    for before in range(table):
        apart = tables[i, before] != tables[j, before]
        i, j = i[apart], j[apart]
    return i, j


def _bucket_links(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    for group in sorted_groups(batches, ["label", "dim", "table", "value", "low", "high"]):
        ids, times = group["vec_id"].to_numpy(), group["times"].to_numpy()
        if len(ids) < 2:
            continue
        side = None
        if group["low"][0].as_py() != group["high"][0].as_py():
            side = group["block"].to_numpy() == group["low"][0].as_py()
        i, j = linked_pairs(_vectors(group["embedding"]), _vectors(group["tables"]).astype(np.int64), group["table"][0].as_py(), side, cosine)
        if not len(i):
            continue
        links = np.bincount(i, times[j], len(ids)) + np.bincount(j, times[i], len(ids))
        root = ids.copy()
        while True:
            low = np.minimum(root[i], root[j])
            new = root.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            if (new == root).all():
                break
            root = new
        met = np.flatnonzero(links > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[met]), pa.array(links[met].astype(np.int64)), pa.array(root[met])], ["vec_id", "links", "root"]
        )


def embedding_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
    sample: int = SAMPLE,
    recall: float = RECALL,
    block: int = BLOCK,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector with an id.

    Vectors are compared within a label and a dimension. A null label, and a
    vector that is null, empty, zero or has null or non-finite components,
    links with nothing. Copies of a vector are linked with each other. Rows
    with a null id are left out; a repeated id gives a row each.
    """
    spark = tuned(vectors.sparkSession)
    numbers = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), numbers.alias("embedding"))
    rows = rows.where("vec_id IS NOT NULL")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.col("label").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    good = rows.where(usable)
    distinct = stored(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("times")), "itq-distinct")
    largest = distinct.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    total = distinct.count()
    mod = max(1, total // sample)
    chosen = distinct.where(F.pmod(F.xxhash64("vec_id"), F.lit(mod)) == 0).select("embedding").limit(2 * sample).toArrow()
    seen = [np.array(v, float) for v in chosen["embedding"].to_pylist()]
    chunk, rotations = plan(largest, cosine, recall, threshold_angles(seen, cosine))
    codes = spark.sparkContext.broadcast(Codes(seen, rotations, chunk))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("embedding"))
            tables: list = [None] * batch.num_rows
            lengths = np.diff(column.offsets.to_numpy())
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                x = _vectors(pa.chunked_array([column.take(pa.array(at))]))
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                for i, row in zip(at.tolist(), codes.value.chunks(x)):
                    tables[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tables, pa.list_(pa.int32()))], [*batch.schema.names, "tables"])

    with_codes = distinct.mapInArrow(coded, "label string, embedding array<double>, vec_id long, times long, tables array<int>")
    met = stored(with_codes, "itq-codes").select("*", F.size("embedding").alias("dim"), F.posexplode("tables").alias("table", "value"))
    key = ["label", "dim", "table", "value"]
    buckets = stored(met.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), "itq-buckets")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    placed = met.join(small_or_dealt(buckets), key).withColumn("blocks", blocks)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("meets", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *key, F.least("block", "meets").alias("low"), F.greatest("block", "meets").alias("high"), "block", "vec_id", "times", "embedding", "tables"
    )
    group = [*key, "low", "high"]
    links = stored(
        dealt.repartition(shuffle_tasks(rows), *group)
        .sortWithinPartitions(*group)
        .mapInArrow(lambda b: _bucket_links(b, cosine), "vec_id long, links long, root long"),
        "itq-links",
    )
    roots = components(links.select("vec_id", "root"), "itq-components").where("node != root")
    counts = links.groupBy("vec_id").agg(F.sum("links").alias("links"))
    one = (
        distinct.join(counts, "vec_id", "left")
        .join(roots.select(F.col("node").alias("vec_id"), "root"), "vec_id", "left")
        .select(
            "label",
            "embedding",
            (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"),
            F.coalesce("root", "vec_id").alias("component_id"),
        )
    )
    same = good.join(one, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return same.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
