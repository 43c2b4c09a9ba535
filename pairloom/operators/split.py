"""Positions in a total order, and contiguous shards."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.session import stored

ROW_BITS = 33  # row number inside a partition, as in monotonically_increasing_id
SAMPLE = 65_536  # keys of the sample that tells about where shards start
TREE = 16  # bounds that are compared by compiled conditions


def _parallelism(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_position(df: DataFrame, order: Sequence[str], name: str = "position", ranges: int | None = None) -> DataFrame:
    """Add the 0-based rank of each row in ``order``, which must be a total order.

    Range-sort, number the rows inside each range, store, then add the size
    of the ranges before. Storing pins the ranges: range bounds come from a
    sample and would differ if the plan ran twice. Offsets are one row per
    range, a fixed number, so their window and their broadcast are bounded.
    """
    ranges = ranges or _parallelism(df)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    numbered = stored(
        df.repartitionByRange(ranges, *order)
        .sortWithinPartitions(*order)
        .withColumns({"_range": F.spark_partition_id(), "_inside": inside}),
        "ranges",
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy("_range")
        .agg(F.count("*").alias("_rows"))
        .select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0).cast("long")).alias("_before"))
    )
    return (
        numbered.join(F.broadcast(offsets), "_range")
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_range", "_inside", "_before")
    )


def shard_size(total: int, n: int) -> int:
    return -(-total // _checked(n))


def _checked(n: int) -> int:
    if n < 1:
        raise ValueError("the number of shards must be at least 1")
    return n


def rank_in(bounds: Column, key: Column, most: int) -> Column:
    """How many of at most ``most`` ascending bounds are not above the key, by binary search.

    A few bounds make a tree of conditions, which is compiled; more are
    searched by halving steps over the array. Past its end ``get`` is null.
    """

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.get(bounds, F.lit(middle)) <= key, tree(middle + 1, high)).otherwise(tree(low, middle))

    def halving(k: Column) -> Column:
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= k, at + step).otherwise(at))

    if most <= TREE:
        return tree(0, most)
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(most.bit_length()))))
    # Over an array of one, so that the key is made once and not at each step.
    return F.get(F.transform(F.array(key), halving), F.lit(0))


def _brackets(keys: DataFrame, order: Sequence[str], total: int, size: int) -> DataFrame:
    """One row: ascending keys, two around the likely place of each shard start.

    From a uniform sample of a fixed size, which is a quantile sketch of any
    ordered type. Four standard deviations wide, and as narrow as can be where
    the sample is the table. Stored, as a sample may differ when drawn again.
    """
    sample = keys.sample(fraction=SAMPLE / total, seed=1) if total > SAMPLE else keys
    drawn = sample.agg(F.sort_array(F.collect_list(F.struct(*order))).alias("_drawn"))
    drawn = drawn.withColumn("_m", F.size("_drawn").cast("long"))
    missed = F.greatest(1 - F.col("_m") / total, F.lit(0.0))
    wide = F.ceil(2 * F.sqrt(F.col("_m") * missed)).cast("long")
    starts = F.sequence(F.lit(size).cast("long"), F.lit(max(total - 1, size)).cast("long"), F.lit(size).cast("long"))
    around = F.flatten(F.transform(starts, lambda at: _around(F.floor(at * F.col("_m") / total), wide)))
    places = F.array_sort(F.array_distinct(F.filter(around, lambda at: (at >= 0) & (at < F.col("_m")))))
    return stored(drawn.select(F.transform(places, lambda at: F.get("_drawn", at.cast("int"))).alias("bounds")), "brackets")


def _around(at: Column, wide: Column) -> Column:
    return F.array(at - wide, at + wide + 1)


def _in_intervals(keys: DataFrame, order: Sequence[str], brackets: DataFrame, most: int) -> DataFrame:
    """The keys with the number of the interval between brackets they lie in."""
    rank = rank_in(F.col("_bounds"), F.struct(*order), most)
    return keys.withColumn("_bounds", brackets.scalar()).withColumn("_interval", rank).drop("_bounds")


def shard_starts(keys: DataFrame, order: Sequence[str], total: int, size: int) -> DataFrame:
    """The keys at the positions size, 2 * size, ... of the order.

    A sample gives a narrow interval around each of them and one pass counts
    all intervals, so the interval of every wanted position is known. Only keys
    of those intervals are sorted, to count on from the exact start of theirs.
    Whatever the sample is, the result is the same.
    """
    placed = _in_intervals(keys, order, _brackets(keys, order, total, size), 2 * (-(-total // size)))
    counts = placed.groupBy("_interval").agg(F.count("*").alias("_rows"))
    # At most two intervals for each shard: their windows and their broadcast are bounded.
    before = Window.orderBy("_interval").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.coalesce(F.sum("_rows").over(before), F.lit(0).cast("long"))
    next_start = F.greatest(F.ceil(F.col("_before") / size), F.lit(1)) * size
    wanted = counts.withColumn("_before", so_far).where(next_start < F.col("_before") + F.col("_rows"))
    wanted = stored(wanted.select("_interval", (F.col("_before") - so_far).alias("_skipped")), "intervals")
    inside = placed.join(F.broadcast(wanted), "_interval")
    ranked = with_position(inside, order, "_place")
    return ranked.withColumn("position", F.col("_place") + F.col("_skipped")).where(F.col("position") % size == 0).where(
        "position > 0"
    )


def assign_split(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """Add ``split`` in 1..n: shard i holds positions [(i-1)*size, i*size), size = ceil(total/n).

    Only order columns are moved, to find the first key of each shard, and of
    them only those near such a key. The rows are then placed by a binary
    search in those at most n-1 keys; they are not shuffled. The table is read
    four times: give a stored one.
    """
    keys = df.select(*order)
    total = keys.count()
    size = shard_size(total, n)
    if size == 0:
        return df.withColumn("split", F.lit(1).cast("long"))
    key = F.struct(*order)
    # At most n-1 keys, one array value.
    bounds = shard_starts(keys, order, total, size).agg(F.sort_array(F.collect_list(key)).alias("starts")).scalar()
    split = rank_in(F.col("_starts"), key, n).cast("long") + 1
    return df.withColumn("_starts", bounds).withColumn("split", split).drop("_starts")


def split_sizes(df: DataFrame, n: int) -> DataFrame:
    """Rows of each of the n shards by arithmetic on the count; trailing shards may be empty."""
    total = df.agg(F.count("*").alias("total")).scalar()
    shards = df.sparkSession.range(1, _checked(n) + 1).select(F.col("id").alias("split"), total.alias("total"))
    size = F.ceil(F.col("total") / n)
    start = F.least((F.col("split") - 1) * size, F.col("total"))
    end = F.least(F.col("split") * size, F.col("total"))
    return shards.select("split", (end - start).alias("num_rows"))
