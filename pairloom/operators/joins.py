"""Joins that hold up when one key has a third of all rows."""

from pyspark.sql import DataFrame, functions as F

from pairloom.operators.bloom import Sieve
from pairloom.session import stored

# A broadcast is bounded by rows, for the hash table, and by bytes.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
HEAVY_KEYS = 1_000
SALTS = 64


def fits_broadcast(df: DataFrame, rows: int) -> tuple[bool, int]:
    """Whether a stored table of keys can be broadcast, and its rows. Reads the table once."""
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(32)).cast("long")
    found = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return found["rows"] <= rows and found["bytes"] <= BROADCAST_BYTES, found["rows"]


def _salted(df: DataFrame, wanted: DataFrame, keys: list[str], spread: str, how: str) -> DataFrame:
    """The join by a shuffle: keys copied once per salt, rows of one key scattered over the salts by ``spread``.

    Where ``spread`` is itself a key no key is heavy, and nothing is copied.
    """
    if spread in keys:
        return df.join(wanted, keys, how)
    salted = wanted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
        .join(salted, [*keys, "_salt"], how)
        .drop("_salt")
    )


def _known(table: DataFrame, keys: list[str], rows: int) -> tuple[DataFrame, bool, int]:
    """The distinct keys of a table, stored: they are counted and joined, and whatever made them runs once."""
    wanted = stored(table.select(*keys).distinct(), "known")
    return wanted, *fits_broadcast(wanted, rows)


def skip_known(df: DataFrame, ledger: DataFrame, keys: list[str], spread: str = "file_path", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``df`` whose keys are not in ``ledger``.

    A ledger beyond a broadcast becomes a Bloom filter first: rows it has
    certainly not pass without a shuffle, the others are joined. ``df`` is
    then read twice.
    """
    wanted, fits, count = _known(ledger, keys, rows)
    if fits:
        return df.join(F.broadcast(wanted), keys, "left_anti").select(*df.columns)
    sieve = Sieve(wanted, keys, count)
    doubtful = _salted(sieve.may_match(df), wanted, keys, spread, "left_anti")
    if not sieve.useful:
        return doubtful.select(*df.columns)
    return sieve.surely_not(df).unionByName(doubtful).select(*df.columns)


def keep_known(df: DataFrame, table: DataFrame, keys: list[str], spread: str = "file_path", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``df`` whose keys are in ``table``. Beyond a broadcast only rows that pass a Bloom filter are shuffled."""
    wanted, fits, count = _known(table, keys, rows)
    if fits:
        return df.join(F.broadcast(wanted), keys, "left_semi").select(*df.columns)
    return _salted(Sieve(wanted, keys, count).may_match(df), wanted, keys, spread, "left_semi").select(*df.columns)


def narrow_to(df: DataFrame, table: DataFrame, keys: list[str], rows: int = BROADCAST_ROWS) -> DataFrame:
    """Drop rows that a later step would drop anyway, without a shuffle: by a broadcast, or beyond its bound by a Bloom filter.

    ``table`` has each key once, and is counted and joined: give a stored one.
    """
    wanted = table.select(*keys)
    fits, count = fits_broadcast(wanted, rows)
    if fits:
        return df.join(F.broadcast(wanted), keys, "left_semi").select(*df.columns)
    return Sieve(wanted, keys, count).may_match(df)


def attach_content(file_list: DataFrame, contents: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The landed content of each listed file; listed files that never arrived drop out.

    ``file_list`` is counted and joined: give a stored one. Of a list beyond a
    broadcast only contents that pass its Bloom filter are shuffled. A file is
    one key, so the shuffled form has no heavy key.
    """
    keys = ["repository_full_name", "file_path"]
    landed = contents.select(*keys, "content")
    fits, count = fits_broadcast(file_list, rows)
    if fits:
        return landed.join(F.broadcast(file_list), keys)
    return Sieve(file_list, keys, count).may_match(landed).join(file_list, keys)


def heavy_keys(df: DataFrame, keys: list[str], most: int = HEAVY_KEYS) -> DataFrame:
    """The ``most`` most frequent keys: any other key has less than one in ``most`` of the rows.

    Bounded, so it can always be broadcast. Counts are combined map-side.
    """
    return df.groupBy(*keys).count().orderBy(F.desc("count"), *keys).limit(most).select(*keys)


def skewed_lookup(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    hot: DataFrame | None = None,
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Join many ``left`` rows to the one ``right`` row of their key.

    Without ``hot`` adaptive execution splits an oversized partition of the
    left side. With ``hot`` (see ``heavy_keys``) the split is part of the
    plan: left rows of a hot key go to a salt made from their own values, and
    only the right rows of hot keys are copied once per salt.
    """
    if hot is None:
        return left.join(right, keys, how)
    marked = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    others = [c for c in left.columns if c not in keys]
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*others), F.lit(salts)).cast("int")).otherwise(0)
    copies = F.sequence(F.lit(0), F.when(F.col("_hot"), salts - 1).otherwise(0))
    salted_left = left.join(marked, keys, "left").withColumn("_salt", salt).drop("_hot")
    salted_right = right.join(marked, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")
