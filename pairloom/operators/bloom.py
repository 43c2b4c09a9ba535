"""Bloom filters as small tables: rows that have no match are dropped before they are shuffled.

A filter is an array of 64-bit words, cut into segments, one row each. A key
sets four bits of one word, so it is built by ``bit_or`` per word, combined
map-side, and tested by a broadcast join on the segment. Its size follows the
number of keys up to a bound of bytes; past the bound more rows pass that have
no match, and none that has one is ever dropped. What passes needs the exact
join that the caller does anyway.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.session import stored

BITS_PER_KEY = 16
MOST_BYTES = 64 << 20
SEGMENT_WORDS = 1 << 13
# With fewer bits for each key more than half of the strangers would pass.
LEAST_BITS_PER_KEY = 2


def words_for(keys: int, most_bytes: int = MOST_BYTES) -> int:
    return max(1, min(most_bytes // 8, -(-keys * BITS_PER_KEY // 64)))


def _hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys)


def _word(h: Column, words: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 24), F.lit(words))


def _bits(h: Column) -> Column:
    """Four bits of a word, from the 24 low bits of the hash."""
    one = F.lit(1).cast("long")
    places = (F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(4))
    a, b, c, d = (F.call_function("shiftleft", one, place) for place in places)
    return a.bitwiseOR(b).bitwiseOR(c).bitwiseOR(d)


def build(table: DataFrame, keys: Sequence[str], words: int) -> DataFrame:
    """The filter of the keys of a table: (segment, words), at most ``8 * words`` bytes."""
    h = _hash(keys)
    marks = table.select(_word(h, words).alias("word"), _bits(h).alias("bits"))
    zeros = table.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    whole = marks.unionByName(zeros).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    # A segment has a fixed number of words.
    members = F.sort_array(F.collect_list(F.struct("word", "bits")))["bits"]
    return whole.groupBy(F.floor(F.col("word") / SEGMENT_WORDS).alias("segment")).agg(members.alias("words"))


def _test(filter_rows: DataFrame, keys: Sequence[str], words: int) -> Column:
    h = _hash(keys)
    word = _word(h, words)
    here = F.element_at(filter_rows["words"], (F.pmod(word, F.lit(SEGMENT_WORDS)) + 1).cast("int"))
    return (filter_rows["segment"] == F.floor(word / SEGMENT_WORDS)) & (here.bitwiseAND(_bits(h)) == _bits(h))


class Sieve:
    """The filter of a stored table of keys, to be used on one or more tables."""

    def __init__(self, table: DataFrame, keys: Sequence[str], rows: int, most_bytes: int = MOST_BYTES) -> None:
        self.keys = list(keys)
        self.words = words_for(rows, most_bytes)
        self.useful = rows * LEAST_BITS_PER_KEY <= self.words * 64
        self.filter = stored(build(table, keys, self.words), "bloom") if self.useful else None

    def may_match(self, df: DataFrame) -> DataFrame:
        """Rows whose key may be in the table: all that are, and a few others."""
        if not self.useful:
            return df
        return df.join(F.broadcast(self.filter), _test(self.filter, self.keys, self.words), "left_semi")

    def surely_not(self, df: DataFrame) -> DataFrame:
        """The other rows: none of their keys is in the table."""
        if not self.useful:
            return df.limit(0)
        return df.join(F.broadcast(self.filter), _test(self.filter, self.keys, self.words), "left_anti")
