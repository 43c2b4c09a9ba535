"""First or last row of each key, by key first: the wide columns of the losers never move.

An aggregate over narrow columns finds the number of the winning row of each
key; then only the winners are read with all their columns. Row numbers are
stored with the rows, so both passes see the same ones. Orders are packed into
one number, as an aggregate with a value of fixed width is hashed, while one
that carries text sorts all rows, code included.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from pairloom.operators.bloom import Sieve
from pairloom.operators.joins import BROADCAST_ROWS, fits_broadcast
from pairloom.schemas import ORD
from pairloom.session import stored

ROW = "_row"
# Rows inside a block, as in monotonically_increasing_id.
POSITION_BITS = 33


def numbered(rows: DataFrame, label: str = "rows") -> DataFrame:
    """The rows, stored with a number for each; rows that have numbers are given back."""
    if ROW in rows.columns:
        return rows
    return stored(rows.withColumn(ROW, F.monotonically_increasing_id()), label)


def file_order(file_pos: str | Column = "file_pos", fn_pos: str | Column = "fn_pos") -> Column:
    """Place of a function over all files: a long and an int in one decimal, which aggregates hold in place."""
    wide = T.DecimalType(38, 0)
    file_pos, fn_pos = (F.col(c) if isinstance(c, str) else c for c in (file_pos, fn_pos))
    return (file_pos.cast(T.DecimalType(20, 0)) * F.lit(1 << 32).cast(T.DecimalType(10, 0)) + fn_pos).cast(wide)


def last_row(order: Column, of: Column | None = None) -> Column:
    """Number of the last row, of those for which ``of`` holds."""
    row = F.col(ROW)
    return F.max_by(row, order) if of is None else F.max_by(F.when(of, row), F.when(of, order))


def first_row(order: Column) -> Column:
    return F.min_by(ROW, order)


def with_record_order(rows: DataFrame, name: str = "_order", ord: str = "ord") -> DataFrame:
    """Add the place of each record over all inputs as one long.

    Input, part file and block become a rank: there are no more of them than
    splits of the inputs, so the ranks are made by one task and broadcast.
    """
    place = [F.col(ord)[c].alias(f"_{c}") for c in ("file_ord", "part", "block")]
    names = ["_file_ord", "_part", "_block"]
    # Parts compare as strings, as in the structs.
    rank = F.row_number().over(Window.orderBy(*names)).cast("long")
    blocks = rows.select(*place).distinct().select(*names, rank.alias("_rank"))
    same = [F.col(f"{ord}.{c[1:]}").eqNullSafe(F.col(c)) for c in names]
    position = F.col(ord)["pos"].bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    return (
        rows.join(F.broadcast(blocks), same)
        .withColumn(name, F.shiftleft("_rank", POSITION_BITS).bitwiseOR(position))
        .drop(*names, "_rank")
    )


def ordered_like_records(rows: DataFrame, order: Sequence[str]) -> bool:
    return len(order) == 1 and rows.schema[order[0]].dataType == ORD


def fetched(narrow: DataFrame, number: str, rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``narrow``, a stored table, with the columns of the numbered rows it names in ``number``.

    A broadcast of the narrow table leaves the rows where they are; beyond its
    bound only rows that pass a Bloom filter of the numbers are shuffled.
    """
    wanted = narrow.withColumn(ROW, F.col(number))
    fits, count = fits_broadcast(wanted, most)
    if fits:
        return rows.join(F.broadcast(wanted), ROW).drop(ROW)
    return Sieve(wanted, [ROW], count).may_match(rows).join(wanted, ROW).drop(ROW)


def winners(rows: DataFrame, keys: Sequence[str], order: Column, last: bool = True, label: str = "rows", most: int = BROADCAST_ROWS) -> DataFrame:
    """The last (or first) row of each key in ``order``. Null is a key like any other.

    Of rows that tie within a key one is taken.
    """
    rows = numbered(rows, label)
    best = rows.groupBy(*keys).agg((last_row(order) if last else first_row(order)).alias("_best")).select("_best")
    return fetched(stored(best, "winners"), "_best", rows, most).drop("_best")
