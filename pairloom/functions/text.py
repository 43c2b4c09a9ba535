"""Base64 and UTF-8 decoding that stays inside the JVM."""

from pyspark.sql import Column, DataFrame, functions as F

_REPLACEMENT = "�"
_ESCAPE = "\x01"


def utf8_ignoring_errors(text: Column) -> Column:
    """The valid part of a string column that was cast from bytes.

    ``make_valid_utf8`` turns each bad run into U+FFFD. To delete those and
    keep the U+FFFD characters that were in the text, the latter are escaped
    first; both escape bytes are ASCII or start with a lead byte, so they can
    not be part of a bad run.
    """
    escaped = _replace(_replace(text, _ESCAPE, _ESCAPE + "a"), _REPLACEMENT, _ESCAPE + "b")
    cleaned = _replace(F.make_valid_utf8(escaped), _REPLACEMENT, "")
    restored = _replace(_replace(cleaned, _ESCAPE + "b", _REPLACEMENT), _ESCAPE + "a", _ESCAPE)
    return F.when(F.is_valid_utf8(text), text).otherwise(restored)


def unwrapped(encoded: Column) -> Column:
    """Base64 without its line breaks."""
    return _replace(_replace(encoded, "\n", ""), "\r", "")


def base64_bytes(symbols: Column) -> Column:
    """Lenient base64: characters outside the alphabet are skipped, decoding
    stops at the first complete padding. Null for text that ends inside a group
    of four or is not ASCII. Well-formed text takes the short branch."""
    regular = (F.length(symbols) % 4 == 0) & F.rlike(symbols, F.lit("^[A-Za-z0-9+/]*+={0,2}$"))
    ascii_only = F.octet_length(symbols) == F.length(symbols)
    known = F.regexp_replace(symbols, "[^A-Za-z0-9+/=]", "")
    return F.when(regular, F.unbase64(symbols)).when(ascii_only, F.unbase64(_data_symbols(known)))


def _data_symbols(symbols: Column) -> Column:
    """The symbols before the first complete padding, re-padded; null if they end inside a group.

    Pieces between ``=`` signs: a non-empty piece takes back the pads counted
    so far, an empty one adds a pad. Two symbols into a group need two pads,
    three need one; pads elsewhere are skipped.
    """
    state = F.struct(F.lit("").alias("data"), F.lit(0).alias("pads"), F.lit(False).alias("done"))

    def step(acc: Column, piece: Column) -> Column:
        data = F.concat(acc["data"], piece)
        pads = F.when(piece != "", 0).otherwise(acc["pads"]) + 1
        filled = F.length(data) % 4
        done = (filled >= 2) & (filled + pads >= 4)
        return F.when(acc["done"], acc).otherwise(
            F.struct(data.alias("data"), pads.alias("pads"), done.alias("done"))
        )

    pieces = F.split(symbols, "=", -1)
    # Every piece but the last is followed by one sign.
    ended = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), state, step)
    tail = F.when(ended["done"], "").otherwise(F.element_at(pieces, -1))
    data = F.concat(ended["data"], tail)
    whole = ended["done"] | (F.length(data) % 4 == 0)
    return F.when(whole, F.rpad(data, (F.ceil(F.length(data) / 4) * 4).cast("int"), "="))


def decode_text(df: DataFrame, encoded: str, name: str) -> DataFrame:
    """Replace base64 column ``encoded`` by text column ``name``; null where it can not be decoded.

    One column per step: each is used several times by the next, and as one
    expression the early steps would be computed again at every use.
    """
    return (
        df.withColumn("_symbols", unwrapped(F.col(encoded)))
        .withColumn("_raw", base64_bytes(F.col("_symbols")).cast("string"))
        .withColumn(name, utf8_ignoring_errors(F.col("_raw")))
        .drop(*{encoded, "_symbols", "_raw"} - {name})
    )


def stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))

