import base64
import binascii
import random

from pyspark.sql import functions as F

from pairloom.functions.text import decode_text, stripped, utf8_ignoring_errors


def python_decode(text):
    try:
        return base64.b64decode(text).decode("utf-8", errors="ignore")
    except (binascii.Error, ValueError):
        return None


def check(spark, texts):
    df = spark.createDataFrame([(t, python_decode(t)) for t in texts], "enc string, want string")
    bad = decode_text(df, "enc", "got").where("not (got <=> want)")
    assert bad.take(3) == []


def test_base64_matches_python_on_odd_padding_and_noise(spark):
    rng = random.Random(5)
    texts = {"", "=", "====", "QUJD", "QUI=", "QQ==", "QUJD\nREVG\n", "QQ==QUJD", "QUI=QUJD", "Q=UJD", "Q", "QU", "QUJ", "QU=JD", "é"}
    while len(texts) < 20_000:
        texts.add("".join(rng.choice("QUJDab+/==== \n-_\r\x00") for _ in range(rng.randint(1, 14))))
    check(spark, sorted(texts))


def test_long_text_with_line_breaks(spark):
    raw = ("def f():\n    return 'é漢�'\n" * 20_000).encode()
    check(spark, [base64.encodebytes(raw).decode(), base64.b64encode(raw + b"\xff\xe4").decode()])


def test_bad_utf8_vanishes_like_in_python(spark):
    rng = random.Random(7)
    edge = [0x00, 0x01, 0x41, 0x7F, 0x80, 0x8F, 0x90, 0x9F, 0xA0, 0xBF, 0xC0, 0xC2, 0xDF, 0xE0, 0xED, 0xEF, 0xBB, 0xBD, 0xF0, 0xF4, 0xF5, 0xFF]
    rows = [bytes(rng.choice(edge) for _ in range(rng.randint(1, 12))) for _ in range(30_000)]
    for _ in range(10_000):
        cut = bytearray("".join(rng.choice(["a", "é", "中", "😀", "�", "\x01", "\x01a", "\x01b"]) for _ in range(8)).encode())
        for _ in range(rng.randint(0, 3)):
            del cut[rng.randrange(len(cut))]
        rows.append(bytes(cut))
    df = spark.createDataFrame([(bytearray(b), b.decode("utf-8", "ignore")) for b in rows], "raw binary, want string")
    got = df.select("raw", "want", utf8_ignoring_errors(F.col("raw").cast("string")).alias("got"))
    assert got.where("got <> want or not is_valid_utf8(got)").take(3) == []


def test_stripped(spark):
    df = spark.createDataFrame([(" \t a:b \r\n",)], "line string")
    assert df.select(stripped(F.col("line"))).first()[0] == "a:b"
