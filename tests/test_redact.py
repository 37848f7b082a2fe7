"""Text redaction."""

import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from veilmark.functions import text as tx
from veilmark.operators.redact import MASK, redact_by_events, redact_text, secure_view
from veilmark.sources.rules import builtin_rules, make_rule


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")


def redacted(df):
    return [r.redacted for r in df.orderBy("i").collect()]


def test_solid_mask_keeps_length(spark):
    df = texts(spark, "ssn 123-45-6789, ip 8.8.8.8.", "nothing", "")
    assert redacted(redact_text(df, "t", builtin_rules())) == [
        "ssn " + MASK * 11 + ", ip " + MASK * 7 + ".", "nothing", "",
    ]


def test_overlapping_hits_are_hidden_whole(spark):
    df = texts(spark, "see https://user:secret@host.example now")
    assert redacted(redact_text(df, "t", builtin_rules())) == ["see " + MASK * len("https://user:secret@host.example") + " now"]


@pytest.mark.parametrize("strength, expected", [(1, "a1234567b"), (3, f"a1{MASK}{MASK}4{MASK}{MASK}7b"), (100, f"a1{MASK * 6}b")])
def test_pixelate_keeps_first_of_each_block(spark, strength, expected):
    df = texts(spark, "a1234567b")
    assert redacted(redact_text(df, "t", [make_rule("d", r"\d+")], "pixelate", strength)) == [expected]


def test_token_is_stable_and_salted(spark):
    df = texts(spark, "x EMP-1 y", "EMP-1")
    out = redacted(redact_text(df, "t", [make_rule("e", r"EMP-\d")], "blur", salt="s"))
    token = "[" + hashlib.sha256(b"sEMP-1").hexdigest()[:12] + "]"
    assert out == [f"x {token} y", token]


def test_spans_count_characters_not_bytes(spark):
    df = texts(spark, "é😀12 34").select(tx.hit_spans(F.col("t"), r"(?U)\d+").alias("s"))
    assert [tuple(s) for s in df.first().s] == [(2, 4), (5, 7)]


def test_empty_matches_do_nothing(spark):
    assert redacted(redact_text(texts(spark, "abc"), "t", [make_rule("e", "x*")])) == ["abc"]


def test_style_per_event(spark):
    docs = texts(spark, "abcdefghij")
    style = "struct<type:string,strength:int,color:string>"
    events = spark.createDataFrame([
        (0, 0, 2, ("solid_box", 15, "#000000"), "accepted", 0),
        (0, 1, 4, ("pixelate", 2, "#000000"), "accepted", 1),
        (0, 6, 9, ("pixelate", 2, "#000000"), "accepted", 2),
        (0, 9, 10, ("solid_box", 15, "#000000"), "pending", 3),
    ], f"i int, start int, end int, style {style}, status string, event_ord int")
    out = redact_by_events(docs, ["i"], "t", events).first()
    assert out.redacted == MASK * 4 + "ef" + f"g{MASK}i" + "j" and out.n_spans == 2


def test_secure_view(spark):
    df = spark.createDataFrame([("a",)], "extracted_text string")
    assert secure_view(df).first()[0] is None and secure_view(df, secure=False).first()[0] == "a"


@pytest.mark.parametrize("number, valid", [("4111 1111 1111 1111", True), ("4111 1111 1111 1112", False), ("79927398713", True)])
def test_luhn(spark, number, valid):
    assert spark.range(1).select(tx.luhn_valid(F.lit(number))).first()[0] is valid


def test_clock_and_escape(spark):
    row = spark.range(1).select(
        tx.clock(F.lit(61_999)), tx.clock(F.lit(3_661_000)), tx.clock(F.lit(61_999), True),
        tx.escape_html(F.lit("<a href='x'>&\"")), tx.percent(F.lit(0.125)), tx.percent(F.lit(0.875)),
    ).first()
    assert list(row) == ["1:01", "1:01:01", "01:01", "&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;", "12%", "88%"]


def brute_redacted(text, spans):
    hidden = [any(a <= i < b for a, b in spans) for i in range(len(text))]
    return "".join(MASK if h else c for c, h in zip(text, hidden))


@pytest.mark.parametrize("size", [tx.BLOCK_CHARS - 1, tx.BLOCK_CHARS, tx.BLOCK_CHARS + 1, 5 * tx.BLOCK_CHARS + 7])
def test_texts_of_several_blocks_equal_brute_force(spark, size):
    text = ("é😀 12 ab345\n" * (size // 12 + 1))[:size]
    rules = [make_rule("d", r"\d+"), make_rule("w", r"b34"), make_rule("n", r"12 a")]
    spans = [m.span() for r in rules for m in re.finditer(r["pattern"], text)]
    assert redacted(redact_text(texts(spark, text), "t", rules)) == [brute_redacted(text, spans)]


def test_a_hit_longer_than_blocks_is_hidden_whole(spark):
    text = "<" + "7" * (3 * tx.BLOCK_CHARS) + ">" + "x" * tx.BLOCK_CHARS
    assert redacted(redact_text(texts(spark, text), "t", [make_rule("d", r"7+")])) == [text.replace("7", MASK)]


def test_null_text_stays_null(spark):
    row = redact_text(texts(spark, None, "a1"), "t", [make_rule("d", r"\d")]).orderBy("i").collect()[0]
    assert row.redacted is None


def test_very_many_hits_in_a_huge_text_take_seconds(spark):
    hits = 20_000
    df = spark.range(1).select(F.repeat(F.lit("lorem ipsum " * 16 + "4711 "), hits).alias("t"))
    started = time.monotonic()
    row = redact_text(df, "t", [make_rule("d", r"\d+")]).select("redacted", "n_spans").first()
    assert time.monotonic() - started < 40
    assert row.n_spans == hits and row.redacted == ("lorem ipsum " * 16 + MASK * 4 + " ") * hits
