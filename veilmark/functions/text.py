"""Text helpers: trimming, escaping, checksums, clock formats and pattern spans."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode classes, so digits, word boundaries and case follow Unicode rather than ASCII.
UNICODE_FLAGS = "(?U)"
SCAN_FLAGS = "(?iU)"

# ---- fixed values: characters that count as white space at the ends of a text -----------------
WHITE_SPACE = (
    "\t\n\u000b\f\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

SPAN = "struct<start:int,end:int>"
BLOCK_ITEMS = 64    # items of a list that are folded at once
BLOCK_CHARS = 4096  # characters that one cut may read in vain

_OPEN, _CLOSE = "\u0001", "\u0002"


def strip(text: Column | str) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def fold_text(text: Column) -> Column:
    """The normal form under which two texts count as the same."""
    return F.lower(strip(F.coalesce(text, F.lit(""))))


def escape_html(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def percent(value: Column) -> Column:
    """A share as a whole percent, half to even."""
    return F.concat(F.bround(value * 100, 0).cast("int").cast("string"), F.lit("%"))


def two_digits(value: Column) -> Column:
    return F.lpad(value.cast("string"), 2, "0")


def clock(ms: Column, pad_minutes: bool = False) -> Column:
    """`M:SS`, or `H:MM:SS` from one hour on; minutes padded on request."""
    seconds = F.floor(ms / 1000)
    minutes, hours = F.floor(seconds / 60), F.floor(seconds / 3600)
    tail = F.concat(F.lit(":"), two_digits(seconds % 60))
    short = two_digits(minutes % 60) if pad_minutes else minutes.cast("string")
    return F.when(
        hours > 0, F.concat(hours.cast("string"), F.lit(":"), two_digits(minutes % 60), tail)
    ).otherwise(F.concat(short, tail))


def luhn_valid(text: Column) -> Column:
    """Check digit test over the digits of a text, last digit first."""
    digits = F.reverse(F.regexp_extract_all(text, F.lit("[0-9]"), F.lit(0)))
    weighed = F.transform(
        digits,
        lambda d, i: d.cast("int") * F.when(i % 2 == 0, 1).otherwise(2)
        - F.when((i % 2 == 1) & (d.cast("int") > 4), 9).otherwise(0),
    )
    total = F.aggregate(weighed, F.lit(0), lambda a, d: a + d)
    return total % 10 == 0


def hits(text: Column, pattern: str, group: int = 0) -> Column:
    """Every match of a pattern, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once per row, also where a lambda uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def before_each(values: Column, step, zero: int) -> Column:
    """For each item of an integer list the fold of the items before it.

    Folds run over blocks of the list and the blocks are chained, as a fold that grows a list would copy it a step.
    """
    def fold(items: Column, start: Column) -> Column:
        return F.aggregate(items, start, step)

    def chained(parts: Column) -> Column:
        return let(F.transform(parts, lambda part: fold(part, F.lit(zero))), lambda totals: F.flatten(F.transform(
            parts, lambda part, b: let(fold(F.slice(totals, F.lit(1), b), F.lit(zero)), lambda base: F.transform(
                part, lambda _, i: fold(F.slice(part, F.lit(1), i), base)
            ))
        )))

    last = F.floor((F.size(values) - 1) / BLOCK_ITEMS).cast("int")
    parts = F.transform(
        F.sequence(F.lit(0), last), lambda b: F.slice(values, b * BLOCK_ITEMS + 1, F.lit(BLOCK_ITEMS))
    )
    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(let(parts, chained))


def blocks(text: Column) -> Column:
    """The text in blocks of `BLOCK_CHARS` characters, so that a cut need not count from its start."""
    return F.when(F.length(text) <= BLOCK_CHARS, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0))
    )


def cut(parts: Column, start: Column, end: Column) -> Column:
    """Characters start to end of a text given by its `blocks`; it reads the blocks in question only."""
    low = F.floor(start / BLOCK_CHARS).cast("int")
    many = F.floor((end - 1) / BLOCK_CHARS).cast("int") - low + 1
    return F.when(end <= start, F.lit("")).otherwise(F.substring(
        F.when(many == 1, F.get(parts, low)).otherwise(F.array_join(F.slice(parts, low + 1, F.greatest(many, F.lit(1))), "")),
        start - low * BLOCK_CHARS + 1, end - start,
    ))


def hit_spans(text: Column, pattern: str) -> Column:
    """Half-open character spans of every non-empty match, in order.

    The matches are bracketed by two control characters and the text is split at the opening one,
    so positions come from running sums over the pieces.
    """
    clean = F.translate(text, _OPEN + _CLOSE, "\u0003\u0003")  # as little a blank as they are
    pieces = F.split(F.regexp_replace(clean, pattern, f"{_OPEN}$0{_CLOSE}"), _OPEN)

    def placed(pieces: Column) -> Column:
        # The first piece lies before any match; every other one starts with a match and its end mark.
        sizes = F.transform(pieces, lambda p, i: F.length(p) - F.when(i == 0, 0).otherwise(1))
        starts = let(sizes, lambda v: before_each(v, lambda a, n: a + n, 0))
        return F.zip_with(pieces, starts, lambda p, at: F.struct(
            at.alias("start"), (at + F.instr(p, _CLOSE) - 1).alias("end")
        ))

    return F.filter(let(pieces, placed), lambda s: s["end"] > s["start"])
