"""Redaction of text columns, row by row inside the JVM; no shuffle.

Spans are half-open character ranges. Overlapping spans are united before anything is replaced, so a
hit that another rule also covers in part is hidden whole.
"""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions import text as tx
from veilmark.sources.rules import active_rules, collect_rules, guard_of, need_of, to_java

MASK = "█"
SPANS = f"array<{tx.SPAN}>"


def rule_spans(text: Column, rules: DataFrame | Iterable[dict]) -> Column:
    """Sorted spans of every match of every active regex rule.

    A text without any character class that the rules need is settled by one look.
    """
    none = F.array().cast(SPANS)
    usable = active_rules(collect_rules(rules), ("regex",))
    parts = []
    for rule in usable:
        spans = tx.hit_spans(text, tx.SCAN_FLAGS + to_java(rule["pattern"]))
        need = need_of(rule)
        parts.append(spans if need is None else F.when(text.rlike(need), spans).otherwise(none))
    if not parts:
        return none
    found = F.sort_array(F.flatten(F.array(*parts)))
    guard = guard_of(usable)
    return found if guard is None else F.when(text.rlike(guard), found).otherwise(none)


def united_spans(spans: Column) -> Column:
    """Unite sorted spans that overlap or touch; further fields are those of the earliest one.

    A span opens a united one if no earlier span reaches it.
    """
    def united(spans: Column, reached: Column) -> Column:
        def ranges(heads: Column) -> Column:
            def one(h: Column, k: Column) -> Column:
                after = F.get(heads, k + 1)
                end = F.when(after.isNull(), F.array_max(F.transform(spans, lambda s: s["end"]))).otherwise(
                    F.get(reached, after)
                )
                return F.get(spans, h).withField("end", end)

            return F.transform(heads, one)

        places = F.transform(spans, lambda s, i: F.when(F.get(reached, i) < s["start"], i))
        return tx.let(F.filter(places, lambda i: i.isNotNull()), ranges)

    def swept(spans: Column) -> Column:
        ends = F.transform(spans, lambda s: s["end"])
        reached = tx.let(ends, lambda v: tx.before_each(v, lambda a, e: F.greatest(a, e), -1))
        return F.when(F.size(spans) < 2, spans).otherwise(tx.let(reached, lambda r: united(spans, r)))

    return tx.let(spans, swept)


def solid(piece: Column) -> Column:
    """A mask of the same length."""
    return F.repeat(F.lit(MASK), F.length(piece))


def pixelate(piece: Column, strength: int) -> Column:
    """Keep the first character of each block and mask the rest."""
    block = max(1, strength)
    if block == 1:
        return piece
    # Every block is blown up to full size, so only the end has to be cut back.
    full = F.regexp_replace(piece, rf"(?s)(.).{{0,{block - 1}}}", f"$1{MASK * (block - 1)}")
    return F.substring(full, F.lit(1), F.length(piece))


def token(piece: Column, salt: str, size: int = 12) -> Column:
    """A stable salted token; equal pieces give equal tokens."""
    return F.concat(F.lit("["), F.substring(F.sha2(F.concat(F.lit(salt), piece), 256), 1, size), F.lit("]"))


def replace_spans(text: Column, spans: Column, style) -> Column:
    """Rebuild the text with every span of an ordered, disjoint list replaced by `style(piece, span)`.

    Each span brings the text before it and its own replacement, and the pieces are joined once. Pieces are cut
    from blocks of the text, so the work is linear in text and spans.
    """
    def rebuilt(parts: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            before = F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"])
            return F.concat(
                tx.cut(parts, before, s["start"]), style(tx.cut(parts, s["start"], s["end"]), s)
            )

        rest = tx.cut(parts, F.get(spans, F.size(spans) - 1)["end"], F.length(text))
        return F.concat(F.array_join(F.transform(spans, piece), ""), rest)

    return F.when(F.size(spans) == 0, text).otherwise(tx.let(tx.blocks(text), rebuilt))


def style_of(kind: str, strength: int = 15, salt: str = ""):
    """The piece function of a named style."""
    if kind == "pixelate":
        return lambda piece, span: pixelate(piece, strength)
    if kind == "blur":
        return lambda piece, span: token(piece, salt)
    return lambda piece, span: solid(piece)


def redact_text(
    df: DataFrame, text: str, rules: DataFrame | Iterable[dict], kind: str = "solid_box",
    strength: int = 15, salt: str = "", out: str = "redacted",
) -> DataFrame:
    """Hide every rule match of a text column; texts that cannot match skip the work."""
    rules = collect_rules(rules)
    body = F.col(text)
    spans = united_spans(rule_spans(body, rules))
    redone = replace_spans(body, F.col("_spans"), style_of(kind, strength, salt))
    return df.withColumn("_spans", spans).withColumn(out, redone).withColumn(
        "n_spans", F.size("_spans")
    ).drop("_spans")


def redact_by_events(
    documents: DataFrame, keys: list[str], text: str, events: DataFrame, salt: str = "", out: str = "redacted",
) -> DataFrame:
    """Apply accepted events (keys, start, end, style, status) to their documents.

    Overlapping spans are united; the style of the earliest one decides. The spans of a document are
    gathered per document, so their number is bounded by its length.
    """
    accepted = events.filter("status = 'accepted'").groupBy(*keys, "start", "end").agg(
        F.min_by("style", "event_ord").alias("style")
    )
    gathered = accepted.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "end", "style"))).alias("_s"))
    styled = "struct<start:int,end:int,style:struct<type:string,strength:int,color:string>>"
    united = united_spans(F.col("_s").cast(f"array<{styled}>"))
    joined = documents.join(gathered, keys, "left").withColumn(
        "_u", F.coalesce(united, F.array().cast(f"array<{styled}>"))
    )
    redone = replace_spans(F.col(text), F.col("_u"), lambda piece, s: _styled(piece, s["style"], salt))
    return joined.withColumn(out, redone).withColumn("n_spans", F.size("_u")).drop("_s", "_u")


def _styled(piece: Column, style: Column, salt: str) -> Column:
    """A piece in the style of its row; the block size may differ from row to row."""
    block = F.greatest(style["strength"], F.lit(1))
    blocks = F.transform(
        F.split(piece, ""), lambda c, i: F.when(i % block == 0, c).otherwise(F.lit(MASK))
    )
    return F.when(style["type"] == "pixelate", F.array_join(blocks, "")).when(
        style["type"] == "blur", token(piece, salt)
    ).otherwise(solid(piece))


def secure_view(df: DataFrame, text: str = "extracted_text", secure: Column | bool = True) -> DataFrame:
    """Withhold a text column where secure mode is on."""
    flag = secure if isinstance(secure, Column) else F.lit(secure)
    return df.withColumn(text, F.when(~flag, F.col(text)))


def accepted_events(events: DataFrame) -> DataFrame:
    return events.filter("status = 'accepted'")
