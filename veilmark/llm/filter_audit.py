"""How text filters over findings interact: what each removes, in every order of the filters.

Five filters: A too few words, B too few distinct words, C too many capitals, D marks of markup or code, E the same text as an
earlier finding. E is found by an existential self-join; its findings are united with those that the others fail, and
only the combinations of failed filters are counted. Every order of the filters follows from those counts.
"""

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.plans.session import settle

LETTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_CAPITAL_PERCENT = 5
MARKS = r"[#$%&*|]"
_GAP = r"[\x20\x09-\x0D]+"


def _failed(text: Column, min_words: int, min_distinct: int, max_capitals: int) -> Column:
    """Bits 1, 2, 4, 8 of the filters A to D that a text fails."""
    words = F.filter(F.split(text, _GAP), lambda w: w != "")
    fails = [
        F.size(words) < min_words,
        F.lit(100) * F.size(F.array_distinct(words)) < F.lit(min_distinct) * F.size(words),
        F.lit(100) * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > F.lit(max_capitals) * F.length(text),
        text.rlike(MARKS),
    ]
    bits = F.lit(0)
    for k, fail in enumerate(fails):
        bits = bits + F.when(fail, 1 << k).otherwise(0)
    return bits.cast("int")


def repeated_findings(findings: DataFrame, marked: DataFrame) -> DataFrame:
    """event_id, h1, h2, project_id of findings whose text an earlier finding has (distinct).

    findings: event_id, h1, h2 (hashes of the text), project_id, text; marked: the same without the text. Hashes that
    one event_id alone has are left out first, so that only texts which may repeat travel. Of those each distinct text
    keeps its smallest event_id, and a finding is marked where such a row with equal hash, equal text and a smaller event_id exists.
    """
    # tables of their own, so that Spark may split a hash or text that many findings share
    several = settle(marked.where("event_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b")).where("a < b").select("h1", "h2"))
    maybe = settle(findings.where("event_id IS NOT NULL").join(several, ["h1", "h2"], "left_semi"))
    earliest = settle(maybe.groupBy("h1", "h2", "text").agg(F.min("event_id").alias("first_id")))
    x, y = maybe.alias("x"), earliest.alias("y")
    same = (F.col("x.h1") == F.col("y.h1")) & (F.col("x.h2") == F.col("y.h2")) & (F.col("x.text") == F.col("y.text"))
    return x.join(y, same & (F.col("y.first_id") < F.col("x.event_id")), "left_semi").select("event_id", "h1", "h2", "project_id").distinct()


def audit_filters(
    findings: DataFrame, reviewed: DataFrame, min_words: int = MIN_WORDS, min_distinct: int = MIN_DISTINCT_PERCENT,
    max_capitals: int = MAX_CAPITAL_PERCENT,
) -> DataFrame:
    """Effects of the filters A to E on the findings of each project, for all 120 orders of the filters.

    findings: event_id (any orderable type), project_id, extracted_text; reviewed: event_id, status; other columns are
    ignored. A finding fails A with fewer than `min_words` words (longest runs without blank and U+0009 to U+000D), B if
    distinct words are under `min_distinct` percent, C if capitals A-Z are over `max_capitals` percent of the characters,
    D if it holds any of # $ % & * |, E if a finding of a smaller event_id, of any project, kept or not, has the same text.

    Returns a row per project_id, filter_order (like BADCE) and step (1 to 5, of the letter there), with counts of the
    project's findings: kept (after the step), removed (by it), redundant (failing its filter, removed before),
    unique_fails (failing this filter only), accepted_lost and rejected_lost (removed by it, with a review of that
    status), shapley (removed by its filter, summed over all orders). Rows exist for every project that has a finding.

    A null text is empty, a null project_id the project ''. Findings that repeat an event_id are counted each, and are not earlier than
    one another; one without event_id is nobody's repetition. Reviews may repeat and
    contradict each other; those of unknown findings are ignored. An empty table gives no rows.
    """
    text = F.coalesce("extracted_text", F.lit(""))
    keyed = findings.select(
        "event_id", F.coalesce(F.col("project_id").cast("string"), F.lit("")).alias("project_id"), text.alias("text"),
        F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"),
    )
    marked = settle(keyed.select("event_id", "h1", "h2", "project_id", _failed(F.col("text"), min_words, min_distinct, max_capitals).alias("bits"), F.lit(1).cast("long").alias("n")))
    repeated = repeated_findings(keyed, marked).select("*", F.lit(16).alias("bits"), F.lit(0).cast("long").alias("n"))
    united = marked.unionByName(repeated).groupBy("event_id", "h1", "h2", "project_id").agg(F.bit_or("bits").alias("failed"), F.sum("n").alias("n"))
    status = lambda s: F.max(F.when(F.col("status") == s, 1).otherwise(0)).cast("long")
    reviews = reviewed.where("event_id IS NOT NULL").groupBy("event_id").agg(status("accepted").alias("accepted"), status("rejected").alias("rejected"))
    total = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c)
    combos = settle(
        united.join(reviews, "event_id", "left").groupBy("project_id", "failed")
        .agg(total("accepted"), total("rejected"), F.sum("n").alias("n"))
    )
    return _orders(combos)


def _orders(combos: DataFrame) -> DataFrame:
    """The audit rows from the counts of failed combinations, 32 a project at most.

    What a filter removes depends on the set of filters before it, not on their order: 5 * 16 sums a project are made
    and then joined to the 600 steps of all orders.
    """
    steps = [
        ("".join(order), k + 1, LETTERS.index(order[k]), sum(1 << LETTERS.index(c) for c in order[:k]))
        for order in permutations(LETTERS) for k in range(len(LETTERS))
    ]
    plan = combos.sparkSession.createDataFrame(steps, "filter_order string, step int, filter int, earlier int")
    cases = combos.groupBy("project_id").agg(
        F.collect_list(F.struct("failed", "n", "accepted", "rejected")).alias("parts")  # 32 at most
    ).withColumn("case", F.explode(F.sequence(F.lit(0), F.lit((1 << 5) * 5 - 1)))).select(
        "project_id", "parts", F.shiftright("case", 5).alias("filter"), F.col("case").bitwiseAND(31).alias("earlier")
    ).withColumn("bit", F.expr("shiftleft(1, filter)")).where(F.col("bit").bitwiseAND(F.col("earlier")) == 0)
    fails = lambda p: p["failed"].bitwiseAND(F.col("bit")) != 0
    before = lambda p: p["failed"].bitwiseAND(F.col("earlier")) != 0
    gone = lambda p: fails(p) & ~before(p)

    def total(of, column: str = "n") -> Column:
        return F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + F.when(of(p), p[column]).otherwise(0))

    sums = cases.select(
        "project_id", "filter", "earlier",
        total(lambda p: ~(fails(p) | before(p))).alias("kept"), total(gone).alias("removed"),
        total(lambda p: fails(p) & before(p)).alias("redundant"),
        total(lambda p: p["failed"] == F.col("bit")).alias("unique_fails"),
        total(gone, "accepted").alias("accepted_lost"), total(gone, "rejected").alias("rejected_lost"),
    )
    rows = sums.join(F.broadcast(plan), ["filter", "earlier"])  # 600 rows
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("project_id", "filter"))).select(
        "project_id", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "accepted_lost", "rejected_lost", "shapley"
    )
