"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact join that removes its false hits."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.llm import bloom

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _directory(path: Column) -> Column:
    """The path up to its last slash."""
    return F.regexp_extract(path, "^((?s).*/)?", 0)


def url_verdicts(boxes: DataFrame, rules: DataFrame, max_blocks: int = bloom.MAX_BLOCKS) -> DataFrame:
    """Judge the URL in each text box by allow-list and deny-list rules.

    boxes: frame_idx, text (the URL). rules: type (allowlist or denylist), pattern (host and path, as net/);
    other columns are ignored. A rule fits its host and every subdomain if the URL's path starts with the
    rule's path. The longest pattern wins, of equal ones that with the longer host; listed both ways, a
    pattern denies. Returns a row per box: frame_idx, host, path, rule (pattern or null), verdict (block or
    allow; allow where no rule fits).

    A null URL or one without :// has an empty host and path and fits no rule. Null frame_idx and repeated
    rows are kept. Rules with a null pattern or of another type are ignored; an empty rule table allows all.

    Each distinct host and path is looked up once, under every host suffix and directory prefix that a rule
    could have (no deeper than the deepest rule, which is exact). The Bloom filter drops nearly all of these
    keys; the rest meets the rules in a hash join on host and directory.
    """
    listed = (
        rules.where(F.col("type").isin("allowlist", "denylist") & F.col("pattern").isNotNull())
        .select(
            F.translate(F.regexp_extract("pattern", "^[^/]*", 0), _UPPER, _LOWER).alias("r_host"),
            F.regexp_extract("pattern", "^[^/]*((?s).*)", 1).alias("r_path"),
            F.when(F.col("type") == "denylist", F.lit("block")).otherwise(F.lit("allow")).alias("r_verdict"),
        )
        .groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))
        .withColumn("r_dir", _directory(F.col("r_path")))
        .withColumn("r_key", F.xxhash64("r_host", "r_dir"))
    )
    table = bloom.build(listed, "r_key", max_blocks)
    depth = listed.select(
        F.coalesce(F.max(F.size(F.split("r_host", "\\."))), F.lit(0)),
        F.coalesce(F.max(F.size(F.split("r_dir", "/")) - 1), F.lit(0)),
    ).first()
    urls = boxes.select("frame_idx", url_host(F.col("text")).alias("host"), url_path(F.col("text")).alias("path"))
    suffixes = F.expr(f"""transform(sequence(1, least(size(split(host, '[.]')), greatest(1, {depth[0]}))),
        k -> array_join(slice(split(host, '[.]'), size(split(host, '[.]')) - k + 1, k), '.'))""")
    folders = F.expr(f"""concat(array(''), transform(filter(sequence(1, greatest(1, {depth[1]})),
        d -> d < size(split(path, '/')) AND d <= {depth[1]}), d -> concat(array_join(slice(split(path, '/'), 1, d), '/'), '/')))""")
    keys = (
        urls.where("host <> '' OR path <> ''").groupBy("host", "path").agg(F.lit(1).alias("one"))
        .select("host", "path", F.explode(suffixes).alias("suffix"), folders.alias("folders"))
        .select("host", "path", "suffix", F.explode("folders").alias("folder"))
        .withColumn("key", F.xxhash64("suffix", "folder"))
    )
    hits = (
        bloom.keep_possible(keys, "key", table)
        .join(listed, (F.col("suffix") == F.col("r_host")) & (F.col("folder") == F.col("r_dir")))
        .where(F.col("path").startswith(F.col("r_path")))
        .groupBy("host", "path")
        .agg(F.max(F.struct(
            F.length(F.concat("r_host", "r_path")), F.length("r_host"), F.concat("r_host", "r_path").alias("rule"),
            F.col("r_verdict").alias("verdict"),
        )).alias("best"))
        .select("host", "path", "best.rule", "best.verdict")
    )
    return urls.join(hits, ["host", "path"], "left").select(
        "frame_idx", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict")
    )
