"""Detection rules: the built-in set, custom rule files, checks and edits."""

import re
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilmark.functions.text import SCAN_FLAGS
from veilmark.schemas import MAX_PATTERN_CHARS, RULE, RULE_TYPES

# ---- fixed values: built-in rules -----------------------------------------------------------
# rule_id, name, type, pattern, label, priority, confidence, context_pixels, description
BUILTIN = [
    ("phone_us", "US Phone Number", "regex",
     r"\b(\+1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "phone", 10, 0.95, None, ""),
    ("email", "Email Address", "regex",
     r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "email", 10, 0.95, None, ""),
    ("ssn", "US Social Security Number", "regex",
     r"\b\d{3}-\d{2}-\d{4}\b", "ssn", 5, 0.98, None, ""),
    ("credit_card", "Credit Card Number", "regex",
     r"\b(?:\d[ -]?){13,16}\b", "credit_card", 5, 0.85, None, ""),
    ("employee_id_6digit", "Employee ID (6-digit)", "regex",
     r"\(?\b\d{6}\b\)?", "employee_id", 8, 0.90, None,
     "Six digits on their own, in brackets or not."),
    ("ipv4_address", "IPv4 Address", "regex",
     r"\b(?!127\.0\.0\.1\b)(?!0\.0\.0\.0\b)(?!255\.255\.255\.255\b)"
     r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\."
     r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b",
     "account_id", 8, 0.85, None, "Dotted network addresses of four parts, apart from the reserved ones."),
    ("url_credentials", "URL with Credentials", "regex",
     r"https?://[^\s:@]+:[^\s:@]+@[^\s/]+", "account_id", 5, 0.95, None,
     "Web addresses that carry a user name and a password."),
    ("bank_account_us", "US Bank Account Number", "regex",
     r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "account_id", 8, 0.75, None,
     "Twelve digits in three blocks."),
    ("routing_number_aba", "ABA Routing Number", "regex",
     r"\b[0-3]\d{8}\b", "account_id", 8, 0.80, None, "Nine digits, the first at most 3."),
    ("ctx_phone_label", "Phone Label Context", "field_label",
     r"(?i)\b(?:phone|tel|mobile|cell|fax)\b", "phone", 30, 0.80, 200,
     "Takes the text beside a matching caption."),
    ("ctx_email_label", "Email Label Context", "field_label",
     r"(?i)\b(?:email|e-mail)\b", "email", 30, 0.80, 200,
     "Takes the text beside a matching caption."),
    ("ctx_ssn_label", "SSN Label Context", "field_label",
     r"(?i)\b(?:ssn|social\s*security)\b", "ssn", 30, 0.85, 200,
     "Takes the text beside a matching caption."),
    ("ctx_name_label", "Name Label Context", "field_label",
     r"(?i)\b(?:name|customer|patient|employee|applicant)\b", "person", 30, 0.70, 200,
     "Takes the text beside a matching caption."),
    ("ctx_account_label", "Account Label Context", "field_label",
     r"(?i)\b(?:account|acct|routing|bank)\b", "account_id", 30, 0.80, 200,
     "Takes the text beside a matching caption."),
]

# A text without this character class cannot match the pattern, so the costly search is skipped. This holds for
# the built-in patterns themselves; a rule that only shares an id with one has a pattern of its own and no guard.
_WITH_AT = ("email", "url_credentials")
NEEDS = {row[3]: "@" if row[0] in _WITH_AT else r"(?U)\d" for row in BUILTIN if row[2] == "regex"}


def need_of(rule: dict) -> str | None:
    """What every match of the rule's pattern contains, if known."""
    return NEEDS.get(rule["pattern"])


def guard_of(rules: Iterable[dict]) -> str | None:
    """One pattern that every text with a match of any of the rules contains, or None if unknown."""
    needs = {need_of(r) for r in rules}
    if not needs or None in needs:
        return None
    return "(?U)[" + "".join(sorted(n.removeprefix("(?U)") for n in needs)) + "]"


def make_rule(rule_id: str, pattern: str | None, label: str | None = None, **extra) -> dict:
    """A rule as a dict, with the defaults of the data model."""
    rule = {
        "rule_ord": 0, "rule_id": rule_id, "name": rule_id, "type": "regex", "enabled": True,
        "pattern": pattern, "label": label, "priority": 50, "confidence": 0.9,
        "context_pixels": None, "description": "",
    }
    rule.update(extra)
    return rule


def builtin_rules() -> list[dict]:
    fields = ("rule_id", "name", "type", "pattern", "label", "priority", "confidence",
              "context_pixels", "description")
    return [
        {"rule_ord": i, "enabled": True, **dict(zip(fields, row))} for i, row in enumerate(BUILTIN)
    ]


def rules_frame(spark: SparkSession, rules: Iterable[dict]) -> DataFrame:
    names = RULE.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rules], RULE)


def _rule_rows(spark: SparkSession, path: str) -> tuple[DataFrame, Column]:
    """The rows of rule files as they are, and whether a row is a valid rule."""
    schema = T.StructType([*RULE.fields, T.StructField("_corrupt", T.StringType())])
    raw = (
        spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt").json(path)
    )
    good = (
        F.col("_corrupt").isNull() & F.col("rule_id").isNotNull() & F.col("name").isNotNull()
        & F.col("type").isin(RULE_TYPES)
        & F.coalesce(F.col("confidence"), F.lit(0.9)).between(0.0, 1.0)
    )
    return raw, good


def rule_file_errors(spark: SparkSession, path: str) -> DataFrame:
    """Rows for whose sake a rule file is passed over: file, rule_id, problem."""
    raw, good = _rule_rows(spark, path)
    problem = (
        F.when(F.col("_corrupt").isNotNull(), "not JSON of a rule").when(F.col("rule_id").isNull() | F.col("name").isNull(), "no id or name")
        .when(~F.coalesce(F.col("type").isin(RULE_TYPES), F.lit(False)), "unknown type").otherwise("confidence out of range")
    )
    return raw.where(~F.coalesce(good, F.lit(False))).select(F.input_file_name().alias("file"), "rule_id", problem.alias("problem"))


def read_rules(spark: SparkSession, custom_path: str | None = None) -> DataFrame:
    """Built-in rules followed by those of the custom file or folder of files.

    A file with a malformed or invalid row counts as empty (`rule_file_errors` lists it); the other files stay.
    """
    rules = rules_frame(spark, builtin_rules())
    if custom_path is None:
        return rules
    raw, good = _rule_rows(spark, custom_path)
    raw = raw.withColumns({"_file": F.input_file_name(), "_row": F.monotonically_increasing_id()})
    bad = raw.where(~F.coalesce(good, F.lit(False))).select("_file").distinct()
    raw = raw.join(F.broadcast(bad), "_file", "left_anti")  # a row a file
    place = Window.orderBy("_file", "_row")  # rule files are small: one task numbers them in file order
    custom = raw.select(
        (F.row_number().over(place) + (len(BUILTIN) - 1)).alias("rule_ord"),
        "rule_id", "name", "type",
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
        "pattern", "label",
        F.coalesce("priority", F.lit(50)).alias("priority"),
        F.coalesce("confidence", F.lit(0.9)).alias("confidence"),
        "context_pixels",
        F.coalesce("description", F.lit("")).alias("description"),
    )
    return rules.unionByName(custom)


def collect_rules(rules: DataFrame | Iterable[dict]) -> list[dict]:
    """The rule table as dicts in rule order. Patterns become expressions of the plan, exact terms belong in a list table."""
    if not isinstance(rules, DataFrame):
        return list(rules)
    return [r.asDict(recursive=True) for r in rules.orderBy("rule_ord").collect()]


def _group(name: str) -> str:
    """A group name of letters and digits only."""
    return name if re.fullmatch("[A-Za-z][A-Za-z0-9]*", name) else "g" + name.encode().hex()


def _classes(pattern: str) -> str:
    """Escape what is literal inside a Python character class but an operator inside a Java one."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            out.append(pattern[at : at + 2])
            at += 2
            continue
        if not inside and c == "[":
            inside = True
            lead = re.match(r"\[\^?\]?", pattern[at:]).group()
            out.append(lead.replace("]", "\\]"))
            at += len(lead)
            continue
        if inside and c == "]":
            inside = False
        elif inside and (c == "[" or pattern[at : at + 2] == "&&"):
            out.append("\\")
        out.append(c)
        at += 1
    return "".join(out)


def to_java(pattern: str) -> str:
    """Spell named groups, the end anchor and character classes the way java.util.regex does."""
    out = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{_group(m[1])}>", _classes(pattern))
    out = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\k<{_group(m[1])}>", out)
    return out.replace(r"\Z", r"\z")


# A group that repeats without bound and whose body does so at its end or throughout: exponential on near misses.
_NESTED = re.compile(r"\((?:\?:|\?P?<\w+>)?(?:[^()\\]|\\.)*[*+]\)[*+]|\((?:\?:|\?P?<\w+>)?(?:[^()\\]|\\.)*\{\d+,\}\)[*+]")


def pattern_problem(pattern: str | None) -> str | None:
    """Why a pattern must not run, or None."""
    if pattern is None:
        return "no pattern"
    if len(pattern) > MAX_PATTERN_CHARS:
        return f"pattern exceeds {MAX_PATTERN_CHARS} chars"
    try:
        re.compile(pattern)
    except re.error as exc:
        return f"malformed regex: {exc}"
    if _NESTED.search(pattern):
        return "nested unbounded repetition"
    session = SparkSession.getActiveSession()
    if session is not None:
        try:
            session._jvm.java.util.regex.Pattern.compile(SCAN_FLAGS + to_java(pattern))
        except Py4JJavaError as exc:
            return f"malformed regex: {str(exc.java_exception.getMessage()).splitlines()[0]}"
    return None


def active_rules(rules: Iterable[dict], types: tuple[str, ...]) -> list[dict]:
    """Enabled rules of the given types whose pattern may run, in order."""
    return [
        r for r in rules
        if r["type"] in types and r.get("enabled", True) and pattern_problem(r["pattern"]) is None
    ]


def rule_errors(spark: SparkSession, rules: DataFrame | Iterable[dict]) -> DataFrame:
    """One warning per enabled pattern rule that will be skipped."""
    found = [
        (r["rule_id"], pattern_problem(r["pattern"]))
        for r in collect_rules(rules)
        if r["type"] in ("regex", "context", "field_label") and r.get("enabled", True)
        and pattern_problem(r["pattern"]) is not None
    ]
    return spark.createDataFrame(found, "rule_id string, problem string")
