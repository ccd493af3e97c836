"""Secrets across lines: template literals, joined string literals and blocks of base64."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.functions.catalog import ENTROPY_RULE, PATTERN_RULES, REFERENCE_CASE, Rule
from siftwell.operators.detect import PASS_MULTILINE, constants, occurrences

LARGEST = 500 * 1024
TEMPLATE = "(?s)`[^`]{20,}`"
JOINED = "\"[^'\"]{4,}\"\\s*\\+\\s*\"[^'\"]{4,}\"|'[^'\"]{4,}'\\s*\\+\\s*'[^'\"]{4,}'"
#: Maximal runs of at least three lines of base64, which blanks may surround. Possessive throughout: nothing is tried twice.
_LINE = r"[ \t\x0B\f\r]*+[A-Za-z0-9+/=]{20,}+[ \t\x0B\f\r]*+(?=\n|\z)"
BASE64 = rf"(?:\A|(?<=\n)){_LINE}(?:\n{_LINE}){{2,}}+"
#: What the line before a block must look like for its entropy to count (fixed value).
CONTEXT = r"[=:]\s*\z|(?i)(?:key|secret|password|token|credential|api[_-]?key)\s*[=:]"


def _found(files: DataFrame, keys: tuple[str, ...], pattern: str, kind: str) -> DataFrame:
    rows = files.filter(F.col("content").rlike(pattern))
    rows = rows.withColumn("m", F.explode(occurrences(F.col("content"), F.lit(pattern))))
    before = F.substring(F.col("content"), F.lit(1), F.col("m.start"))
    lines_before = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    return rows.select(
        *keys, (lines_before + 1).cast("int").alias("line_number"), F.col("m.match").alias("raw"), F.lit(kind).alias("kind"),
        F.get(F.split("content", "\n", -1), (lines_before - 1).cast("int")).alias("context"), F.col("m.number").alias("number"),
    )


def template_literals(files: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    rows = _found(files, keys, TEMPLATE, "template")
    inner = F.regexp_replace(F.substring(F.col("raw"), F.lit(2), F.length("raw") - 2), r"\$\{[^}]*\}", "")
    return rows.withColumn("text", inner).filter(F.length("text") >= 20).drop("raw")


def joined_literals(files: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    rows = _found(files, keys, JOINED, "concat")
    quote = F.substring("raw", 1, 1)
    bare = F.regexp_replace("raw", "(\"\\s*\\+\\s*\"|'\\s*\\+\\s*')", "")
    return rows.withColumn("text", F.replace(bare, quote, F.lit(""))).filter(F.length("text") >= 20).drop("raw")


def base64_blocks(files: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    rows = _found(files, keys, BASE64, "base64")
    return rows.withColumn("text", F.regexp_replace("raw", r"\s+", "")).drop("raw")


def findings(files: DataFrame, threshold: Column, keys: tuple[str, ...] = ("file",), rules: tuple[Rule, ...] = PATTERN_RULES, case_mode: str = REFERENCE_CASE) -> DataFrame:
    """files: key columns and content. For each candidate its first rule, else its entropy if the line before is an assignment."""
    small = files.filter(F.length("content") <= LARGEST)
    found = template_literals(small, keys).unionByName(joined_literals(small, keys)).unionByName(base64_blocks(small, keys))
    first = F.coalesce(*(F.when(F.col("text").rlike(r.java(case_mode)), F.lit(r.ord)) for r in rules))
    context = F.coalesce("context", F.lit(""))
    rows = found.withColumn("rule_ord", first).withColumn("h", T.shannon_entropy(F.col("text")))
    odd = (F.length("text") >= 20) & (F.col("h") >= threshold) & context.rlike(CONTEXT)
    rows = rows.filter(F.col("rule_ord").isNotNull() | odd)
    own = lambda f: constants([(r.ord, f(r)) for r in (*rules, ENTROPY_RULE)], F.coalesce("rule_ord", F.lit(ENTROPY_RULE.ord)))
    by_rule = F.col("rule_ord").isNotNull()
    pattern = own(lambda r: r.java(case_mode) if r.pattern else "(?!)")
    hit = F.get(occurrences(F.col("text"), pattern, own(lambda r: r.group)), F.lit(0))
    cut = F.substring("text", 1, 50)
    return rows.select(
        *keys, "line_number", own(lambda r: r.id).alias("rule_id"),
        F.when(by_rule, own(lambda r: r.name)).otherwise("High-Entropy String (multiline)").alias("rule_name"), own(lambda r: r.severity).alias("severity"),
        F.when(by_rule, "multiline-pattern").otherwise("multiline-entropy").alias("type"),
        F.when(by_rule & (F.length("text") <= 50), cut).otherwise(F.concat(cut, F.lit("..."))).alias("match"),
        F.when(by_rule, hit["secret"]).otherwise(F.col("text")).alias("secret"), F.lit(None).cast("int").alias("match_start"),
        F.lit(None).cast("int").alias("match_length"), F.when(~by_rule, F.col("h")).alias("entropy"), F.lit(True).alias("multiline"),
        F.lit(PASS_MULTILINE).alias("emit_pass"), F.when(F.col("kind") == "template", 0).when(F.col("kind") == "concat", 1).otherwise(2).alias("emit_shift"),
        F.lit(0).alias("emit_rule"), F.col("number").alias("emit_match"),
    )
