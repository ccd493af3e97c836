"""Counts over findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.functions.catalog import SEVERITY_RANK
from siftwell.operators.enrich import controls


def severity_counts(findings: DataFrame, *by: str) -> DataFrame:
    return findings.groupBy(*by).agg(
        *(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_RANK), F.count("*").alias("total"), F.count_distinct("file").alias("files")
    )


def rule_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_id", "severity").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))


def control_counts(findings: DataFrame) -> DataFrame:
    return controls(findings).groupBy("framework", "control").agg(F.count("*").alias("n"))


def verification_counts(verified: DataFrame) -> DataFrame:
    other = ~F.col("verification").isin("live", "inactive")
    return verified.agg(F.count_if(F.col("verification") == "live").alias("live"), F.count_if(F.col("verification") == "inactive").alias("inactive"), F.count_if(other).alias("unknown"))


def purge_list(findings: DataFrame) -> DataFrame:
    """Distinct secrets with the files that hold them; cut values don't count. These are secrets in the clear."""
    return findings.filter(~F.col("secret").endswith("...")).groupBy("secret").agg(F.count_distinct("file").alias("files"), F.count("*").alias("n"))


def scan_summary(status: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: files, skipped, binary and ignored ones, and findings by severity."""
    files = status.agg(
        F.count("*").alias("files_seen"), F.count_if("skipped").alias("files_skipped"), F.count_if("is_binary").alias("files_binary"), F.count_if("is_ignored").alias("files_ignored")
    )
    return files.crossJoin(F.broadcast(severity_counts(findings)))  # one row each


def pack_averages(rules: DataFrame) -> DataFrame:
    """One row on a pack's rules (severity, category, confidence, detection_rate, false_positive_rate): numbers and averages to three digits."""
    mean = lambda c: F.format_string("%.3f", F.avg(c)).alias(f"avg_{c}")
    return rules.agg(F.count("*").alias("rules"), F.count_distinct("category").alias("categories"), F.count_distinct("severity").alias("severities"), *map(mean, ("confidence", "detection_rate", "false_positive_rate")))


def pack_top(rules: DataFrame, n: int = 10) -> DataFrame:
    """The surest rules and those with the fewest false positives: list, place, id. Of equals the first of the pack (position)."""
    best = rules.orderBy(F.col("confidence").desc(), "position").limit(n), rules.orderBy("false_positive_rate", "position").limit(n)
    order = Window.orderBy(F.col("confidence").desc(), "position"), Window.orderBy("false_positive_rate", "position")  # of n rows
    rows = [b.select(F.lit(name).alias("list"), F.row_number().over(o).cast("long").alias("place"), "id") for name, b, o in zip(("confidence", "false_positive_rate"), best, order, strict=True)]
    return rows[0].unionByName(rows[1])
