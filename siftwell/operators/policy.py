"""What becomes of findings: rule ignores, severity overrides, and the level that fails a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import severity_rank
from siftwell.sources.config import ScanConfig


def apply(findings: DataFrame, config: ScanConfig) -> DataFrame:
    kept = findings.filter(~config.ignore.ignores_finding(F.col("rule_id"), F.col("file")))
    if config.severity:
        wanted = F.element_at(F.create_map(*[F.lit(x) for pair in config.severity.items() for x in pair]), F.col("rule_id"))
        kept = kept.withColumn("wanted", wanted).filter(~F.col("wanted").eqNullSafe("ignore"))
        kept = kept.withColumn("severity", F.coalesce("wanted", "severity")).drop("wanted")
    return kept


def fail_on(findings: DataFrame, level: str) -> DataFrame:
    """Findings at or above the level."""
    return findings.filter(severity_rank(F.col("severity")) >= severity_rank(F.lit(level)))


def only_in(findings: DataFrame, changes: DataFrame) -> DataFrame:
    """The findings in changed files; ``changes``: file, change_type (D: deleted)."""
    return findings.join(changes.filter("change_type <> 'D'").select("file"), "file", "left_semi")
