"""The scan as one lazy plan: files to findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators import detect, multiline, policy
from siftwell.operators.indexed import indexed_findings
from siftwell.operators.lines import split_lines, windows
from siftwell.sources.config import ScanConfig


def candidates(files: DataFrame, config: ScanConfig = ScanConfig(), keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Every finding before dedup and policy. files: key columns (file among them) and content. Stateless per row, so it
    works on streams."""
    kept = files.filter(~config.ignore.ignores_file(F.col("file")))
    parts = windows(split_lines(kept, keys)).filter(~F.col("line").rlike(config.inline_ignore))
    threshold = T.entropy_threshold(F.col("file"), config.entropy_threshold)
    found = detect.pattern_findings(parts, case_mode=config.case_mode)
    if config.rules:
        found = found.unionByName(detect.pattern_findings(parts, config.rules, config.case_mode, detect.PASS_CUSTOM))
    if config.packs:
        found = found.unionByName(indexed_findings(parts, config.packs, config.case_mode))
    found = found.unionByName(detect.entropy_findings(parts, threshold))
    if config.multiline:
        found = found.unionByName(multiline.findings(kept.select(*keys, "content"), threshold, keys, case_mode=config.case_mode))
    return found


def scan(files: DataFrame, config: ScanConfig = ScanConfig(), keys: tuple[str, ...] = ("file",)) -> DataFrame:
    found = policy.apply(detect.dedup(candidates(files, config, keys), keys), config)
    return found.select(*keys, *detect.FOUND)


def scan_history(added: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Findings in added lines (commit_hash, file, line_number, content), by the rules and the lowest threshold; no dedup and no policy."""
    lines = added.select("commit_hash", "file", "line_number", F.col("content").alias("line"), F.lit(0).alias("shift"))
    lines = lines.filter(~F.col("line").rlike(config.inline_ignore))
    found = detect.pattern_findings(lines).unionByName(detect.entropy_findings(lines, F.lit(T.THRESHOLD_DIRECT)))
    return found.select("commit_hash", "file", *detect.FOUND)


def with_commits(found: DataFrame, commits: DataFrame, now: Column) -> DataFrame:
    """Findings of scan_history with their commit: its short hash, author, subject and date, and for how many days it has been there."""
    rows = commits.select("commit_hash", "author", "subject", F.to_timestamp("committed_at").alias("commit_date"))
    return found.join(rows, "commit_hash").withColumns({"commit": F.substring("commit_hash", 1, 7), "days_in_history": T.days_ago(F.col("commit_date"), now)})
