"""The scan over streams: it is stateless per row, so the same plan runs on readStream; the best finding of a span is state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwell.functions import text as T
from siftwell.operators import detect, policy
from siftwell.plans.scan import candidates
from siftwell.sources.config import ScanConfig


def scan_stream(files: DataFrame, config: ScanConfig = ScanConfig(), keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Findings before dedup, secrets across a file's lines among them."""
    return candidates(files, config, keys)


def best_findings(files: DataFrame, config: ScanConfig = ScanConfig(), keys: tuple[str, ...] = ("file",), at: str | None = None, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Of findings on one span the most severe, of equals the first emitted, as ``plans.scan.scan`` has them; to be written in update mode, where a better finding of
    a file that comes again follows the one it replaces.

    ``at``: a timestamp of ``files``; findings compete within ``window`` of it only, and a window's state is dropped ``late`` after its end. Without it
    the state holds every span that was ever found."""
    if at:
        files = files.withWatermark(at, late)
    found = candidates(files, config, (*keys, at) if at else keys)
    rank = F.struct(T.severity_rank(F.col("severity")), *(-F.col(c) for c in detect.ORDER))
    values = [c for c in detect.FOUND if c not in ("line_number", "match_start", "match_length")]
    by = [*keys, "line_number", "match_start", "match_length", *([F.window(at, window).alias("window")] if at else [])]
    best = found.groupBy(*by).agg(F.max_by(F.struct(*values), rank).alias("best"))
    kept = policy.apply(best.select(*keys, *(["window"] if at else []), "line_number", "match_start", "match_length", "best.*"), config)
    return kept.select(*keys, *([F.col("window.start").alias("window_start")] if at else []), *detect.FOUND)


def write_latest(findings: DataFrame, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Writes each batch's changes as a folder of its own; a batch that runs again after a failure replaces its folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return findings.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()


def read_latest(spark: SparkSession, path: str, schema: str, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """What ``write_latest`` has written: of each span the row of the last batch."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(path)
    own = [c for c in (*keys, "window_start", "line_number", "match_start", "match_length") if c in rows.columns]
    others = [c for c in rows.columns if c not in (*own, "batch")]
    return rows.groupBy(*own).agg(F.max_by(F.struct(*others), "batch").alias("last")).select(*own, "last.*")


def windowed_counts(findings: DataFrame, at: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    grouped = findings.withWatermark(at, late).groupBy(F.window(at, window), "rule_id", "severity")
    return grouped.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "rule_id", "severity", "n")
