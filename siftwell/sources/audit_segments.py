"""An audit log in segments: each append is a folder that Spark's writer commits as a whole, so a lost executor or a failed job leaves no half of it.

A segment holds the entries of one run, each chained to the one before by hash and the first to the last of the segment before. Chaining is one pass by nature and is
done by one task, over the entries of that append only; checking (``operators.audit.verify_chain``) is parallel. Two appends at once write the same segment; the later fails.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.catalog import SEVERITY_RANK
from siftwell.functions.text import redact_for_audit
from siftwell.sources.audit_log import HASHED


def entries(findings: DataFrame, *by: str, timestamp: Column, action: Column | None = None, decision: Column | None = None) -> DataFrame:
    """One entry for each value of ``by``: the findings of a scan with their secrets masked, their files and counts. ``timestamp``, ``action``, ``decision``: of the columns ``by``."""
    one = F.struct(F.col("rule_id").alias("ruleId"), F.col("rule_name").alias("ruleName"), "severity", "file", F.col("line_number").cast("int").alias("lineNumber"), redact_for_audit(F.col("match")).alias("match"))
    at = F.struct("file", "line_number", "match_start", "rule_id", one.alias("finding"))
    grouped = findings.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(at)), lambda x: x["finding"]).alias("findings"), F.array_sort(F.collect_set("file")).alias("filesScanned"), F.count("*").alias("findingCount"),
        F.struct(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_RANK)).alias("severityCounts"),
    )
    none = F.lit(None).cast("string")
    given = {"timestamp": timestamp, "version": F.lit("1"), "commitHash": F.lit("unknown"), "userDecision": none if decision is None else decision, "action": F.lit("none") if action is None else action}
    return grouped.select(*(given.get(c, F.col(c) if c in grouped.columns else none).alias(c) for c in HASHED if c != "previousHash"))


def _segments(spark: SparkSession, log: str) -> list[int]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n.removeprefix("segment=")) for n in names if n.startswith("segment="))


def read(spark: SparkSession, log: str) -> DataFrame:
    """segment, position, value: the lines as they stand; positions order them, over all segments."""
    rows = spark.read.schema("value string, segment int").text(log)
    place = F.struct(F.col("segment").alias("segment"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return rows.select("segment", place.alias("position"), "value")


def last_hash(spark: SparkSession, log: str, segment: int) -> str | None:
    rows = read(spark, log).filter(F.col("segment") == segment)
    return rows.agg(F.max_by(F.get_json_object("value", "$.hash"), "position")).first()[0]


def append(spark: SparkSession, log: str, rows: DataFrame) -> int | None:
    """Appends entries (the columns of ``HASHED`` but for previousHash) by timestamp as one segment, and says which; none for no entries."""
    there = _segments(spark, log)
    number, before = (there[-1] + 1, last_hash(spark, log, there[-1])) if there else (1, None)
    text = F.to_json(F.struct(*(c for c in HASHED if c != "previousHash")), {"ignoreNullFields": "false"})
    ordered = rows.select("timestamp", text.alias("value")).repartition(1).sortWithinPartitions("timestamp", "value").select("value")
    if ordered.isEmpty():
        return None

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = before
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                whole = text[:-1] + ',"previousHash":' + (f'"{last}"' if last else "null") + "}"
                last = hashlib.sha256(whole.encode()).hexdigest()
                out.append(f'{whole[:-1]},"hash":"{last}"}}')
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    ordered.mapInArrow(chain, "value string").write.text(f"{log.rstrip('/')}/segment={number:08d}")
    return number
