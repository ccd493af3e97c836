"""Queries over the audit log (see sources.audit_log)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.catalog import SEVERITY_RANK
from siftwell.functions.text import csv_cell
from siftwell.operators.running import running_sums
from siftwell.sources.audit_log import HASHED, HASHED_BEFORE
from siftwell.sources.staged import stage

# What a check says.
WRONG_HASH, BROKEN_LINK, FIRST_LINK, LOST_SEGMENT = "Hash mismatch", "Chain linkage broken", "First entry should have no previous hash", "Segment lost"


def query(log: DataFrame, since: Column | None = None, until: Column | None = None, decision: str | None = None, min_findings: int | None = None, severity: str | None = None) -> DataFrame:
    at = F.to_timestamp("timestamp")
    for test in (
        at >= since if since is not None else None, at <= until if until is not None else None,
        F.col("userDecision") == decision if decision else None, F.col("findingCount") >= min_findings if min_findings is not None else None,
        F.col(f"severityCounts.{severity}") > 0 if severity else None,
    ):
        log = log if test is None else log.filter(test)
    return log


def stats(log: DataFrame) -> DataFrame:
    total = lambda s: F.coalesce(F.sum(f"severityCounts.{s}"), F.lit(0)).alias(s)
    bypassed = F.count_if(F.col("userDecision") == "bypassed")
    return log.agg(
        F.count("*").alias("scans"), F.coalesce(F.sum("findingCount"), F.lit(0)).alias("findings"), *(total(s) for s in SEVERITY_RANK),
        bypassed.alias("bypassed"), F.format_string("%.2f", F.when(F.count("*") == 0, 0.0).otherwise(100.0 * bypassed / F.count("*"))).alias("bypass_percent"),
    )


def last_scan(log: DataFrame) -> DataFrame:
    """One row: when the last scan was, what it found and what was decided."""
    last = lambda c: F.max_by(c, "timestamp").alias(c)
    return log.agg(F.max("timestamp").alias("timestamp"), last("findingCount"), last("userDecision"))


def decisions(log: DataFrame) -> DataFrame:
    return log.groupBy(F.coalesce("userDecision", F.lit("none")).alias("decision")).agg(F.count("*").alias("n"))


def verify_chain(lines: DataFrame) -> DataFrame:
    """lines: position (anything that orders them), value (JSON), and maybe segment. Gives these without value, entry (from 0, malformed lines not counted), hash_ok, link_ok, errors.

    An entry's hash is over its other fields, as the writer orders them or as earlier versions did; each entry names the hash before it, the
    first none. Hashes are checked where the lines are; the entries are then numbered by ranges of positions, and each is joined with the one before it, so a log of any
    length needs no single task. Segments are numbered from 1; one that is missing is an error of the entry after it."""
    of = lambda name: F.get_json_object("value", f"$.{name}")
    quoted = lambda c: F.expr("substring(to_json(array({0})), 2, length(to_json(array({0}))) - 2)".format(c))

    def field(name: str) -> Column:
        raw = of(name)
        if name in ("filesScanned", "findings", "findingCount", "severityCounts"):
            said = raw
        else:
            text = quoted(f"get_json_object(value, '$.{name}')")
            said = F.when(raw.rlike(r"^[\[{]"), raw).otherwise(text) if name in ("verification", "exposure") else text
        return F.when(F.array_contains(F.json_object_keys("value"), name), F.concat(F.lit(f'"{name}":'), F.when(raw.isNull(), "null").otherwise(said)))

    written = lambda names: F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*map(field, names))), ","), F.lit("}"))
    as_it_stands = F.regexp_replace("value", r',"hash":"[^"]*"\}\s*\z', "}")
    keys = [c for c in ("segment", "position") if c in lines.columns]
    rows = lines.filter(F.json_object_keys("value").isNotNull())
    own = [F.sha2(c, 256) for c in (as_it_stands, written(HASHED), written(HASHED_BEFORE))]
    rows = rows.select(*keys, of("hash").alias("hash"), of("previousHash").alias("previous"), F.array(*own).alias("own"))
    rows = rows.select(*keys, "hash", "previous", F.coalesce(F.array_contains("own", F.col("hash")), F.lit(False)).alias("hash_ok"))
    rows = stage(running_sums(rows, [F.col("position")], name="number"), "chain")
    before = rows.select((F.col("number") + 1).alias("number"), F.col("hash").alias("hash_before"), *([F.col("segment").alias("segment_before")] if "segment" in keys else []))
    rows = rows.join(before, "number", "left").withColumns({"entry": F.col("number") - 1, "link_ok": F.col("previous").eqNullSafe(F.col("hash_before"))})
    link = F.when(F.col("number") == 1, FIRST_LINK).otherwise(BROKEN_LINK)
    errors = [F.when(~F.col("hash_ok"), WRONG_HASH), F.when(~F.col("link_ok"), link)]
    if "segment" in keys:
        errors.append(F.when(F.col("segment") > F.coalesce("segment_before", F.lit(0)) + 1, LOST_SEGMENT))
    return rows.withColumn("errors", F.array_compact(F.array(*errors))).select(*keys, "entry", "hash_ok", "link_ok", "errors")


def flat_findings(log: DataFrame) -> DataFrame:
    """One row per finding, with its own file (the entry's first if it has none)."""
    rows = log.select("timestamp", F.coalesce("action", F.lit("none")).alias("status"), "filesScanned", F.explode("findings").alias("f"))
    return rows.select("timestamp", "status", F.coalesce("f.file", F.get("filesScanned", F.lit(0))).alias("file"), F.col("f.ruleId").alias("rule_id"), F.col("f.severity").alias("severity"))


def status_counts(flat: DataFrame) -> DataFrame:
    fixed, ignored = F.count_if(F.col("status") == "fixed"), F.count_if(F.col("status") == "ignored")
    return flat.agg(F.count("*").alias("total"), fixed.alias("fixed"), ignored.alias("ignored"), (F.count("*") - fixed - ignored).alias("open"))


def csv_lines(log: DataFrame) -> DataFrame:
    cells = [csv_cell(F.coalesce(c, F.lit(""))) for c in (F.col("timestamp"), F.col("commitHash") if "commitHash" in log.columns else F.lit(None), F.array_join("filesScanned", ";"))]
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("string") for c in ("findingCount", *(f"severityCounts.{s}" for s in SEVERITY_RANK))]
    return log.select("timestamp", F.concat_ws(",", *cells, *numbers, csv_cell(F.coalesce("userDecision", F.lit("none")))).alias("line"))
