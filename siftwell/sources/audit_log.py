"""The audit log: JSON lines, each chained to the one before by hash. The driver appends one line a scan; reading is Spark's."""

from __future__ import annotations

import hashlib
import json
import os
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """timestamp string, version string, commitHash string, filesScanned array<string>,
    findings array<struct<ruleId:string,ruleName:string,severity:string,file:string,lineNumber:int,match:string>>,
    findingCount long, severityCounts struct<critical:long,high:long,medium:long,low:long>, userDecision string,
    verification string, exposure string, action string, actionDetails string, previousHash string, hash string"""
# What an entry's hash is taken over, in this order, now and in earlier versions; when a log rotates.
HASHED = (
    "timestamp", "version", "commitHash", "filesScanned", "findings", "findingCount", "severityCounts", "userDecision",
    "verification", "exposure", "action", "actionDetails", "previousHash",
)
HASHED_BEFORE = ("timestamp", "commitHash", "filesScanned", "findings", "findingCount", "severityCounts", "userDecision", "previousHash")
ROTATE_BYTES, GENERATIONS = 5 << 20, 2


def read(spark: SparkSession, path: str) -> DataFrame:
    """Malformed lines are left out."""
    return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """position, value: the lines as they stand, for the chain check. A log rotates long before it is split among tasks."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("position"), "value")


def _json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def chained(entry: dict, previous_hash: str | None) -> str:
    """An entry's line: defaults filled in, matches masked, the hash over it at its end."""
    mask = lambda m: f"{m[:4]}****" if m and len(m) > 8 else "***"
    findings = [{**f, "match": mask(f.get("match"))} for f in entry.get("findings") or []]
    given = {
        "timestamp": entry.get("timestamp") or datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z"), "commitHash": entry.get("commitHash") or "unknown",
        "filesScanned": entry.get("filesScanned") or [], "findings": findings, "findingCount": len(findings), "severityCounts": entry.get("severityCounts") or {},
        "action": entry.get("action") or "none", "previousHash": previous_hash,
    }
    whole = {name: given[name] if name in given else entry.get(name) for name in HASHED}
    return _json({**whole, "hash": hashlib.sha256(_json(whole).encode()).hexdigest()})


def append(path: str, entry: dict, limit: int = ROTATE_BYTES) -> str:
    """Appends to a log of the driver's own and returns the line. A log of ``limit`` bytes becomes ``path.1`` first, that one ``path.2``."""
    if os.path.exists(path) and os.path.getsize(path) >= limit:
        for generation in range(GENERATIONS, 0, -1):
            older = path if generation == 1 else f"{path}.{generation - 1}"
            if os.path.exists(older):
                os.replace(older, f"{path}.{generation}")
    last = None
    if os.path.exists(path):
        with open(path, encoding="utf-8") as log:
            lines = [x for x in log.read().strip().split("\n") if x]
        try:
            last = json.loads(lines[-1]).get("hash") if lines else None
        except ValueError:
            last = None
    line = chained(entry, last)
    with open(path, "a", encoding="utf-8", opener=lambda p, flags: os.open(p, flags, 0o600)) as log:
        log.write(line + "\n")
    return line
