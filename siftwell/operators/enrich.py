"""Lookups by rule: constants of 80 rows each, so they are broadcast whatever the findings' size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.functions.catalog import DEFAULT_ACTION, ENRICHMENT, FRAMEWORKS, RULES


def rules(spark: SparkSession) -> DataFrame:
    rows = [(r.ord, r.id, r.name, r.pattern or None, r.flags, r.group, r.severity, r.severity_rank, r.provider, r.category) for r in RULES]
    return spark.createDataFrame(
        rows, "rule_ord int, rule_id string, rule_name string, pattern string, declared_flags string, secret_group int, severity string, severity_rank int, provider string, category string"
    )


def dimension(spark: SparkSession) -> DataFrame:
    rows = [(e.rule_id, e.action, *map(list, (e.owasp, e.nist, e.cis, e.soc2)), e.env_var, e.provider) for e in ENRICHMENT]
    arrays = ", ".join(f"{f} array<string>" for f in FRAMEWORKS)
    return spark.createDataFrame(rows, f"rule_id string, action string, {arrays}, env_var string, incident_provider string")


def without_builtins(pack: DataFrame) -> DataFrame:
    """A pack's rules (id, pattern) but for those with the id, or in any case the pattern, of one of the catalogue's."""
    own = rules(pack.sparkSession)
    ids, patterns = own.select(F.col("rule_id").alias("id")), own.filter("pattern is not null").select(F.lower("pattern").alias("_lower")).distinct()
    kept = pack.join(F.broadcast(ids), "id", "left_anti").withColumn("_lower", F.lower("pattern"))
    return kept.join(F.broadcast(patterns), "_lower", "left_anti").drop("_lower")


def enrich(findings: DataFrame) -> DataFrame:
    """With action (``review`` if unknown), compliance arrays (empty if unknown), env_var, incident_provider."""
    joined = findings.join(F.broadcast(dimension(findings.sparkSession)), "rule_id", "left")
    empty = F.array().cast("array<string>")
    return joined.withColumns({"action": F.coalesce("action", F.lit(DEFAULT_ACTION)), **{f: F.coalesce(f, empty) for f in FRAMEWORKS}})


def controls(findings: DataFrame) -> DataFrame:
    """One row per finding, framework and control."""

    def named(framework: str) -> Column:
        return F.transform(framework, lambda c: F.struct(F.lit(framework).alias("framework"), c.alias("control")))

    parts = F.concat(*map(named, FRAMEWORKS))
    return enrich(findings).withColumn("c", F.explode(parts)).select(*findings.columns, "c.framework", "c.control")


def apply_verification(findings: DataFrame, results: DataFrame, now: Column, ttl: str = "1 hour") -> DataFrame:
    """``findings`` with the latest result of a liveness check (rule_id, secret_sha256, status, checked_at) at or before ``now`` - a constant, or a column of the
    findings - that is younger than ``ttl``; no network call is made here. A live credential is critical; an inactive one low, and marked.

    A result holds until the next one of its key or its end of life; these spans don't overlap, so a finding meets one at most. They are
    joined by key and stretch of time (a span lies in two), so no key's whole history meets all its findings."""
    life = F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"interval {ttl}"))
    at = F.unix_micros("checked_at")
    once = results.filter("checked_at is not null").groupBy("rule_id", "secret_sha256", at.alias("_from")).agg(F.max("status").alias("_status"))
    of_key = Window.partitionBy("rule_id", "secret_sha256").orderBy("_from")
    spans = once.withColumn("_until", F.least(F.coalesce(F.lead("_from").over(of_key), F.col("_from") + life), F.col("_from") + life))
    stretch = lambda t: F.floor(t / life)
    spans = spans.withColumn("_stretch", F.explode(F.sequence(stretch(F.col("_from")), stretch(F.col("_until") - 1))))
    keyed = findings.withColumns({"secret_sha256": F.sha2("secret", 256), "_now": F.unix_micros(now)}).withColumn("_stretch", stretch(F.col("_now")))
    f, r = keyed.alias("f"), spans.alias("r")
    same = [F.col(f"f.{c}") == F.col(f"r.{c}") for c in ("rule_id", "secret_sha256", "_stretch")]
    met = f.join(r, [*same, F.col("f._now") >= F.col("r._from"), F.col("f._now") < F.col("r._until")], "left")
    status = F.col("verification")
    return met.select("f.*", F.col("r._status").alias("verification")).drop("_now", "_stretch").withColumns({
        "auto_downgraded": status.eqNullSafe("inactive"),
        "severity": F.when(status == "live", "critical").when(status == "inactive", "low").otherwise(F.col("severity")),
        "verification": F.coalesce(status, F.lit("skipped")),
    })
