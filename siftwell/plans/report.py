"""Reports: redacted rows, JSON, SARIF, annotations, HTML and Markdown. Secrets leave only redacted or hashed."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.functions import text as T
from siftwell.functions.catalog import FRAMEWORKS
from siftwell.operators.enrich import controls, enrich
from siftwell.operators.running import Descending, running_sums
from siftwell.sources.staged import stage

ORDER = ("file", "line_number", "match_start", "rule_id")


def redacted(findings: DataFrame) -> DataFrame:
    return findings.withColumn("redacted", T.redact(F.col("secret"))).withColumn("secret_hash", T.secret_hash(F.col("secret"))).drop("secret", "match")


def json_lines(findings: DataFrame, *keep: str) -> DataFrame:
    rows = redacted(enrich(findings))
    compliance = F.struct(*FRAMEWORKS).alias("compliance")
    return rows.select("file", "line_number", *keep, F.to_json(F.struct(
        "file", F.col("line_number").alias("line"), F.col("rule_id").alias("ruleId"), F.col("rule_name").alias("ruleName"), "severity",
        F.col("redacted").alias("match"), F.col("secret_hash").alias("secretHash"), F.col("action").alias("remediation"), compliance,
    )).alias("json"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """The columns of a SARIF result."""
    return findings.select(
        F.col("rule_id").alias("ruleId"), T.sarif_level(F.col("severity")).alias("level"), F.coalesce("rule_name", "rule_id").alias("message"),
        F.col("file").alias("uri"), F.coalesce("line_number", F.lit(1)).alias("startLine"), (F.coalesce("match_start", F.lit(0)) + 1).alias("startColumn"),
    )


def sarif_json_column() -> Column:
    """A result as JSON, of the columns of sarif_results."""
    region = F.struct("startLine", "startColumn")
    place = F.struct(F.struct(F.struct(F.col("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return F.to_json(F.struct("ruleId", "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations")))


def sarif_json(findings: DataFrame) -> DataFrame:
    return sarif_results(findings).select(sarif_json_column().alias("json"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    first = Window.partitionBy("rule_id").orderBy("file", "line_number", "match_start")
    rows = findings.withColumn("n", F.row_number().over(first)).filter("n = 1")
    return rows.select(F.col("rule_id").alias("id"), F.coalesce("rule_name", "rule_id").alias("name"), "severity")


def annotations(findings: DataFrame, github: bool = True) -> DataFrame:
    form = "::error file=%s,line=%s::%s (%s)" if github else "ERROR: %s:%s %s (%s)"
    return findings.select("file", "line_number", F.format_string(form, "file", F.col("line_number").cast("string"), "rule_name", "severity").alias("line"))


def within_bytes(findings: DataFrame, limit: int = 1_024_000) -> DataFrame:
    """The most severe findings whose JSON, a line each, fits in ``limit`` bytes, with the bytes up to each."""
    rows = json_lines(findings, "severity") if "json" not in findings.columns else findings
    order = [Descending(T.severity_rank(F.col("severity"))), F.col("file"), F.col("line_number"), F.col("json")]
    return running_sums(rows, order, F.octet_length("json") + 1, "bytes").filter(F.col("bytes") <= limit)


def numbered(findings: DataFrame) -> DataFrame:
    """``findings`` with counter, ``[i/n]``, by file, line, place and rule."""
    rows = running_sums(findings, [F.col(c) for c in ORDER], name="number", total="of")
    return rows.withColumn("counter", F.format_string("[%d/%d]", "number", "of")).drop("number", "of")


def summary(findings: DataFrame, files_scanned: int = 0) -> DataFrame:
    """One row: the head of a JSON report, totals and counts by severity."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(s)
    counts = findings.agg(F.count("*").alias("total"), F.count_distinct("file").alias("files"), *map(n, T.SEVERITIES))
    return counts.select(F.to_json(F.struct(F.lit(files_scanned).alias("filesScanned"), F.col("files").alias("filesWithFindings"), F.col("total").alias("findingsCount"), F.struct(*T.SEVERITIES).alias("severityCounts"))).alias("json"))


def _lines(spark: SparkSession, section: int, lines: Sequence[str | Column]) -> DataFrame:
    """A section of constant lines."""
    rows = spark.createDataFrame([(section, i) for i in range(1, len(lines) + 1)], "section int, number long")
    said = F.get(F.array(*(F.lit(x) if isinstance(x, str) else x for x in lines)), (F.col("number") - 1).cast("int"))
    return rows.select("section", "number", said.alias("line"))


def _rows(section: int, numbered_rows: DataFrame, line: Column) -> DataFrame:
    return numbered_rows.select(F.lit(section).alias("section"), "number", line.alias("line"))


def write_document(lines: DataFrame, path: str) -> None:
    """Writes a document (section, number, line) as text files, which in the order of their names are the whole."""
    lines.repartitionByRange("section", "number").sortWithinPartitions("section", "number").select("line").write.text(path)


def sarif_document(findings: DataFrame, tool: str, version: str) -> DataFrame:
    """section, number, line: a whole SARIF file with one run: the head, the rules that were hit, the results, one a line. A comma stands before
    each row but the first, by its number, so equal rows are as good as others."""
    spark, findings = findings.sparkSession, stage(findings, "findings")  # read three times
    start = F.to_json(F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version")))
    head = F.concat(F.lit('{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":'), F.regexp_replace(start, r"\}$", ""), F.lit(',"rules":['))
    rule = F.to_json(F.struct("id", F.struct(F.col("name").alias("text")).alias("shortDescription"), F.struct(T.sarif_level(F.col("severity")).alias("level")).alias("defaultConfiguration")))
    listed = lambda c: F.concat(F.when(F.col("number") > 1, ",").otherwise(""), c)
    rules = running_sums(sarif_rules(findings), [F.col("id")], name="number")
    results = running_sums(sarif_results(findings), [F.col(c) for c in ("uri", "startLine", "startColumn", "ruleId")], name="number")
    parts = [_lines(spark, 1, [head]), _rows(2, rules, listed(rule)), _lines(spark, 3, ["]}},", '"results":[']), _rows(4, results, listed(sarif_json_column())), _lines(spark, 5, ["]}]}"])]
    return reduce(DataFrame.unionByName, parts)


def compliance(findings: DataFrame) -> DataFrame:
    """framework, controls: the sorted distinct controls of what was found, for every framework."""
    found = controls(findings).groupBy("framework").agg(F.sort_array(F.collect_set("control")).alias("controls"))  # a control is one of the catalogue's
    every = findings.sparkSession.createDataFrame([(f,) for f in FRAMEWORKS], "framework string")
    return every.join(F.broadcast(found), "framework", "left").withColumn("controls", F.coalesce("controls", F.array().cast("array<string>")))


#: What the frameworks are called, and the order of a report's findings.
FRAMEWORK_NAMES = {"owasp": "OWASP Top 10", "nist": "NIST SP 800-53", "cis": "CIS Controls", "soc2": "SOC 2 Criteria"}
ADVICE = (
    "Rotate every credential that is still live.", "Remove secrets from the history of commits.", "Keep secrets in a secrets manager.", "Scan in continuous integration, so that no new one comes in.",
)


def _report_parts(findings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts (one row), findings with number and status, controls by framework with number."""
    status = F.coalesce("status", F.lit("open")) if "status" in findings.columns else F.lit("open")
    status = F.when(status.isin("fixed", "ignored"), status).otherwise("open")
    rows = findings = stage(findings.withColumn("status", status), "findings")  # read three times
    n = lambda c, v: F.count_if(F.col(c) == v).alias(v)
    counts = rows.agg(F.count("*").alias("total"), *(n("severity", s) for s in T.SEVERITIES), *(n("status", s) for s in ("open", "fixed", "ignored")))
    order = F.create_map(*(F.lit(x) for i, f in enumerate(FRAMEWORKS, 1) for x in (f, i)))
    named = F.create_map(*(F.lit(x) for f in FRAMEWORKS for x in (f, FRAMEWORK_NAMES[f])))
    frameworks = compliance(findings).select(F.element_at(order, F.col("framework")).cast("long").alias("number"), F.element_at(named, F.col("framework")).alias("name"), "controls")
    return counts, running_sums(rows, [F.col(c) for c in ORDER], name="number"), frameworks


def _summary_lines(counts: DataFrame, section: int, line: Callable[[Column, Column], Column]) -> DataFrame:
    names = ("total", *T.SEVERITIES, "open", "fixed", "ignored")
    said = F.posexplode(F.array(*(line(F.lit(c), F.col(c).cast("string")) for c in names)))
    return counts.select(said.alias("i", "line")).select(F.lit(section).alias("section"), (F.col("i") + 1).cast("long").alias("number"), "line")


def markdown_document(findings: DataFrame, day: str) -> DataFrame:
    """section, number, line: a compliance report of findings (file, line_number, match_start, rule_id, rule_name, severity, maybe status)."""
    spark, (counts, rows, frameworks) = findings.sparkSession, _report_parts(findings)
    cell = lambda c: F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|"))
    found = F.concat(F.lit("| `"), F.coalesce(cell("file"), F.lit("unknown")), F.lit("` | "), F.coalesce(cell("line_number"), F.lit("-")), F.lit(" | "), F.coalesce(cell("rule_name"), cell("rule_id")), F.lit(" | "), cell("severity"), F.lit(" | "), cell("status"), F.lit(" |"))
    control = F.concat(F.lit("- "), F.col("name"), F.lit(": "), F.when(F.size("controls") > 0, F.array_join("controls", ", ")).otherwise("none"))
    parts = [
        _lines(spark, 1, ["# Compliance report", "", f"Date: {day}", "", "## Summary", "", "| | n |", "|-|-|"]),
        _summary_lines(counts, 2, lambda name, value: F.concat(F.lit("| "), name, F.lit(" | "), value, F.lit(" |"))),
        _lines(spark, 3, ["", "## Findings", "", "| File | Line | Rule | Severity | Status |", "|-|-|-|-|-|"]), _rows(4, rows, found),
        _lines(spark, 5, ["", "## Controls", ""]), _rows(6, frameworks, control), _lines(spark, 7, ["", "## What to do", "", *(f"{i}. {x}" for i, x in enumerate(ADVICE, 1))]),
    ]
    return reduce(DataFrame.unionByName, parts)


def html_document(findings: DataFrame, day: str) -> DataFrame:
    """The same report as a page."""
    spark, (counts, rows, frameworks) = findings.sparkSession, _report_parts(findings)
    cells = F.concat_ws("</td><td>", *(F.coalesce(T.escape_html(c.cast("string")), F.lit("-")) for c in (F.col("file"), F.col("line_number"), F.coalesce("rule_name", "rule_id"), F.col("severity"), F.col("status"))))
    control = F.concat(F.lit("<dt>"), F.col("name"), F.lit("</dt><dd>"), F.when(F.size("controls") > 0, T.escape_html(F.array_join("controls", ", "))).otherwise("none"), F.lit("</dd>"))
    parts = [
        _lines(spark, 1, ["<!DOCTYPE html>", '<html lang="en"><head><meta charset="UTF-8"/><title>Compliance report</title></head><body>', f"<h1>Compliance report</h1><p>{day}</p>", "<h2>Summary</h2><table>"]),
        _summary_lines(counts, 2, lambda name, value: F.concat(F.lit("<tr><td>"), name, F.lit("</td><td>"), value, F.lit("</td></tr>"))),
        _lines(spark, 3, ["</table><h2>Findings</h2><table>", "<tr><th>File</th><th>Line</th><th>Rule</th><th>Severity</th><th>Status</th></tr>"]),
        _rows(4, rows, F.concat(F.lit("<tr><td>"), cells, F.lit("</td></tr>"))), _lines(spark, 5, ["</table><h2>Controls</h2><dl>"]), _rows(6, frameworks, control),
        _lines(spark, 7, ["</dl><h2>What to do</h2><ol>", *(f"<li>{x}</li>" for x in ADVICE), "</ol></body></html>"]),
    ]
    return reduce(DataFrame.unionByName, parts)


def html_rows(findings: DataFrame) -> DataFrame:
    cells = [T.escape_html(F.col(c).cast("string")) for c in ("severity", "rule_name", "file", "line_number")]
    return findings.select("file", "line_number", F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *cells), F.lit("</td></tr>")).alias("html"))


def context_lines(lines: DataFrame, findings: DataFrame, n: int = 2) -> DataFrame:
    """The lines around each finding: an equi-join on file and each wanted number."""
    wanted = findings.select("file", F.col("line_number").alias("finding_line"), F.explode(F.sequence(F.col("line_number") - n, F.col("line_number") + n)).alias("line_number"))
    return wanted.distinct().join(lines, ["file", "line_number"]).select("file", "finding_line", "line_number", "line")


def purge_lines(secrets: DataFrame, mark: str = "REDACTED") -> DataFrame:
    """Replacement rules for history rewriting. These hold secrets in the clear."""
    return secrets.select(F.concat(F.lit("literal:"), F.col("secret"), F.lit(f"==>literal:{mark}")).alias("line"))


def incidents(findings: DataFrame, day: str, earlier: DataFrame | None = None) -> DataFrame:
    """Numbered incident records for findings, numbered on from the day's greatest number in ``earlier`` (incident_id)."""
    last = 0
    if earlier is not None:
        own = F.regexp_extract("incident_id", rf"^inc-{day}-(\d+)$", 1).try_cast("long")
        last = earlier.agg(F.coalesce(F.max(own), F.lit(0))).first()[0]
    rows = running_sums(redacted(enrich(findings)), [F.col(c) for c in ORDER], name="number")
    number = F.format_string(f"inc-{day}-%03d", F.col("number") + last)
    return rows.select(number.alias("incident_id"), "rule_id", "severity", "file", "line_number", "incident_provider", "secret_hash", "action", *FRAMEWORKS)
