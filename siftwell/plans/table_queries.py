"""Queries over tables that Spark derives from the given ones (see ``derived``): reports, audit, policy, enrichment, history and rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.functions import text as T
from siftwell.functions.catalog import ENRICHMENT, FRAMEWORKS, PATTERN_RULES, RULES
from siftwell.operators import aggregate, audit, detect, enrich, exposure, multiline, policy, rewrite
from siftwell.operators.lines import split_lines, windows
from siftwell.operators.running import running_sums
from siftwell.plans import derived, report
from siftwell.plans.derived import ADDED_SQL, AUDIT, COMMIT_SQL, PACK, PATHS_SQL, PLANTED, SAMPLES, SOURCES, START, VERSIONS, planted_findings, planted_sql, with_fixture, with_fixture_sql
from siftwell.plans.fixtures import literal
from siftwell.plans.queries import BASE_SQL, CONCAT_SQL, EXT_SQL, IGNORED_SQL, IGNORES, ORACLES, QUERIES, documents, hits_sql, query, read
from siftwell.plans.scan import scan_history, with_commits
from siftwell.sources import audit_segments, folder, history
from siftwell.sources import files as file_source
from siftwell.sources.config import IgnoreSpec, ScanConfig
from siftwell.sources.staged import new_path, stage

__all__ = ["ORACLES", "QUERIES"]


def long(name: str):  # noqa: ANN201
    return F.col(name).cast("long").alias(name)


RANK = "case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 else 1 end"
CONTROLS = ", ".join(f"({literal(e.rule_id)}, {literal(f)}, {literal(c)})" for e in ENRICHMENT for f in FRAMEWORKS for c in getattr(e, f))
CONTROLS_SQL = f"(values {CONTROLS}) as c(rule_id, framework, control)"
NAMES_SQL = f"(values {', '.join(f'({literal(r.id)}, {literal(r.name)})' for r in RULES)}) as n(rule_id, name)"
ACTIONS_SQL = f"(values {', '.join(f'({literal(e.rule_id)}, {literal(e.action)})' for e in ENRICHMENT)}) as c(rule_id, action)"
CATALOGUE = f"(values {', '.join(f'({literal(r.id)}, {literal(r.severity)}, {literal(r.category)})' for r in RULES)}) as r(rule_id, severity, category)"
REPORT_ORDER = "file, line_number, match_start, rule_id"

# findings of the planted files


@query(planted_sql("select doc_id, line_number::bigint as line_number, rule_id, match, secret, match_start from h"))
def rule_fixture_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match of every rule, before dedup."""
    found = detect.pattern_findings(windows(split_lines(derived.planted(spark, sf_dir), ("doc_id",))))
    return found.select("doc_id", long("line_number"), "rule_id", "match", "secret", long("match_start"))


@query(planted_sql("select doc_id, line_number::bigint as line_number, rule_id, match_start, match_length::bigint as match_length from d"))
def dedup_rule_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted_findings(spark, sf_dir).select("doc_id", long("line_number"), "rule_id", long("match_start"), long("match_length"))


@query(planted_sql(f"select severity, category, count(distinct r.rule_id)::bigint as rules, count(d.rule_id)::bigint as findings from {CATALOGUE} left join (select rule_id from d) d on d.rule_id = r.rule_id group by 1, 2"))
def catalogue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = planted_findings(spark, sf_dir).groupBy("rule_id").agg(F.count("*").alias("n"))
    rules = enrich.rules(spark).join(found, "rule_id", "left")
    return rules.groupBy("severity", "category").agg(F.count("*").alias("rules"), F.coalesce(F.sum("n"), F.lit(0)).alias("findings"))


@query(planted_sql(f"select framework, control, count(*)::bigint as n from d join {CONTROLS_SQL} using (rule_id) group by 1, 2"))
def compliance_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.control_counts(planted_findings(spark, sf_dir))


@query(planted_sql(f"""select f.framework, coalesce(string_agg(distinct control, ', ' order by control), '') as controls
    from (values ('owasp'), ('nist'), ('cis'), ('soc2')) f(framework) left join (select framework, control from d join {CONTROLS_SQL} using (rule_id)) x on x.framework = f.framework group by 1"""))
def framework_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted distinct controls of each framework."""
    return report.compliance(planted_findings(spark, sf_dir)).select("framework", F.array_join("controls", ", ").alias("controls"))


@query(planted_sql(f"select action, count(*)::bigint as n from d join {ACTIONS_SQL} using (rule_id) group by 1"))
def remediation_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.enrich(planted_findings(spark, sf_dir)).groupBy("action").agg(F.count("*").alias("n"))


@query(planted_sql("select rule_id, severity, count(*)::bigint as n from d where severity in ('critical', 'high') group by 1, 2"))
def fail_on_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.fail_on(planted_findings(spark, sf_dir), "high").groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


@query(planted_sql("""select file as uri, rule_id as ruleid, case when severity in ('critical', 'high') then 'error' when severity = 'low' then 'note' else 'warning' end as level,
    line_number::bigint as startline, match_start + 1 as startcolumn from d"""))
def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sarif_results(planted_findings(spark, sf_dir)).select("uri", F.col("ruleId").alias("ruleid"), "level", F.col("startLine").cast("long").alias("startline"), F.col("startColumn").cast("long").alias("startcolumn"))


@query(planted_sql(f"select file, line_number::bigint as line_number, match_start, rule_id from d order by {RANK} desc, {REPORT_ORDER} limit 25"))
def top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 that a review comment shows."""
    order = [T.severity_rank(F.col("severity")).desc(), *report.ORDER]
    return planted_findings(spark, sf_dir).orderBy(*order).limit(25).select("file", long("line_number"), long("match_start"), "rule_id")


@query(planted_sql("select distinct d.file, d.line_number::bigint as finding_line, l.line_number::bigint as line_number, l.line from d join l on l.file = d.file and l.line_number between d.line_number - 2 and d.line_number + 2"))
def context_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = split_lines(derived.planted(spark, sf_dir))
    return report.context_lines(lines, planted_findings(spark, sf_dir)).select("file", long("finding_line"), long("line_number"), "line")


@query(planted_sql(f"select distinct rule_id as id, name, d.severity from d join {NAMES_SQL} using (rule_id)"))
def sarif_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sarif_rules(planted_findings(spark, sf_dir))


@query(planted_sql(f"""select 'inc-20240101-' || lpad(((select coalesce(max(doc_id % 50), 0) from documents where doc_id % 100 = 3) + row_number() over (order by {REPORT_ORDER}))::varchar,
        greatest(3, length(((select coalesce(max(doc_id % 50), 0) from documents where doc_id % 100 = 3) + row_number() over (order by {REPORT_ORDER}))::varchar)::int), '0') as incident_id,
        rule_id, file, line_number::bigint as line_number, sha256(secret)[1:12] as secret_hash, action
    from (select distinct on (file, rule_id) * from d order by file, rule_id, line_number, match_start) join {ACTIONS_SQL} using (rule_id)"""))
def incident_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An incident for each rule of a file, numbered on from the day's last."""
    first = planted_findings(spark, sf_dir).groupBy("file", "rule_id").agg(F.min_by(F.struct("severity", "line_number", "match_start", "match", "secret"), F.struct("line_number", "match_start")).alias("f"))
    day = lambda n: F.concat(F.lit("inc-20240101-"), F.lpad((n % 50).cast("string"), 3, "0"))
    earlier = read(spark, sf_dir, "documents", "doc_id").filter("doc_id % 100 in (3, 4)").select(F.when(F.col("doc_id") % 100 == 3, day(F.col("doc_id"))).otherwise("inc-20231231-999").alias("incident_id"))
    made = report.incidents(first.select("file", "rule_id", "f.*"), "20240101", earlier)
    return made.select("incident_id", "rule_id", "file", long("line_number"), "secret_hash", "action")


@query(planted_sql(f"select file, line_number::bigint as line_number, rule_id, '[' || row_number() over (order by {REPORT_ORDER}) || '/' || count(*) over () || ']' as counter from d"))
def finding_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.numbered(planted_findings(spark, sf_dir)).select("file", long("line_number"), "rule_id", "counter")


@query(planted_sql(f"""select file, rule_id, line_number::bigint as line_number, bytes::bigint as bytes from s where bytes <= 20000""", f"""j as (select file, rule_id, line_number, severity, repeat(rule_id, 10) as json from d), s as (
        select *, sum(strlen(json) + 1) over (order by {RANK} desc, file, line_number, json rows unbounded preceding) as bytes from j)"""))
def report_within_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planted_findings(spark, sf_dir).withColumn("json", F.repeat("rule_id", F.lit(10)))
    return report.within_bytes(rows, 20_000).select("file", "rule_id", long("line_number"), "bytes")


@query("""select doc_id, sum(n) over (order by source, doc_id desc rows unbounded preceding)::bigint as running, sum(n) over ()::bigint as total
    from (select doc_id, source, length(coalesce(text, '')) as n from documents)""")
def running_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place in the whole text, by source, newest first."""
    rows = read(spark, sf_dir, "documents", "doc_id", "source", "text").select("doc_id", "source", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    found = running_sums(rows, [F.col("source"), report.Descending(F.col("doc_id"))], F.col("n"), total="total")
    return found.select("doc_id", "running", "total")


@query(planted_sql("select 'literal:' || secret || '==>literal:REDACTED' as line from d group by secret"))
def purge_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.purge_lines(aggregate.purge_list(planted_findings(spark, sf_dir)))


GUARD_FILES = f"(select path as file, case when doc_id % 13 = 0 then chr(26) else '' end || coalesce(text, '') as content from {PATHS_SQL})"
GUARD_IGNORED = "(starts_with(file, 'test/') or starts_with(file, 'node_modules/') or regexp_full_match(file, '[^/]*\\.min\\.js')) and file <> 'test/keep.js'"


def guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, content (binary), size and status of files of many kinds, with a limit of 4 KB."""
    rows = derived.paths(spark, sf_dir, "text")
    content = F.concat(F.when(F.col("doc_id") % 13 == 0, "\x1a").otherwise(""), F.coalesce("text", F.lit(""))).cast("binary")
    rows = rows.select(F.col("path").alias("file"), content.alias("content"), F.octet_length(content).cast("long").alias("size"))
    return file_source.file_status(rows, ScanConfig(max_file_size=4096, ignore=IgnoreSpec.parse(IGNORES)))


#: n bytes as a text, with one decimal rounded half up
TENTHS = "((n * 10 + unit // 2) // unit)"
BYTES_SQL = f"""(case when n < 1024 then n || ' B' else ({TENTHS} // 10) || (case when {TENTHS} % 10 = 0 then '' else '.' || {TENTHS} % 10 end) ||
    (case unit when 1024 then ' KB' when 1048576 then ' MB' else ' GB' end) end)"""
UNIT_SQL = "case when n < 1048576 then 1024 when n < 1073741824 then 1048576 else 1073741824 end as unit"


@query(f"""select file, n as size, is_ignored, n > 4096 and not is_ignored as skipped, case when n > 4096 and not is_ignored then 'File size ' || {BYTES_SQL} || ' exceeds limit 4 KB' end as skip_reason, is_binary
    from (select *, {UNIT_SQL} from (select file, {GUARD_IGNORED} as is_ignored, strlen(content)::bigint as n, starts_with(content, chr(26)) as is_binary from {GUARD_FILES}))""")
def file_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guarded(spark, sf_dir).select("file", "size", "is_ignored", "skipped", "skip_reason", "is_binary")


@query(planted_sql(f"""select g.*, critical, high, medium, low, total, files from (
        select count(*)::bigint as files_seen, count(*) filter (strlen(content) > 4096 and not ({GUARD_IGNORED}))::bigint as files_skipped, count(*) filter (starts_with(content, chr(26)))::bigint as files_binary, count(*) filter ({GUARD_IGNORED})::bigint as files_ignored from {GUARD_FILES}
    ) g, (select count(*) filter (severity = 'critical')::bigint as critical, count(*) filter (severity = 'high')::bigint as high, count(*) filter (severity = 'medium')::bigint as medium,
        count(*) filter (severity = 'low')::bigint as low, count(*)::bigint as total, count(distinct file)::bigint as files from d)"""))
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.scan_summary(guarded(spark, sf_dir), planted_findings(spark, sf_dir))


@query(planted_sql("""select '{"filesScanned":' || (select count(*) from documents) || ',"filesWithFindings":' || count(distinct file) || ',"findingsCount":' || count(*) || ',"severityCounts":{"critical":' || count(*) filter (severity = 'critical')
    || ',"high":' || count(*) filter (severity = 'high') || ',"medium":' || count(*) filter (severity = 'medium') || ',"low":' || count(*) filter (severity = 'low') || '}}' as json from d"""))
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(planted_findings(spark, sf_dir), files_scanned=read(spark, sf_dir, "documents", "doc_id").count())


# whole documents, line by line: a finding is open, fixed or ignored by its document's number

STATUS = "case doc_id % 3 when 0 then 'open' when 1 then 'fixed' else 'ignored' end"
REPORTED = f"""r as (select d.*, name, {STATUS} as status, row_number() over (order by {REPORT_ORDER}) as number from d join {NAMES_SQL} using (rule_id)),
    t as (select unnest(['total', 'critical', 'high', 'medium', 'low', 'open', 'fixed', 'ignored']) as name, unnest(range(1, 9)) as number, unnest([count(*), count(*) filter (severity = 'critical'), count(*) filter (severity = 'high'),
        count(*) filter (severity = 'medium'), count(*) filter (severity = 'low'), count(*) filter (status = 'open'), count(*) filter (status = 'fixed'), count(*) filter (status = 'ignored')]) as n from r),
    k as (select f.number, title, string_agg(distinct control, ', ' order by control) as controls from (values (1, 'owasp', 'OWASP Top 10'), (2, 'nist', 'NIST SP 800-53'), (3, 'cis', 'CIS Controls'), (4, 'soc2', 'SOC 2 Criteria')) f(number, framework, title)
        left join (select framework, control from d join {CONTROLS_SQL} using (rule_id)) x on x.framework = f.framework group by 1, 2)"""


def reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id") % 3
    return planted_findings(spark, sf_dir).withColumn("status", F.when(n == 0, "open").when(n == 1, "fixed").otherwise("ignored"))


def fixed_sql(section: int, lines: list[str]) -> str:
    return f"select {section}, generate_subscripts({lines}, 1), unnest([{', '.join(map(literal, lines))}])"


@query(planted_sql(f"""select section::int as section, number::bigint as number, line from (
        {fixed_sql(1, ['# Compliance report', '', 'Date: 2024-01-01', '', '## Summary', '', '| | n |', '|-|-|'])}
        union all select 2, number, '| ' || name || ' | ' || n || ' |' from t
        union all {fixed_sql(3, ['', '## Findings', '', '| File | Line | Rule | Severity | Status |', '|-|-|-|-|-|'])}
        union all select 4, number, '| `' || file || '` | ' || line_number || ' | ' || name || ' | ' || severity || ' | ' || status || ' |' from r
        union all {fixed_sql(5, ['', '## Controls', ''])}
        union all select 6, number, '- ' || title || ': ' || coalesce(controls, 'none') from k
        union all {fixed_sql(7, ['', '## What to do', '', *(f'{i}. {x}' for i, x in enumerate(report.ADVICE, 1))])}
    ) as l(section, number, line)""", REPORTED))
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.markdown_document(reported(spark, sf_dir), "2024-01-01")


HTML_CELL = "replace(replace(replace(replace({0}::varchar, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(planted_sql(f"""select section::int as section, number::bigint as number, line from (
        {fixed_sql(1, ['<!DOCTYPE html>', '<html lang="en"><head><meta charset="UTF-8"/><title>Compliance report</title></head><body>', '<h1>Compliance report</h1><p>2024-01-01</p>', '<h2>Summary</h2><table>'])}
        union all select 2, number, '<tr><td>' || name || '</td><td>' || n || '</td></tr>' from t
        union all {fixed_sql(3, ['</table><h2>Findings</h2><table>', '<tr><th>File</th><th>Line</th><th>Rule</th><th>Severity</th><th>Status</th></tr>'])}
        union all select 4, number, '<tr><td>' || {" || '</td><td>' || ".join(HTML_CELL.format(c) for c in ("file", "line_number", "name", "severity", "status"))} || '</td></tr>' from r
        union all {fixed_sql(5, ['</table><h2>Controls</h2><dl>'])}
        union all select 6, number, '<dt>' || title || '</dt><dd>' || coalesce(controls, 'none') || '</dd>' from k
        union all {fixed_sql(7, ['</dl><h2>What to do</h2><ol>', *(f'<li>{x}</li>' for x in report.ADVICE), '</ol></body></html>'])}
    ) as l(section, number, line)""", REPORTED))
def html_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.html_document(reported(spark, sf_dir), "2024-01-01")


@query(planted_sql(f"""select section::int as section, number::bigint as number, line from (
        select 1, 1, '{{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"siftwell","version":"1","rules":['
        union all select 2, number, (case when number > 1 then ',' else '' end) || '{{"id":"' || rule_id || '","shortDescription":{{"text":"' || name || '"}},"defaultConfiguration":{{"level":"' || level || '"}}}}' from u
        union all {fixed_sql(3, [']}},', '"results":['])}
        union all select 4, number, (case when number > 1 then ',' else '' end) || '{{"ruleId":"' || rule_id || '","level":"' || level || '","message":{{"text":"' || name || '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || file
            || '"}},"region":{{"startLine":' || line_number || ',"startColumn":' || match_start + 1 || '}}}}}}]}}' from x
        union all {fixed_sql(5, [']}]}'])}
    ) as l(section, number, line)""", f"""x as (select *, row_number() over (order by {REPORT_ORDER}) as number, case when severity in ('critical', 'high') then 'error' when severity = 'low' then 'note' else 'warning' end as level from d join {NAMES_SQL} using (rule_id)),
    u as (select *, row_number() over (order by rule_id) as number from (select distinct rule_id, name, level from x))"""))
def sarif_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sarif_document(planted_findings(spark, sf_dir), "siftwell", "1")


# policy and scalar functions


@query(f"""select doc_id, path, (case when regexp_matches(path, '\\.(min|bundle)\\.(js|css)$') then 5.0 when {EXT_SQL} in ({", ".join(map(literal, T.CONFIG_EXTENSIONS))})
    or {BASE_SQL} = '.env' or starts_with({BASE_SQL}, '.env.') then 4.5 else 4.8 end)::double as threshold from {PATHS_SQL}""")
def entropy_threshold_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.paths(spark, sf_dir).select("doc_id", "path", T.entropy_threshold(F.col("path")).cast("double").alias("threshold"))


@query(f"select doc_id, file, {GUARD_IGNORED} as ignored from (select doc_id, path as file from {PATHS_SQL})")
def glob_file_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.paths(spark, sf_dir).select("doc_id", F.col("path").alias("file"), IgnoreSpec.parse(IGNORES).ignores_file(F.col("path")).alias("ignored"))


@query(f"select doc_id, {IGNORED_SQL} as ignored from (select doc_id, split_part(coalesce(text, ''), chr(10), 1) || line as line from {with_fixture_sql('comments', 'doc_id, text')})")
def inline_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document's first line with one of the comments behind it."""
    line = F.concat(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), "line")
    return with_fixture(spark, sf_dir, "comments", "text").select("doc_id", line.rlike(ScanConfig().inline_ignore).alias("ignored"))


@query(f"""select file, line_number::bigint as line_number, rule_id, severity, emit from (select *, row_number() over (partition by file, line_number, match_start, match_length order by {RANK} desc, emit) as n from (
        select source as file, n_chars % 50 as line_number, 'rule-' || doc_id % 5 as rule_id, ['critical', 'high', 'medium', 'low'][doc_id % 4 + 1] as severity, nullif(doc_id % 3, 2) as match_start, 10 as match_length, doc_id as emit from documents)) where n = 1""")
def dedup_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, severities = F.col("doc_id"), F.array(*map(F.lit, ("critical", "high", "medium", "low")))
    rows = read(spark, sf_dir, "documents", "doc_id", "source", "n_chars").select(
        F.col("source").alias("file"), (F.col("n_chars") % 50).alias("line_number"), F.concat(F.lit("rule-"), (n % 5).cast("string")).alias("rule_id"), F.element_at(severities, (n % 4 + 1).cast("int")).alias("severity"),
        F.nullif(n % 3, F.lit(2)).alias("match_start"), F.lit(10).alias("match_length"), n.alias("emit"), *(F.lit(0).alias(c) for c in detect.ORDER if c != "emit_rule"), n.alias("emit_rule"),
    )
    return detect.dedup(rows).select("file", "line_number", "rule_id", "severity", "emit")


@query(planted_sql("select d.file, line_number::bigint as line_number, rule_id, severity from d where doc_id % 3 <> 1 and doc_id % 7 < 5"))
def changed_files_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five of seven files are in the list of changes, a third of them as deleted."""
    kind = F.when(F.col("doc_id") % 3 == 0, "M").when(F.col("doc_id") % 3 == 1, "D").otherwise("A")
    changes = documents(spark, sf_dir).filter("doc_id % 7 < 5").select("file", kind.alias("change_type"))
    return policy.only_in(planted_findings(spark, sf_dir), changes).select("file", long("line_number"), "rule_id", "severity")


SCALARS = f"""(select doc_id as id, n, {UNIT_SQL}, slug, cell, seconds, [doc_id % 3, doc_id % 11, doc_id % 7] as version, [doc_id % 2, doc_id % 13, doc_id % 5] as other from (
    select doc_id, case doc_id % 4 when 0 then n_chars when 1 then n_chars * 1021 when 2 then n_chars * 104729 else doc_id end as n, coalesce(lang, 'xx') || '-' || source || '_kEY' as slug, doc_id * 977 as seconds,
        ['', '=', '+', '-', '@', chr(9)][doc_id % 6 + 1] || split_part(coalesce(text, ''), chr(10), 1) as cell from documents))"""


@query(f"""select id, {BYTES_SQL} as bytes, array_to_string(list_transform(regexp_split_to_array(slug, '[-_]'), lambda x: upper(x[1:1]) || x[2:]), ' ') as title, version > other as newer,
    case when seconds < 60 then seconds || ' sec ago' when seconds < 3600 then seconds // 60 || ' min ago' when seconds < 86400 then seconds // 3600 || ' hr ago' when seconds < 172800 then '1 day ago' else seconds // 86400 || ' days ago' end as ago,
    case when contains(guarded, ',') then '"' || guarded || '"' else guarded end as csv, {HTML_CELL.format("cell")} as html
    from (select *, case when regexp_matches(cell, '^[=+@\\t\\r-]') then '''' || cell else cell end as guarded from {SCALARS})""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    dotted = lambda *n: F.concat_ws(".", *((d % k).cast("string") for k in n))
    n = F.when(d % 4 == 0, F.col("n_chars")).when(d % 4 == 1, F.col("n_chars") * 1021).when(d % 4 == 2, F.col("n_chars") * 104729).otherwise(d)
    cell = F.concat(F.element_at(F.array(*map(F.lit, ("", "=", "+", "-", "@", "\t"))), (d % 6 + 1).cast("int")), F.substring_index(F.coalesce("text", F.lit("")), "\n", 1))
    now = F.lit("2050-03-01T00:00:00Z").cast("timestamp")
    then = F.timestamp_micros(F.unix_micros(now) - d * 977_000_000)
    slug = F.concat(F.coalesce("lang", F.lit("xx")), F.lit("-"), "source", F.lit("_kEY"))
    return read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars").select(
        d.alias("id"), T.format_bytes(n).alias("bytes"), T.title_case(slug).alias("title"), T.is_newer(dotted(3, 11, 7), dotted(2, 13, 5)).alias("newer"),
        T.relative_time(then, now).alias("ago"), T.csv_cell(cell).alias("csv"), T.escape_html(cell).alias("html"),
    )


@query(f"""select doc_id as id, (doc_id * 20 * 977 // 86400)::bigint as days, here - interval 2 day as two_days, here - interval 21 day as three_weeks, (here::date - interval 1 month)::timestamp as month_back
    from (select doc_id, timestamp '{START}' + to_minutes(doc_id * 777) as here from documents)""")
def relative_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, now = F.col("doc_id"), derived.minutes_after(F.col("doc_id") * 777)
    then = F.timestamp_micros(F.unix_micros(now) - d * 20 * 977_000_000)
    date = lambda spec: T.since(spec, now).cast("timestamp_ntz")
    return read(spark, sf_dir, "documents", "doc_id").select(d.alias("id"), T.days_ago(then, now).alias("days"), date("2d").alias("two_days"), date("3w").alias("three_weeks"), date("1m").alias("month_back"))


# secrets across lines


@query(f"""with s as {SOURCES}, l as (
        select file, unnest(string_split(content, chr(10))) as raw, generate_subscripts(string_split(content, chr(10)), 1) as pos from s
    ), b as (select *, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') as line from l where regexp_full_match(regexp_replace(raw, '^\\s+|\\s+$', '', 'g'), '[A-Za-z0-9+/=]{{20,}}')),
    g as (select *, pos - row_number() over (partition by file order by pos) as island from b)
    select file, min(pos)::bigint as line_number, string_agg(line, '' order by pos) as text from g group by file, island having count(*) >= 3""")
def base64_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiline.base64_blocks(derived.sources(spark, sf_dir)).select("file", long("line_number"), "text")


@query(f"""select file, regexp_replace(m[2:-2], '\\$\\{{[^}}]*\\}}', '', 'g') as text from (select file, unnest(regexp_extract_all(content, '`[^`]{{20,}}`')) as m from {SOURCES})
    where length(regexp_replace(m[2:-2], '\\$\\{{[^}}]*\\}}', '', 'g')) >= 20""")
def template_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiline.template_literals(derived.sources(spark, sf_dir)).select("file", "text")


@query(f"""select file, text from (select file, replace(replace(regexp_replace(m, '["'']\\s*\\+\\s*["'']', ''), '"', ''), '''', '') as text
    from (select file, unnest(regexp_extract_all(content, {CONCAT_SQL})) as m from {SOURCES})) where length(text) >= 20""")
def joined_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiline.joined_literals(derived.sources(spark, sf_dir)).select("file", "text")


# the audit log


@query(f"""select count(*)::bigint as scans, sum("findingCount")::bigint as findings, sum(critical)::bigint as critical, sum(high)::bigint as high, sum(medium)::bigint as medium, sum(low)::bigint as low,
    count(*) filter ("userDecision" = 'bypassed')::bigint as bypassed, format('{{:.2f}}', 100.0 * count(*) filter ("userDecision" = 'bypassed') / count(*)) as bypass_percent from {AUDIT}""")
def audit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.stats(derived.audit_log(spark, sf_dir))


@query(f"""select idx from {AUDIT} where timestamp::timestamp >= timestamp '2024-01-02' and timestamp::timestamp <= timestamp '2024-06-01 12:00:00' and "userDecision" = 'bypassed' and high > 0 and "findingCount" >= 4""")
def audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda s: F.lit(s).cast("timestamp")
    log = derived.audit_log(spark, sf_dir)
    return audit.query(log, since=at("2024-01-02"), until=at("2024-06-01 12:00:00"), decision="bypassed", min_findings=4, severity="high").select("idx")


@query(f"""select timestamp, timestamp || ',' || (case when "commitHash" = '=cmd' then '''=cmd' else "commitHash" end) || ',' || (case when contains(files, ',') then '"' || files || '"' else files end)
    || ',' || "findingCount" || ',' || critical || ',' || high || ',' || medium || ',' || low || ',' || coalesce("userDecision", 'none') as line from {AUDIT}""")
def audit_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.csv_lines(derived.audit_log(spark, sf_dir))


@query(f"select coalesce(\"userDecision\", 'none') as decision, count(*)::bigint as n from {AUDIT} group by 1")
def audit_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.decisions(derived.audit_log(spark, sf_dir))


@query(f'select timestamp, "findingCount", "userDecision" from {AUDIT} order by timestamp desc limit 1')
def last_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.last_scan(derived.audit_log(spark, sf_dir))


FLAT_SQL = f"""(select idx, case when idx % 2 = 0 then split_part(files, ';', 1) else 'own' || idx end as file, 'r' || critical as rule_id, action as status from {AUDIT} where "findingCount" > 0)"""


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding an entry; every other one has a file of its own."""
    log = derived.audit_log(spark, sf_dir).filter("findingCount > 0")
    own = F.when(F.col("idx") % 2 == 1, F.concat(F.lit("own"), F.col("idx").cast("string")))
    rule = F.concat(F.lit("r"), F.col("severityCounts.critical").cast("string"))
    return audit.flat_findings(log.withColumn("findings", F.array(F.struct(own.alias("file"), rule.alias("ruleId"), F.lit("low").alias("severity")))))


@query(f"select file, rule_id, status, count(*)::bigint as n from {FLAT_SQL} group by all")
def audit_flat_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding without a file of its own belongs to the entry's first."""
    return flat(spark, sf_dir).groupBy("file", "rule_id", "status").agg(F.count("*").alias("n"))


@query(f"""select count(*)::bigint as total, count(*) filter (status = 'fixed')::bigint as fixed, count(*) filter (status = 'ignored')::bigint as ignored, count(*) filter (status not in ('fixed', 'ignored'))::bigint as open from {FLAT_SQL}""")
def audit_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.status_counts(flat(spark, sf_dir))


# A scan of each source and range of 256 documents is an entry; a fourth of the ranges is appended at a time, as a segment. Then the third segment is lost, and every
# seventh entry's count is changed.
SCANS = """e as (select distinct string_split(file, '/')[1][4:]::int as source, doc_id // 256 as part, doc_id // 256 % 4 + 1 as segment from d),
    g as (select *, row_number() over (partition by segment order by part, source) as place, row_number() over (order by segment, part, source) - 1 as entry from e where segment <> 3)"""


@query(planted_sql("""select segment::int as segment, entry::bigint as entry, place % 7 <> 0 as hash_ok, not (segment = 4 and place = 1) as link_ok,
    array_to_string(list_filter([case when place % 7 = 0 then 'Hash mismatch' end, case when segment = 4 and place = 1 then 'Chain linkage broken' end, case when segment = 4 and place = 1 then 'Segment lost' end], lambda x: x is not null), ', ') as errors from g""", SCANS))
def audit_chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries made of scans, appended in segments, tampered with, and checked."""
    log, other = new_path(spark, "audit"), new_path(spark, "audit-tampered")
    part = F.floor(F.col("doc_id") / 256)
    at = derived.minutes_after(part * 1000 + F.substring(F.substring_index("file", "/", 1), 4, 9).try_cast("int"))
    found = stage(planted_findings(spark, sf_dir).withColumns({"at": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), "segment": part % 4 + 1}), "scans")
    for segment in range(1, 5):
        audit_segments.append(spark, log, audit_segments.entries(found.filter(F.col("segment") == segment), "at", timestamp=F.col("at"), decision=F.lit("passed")))
    place = F.row_number().over(Window.partitionBy("segment").orderBy("position"))
    lines = audit_segments.read(spark, log).withColumn("place", place).filter("segment <> 3")
    changed = F.when(F.col("place") % 7 == 0, F.replace("value", F.lit('"findingCount":'), F.lit('"findingCount":1'))).otherwise(F.col("value"))
    lines = lines.select("segment", "place", changed.alias("value")).repartition("segment").sortWithinPartitions("segment", "place")
    lines.select("segment", "value").write.partitionBy("segment").text(other)
    return audit.verify_chain(audit_segments.read(spark, other)).select("segment", "entry", "hash_ok", "link_ok", F.array_join("errors", ", ").alias("errors"))


# history


@query(f"select commit_hash, file, line_number::bigint as line_number, content from {ADDED_SQL}")
def diff_added_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.added_lines(derived.commits(spark, sf_dir))
    return rows.select("commit_hash", "file", long("line_number"), "content")


@query(f"select sha256('c' || doc_id)[1:40] as commit_hash, file, case when before is null then 'A' else 'M' end as status, len(string_split(content, chr(10)))::bigint + (before is null)::int as added, coalesce(len(string_split(before, chr(10))), 0)::bigint as removed from {VERSIONS}")
def changed_file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each commit's file with the numbers of lines it brings and removes."""
    commits = derived.commits(spark, sf_dir)
    sizes = history.changed_lines(commits).groupBy("commit_hash", "file").agg(F.count_if(F.col("change") == 1).alias("added"), F.count_if(F.col("change") == -1).alias("removed"))
    return history.changed_files(commits).select("commit_hash", "file", "status").join(sizes, ["commit_hash", "file"])


ADDED_HITS = f"a as (select doc_id, commit_hash, file, line_number, content as line, 0 as shift from {ADDED_SQL}), {hits_sql('a', 'doc_id, commit_hash, file')}"


@query(f"with {ADDED_HITS} select commit_hash, file, line_number, rule_id, match_start, secret from h")
def history_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_history(history.added_lines(derived.commits(spark, sf_dir))).filter("type = 'pattern'")
    return found.select("commit_hash", "file", long("line_number"), "rule_id", long("match_start"), "secret")


@query(f"with {ADDED_HITS} select secret, count(distinct file)::bigint as files, count(*)::bigint as n from h group by 1")
def purge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.purge_list(scan_history(history.added_lines(derived.commits(spark, sf_dir))).filter("type = 'pattern'"))


@query(f"""with {ADDED_HITS} select h.commit_hash[1:7] as commit, c.author, c.subject, h.file, h.line_number, h.rule_id, h.match_start,
    (epoch_ms(timestamp '2050-02-01 12:00:00') - epoch_ms(c.committed_at)) // 86400000 as days_in_history from h join (select {COMMIT_SQL} from documents) c using (commit_hash)""")
def history_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = derived.commits(spark, sf_dir)
    found = with_commits(scan_history(history.added_lines(commits)).filter("type = 'pattern'"), commits, F.lit("2050-02-01T12:00:00Z").cast("timestamp"))
    return found.select("commit", "author", "subject", "file", long("line_number"), "rule_id", long("match_start"), "days_in_history")


# what each version's file holds when it is the last of its chain, and in which versions the secret's count changes
LATEST = f"""v as materialized (select * from {VERSIONS}), last as (select * exclude n from (select *, row_number() over (partition by chain order by doc_id desc) as n from v) where n = 1),
    a as (select doc_id, file, unnest(generate_series(1, len(string_split(content, chr(10))))) as line_number, unnest(string_split(content, chr(10))) as line, 0 as shift from last), {hits_sql('a', 'doc_id, file')},
    s as (select distinct file, secret from h), x as (select s.file, s.secret, v.doc_id, v.is_remote, (length(content) - length(replace(content, secret, '')) - coalesce(length(before) - length(replace(before, secret, '')), 0)) // length(secret) as difference
        from s join v using (file) where length(secret) between 8 and 200)"""


def latest_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.versions(spark, sf_dir).groupBy("file").agg(F.max_by("content", "doc_id").alias("content"))
    return stage(detect.pattern_findings(split_lines(rows).withColumn("shift", F.lit(0))).select("file", "secret").distinct(), "latest")


@query(f"with {LATEST} select sha256('c' || doc_id)[1:40] as commit_hash, file, secret, difference::bigint as difference from x where difference <> 0")
def secret_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits that change how often a secret of the latest files occurs."""
    return exposure.secret_changes(latest_findings(spark, sf_dir), history.changed_text(derived.commits(spark, sf_dir)))


@query(f"""with {LATEST}, t as (select file, bool_or(is_remote) as remote, min(timestamp '{START}' + to_minutes(doc_id)) filter (is_remote and before is null) as since from v group by file),
    y as (select file, secret, bool_or(is_remote) as remote from x where difference <> 0 group by 1, 2)
    select s.file, s.secret, case when length(s.secret) between 8 and 200 then case when y.remote then 'PUSHED' when y.file is not null then 'COMMITTED' else 'LOCAL' end when t.remote then 'PUSHED' else 'COMMITTED' end as level,
        case when length(s.secret) between 8 and 200 then 'high' else 'medium' end as confidence, t.since as exposure_since
    from s join t using (file) left join y on y.file = s.file and y.secret = s.secret""")
def exposure_in_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From commits to levels: which secrets others can see, and since when."""
    commits = derived.commits(spark, sf_dir)
    flags = exposure.history_flags(latest_findings(spark, sf_dir), commits, history.changed_files(commits), history.changed_text(commits))
    exposed = exposure.exposure(flags.withColumn("is_repo", F.lit(True)))
    return exposed.select("file", "secret", "level", "confidence", F.col("exposure_since").cast("timestamp_ntz").alias("exposure_since"))


FLAGS = "(select doc_id as id, doc_id % 11 <> 0 as is_repo, doc_id % 2 = 0 as staged, doc_id % 3 = 0 as in_any_commit, doc_id % 6 = 0 as in_remote, coalesce(text, '')[1:n_chars % 13] as secret, doc_id % 5 = 0 as secret_in_any, doc_id % 10 = 0 as secret_in_remote from documents)"


@query(f"""select id, case when not is_repo then 'UNKNOWN' when length(secret) between 8 and 200 then case when secret_in_remote then 'PUSHED' when secret_in_any then 'COMMITTED' else 'LOCAL' end
    when not in_any_commit then 'LOCAL' when in_remote then 'PUSHED' else 'COMMITTED' end as level,
    case when not is_repo then 'low' when length(secret) between 8 and 200 or not in_any_commit then 'high' else 'medium' end as confidence from {FLAGS}""")
def exposure_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    rows = read(spark, sf_dir, "documents", "doc_id", "text", "n_chars").select(
        d.alias("id"), (d % 11 != 0).alias("is_repo"), (d % 2 == 0).alias("staged"), (d % 3 == 0).alias("in_any_commit"), (d % 6 == 0).alias("in_remote"),
        F.substring(F.coalesce("text", F.lit("")), F.lit(1), (F.col("n_chars") % 13).cast("int")).alias("secret"), (d % 5 == 0).alias("secret_in_any"), (d % 10 == 0).alias("secret_in_remote"),
    )
    return exposure.exposure(rows).select("id", "level", "confidence")


@query(f"""with {LATEST}, y as (select file, secret from x where difference <> 0 and is_remote group by 1, 2), t as (select file, bool_or(is_remote) as remote from v group by file)
    select s.file, s.secret from s left join y using (file, secret) join t on t.file = s.file where case when length(s.secret) between 8 and 200 then y.file is not null else t.remote end""".replace("left join y using (file, secret)", "left join y on y.file = s.file and y.secret = s.secret"))
def pushed_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = derived.commits(spark, sf_dir)
    flags = exposure.history_flags(latest_findings(spark, sf_dir), commits, history.changed_files(commits), history.changed_text(commits))
    return exposure.pushed_only(exposure.exposure(flags.withColumn("is_repo", F.lit(True)))).select("file", "secret")


# verification: every planted document's secrets were checked at some time, many of them more than once in the hour and some after the scan

NOW = "2024-01-01 12:00:00"
CHECKS = f"""c as (select distinct rule_id, secret, timestamp '{NOW}' - to_minutes(doc_id % 97 - 9) as checked_at, ['live', 'inactive', 'unknown'][doc_id % 3 + 1] as status from d),
    b as (select rule_id, secret, arg_max(status, (checked_at, status)) as status from c where checked_at <= timestamp '{NOW}' and checked_at > timestamp '{NOW}' - interval 1 hour group by 1, 2),
    v as (select d.*, coalesce(status, 'skipped') as verification, coalesce(status = 'inactive', false) as auto_downgraded, case status when 'live' then 'critical' when 'inactive' then 'low' else severity end as adjusted
        from d left join b on b.rule_id = d.rule_id and b.secret = d.secret)"""


def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, now = stage(planted_findings(spark, sf_dir), "findings"), F.lit(NOW).cast("timestamp")
    at = F.timestamp_micros(F.unix_micros(now) - (F.col("doc_id") % 97 - 9) * 60_000_000)
    status = F.element_at(F.array(*map(F.lit, ("live", "inactive", "unknown"))), (F.col("doc_id") % 3 + 1).cast("int"))
    results = found.select("rule_id", F.sha2("secret", 256).alias("secret_sha256"), status.alias("status"), at.alias("checked_at"))
    return enrich.apply_verification(found, results, now)


@query(planted_sql("select file, line_number::bigint as line_number, rule_id, match_start, verification, adjusted as severity, auto_downgraded from v", CHECKS))
def verification_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(spark, sf_dir).select("file", long("line_number"), "rule_id", long("match_start"), "verification", "severity", "auto_downgraded")


@query(planted_sql("select count(*) filter (verification = 'live')::bigint as live, count(*) filter (verification = 'inactive')::bigint as inactive, count(*) filter (verification not in ('live', 'inactive'))::bigint as unknown from v", CHECKS))
def verification_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.verification_counts(verified(spark, sf_dir))


# rewrites: each document brings one of the lines, with its number in the secret and a folder of its own

ENV = ", ".join(f"({literal(e.rule_id)}, {literal(e.env_var)})" for e in ENRICHMENT if e.env_var)
FIX_ROWS = f"(select * replace ('d' || doc_id || '/' || file as file, replace(line, secret, secret || doc_id) as line, secret || doc_id as secret) from {with_fixture_sql('fixes')})"
FIXES = f"""x as (select f.*, case when regexp_matches(file, '(^|/)Dockerfile(\\.[^/]*)?$') then 'dockerfile' else coalesce(l.language, 'unknown') end as language,
        coalesce(e.known, upper(regexp_replace(nullif(regexp_extract(line, '(?:const|let|var|export)\\s+(\\w+)\\s*=', 1), ''), '([a-z])([A-Z])', '\\1_\\2', 'g')), replace(upper(f.rule_id), '-', '_')) as var_name
        from {FIX_ROWS} f left join (values {ENV}) as e(rule_id, known) using (rule_id)
        left join (values {", ".join(f"({literal(k)}, {literal(v)})" for k, v in T.LANGUAGES.items())}) as l(ext, language) on l.ext = regexp_extract(file, '\\.[^./]*$'))"""
# what is taken out: the secret with its quotes, or the quoted literal that holds it, or the secret
TAKEN = """case when contains(line, '"' || secret || '"') then '"' || secret || '"' when contains(line, '''' || secret || '''') then '''' || secret || ''''
        else coalesce(nullif(regexp_extract(line, '"[^"]*' || regexp_escape(secret) || '[^"]*"'), ''), nullif(regexp_extract(line, '''[^'']*' || regexp_escape(secret) || '[^'']*'''), ''), secret) end"""


def fix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("doc_id").cast("string")
    return with_fixture(spark, sf_dir, "fixes").withColumns({"file": F.concat(F.lit("d"), number, F.lit("/"), "file"), "line": F.replace("line", "secret", F.concat("secret", number)), "secret": F.concat("secret", number)})


@query(f"with {FIXES} select file, line_number, language, var_name from x")
def env_var_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.fix_plan(fix_rows(spark, sf_dir)).select("file", "line_number", "language", "var_name")


@query(f"""with {FIXES}, y as (select *, case language when 'python' then 'os.environ["' || var_name || '"]' when 'go' then 'os.Getenv("' || var_name || '")' when 'ruby' then 'ENV["' || var_name || '"]'
        when 'java' then 'System.getenv("' || var_name || '")' when 'yaml' then '${{' || var_name || '}}' when 'terraform' then 'var.' || lower(var_name) else 'process.env.' || var_name end as ref from x),
    z as (select *, {TAKEN} as old from y)
    select file, line_number, line as before, case language when 'json' then line
        when 'dockerfile' then case when starts_with(line, 'ENV') then 'ARG ' || regexp_extract(line, 'ENV\\s+(\\w+)', 1) else replace(line, secret, '# REMOVED') end
        else line[1:instr(line, old) - 1] || (case when language = 'yaml' and old <> secret then '"' || ref || '"' else ref end) || line[instr(line, old) + length(old):] end as after from z""")
def fix_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.fix_plan(fix_rows(spark, sf_dir)).select("file", "line_number", "before", "after")


@query(f"""with f as (select 'd' || doc_id || '/' || file as file, secret || doc_id as secret, replace(upper(rule_id), '-', '_') as name, doc_id, line_number, line, secret as plain from {with_fixture_sql('fix_findings')}),
    c as (select doc_id, 'd' || doc_id || '/' || file as file, line, line_number, plain from f),
    r as (select *, string_split(line, chr(39)) as q from f)
    select file, repeat('// ' || doc_id || chr(10), (line_number - 1)::int) || replace(replace(line, plain, plain || doc_id), '''' || plain || doc_id || '''', 'process.env.' || name) || chr(10) || 'end' as content
    from (select 'd' || doc_id || '/' || split_part(file, '/', 2) as file, doc_id, line_number, line, plain, name from f)""")
def fix_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a file with its secret in one of its lines."""
    number = F.col("doc_id").cast("string")
    rows = with_fixture(spark, sf_dir, "fix_findings")
    named = F.concat(F.lit("d"), number, F.lit("/"), "file")
    line = F.replace("line", "secret", F.concat("secret", number))
    found = rows.select(named.alias("file"), "line_number", line.alias("line"), F.concat("secret", number).alias("secret"), "rule_id")
    content = F.concat(F.repeat(F.concat(F.lit("// "), number, F.lit("\n")), (F.col("line_number") - 1).cast("int")), line, F.lit("\nend"))
    files = rows.select(named.alias("file"), content.alias("content"), F.lit(None).cast("string").alias("dotenv"))
    return rewrite.rewrite_files(files, rewrite.fix_plan(found)).select("file", "content")


#: A document wants its number's value under a name; every third name is there already, with that value or another.
WANTED = "(select 'V' || doc_id as name, coalesce(lang, '') || ' ' || source as value, doc_id from documents)"
EXISTING = "(select name, case when doc_id % 2 = 0 then '\"' || value || '\"' else 'other' end as value from (select 'V' || doc_id as name, coalesce(lang, '') || ' ' || source as value, doc_id from documents) where doc_id % 3 = 0)"


@query(f"""select case when e.value is null then 'added' when trim(e.value, '"') = w.value then 'existing' else 'conflict' end as action,
    case when e.value is not null and trim(e.value, '"') <> w.value then w.name || '_NEW' else w.name end as name,
    case when e.value is null then w.name || '="' || w.value || '"' when trim(e.value, '"') <> w.value then w.name || '_NEW=' || w.value end as line from {WANTED} w left join {EXISTING} e on e.name = w.name""")
def env_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = read(spark, sf_dir, "documents", "doc_id", "lang", "source").select("doc_id", F.concat(F.lit("V"), F.col("doc_id").cast("string")).alias("name"), F.concat(F.coalesce("lang", F.lit("")), F.lit(" "), "source").alias("value"))
    there = wanted.filter("doc_id % 3 = 0").select("name", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('"'), "value", F.lit('"'))).otherwise("other").alias("value"))
    return rewrite.env_upserts(wanted.select("name", "value"), there).select("action", "name", "line")


@query("select doc_id, coalesce(text, '')[1:1000] as value from documents")
def vault_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed values come back. The key is made up for the query."""
    key = F.lit(bytes(range(32)))
    value = F.substring(F.coalesce("text", F.lit("")), 1, 1000)
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.unseal(T.seal(value, key), key).alias("value"))


NEWLINE = "' || chr(10) || '"


@query(f"""select doc_id, language, case
    when language = 'python' and not regexp_matches(content, '(?m)^(import|from)\\s+os\\b') then regexp_replace(content, '^(#![^\\n]*\\n)?(#[^\\n]*coding[^\\n]*\\n)?', '\\1\\2import os{NEWLINE}')
    when language = 'go' and contains(content, '"os"') then content
    when language = 'go' and regexp_matches(content, '(?m)^import\\s*\\(') then regexp_replace(content, '(?m)^(import\\s*\\([^\\n]*)', '\\1{NEWLINE}' || chr(9) || '"os"')
    when language = 'go' and regexp_matches(content, '(?m)^import\\s+"') then regexp_replace(content, '(?m)^import\\s+"([^"]+)"[^\\n]*', 'import ({NEWLINE}' || chr(9) || '"\\1"{NEWLINE}' || chr(9) || '"os"{NEWLINE})')
    when language = 'go' then regexp_replace(content, '(?m)^(package\\s+[^\\n]*)', '\\1{NEWLINE}{NEWLINE}import "os"')
    when language = 'javascript' and dotenv is not null and not contains(content, 'dotenv') then regexp_replace(content, '^(#![^\\n]*\\n)?([^\\n]*[''"]use strict[''"][^\\n]*\\n)?',
        '\\1\\2' || (case dotenv when 'module' then 'import ''dotenv/config'';' else 'require(''dotenv'').config();' end) || chr(10))
    else content end as content from (select * replace (content || chr(10) || '~ ' || coalesce(text, '') as content) from {with_fixture_sql('modules', 'doc_id, text')})""")
def ensure_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of scripts with a document below."""
    body = F.regexp_replace(F.coalesce("text", F.lit("")), "^", "~ ")
    rows = with_fixture(spark, sf_dir, "modules", "text").withColumn("content", F.concat("content", F.lit("\n"), body))
    lines = rewrite.ensure_import(F.split("content", "\n", -1), F.col("language"), F.col("dotenv"))
    return rows.select("doc_id", "language", F.array_join(lines, "\n").alias("content"))


# rule packs


@query(f"""select count(*)::bigint as rules, count(distinct category)::bigint as categories, count(distinct severity)::bigint as severities, format('{{:.3f}}', avg(confidence)) as avg_confidence,
    format('{{:.3f}}', avg(detection_rate)) as avg_detection_rate, format('{{:.3f}}', avg(false_positive_rate)) as avg_false_positive_rate from {PACK}""")
def pack_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.pack_averages(derived.pack_rules(spark, sf_dir))


@query(f"""select * from (select 'confidence' as list, row_number() over (order by confidence desc, position) as place, id from {PACK}
    union all select 'false_positive_rate', row_number() over (order by false_positive_rate, position), id from {PACK}) where place <= 10""")
def pack_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two lists of ten."""
    return aggregate.pack_top(derived.pack_rules(spark, sf_dir))


_IDS, _PATTERNS = [r.id for r in RULES], [r.pattern for r in PATTERN_RULES]
OWN_PACK = f"""(select case when doc_id % 10 = 0 then [{", ".join(map(literal, _IDS))}][doc_id // 10 % {len(_IDS)} + 1] else 'rule-' || doc_id end as id,
    case when doc_id % 7 = 0 then upper([{", ".join(map(literal, _PATTERNS))}][doc_id // 7 % {len(_PATTERNS)} + 1]) else 'p' || doc_id end as pattern from documents)"""


@query(f"select id, pattern from {OWN_PACK} where id not in ({', '.join(map(literal, _IDS))}) and lower(pattern) not in ({', '.join(literal(p.lower()) for p in _PATTERNS)})")
def pack_without_builtins(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, of = F.col("doc_id"), lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n % len(xs) + 1).cast("int"))
    rows = read(spark, sf_dir, "documents", "doc_id").select(
        F.when(d % 10 == 0, of(_IDS, F.floor(d / 10))).otherwise(F.concat(F.lit("rule-"), d.cast("string"))).alias("id"),
        F.when(d % 7 == 0, F.upper(of(_PATTERNS, F.floor(d / 7)))).otherwise(F.concat(F.lit("p"), d.cast("string"))).alias("pattern"),
    )
    return enrich.without_builtins(rows)


# folders


@query("""select source, sum(len(string_split(coalesce(text, ''), chr(10))))::bigint as lines, sum(length(coalesce(text, '')) + 1)::bigint as chars, 0::bigint as errors
    from documents where source not in ('src1', 'src19') group by 1 union all select 'src1', 0, 0, 1 where exists (select 1 from documents)""")
def folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files, a folder a source, and read again: one folder is ignored, and a tracked file that isn't there is an error."""
    path = new_path(spark, "folder")
    rows = documents(spark, sf_dir).filter(~F.col("file").startswith("src1/")).select(F.substring_index("file", "/", 1).alias("source"), F.coalesce("content", F.lit("")).alias("value"))
    rows.write.option("maxRecordsPerFile", 500).partitionBy("source").text(path)
    config = ScanConfig(max_file_size=256 << 20, ignore=IgnoreSpec.parse("source=src19/**\n_SUCCESS\n**/.*\n.*"))
    found = folder.read(spark, path, config).unionByName(folder.read(spark, f"{path}/source=src1"))
    text = F.coalesce(F.make_valid_utf8(F.col("content").cast("string")), F.lit(""))
    source = F.regexp_extract("file", r"source=([^/]*)", 1)
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return found.groupBy(source.alias("source")).agg(F.sum(lines).cast("long").alias("lines"), F.sum(F.length(text)).cast("long").alias("chars"), F.count("error").alias("errors"))
