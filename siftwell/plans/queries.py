"""The registered queries: each with DuckDB SQL for the same rows, written from the semantics and not from the plan."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.functions.catalog import PATTERN_RULES, RULES, Rule
from siftwell.operators import aggregate, detect, enrich, policy
from siftwell.operators.indexed import indexed_findings
from siftwell.operators.lines import split_lines, windows
from siftwell.plans import fixtures, report
from siftwell.plans.fixtures import literal
from siftwell.plans.scan import scan
from siftwell.sources import rule_pack
from siftwell.sources.config import IgnoreSpec, ScanConfig, custom_rules
from siftwell.sources.staged import new_path
from siftwell.streaming.stream import best_findings, read_latest, write_latest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
IGNORES = "# generated\ntest/**\n!test/keep.js\nnode_modules/**\n*.min.js\n[rule:token-assignment] src0/**\n"


def query(sql: str | None = None) -> Callable:
    """Registers a function; one without parameters for folder takes the session only."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f if len(inspect.signature(f).parameters) == 2 else lambda spark, sf_dir: f(spark)
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


#: A table is dealt evenly to tasks of about this size, at least two a core: row groups may be few and large.
TASK_BYTES = 16 << 20


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str, deal: bool = True) -> DataFrame:
    """Only the columns that are needed. What is shuffled anyway before it costs anything needn't be dealt."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if not deal:
        return df.select(*columns)
    n_bytes = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.select(*columns).repartition(max(2 * spark.sparkContext.defaultParallelism, -(-n_bytes // TASK_BYTES)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents", "doc_id", "source", "text")
    return rows.select("doc_id", F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("file"), F.col("text").alias("content"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages", "page_id", "html").select(F.col("page_id").alias("doc_id"), F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("file"), F.col("html").alias("content"))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    key = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return rows.select(F.col("conv_id").alias("doc_id"), key.alias("file"), F.col("text").alias("content"))


FILES_SQL = {
    "documents": "select doc_id, source || '/' || doc_id || '.txt' as file, coalesce(text, '') as content from documents",
    "pages": "select page_id as doc_id, page_id || '.html' as file, coalesce(html, '') as content from pages",
    "chats": "select conv_id as doc_id, conv_id || '/' || turn as file, coalesce(text, '') as content from conversations",
}


def lines_sql(files: str) -> str:
    """CTEs: f (files), l (lines), w (windows of them)."""
    return f"""f as ({files}), l as (
            select doc_id, file, generate_subscripts(string_split(content, chr(10)), 1) as line_number, unnest(string_split(content, chr(10))) as line from f
        ), w as (
            select doc_id, file, line_number, line, 0 as shift from l where length(line) <= 16384
            union all
            select doc_id, file, line_number, substr(line, shift::bigint + 1, 16384) as line, shift from (
                select *, unnest(generate_series(0, ceil((length(line) - 16384) / 15360.0)::bigint * 15360, 15360)) as shift from l where length(line) > 16384
            ) where regexp_matches(substr(line, shift::bigint + 1, 16384), '[A-Z0-9"''`:=/_@.-]')
        )"""


def hits_sql(source: str = "w", keys: str = "doc_id, file", rules: tuple[Rule, ...] = PATTERN_RULES) -> str:
    """CTE h: matches by rule, with offsets summed from the pieces between them."""
    parts = [
        f"select {keys}, line_number, shift, line, {r.ord} as ord, {literal(r.id)} as rule_id, {literal(r.severity)} as severity, {literal(r.category)} as category,"
        f" regexp_extract_all(line, {literal(r.re2())}) as ms, regexp_extract_all(line, {literal(r.re2())}, {r.group}) as ss, regexp_split_to_array(line, {literal(r.re2())}) as gaps"
        f" from {source} where regexp_matches(line, {literal(r.re2())})"
        for r in rules
    ]
    return f"""m as ({" union all ".join(parts)}), n as (select *, unnest(range(1, len(ms) + 1)) as k from m), h as (
            select {keys}, line_number, shift, k, ord, rule_id, severity, category, ms[k] as match, ss[k] as secret, length(ms[k]) as match_length,
                (shift + list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0))::bigint as match_start
            from n
        ), d as (
            select distinct on ({keys}, line_number, match_start, match_length) * from h
            order by {keys}, line_number, match_start, match_length, case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 else 1 end desc, ord
        )"""


SPAN = ("doc_id", "line_number", "rule_id", "severity", "match", "secret", "match_start", "match_length")


def spans(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.col("line_number").cast("long").alias("line_number"), "rule_id", "severity", "match", "secret", F.col("match_start").cast("long").alias("match_start"), F.col("match_length").cast("long").alias("match_length"))


def spans_sql(name: str) -> str:
    return f"with {lines_sql(FILES_SQL[name])}, {hits_sql()} select doc_id, line_number::bigint as line_number, rule_id, severity, match, secret, match_start, match_length::bigint as match_length from d"


def patterns(files: DataFrame) -> DataFrame:
    """Deduplicated pattern findings of single lines."""
    found = detect.pattern_findings(windows(split_lines(files, ("doc_id", "file"))))
    return detect.dedup(found, ("doc_id", "file"))


@query(f"""with {lines_sql(FILES_SQL["documents"])}, {hits_sql()}
    select r.rule_id, r.severity, count(d.doc_id)::bigint as n_findings, count(distinct d.file)::bigint as n_files
    from (values {", ".join(f"({literal(r.id)}, {literal(r.severity)})" for r in RULES)}) as r(rule_id, severity) left join d on d.rule_id = r.rule_id group by 1, 2""")
def rule_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule with its findings, zero where there are none."""
    found = patterns(documents(spark, sf_dir)).groupBy("rule_id").agg(F.count("*").alias("n"), F.count_distinct("file").alias("f"))
    zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return enrich.rules(spark).join(found, "rule_id", "left").select("rule_id", "severity", zero(F.col("n"), "n_findings"), zero(F.col("f"), "n_files"))


@query("""select source, count(*)::bigint as files, sum(len(string_split(coalesce(text, ''), chr(10))))::bigint as lines,
    max(list_max(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: length(x))))::bigint as longest from documents group by 1""")
def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    return read(spark, sf_dir, "documents", "source", "text").groupBy("source").agg(
        F.count("*").alias("files"), F.sum(F.size(lines)).alias("lines"), F.max(F.array_max(F.transform(lines, F.length))).cast("long").alias("longest"))


@query(f"with {lines_sql(FILES_SQL['pages'])} select doc_id, line_number::bigint as line_number, shift::bigint as shift, length(line)::bigint as n from w where length(line) > 1000 or shift > 0")
def long_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows(split_lines(pages(spark, sf_dir), ("doc_id",))).filter((F.length("line") > 1000) | (F.col("shift") > 0))
    return rows.select("doc_id", F.col("line_number").cast("long").alias("line_number"), F.col("shift").cast("long").alias("shift"), F.length("line").cast("long").alias("n"))


@query(spans_sql("documents"))
def pattern_scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(patterns(documents(spark, sf_dir)))


@query(spans_sql("pages"))
def pattern_scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(patterns(pages(spark, sf_dir)))


@query(spans_sql("chats"))
def pattern_scan_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(patterns(chats(spark, sf_dir)))


QUOTED_SQL = """'"[^''"`\\n]{20,}"|''[^''"`\\n]{20,}''|`[^''"`\\n]{20,}`'"""
CANDIDATES = f"""c as (
        select doc_id, line_number, k, ms[k][2:-2] as text, (shift + list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0))::bigint as start
        from (select *, unnest(range(1, len(ms) + 1)) as k from (
            select *, regexp_extract_all(line, {QUOTED_SQL}) as ms, regexp_split_to_array(line, {QUOTED_SQL}) as gaps from w where regexp_matches(line, {QUOTED_SQL})))
    )"""
ENTROPY_SQL = """(select round(-sum(p * log2(p)), 6) from (select count(*) / length(text)::double as p from (select unnest(string_split(text, '')) as ch) group by ch))"""
REJECT_SQL = {
    "short": "length(text) < 20", "url": "starts_with(text, 'http://') or starts_with(text, 'https://')", "tag": "starts_with(text, '<') and ends_with(text, '>')",
    "markup": "contains(text, '<!DOCTYPE') or contains(text, '<?xml')", "code": "contains(text, 'function ') or contains(text, 'class ')", "interpolation": "contains(text, '${')",
    "uuid": "regexp_full_match(text, '(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}')",
    "path": "(starts_with(text, '/') or contains(text, '://')) and length(text) - length(replace(text, '/', '')) >= 2",
    "segments": "length(text) - length(replace(text, '/', '')) >= 2 and len(list_filter(string_split(text, '/'), lambda x: length(x) >= 16 and regexp_matches(x, '[0-9]') and regexp_full_match(x, '[A-Za-z0-9+=._-]+'))) = 0",
    "prose": "(length(text) - length(replace(text, ' ', '')))::double / length(text) > 0.15",
    "words": "length(array_to_string(regexp_extract_all(text, '[a-z]{3,}'), '')) > length(text) * 0.6::double",
}


@query(f"with {lines_sql(FILES_SQL['documents'])}, {CANDIDATES} select doc_id, line_number::bigint as line_number, start, text from c")
def entropy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detect.entropy_candidates(windows(split_lines(documents(spark, sf_dir), ("doc_id",))))
    return rows.select("doc_id", F.col("line_number").cast("long").alias("line_number"), (F.col("start") + F.col("shift")).cast("long").alias("start"), "text")


@query(f"with {lines_sql(FILES_SQL['documents'])}, {CANDIDATES} select doc_id, line_number::bigint as line_number, text, {ENTROPY_SQL} as bits from c")
def shannon_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detect.entropy_candidates(windows(split_lines(documents(spark, sf_dir), ("doc_id",))))
    return rows.select("doc_id", F.col("line_number").cast("long").alias("line_number"), "text", F.round(T.shannon_entropy(F.col("text")), 6).alias("bits"))


@query(f"""with {lines_sql(FILES_SQL['pages'])}, {CANDIDATES} select text, count(*)::bigint as n, {", ".join(f"any_value({v}) as is_{k}" for k, v in REJECT_SQL.items())} from c group by text""")
def should_scan_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detect.entropy_candidates(windows(split_lines(pages(spark, sf_dir), ("doc_id",)))).groupBy("text").agg(F.count("*").alias("n"))
    return rows.select("text", "n", *(c.alias(f"is_{k}") for k, c in T.entropy_rejections(F.col("text")).items()))


@query(f"""with {lines_sql(FILES_SQL['documents'])}, {CANDIDATES}, e as (select *, {ENTROPY_SQL} as bits from c where not ({" or ".join(f"({v})" for v in REJECT_SQL.values())}))
    select doc_id, line_number::bigint as line_number, text, bits from e where bits >= 3.8""")
def entropy_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detect.entropy_findings(windows(split_lines(documents(spark, sf_dir), ("doc_id",))), F.lit(T.THRESHOLD_DIRECT))
    return rows.select("doc_id", F.col("line_number").cast("long").alias("line_number"), F.col("secret").alias("text"), F.round("entropy", 6).alias("bits"))


BASE_SQL = "regexp_extract(path, '[^/]*$')"
EXT_SQL = f"regexp_extract({BASE_SQL}, '^[^.].*?(\\.[^.]*)$', 1)"


#: A comment sign of two characters, the word, maybe a colon with a reason, maybe the end of a block comment.
IGNORED_SQL = "regexp_matches(line, '/[/*]\\s*scan-ignore(:\\s*.+)?\\s*(\\*/)?\\s*$')"


def found_sql(select: str) -> str:
    return f"with {lines_sql(FILES_SQL['documents'])}, {hits_sql()} {select}"


@query(found_sql("select doc_id, line_number::bigint as line_number, rule_id from d where not (rule_id = 'token-assignment' and starts_with(file, 'src0/'))"))
def rule_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = policy.apply(patterns(documents(spark, sf_dir)), ScanConfig(ignore=IgnoreSpec.parse(IGNORES)))
    return kept.select("doc_id", F.col("line_number").cast("long").alias("line_number"), "rule_id")


@query(found_sql("select doc_id, line_number::bigint as line_number, rule_id, case rule_id when 'token-assignment' then 'low' else severity end as severity from d where rule_id <> 'secret-assignment'"))
def severity_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = policy.apply(patterns(documents(spark, sf_dir)), ScanConfig(severity={"token-assignment": "low", "secret-assignment": "ignore"}))
    return kept.select("doc_id", F.col("line_number").cast("long").alias("line_number"), "rule_id", "severity")


@query(found_sql("select doc_id, line_number::bigint as line_number, rule_id, case when length(secret) <= 8 then '****' else secret[1:4] || '****' || secret[-4:] end as redacted, sha256(secret)[1:12] as secret_hash from d"))
def redacted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.redacted(patterns(documents(spark, sf_dir))).select("doc_id", F.col("line_number").cast("long").alias("line_number"), "rule_id", "redacted", "secret_hash")


@query(found_sql("""select string_split(file, '/')[1] as source, count(*) filter (severity = 'critical')::bigint as critical, count(*) filter (severity = 'high')::bigint as high,
    count(*) filter (severity = 'medium')::bigint as medium, count(*) filter (severity = 'low')::bigint as low, count(*)::bigint as total, count(distinct file)::bigint as files from d group by 1"""))
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.severity_counts(patterns(documents(spark, sf_dir)).withColumn("source", F.substring_index("file", "/", 1)), "source")


@query(found_sql("select rule_id, severity, count(*)::bigint as n, count(distinct file)::bigint as files from d group by 1, 2"))
def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.rule_counts(patterns(documents(spark, sf_dir)))


@query(found_sql("select category, count(*)::bigint as n from d group by 1"))
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.broadcast(enrich.rules(spark).select("rule_id", "category"))
    return patterns(documents(spark, sf_dir)).join(names, "rule_id").groupBy("category").agg(F.count("*").alias("n"))


CONCAT_SQL = """'"[^''"]{4,}"\\s*\\+\\s*"[^''"]{4,}"|''[^''"]{4,}''\\s*\\+\\s*''[^''"]{4,}'''"""


FULL = ScanConfig(
    entropy_threshold=T.THRESHOLD_DIRECT, ignore=IgnoreSpec.parse("skip/**\nsrc19/**\n[rule:token-assignment] src1/**"), severity={"aws-access-key-id": "low", "env-var-secret": "ignore"},
    rules=custom_rules([{"id": "own-mailbox", "name": "Mailbox", "severity": "high", "pattern": r"([a-z0-9.]+)@mail[0-9]\.example\.com"}])[0],
)
FULL_FILES = f"""select 0 as doc_id, file, content from (select file, content from ({FILES_SQL["documents"]}) union all select file, content from ({FILES_SQL["pages"]})
    union all select file, content from {fixtures.sql("sources")}) where not starts_with(file, 'skip/') and not starts_with(file, 'src19/')"""
JOINED_TEXT = """replace(replace(regexp_replace(m, '["'']\\s*\\+\\s*["'']', ''), '"', ''), '''', '')"""


def across_sql(kind: int, pattern: str, text: str) -> str:
    """Matches of a pattern in whole files, with the number of lines before (row) and the text that they stand for."""
    return f"""select file, {kind} as kind, k, text, row, case when row > 0 then string_split(content, chr(10))[row] else '' end as context from (
            select *, {text} as text, length(before) - length(replace(before, chr(10), '')) as row from (
                select *, ms[k] as m, array_to_string(list_concat(list_transform(range(1, k), lambda i: gaps[i] || ms[i]), [gaps[k]]), '') as before from (
                    select *, unnest(range(1, len(ms) + 1)) as k from (
                        select file, content, regexp_extract_all(content, {pattern}) as ms, regexp_split_to_array(content, {pattern}) as gaps from f where length(content) <= 512000 and regexp_matches(content, {pattern})))))"""


def full_sql(files: str = FULL_FILES) -> str:
    """The scan from the semantics: single lines, and what spans lines; of one span the most severe finding, then the first emitted."""
    rank = "case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 else 1 end"
    ext = EXT_SQL.replace("path", "file")
    limit = f"(case when regexp_matches(file, '\\.(min|bundle)\\.(js|css)$') then 5.0 when {ext} in ({', '.join(map(literal, T.CONFIG_EXTENSIONS))}) or regexp_matches(file, '(^|/)\\.env(\\.|$)') then 4.5 else 3.8 end)"
    every = " ".join(f"when regexp_matches(text, {literal(r.re2())}) then {r.ord}" for r in PATTERN_RULES)
    secret = " ".join(f"when {r.ord} then coalesce(nullif(regexp_extract(text, {literal(r.re2())}, {r.group}), ''), regexp_extract(text, {literal(r.re2())}))" for r in PATTERN_RULES)
    rules = ", ".join(f"({r.ord}, {literal(r.id)}, {literal(r.severity)})" for r in RULES)
    entropy_rule = next(r.ord for r in RULES if not r.pattern)
    assigned = "regexp_matches(context, '[=:]\\s*$|(?i)(key|secret|password|token|credential|api[_-]?key)\\s*[=:]')"
    trimmed = "regexp_replace(raw, '^\\s+|\\s+$', '', 'g')"
    return f"""with {lines_sql(files)}, v as (select * from w where not {IGNORED_SQL}), {hits_sql("v", rules=(*PATTERN_RULES, *FULL.rules))},
        {CANDIDATES.replace("select doc_id,", "select file, shift,").replace("from w where", "from v where")},
        e as (select *, {ENTROPY_SQL} as bits from c where not ({" or ".join(f"({x})" for x in REJECT_SQL.values())})),
        bl as (select file, unnest(string_split(content, chr(10))) as raw, generate_subscripts(string_split(content, chr(10)), 1) as pos, content from f where length(content) <= 512000),
        bt as (select *, pos - row_number() over (partition by file order by pos) as island, {trimmed} as line from bl where regexp_full_match({trimmed}, '[A-Za-z0-9+/=]{{20,}}')),
        a as (
            select * from ({across_sql(0, "'`[^`]{20,}`'", "regexp_replace(m[2:-2], '\\$\\{[^}]*\\}', '', 'g')")}) where length(text) >= 20
            union all
            select * from ({across_sql(1, CONCAT_SQL, JOINED_TEXT)}) where length(text) >= 20
            union all
            select file, 2, min(pos), string_agg(line, '' order by pos), min(pos) - 1, case when min(pos) > 1 then string_split(any_value(content), chr(10))[min(pos) - 1] else '' end from bt group by file, island having count(*) >= 3
        ), x as (select *, case {every} end as first, {ENTROPY_SQL} as bits from a), found as (
            select file, line_number, rule_id, severity, 'pattern' as type, coalesce(nullif(secret, ''), match) as secret, match_start, match_length, shift, case when ord >= 1000 then 2 else 1 end as pass, ord, k from h
            union all
            select file, line_number, 'high-entropy-string', 'medium', 'entropy', text, start, length(text) + 2, shift, 3, 0, k from e where bits >= {limit}
            union all
            select file, row + 1, r.id, r.severity, case when first is null then 'multiline-entropy' else 'multiline-pattern' end, case first {secret} else text end, null, null, kind, 0, 0, k
            from x join (values {rules}) as r(ord, id, severity) on r.ord = coalesce(first, {entropy_rule}) where first is not null or (bits >= {limit} and {assigned})
        ), best as (
            select distinct on (file, line_number, match_start, match_length) * from found order by file, line_number, match_start, match_length, {rank} desc, shift, pass, ord, k
        ) select file, line_number::bigint as line_number, rule_id, case rule_id when 'aws-access-key-id' then 'low' else severity end as severity, type, match_start::bigint as match_start, match_length::bigint as match_length,
            case when length(secret) <= 8 then '****' else secret[1:4] || '****' || secret[-4:] end as redacted, sha256(secret)[1:12] as secret_hash
        from best where rule_id <> 'env-var-secret' and not (rule_id = 'token-assignment' and starts_with(file, 'src1/'))"""


@query(full_sql())
def full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything at once: patterns, custom rules, entropy and secrets across lines, over documents, pages and the fixture sources, with ignores and overrides."""
    rows = documents(spark, sf_dir).select("file", "content").unionByName(pages(spark, sf_dir).select("file", "content")).unionByName(fixtures.table(spark, "sources"))
    long = lambda c: F.col(c).cast("long").alias(c)
    return report.redacted(scan(rows, FULL)).select("file", long("line_number"), "rule_id", "severity", "type", long("match_start"), long("match_length"), "redacted", "secret_hash")


@query(found_sql("select file, line_number::bigint as line_number, '::error file=' || file || ',line=' || line_number || '::Token Assignment (' || severity || ')' as line from d where rule_id = 'token-assignment'"))
def ci_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = patterns(documents(spark, sf_dir)).filter("rule_id = 'token-assignment'")
    return report.annotations(found).select("file", F.col("line_number").cast("long").alias("line_number"), "line")


@query(full_sql(f"select 0 as doc_id, file, content from ({FILES_SQL['documents']}) where not starts_with(file, 'skip/') and not starts_with(file, 'src19/')"))
def streaming_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scan as a stream over the folder, run until it has read what is there; what it says is what the scan of the table says."""
    out = new_path(spark, "stream")
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parquet*")
    at = F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=F.col("doc_id").cast("int"))
    files = rows.select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("file"), F.col("text").alias("content"), at.alias("at"))
    found = best_findings(files, FULL, at="at", late="36500 days")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    write_latest(found, f"{out}/rows", f"{out}/state").awaitTermination()
    long = lambda c: F.col(c).cast("long").alias(c)
    return report.redacted(read_latest(spark, f"{out}/rows", ddl)).select("file", long("line_number"), "rule_id", "severity", "type", long("match_start"), long("match_length"), "redacted", "secret_hash")


#: A pack of 5,000 rules: a rule's literal is its number in letters, behind which a sign must stand.
PACK_SIZE, PACK_STEP = 5000, 7
PACK_SQL = f"""(select 'tail-' || i as rule_id, chr((97 + n // 676)::int) || chr((97 + n // 26 % 26)::int) || chr((97 + n % 26)::int) as tail from (select i, i * {PACK_STEP} % 17576 as n from range({PACK_SIZE}) r(i)))"""


def large_pack() -> tuple[Rule, ...]:
    letters = lambda n: "".join(chr(97 + n // k % 26) for k in (676, 26, 1))
    rows = [{"id": f"tail-{i}", "pattern": f"{letters(i * PACK_STEP % 17576)}[.,;:!?]", "severity": "low"} for i in range(PACK_SIZE)]
    return rule_pack.load(json.dumps(rows))[0]


@query(f"""with {lines_sql(FILES_SQL["documents"])}, x as (select doc_id, unnest(regexp_extract_all(line, '[a-z]{{3}}[.,;:!?]')) as match from w)
    select rule_id, count(*)::bigint as n, count(distinct doc_id)::bigint as files from x join {PACK_SQL} on tail = match[1:3] group by 1""")
def pack_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match of the rules of a large pack in the windows of all lines."""
    found = indexed_findings(windows(split_lines(documents(spark, sf_dir), ("doc_id",))), large_pack())
    return found.groupBy("rule_id").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("files"))
