"""Inputs that Spark derives from the given tables, each with the same table as a DuckDB subquery: files with planted samples of the rules, paths of many kinds,
an audit log, commits, rule packs. They grow with ``documents``; what a document gets depends on its doc_id and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators import detect
from siftwell.operators.lines import split_lines, windows
from siftwell.plans import fixtures
from siftwell.plans.fixtures import literal
from siftwell.plans.queries import documents, hits_sql, lines_sql, read


def _values(rows: list[tuple], names: str) -> str:
    return f"(values {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) as v({names})"


# every fourth document ends with a line that one of the rules matches, bare, twice or quoted

SAMPLES = [(i, line) for i, (_, line) in enumerate(fixtures.rule_lines())]
PLANTED = f"""(select doc_id, source || '/' || doc_id || '.txt' as file, coalesce(text, '') || coalesce(chr(10) || sample, '') as content
    from documents left join (select * from {_values(SAMPLES, 'n, sample')}) s on doc_id % 4 = 0 and s.n = doc_id // 4 % {len(SAMPLES)})"""


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = F.broadcast(spark.createDataFrame(SAMPLES, "n long, sample string"))
    n = F.when(F.col("doc_id") % 4 == 0, F.floor(F.col("doc_id") / 4) % len(SAMPLES)).alias("n")
    rows = documents(spark, sf_dir).select("*", n).join(samples, "n", "left")
    return rows.select("doc_id", "file", F.concat(F.coalesce("content", F.lit("")), F.coalesce(F.concat(F.lit("\n"), "sample"), F.lit(""))).alias("content"))


def planted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.dedup(detect.pattern_findings(windows(split_lines(planted(spark, sf_dir), ("doc_id", "file")))), ("doc_id", "file"))


def planted_sql(select: str, more: str = "") -> str:
    """CTEs f, l, w, m, n, h (all matches) and d (one a span) over the planted files, then ``more``, then ``select``."""
    return f"with {lines_sql(f'select * from {PLANTED}')}, {hits_sql()}{', ' + more if more else ''} {select}"


# a document's place in a project, by its number

PATHS = [
    (i, t) for i, t in enumerate((
        "src/app#.js", "src/app#.min.js", ".env.#", ".env", "config/app#.yml", "a/b/c#.properties", "web/site#.bundle.css", "Dockerfile", "x/Dockerfile.d#", "main#.py", "cmd/main#.go",
        "test/fixture#.js", "test/keep.js", "node_modules/a/b#.js", "top#.min.js", "deep/top#.min.js", "infra/main#.tf", "data#.json", "README#", ".hidden#", "web/a#.ts", "r#.rb", "J#.java",
    ))
]
PATHS_SQL = f"(select doc_id, source, text, replace(template, '#', doc_id::varchar) as path from documents join (select * from {_values(PATHS, 'n, template')}) p on p.n = doc_id % {len(PATHS)})"


def paths(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    templates = F.broadcast(spark.createDataFrame(PATHS, "n long, template string"))
    rows = read(spark, sf_dir, "documents", "doc_id", *columns).withColumn("n", F.col("doc_id") % len(PATHS)).join(templates, "n")
    return rows.select("doc_id", *columns, F.replace("template", F.lit("#"), F.col("doc_id").cast("string")).alias("path"))


# rows of a fixture, one for each document, with the document's number


def with_fixture(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Each document's doc_id and ``columns`` with the fixture's row whose place is doc_id modulo their number."""
    rows = fixtures.FIXTURES[name][1]
    own = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_n long, {fixtures.FIXTURES[name][0]}")
    return read(spark, sf_dir, "documents", "doc_id", *columns).withColumn("_n", F.col("doc_id") % len(rows)).join(F.broadcast(own), "_n").drop("_n")


def with_fixture_sql(name: str, columns: str = "doc_id") -> str:
    rows = fixtures.FIXTURES[name][1]
    names = [c.split()[0] for c in fixtures.FIXTURES[name][0].split(", ")]
    numbered = _values([(i, *r) for i, r in enumerate(rows)], ", ".join(["_n", *names]))
    return f"(select {columns}, v.* exclude (_n) from documents join (select * from {numbered}) v on _n = doc_id % {len(rows)})"


SOURCES = f"(select doc_id || '-' || file as file, coalesce(text, '') || chr(10) || content as content from {with_fixture_sql('sources', 'doc_id, text')})"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_fixture(spark, sf_dir, "sources", "text")
    return rows.select(F.concat_ws("-", F.col("doc_id").cast("string"), "file").alias("file"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), "content").alias("content"))


# a scan's log: an entry a document

START = "2024-01-01 00:00:00"
AUDIT = f"""(select doc_id as idx, strftime(timestamp '{START}' + to_minutes(doc_id * 37), '%Y-%m-%dT%H:%M:%SZ') as timestamp, case when doc_id % 4 = 3 then '=cmd' else 'c' || doc_id end as "commitHash",
    source || '/' || doc_id || case when doc_id % 5 = 0 then ',b.js' else '.js' end || case when doc_id % 3 = 0 then ';y.js' else '' end as files,
    doc_id % 2 + doc_id % 3 + doc_id % 5 + doc_id % 7 as "findingCount", doc_id % 2 as critical, doc_id % 3 as high, doc_id % 5 as medium, doc_id % 7 as low,
    case doc_id % 4 when 0 then 'blocked' when 1 then 'passed' when 2 then 'bypassed' end as "userDecision", case doc_id % 3 when 0 then 'none' when 1 then 'fixed' else 'ignored' end as action from documents)"""


def minutes_after(col: Column) -> Column:
    return F.lit(START).cast("timestamp") + F.make_interval(mins=col.cast("int"))


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda k: F.col("doc_id") % k
    rows = read(spark, sf_dir, "documents", "doc_id", "source")
    name = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.when(n(5) == 0, ",b.js").otherwise(".js"))
    return rows.select(
        F.col("doc_id").alias("idx"), F.date_format(minutes_after(F.col("doc_id") * 37), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.when(n(4) == 3, "=cmd").otherwise(F.concat(F.lit("c"), F.col("doc_id").cast("string"))).alias("commitHash"),
        F.when(n(3) == 0, F.array(name, F.lit("y.js"))).otherwise(F.array(name)).alias("filesScanned"), (n(2) + n(3) + n(5) + n(7)).alias("findingCount"),
        F.struct(n(2).alias("critical"), n(3).alias("high"), n(5).alias("medium"), n(7).alias("low")).alias("severityCounts"),
        F.when(n(4) == 0, "blocked").when(n(4) == 1, "passed").when(n(4) == 2, "bypassed").alias("userDecision"), F.when(n(3) == 0, "none").when(n(3) == 1, "fixed").otherwise("ignored").alias("action"),
    )


# commits: of each four documents in a row, each is a new version of one file, its lines against those of the one before. The sample that ends two versions in a row
# is the same in both (removed and added again), so it moves without a change

VERSIONS = f"""(select doc_id, doc_id // 4 as chain, 'd' || doc_id // 4 || '.txt' as file, coalesce(text, '') || chr(10) || sample as content,
    lag(coalesce(text, '') || chr(10) || sample) over (partition by doc_id // 4 order by doc_id) as before, doc_id % 5 <> 0 as is_remote
    from documents join (select * from {_values(SAMPLES, 'n, sample')}) s on s.n = doc_id // 2 % {len(SAMPLES)})"""
#: hash, date, author and subject of a commit by its document's number
COMMIT_SQL = f"sha256('c' || doc_id)[1:40] as commit_hash, timestamp '{START}' + to_minutes(doc_id) as committed_at, 'author' || doc_id % 9 as author, 'Version ' || doc_id as subject"
#: commit_hash, file, line_number and content of each added line: the first line, that names the file, stays
ADDED_SQL = f"""(select doc_id, sha256('c' || doc_id)[1:40] as commit_hash, file, line_number + 1 as line_number, content from (
        select doc_id, file, unnest(string_split(content, chr(10))) as content, generate_subscripts(string_split(content, chr(10)), 1)::bigint as line_number from {VERSIONS})
    union all select doc_id, sha256('c' || doc_id)[1:40], file, 1, '# ' || file from {VERSIONS} where before is null)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    samples = F.broadcast(spark.createDataFrame(SAMPLES, "n long, sample string"))
    rows = read(spark, sf_dir, "documents", "doc_id", "text", deal=False).withColumn("n", F.floor(F.col("doc_id") / 2) % len(SAMPLES)).join(samples, "n")
    chain = F.floor(F.col("doc_id") / 4)
    rows = rows.select("doc_id", chain.alias("chain"), F.concat(F.lit("d"), chain.cast("string"), F.lit(".txt")).alias("file"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), "sample").alias("content"))
    return rows.withColumn("before", F.lag("content").over(Window.partitionBy("chain").orderBy("doc_id"))).withColumn("is_remote", F.col("doc_id") % 5 != 0)


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commit_hash, committed_at, author, subject, is_remote, diff."""
    said = lambda mark, text: F.concat(F.lit(mark), F.replace(text, F.lit("\n"), F.lit(f"\n{mark}")), F.lit("\n"))
    size = lambda text: F.size(F.split(text, "\n", -1)).cast("string")
    new = F.col("before").isNull()
    head = F.concat(F.lit("diff --git a/"), "file", F.lit(" b/"), "file", F.lit("\n"), F.when(new, "new file mode 100644\n--- /dev/null").otherwise(F.concat(F.lit("--- a/"), "file")), F.lit("\n+++ b/"), "file", F.lit("\n@@ -"))
    hunk = F.concat(F.when(new, "0,0").otherwise(F.concat(F.lit("1,"), size(F.col("before")))), F.lit(" +1,"), size(F.col("content")), F.lit(" @@\n"), F.when(new, "+").otherwise(" "), F.lit("# "), "file", F.lit("\n"))
    diff = F.concat(head, hunk, F.when(new, "").otherwise(said("-", F.col("before"))), said("+", F.col("content")))
    number = F.col("doc_id").cast("string")
    return versions(spark, sf_dir).select(
        F.substring(F.sha2(F.concat(F.lit("c"), number), 256), 1, 40).alias("commit_hash"), minutes_after(F.col("doc_id")).alias("committed_at"),
        F.concat(F.lit("author"), (F.col("doc_id") % 9).cast("string")).alias("author"), F.concat(F.lit("Version "), number).alias("subject"), "is_remote", diff.alias("diff"),
    )


# rules of a pack, one a document

PACK = """(select doc_id as position, 'rule-' || doc_id as id, ['critical', 'high', 'low'][doc_id % 3 + 1] as severity, source as category, 0.5 + (doc_id * 7 % 12) / 25.0::double as confidence,
    0.9 - (doc_id * 5 % 11) / 50.0::double as detection_rate, (doc_id * 3 % 10) / 100.0::double as false_positive_rate from documents)"""


def pack_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    return read(spark, sf_dir, "documents", "doc_id", "source").select(
        n.alias("position"), F.concat(F.lit("rule-"), n.cast("string")).alias("id"), F.element_at(F.array(*map(F.lit, ("critical", "high", "low"))), (n % 3 + 1).cast("int")).alias("severity"), F.col("source").alias("category"),
        (F.lit(0.5) + (n * 7 % 12) / F.lit(25.0)).alias("confidence"), (F.lit(0.9) - (n * 5 % 11) / F.lit(50.0)).alias("detection_rate"), ((n * 3 % 10) / F.lit(100.0)).alias("false_positive_rate"),
    )


