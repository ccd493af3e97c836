"""What large inputs need: one pass over what is dear, tables dealt evenly, and no result that depends on the way taken."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siftwell.functions.catalog import DECLARED_CASE, PATTERN_RULES, REFERENCE_CASE, necessary_literals, prefilter
from siftwell.operators import detect, exposure, indexed
from siftwell.operators.running import running_sums
from siftwell.plans import derived, queries, report, table_queries
from siftwell.sources.config import custom_rules

LINES = "commit_hash string, file string, change int, content string"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("few", [0, 7, 1000])
def test_secret_changes_whatever_the_number_of_secrets(spark, monkeypatch, few):
    """files of few secrets and of many, by either way."""
    monkeypatch.setattr(exposure, "FEW", few)
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abé") for _ in range(n))
    secrets = [(f"f{i % 3 if i < 30 else 3}", text(rng.randint(8, 12))) for i in range(33)]
    lines = []
    for i in range(300):
        f, own = rng.choice(secrets)
        lines.append((f"c{i % 40}", f, rng.choice([1, -1]), text(rng.randint(0, 6)) + rng.choice([own, own * 2, own[:-1], ""]) + text(rng.randint(0, 9))))
    got = exposure.secret_changes(spark.createDataFrame(secrets, "file string, secret string"), spark.createDataFrame(lines, LINES))
    want = {}
    for f, s in set(secrets):
        for c, g, sign, content in lines:
            if f == g:
                want[c, f, s] = want.get((c, f, s), 0) + sign * content.count(s)
    assert {tuple(r[:3]): r[3] for r in got.collect()} == {k: v for k, v in want.items() if v}


def test_lines_of_a_file_with_few_secrets_are_not_shingled(spark):
    """F1, F2, F3."""
    got = exposure.secret_changes(spark.createDataFrame([("f", "tok_ABCDEFGH")], "file string, secret string"), spark.createDataFrame([("c", "f", 1, "x")], LINES))
    assert "array_min" not in plan(got)


@pytest.mark.parametrize("mode", [REFERENCE_CASE, DECLARED_CASE])
def test_search_for_literals_lets_through_what_the_prefilter_does(spark, mode):
    """and it has no alternation to try at each character."""
    rng = random.Random(5)
    literals = sorted({x for r in PATTERN_RULES for x in necessary_literals(r.pattern)})
    lines = [(rng.choice("ab_-.=é") + rng.choice(literals)[: rng.randint(1, 30)] + rng.choice(["", "_", "-", "x.y"]),) for _ in range(2000)]
    rows = spark.createDataFrame(lines, "line string")
    wanted = {x.lower() for x in literals} if mode == DECLARED_CASE else set(literals)
    line = F.lower("line") if mode == DECLARED_CASE else F.col("line")
    kept = [r["line"] for r in rows.filter(detect.holds_any(line, wanted)).collect()]
    assert sorted(kept) == sorted(x for (x,) in lines if re.search(prefilter(PATTERN_RULES, mode), x))
    found = detect.pattern_findings(rows.withColumns({"line_number": F.lit(1), "shift": F.lit(0)}), case_mode=mode)
    assert "AccountKey\\" not in plan(found)


def test_rules_with_and_without_literals_together(spark):
    rules = custom_rules([{"id": "word", "name": "W", "severity": "low", "pattern": "[0-9]{4}|[x-z]{3}"}, {"id": "key", "name": "K", "severity": "low", "pattern": "key=([a-z]+)"}])[0]
    rows = spark.createDataFrame([(1, "key=abc 1234 xyz", 0), (2, "nothing", 0), (3, "key=zzz", 7)], "line_number int, line string, shift int")
    found = detect.pattern_findings(rows, rules).select("line_number", "rule_id", "match", "secret", "match_start").collect()
    assert {tuple(r) for r in found} == {(1, "word", "1234", "1234", 8), (1, "word", "xyz", "xyz", 13), (1, "key", "key=abc", "abc", 0), (3, "word", "zzz", "zzz", 11), (3, "key", "key=zzz", "zzz", 7)}


def test_a_pattern_is_run_once_over_a_line(spark):
    """F5, F15, F16: it ran again for each match."""
    rows = spark.createDataFrame([("'" + "a" * 20 + "' é '" + "b" * 21 + "'",)], "line string").withColumn("m", detect.occurrences(F.col("line"), F.lit(detect.QUOTED)))
    assert plan(rows).count("regexp_extract_all") == 1
    assert [tuple(x) for x in rows.first()["m"]] == [(0, "'" + "a" * 20 + "'", "'" + "a" * 20 + "'", 0), (1, "'" + "b" * 21 + "'", "'" + "b" * 21 + "'", 25)]


def test_a_table_of_few_row_groups_is_dealt_evenly(spark, tmp_path, monkeypatch):
    """F14, F16, F18: tables of over 256 MB were read by one task a row group."""
    spark.range(1000).selectExpr("id as doc_id", "repeat(sha2(cast(id as string), 256), 20) as text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(queries, "TASK_BYTES", 1000)
    rows = queries.read(spark, str(tmp_path), "documents", "doc_id", "text")
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) > 2 * spark.sparkContext.defaultParallelism
    assert max(sizes) < 1000 / len(sizes) * 3 + 3


def test_a_pack_looks_runs_up_without_cutting_lines_into_characters(spark):
    """F6."""
    rules = custom_rules([{"id": "tail", "name": "T", "severity": "low", "pattern": "aéb[.,]"}, {"id": "end", "name": "E", "severity": "low", "pattern": "xyz!"}])[0]
    rows = spark.createDataFrame([(1, "😀aéb. xyz! aéb,", 0), (2, "aé\nb", 0), (3, "", 0)], "line_number int, line string, shift int")
    found = indexed.indexed_findings(rows, rules)
    assert {tuple(r) for r in found.select("line_number", "rule_id", "match", "match_start").collect()} == {(1, "tail", "aéb.", 1), (1, "tail", "aéb,", 11), (1, "end", "xyz!", 6)}
    assert "crc32" not in plan(found)


@pytest.mark.parametrize("made", [
    lambda f: report.sarif_document(f, "t", "1"), lambda f: report.html_document(f, "d"), lambda f: report.markdown_document(f, "d"), lambda f: running_sums(f, [F.col("file")]),
], ids=["sarif", "html", "markdown", "sums"])
def test_findings_are_made_once_for_a_report(spark, made):
    """F7, F8, F9."""
    seen = spark.sparkContext.accumulator(0)
    rows = [(f"f{i}", i, 0, "token-assignment", "T", "low") for i in range(100)]

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    found = spark.createDataFrame(rows, "file string, line_number int, match_start int, rule_id string, rule_name string, severity string")
    made(found.mapInArrow(count, found.schema)).write.format("noop").mode("overwrite").save()
    assert seen.value == 100


def test_findings_are_made_once_for_verification(spark, monkeypatch):
    """F13, F17."""
    made = []
    monkeypatch.setattr(table_queries, "stage", lambda df, name: made.append(name) or df)
    table_queries.verified(spark, "/root/testdata/sf0.001")
    assert made == ["findings"]


def test_versions_are_shuffled_once(spark):
    """by their chain alone, which deals them."""
    assert "Repartition" not in plan(derived.versions(spark, "/root/testdata/sf0.001"))
