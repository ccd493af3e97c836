import json
import os
import random
import re

from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.functions.catalog import PATTERN_RULES
from siftwell.operators import audit, detect, multiline, rewrite
from siftwell.operators.lines import OVERLAP, WINDOW, split_lines, windows
from siftwell.plans import fixtures, report
from siftwell.plans.scan import scan
from siftwell.sources import files as file_source
from siftwell.sources import audit_log, history
from siftwell.sources.config import IgnoreSpec, ScanConfig, custom_rules
from siftwell.streaming.stream import windowed_counts

KEY = fixtures.sample(r"AKIA[0-9A-Z]{16}")
RANDOM = "aB3dE6gH9jK2mN5pQ8sT1vW4yZ"  # 26 distinct characters: 4.70 bits


def files(spark, rows):
    return spark.createDataFrame(rows, "file string, content string")


def brute(line):
    """Findings of a line by Python's own engine, with ASCII classes."""
    out = []
    for rule in PATTERN_RULES:
        for m in re.finditer(rule.pattern, line, re.ASCII):
            out.append((rule.id, m[0], m[1] if rule.group else m[0], m.start()))
    return sorted(out)


def test_offsets_equal_a_plain_regex_engine(spark):
    rng = random.Random(3)
    samples = [fixtures.sample(r.pattern) for r in PATTERN_RULES]
    lines = [" ".join(rng.choice([*samples, "x", "=", "'", "id: "]) for _ in range(rng.randint(1, 5))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(lines)), "line_number long, line string").withColumn("shift", F.lit(0))
    got = {}
    for r in detect.pattern_findings(df).collect():
        got.setdefault(r["line_number"], []).append((r["rule_id"], r["match"], r["secret"], r["match_start"]))
    for i, line in enumerate(lines):
        assert sorted(got.get(i, [])) == brute(line), line


def test_entropy_by_kind_of_file(spark):
    rows = [(f, f'x = "{RANDOM}"') for f in (".env", "a.js", "a.min.js", "b.yml")]
    assert {r["file"] for r in scan(files(spark, rows)).collect()} == {".env", "b.yml"}


def test_entropy_guards(spark):
    texts = ['"123e4567-e89b-12d3-a456-426614174000"', '"/usr/local/lib/python/site/x"', '"plain words in a long sentence here"', '"https://example.com/a/b/c?q=1Aa2Bb3Cc"', "'<div class=aB3dE6gH9jK2mN5>'"]
    assert scan(files(spark, [(".env", t) for t in texts])).count() == 0
    assert scan(files(spark, [(".env", f'"a/b/{RANDOM}"')])).count() == 1


def test_case_modes(spark):
    rows = [("a", "PASSWORD = hunter2hunter2")]
    assert scan(files(spark, rows)).count() == 0
    assert scan(files(spark, rows), ScanConfig(case_mode="declared")).count() == 1


def test_ignores_and_overrides(spark):
    rows = [("test/a.js", KEY), ("src/a.js", KEY), ("src/b.js", f"{KEY} // scan-ignore"), ("src/c.js", f"{KEY} # scan-ignore")]
    found = scan(files(spark, rows), ScanConfig(ignore=IgnoreSpec.parse("test/**"), severity={"aws-access-key-id": "low"})).collect()
    assert {(r["file"], r["severity"]) for r in found} == {("src/a.js", "low"), ("src/c.js", "low")}
    assert scan(files(spark, rows), ScanConfig(ignore=IgnoreSpec.parse("[rule:aws-access-key-id] **"))).count() == 0
    assert scan(files(spark, rows), ScanConfig(severity={"aws-access-key-id": "ignore"})).count() == 0


def test_long_lines_are_windowed_without_twins(spark):
    line = "x" * 20000 + f" {KEY} " + "y" * 20000
    [r] = scan(files(spark, [("a.js", line)])).collect()
    assert r["match_start"] == 20001
    edge = "x" * (WINDOW - OVERLAP + 100) + KEY + "y" * WINDOW  # in the overlap: both windows see it
    assert scan(files(spark, [("a.js", edge)])).count() == 1
    got = windows(split_lines(files(spark, [("a", "A" * 40020)]))).collect()
    assert [r["shift"] for r in got] == [0, 15360, 30720] and len(got[-1]["line"]) == 40020 - 30720
    assert windows(split_lines(files(spark, [("a", "x" * 600_000)]))).count() == 0


def test_multiline(spark):
    found = scan(files(spark, [("a.js", f'k = "{KEY[:7]}" + "{KEY[7:]}"\n`{KEY}`')])).collect()
    assert {(r["type"], r["line_number"]) for r in found} == {("multiline-pattern", 1), ("multiline-pattern", 2), ("pattern", 2)}
    plain = files(spark, [("b.js", "'hello there ' + 'general audience'\n`a template of plain words`")])
    assert scan(plain).count() == 0
    block = "\n".join(["aB3dE6gH9jK2mN5pQ8sT1vW4yZ0cFiLoRuX7+/"] * 3)
    [r] = scan(files(spark, [("c.txt", f"secret =\n{block}")])).collect()
    assert (r["type"], r["line_number"], r["match_start"]) == ("multiline-entropy", 2, None)
    assert scan(files(spark, [("c.txt", f"nothing\n{block}")])).count() == 0
    assert multiline.base64_blocks(files(spark, [("d", block + "\n-\n" + "short")])).count() == 1


def test_custom_rules_and_empty_input(spark):
    rules, _ = custom_rules([{"id": "mine", "pattern": "zz([0-9]+)"}])
    [r] = scan(files(spark, [("a", "zz12 ")]), ScanConfig(rules=rules)).collect()
    assert (r["rule_id"], r["secret"], r["severity"]) == ("mine", "12", "medium")
    assert scan(files(spark, []), ScanConfig(rules=rules)).count() == 0
    assert scan(files(spark, [("a", None), (None, KEY)])).count() <= 1


def test_folder_source(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.txt").write_text(f"x\n{KEY}")
    (tmp_path / "big.txt").write_text("y" * 5000)
    (tmp_path / "bin").write_bytes(b"\x00" + KEY.encode())
    (tmp_path / "odd").write_bytes(b"\xff " + KEY.encode())
    config = ScanConfig(max_file_size=4096)
    raw = file_source.read_folder(spark, str(tmp_path), config)
    status = {r["file"]: r for r in file_source.file_status(raw, config).collect()}
    assert status["big.txt"]["skip_reason"] == "File size 4.9 KB exceeds limit 4 KB" and status["bin"]["is_binary"]
    assert {r["file"] for r in scan(file_source.texts(raw, config), config).collect()} == {"sub/a.txt", "odd"}
    assert {r["file"]: r["content"] is None for r in raw.collect()} == {"sub/a.txt": False, "big.txt": True, "bin": False, "odd": False}
    assert "LessThanOrEqual(length,4096)]" in raw._jdf.queryExecution().executedPlan().toString()
    for ignored in ("sub", "sub/", "s*", "sub/**", "**/a.txt"):  # what is in an ignored folder isn't visited
        names = {r["file"] for r in file_source.read_folder(spark, str(tmp_path), ScanConfig(ignore=IgnoreSpec.parse(ignored))).collect()}
        assert names == {"big.txt", "bin", "odd"}, ignored
    assert [(r["file"], r["error"]) for r in file_source.read_folder(spark, str(tmp_path / "none")).collect()] == [(str(tmp_path / "none"), "File not found")]


def test_audit_log_is_chained_and_rotates(spark, tmp_path):
    path = str(tmp_path / "audit.jsonl")
    find = [{"ruleId": "npm-token", "severity": "high", "match": "npm_abcdefgh"}, {"ruleId": "x", "match": "short"}]
    lines = [audit_log.append(path, {"findings": find, "filesScanned": ["ä.js"], "userDecision": "passed", "severityCounts": {"high": 1}}) for _ in range(3)]
    checked = lambda: audit.verify_chain(audit_log.read_lines(spark, path)).orderBy("position").collect()
    assert [(r["entry"], r["hash_ok"], r["link_ok"], r["errors"]) for r in checked()] == [(i, True, True, []) for i in range(3)]
    assert [f["match"] for f in json.loads(lines[0])["findings"]] == ["npm_****", "***"]
    with open(path, "w", encoding="utf-8") as log:  # a count changed, another order of keys, a line cut short
        other = json.loads(lines[1])
        log.write(lines[0].replace('"findingCount":2', '"findingCount":1') + "\n" + json.dumps({"hash": other.pop("hash"), **other}, separators=(",", ":"), ensure_ascii=False) + "\n{\"cut\n" + lines[2] + "\n")
    assert [r["errors"] for r in checked()] == [["Hash mismatch"], [], []]
    size = os.path.getsize(path)
    audit_log.append(path, {}, limit=size + 1)
    first = audit_log.append(path, {"userDecision": "new"}, limit=size)
    audit_log.append(path, {}, limit=1)
    assert json.loads(first)["previousHash"] is None and sorted(os.listdir(tmp_path)) == ["audit.jsonl", "audit.jsonl.1", "audit.jsonl.2"]
    assert open(path + ".1", encoding="utf-8").read() == first + "\n"


def test_ignore_comments_take_a_whole_comment_sign(spark):
    lines = ["x // scan-ignore", "x /* scan-ignore */", "https://h/scan-ignore", "a * scan-ignore", "# scan-ignore", "x // scan-ignore: a * b", "x // scan-ignore later"]
    rows = spark.createDataFrame(list(enumerate(lines)), "id int, line string").select("id", F.col("line").rlike(ScanConfig().inline_ignore).alias("hit"))
    assert [r["hit"] for r in rows.orderBy("id").collect()] == [True, True, False, False, False, True, False]


def test_blocks_of_many_lines(spark):
    line = "aB3dE6gH9jK2mN5pQ8sT1vW4"
    text = "\n".join(["key =", *[line] * 15_000, "end", line, line])  # 375 kB
    [r] = multiline.base64_blocks(files(spark, [("a", text), ("b", f"{line}\n\t{line} \n{line} x\n{line}"), ("c", None)])).collect()
    assert (r["line_number"], r["context"], r["text"] == line * 15_000) == (2, "key =", True)


def test_example_and_ignore_files():
    assert rewrite.env_example(None, ["A", "B_NEW", "B"]) == "# Copy to .env and fill in real values\n\nA=\nB=\n"
    assert rewrite.env_example("A=1\nC=", ["A", "D"]) == "A=1\nC=\nD=\n"
    assert rewrite.gitignore("") == ".env\n" and rewrite.gitignore("x") == "x\n.env\n" and rewrite.gitignore(" .env \n.env.local") == " .env \n.env.local"


def test_diff_quirks(spark):
    diff = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1,2 @@\n+one\n\\ No newline at end of file\n+two\ndiff --git a/y b/y\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n-gone"
    commits = spark.createDataFrame([("c", diff)], "commit_hash string, diff string")
    plain = [(r["line_number"], r["content"]) for r in history.added_lines(commits).orderBy("pos").collect()]
    quirky = [(r["file"], r["line_number"], r["content"]) for r in history.added_lines(commits, quirks=True).orderBy("pos").collect()]
    assert plain == [(1, "one"), (2, "two")]
    assert ("x", 3, "two") in quirky and any(c == "++ /dev/null" for _, _, c in quirky)


def test_rewrites_touch_the_first_occurrence_only(spark):
    rows = [("a.js", 1, "f('abc', 'abc')", "abc", "npm-token"), ("a.js", 2, 'u = "https://u:abc@h"', "abc", "npm-token"), ("a.js", 3, "none", "abc", "npm-token")]
    got = {r["line_number"]: r for r in rewrite.fix_plan(spark.createDataFrame(rows, "file string, line_number long, line string, secret string, rule_id string")).collect()}
    assert got[1]["after"] == "f(process.env.NPM_TOKEN, 'abc')" and got[2]["after"] == "u = process.env.NPM_TOKEN" and got[3]["after"] is None
    assert got[3]["step"] == 1


def test_sealing_and_jwt(spark):
    row = spark.createDataFrame([("value", "k" * 32, "h.eyJyZWYiOiJhYmMifQ.s")], "v string, k string, t string")
    sealed = row.withColumn("s", T.seal(F.col("v"), F.col("k")))
    r = sealed.select(T.unseal(F.col("s"), F.col("k")).alias("v"), T.jwt_project_ref(F.col("t")).alias("ref")).first()
    assert tuple(r) == ("value", "abc")


def test_reports_hold_no_secret(spark):
    found = scan(files(spark, [("a.js", f"x {KEY} y"), ("b.js", f'"{KEY}"')]))
    lines = [r["json"] for r in report.json_lines(found).collect()] + [r["json"] for r in report.sarif_json(found).collect()]
    assert len(lines) == 4 and not any(KEY in x for x in lines)
    assert report.within_bytes(found, 10).count() == 0 and report.within_bytes(found).count() == 2
    assert report.context_lines(split_lines(files(spark, [("a.js", "1\n2\n3")])), found.filter("file = 'a.js'")).count() == 3
    assert report.incidents(found, "20240101").first()["incident_id"] == "inc-20240101-001"


def test_windowed_counts(spark):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "r", "low"), ("2024-01-01 00:02:00", "r", "low"), ("2024-01-01 00:09:00", "r", "low")], "at string, rule_id string, severity string")
    got = windowed_counts(rows.withColumn("at", F.to_timestamp("at")), "at").collect()
    assert sorted(r["n"] for r in got) == [1, 2]


def test_plan_has_no_python_and_no_cross_join(spark):
    plan = scan(files(spark, [("a", KEY)]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert plan.count("Exchange") == 1  # dedup, over findings


def test_files_are_rewritten_with_imports(spark):
    from siftwell.operators import rewrite

    found = [("a.py", 2, 'k = "s3cretValue"', "s3cretValue", "api-key-assignment"), ("a.py", 3, 'j = "other$1Value"', "other$1Value", "npm-token"), ("p.json", 1, '{"k": "zzz"}', "zzz", "npm-token")]
    files = [("a.py", '#!/bin/python\nk = "s3cretValue"\nj = "other$1Value"\n', None), ("p.json", '{"k": "zzz"}', None), ("untouched.go", "package a", None)]
    plan = rewrite.fix_plan(spark.createDataFrame(found, "file string, line_number long, line string, secret string, rule_id string"))
    got = {r["file"]: r["content"] for r in rewrite.rewrite_files(spark.createDataFrame(files, "file string, content string, dotenv string"), plan).collect()}
    lines = got["a.py"].split("\n")
    assert lines[:2] == ["#!/bin/python", "import os"] and len(lines) == 5 and all("os.environ[" in x for x in lines[2:4])
    assert got["p.json"] == '{"k": "zzz"}' and set(got) == {"a.py", "p.json"}
