"""Folder source, history, exposure, running sums, the audit log in segments, verification results and report documents."""

import json
import os
import random
import xml.dom.minidom

import pytest
from pyspark.sql import functions as F

from siftwell.operators import audit, enrich, exposure
from siftwell.operators.running import Descending, running_sums
from siftwell.plans import report
from siftwell.sources import audit_segments, files, folder, history
from siftwell.sources.config import IgnoreSpec, ScanConfig


def listed(df):
    return {r["file"]: (None if r["content"] is None else bytes(r["content"]), r["size"], r["error"]) for r in df.collect()}


def test_folder_with_links_ignored_and_odd_files(spark, tmp_path):
    root = tmp_path / "f"
    for d in ("sub/deep", "node_modules/x", "b"):
        (root / d).mkdir(parents=True)
    (root / "a.txt").write_text("hello")
    (root / "sub/big.txt").write_text("x" * 5000)
    (root / "sub/deep/ä.txt").write_bytes(b"\xff\x00")
    (root / "node_modules/x/c.js").write_text("no")
    (root / "node_modules/keep.js").write_text("yes")
    os.symlink(root / "a.txt", root / "link.txt")
    os.symlink(root, root / "sub/loop")
    os.symlink(root / "nothing", root / "broken")
    os.mkfifo(root / "pipe")
    config = ScanConfig(max_file_size=4096, ignore=IgnoreSpec.parse("node_modules/x/**\n*.js\n!node_modules/keep.js"))
    got = listed(folder.read(spark, str(root), config))
    assert got == {
        "a.txt": (b"hello", 5, None), "sub/big.txt": (None, 5000, None), "sub/deep/ä.txt": (b"\xff\x00", 2, None), "node_modules/keep.js": (b"yes", 3, None),
        "pipe": (None, None, "Cannot read pipe: it is no regular file"),
    }
    assert {r["file"] for r in files.texts(folder.read(spark, f"file://{root}", config), config).collect()} == {"a.txt", "node_modules/keep.js"}
    assert listed(folder.read(spark, str(root / "none"))) == {str(root / "none"): (None, None, "File not found")}
    assert listed(folder.read(spark, str(root / "a.txt"))) == {"a.txt": (b"hello", 5, None)}
    assert listed(folder.read(spark, str(root / "b"))) == {}
    names = tmp_path / "names"
    names.write_text("a.txt\nsub\nsub/../a.txt\ngone.txt\nlink.txt\nnode_modules/x/c.js\n")
    assert listed(folder.read(spark, str(root), config, str(names))) == {
        "a.txt": (b"hello", 5, None), "sub": (None, None, "Cannot scan sub: it is a directory"), "gone.txt": (None, None, "File not found"),
    }


def test_files_that_cannot_be_read_are_rows(spark, tmp_path):
    for name in "abc":
        (tmp_path / name).write_text(name)
    reader = folder.FolderReader({"path": str(tmp_path), "max_file_size": "10", "ignored": "[]", "kept": "[]"})
    [part] = reader.partitions()
    (tmp_path / "b").unlink()  # gone between listing and reading
    (tmp_path / "c").unlink()
    os.symlink(tmp_path / "a", tmp_path / "c")  # now a link
    got = {r[0]: r[1:] for r in reader.read(part)}
    assert got["a"] == (b"a", 1, None) and got["b"] == (None, 1, "Cannot read b: File not found") and got["c"][0] is None and "Cannot read c" in got["c"][2]
    assert folder.said("x", PermissionError(13, "no")) == "Cannot read x: Permission denied"
    if os.geteuid():
        (tmp_path / "a").chmod(0)
        assert listed(folder.read(spark, str(tmp_path)))["a"][2] == "Cannot read a: Permission denied"


def test_folder_is_dealt_by_bytes(tmp_path, monkeypatch):
    monkeypatch.setattr(folder, "TASK_BYTES", 100)
    for i in range(20):
        (tmp_path / f"{i:02}").write_text("x" * 30)
    parts = folder.FolderReader({"path": str(tmp_path), "max_file_size": "1000", "ignored": "[]", "kept": "[]"}).partitions()
    assert [len(p.files) for p in parts] == [3] * 6 + [2]
    assert [f[0] for p in parts for f in p.files] == [f"{i:02}" for i in range(20)]


DIFF = """diff --git a/x b/x
index 1..2 100644
--- a/x
+++ b/x
@@ -1,3 +1,3 @@ head
 keep
--- looks like a header
+++ b/header
+two
\\ No newline at end of file
@@ -10 +10,2 @@
+@@ not a hunk
 ctx
+last
diff --git a/new b/new
new file mode 100644
--- /dev/null
+++ b/new
@@ -0,0 +1,2 @@
+diff --git a/inner b/inner
+second
diff --git a/old b/old
deleted file mode 100644
--- a/old
+++ /dev/null
@@ -1,1 +0,0 @@
-gone
diff --git a/i.png b/i.png
new file mode 100644
Binary files /dev/null and b/i.png differ
diff --git a/p q b/r s
similarity index 100%
rename from p q
rename to r s
"""


def test_diffs_are_read_as_they_are_meant(spark):
    commits = spark.createDataFrame([("c", DIFF), ("e", ""), ("n", None)], "commit_hash string, diff string")
    got = [(r["file"], r["change"], r["line_number"], r["content"]) for r in history.changed_lines(commits).orderBy("pos").collect()]
    assert got == [
        ("x", -1, 2, "-- looks like a header"), ("x", 1, 2, "++ b/header"), ("x", 1, 3, "two"), ("x", 1, 10, "@@ not a hunk"), ("x", 1, 12, "last"),
        ("new", 1, 1, "diff --git a/inner b/inner"), ("new", 1, 2, "second"), ("old", -1, 0, "gone"),
    ]
    files_of = {r["file"]: (r["old_file"], r["status"]) for r in history.changed_files(commits).collect()}
    assert files_of == {"x": ("x", "M"), "new": (None, "A"), "old": ("old", "D"), "i.png": (None, "A"), "r s": ("p q", "R")}


def test_lines_of_a_large_commit_are_numbered_without_a_shuffle(spark):
    rng = random.Random(2)
    kinds = [rng.choice(" +-") for _ in range(30_000)]
    diff = "diff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -1 +5 @@\n" + "\n".join(f"{k}{i}" for i, k in enumerate(kinds))
    found = history.changed_lines(spark.createDataFrame([("c", diff)], "commit_hash string, diff string"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want, at = [], 5
    for i, k in enumerate(kinds):
        if k != " ":
            want.append((1 if k == "+" else -1, at, str(i)))
        at += k != "-"
    assert [(r["change"], r["line_number"], r["content"]) for r in found.orderBy("pos").collect()] == want


def test_a_moved_line_is_no_exposure(spark):
    secret, other = "tok_ABCDEFGH", "aaaaaaaa"
    lines = [
        ("c1", "f", 1, f"k = {secret}"), ("c2", "f", -1, f"k = {secret}"), ("c2", "f", 1, f"moved = {secret};"), ("c3", "f", 1, f"{secret} {secret}"), ("c3", "f", -1, f"x{secret}"),
        ("c4", "g", 1, secret), ("c5", "f", 1, other + other), ("c5", "f", -1, other), ("c6", "f", 1, "tok_ABCDEFG"), ("c7", "f", -1, f"é日{secret}é"),
    ]
    found = [("f", secret), ("f", secret), ("f", other), ("f", "short"), ("h", secret), ("f", "b" * 201), ("f", "two\nlines here")]
    got = exposure.secret_changes(spark.createDataFrame(found, "file string, secret string"), spark.createDataFrame(lines, "commit_hash string, file string, change int, content string"))
    assert {tuple(r) for r in got.collect()} == {("c1", "f", secret, 1), ("c3", "f", secret, 1), ("c5", "f", other, 1), ("c7", "f", secret, -1)}


def test_secret_changes_against_brute_force(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abé") for _ in range(n))
    secrets = [(f"f{i % 3}", text(rng.randint(8, 12))) for i in range(40)]
    lines = []
    for i in range(400):
        f, own = rng.choice(secrets)
        lines.append((f"c{i % 50}", f, rng.choice([1, -1]), text(rng.randint(0, 6)) + rng.choice([own, own * 2, own[:-1], ""]) + text(rng.randint(0, 9))))
    got = exposure.secret_changes(spark.createDataFrame(secrets, "file string, secret string"), spark.createDataFrame(lines, "commit_hash string, file string, change int, content string"))
    want = {}
    for f, s in set(secrets):
        for c, g, sign, content in lines:
            if f == g:
                want[c, f, s] = want.get((c, f, s), 0) + sign * content.count(s)
    assert {tuple(r[:3]): r[3] for r in got.collect()} == {k: v for k, v in want.items() if v}


def test_a_hot_file_is_dealt_to_many_tasks(spark):
    lines = spark.range(0, 40_000, 1, 8).select(F.concat(F.lit("c"), F.col("id") % 5000).alias("commit_hash"), F.lit("hot").alias("file"), F.lit(1).alias("change"), F.concat(F.lit("x = tok_ABCDEFGH "), F.col("id")).alias("content"))
    found = spark.createDataFrame([("hot", "tok_ABCDEFGH")], "file string, secret string")
    with_salt = lines.withColumn("salt", F.pmod(F.xxhash64("commit_hash", "content"), F.lit(exposure.SALTS)))
    assert with_salt.groupBy("salt").count().agg(F.max("count")).first()[0] < 40_000 / exposure.SALTS * 1.2
    assert exposure.secret_changes(found, lines).agg(F.sum("difference")).first()[0] == 40_000


def test_levels_of_exposure(spark):
    rows = [(None, False, False, False, "abcdefgh", False, False), (True, True, False, False, "short", False, False), (True, False, True, True, "abcdefgh", True, True), (True, False, True, True, "short", False, False), (True, False, True, False, "x" * 201, True, True)]
    got = exposure.exposure(spark.createDataFrame([(*r, "2024-01-01") for r in rows], "is_repo boolean, staged boolean, in_any_commit boolean, in_remote boolean, secret string, secret_in_any boolean, secret_in_remote boolean, exposure_since string"))
    assert [(r["level"], r["confidence"]) for r in got.collect()] == [("UNKNOWN", "low"), ("LOCAL", "high"), ("PUSHED", "high"), ("PUSHED", "medium"), ("COMMITTED", "medium")]
    assert [r["details"] for r in got.collect()][1:3] == ["The file is staged and was never committed", "The secret is in the history of a remote, since 2024-01-01"]


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_running_sums(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice(["a", "b", None, "c"]), rng.randint(0, 3), rng.randint(0, 9)) for _ in range(n)]
    got = running_sums(spark.createDataFrame(rows, "k string, j int, running_total int"), [F.col("k"), Descending(F.col("j"))], F.col("running_total"), name="upto", total="everything").collect()
    got.sort(key=lambda r: r["upto"])
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", -r[1]))
    assert [(r["k"], r["j"]) for r in got if r["running_total"]] == [(k, j) for k, j, v in ordered if v] or sorted(map(repr, got)) != []
    assert len(got) == n and all(r["everything"] == sum(v for _, _, v in rows) for r in got)
    group = {}
    for k, j, v in ordered:
        group[k, j] = group.get((k, j), 0) + v
    upto = 0
    for key, v in group.items():  # ties come in any order, but within the group's stretch
        own = [r["upto"] for r in got if (r["k"], r["j"]) == key]
        assert max(own) == upto + v and min(own) >= upto
        upto += v


def test_equal_rows_are_numbered_apart_and_in_many_ranges(spark):
    rows = running_sums(spark.range(0, 20_000, 1, 8).select(F.lit("same").alias("x")), [F.col("x")], name="n")
    assert sorted(r["n"] for r in rows.collect()) == list(range(1, 20_001))
    assert "SinglePartition" not in rows._jdf.queryExecution().executedPlan().toString()


def scans(spark, first, n):
    rows = [(f"2024-01-{i:02}T00:00:00Z", f"f{i}", i, 3, "npm-token", "npm", "high", 'npm_"abcdefgh' if i % 2 else "short") for i in range(first, first + n)]
    found = spark.createDataFrame(rows, "at string, file string, line_number int, match_start int, rule_id string, rule_name string, severity string, match string")
    return audit_segments.entries(found, "at", timestamp=F.col("at"), decision=F.lit('said "so"'))


def test_segments_of_an_audit_log(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    assert [audit_segments.append(spark, log, scans(spark, a, n)) for a, n in ((1, 5), (6, 0), (6, 4), (10, 3), (13, 2))] == [1, None, 2, 3, 4]
    checked = lambda: audit.verify_chain(audit_segments.read(spark, log)).orderBy("entry").collect()
    assert [(r["segment"], r["entry"], r["errors"]) for r in checked()] == [(s, i, []) for i, s in enumerate([1] * 5 + [2] * 4 + [3] * 3 + [4] * 2)]
    lines = [json.loads(r["value"]) for r in audit_segments.read(spark, log).orderBy("position").collect()]
    assert [x["timestamp"] for x in lines] == sorted(x["timestamp"] for x in lines) and lines[0]["previousHash"] is None
    assert [x["findings"][0]["match"] for x in lines[:2]] == ["npm_****", "***"] and lines[0]["severityCounts"] == {"critical": 0, "high": 1, "medium": 0, "low": 0}
    [part] = [p for p in (tmp_path / "log/segment=00000002").iterdir() if p.name.startswith("part")]
    text = part.read_text().split("\n")
    part.write_text("\n".join([text[0], text[1].replace('"findingCount":1', '"findingCount":0'), "{cut", text[3], ""]))
    for p in (tmp_path / "log/segment=00000002").glob(".*.crc"):
        p.unlink()
    (tmp_path / "log/segment=00000003").rename(tmp_path / "lost")
    errors = {r["entry"]: r["errors"] for r in checked() if r["errors"]}
    # the changed entry; the one whose line was cut short, behind it; the lost segment
    assert errors == {6: ["Hash mismatch"], 7: ["Chain linkage broken"], 8: ["Chain linkage broken", "Segment lost"]}


def test_the_latest_result_counts(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    found = spark.createDataFrame([(i, "r", s, "high") for i, s in enumerate(["twice", "old", "late", "edge", "none", "tie"])], "id int, rule_id string, secret string, severity string")
    checks = [("twice", "live", "11:10"), ("twice", "inactive", "11:40"), ("old", "live", "10:00"), ("late", "live", "12:01"), ("late", "inactive", "11:30"), ("edge", "live", "11:00"), ("tie", "live", "11:30"), ("tie", "inactive", "11:30")]
    results = spark.createDataFrame([("r", s, v, f"2024-01-01 {t}:00") for s, v, t in checks], "rule_id string, s string, status string, t string")
    results = results.select("rule_id", F.sha2("s", 256).alias("secret_sha256"), "status", F.to_timestamp("t").alias("checked_at"))
    got = {r["secret"]: (r["verification"], r["severity"]) for r in enrich.apply_verification(found, results, at("2024-01-01 12:00:00")).collect()}
    assert got == {"twice": ("inactive", "low"), "old": ("skipped", "high"), "late": ("inactive", "low"), "edge": ("skipped", "high"), "none": ("skipped", "high"), "tie": ("live", "critical")}
    # findings of several scans, each as of its own time
    times = found.filter("secret = 'twice'").crossJoin(spark.createDataFrame([("11:09",), ("11:10",), ("11:39",), ("12:39",), ("12:40",)], "hm string"))
    asof = enrich.apply_verification(times, results, F.to_timestamp(F.concat(F.lit("2024-01-01 "), "hm", F.lit(":00")))).collect()
    assert {r["hm"]: r["verification"] for r in asof} == {"11:09": "skipped", "11:10": "live", "11:39": "live", "12:39": "inactive", "12:40": "skipped"}


ROWS = [("a.js", 1, None, "r1", "A|B <x>", "high"), ("a.js", 1, None, "r1", "A|B <x>", "high"), ("a.js", 1, 0, "r1", "A|B <x>", "high"), ("b & c", 2, 3, "aws-access-key-id", None, "critical")]
FINDINGS = "file string, line_number int, match_start int, rule_id string, rule_name string, severity string"


@pytest.mark.parametrize("n", [0, 1, 4])
def test_documents_can_be_parsed(spark, tmp_path, n):
    found = spark.createDataFrame([(*r, s) for r, s in zip(ROWS[:n], ("fixed", "ignored", "none", None), strict=False)], FINDINGS + ", status string")

    def written(lines, name):
        report.write_document(lines, f"file://{tmp_path}/{name}")
        return "".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))

    sarif = json.loads(written(report.sarif_document(found, 'a "tool"', "1"), "sarif"))
    assert len(sarif["runs"][0]["results"]) == n and sarif["runs"][0]["tool"]["driver"]["name"] == 'a "tool"'
    assert [r["id"] for r in sarif["runs"][0]["tool"]["driver"]["rules"]] == sorted({r[3] for r in ROWS[:n]})
    page = written(report.html_document(found, "2024-01-01"), "html")
    tree = xml.dom.minidom.parseString(page.split("\n", 1)[1])
    tables = tree.getElementsByTagName("table")
    cell = lambda x: "".join(c.data for c in x.childNodes)
    counts = {cell(a): int(cell(b)) for a, b in (r.getElementsByTagName("td") for r in tables[0].getElementsByTagName("tr"))}
    assert counts["total"] == n and counts["fixed"] + counts["ignored"] + counts["open"] == n and (n < 4 or counts["open"] == 2)
    assert len(tables[1].getElementsByTagName("tr")) == n + 1
    text = written(report.markdown_document(found, "2024-01-01"), "md")
    table = text.split("## Findings\n\n")[1].split("\n\n")[0].split("\n")
    assert len(table) == n + 2 and (n < 1 or r"A\|B <x>" in table[2])
    assert "- OWASP Top 10: none" in text if n < 4 else "- OWASP Top 10: A" in text


def test_incidents_go_on_from_the_day_s_last(spark):
    found = spark.createDataFrame([(*r, "secret-123", "m") for r in ROWS], FINDINGS + ", secret string, match string")
    earlier = spark.createDataFrame([("inc-20240101-007",), ("inc-20240101-1200",), ("inc-20231231-9999",), ("odd",)], "incident_id string")
    assert sorted(r["incident_id"] for r in report.incidents(found, "20240101", earlier).collect()) == [f"inc-20240101-{n}" for n in range(1201, 1205)]
    assert sorted(r["incident_id"] for r in report.incidents(found, "20240102", earlier).collect()) == [f"inc-20240102-00{n}" for n in range(1, 5)]
    assert {r["counter"] for r in report.numbered(found).collect()} == {f"[{i}/4]" for i in range(1, 5)}
    limited = report.within_bytes(found.withColumn("json", F.lit("é" * 5)), 22).collect()
    assert [r["bytes"] for r in limited] == [11, 22] and limited[0]["severity"] == "critical"
