"""What may not pass through the driver."""

import random

import pytest
from pyspark.sql import functions as F

from siftwell.operators import exposure
from siftwell.sources import history

LINES = "commit_hash string, file string, change int, content string"


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [0, 1000])
def test_secrets_are_not_broadcast(spark, monkeypatch, few):
    """written, equal secrets of many files take next to nothing, and were sent through the driver sixteen times each."""
    monkeypatch.setattr(exposure, "FEW", few)
    staged = []
    monkeypatch.setattr(exposure, "stage", lambda df, name, keep=exposure.stage: staged.append(df) or keep(df, name))
    found = spark.range(3000).select(F.concat(F.lit("f"), "id").alias("file"), F.lit("tok_ABCDEFGH").alias("secret"))
    lines = spark.range(3000).select(F.lit("c").alias("commit_hash"), F.concat(F.lit("f"), "id").alias("file"), F.lit(1).alias("change"), F.lit("x = tok_ABCDEFGH").alias("content"))
    got = exposure.secret_changes(found, lines)
    assert "Broadcast" not in executed(got)
    assert not [p for p in map(executed, staged) if "Broadcast" in p]
    assert [tuple(r) for r in got.agg(F.count("*"), F.sum("difference")).collect()] == [(3000, 3000)]


@pytest.mark.parametrize("few", [0, 1000])
def test_lines_of_a_block_together_hold_what_they_hold_one_by_one(spark, monkeypatch, few):
    """a block's added and removed lines are searched as one text each; no secret spans a break."""
    monkeypatch.setattr(exposure, "FEW", few)
    rng = random.Random(4)
    line = lambda: rng.choice("+- ") + rng.choice(["", "é", "tok_ABCD", "EFGH", "tok_ABCDEFGH", "tok_ABCDEFGHtok_ABCDEFGH", "--- a/x"])
    diffs = []
    for c in range(30):
        body = "".join(f"@@ -1,9 +{k * 500 + 1},9 @@\n" + "".join(line() + "\n" for _ in range(rng.choice([0, 1, 127, 128, 129, 300]))) for k in range(2))
        diffs.append((f"c{c}", f"diff --git a/f b/f\n--- a/f\n+++ {rng.choice(['b/f', '/dev/null'])}\n{body}\\ No newline at end of file\n"))
    commits = spark.createDataFrame(diffs, "commit_hash string, diff string")
    one, whole = history.changed_lines(commits), history.changed_text(commits)
    kept = lambda rows: sorted(tuple(r) for r in rows.collect())
    apart = whole.select("commit_hash", "file", "change", F.explode(F.split("content", "\n", -1)).alias("content")).filter("content <> ''")
    assert kept(apart) == kept(one.select("commit_hash", "file", "change", "content").filter("content <> ''"))
    found = spark.createDataFrame([("f", "tok_ABCDEFGH"), ("f", "tok_ABCD")], "file string, secret string")
    assert kept(exposure.secret_changes(found, whole)) == kept(exposure.secret_changes(found, one.select("commit_hash", "file", "change", "content")))


def test_only_lines_are_copied_for_their_shingles(spark):
    """not the block that a line came in."""
    lines = spark.createDataFrame([("c", "f", 1, "tok_ABCDEFGH\nsome other line\n" * 50, 0)], LINES + ", salt int")
    met = exposure._met_by_shingles(lines, spark.createDataFrame([("f", "tok_ABCDEFGH", 0)], "file string, secret string, salt int"))
    assert [tuple(r) for r in met.groupBy("content").count().collect()] == [("tok_ABCDEFGH", 50)]


@pytest.mark.parametrize("made", [lambda flags: exposure.exposure(flags.withColumn("is_repo", F.lit(True))), lambda flags: exposure.pushed_only(exposure.exposure(flags.withColumn("is_repo", F.lit(True))))], ids=["exposure", "pushed"])
def test_commits_and_files_are_not_broadcast(spark, made):
    """nor what is known of them."""
    diff = F.concat(F.lit("diff --git a/f b/f\n--- /dev/null\n+++ b/f"), "id", F.lit("\n@@ -0,0 +1,1 @@\n+tok_ABCDEFGH\n"))
    commits = spark.range(300).select(F.concat(F.lit("c"), "id").alias("commit_hash"), F.timestamp_seconds("id").alias("committed_at"), (F.col("id") % 3 > 0).alias("is_remote"), diff.alias("diff"))
    found = spark.range(301).select(F.concat(F.lit("f"), "id").alias("file"), F.lit("tok_ABCDEFGH").alias("secret"))
    got = made(exposure.history_flags(found, commits, history.changed_files(commits), history.changed_text(commits)))
    assert "Broadcast" not in executed(got)
    levels = {r[0]: r[1] for r in got.groupBy("level").count().collect()}
    assert levels.pop("PUSHED") == 200 and levels in ({}, {"COMMITTED": 100, "LOCAL": 1})
