"""Where a secret has been: commits that change how often it occurs in a file, and who could see it since when.

Secrets and changed lines meet by their file: a line is searched for each secret of a file that has few. In a file of many secrets they meet by short shingles as well: of every four neighbouring
runs of five characters the one with the least hash counts, so a line that holds a secret of eight characters or more has that secret's first shingle among its own. Both ways find the same
lines; shingling a line takes as long as searching it some thousand times. Only lines of files with findings are looked at. What meets is then counted exactly: occurrences in added lines less those in removed ones, by commit. A line that only moves leaves no trace.

Secrets grow with the files, and written they compress to a few hundredths of what a driver would have to hold. So their joins, and those of commits and files, ask for a merge: none is broadcast, whatever a file's size says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.sources.staged import stage

SHORTEST, LONGEST = 8, 200
_GRAM, _RUN = 5, 4
#: A file's lines are dealt to so many tasks at least, whatever the file; its secrets go to each of them.
SALTS = 16
#: Up to so many secrets of a file each of its lines is searched for.
FEW = 256


def _shingles(text: Column) -> Column:
    """Hashes of all runs of five characters."""
    chars = F.split(text, "")
    n = F.size(chars) - _GRAM + 1
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(chars, i, F.lit(_GRAM)), "")))


def _least(hashes: Column) -> Column:
    at = F.when(F.size(hashes) >= _RUN, F.sequence(F.lit(1), F.size(hashes) - _RUN + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.array_min(F.slice(hashes, i, F.lit(_RUN)))))


def by_content(secret: Column) -> Column:
    """Whether a secret is looked for itself, not only its file."""
    return F.length(secret).between(SHORTEST, LONGEST) & ~secret.contains("\n")


def secret_changes(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """findings: file, secret; changed: commit_hash, file, change (1 or -1), content (a line, or lines with their breaks between). Gives commit_hash, file, secret, difference: by how much
    a commit changes the number of the secret's occurrences in the file, where it does. A line may hold many secrets, a secret stand in many lines."""
    wanted = stage(findings.filter(by_content(F.col("secret"))).select("file", "secret").distinct(), "secrets")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    numbers = wanted.groupBy("file").agg((F.count("*") > FEW).alias("many"))
    wanted = stage(wanted.join(numbers.hint("merge"), "file"), "secrets")
    lines = changed.filter(F.length("content") >= SHORTEST).withColumn("salt", F.pmod(F.xxhash64("commit_hash", "content"), F.lit(SALTS)).cast("int"))
    met = lines.join(wanted.filter("not many").select("file", "secret", salts).hint("merge"), ["file", "salt"]).filter(F.contains("content", "secret"))
    if not wanted.filter("many").isEmpty():
        met = _met_by_shingles(lines, wanted.filter("many").select("file", "secret", salts)).unionByName(met)
    times = (F.length("content") - F.length(F.replace("content", "secret"))) / F.length("secret")
    summed = met.groupBy("commit_hash", "file", "secret").agg(F.sum(F.col("change") * times).cast("long").alias("difference"))
    return summed.filter("difference <> 0")


def _met_by_shingles(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Lines with the secrets of their file that share a shingle with them."""
    files = wanted.select("file", "salt").distinct()
    lines = lines.join(files.hint("merge"), ["file", "salt"], "left_semi").withColumn("content", F.explode(F.split("content", "\n", -1)))  # a row is copied for each of its shingles
    lines = lines.withColumn("hashes", _shingles(F.col("content")))
    lines = lines.withColumn("shingle", F.explode(_least(F.col("hashes")))).drop("hashes")
    keyed = wanted.withColumn("shingle", F.get(_least(F.slice(_shingles(F.substring("secret", 1, SHORTEST)), 1, _RUN)), F.lit(0)))
    return lines.join(keyed.hint("merge"), ["file", "salt", "shingle"]).drop("shingle")


def history_flags(findings: DataFrame, commits: DataFrame, touched: DataFrame, changed: DataFrame) -> DataFrame:
    """``findings`` (file, secret) with what ``exposure`` takes - in_any_commit, in_remote, secret_in_any, secret_in_remote - and exposure_since.

    commits: commit_hash, committed_at, is_remote; touched: commit_hash, file, status; changed: as for ``secret_changes``. A file counts as exposed since the first
    commit on a remote that added it."""
    known = commits.select("commit_hash", "committed_at", "is_remote").hint("merge")
    seen = touched.join(known, "commit_hash").groupBy("file").agg(
        F.lit(True).alias("in_any_commit"), F.bool_or("is_remote").alias("in_remote"),
        F.min(F.when(F.col("is_remote") & (F.col("status") == "A"), F.col("committed_at"))).alias("exposure_since"),
    )
    held = secret_changes(findings, changed).join(known, "commit_hash").groupBy("file", "secret")
    held = held.agg(F.lit(True).alias("secret_in_any"), F.bool_or("is_remote").alias("secret_in_remote"))
    flags = ("in_any_commit", "in_remote", "secret_in_any", "secret_in_remote")
    return findings.join(seen.hint("merge"), "file", "left").join(held.hint("merge"), ["file", "secret"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in flags})


def exposure(flags: DataFrame) -> DataFrame:
    """flags: is_repo, staged (null: unknown), in_any_commit, in_remote, secret, secret_in_any, secret_in_remote. Adds level, confidence and details."""
    own = F.length("secret").between(SHORTEST, LONGEST)
    staged = F.coalesce("staged", F.lit(False)) if "staged" in flags.columns else F.lit(False)
    cases = [
        (F.col("is_repo").isNull(), "UNKNOWN", "low", "The state of the repository could not be read"),
        (~F.col("is_repo"), "UNKNOWN", "low", "Not a repository"),
        (own & F.col("secret_in_remote"), "PUSHED", "high", "The secret is in the history of a remote"),
        (own & F.col("secret_in_any"), "COMMITTED", "high", "The secret is in local commits only"),
        (own, "LOCAL", "high", "The secret is in no commit"),
        (staged & ~F.col("in_any_commit"), "LOCAL", "high", "The file is staged and was never committed"),
        (~F.col("in_any_commit"), "LOCAL", "high", "The file is in no commit"),
        (F.col("in_remote"), "PUSHED", "medium", "The file is in the history of a remote"),
    ]
    level, sure, said = F.lit("COMMITTED"), F.lit("medium"), F.lit("The file is in local commits only")
    for when, a, b, c in reversed(cases):
        level, sure, said = F.when(when, a).otherwise(level), F.when(when, b).otherwise(sure), F.when(when, c).otherwise(said)
    since = F.col("exposure_since").cast("string") if "exposure_since" in flags.columns else F.lit(None).cast("string")
    dated = F.when((level == "PUSHED") & since.isNotNull(), F.concat(said, F.lit(", since "), since)).otherwise(said)
    return flags.withColumns({"level": level, "confidence": sure, "details": dated})


def pushed_only(exposed: DataFrame) -> DataFrame:
    """Findings that others can see already."""
    return exposed.filter("level = 'PUSHED'")
