"""Commit history: unified diffs to files and lines.

A commit's diff is cut at its file headers, a file's part at its hunks, and a hunk into blocks of lines, all within the row; the blocks' starts in the
new file come from sums over the blocks. Only then is anything exploded, so a large commit is dealt to many tasks, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 128


def newest(commits: DataFrame, n: int = 50) -> DataFrame:
    return commits.orderBy(F.col("committed_at").desc()).limit(n)


def _sections(commits: DataFrame) -> DataFrame:
    """One row a file of a commit: commit_hash, section, head (up to its first hunk), hunks (each from its own ``@@`` on)."""
    rows = commits.select("commit_hash", F.posexplode(F.split("diff", "\n(?=diff --git )", -1)).alias("section", "text"))
    rows = rows.withColumn("parts", F.split("text", "(?:^|\n)(?=@@ )", -1))
    return rows.select("commit_hash", "section", F.get("parts", F.lit(0)).alias("head"), F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))).alias("hunks"))


def _named(head: Column, mark: str) -> Column:
    """What follows ``--- `` or ``+++ ``: the path behind ``a/`` or ``b/``; null for a file that isn't there on that side."""
    said = F.regexp_extract(head, rf"(?m)^{mark} (.*)$", 1)
    return F.when((said != "") & (said != "/dev/null"), F.trim(F.substring(said, 3, 1 << 30)))


def changed_files(commits: DataFrame) -> DataFrame:
    """commit_hash, file, old_file, status (A: added, D: deleted, R: renamed, M: changed) of each file in a diff; binary files among them."""
    rows = _sections(commits).filter(F.col("head").rlike(r"(?m)^(\+\+\+ |--- |Binary files |diff --git )"))
    old, new = _named(F.col("head"), "---"), _named(F.col("head"), r"\+\+\+")
    whole = lambda mark, n: F.when(F.regexp_extract("head", mark, n) != "", F.regexp_extract("head", mark, n))
    old = F.coalesce(old, whole(r"(?m)^rename from (.+)$", 1), F.when(~F.col("head").rlike("(?m)^(--- |new file)"), whole(r"(?m)^diff --git a/(.+) b/(.+)$", 1)))
    new = F.coalesce(new, whole(r"(?m)^rename to (.+)$", 1), F.when(~F.col("head").rlike(r"(?m)^(\+\+\+ |deleted file)"), whole(r"(?m)^diff --git a/(.+) b/(.+)$", 2)))
    status = F.when(old.isNull(), "A").when(new.isNull(), "D").when(old != new, "R").otherwise("M")
    return rows.select("commit_hash", F.coalesce(new, old).alias("file"), old.alias("old_file"), status.alias("status"))


def _blocks(commits: DataFrame) -> DataFrame:
    """One row a hunk: commit_hash, section, file (a deleted one's old name), hunk, start (its first line in the new file), blocks (arrays of lines with their marks)."""
    rows = _sections(commits)
    file = F.coalesce(_named(F.col("head"), r"\+\+\+"), _named(F.col("head"), "---"))
    rows = rows.select("commit_hash", "section", file.alias("file"), F.posexplode("hunks").alias("hunk", "text")).filter("file is not null")
    start = F.regexp_extract("text", r"\+(\d+)", 1).try_cast("long")
    lines = F.split("text", "\n", -1)
    body = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    rows = rows.select("commit_hash", "section", "file", "hunk", F.coalesce(start, F.lit(1)).alias("start"), body.alias("body"))
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size("body") - 1, F.lit(0)) / BLOCK).cast("int")), lambda b: F.slice("body", b * BLOCK + 1, F.lit(BLOCK)))
    return rows.select("commit_hash", "section", "file", "hunk", "start", cut.alias("blocks"))


def changed_lines(commits: DataFrame) -> DataFrame:
    """commits: commit_hash, diff. Gives commit_hash, file, change (1: added, -1: removed), line_number (in the new file; of a removed line, of what
    comes after it), content, pos (of the line within its commit, growing). A line without a file, as in a deleted one, is given with its old name."""
    rows = _blocks(commits)
    moves = lambda line: line.startswith("+") | line.startswith(" ")
    counts = F.transform("blocks", lambda b: F.size(F.filter(b, moves)))
    rows = rows.withColumn("counts", counts)
    sums = F.aggregate("counts", F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
    rows = rows.select("commit_hash", "section", "file", "hunk", "start", F.posexplode(F.arrays_zip(F.col("blocks").alias("lines"), sums.alias("before"))).alias("block", "b"))
    rows = rows.filter(F.col("b.lines").isNotNull())
    # within a block: a line's number in the new file counts the block's lines before it
    def add(so_far: Column, line: Column) -> Column:
        change = F.when(line.startswith("+"), 1).when(line.startswith("-"), -1)
        one = F.struct(change.alias("change"), F.substring(line, 2, 1 << 30).alias("content"), so_far["i"].alias("i"), so_far["at"].alias("line_number"))
        found = F.when(change.isNotNull(), F.array_append(so_far["found"], one)).otherwise(so_far["found"])
        return F.struct((so_far["i"] + 1).alias("i"), (so_far["at"] + moves(line).cast("int")).alias("at"), found.alias("found"))

    none = F.array().cast("array<struct<change:int,content:string,i:int,line_number:bigint>>")
    first = F.struct(F.lit(0).alias("i"), (F.col("start") + F.col("b.before")).alias("at"), none.alias("found"))
    numbered = F.aggregate("b.lines", first, add, lambda x: x["found"])
    rows = rows.select("commit_hash", "section", "file", "hunk", "block", F.explode(numbered).alias("x"))
    pos = ((F.col("section").cast("long") * 100_000 + F.col("hunk")) * 10_000_000) + F.col("block").cast("long") * BLOCK + F.col("x.i")
    return rows.select("commit_hash", "file", "x.change", F.col("x.line_number").cast("int").alias("line_number"), "x.content", pos.alias("pos"))


def changed_text(commits: DataFrame) -> DataFrame:
    """The lines of ``changed_lines`` for who only asks what they hold: commit_hash, file, change, content; a row for the added and one for the removed lines of each block, breaks between them."""
    rows = _blocks(commits).select("commit_hash", "file", F.explode("blocks").alias("lines"))
    lines = lambda mark: F.transform(F.filter("lines", lambda x: x.startswith(mark)), lambda x: F.substring(x, 2, 1 << 30))
    sides = F.array(*(F.struct(F.lit(n).alias("change"), F.array_join(lines(mark), "\n").alias("content")) for mark, n in (("+", 1), ("-", -1))))
    return rows.select("commit_hash", "file", F.explode(sides).alias("x")).select("commit_hash", "file", "x.change", "x.content").filter("content <> ''")


def added_lines(commits: DataFrame, quirks: bool = False) -> DataFrame:
    """commits: commit_hash, diff. Gives commit_hash, file, line_number, content, pos (growing within a commit).

    ``quirks``: headers of deleted files, added lines that look like a header and the no-newline mark are taken
    as the scanned tool takes them (a window over each commit); without it they are read as the diff format means them."""
    if quirks:
        return _added_with_quirks(commits)
    return changed_lines(commits).filter("change = 1").select("commit_hash", "file", "line_number", "content", "pos")


def _added_with_quirks(commits: DataFrame) -> DataFrame:
    rows = commits.select("commit_hash", F.posexplode(F.split("diff", "\n", -1)).alias("pos", "line"))
    order = Window.partitionBy("commit_hash").orderBy("pos")
    line = F.col("line")
    is_file, is_hunk, target = line.startswith("diff --git "), line.startswith("@@"), line.startswith("+++ b/")
    blind = F.last(F.when(is_file, False).when(line.rlike(r"^Binary files .* differ"), True), True).over(order)
    rows = rows.withColumn("blind", F.coalesce(blind, F.lit(False))).filter("not blind")
    rows = rows.withColumn("file", F.last(F.when(target, F.trim(F.expr("substring(line, 7)"))), True).over(order))
    rows = rows.withColumn("hunk", F.sum(F.when(is_hunk, 1).otherwise(0)).over(order))
    start = F.when(is_hunk, F.regexp_extract(line, r"\+(\d+)", 1).try_cast("long") - 1)
    added = line.startswith("+") & ~target & ~is_hunk
    context = ~line.startswith("-") & (line != "") & ~added & ~target & ~is_hunk & ~line.startswith("--- ")
    within = Window.partitionBy("commit_hash", "hunk").orderBy("pos")
    rows = rows.withColumn("added", added).withColumn("moves", F.when(added | context, 1).otherwise(0))
    number = F.coalesce(F.first(start, True).over(within), F.lit(0)) + F.sum("moves").over(within)
    found = rows.withColumn("line_number", number.cast("int")).filter(F.col("added") & (F.coalesce("file", F.lit("")) != ""))
    return found.select("commit_hash", "file", "line_number", F.expr("substring(line, 2)").alias("content"), "pos")
