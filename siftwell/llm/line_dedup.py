"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only).

The index is a log-structured set of runs: tables of (h1, h2, owner, n_docs), bucketed and sorted by hash, one file a bucket.
Batches come in descending document order, so the first document to bring a key is the largest one
holding it. A batch's keys are dealt to the buckets once and merge with all runs as these lie, without moving or sorting them: what no run has
is new and becomes a run of level 0; what is known already is a log of hits, so that counts stay whole. When a level has ``fanout`` runs they
are compacted into one of the next level. Runs never share a key.

A key is 128 bits of two XXH64, so that 10^12 distinct lines meet by chance with odds of about 10^-15.

Defined results: null or empty text is one empty line; keys shorter than ``min_chars`` are never
dropped; a null doc_id is the smallest document; rows that share a doc_id are one document, each
with its own lines; repeated rows get equal results; an empty table gives none. Columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import id_or_null_id, join_unique, new_path, stage

BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """Stripped of blanks at both ends, A-Z lower-cased. ``lower`` is the faster way where all is ASCII."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def lines_of(text: Column | str) -> Column:
    return F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\n", -1)


def line_hashes(documents: DataFrame, min_chars: int = 20) -> DataFrame:
    """One row per long enough line: doc, text_hash, pos, h1, h2."""
    rows = documents.select(
        id_or_null_id("doc_id").alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        F.posexplode(lines_of("text")).alias("pos", "line"),
    )
    rows = rows.withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= min_chars)
    return rows.select("doc", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), F.col("key")).alias("h2"))


_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class LineRuns:
    """The index. ``add`` takes batches of (doc, h1, h2) whose documents don't exceed those added before."""

    def __init__(self, spark: SparkSession, fanout: int = 3, buckets: int = 16):
        self.spark, self.fanout, self.buckets = spark, fanout, buckets
        self.levels: list[list[DataFrame]] = [[]]
        self.hits: list[DataFrame] = []
        self.path = new_path(spark, "line-runs")
        self.tables: list[str] = []

    def _write(self, rows: DataFrame) -> DataFrame:
        """``rows``, dealt to the buckets by both hashes, as a table with one sorted file a bucket."""
        name = f"line_run_{uuid.uuid4().hex}"
        self.tables.append(name)
        writer = rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.path}/run-{len(self.tables)}")
        # a scan that knows its order is merged without a sort
        before = self.spark.conf.get(_ORDERED)
        self.spark.conf.set(_ORDERED, "true")
        try:
            writer.format("parquet").saveAsTable(name)
        finally:
            self.spark.conf.set(_ORDERED, before)
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def merged(self, batch: DataFrame) -> DataFrame:
        """A batch's keys, each with whether a run has it: h1, h2, owner, n_docs, known. Runs are merged as they lie."""
        once = batch.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one"))
        keys = once.groupBy("h1", "h2").agg(F.max("doc").alias("owner"), F.count("*").alias("n_docs")).repartition(self.buckets, "h1", "h2")
        known = F.lit(False)
        for i, run in enumerate(self.runs()):
            keys = keys.join(run.select("h1", "h2", F.lit(True).alias(f"in_{i}")).hint("merge"), ["h1", "h2"], "left")
            known = known | F.coalesce(f"in_{i}", F.lit(False))
        return keys.select("h1", "h2", "owner", "n_docs", known.alias("known"))

    def add(self, batch: DataFrame) -> None:
        rows = self._write(self.merged(batch))
        if self.runs():
            self.hits.append(rows.filter("known").drop("known"))
        self.levels[0].append(rows.filter("not known").drop("known"))
        self._compact()

    def _compact(self) -> None:
        at = 0
        while len(self.levels[at]) >= self.fanout:
            rows = reduce(DataFrame.unionByName, self.levels[at]).repartition(self.buckets, "h1", "h2")
            merged = self._write(rows)
            self.levels[at] = []
            if at + 1 == len(self.levels):
                self.levels.append([])
            self.levels[at + 1].append(merged)
            at += 1

    def keys(self) -> DataFrame:
        """Every key with its owner and the number of documents that hold it."""
        both = reduce(DataFrame.unionByName, [*self.runs(), *self.hits])
        return both.groupBy("h1", "h2").agg(F.max("owner").alias("owner"), F.sum("n_docs").alias("n_docs"))

    def close(self) -> None:
        """Takes the runs' tables out of the catalog; their files go with the shared folder."""
        for name in self.tables:
            self.spark.sql(f"drop table if exists {name}")


def drop_repeated_lines(documents: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3, bucket_lines: int = 1 << 22) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (the kept lines) per row of ``documents``."""
    spark = documents.sparkSession
    cuts = documents.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("cuts")).first()
    edges = sorted(set(cuts["cuts"] or [])) if cuts else []
    lines = stage(line_hashes(documents, min_chars), "lines")
    index = LineRuns(spark, fanout, max(spark.sparkContext.defaultParallelism, lines.count() // bucket_lines))
    for low, high in reversed(list(zip([None, *edges], [*edges, None], strict=True))):
        batch = lines
        if low is not None:
            batch = batch.filter(F.col("doc") > low)
        if high is not None:
            batch = batch.filter(F.col("doc") <= high)
        index.add(batch)
    repeated = stage(index.keys().filter(F.col("n_docs") >= min_docs).select("h1", "h2", "owner", "n_docs"), "repeated-lines")
    index.close()
    # a line that many documents hold is dealt to many tasks; rows of a key are at least its documents
    key = F.struct("h1", "h2").alias("line")
    wanted = stage(repeated.select(key, "owner", F.col("n_docs").alias("n")), "wanted-lines")
    gone = join_unique(lines.select(key, "doc", "text_hash", "pos"), wanted, "line", "n", "doc").filter(F.col("doc") != F.col("owner"))
    gone = gone.groupBy("doc", "text_hash").agg(F.collect_set("pos").alias("gone"))
    rows = documents.select(
        "doc_id", "text", id_or_null_id("doc_id").alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")
    )
    rows = rows.join(gone, ["doc", "text_hash"], "left").select("doc_id", "text", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    rows = rows.withColumn("lines", lines_of("text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.size("gone") == 0, F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    )
    return rows.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), kept.alias("text")
    )
