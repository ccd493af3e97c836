"""File tables: a folder of files, or any table of texts, as (file, content) with the guards of a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import format_bytes
from siftwell.sources.config import ScanConfig


def read_folder(spark: SparkSession, path: str, config: ScanConfig = ScanConfig()) -> DataFrame:
    """file (relative to ``path``), content (binary), size, error: each file of the folder once, without what is ignored or in an ignored folder.

    The size limit is a filter of the reader, which doesn't open larger files; these are listed without content. A path that isn't
    there is one row with an error."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return spark.createDataFrame([(path, None, None, "File not found")], "file string, content binary, size long, error string")
    base = fs.makeQualified(root).toString().rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    whole, large = found.filter(F.col("length") <= config.max_file_size), found.filter(F.col("length") > config.max_file_size)
    name = F.when(F.col("path").startswith(base + "/"), F.substring("path", len(base) + 2, 1 << 20)).otherwise(F.substring_index("path", "/", -1))
    rows = lambda df, content: df.select(name.alias("file"), content.alias("content"), F.col("length").alias("size"), F.lit(None).cast("string").alias("error"))
    listed = rows(whole, F.col("content")).unionByName(rows(large, F.lit(None).cast("binary")))
    return listed.filter(~config.ignore.ignores_tree(F.col("file")))


def is_binary(content: Column) -> Column:
    """A NUL or SUB among the first 512 bytes."""
    return F.hex(F.substring(content, 1, 512)).rlike("^(?:..)*?(?:00|1A)")


def file_status(files: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """``files`` (file, content binary, size) with is_ignored, is_binary, skipped, skip_reason."""
    large = F.col("size") > config.max_file_size
    reason = F.concat(F.lit("File size "), format_bytes(F.col("size")), F.lit(" exceeds limit "), format_bytes(F.lit(config.max_file_size)))
    ignored = config.ignore.ignores_file(F.col("file"))
    return files.withColumns({
        "is_ignored": ignored, "skipped": large & ~ignored, "skip_reason": F.when(large & ~ignored, reason),
        "is_binary": F.coalesce(is_binary(F.col("content")), F.lit(False)),
    })


def texts(files: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """What is scanned: file and content, decoded with replacement of malformed bytes."""
    open_ = file_status(files, config).filter("not is_ignored and not skipped and not is_binary")
    return open_.select("file", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
