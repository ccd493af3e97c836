"""Shared plumbing: reading tables, staging intermediate results, hashing words."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id wherever an id has to be compared or joined.
NULL_ID = -(1 << 63)

WORDS_PER_SHINGLE = 5
SIMILARITY = 0.8

_M64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting (tests, a laptop) gets a temporary folder; a cluster
    without it is an error, since executors couldn't see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master.startswith("local[") or master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='siftwell-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: cuts lineage, and lost executors
    don't repeat what led to it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*frames: DataFrame) -> None:
    """Deletes staged results that nothing to come reads (what reads them has been staged itself)."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def join_unique(rows: DataFrame, unique: DataFrame, key: str, n: str, spread: str, salts: int = 64, share: int = 512, how: str = "inner",
                hint: str | None = "shuffle_hash") -> DataFrame:
    """``rows`` with the columns of ``unique``, a staged table with one row for each ``key`` and ``n``, its number of rows.

    A key that holds more than one in ``share`` of the rows is dealt to ``salts`` parts by ``spread``, so no task gets all of them. There
    are fewer than ``share`` such keys whatever the data, so their hashes are a list in the plan. The table of keys is built into
    hashes, so the rows needn't be sorted; without ``hint`` Spark chooses, by its size. ``how`` may be "left"."""
    hinted = lambda df: df.hint(hint) if hint else df
    total = unique.agg(F.sum(n)).first()[0] or 0
    hot = [r[0] for r in unique.filter(F.col(n) > max(10_000, total // share)).select(F.xxhash64(key)).collect()]
    if not hot:
        return rows.join(hinted(unique), key, how)
    salt, is_hot = fresh(rows, "_salt"), F.xxhash64(key).isin(hot)
    dealt = rows.withColumn(salt, F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0))
    copies = F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    return dealt.join(hinted(unique.withColumn(salt, copies)), [key, salt], how).drop(salt)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def worker_state() -> dict:
    """A dict that lives as long as the Python worker, across tasks. Only for caches: results never depend on it."""
    return vars(sys.modules.setdefault("siftwell_worker_state", types.ModuleType("siftwell_worker_state")))


def id_or_null_id(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(NULL_ID))


class WordHashes(dict):
    """word -> XXH64, remembered. Emptied when it holds ``most`` words, so its memory is bounded."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return got

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits (uint64, wraps)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(words: np.ndarray, k: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """A hash for each run of ``k`` words; fewer words count as one run."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    factor = 1
    for j in range(k):
        factor = factor * 0x9E3779B97F4A7C15 & _M64 | 1
        out += words[j : n - k + 1 + j] * np.uint64(factor)
    return mix(out)


def signed(x: int) -> int:
    """An unsigned 64-bit value as Spark's long."""
    return x - (1 << 64) if x >> 63 else x
