"""Lines and, of long lines, windows: the unit that patterns are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, OVERLAP = 16 * 1024, 1024
INDICATOR = "[A-Z0-9\"'`:=/_@.-]"


def split_lines(files: DataFrame, keep: tuple[str, ...] = ("file",)) -> DataFrame:
    """One row per line: the ``keep`` columns, line_number (from 1), line. Carriage returns and a last empty line stay."""
    rows = files.select(*keep, F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n", -1)).alias("pos", "line"))
    return rows.select(*keep, (F.col("pos") + 1).alias("line_number"), "line")


def windows(lines: DataFrame) -> DataFrame:
    """``lines`` with long ones cut into overlapping windows; shift is where a window starts in its line. Windows
    of long lines without any character that a secret has are left out."""
    n = F.length("line")
    step = WINDOW - OVERLAP
    starts = F.sequence(F.lit(0), F.ceil((n - WINDOW) / step).cast("int") * step, F.lit(step))
    cut = lines.withColumn("shift", F.explode(F.when(n > WINDOW, starts).otherwise(F.array(F.lit(0)))))
    long_ = F.length("line") > WINDOW
    part = F.when(long_, F.substring(F.col("line"), F.col("shift") + 1, F.lit(WINDOW))).otherwise(F.col("line"))
    cut = cut.withColumn("is_part", long_).withColumn("line", part)
    return cut.filter(~F.col("is_part") | F.col("line").rlike(INDICATOR)).drop("is_part")
