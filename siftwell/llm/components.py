"""Connected components by min labels and pointer jumping, on DataFrames.

Each batch of edges is first contracted to stars, so that what one task found takes no rounds.
Each round takes the least label of a node's neighbours (aggregated on the map side, so a hub costs no
more than its links) and then the label's own label, so long chains shrink by half a round. Rounds are
staged in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import stage


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of each batch as stars around the least node of what they connect."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int, parent: dict[int, int] = parent) -> int:
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array([root(x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Gives node, component (the smallest node reachable), for nodes with an edge."""
    stars = stage(edges.select("a", "b").mapInArrow(_stars, "a long, b long").filter("a <> b"), "stars")
    both = stage(stars.union(stars.select("b", "a")).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        theirs = labels.select(F.col("node").alias("b"), F.col("label").alias("theirs"))
        least = both.join(theirs, "b").groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("theirs"))
        new = labels.join(least, "node").select("node", F.col("label").alias("old"), F.least("label", "theirs").alias("label"))
        new = stage(new, "hooked")
        roots = new.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = stage(new.join(roots, "label").select("node", "old", F.least("label", "root").alias("label")), "jumped")
        labels = jumped.select("node", "label")
        if jumped.filter("label <> old").isEmpty():
            return labels.withColumnRenamed("label", "component")
