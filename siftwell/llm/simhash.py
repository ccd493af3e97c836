"""SimHash near-dedup by BK-trees.

A fingerprint has a bit set where over half of the word shingles' XXH64 have it. Fingerprints within
``radius`` bits link, and documents fall into the components of these links. Equal fingerprints are one
node, so copies cost nothing further.

Fingerprints cut into radius + 2 blocks agree on at least two blocks if they differ in at most radius bits: each
pair of blocks is a shard key, and a shard's fingerprints form a BK-tree, whose children are keyed
by their Hamming distance to the parent; a search follows only edges within the radius. Shards of more than
``shard_size`` are cut again in the same way on their remaining bits, which leaves at most 2^16 distinct
fingerprints a shard at radius 2, so a tree's size is bounded. Trees go to tasks shard by shard: broadcasting
them all would put every document's fingerprint on the driver. A shard gives a spanning forest of its links,
never all pairs.

Defined results: a null, empty or blank text has fingerprint zero, linked like any other; a null doc_id never is
a component's smallest unless all are null; repeated rows get equal results; an empty table gives
none. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import fresh, join_unique, signed, stage
from siftwell.llm.components import components

BITS = 64
_BLOCK = 1 << 16


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Unsigned. bytes.lower and bytes.split know just A-Z and the six ASCII blanks."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    k = min(words, len(found))
    total, n, ones = len(found) - k + 1, 0, np.zeros(BITS, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, total, _BLOCK):
        part = found[at : min(at + _BLOCK, total) + k - 1]
        h = np.array([digest(join(x), seed) for x in zip(*(part[j:] for j in range(k)))], np.uint64)  # noqa: B905
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return sum(1 << j for j in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(documents: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, text_hash (with doc_id it tells rows apart), fingerprint (as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [signed(fingerprint(x.as_py(), words)) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.int64())], ["doc_id", "text_hash", "fingerprint"])

    rows = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, fingerprint long")


class BKTree:
    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        at = self.root
        while True:
            d = (at[0] ^ value).bit_count()
            if not d:
                return
            below = at[1].get(d)
            if below is None:
                at[1][d] = (value, {})
                return
            at = below

    def within(self, value: int, radius: int) -> list[int]:
        found, stack = [], [self.root] if self.root else []
        while stack:
            own, children = stack.pop()
            d = (own ^ value).bit_count()
            if d <= radius:
                found.append(own)
            if children:
                for edge in range(max(1, d - radius), d + radius + 1):
                    if (child := children.get(edge)) is not None:
                        stack.append(child)
        return found


def spanning_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join what the shard's links join: a forest."""
    tree, parent, out = BKTree(), {}, []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for value in values:
        parent[value] = value
        for near in tree.within(value, radius):
            a, b = root(near), root(value)
            if a != b:
                parent[b] = a
                out.append((near, value))
        tree.add(value)
    return out


def _spans(bits: list[int], parts: int) -> list[list[int]]:
    return [bits[len(bits) * i // parts : len(bits) * (i + 1) // parts] for i in range(parts)]


def _mask(bits: list[int]) -> int:
    return signed(sum(1 << b for b in bits))


def shard_keys(value: Column, radius: int, bits: list[int], salt: Column | None = None) -> Column:
    """Array of shard keys: one for each pair of blocks of ``bits``."""
    keys = []
    for n, (a, b) in enumerate(combinations(_spans(bits, radius + 2), 2)):
        keys.append(F.xxhash64(*([salt] if salt is not None else []), F.lit(n), value.bitwiseAND(F.lit(_mask(a + b)))))
    return F.array(*keys)


def links(nodes: DataFrame, radius: int = 2, shard_size: int = 4096) -> DataFrame:
    """a, b: links that join the fingerprints (column fingerprint, distinct) of ``nodes``."""
    every = list(range(BITS))
    rows = nodes.select("fingerprint", F.posexplode(shard_keys(F.col("fingerprint"), radius, every)).alias("pair", "shard"))
    counts = stage(rows.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1"), "shard-sizes")
    rows = stage(join_unique(rows, counts, "shard", "n", "fingerprint"), "shards")
    small = rows.filter(F.col("n") <= shard_size).select("shard", "fingerprint")
    again = F.array()
    for n, (a, b) in reversed(list(enumerate(combinations(_spans(every, radius + 2), 2)))):
        rest = [x for x in every if x not in a and x not in b]
        again = F.when(F.col("pair") == n, shard_keys(F.col("fingerprint"), radius, rest, F.col("shard"))).otherwise(again)
    large = rows.filter(F.col("n") > shard_size).select(F.explode(again).alias("shard"), "fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((s, f) for batch in batches for s, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        out: list[tuple[int, int]] = []
        for _, group in groupby(pairs, lambda x: x[0]):
            values = [f & ((1 << BITS) - 1) for _, f in group]
            if len(values) > 1:
                out += [(signed(a), signed(b)) for a, b in spanning_links(values, radius)]
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    dealt = small.union(large).repartition("shard").sortWithinPartitions("shard", "fingerprint")
    return dealt.mapInArrow(run, "a long, b long")


def near_groups(documents: DataFrame, words: int = 3, radius: int = 2, shard_size: int = 4096) -> DataFrame:
    """doc_id, text_hash, fingerprint (long), component (its smallest fingerprint), component_id: its smallest doc_id."""
    rows = stage(fingerprints(documents, words), "fingerprints")
    nodes = stage(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "nodes")
    found = stage(links(nodes, radius, shard_size), "links")
    if found.isEmpty():
        least = nodes.select("fingerprint", F.col("fingerprint").alias("component"), F.col("doc_id").alias("component_id"), "n")
    else:
        joined = components(found).withColumnRenamed("node", "fingerprint")
        named = nodes.join(joined, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
        named = stage(named, "named")
        smallest = stage(named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("members")), "smallest")
        least = join_unique(named, smallest, "component", "members", "fingerprint", hint=None)
        least = stage(least.select("fingerprint", "component", "component_id", "n"), "least")
    return join_unique(rows, least, "fingerprint", "n", "doc_id", hint=None).select("doc_id", "text_hash", "fingerprint", "component", "component_id")


def drop_near_copies(documents: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """One row of ``documents`` for each component, that with the smallest doc_id, with all its columns."""
    stay = near_groups(documents, words, radius).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = F.min(F.struct("fingerprint", "text_hash")).alias("first")
    own, least, code = (fresh(documents, c) for c in ("_own", "_least", "_code"))
    stay = stay.groupBy("component", "component_id").agg(first).select(F.col("component_id").alias(least), F.col("first.text_hash").alias(code))
    rows = documents.withColumn(own, F.xxhash64("text"))
    joined = rows.join(stay, rows["doc_id"].eqNullSafe(stay[least]) & (rows[own] == stay[code]))
    return joined.dropDuplicates(["doc_id", own]).select(*documents.columns)
