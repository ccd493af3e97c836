"""Exact dedup by Patricia tries.

Each task first merges its own rows in a trie, so a text that a third of all rows share leaves a task
once, whatever its number of copies. What is left is dealt by length and content hash: each range of hashes has a
compressed radix trie, which full byte strings are inserted into and whose terminal nodes hold the owner
(``keep``: the largest or smallest doc_id). Only whole byte strings decide; the hash merely deals. A trie
beyond its budget spills its largest subtrees; Spark writes their rows to the shared folder and deals them anew, until none are left.
A string larger than the budget is a trie of its own.

Defined results: a null text is empty; a null doc_id loses against any other; of rows that tie on the
owner's doc_id exactly one is kept; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import fresh, signed, stage


class Node:
    __slots__ = ("edge", "children", "value")

    def __init__(self, edge: bytes):
        self.edge, self.children, self.value = edge, {}, None


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low + 1 < high:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low if a[low : low + 1] != b[low : low + 1] else low + 1


#: In place of a child whose subtree was spilled.
_GONE = Node(b"")


class PatriciaTrie:
    """Byte strings with a value each. ``merge(old, new)`` joins the values of equal strings.

    Beyond ``budget`` bytes the largest subtrees below the first branching go to ``spilled``, down to half of the budget; what is inserted below
    them later follows. Equal strings thus stay or go together. One part stays always, so a single string never goes."""

    def __init__(self, merge: Callable, budget: int = 64 << 20):
        self.root, self.merge, self.budget, self.bytes = Node(b""), merge, budget, 0
        self.spilled: list[tuple[bytes, object]] = []

    def insert(self, key: bytes, value: object) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.bytes += len(child.edge) + 200
                node, at = child, len(key)
                break
            if child is _GONE:
                self.spilled.append((key, value))
                return
            edge = child.edge
            if key.startswith(edge, at):
                node, at = child, at + len(edge)
                continue
            cut = _shared(edge, key[at : at + len(edge)])
            upper = Node(edge[:cut])
            child.edge = edge[cut:]
            upper.children[child.edge[0]] = child
            node.children[key[at]] = upper
            self.bytes += 200
            node, at = upper, at + cut
        node.value = value if node.value is None else self.merge(node.value, value)
        if self.bytes > self.budget:
            self._spill()

    @staticmethod
    def _walk(node: Node, prefix: bytes) -> Iterator[tuple[bytes, Node]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            yield prefix, node
            stack += [(child, prefix + child.edge) for child in node.children.values() if child is not _GONE]

    @staticmethod
    def _size(node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            node = stack.pop()
            total += len(node.edge) + 200
            stack += [child for child in node.children.values() if child is not _GONE]
        return total

    def _spill(self) -> None:
        node, prefix = self.root, b""
        while True:
            held = {first: child for first, child in node.children.items() if child is not _GONE}
            if len(held) != 1 or node.value is not None:
                break
            node = next(iter(held.values()))
            prefix += node.edge
        sizes = {first: self._size(child) for first, child in held.items()}
        order = sorted(sizes, key=sizes.__getitem__, reverse=True)
        for first in order if node.value is not None else order[:-1]:
            if self.bytes <= self.budget // 2:
                break
            gone = node.children[first]
            self.spilled += [(key, n.value) for key, n in self._walk(gone, prefix + gone.edge) if n.value is not None]
            node.children[first] = _GONE
            self.bytes -= sizes[first]

    def resident(self) -> Iterator[tuple[bytes, object]]:
        return ((key, n.value) for key, n in self._walk(self.root, b"") if n.value is not None)

    def items(self) -> Iterator[tuple[bytes, object]]:
        """All strings; what was spilled takes tries of its own, one after another."""
        trie = self
        while True:
            yield from trie.resident()
            if not (rows := trie.spilled):
                return
            trie = PatriciaTrie(self.merge, self.budget)
            for key, value in rows:
                trie.insert(key, value)


def _better(a: int | None, b: int | None, largest: bool) -> bool:
    """Whether a beats b."""
    if a is None or b is None:
        return b is None and a is not None
    return a > b if largest else a < b


_LOCAL = pa.schema([
    ("is_text", pa.bool_()), ("rep", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("is_owner", pa.bool_()),
    ("sha256", pa.string()), ("length", pa.int64()), ("hash", pa.int64()), ("content", pa.binary()),
])
_LOCAL_DDL = "is_text boolean, rep long, doc_id long, n long, is_owner boolean, sha256 string, length long, hash long, content binary"


_MERGED = pa.schema([
    ("done", pa.bool_()), ("doc_id", pa.int64()), ("rep", pa.int64()), ("n", pa.int64()), ("reps", pa.list_(pa.int64())),
    ("length", pa.int64()), ("hash", pa.int64()), ("content", pa.binary()),
])
_MERGED_DDL = "done boolean, doc_id long, rep long, n long, reps array<long>, length long, hash long, content binary"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def owners(documents: DataFrame, keep: str = "largest", normalise: Callable[[str], str] | None = None, budget: int = 32 << 20) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``documents``."""
    largest = {"largest": True, "smallest": False}[keep]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 36, 0

        def flush(trie: PatriciaTrie) -> Iterator[pa.RecordBatch]:
            nonlocal made
            rows, held = [], 0
            for content, members in trie.items():
                sha, rep = hashlib.sha256(content).hexdigest(), first + made
                made += 1
                best = 0
                for i, doc in enumerate(members):
                    if _better(doc, members[best], largest):
                        best = i
                rows.append((True, rep, members[best], len(members), None, None, len(content), signed(xxhash.xxh64_intdigest(content)), content))
                rows += [(False, rep, doc, None, i == best, sha, None, None, None) for i, doc in enumerate(members)]
                held += len(content)
                if held >= 1 << 23 or len(rows) >= 20_000:
                    yield _batch(rows, _LOCAL)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, _LOCAL)

        def extend(a: list, b: list) -> list:
            a.extend(b)
            return a

        trie = PatriciaTrie(extend, 1 << 62)
        rows = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                trie.insert((normalise(text) if normalise else text).encode("utf-8", "surrogatepass"), [doc])
                rows += 1
                if trie.bytes > budget or rows >= 200_000:
                    yield from flush(trie)
                    trie, rows = PatriciaTrie(extend, 1 << 62), 0
        yield from flush(trie)

    def join(a: list, b: list) -> list:
        """best doc_id, its rep, size, reps"""
        if _better(b[0], a[0], largest):
            a[:2] = b[:2]
        a[2] += b[2]
        a[3].extend(b[3])
        return a

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0

        def rows(found: Iterator[tuple[bytes, list]], done: bool) -> Iterator[pa.RecordBatch]:
            nonlocal out, size
            for content, (doc, rep, n, reps) in found:
                out.append((done, doc, rep, n, reps, None if done else len(content), None if done else signed(xxhash.xxh64_intdigest(content)), None if done else content))
                size += 0 if done else len(content)
                if len(out) >= 10_000 or size >= 1 << 23:
                    yield _batch(out, _MERGED)
                    out, size = [], 0

        bucket, trie = None, PatriciaTrie(join, budget)
        for batch in batches:
            for own, doc, rep, n, reps, content in zip(*(batch.column(c).to_pylist() for c in range(5)), batch.column(5), strict=True):
                if own != bucket:
                    yield from rows(trie.resident(), True)
                    bucket, trie = own, PatriciaTrie(join, budget)
                trie.insert(content.as_py(), [doc, rep, n, reps])
                if trie.spilled:
                    yield from rows(trie.spilled, False)
                    trie.spilled = []
        yield from rows(trie.resident(), True)
        if out:
            yield _batch(out, _MERGED)

    rows = stage(documents.select("doc_id", "text").mapInArrow(local, _LOCAL_DDL), "exact-local")
    left = rows.filter("is_text").select("doc_id", "rep", "n", F.array("rep").alias("reps"), "length", "hash", "content")
    found, number = None, 0
    while True:
        # a trie for each range of hashes, half of the budget on the average
        total = left.agg(F.sum(F.col("length") + 200)).first()[0] or 0
        buckets = max(1, 2 * total // budget)
        dealt = left.withColumn("bucket", F.pmod(F.xxhash64(F.lit(number), "length", "hash"), F.lit(buckets))).repartition("bucket").sortWithinPartitions("bucket")
        merged = stage(dealt.select("bucket", "doc_id", "rep", "n", "reps", "content").mapInArrow(merge, _MERGED_DDL), f"exact-owners-{number}")
        done = merged.filter("done").select(F.col("doc_id").alias("keep_id"), F.col("rep").alias("keep_rep"), F.col("n").alias("group_size"), F.explode("reps").alias("rep"))
        found = done if found is None else found.unionByName(done)
        left, number = merged.filter("not done").drop("done"), number + 1
        if left.isEmpty():
            break
    members = rows.filter("not is_text").select("doc_id", "rep", "is_owner", "sha256")
    return members.join(found, "rep").select(
        "doc_id", "keep_id", "group_size", (F.col("is_owner") & (F.col("keep_rep") == F.col("rep"))).alias("kept"), F.col("sha256").alias("text_sha256")
    )


def drop_copies(documents: DataFrame, keep: str = "largest") -> DataFrame:
    """The rows of ``documents`` that stay, with all their columns."""
    own, owner, sha = (fresh(documents, c) for c in ("_own", "_owner", "_sha"))
    stay = owners(documents, keep).filter("kept").select(F.col("doc_id").alias(owner), F.col("text_sha256").alias(sha)).distinct()
    rows = documents.withColumn(own, F.sha2(F.coalesce("text", F.lit("")), 256))
    joined = rows.join(stay, rows["doc_id"].eqNullSafe(stay[owner]) & (rows[own] == stay[sha]))
    return joined.dropDuplicates(["doc_id", own]).select(*documents.columns)
