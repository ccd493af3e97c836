"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item is contained in a document if at least ``threshold`` of the item's word shingles are among
the document's. Items are partitioned by their number of shingles, in powers of two. A partition's
signature is the bottom-m MinHash of the item with m = floor((1 - threshold) * upper) + 1 for the
partition's upper size: a document that lacks at most (1 - threshold) of the shingles has one of them, whatever
the document's length, so the search loses nothing. A document that holds any shingle of a signature is
a candidate, and exact containment of the shingles themselves decides.

Items are a stated query set, taken to the tasks in blocks of at most ``block_items`` items and
``block_chars`` characters (one item at least). ``held_blocks`` of them are broadcast at a time and met in one
pass over the rows; before the next ones come, the marked rows are written to the shared folder and these
broadcasts are given up, so what driver and executors hold is bounded whatever the benchmark's size.

Words are the runs of letters, digits and underscores of the lower-cased text; an item of fewer than five
words is one shingle of its length. Defined results: a null or wordless text or item matches nothing;
repeated items and rows match each on its own; an empty table or benchmark gives no match. Other columns
of ``documents`` are carried along.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftwell.llm.common import SIMILARITY, WORDS_PER_SHINGLE, WordHashes, drop_staged, fresh, shingle_hashes, stage

WORD = re.compile(r"\w+")
_SHIFT = np.uint64(44)
MATCHES = "array<struct<item_id:bigint,item_shingles:int,shared:int,containment:double>>"
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("item_shingles", pa.int32()), ("shared", pa.int32()), ("containment", pa.float64())]))


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles_of(words: list[str], k: int) -> set[tuple[str, ...]]:
    return set(zip(*(words[j:] for j in range(k))))  # noqa: B905


def signature_size(n: int, threshold: float) -> int:
    upper = (1 << n.bit_length()) - 1
    return min(n, int((1 - threshold) * upper + 1e-9) + 1)


class ItemIndex:
    """Signatures of a block of items, by shingle length."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.items: list[tuple[int | None, int, set[tuple[str, ...]]]] = []
        self.by_length: dict[int, tuple[np.ndarray, dict[int, list[int]]]] = {}

    def fill(self, items: list[tuple[int | None, str | None]], k: int) -> tuple[list, dict]:
        """Its parts as plain values, which a broadcast can carry."""
        hashes, held = WordHashes(), defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            own = min(k, len(words))
            shingles = shingles_of(words, own)
            least = np.sort(np.unique(shingle_hashes(hashes.of(words), own)))[: signature_size(len(shingles), self.threshold)]
            for h in least.tolist():
                held[own][h].append(len(self.items))
            self.items.append((item_id, own, shingles))
        for own, signatures in held.items():
            seen = np.zeros(1 << 20, bool)
            seen[(np.array(list(signatures), np.uint64) >> _SHIFT).astype(np.int64)] = True
            self.by_length[own] = (seen, dict(signatures))
        return self.items, self.by_length

    def search(self, text: str | None, hashes: WordHashes) -> list[dict]:
        words = words_of(text)
        if not words:
            return []
        coded, candidates = hashes.of(words), set()
        for own, (seen, signatures) in self.by_length.items():
            if own > len(words):
                continue
            s = shingle_hashes(coded, own)
            for h in s[seen[(s >> _SHIFT).astype(np.int64)]].tolist():
                candidates.update(signatures.get(h, ()))
        out, sets = [], {}
        for at in sorted(candidates):
            item_id, own, shingles = self.items[at]
            if own not in sets:
                sets[own] = shingles_of(words, own)
            shared = len(shingles & sets[own])
            if shared >= self.threshold * len(shingles) - 1e-9:
                out.append({"item_id": item_id, "item_shingles": len(shingles), "shared": shared, "containment": shared / len(shingles)})
        return out


def _blocks(benchmark: DataFrame, block_items: int, block_chars: int) -> Iterator[list[tuple[int | None, str | None]]]:
    block, chars = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        size = len(row["text"] or "")
        if block and (len(block) >= block_items or chars + size > block_chars):
            yield block
            block, chars = [], 0
        block.append((row["item_id"], row["text"]))
        chars += size
    if block:
        yield block


def _marker(parts: Broadcast, threshold: float, at_text: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, index = WordHashes(), ItemIndex(threshold)
        index.items, index.by_length = parts.value
        for batch in batches:
            found = [index.search(x.as_py(), hashes) for x in batch.column(at_text)]
            marked = batch.column(batch.num_columns - 1)
            if any(found):
                marked = pa.array([a + b for a, b in zip(marked.to_pylist(), found, strict=True)], _ARROW)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], marked], names=batch.schema.names)

    return run


def mark(documents: DataFrame, benchmark: DataFrame, k: int = WORDS_PER_SHINGLE, threshold: float = SIMILARITY,
         block_items: int = 5000, block_chars: int = 8_000_000, held_blocks: int = 8) -> DataFrame:
    """``documents`` with one more column, the last, _matches (or a ``fresh`` name): the items contained in each row's text."""
    spark = documents.sparkSession
    out = documents.withColumn(fresh(documents, "_matches"), F.array().cast(MATCHES))
    schema: StructType = out.schema
    at_text = documents.columns.index("text")
    held, staged = [], []
    for block in _blocks(benchmark, block_items, block_chars):
        if len(held) == held_blocks:
            out = stage(out, "marked")
            drop_staged(*staged)
            for parts in held:
                parts.destroy()
            held, staged = [], [out]
        parts = spark.sparkContext.broadcast(ItemIndex(threshold).fill(block, k))
        held.append(parts)
        out = out.mapInArrow(_marker(parts, threshold, at_text), schema)
    return out


def matches(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document and contained item: doc_id, item_id, item_shingles, shared, containment."""
    found = mark(documents.select("doc_id", "text"), benchmark, **options)
    return found.select("doc_id", F.explode("_matches").alias("m")).select("doc_id", "m.*")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    marked = mark(documents, benchmark, **options)
    return marked.filter(F.size(marked.columns[-1]) == 0).select(*documents.columns)
