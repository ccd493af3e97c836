"""Best-fit packing with certified bin counts.

Documents become token pieces; pieces are dealt to partitions by hash, each partition packs its own
by best-fit decreasing, and dual-feasible functions give a lower bound for its number of bins. A
partition whose bins meet the bound is certified: only its emptiest bin is left open. A partition
with a gap opens every bin that has room. Opened documents are exchanged - regrouped over half as many
partitions - and packed again; a group keeps its new packing only if that takes fewer bins, and its bins stay open as long
as it has a gap. This goes on until one group has been tried (``pack`` says what bounds a group's size).

Defined results: a null or empty text has only the end token; a piece as long as a sequence fills one
alone; rows that share a doc_id, and repeated rows, are packed each on its own; an empty table gives none.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.llm.common import stage, worker_state

CAPACITY = 4096
END_ID = 1
#: Python splits at these too, the tokenizer's white space doesn't hold them.
_NOT_BLANK = "\x1c\x1d\x1e\x1f"


class WordIds:
    """Texts to ids as little-endian uint32 bytes.

    The tokenizer lower-cases a text, cuts it into pre-tokens and encodes each on its own, so the ids of a
    pre-token can be remembered. Texts of Latin letters and ASCII are cut here; new pre-tokens are
    encoded many at a time, joined by blanks, and the ids cut again where a token ends a pre-token. Other texts (any
    composed characters, special tokens, or blanks that the libraries see differently) go to the tokenizer whole. Pre-tokens are
    held in two generations of about ``most`` each; the older goes when the newer is full, so memory is bounded."""

    #: Letters and numbers among the lower-cased characters that are cut here; the pattern is the tokenizer's own (fixed values).
    LETTERS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff\u0100-\u017f"
    NUMBERS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
    PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+"
    JOINED = 1000

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        own = json.loads(self.tokenizer.to_str())
        by_blanks = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
        as_bytes = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        own |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [by_blanks, as_bytes]}}
        self.bare = Tokenizer.from_str(json.dumps(own))
        self.cut = re.compile(self.PRE_TOKEN).findall
        self.latin = re.compile("[\x00-\u012f\u0131-\u017f]*").fullmatch
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, parts: list[str]) -> None:
        for at in range(0, len(parts), self.JOINED):
            some = parts[at : at + self.JOINED]
            ids = np.array(self.bare.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) != len(some):
                self.new.update((p, self._whole(p)) for p in some)
                continue
            held = ids.tobytes()
            self.new.update((p, held[a:b]) for p, a, b in zip(some, [0, *stops], stops, strict=False))

    def _is_cut_here(self, text: str) -> bool:
        return (text.isascii() or self.latin(text) is not None) and "<|" not in text and not any(c in text for c in _NOT_BLANK)

    def of_all(self, texts: list[str]) -> list[bytes]:
        cuts = [self.cut(t.lower()) if self._is_cut_here(t) else None for t in texts]
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        found = [list(map(new.get, c)) if c is not None else [] for c in cuts]
        missing, unknown = [], set()
        for c, f in zip(cuts, found, strict=True):
            at = list(compress(range(len(f)), map(not_, f)))
            missing.append(at)
            unknown.update(c[i] for i in at)
        known = {p: old[p] for p in unknown if p in old}
        new.update(known)
        self._learn([p for p in unknown if p not in known])
        for c, f, at in zip(cuts, found, missing, strict=True):
            for i in at:
                f[i] = new[c[i]]
        return [b"".join(f) if c is not None else self._whole(t) for t, c, f in zip(texts, cuts, found, strict=True)]


def tokenize(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (binary, little-endian uint32)."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        caches = worker_state().setdefault("word_ids", {})
        words = caches.get(tokenizer_path) or caches.setdefault(tokenizer_path, WordIds(tokenizer_path))
        size = 4 * capacity
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for first in range(0, len(docs), 256):
                texts = [x.as_py() or "" for x in batch.column(1)[first : first + 256]]
                out = []
                for doc, ids in zip(docs[first : first + 256], words.of_all(texts), strict=True):
                    ids += end
                    out += [(doc, at // size, at // 4, len(cut := ids[at : at + size]) // 4, cut) for at in range(0, len(ids), size)]
                yield _rows(out)

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs: the best of two families of dual-feasible functions."""
    n = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    if not n.sum():
        return 0
    x = np.arange(capacity + 1, dtype=np.int64)
    best = math.ceil(int((n * x).sum()) / capacity)
    # small items vanish, those that only fit beside vanished ones take a whole bin
    count, volume = np.cumsum(n), np.cumsum(n * x)
    for least in range(1, capacity // 2 + 1):
        large = int(count[-1] - count[capacity - least])
        middle = int(volume[capacity - least] - volume[least - 1])
        best = max(best, large + math.ceil(middle / capacity))
    # rounding to multiples of 1/k, in exact integers: each value is scaled by k * capacity
    for k in range(1, 33):
        part, rest = np.divmod((k + 1) * x, capacity)
        value = np.where(rest == 0, x * k, part * capacity)
        best = max(best, -(-int((n * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each item, and each bin's room. Bit r of ``rooms`` says that a bin has room r."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = rooms >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                rooms &= ~(1 << r)
        else:
            b, r = len(room), capacity
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - r
        room[b] = r - size
        if room[b]:
            by_room.setdefault(room[b], []).append(b)
            rooms |= 1 << room[b]
    return bins, offsets, room


def _pack_group(rows: dict[str, np.ndarray], number: int, group: int, capacity: int) -> dict[str, np.ndarray]:
    """Sequence, offset and open for a group's rows. The old packing stays if the new one takes no fewer bins; either way, a
    group whose bins are as few as the bound and lack less than one bin has its emptiest bin open, another one every bin with room."""
    lengths, old = rows["length"], rows["sequence_id"]
    bins, offsets, room = best_fit_decreasing(lengths, capacity)
    slack, sequence = np.array(room), (np.int64(number) << np.int64(57)) | (np.int64(group) << np.int64(26)) | bins
    if number:
        own, old_bins = np.unique(old, return_inverse=True)
        if len(own) <= len(room):
            bins, offsets, sequence = old_bins, rows["offset"], old
            slack = capacity - np.bincount(bins, weights=lengths).astype(np.int64)
    open_bins = slack > 0
    if len(slack) == lower_bound(lengths, capacity) and 0 < slack.sum() < capacity:
        open_bins = np.arange(len(slack)) == int(slack.argmax())
    return {"sequence_id": sequence, "offset": offsets, "open": open_bins[bins]}


def _packer(number: int, capacity: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        # rows come in any order: ties are packed by id
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "piece") if c in table.column_names])
        got = {c: table.column(c).to_numpy() for c in ("length", "sequence_id", "offset")}
        new = _pack_group(got, number, table.column("group")[0].as_py(), capacity)
        for c in ("sequence_id", "offset"):
            table = table.set_column(table.schema.get_field_index(c), c, pa.array(new[c]))
        return table.append_column("open", pa.array(new["open"]))

    return run


def _dealt(rows: DataFrame, groups: int, per_partition: int) -> DataFrame:
    """``rows`` with their group, by a hash of all columns, so that files and cores don't matter. Only where rows that are equal in every
    column fill a group several times are they dealt on, by their place."""
    columns = rows.columns
    rows = rows.withColumn("group", F.pmod(F.xxhash64(*columns), F.lit(groups)))
    full = rows.groupBy("group").agg(F.ceil(F.count("*") / per_partition).alias("parts")).filter("parts > 4")
    full = stage(full.withColumn("first", F.sum("parts").over(Window.orderBy("group")) - F.col("parts")), "full-groups")
    if full.isEmpty():
        return rows
    some = F.pmod(F.monotonically_increasing_id(), F.col("parts"))
    return rows.join(full, "group", "left").withColumn("group", F.when(F.col("parts").isNull(), F.col("group")).otherwise(groups + F.col("first") + some)).drop("parts", "first")


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_partition: int = 8192, most: int | None = None) -> DataFrame:
    """``pieces`` (doc_id, piece, length and more) with sequence_id and offset.

    ``per_partition``: pieces that one partition packs, about. What stays open is exchanged among half as many groups each round, until
    one has been tried or a group holds ``most`` pieces (32 partitions), and then once more in other groups; so a
    task's memory is bounded, and the result hardly depends on ``per_partition``."""
    columns = pieces.columns
    rows = stage(pieces, "pieces")
    groups = max(1, math.ceil(rows.count() / per_partition))
    most = most or 32 * per_partition
    rows = _dealt(rows, groups, per_partition).withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", open boolean"
    done: list[DataFrame] = []
    number, last = 0, groups == 1
    while True:
        packed = stage(rows.groupBy("group").applyInArrow(_packer(number, capacity), schema), f"packed-{number}")
        n_open = 0 if last else packed.filter("open").count()
        if not n_open:
            done.append(packed)
            break
        done.append(packed.filter(~F.col("open")))
        fewer = max(1, math.ceil(n_open / most), min(groups // 2, math.ceil(n_open / per_partition)))
        last = fewer == 1 or fewer >= groups
        groups, number = fewer, number + 1
        # bins stay together, so that a group's new packing can be held against the old one
        rows = packed.filter("open").drop("open").withColumn("group", F.pmod(F.xxhash64(F.lit(number), "sequence_id"), F.lit(groups)))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*columns, "sequence_id", "offset")
