"""Byte-pair encoding and decoding by rounds of merges over flat arrays.

The distinct words of a batch lie one after the other in one array of symbols. A round looks up all adjacent pairs in the sorted keys of
the merge table by binary search, finds each word's lowest rank and merges every place where the word has that pair, left to right; words
without a pair in the table leave the array. Since a pair of a merged symbol always ranks after the merge that makes it (checked when the table is
read), this is what one merge at a time gives. Words of over ``LONG`` bytes, where a round would do little, take their pairs from a heap.

Words are cut as the tokenizer's file says: texts of Latin letters here, others by the library's own normalizer and pre-tokenizer; special tokens are
found in the raw text. Words' ids are remembered in two generations, so memory is bounded; a long text is encoded in pieces that end
before a blank, which changes nothing.

Defined results: a null or empty text has no ids and decodes to an empty text; repeated rows get equal results; an empty table gives none.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftwell.llm.common import worker_state
from siftwell.llm.packing import WordIds

LONG, PIECE, OUT = 2048, 1 << 20, 16 << 20
_NONE = np.int32(np.iinfo(np.int32).max)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it can be printed, else the next free one from 256 on."""
    printed = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in printed else next(free)) for b in range(256)]


class MergeTable:
    """Symbols of words to ids. ``vocabulary``: token -> id; ``merges``: pairs of tokens by rank; ``end``: what the last symbol of a word has at its end."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.size = max(vocabulary.values()) + 1
        letters = byte_letters()
        self.inner = np.array([vocabulary[x] for x in letters], np.int32)
        self.last = np.array([vocabulary[x + end] for x in letters], np.int32)
        ids = np.array([(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in merges], np.int64)
        made = np.full(self.size, -1)
        made[ids[:, 2]] = np.arange(len(ids))
        if len(np.unique(ids[:, 2])) < len(ids) or (made[ids[:, :2]] >= np.arange(len(ids))[:, None]).any():
            raise ValueError("a merge's tokens must be made by earlier merges, each by one")
        keys = ids[:, 0] * self.size + ids[:, 1]
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), ids[order, 2].astype(np.int32)
        self.of_rank = ids[:, 2].astype(np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``_NONE`` if it is no merge."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian uint32; words aren't empty."""
        short = [w for w in words if len(w) <= LONG]
        ids, stops = self._rounds(short)
        held, ends = ids.astype("<u4").tobytes(), (4 * stops).tolist()
        cut = iter([held[a:b] for a, b in zip([0, *ends], ends, strict=False)])
        return [next(cut) if len(w) <= LONG else self._by_heap(w) for w in words]

    def _rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each word's end."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols, word = self.inner[raw], np.repeat(np.arange(len(words)), lengths)
        tails = np.cumsum(lengths) - 1
        symbols[tails] = self.last[raw[tails]]
        ranks = np.full(len(symbols), _NONE)  # of the pair that starts here
        if len(symbols) > 1:
            ranks[:-1] = self.rank(symbols[:-1], symbols[1:])
            ranks[tails] = _NONE
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            each = np.diff(np.append(heads, len(word)))
            least = np.repeat(np.minimum.reduceat(ranks, heads), each)
            open_ = least != _NONE
            if not open_.all():
                done.append((word[~open_], symbols[~open_]))
                symbols, word, ranks, least = symbols[open_], word[open_], ranks[open_], least[open_]
            at = np.flatnonzero(ranks == least)
            if not len(at):
                break
            # of overlapping places (a run of one symbol) the first, third, ... are merged
            begins = np.concatenate([[True], np.diff(at) != 1])
            in_run = at - at[np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))]
            at = at[in_run % 2 == 0]
            symbols[at] = self.of_rank[ranks[at]]
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            new = np.cumsum(stays)[at] - 1
            symbols, word, ranks = symbols[stays], word[stays], ranks[stays]
            near = np.unique(np.concatenate([new, new[new > 0] - 1]))
            paired = near[near < len(symbols) - 1]
            ranks[near] = _NONE
            ranks[paired] = np.where(word[paired] == word[paired + 1], self.rank(symbols[paired], symbols[paired + 1]), _NONE)
        if not done:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        words_of, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        return ids[np.argsort(words_of, kind="stable")], np.cumsum(np.bincount(words_of, minlength=len(words)))

    def _by_heap(self, word: bytes) -> bytes:
        raw = np.frombuffer(word, np.uint8)
        first = np.append(self.inner[raw[:-1]], self.last[raw[-1]])
        symbols, n = first.tolist(), len(first)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i) for i, r in enumerate(self.rank(first[:-1], first[1:]).tolist()) if r != _NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def rank(a: int, b: int) -> int:
            if (a, b) not in known:
                known[a, b] = int(self.rank(np.array([a]), np.array([b]))[0])
            return known[a, b]

        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if symbols[i] >= 0 else -1
            if j < 0 or rank(symbols[i], symbols[j]) != r:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = int(self.of_rank[r]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (x := rank(symbols[a], symbols[b])) != _NONE:
                    heapq.heappush(heap, (x, a))
        return np.array([s for s in symbols if s >= 0], "<u4").tobytes()


class Encoder:
    """Texts to ids and back, by a tokenizer's file."""

    #: Blanks among the characters that are cut here; the libraries' classes differ, so they are spelt out (fixed values).
    BLANKS = r"\t\n\x0b\x0c\r \x85\xa0"
    WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|[{WordIds.LETTERS}]+|[{WordIds.NUMBERS}]|[^{BLANKS}{WordIds.LETTERS}{WordIds.NUMBERS}]+"

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            own = json.load(file)
        model = own["model"]
        self.table = MergeTable(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"])
        self.specials = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in own["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))))
        self.tokens = [""] * (1 + max([*model["vocab"].values(), *(t["id"] for t in own["added_tokens"])]))
        for token, i in [*model["vocab"].items(), *((t["content"], t["id"]) for t in own["added_tokens"])]:
            self.tokens[i] = token
        self.library, self.most = Tokenizer.from_file(path), most
        self.byte_of = {x: b for b, x in enumerate(byte_letters())}
        self.cut = re.compile(self.WORD).findall
        self.latin = re.compile("[\x00-įı-ſ]*").fullmatch
        self.blank = re.compile("[ \n]").search
        self.new: dict[str | bytes, bytes] = {}
        self.old: dict[str | bytes, bytes] = {}

    def words(self, text: str) -> list[str | bytes]:
        """The words of a text without special tokens, normalized; bytes where the library has cut them."""
        if text.isascii() or self.latin(text) is not None:
            return self.cut(text.lower())
        normal = self.library.normalizer.normalize_str(text)
        return [bytes(map(self.byte_of.__getitem__, w)) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def pieces(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PIECE:
            blank = self.blank(text, at + PIECE)
            if not blank:
                break
            yield text[at : blank.start()]
            at = blank.start()
        yield text[at:]

    def _parts(self, text: str) -> list[str | bytes | re.Match]:
        """Words, and special tokens as matches."""
        if not any(s in text for s in self.specials):
            return self.words(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*self.words(text[at : m.start()]), m]
            at = m.end()
        return out + self.words(text[at:])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian uint32; the words of all texts that aren't remembered are merged together."""
        parts = [self._parts(t) for t in texts]
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        unknown = {w for p in parts for w in p if w not in new and not isinstance(w, re.Match)}
        known = {w: old[w] for w in unknown if w in old}
        new.update(known)
        todo = [w for w in unknown if w not in known]
        new.update(zip(todo, self.table.encode([w if isinstance(w, bytes) else w.encode() for w in todo]), strict=True))
        return [b"".join([new[w] if not isinstance(w, re.Match) else self.specials[w[0]] for w in p]) for p in parts]

    def encode_long(self, text: str) -> bytes:
        return b"".join(x for piece in self.pieces(text) for x in self.encode([piece]))

    def decode(self, ids: bytes) -> str:
        """The tokens, a blank between two: the file names no decoder that would undo bytes and word ends."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    held = worker_state().setdefault("bpe", {})
    return held.get(path) or held.setdefault(path, Encoder(path))


def encode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian uint32) of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)

        def batch_of(ids: list, coded: list[bytes]) -> pa.RecordBatch:
            counts = [len(c) // 4 for c in coded]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(coded, pa.binary())], ["doc_id", "n_tokens", "ids"])

        for batch in batches:
            ids, some, size = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                if len(text) > PIECE:
                    yield batch_of([doc], [encoder.encode_long(text)])
                    continue
                ids.append(doc)
                some.append(text)
                size += len(text)
                if len(some) >= 512 or size > PIECE:
                    yield batch_of(ids, encoder.encode(some))
                    ids, some, size = [], [], 0
            if some:
                yield batch_of(ids, encoder.encode(some))

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """``coded`` (doc_id, n_tokens, ids) with text: what the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            done, sizes = 0, batch.column(1).to_pylist()
            while done < batch.num_rows:
                end, size = done, 0
                while end < batch.num_rows and (end == done or size + sizes[end] < OUT // 8):
                    size += sizes[end]
                    end += 1
                part = batch.slice(done, end - done)
                texts = [encoder.decode(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "text"])
                done = end

    return coded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, text string")
