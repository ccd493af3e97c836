"""Fill-in-middle transformation by chunks that overlap in one byte.

A text is cut into tokens (``[A-Za-z]+|[^A-Za-z]``); two cuts between tokens make prefix, middle and suffix. Whether a token starts
at a place depends on that byte and the one before it only, so chunks that overlap in one byte count their starts on their own, many at a
time; the running sums of these counts say which chunk holds which cut, and only those chunks are read again. Everything works on
the UTF-8 bytes as Arrow brings them, so no text is taken apart into tokens; memory beyond a batch's texts is bounded by ``SLAB``.

Defined results: a null text counts as empty and stays plain; a null doc_id counts as an empty string in the hash; repeated rows get equal
results; an empty table gives none. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of all documents, in percent: those that stay plain, and of the others those whose suffix comes first.
PLAIN, SUFFIX_FIRST = 10, 20
CHUNK, SLAB, OUT = 4096, 4 << 20, 16 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80


def starts_in(data: np.ndarray, a: int, b: int) -> np.ndarray:
    """Whether a token starts at each byte of ``data[a:b]``, if no document starts there; reads the byte before ``a`` too."""
    letter = _LETTER[data[max(a - 1, 0) : b]]
    before = letter[:-1] if a else np.concatenate([[False], letter[:-1]])
    own = letter[1:] if a else letter
    return _LEAD[data[a:b]] & ~(own & before)


class Chunks:
    """The chunks of documents that lie one after the other in ``data``: of each its tokens' starts and its code points, as running sums."""

    def __init__(self, data: np.ndarray, begins: np.ndarray, stops: np.ndarray, size: int = CHUNK, slab: int = SLAB):
        self.data, self.begins, self.stops = data, begins, stops
        each = -(-(stops - begins) // size)
        self.first = np.concatenate([[0], np.cumsum(each)])
        within = np.arange(self.first[-1]) - np.repeat(self.first[:-1], each)
        self.at = np.repeat(begins, each) + size * within
        self.until = np.minimum(self.at + size, np.repeat(stops, each))
        self.opens = within == 0
        starts, chars = np.zeros(len(self.at), np.int64), np.zeros(len(self.at), np.int64)
        step = max(1, slab // size)
        for i in range(0, len(self.at), step):
            at = self.at[i : i + step]
            a, b = int(at[0]), int(self.until[i : i + step][-1])
            found = starts_in(data, a, b)
            found[at[self.opens[i : i + step]] - a] = True
            starts[i : i + step] = np.add.reduceat(found, at - a, dtype=np.int64)
            chars[i : i + step] = np.add.reduceat(_LEAD[data[a:b]], at - a, dtype=np.int64)
        self.starts, self.chars = np.concatenate([[0], np.cumsum(starts)]), np.concatenate([[0], np.cumsum(chars)])
        self.tokens = self.starts[self.first[1:]] - self.starts[self.first[:-1]]
        self.read: tuple[int, np.ndarray] = -1, np.zeros(0, np.int64)

    def cut(self, doc: int, tokens: int) -> tuple[int, int]:
        """Where the first ``tokens`` tokens of a document end: the place in ``data`` and the code points before it."""
        first, last = int(self.first[doc]), int(self.first[doc + 1])
        if tokens == self.tokens[doc]:
            return int(self.stops[doc]), int(self.chars[last] - self.chars[first])
        rank = int(self.starts[first]) + tokens
        owner = int(np.searchsorted(self.starts, rank, "right")) - 1
        a, b = int(self.at[owner]), int(self.until[owner])
        if self.read[0] != owner:
            found = starts_in(self.data, a, b)
            found[0] |= self.opens[owner]
            self.read = owner, np.flatnonzero(found)
        place = a + int(self.read[1][rank - int(self.starts[owner])])
        return place, int(self.chars[owner] - self.chars[first]) + int(np.count_nonzero(_LEAD[self.data[a:place]]))


def _transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches doc_id, text (no nulls), form, h1, h2."""
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    for batch in batches:
        texts = batch.column(1).cast(pa.large_string())
        _, offsets, raw = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        view = memoryview(data)
        forms, h1, h2 = batch.column(2).to_pylist(), batch.column(3).to_numpy(), batch.column(4).to_numpy()
        done = 0
        while done < len(texts):
            end = max(done + 1, int(np.searchsorted(bounds, bounds[done] + OUT, "right")) - 1)
            chunks = Chunks(data, bounds[done:end], bounds[done + 1 : end + 1])
            cuts = np.sort(np.stack([h1[done:end] % (chunks.tokens + 1), h2[done:end] % (chunks.tokens + 1)]), axis=0).T.tolist()
            out, prefix, middle = [], [], []
            for i, form in enumerate(forms[done:end]):
                a, b = int(bounds[done + i]), int(bounds[done + i + 1])
                if form == "plain":
                    out.append(view[a:b])
                    prefix.append(None)
                    middle.append(None)
                    continue
                (x, before), (y, until) = (chunks.cut(i, k) for k in cuts[i])
                parts = (p, view[a:x], s, view[y:b], m, view[x:y]) if form == "psm" else (s, view[y:b], p, view[a:x], m, view[x:y])
                out.append(b"".join(parts))
                prefix.append(before)
                middle.append(until - before)
            columns = [batch.column(0)[done:end], pa.array(chunks.tokens), batch.column(2)[done:end], pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
            done = end


def transform(documents: DataFrame, seed: str = "1") -> DataFrame:
    """doc_id, n (tokens), form (plain, psm: prefix, suffix, middle; spm: suffix, prefix, middle), prefix_chars and middle_chars (null if plain), output.

    The choice depends on ``seed`` and doc_id only; a text that is empty or holds a mark stays plain."""
    text = F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9, 17, 25)]
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = F.when((text == "") | marked | (h[2] % 100 >= 100 - PLAIN), "plain").when(h[3] % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    rows = documents.select("doc_id", text.alias("text"), form.alias("form"), h[0].alias("h1"), h[1].alias("h2"))
    return rows.mapInArrow(_transform, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The text as it was. No mark occurs in it, nor can one arise where a part meets a mark."""
    rest = F.substr(output, F.lit(len(PREFIX) + 1))
    middle = F.substring_index(output, MIDDLE, -1)
    before = F.substring_index(rest, MIDDLE, 1)  # the first and the second part, with the second mark between them
    first = lambda mark: F.substring_index(before, mark, 1)
    second = lambda mark: F.substring_index(before, mark, -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(first(SUFFIX), middle, second(SUFFIX))).otherwise(F.concat(second(PREFIX), middle, first(PREFIX)))
