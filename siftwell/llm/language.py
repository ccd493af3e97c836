"""Language ID by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram binds its letters' vectors, permuted by place
(rotated by two, by one, not at all), by multiplication; a document bundles (adds) its trigrams, and so does a
language over its training documents. A document goes to the language whose prototype has the largest
cosine with it; that cosine, cut to 0..1, is the score.

Letters are lower-cased and each has a vector of its own, drawn by its code point; whatever isn't a letter separates words. Training takes about
``per_language`` documents of each language (all, if it has no more), chosen by a hash of doc_id: a bound
on the labelled rows that the prototypes are fitted on, nothing else. Rows predicted are all rows.

Defined results: a null text, or one without letters, is ``und`` with score 0, as is every text if nothing can be learned; rows
with a null lang are not learned from; ties go to the language that sorts first; an
empty table gives none. Other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from siftwell.llm.common import fresh

UNKNOWN = "und"
DIMENSIONS = 512


class Letters:
    """A number for each letter, given when it is first met; 0 for what isn't a letter."""

    def __init__(self) -> None:
        self.table = np.full(0x110000, -1, np.int32)
        self.points = [0]

    def of(self, codes: np.ndarray) -> np.ndarray:
        got = self.table[codes]
        if (got < 0).any():
            for cp in np.unique(codes[got < 0]).tolist():
                self.table[cp] = 0
                if not 0xD800 <= cp < 0xE000 and chr(cp).isalpha():
                    self.table[cp] = len(self.points)
                    self.points.append(cp)
            got = self.table[codes]
        return got


class Profiles:
    """Vectors of letters, drawn by code point, and of trigrams, made when first seen. At most ``most`` trigrams are remembered."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 8, most: int = 1 << 16):
        self.dimensions, self.seed, self.most = dimensions, seed, most
        self.classes = Letters()
        self.signs = [np.empty((0, dimensions), np.int8)] * 3
        self._forget()

    def _rotated(self, by: int) -> np.ndarray:
        """The vectors of all letters met so far, rotated."""
        new = self.classes.points[len(self.signs[0]) :]
        if new:
            drawn = [np.random.default_rng((self.seed, cp)).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1 for cp in new]
            last = np.concatenate((self.signs[0], np.array(drawn, np.int8)))
            self.signs = [np.roll(last, n, axis=1) for n in range(3)]
        return self.signs[by]

    last, middle, first = (property(lambda self, by=by: self._rotated(by)) for by in range(3))

    def _forget(self) -> None:
        self.known, self.slots, self.made = np.empty(0, np.int64), np.empty(0, np.int64), 0
        self.vectors = np.empty((1024, self.dimensions), np.float32)

    def trigrams(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Trigram numbers and counts; runs of non-letters are one separator."""
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
        c = self.classes.of(codes)
        c = np.concatenate(([0], c, [0])).astype(np.int64)
        c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]
        if len(c) < 3:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.unique((c[:-2] << 42) | (c[1:-1] << 21) | c[2:], return_counts=True)

    def _of(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of sorted, distinct trigrams."""
        at = np.searchsorted(self.known, grams)
        new = grams[np.append(self.known, -1)[at] != grams]
        if len(new):
            if self.made + len(new) > self.most:
                self._forget()
                new = grams
            low = (1 << 21) - 1
            vectors = self.first[new >> 42] * self.middle[new >> 21 & low] * self.last[new & low]
            while self.made + len(new) > len(self.vectors):
                self.vectors = np.concatenate((self.vectors, np.empty_like(self.vectors)))
            self.vectors[self.made : self.made + len(new)] = vectors
            at = np.searchsorted(self.known, new)
            self.slots = np.insert(self.slots, at, np.arange(self.made, self.made + len(new)))
            self.known = np.insert(self.known, at, new)
            self.made += len(new)
            at = np.searchsorted(self.known, grams)
        return self.vectors[self.slots[at]]

    def bundle(self, text: str | None) -> np.ndarray | None:
        grams, counts = self.trigrams(text)
        if not len(grams):
            return None
        total, part = np.zeros(self.dimensions, np.float32), self.most // 2
        for i in range(0, len(grams), part):
            total += counts[i : i + part].astype(np.float32) @ self._of(grams[i : i + part])
        return total


def held_out(doc_id: Column | str) -> Column:
    """The fold that is never learned from: crc32 of doc_id as text, modulo 4, is 2."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(documents: DataFrame, per_language: int = 2000, dimensions: int = DIMENSIONS, seed: int = 8) -> dict[str, np.ndarray]:
    """Prototype of each language; ``documents``: doc_id, text, lang of the rows to learn from."""
    rows = documents.filter(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])
    place = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0))), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.filter(place < F.element_at(share, F.col("lang")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums = Profiles(dimensions, seed), {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if (vector := profiles.bundle(text.as_py())) is not None:
                    norm = float(np.sqrt(vector @ vector)) or 1.0
                    sums[lang] = sums.get(lang, 0) + np.rint(vector.astype(np.float64) / norm * (1 << 20)).astype(np.int64)
        for lang, total in sums.items():
            yield pa.record_batch([pa.array([lang] * dimensions), pa.array(np.arange(dimensions)), pa.array(total)], ["lang", "place", "value"])

    parts = rows.select("text", "lang").mapInArrow(run, "lang string, place long, value long")
    out = {lang: np.zeros(dimensions) for lang in counts}
    for r in parts.groupBy("lang", "place").agg(F.sum("value").alias("value")).collect():  # languages x dimensions
        out[r["lang"]][r["place"]] = r["value"]
    return {lang: v for lang, v in sorted(out.items()) if v.any()}


def predict(documents: DataFrame, prototypes: dict[str, np.ndarray], seed: int = 8) -> DataFrame:
    """``documents`` with two more columns, the last: _lang_pred and _score (or ``fresh`` names)."""
    names = list(prototypes)
    unit = np.array([v / np.sqrt(v @ v) for v in prototypes.values()]).astype(np.float32) if names else np.zeros((0, 1))
    at_text = documents.columns.index("text")
    names_out = [*documents.columns, fresh(documents, "_lang_pred"), fresh(documents, "_score")]
    schema = StructType([*documents.schema.fields, StructField(fresh(documents, "_lang_pred"), StringType()), StructField(fresh(documents, "_score"), DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(unit.shape[1], seed) if names else None
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(at_text):
                vector = profiles.bundle(text.as_py()) if names else None
                if vector is None or not (norm := float(np.sqrt(vector @ vector))):
                    lang, score = UNKNOWN, 0.0
                    if vector is not None:
                        lang = names[0]
                else:
                    cosines = unit @ (vector / norm)
                    best = int(cosines.argmax())
                    lang, score = names[best], min(1.0, max(0.0, float(cosines[best])))
                langs.append(lang)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=names_out)

    return documents.mapInArrow(run, schema)


def identify(documents: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that aren't held out."""
    prototypes = train(documents.filter(~held_out("doc_id")), **options)
    found = predict(documents.select("doc_id", "text"), prototypes)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))


def drop_unidentified(documents: DataFrame, **options) -> DataFrame:
    """The rows whose language is known, with all their columns."""
    prototypes = train(documents.filter(~held_out("doc_id")), **options)
    found = predict(documents, prototypes)
    return found.filter(F.col(found.columns[-2]) != UNKNOWN).select(*documents.columns)
