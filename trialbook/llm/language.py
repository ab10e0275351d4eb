"""Language identification with string kernels.

A text is the set of its byte n-grams of one to ``GRAMS`` (blended spectrum, presence only), taken over the
lower-cased text with everything that is not a letter folded to a blank; n-grams are hashed to ``DIMS`` slots.
The kernel of two texts is the cosine of their sets.  It is approximated from ``landmarks`` training texts
(Nyström) and one kernel ridge regression per language is solved on it; texts are scored in batches by two
matrix products, texts x landmarks and landmarks x languages.

The fit sees a bounded sample: about ``per_language`` training rows of each language and about ``rows`` in all, chosen by a
hash of doc_id and text; of more than ``rows`` labels the most frequent ones are learned.  Features of the sample are computed on the
executors (2 kB a row, whatever the length of the text) and only those reach the driver.  Every language of the
sample has a landmark of its own at least.

Defined cases: null text or text without a letter is ``und`` with score 0; if no training row exists every
text is ``und``; a row without doc_id is neither held out nor learned from (``held_out`` is null); equal rows count once in the
sample and get equal results; extra columns are ignored; texts of any length are read whole, in pieces, and at most
``TOGETHER`` at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_bytes, slices

GRAMS = 3
DIMS = 1 << 14
PIECE = 1 << 20
TOGETHER = 512
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


def presence(column: pa.Array) -> np.ndarray:
    """n x DIMS matrix of 0 and 1."""
    raw, offsets = joined_bytes(pc.utf8_lower(column))
    n = len(column)
    seen = np.zeros(n * DIMS, np.uint8)
    for at in range(0, len(raw), PIECE):
        part = _FOLD[raw[at : at + PIECE + GRAMS - 1]].astype(np.uint32)
        here = np.arange(at, at + len(part))
        row = np.searchsorted(offsets, here, side="right") - 1
        code = np.zeros(len(part), np.uint32)
        for k in range(1, GRAMS + 1):
            if len(part) < k:
                break
            code = code[: len(part) - k + 1] * np.uint32(256) + part[k - 1 :]
            inside = row[: len(code)] == row[k - 1 :]
            slot = ((code + np.uint32(k)) * np.uint32(2654435761)) >> np.uint32(18)
            seen[(row[: len(code)] * DIMS + slot)[inside]] = 1
    return seen.reshape(n, DIMS)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def _lengths(sets: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(sets.sum(axis=1, dtype=np.float32), 1))[:, None]


class Model:
    """Landmark sets (cosine-scaled, DIMS x m) and the regression weights (m x languages)."""

    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray):
        self.languages, self.landmarks, self.weights = languages, landmarks, weights

    def score(self, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language, and a softmax of the regression values as its score."""
        kernel = (sets.astype(np.float32) @ self.landmarks) / _lengths(sets)
        values = kernel @ self.weights
        best = values.argmax(axis=1)
        odds = np.exp(4 * (values - values.max(axis=1, keepdims=True)))
        return best, 1 / odds.sum(axis=1)


def fit(docs: DataFrame, training: Column, per_language: int = 300, landmarks: int = 96, ridge: float = 1e-3, seed: int = 5, rows: int = 20_000) -> Model | None:
    """Train on rows where ``training`` holds and lang is not null.  None if there is none."""
    known = docs.filter(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    # The most frequent labels: as many rows as the sample at most, so they may be broadcast.
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "lang").limit(rows)
    # As an Arrow table: a list would start Python workers of another kind, which stay beside the first.
    counts = docs.sparkSession.createDataFrame(counts.toArrow(), counts.schema)
    labels = counts.count()
    if not labels:
        return None
    # A keyed hash below a rate for each language: an expected number of rows, whatever the size of the corpus.
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    sample = known.join(F.broadcast(counts), "lang").filter(draw < min(per_language, rows / labels) / F.col("_n"))
    sample = sample.select("doc_id", "lang", "text", draw.alias("draw")).dropDuplicates(["lang", "draw"])

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=1 << 20, rows=TOGETHER):
            packed = np.packbits(presence(b.column("text")), axis=1)
            yield pa.record_batch({"lang": b.column("lang"), "draw": b.column("draw"), "doc_id": b.column("doc_id"), "bits": pa.array([x.tobytes() for x in packed], pa.binary())})

    found = sample.mapInArrow(featured, "lang string, draw double, doc_id long, bits binary").collect()
    if not found:
        return None
    found.sort(key=lambda r: (r["lang"], r["draw"], r["doc_id"]))
    languages = sorted({r["lang"] for r in found})
    place = {lang: k for k, lang in enumerate(languages)}
    label = np.array([place[r["lang"]] for r in found])
    sets = lambda these: np.unpackbits(np.stack([np.frombuffer(found[k]["bits"], np.uint8) for k in these]), axis=1).astype(np.float32)
    # Landmarks in equal shares, in drawing order.
    turn = np.arange(len(found)) - np.searchsorted(label, label)
    chosen = np.lexsort((label, turn))[: max(landmarks, len(languages))]
    marks = sets(chosen)
    marks = (marks / _lengths(marks)).T.copy()
    kernel = np.zeros((len(found), len(chosen)))
    for at in range(0, len(found), TOGETHER):
        part = sets(range(at, min(at + TOGETHER, len(found))))
        kernel[at : at + TOGETHER] = part @ marks / _lengths(part)
    among = kernel[chosen]
    target = np.where(label[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # Balanced rows: each language weighs the same.
    weight = (len(found) / len(languages) / np.bincount(label))[label][:, None]
    system = kernel.T @ (weight * kernel) + ridge * len(found) * (among + 1e-6 * np.eye(len(chosen)))
    return Model(languages, marks, np.linalg.solve(system, kernel.T @ (weight * target)).astype(np.float32))


def has_letter(text: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(text, r"\pL"), False).to_numpy(zero_copy_only=False)


def predictor(model: Model | None) -> Callable[[pa.Array], tuple[list[str], np.ndarray]]:
    def predict(text: pa.Array) -> tuple[list[str], np.ndarray]:
        if model is None:
            return [UNKNOWN] * len(text), np.zeros(len(text))
        lettered = has_letter(text)
        best, score = model.score(presence(text))
        return [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0)

    return predict


def recognized(docs: DataFrame, model: Model | None, least: float = 0.0, into: str | None = None) -> DataFrame:
    """The rows of ``docs``, as they are, whose text has a letter and a language scored ``least`` or more; none without a model.

    The language is set in the column ``into``, if one is named, where that is null.  A score says how far the best language is ahead, not
    whether the text is in any: it falls to 1 / languages on short texts, so by default none is too low.
    """
    given = docs.sparkSession.sparkContext.broadcast(model and (model.languages, model.landmarks, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor(given.value and Model(*given.value))
        for b in batches:
            for s in slices([b], "text", 1 << 20, TOGETHER):
                lang, score = predict(s.column("text"))
                if into is not None:
                    at, known = s.schema.get_field_index(into), s.column(into)
                    s = s.set_column(at, s.schema.field(at), pc.coalesce(known, pa.array(lang, pa.string()).cast(known.type)))
                # A language may be called as UNKNOWN is: letters tell these apart.
                kept = has_letter(s.column("text")) & (score >= least) if given.value else np.zeros(s.num_rows, bool)
                yield s.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def lettered(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(has_letter(b.column("text"))))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns with lang_pred and score; only the text is looked at."""
    keep = ["doc_id"] if keep is None else keep
    given = docs.sparkSession.sparkContext.broadcast(model and (model.languages, model.landmarks, model.weights))  # bounded: DIMS x landmarks numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor(given.value and Model(*given.value))
        for b in batches:
            for s in slices([b], "_text", 1 << 20, TOGETHER):
                lang, score = predict(s.column("_text"))
                yield pa.record_batch([*[s.column(c) for c in keep], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    of = docs.select(*keep, F.col("text").alias("_text"))
    schema = of.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return of.mapInArrow(run, schema)
