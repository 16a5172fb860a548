"""Language identification by a blended-spectrum string kernel, Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import small_batches, uniform

#: Classes of characters: 0 what is no letter, 1 to 26 the ASCII letters in lower case, 27 to 63 other letters by code point.
CLASSES = 64
#: Runs of one, two and three classes, one after the other.
SPACE = CLASSES + CLASSES**2 + CLASSES**3


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of each code point of the first three planes."""
    table = np.zeros(0x30000, np.uint8)
    for at in range(len(table)):
        if not 0xD800 <= at < 0xE000 and (c := chr(at)).isalpha():
            low = ord(c.lower()[0])
            table[at] = low - 96 if 97 <= low <= 122 else 27 + low % 37
    return table


def classes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return class_table()[np.minimum(points, 0x2FFFF)]


def grams_of(text: str | None) -> np.ndarray | None:
    """The run codes of a text, with repeats; None if it has no letter."""
    c = classes_of(text or "")
    if not c.any():
        return None
    c = np.concatenate(([0], c, [0])).astype(np.int32)
    c = c[(c > 0) | np.concatenate(([True], c[:-1] > 0))]  # one separator for each run of non-letters
    two = c[:-1] * CLASSES + c[1:]
    return np.concatenate((c, CLASSES + two, CLASSES + CLASSES**2 + two[:-1] * CLASSES + c[2:]))


@dataclass
class LanguageModel:
    """Ridge weights carried from the landmarks to runs: the score of a text is its presence vector times `weights`,
    over the root of the number of its known runs. As matrix products associate, this equals the kernel with each
    landmark times the landmarks' weights."""

    languages: list[str]
    known: np.ndarray  # run code -> row of weights, or the last row
    weights: np.ndarray

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the score of each language, and whether it has a letter."""
        out, lettered = np.zeros((len(texts), len(self.languages)), np.float32), np.zeros(len(texts), bool)
        width = len(self.weights)
        for at in range(0, len(texts), 64):
            run = texts[at : at + 64]
            present = np.zeros((len(run), width), np.float32)
            for i, t in enumerate(run):
                if (g := grams_of(t)) is not None:
                    lettered[at + i] = True
                    present[i, self.known[g]] = 1
            present[:, -1] = 0
            out[at : at + 64] = present @ self.weights / np.sqrt(np.maximum(present.sum(axis=1, keepdims=True), 1))
        return out, lettered


def fit_ridge(languages: list[str], labels: np.ndarray, codes: list[np.ndarray], landmarks: int, ridge: float) -> LanguageModel:
    """labels: index of each row's language; codes: the different run codes of each row. Rows are made dense by blocks."""
    seen = np.zeros(SPACE, np.int64)
    for c in codes:
        seen[c] += 1
    used = np.flatnonzero(seen >= min(2, len(labels)))
    known = np.full(SPACE, len(used), np.int32)
    known[used] = np.arange(len(used))

    def dense(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), len(used) + 1), np.float32)
        for k, i in enumerate(rows.tolist()):
            x[k, known[codes[i]]] = 1
        x = x[:, :-1]
        return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))

    order = np.argsort([(labels[:i] == c).sum() for i, c in enumerate(labels)], kind="stable")  # languages in turn
    marks = dense(order[:landmarks])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    z = np.concatenate([(dense(np.arange(s, min(s + 256, len(labels)))) @ marks.T).astype(float) for s in range(0, len(labels), 256)]) @ root
    z1 = np.hstack((z, np.ones((len(z), 1))))
    share = np.bincount(labels, minlength=len(languages)) / len(labels)
    balance = 1 / np.maximum(share[labels], 1e-9)
    target = np.where(labels[:, None] == np.arange(len(languages)), 1.0, -1.0)
    penalty = ridge * balance.sum() / len(labels) * np.eye(z1.shape[1])
    w = np.linalg.solve((z1 * balance[:, None]).T @ z1 + penalty, (z1 * balance[:, None]).T @ target)
    weights = marks.T.astype(float) @ (root @ w[:-1])
    return LanguageModel(languages, known, np.vstack((weights, np.zeros((1, len(languages))))).astype(np.float32))


def sample_by_class(docs: DataFrame, label: str, per_class: int, most: int, seed: str) -> DataFrame:
    """About per_class rows of each class (at most `most` on the whole, but one of each class), those with the smallest hashes
    of doc_id. To the driver comes a row for each class."""
    counts = {r[label]: r["n"] for r in docs.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    each = max(1, min(per_class, most // max(1, len(counts))))
    share = docs.sparkSession.createDataFrame([(k, min(1.0, each / n)) for k, n in counts.items()], f"{label} {dict(docs.dtypes)[label]}, _share double") if counts else None
    if share is None:
        return docs.limit(0)
    return docs.join(F.broadcast(share), label).where(uniform(seed, F.col("doc_id")) < F.col("_share")).drop("_share")


def fit(labelled: DataFrame, per_language: int = 300, most: int = 4000, landmarks: int = 384, ridge: float = 0.3, seed: str = "langid") -> LanguageModel | None:
    """Fit on at most about `most` labelled rows (doc_id, text, lang), one of each language at least. What comes to the
    driver is each sampled text's set of runs, a deflated bitmap of 33 kB at most. None if there is no row with a language
    and a letter. Null texts and languages take no part; repeated rows count each; other columns are not read."""

    def bitmaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, maps = [], []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if (g := grams_of(text)) is not None:
                    bits = np.zeros(SPACE, bool)
                    bits[g] = True
                    langs.append(lang)
                    maps.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(maps, pa.binary())], names=["lang", "bits"])

    small_batches(labelled.sparkSession)
    rows = sample_by_class(labelled.where("lang is not null").select("doc_id", "text", "lang"), "lang", per_language, most, seed).select("lang", F.col("text").cast("string")).mapInArrow(bitmaps, "lang string, bits binary").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["bits"])))  # the same order whatever the partitions
    if not rows:
        return None
    languages = sorted({r["lang"] for r in rows})
    labels = np.array([languages.index(r["lang"]) for r in rows])
    codes = [np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(r["bits"]), np.uint8))[:SPACE]).astype(np.int32) for r in rows]
    return fit_ridge(languages, labels, codes, landmarks, ridge)


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred, score of each whole text; no shuffle.

    score: softmax of four times the ridge outputs, from 0 to 1. Null, empty or letterless text, or no model: `und`,
    score 0. Very long text: whole. Null doc_id: kept. Repeated rows: a row each. Ties: the language first in alphabetical order. Empty table:
    no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # runs seen in the sample: 266,304 at most, by languages

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            if m is not None and texts:
                s, lettered = m.scores(texts)
                best = s.argmax(axis=1)
                e = np.exp(4.0 * (s - s.max(axis=1, keepdims=True)).astype(float))
                scores = np.where(lettered, e.max(axis=1) / e.sum(axis=1), 0.0)
                langs = [m.languages[k] if ok else "und" for k, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string")).mapInArrow(run, "doc_id bigint, lang_pred string, score double")
