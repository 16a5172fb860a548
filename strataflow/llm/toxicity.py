"""Toxicity by a support vector machine over a gapped-subsequence string kernel with Nyström landmarks."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import blake2b
from heapq import nsmallest
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import WordTable, chunked, cut, held, paused_gc, small_batches, text_bytes, uniform, written
from strataflow.llm.components import components
from strataflow.llm.langid import CLASSES, classes_of, sample_by_class

#: The kernel compares subsequences of three characters, up to SPAN apart, each weighted GAP to the power of its span.
SPAN, GAP = 6, 0.7
#: Words longer than this are seen through overlapping windows.
LONGEST = 28
#: A word contrasts if it comes CONTRAST times as often in toxic texts as in others; of contrasting words that come in so
#: many texts, chance may account for CHANCE at most. Words of more than MANY texts need no such test.
CONTRAST, CHANCE, MANY = 25, 0.3, 400
#: Toxic texts that share one of the MARKS smallest hashes of their runs of SHINGLE words are near copies.
MARKS, SHINGLE = 4, 5
#: Letters set apart by single spaces are read as one word too.
SPACED = re.compile(rb"(?<![^ \t\n\x0b\x0c\r])(?:[A-Za-z][ ]){2,}[A-Za-z](?![^ \t\n\x0b\x0c\r])")


def triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples of a string of n characters, and the weight of each; the weights' squares sum to 1."""
    at = np.array([(i, j, k) for i in range(n) for j in range(i + 1, min(n, i + SPAN)) for k in range(j + 1, min(n, i + SPAN))]).reshape(-1, 3)
    w = GAP ** (at[:, 2] - at[:, 0] + 1.0) if len(at) else np.zeros(0)
    return at, w / max(np.sqrt((w**2).sum()), 1e-12)


_TRIPLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def coded(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words in groups of one length: index of the word, codes of its triples, their weights. A word is its letters
    between two border marks; characters at its ends that are no letters are left out, those within are kept as gaps.
    A word with more than LONGEST comes as several windows."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = classes_of("".join(words))
    ends = np.cumsum(lengths)
    groups: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    letters = flat > 0
    count = np.concatenate(([0], np.cumsum(letters)))
    where = np.flatnonzero(letters)
    for i, (end, n) in enumerate(zip(ends.tolist(), lengths.tolist(), strict=True)):
        a, b = count[end - n], count[end]
        if a == b:
            continue
        c = flat[where[a] : where[b - 1] + 1]
        for at in range(0, max(1, len(c) - LONGEST // 2), LONGEST // 2) if len(c) > LONGEST else (0,):
            part = c[at : at + LONGEST]
            ids, parts = groups.setdefault(len(part), ([], []))
            ids.append(i)
            parts.append(part)
    for n, (ids, parts) in groups.items():
        if n + 2 not in _TRIPLES:
            _TRIPLES[n + 2] = triples(n + 2)
        at, w = _TRIPLES[n + 2]
        for s in range(0, len(ids), 4096):
            c = np.zeros((len(ids[s : s + 4096]), n + 2), np.int32)
            c[:, 1:-1] = np.stack(parts[s : s + 4096])
            yield np.array(ids[s : s + 4096]), (c[:, at[:, 0]] * CLASSES + c[:, at[:, 1]]) * CLASSES + c[:, at[:, 2]], w


@dataclass
class WordMachine:
    """f(word) of the machine. The kernel with all landmarks times their weights is one weight for each triple, as both
    are sums; so scoring a word reads its triples' weights."""

    weights: np.ndarray
    bias: float

    def __call__(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), -9.0)
        for ids, codes, w in coded(words):
            np.maximum.at(out, ids, self.weights[codes] @ w + self.bias)
        return out


def fit_machine(positive: list[str], negative: list[str], landmarks: int, cost: float = 10.0) -> WordMachine:
    """Squared-hinge machine on Nyström features, by Newton steps. Landmarks: positives and negatives in turn."""
    marks = (positive[: landmarks // 2] + negative[: landmarks - min(len(positive), landmarks // 2)])[:landmarks]
    table = np.zeros((CLASSES**3,), np.int32)
    entries = [(i, c, w) for ids, codes, w in coded(marks) for i, c in zip(ids.tolist(), codes, strict=True)]
    used = np.unique(np.concatenate([c for _, c, _ in entries]))
    table[used] = np.arange(1, len(used) + 1)
    phi = np.zeros((len(used) + 1, len(marks)), np.float32)
    for i, c, w in entries:
        np.add.at(phi[:, i], table[c], w)
    phi[0] = 0
    values, vectors = np.linalg.eigh((phi.T @ phi).astype(float))
    good = values > 1e-8 * values.max()
    root = (vectors[:, good] / np.sqrt(values[good])).astype(np.float32)
    basis = phi @ root
    words = positive + negative
    z = np.zeros((len(words), basis.shape[1] + 1), np.float32)
    for ids, codes, w in coded(words):
        for s in range(0, len(ids), 32):
            z[ids[s : s + 32], :-1] = np.einsum("ntd,t->nd", basis[table[codes[s : s + 32]]], w.astype(np.float32))
    z[:, -1] = 1
    y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    weight = np.where(y > 0, 0.5 / max(1, len(positive)), 0.5 / max(1, len(negative))) * len(y) * cost
    theta = np.zeros(z.shape[1])
    keep = np.eye(len(theta))
    keep[-1, -1] = 1e-6
    for _ in range(25):
        left, right = keep.copy(), np.zeros(len(theta))
        for s in range(0, len(z), 1024):  # by blocks, as doubles of all rows would be most of the driver's memory
            part, own = z[s : s + 1024].astype(float), y[s : s + 1024]
            active = own * (part @ theta) < 1
            weighted = part[active] * weight[s : s + 1024][active, None]
            left += weighted.T @ part[active]
            right += weighted.T @ own[active]
        step = np.linalg.solve(left, right)
        if np.abs(step - theta).max() < 1e-6:
            break
        theta = step
    full = np.zeros(CLASSES**3)
    full[used] = (phi @ (root @ theta[:-1]))[1:]
    return WordMachine(full.astype(np.float32), float(theta[-1]))


def features(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of texts, from f of their words: the largest three, how many are positive, and 1. at: each text's first word."""
    n, some = len(at) - 1, np.flatnonzero(np.diff(at))
    out = np.column_stack((np.full((n, 3), -2.0), np.zeros(n), np.ones(n)))
    if len(some):
        left, own = values.astype(np.float64), np.repeat(np.arange(len(some)), np.diff(at)[some])
        out[some, 3] = np.log1p(np.bincount(own, left > 0))
        for k in range(3):
            top = np.maximum.reduceat(left, at[:-1][some])
            out[some, k] = np.clip(top, -2, 2)
            here = np.flatnonzero(left == top[own])
            left[here[np.concatenate(([True], np.diff(own[here]) > 0))]] = -9.0  # one of equal ones
    return out


@dataclass
class ToxicityModel:
    machine: WordMachine
    calibration: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.calibration, -30, 30)))


def text_features(texts: list[str | None], table: WordTable) -> np.ndarray:
    out = []
    for _, run in chunked([text_bytes(t) for t in texts]):
        spaced = [b" ".join([m.replace(b" ", b"") for m in SPACED.findall(raw)]) for raw in run]
        every = [raw + b" " + more if more else raw for raw, more in zip(run, spaced, strict=True)]
        rows, at, _, _ = table.look_up(every)
        out.append(features(table.values[0][rows] if len(rows) else np.empty(0), at))
    return np.concatenate(out) if out else np.empty((0, 5))


def word_table(machine: WordMachine) -> WordTable:
    return WordTable(lambda words: (machine([w.decode("utf-8", "replace") for w in words]),), marks=b".,;:!?")


def words_of(text: bytes) -> set[bytes]:
    """The different words of a text; a long one comes as the windows that the machine sees."""
    out: set[bytes] = set()
    for w in text.lower().split():
        if len(w) <= LONGEST:
            out.add(w)
        else:
            t = w.decode("utf-8", "replace")
            out |= {t[i : i + LONGEST].encode() for i in range(0, max(1, len(t) - LONGEST // 2), LONGEST // 2)}
    return out


def counted_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From toxic, around, text: a row for each different word of a toxic text with its around, and rows of words with
    numbers of other texts."""

    def rows(words: list[bytes], around: list[int | None], good: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in words], pa.string()), pa.array(around, pa.int64()), pa.array(good, pa.int64())], names=["word", "around", "good"])

    others: Counter[bytes] = Counter()
    for b in batches:
        words, around = [], []
        for label, near, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            own = words_of(text_bytes(text))
            if label == 1:
                words += own
                around += [near] * len(own)
            else:
                others.update(own)
        yield rows(words, around, [0] * len(words))
        if len(others) > 200_000:
            yield rows([*others], [None] * len(others), [*others.values()])
            others.clear()
    yield rows([*others], [None] * len(others), [*others.values()])


def shingle_marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From around, text: a row for each of the MARKS smallest hashes of a text's runs of SHINGLE words."""
    for b in batches:
        around, marks = [], []
        for near, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            words = text_bytes(text).lower().split()
            runs = {b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}
            least = nsmallest(MARKS, (int.from_bytes(blake2b(r, digest_size=8).digest(), "big", signed=True) for r in runs))
            around += [near] * len(least)
            marks += least
        yield pa.RecordBatch.from_arrays([pa.array(around, pa.int64()), pa.array(marks, pa.int64())], names=["around", "mark"])


def folded(toxic: DataFrame) -> DataFrame:
    """Toxic texts (around, text) with around, the hash of a text, replaced by that of its near copies' least: texts are
    near copies if they share a mark, directly or by others."""
    marks = cut(toxic.mapInArrow(shingle_marks, "around bigint, mark bigint").distinct())
    least = marks.groupBy("mark").agg(F.min("around").alias("a"))
    links = marks.join(least, "mark").where("around <> a").select("a", F.col("around").alias("b"))
    roots = components(links).withColumnRenamed("node", "around")
    return toxic.join(roots, "around", "left").select(F.lit(1).alias("toxic"), F.coalesce("root", "around").alias("around"), "text")


def believed(tally: dict[int, tuple[int, int]], ratio: float) -> list[int]:
    """Of numbers of texts, those at which contrasting words are mostly no chance. tally: from a number of texts to that
    of the words that come in so many, and of those among them that contrast. By chance a text is toxic once in ratio + 1."""
    p, found = 1 / (ratio + 1), []
    for n, (words, contrasting) in sorted(tally.items()):
        chance = sum(comb(n, g) * p ** (n - g) * (1 - p) ** g for g in range(n) if (n - g) * ratio >= CONTRAST * max(g, 0.3))
        if contrasting and words * chance <= CHANCE * contrasting:
            found.append(n)
    return found


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = 6000, most_others: int = 24_000, per_class: int = 3000, landmarks: int = 256, negatives: int = 20_000, seed: str = "toxicity") -> ToxicityModel | None:
    """Fit on about most_toxic toxic and most_others other labelled rows at most, those with the smallest hashes of doc_id,
    equal texts once. Null texts have no words; rows without doc_id or with a label other than
    0 and 1 take no part; repeated rows count once; other columns are not read.

    The words of the toxic class are those that occur CONTRAST times as often in its texts as among the others, near
    copies counting as one, and in a number of texts at which chance accounts for at most CHANCE of such words: the bar
    comes from the words' own counts and sinks as labelled texts grow in number. The machine learns them against words of
    the other class, then again with those that it took for toxic; a logistic curve over the largest values of about
    per_class texts a class gives the score. None if a class is missing. To the driver come counted words, at most
    `negatives` of each class, and five figures for each text of the curve.
    """
    spark = docs.sparkSession
    small_batches(spark)
    named = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in named.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, most_toxic / max(1, counts.get(1, 0))).otherwise(most_others / max(1, counts.get(0, 0)))
    chosen = F.broadcast(named.where(uniform(seed, F.col("doc_id")) < share))  # about most_toxic + most_others rows of two numbers
    texts = written(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id"), "toxicity-chosen")
    labelled = written(texts.withColumn("around", F.xxhash64("text")).dropDuplicates(["toxic", "around"]), "toxicity-labelled")
    toxic = cut(folded(labelled.where("toxic = 1").select("around", "text")))
    good, bad = labelled.where("toxic = 0").count(), toxic.select("around").distinct().count()
    if not good or not bad:
        return None
    ratio = good / bad
    seen = toxic.unionByName(labelled.where("toxic = 0").select("toxic", "around", "text")).mapInArrow(counted_words, "word string, around bigint, good bigint")
    counts = seen.groupBy("word").agg(F.count_distinct("around").alias("bad"), F.sum("good").alias("good"))
    marked = F.col("bad") * ratio >= CONTRAST * F.greatest(F.col("good"), F.lit(0.3))
    counted = cut(counts.select("*", marked.alias("marked"), (F.col("bad") + F.col("good")).alias("n")))
    tally = {r["n"]: (r["words"], r["contrasting"]) for r in counted.where(F.col("n") <= MANY).groupBy("n").agg(F.count(F.lit(1)).alias("words"), F.count_if("marked").alias("contrasting")).collect()}
    sure = (F.col("n") > MANY) | F.col("n").isin(believed(tally, ratio))
    positive = [r["word"] for r in counted.where(F.col("marked") & sure).orderBy(F.desc("bad"), "word").limit(negatives).collect()]
    negative = [r["word"] for r in counted.where("good > 0 and not marked").orderBy(F.xxhash64("word"), "word").limit(negatives).collect()]
    if not positive or not negative:
        return None
    first = fit_machine(positive, negative[: len(negative) // 4 + 1], landmarks)
    hard = np.argsort(-first(negative), kind="stable")
    machine = fit_machine(positive, [negative[i] for i in hard.tolist()], landmarks)

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_table(machine)
        for b in batches:
            x = text_features(b.column(1).to_pylist(), cache)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x[:, i]) for i in range(5)]], names=["toxic", *"abcde"])

    # about 2 * per_class texts: bounded
    sample = sample_by_class(labelled, "toxic", per_class, 2 * per_class, seed)
    rows = sample.select("toxic", "text").mapInArrow(measured, "toxic int, a double, b double, c double, d double, e double").collect()
    x, y = np.array([r[1:] for r in rows]), np.array([r[0] for r in rows], float)
    theta, keep = np.zeros(5), np.diag([0.5, 0.5, 0.5, 0.5, 1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        theta = theta + np.linalg.solve((x * s[:, None]).T @ x + keep, x.T @ (y - p) - keep @ theta)
    return ToxicityModel(machine, theta)


def scorer(docs: DataFrame, model: ToxicityModel | None):
    """A function from texts to scores, for tasks; a worker's tasks share the cache of a model's words."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 64^3 weights
    key = uuid.uuid4().hex

    def scores(texts: list[str | None]) -> np.ndarray:
        if (m := shared.value) is None or not texts:
            return np.zeros(len(texts))
        return m.score(text_features(texts, held(("toxicity", key), lambda: word_table(m.machine))))

    return scores


def predict(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """doc_id and score (0 to 1, higher: more toxic) of each whole text; no shuffle. Words' values are cached.

    Null or empty text: the score of a text without words. Very long text: whole. No model: 0. Null doc_id: kept. Ties:
    none arise, as each text is scored alone. Repeated rows: a row each. Empty table: no rows. Other columns, whatever their
    names, are not read.
    """
    scores = scorer(docs, model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with paused_gc():
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(b.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string")).mapInArrow(run, "doc_id bigint, score double")


def keep(docs: DataFrame, model: ToxicityModel | None, below: float) -> DataFrame:
    """The rows of docs with a score under `below`, in all their columns, whatever their names, and in one pass. Odd rows
    are scored as in `predict`: null and empty texts stay unless texts without words score so high; repeated rows share
    their fate; an empty table gives no rows."""
    scores, at = scorer(docs, model), docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with paused_gc():
            for b in batches:
                yield b.filter(pa.array(scores(b.column(at).to_pylist()) < below))

    return docs.mapInArrow(run, docs.schema)
