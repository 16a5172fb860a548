"""Helpers shared by the corpus operators: checkpoints, vectorised tokenising, uniform hashes."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.operators.names import fresh as fresh

#: The ASCII white space that separates words, [\x20\x09-\x0D].
SPACE_BYTES = b" \t\n\x0b\x0c\r"

#: Rows in an Arrow batch; texts may be long, so batches stay small.
ARROW_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set only where the session has none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="strataflow-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


_PATHS: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; `forget` removes what was written there."""
    _PATHS.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _PATHS[-1]


def already_written() -> list[str]:
    return [*_PATHS]


def forget(spark: SparkSession, keep: Iterable[str] = ()) -> None:
    """Remove what operators have written to the shared folder in this process, but the paths `keep`. Frames that still read
    it can't be evaluated afterwards; write their rows first. Checkpoints are Spark's own to clean."""
    kept = set(keep)
    for path in [p for p in _PATHS if p not in kept]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _PATHS.remove(path)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint df in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package's source to the Python workers, once a context."""
    if getattr(spark.sparkContext, "_strataflow_sent", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="strataflow-"), f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    spark.sparkContext._strataflow_sent = True


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small, whatever the texts' length, and let Python workers import this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


_HELD: dict[Any, Any] = {}


def held(key: Any, make: Callable[[], Any]) -> Any:
    """What the tasks of a Python worker share under key. A worker holds one thing at a time: Spark reuses workers, and
    the caches of a job's earlier stages would add up in them."""
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        _HELD[key] = make()
    return _HELD[key]


@contextmanager
def paused_gc() -> Iterator[None]:
    """No passes of the collector over large caches without cycles, which would take a third of the time; what a task
    leaves in cycles is collected when the next one isn't paused."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo modulus."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def uniform(*parts: Column | str) -> Column:
    """A double in [0, 1) with 52 random bits, from the MD5 of the parts joined by ':' (null: empty)."""
    texts = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    digest = F.md5(F.concat_ws(":", *texts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def text_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def chunked(texts: Iterable[bytes], limit: int = 1 << 21) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about limit bytes with the index of the first; one longer text is a run of its own."""
    first, run, size = 0, [], 0
    for i, t in enumerate(texts):
        if run and size + len(t) > limit:
            yield first, run
            first, run, size = i, [], 0
        run.append(t)
        size += len(t) + 1
    if run:
        yield first, run


#: Bytes of a word that are hashed in step with those of other words; 255 at most.
STEPS = 32

_ALNUM = np.array([chr(i).isalnum() and i < 128 for i in range(256)])


class WordHasher:
    """64-bit multilinear hashes of white-space separated words of byte texts, without a Python loop over words."""

    def __init__(self, seed: int = 20240229, lower_ascii: bool = True):
        self._rng_seed = seed
        rng = np.random.Generator(np.random.PCG64(seed))
        table = rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if lower_ascii:
            table[65:91] = table[97:123]
        self._table = table
        self._space = np.zeros(256, bool)
        self._space[list(SPACE_BYTES)] = True
        self._powers = self._make(1 << 10)

    def _make(self, n: int) -> np.ndarray:
        rng = np.random.Generator(np.random.PCG64(self._rng_seed + 1))
        return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and the offset of each text's first word (one more entry at the end)."""
        hashes, at, _ = self.spans(texts)
        return hashes, at

    def spans(self, texts: list[bytes], marks: bytes = b"") -> tuple[np.ndarray, np.ndarray, "Spans"]:
        """The same, and where the words are in the joined texts. A byte of `marks` at the end of a word, after an ASCII
        letter or digit, is no part of the word."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = b"\n".join(texts)
        data = np.frombuffer(joined, np.uint8)
        text_starts = np.concatenate(([0], np.cumsum(sizes + 1)))
        space = self._space.take(data)
        if marks and len(data) > 2:
            ends = np.flatnonzero(space | np.append(space[1:], True) & np.isin(data, list(marks)))
            ends = ends[(ends > 0) & ~space[ends]]
            space[ends[_ALNUM[data[ends - 1]]]] = True
        begins, ends = ~space, ~space
        begins[1:] &= space[:-1]
        ends[:-1] &= space[1:]
        starts = np.flatnonzero(begins)
        if not len(starts):
            none = np.empty(0, np.int64)
            return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64), Spans(joined, data, text_starts, none, none)
        lengths = np.flatnonzero(ends) + 1 - starts
        if (longest := int(lengths.max())) > len(self._powers):
            self._powers = self._make(1 << (longest - 1).bit_length())
        # byte by byte of all words at once, of which ever fewer are long enough; what long words have beyond STEPS bytes apart
        steps = np.minimum(lengths, STEPS).astype(np.uint8)
        order = np.argsort(steps, kind="stable")
        under = np.searchsorted(steps[order], np.arange(STEPS, dtype=np.uint8), side="right").tolist()
        place, sums_of = starts[order], np.zeros(len(order), np.uint64)
        for j in range(min(longest, STEPS)):
            k = under[j]
            sums_of[k:] += self._table.take(data.take(place[k:])) * self._powers[j]
            place[k:] += 1
        h = np.empty(len(order), np.uint64)
        h[order] = sums_of
        if len(far := np.flatnonzero(lengths > STEPS)):
            more = lengths[far] - STEPS
            first = np.cumsum(more) - more
            at = np.arange(int(more.sum())) - np.repeat(first, more) + STEPS
            h[far] += np.add.reduceat(self._table[data[np.repeat(starts[far], more) + at]] * self._powers[at], first)
        return mix64(h ^ lengths.astype(np.uint64)), np.searchsorted(starts, text_starts).astype(np.int64), Spans(joined, data, text_starts, starts, lengths)


@dataclass
class Spans:
    """Texts joined by line feeds, as bytes and as an array; where each text begins (one more at the end); where each word
    begins and its bytes."""

    joined: bytes
    data: np.ndarray
    texts: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    def words(self, at: Iterable[int]) -> list[bytes]:
        at = np.asarray(at, np.int64)
        return [self.joined[a : a + n] for a, n in zip(self.starts[at].tolist(), self.lengths[at].tolist(), strict=True)]


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the runs of values between the offsets at, of integers or doubles; empty runs have 0."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64 if values.dtype.kind in "biu" else np.float64)))
    return total[at[1:]] - total[at[:-1]]


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of `count` entries each, one run after the other."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - count), count)


@dataclass
class Ragged:
    """Rows of several numbers each: row i is flat[start[i] : start[i] + count[i]]."""

    flat: np.ndarray
    count: np.ndarray
    start: np.ndarray

    @staticmethod
    def of(rows: list[np.ndarray] | list[list[int]], kind: type = np.uint32) -> "Ragged":
        count = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.concatenate([np.asarray(r, kind) for r in rows]) if len(rows) else np.empty(0, kind)
        return Ragged(flat, count, np.cumsum(count) - count)

    def then(self, other: "Ragged") -> "Ragged":
        return Ragged(np.concatenate((self.flat, other.flat)), np.concatenate((self.count, other.count)), np.concatenate((self.start, other.start + len(self.flat))))

    def take(self, rows: np.ndarray) -> np.ndarray:
        """The numbers of the rows, one row after the other."""
        return self.flat[spread(self.start[rows], self.count[rows])]


class WordTable:
    """What a function gives for words, kept by the words' 64-bit hashes, so that texts are looked up by array operations.

    compute: from a list of words to a tuple of arrays or Raggeds, each with a row a word. A value depends on its word alone, so
    that the table may be emptied when it holds over `room` words: memory is bounded and results aren't changed. Two words
    of one hash would share a value: with a million words kept, that is 2^-44 a word looked up.
    """

    def __init__(self, compute: Callable[[list[bytes]], tuple[np.ndarray | Ragged, ...]], room: int = 1_000_000, lower_ascii: bool = True, marks: bytes = b""):
        self._compute, self._room, self._marks = compute, room, marks
        self.hasher = WordHasher(lower_ascii=lower_ascii)
        self._keys, self._slots = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.values: tuple[np.ndarray | Ragged, ...] = ()
        self.rows = 0

    def look_up(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Spans]:
        """For each word of the texts its row in `values`; the offset of each text's first word; the words' hashes; spans.
        Rows hold until the next call."""
        hashes, at, where = self.hasher.spans(texts, self._marks)
        if len(self._keys) > self._room:
            self._keys, self._slots, self.values, self.rows = np.empty(0, np.uint64), np.empty(0, np.int64), (), 0
        codes, unique = pd.factorize(hashes)
        if not len(unique):
            return codes.astype(np.int64), at, hashes, where
        place = np.searchsorted(self._keys, unique)
        known = place < len(self._keys)
        known[known] = self._keys[place[known]] == unique[known]
        slots = np.full(len(unique), -1, np.int64)
        slots[known] = self._slots[place[known]]
        if len(new := np.flatnonzero(~known)):
            first = np.empty(len(unique), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            got = self._compute(where.words(first[new]))
            self.values = tuple(a.then(b) if isinstance(a, Ragged) else np.concatenate((a, b)) for a, b in zip(self.values, got, strict=True)) if self.values else got
            slots[new] = np.arange(self.rows, self.rows + len(new))
            self.rows += len(new)
            order = np.argsort(unique[new])
            keys, rows = unique[new][order], slots[new][order]
            to = np.searchsorted(self._keys, keys)
            self._keys, self._slots = np.insert(self._keys, to, keys), np.insert(self._slots, to, rows)
        return slots[codes], at, hashes, where


def mix64(x: np.ndarray) -> np.ndarray:
    """The public 64-bit finaliser of splitmix, over an array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
