"""Vector bin packing of token sequences by the dot-product heuristic."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from strataflow.llm.common import Ragged, WordTable, chunked, held, paused_gc, small_batches, spread, text_bytes

PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("loss_tokens", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("token_ids", pa.binary()),
])
PIECES_DDL = "doc_id bigint, start bigint, length bigint, loss_tokens bigint, doc_tokens bigint, sequence_id bigint, offset bigint, token_ids binary"


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most. max_gap: unused tokens that are left rather than cutting a document to fill them."""

    tokens: int = 2048
    segments: int = 16
    loss_tokens: int = 1984
    max_gap: int = 24
    #: Pieces that wait for a place at one time; bounds a task's memory.
    window: int = 512


class WordIds:
    """Token ids of texts from ids of their white-space words.

    For a tokeniser that lowers case and whose pieces cross neither white space nor the border between a letter or digit
    and a full stop or comma; its ids of a text are then those of its words, one after the other.
    """

    MARKS = b".,"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self._tokenizer, self._plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # for words of a to z alone: no normalising and no patterns
        self._plain.normalizer, self._plain.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._marks = np.zeros(256, np.uint32)
        for m in self.MARKS:
            (self._marks[m],) = self._tokenizer.encode(chr(m), add_special_tokens=False).ids
        self._table = WordTable(self._encode, marks=self.MARKS)

    def _joined(self, tokenizer, words: list[bytes]) -> list[np.ndarray] | None:
        """Many words as one text: each ends with the one piece that is marked as a word's end. None if that fails."""
        ids = np.array(tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self._ends[ids]) + 1
        return [ids, np.diff(ends, prepend=0)] if len(ends) == len(words) else None

    def _encode(self, words: list[bytes]) -> tuple[Ragged]:
        lowered = [w.lower() for w in words]  # bytes: A to Z only
        kinds = np.array([0 if w.isalpha() else 1 if (t := w.decode("utf-8", "replace")).isalpha() and t.lower().isalpha() else 2 for w in lowered], np.int8)
        order, flats, counts = [], [], []
        for kind, tokenizer in ((0, self._plain), (1, self._tokenizer)):
            own = np.flatnonzero(kinds == kind)
            for s in range(0, len(own), 2048):
                run = own[s : s + 2048]
                if (got := self._joined(tokenizer, [lowered[i] for i in run.tolist()])) is None:
                    kinds[run] = 2
                else:
                    order.append(run)
                    flats.append(got[0])
                    counts.append(got[1])
        if len(rest := np.flatnonzero(kinds == 2)):
            each = self._tokenizer.encode_batch_fast([lowered[i].decode("utf-8", "replace") for i in rest.tolist()], add_special_tokens=False)
            order.append(rest)
            flats.append(np.array([i for e in each for i in e.ids], np.uint32))
            counts.append(np.array([len(e.ids) for e in each], np.int64))
        at, flat, count = np.concatenate(order), np.concatenate(flats), np.concatenate(counts)
        start = np.empty(len(at), np.int64)
        size = np.empty(len(at), np.int64)
        start[at], size[at] = np.cumsum(count) - count, count
        return (Ragged(flat, size, start),)

    def __call__(self, texts: list[bytes], prompt_end: bytes | None) -> Iterator[tuple[bytes, int]]:
        """The ids of each text, and how many of them come from words before its first `prompt_end`."""
        rows, at, _, where = self._table.look_up(texts)
        ids, counts = np.empty(0, np.uint32), np.empty(0, np.int64)
        if len(rows):
            known, ends = self._table.values[0], where.starts + where.lengths
            mark = np.zeros(len(rows), np.uint32)
            here = ends < len(where.data)
            mark[here] = self._marks[where.data[ends[here]]]
            plain, marked = known.count[rows], (mark > 0).astype(np.int64)
            counts = plain + marked
            ids = np.empty(int(counts.sum()), np.uint32)
            first = np.cumsum(counts) - counts
            ids[spread(first, plain)] = known.take(rows)
            ids[(first + plain)[mark > 0]] = mark[mark > 0]
        before = np.concatenate(([0], np.cumsum(counts)))
        raw = memoryview(ids.astype("<u4").tobytes())
        for i, (text, a, z) in enumerate(zip(texts, at[:-1].tolist(), at[1:].tolist(), strict=True)):
            cut = text.find(prompt_end) if prompt_end else -1
            prompt = 0 if cut < 0 else int(before[a + np.searchsorted(where.starts[a:z], where.texts[i] + cut)] - before[a])
            yield bytes(raw[4 * int(before[a]) : 4 * int(before[z])]), prompt


class Packer:
    """Fills one sequence at a time. Of the waiting pieces that fit, the one goes in whose demand has the largest
    weighted dot product with the room left; the weights are the mean demands of what waits. When nothing fits and more
    than max_gap tokens are free, the largest waiting piece is cut to fill the room."""

    def __init__(self, limits: Limits):
        if min(limits.tokens, limits.segments, limits.loss_tokens) < 1:
            raise ValueError("limits must be positive")
        self.limits = limits
        self._waiting: list[tuple] = []
        self.sequences = 0

    def _piece(self, doc_id: int, start: int, ids: memoryview, total: int, silent: int) -> tuple:
        n = len(ids) // 4
        return doc_id, start, n, n - min(n, max(0, silent - start)), total, ids, silent

    def _longest(self, start: int, silent: int, tokens: int, loss: int) -> int:
        """How many tokens from `start` on fit into so many tokens and so many that bear loss."""
        return min(tokens, loss + max(0, silent - start))

    def add(self, doc_id: int, ids: bytes, silent: int = 1) -> Iterator[list[tuple]]:
        """silent: the first tokens of the document, which bear no loss."""
        total, view, at = len(ids) // 4, memoryview(ids), 0
        while at < total:
            n = self._longest(at, silent, self.limits.tokens, self.limits.loss_tokens)
            self._waiting.append(self._piece(doc_id, at, view[4 * at : 4 * (at + n)], total, silent))
            at += n
        if len(self._waiting) >= 2 * self.limits.window:
            yield from self._drain(self.limits.window)

    def finish(self) -> Iterator[list[tuple]]:
        yield from self._drain(0)

    def _cut(self, waiting: list[tuple | None], tokens: np.ndarray, loss: np.ndarray, room_t: int, room_l: int) -> tuple[int, int] | None:
        """The piece to cut and where: the largest one if room for loss is left, else that with most tokens before its loss."""
        here = np.isfinite(tokens)
        want = np.where(here, tokens, 0) if room_l > self.limits.max_gap else np.where(here, tokens, 0) - np.where(here, loss, 0)
        k = int(np.argmax(np.where(here, want, -1.0)))
        n = self._longest(waiting[k][1], waiting[k][6], room_t, room_l)
        return (k, n) if n > self.limits.max_gap and n < tokens[k] else None

    def _drain(self, leave: int) -> Iterator[list[tuple]]:
        waiting, most = self._waiting, self.limits
        tokens = np.array([p[2] for p in waiting], float)
        loss = np.array([p[3] for p in waiting], float)
        left = len(waiting)
        gone = np.inf  # demand of a piece that has its place
        while left > leave:
            room_t, room_s, room_l, rows, offset = most.tokens, most.segments, most.loss_tokens, [], 0
            here = np.isfinite(tokens)
            per_t, per_s, per_l = tokens[here].mean() / most.tokens**2, 1 / most.segments**2, loss[here].mean() / most.loss_tokens**2
            while left:
                fits = (tokens <= room_t) & (loss <= room_l) if room_s >= 1 else np.zeros(1, bool)
                if fits.any():
                    among = np.flatnonzero(fits)
                    k = int(among[np.argmax(tokens[among] * (per_t * room_t) + loss[among] * (per_l * room_l) + per_s * room_s)])
                    piece = waiting[k]
                    tokens[k] = loss[k] = gone
                    waiting[k] = None
                    left -= 1
                elif room_t > most.max_gap and room_s >= 1 and (cut := self._cut(waiting, tokens, loss, room_t, room_l)):
                    k, n = cut
                    doc_id, start, _, _, total, ids, silent = waiting[k]
                    piece = self._piece(doc_id, start, ids[: 4 * n], total, silent)
                    waiting[k] = rest = self._piece(doc_id, start + n, ids[4 * n :], total, silent)
                    tokens[k], loss[k] = rest[2], rest[3]
                else:
                    break
                rows.append((*piece, offset))
                offset += piece[2]
                room_t, room_s, room_l = room_t - piece[2], room_s - 1, room_l - piece[3]
            self.sequences += 1
            yield rows
        self._waiting = [p for p in waiting if p is not None]


def word_ids(path: str) -> WordIds:
    """One cache for all tasks of a Python worker."""
    return held(("packing", path), lambda: WordIds(path))


def pack_partition(batches: Iterable[pa.RecordBatch], ids_of: WordIds, end_id: int, limits: Limits, part: int, prompt_end: bytes | None) -> Iterator[pa.RecordBatch]:
    packer, end = Packer(limits), np.asarray([end_id], "<u4").tobytes()

    def table(sequences: Iterable[list[tuple]]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in PIECES]
        for rows in sequences:
            sequence_id = (part << 32) + packer.sequences - 1
            for doc_id, start, n, loss, total, ids, _, offset in rows:
                for col, v in zip(cols, (doc_id, start, n, loss, total, sequence_id, offset, bytes(ids)), strict=True):
                    col.append(v)
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, PIECES, strict=True)], schema=PIECES)

    for batch in batches:
        doc_ids, texts = batch.column(0).to_pylist(), [text_bytes(t) for t in batch.column(1).to_pylist()]
        for first, run in chunked(texts):
            for doc_id, (ids, prompt) in zip(doc_ids[first:], ids_of(run, prompt_end), strict=False):
                yield from table(packer.add(doc_id, ids + end, max(1, prompt)))
    yield from table(packer.finish())


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, limits: Limits = Limits(), prompt_end: str | None = "\n") -> DataFrame:
    """Pack all docs (doc_id, text) into sequences within limits; a row for each piece.

    Each input partition is tokenised and packed in one pass, without a shuffle: a sequence never spans partitions, so
    at most the last sequence of a partition is short. sequence_id is the partition's number times 2^32 plus a counter.
    A document longer than a sequence is cut; each of its ids lies in exactly one piece. A segment is a piece.

    A document is a prompt up to its first `prompt_end`, and an answer: only the answer's tokens and the end id bear
    loss. Without one (or with prompt_end None) every token bears loss but the first. So tokens and loss tokens are two
    demands, and sequences that reach the loss limit are filled up with prompts.

    Null or empty text: the end id alone. Very long text: cut into pieces of a sequence. Null doc_id: kept as null.
    Repeated rows: packed each. Ties: the piece that waits longest. Empty table: no rows. Other columns are not read.
    tokenizer: path of a `tokenizers` file of the kind whose pieces never cross white space.
    """
    small_batches(docs.sparkSession)
    ends = prompt_end.encode() if prompt_end else None

    def run(batches):
        with paused_gc():
            yield from pack_partition(batches, word_ids(tokenizer), end_id, limits, TaskContext.get().partitionId(), ends)

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string")).mapInArrow(run, PIECES_DDL)
