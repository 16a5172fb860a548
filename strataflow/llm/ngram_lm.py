"""A trigram language model in an Elias-Fano trie of memory-mapped levels, counted and built by executors."""

from __future__ import annotations

import json
import mmap
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import WordHasher, chunked, mix64, shared_path, small_batches, text_bytes

#: The hash of the end of a text, counted as a token.
END = np.uint64(1)
#: Steps of a quantised probability: code q, of 16 bits, stands for 10 to the power -q * STEP, down to 10^-32.
STEP = 1 / 2048
#: Bytes of text that a shard of a level is made from, about, and that are looked up at once; shards that a run of counts is
#: dealt over at once.
SHARD_BYTES, CHUNK, FAN = 24_000_000, 1 << 22, 2048


#: Place of the k-th one of a byte, at byte * 8 + k - 1.
_IN_BYTE = np.array([next((i for i in range(8) if b >> i & 1 and bin(b & (2 << i) - 1).count("1") == k), 0) for b in range(256) for k in range(1, 9)], np.int64)


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary, with the number of ones before each word."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.n, self.low_bits = (int(x) for x in arrays[f"{name}.shape"])
        self.low, self.high, self.ones = arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.ones"]
        self.zeros = None

    @staticmethod
    def encode(name: str, values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
        n = len(values)
        low_bits = max(0, int(universe // max(1, n)).bit_length() - 1)
        parts = []
        for s in range(0, n, 1 << 16):
            low = values[s : s + (1 << 16)] & np.uint64((1 << low_bits) - 1)
            parts.append(np.packbits(((low[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little"))
        packed = np.concatenate([*parts, np.zeros(16, np.uint8)])
        packed = np.concatenate((packed, np.zeros(-len(packed) % 8, np.uint8))).view(np.uint64)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(places[-1]) if n else 0) // 64 * 64 + 128, np.uint8)
        bits[places] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64)))[:-1]
        return {f"{name}.shape": np.array([n, low_bits], np.int64), f"{name}.low": packed, f"{name}.high": high, f"{name}.ones": ones.astype(np.uint32 if n < 2**32 else np.uint64)}

    def lows(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        out = self.low.take(word) >> shift
        out |= (self.low.take(word + 1) << (np.uint64(63) - shift)) << np.uint64(1)
        return out & np.uint64((1 << self.low_bits) - 1)

    def _select(self, words: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the k-th (from 1) one in each word: halves down to a byte, then a table."""
        x, k, at = words.copy(), k.astype(np.uint8), np.zeros(len(words), np.uint8)
        for width in (32, 16, 8):
            ones = np.bitwise_count(x & np.uint64((1 << width) - 1))
            go = k > ones
            k -= ones * go
            step = go * np.uint8(width)
            at += step
            x >>= step.astype(np.uint64)
        return at.astype(np.int64) + _IN_BYTE.take(((x & np.uint64(255)) << np.uint64(3)).astype(np.int64) + (k - np.uint8(1)))

    def _next(self, bits: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the next one of the words `bits` after `place`, and whether the word has one."""
        rest = bits >> (place & 63).astype(np.uint64) >> np.uint64(1)
        return place + 1 + np.bitwise_count(~rest & (rest - np.uint64(1))), rest != 0

    def _zero(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the k-th (from 1) zero, and its word."""
        word = np.searchsorted(self.zeros, (k - 1).astype(self.zeros.dtype), side="right") - 1
        bits = ~self.high.take(word)
        return word * 64 + self._select(bits, k - self.zeros.take(word)), bits

    def bounds(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first value whose high part is at least `high`, and of the first whose is more."""
        if self.zeros is None:
            zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones.astype(np.int64)
            self.zeros = zeros.astype(np.uint32) if zeros[-1] < 2**32 - 64 else zeros
        most = int(self.zeros[-1]) + 64 - int(np.bitwise_count(self.high[-1]))
        known, after = np.minimum(high, most), np.minimum(high + 1, most)
        place, bits = self._zero(np.maximum(known, 1))
        lo = np.where(known > 0, np.minimum(place - (known - 1), self.n), 0)
        following, there = self._next(bits, place)  # mostly in the same word
        if len(far := np.flatnonzero(~there | (known == 0) | (known == after))):
            following[far] = self._zero(after[far])[0]
        return lo, np.minimum(following - (after - 1), self.n)

    def _one(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the one of the value at each index, and its word."""
        word = np.searchsorted(self.ones, at.astype(self.ones.dtype), side="right") - 1  # of one type, lest all of ones be copied
        bits = self.high.take(word)
        return word * 64 + self._select(bits, at + 1 - self.ones.take(word).astype(np.int64)), bits

    def access(self, at: np.ndarray) -> np.ndarray:
        """The values at the indices."""
        return ((self._one(at)[0] - at).astype(np.uint64) << np.uint64(self.low_bits)) | self.lows(at)

    def both(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at the indices and at the next ones."""
        place, bits = self._one(at)
        following, there = self._next(bits, place)
        if len(far := np.flatnonzero(~there)):
            following[far] = self._one(at[far] + 1)[0]
        low_bits = np.uint64(self.low_bits)
        return ((place - at).astype(np.uint64) << low_bits) | self.lows(at), ((following - at - 1).astype(np.uint64) << low_bits) | self.lows(at + 1)

    def find(self, values: np.ndarray, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Index of each value (of the last, if it comes again), between start and end if given, or -1."""
        if not self.n or not len(values):
            return np.full(len(values), -1, np.int64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        lo, hi = self.bounds(high)
        if start is not None:
            lo, hi = np.maximum(lo, start), np.minimum(hi, end)
        some = np.flatnonzero(lo < hi)
        lo, hi, want = lo.take(some), hi.take(some), values.take(some) & np.uint64((1 << self.low_bits) - 1)
        live = np.flatnonzero(hi - lo > 1)
        left, right, aim = lo.take(live), hi.take(live), want.take(live)
        while len(live):  # the last that is not larger, by halving the ranges that have several
            mid = (left + right) >> 1
            less = self.lows(mid) <= aim
            left, right = np.where(less, mid, left), np.where(less, right, mid)
            lo[live] = left
            more = np.flatnonzero(right - left > 1)
            live, left, right, aim = (x.take(more) for x in (live, left, right, aim))
        hit = np.flatnonzero(self.lows(lo) == want)
        out = np.full(len(values), -1, np.int64)
        out[some[hit]] = lo[hit]
        return out

    def within(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Index of each value, which is between start and end if at all, or -1. Only ranges that aren't empty are looked at."""
        out, some = np.full(len(values), -1, np.int64), np.flatnonzero(start < end)
        out[some] = self.find(values.take(some), start.take(some), end.take(some))
        return out


def save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Write arrays as one file of the shared folder, whole or not at all; a repeated task writes the same again."""
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    head, at = {}, 4096 * (1 + len(arrays) // 20)
    for k, a in arrays.items():
        head[k] = [a.dtype.str, at, len(a)]
        at += -(-a.nbytes // 64) * 64
    temp = f"{root}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(temp) as out:
        out.write(json.dumps(head).encode().ljust(4096 * (1 + len(arrays) // 20)))
        for a in arrays.values():
            out.write(a.tobytes().ljust(-(-a.nbytes // 64) * 64, b"\0"))
    fs.move(temp, f"{root}/{name}")


def load(folder: str, name: str) -> dict[str, np.ndarray]:
    """Map a file of the shared folder into memory. A folder that is no file system here is fetched into a nameless file."""
    fs, root = pafs.FileSystem.from_uri(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        with open(f"{root}/{name}", "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        with tempfile.TemporaryFile() as f, fs.open_input_stream(f"{root}/{name}") as source:
            while block := source.read(1 << 24):
                f.write(block)
            f.flush()
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    head = json.loads(data[:4096].rstrip(b" \0") if data[:4096].rstrip().endswith(b"}") else data[:8192].rstrip())
    return {k: np.frombuffer(data, np.dtype(d), n, at) for k, (d, at, n) in head.items()}


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different values, and the place of each value among them."""
    order = np.argsort(values)
    ranked = values.take(order)
    new = np.ones(len(values), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    back = np.empty(len(values), np.int64)
    back[order] = np.cumsum(new) - 1
    return ranked.take(np.flatnonzero(new)), back


def by_shard(shard: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices shard by shard, in order within each, and where each shard's begin (and the end). 16 bits are sorted by radix."""
    shard = shard.astype(np.uint16) if n <= 65536 else shard
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard.take(order), np.arange(n, dtype=shard.dtype)).tolist() + [len(order)]


def coded(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(p) / STEP), 0, 65535).astype(np.uint16)


@dataclass(frozen=True)
class Levels:
    """Where the trie is, and its totals. first, second, third: values in each shard of the levels."""

    folder: str
    first: tuple[int, ...]
    second: tuple[int, ...]
    third: tuple[int, ...]
    tokens: int
    prior: float

    @property
    def words(self) -> int:
        return sum(self.first)


class Words:
    """The first level: word hashes in shards by range; a word's id is its rank."""

    def __init__(self, levels: Levels):
        self.levels, self.n = levels, len(levels.first)
        self.offsets = np.concatenate(([0], np.cumsum(levels.first))).astype(np.int64)
        self._open: dict[int, tuple[EliasFano, np.ndarray]] = {}

    def _shard(self, k: int) -> tuple[EliasFano, np.ndarray]:
        if k not in self._open:
            a = load(self.levels.folder, f"first-{k}")
            self._open[k] = EliasFano(a, "words"), a["counts"]
        return self._open[k]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (or -1) and counts of sorted hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        at = np.searchsorted(range_of(hashes, self.n), np.arange(self.n + 1))
        for k in range(self.n):
            a, z = int(at[k]), int(at[k + 1])
            if a < z and self.levels.first[k]:
                words, own = self._shard(k)
                got = words.find(hashes[a:z] - np.uint64(low_of(k, self.n)))
                hit = np.flatnonzero(got >= 0)
                ids[a + hit] = got[hit] + self.offsets[k]
                counts[a + hit] = own[got[hit]]
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        out, shard = np.zeros(len(ids), np.int64), np.searchsorted(self.offsets, ids, side="right") - 1
        for k in np.unique(shard).tolist():
            at = np.flatnonzero(shard == k)
            out[at] = self._shard(k)[1][ids[at] - self.offsets[k]]
        return out


def low_of(k: int, n: int) -> int:
    return -(-(k << 32) // n) << 32


def range_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """The shard of each hash: n equal ranges."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


class Pairs:
    """The second level: shards by a hash of the pair, so that a frequent word's successors are spread. In a shard the
    contexts, a pointer to each context's successors, and the successors, relative to their context, with the code of
    their probability and that of the weight which they, as a context, leave to the shorter one."""

    def __init__(self, levels: Levels):
        self.levels, self.n = levels, len(levels.second)
        self._open: dict[int, tuple] = {}

    def _shard(self, k: int):
        if k not in self._open:
            a = load(self.levels.folder, f"second-{k}")
            self._open[k] = EliasFano(a, "contexts"), EliasFano(a, "pointers"), EliasFano(a, "successors"), a["codes"], a["backoffs"]
        return self._open[k]

    def find(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of pairs of words' ids, sorted: the shard, the place in it (-1: unknown pair), the two codes."""
        shard, place = pair_shard(one, two, self.n), np.full(len(one), -1, np.int64)
        codes, backoffs = np.zeros(len(one), np.uint16), np.zeros(len(one), np.uint16)
        order, at = by_shard(shard, self.n)
        for k in range(self.n):
            own = order[at[k] : at[k + 1]]
            if not len(own) or not self.levels.second[k]:
                continue
            contexts, pointers, successors, probable, back = self._shard(k)
            context = one.take(own)
            new = np.ones(len(own), bool)
            new[1:] = context[1:] != context[:-1]
            unique, where = context.take(np.flatnonzero(new)), np.cumsum(new) - 1
            rank = contexts.find(unique.astype(np.uint64))
            start, end = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
            known = np.flatnonzero(rank >= 0)
            start[known], end[known] = pointers.both(rank[known])
            some = np.flatnonzero((rank >= 0).take(where))
            own, where = own.take(some), where.take(some)
            value = rank.take(where).astype(np.uint64) * np.uint64(self.levels.words) + two.take(own).astype(np.uint64)
            got = successors.find(value, start.take(where), end.take(where))
            hit = np.flatnonzero(got >= 0)
            own, got = own.take(hit), got.take(hit)
            place[own], codes[own], backoffs[own] = got, probable.take(got), back.take(got)
        return shard, place, codes, backoffs


class Triples:
    """The third level: a shard for each of the second, with a pointer for each pair of that shard to the words that follow
    it, and these words, relative to their pair, with the code of their probability."""

    def __init__(self, levels: Levels):
        self.levels = levels
        self._open: dict[int, tuple] = {}

    def _shard(self, k: int):
        if k not in self._open:
            a = load(self.levels.folder, f"third-{k}")
            self._open[k] = EliasFano(a, "pointers"), EliasFano(a, "successors"), a["codes"]
        return self._open[k]

    def log10(self, shard: np.ndarray, place: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The quantised log10 probability of a word after a pair (its shard and place); NaN if the three are unknown."""
        out = np.full(len(place), np.nan)
        order, at = by_shard(shard, len(self.levels.third))
        for k in range(len(self.levels.third)):
            own = order[at[k] : at[k + 1]]
            if not len(own) or not self.levels.third[k]:
                continue
            pointers, successors, codes = self._shard(k)
            of = place.take(own)
            start, end = pointers.both(of)
            got = successors.within(of.astype(np.uint64) * np.uint64(self.levels.words) + word.take(own).astype(np.uint64), start.astype(np.int64), end.astype(np.int64))
            hit = np.flatnonzero(got >= 0)
            out[own.take(hit)] = codes.take(got.take(hit)) * -STEP
        return out


def pair_shard(one: np.ndarray, two: np.ndarray, n: int) -> np.ndarray:
    return range_of(mix64((one.astype(np.uint64) << np.uint64(32)) ^ two.astype(np.uint64) ^ np.uint64(0x2545F4914F6CDD1D)), n)


def tokens_of(texts: list[bytes], hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with an end after each text, and where each text starts (and the end of all)."""
    hashes, at = hasher(texts)
    return np.insert(hashes, at[1:], END), at + np.arange(len(at))


def packed(keys: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Sorted keys as differences by byte planes, counts and codes, compressed; each begins with its length before that."""

    def planes(a: np.ndarray) -> bytes:
        plain = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes()
        return len(plain).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(plain, asbytes=True)

    return planes(np.diff(keys, prepend=np.uint64(0))), planes(counts.astype(np.int64)), planes(codes)


def unpacked(keys: bytes, counts: bytes, codes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def planes(b: bytes, kind: type) -> np.ndarray:
        plain = pa.Codec("zstd").decompress(memoryview(b)[8:], int.from_bytes(b[:8], "little"))
        return np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()

    return np.cumsum(planes(keys, np.uint64), dtype=np.uint64), planes(counts, np.int64), planes(codes, np.uint16)


COUNTED = "shard int, keys binary, counts binary, codes binary"


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3)]], names=["shard", "keys", "counts", "codes"])


def counted(chunks: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], width: int, hold: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Rows (shard // width, keys, counts, codes) of the (shards, keys, codes) of all chunks, added up in runs of `hold`.
    A key's code is the same wherever it comes."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        shard, keys, codes = (np.concatenate([h[i] for h in held]) for i in range(3))
        group = shard // width
        order = np.argsort(group.astype(np.uint16) if group.max() < 65536 else group, kind="stable")
        keys, codes, group = keys.take(order), codes.take(order), group.take(order)
        at = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(order)])).tolist()
        rows = []
        for a, z in zip(at[:-1], at[1:], strict=True):
            own, code = keys[a:z], codes[a:z]
            if code.any():
                order = np.argsort(own)
                own, code = own.take(order), code.take(order)
            else:  # a level without codes
                own = np.sort(own)
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            rows.append((int(group[a]), *packed(own[first], np.diff(first, append=len(own)), code[first])))
        return rows_of(rows)

    for c in chunks:
        if len(c[1]):
            held.append(c)
            size += len(c[1])
        if size >= hold:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Sorted runs of (keys, counts, codes) as one."""
    if len(parts) == 1:
        return parts[0]
    keys, counts, codes = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys = keys.take(order)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[starts], np.add.reduceat(counts.take(order), starts), codes.take(order.take(starts))


def widths_of(shards: int) -> list[int]:
    """Shards of a group before each step that deals groups over at most FAN smaller ones; 1 at the end."""
    steps = 1
    while FAN**steps < shards:
        steps += 1
    fan = next(f for f in range(1, FAN + 1) if f**steps >= shards)
    return [fan**k for k in range(steps - 1, -1, -1)]


def dealt(rows: DataFrame, shards: int, amount: int, split) -> DataFrame:
    """Rows of runs for groups of shards as rows for single shards, one shard a partition. In each step a run is dealt over
    FAN groups at most, by tasks that each add up the runs of one group: so rows grow with the input times the number of
    steps, which is its logarithm, and not with runs times shards. split(batches, width before, width after)."""
    widths = widths_of(shards)
    for width, less in zip(widths[:-1], widths[1:], strict=True):
        groups = -(-shards // width)
        salts = max(1, -(-amount // (SHARD_BYTES * groups)))
        rows = rows.repartition(groups * salts, "shard", F.pmod(F.xxhash64("keys"), F.lit(salts))).sortWithinPartitions("shard").mapInArrow(lambda it, w=width, v=less: split(it, w, v), COUNTED)
    return rows.repartitionById(shards, "shard")


def resplit(batches: Iterable[pa.RecordBatch], width: int, less: int, shard_of, hold: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Rows of groups of `width` shards, one group after the other, added up in runs of `hold` keys and dealt over groups of
    `less` shards. shard_of(keys, group, width, less): the shards of a group's keys, and the keys in the smaller group."""

    def flush(parts: list[tuple[np.ndarray, ...]], group: int) -> pa.RecordBatch:
        keys, counts, codes = added(parts)
        shard, keys = shard_of(keys, group, width, less)
        to = shard // less
        order = np.argsort(to, kind="stable")
        at = np.concatenate(([0], np.flatnonzero(np.diff(to[order])) + 1, [len(order)])).tolist()
        return rows_of([(int(to[order[a]]), *packed(keys[order[a:z]], counts[order[a:z]], codes[order[a:z]])) for a, z in zip(at[:-1], at[1:], strict=True)])

    held, size, last = [], 0, None
    for b in batches:
        for shard, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and (shard != last or size >= hold):
                yield flush(held, last)
                held, size = [], 0
            held.append(unpacked(*row))
            size, last = size + len(held[-1][0]), shard
    if held:
        yield flush(held, last)


def merged(batches: Iterable[pa.RecordBatch]) -> tuple[int, tuple[np.ndarray, ...]] | None:
    """The number of a partition's shard, and all its keys with counts and codes."""
    shard, parts = None, []
    for b in batches:
        for shard, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            parts.append(unpacked(*row))
            if len(parts) > 16:
                parts = [added(parts)]
    return (shard, added(parts)) if parts else None


def narrow(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.uint32 if not len(counts) or counts.max() < 2**32 else np.int64)


def train(docs: DataFrame, prior: float = 20.0) -> Levels:
    """Count and build the trie of docs (text). Every text counts whole; nothing is pruned.

    Three passes: words, pairs of words' ranks, words after pairs. In each, a task adds up what it reads and sends compressed
    runs of sorted keys towards the shards (see `dealt`); a shard's task merges them and writes a file of its level to the
    shared folder. The number of shards follows the bytes of text, so a shard's task doesn't grow with the input. A word
    that makes a third of all tokens is one key in the first level and spread over all shards in the second; in the third
    a pair's successors lie together, as many as the vocabulary at most. To the driver come the sizes of the shards only.

    p(word) = (count + 1) / (N + V + 1); after one word (count + prior * p(word)) / (count of the context + prior); after two
    likewise, with the former in place of p(word).

    Null or empty text: an end alone. Very long text: whole. Repeated rows: counted each. Empty table: a model without
    words. Ids and other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = shared_path(spark, "ngram-lm")
    texts = docs.select(F.col("text").cast("string").alias("text"))
    amount = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = 1 + int(amount // SHARD_BYTES)
    width = widths_of(shards)[0]

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        hasher = WordHasher()
        for _, run in chunked((text_bytes(t) for b in batches for t in b.column(0).to_pylist()), CHUNK):
            yield tokens_of(run, hasher)

    def built(count, shard_of, build) -> dict[int, tuple[int, int]]:
        rows = dealt(texts.mapInArrow(count, COUNTED), shards, amount, lambda it, before, after: resplit(it, before, after, shard_of))

        def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if got := merged(batches):
                k, values = got
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([len(values[0])], pa.int64()), pa.array([build(k, *values)], pa.int64())], names=["shard", "n", "total"])

        # a row for each shard
        return {r["shard"]: (r["n"], r["total"]) for r in rows.mapInArrow(make, "shard int, n bigint, total bigint").collect()}

    sizes = lambda found: tuple(found.get(k, (0, 0))[0] for k in range(shards))
    none = lambda keys: np.zeros(len(keys), np.uint16)

    def count_words(batches):
        yield from counted(((range_of(h, shards), h, none(h)) for h, _ in runs(batches)), width)

    def build_words(k: int, keys: np.ndarray, counts: np.ndarray, _) -> int:
        save(folder, f"first-{k}", EliasFano.encode("words", keys - np.uint64(low_of(k, shards)), -(-(2**64) // shards)) | {"counts": narrow(counts)})
        return int(counts.sum())

    first = built(count_words, lambda keys, *_: (range_of(keys, shards), keys), build_words)
    levels = Levels(folder, sizes(first), (), (), sum(n for _, n in first.values()), prior)
    if not levels.tokens:
        return levels

    def count_pairs(batches) -> Iterator[pa.RecordBatch]:
        words = Words(levels)

        def chunks():
            for hashes, at in runs(batches):
                unique, back = distinct(hashes)
                ids = words.find(unique)[0].astype(np.uint64).take(back)
                keys = (ids[:-1] << np.uint64(32)) | ids[1:]
                inside = np.ones(len(keys), bool)
                inside[at[1:-1] - 1] = False  # from one text's end to the next text
                keys = keys.take(np.flatnonzero(inside))
                yield pair_shard(keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF), shards), keys, none(keys)

        yield from counted(chunks(), width)

    def build_pairs(k: int, keys: np.ndarray, counts: np.ndarray, _) -> int:
        one, two = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        words = Words(levels)
        starts = np.flatnonzero(np.concatenate(([True], one[1:] != one[:-1])))
        many = np.diff(np.concatenate((starts, [len(one)])))
        contexts = one[starts]
        whole = np.repeat(words.counts(contexts), many)
        lower = (words.counts(two) + 1) / (levels.tokens + levels.words + 1)
        rank = np.repeat(np.arange(len(starts), dtype=np.uint64), many)
        pointers = np.concatenate((starts, [len(one)])).astype(np.uint64)
        arrays = EliasFano.encode("contexts", contexts.astype(np.uint64), levels.words) | EliasFano.encode("pointers", pointers, len(one) + 1)
        arrays |= EliasFano.encode("successors", rank * np.uint64(levels.words) + two.astype(np.uint64), len(starts) * levels.words)
        save(folder, f"second-{k}", arrays | {"codes": coded((counts + prior * lower) / (whole + prior)), "backoffs": coded(prior / (counts + prior))})
        return int(counts.sum())

    second = built(count_pairs, lambda keys, *_: (pair_shard(keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF), shards), keys), build_pairs)
    levels = Levels(folder, levels.first, sizes(second), (), levels.tokens, prior)

    # a shard of the third level takes what follows the pairs of the second's. A key is the pair's place in its group of
    # shards, times the words, plus the word: for two steps and 24 MB a shard that suffices up to about 100 TB
    starts = np.concatenate(([0], np.cumsum(levels.second)))[:-1].astype(np.int64)
    if max(sum(levels.second[k : k + width]) for k in range(0, shards, width)) * levels.words >= 2**64:
        raise OverflowError("a group of shards has too many pairs for 64-bit keys")

    def regroup(keys: np.ndarray, group: int, before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
        place, word = keys // np.uint64(levels.words), keys % np.uint64(levels.words)
        own = starts[group * before : (group + 1) * before]
        shard = group * before + np.searchsorted(own - own[0], place.astype(np.int64), side="right") - 1
        return shard, (place + (own[0] - starts[shard // after * after]).astype(np.uint64)) * np.uint64(levels.words) + word

    def count_triples(batches) -> Iterator[pa.RecordBatch]:
        words, pairs = Words(levels), Pairs(levels)

        def chunks():
            for hashes, at in runs(batches):
                unique, back = distinct(hashes)
                ids = words.find(unique)[0].astype(np.uint64).take(back)
                joined, where = distinct((ids[:-1] << np.uint64(32)) | ids[1:])
                shard, place, codes, _ = pairs.find((joined >> np.uint64(32)).astype(np.int64), (joined & np.uint64(0xFFFFFFFF)).astype(np.int64))
                inside = np.ones(len(where), bool)
                inside[at[1:-1] - 1] = False
                both = np.flatnonzero(inside[:-1] & inside[1:])  # three tokens of one text
                context, last = where.take(both), where.take(both + 1)
                inner = (place + starts[shard] - starts[shard // width * width]).astype(np.uint64).take(context)
                yield shard.take(context), inner * np.uint64(levels.words) + ids.take(both + 2), codes.take(last)

        yield from counted(chunks(), width)

    def build_triples(k: int, keys: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> int:
        pair = (keys // np.uint64(levels.words)).astype(np.int64)
        whole = np.bincount(pair, counts, levels.second[k])[pair]  # each pair is followed as often as it comes
        pointers = np.concatenate(([0], np.cumsum(np.bincount(pair, minlength=levels.second[k])))).astype(np.uint64)
        arrays = EliasFano.encode("pointers", pointers, len(keys) + 1) | EliasFano.encode("successors", keys, levels.second[k] * levels.words)
        save(folder, f"third-{k}", arrays | {"codes": coded((counts + prior * 10.0 ** (codes * -STEP)) / (whole + prior))})
        return int(counts.sum())

    third = built(count_triples, regroup, build_triples) if sum(levels.second) else {}
    return Levels(folder, levels.first, levels.second, sizes(third), levels.tokens, prior)


_OPEN: dict[str, tuple[Words, Pairs, Triples]] = {}


def score_texts(texts: list[bytes], levels: Levels, words: Words, pairs: Pairs, triples: Triples, hasher: WordHasher) -> tuple[np.ndarray, ...]:
    """Tokens, known tokens, base score and score of each text."""
    hashes, at = tokens_of(texts, hasher)
    unique, back = distinct(hashes)
    ids, counts = words.find(unique)
    base = np.log10((counts + 1) / (levels.tokens + levels.words + 1))
    weight = np.log10(levels.prior / (counts + levels.prior))  # of the shorter context, for what doesn't follow
    tokens, low = ids.take(back), base.take(back)
    score = low.copy()
    follows = np.ones(len(tokens), bool)
    follows[at[:-1]] = False
    follows[1:] &= tokens[:-1] >= 0
    follows = np.flatnonzero(follows)
    score[follows] += weight.take(back.take(follows - 1))
    known = follows.take(np.flatnonzero(tokens.take(follows) >= 0))
    if len(known) and levels.second:
        keys, again = distinct((tokens.take(known - 1).astype(np.uint64) << np.uint64(32)) | tokens.take(known).astype(np.uint64))
        shard, place, codes, backoffs = pairs.find((keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64))
        pair = np.full(len(tokens) + 1, -1, np.int64)  # of each token: its pair with the one before, if that is known
        seen = np.flatnonzero((place >= 0).take(again))
        known, again = known.take(seen), again.take(seen)
        pair[known] = again
        score[known] = (codes * -STEP).take(again)
        # what follows a known pair: that pair's weight for the score so far, or the three's own probability
        first = np.zeros(len(tokens) + 1, bool)
        first[at[:-1]] = True
        after = np.flatnonzero((pair[:-1] >= 0) & ~first[1:]) + 1
        after = after[after < len(tokens)]
        if len(after) and levels.third:
            context = pair.take(after - 1)
            score[after] += (backoffs * -STEP).take(context)
            some = np.flatnonzero(tokens.take(after) >= 0)
            context, after = context.take(some), after.take(some)
            three, which = distinct((context.astype(np.uint64) << np.uint64(32)) | back.take(after).astype(np.uint64))
            of, word = (three >> np.uint64(32)).astype(np.int64), ids.take((three & np.uint64(0xFFFFFFFF)).astype(np.int64))
            found = triples.log10(shard.take(of), place.take(of), word).take(which)
            hit = np.flatnonzero(~np.isnan(found))
            score[after.take(hit)] = found.take(hit)
    return np.diff(at), np.add.reduceat((tokens >= 0).astype(np.int64), at[:-1]), np.add.reduceat(low, at[:-1]), np.add.reduceat(score, at[:-1])


def score(docs: DataFrame, levels: Levels) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of each whole text; no shuffle.

    Executors map the levels' files of the shared folder; pages that no text needs are not read.
    Null or empty text: the end token alone. Very long text: whole. Null doc_id: kept. Repeated rows: a row each. Empty
    table: no rows. A model of no text: every token is unknown, with probability 1. Other columns, whatever their names,
    are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if levels.folder not in _OPEN:
            _OPEN.clear()
            _OPEN[levels.folder] = Words(levels), Pairs(levels), Triples(levels)
        parts, hasher = _OPEN[levels.folder], WordHasher()
        ids: list[pa.Array] = []
        held: list[bytes] = []

        def flush() -> pa.RecordBatch:
            found = [score_texts(run, levels, *parts, hasher) for _, run in chunked(held, CHUNK)]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *map(pa.array, map(np.concatenate, zip(*found, strict=True)))], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

        size = 0
        for b in batches:  # several batches at once, as what they share is looked up once
            ids.append(b.column(0))
            held += (texts := [text_bytes(t) for t in b.column(1).to_pylist()])
            size += sum(map(len, texts))
            if size >= CHUNK:
                yield flush()
                ids, held, size = [], [], 0
        if held:
            yield flush()

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string")).mapInArrow(run, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
