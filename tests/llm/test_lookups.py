"""Look-ups in Elias-Fano sequences and runs of counts, against brute force."""

import tracemalloc

import numpy as np
import pytest

from strataflow.llm import common, ngram_lm


def sequence(values: np.ndarray, top: int) -> ngram_lm.EliasFano:
    return ngram_lm.EliasFano(ngram_lm.EliasFano.encode("x", values, top), "x")


def test_access_copies_nothing_of_the_sequence():
    values = np.arange(0, 6_000_000, 3, dtype=np.uint64)
    ef = sequence(values, 6_000_000)
    tracemalloc.start()
    assert ef.access(np.array([7, 1_234_567])).tolist() == [21, 3_703_701]
    assert tracemalloc.get_traced_memory()[1] < ef.ones.nbytes / 2
    tracemalloc.stop()


@pytest.mark.parametrize("gap", [1, 3, 900, 2**40])
def test_bounds_and_neighbours(gap):
    """Also where whole words of the high bits hold nothing, or nothing but ones."""
    rng = np.random.default_rng(gap)
    values = np.sort(np.concatenate((rng.integers(0, 200, 300), gap * 500 + rng.integers(0, 200, 300), gap * 900 + rng.integers(0, gap, 5)))).astype(np.uint64)
    ef = sequence(values, gap * 1000 + 1000)
    high = (values >> np.uint64(ef.low_bits)).astype(np.int64)
    asked = np.unique(np.concatenate((high, high + 1, [0, int(high[-1]) + 1, int(high[-1]) + 500])))
    lo, hi = ef.bounds(asked)
    assert (lo == np.searchsorted(high, asked)).all() and (hi == np.searchsorted(high, asked, side="right")).all()
    one, two = ef.both(np.arange(len(values) - 1))
    assert (one == values[:-1]).all() and (two == values[1:]).all()


def test_runs_add_up():
    rng = np.random.default_rng(2)
    shards, keys = rng.integers(0, 5, 3000), rng.integers(0, 400, 3000).astype(np.uint64)
    keys = keys * np.uint64(5) + shards.astype(np.uint64)
    for codes in (np.zeros(3000, np.uint16), (keys % np.uint64(1000)).astype(np.uint16)):
        rows = list(ngram_lm.counted(((shards[i::3], keys[i::3], codes[i::3]) for i in range(3)), 1, 1000))
        assert len(rows) == 3
        for k in range(5):
            own = [r for b in rows for r in b.to_pylist() if r["shard"] == k]
            got, counts, code = ngram_lm.added([ngram_lm.unpacked(r["keys"], r["counts"], r["codes"]) for r in own])
            want, many = np.unique(keys[shards == k], return_counts=True)
            assert (got == want).all() and (counts == many).all()
            assert (code == (want % np.uint64(1000) if codes.any() else 0)).all()


@pytest.mark.parametrize("n", [7, 65536, 70000])
def test_by_shard(n):
    shard = np.random.default_rng(n).integers(0, n, 2000)
    order, at = ngram_lm.by_shard(shard, n)
    assert len(at) == n + 1 and at[-1] == len(shard)
    for k in set(shard.tolist()) | {0, n - 1}:
        assert order[at[k] : at[k + 1]].tolist() == np.flatnonzero(shard == k).tolist()


def test_hashes_byte_by_byte():
    hasher = common.WordHasher()
    words = [b"a", b"Ab", b"x" * common.STEPS, b"xy" * common.STEPS, b"z" * (common.STEPS + 1), b"\xc3\xa9" * 700, b"b"]
    hashes, at = hasher([b" ".join(words), b"", b"  " + words[3] + b"\n"])
    sums = [sum(int(hasher._table[c]) * int(hasher._powers[i]) for i, c in enumerate(w)) % 2**64 ^ len(w) for w in [*words, words[3]]]
    assert hashes.tolist() == common.mix64(np.array(sums, np.uint64)).tolist() and at.tolist() == [0, 7, 7, 8]
