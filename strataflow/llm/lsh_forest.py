"""N-gram Jaccard join by a MinHash LSH forest with exact verification."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataflow.llm.common import WordHasher, chunked, cut, fresh, mix64, small_batches, text_bytes, written
from strataflow.llm.components import components, forest


@dataclass(frozen=True)
class Forest:
    """shingle: words of an n-gram. threshold: Jaccard similarity from which texts are linked. trees, depth: prefix trees
    of the forest and hashes in each. recall: share of the pairs of the least similarity that the matched prefixes must
    find. block: members of a trie node that are matched at once. budget: shingles in a block of exact comparisons."""

    shingle: int = 5
    threshold: float = 0.8
    trees: int = 20
    depth: int = 8
    recall: float = 0.9995
    block: int = 2048
    budget: int = 250_000
    seed: int = 11

    def depth_for(self, similarity: float) -> int:
        """The longest prefix by which a pair of that similarity is found in some tree with probability `recall`."""
        d = self.depth
        while d > 1 and 1 - (1 - similarity**d) ** self.trees < self.recall:
            d -= 1
        return d

    @property
    def shortest(self) -> int:
        return self.depth_for(self.threshold)

    def least_equal(self) -> int:
        """Equal hashes of two signatures that a pair at the threshold has but for about one in 10,000."""
        n = self.trees * self.depth
        return int(n * self.threshold - 3.8 * np.sqrt(n * self.threshold * (1 - self.threshold)))


@lru_cache(maxsize=4096)
def own_depth(n: int, config: Forest) -> int:
    """To what prefix a text of n shingles shortens its search: the one for the least similarity, of the threshold or more,
    that it can have with another set. 0: it can have none, as no other set comes so near."""
    least = 2.0
    for m in range(ceil(n * config.threshold - 1e-9), floor(n / config.threshold + 1e-9) + 1):
        both = ceil(config.threshold * (n + m) / (1 + config.threshold) - 1e-9)
        if both < n or both < m:
            least = min(least, both / (n + m - both))
        elif n != m:
            least = min(least, min(n, m) / max(n, m))
    return 0 if least > 1 else config.depth_for(least)


def shingles(texts: list[bytes], hasher: WordHasher, size: int) -> list[np.ndarray]:
    """Sorted different hashes of each text's runs of `size` words; of all its words if it has fewer."""
    hashes, at = hasher(texts)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        n = b - a
        if not n:
            out.append(np.empty(0, np.uint64))
            continue
        width = min(size, n)
        runs = np.zeros(n - width + 1, np.uint64)
        for i in range(width):
            runs = runs * np.uint64(0x9E3779B97F4A7C15) + hashes[a + i : a + i + len(runs)]
        out.append(np.unique(mix64(runs + np.uint64(width))))
    return out


def signatures(sets: list[np.ndarray], config: Forest) -> np.ndarray:
    """The MinHash of each non-empty set, trees * depth values of 32 bits, a tree's values side by side."""
    rng = np.random.Generator(np.random.PCG64(config.seed))
    n = config.trees * config.depth
    times, plus = rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), n), np.uint32)
    for i in range(n):
        y = (x ^ plus[i]) * times[i]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        out[:, i] = np.minimum.reduceat(y, starts)
    return out


SKETCH = "doc_id bigint, text_hash bigint, node bigint, check bigint, shingles int, depth int, keys array<bigint>, signature binary"


def sketch(batches: Iterable[pa.RecordBatch], config: Forest) -> Iterator[pa.RecordBatch]:
    """From doc_id, text, text_hash: two hashes of the text's set of shingles, to what depth it looks for partners, for each
    tree the hash of its shortest prefix, and the signature in 16 bits a value."""
    hasher, d = WordHasher(), config.shortest
    for b in batches:
        ids, hashes = b.column(0).to_pylist(), b.column(2).to_pylist()
        for first, run in chunked([text_bytes(t) for t in b.column(1).to_pylist()], 1 << 20):
            sets = shingles(run, hasher, config.shingle)
            keys, sigs = [None] * len(sets), [None] * len(sets)
            node, check = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
            depths = np.array([own_depth(min(len(s), 400), config) if len(s) else 0 for s in sets], np.int32)
            for i, s in enumerate(sets):
                if len(s):
                    node[i], check[i] = mix64(s).sum().view(np.int64), mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64)
            if len(seek := np.flatnonzero(depths)):
                sig = signatures([sets[i] for i in seek.tolist()], config)
                prefix = np.arange(config.trees, dtype=np.uint64)[None, :].repeat(len(seek), 0)
                for i in range(d):
                    prefix = mix64(prefix * np.uint64(0x9E3779B97F4A7C15) + sig[:, i :: config.depth])
                # the tree's number takes the top bits, so that a key tells it
                prefix = prefix >> np.uint64(8) | np.arange(config.trees, dtype=np.uint64)[None, :] << np.uint64(56)
                short = sig.astype(">u2")  # big-endian, so that bytes sort as the values do
                for k, i in enumerate(seek.tolist()):
                    keys[i], sigs[i] = prefix[k].view(np.int64), short[k].tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[first : first + len(run)], pa.int64()), pa.array(hashes[first : first + len(run)], pa.int64()), pa.array(node), pa.array(check),
                    pa.array([len(s) for s in sets], pa.int32()), pa.array(depths), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary()),
                ],
                names=["doc_id", "text_hash", "node", "check", "shingles", "depth", "keys", "signature"],
            )


def grouped(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that are equal in the first `keys` columns, of rows that come sorted by them."""
    held: list[pa.RecordBatch] = []

    def flush() -> pa.Table:
        return pa.Table.from_batches(held).combine_chunks()

    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for a, z in zip(starts[:-1], starts[1:], strict=True):
            own = tuple(c[a] for c in cols)
            if held and own != last:
                yield flush()
                held.clear()
            held.append(b.slice(a, z - a))
            last = own
    if held:
        yield flush()


class Unions:
    """Sets of indices that are joined, and the joins that were needed."""

    def __init__(self, n: int):
        self.root, self.links = np.arange(n), []

    def join(self, a: int, others: np.ndarray) -> None:
        """Put the sets of others into that of a."""
        for b in others.tolist():
            one, two = self.root[a], self.root[b]
            if one != two:
                self.root[self.root == two] = one
                self.links.append((a, b))


def matched(label: np.ndarray, sig: np.ndarray, depth: np.ndarray, shortest: int, least: int) -> Unions:
    """Which members of a trie node are connected by near signatures (equal in `least` places or more).

    label: the members' values in this tree, sorted, so that those of one prefix lie together. From the longest prefix to
    the shortest, whose members they all are: the first member of a run of one prefix is held against the run's members
    that aren't connected to it yet. What the runs of the shortest prefix leave apart is compared member by member, but for
    groups whose leaders' distance, less both radii, is too large for any near pair. A member is compared by prefixes of its
    own depth or more only. So a node of near copies costs a comparison a member, and only unlike groups cost products.
    """
    n, width = len(label), sig.shape[1]
    found = Unions(n)
    lcp = np.cumprod(label[1:] == label[:-1], axis=1).sum(axis=1)
    for d in range(label.shape[1], shortest - 1, -1):
        run = np.concatenate(([0], np.cumsum(lcp < d)))
        starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        sizes = np.diff(np.append(starts, n))
        for a, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            while len(apart := np.flatnonzero((found.root[a : a + size] != found.root[a]) & (depth[a : a + size] <= d)) + a) and depth[a] <= d:
                near = apart[(sig[apart] == sig[a]).sum(axis=1) >= least]
                if not len(near):
                    break
                found.join(a, near)
    roots = np.unique(found.root)
    if len(roots) > 1:
        groups = [np.flatnonzero(found.root == r) for r in roots.tolist()]
        lead = np.array([g[0] for g in groups])
        radius = np.array([width - int((sig[g] == sig[g[0]]).sum(axis=1).min()) for g in groups])
        for i in range(len(groups)):
            gap = width - (sig[lead[i + 1 :]] == sig[lead[i]]).sum(axis=1) - radius[i] - radius[i + 1 :]
            for j in (np.flatnonzero(gap <= width - least) + i + 1).tolist():
                if found.root[lead[i]] != found.root[lead[j]] and (hit := first_near(sig, groups[i], groups[j], least)):
                    found.join(hit[0], np.array([hit[1]]))
    return found


def first_near(sig: np.ndarray, one: np.ndarray, two: np.ndarray, least: int) -> tuple[int, int] | None:
    """A near pair between two groups, if there is one."""
    step = max(1, 4_000_000 // (len(two) * sig.shape[1]))
    for s in range(0, len(one), step):
        i, j = np.nonzero((sig[one[s : s + step], None, :] == sig[None, two, :]).sum(axis=2, dtype=np.int16) >= least)
        if len(i):
            return int(one[s + i[0]]), int(two[j[0]])
    return None


def signature_rows(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u2").astype(np.uint16).reshape(n, -1)


def candidates(batches: Iterable[pa.RecordBatch], config: Forest) -> Iterator[pa.RecordBatch]:
    """From key, own, node, depth, many, signature, sorted by the first two and the tree's label: links (a, b) within a block
    of a trie node, and, where the node has many blocks, a row (key, a: its first member, radius, signature) for each
    connected group of the block."""
    for t in grouped(batches, 2):
        n, nodes, many = t.num_rows, t.column(2).to_numpy(), t.column(4)[0].as_py()
        if n < 2 and not many:
            continue
        key, sig = t.column(0)[0].as_py(), signature_rows(t.column(5), n)
        tree = (key & 0xFFFFFFFFFFFFFFFF) >> 56
        found = matched(sig[:, tree * config.depth : (tree + 1) * config.depth], sig, t.column(3).to_numpy(), config.shortest, config.least_equal())
        at = np.array(found.links, np.int64).reshape(-1, 2)
        lead, radius, signs = [], [], []
        if many:
            for r in np.unique(found.root).tolist():
                own = np.flatnonzero(found.root == r)
                lead.append(nodes[own[0]])
                radius.append(sig.shape[1] - int((sig[own] == sig[own[0]]).sum(axis=1).min()))
                signs.append(sig[own[0]].astype(">u2").tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([None] * len(at) + [key] * len(lead), pa.int64()), pa.array(np.concatenate((nodes[at[:, 0]], np.array(lead, np.int64)))),
                pa.array(nodes[at[:, 1]].tolist() + [None] * len(lead), pa.int64()), pa.array([None] * len(at) + radius, pa.int32()), pa.array([None] * len(at) + signs, pa.binary()),
            ],
            names=["key", "a", "b", "radius", "signature"],
        )


def across(batches: Iterable[pa.RecordBatch], config: Forest) -> Iterator[pa.RecordBatch]:
    """From key, one, two, own, id, radius, signature, sorted by the first three: links between groups of two blocks of
    groups that may hold a near pair, going by their leaders' distance less both radii. A link too many costs an exact
    comparison later, nothing else."""
    for t in grouped(batches, 3):
        one, two, own, ids = t.column(1)[0].as_py(), t.column(2)[0].as_py(), t.column(3).to_numpy(), t.column(4).to_numpy()
        sig, radius = signature_rows(t.column(6), len(ids)), t.column(5).to_numpy()
        rows = np.flatnonzero(own == one)
        cols = rows if one == two else np.flatnonzero(own == two)
        found, least, width = Unions(len(ids)), config.least_equal(), sig.shape[1]
        for i in rows.tolist():
            apart = cols[found.root[cols] != found.root[i]]
            if len(apart):
                found.join(i, apart[width - (sig[apart] == sig[i]).sum(axis=1) - radius[i] - radius[apart] <= width - least])
        at = np.array(found.links, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(ids[at[:, 0]]), pa.array(ids[at[:, 1]])], names=["a", "b"])


SETS = "root bigint, id bigint, copies bigint, shingles int, hashes binary"


def shingle_sets(batches: Iterable[pa.RecordBatch], config: Forest) -> Iterator[pa.RecordBatch]:
    """From root, id, copies, text: the text's set of shingles, in place of the text."""
    hasher = WordHasher()
    for b in batches:
        sets: list[np.ndarray] = []
        for _, run in chunked([text_bytes(x) for x in b.column(3).to_pylist()], 1 << 20):
            sets += shingles(run, hasher, config.shingle)
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["root", "id", "copies", "shingles", "hashes"])


def to_pivot(batches: Iterable[pa.RecordBatch], config: Forest) -> Iterator[pa.RecordBatch]:
    """From SETS and the pivot's hashes: SETS and whether the similarity to the pivot is (1 + threshold) / 2 or more."""
    for b in batches:
        ball = []
        for raw, other in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
            own, pivot = np.frombuffer(raw, np.uint64), np.frombuffer(other, np.uint64)
            both = len(np.intersect1d(own, pivot, assume_unique=True))
            ball.append(both >= (1 + config.threshold) / 2 * (len(own) + len(pivot) - both) - 1e-9)
        yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(ball, pa.bool_())], names=["root", "id", "copies", "shingles", "hashes", "ball"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set."""
    out = np.zeros((len(left), len(right)), np.float32)
    lv, rv = np.concatenate(left), np.concatenate(right)
    li, ri = np.repeat(np.arange(len(left)), [len(s) for s in left]), np.repeat(np.arange(len(right)), [len(s) for s in right])
    common = np.intersect1d(lv, rv)
    lk, rk = np.searchsorted(common, lv), np.searchsorted(common, rv)
    lok, rok = (lk < len(common)), (rk < len(common))
    lok[lok] = common[lk[lok]] == lv[lok]
    rok[rok] = common[rk[rok]] == rv[rok]
    lk, li, rk, ri = lk[lok], li[lok], rk[rok], ri[rok]
    lo, ro = np.argsort(lk, kind="stable"), np.argsort(rk, kind="stable")
    lk, li, rk, ri = lk[lo], li[lo], rk[ro], ri[ro]
    width = 8192  # columns at a time, so that memory doesn't grow with the texts
    for s in range(0, len(common), width):
        a, b = np.searchsorted(lk, [s, s + width])
        c, d = np.searchsorted(rk, [s, s + width])
        n = min(width, len(common) - s)
        x, y = np.zeros((len(left), n), np.float32), np.zeros((len(right), n), np.float32)
        x[li[a:b], lk[a:b] - s] = 1
        y[ri[c:d], rk[c:d] - s] = 1
        out += x @ y.T
    return out


def verified(batches: Iterable[pa.RecordBatch], config: Forest) -> Iterator[pa.RecordBatch]:
    """From root, one, two, own, id, copies, hashes, sorted by the first three: with exact similarities of the sets of block
    one with those of block two, a row (a: id, b: null, links) for each text that has links, and links (a, b, null) that
    connect the same texts as all do."""
    for t in grouped(batches, 3):
        one, two, own = t.column(1)[0].as_py(), t.column(2)[0].as_py(), t.column(3).to_numpy()
        ids, copies = t.column(4).to_numpy(), t.column(5).to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in t.column(6).to_pylist()]
        rows = np.flatnonzero(own == one)
        cols = rows if one == two else np.flatnonzero(own == two)
        if not len(rows) or not len(cols):
            continue
        sizes = np.array([len(s) for s in sets], float)
        common = overlaps([sets[i] for i in rows], [sets[j] for j in cols])
        near = common >= config.threshold * (sizes[rows][:, None] + sizes[cols][None, :] - common) - 1e-6
        near &= ids[rows][:, None] != ids[cols][None, :]
        i, j = np.nonzero(near)
        links = np.zeros(len(ids), np.int64)
        links[rows] += near @ copies[cols]
        if one != two:
            links[cols] += near.T @ copies[rows]
        at = np.array(forest(len(ids), rows[i], cols[j]), np.int64).reshape(-1, 2)
        with_links = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((ids[with_links], ids[at[:, 0]]))), pa.array([None] * len(with_links) + ids[at[:, 1]].tolist(), pa.int64()), pa.array(links[with_links].tolist() + [None] * len(at), pa.int64())],
            names=["a", "b", "links"],
        )


def spread(column: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(column), blocks).cast("int")


def paired(df: DataFrame, own: Column, others: Column) -> DataFrame:
    """A row for each pair (one, two) of blocks that a row takes part in; others: an array of the blocks it meets."""
    named = df.withColumn("own", own).withColumn("_other", F.explode(others))
    return named.withColumns({"one": F.least("own", "_other"), "two": F.greatest("own", "_other")}).drop("_other")


def candidate_links(nodes: DataFrame, config: Forest) -> DataFrame:
    """a, b: links that connect texts whose signatures are near, as few as connect what all such links would."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = nodes.select(F.col("node"), F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("h")).where("n > 1")
    # trie nodes of the same members, in other trees, would say the same: one of them is enough
    shared = shared.groupBy("n", "h").agg(F.min("key").alias("key")).drop("h")
    blocks = F.ceil(F.col("n") / F.lit(config.block)).cast("int")
    dealt = keyed.join(shared, "key").select("key", spread("node", blocks).alias("own"), "node", (blocks > 1).alias("many"))
    members = dealt.join(nodes.select("node", "depth", "signature"), "node")
    width, tree = 2 * config.depth, F.shiftrightunsigned("key", 56).cast("int")
    label = F.substring(F.col("signature"), tree * width + 1, F.lit(width))
    ordered = members.select("key", "own", "node", "depth", "many", "signature", label.alias("label")).repartition(parts, "key", "own").sortWithinPartitions("key", "own", "label").drop("label")
    found = cut(ordered.mapInArrow(lambda it: candidates(it, config), "key bigint, a bigint, b bigint, radius int, signature binary"))
    groups = found.where("b is null").select("key", F.col("a").alias("id"), "radius", "signature")
    sizes = groups.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(config.block)).cast("int").alias("blocks"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    two = paired(groups.join(sizes, "key"), spread("id", F.col("blocks")), every).select("key", "one", "two", "own", "id", "radius", "signature")
    at = ["key", "one", "two"]
    more = two.repartition(parts, *at).sortWithinPartitions(*at).mapInArrow(lambda it: across(it, config), "a bigint, b bigint")
    return cut(found.where("b is not null").select("a", "b").unionByName(more).distinct())


def near_duplicates(docs: DataFrame, config: Forest = Forest()) -> DataFrame:
    """doc_id, class_id, n_links and n_copies of each row: rows whose sets of word shingles have a Jaccard similarity of at
    least the threshold are linked; a class is a connected component of links, named by its smallest doc_id; n_links counts
    the other rows that a row is linked to, its copies included; n_copies the rows of its set of shingles.

    Texts are compared as ASCII-lower-cased white-space words. Copies (equal sets) are folded into one first. Each tree of
    the forest has the texts' MinHash values as labels; texts that share the shortest prefix form a node, whose members are
    sorted by label and matched from the longest prefix down (see `matched`). A text stops at the prefix by which partners
    of the least similarity that it can have are found with probability `recall`; one that can have no partner isn't
    looked for. A node of many members is dealt over blocks by a hash; the blocks' groups then meet by one row a group.

    Components of candidates are compared exactly, by sets of 64-bit hashes of shingles. Those of more than a block get a
    pivot: as Jaccard distance is a metric, members within half the threshold's distance of it are all linked to each
    other, which counts their links without comparing them; blocks that have others are compared pair by pair. No pair of
    a group is written out, none is left out, and no group meets in one task.

    Null, empty or white-space text: a class of its own, no links. Null doc_id: class null, no links. Texts of fewer words
    than a shingle: one shingle of all words. Very long text: whole. Repeated rows: copies, a row each. One doc_id with two
    texts: each row goes by its own text. Ties: the smallest doc_id names a class. Empty table: no rows. Other columns,
    whatever their names, are not read. Pairs at the threshold are missed with a probability below 1 - recall + 1/10,000.
    """
    return classified(docs, config).drop("text_hash")


def keep_one(docs: DataFrame, config: Forest = Forest()) -> DataFrame:
    """docs with one row of each class of near duplicates: that with the smallest doc_id, of its repeats any one. All columns
    stay, whatever their names.

    Rows without a doc_id or without a word stay, repeated or not. One doc_id with two texts: each row goes by its text.
    Empty table: no rows.
    """
    hashed, rank, key = fresh(docs, "_text_hash", "_rank", "_doc_id")
    first = classified(docs, config).where("text_hash is not null").groupBy("class_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("at")).select(F.col("at.doc_id").alias(key), F.col("at.text_hash").alias(hashed))
    named = docs.withColumns({hashed: F.xxhash64(docs["text"].cast("string")), key: docs["doc_id"].cast("bigint")})
    worded = F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]") & F.col("doc_id").isNotNull()
    order = Window.partitionBy(key, hashed).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    kept = named.where(worded).join(first, [key, hashed], "left_semi").withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return kept.select(*columns).unionAll(docs.where(~worded).select(*columns))


def classified(docs: DataFrame, config: Forest) -> DataFrame:
    """`near_duplicates` with text_hash, the xxhash64 of the text, of rows with words."""
    spark = docs.sparkSession
    small_batches(spark)
    plain = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sketched = written(plain.where("doc_id is not null").mapInArrow(lambda it: sketch(it, config), SKETCH), "forest-sketch")
    some = sketched.where("shingles > 0")
    folded = some.groupBy("node", "check").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "text_hash")).alias("at"))
    folded = cut(folded)
    seeking = some.where("depth > 0").join(folded.select("node", "check", F.col("at.doc_id").alias("doc_id"), F.col("at.text_hash").alias("text_hash")), ["node", "check", "doc_id", "text_hash"], "left_semi")
    nodes = written(seeking.dropDuplicates(["node", "check"]).select("node", "depth", "keys", "signature"), "forest-nodes")
    found = candidate_links(nodes, config)
    linked = components(found).withColumnRenamed("node", "id")
    degrees = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    members = linked.join(degrees, "id").join(folded.select(F.col("node").alias("id"), "copies", "at.*"), "id")
    # one row of each text: the repeats of a row lie together after the join
    texts = members.join(plain, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash", "id"])
    sets = written(texts.select("root", "id", "copies", "text").mapInArrow(lambda it: shingle_sets(it, config), SETS), "forest-sets")
    weight = F.sum(F.greatest("shingles", F.lit(400)).cast("bigint"))
    sizes = cut(sets.groupBy("root").agg(weight.alias("weight")).join(linked.join(degrees, "id").groupBy("root").agg(F.max_by("id", F.struct("degree", "id")).alias("pivot")), "root"))
    exact, balls = exact_links(sets, sizes, config)
    classes = components(exact.where("b is not null").select("a", "b").unionByName(balls.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b"))))
    links = exact.where("b is null").select("a", "links").unionByName(balls.select(F.col("id").alias("a"), "links")).groupBy("a").agg(F.sum("links").alias("links"))
    known = folded.join(classes.withColumnRenamed("node", "node"), "node", "left").join(links.withColumnRenamed("a", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = known.groupBy("root").agg(F.min("id").alias("class_id"))
    named = known.join(least, "root").select("node", "check", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))
    many = some.select("doc_id", "text_hash", "node", "check").join(named, ["node", "check"]).select("doc_id", "class_id", "n_links", "n_copies", "text_hash")
    alone = sketched.where("shingles = 0").select("doc_id").unionByName(plain.where("doc_id is null").select("doc_id"))
    return many.unionByName(alone.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(1).cast("bigint").alias("n_copies"), F.lit(None).cast("bigint").alias("text_hash")))


def exact_links(sets: DataFrame, sizes: DataFrame, config: Forest) -> tuple[DataFrame, DataFrame]:
    """Links of components (root, weight, pivot) of sets, as `verified` gives them, and the members of balls round a pivot
    with their links to each other: id, pivot, links."""
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = sets.join(sizes.where(F.col("weight") <= config.budget).select("root"), "root").select("root", F.lit(0).alias("one"), F.lit(0).alias("two"), F.lit(0).alias("own"), "id", "copies", "hashes")
    large = sizes.where(F.col("weight") > config.budget).withColumn("blocks", F.ceil(F.col("weight") / F.lit(config.budget)).cast("int"))
    # a pivot's set meets its component block by block, so that none is one task
    pivots = sets.join(large.select(F.col("pivot").alias("id"), "blocks"), "id").select("root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"), F.col("hashes").alias("pivot_hashes"))
    own = sets.join(large.select("root", "blocks"), "root").withColumn("own", spread("id", F.col("blocks")))
    measured = own.join(pivots, ["root", "own"]).select("root", "id", "copies", "shingles", "hashes", "pivot_hashes").mapInArrow(lambda it: to_pivot(it, config), SETS + ", ball boolean")
    measured = cut(measured)
    weight = F.greatest("shingles", F.lit(400)).cast("bigint")
    shares = measured.groupBy("root").agg(*[F.ceil(F.coalesce(F.sum(F.when(F.col("ball") == b, weight)), F.lit(0)) / F.lit(config.budget)).cast("int").alias(n) for b, n in ((True, "inside"), (False, "outside"))], F.sum(F.when(F.col("ball"), F.col("copies"))).alias("all"))
    named = measured.join(shares, "root")
    inside, outside = F.col("inside"), F.col("outside")
    block = F.when(F.col("ball"), spread("id", F.greatest(inside, F.lit(1)))).otherwise(inside + spread("id", F.greatest(outside, F.lit(1))))
    # those in the ball meet blocks of others only
    others = F.when(F.col("ball"), F.when(outside > 0, F.sequence(inside, inside + outside - 1))).otherwise(F.sequence(F.lit(0), inside + outside - 1))
    pairs = paired(named, block, others).select("root", "one", "two", "own", "id", "copies", "hashes")
    at = ["root", "one", "two"]
    both = small.unionByName(pairs).repartition(parts, *at).sortWithinPartitions(*at)
    exact = cut(both.mapInArrow(lambda it: verified(it, config), "a bigint, b bigint, links bigint"))
    balls = named.where("ball").join(large.select("root", "pivot"), "root").select("id", "pivot", (F.col("all") - F.col("copies")).alias("links"))
    return exact, cut(balls)
