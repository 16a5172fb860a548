"""Approximate nearest neighbours: inverted file of coarse centroids, product-quantised residuals, exact reranking."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataflow.llm.common import small_batches, uniform, written


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds from distinct rows; a centroid that loses all rows moves to the row farthest from its own."""
    pool = np.unique(x, axis=0)
    centroids = pool[rng.permutation(len(pool))[: min(k, len(pool))]].copy()
    for _ in range(rounds):
        gap = (centroids**2).sum(axis=1)[None, :] - 2 * x @ centroids.T
        own = gap.argmin(axis=1)
        counts = np.bincount(own, minlength=len(centroids))
        order = np.argsort(own, kind="stable")
        filled = np.flatnonzero(counts)
        centroids[filled] = np.add.reduceat(x[order], np.concatenate(([0], np.cumsum(counts[filled])[:-1])), axis=0) / counts[filled, None]
        for c in np.flatnonzero(counts == 0):
            far = int(gap[np.arange(len(x)), own].argmax())
            centroids[c] = x[far]
            gap[far, own[far]] = -np.inf
    return centroids


@dataclass
class Quantizer:
    """Coarse centroids (lists x dims), residual codebooks (parts x codes x dims of a part), and how many lists are probed."""

    coarse: np.ndarray
    books: np.ndarray
    probes: int

    @property
    def dims(self) -> int:
        return self.coarse.shape[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        return ((self.coarse**2).sum(axis=1)[None, :] - 2 * x @ self.coarse.T).argmin(axis=1)

    def codes(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        parts, _, width = self.books.shape
        rest = (x - self.coarse[cells]).reshape(len(x), parts, width)
        return np.stack([((b**2).sum(axis=1)[None, :] - 2 * rest[:, p] @ b.T).argmin(axis=1) for p, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of each query's parts with all codes: queries x parts x codes."""
        parts, _, width = self.books.shape
        return np.einsum("qpw,pcw->qpc", q.reshape(len(q), parts, width), self.books)


def vectors_of(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is neither null nor zero nor has a null or non-finite component: vec_id, v (array<double>)."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def fit(rows: DataFrame, total: int, lists: int | None = None, parts: int = 16, codes: int = 256, k: int = 20, recall: float = 0.95, most: int = 20_000, seed: str = "ivf") -> Quantizer | None:
    """Fit on about `most` rows at most, those with the smallest hashes of vec_id. Dimensions: those of most sampled rows.

    lists: a quarter of the root of the number of rows, 16 to 4096, unless given. The number of probed lists is the
    least with which 256 sampled queries find `recall` of their exact k neighbours in the sample.
    """
    sample = rows.where(uniform(seed, F.col("vec_id")) < min(1.0, most / max(1, total))).toArrow().sort_by("vec_id")
    if not sample.num_rows:
        return None
    sizes = np.array([len(v) for v in sample.column("v").to_pylist()])
    dims = int(np.bincount(sizes).argmax())
    x = np.array([v for v, n in zip(sample.column("v").to_pylist(), sizes.tolist(), strict=True) if n == dims])
    rng = np.random.default_rng(7)
    coarse = kmeans(x, lists or int(min(4096, max(16, total**0.5 / 4))), 12, rng)
    while dims % parts:
        parts -= 1
    model = Quantizer(coarse, np.zeros((parts, 1, dims // parts)), len(coarse))
    own = model.cells(x)
    rest = (x - coarse[own]).reshape(len(x), parts, -1)
    books = [kmeans(rest[:, p], codes, 8, rng) for p in range(parts)]
    width = max(map(len, books))
    model.books = np.stack([np.vstack((b, np.repeat(b[:1], width - len(b), axis=0))) for b in books])
    asked = rng.permutation(len(x))[:256]
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -np.inf
    best = np.argpartition(-near, min(k, len(x) - 1) - 1, axis=1)[:, :k] if len(x) > 1 else np.zeros((len(asked), 1), int)
    rank = np.argsort(np.argsort(-(x[asked] @ coarse.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(rank, own[best], axis=1).ravel())
    model.probes = int(min(len(coarse), needed[min(len(needed) - 1, int(recall * len(needed)))] + 1))
    return model


def search_block(index: pa.Table, asked: pa.Table, model: Quantizer, k: int, refine: int) -> pa.Table:
    """The k nearest of a block of one list for each query: by exact products of the `refine` rows with the largest table
    sums, and of all others whose sum may be as large as the k-th's but for the codes' error."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if index.num_rows and asked.num_rows:
        ids = index.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        codes = np.frombuffer(b"".join(index.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
        full = np.frombuffer(b"".join(index.column("vector").to_pylist()), np.float64).reshape(len(ids), -1)[order]
        qid = asked.column("query_id").to_numpy()
        q = np.frombuffer(b"".join(asked.column("vector").to_pylist()), np.float64).reshape(len(qid), -1)
        parts, _, width = model.books.shape
        rest = full - model.coarse[index.column("cell")[0].as_py()] - np.stack([model.books[p][codes[:, p]] for p in range(parts)], axis=1).reshape(len(ids), -1)
        unsure = 4 * np.sqrt((rest**2).mean())  # of a product with a vector of length 1, four standard errors
        for s in range(0, len(qid), 32):
            part, own = q[s : s + 32], qid[s : s + 32]
            tables = model.tables(part).astype(np.float32)
            near = tables[:, 0, codes[:, 0]]  # the list's own product is the same for all its rows
            for p in range(1, codes.shape[1]):
                near += tables[:, p, codes[:, p]]
            near[own[:, None] == ids[None, :]] = -np.inf
            few = min(k, len(ids))
            floor = np.partition(near, len(ids) - few, axis=1)[:, len(ids) - few] - unsure * np.sqrt((part**2).sum(axis=1))
            for i in range(len(own)):
                among = np.flatnonzero(near[i] >= floor[i])
                if len(among) < min(refine, len(ids)):
                    among = np.argpartition(near[i], len(ids) - min(refine, len(ids)))[-min(refine, len(ids)) :]
                among = among[np.isfinite(near[i, among])]
                exact = (full[among] * part[i]).sum(axis=1)
                top = np.lexsort((ids[among], -exact))[:k]
                out.append((np.full(len(top), own[i]), ids[among[top]], exact[top]))
    a, b, c = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, refine: int = 200, block: int = 4096, **how) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose vec_id is divisible by `every` the k other rows with the
    largest inner products that the index finds, ties to the smaller vec_id; score in double precision on the vectors.

    All rows are indexed: cell and code of the residual. A query meets the lists with the largest centroid products. A
    list's rows and its queries are dealt over blocks of about `block` by hashes of the ids, so that a list that holds a
    third of all rows is many tasks; each block returns k rows a query at most, already exact, and those are merged.

    Null, zero or non-finite vectors, vectors with null components or of other dimensions than most, null vec_id: take
    no part. Repeated rows: candidates each, except the query's own vec_id; a repeated vec_id asks once, with the vector that
    is first in order. Fewer candidates than k: all that are found.
    Empty table: no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = usable(vectors)
    total = rows.count()
    model = fit(rows, total, k=k, **how) if total else None
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if model is None:
        return empty
    shared = spark.sparkContext.broadcast(model)  # lists x dims and codes x dims numbers: lists are 4096 at most
    rows = rows.where(F.size("v") == model.dims)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            x = vectors_of(b.column(1))
            cells = m.cells(x) if len(x) else np.empty(0, np.int64)
            codes = m.codes(x, cells) if len(x) else x
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())], names=["cell", "vec_id", "code", "vector"])

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            x = vectors_of(b.column(1))
            if not len(x):
                continue
            best = np.argsort(-(x @ m.coarse.T), axis=1, kind="stable")[:, : m.probes]
            yield pa.RecordBatch.from_arrays([pa.array(best.ravel().astype(np.int32)), pa.array(np.repeat(b.column(0).to_numpy(), best.shape[1])), pa.array([v for v in (v.tobytes() for v in x) for _ in range(best.shape[1])], pa.binary())], names=["cell", "query_id", "vector"])

    index = written(rows.mapInArrow(encode, "cell int, vec_id bigint, code binary, vector binary"), "ivf-index")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).mapInArrow(probe, "cell int, query_id bigint, vector binary")
    asked = written(asked, "ivf-queries")
    # a row for each list: 4096 at most
    held = {r["cell"]: r["n"] for r in index.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not wanted:
        return empty
    deal = spark.createDataFrame([(c, -(-n // block), -(-wanted[c] // block)) for c, n in held.items() if c in wanted], "cell int, rows_in bigint, queries_in bigint")
    left = index.join(F.broadcast(deal), "cell").withColumns({"one": F.pmod(F.xxhash64("vec_id"), "rows_in"), "two": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("queries_in") - 1))})
    right = asked.join(F.broadcast(deal), "cell").withColumns({"two": F.pmod(F.xxhash64("query_id"), "queries_in"), "one": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows_in") - 1))})
    at = ["cell", "one", "two"]

    def block_search(a: pa.Table, b: pa.Table) -> pa.Table:
        return search_block(a, b, shared.value, k, refine)

    found = left.select(*at, "vec_id", "code", "vector").groupBy(*at).cogroup(right.select(*at, "query_id", "vector").groupBy(*at)).applyInArrow(block_search, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
