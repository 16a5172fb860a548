"""Connected components of a graph of links, on DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import cut, small_batches

#: A node with over 1/HUBS of all links' ends, and over HUB_LINKS, is a hub. No graph has more than HUBS of them.
HUBS, HUB_LINKS = 4096, 64

#: Links that one task joins at once: arrays of some 50 MB. More are joined by all tasks, in rounds.
FEW = 500_000


def with_least(links: DataFrame, least: DataFrame, ends: int) -> DataFrame:
    """u, v, m: links (u, v), at most `ends` of them, with the m of u; least (u, m, n): n is the number of u's links.

    What hangs on a hub meets its m by broadcast, where it lies; only the other links are dealt by u.
    """
    hub = F.col("n") > max(HUB_LINKS, ends // HUBS)
    marked = links.join(F.broadcast(least.where(hub).select("u", F.col("m").alias("hub_m"))), "u", "left")
    plain = marked.where("hub_m is null").join(least.where(~hub), "u").select("u", "v", "m")
    return plain.unionByName(marked.where("hub_m is not null").select("u", "v", F.col("hub_m").alias("m")))


def least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (u, v) and for each the smallest node of its component. In each pass every set of nodes that has a
    link out of it is joined to another, so that passes grow with the logarithm of the nodes."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while (apart := root[a] != root[b]).any():
        one, two = root[a[apart]], root[b[apart]]
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while ((up := root[root]) != root).any():
            root = up
    return nodes, nodes[root]


def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From all links (u, v): node and root of each node."""
    if held := [b for b in batches if b.num_rows]:
        links = pa.Table.from_batches(held)
        nodes, roots = least_nodes(*[links.column(i).to_numpy().astype(np.int64) for i in (0, 1)])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])


def components(edges: DataFrame, rounds: int = 60, few: int = FEW) -> DataFrame:
    """node, root: for each node of edges (a, b: bigint) the smallest node of its component.

    Null ends take no part; repeated edges and edges from a node to itself change nothing, but a node of such an edge alone
    is in no component; no edges: no rows; other columns are not read.

    Up to `few` links are joined in one task, where a plan for each round would cost far more than the links. More of them:
    alternates the large-star and small-star steps (Kiveris and others, 2014) until nothing changes; each round is
    checkpointed, so a lost executor costs one round. Rounds grow with the logarithm of the longest path.
    """
    known = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if known.count() <= few:
        small_batches(edges.sparkSession)
        return cut(known.coalesce(1).mapInArrow(joined, "node bigint, root bigint"))
    before = None
    for _ in range(rounds):
        state = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now := (state["n"], state["h"])) == before or not now[0]:
            break
        before = now
        both = known.unionByName(known.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = with_least(both, least, 2 * now[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = with_least(large, lowest, 2 * now[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        known = cut(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    else:
        raise RuntimeError(f"components not found in {rounds} rounds")
    roots = known.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return known.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the same of n members as all of left-right do: fewer than n."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
            if len(out) == n - 1:
                break
    return out
