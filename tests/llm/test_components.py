"""Components of graphs of few links, joined in one task, and in rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.llm import components


def by_hand(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("few", [0, components.FEW])
def test_components_of_random_graphs(spark, few):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(-900, 900, (800, 2))] + [(-(2**63), 2**63 - 1), (5000 - 1, 5000)] + [(5000 + i, 5001 + i) for i in range(40)]
    rows = spark.createDataFrame([*links, *links[:9], (None, 3), (4, None), (7777, 7777)], "a bigint, b bigint")
    found = components.components(rows, few=few).collect()
    assert len(found) == len({r["node"] for r in found})
    assert {r["node"]: r["root"] for r in found} == by_hand([x for x in links if x[0] != x[1]])
    none = components.components(rows.where("a is null"), few=few)
    assert none.count() == 0 and none.columns == ["node", "root"]


def test_few_links_take_few_jobs(spark):
    """A path of 300 nodes took a job and five shuffles a round."""
    path = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    spark.sparkContext.setJobGroup("components", "components")
    try:
        assert components.components(path).where("root = 0").count() == 301
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components")) <= 8
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
