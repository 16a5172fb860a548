"""Rows of drained streams lie in files of the shared folder: they never pass the driver, whatever their number."""

from pathlib import Path

import pytest

from strataflow.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["stream_deduplicated", "stream_sessions", "stream_static_join"])
def test_rows_lie_in_the_shared_folder(spark, name):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    found = catalogue.QUERIES[name](spark, SF)
    files = [Path(f.removeprefix("file://")) for f in found.inputFiles()]
    assert files and all(shared in f.parents for f in files)
    assert not (files[0].parents[1] / "checkpoint").exists()
    assert found.count() > 0
