"""Reading tables and writing them in the formats that Spark has built in; a data source in Python."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Formats that are read and written with the schema given, never inferred, and their options. text: one string column.
FORMATS = {"parquet": {}, "orc": {}, "json": {}, "csv": {"header": "true"}, "xml": {"rowTag": "row"}, "text": {}}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; columns and filters of later steps reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: Iterable[str]) -> None:
    """Views for SQL texts. A query is bound to its tables when spark.sql() returns, so views may be replaced later."""
    for n in names:
        load(spark, sf_dir, n).createOrReplaceTempView(n)


def save(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Write df; partition_by makes folders that later filters prune."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format: {kind}")
    writer = df.write.format(kind).mode(mode).options(**FORMATS[kind])
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def read(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet") -> DataFrame:
    if kind not in FORMATS:
        raise ValueError(f"unknown format: {kind}")
    return spark.read.format(kind).schema(schema).options(**FORMATS[kind]).load(path)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, else in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/strataflow-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder and what is in it, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def round_trip(df: DataFrame, kind: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df, written to the shared folder and read again."""
    path = shared_folder(df.sparkSession)
    save(df, path, kind, partition_by)
    return read(df.sparkSession, path, df.schema, kind)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length and content of the files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


class Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class Squares(DataSource):
    """The numbers under `end` and their squares, in `parts` partitions: a source written in Python."""

    @classmethod
    def name(cls) -> str:
        return "squares"

    def schema(self) -> str:
        return "n bigint, square bigint"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SquaresReader(int(self.options.get("end", 100)), int(self.options.get("parts", 4)))


class SquaresReader(DataSourceReader):
    def __init__(self, end: int, parts: int):
        self._end, self._parts = end, parts

    def partitions(self) -> list[InputPartition]:
        return [Range(k * self._end // self._parts, (k + 1) * self._end // self._parts) for k in range(self._parts)]

    def read(self, partition: Range) -> Iterator[tuple[int, int]]:
        for n in range(partition.start, partition.end):
            yield n, n * n
