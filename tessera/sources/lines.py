"""The `sniffed_lines` data source: lines of text files, gzip or plain by content.

Spark tells compression by extension only; here a file is its own input partition
and is streamed, so neither its name nor its size matters.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .files import open_sniffed

BATCH = 8192


class LinesReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, held, first = partition.value, [], 0
        with open_sniffed(path) as f:
            for line in f:
                held.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
                if len(held) == BATCH:
                    yield self.batch(path, first, held)
                    first, held = first + len(held), []
        if held:
            yield self.batch(path, first, held)

    @staticmethod
    def batch(path: str, first: int, held: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(held)), pa.array(range(first, first + len(held)), pa.int64()), pa.array(held)], ["file", "line_no", "value"])


class SniffedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sniffed_lines"

    def schema(self) -> str:
        return "file string, line_no long, value string"

    def reader(self, schema: StructType) -> LinesReader:
        return LinesReader(self.options["path"].split("\n"))


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line_no, value) of each line; line_no from 0."""
    spark.dataSource.register(SniffedLines)
    return spark.read.format("sniffed_lines").option("path", paths if isinstance(paths, str) else "\n".join(paths)).load()
