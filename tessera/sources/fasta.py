"""FASTA: records (id, seq), from plain or gzip files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .files import open_sniffed

#: Bytes of the records in a batch, and what one takes besides its letters.
BATCH_BYTES, RECORD_BYTES = 1 << 22, 256


def records(stream) -> Iterator[tuple[str, str]]:
    """The id ends at the first blank; body lines are joined; a header without a
    body line is no record."""
    name, body = None, []
    for raw in stream:
        line = raw.rstrip(b"\r\n")
        if line.startswith(b">"):
            if name is not None and body:
                yield name, b"".join(body).decode()
            name, body = line[1:].split(b" ", 1)[0].decode(), []
        elif name is not None:
            body.append(line)
    if name is not None and body:
        yield name, b"".join(body).decode()


def strings(values: Sequence[str]) -> pa.Array:
    """As pa.array, whose builder would double its space over and over and keep it."""
    raw = [v.encode() for v in values]
    ends = np.cumsum([0, *map(len, raw)])
    if ends[-1] >= 1 << 31:
        return pa.array(values, pa.string())
    return pa.StringArray.from_buffers(len(raw), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(b"".join(raw)))


class FastaReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        held, size, at = [], 0, 0
        with open_sniffed(partition.value) as f:
            for name, seq in records(f):
                held.append((at, name, seq))
                at, size = at + 1, size + len(name) + len(seq) + RECORD_BYTES
                if size >= BATCH_BYTES:
                    batch, held, size = self.batch(partition.value, held), [], 0
                    yield batch
                    del batch
        if held:
            yield self.batch(partition.value, held)

    @staticmethod
    def batch(path: str, held: list[tuple[int, str, str]]) -> pa.RecordBatch:
        at, names, seqs = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([strings([path] * len(held)), pa.array(at, pa.int64()), strings(names), strings(seqs)], ["file", "ordinal", "seq_id", "seq"])


class Fasta(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "file string, ordinal long, seq_id string, seq string"

    def reader(self, schema: StructType) -> FastaReader:
        return FastaReader(self.options["path"].split("\n"))


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, ordinal, seq_id, seq); a file is one partition, gzip or plain."""
    spark.dataSource.register(Fasta)
    return spark.read.format("fasta").option("path", paths if isinstance(paths, str) else "\n".join(paths)).load()


def read_plain_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq_id, seq) of plain files, which Spark splits at record marks."""
    text = spark.read.option("lineSep", "\n>").text(path).select(F.input_file_name().alias("file"), F.regexp_replace("value", "^>", "").alias("value"))
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.expr("substring(value, length(regexp_extract(value, '^([^\\\\r\\\\n]*)', 1)) + 1)"), r"[\r\n]", "")
    return text.where(F.col("value").contains("\n")).select("file", F.split(head, " ")[0].alias("seq_id"), body.alias("seq")).where("seq_id <> '' or seq <> ''")
