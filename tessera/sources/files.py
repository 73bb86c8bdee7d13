"""Opening files by path or URI, plain or gzip by their first two bytes."""

from __future__ import annotations

import gzip
import io
import os
import re
from typing import BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GZIP_MAGIC = b"\x1f\x8b"


def open_binary(path: str) -> BinaryIO:
    """A seekable stream; URIs other than file: go through pyarrow's filesystems."""
    if re.match(r"(?!file:)[a-z][a-z0-9+.-]*://", path):
        from pyarrow.fs import FileSystem

        fs, inner = FileSystem.from_uri(path)
        return io.BufferedReader(fs.open_input_file(inner))
    return open(re.sub(r"^file:/*", "/", path), "rb")


def create_binary(path: str) -> BinaryIO:
    """A new file to write, by path or URI; its folder must be there, or be made here."""
    if re.match(r"(?!file:)[a-z][a-z0-9+.-]*://", path):
        from pyarrow.fs import FileSystem

        fs, inner = FileSystem.from_uri(path)
        fs.create_dir(inner.rsplit("/", 1)[0])
        return fs.open_output_stream(inner)
    plain = re.sub(r"^file:/*", "/", path)
    os.makedirs(os.path.dirname(plain), exist_ok=True)
    return open(plain, "wb")


def open_sniffed(path: str) -> BinaryIO:
    """As open_binary, inflated if the content is gzip, whatever the name."""
    f = open_binary(path)
    magic = f.read(2)
    f.seek(0)
    return gzip.GzipFile(fileobj=f) if magic == GZIP_MAGIC else f


def find_files(spark: SparkSession, path: str | list[str], suffix: str = "") -> DataFrame:
    """(path): files whose name ends with `suffix`, in the paths themselves or one
    level below, by name. Only the listing is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path).select("path")
    return found.orderBy("path")


def stem(path: Column, suffix: str = "") -> Column:
    """The file name without folders and without `suffix`: a sample's or cluster's id."""
    name = F.regexp_extract(path, r"([^/]+)/*$", 1)
    return F.regexp_replace(name, re.escape(suffix) + "$", "") if suffix else name


def part_files(spark: SparkSession, folder: str) -> list[str]:
    """The files of a folder that Spark wrote, by name."""
    return [r["path"] for r in find_files(spark, folder).collect()]
