"""BAM: an index table of byte ranges by reference, and records read from it.

Building the index inflates each file once, a task a file; the table can be kept as
Parquet. Reading deals the ranges out, so one large file is read by many tasks and
references that are not wanted are never touched.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import open_binary

INDEX = "file string, ref_id int, name string, length long, file_offset long, data_offset long, data_size long, header_md5 string"
RECORD = "file string, ref_id int, name string, length long, pos long, mapq int, flag int, cigar array<struct<op:int,len:int>>, seq string, nm int"
BASES = "=ACMGRSVTWYHKDBN"
#: Reads in a batch; inflated bytes that are taken apart at a time.
BATCH, CHUNK = 8192, 1 << 22
#: Optional-tag types of fixed size, by struct code.
_FIXED = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def blocks(f: BinaryIO, offset: int = 0) -> Iterator[tuple[int, bytes]]:
    """(offset in the file, inflated bytes) of each BGZF block from `offset` on."""
    f.seek(offset)
    while True:
        head = f.read(18)
        if len(head) < 18:
            return
        extra = head[12:] + f.read(struct.unpack_from("<H", head, 10)[0] - 6)
        size, at = 0, 0
        while at + 4 <= len(extra):
            tag, n = extra[at : at + 2], struct.unpack_from("<H", extra, at + 2)[0]
            if tag == b"BC":
                size = struct.unpack_from("<H", extra, at + 4)[0] + 1
            at += 4 + n
        if not size:
            raise ValueError(f"no BGZF block at {offset}")
        body = f.read(size - 12 - len(extra))
        yield offset, zlib.decompress(body[:-8], -15)
        offset += size


class Stream:
    """Inflated bytes with the position of each in the file."""

    def __init__(self, f: BinaryIO, offset: int = 0, skip: int = 0):
        self.source, self.block, self.start, self.at = blocks(f, offset), b"", offset, 0
        self.fill()
        self.at = skip

    def fill(self) -> bool:
        for start, data in self.source:
            if data:
                self.start, self.block, self.at = start, data, 0
                return True
        return False

    def read(self, n: int) -> bytes:
        parts, need = [], n
        while need:
            if self.at >= len(self.block) and not self.fill():
                break
            part = self.block[self.at : self.at + need]
            self.at += len(part)
            need -= len(part)
            parts.append(part)
        return b"".join(parts)

    def where(self) -> tuple[int, int]:
        if self.at >= len(self.block):
            self.fill()
        return self.start, self.at


def read_header(s: Stream) -> tuple[list[str], list[int], str]:
    if s.read(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    s.read(struct.unpack("<i", s.read(4))[0])
    names, lengths, digest = [], [], hashlib.md5()
    for _ in range(struct.unpack("<i", s.read(4))[0]):
        name = s.read(struct.unpack("<i", s.read(4))[0])[:-1]
        raw = s.read(4)
        digest.update(name + raw)
        names.append(name.decode())
        lengths.append(struct.unpack("<i", raw)[0])
    return names, lengths, digest.hexdigest()


def scan(path: str) -> list[tuple]:
    """The index rows of a file sorted by reference; unplaced reads are ref_id -1."""
    with open_binary(path) as f:
        s = Stream(f)
        names, lengths, digest = read_header(s)
        ranges: dict[int, list[int]] = {}
        while True:
            at = s.where()
            raw = s.read(4)
            if len(raw) < 4:
                break
            size = struct.unpack("<i", raw)[0]
            ref = struct.unpack_from("<i", s.read(size))[0]
            ranges.setdefault(ref, [*at, 0])[2] += size + 4
    refs = [(i, n, m) for i, (n, m) in enumerate(zip(names, lengths, strict=True))] + [(-1, "*", 0)]
    return [(path, i, n, m, *ranges.get(i, (0, 0, 0)), digest) for i, n, m in refs]


def build_index(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The index of each file, built by a task a file."""

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in INDEX.split(", ")]
        for x in frames:
            for path in x["file"]:
                yield pd.DataFrame(scan(path), columns=names)

    return spark.createDataFrame([(p,) for p in paths], "file string").repartition(max(1, len(paths)), "file").mapInPandas(kernel, INDEX)


def checked_index(index: DataFrame) -> DataFrame:
    """The index without unplaced reads; fails if files differ in their references."""
    heads = index.agg(F.count_distinct("header_md5").alias("heads"))
    ok = F.when(F.col("heads") > 1, F.raise_error(F.lit("files have different headers"))).otherwise(F.lit(True))
    return index.where("ref_id >= 0").crossJoin(F.broadcast(heads.select(ok.alias("same")))).where("same").drop("same")


def tags(data: bytes, at: int) -> Iterator[tuple[str, object]]:
    """Optional fields from `at` on."""
    while at + 3 <= len(data):
        tag, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in _FIXED:
            code = "<" + _FIXED[kind]
            yield tag, struct.unpack_from(code, data, at)[0]
            at += struct.calcsize(code)
        elif kind in "ZH":
            end = data.index(b"\0", at)
            yield tag, data[at:end].decode()
            at = end + 1
        elif kind == "B":
            code, n = _FIXED[chr(data[at])], struct.unpack_from("<i", data, at + 1)[0]
            yield tag, list(struct.unpack_from(f"<{n}{code}", data, at + 5))
            at += 5 + n * struct.calcsize(code)
        else:
            raise ValueError(f"unknown tag type {kind}")


#: The fixed part of a record, its size before it.
_HEAD = np.dtype([("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("ops", "<u2"), ("flag", "<u2"), ("bases", "<i4"), ("rest", "V12")])
#: The two letters of each byte of packed bases.
_PAIRS = np.frombuffer("".join(BASES[b >> 4] + BASES[b & 15] for b in range(256)).encode(), "S2")
#: Columns of a read for counting, without its letters.
PLACED = ("pos", "mapq", "flag", "cigar", "nm")


def _nested(rows: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Indices of `n` items from `first` on, for all rows in turn."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def columns_of(data: bytes, starts: list[int], wanted: tuple[str, ...]) -> dict[str, pa.Array]:
    """Arrow columns of the records that begin at `starts`; only what is wanted is decoded."""
    raw = np.frombuffer(data, np.uint8)
    at = np.array(starts, np.int64)
    head = raw[at[:, None] + np.arange(36)].copy().view(_HEAD).ravel() if len(at) else np.zeros(0, _HEAD)
    out = {"pos": pa.array(head["pos"].astype(np.int64)), "mapq": pa.array(head["mapq"].astype(np.int32)), "flag": pa.array(head["flag"].astype(np.int32))}
    ops, bases = head["ops"].astype(np.int64), head["bases"].astype(np.int64)
    cigar = at + 36 + head["name"]
    if "cigar" in wanted:
        words = raw[_nested(at, cigar, 4 * ops)].copy().view("<u4")
        items = pa.StructArray.from_arrays([pa.array((words & 15).astype(np.int32)), pa.array((words >> 4).astype(np.int32))], ["op", "len"])
        out["cigar"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(ops)).astype(np.int32)), items)
    letters = cigar + 4 * ops
    packed = (bases + 1) // 2
    if "seq" in wanted:
        text = _PAIRS[raw[_nested(at, letters, packed)]].tobytes()
        ends = 2 * np.cumsum(packed)
        begins = ends - 2 * packed
        out["seq"] = pa.array([text[a : a + n] for a, n in zip(begins.tolist(), bases.tolist(), strict=True)], pa.binary()).cast(pa.string())
    if "nm" in wanted:
        tail, stop = (letters + packed + bases).tolist(), (at + 4 + head["size"]).tolist()
        out["nm"] = pa.array([next((int(v) for t, v in tags(data[a:b], 0) if t == "NM"), 0) for a, b in zip(tail, stop, strict=True)], pa.int32())
    return out


def read_bam(index: DataFrame, min_length: int = 0, tasks: int | None = None, columns: tuple[str, ...] = ("pos", "mapq", "flag", "cigar", "seq", "nm")) -> DataFrame:
    """Records of the index's ranges: references of at least `min_length` bases,
    ranges without bytes skipped. `columns`: what to decode of a record; letters cost most."""
    side = ["file", "ref_id", "name", "length"]
    kinds = dict(c.split(" ", 1) for c in re.split(r", ", RECORD))
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*side, *columns])
    order = [c for c in columns]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for r in x.to_pylist():
                with open_binary(r["file"]) as f:
                    s, left, rest = Stream(f, int(r["file_offset"]), int(r["data_offset"])), int(r["data_size"]), b""
                    while left > 0:
                        part = s.read(min(left, CHUNK))
                        if not part:
                            raise ValueError(f"{r['file']} ends within the records of {r['name']}")
                        left -= len(part)
                        data, at, starts = rest + part, 0, []
                        while at + 4 <= len(data):
                            size = struct.unpack_from("<i", data, at)[0] + 4
                            if at + size > len(data):
                                break
                            starts.append(at)
                            at += size
                        rest = data[at:]
                        for cut in range(0, len(starts), BATCH):
                            own = starts[cut : cut + BATCH]
                            got = columns_of(data, own, columns)
                            same = [pa.array([r[c]] * len(own), kind) for c, kind in zip(side, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)]
                            yield pa.RecordBatch.from_arrays([*same, *(got[c] for c in order)], [*side, *order])

    wanted = index.where((F.col("data_size") > 0) & (F.col("length") >= min_length) & (F.col("ref_id") >= 0))
    n = tasks or index.sparkSession.sparkContext.defaultParallelism
    return wanted.repartition(n, "file", "ref_id").mapInArrow(kernel, schema)
