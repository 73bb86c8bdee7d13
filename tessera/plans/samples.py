"""BAM files made from the events: each type is a sample, each event a read."""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.bam import BASES
from ..sources.files import create_binary
from .base import scratch, table

#: Reference sequences (cluster.number) and their length; CIGARs with their bases and gaps.
REFS, LENGTH = [f"k{c}.{i}" for c in range(8) for i in range(1, 6)], 5000
CIGARS = (((10, 0),), ((5, 0), (2, 1), (5, 0)), ((4, 4), (20, 0), (3, 2), (10, 0)), ((30, 0), (100, 3), (20, 0)), ((8, 7), (2, 8), (10, 0), (1, 1)))
FLAGS = (0, 16, 4, 256, 1024, 2048)
#: Inflated bytes of a block.
BLOCK = 60_000
#: The same reads in SQL: read length, ungapped bases and gaps by kind.
READS_SQL = """reads AS (SELECT event_type AS sample, event_id, event_id % 5 AS kind, ([0, 16, 4, 256, 1024, 2048])[event_id % 6 + 1] AS flag, (event_id % 60)::INT AS mapq, (event_id % 9 // 2)::INT AS nm,
 CASE WHEN event_id % 11 = 0 THEN -1 ELSE user_id % 40 END AS ref, (event_id * 31 % 4800)::BIGINT AS pos FROM events),
kinds AS (SELECT * FROM (VALUES (0, 10, 10, 0), (1, 12, 10, 2), (2, 34, 30, 3), (3, 50, 50, 0), (4, 21, 20, 1)) k(kind, bases, ungapped, gaps)),
placed AS (SELECT *, 'k' || (ref // 5) || '.' || (ref % 5 + 1) AS name, 'k' || (ref // 5) AS cluster, (flag & 1796) = 0 AND mapq >= 5 AS good, ungapped - greatest(0, nm - gaps) >= (ungapped + gaps) * 0.9::DOUBLE AS alike FROM reads JOIN kinds USING (kind)),
stretches AS (SELECT * FROM (VALUES (0, 0, 10, 0), (1, 0, 5, 0), (1, 5, 10, 7), (2, 0, 20, 4), (2, 23, 33, 24), (3, 0, 30, 0), (3, 130, 150, 30), (4, 0, 8, 0), (4, 8, 10, 8), (4, 10, 20, 10)) s(kind, a, b, r)),
blocks AS (SELECT p.*, pos + a AS s, pos + b AS e, r FROM placed p JOIN stretches USING (kind))"""


def _record(ref: int, pos: int, flag: int, mapq: int, kind: int, nm: int, shift: int) -> bytes:
    cigar = CIGARS[kind]
    n = sum(k for k, op in cigar if op not in (2, 3))
    codes = [BASES.index("ACGT"[(shift + i) % 4]) for i in range(n)] + [0] * (n % 2)
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
    body = struct.pack("<iiBBHHHiiii", ref, pos, 2, mapq, 0, len(cigar), flag, n, -1, -1, 0) + b"r\0"
    body += struct.pack(f"<{len(cigar)}I", *(k << 4 | op for k, op in cigar)) + packed + b"\xff" * n + b"NMC" + bytes([nm])
    return struct.pack("<i", len(body)) + body


def _block(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def write_bams(spark: SparkSession, sf_dir: str) -> list[str]:
    """Paths of the samples' files, sorted by reference and position: one writer a file, to
    which Spark brings the sorted reads in batches."""
    folder = scratch(spark, "bam")
    e = table(spark, sf_dir, "events")
    ref = F.when(F.col("event_id") % 11 == 0, -1).otherwise(F.col("user_id") % len(REFS)).cast("int")
    rows = e.select("event_type", ref.alias("ref"), (F.col("event_id") * 31 % 4800).cast("int").alias("pos"), "event_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = b"BAM\1" + struct.pack("<ii", 0, len(REFS)) + b"".join(struct.pack("<i", len(r) + 1) + r.encode() + b"\0" + struct.pack("<i", LENGTH) for r in REFS)
        lines = (x for batch in batches for at in range(0, len(batch), 4096) for x in zip(*(c.to_pylist() for c in batch.slice(at, 4096).columns), strict=True))
        for name, own in itertools.groupby(lines, key=lambda x: x[0]):
            path, held = f"{folder}/{name}.bam", bytearray(head)
            with create_binary(path) as f:
                for _, r, p, i in own:
                    held += _record(r, p if r >= 0 else -1, FLAGS[i % 6], i % 60, i % 5, i % 9 // 2, i)
                    if len(held) >= BLOCK:
                        f.write(_block(bytes(held)))
                        held = bytearray()
                f.write(_block(bytes(held)) + _block(b"") if held else _block(b""))
            yield pa.RecordBatch.from_pydict({"path": [path]})

    # unplaced reads come last
    near = rows.repartition("event_type").sortWithinPartitions("event_type", F.col("ref") < 0, "ref", "pos", "event_id")
    return sorted(r["path"] for r in near.mapInArrow(write, "path string").collect())


def reads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index, its checked part, and the placed reads with their sample."""
    from ..commands import index_bam, with_samples
    from ..sources import bam

    whole = index_bam(spark, write_bams(spark, sf_dir), scratch(spark, "bam-index"))
    ranges = bam.checked_index(whole)
    return whole, ranges, with_samples(bam.read_bam(ranges))
