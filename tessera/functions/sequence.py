"""Column functions and profiles of nucleotide sequences."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a kernel takes at a time, if its rows are shorter.
CHUNK = 1 << 18


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def kmers(seq: Column, k: int) -> Column:
    """All frames of length k that are of A, C, G and T, in order. One pass of a
    lookahead: a substring per frame would count characters from the start each time."""
    return F.regexp_extract_all(seq, F.lit(f"(?=([ACGT]{{{k}}}))"), F.lit(1))


def canonical_kmers(seq: Column, k: int) -> Column:
    """The canonical form of each frame: frames of the sequence beside those of its
    complement, which is made once."""
    return F.zip_with(kmers(seq, k), F.reverse(kmers(reverse_complement(seq), k)), lambda a, b: F.least(a, b))


def chunks(text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds) of stretches of rows of about CHUNK bytes; null is empty."""
    text = text.cast(pa.large_binary())
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, "right")) - 1)
        yield at, data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def frames(data: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of all frames of k <= 31 letters of A, C, G and T inside a row, in order:
    the smaller of the frame and its reverse complement, two bits a letter, so that codes
    are ordered as the words are."""
    base = np.full(256, 4, np.uint8)
    base[list(b"ACGT")] = range(4)
    c = base[data]
    n = len(c) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    bad = np.concatenate(([0], np.cumsum(c == 4)))
    at = np.flatnonzero((bad[k:] == bad[:-k]) & (rows[:n] == rows[k - 1 :]))
    parts, width = [((c & 3).astype(np.uint64), (3 - (c & 3)).astype(np.uint64))], 1
    while 2 * width <= k:  # words of 1, 2, 4, ... letters at each place
        f, r = parts[-1]
        s = np.uint64(2 * width)
        parts.append(((f[:-width] << s) | f[width:], r[:-width] | (r[width:] << s)))
        width *= 2
    f, r, done = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64), 0
    for i in reversed(range(len(parts))):
        if k >> i & 1:
            f = (f << np.uint64(2 << i)) | parts[i][0][at + done]
            r = r | (parts[i][1][at + done] << np.uint64(2 * done))
            done += 1 << i
    return rows[at], np.minimum(f, r)


def kmer_classes(k: int = 4) -> list[str]:
    """The canonical k-mers over ACGT, 136 for k = 4, in alphabetical order."""
    table = str.maketrans("ACGT", "TGCA")
    words = ("".join(p) for p in itertools.product("ACGT", repeat=k))
    return sorted({min(w, w[::-1].translate(table)) for w in words})


def kmer_counts(seqs: DataFrame, k: int = 4) -> DataFrame:
    """(seq_id, kmer, n): canonical k-mers; frames with any other letter are skipped."""
    if k > 5:  # too many classes for a table of each row
        words = seqs.select("seq_id", F.explode(kmers(F.col("seq"), k)).alias("word"))
        # counted by word first: twice as many groups, but no complement per frame
        counted = words.groupBy("seq_id", "word").agg(F.count("*").alias("n"))
        return counted.groupBy("seq_id", canonical(F.col("word")).alias("kmer")).agg(F.sum("n").alias("n"))
    rows = seqs.select("seq_id", "seq")
    classes = 4**k

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(["".join(p) for p in itertools.product("ACGT", repeat=k)])
        for batch in batches:
            for first, data, bounds in chunks(batch.column(1)):
                row, code = frames(data, bounds, k)
                n = np.bincount(row * classes + code.astype(np.int64))
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + at // classes)), names.take(pa.array(at % classes)), pa.array(n[at].astype(np.int64))], ["seq_id", "kmer", "n"])

    # a row's own counts are few; they are dealt out before they are added, as a table of all
    # sequences of a task that reads would hold as many groups as they have classes
    parts = int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = rows.mapInArrow(kernel, f"seq_id {dict(rows.dtypes)['seq_id']}, kmer string, n long")
    return own.repartition(parts, "seq_id").groupBy("seq_id", "kmer").agg(F.sum("n").alias("n"))


def kmer_profile(seqs: DataFrame, k: int = 4) -> DataFrame:
    """(seq_id, profile): frequencies of all canonical k-mers in alphabetical order,
    each count raised by one over the number of classes, summing to 1."""
    classes = kmer_classes(k)
    share = 1.0 / len(classes)
    counts = kmer_counts(seqs, k).groupBy("seq_id").agg(F.map_from_entries(F.collect_list(F.struct("kmer", "n"))).alias("m"), F.sum("n").alias("total"))
    held = seqs.select("seq_id").distinct().join(counts, "seq_id", "left")
    one = lambda c: (F.coalesce(F.try_element_at("m", F.lit(c)), F.lit(0)) + F.lit(share)) / (F.coalesce("total", F.lit(0)) + F.lit(1.0))
    return held.select("seq_id", F.array(*(one(c) for c in classes)).alias("profile"))


def nx(lengths: DataFrame, group: list[str], length: str = "length", x: float = 0.5) -> DataFrame:
    """(group, nx): the length at which the longest sequences of a group first hold
    the share `x` of its bases. Equal lengths are summed first, so a group's window
    holds its distinct lengths, not its sequences."""
    by = lengths.groupBy(*group, F.col(length).alias("len")).agg((F.count("*") * F.col("len")).alias("bases"))
    w = Window.partitionBy(*group)
    run = by.withColumns({"cum": F.sum("bases").over(w.orderBy(F.desc("len"))), "total": F.sum("bases").over(w)})
    return run.where(F.col("cum") >= F.col("total") * x).groupBy(*group).agg(F.max("len").alias("nx"))


def wrapped(seq: Column, width: int = 100) -> Column:
    """The sequence with a line break after every `width` letters."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def class_table(spark: SparkSession, k: int = 4) -> DataFrame:
    """(kmer, ix): the canonical k-mers, numbered."""
    return spark.createDataFrame([(c, i) for i, c in enumerate(kmer_classes(k))], "kmer string, ix int")
