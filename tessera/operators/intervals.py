"""Alignments as intervals: blocks, acceptance, depth and overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: FLAG bits that reject a read: unmapped, secondary, failed checks, duplicate.
UNMAPPED, SECONDARY, FAILED, DUPLICATE = 0x4, 0x100, 0x200, 0x400
REJECTED = UNMAPPED | SECONDARY | FAILED | DUPLICATE
#: CIGAR operations.
MATCH, INSERT, DELETE, SKIP, SOFT, EQUAL, DIFFER = 0, 1, 2, 3, 4, 7, 8


def parse_cigar(text: Column) -> Column:
    """array<struct<op,len>> of a CIGAR string."""
    tokens = F.regexp_extract_all(text, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    return F.transform(tokens, lambda t: F.struct((F.instr(F.lit("MIDNSHP=X"), F.substring(t, -1, 1)) - 1).cast("int").alias("op"), F.regexp_extract(t, r"^(\d+)", 1).cast("int").alias("len")))


def cigar_sum(cigar: Column, *ops: int) -> Column:
    """Bases of the given operations."""
    return F.aggregate(F.filter(cigar, lambda c: c["op"].isin(*ops)), F.lit(0), lambda a, c: a + c["len"])


def identity_ok(cigar: Column, nm: Column, identity: float) -> Column:
    """ungapped - max(0, NM - inserted - deleted) >= aligned * identity, where aligned
    is ungapped plus inserted plus deleted."""
    ungapped, gaps = cigar_sum(cigar, MATCH, EQUAL, DIFFER), cigar_sum(cigar, INSERT, DELETE)
    return ungapped - F.greatest(F.lit(0), nm - gaps) >= (ungapped + gaps) * F.lit(identity)


def flag_ok(flag: Column, mapq: Column, cigar: Column, min_mapq: int) -> Column:
    return (flag.bitwiseAND(F.lit(REJECTED)) == 0) & (mapq >= min_mapq) & (F.size(cigar) > 0)


def blocks(cigar: Column, pos: Column) -> Column:
    """array<struct<start,end,read>>: ungapped stretches of the reference, half open,
    and where each begins in the read."""
    zero = F.struct(pos.cast("long").alias("ref"), F.lit(0).cast("long").alias("read"), F.array().cast("array<struct<start:bigint,end:bigint,read:bigint>>").alias("out"))

    def step(a: Column, c: Column) -> Column:
        n = c["len"].cast("long")
        on_ref, on_read = c["op"].isin(MATCH, DELETE, SKIP, EQUAL, DIFFER), c["op"].isin(MATCH, INSERT, SOFT, EQUAL, DIFFER)
        block = F.struct(a["ref"].alias("start"), (a["ref"] + n).alias("end"), a["read"].alias("read"))
        return F.struct(
            (a["ref"] + F.when(on_ref, n).otherwise(0)).alias("ref"), (a["read"] + F.when(on_read, n).otherwise(0)).alias("read"),
            F.when(c["op"].isin(MATCH, EQUAL, DIFFER), F.concat(a["out"], F.array(block))).otherwise(a["out"]).alias("out"),
        )

    return F.aggregate(cigar, zero, step, lambda a: a["out"])


def accepted(reads: DataFrame, min_mapq: int = 0, identity: float = 0.9) -> DataFrame:
    """Reads that pass FLAG, MAPQ and identity, with their `blocks`."""
    ok = flag_ok(F.col("flag"), F.col("mapq"), F.col("cigar"), min_mapq)
    return reads.where(ok).where(identity_ok(F.col("cigar"), F.col("nm"), identity)).withColumn("blocks", blocks(F.col("cigar"), F.col("pos")))


def counted(reads: DataFrame, min_mapq: int = 0, identity: float = 0.9) -> DataFrame:
    """Reads with `mapped` (0 or 1) and `blocks` for counting: unmapped reads are 0;
    a read that fails a check still counts as mapped but has no blocks, except that a
    failing secondary read is left out."""
    ok = flag_ok(F.col("flag"), F.col("mapq"), F.col("cigar"), min_mapq)
    unmapped = F.col("flag").bitwiseAND(F.lit(UNMAPPED)) != 0
    secondary = F.col("flag").bitwiseAND(F.lit(SECONDARY)) != 0
    whole = ok & identity_ok(F.col("cigar"), F.col("nm"), identity)
    none = F.array().cast("array<struct<start:bigint,end:bigint,read:bigint>>")
    rows = reads.where(unmapped | ok | ~secondary)
    return rows.withColumns({"mapped": F.when(unmapped, 0).otherwise(1), "blocks": F.when(~unmapped & whole, blocks(F.col("cigar"), F.col("pos"))).otherwise(none)})


def mapq_for(sequences: int) -> int:
    """The MAPQ floor that goes with a number of reference sequences."""
    return 30 if sequences >= 10_000_000 else 20 if sequences >= 5_000_000 else 0


def clip(start: Column, end: Column, low: Column, high: Column) -> Column:
    """The length of [start, end) within [low, high)."""
    return F.greatest(F.lit(0), F.least(end, high) - F.greatest(start, low))


def depth_runs(intervals: DataFrame, by: list[str], tile: int = 1 << 16) -> DataFrame:
    """(by, start, end, depth): stretches of equal, positive depth of intervals
    [start, end), by a sweep: +1 at each start and -1 at each end, equal positions
    summed first, then a running sum. Rows follow the intervals, not the bases.

    Intervals are cut at tile edges, so one deep or long sequence is swept by many
    tasks; runs stop at tile edges."""
    first, last = F.floor(F.col("start") / tile), F.floor((F.col("end") - 1) / tile)
    cut = intervals.where(F.col("end") > F.col("start")).select(*by, "start", "end", F.explode(F.sequence(first, last)).alias("tile"))
    cut = cut.select(*by, "tile", F.greatest("start", F.col("tile") * tile).alias("start"), F.least("end", (F.col("tile") + 1) * tile).alias("end"))
    edges = cut.select(*by, "tile", F.inline(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))))
    edges = edges.groupBy(*by, "tile", "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*by, "tile").orderBy("at")
    runs = edges.select(*by, F.col("at").alias("start"), F.lead("at").over(w).alias("end"), F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("depth"))
    return runs.where((F.col("depth") > 0) & F.col("end").isNotNull())


def depth_stats(intervals: DataFrame, by: list[str], length: str, trim: int = 0) -> DataFrame:
    """(by, mean, variance): depth over [trim, length - trim), sample variance, with
    uncovered positions. `intervals` has start, end and the sequence's `length`."""
    size = F.col(length) - 2 * trim
    inside = intervals.select(*by, length, F.greatest("start", F.lit(trim)).alias("start"), F.least("end", F.col(length) - trim).alias("end"))
    runs = depth_runs(inside, [*by, length])
    span = (F.col("end") - F.col("start")).cast("double")
    sums = runs.groupBy(*by, length).agg(F.sum(F.col("depth") * span).alias("s1"), F.sum(F.col("depth") * F.col("depth") * span).alias("s2"))
    return sums.where(size > 1).select(*by, length, (F.col("s1") / size).alias("mean"), ((F.col("s2") - F.col("s1") * F.col("s1") / size) / (size - 1)).alias("variance"))


def coverage(reads: DataFrame, sequences: DataFrame, min_mapq: int = 0, identity: float = 0.9, trim: int = 0, min_length: int = 100, samples: DataFrame | None = None) -> DataFrame:
    """(seq_id, sample, mean, variance) for every sequence of at least `min_length`
    and sample. reads: (sample, name, pos, mapq, flag, cigar, nm); sequences: (name,
    length); samples: (sample), those of the reads if not given, which reads them twice
    and knows no sample without reads."""
    wanted = sequences.where(F.col("length") >= min_length)
    hits = accepted(reads, min_mapq, identity).select("sample", "name", F.inline("blocks")).join(wanted, "name")
    found = depth_stats(hits, ["name", "sample"], "length", trim).drop("length")
    every = wanted.select("name").crossJoin(F.broadcast(reads.select("sample").distinct() if samples is None else samples))
    return every.join(found, ["name", "sample"], "left").select(F.col("name").alias("seq_id"), "sample", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("variance", F.lit(0.0)).alias("variance"))
