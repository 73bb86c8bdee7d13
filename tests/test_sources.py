"""Files written by hand."""

import gzip
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tessera import sinks
from tessera.operators import intervals
from tessera.sources import bam, fasta, files, lines, profiles, tables

FASTA = b">s1 first one\nACGT\nNNAC\n>empty\n>s2\nGGGG\n>s3 x\nAC\n"


def test_fasta_plain_and_gzip_by_content(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(FASTA)
    (tmp_path / "b.fa").write_bytes(gzip.compress(FASTA))  # no .gz in the name
    want = [("s1", "ACGTNNAC"), ("s2", "GGGG"), ("s3", "AC")]
    for name in ("a.fa", "b.fa"):
        assert [(r.seq_id, r.seq) for r in fasta.read_fasta(spark, str(tmp_path / name)).orderBy("ordinal").collect()] == want
    assert fasta.read_fasta(spark, [str(tmp_path / "a.fa"), str(tmp_path / "b.fa")]).count() == 6


def test_fasta_batches_are_bounded_by_what_they_hold(tmp_path):
    # short records take more than their letters
    want = [(i, f"é{i}", "ACGT"[: 1 + i % 4]) for i in range(60000)]
    (tmp_path / "a.fa").write_bytes("".join(f">{name} x\n{seq}\n" for _, name, seq in want).encode())
    batches = list(fasta.FastaReader([]).read(fasta.InputPartition(str(tmp_path / "a.fa"))))
    assert [(r["ordinal"], r["seq_id"], r["seq"]) for b in batches for r in b.to_pylist()] == want
    assert len(batches) > 3 and all(b.nbytes < 1 << 22 for b in batches)
    for b in batches:
        b.validate(full=True)


def test_plain_fasta_is_split_by_spark(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(FASTA)
    assert sorted((r.seq_id, r.seq) for r in fasta.read_plain_fasta(spark, str(tmp_path / "a.fa")).collect()) == [("s1", "ACGTNNAC"), ("s2", "GGGG"), ("s3", "AC")]


def test_find_files(spark, tmp_path):
    for n in ("x.bam", "y.bam", "z.txt"):
        (tmp_path / n).write_text("1")
    found = files.find_files(spark, str(tmp_path), ".bam").select(files.stem(F.col("path"), ".bam").alias("s"))
    assert [r.s for r in found.collect()] == ["x", "y"]


def write(path, text, zipped=False):
    path.write_bytes(gzip.compress(text.encode()) if zipped else text.encode())
    return str(path)


def test_tables(spark, tmp_path):
    cov = write(tmp_path / "cov", "Sequence ID\tMean\tVariance\tMean\tVariance\na\t1\t2\t3\t4\n", True)
    assert [tuple(r) for r in tables.read_coverage(spark, cov).orderBy("sample").collect()] == [("a", "sample1", 1.0, 2.0), ("a", "sample2", 3.0, 4.0)]
    assert tables.read_seeds(spark, write(tmp_path / "seed", "Sequence ID\tMarker IDs\na\t3 17 42\n", True)).first().markers == [3, 17, 42]
    assert [tuple(r) for r in tables.read_phenotype(spark, write(tmp_path / "p", "ID\tX\tY\ni\t1.5\tNA\nj\tna\t2\n"), 3).collect()] == [("i", None), ("j", 2.0)]
    assert [tuple(r) for r in tables.read_covariates(spark, write(tmp_path / "c", "ID\tAge\tNation\nanna\t30\tNA\n")).collect()] == [("anna", "Age", 30.0), ("anna", "Nation", None)]
    v = tables.read_variants(spark, write(tmp_path / "v", "Classification\tChromosome\tPosition\tPopulation\ti\tj\nt\tc\t7\t0.5/0.5/0/0\t1/0/0/0\tNA\n")).orderBy("sample").collect()
    assert [(r.pos, r.sample, r.acgt) for r in v] == [(7, "i", [1.0, 0.0, 0.0, 0.0]), (7, "j", None)]
    q = tables.read_quality(spark, write(tmp_path / "q", "Name\tCompleteness\tContamination\tx\nd.p.r.1\t90\t5\ty\nd.q.2\t60\t1\ty\n"))
    assert [r.name for r in tables.passing_quality(q).collect()] == ["d.p.r.1"]
    assert sorted((r.dataset, r.program, r.cluster) for r in tables.split_program(q).collect()) == [("d", "p.r", "1"), ("d", "q", "2")]
    t = tables.read_taxonomy(spark, write(tmp_path / "t", "user_genome\tclassification\na\td__B;g__X;s__Y z\nb\td__B;g__;s__\n"))
    assert [tuple(r) for r in t.select("name", "genus", "species").collect()] == [("a", "d__B;g__X", "s__Y z")]
    pairs = tables.read_pairs(spark, write(tmp_path / "pairs", "a\tb\t96\na\tc\t90\na\ta\t100\n"), 95.0)
    assert sorted(tuple(r) for r in pairs.collect()) == [("a", "b"), ("b", "a")]
    with pytest.raises(Exception, match="unexpected header"):
        tables.read_groups(spark, write(tmp_path / "g", "Wrong\nx\ty\n")).collect()


def test_other_readers(spark, tmp_path):
    assert tables.read_groups(spark, write(tmp_path / "g", "ID\tGroup\na\tNA\n")).first().grp == "NA"
    assert tables.read_mapping(spark, write(tmp_path / "m", "Sequence ID\tCluster ID\ns\t1\n")).first().cluster_id == "1"
    assert tables.read_truth(spark, write(tmp_path / "gt", "Sequence ID\tGenome ID\tLength\ns\tg\t10\n")).first().length == 10
    assert tables.read_annotation(spark, write(tmp_path / "an", "Cluster ID\tClassification\nc\td__B\n")).first().classification == "d__B"
    assert tables.read_abundance(spark, write(tmp_path / "ab", "Classification\ts\nd__B\t0.5\n")).first().value == 0.5
    assert tables.read_associations(spark, write(tmp_path / "as", "Classification\tChromosome\tPosition\tAllele\tBeta\tSE\tP\tSignificance\nd\tc\t3\tA\t1\t2\t0.5\t-\n")).first().p == 0.5
    assert tables.read_variant_annotation(spark, write(tmp_path / "va", "Classification\tChromosome\tPosition\tAnnotation\nd\tc\t3\tx\n")).first().annotation == "x"
    assert [r.value for r in lines.read_lines(spark, write(tmp_path / "l", "a\r\nb")).orderBy("line_no").collect()] == ["a", "b"]


def test_profiles_and_hits(spark, tmp_path):
    db = write(tmp_path / "db", "NAME a\nACC   PF00318.23\nLENG  10\nGA    25.10 24.00;\nTC    30 30\n//\nNAME b\nACC   TIGR00001\nLENG  20\nGA    1 1\nTC    40.5 39\n//\n")
    assert {r.profile: (r.length, r.sequence_score) for r in profiles.read_profiles(spark, db).collect()} == {"PF00318.23": (10, 25.1), "TIGR00001": (20, 40.5)}
    hits = profiles.read_hits(spark, write(tmp_path / "hits", "# head\np1 - q PF00318.23 1e-9 30.5 0\np2   -  TIGR00001  -  1e-9 12 0\n"))
    assert sorted((r.protein, r.profile, r.score) for r in hits.collect()) == [("p1", "PF00318.23", 30.5), ("p2", "TIGR00001", 12.0)]


def record(ref, pos, flag, cigar, seq, mapq=60, nm=None, extra=b""):
    ops = [(n << 4) | "MIDNSHP=X".index(op) for n, op in cigar]
    codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
    body = struct.pack("<iiBBHHHiiii", ref, pos, 2, mapq, 0, len(ops), flag, len(seq), -1, -1, 0) + b"r\0" + struct.pack(f"<{len(ops)}I", *ops) + packed + b"\xff" * len(seq)
    body += extra + (b"NMC" + bytes([nm]) if nm is not None else b"")
    return struct.pack("<i", len(body)) + body


def bgzf(data, size):
    out = b""
    for part in [data[i : i + size] for i in range(0, len(data), size)] + [b""]:
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        out += struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


REFS = [("c1.1", 100), ("c1.2", 50), ("c2.1", 80)]


def bam_bytes(block):
    data = b"BAM\1" + struct.pack("<i", 5) + b"@HD\t\n" + struct.pack("<i", len(REFS)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", m) for n, m in REFS)
    tags = b"XAZhello\0" + b"XBBs" + struct.pack("<i2h", 2, 1, 2) + b"XIi" + struct.pack("<i", 9)
    data += record(0, 10, 0, [(10, "M")], "ACGTACGTAC", nm=0, extra=tags)
    data += record(0, 12, 0x100, [(10, "M")], "ACGTACGTAC", mapq=0)  # secondary
    data += record(0, 14, 0x800, [(4, "S"), (6, "M")], "ACGTACGTAC", nm=0)  # supplementary
    data += record(0, 20, 0, [(5, "M"), (2, "I"), (3, "D"), (5, "=")], "ACGTACGTACGT", nm=5)
    data += record(0, 30, 0, [(10, "M")], "ACGTACGTAC", nm=5)  # too different
    data += record(2, 5, 16, [(3, "X"), (20, "N"), (4, "M")], "NACGTAC", nm=0)
    data += record(2, 6, 0, [(4, "M")], "ACGT", mapq=3, nm=0)
    return data + record(-1, -1, 4, [], "ACG")


@pytest.mark.parametrize("block", [37, 10_000])  # 37: records cross blocks
def test_bam(spark, tmp_path, block):
    paths = []
    for name in ("a", "b"):
        p = tmp_path / f"{name}.bam"
        p.write_bytes(bgzf(bam_bytes(block), block))
        paths.append(str(p))
    index = bam.build_index(spark, paths).cache()
    assert index.count() == 8
    whole = bam.checked_index(index)
    reads = bam.read_bam(whole).cache()
    assert reads.count() == 14
    one = reads.where(F.col("file") == paths[0]).orderBy("ref_id", "pos").collect()
    assert [(r.name, r.pos, r.flag, r.nm) for r in one] == [("c1.1", 10, 0, 0), ("c1.1", 12, 256, 0), ("c1.1", 14, 2048, 0), ("c1.1", 20, 0, 5), ("c1.1", 30, 0, 5), ("c2.1", 5, 16, 0), ("c2.1", 6, 0, 0)]
    assert one[0].seq == "ACGTACGTAC" and one[5].seq == "NACGTAC"
    assert bam.read_bam(whole, min_length=90).count() == 10
    ok = intervals.accepted(reads.where(F.col("file") == paths[0]), 10, 0.6)
    assert sorted((r.pos, [(b.start, b.end, b.read) for b in r.blocks]) for r in ok.collect()) == [(5, [(5, 8, 0), (28, 32, 3)]), (10, [(10, 20, 0)]), (14, [(14, 20, 4)]), (20, [(20, 25, 0), (28, 33, 7)])]


def test_bam_headers_must_agree(spark, tmp_path):
    a, b = tmp_path / "a.bam", tmp_path / "b.bam"
    a.write_bytes(bgzf(bam_bytes(99), 99))
    b.write_bytes(bgzf(bam_bytes(99).replace(b"c2.1", b"c9.9"), 99))
    with pytest.raises(Exception, match="different headers"):
        bam.checked_index(bam.build_index(spark, [str(a), str(b)])).collect()


def test_sinks_and_back(spark, tmp_path):
    cov = spark.createDataFrame([("a", "s1", 1.0, 2.0), ("a", "s2", 3.0, 4.0)], "seq_id string, sample string, mean double, variance double")
    sinks.write_coverage(cov, str(tmp_path / "cov"), ["s1", "s2"])
    part = next((tmp_path / "cov").glob("part-*"))
    assert [tuple(r) for r in tables.read_coverage(spark, str(part)).orderBy("sample").collect()] == [("a", "sample1", 1.0, 2.0), ("a", "sample2", 3.0, 4.0)]
    seqs = spark.createDataFrame([("k", "s", "A" * 250)], "cluster string, seq_id string, seq string")
    sinks.write_fasta(seqs, str(tmp_path / "fa"), 100)
    part = next((tmp_path / "fa" / "cluster=k").glob("part-*"))
    assert part.read_text() == ">s\n" + "A" * 100 + "\n" + "A" * 100 + "\n" + "A" * 50 + "\n"
    m = sinks.mapping_of(spark.createDataFrame([("f1", "a", "AC"), ("f2", "b", "ACGT"), ("f3", "c", "ACGTA")], "file string, seq_id string, seq string"), 4)
    assert sorted(tuple(r) for r in m.collect()) == [("b", "1"), ("c", "2")]


def test_reads_are_streamed_to_their_files(spark, monkeypatch):
    """No worker holds a whole sample."""
    from conftest import DATA

    from tessera.plans import samples

    monkeypatch.setattr(type(spark.range(1).groupBy("id")), "applyInArrow", None, raising=False)
    kinds = {r[0] for r in spark.read.parquet(f"{DATA}/events.parquet").select("event_type").distinct().collect()}
    assert {p.rsplit("/", 1)[1] for p in samples.write_bams(spark, DATA)} == {f"{k}.bam" for k in kinds}
