"""Commands from files to files, on a toy study."""

import struct

import numpy as np
import pytest
from test_sources import bgzf, record, write

from tessera import commands as c
from tessera.sources import tables

REFS = [("k1.1", 200), ("k2.1", 200)]


def toy_bam(reads):
    data = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(REFS)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", m) for n, m in REFS)
    return bgzf(data + b"".join(reads), 500)


@pytest.fixture(scope="module")
def study(tmp_path_factory):
    d = tmp_path_factory.mktemp("study")
    rng = np.random.default_rng(0)
    for s in range(12):
        reads = []
        for ref in range(2):
            for pos in range(0, 151, 10):
                seq = ["A"] * 50
                if pos <= 100 < pos + 50:
                    seq[100 - pos] = "C" if rng.random() < 0.1 + 0.07 * s else "A"
                reads.append(record(ref, pos, 0, [(50, "M")], "".join(seq), nm=0))
        reads += [record(-1, -1, 4, [], "ACG") for _ in range(s)]
        (d / f"s{s:02d}.bam").write_bytes(toy_bam(reads))
    write(d / "ann", "Cluster ID\tClassification\nk1\td__B;g__a;s__x\nk2\td__B;g__a;s__y\n")
    write(d / "phe", "ID\tX\n" + "".join(f"s{s:02d}\t{s * 1.5 + rng.normal():.3f}\n" for s in range(12)))
    write(d / "grp", "ID\tGroup\n" + "".join(f"s{s:02d}\t{'a' if s < 6 else 'b'}\n" for s in range(12)))
    return d


def bams(d):
    return [str(p) for p in sorted(d.glob("*.bam"))]


def one(folder):
    parts = sorted(folder.glob("part-*"))
    return [str(p) for p in parts if p.stat().st_size] or [str(parts[0])]


def test_reads_to_associations(spark, study):
    index = c.index_bam(spark, bams(study), str(study / "index"))
    cov = c.coverage(spark, bams(study), str(study / "cov"), index, trim=10)
    assert cov.count() == 24
    ab = c.abundance(spark, bams(study), str(study / "ann"), str(study / "ab"), index)
    values = {(r["sample"], r["node"]): r["value"] for r in ab.collect()}
    assert values["s00", "d__B"] == pytest.approx(1, abs=1e-4)
    assert values["s08", "d__B"] == pytest.approx(32 / 40, abs=1e-4)
    found = c.variant(spark, bams(study), str(study / "ann"), str(study / "var"), index)
    assert {(r.chrom, r.pos) for r in found.collect()} <= {("k1.1", 101), ("k2.1", 101)} and found.count() >= 1
    read = tables.read_variants(spark, one(study / "var"))
    assert read.count() == 12 * found.count()
    tests = c.mwas(spark, one(study / "var"), one(study / "ab"), str(study / "phe"), str(study / "assoc"), components=1)
    rows = tests.collect()
    assert len(rows) == found.count() and all(0 <= r.p <= 1 for r in rows)
    qq, layout = c.plot_mwas(spark, one(study / "assoc"), str(study / "plots"))
    assert qq.count() == layout.count() == len(rows)
    t = c.abundance_test(spark, one(study / "ab"), str(study / "grp"), str(study / "test"))
    assert {r.node for r in t.collect()} == {"d__B;g__a;s__x", "d__B;g__a;s__y"}


def test_bins(spark, tmp_path):
    fa = write(tmp_path / "asm.fasta", ">a\nACGTACGT\n>b\nACGT\n>c\nGG\n")
    m = write(tmp_path / "map", "Sequence ID\tCluster ID\na\t1\nb\t1\nc\t2\n")
    gt = write(tmp_path / "gt", "Sequence ID\tGenome ID\tLength\na\tg\t8\nb\tg\t4\nc\th\t2\n")
    grid = c.benchmark_gt(spark, gt, {"p": m}, str(tmp_path / "grid"))
    assert {r.clusters for r in grid.collect()} == {2}
    q = write(tmp_path / "q", "Name\tCompleteness\tContamination\n1\t90\t1\n2\t20\t1\n")
    assert c.mapping2cluster(spark, fa, m, str(tmp_path / "bins"), q).count() == 2
    files = [str(p) for p in (tmp_path / "bins" / "cluster=1").glob("part-*")]
    assert c.cluster2mapping(spark, files, str(tmp_path / "again")).count() == 2
    q2 = write(tmp_path / "q2", "Name\tCompleteness\tContamination\nd.p.1\t96\t1\nd.p.2\t20\t1\ne.q.1\t91\t6\n")
    got = {(r.dataset, r.program, r.contamination_t, r.completeness_t): r.clusters for r in c.benchmark_rw(spark, q2, str(tmp_path / "rw"), labels={"p": "P"}).collect()}
    assert got["d", "p", 0.05, 0.95] == 1 and got["e", "p", 0.10, 0.70] == 0 and got["e", "q", 0.10, 0.90] == 1
    assert c.checkm2(spark, [q, q], str(tmp_path / "cm")).count() == 2
    with pytest.raises(ValueError, match="between 0 and 1"):
        c.checkm2(spark, [q], str(tmp_path / "cm"), contamination=10)


def test_representative(spark, tmp_path):
    rng = np.random.default_rng(0)
    a = "".join(rng.choice(list("ACGT"), 5000))
    b = "".join(x if rng.random() > 0.01 else "A" for x in a)
    d = "".join(rng.choice(list("ACGT"), 5000))
    paths = [write(tmp_path / f"{n}.fasta", f">s1\n{s[:3000]}\n>s2\n{s[3000:]}\n") for n, s in (("a", a), ("b", b), ("d", d))]
    q = write(tmp_path / "q", "Name\tCompleteness\tContamination\na\t99\t0\nb\t98\t0\nd\t97\t0\n")
    t = write(tmp_path / "t", "user_genome\tclassification\na\td__B;g__G;s__\nb\td__B;g__G;s__\nd\td__B;g__G;s__\n")
    found = c.representative(spark, paths, q, t, str(tmp_path / "out"), sketch=500)
    assert {r["name"]: r.classification for r in found.collect()} == {"a": "d__B;g__G;s__G 1", "d": "d__B;g__G;s__G 2"}
    assert c.gtdbtk(spark, [t, t], str(tmp_path / "tax"), q).count() == 6


def test_seed(spark, tmp_path):
    hits = write(tmp_path / "hits", "#\ng_1_9_+ - q PF00318.23 1e-9 30 0\ng_1_9_+ - q TIGR00001 1e-9 31 0\ng_20_30_- - q TIGR00002 1e-9 5 0\n")
    db = write(tmp_path / "db", "NAME a\nACC   TIGR00002\nLENG  10\nTC    10 10\n//\n")
    assert [tuple(r) for r in c.seed(spark, [hits], db, str(tmp_path / "seeds")).collect()] == [("g", [55])]


def test_cluster(spark, tmp_path):
    rng = np.random.default_rng(1)
    fa, cov, marks = [], ["Sequence ID\tMean\tVariance"], ["Sequence ID\tMarker IDs"]
    for g in range(2):
        p = rng.dirichlet(np.full(4, 8.0))
        for j in range(8):
            fa.append(f">g{g}s{j}\n" + "".join(rng.choice(list("ACGT"), 20000 - j, p=p)))
            cov.append(f"g{g}s{j}\t{10 + 50 * g}\t4")
        marks += [f"g{g}s{j}\t" + " ".join(map(str, range(16 + 26 * j, 42 + 26 * j))) for j in range(4)]
    w = lambda n, x: write(tmp_path / n, "\n".join(x) + "\n")
    found = c.cluster(spark, w("a.fa", fa), w("cov", cov), w("seed", marks), str(tmp_path / "out"), str(tmp_path / "state"))
    homes = {}
    for r in found.collect():
        homes.setdefault(r.cluster_id, set()).add(r.seq_id[:2])
    assert sorted(map(sorted, homes.values())) == [["g0"], ["g1"]]
