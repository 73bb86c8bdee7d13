"""Micro fixtures and invariants of the operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import sequence, stats
from tessera.operators import abundance, assoc, binning, clustering, dereplicate, graph, intervals, markers, mixture, pileup, taxonomy


def test_depth_by_hand(spark):
    df = spark.createDataFrame([("s", 0, 4, 10), ("s", 2, 6, 10)], "seq string, start long, end long, length long")
    r = intervals.depth_stats(df, ["seq"], "length").first()
    assert (r.mean, r.variance) == pytest.approx((0.8, 0.62222222))


def test_depth_across_tiles(spark):
    rng = random.Random(0)
    rows = [("s", a, a + rng.randint(1, 900), 5000) for a in (rng.randint(0, 4000) for _ in range(200))]
    df = spark.createDataFrame(rows, "seq string, start long, end long, length long")
    depth = np.zeros(5000, int)
    for _, a, b, _ in rows:
        depth[a:b] += 1
    got = np.zeros(5000, int)
    for r in intervals.depth_runs(df, ["seq"], tile=256).collect():
        got[r.start : r.end] += r.depth
    assert (got == depth).all()
    r = intervals.depth_stats(df, ["seq"], "length", 100).first()
    inner = depth[100:4900]
    assert (r.mean, r.variance) == pytest.approx((inner.mean(), inner.var(ddof=1)))


def test_nx(spark):
    df = spark.createDataFrame([("g", n) for n in (10, 8, 6, 4, 2)], "g string, length long")
    assert sequence.nx(df, ["g"]).first().nx == 8


def test_kmer_profile_sums_to_one(spark):
    df = spark.createDataFrame([("a", "ACGTNACGTTT"), ("b", "AC")], "seq_id string, seq string")
    rows = {r.seq_id: r.profile for r in sequence.kmer_profile(df).collect()}
    assert len(sequence.kmer_classes()) == 136 and all(sum(p) == pytest.approx(1) for p in rows.values())
    assert set(rows["b"]) == {1 / 136}
    counts = {r.kmer: r.n for r in sequence.kmer_counts(df).where("seq_id = 'a'").collect()}
    assert counts == {"ACGT": 2, "AACG": 1, "AAAC": 1}


def test_kmer_counts_by_row(spark):
    """Against counting by hand; rows of one id are added up, and no frame is a row."""
    rng = random.Random(11)
    seqs = [(rng.choice((None, 1, 2, 3)), "".join(rng.choice("ACGTACGTNa\u00e9") for _ in range(rng.randint(0, 90)))) for _ in range(60)] + [(1, None)]
    df = spark.createDataFrame(seqs, "seq_id int, seq string")
    for k in (3, 4):
        want = {}
        for i, s in seqs:
            for at in range(len(s or "") - k + 1):
                w = s[at : at + k]
                if set(w) <= set("ACGT"):
                    key = i, min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA")))
                    want[key] = want.get(key, 0) + 1
        got = sequence.kmer_counts(df, k)
        assert {(r.seq_id, r.kmer): r.n for r in got.collect()} == want
        assert "explode" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(1, p) for p in (0.01, 0.04, 0.03, 0.005, 0.5)], "g int, p double")
    got = {r.p: r.q for r in stats.benjamini_hochberg(df, "p", ["g"]).collect()}
    assert got == pytest.approx({0.01: 0.025, 0.04: 0.05, 0.03: 0.05, 0.005: 0.025, 0.5: 0.5})


def test_benjamini_hochberg_ties(spark):
    """Equal p values get the same q, the least of any order of theirs."""
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate((0.02, 0.5, 0.02, 0.01, 0.02))], "g int, i int, p double")
    got = {r.i: r.q for r in stats.benjamini_hochberg(df, "p", ["g"]).collect()}
    assert got == pytest.approx({0: 0.025, 1: 0.5, 2: 0.025, 3: 0.025, 4: 0.025})


def test_average_rank(spark):
    df = spark.createDataFrame([(1, v) for v in (1.0, 2.0, 2.0, 3.0)], "g int, v double")
    assert [r[0] for r in df.select(stats.average_rank("v", ["g"]).alias("r")).orderBy("r").collect()] == [1, 2.5, 2.5, 4]


def test_exact_mann_whitney():
    # all arrangements of 3 among 7
    import itertools

    n1, n2 = 3, 4
    us = [sum(r) - n1 * (n1 + 1) / 2 for r in itertools.combinations(range(1, 8), n1)]
    for u in set(us):
        hi = max(u, n1 * n2 - u)
        assert stats.mann_whitney_p(u, n1, n2, 0) == pytest.approx(min(1, 2 * sum(x >= hi for x in us) / len(us)))


def test_group_test(spark):
    values = spark.createDataFrame([("x", f"s{i}", -2.0 - i * 0.1 if i < 6 else -1.0 - i * 0.01) for i in range(12)] + [("y", f"s{i}", -5.0) for i in range(12)], "node string, sample string, value double")
    groups = spark.createDataFrame([(f"s{i}", "a" if i < 6 else "b") for i in range(12)], "sample string, grp string")
    rows = {r.node: r for r in stats.group_test(values, groups, -5.0, method="bonferroni").collect()}
    assert rows["x"].flag == "<" and rows["x"].p == pytest.approx(2 / math.comb(12, 6)) and rows["x"].q == rows["x"].p
    assert (rows["y"].flag, rows["y"].median1, rows["y"].p, rows["y"].q) == ("?", None, 1.0, 1.0)


def test_roll_up_parents_are_sums(spark):
    df = spark.createDataFrame([("d__A;p__B;c__C", 1.0), ("d__A;p__B;c__D", 2.0), ("d__A;p__E;c__F", 4.0)], "path string, value double")
    got = {r.node: r.value for r in taxonomy.roll_up(df, "path", "value", []).collect()}
    assert got == {"d__A": 7, "d__A;p__B": 3, "d__A;p__E": 4, "d__A;p__B;c__C": 1, "d__A;p__B;c__D": 2, "d__A;p__E;c__F": 4}


def test_abundance(spark):
    reads = [("s", "c1.1", 100, 0, 60, 0, "50M", 0), ("s", "c1.1", 100, 50, 60, 0, "50M", 0), ("s", "c2.1", 200, 0, 60, 0, "10M", 0), ("s", "zz.1", 10, 0, 60, 0, "5M", 0), ("s", None, 0, -1, 0, 4, "", 0), ("s", "c1.1", 100, 0, 60, 0, "10M", 9)]
    df = spark.createDataFrame(reads, "sample string, name string, length long, pos long, mapq int, flag int, c string, nm int").withColumn("cigar", intervals.parse_cigar(F.col("c")))
    seqs = spark.createDataFrame([("c1.1", 100), ("c2.1", 200)], "name string, length long")
    ann = spark.createDataFrame([("c1", "d__A;g__x"), ("c2", "d__A;g__y")], "cluster_id string, classification string")
    got = {r.node: r.value for r in abundance.abundance(df, seqs, ann).collect()}
    # c2 has depth .05 and goes; its read and the two others are unmapped
    assert got == pytest.approx({"d__A": 0.5, "d__A;g__x": 0.5, "d__A;g__y": 0.0}, abs=1e-5)


def test_pileup_ties_and_filters(spark):
    rows = [("s1", 1, "A"), ("s1", 1, "C"), ("s2", 1, "C"), ("s2", 1, "A"), ("s1", 2, "G"), ("s2", 2, "G")]
    df = spark.createDataFrame(rows, "sample string, site int, base string")
    counts = pileup.pileup(df, ["site"])
    got = pileup.sites(counts, ["site"], 2, mono=0.99).collect()
    # site 2: all samples have the major allele only, and so has site 1 above .05
    assert got == []
    got = pileup.sites(counts, ["site"], 2, dominant=0.6).collect()
    assert [(r.site, r.population) for r in got] == [(1, [0.5, 0.5, 0.0, 0.0])]
    assert counts.where("site = 1").select(pileup.major(F.col("acgt")).alias("m")).first().m == 0
    assert counts.limit(1).select(pileup.shown(F.array(F.lit(0.25), F.lit(1.0), F.lit(0.0), F.lit(0.3333)))).first()[0] == "0.25/1/0/0.3333"


def test_coverage_of_all_sequences(spark):
    reads = spark.createDataFrame([("s", "a", 0, 60, 0, "50M", 0)], "sample string, name string, pos long, mapq int, flag int, c string, nm int").withColumn("cigar", intervals.parse_cigar(F.col("c")))
    seqs = spark.createDataFrame([("a", 100), ("b", 100), ("c", 10)], "name string, length long")
    got = {r.seq_id: r["mean"] for r in intervals.coverage(reads, seqs).collect()}
    assert got == {"a": 0.5, "b": 0.0}


def test_best_match_first_on_ties(spark):
    cells = spark.createDataFrame([(1, "g2", 5.0), (1, "g1", 5.0), (2, "g1", 5.0)], "cluster_id int, genome_id string, bp double")
    genomes = spark.createDataFrame([("g1", 10.0), ("g2", 10.0)], "genome_id string, genome_bp double")
    got = {r.cluster_id: (r.genome_id, r.recall, r.precision) for r in binning.best_match(cells, genomes).collect()}
    assert got == {1: ("g1", 0.5, 0.5), 2: ("g1", 0.5, 1.0)}
    with pytest.raises(Exception, match="unknown id"):
        binning.contingency(spark.createDataFrame([("s", "c")], "seq_id string, cluster_id string"), spark.createDataFrame([("t", "g", 1)], "seq_id string, genome_id string, length long")).collect()


def test_marker_scores_agree(spark):
    rng = random.Random(0)
    rows = [(c, f"s{rng.randint(0, 9)}", rng.randint(0, 119)) for c in range(20) for _ in range(rng.randint(5, 150))]
    df = spark.createDataFrame(rows, "cluster int, seq_id string, marker int")
    got = {r.cluster: (r.score, r.recall) for r in markers.scores(df, "cluster").collect()}
    for c in range(20):
        counts = np.bincount([m for x, _, m in rows if x == c], minlength=120)
        assert got[c] == pytest.approx(markers.marker_score(counts, by_recall=True))
    assert len(set(markers.PROFILES.values())) == 120


def test_scores_are_counted_behind_one_exchange(spark):
    df = spark.range(1000).select(F.col("id").alias("c"), (F.col("id") % 120).cast("int").alias("marker"))
    plan = markers.scores(df, "c")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_seeds(spark):
    hits = spark.createDataFrame([(1, "q_1_2_+", "PF00318.23", 5.0), (2, "q_1_2_+", "TIGR00001", 5.0), (3, "q_5_9_-", "TIGR00002", 7.0)], "ordinal long, protein string, profile string, score double")
    assert [tuple(r) for r in markers.seeds(hits, markers.profile_table(spark)).collect()] == [("q", [0, 56])]


def test_representatives(spark):
    scored = spark.createDataFrame([("a", "d;g__X", "s__k", 5.0), ("b", "d;g__X", "s__k", 9.0), ("c", "d;g__X", "s__", 8.0), ("d", "d;g__X", "s__", 7.0), ("e", "d;g__X", "s__", 6.0)], "name string, genus string, species string, score double")
    pairs = spark.createDataFrame([("b", "c"), ("d", "e")], "src string, dst string")
    got = {r.classification: r.name for r in dereplicate.representatives(scored, pairs).collect()}
    assert got == {"d;g__X;s__k": "b", "d;g__X;s__X 1": "d"}


def test_minhash(spark):
    rng = random.Random(0)
    a = "".join(rng.choice("ACGT") for _ in range(20000))
    b = "".join(c if rng.random() > 0.01 else rng.choice("ACGT") for c in a)
    c = "".join(rng.choice("ACGT") for _ in range(20000))
    df = spark.createDataFrame([("a", a), ("b", b), ("c", c)], "g string, seq string")
    got = dereplicate.similar_pairs(dereplicate.sketches(df, "g"), "g").collect()
    assert [(r.src, r.dst) for r in got] == [("a", "b")] and got[0].distance == pytest.approx(0.0075, abs=0.004)


def test_sketches_are_sparks_hashes(spark):
    rng = random.Random(5)
    seqs = ["".join(rng.choice("ACGTACGTACGTNa\u00e9") for _ in range(rng.randint(0, 700))) for _ in range(40)] + [None, "ACGT" * 300]
    df = spark.createDataFrame(list(enumerate(seqs)), "g int, seq string")
    for k, size in ((4, 50), (13, 20), (21, 50)):
        own = F.slice(F.array_sort(F.array_distinct(F.transform(sequence.canonical_kmers(F.col("seq"), k), lambda w: F.xxhash64(w, F.lit(42))))), 1, size)
        want = {r.g: r.hs for r in df.select("g", own.alias("hs")).collect() if r.hs}
        assert {r.g: r.hs for r in dereplicate.row_sketches(df, "g", k, size).collect()} == want


def test_similar_classes_lose_no_link(spark, tmp_path):
    """Against all pairs by hand: copies are one class, and a hash that all share makes no
    candidates."""
    rng = random.Random(6)
    rows, base = [], [sorted(rng.sample(range(10**6), 40)) for _ in range(12)]
    for i in range(90):
        own = base[i % 12] if i % 3 == 0 else sorted({h if rng.random() > 0.3 else rng.randrange(10**6) for h in base[i % 12]} | {-1, -2})
        rows.append((f"d{i:02}", own[: rng.choice((40, 40, 15))]))
    df = spark.createDataFrame(rows, "g string, hs array<long>")

    def jaccard(a, b):
        union = set(sorted(set(a) | set(b))[:40])
        return len(set(a) & set(b) & union) / len(union)

    least = math.exp(-1.05) / (2 - math.exp(-1.05))
    want = {(a, b): pytest.approx(jaccard(x, y)) for a, x in rows for b, y in rows if a < b and jaccard(x, y) >= least}
    got = dereplicate.similar_pairs(df.select("g", F.explode("hs").alias("hash")), "g", 21, 40)
    assert {(r.src, r.dst): r.jaccard for r in got.collect()} == want and want
    pairs, members = dereplicate.similar_classes(df, "g", 21, 40, folder=str(tmp_path))
    of = {r.g: r["class"] for r in members.collect()}
    held = dict(rows)
    assert all(held[g] == held[c] and c == min(x for x, y in rows if y == held[g]) for g, c in of.items()) and len(of) == 90
    assert {(r.src, r.dst) for r in pairs.collect()} == {p for p in want if of[p[0]] == p[0] and of[p[1]] == p[1]}


def test_glm():
    rng = np.random.default_rng(0)
    x = np.column_stack((np.ones(400), rng.normal(size=(400, 2))))
    y = x @ [1, 2, 0] + rng.normal(size=400)
    beta, se, p = assoc.fit_glm(x, y, False)
    assert abs(beta - 2) < 4 * se and 0.03 < se < 0.07 and p < 1e-20
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [0, 1.5, 0])))).astype(float)
    beta, se, p = assoc.fit_glm(x, y, True)
    assert abs(beta - 1.5) < 4 * se and p < 1e-10
    assert assoc.fit_glm(x, (x[:, 1] > 0).astype(float), True) == (0.0, 0.0, 1.0)
    constant = assoc.scaled(np.full((4, 1), 30.0))
    assert (constant == 0).all()


@pytest.mark.parametrize("binomial", [False, True])
def test_glm_fits_variants_together(spark, monkeypatch, binomial):
    # batches smaller than a variant's rows; one that can't be fitted, one short of rank, one of
    # too few samples, rows of samples without a phenotype, and the others as fitted alone
    rng = np.random.default_rng(3)
    names = [f"s{i:02}" for i in range(20)]
    phenotype = {s: float(v) for s, v in zip(names, rng.permutation([0, 1] * 10) if binomial else rng.normal(size=20), strict=True)}
    covariates = {s: [float(v)] for s, v in zip(names, rng.normal(size=20), strict=True)}
    rows = []
    for pos in range(40):
        own = names[:5] if pos == 0 else sorted(rng.choice(names, 12 + pos % 9, replace=False))
        f, a = rng.random(len(own)), rng.random(len(own))
        f = a if pos == 1 else f
        f[0] = math.nan if pos == 2 else f[0]
        f = np.array([phenotype[s] for s in own]) if pos == 3 else f
        rows += [("t", "c" if pos % 2 else None, pos, 0, s, float(x), float(y)) for s, x, y in zip(own, f, a, strict=True)]
    calls = rows + [("t", "c", pos, 0, "unknown", 0.5, 0.5) for pos in range(50)]
    df = spark.createDataFrame(calls, "classification string, chrom string, pos long, allele int, sample string, f double, abundance double")
    monkeypatch.setattr(assoc, "CALLS", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r.pos: (r.chrom, r.beta, r.se, r.p) for r in assoc.glm(df, phenotype, covariates, 0.4).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for pos in range(40):
        mine = [r for r in rows if r[2] == pos]
        y = np.array([phenotype[r[4]] for r in mine])
        if min(np.sum(y == 0), np.sum(y == 1)) < 4 if binomial else len(y) < 8:
            continue
        x = np.array([(1, r[5], r[6], *covariates[r[4]]) for r in mine])
        want[pos] = (mine[0][1], *map(pytest.approx, assoc.fit_glm(x, y, binomial)))
    assert got == want and 0 not in got and got[2][1:] == (0, 0, 1) and len(got) > 20
    assert not binomial or got[3][1:] == (0, 0, 1)
    # neither padding nor company changes a fit
    x, y, n = np.zeros((3, 30, 4)), np.zeros((3, 30)), np.array([10, 20, 30])
    for i, k in enumerate(n):
        x[i, :k] = np.column_stack((np.ones(k), rng.normal(size=(k, 3))))
        y[i, :k] = rng.permutation(np.arange(k) % 2) if binomial else rng.normal(size=k)
    alone = [assoc.fit_glm(a[:k], b[:k], binomial) for a, b, k in zip(x, y, n, strict=True)]
    assert assoc.fit_glms(x, y, n, binomial) == pytest.approx(np.array(alone)) and all(p < 1 for *_, p in alone)


def test_sample_distance_in_steps(spark, monkeypatch):
    rng = np.random.default_rng(5)
    f = {(v, s): float(rng.random()) for v in range(30) for s in range(12) if rng.random() < 0.6}
    df = spark.createDataFrame([(v, s, x if s != 11 else f.get((v, 10), x)) for (v, s), x in f.items()], "v int, sample int, f double")
    f = {(r.v, r.sample): r.f for r in df.collect()}
    monkeypatch.setattr(assoc, "PAIRS", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = {(r.i, r.j): r.distance for r in assoc.sample_distance(df, ["v"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for i in range(12):
        for j in range(12):
            d = [(f[v, i] - f[v, j]) ** 2 for v in range(30) if (v, i) in f and (v, j) in f]
            want[str(i), str(j)] = pytest.approx(math.sqrt(sum(d) / (len(d) + assoc.EPS)) or 1.0)
    assert got == want
    empty = assoc.sample_distance(df.where("v < 0"), ["v"])
    assert empty.count() == 0


def test_tests_are_written_once(spark, tmp_path):
    # the number of tests and their rows come from one pass over them
    made = spark.sparkContext.accumulator(0)

    def count(frames):
        for x in frames:
            made.add(len(x))
            yield x

    tests = spark.createDataFrame([(i, 0.001 * i) for i in range(100)], "pos int, p double").mapInPandas(count, "pos int, p double")
    got = {r.pos: r.significance for r in assoc.significance(tests, folder=str(tmp_path)).collect()}
    assert made.value == 100 and got == {i: "+" if i == 0 else "-" for i in range(100)}


def test_knn_blocks_agree(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(120, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id long, v array<double>")
    got = {}
    for r in graph.cosine_neighbours(df, 4, block_rows=25).collect():
        got.setdefault(r.src, set()).add(r.dst)
    s = v @ v.T
    np.fill_diagonal(s, -9)
    assert all(got[i] == set(np.argsort(-s[i])[:4]) for i in range(120))


def test_near_pairs(spark):
    """Small blocks, against all pairs by hand; products that are the bound itself are in."""
    rng = np.random.default_rng(8)
    v = np.round(rng.normal(size=(80, 3)), 1)
    v[:4] = [[0.5, 0, 0], [1, 0, 0], [0.7, 0.1, 0], [0.5, 1.5, 0]]
    by = rng.integers(0, 3, 80)
    by[:4] = 0
    df = spark.createDataFrame([(i, int(by[i]), v[i].tolist()) for i in range(80)], "id long, c int, v array<double>")
    want = {(i, j) for i in range(80) for j in range(i + 1, 80) if by[i] == by[j] and sum((v[i] * v[j]).tolist()) >= 0.5}
    for rows in (7, 4000):
        got = [tuple(r) for r in graph.near_pairs(df, "c", 0.5, rows).collect()]
        assert set(got) == want and len(got) == len(want) and (0, 1) in want


def test_pairs_of_a_large_group_are_many_tasks(spark):
    df = spark.createDataFrame([(int(i > 50), i) for i in range(60)], "k int, i long")
    pairs = graph.group_pairs(df.select("k", F.col("i").alias("src")), df.select("k", F.col("i").alias("dst")), "k", 10)
    got = [(r.src, r.dst) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i in range(60) for j in range(i + 1, 60) if (i > 50) == (j > 50)}
    assert pairs.where("k = 0").select(F.spark_partition_id()).distinct().count() > 1


def test_best_of_ties():
    rng = np.random.default_rng(9)
    s = rng.integers(0, 5, (30, 40)).astype(float)
    s[s == 0] = -np.inf
    ids, others = np.arange(30), np.arange(100, 140)
    for k in (1, 5, 39, 40, 60):
        got = graph._best(ids, others, s, k)
        for i in ids:
            order = [j for j in np.argsort(-s[i], kind="stable")[:k] if np.isfinite(s[i, j])]
            assert got[got["src"] == i]["dst"].tolist() == others[order].tolist()


def test_rounds_do_not_make_the_edges_again(spark):
    from conftest import DATA

    from tessera.plans.registry import QUERIES

    for name in ("label_propagation_r3", "annealed_propagation"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroupsInPandas" not in plan and plan.count("Relation") < 12


def test_propagation_agrees(spark, tmp_path):
    rng = np.random.default_rng(1)
    w = np.zeros((40, 40))
    for i in range(40):
        w[i, rng.choice(np.delete(np.arange(40), i), 5, replace=False)] = rng.random(5)
    y = np.full(40, -1)
    y[:8] = [0, 1, 2, 0, 1, 2, 0, 1]
    edges = spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w), strict=True)], "src long, dst long, weight double")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y) if v >= 0], "id long, label long")
    near = np.argsort(-w, axis=1, kind="stable")[:, :5]
    want = graph.propagate_near(near, np.take_along_axis(w, near, axis=1), y.copy(), 3)
    z = (y[:, None] == np.arange(3)[None]).astype(float)  # densely, by hand
    for _ in range(3):
        new = w @ z / ((w @ z).sum(axis=1, keepdims=True) + graph.EPS)
        new[:8] = z[:8]
        z = new
    assert np.where(z.max(axis=1) > 0, z.argmax(axis=1), -1).tolist() == want.tolist()
    for folder in (None, str(tmp_path)):
        got = {r.id: r.label for r in graph.propagate(edges, labels, 3, folder=folder).collect()}
        assert [got.get(i, -1) for i in range(40)] == want.tolist()


def test_neighbours_stay_in_their_cluster(spark):
    """Small blocks, several clusters in one pass: as from all pairs of each cluster."""
    rng = np.random.default_rng(3)
    n = 90
    v = rng.normal(size=(n, 4))
    by = rng.integers(0, 3, n)
    rows = spark.createDataFrame([(i, int(by[i]), v[i].tolist()) for i in range(n)], "id long, c long, v array<double>")
    score = lambda a, b: (np.stack(a["v"].to_numpy()) @ np.stack(b["v"].to_numpy()).T)[None]
    got = {}
    for r in graph.top_neighbours(rows, 3, score, 1, 7, "c").collect():
        got.setdefault(r.src, set()).add(r.dst)
    s = v @ v.T
    np.fill_diagonal(s, -np.inf)
    s[by[:, None] != by[None]] = -np.inf
    assert got == {i: set(np.argsort(-s[i])[:3].tolist()) for i in range(n)}


def test_weight_grid():
    assert graph.weight_grid([0.1, 0.9], [0.9, 0.1], 1) == [(0.9, 0.1), (0.1, 0.9)]
    first = graph.weight_grid([0.5], [0.5], 10)[0]
    assert sum(first) == pytest.approx(1)
    with pytest.raises(ValueError, match="sum"):
        graph.weight_grid([0.5], [0.6], 1)


def test_kmer_model_prefers_near():
    n = graph.log_length(20000.0)
    p = [float(graph.kmer_log_probability(d, n, n)) for d in (0.0, 0.02, 0.2)]
    assert 0 >= p[0] > p[1] > p[2]


def test_digamma():
    assert mixture.digamma(np.array([1.0, 0.5, 10.0])) == pytest.approx([-0.5772156649, -1.9635100260, 2.2517525890])


def test_mixture_finds_blobs(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(m, 0.3, size=(80, 2)) for m in ((0, 0), (4, 4), (0, 5))])
    rows = [(i, v.tolist(), 3.0, (i // 80 + 1) if i % 80 < 10 else 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, x array<double>, w double, y int")
    got = {r.id: r.component for r in mixture.cluster(df, rounds=15).collect()}
    homes = [{got[i] for i in range(80 * k, 80 * k + 80)} for k in range(3)]
    assert [len(h) for h in homes] == [1, 1, 1] and len(set.union(*homes)) == 3


def test_principal_axes(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5)) * [5, 2, 1, 0.1, 0.1] + 7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    c = mixture.principal_axes(df, "v", 0.9, 1)
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert c.ratio == pytest.approx(values[: len(c.ratio)] / values.sum())
    z = np.array([r.z for r in mixture.project(df, "v", "z", c).orderBy("id").collect()])
    assert z.mean(axis=0) == pytest.approx(0, abs=1e-9) and z.var(axis=0, ddof=1) == pytest.approx(values[: z.shape[1]])


def test_greedy_partitions():
    marks = np.zeros((4, 120), int)
    marks[0, 16:70], marks[1, 70:120], marks[2, 16:80], marks[3, 80:120] = 1, 1, 1, 1
    label, good, _ = clustering.choose_partitions(np.array([[0, 0, 2, 2], [0, 1, 0, 1]]), marks)
    assert label[0] == label[1] and label[2] == label[3] and label[0] != label[2] and good == pytest.approx(2.0, abs=1e-3)


def test_clusters_split_until_all_are_decided(spark, tmp_path, monkeypatch):
    """A cluster that loses one sequence a round: more rounds than any fixed bound had."""

    def verdicts(state, marks, s):
        return state.groupBy("label").agg(F.when(F.count("*") == 1, "final").otherwise("split").alias("verdict"), F.lit(2).alias("genomes"), F.count("*").alias("members"))

    def spread(base, open_, *rest):
        first = open_.agg(F.min("id")).first()[0]
        return open_.select("id", "length", F.when(F.col("id") == first, first).otherwise(first + 1).alias("label"), F.lit(False).alias("closed"))

    monkeypatch.setattr(clustering, "verdicts", verdicts)
    monkeypatch.setattr(clustering, "_spread", spread)
    monkeypatch.setattr(clustering, "split_seeds", lambda g, s: (np.zeros(len(g), int), 0, 0.8))
    features = spark.createDataFrame([(i, 5000, [0.0], [1.0], [1.0]) for i in range(22)], "id long, length long, profile array<double>, mean array<double>, variance array<double>").coalesce(1)
    marks = spark.createDataFrame([(0, [1])], "id long, markers array<int>").coalesce(1)
    got = {r.id: r.cluster for r in clustering.cluster_sequences(features, marks, str(tmp_path)).collect()}
    assert got == {i: i for i in range(22)}


def test_two_genomes_are_split(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows, seeds = [], []
    for g in range(2):
        centre = rng.dirichlet(np.full(136, 5.0))
        for j in range(24):
            p = rng.dirichlet(centre * 40000)
            rows.append((g * 24 + j, 60000 - j, p.tolist(), [10.0 + 40 * g], [4.0]))
        seeds += [(g * 24 + j, list(range(16 + 26 * j, 16 + 26 * j + 26))) for j in range(4)]
    features = spark.createDataFrame(rows, "id long, length long, profile array<double>, mean array<double>, variance array<double>")
    marks = spark.createDataFrame(seeds, "id long, markers array<int>")
    got = {r.id: r.cluster for r in clustering.cluster_sequences(features, marks, str(tmp_path)).collect()}
    homes = [{got.get(i) for i in range(24 * g, 24 * g + 24)} for g in range(2)]
    assert [len(h) for h in homes] == [1, 1] and homes[0] != homes[1]


def test_large_clusters_take_the_mixture(spark, tmp_path):
    """Two genomes apart in coverage, over the gate: every sequence gets its genome's label."""
    rng = np.random.default_rng(0)
    rows = [(i, 20000 - i, rng.dirichlet(np.full(6, 50.0)).tolist(), [10.0 + 60 * (i % 2) + rng.normal(), 5.0 + 80 * (i % 2) + rng.normal()], [4.0, 4.0]) for i in range(60)]
    features = spark.createDataFrame(rows, "id long, length long, profile array<double>, mean array<double>, variance array<double>")
    s = clustering.Settings(mixture_sequences=10, mixture_rounds=10)
    x = {r.id: r.x for r in clustering.model_features(features).collect()}
    assert all(0 <= v <= 1 for r in x.values() for v in r[-2:])
    open_ = features.select("id", "length", F.lit(0).cast("long").alias("label"))
    judged = spark.createDataFrame([(0, "split", 2, 60)], "label long, verdict string, genomes long, members long")
    split = spark.createDataFrame([(i, 0, 1 + i % 2, 0, 0.8) for i in range(12)], "id long, label long, seed long, w int, cut double")
    got = {r.id: r.label for r in clustering._mix(features, open_, judged, split, s, str(tmp_path), 2).collect()}
    assert got == {i: i % 2 for i in range(60)}
    assert clustering._mix(features, open_, judged, split, clustering.Settings(), str(tmp_path), 2) is None
