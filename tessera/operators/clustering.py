"""Splitting sequences into genomes: seeds by markers, then all by affinity.

The loop splits clusters until each is final. A cluster's seeds, bounded by
`max_seeds`, are one task: each one's nearest, one propagation for each weighting and
carrier set, and a greedy choice of partitions by marker score. The sequences of all
clusters are processed together in DataFrames: a round has as many jobs for a thousand
open clusters as for one. Only clusters that are large enough for the mixture model, and
so few, go one by one.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import markers as M
from . import mixture
from .graph import _parts, _written, anneal_near, cluster_edges, weight_grid
from .graph import anneal as anneal_edges


#: Seeds that are compared with all others at a time.
ROWS = 256


@dataclass(frozen=True)
class Settings:
    kmer_weights: tuple[float, ...] = (0.9, 0.7, 0.5, 0.3, 0.1)
    coverage_weights: tuple[float, ...] = (0.1, 0.3, 0.5, 0.7, 0.9)
    min_kmer: float = 0.5
    min_coverage: float = 0.5
    seed_neighbours: int = 10
    sequence_neighbours: int = 10
    min_cluster: int = 100_000
    max_seeds: int = 30_000
    stages: tuple = field(default=((0.97, 10, 0.97), (0.90, 10, 0.90), (0.85, 30, 0.7)))
    mixture_clusters: int = 200
    mixture_sequences: int = 500_000
    mixture_n50: int = 1500
    mixture_rounds: int = 30


def choose_partitions(partitions: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Greedy choice among candidate groups of seeds.

    partitions: (candidates, seeds), -1 for unlabelled; marks: (seeds, markers). Again
    and again the group, or single seed, with the best marker score is taken and its
    seeds leave all others. Scores of .5 or more are good (labels 1, 2, ...), of .1 or
    more low (labels below 0); the rest is 0. Also gives the sums of good and low
    scores."""
    n = len(marks)
    groups = {("s", i): np.array([i]) for i in range(n)}
    for c, row in enumerate(partitions):
        for v in np.unique(row[row >= 0]):
            groups[c, int(v)] = np.flatnonzero(row == v)
    score = {g: M.marker_score(marks[m].sum(axis=0))[0] for g, m in groups.items()}
    of: list[list] = [[] for _ in range(n)]
    for g, m in groups.items():
        for i in m:
            of[i].append(g)
    label, free = np.zeros(n, np.int64), np.ones(n, bool)
    next_label, good, low = 1, 0.0, 0.0
    order = {g: i for i, g in enumerate(score)}
    heap = [(-v, order[g], g) for g, v in score.items()]
    heapq.heapify(heap)
    while heap:
        value, _, best = heapq.heappop(heap)
        if score.get(best) != -value:
            continue  # it has lost seeds since, and comes again
        value, taken = -value, groups[best][free[groups[best]]]
        if value >= 0.5:
            label[taken], good, next_label = next_label, good + value, next_label + 1
        elif value >= 0.1:
            label[taken], low, next_label = -next_label, low + value, next_label + 1
        free[taken] = False
        for g in {g for i in taken for g in of[i]}:
            rest = groups[g][free[groups[g]]]
            if not len(rest):
                score.pop(g, None)
                continue
            new = M.marker_score(marks[rest].sum(axis=0))[0]
            if g in score and new != score[g]:
                heapq.heappush(heap, (-new, order[g], g))
            score[g] = new
    return label, good, low


def split_seeds(seeds: pd.DataFrame, s: Settings) -> tuple[np.ndarray, int, float]:
    """(labels, index of the weighting, edge cut) of one cluster's seeds: columns
    length, profile, mean, variance, markers."""
    n = len(seeds)
    mean = np.stack(seeds["mean"].to_numpy())
    marks = np.zeros((n, M.MARKERS), np.int64)
    for i, m in enumerate(seeds["markers"]):
        marks[i, list(m)] = 1
    carriers = {tuple(np.flatnonzero(c)) for c in marks.T if c.any()}
    k = min(n, s.seed_neighbours)
    grid = weight_grid(list(s.kmer_weights), list(s.coverage_weights), mean.shape[1])
    near, score = np.zeros((len(grid), n, k), np.int64), np.zeros((len(grid), n, k))
    for cut in range(0, n, ROWS):  # a few rows against all at a time; only the nearest are kept
        lk, lc = _parts(seeds.iloc[cut : cut + ROWS], seeds, np.log(s.min_kmer), np.log(s.min_coverage))
        rows = np.arange(len(lk))
        for w, (wk, wc) in enumerate(grid):
            own = wk * lk + wc * lc
            own[rows, cut + rows] = -np.inf
            top = np.argpartition(-own, k - 1, axis=1)[:, :k]
            near[w, cut : cut + ROWS], score[w, cut : cut + ROWS] = top, np.take_along_axis(own, top, axis=1)
    found = []
    for w in range(len(grid)):
        a = np.exp(score[w])
        cut = float(np.percentile(a.min(axis=1), 20))
        parts = []
        for c in sorted(carriers):
            if 1 < len(c) < n:
                y = np.full(n, -1)
                y[list(c)] = c
                parts.append(anneal_near(near[w], a, y))
        label, good, low = choose_partitions(np.array(parts).reshape(-1, n), marks)
        found.append((good, low, w, label, cut))
    best = max(found, key=lambda f: (f[0], -f[2])) if max(f[0] for f in found) > 0 else max(found, key=lambda f: (f[1], -f[2]))
    return best[3], best[2], max(0.8, best[4])


def verdicts(state: DataFrame, marks: DataFrame, s: Settings) -> DataFrame:
    """(label, verdict, genomes, members): drop, final or split, for each open cluster of
    state (id, length, label); marks: (id, marker)."""
    own = state.join(marks, "id").select("label", F.col("id").alias("seq_id"), "marker")
    size = state.groupBy("label").agg(F.sum("length").alias("bp"), F.count("*").alias("members"))
    df = size.join(M.scores(own, "label"), "label", "left").join(M.genome_count(own, "label"), "label", "left")
    drop = (F.coalesce("recall", F.lit(0.0)) < 0.2) | (F.col("bp") < s.min_cluster)
    return df.select("label", F.when(drop, "drop").when((F.coalesce("genomes", F.lit(0)) <= 1) | (F.col("score") >= 0.95), "final").otherwise("split").alias("verdict"), F.coalesce("genomes", F.lit(0)).alias("genomes"), "members")


def cluster_sequences(features: DataFrame, seeds: DataFrame, folder: str, s: Settings | None = None) -> DataFrame:
    """(id, cluster) of features (id, length, profile, mean, variance) and seeds (id,
    markers); sequences of dropped clusters are left out. Rounds go on until no cluster is
    open. State is written to `folder` each round."""
    s = s or Settings()
    marks = _written(seeds.select("id", F.explode("markers").alias("marker")), folder, "marks")
    base = _written(features, folder, "features")
    state = _written(base.select("id", "length", F.lit(0).cast("long").alias("label")), folder, "state")
    done = None
    samples_first = base.select(F.size("mean").alias("n")).first()
    samples = samples_first["n"] if samples_first else 0
    one_sample = samples == 1

    for turn in count():
        judged = _written(verdicts(state, marks, s), folder, "verdicts")
        first = state.groupBy("label").agg(F.min("id").alias("least"))
        final = state.join(judged.where("verdict = 'final'"), "label").join(first, "label").select("id", F.col("least").alias("cluster"))
        final = _written(final, folder, "final")
        done = final if done is None else done.unionByName(final)
        open_ = _written(state.join(judged.where("verdict = 'split'"), "label").select("id", "length", "label"), folder, "open")
        if open_.isEmpty():
            break
        least = (1500 if one_sample else 2500) if turn == 0 else 0
        picked = open_.where(F.col("length") >= least).join(seeds, "id").join(base.drop("length"), "id")

        def kernel(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values(["length", "id"], ascending=[False, True]).head(s.max_seeds)
            label, w, cut = split_seeds(g, s)
            return pd.DataFrame({"id": g["id"], "label": g["label"], "seed": label, "w": w, "cut": cut})

        split = _written(picked.groupBy("label").applyInPandas(kernel, "id long, label long, seed long, w int, cut double"), folder, "split")
        mixed = _mix(base, open_, judged, split, s, folder, samples)
        spread = open_ if mixed is None else open_.join(mixed.select("id"), "id", "left_anti")
        state = _spread(base, spread, split, s, folder, one_sample and turn == 0, samples)
        state = _written(state if mixed is None else state.unionByName(mixed), folder, "state")
        closed = state.where("closed")
        done = done.unionByName(closed.select("id", F.col("label").alias("cluster")))
        state = state.where(~F.col("closed")).select("id", "length", "label")
        # every open cluster gives one label at least: as many as before, and nothing was split
        if turn and closed.isEmpty() and state.select("label").distinct().count() == open_.select("label").distinct().count():
            raise RuntimeError(f"round {turn} of the clustering split none of its open clusters")
    return done


def _spread(base: DataFrame, open_: DataFrame, split: DataFrame, s: Settings, folder: str, skip_unlabelled: bool, samples: int) -> DataFrame:
    """(id, length, label, closed): seed labels spread to all sequences of their cluster.
    A seed group is named by its smallest member; a cluster with one group or none is
    closed; sequences that no label reaches are a group by themselves."""
    usable = split.where(F.col("seed") != 0) if skip_unlabelled else split
    names = usable.groupBy("label", "seed").agg(F.min("id").alias("named"))
    given = usable.join(names, ["label", "seed"]).select("id", "label", F.col("named").alias("y"), "w", "cut")
    kinds = given.groupBy("label").agg(F.count_distinct("y").alias("kinds"))
    all_ = open_.join(kinds, "label", "left").withColumn("kinds", F.coalesce("kinds", F.lit(0)))
    lone = all_.where("kinds <= 1").join(open_.groupBy("label").agg(F.min("id").alias("least")), "label").select("id", "length", F.col("least").alias("label"), F.lit(True).alias("closed"))
    many = all_.where("kinds > 1")
    weights = split.groupBy("label").agg(F.first("w").alias("w"), F.first("cut").alias("cut"))
    grid = F.array(*(F.struct(F.lit(float(a)).alias("wk"), F.lit(float(b)).alias("wc")) for a, b in weight_grid(list(s.kmer_weights), list(s.coverage_weights), samples)))
    rows = many.select("id", "label").join(base, "id").join(weights, "label").withColumn("g", F.get(grid, F.col("w"))).select("*", "g.wk", "g.wc")
    edges = cluster_edges(rows, s.sequence_neighbours, s.min_kmer, s.min_coverage)
    # labels are named by their members, so those of all clusters spread side by side
    start = given.join(many.select("label").distinct(), "label", "left_semi").select("id", F.col("y").alias("label"))
    found = anneal_edges(_written(edges, folder, "edges"), start, s.stages, folder)
    left = _written(many.select("id", "length", "label").join(found.withColumnRenamed("label", "new"), "id", "left"), folder, "spread")
    rest = left.where("new is null").groupBy("label").agg(F.min("id").alias("least"))
    out = left.join(rest, "label", "left").select("id", "length", F.coalesce("new", "least").alias("label"), F.lit(False).alias("closed"))
    return lone.unionByName(out)


def _mix(base: DataFrame, open_: DataFrame, judged: DataFrame, split: DataFrame, s: Settings, folder: str, samples: int) -> DataFrame | None:
    """(id, length, label, closed) of the open clusters that the mixture model takes: large
    ones, or of very many genomes in several samples, if the assembly is not in pieces.
    Clusters where it finds one component are left to the others' way."""
    seeds = split.groupBy("label").agg(F.count("*").alias("seeds"), F.max(F.col("seed") != 0).alias("some"))
    large = (F.col("members") >= s.mixture_sequences) | (F.col("seeds") >= s.max_seeds) | (F.lit(samples > 1) & (F.col("genomes") >= s.mixture_clusters))
    taken = [r["label"] for r in judged.where("verdict = 'split'").join(seeds, "label").where(large & F.col("some")).select("label").collect()]
    if not taken:
        return None
    sums = base.groupBy("length").agg(F.sum("length").alias("bp"))  # by distinct length
    run = sums.select("length", F.sum("bp").over(Window.orderBy(F.desc("length"))).alias("cum"), F.sum("bp").over(Window.partitionBy()).alias("all"))
    if (run.where(F.col("cum") * 2 >= F.col("all")).agg(F.max("length").alias("n50")).first()["n50"] or 0) < s.mixture_n50:
        return None
    x = _written(model_features(base), folder, "mixture-features")
    out = None
    for label in sorted(taken):
        y = split.where(F.col("label") == label).select("id", F.col("seed").cast("int").alias("y"))
        rows = open_.where(F.col("label") == label).join(x, "id").join(y, "id", "left")
        rows = _written(rows.select("id", "x", (F.col("length") / 1000).alias("w"), F.coalesce("y", F.lit(0)).alias("y")), folder, "mixture-rows")
        found = _written(mixture.cluster(rows, rounds=s.mixture_rounds), folder, "mixture")
        names = found.groupBy("component").agg(F.min("id").alias("label"))
        if names.count() > 1:
            own = open_.where(F.col("label") == label).select("id", "length").join(found, "id").join(names, "component").select("id", "length", "label", F.lit(False).alias("closed"))
            out = own if out is None else out.unionByName(own)
    return out


def model_features(base: DataFrame) -> DataFrame:
    """(id, x) of (id, profile, mean): the profiles' principal axes beside each sample's
    log1p mean coverage, brought to [0, 1]."""
    axes = mixture.principal_axes(base, "profile")
    n = (base.select(F.size("mean").alias("n")).first() or {"n": 0})["n"]
    logs = [F.log1p(F.get("mean", F.lit(i))) for i in range(n)]
    ends = base.agg(*(f(c).alias(f"{name}{i}") for i, c in enumerate(logs) for name, f in (("lo", F.min), ("hi", F.max)))).first()
    scaled = F.array(*((c - F.lit(float(ends[f"lo{i}"]))) / F.lit(float(ends[f"hi{i}"] - ends[f"lo{i}"]) + mixture.EPS) for i, c in enumerate(logs)))
    return mixture.project(base, "profile", "_axes", axes).select("id", F.concat("_axes", scaled).alias("x"))
