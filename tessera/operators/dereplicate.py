"""Cluster scores, MinHash similarity and greedy choice of representatives."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import canonical_kmers, chunks, frames

#: Cells in which hashes are counted, to tell frequent ones.
CELLS = 1 << 20


def cluster_score(completeness: Column, contamination: Column, n50: Column) -> Column:
    """completeness - 5 contamination + 15 log10(N50), the first two in percent."""
    return completeness - 5 * contamination + 15 * F.log10(n50)


def best_of_species(scored: DataFrame) -> DataFrame:
    """The best (score, name) of each named species: (genus, species, name, score)."""
    named = scored.where("species <> 's__'")
    return named.groupBy("genus", "species").agg(F.max(F.struct("score", "name")).alias("b")).select("genus", "species", "b.name", "b.score")


def _letters(n: int) -> np.ndarray:
    """The bytes of all words of n letters, as numbers."""
    x = np.arange(4**n)
    return sum((np.frombuffer(b"ACGT", np.uint8).astype(np.uint64)[x >> 2 * (n - 1 - j) & 3] << np.uint64(8 * j) for j in range(n)), np.zeros(len(x), np.uint64))


def _xxh64(code: np.ndarray, k: int, seed: int, words: dict[int, np.ndarray]) -> np.ndarray:
    """Spark's xxhash64(word, seed) of words of k < 32 letters, two bits each in `code`; `words`
    are the bytes of words of 8, 4 and 1 letters."""
    u = np.uint64
    p1, p2, p3, p4, p5 = (u(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    rot = lambda x, r: (x << u(r)) | (x >> u(64 - r))

    def ends(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> u(33))) * p2
        h = (h ^ (h >> u(29))) * p3
        return h ^ (h >> u(32))

    with np.errstate(over="ignore"):
        h, at = np.full(len(code), u(42) + p5 + u(k)), 0
        while at < k:
            n = 8 if k - at >= 8 else 4 if k - at >= 4 else 1
            w = words[n][(code >> u(2 * (k - at - n)) & u(4**n - 1)).astype(np.int64)]
            if n == 8:
                h = rot(h ^ (rot(w * p2, 31) * p1), 27) * p1 + p4
            elif n == 4:
                h = rot(h ^ (w * p1), 23) * p2 + p3
            else:
                h = rot(h ^ (w * p5), 11) * p1
            at += n
        h = ends(h) + p5 + u(4)  # the seed follows as an int, with the word's hash for a seed
        return ends(rot(h ^ (u(seed & 0xFFFFFFFF) * p1), 23) * p2 + p3).view(np.int64)


def _least(h: np.ndarray, size: int) -> np.ndarray:
    """The `size` smallest distinct values, sorted; most rows need few of theirs sorted."""
    if len(h) > 4 * size:
        some = np.unique(np.partition(h, 2 * size)[: 2 * size])
        if len(some) > size:
            return some[:size]
    return np.unique(h)[:size]


def row_sketches(seqs: DataFrame, group: str, k: int = 21, size: int = 1000, seed: int = 42) -> DataFrame:
    """(group, hs): the `size` smallest hashes of each row's canonical k-mers, sorted; rows
    without any are left out."""
    rows = seqs.select(group, "seq")
    if k > 31:
        own = F.slice(F.array_sort(F.array_distinct(F.transform(canonical_kmers(F.col("seq"), k), lambda w: F.xxhash64(w, F.lit(seed))))), 1, size)
        return rows.select(group, own.alias("hs")).where(F.size("hs") > 0)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = {n: _letters(n) for n in (1, 4, 8)}
        for batch in batches:
            for first, data, bounds in chunks(batch.column(1)):
                row, code = frames(data, bounds, k)
                h = _xxh64(code, k, seed, words)
                cut = np.searchsorted(row, np.arange(len(bounds)))
                lists = [_least(h[i:j], size) for i, j in zip(cut[:-1], cut[1:], strict=True)]
                n = np.array([len(x) for x in lists])
                keep = np.flatnonzero(n)
                if len(keep):
                    hs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n[keep]))), pa.int32()), pa.array(np.concatenate([lists[i] for i in keep]), pa.int64()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + keep)), hs], [group, "hs"])

    return rows.mapInArrow(kernel, f"{group} {dict(rows.dtypes)[group]}, hs array<long>")


def sketches(seqs: DataFrame, group: str, k: int = 21, size: int = 1000, seed: int = 42) -> DataFrame:
    """(group, hash): the `size` smallest hashes of a group's canonical k-mers."""
    # a row keeps its smallest hashes before anything is shuffled
    hashes = row_sketches(seqs, group, k, size, seed).select(group, F.explode("hs").alias("hash")).distinct()
    w = Window.partitionBy(group).orderBy("hash")
    return hashes.withColumn("r", F.row_number().over(w)).where(F.col("r") <= size).drop("r")


def _written(df: DataFrame, folder: str | None, label: str) -> DataFrame:
    if not folder:
        return df
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sketch_lists(seqs: DataFrame, group: str, k: int = 21, size: int = 1000, seed: int = 42, folder: str | None = None) -> DataFrame:
    """(group, hs): the same as sorted lists; only groups of several rows are merged. With
    `folder` they are written there, else made anew for each use."""
    own = _written(row_sketches(seqs, group, k, size, seed), folder, "sketches")
    several = own.groupBy(group).agg(F.count("*").alias("n")).where("n > 1").select(group)
    if folder and several.isEmpty():
        return own
    hashes = own.join(several, group, "left_semi").select(group, F.explode("hs").alias("hash")).distinct()
    w = Window.partitionBy(group).orderBy("hash")
    merged = hashes.withColumn("r", F.row_number().over(w)).where(F.col("r") <= size).groupBy(group).agg(F.array_sort(F.collect_list("hash")).alias("hs"))
    return own.join(several, group, "left_anti").unionByName(merged)


def _cell_counts(lists: DataFrame) -> np.ndarray:
    """How many hashes of the lists fall in each of CELLS cells. A task gives a fixed number of
    parts, and what comes to the driver has that size too."""
    part = CELLS // 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CELLS, np.int64)
        for b in batches:
            n += np.bincount(b.column(0).flatten().to_numpy() & (CELLS - 1), minlength=CELLS)
        yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array([x.astype(np.int64).tobytes() for x in n.reshape(16, part)], pa.binary())], ["part", "n"])

    def add(t: pa.Table) -> pa.Table:
        return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "n": pa.array([sum(np.frombuffer(x.as_py(), np.int64) for x in t.column("n")).tobytes()], pa.binary())})

    out = np.zeros((16, part), np.int64)
    for r in lists.select("hs").mapInArrow(count, "part int, n binary").groupBy("part").applyInArrow(add, "part int, n binary").collect():
        out[r["part"]] = np.frombuffer(bytes(r["n"]), np.int64)
    return out.ravel()


def similar_classes(lists: DataFrame, group: str, k: int = 21, size: int = 1000, ani: float = 0.95, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(src, dst, jaccard, distance) and (group, class), of lists (group, hs), or (group, genus,
    hs) for pairs within a genus only: the similar pairs, src < dst, of the least groups of
    each class; a class is what has the same sketch (and genus), whose pairs are all alike.

    A pair has common hashes for the least Jaccard share of its larger sketch. So the two
    have some among their first ones in any order of all hashes, and rarer cells come first
    here: each row shows as many as leave no similar pair out, those that a pair must
    share at least are counted, and what is left is compared by whole sketches."""
    top = math.exp(-k * (1 - ani))
    least = top / (2 - top)
    within = ["genus"] if "genus" in lists.columns else []
    kind = dict(lists.dtypes)[group]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs = b.column(b.num_columns - 1)
            ends, h = hs.offsets.to_numpy() - hs.offsets[0].as_py(), hs.flatten().to_numpy()
            same = pa.array([hashlib.sha256(h[i:j].tobytes()).digest() for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), same], [group, *within, "_same"])

    heads = f"{group} {kind}, {''.join(f'{c} string, ' for c in within)}"
    named = lists.select(group, *within, "hs").mapInArrow(digest, f"{heads}_same binary")
    classes = named.groupBy("_same", *within).agg(F.min(group).alias("class"))
    on = named["_same"] == classes["_same"]
    for c in within:
        on = on & named[c].eqNullSafe(classes[c])
    members = _written(named.join(classes, on).select(named[group], classes["class"]), folder, "classes")
    firsts = members.select(F.col("class").alias(group)).distinct()
    reps = _written(lists.join(firsts, group, "left_semi"), folder, "firsts")
    rare = _cell_counts(reps)
    need = lambda n: np.maximum(np.ceil(least * n - 1e-9), 1).astype(np.int64)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.num_columns - 1)
            ends = lists.offsets.to_numpy()
            h, n = lists.flatten().to_numpy(), np.diff(ends)
            row = np.repeat(np.arange(len(n)), n)
            h = h[np.lexsort((h, rare[h & (CELLS - 1)], row))]
            must = np.maximum(need(n) // 3, 1)
            keep = np.arange(len(h)) - np.repeat(ends[:-1] - ends[0], n) < (n - need(n) + must)[row]
            at = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(b.num_columns - 1)), pa.array(h[keep]), pa.array(n[row[keep]], pa.int32()), pa.array(must[row[keep]], pa.int32())], [group, *within, "hash", "n", "must"])

    shown = reps.select(group, *within, "hs").mapInArrow(kernel, f"{heads}hash long, n int, must int")
    a = shown.select(F.col(group).alias("src"), *within, "hash", F.col("n").alias("n1"), F.col("must").alias("m1"))
    b = shown.select(F.col(group).alias("dst"), *within, "hash", F.col("n").alias("n2"), F.col("must").alias("m2"))
    long = F.least("n1", "n2") >= F.lit(least) * F.greatest("n1", "n2") - 1e-9
    counted = a.join(b, [*within, "hash"]).where(F.col("src") < F.col("dst")).where(long).groupBy("src", "dst").agg(F.count("*").alias("c"), F.max(F.least("m1", "m2")).alias("m"))
    shared = counted.where("c >= m").select("src", "dst")
    both = shared.join(reps.select(F.col(group).alias("src"), F.col("hs").alias("h1")), "src").join(reps.select(F.col(group).alias("dst"), F.col("hs").alias("h2")), "dst")
    union = F.slice(F.array_sort(F.array_union("h1", "h2")), 1, size)
    # the union is bound once, as the only element of an array
    j = F.element_at(F.transform(F.array(union), lambda u: F.size(F.array_intersect(F.array_intersect("h1", "h2"), u)) / F.size(u)), 1)
    pairs = both.select("src", "dst", j.alias("jaccard"))
    distance = F.when(F.col("jaccard") > 0, F.greatest(F.lit(0.0), -F.log(2 * F.col("jaccard") / (1 + F.col("jaccard"))) / k)).otherwise(1.0)
    return pairs.withColumn("distance", distance).where(F.col("distance") <= 1 - ani), members


def similar_pairs(sketch: DataFrame, group: str, k: int = 21, size: int = 1000, ani: float = 0.95, within: DataFrame | None = None) -> DataFrame:
    """(src, dst, jaccard, distance): pairs, src < dst, whose estimated distance
    -ln(2j / (1 + j)) / k is at most 1 - ani; with `within` (group, genus) only pairs of one
    genus are made at all. The estimate takes shared hashes among the `size` smallest of the
    union, which both sketches hold. Classes of equal sketches are compared once, and
    their pairs are written out for all members."""
    lists = sketch.groupBy(group).agg(F.array_sort(F.collect_list("hash")).alias("hs"))
    if within is not None:
        lists = lists.join(within.select(group, "genus").distinct(), group).select(group, "genus", "hs")
    pairs, members = similar_classes(lists, group, k, size, ani)
    a, b = members.select(F.col(group).alias("x"), F.col("class").alias("src")), members.select(F.col(group).alias("y"), F.col("class").alias("dst"))
    across = pairs.join(a, "src").join(b, "dst")
    inside = a.join(b, F.col("src") == F.col("dst")).where("x < y").withColumns({"jaccard": F.lit(1.0), "distance": F.lit(0.0)})
    columns = [F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"), "jaccard", "distance"]
    return across.select(*columns).unionByName(inside.select(*columns))


def greedy_accept(items: DataFrame, pairs: DataFrame, group: str, fixed: str | None = None) -> DataFrame:
    """The items accepted one after another by (score, name) descending within a group,
    each if it has no pair with an accepted one; those where `fixed` holds are accepted
    from the start and not returned. Gives the items with `rank`, 1, 2, ... by group.

    The walk is sequential, so a group is one task; only items and pairs of that group
    are there."""
    both = pairs.select("src", "dst").union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    near = items.select(F.col("name").alias("src")).join(both, "src").groupBy("src").agg(F.collect_set("dst").alias("near"))
    first = F.col(fixed) if fixed else F.lit(False)
    rows = items.withColumn("_fixed", first).join(near, items["name"] == near["src"], "left").select(group, "name", "score", "_fixed", F.coalesce("near", F.array().cast("array<string>")).alias("near"))

    def walk(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["score", "name"], ascending=False)
        taken = set(x.loc[x["_fixed"], "name"])
        out = []
        for r in x[~x["_fixed"]].itertuples():
            if taken.isdisjoint(r.near):
                taken.add(r.name)
                out.append((getattr(r, group), r.name, r.score, len(out) + 1))
        return pd.DataFrame(out, columns=[group, "name", "score", "rank"])

    kinds = dict(items.dtypes)
    return rows.groupBy(group).applyInPandas(walk, f"{group} {kinds[group]}, name {kinds['name']}, score double, rank int")


def representatives(scored: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cluster_id, classification, name, score): the best cluster of each named species,
    then unnamed ones by score that resemble no accepted one of their genus, numbered.
    scored: (name, genus, species, score); the id is the MD5 of the classification."""
    named = best_of_species(scored)
    pool = named.select("genus", "name", "score", F.lit(True).alias("fixed")).unionByName(scored.where("species = 's__'").select("genus", "name", "score", F.lit(False).alias("fixed")))
    fresh = greedy_accept(pool, pairs, "genus", "fixed")
    title = F.concat("genus", F.lit(";s__"), F.expr("substring(regexp_extract(genus, '([^;]*)$', 1), 4)"), F.lit(" "), F.col("rank"))
    out = named.select(F.concat_ws(";", "genus", "species").alias("classification"), "name", "score").unionByName(fresh.select(title.alias("classification"), "name", "score"))
    return out.select(F.md5("classification").alias("cluster_id"), "classification", "name", "score")


def renumbered(assembly: DataFrame, reps: DataFrame) -> DataFrame:
    """(seq_id, seq): sequences of the representatives, named `<cluster_id>.<n>`, n from
    1 in the order of (ordinal) within each cluster. assembly: (name, ordinal, seq)."""
    n = F.row_number().over(Window.partitionBy("cluster_id").orderBy("ordinal"))
    return assembly.join(reps.select("name", "cluster_id"), "name").select(F.concat_ws(".", "cluster_id", n).alias("seq_id"), "seq")


def candidates(files: DataFrame, quality: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Names that are among the files, the passing and the classified: rows of all three."""
    return files.join(quality, "name").join(taxonomy, "name")

