"""Single-copy markers: best hits, marker sets, completeness scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Markers, those of archaea [0, 55) and of bacteria [16, 120).
MARKERS, ARCHAEA, BACTERIA = 120, (0, 55), (16, 120)
EPS = 10 * 2.0**-23
#: Profile accession to marker.
PROFILES = {
    "PF00318.23": 0, "PF01015.21": 1, "PF01090.22": 2, "PF01092.22": 3, "PF01157.21": 4, "PF01172.21": 5,
    "PF20268.1": 5, "PF09377.13": 5, "PF01194.20": 6, "PF01200.21": 7, "PF01269.20": 8, "PF01798.21": 9,
    "PF01866.20": 10, "PF02978.22": 11, "PF03439.16": 12, "PF03876.20": 13, "PF09173.14": 14, "PF09249.14": 15,
    "PF00177.24": 16, "TIGR01029": 16, "PF00252.21": 17, "TIGR01164": 17, "PF00276.20": 18, "PF00281.19": 19,
    "PF00297.25": 20, "PF00312.25": 21, "PF08069.15": 21, "TIGR00952": 21, "PF00347.23": 22, "PF00366.20": 23,
    "PF00380.22": 24, "PF00410.19": 25, "PF00411.19": 26, "PF00416.25": 27, "PF00466.20": 28, "PF00572.21": 29,
    "TIGR01066": 29, "PF00573.22": 30, "PF01025.19": 31, "TIGR00012": 32, "TIGR00064": 33, "TIGR00234": 34,
    "TIGR00337": 35, "TIGR00344": 36, "TIGR00388": 37, "TIGR00389": 37, "TIGR00392": 38, "TIGR00396": 39,
    "TIGR00408": 40, "TIGR00409": 40, "TIGR00414": 41, "TIGR00418": 42, "TIGR00422": 43, "TIGR00435": 44,
    "TIGR00442": 45, "TIGR00468": 46, "TIGR00471": 47, "TIGR00472": 47, "TIGR00575": 48, "TIGR00631": 49,
    "TIGR00755": 50, "TIGR00967": 51, "TIGR01059": 52, "TIGR01063": 53, "TIGR02350": 54,
    "TIGR00001": 55, "TIGR00002": 56, "TIGR00009": 57, "TIGR00019": 58, "TIGR00029": 59, "TIGR00043": 60,
    "TIGR00059": 61, "TIGR00060": 62, "TIGR00061": 63, "TIGR00062": 64, "TIGR00082": 65, "TIGR00086": 66,
    "TIGR00092": 67, "TIGR00115": 68, "TIGR00116": 69, "TIGR00152": 70, "TIGR00158": 71, "TIGR00165": 72,
    "TIGR00166": 73, "TIGR00168": 74, "TIGR00362": 75, "TIGR00420": 76, "TIGR00436": 77, "TIGR00459": 78,
    "TIGR00460": 79, "TIGR00487": 80, "TIGR00496": 81, "TIGR00663": 82, "TIGR00810": 83, "TIGR00855": 84,
    "TIGR00922": 85, "TIGR00959": 86, "TIGR00963": 87, "TIGR00964": 88, "TIGR00981": 89, "TIGR01009": 90,
    "TIGR01011": 91, "TIGR01017": 92, "TIGR01021": 93, "TIGR01024": 94, "TIGR01030": 95, "TIGR01031": 96,
    "TIGR01032": 97, "TIGR01044": 98, "TIGR01049": 99, "TIGR01050": 100, "TIGR01067": 101, "TIGR01071": 102,
    "TIGR01079": 103, "TIGR01169": 104, "TIGR01171": 105, "TIGR01391": 106, "TIGR01393": 107, "TIGR01632": 108,
    "TIGR01953": 109, "TIGR02012": 110, "TIGR02013": 111, "TIGR02027": 112, "TIGR02191": 113, "TIGR02386": 114,
    "TIGR02387": 114, "TIGR02397": 115, "TIGR02432": 116, "TIGR02729": 117, "TIGR03263": 118, "TIGR03594": 119,
}


def profile_table(spark: SparkSession) -> DataFrame:
    """(profile, marker)."""
    return spark.createDataFrame(list(PROFILES.items()), "profile string, marker int")


def above_threshold(hits: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Hits whose score reaches their profile's threshold, or that have none."""
    return hits.join(F.broadcast(thresholds), "profile", "left").where(F.col("threshold").isNull() | (F.col("score") >= F.col("threshold"))).select(hits.columns)


def best_hits(hits: DataFrame) -> DataFrame:
    """(protein, profile, score): the best hit of each protein, the first (by ordinal)
    of equals."""
    top = hits.groupBy("protein").agg(F.max_by(F.struct("profile", "score"), F.struct(F.col("score"), -F.col("ordinal"))).alias("b"))
    return top.select("protein", "b.profile", "b.score")


def sequence_of(protein: Column) -> Column:
    """The sequence that a predicted protein is on: its id without the last three
    `_` fields (fewer, if it has fewer)."""
    parts = F.split(protein, "_")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 3, F.lit(1))), "_")


def seeds(hits: DataFrame, profiles: DataFrame) -> DataFrame:
    """(seq_id, markers): the sorted markers of each sequence's best hits."""
    known = best_hits(hits).join(F.broadcast(profiles), "profile")
    return known.groupBy(sequence_of(F.col("protein")).alias("seq_id")).agg(F.array_sort(F.collect_set("marker")).alias("markers"))


def domain_score(counts: np.ndarray, low: int, high: int) -> tuple[float, float]:
    """(score, recall) of marker counts against the markers of one domain: recall less
    half the share of repeated markers and half the surplus copies."""
    own = counts[low:high]
    unique = np.count_nonzero(own)
    recall = unique / (high - low)
    score = recall - 0.5 * np.sum(own > 1) / (unique + EPS) - 0.5 * (own.sum() - unique) / (high - low)
    return float(score), float(recall)


def marker_score(counts: np.ndarray, by_recall: bool = False) -> tuple[float, float]:
    """The better domain's (score, recall), archaea first on ties."""
    both = (domain_score(counts, *ARCHAEA), domain_score(counts, *BACTERIA))
    return max(both, key=lambda x: x[int(by_recall)])


def scores(members: DataFrame, by: str) -> DataFrame:
    """(by, score, recall) from rows (by, marker), one for each marker copy. Rows are dealt out
    by `by` before they are counted: counting them where they are read holds nearly as many
    groups as there are rows. A number of partitions that is given is not made smaller at run
    time, when few bytes may be many groups."""
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = members.select(by, "marker").repartition(n, by).groupBy(by, "marker").agg(F.count("*").alias("n"))
    out = []
    for name, (low, high) in (("arc", ARCHAEA), ("bac", BACTERIA)):
        inside = (F.col("marker") >= low) & (F.col("marker") < high)
        unique = F.count_if(inside)
        surplus = F.coalesce(F.sum(F.when(inside, F.col("n") - 1)), F.lit(0))
        recall = unique / (high - low)
        out += [(recall - 0.5 * F.count_if(inside & (F.col("n") > 1)) / (unique + F.lit(EPS)) - 0.5 * surplus / (high - low)).alias(f"{name}_score"), recall.alias(f"{name}_recall")]
    wide = counts.groupBy(by).agg(*out)
    # the domain with more recall, archaea on ties
    better = F.col("bac_recall") > F.col("arc_recall")
    pick = lambda c: F.when(better, F.col(f"bac_{c}")).otherwise(F.col(f"arc_{c}")).alias(c)
    return wide.select(by, pick("score"), pick("recall"))


def genome_count(members: DataFrame, by: str) -> DataFrame:
    """(by, genomes): the estimated number of genomes from rows (by, seq_id, marker).

    Markers are counted by how many sequences carry them; the largest multiplicity that
    at least half as many markers have as the most frequent one is the estimate, and 1
    becomes 2 if over five markers are elsewhere."""
    carried = members.groupBy(by, "marker").agg(F.count_distinct("seq_id").alias("k"))
    weights = carried.groupBy(by, "k").agg(F.count("*").alias("w"))
    tops = weights.groupBy(by).agg(F.max("w").alias("top"), F.sum("w").alias("all"), F.sum(F.when(F.col("k") == 1, F.col("w")).otherwise(0)).alias("single"))
    k = F.max(F.when(F.col("w") >= F.col("top") * 0.5, F.col("k")))
    found = weights.join(tops, by).groupBy(by).agg(k.alias("k"), F.max(F.col("all") - F.col("single")).alias("other"))
    return found.select(by, F.when((F.col("k") == 1) & (F.col("other") > 5), 2).otherwise(F.col("k")).cast("long").alias("genomes"))


def carrier_sets(members: DataFrame, by: str) -> DataFrame:
    """(by, carriers): the distinct sets of sequences that share a marker."""
    return members.groupBy(by, "marker").agg(F.array_sort(F.collect_set("seq_id")).alias("carriers")).select(by, "carriers").distinct()
