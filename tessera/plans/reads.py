"""Alignments, depth and pileup, on reads made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals, pileup
from .base import Plans, table

PLANS = Plans()

# a part is a sequence of 500 bases, a line a block on it
_BLOCKS = "blocks AS (SELECT l_partkey AS seq, ((l_suppkey * 7) % 450)::BIGINT AS s, ((l_suppkey * 7) % 450 + l_quantity)::BIGINT AS e FROM lineitem)"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("l_suppkey") * 7) % 450
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("seq"), start.cast("long").alias("start"), (start + F.col("l_quantity")).cast("long").alias("end"), F.lit(500).cast("long").alias("length"))


def _stats_sql(trim: int) -> str:
    n = 500 - 2 * trim
    return f"""WITH {_BLOCKS}, d AS (SELECT seq, i, count(*) AS depth FROM (SELECT seq, unnest(range(greatest(s, {trim}), least(e, {500 - trim}))) AS i FROM blocks) GROUP BY ALL)
SELECT seq, round(sum(depth) / {n}, 9) AS mean, round((sum(depth * depth) - sum(depth)::DOUBLE * sum(depth) / {n}) / {n - 1}, 9) AS variance FROM d GROUP BY 1"""


def _stats(spark: SparkSession, sf_dir: str, trim: int) -> DataFrame:
    d = intervals.depth_stats(_blocks(spark, sf_dir), ["seq"], "length", trim)
    return d.select("seq", F.round("mean", 9).alias("mean"), F.round("variance", 9).alias("variance"))


@PLANS.add(_stats_sql(0))
def interval_depth_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir, 0)


@PLANS.add(_stats_sql(25))
def interval_depth_stats_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir, 25)


@PLANS.add(f"""WITH {_BLOCKS}, e AS (SELECT seq, s AS pos, 1 AS d FROM blocks UNION ALL SELECT seq, e, -1 FROM blocks), n AS (SELECT seq, pos, sum(d) AS d FROM e GROUP BY ALL),
r AS (SELECT seq, pos AS start, lead(pos) OVER w AS "end", (sum(d) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS depth FROM n WINDOW w AS (PARTITION BY seq ORDER BY pos)) SELECT * FROM r WHERE depth > 0 AND "end" IS NOT NULL""")
def interval_depth_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.depth_runs(_blocks(spark, sf_dir), ["seq"]).select("seq", "start", "end", "depth")


@PLANS.add(f"WITH {_BLOCKS} SELECT seq, sum(greatest(0, least(e, 300) - greatest(s, 100)))::BIGINT AS bp FROM blocks GROUP BY 1")
def interval_overlap_bp(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = intervals.clip(F.col("start"), F.col("end"), F.lit(100).cast("long"), F.lit(300).cast("long"))
    return _blocks(spark, sf_dir).groupBy("seq").agg(F.sum(inside).alias("bp"))


# an event is a read; five CIGAR strings, six FLAGs
CIGARS = ("10M", "5M2I5M", "4S20M3D10M", "30M100N20M", "8=2X10M1I")
FLAGS = (0, 16, 4, 256, 1024, 2048)
_READS = """reads AS (SELECT event_id, (event_id * 31 % 5000)::BIGINT AS pos, (event_id % 60)::INT AS mapq, ([0, 16, 4, 256, 1024, 2048])[event_id % 6 + 1] AS flag, event_id % 5 AS kind, (event_id % 9)::INT AS nm FROM events),
kinds AS (SELECT * FROM (VALUES (0, 10, 0), (1, 10, 2), (2, 30, 3), (3, 50, 0), (4, 20, 1)) k(kind, ungapped, gaps)),
j AS (SELECT *, flag & 1796 = 0 AND mapq >= 10 AS ok, ungapped - greatest(0, nm - gaps) >= (ungapped + gaps) * 0.9::DOUBLE AS alike FROM reads JOIN kinds USING (kind))"""


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, i: F.element_at(F.array(*(F.lit(v) for v in values)), (i + 1).cast("int"))
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", (F.col("event_id") * 31 % 5000).alias("pos"), (F.col("event_id") % 60).cast("int").alias("mapq"), pick(FLAGS, F.col("event_id") % 6).alias("flag"),
        intervals.parse_cigar(pick(CIGARS, F.col("event_id") % 5)).alias("cigar"), (F.col("event_id") % 9).cast("int").alias("nm"),
    )


@PLANS.add(f"WITH {_READS} SELECT event_id FROM j WHERE ok AND alike")
def cigar_identity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.accepted(_reads(spark, sf_dir), 10, 0.9).select("event_id")


@PLANS.add(f"""WITH {_READS}, b AS (SELECT * FROM (VALUES (0, 0, 10, 0), (1, 0, 5, 0), (1, 5, 10, 7), (2, 0, 20, 4), (2, 23, 33, 24), (3, 0, 30, 0), (3, 130, 150, 30), (4, 0, 8, 0), (4, 8, 10, 8), (4, 10, 20, 10)) b(kind, s, e, r))
SELECT event_id, pos + s AS "start", pos + e AS "end", r::BIGINT AS "read" FROM j JOIN b USING (kind) WHERE ok AND alike""")
def cigar_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.accepted(_reads(spark, sf_dir), 10, 0.9).select("event_id", F.inline("blocks"))


@PLANS.add(f"""WITH {_READS}, n AS (SELECT * FROM (VALUES (0, 1), (1, 2), (2, 2), (3, 2), (4, 3)) n(kind, k))
SELECT event_id, CASE WHEN flag & 4 <> 0 THEN 0 ELSE 1 END AS mapped, CASE WHEN ok AND alike THEN k ELSE 0 END AS n_blocks FROM j JOIN n USING (kind) WHERE flag & 4 <> 0 OR ok OR flag & 256 = 0""")
def read_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.counted(_reads(spark, sf_dir), 10, 0.9).select("event_id", "mapped", F.size("blocks").alias("n_blocks"))


# a part is a site, a tenth of the suppliers a sample, the return flag a base
_PILE = """b AS (SELECT l_partkey AS site, (l_suppkey % {k})::INT AS sample, translate(l_returnflag, 'ANR', 'ACG') AS base FROM lineitem),
c AS (SELECT site, sample, count(*) FILTER (base = 'A')::DOUBLE AS a, count(*) FILTER (base = 'C')::DOUBLE AS c, count(*) FILTER (base = 'G')::DOUBLE AS g, count(*) FILTER (base = 'T')::DOUBLE AS t FROM b GROUP BY ALL)"""


def _pile(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("site"), (F.col("l_suppkey") % k).cast("int").alias("sample"), F.translate("l_returnflag", "ANR", "ACG").alias("base"))
    return pileup.pileup(rows, ["site"])


@PLANS.add(f"WITH {_PILE.format(k=10)} SELECT * FROM c")
def pileup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pile(spark, sf_dir, 10).select("site", "sample", *(F.get("acgt", F.lit(i)).alias(n) for i, n in enumerate("acgt")))


@PLANS.add(f"WITH {_PILE.format(k=10)} SELECT site, sample, (CASE WHEN a >= greatest(c, g, t) THEN 0 WHEN c >= greatest(g, t) THEN 1 WHEN g >= t THEN 2 ELSE 3 END)::INT AS major FROM c")
def major_allele(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pile(spark, sf_dir, 10).select("site", "sample", pileup.major(F.col("acgt")).alias("major"))


def _sites_sql(k: int, depth: int) -> str:
    f = lambda x: f"CASE WHEN {x} < {depth} THEN 0 ELSE {x} END"
    sums = ", ".join(f"{f(f'sum({b})')} AS p{b}" for b in "acgt")
    left = ", ".join(f"{f(f'c.{b}')} AS {b}" for b in "acgt")
    return f"""WITH {_PILE.format(k=k)}, p AS (SELECT site, {sums} FROM c GROUP BY 1),
l AS (SELECT c.site, c.sample, {left} FROM c), m AS (SELECT l.*, pa, pc, pg, pt, l.a + l.c + l.g + l.t AS n, CASE WHEN pa >= greatest(pc, pg, pt) THEN l.a WHEN pc >= greatest(pg, pt) THEN l.c WHEN pg >= pt THEN l.g ELSE l.t END AS top FROM l JOIN p USING (site)),
s AS (SELECT site, count(*) FILTER (n > 0) AS cov, count(*) FILTER (n > 0 AND top / (n + 10 * pow(2::DOUBLE, -23)) > 0.05::DOUBLE) AS high FROM m GROUP BY 1)
SELECT site, cov::INT AS covered, round(pa / (pa + pc + pg + pt + 10 * pow(2::DOUBLE, -23)), 3) AS fa FROM s JOIN p USING (site) WHERE cov / {k} >= 0.5::DOUBLE AND high / (cov + 10 * pow(2::DOUBLE, -23)) <= 0.99::DOUBLE"""


def _sites(spark: SparkSession, sf_dir: str, k: int, depth: int) -> DataFrame:
    return pileup.sites(_pile(spark, sf_dir, k), ["site"], k, depth)


@PLANS.add(_sites_sql(10, 2).replace("round(pa /", "round(round_even(pa /").replace("-23)), 3)", "-23)), 4), 4)"))
def site_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sites(spark, sf_dir, 10, 2).select("site", F.size("calls").alias("covered"), F.get("population", F.lit(0)).alias("fa"))


@PLANS.add(_sites_sql(5, 1).replace("round(pa /", "round(round_even(pa /").replace("-23)), 3)", "-23)), 4), 4)"))
def site_filters_shallow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sites(spark, sf_dir, 5, 1).select("site", F.size("calls").alias("covered"), F.get("population", F.lit(0)).alias("fa"))
