"""Bins against genomes, markers and representatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import binning, dereplicate, graph, markers
from ..sources.tables import split_program
from .base import Plans, table

PLANS = Plans()
PRECISION, RECALL = [0.95, 0.9, 0.5, 0.3], [0.10, 0.05, 0.03, 0.01]

_CELLS = """cells AS (SELECT l_orderkey AS cluster_id, l_partkey AS genome_id, sum(l_quantity) AS bp FROM lineitem GROUP BY ALL)"""
_BEST = f"""{_CELLS}, g AS (SELECT genome_id, sum(bp) AS genome_bp FROM cells GROUP BY 1), c AS (SELECT cluster_id, sum(bp) AS cluster_bp FROM cells GROUP BY 1),
best AS (SELECT cluster_id, genome_id, bp / genome_bp AS recall, bp / cluster_bp AS precision FROM cells JOIN g USING (genome_id) JOIN c USING (cluster_id)
 QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY bp / genome_bp DESC, genome_id) = 1)"""


def _bins(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A line of an order is a sequence, the order its bin, the part its genome."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cluster_id"), F.col("l_partkey").alias("genome_id"), F.col("l_quantity").alias("length"))
    return rows, rows.select("genome_id", "length")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, truth = _bins(spark, sf_dir)
    cells = rows.groupBy("cluster_id", "genome_id").agg(F.sum("length").alias("bp"))
    return binning.best_match(cells, binning.genome_lengths(truth))


@PLANS.add(f"WITH {_CELLS} SELECT * FROM cells")
def bin_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bins(spark, sf_dir)[0].groupBy("cluster_id", "genome_id").agg(F.sum("length").alias("bp"))


@PLANS.add("""SELECT c.c_mktsegment AS cluster_id, n.n_name AS genome_id, sum(floor(o_totalprice)::BIGINT)::BIGINT AS bp FROM orders o
JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY ALL""")
def bin_strict_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contingency through strict lookups: an id without a partner fails the query."""
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    mapping = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("seq_id"), F.expr("floor(o_totalprice)").alias("length"))
    truth = customers.select(F.col("c_custkey").alias("seq_id"), F.col("c_mktsegment").alias("cluster_id"), F.col("n_name").alias("genome_id"))
    return binning.strict_join(mapping, truth, "seq_id").groupBy("cluster_id", "genome_id").agg(F.sum("length").alias("bp"))


@PLANS.add(f"WITH {_BEST} SELECT cluster_id, genome_id, round(recall, 9) AS recall, round(precision, 9) AS precision FROM best")
def bin_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("cluster_id", "genome_id", F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"))


_GRID = f"""WITH {_BEST}, p AS (SELECT unnest([0.95, 0.9, 0.5, 0.3])::DOUBLE AS precision_t), r AS (SELECT unnest([0.10, 0.05, 0.03, 0.01])::DOUBLE AS recall_t),
grid AS (SELECT precision_t, recall_t, count(*) FILTER (recall >= recall_t AND precision >= precision_t) AS clusters FROM p, r, best GROUP BY ALL)"""


@PLANS.add(f"{_GRID} SELECT * FROM grid")
def bin_threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.threshold_grid(_scores(spark, sf_dir), spark, RECALL, PRECISION)


@PLANS.add(f'{_GRID} SELECT *, lag(clusters, 1, 0) OVER w AS "left", clusters - lag(clusters, 1, 0) OVER w AS width FROM grid WINDOW w AS (PARTITION BY precision_t ORDER BY recall_t DESC)')
def bin_stacked_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.stacked(bin_threshold_grid(spark, sf_dir), ["precision_t"], "recall_t")


_QUALITY = """q AS (SELECT coalesce(lang, 'xx') AS dataset, coalesce(source, 'none') AS program, (doc_id * 37 % 101)::DOUBLE / 100 AS completeness, (doc_id * 13 % 21)::DOUBLE / 100 AS contamination FROM documents),
grid AS (SELECT d.dataset, p.program, contamination_t, completeness_t, count(q.dataset) FILTER (contamination <= contamination_t AND completeness >= completeness_t) AS clusters
 FROM (SELECT DISTINCT dataset FROM q) d CROSS JOIN (SELECT DISTINCT program FROM q) p CROSS JOIN (SELECT unnest([0.05, 0.10])::DOUBLE AS contamination_t) CROSS JOIN (SELECT unnest([0.95, 0.9, 0.8, 0.7])::DOUBLE AS completeness_t)
 LEFT JOIN q ON q.dataset = d.dataset AND q.program = p.program GROUP BY ALL)"""


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("xx")).alias("lang"), F.coalesce("source", F.lit("none")).alias("source"))
    named = docs.select(F.concat_ws(".", "lang", "source", "doc_id").alias("name"), (F.col("doc_id") * 37 % 101).cast("double").alias("completeness"), (F.col("doc_id") * 13 % 21).cast("double").alias("contamination"))
    return split_program(named)


@PLANS.add(f"WITH {_QUALITY} SELECT * FROM grid")
def quality_grid_by_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.quality_grid(_quality(spark, sf_dir), [0.05, 0.10], [0.95, 0.9, 0.8, 0.7])


@PLANS.add("SELECT DISTINCT coalesce(source, 'none') AS program, CASE coalesce(source, 'none') WHEN 'src0' THEN 'main' WHEN 'src1' THEN 'first' ELSE coalesce(source, 'none') END AS label FROM documents")
def program_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.labelled(_quality(spark, sf_dir).select("program").distinct(), spark, {"src0": "main", "src1": "first"})


# a line is a hit: its order the protein, its part the profile
_HITS = "hits AS (SELECT l_orderkey AS protein, l_partkey AS profile, l_linenumber AS ordinal, l_quantity AS score, l_suppkey, l_extendedprice FROM lineitem)"
_TOP = f"{_HITS}, top AS (SELECT protein, profile, score FROM hits QUALIFY row_number() OVER (PARTITION BY protein ORDER BY score DESC, ordinal, profile DESC) = 1)"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("protein"), F.col("l_partkey").alias("profile"), F.col("l_linenumber").alias("ordinal"), F.col("l_quantity").alias("score"))


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    # line numbers may repeat within an order: the profile decides then
    hits = _hits(spark, sf_dir)
    top = hits.groupBy("protein").agg(F.max(F.struct("score", (-F.col("ordinal")).alias("o"), "profile")).alias("b"))
    return top.select("protein", "b.profile", "b.score")


@PLANS.add(f"WITH {_TOP} SELECT * FROM top")
def best_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir)


@PLANS.add(f"WITH {_TOP} SELECT protein % 1000 AS seq_id, list_sort(list(DISTINCT (profile % 120)::INT)) AS markers FROM top GROUP BY 1")
def marker_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _best(spark, sf_dir).select((F.col("protein") % 1000).alias("seq_id"), (F.col("profile") % 120).cast("int").alias("marker"))
    return top.groupBy("seq_id").agg(F.array_sort(F.collect_set("marker")).alias("markers"))


@PLANS.add(f"WITH {_HITS} SELECT h.protein, h.profile, h.ordinal, h.score FROM hits h LEFT JOIN part p ON p.p_partkey = h.profile AND p.p_size > 10 WHERE p.p_size IS NULL OR h.score >= p.p_size")
def profile_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    thresholds = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("profile"), F.col("p_size").cast("double").alias("threshold"))
    return _hits(spark, sf_dir).join(thresholds, "profile", "left").where("threshold is null or score >= threshold").select("protein", "profile", "ordinal", "score")


@PLANS.add("""SELECT event_id, array_to_string((string_split('seq_' || event_id || '_' || event_type || '_10_+', '_'))[1:greatest(len(string_split('seq_' || event_id || '_' || event_type || '_10_+', '_')) - 3, 1)], '_') AS seq_id FROM events""")
def protein_to_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", markers.sequence_of(F.concat(F.lit("seq_"), F.col("event_id").cast("string"), F.lit("_"), "event_type", F.lit("_10_+"))).alias("seq_id"))


_MEMBERS = "m AS (SELECT l_suppkey AS cluster, l_orderkey AS seq_id, (l_partkey % 120)::INT AS marker FROM lineitem)"


def _members(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col(by).alias("cluster"), F.col("l_orderkey").alias("seq_id"), (F.col("l_partkey") % 120).cast("int").alias("marker"))


_SCORES = """c AS (SELECT cluster, marker, count(*) AS n FROM mo GROUP BY ALL),
s AS (SELECT cluster, count(*) FILTER (marker < 55) / 55 AS ar, count(*) FILTER (marker >= 16) / 104 AS br,
 count(*) FILTER (marker < 55) / 55 - 0.5::DOUBLE * count(*) FILTER (marker < 55 AND n > 1) / (count(*) FILTER (marker < 55) + 10 * pow(2::DOUBLE, -23)) - 0.5::DOUBLE * coalesce(sum(n - 1) FILTER (marker < 55), 0) / 55 AS a,
 count(*) FILTER (marker >= 16) / 104 - 0.5::DOUBLE * count(*) FILTER (marker >= 16 AND n > 1) / (count(*) FILTER (marker >= 16) + 10 * pow(2::DOUBLE, -23)) - 0.5::DOUBLE * coalesce(sum(n - 1) FILTER (marker >= 16), 0) / 104 AS b FROM c GROUP BY 1)"""


@PLANS.add(f"WITH mo AS (SELECT l_orderkey AS cluster, (l_partkey % 120)::INT AS marker FROM lineitem), {_SCORES} SELECT cluster, round(CASE WHEN br > ar THEN b ELSE a END, 9) AS score, round(greatest(ar, br), 9) AS recall FROM s")
def marker_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = markers.scores(_members(spark, sf_dir, "l_orderkey"), "cluster")
    return s.select("cluster", F.round("score", 9).alias("score"), F.round("recall", 9).alias("recall"))


@PLANS.add(f"""WITH {_MEMBERS}, k AS (SELECT cluster, marker, count(DISTINCT seq_id) AS k FROM m GROUP BY ALL), w AS (SELECT cluster, k, count(*) AS w FROM k GROUP BY ALL),
t AS (SELECT cluster, max(w) AS top, sum(w) AS al, coalesce(sum(w) FILTER (k = 1), 0) AS one FROM w GROUP BY 1),
g AS (SELECT cluster, max(k) FILTER (w >= top * 0.5::DOUBLE) AS k, max(al - one) AS other FROM w JOIN t USING (cluster) GROUP BY 1)
SELECT cluster, (CASE WHEN k = 1 AND other > 5 THEN 2 ELSE k END)::BIGINT AS genomes FROM g""")
def genome_count_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markers.genome_count(_members(spark, sf_dir, "l_suppkey"), "cluster")


@PLANS.add(f"WITH {_MEMBERS}, k AS (SELECT cluster, marker, list_sort(list(DISTINCT seq_id)) AS carriers FROM m GROUP BY ALL) SELECT DISTINCT cluster, carriers FROM k")
def carrier_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markers.carrier_sets(_members(spark, sf_dir, "l_suppkey"), "cluster")


# parts are clusters: brand the genus, type the species, `s__` where the size is over 40
_SCORED = "sc AS (SELECT 'd__X;g__' || p_brand AS genus, CASE WHEN p_size > 40 THEN 's__' ELSE 's__' || p_type END AS species, 'c' || p_partkey AS name, round(p_size * 2 - 5 * (p_partkey % 7) + 15 * log10(p_retailprice), 6) AS score FROM part)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    species = F.when(F.col("p_size") > 40, "s__").otherwise(F.concat(F.lit("s__"), "p_type"))
    score = dereplicate.cluster_score(F.col("p_size") * 2, F.col("p_partkey") % 7, F.col("p_retailprice"))
    return p.select(F.concat(F.lit("d__X;g__"), "p_brand").alias("genus"), species.alias("species"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("name"), F.round(score, 6).alias("score"))


@PLANS.add(f"WITH {_SCORED} SELECT genus, species, name, score FROM sc WHERE species <> 's__' QUALIFY row_number() OVER (PARTITION BY genus, species ORDER BY score DESC, name DESC) = 1")
def genome_score_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dereplicate.best_of_species(_scored(spark, sf_dir))


@PLANS.add(f"""WITH {_SCORED}, n AS (SELECT genus, name, score, row_number() OVER (PARTITION BY genus ORDER BY score DESC, name DESC) AS rank FROM sc WHERE species = 's__'),
r AS (SELECT genus || ';' || species AS classification, name, score FROM sc WHERE species <> 's__' QUALIFY row_number() OVER (PARTITION BY genus, species ORDER BY score DESC, name DESC) = 1
 UNION ALL SELECT genus || ';s__' || substring(regexp_extract(genus, '([^;]*)$', 1), 4) || ' ' || rank, name, score FROM n)
SELECT md5(classification) AS cluster_id, classification, name, score FROM r""")
def species_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Representatives where nothing is similar: every unnamed one is numbered."""
    none = spark.createDataFrame([], "src string, dst string")
    return dereplicate.representatives(_scored(spark, sf_dir), none)


@PLANS.add("""WITH RECURSIVE e AS (SELECT label AS genus, 'v' || lpad(vec_id::VARCHAR, 12, '0') AS name, vec_id::DOUBLE AS score, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS i FROM embeddings),
near AS (SELECT a.genus, a.i, a.name, a.score, list(b.name) FILTER (b.name IS NOT NULL) AS near FROM e a LEFT JOIN e b ON a.genus = b.genus AND b.i < a.i AND list_dot_product(a.v, b.v) >= 0.5::DOUBLE GROUP BY ALL),
walk AS (SELECT DISTINCT genus, 0::BIGINT AS i, []::VARCHAR[] AS taken FROM e UNION ALL SELECT w.genus, n.i, CASE WHEN list_has_any(w.taken, coalesce(n.near, [])) THEN w.taken ELSE list_append(w.taken, n.name) END FROM walk w JOIN near n ON n.genus = w.genus AND n.i = w.i + 1),
last AS (SELECT genus, arg_max(taken, i) AS taken FROM walk GROUP BY 1), rows AS (SELECT genus, unnest(taken) AS name, unnest(range(1, len(taken) + 1)) AS rank FROM last) SELECT genus, name, score, rank::INT AS rank FROM rows JOIN e USING (genus, name)""")
def greedy_dereplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of a label, by falling id, accepted if no accepted one has a cosine of
    0.5 or more."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("genus"), F.col("vec_id").cast("double").alias("score"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    name = lambda c: F.concat(F.lit("v"), F.lpad(F.col(c).cast("string"), 12, "0"))
    pairs = graph.near_pairs(e, "genus", 0.5).select(name("a").alias("src"), name("b").alias("dst"))
    return dereplicate.greedy_accept(e.select("genus", name("id").alias("name"), "score"), pairs, "genus")


@PLANS.add("""WITH q AS (SELECT s_suppkey AS name, s_acctbal FROM supplier WHERE s_acctbal > 0), f AS (SELECT DISTINCT l_suppkey AS name FROM lineitem WHERE l_returnflag = 'R'),
t AS (SELECT s_suppkey AS name, n_name AS classification FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT name, s_acctbal, classification FROM f JOIN q USING (name) JOIN t USING (name)""")
def candidate_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    quality = supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("name"), "s_acctbal")
    files = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("name")).distinct()
    taxa = supplier.join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("name"), F.col("n_name").alias("classification"))
    return dereplicate.candidates(files, quality, taxa)


@PLANS.add("""SELECT md5(p_brand) || '.' || row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS seq_id, p_name AS seq FROM part""")
def representative_renumbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    reps = p.select(F.col("p_brand").alias("name")).distinct().withColumn("cluster_id", F.md5("name"))
    return dereplicate.renumbered(p.select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("seq")), reps)


@PLANS.add("SELECT l_suppkey AS cluster, lpad(dense_rank() OVER (ORDER BY l_suppkey)::VARCHAR, ceil(log10((SELECT count(DISTINCT l_suppkey) FROM lineitem) + 1))::INT, '0') AS number FROM (SELECT DISTINCT l_suppkey FROM lineitem)")
def cluster_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sinks import numbered

    return numbered(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cluster")))


