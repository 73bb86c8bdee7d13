"""Sequence text: k-mers, Nx, complements, wrapping. Documents stand in for
sequences, their letters mapped to bases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence
from .base import Plans, spread, table

PLANS = Plans()
LETTERS, BASES = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 2 * "ACGTACGTACGTACGTACGTACGTAC"
_SEQS = f"seqs AS (SELECT doc_id AS seq_id, coalesce(lang, '') AS lang, translate(text, '{LETTERS}', '{BASES}') AS seq FROM documents WHERE text IS NOT NULL)"
_RC = "reverse(translate({0}, 'ACGTacgt', 'TGCAtgca'))"
_COUNTS = f"""{_SEQS}, f AS (SELECT {{by}} AS seq_id, substring(seq, i, 4) AS w FROM (SELECT *, unnest(range(1, length(seq) - 2)) AS i FROM seqs)),
c AS (SELECT seq_id, least(w, {_RC.format("w")}) AS kmer, count(*)::BIGINT AS n FROM f WHERE regexp_full_match(w, '[ACGT]{{{{4}}}}') GROUP BY ALL)"""


def _seqs(spark: SparkSession, sf_dir: str, by: str = "doc_id") -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).where("text is not null")
    return d.select((F.coalesce("lang", F.lit("")) if by == "lang" else F.col(by)).alias("seq_id"), F.translate("text", LETTERS, BASES).alias("seq"))


@PLANS.add(f"WITH {_COUNTS.format(by='seq_id')} SELECT * FROM c")
def kmer4_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.kmer_counts(_seqs(spark, sf_dir))


@PLANS.add(f"""WITH {_COUNTS.format(by='lang')}, a AS (SELECT unnest({sequence.kmer_classes()!r}) AS kmer), t AS (SELECT seq_id, sum(n) AS total FROM c GROUP BY 1)
SELECT t.seq_id, a.kmer, round((coalesce(c.n, 0) + 1::DOUBLE / 136) / (total + 1), 9) AS freq FROM t CROSS JOIN a LEFT JOIN c ON c.seq_id = t.seq_id AND c.kmer = a.kmer""")
def kmer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = sequence.kmer_profile(_seqs(spark, sf_dir, "lang"))
    names = F.array(*(F.lit(c) for c in sequence.kmer_classes()))
    rows = profile.select("seq_id", F.inline(F.arrays_zip(names.alias("kmer"), F.col("profile").alias("freq"))))
    return rows.toDF("seq_id", "kmer", "freq").select("seq_id", "kmer", F.round("freq", 9).alias("freq"))


@PLANS.add(f"WITH {_SEQS} SELECT seq_id, md5({_RC.format('seq')}) AS digest FROM seqs")
def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seqs(spark, sf_dir).select("seq_id", F.md5(sequence.reverse_complement(F.col("seq"))).alias("digest"))


@PLANS.add(f"WITH {_SEQS} SELECT seq_id, md5(rtrim(regexp_replace(regexp_replace(seq, '[ \\t\\n\\x0b\\f\\r]', '', 'g'), '(.{{100}})', '\\1' || chr(10), 'g'), chr(10))) AS digest FROM seqs")
def fasta_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.regexp_replace("seq", r"\s", "")
    return _seqs(spark, sf_dir).select("seq_id", F.md5(sequence.wrapped(plain)).alias("digest"))


def _nx_sql(x: str) -> str:
    return f"""WITH r AS (SELECT coalesce(source, '') AS source, n_chars, sum(n_chars) OVER (PARTITION BY coalesce(source, '') ORDER BY n_chars DESC) AS cum, sum(n_chars) OVER (PARTITION BY coalesce(source, '')) AS total FROM documents)
SELECT source, max(n_chars) AS nx FROM r WHERE cum >= total * {x}::DOUBLE GROUP BY 1"""


def _nx(spark: SparkSession, sf_dir: str, x: float) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("source"), "n_chars")
    return sequence.nx(d, ["source"], "n_chars", x)


@PLANS.add(_nx_sql("0.5"))
def nx50_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nx(spark, sf_dir, 0.5)


@PLANS.add(_nx_sql("0.9"))
def nx90_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nx(spark, sf_dir, 0.9)


@PLANS.add("SELECT doc_id, n_chars FROM documents WHERE n_chars >= 1000 OR doc_id IN (SELECT doc_id FROM labels)")
def length_or_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences that are long enough, or seeds."""
    seeds = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("seed", F.lit(True))
    return table(spark, sf_dir, "documents").join(seeds, "doc_id", "left").where("n_chars >= 1000 or seed").select("doc_id", "n_chars")


@PLANS.add("SELECT doc_id FROM (SELECT doc_id FROM documents JOIN labels USING (doc_id) ORDER BY n_chars DESC, doc_id LIMIT 100)")
def longest_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is the limit: the longest seeds."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    return d.orderBy(F.desc("n_chars"), "doc_id").limit(100).select("doc_id")
