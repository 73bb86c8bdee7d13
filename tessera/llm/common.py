"""Shared plumbing of the text operators: folders, folds, samples, tables."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kernels travel to the executors by value, so workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: Tables of at most this many rows may be broadcast; beyond it they are shuffled.
BROADCAST_ROWS = 200_000
#: Rows of an Arrow batch that holds texts.
TEXT_ROWS = 1000
#: Word characters for `[^\x20\x09-\x0D]+`, as Java and SQL patterns take it.
WORD = r"[^\x20\x09-\x0D]+"
#: The resolution of hash thresholds when a bounded sample is taken.
SAMPLE_GRAIN = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where it is unset, a
    temporary one on a local master, as in tests; an error on any other, since nodes do
    not share such a folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        named = spark.sparkContext.getCheckpointDir() or ""
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all nodes share")
        named = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes `df` as Parquet in the shared folder and reads it again: lineage
    ends here, and a lost executor costs nothing that was written."""
    path = f"{shared_dir(df.sparkSession)}/tessera-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def others(df: DataFrame, added: list[str]) -> list[Column]:
    """The columns of `df` but those that an operator adds: the rule for clashing names
    is that an added column replaces the input's of the same name (in any case, as Spark
    takes names)."""
    fixed = df.sparkSession.conf.get("spark.sql.caseSensitive", "false") == "true"
    plain = (lambda c: c) if fixed else str.lower
    taken = {plain(c) for c in added}
    return [F.col(quoted(c)) for c in df.columns if plain(c) not in taken]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def pack(df: DataFrame, *more: Column) -> DataFrame:
    """(document, more): all columns of `df` in one struct, so that no working column
    beside it can clash with one of them."""
    return df.select(F.struct(*(F.col(quoted(c)) for c in df.columns)).alias("document"), *more)


def map_texts(df: DataFrame, kernel, schema) -> DataFrame:
    """mapInArrow over rows that hold whole texts. Spark's own batches may hold 10,000
    texts; the kernel gets slices of TEXT_ROWS, so that what it makes of them is small.
    The session's settings stay as they are; its spark.sql.execution.arrow.maxBytesPerBatch
    (64 MB by default) bounds the batches themselves."""

    def sliced(batches):
        return kernel(b.slice(at, TEXT_ROWS) for b in batches for at in range(0, max(1, b.num_rows), TEXT_ROWS))

    return df.mapInArrow(sliced, schema)


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks `df` for broadcast if its counted rows are within the limit."""
    return F.broadcast(df) if rows <= limit else df


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(k)


def held_out(doc_id: Column, k: int, remainder: int) -> Column:
    """Whether the id falls in the held-out fold; a null id never does."""
    return F.coalesce(fold(doc_id, k) == F.lit(remainder), F.lit(False))


def bounded_sample(df: DataFrame, key: str, by: str, per_value: int, values: dict, seed: int = 7) -> DataFrame:
    """About `per_value` rows for each value of `by`, chosen by a hash of the
    key, so that reruns take the same rows. `values`: rows there are of each."""
    keep = F.lit(False)
    for value, rows in sorted(values.items()):
        share = int(SAMPLE_GRAIN * min(1.0, per_value / max(rows, 1)))
        keep = keep | ((F.col(by) == F.lit(value)) & (F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(SAMPLE_GRAIN)) < share))
    return df.where(keep)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int, seed: int = 7) -> tuple[DataFrame, dict]:
    """Documents with a label of the training fold, at most about `per_class` of
    each class: (doc_id, text, label), and the class counts before sampling.
    Only the sampled ids, of bounded number, are sent to every executor."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & train)
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = bounded_sample(rows, "doc_id", "label", per_class, counts, seed)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), counts
