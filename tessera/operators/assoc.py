"""Association of variants with a phenotype, and the tables behind its plots."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import _written

EPS = 10 * 2.0**-23
#: Calls that are fitted together; a variant's are never parted.
CALLS = 1 << 16
#: Pairs of samples in a step of their distances.
PAIRS = 1 << 18


def usable(variants: DataFrame, abundance: DataFrame) -> DataFrame:
    """Calls of samples whose taxon is there: (..., sample, acgt, abundance)."""
    return variants.where("acgt is not null").join(abundance.where("value > 0").withColumnRenamed("value", "abundance"), ["classification", "sample"])


def allele_of(population: Column) -> Column:
    """The population's major allele, from 0; the first of equals."""
    return (F.array_position(population, F.array_max(population)) - 1).cast("int")


def sample_distance(calls: DataFrame, variant: list[str], sample: str = "sample", value: str = "f") -> DataFrame:
    """(i, j, distance) of all sample pairs that share a variant, both ways and with
    themselves: the root of the mean squared difference of allele frequencies; 0
    becomes 1.

    A variant's row holds its samples, of a number that the study bounds; each task
    adds up one matrix and gives its non-zero cells. Variants of as many samples are
    taken together, in steps of `PAIRS` pairs."""
    rows = calls.groupBy(*variant).agg(F.array_agg(F.struct(F.col(sample).cast("string").alias("s"), F.col(value).cast("double").alias("f"))).alias("c")).select("c")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[str, int] = {}
        total, count = np.zeros((0, 0)), np.zeros((0, 0))
        for batch in batches:
            held = batch.column(0).flatten()
            names = held.field(0).dictionary_encode("encode")
            own = np.array([at.setdefault(s, len(at)) for s in names.dictionary.to_pylist()], np.int64)
            ids, f = own[names.indices.to_numpy()], held.field(1).to_numpy(zero_copy_only=False)
            if len(at) > len(total):
                n = 2 * len(at)
                total, count = (np.pad(m, (0, n - len(m))) for m in (total, count))
            sizes = batch.column(0).value_lengths().to_numpy()
            first = np.cumsum(sizes) - sizes
            for n in np.unique(sizes).tolist():
                starts = first[sizes == n]
                step = max(1, PAIRS // n**2)
                for k in range(0, len(starts), step):
                    here = starts[k : k + step, None] + np.arange(n)
                    i, v = ids[here], f[here]
                    cell = (i[:, :, None] * len(total) + i[:, None, :]).ravel()
                    np.add.at(total.reshape(-1), cell, ((v[:, :, None] - v[:, None, :]) ** 2).ravel())
                    np.add.at(count.reshape(-1), cell, 1.0)
        i, j = np.nonzero(count)
        names = pa.array(list(at), pa.string())
        yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), names.take(pa.array(j)), pa.array(total[i, j]), pa.array(count[i, j])], ["i", "j", "s", "n"])

    sums = rows.mapInArrow(kernel, "i string, j string, s double, n double").groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    d = F.sqrt(F.col("s") / (F.col("n") + EPS))
    return sums.select("i", "j", F.when(d == 0, 1.0).otherwise(d).alias("distance"))


def principal_components(distance: pd.DataFrame, samples: list[str], components: int = 5) -> np.ndarray:
    """The first components of the rows of the distance matrix of `samples`, whose
    number the study bounds; pairs that are missing are 1."""
    at = {s: i for i, s in enumerate(samples)}
    m = np.ones((len(samples), len(samples)))
    for i, j, d in distance[["i", "j", "distance"]].itertuples(index=False):
        if i in at and j in at:
            m[at[i], at[j]] = d
    m = m - m.mean(axis=0)
    u, s, _ = np.linalg.svd(m, full_matrices=False)
    k = min(components, len(samples) - 1)
    return u[:, :k] * s[:k]


def scaled(x: np.ndarray) -> np.ndarray:
    """Columns less their mean over their sample deviation; a constant one is 0."""
    return (x - x.mean(axis=0)) / (x.std(axis=0, ddof=1) + EPS) if len(x) > 1 else np.zeros_like(x)


def fit_glm(x: np.ndarray, y: np.ndarray, binomial: bool, rounds: int = 100, tol: float = 1e-8) -> tuple[float, float, float]:
    """(beta, se, p) of column 1, p by the normal tail; (0, 0, 1) if it can't be fitted."""
    return tuple(fit_glms(x[None], y[None], np.array([len(y)]), binomial, rounds, tol)[0].tolist())


def fit_glms(x: np.ndarray, y: np.ndarray, n: np.ndarray, binomial: bool, rounds: int = 100, tol: float = 1e-8) -> np.ndarray:
    """`fit_glm` of many at once: x (fits, rows, columns), y (fits, rows), the first n
    (fits) of whose rows are data and the others 0; (fits, 3)."""
    out = np.tile((0.0, 0.0, 1.0), (len(x), 1))
    sound = np.flatnonzero((n > 0) & np.isfinite(x).all(axis=(1, 2)) & np.isfinite(y).all(axis=1))
    if not len(sound):
        return out
    try:
        with np.errstate(all="ignore"):
            beta, se = _logistic(x[sound], y[sound], n[sound], rounds, tol) if binomial else _linear(x[sound], y[sound], n[sound])
    except np.linalg.LinAlgError:
        # one that can't be solved must not take the others with it
        if len(sound) > 1:
            out[sound] = [fit_glms(x[[i]], y[[i]], n[[i]], binomial, rounds, tol)[0] for i in sound]
        return out
    fine = np.isfinite(beta) & np.isfinite(se) & (se > 0)
    beta, se = beta[fine], se[fine]
    out[sound[fine]] = np.column_stack((beta, se, [math.erfc(z) for z in np.abs(beta / se) / math.sqrt(2)]))
    return out


def _solved(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(beta, rank) of least squares, the shortest solution where the rank is short."""
    u, s, v = np.linalg.svd(x, full_matrices=False)
    large = s > np.maximum(n, x.shape[2])[:, None] * np.finfo(float).eps * s[:, :1]
    part = np.divide((u.transpose(0, 2, 1) @ y[:, :, None])[:, :, 0], s, out=np.zeros_like(s), where=large)
    return (part[:, None, :] @ v)[:, 0], large.sum(axis=1)


def _spread(x: np.ndarray) -> np.ndarray:
    """Column 1's place on the diagonal of the inverse of x'x."""
    _, s, v = np.linalg.svd(x, full_matrices=False)
    return np.sum(np.divide(v[:, :, 1], s, out=np.zeros_like(s), where=s**2 > 1e-15 * s[:, :1] ** 2) ** 2, axis=1)


def _product(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return (x @ beta[:, :, None])[:, :, 0]


def _linear(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(beta, se) of column 1; se is nan where no row is left over for it."""
    beta, rank = _solved(x, y, n)
    free = n - rank
    error = np.sum((y - _product(x, beta)) ** 2, axis=1)
    return beta[:, 1], np.sqrt(np.where(free > 0, _spread(x) * error / free, np.nan))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """(beta, se) of column 1 by reweighted least squares; se is nan for the separated,
    which have no finite maximum. A fit that has converged takes no part in later rounds."""

    def chance(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_product(x, beta), -30, 30)))

    row = np.arange(x.shape[1]) < n[:, None]
    beta, last, apart = np.zeros((len(x), x.shape[2])), np.full(len(x), math.inf), np.zeros(len(x), bool)
    apart[(y.sum(axis=1) <= 0) | (y.sum(axis=1) >= n)] = True
    live = np.flatnonzero(~apart)
    for step in range(rounds):
        mu = (y[live] + 0.5) / 2 if step == 0 else chance(x[live], beta[live])
        flat = (~row[live] | (np.abs(y[live] - mu) < 1e-6)).all(axis=1)
        apart[live[flat]] = True
        live, mu = live[~flat], mu[~flat]
        if not len(live):
            break
        a, b, r = x[live], y[live], row[live]
        w = np.where(r, np.maximum(mu * (1 - mu), 1e-12), 1)
        root = np.sqrt(w) * r
        beta[live] = _solved(a * root[:, :, None], (np.log(mu / (1 - mu)) + (b - mu) / w) * root, n[live])[0]
        mu = chance(a, beta[live])
        dev = -2 * np.sum(np.where(r, b * np.log(mu) + (1 - b) * np.log(1 - mu), 0), axis=1)
        going = ~(np.abs(dev - last[live]) < tol)
        last[live] = dev
        live = live[going]
    eta, mu = _product(x, beta), chance(x, beta)
    apart |= np.where(row & (y == 1), eta, math.inf).min(axis=1) > np.where(row & (y == 0), eta, -math.inf).max(axis=1)
    se = np.full(len(x), np.nan)
    se[~apart] = np.sqrt(_spread(x[~apart] * (np.sqrt(mu * (1 - mu)) * row)[~apart][:, :, None]))
    return beta[:, 1], se


def glm(calls: DataFrame, phenotype: dict[str, float], covariates: dict[str, list[float]], size: float = 0.5) -> DataFrame:
    """(classification, chrom, pos, allele, beta, se, p) of calls (classification, chrom,
    pos, allele, sample, f, abundance): phenotype on 1 + frequency + abundance +
    covariates; logistic if every phenotype is 0 or 1.

    A variant is tested if enough samples are usable: `size` of each class, or of all.
    Phenotypes and covariates are a value a sample and go with the kernel."""
    binomial = set(phenotype.values()) <= {0.0, 1.0}
    ones = size * sum(v == 1 for v in phenotype.values())
    zeros = size * sum(v == 0 for v in phenotype.values())
    least = size * len(phenotype)
    width = len(next(iter(covariates.values()), []))
    key = ["classification", "chrom", "pos", "allele"]
    samples, values = pd.Index(list(phenotype)), np.array(list(phenotype.values()), float)
    extra = np.array([covariates.get(s, [0.0] * width) for s in phenotype], float).reshape(len(phenotype), width)

    def heads(f: pd.DataFrame) -> np.ndarray:
        """Whether a row's variant is another than that of the row before."""
        new = np.ones(len(f), bool)
        new[1:] = False
        for v in (f[c] for c in key):
            null, v = v.isna().to_numpy(), v.to_numpy()
            new[1:] |= (v[1:] != v[:-1]) & ~(null[1:] & null[:-1])
        return new

    def fitted(f: pd.DataFrame, new: np.ndarray) -> pd.DataFrame:
        at = samples.get_indexer(f["sample"])
        use = at >= 0
        at, variant = at[use], np.cumsum(new)[use] - 1
        y, count = values[at], np.bincount(variant, minlength=new.sum())
        enough = count >= least
        if binomial:
            enough = (np.bincount(variant[y == 0], minlength=len(count)) >= zeros) & (np.bincount(variant[y == 1], minlength=len(count)) >= ones)
        x = np.column_stack((np.ones(len(at)), f["f"].to_numpy(float)[use], f["abundance"].to_numpy(float)[use], extra[at]))
        first, found = np.cumsum(count) - count, np.zeros((len(count), 3))
        # fits of like numbers of rows are stacked: at most twice the rows that they have
        top = 2 ** np.ceil(np.log2(np.maximum(count, 1))).astype(int)
        kept = enough & (count > 0)
        for t in np.unique(top[kept]):
            these = np.flatnonzero(kept & (top == t))
            slot = np.arange(count[these].max())
            own = slot < count[these][:, None]
            rows = (first[these][:, None] + slot)[own]
            xs, ys = np.zeros((*own.shape, x.shape[1])), np.zeros(own.shape)
            xs[own], ys[own] = x[rows], y[rows]
            found[these] = fit_glms(xs, ys, count[these], binomial)
        out = f.loc[new, key][kept].reset_index(drop=True)
        return out.assign(**dict(zip(("beta", "se", "p"), found[kept].T, strict=True)))

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows of a variant are neighbours; the last one held may go on in the next batch
        held: list[pd.DataFrame] = []
        for f in frames:
            held.append(f)
            if sum(map(len, held)) >= CALLS:
                f = pd.concat(held, ignore_index=True)
                new = heads(f)
                cut = int(np.flatnonzero(new)[-1])
                held = [f.iloc[cut:]]
                if cut:
                    yield fitted(f.iloc[:cut], new[:cut])
        f = pd.concat(held, ignore_index=True) if held else pd.DataFrame()
        if len(f):
            yield fitted(f, heads(f))

    kinds = dict(calls.dtypes)
    near = calls.select(*key, "sample", "f", "abundance").repartition(*key).sortWithinPartitions(*key, "sample")
    return near.mapInPandas(kernel, ", ".join(f"{c} {kinds[c]}" for c in key) + ", beta double, se double, p double")


def gaussian_by_sums(rows: DataFrame, by: list[str], x: str, y: str, least: float = 0.0) -> DataFrame:
    """(by, n, beta, se): least squares of y on 1 + x from sums, wholly by partial
    aggregation; groups where x is constant (its squares sum to at most `least`) have
    null beta."""
    sxx, sxy, syy = F.regr_sxx(y, x), F.regr_sxy(y, x), F.regr_syy(y, x)
    s = rows.groupBy(*by).agg(F.regr_count(y, x).alias("n"), sxx.alias("sxx"), sxy.alias("sxy"), syy.alias("syy"))
    ok = (F.col("sxx") > least) & (F.col("n") > 2)
    beta = F.when(ok, F.col("sxy") / F.col("sxx"))
    rest = F.when(ok, F.greatest(F.lit(0.0), F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")))
    return s.select(*by, "n", beta.alias("beta"), F.sqrt(rest / (F.col("n") - 2) / F.col("sxx")).alias("se"))


def significance(tests: DataFrame, alpha: float = 0.05, replication: bool = False, folder: str | None = None) -> DataFrame:
    """Adds `significance`: + where p is at most alpha over the number of tests (alpha
    itself in replication). With `folder` the tests are written there, once; without, they
    are made for their number and again for their rows."""
    if folder:
        tests = _written(tests, folder, "tests")
    if replication:
        return tests.withColumn("significance", F.when(F.col("p") > alpha, "-").otherwise("+"))
    n = tests.agg(F.greatest(F.count("*"), F.lit(1)).alias("_n"))
    return tests.crossJoin(F.broadcast(n)).withColumn("significance", F.when(F.col("p") > F.lit(alpha) / F.col("_n"), "-").otherwise("+")).drop("_n")


def prior_alleles(calls: DataFrame, prior: DataFrame) -> DataFrame:
    """Calls at sites that were significant before, with the allele of then."""
    hits = prior.where("significance = '+'").select("chrom", "pos", F.col("allele").alias("_allele")).dropDuplicates(["chrom", "pos"])
    return calls.drop("allele").join(hits, ["chrom", "pos"]).withColumnRenamed("_allele", "allele")


def complete_cases(phenotype: DataFrame, covariates: DataFrame | None = None) -> DataFrame:
    """(sample, phenotype): samples with a phenotype and no missing covariate."""
    have = phenotype.where("phenotype is not null")
    if covariates is None:
        return have
    whole = covariates.groupBy("sample").agg(F.bool_and(F.col("value").isNotNull()).alias("ok")).where("ok")
    return have.join(whole, "sample", "left_semi")


def clipped_log_p(p: Column, most: float = 20.0) -> Column:
    return -F.log10(F.least(F.lit(1.0), F.greatest(F.lit(10.0**-most), p)))


def qq_points(tests: DataFrame, p: str = "p", most: float = 20.0) -> DataFrame:
    """(p, observed, expected): expected is -log10((rank - 0.5) / n), ranks by rising p.
    Ranks come from range partitions: counts before each, then a rank within."""
    # a number of partitions that is given is not changed at run time: both uses agree
    n = int(tests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = tests.select(p).repartitionByRange(n, p).withColumn("_part", F.spark_partition_id())
    sizes = spread.groupBy("_part").agg(F.count("*").alias("m"))
    ahead = sizes.select("_part", F.coalesce(F.sum("m").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("m").over(Window.partitionBy()).alias("n"))
    ranked = spread.withColumn("r", F.row_number().over(Window.partitionBy("_part").orderBy(p))).join(F.broadcast(ahead), "_part")
    return ranked.select(p, clipped_log_p(F.col(p), most).alias("observed"), (-F.log10((F.col("before") + F.col("r") - 0.5) / F.col("n"))).alias("expected"))


def manhattan(tests: DataFrame, most: float = 20.0) -> DataFrame:
    """Adds `x` (position after all that lies on earlier sequences, by taxon, then
    name) and `y`."""
    last = tests.groupBy("classification", "chrom").agg(F.max("pos").alias("last"))
    w = Window.orderBy("classification", "chrom").rowsBetween(Window.unboundedPreceding, -1)
    offsets = last.select("classification", "chrom", F.coalesce(F.sum("last").over(w), F.lit(0)).alias("offset"))
    return tests.join(offsets, ["classification", "chrom"]).withColumns({"x": F.col("offset") + F.col("pos"), "y": clipped_log_p(F.col("p"), most)}).drop("offset")


def annotate(tests: DataFrame, annotation: DataFrame) -> DataFrame:
    """Adds `annotation` by sequence and position, null where there is none."""
    return tests.join(annotation.select("chrom", "pos", "annotation").dropDuplicates(["chrom", "pos"]), ["chrom", "pos"], "left")
