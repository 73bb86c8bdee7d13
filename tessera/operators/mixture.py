"""Principal components and a Dirichlet-process mixture of normals."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 10 * 2.0**-23
#: Groups in which the tasks' sums meet before the driver, or the last task, adds them up.
SPREAD = 32


def moments(rows: DataFrame, vector: str, weight: str | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """(sum of weights, weighted sum, weighted sum of outer products): each task adds up
    its rows, SPREAD groups the tasks' d x d matrices, and the driver these."""

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, s, q = 0.0, 0.0, 0.0
        for f in frames:
            if len(f):
                x = np.stack(f[vector].to_numpy()).astype(float)
                u = f[weight].to_numpy(float) if weight else np.ones(len(x))
                w, s, q = w + u.sum(), s + u @ x, q + (x * u[:, None]).T @ x
        if np.ndim(s):
            yield pd.DataFrame({"w": [w], "s": [np.ravel(s)], "q": [np.ravel(q)]})

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"w": [g["w"].sum()], "s": [sum(g["s"])], "q": [sum(g["q"])]})

    kind = "w double, s array<double>, q array<double>"
    parts = rows.select(vector, *([weight] if weight else [])).mapInPandas(kernel, kind)
    parts = parts.groupBy((F.spark_partition_id() % SPREAD).alias("part")).applyInPandas(merge, kind).collect()
    s = sum(np.array(r["s"]) for r in parts)
    return sum(r["w"] for r in parts), s, sum(np.array(r["q"]) for r in parts).reshape(len(s), len(s))


@dataclass
class Components:
    mean: np.ndarray
    axes: np.ndarray  # (k, d)
    ratio: np.ndarray  # share of variance of each kept axis


def principal_axes(rows: DataFrame, vector: str, share: float = 0.9, least: int = 20) -> Components:
    """The axes that hold `share` of the variance, at least `least` of them, none with
    less than 1e-5. Signs: the largest part of each axis is positive."""
    n, s, q = moments(rows, vector)
    mean = s / n
    values, axes = np.linalg.eigh((q - n * np.outer(mean, mean)) / (n - 1))
    values, axes = np.maximum(values[::-1], 0), axes[:, ::-1].T
    ratio = values / values.sum()
    k = min(max(int(np.sum(np.cumsum(ratio) < share)) + 1, least), int(np.sum(ratio >= 1e-5)))
    axes = axes[:k]
    axes = axes * np.sign(axes[np.arange(k), np.abs(axes).argmax(axis=1)])[:, None]
    return Components(mean, axes, ratio[:k])


def project(rows: DataFrame, vector: str, to: str, c: Components) -> DataFrame:
    """Adds the centred projection, array<double>."""
    mean, axes = c.mean, c.axes

    @F.pandas_udf("array<double>")
    def kernel(v: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(v.to_numpy()) - mean) @ axes.T) if len(v) else [])

    return rows.withColumn(to, kernel(vector))


def digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence up to 6 and the asymptotic series from there."""
    x, out = np.array(x, float), 0.0
    for _ in range(6):
        low = x < 6
        out = out - np.where(low, 1 / np.where(low, x, 1.0), 0.0)
        x = np.where(low, x + 1, x)
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def upper_inverse(sigma: np.ndarray) -> tuple[np.ndarray, float]:
    """P with inverse(sigma) = P P', and log |P|^2; the diagonal is raised until sigma is
    positive definite."""
    jitter = 0.0
    while True:
        try:
            lower = np.linalg.cholesky(sigma + jitter * np.eye(len(sigma)))
            break
        except np.linalg.LinAlgError:
            jitter = max(1e-6, 10 * jitter)
    p = np.linalg.solve(lower, np.eye(len(sigma))).T
    return p, 2 * float(np.log(np.diag(p)).sum())


class Mixture:
    """Variational posterior of a stick-breaking mixture; rows have weights."""

    def __init__(self, mu0: np.ndarray, sigma0: np.ndarray, neighbours: int = 5, kappa0: float = 1e-4, add: float = 1e-4):
        self.mu0, self.sigma0, self.neighbours, self.kappa0, self.add = mu0, sigma0, neighbours, kappa0, add
        self.d = len(mu0)

    def update(self, n: np.ndarray, w: np.ndarray, s: np.ndarray, q: np.ndarray, first: bool = False) -> None:
        """From the sums r, rw, rwx and rwxx' of each component."""
        n, w = n + EPS, w + EPS
        self.alpha, self.beta = 1 + n, 1 + np.append(np.cumsum(n[:0:-1])[::-1], 0)
        self.kappa, self.m = self.kappa0 + w, self.d + n
        mean = s / w[:, None]
        self.mu = (s + self.kappa0 * self.mu0) / self.kappa[:, None]
        self.p, self.log_p = [], []
        for k in range(len(n)):
            gap = mean[k] - self.mu0
            sigma = q[k] - w[k] * np.outer(mean[k], mean[k]) + (0 if first else self.sigma0) + self.kappa0 * w[k] / self.kappa[k] * np.outer(gap, gap)
            p, log_p = upper_inverse(sigma / self.m[k] + self.add * np.eye(self.d))
            self.p.append(p)
            self.log_p.append(log_p)

    def log_density(self, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.m)))
        for k, p in enumerate(self.p):
            z = w * (np.square((x - self.mu[k]) @ p).sum(axis=1) + self.d / self.kappa[k])
            out[:, k] = -0.5 * (z + self.d * np.log(self.m[k]) - self.log_p[k] - digamma((self.m[k] - np.arange(self.d)) / 2).sum())
        b = digamma(self.beta)
        return out + digamma(self.alpha) + np.append(0, np.cumsum(b)[:-1]) - np.cumsum(digamma(self.alpha + self.beta))

    def responsibilities(self, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Softmax over each row's few best components, 0 for the others."""
        v = self.log_density(x, w)
        k = min(self.neighbours, v.shape[1])
        cut = np.partition(v, -k, axis=1)[:, [-k]]
        v = np.where(v >= cut, v, -np.inf)
        r = np.exp(v - v.max(axis=1, keepdims=True))
        return r / r.sum(axis=1, keepdims=True)

    def keep(self, used: np.ndarray) -> None:
        for name in ("alpha", "beta", "kappa", "m", "mu"):
            setattr(self, name, getattr(self, name)[used])
        self.p, self.log_p = [self.p[k] for k in used], [self.log_p[k] for k in used]


def _sums(rows: DataFrame, d: int, respond) -> tuple[np.ndarray, ...]:
    """r, rw, rwx, rwxx' by component, and the squared change of responsibilities, over
    rows (x, w, y): every task sums its own, then components are summed across tasks."""

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, w, s, q, moved = None, None, None, None, 0.0
        for f in frames:
            if not len(f):
                continue
            x, u = np.stack(f["x"].to_numpy()).astype(float), f["w"].to_numpy(float)
            r, change = respond(x, u, f["y"].to_numpy())
            if n is None:
                n, w, s, q = np.zeros(r.shape[1]), np.zeros(r.shape[1]), np.zeros((r.shape[1], d)), np.zeros((r.shape[1], d, d))
            ru = r * u[:, None]
            n, w, s, moved = n + r.sum(axis=0), w + ru.sum(axis=0), s + ru.T @ x, moved + change
            for k in np.flatnonzero(ru.any(axis=0)):
                q[k] += (x * ru[:, [k]]).T @ x
        if n is not None:
            yield pd.DataFrame({"k": np.arange(len(n)), "n": n, "w": w, "s": list(s), "q": [v.ravel() for v in q], "moved": np.append(moved, np.zeros(len(n) - 1))})

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [g["k"].iloc[0]], "n": [g["n"].sum()], "w": [g["w"].sum()], "s": [np.sum(np.stack(g["s"].to_numpy()), axis=0)], "q": [np.sum(np.stack(g["q"].to_numpy()), axis=0)], "moved": [g["moved"].sum()]})

    kind = "k long, n double, w double, s array<double>, q array<double>, moved double"
    sums = rows.select("x", "w", "y").mapInPandas(kernel, kind).groupBy("k", F.spark_partition_id() % SPREAD).applyInPandas(merge, kind)
    got = sorted(sums.groupBy("k").applyInPandas(merge, kind).collect(), key=lambda r: r["k"])
    return np.array([r["n"] for r in got]), np.array([r["w"] for r in got]), np.array([r["s"] for r in got]), np.array([r["q"] for r in got]).reshape(len(got), d, d), sum(r["moved"] for r in got)


def cluster(rows: DataFrame, min_weight: float = 2.0, rounds: int = 30, tolerance: float = 1e-3, neighbours: int = 5) -> DataFrame:
    """(id, component) of rows (id, x, w, y): y is a starting label, 0 for none.

    Trains on rows of at least `min_weight` (on all, if none is), from the labelled ones;
    a component that nobody keeps among its best is dropped; rounds end when
    responsibilities hardly change. Then every row gets its most probable component."""
    heavy = rows.where(F.col("w") >= min_weight)
    train = rows if heavy.isEmpty() else heavy
    names = sorted(r[0] for r in train.where("y <> 0").select("y").distinct().collect())
    if not names:
        return rows.select("id", F.lit(0).alias("component"))
    total, s, q = moments(train, "x", "w")
    mu0 = s / total
    n = train.count()
    model = Mixture(mu0, (q - total * np.outer(mu0, mu0)) / max(n - 1, 1), neighbours)
    label = {y: k for k, y in enumerate(names)}

    def start(x: np.ndarray, w: np.ndarray, y: np.ndarray):
        r = np.zeros((len(x), len(label)))
        for i, v in enumerate(y):
            if v in label:
                r[i, label[v]] = 1
        return r, 0.0

    model.update(*_sums(train, model.d, start)[:4], first=True)
    before = None
    for _ in range(rounds):
        now, last = model, before

        def step(x: np.ndarray, w: np.ndarray, y: np.ndarray, now=now, last=last):
            r = now.responsibilities(x, w)
            old = last.responsibilities(x, w) if last is not None else None
            return r, float(np.square(r - old).sum()) if old is not None and old.shape == r.shape else float(len(x))

        counts, w, s, q, moved = _sums(train, model.d, step)
        used = np.flatnonzero(counts > 1e-6)
        before = Mixture(model.mu0, model.sigma0, neighbours)
        before.__dict__.update(model.__dict__)
        before.keep(used)
        model = Mixture(model.mu0, model.sigma0, neighbours)
        model.update(counts[used], w[used], s[used], q[used])
        if moved < tolerance:
            break
    final = model

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({"id": f["id"], "component": final.log_density(np.stack(f["x"].to_numpy()).astype(float), f["w"].to_numpy(float)).argmax(axis=1)})

    kinds = dict(rows.dtypes)
    return rows.select("id", "x", "w").mapInPandas(predict, f"id {kinds['id']}, component int")
