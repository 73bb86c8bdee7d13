"""Document quality by attention-based multiple-instance learning (Ilse et al. 2018).

A document is a bag of passages of `PASSAGE` words. Every passage is encoded: its
measurements pass through a learned tanh layer. Gated attention, learned from the
documents' labels alone, weighs the passages; the weighted sum of the encodings
is scored by a logistic unit. Training is Adam on a bounded, class-balanced sample
of labelled documents; the logit is then shifted back to the classes' true odds.

Edge cases: a null or wordless text is one empty passage and gets a score like any
other; a null doc_id or label trains nothing but is scored; repeated rows are
scored one by one; without both classes in the sample every score is the share of
label 1 (0.5 without labels). All columns pass through `score_documents`; a column named
score or predicted is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SAMPLE_GRAIN, WORD, labelled_sample, map_texts, materialize, others

#: Words in a passage; labelled documents of each class that training takes at most, about;
#: passages that these may have together, about.
PASSAGE, PER_CLASS, PASSAGES = 100, 2500, 100_000
#: Character classes: blank, newline, small, capital, digit, beyond ASCII, then marks.
_CLASS = np.zeros(256, np.uint8)
for _b in range(256):
    _CLASS[_b] = 1 if _b == 10 else 0 if _b <= 32 else 2 if 97 <= _b <= 122 else 3 if 65 <= _b <= 90 else 4 if 48 <= _b <= 57 else 5 if _b >= 128 else 6
for _i, _marks in enumerate((b".,;:", b"!?", b"#*$%&", b"|<>", b"\"'()-", b"=+_/\\@~^[]{}`")):
    for _b in _marks:
        _CLASS[_b] = 6 + _i
KINDS = 12
#: What parts words; other control characters are letters of a word.
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Class bigrams, and what is measured on words.
WIDTH = KINDS * KINDS + 8


def passages(text: bytes | None) -> np.ndarray:
    """Measurements of each passage, (passages, WIDTH) float32."""
    data = text or b""
    raw = np.frombuffer(data, np.uint8)
    kind, ink = _CLASS[raw], ~_BLANK[raw]
    start = np.flatnonzero(ink & ~np.concatenate(([False], ink[:-1]))) if len(kind) else np.zeros(0, np.int64)
    words = data.lower().split()
    n = max(1, -(-len(words) // PASSAGE))
    out = np.zeros((n, WIDTH), np.float32)
    if not words:
        return out
    begin = np.zeros(n, np.int64)
    begin[1:] = start[PASSAGE::PASSAGE]
    part = np.searchsorted(begin, np.arange(len(kind)), side="right") - 1
    size = np.diff(np.append(begin, len(data))).clip(1)
    pair = part[1:] * (KINDS * KINDS) + kind[:-1].astype(np.int64) * KINDS + kind[1:]
    if len(pair):
        counts = np.bincount(pair, minlength=n * KINDS * KINDS).reshape(n, -1)
        out[:, : KINDS * KINDS] = np.sqrt(counts / size[:, None])
    for p in range(n):
        own = words[p * PASSAGE : (p + 1) * PASSAGE]
        m = len(own)
        repeats = sum(a == b for a, b in zip(own, own[1:]))  # noqa: B905
        triples = m - 2 - len(set(zip(own, own[1:], own[2:]))) if m > 2 else 0  # noqa: B905
        long = sum(len(w) > 15 for w in own)
        out[p, KINDS * KINDS :] = (len(set(own)) / m, repeats / m, triples / m, long / m, min(1.0, size[p] / m / 20), m / PASSAGE, min(1.0, n / 50), 1.0)
    return out


class Attention:
    """Gated attention over encoded passages."""

    def __init__(self, width: int, hidden: int = 32, gate: int = 16, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.shift = np.zeros(width), np.ones(width), 0.0
        init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"W": init(width, hidden), "b": np.zeros(hidden), "V": init(hidden, gate), "U": init(hidden, gate), "w": init(gate), "c": init(hidden), "d": np.zeros(1)}

    def forward(self, x: np.ndarray, first: np.ndarray):
        """The bags' logits, and what the gradient needs; first: each bag's first row."""
        p = self.p
        bag = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (t * g) @ p["w"]
        a = np.exp(a - np.maximum.reduceat(a, first)[bag])
        a /= np.add.reduceat(a, first)[bag]
        r = np.add.reduceat(a[:, None] * h, first, axis=0)
        return r @ p["c"] + p["d"][0], (bag, z, h, t, g, a, r)

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = 30, rate: float = 3e-3, batch: int = 64, decay: float = 1e-4, seed: int = 0) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        rng, step = np.random.default_rng(seed), 0
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        size = np.diff(np.append(first, len(x)))
        for _ in range(epochs):
            for bags in np.array_split(rng.permutation(len(first)), max(1, len(first) // batch)):
                rows = np.concatenate([np.arange(first[b], first[b] + size[b]) for b in bags])
                start = np.cumsum(size[bags]) - size[bags]
                logit, (bag, z, h, t, g, a, r) = self.forward(x[rows], start)
                e = (1 / (1 + np.exp(-logit)) - y[bags]) / len(bags)
                p, grad = self.p, {}
                grad["c"], grad["d"] = r.T @ e, np.array([e.sum()])
                dr = e[:, None] * p["c"][None, :]
                da = (dr[bag] * h).sum(axis=1)
                ds = a * (da - np.add.reduceat(a * da, start)[bag])
                grad["w"] = (t * g).T @ ds
                dt = ds[:, None] * p["w"] * g * (1 - t * t)
                dg = ds[:, None] * p["w"] * t * g * (1 - g)
                grad["V"], grad["U"] = h.T @ dt, h.T @ dg
                dh = (a[:, None] * dr[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
                grad["W"], grad["b"] = z.T @ dh, dh.sum(axis=0)
                step += 1
                for k, v in grad.items():
                    v = v + decay * p[k]
                    m1[k] = 0.9 * m1[k] + 0.1 * v
                    m2[k] = 0.999 * m2[k] + 0.001 * v * v
                    p[k] = p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)

    def scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x, first)[0] + self.shift, -40, 40)))


class Constant:
    """Where there is nothing to learn from."""

    def __init__(self, share: float):
        self.share = share

    def scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.full(len(first), self.share)


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", per_class: int = PER_CLASS, passages_: int = PASSAGES) -> Attention | Constant:
    """A model of `label`, from at most about `per_class` labelled documents a class, and
    fewer if these have more than `passages_` passages."""
    picked, counts = labelled_sample(docs, labels, label, train, per_class)
    picked = materialize(picked.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label"), "labelled")
    of = F.ceil(F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) / PASSAGE)
    for r in picked.groupBy("label").agg(F.sum(F.greatest(of, F.lit(1))).alias("n")).collect():
        if r["n"] > passages_:
            share = int(SAMPLE_GRAIN * passages_ / r["n"])
            picked = picked.where((F.col("label") != r["label"]) | (F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(SAMPLE_GRAIN)) < share))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [passages(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary())], ["doc_id", "label", "x"])

    total = counts.get(0, 0) + counts.get(1, 0)
    rows = picked.transform(map_texts, kernel, "doc_id long, label int, x binary").toArrow().sort_by("doc_id")
    y = rows.column("label").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return Constant(counts.get(1, 0) / total if total else 0.5)
    bags = [np.frombuffer(v, np.float16).reshape(-1, WIDTH).astype(np.float32) for v in rows.column("x").to_pylist()]
    size = np.array([len(b) for b in bags])
    model = Attention(WIDTH)
    model.fit(np.concatenate(bags), np.cumsum(size) - size, y)
    model.shift = float(np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return model


def score_documents(docs: DataFrame, model: Attention | Constant, threshold: float = 0.7, keep: bool = False) -> DataFrame:
    """Adds score and predicted (1 at `threshold` or above) to all columns; with
    `keep` gives the documents predicted 1 as they came instead."""
    docs = docs if keep else docs.select(*others(docs, ["score", "predicted"]))
    at = [c.lower() for c in docs.columns].index("text")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            found = []
            texts = b.column(at).cast(pa.binary()).to_pylist()
            for cut in range(0, len(texts), 256):
                x = [passages(t) for t in texts[cut : cut + 256]]
                size = np.array([len(v) for v in x])
                found.append(model.scores(np.concatenate(x), np.cumsum(size) - size))
            s = np.concatenate(found)
            if keep:
                yield b.filter(pa.array(s >= threshold))
            else:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*b.schema.names, "score", "predicted"])

    if keep:
        return docs.transform(map_texts, kernel, docs.schema)
    return docs.transform(map_texts, kernel, T.StructType(docs.schema.fields + T.StructType().add("score", "double").add("predicted", "integer").fields))
