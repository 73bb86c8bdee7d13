"""Language identification by nearest centroid.

A text is a TF-IDF vector of hashed character bigrams and trigrams (over lowered
letters, each word with its edges), of unit length. The document frequencies are
counted over all training documents. From a bounded sample, spherical k-means
makes several centroids for each language; a text takes the language of the
centroid with the highest cosine. A text farther from its centroid than nearly all
of that centroid's members is marked `rejected`.

Edge cases: a null text, or one without a letter, is `und` with score 0; short
texts are scored like any other; repeated rows and null ids are scored one by one;
training rows without a language are left out, and without any training row all is
`und`. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SAMPLE_GRAIN, map_texts

#: Hashed n-grams; training documents of a language that clustering takes at most,
#: about; centroids of a language; share of a centroid's members beyond its radius.
DIM, PER_LANGUAGE, CENTROIDS, OUTSIDE = 4096, 800, 4, 0.005
UNDETERMINED = "und"
#: Anything but letters and marks beyond ASCII becomes a blank.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BLANKS = re.compile(rb" {2,}")


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams that occur, and how often."""
    data = _BLANKS.sub(b" ", b" " + text.lower().encode("utf-8", "replace").translate(_LETTERS) + b" ")
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(263) + b[2:] + np.uint32(70001)
    both = np.concatenate((two, three)) * np.uint32(2654435761)
    count = np.bincount(both >> np.uint32(32 - 12), minlength=DIM)
    at = np.flatnonzero(count)
    return at, count[at].astype(float)


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, v = grams(text)
    v = v * idf[at]
    return at, v / max(float(np.sqrt((v * v).sum())), 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # (n, DIM)
    owner: np.ndarray  # each centroid's language
    radius: np.ndarray  # the least cosine that is not rejected


def cluster(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means of unit rows: centroids, and each row's."""
    rng = np.random.default_rng(seed)
    c = x[rng.integers(len(x))][None, :]
    while len(c) < min(k, len(x)):
        far = np.maximum(1 - (x @ c.T).max(axis=1), 0)
        c = np.vstack((c, x[rng.choice(len(x), p=far / far.sum()) if far.sum() > 1e-9 else 0]))
    home = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        home = (x @ c.T).argmax(axis=1)
        for i in range(len(c)):
            if (home == i).any():
                m = x[home == i].sum(axis=0)
                c[i] = m / max(np.linalg.norm(m), 1e-12)
    return c, home


def fit(docs: DataFrame, train: Column) -> Model | None:
    """Learns from the rows of `docs` (doc_id, text, lang) where `train` holds."""
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, seen = np.zeros(DIM, np.int64), {}
        for b in batches:
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                df[grams(t)[0]] += 1
                seen[lang] = seen.get(lang, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([None] * DIM + list(seen), pa.string()), pa.array(np.append(np.arange(DIM), [-1] * len(seen)), pa.int64()), pa.array(np.append(df, list(seen.values())), pa.int64())], ["lang", "at", "n"])

    counted = rows.select("text", "lang").transform(map_texts, frequencies, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).collect()
    df, languages = np.zeros(DIM), {}
    for r in counted:  # DIM rows, and one for each language
        if r["lang"] is None:
            df[r["at"]] = r["n"]
        else:
            languages[r["lang"]] = r["n"]
    if not languages:
        return None
    n = sum(languages.values())
    idf = np.log((n + 1) / (df + 1)) + 1

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [vector(t, idf) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([a.astype(np.uint16).tobytes() for a, _ in x], pa.binary()), pa.array([v.astype(np.float16).tobytes() for _, v in x], pa.binary())], ["doc_id", "lang", "at", "v"])

    share = F.lit(0)
    for lang, rows_of in sorted(languages.items()):
        share = F.when(F.col("lang") == lang, int(SAMPLE_GRAIN * min(1.0, PER_LANGUAGE / rows_of))).otherwise(share)
    picked = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(SAMPLE_GRAIN)) < share)
    got = picked.select("doc_id", "text", "lang").transform(map_texts, vectors, "doc_id long, lang string, at binary, v binary").toArrow().sort_by([("lang", "ascending"), ("doc_id", "ascending")])
    names = got.column("lang").to_numpy(zero_copy_only=False)
    out: list[tuple[np.ndarray, int, float]] = []
    kept = sorted(languages)
    for i, lang in enumerate(kept):
        own = np.flatnonzero(names == lang)
        x = np.zeros((len(own), DIM), np.float32)
        for j, k in enumerate(own.tolist()):
            x[j, np.frombuffer(got.column("at")[k].as_py(), np.uint16)] = np.frombuffer(got.column("v")[k].as_py(), np.float16)
        if not len(x):
            continue
        c, home = cluster(x, CENTROIDS)
        cosine = (x * c[home]).sum(axis=1)
        out += [(c[j], i, float(np.quantile(cosine[home == j], OUTSIDE)) if (home == j).any() else 1.0) for j in range(len(c))]
    if not out:
        return None
    return Model(kept, idf, np.stack([o[0] for o in out]), np.array([o[1] for o in out]), np.array([o[2] for o in out]))


def predict(docs: DataFrame, model: Model | None, block: int = 256) -> DataFrame:
    """doc_id, lang_pred, score (cosine) and rejected of each document."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            names, scores, outside = [], [], []
            for cut in range(0, len(texts), block):
                part = texts[cut : cut + block]
                known = [t is not None and model is not None and has_letter(t) for t in part]
                x = np.zeros((len(part), DIM), np.float32)
                for i, t in enumerate(part):
                    if known[i]:
                        at, v = vector(t, model.idf)
                        x[i, at] = v
                cosine = x @ model.centroids.T if model is not None else np.zeros((len(part), 1))
                best = cosine.argmax(axis=1)
                for i, j in enumerate(best.tolist()):
                    s = float(min(1.0, max(0.0, cosine[i, j]))) if known[i] else 0.0
                    names.append(model.languages[model.owner[j]] if known[i] else UNDETERMINED)
                    scores.append(s)
                    outside.append(not known[i] or s < float(model.radius[j]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(outside, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(map_texts, kernel, "doc_id long, lang_pred string, score double, rejected boolean")
