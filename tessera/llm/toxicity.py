"""Toxicity by weak supervision.

Voters (curated lexicons, lexicons found in labelled rows, patterns) vote +1, 0 or
-1 on each document. A generative label model with a hidden class is fitted by
expectation-maximisation to the counts of vote patterns over all training
documents; voters that go together more than the class explains have their votes
weighed down by the correlation. A linear classifier is trained on the label
model's posteriors of a bounded sample, and its logit is put on the scale of the
labels (Platt 1999).

Edge cases: a null or empty text has no hits and gets the score of such; repeated
rows are scored one by one; a null id or label trains nothing; without both labels
the posteriors stand uncalibrated. Other columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, map_texts, materialize

#: Labelled documents of each class taken at most, about; learned words and stems.
PER_CLASS, LEARNED_WORDS, LEARNED_STEMS = 4000, 400, 200
#: A learned entry: log-likelihood ratio and ratio of rates at least; stems' bytes.
LEAST_G2, LEAST_RATIO, STEMS = 20.0, 8.0, (4, 5)
#: Hashes of a document's signature; share of word pairs in common from which a labelled
#: document is a copy.
SIGNS, COPY = 128, 0.5

#: Curated lexicons, lowered.
LEXICONS = {
    "insult": "idiot moron imbecile loser fool jerk clown scum trash vermin filth parasite coward creep freak pig rat weasel scumbag dumbass bastard".split(),
    "slight": "stupid dumb pathetic worthless disgusting ugly useless ridiculous miserable despicable vile repulsive brainless clueless incompetent gutless".split(),
    "threat": "kill murder strangle stab shoot hang burn hurt".split(),
    "profanity": "damn shit crap ass bitch fuck fucking bullshit".split(),
    "hate": "hate despise loathe detest subhuman inferior".split(),
    "foreign": "trottel dumm abschaum versager idioten widerlich wertlos crétin stupide ordure minable imbécile dégoûtant idiota estúpido basura imbécil asqueroso inútil".split(),
}
#: Words that address somebody.
ADDRESS = frozenset(b"you your youre u du ihr dich tu te vous toi usted eres".split())
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
CURATED = {w.encode(): name for name, ws in LEXICONS.items() for w in ws}
#: Voters, in the order of a vote pattern.
VOTERS = (*LEXICONS, "insults", "addressed", "shouted", "learned0", "learned1", "learned2", "stem", "stems", "dense", "nothing")


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


@dataclass
class Lexicon:
    """Learned words and stems, and the index of each feature of the classifier."""

    learned: list[bytes] = field(default_factory=list)
    stems: list[bytes] = field(default_factory=list)

    def index(self) -> None:
        self.word_at = {w: i for i, w in enumerate(dict.fromkeys([*CURATED, *self.learned]))}
        self.stem_at = {s: len(self.word_at) + i for i, s in enumerate(self.stems)}
        self.width = len(self.word_at) + len(self.stem_at) + len(VOTERS)
        self.known = frozenset(self.learned)

    def look(self, text: bytes | None) -> tuple[dict[int, int], str]:
        """Hits by feature, and the vote pattern."""
        ws = words(text)
        counts = Counter(ws)
        hits = {self.word_at[w]: counts[w] for w in self.word_at.keys() & counts.keys()}
        by = Counter()
        for w in CURATED.keys() & counts.keys():
            by[CURATED[w]] += counts[w]
        stems = 0
        if self.stem_at:
            for w, n in counts.items():
                for k in STEMS:
                    at = self.stem_at.get(w[:k]) if len(w) > k else None
                    if at is not None:
                        hits[at] = hits.get(at, 0) + n
                        stems += n
                        break
        learned = [0, 0, 0]
        for w in self.known & counts.keys():
            learned[zlib.crc32(w) % 3] += counts[w]
        bad = {w for w in CURATED.keys() & counts.keys() if CURATED[w] in ("insult", "slight", "foreign")} | (self.known & counts.keys())
        near = bool(bad and ADDRESS & counts.keys()) and any(w in bad and not ADDRESS.isdisjoint(ws[max(0, i - 3) : i]) for i, w in enumerate(ws))
        shouted = bool(bad and text) and any(w.upper() in text or w + b"!" in text.lower() for w in bad)
        total = sum(by.values()) + sum(learned) + stems
        votes = [1 if by[name] else 0 for name in LEXICONS]
        votes += [int(by["insult"] + by["slight"] >= 3), int(near), int(shouted), *(int(x > 0) for x in learned), int(stems > 0), int(stems >= 3), int(total > 0 and total >= 0.01 * len(ws)), 0 if total else -1]
        return hits, "".join("-0+"[v + 1] for v in votes)


def signature(text: bytes | None) -> np.ndarray:
    """The least hashes of a text's pairs of neighbouring words, by SIGNS functions; two
    texts agree in about the share of pairs that they have in common."""
    ws = words(text)
    pairs = {b" ".join(p) for p in zip(ws, ws[1:], strict=False)} or set(ws)
    if not pairs:
        return np.zeros(SIGNS, np.uint32)
    h = np.fromiter(map(zlib.crc32, pairs), np.uint64, len(pairs))
    rng = np.random.default_rng(5)
    odd, add = rng.integers(1, 1 << 63, SIGNS, np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, SIGNS, np.uint64)
    return np.array([((h * x + y) >> np.uint64(32)).min() for x, y in zip(odd, add, strict=True)], np.uint32)


def distinct_texts(sample: DataFrame) -> DataFrame:
    """The bounded sample without copies: a document is left out if one that stays, with
    its label, has at least COPY of its pairs of words in common with it. Words of a copied
    text would otherwise count as if many authors used them."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            signs = [signature(t).tobytes() for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(signs, pa.binary())], ["row", "doc_id", "label", "signs"])

    rows = materialize(sample.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("label").cast("int").alias("label")), "tox-labelled")
    signed = rows.transform(map_texts, sign, "row long, doc_id long, label int, signs binary").toArrow().sort_by([("label", "ascending"), ("doc_id", "ascending"), ("row", "ascending")])
    held: dict[int, tuple[np.ndarray, int]] = {}
    stay = []
    for row, label, signs in zip(signed.column("row").to_pylist(), signed.column("label").to_pylist(), signed.column("signs").to_pylist(), strict=True):
        own = np.frombuffer(signs, np.uint32)
        seen, n = held.get(label) or (np.zeros((signed.num_rows, SIGNS), np.uint32), 0)
        if not n or (seen[:n] == own).mean(axis=1).max() < COPY:
            seen[n], n = own, n + 1
            stay.append((row,))
        held[label] = seen, n
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(stay, "row long")), "row").select("doc_id", "text", "label")


def learn_lexicon(sample: DataFrame, counts: dict) -> Lexicon:
    """Words and stems that labelled toxic documents have far more often."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t, y in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = set(words(t))
                seen.update((0, w, y) for w in own if len(w) <= 40)
                seen.update((k, s, y) for k in STEMS for s in {w[:k] for w in own if len(w) > k})
                seen[-1, b"", y] += 1
        rows = list(seen.items())
        yield pa.RecordBatch.from_arrays([pa.array([k for (k, _, _), _ in rows], pa.int64()), pa.array([w for (_, w, _), _ in rows], pa.binary()), pa.array([n * (y == 0) for (_, _, y), n in rows], pa.int64()), pa.array([n * (y == 1) for (_, _, y), n in rows], pa.int64())], ["size", "word", "clean", "toxic"])

    stats = sample.select("text", "label").transform(map_texts, kernel, "size long, word binary, clean long, toxic long").groupBy("size", "word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    stats = materialize(stats, "tox-words")
    total = stats.where("size = -1").first()
    out = Lexicon()
    if total and total["clean"] and total["toxic"]:
        n0, n1 = float(total["clean"]), float(total["toxic"])
        e = lambda n: n / (n0 + n1) * (F.col("toxic") + F.col("clean"))
        part = lambda o, x: F.when(o > 0, o * F.log(o / x)).otherwise(0.0)
        g2 = 2 * (part(F.col("toxic"), e(n1)) + part(F.col("clean"), e(n0)))
        ratio = ((F.col("toxic") + 0.5) / (n1 + 1)) / ((F.col("clean") + 0.5) / (n0 + 1))
        best = stats.where("size >= 0").withColumns({"g2": g2, "ratio": ratio}).where((F.col("g2") >= LEAST_G2) & (F.col("ratio") >= LEAST_RATIO))
        take = lambda c, n: [bytes(r["word"]) for r in best.where(c).orderBy(F.desc("g2"), "word").limit(n).collect()]
        out.learned, out.stems = take("size = 0", LEARNED_WORDS), take("size > 0", LEARNED_STEMS)
    out.index()
    return out


@dataclass
class LabelModel:
    posterior: dict[str, float]
    accuracy: dict[str, float]
    weight: np.ndarray
    correlation: np.ndarray


def label_model(patterns: dict[str, int], share: float, rounds: int = 40) -> LabelModel:
    """Fits accuracies and correlations to counts of vote patterns; share: prior of class 1."""
    keys = sorted(patterns)
    v = np.array([["-0+".index(c) for c in k] for k in keys], int).reshape(len(keys), len(VOTERS))
    n = np.array([patterns[k] for k in keys], float)
    prior = math.log(share / (1 - share))
    weight, m = np.ones(len(VOTERS)), len(VOTERS)
    post = 1 / (1 + np.exp(-(prior + 2.0 * np.clip((v - 1).sum(axis=1), -3, 3))))
    table = np.zeros((2, m, 3))
    correlation = np.zeros((m, m))
    for _ in range(3):
        for _ in range(rounds):
            for y, p in ((1, post), (0, 1 - post)):
                for x in range(3):
                    table[y, :, x] = (n * p) @ (v == x)
                table[y] += 0.5 * np.array([[0.1, 1, 1 if y else 0.1]])
                table[y] /= table[y].sum(axis=1, keepdims=True)
            odds = np.log(table[1] / table[0])[np.arange(m)[None, :], v]
            post = 1 / (1 + np.exp(-np.clip(prior + odds @ weight, -40, 40)))
        # what two voters share beyond the class, by class, then over both
        top = np.zeros((m, m))
        for p in (post, 1 - post):
            w = n * p
            z = v - (w @ v) / max(w.sum(), 1e-9)
            cov = (z * w[:, None]).T @ z / max(w.sum(), 1e-9)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-6))
            top = np.maximum(top, cov / sd[:, None] / sd[None, :])
        np.fill_diagonal(top, 0)
        correlation = np.clip(top, 0, 1)
        weight = 1 / (1 + correlation.sum(axis=1))
    right = {name: float((table[1, j, 2] * share + table[0, j, 0] * (1 - share)) / max(table[1, j, [0, 2]].sum() * share + table[0, j, [0, 2]].sum() * (1 - share), 1e-9)) for j, name in enumerate(VOTERS)}
    return LabelModel(dict(zip(keys, post.tolist(), strict=True)), right, weight, correlation)


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    scale: tuple[float, float]
    labels: LabelModel


def features(hits: dict[int, int], votes: str, width: int) -> np.ndarray:
    x = np.zeros(width + 1)
    for i, n in hits.items():
        x[i] = math.log1p(n)
    x[width - len(votes) : width] = [("-0+".index(c) - 1) for c in votes]
    x[width] = 1.0
    return x


def _logistic(x: np.ndarray, y: np.ndarray, decay: float, rounds: int = 30) -> np.ndarray:
    """Newton's method; y may be soft."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + decay * w
        h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + decay * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Labels and vote patterns come only from rows where `train` (of doc_id) holds."""
    sample, counts = labelled_sample(docs, labels, label, train, per_class)
    sample = materialize(distinct_texts(sample), "tox-sample")
    lexicon = learn_lexicon(sample, counts)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            seen.update(lexicon.look(t)[1] for t in b.column(0).cast(pa.binary()).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["votes", "n"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [lexicon.look(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            x = [features(h, v, lexicon.width).astype(np.float16).tobytes() for h, v in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([v for _, v in found], pa.string()), pa.array(x, pa.binary())], ["doc_id", "label", "votes", "x"])

    voted = docs.where(train).select("text").transform(map_texts, vote, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n"))
    patterns = {r["votes"]: r["n"] for r in voted.collect()}
    share = (counts.get(1, 0) + 1) / (counts.get(0, 0) + counts.get(1, 0) + 2)
    known = label_model(patterns, share)
    got = sample.select("doc_id", "text", "label").transform(map_texts, look, "doc_id long, label int, votes string, x binary").toArrow().sort_by("doc_id")
    x = np.array([np.frombuffer(b, np.float16) for b in got.column("x").to_pylist()], float).reshape(-1, lexicon.width + 1)
    y = got.column("label").to_numpy().astype(float)
    soft = np.array([known.posterior.get(v, share) for v in got.column("votes").to_pylist()])
    if not len(y):
        return Model(lexicon, np.append(np.zeros(lexicon.width), math.log(share / (1 - share))), (1.0, 0.0), known)
    w = _logistic(x, soft, 1.0)
    scale = (1.0, 0.0)
    if y.min() != y.max():
        # the sample is balanced by class; its odds are put back to those of the labels
        z = np.column_stack((np.clip(x @ w, -30, 30), np.ones(len(y))))
        a, b = _logistic(z, y * (1 - 1e-3) + 5e-4, 1e-2)
        b += math.log(counts[1] / counts[0]) - math.log(y.sum() / (len(y) - y.sum()))
        scale = (float(a), float(b)) if a > 0 else scale
    return Model(lexicon, w, scale, known)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted and votes (the voters' pattern) of each document."""
    lexicon, (a, b) = model.lexicon, model.scale
    w = model.weights

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[float, str]] = []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                hits, votes = lexicon.look(t)
                z = w[-1] + sum(w[i] * math.log1p(n) for i, n in hits.items()) + sum(x * ("-0+".index(c) - 1) for x, c in zip(w[lexicon.width - len(votes) : lexicon.width].tolist(), votes, strict=True))
                out.append((1 / (1 + math.exp(-max(-40.0, min(40.0, a * max(-30.0, min(30.0, z)) + b)))), votes))
            s = np.array([x for x, _ in out])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32)), pa.array([v for _, v in out], pa.string())], ["doc_id", "score", "predicted", "votes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(map_texts, kernel, "doc_id long, score double, predicted int, votes string")
