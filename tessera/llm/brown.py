"""Language-model scores from a class-based bigram model (Brown et al. 1992).

Words are counted over all training documents. The most frequent words and, for
the rest, groups by ending are the units that an exchange algorithm (Martin et
al. 1998) assigns to classes: it moves one unit at a time to the class with the
greatest gain in class-bigram likelihood. Then every other word leaves the class of
its ending for the class of its own greatest gain, by the classes beside all of its
tokens; these words move in one sweep, all at once. Bigrams of classes are counted
anew after it. A text's probability is the product of class transitions and of word
emissions, P(w|k) = (c(w)+1) / (N_k + V_k + 1).

Counts and classes of words seen often (a bounded number) go to every executor;
tokens of rarer words are gathered by document and word, joined with the words'
counts and classes, and put back by document, so no vocabulary has to fit anywhere.

Edge cases: a null or blank text is its end token alone; repeated rows are scored
one by one; a null doc_id trains and is scored like any other. Without training
rows every count is 0. Other columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialize

#: Words whose counts go to every executor; words that are units by themselves; groups
#: of the other words by ending, where these start; classes (a byte holds one, two bytes
#: a pair); most entries of a worker's buffers.
FREQUENT, CLUSTERED, ENDINGS, CLASSES, BUFFER = 100_000, 1000, 96, 64, 250_000
#: Tokens up to which a word's gains come from tables.
SMALL = 32
#: The end token: no word has a blank.
END = b" "


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def ending(word: bytes) -> int:
    """The group in which a word that is no unit by itself starts, by its last two letters."""
    return zlib.crc32(word[-2:]) % ENDINGS


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) of all documents; the end token is counted once a document."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])
            seen.clear()
            return b

        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                seen.update(tokens(t))
                seen[END] += 1
                if len(seen) > BUFFER:
                    yield out()
        yield out()

    return docs.select("text").transform(map_texts, kernel, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = 8) -> np.ndarray:
    """The class of each unit, from the units' bigram counts. Units start by
    frequency, round robin; each sweep moves every unit to its best class."""
    n = len(bigrams)
    weight = bigrams.sum(axis=1) + bigrams.sum(axis=0)
    order = np.argsort(-weight, kind="stable")
    home = np.empty(n, np.int64)
    home[order] = np.arange(n) % classes
    f = lambda x: x * np.log(np.maximum(x, 1.0))
    table = np.zeros((classes, classes))
    np.add.at(table, (home[:, None], home[None, :]), bigrams)
    outs = np.zeros((n, classes))  # unit -> class, class -> unit
    ins = np.zeros((n, classes))
    np.add.at(outs.T, home, bigrams.T)
    np.add.at(ins.T, home, bigrams)
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not weight[u]:
                continue
            k, own = home[u], bigrams[u, u]
            o, i = outs[u].copy(), ins[u].copy()
            o[k] -= own
            i[k] -= own
            table[k, :] -= o
            table[:, k] -= i
            table[k, k] -= own
            row, column = table.sum(axis=1) + i, table.sum(axis=0) + o
            # the change of sum f(n(k,l)) - sum f(n(k)) - sum f(n(l)) if u joins a class
            gain = (f(table + o[None, :]) - f(table)).sum(axis=1) + (f(table + i[:, None]) - f(table)).sum(axis=0)
            d = np.arange(classes)
            gain += f(table[d, d] + o + i + own) - f(table[d, d] + o) - f(table[d, d] + i) + f(table[d, d])
            gain -= f(row + o.sum() + own) - f(row) + f(column + i.sum() + own) - f(column)
            best = int(np.argmax(gain))
            if gain[best] <= gain[k] + 1e-9:
                best = k
            table[best, :] += o
            table[:, best] += i
            table[best, best] += own
            if best != k:
                moved += 1
                home[u] = best
                outs[:, k] -= bigrams[:, u]
                outs[:, best] += bigrams[:, u]
                ins[:, k] -= bigrams[u, :]
                ins[:, best] += bigrams[u, :]
        if not moved:
            break
    return home


class Model:
    """What every executor gets: bounded by FREQUENT, CLUSTERED and CLASSES."""

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, distinct: int, ends: int):
        self.words, self.counts, self.total, self.distinct, self.ends = words, counts, total, distinct, ends
        self.clustered = min(CLUSTERED, len(words))
        self.units = self.clustered + ENDINGS + 1  # the last is the end
        self.end = self.units - 1
        # the unit of each frequent word; the last entry is for words that are not
        self.unit_of = np.array([i if i < self.clustered else self.clustered + ending(w) for i, w in enumerate(words)] + [0], np.int64)

    def ranks(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}

    def look(self, words: list[bytes], rank: dict[bytes, int], of: np.ndarray, endings: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each word, -1 for rare ones, and what `of` has for frequent words
        and `endings` for rare ones, with `end` before and after."""
        at = np.fromiter(map(rank.get, words, repeat(-1)), np.int64, len(words))
        ids = np.full(len(words) + 2, end, np.int64)
        ids[1:-1] = of[at]
        for i in np.flatnonzero(at < 0).tolist():
            ids[i + 1] = endings[ending(words[i])]
        return at, ids


def frequent(counts: DataFrame, most: int) -> list:
    """The words seen at least so often that there are no more than `most`,
    with their counts, by falling count; the end is left out."""
    level = F.floor(F.log2("c") * 16)
    steps = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("level")).collect()
    held, least = 0, None
    for s in steps:
        held += s["n"]
        if held > most:
            break
        least = s["least"]
    if least is None:
        return []
    rows = counts.where((F.col("c") >= least) & (F.col("word") != F.lit(END))).select("word", "c").toArrow()
    return sorted(zip(rows.column("word").to_pylist(), rows.column("c").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))


def gains(table: np.ndarray, out: np.ndarray, into: np.ndarray, home: np.ndarray) -> np.ndarray:
    """The gain of each class for each word, as in `exchange`: (words, classes) counts of
    the classes after and before a word, which the table holds at the word's `home`. A
    word beside itself counts as beside its home."""
    f = lambda x: x * np.log(np.maximum(x, 1.0))
    gain = np.zeros(out.shape)
    for t, own, other in ((table.T, out, into), (table, into, out)):
        w, l = np.nonzero(own)  # noqa: E741
        c, base, k = own[w, l][:, None], t[l].copy(), home[w]
        base[np.arange(len(w)), k] -= c[:, 0]
        same = l == k
        base[same] -= other[w[same]]
        step = f(base + c) - f(base)
        if len(w):
            first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            gain[w[first]] += np.add.reduceat(step, first, axis=0)
    rows, sums, before = np.arange(len(out)), out.sum(axis=1), into.sum(axis=1)
    d = np.repeat(np.diag(table)[None], len(out), axis=0)
    d[rows, home] -= out[rows, home] + into[rows, home]
    gain += f(d + out + into) - f(d + out) - f(d + into) + f(d)
    for total, n in ((table.sum(axis=1), sums), (table.sum(axis=0), before)):
        base = np.repeat(total[None], len(out), axis=0)
        base[rows, home] -= n
        gain -= f(base + n[:, None]) - f(base)
    return gain


class Steps:
    """The gains of words that occur a few times, from tables made once: the counts of such a
    word beside a class change one cell of the bigram table by a small whole number."""

    def __init__(self, table: np.ndarray):
        f = lambda x: x * np.log(np.maximum(x, 1.0))
        n = np.arange(SMALL + 1)[:, None, None]
        self.table = table
        # by direction, count and the other class: the step of joining each class, and of staying at home
        sides = (table.T, table)
        self.join = [f(t[None] + n) - f(t[None]) for t in sides]
        self.stay = [f(t[None]) - f(np.maximum(t[None] - n, 0.0)) for t in sides]
        totals = (table.sum(axis=1), table.sum(axis=0))
        m = np.arange(SMALL + 1)[:, None]
        self.sum_join = [f(x[None] + m) - f(x[None]) for x in totals]
        self.sum_stay = [f(x[None]) - f(np.maximum(x[None] - m, 0.0)) for x in totals]
        self.f = f

    def __call__(self, out: np.ndarray, into: np.ndarray, home: np.ndarray) -> np.ndarray:
        """As `gains`."""
        sums = out.sum(axis=1)
        few = sums <= SMALL
        gain = np.empty(out.shape)
        if not few.all():
            gain[~few] = gains(self.table, out[~few], into[~few], home[~few])
        if few.any():
            gain[few] = self.of_few(out[few], into[few], home[few], sums[few].astype(np.int64))
        return gain

    def of_few(self, out: np.ndarray, into: np.ndarray, home: np.ndarray, n: np.ndarray) -> np.ndarray:
        rows, g, f = np.arange(len(out)), np.zeros(out.shape), self.f
        for side, t, (own, other) in zip(range(2), (self.table.T, self.table), ((out, into), (into, out)), strict=True):
            join, stay = self.join[side], self.stay[side]
            w, l = np.nonzero(own)  # noqa: E741
            c, k = own[w, l].astype(np.int64), home[w]
            for x in (1, 2):  # one product for all words that a class is beside once, or twice
                g += (own == x).astype(float) @ join[x]
            more = np.flatnonzero(c > 2)
            if len(more):
                first = np.flatnonzero(np.append(True, w[more][1:] != w[more][:-1]))
                g[w[more][first]] += np.add.reduceat(join[c[more], l[more]], first, axis=0)
            g[rows, home] += np.bincount(w, stay[c, l, k] - join[c, l, k], len(out))
            # beside its own home, a word's other side is in the row too
            at = np.flatnonzero(l == k)
            if len(at):
                v, h, x = w[at], k[at], own[w[at], k[at]][:, None]
                base = t[h].copy()
                base[np.arange(len(at)), h] -= x[:, 0]
                base -= other[v]
                was = join[c[at], h]
                was[np.arange(len(at)), h] = stay[c[at], h, h]
                g[v] += f(base + x) - f(base) - was
        for side in range(2):
            step = self.sum_join[side][n]
            step[rows, home] = self.sum_stay[side][n, home]
            g -= step
        # a class on both sides of the word: its own cell changes by both
        w, l = np.nonzero((out > 0) & (into > 0))  # noqa: E741
        x, y = out[w, l], into[w, l]
        d = self.table[l, l] - np.where(l == home[w], x + y, 0)
        g[w, l] += f(d + x + y) - f(d + x) - f(d + y) + f(d)
        return g


def place_tail(docs: DataFrame, model: Model, home: np.ndarray, table: np.ndarray) -> DataFrame:
    """(word, c, k) of every training word that is no unit by itself: from the class of its
    ending it moves to the class of greatest gain, by the classes before and after each of
    its tokens. All move at once, against the table of the units' classes. A word's pairs of
    classes are counted where there are many, so a frequent one is no long row."""
    k = len(table)
    of, endings, end = home[model.unit_of], home[model.clustered : model.end], int(home[model.end])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = model.ranks()
        often: list[np.ndarray] = []  # of frequent words: rank and pair in one number
        seldom: defaultdict = defaultdict(bytearray)
        held = 0

        def out() -> pa.RecordBatch:
            words, pairs, counts = list(seldom), list(map(bytes, seldom.values())), []
            code = np.concatenate(often) if often else np.zeros(0, np.int64)
            if len(code):
                code.sort()
                at, pair = code // (k * k), (code % (k * k)).astype(np.uint16)
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                words += [model.words[i] for i in at[first].tolist()]
                pairs += [pair[x:y].tobytes() for x, y in zip(first.tolist(), [*first[1:].tolist(), len(pair)], strict=True)]
            for i, x in enumerate(pairs):
                if len(x) > 4 * k * k:
                    found, n = np.unique(np.frombuffer(x, np.uint16), return_counts=True)
                    pairs[i] = found.tobytes()
                    counts.append(n.astype(np.int64).tobytes())
                else:
                    counts.append(None)
            seldom.clear()
            often.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(pairs, pa.binary()), pa.array(counts, pa.binary())], ["word", "pairs", "n"])

        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                words = tokens(t)
                at, ids = model.look(words, rank, of, endings, end)
                pair = ids[:-2] * k + ids[2:]
                known = at >= model.clustered
                often.append(at[known] * (k * k) + pair[known])
                for i in np.flatnonzero(at < 0).tolist():
                    seldom[words[i]] += pair[i].astype(np.uint16).tobytes()
                held += len(words)
                if len(seldom) > BUFFER or held > 16 * BUFFER:
                    yield out()
                    held = 0
        yield out()

    def settle(steps: Steps, names: list[bytes], at: np.ndarray, pair: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        size = len(names)
        into = np.bincount(at * k + pair // k, n, size * k).reshape(size, k)
        out = np.bincount(at * k + pair % k, n, size * k).reshape(size, k)
        old = endings[[ending(w) for w in names]]
        gain = steps(out, into, old)
        best = gain.argmax(axis=1)
        rows = np.arange(size)
        best = np.where(gain[rows, best] <= gain[rows, old] + 1e-9, old, best)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(out.sum(axis=1).astype(np.int64)), pa.array(best.astype(np.int32))], ["word", "c", "k"])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Steps(table)
        last, kept, often = None, np.zeros(0, np.int64), np.zeros(0)  # the word that may go on, and its pairs
        for batch in batches:
            words, raw = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if not words:
                continue
            counts = batch.column(2).to_pylist()
            n = np.concatenate([np.frombuffer(c, np.int64) if c is not None else np.ones(len(p) // 2, np.int64) for p, c in zip(raw, counts, strict=True)]).astype(float) if any(c is not None for c in counts) else None
            pair = np.frombuffer(b"".join(raw), np.uint16).astype(np.int64)
            n = np.ones(len(pair)) if n is None else n
            if last is not None:
                words, raw = [last, *words], [b"  " * len(kept), *raw]
                pair, n = np.append(kept, pair), np.append(often, n)
            row = np.cumsum([0] + [x != y for x, y in zip(words[1:], words[:-1], strict=True)])
            at = np.repeat(row, [len(p) // 2 for p in raw])
            names = [words[i] for i in np.flatnonzero(np.append(True, row[1:] != row[:-1])).tolist()]
            cut = int(np.searchsorted(at, len(names) - 1))
            if len(names) > 1:
                yield settle(steps, names[:-1], at[:cut], pair[:cut], n[:cut])
            last = names[-1]
            kept, back = np.unique(pair[cut:], return_inverse=True)
            often = np.bincount(back, n[cut:], len(kept))
        if last is not None:
            yield settle(steps, [last], np.zeros(len(kept), np.int64), kept, often)

    found = docs.select("text").transform(map_texts, contexts, "word binary, pairs binary, n binary")
    return found.repartition("word").sortWithinPartitions("word").mapInArrow(assign, "word binary, c long, k int")


def learn(docs: DataFrame) -> tuple[Model, DataFrame]:
    """A model with the class of every training word, but no transitions yet; and (word,
    c, k) of all words that are no unit by themselves, as a written table."""
    counts = materialize(count_words(docs), "counts")
    total, distinct, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(F.col("word") == F.lit(END), F.col("c"))), F.lit(0))).first()
    top = frequent(counts, FREQUENT)
    model = Model([w for w, _ in top], np.array([c for _, c in top], np.int64), total, distinct, ends)
    n = model.units

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, endings = model.ranks(), np.arange(model.clustered, model.end)
        seen = np.zeros(n * n, np.int64)
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                _, ids = model.look(tokens(t), rank, model.unit_of, endings, model.end)
                np.add.at(seen, ids[:-1] * n + ids[1:], 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"pair": at, "c": seen[at]})

    bigrams = np.zeros(n * n)
    seen = docs.select("text").transform(map_texts, pairs, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()  # units squared at most
    bigrams[seen.column("pair").to_numpy()] = seen.column("c").to_numpy()
    bigrams = bigrams.reshape(n, n)
    home = exchange(bigrams, min(CLASSES, n))
    k = int(home.max()) + 1
    table = np.zeros((k, k))
    np.add.at(table, (home[:, None], home[None, :]), bigrams)
    placed = materialize(place_tail(docs, model, home, table), "classes")
    model.classes, model.end_class = k, int(home[model.end])
    #: Words that training has not seen go by their ending.
    model.endings = home[model.clustered : model.end]
    model.kinds = home[model.unit_of]
    rank = model.ranks()
    if len(model.counts):
        known = placed.where(F.col("c") >= int(model.counts[-1])).select("word", "k").toArrow()  # FREQUENT at most
        for w, c in zip(known.column("word").to_pylist(), known.column("k").to_pylist(), strict=True):
            model.kinds[rank[w]] = c
    model.vocabulary = np.bincount(np.append(home[: model.clustered], [model.end_class] * (ends > 0)).astype(np.int64), minlength=k).astype(float)
    for r in placed.groupBy("k").agg(F.count("*").alias("n")).collect():
        model.vocabulary[r["k"]] += r["n"]
    return model, placed


def encode(docs: DataFrame, model: Model, placed: DataFrame, held: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, log (the sum of log10(c + 1) of the tokens) and
    classes (a byte for each token, with the end before and after), as a written table."""
    least = int(model.counts[-1]) if len(model.counts) else 1 << 62

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, logs = model.ranks(), np.log10(model.counts + 1.0)
        for batch in batches:
            rows: list[tuple] = []
            for rid, doc_id, text, out in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = tokens(text)
                at, ids = model.look(words, rank, model.kinds, model.endings, model.end_class)
                known = at[at >= 0]
                kept = float(logs[known].sum()) + math.log10(model.ends + 1)
                # one row for the document under a word that cannot be, then its rarer words and where they are
                rows.append((rid, doc_id, out, b" %d" % rid, len(words) + 1, len(known) + (model.ends > 0), kept, ids.astype(np.uint8).tobytes()))
                rare: dict[bytes, list[int]] = {}
                for i in np.flatnonzero(at < 0).tolist():
                    rare.setdefault(words[i], []).append(i + 1)
                rows += [(rid, None, None, w, None, None, None, array("i", x).tobytes()) for w, x in rare.items()]
                if len(rows) > BUFFER:
                    yield pack(rows)
                    rows = []
            yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)

    def gather(rows: pa.Table) -> pa.RecordBatch:
        """The rows of whole documents, by rid: one row each."""
        get = lambda name: rows.column(name).to_numpy()
        rid = get("rid")
        first = np.flatnonzero(np.append(True, rid[1:] != rid[:-1]))
        doc = np.cumsum(np.append(0, rid[1:] != rid[:-1]))
        main = np.flatnonzero(rows.column("n_tokens").is_valid().to_numpy())
        held = rows.column("bytes").to_pylist()
        classes = [held[i] for i in main.tolist()]
        flat = np.frombuffer(b"".join(classes), np.uint8).copy()
        start = np.cumsum([0] + [len(x) for x in classes])
        k = get("k")
        moved = np.flatnonzero(k >= 0)
        where = [held[i] for i in moved.tolist()]
        many = np.array([len(x) // 4 for x in where], np.int64)
        flat[np.repeat(start[doc[moved]], many) + np.frombuffer(b"".join(where), np.int32)] = np.repeat(k[moved], many)
        data = flat.tobytes()
        cut = start.tolist()
        side = rows.select(["doc_id", "held_out", "n_tokens"]).take(pa.array(main))
        return pa.RecordBatch.from_arrays([
            *(side.column(c).combine_chunks() for c in side.column_names), pa.array(np.add.reduceat(get("n_known"), first)), pa.array(np.add.reduceat(get("log"), first)),
            pa.array([data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
        ], ["doc_id", "held_out", "n_tokens", "n_known", "log", "classes"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            rid = batch.column(0).to_numpy()
            whole = int(np.searchsorted(rid, rid[-1]))  # the last document may go on
            if whole or (open_ and open_[0].column(0)[0].as_py() != rid[-1]):
                yield gather(pa.Table.from_batches([*open_, batch.slice(0, whole)]))
                open_ = []
            open_.append(batch.slice(whole))
        if open_:
            yield gather(pa.Table.from_batches(open_))

    names = ["rid", "doc_id", "held_out", "word", "n_tokens", "n_known", "kept", "bytes"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.binary()]
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"))
    rows = base.transform(map_texts, kernel, "rid long, doc_id long, held_out boolean, word binary, n_tokens long, n_known long, kept double, bytes binary")
    joined = rows.join(placed.where(F.col("c") < least), "word", "left")
    tf = F.when(F.col("c").isNotNull(), F.octet_length("bytes") / 4).otherwise(0.0)
    known = F.coalesce("n_known", tf.cast("long"))
    log = F.coalesce("kept", tf * F.log10(F.coalesce("c", F.lit(0)) + 1.0))
    slim = joined.select("rid", "doc_id", "held_out", "n_tokens", known.alias("n_known"), log.alias("log"), F.coalesce("k", F.lit(-1)).alias("k"), "bytes")
    out = slim.repartition("rid").sortWithinPartitions("rid").mapInArrow(merge, "doc_id long, held_out boolean, n_tokens long, n_known long, log double, classes binary")
    return materialize(out, "coded")


def join_classes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bigrams (first, second) of a batch of documents, and where each document's begin."""
    rows = column.to_pylist()
    flat = np.frombuffer(b"".join(rows), np.uint8).astype(np.int64)
    start = np.cumsum([0] + [len(x) for x in rows])
    inner = np.ones(len(flat), bool)
    inner[start[1:] - 1] = False
    at = np.flatnonzero(inner)
    return np.stack((flat[at], flat[at + 1])), start[:-1] - np.arange(len(rows))


def settle(model: Model, coded: DataFrame) -> Model:
    """Adds transitions and emissions, from the class bigrams of coded training documents."""
    k = model.classes

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(k * k, np.int64)
        for batch in batches:
            if len(batch):
                (a, b), _ = join_classes(batch.column(0))
                seen += np.bincount(a * k + b, minlength=k * k)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"pair": at, "c": seen[at]})

    table = np.zeros(k * k)
    for r in coded.select("classes").transform(map_texts, pairs, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).collect():
        table[r["pair"]] = r["c"]
    table = table.reshape(k, k)
    tokens_of = table.sum(axis=0)
    share = (tokens_of + 1) / (tokens_of.sum() + k)
    model.table = table
    model.transition = np.log10((table + 2 * share[None, :]) / (table.sum(axis=1, keepdims=True) + 2))
    model.emission = -np.log10(tokens_of + model.vocabulary + 1)
    return model


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and (word, c, k) of the training words that are no unit by themselves."""
    model, placed = learn(docs)
    return settle(model, encode(docs, model, placed, F.lit(False))), placed


def rate(coded: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and
    class_perplexity of every coded document."""
    transition, emission = model.transition, model.emission

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                (a, b), first = join_classes(batch.column(5))
                chain = np.add.reduceat(transition[a, b] + emission[b], first)
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(chain)], ["doc_id", "held_out", "n_tokens", "n_known", "log", "chain"])

    out = coded.select("doc_id", "held_out", "n_tokens", "n_known", "log", "classes").transform(map_texts, kernel, "doc_id long, held_out boolean, n_tokens long, n_known long, log double, chain double")
    whole = math.log10(model.total + model.distinct + 1)
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("log") - F.col("n_tokens") * F.lit(whole)).alias("base_score"), (F.col("log") + F.col("chain")).alias("score"),
        F.pow(F.lit(10.0), -(F.col("log") + F.col("chain")) / F.col("n_tokens")).alias("class_perplexity"),
    )


def score(docs: DataFrame, model: Model, placed: DataFrame, held: Column) -> DataFrame:
    """`rate` of documents that are not coded yet."""
    return rate(encode(docs, model, placed, held), model)
