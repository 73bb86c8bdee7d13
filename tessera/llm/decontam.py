"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of `window` consecutive words (a shorter item is one
window); a window's set elements are its word shingles. A window that occurs in
a document needs all its shingles there, so the prefix that must be joined is one
shingle: the rarest by its count over the whole corpus. The join is on that shingle:
every document position that has it, with the words around it, meets the windows of that
prefix. The shingle's offset within the window bounds the start, and start and length
must fit the document; what is left is verified word by word.

Documents are read three times whatever the size of the benchmark: to count its
shingles, to find positions of the chosen ones, and to hand on the result. Neither the
driver nor a task holds the benchmark: what goes to executors is a bitmap of `BITS`
bits, of a fixed size, that lets through the shingles to look for (a false one costs a
row and joins nothing). Shingles and windows are tables, shuffled by shingle, or broadcast
where their counted rows are few. Positions are split off and broadcast against their
windows where a shingle is very frequent, so that it is no single task.

What is found belongs to a text, not to a row: rows go by a 128-bit hash of their text,
which each pass makes anew, so no numbering has to survive.

Edge cases: a null or wordless text has no words and no hits; an item without
words never occurs; repeated item rows count once by item_id (rows that share an
id add their windows to it); null item_ids are left out; equal texts have equal
results; an empty table on either side gives no hits. All columns of the documents pass
through `flag`; a column of theirs with the name of one that it adds is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, map_texts, materialize, maybe_broadcast, others, pack, quoted

#: Bits of the filter that goes to every executor; its bitmaps' size in Spark's aggregate.
BITS, BUCKET = 1 << 26, 32_768
#: Most entries of a worker's buffer; positions from which a shingle is hot.
BUFFER, HOT = 100_000, 100_000
#: Bytes that are no word character become blanks, capitals become small.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
ADDED = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def words(text: bytes | None) -> list[bytes]:
    """Words `[0-9a-z` and anything beyond ASCII`]+` of the text with A-Z lowered."""
    return (text or b"").translate(_WORDS).split()


def hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens, repeat(7)), np.uint64, len(tokens))


def codes(h: np.ndarray, shingle: int) -> np.ndarray:
    """A code for each shingle of word hashes, of its size as well."""
    n = len(h) - shingle + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.full(n, shingle, np.uint64)
    for k in range(shingle):
        out = (out ^ h[k : k + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out


class Filter:
    """A bitmap of codes: what is not in it need not be looked for."""

    def __init__(self, codes_: DataFrame, sizes: list[int]):
        at = F.pmod(F.col("code"), F.lit(BITS))
        rows = codes_.select(F.floor(at / BUCKET).cast("int").alias("bucket"), F.pmod(at, F.lit(BUCKET)).alias("at"))
        parts = rows.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")).collect()  # BITS at most
        self.bits, self.sizes = np.zeros(BITS // 8, np.uint8), sizes
        for r in parts:
            raw = np.frombuffer(bytes(r["bits"]), np.uint8)
            self.bits[r["bucket"] * (BUCKET // 8) :][: len(raw)] = raw

    def places(self, c: np.ndarray) -> np.ndarray:
        """Where codes are that may be looked for."""
        at = c & np.uint64(BITS - 1)
        return np.flatnonzero(self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)


def windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """(wid, words, item_id, codes): each window of each item; wid is a hash of its words."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for name, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                tokens = words(t)
                h = hashes(tokens)
                size = min(shingle, window, len(tokens))
                c = codes(h, size).view(np.int64) if size else None
                for s in range(max(1, len(tokens) - window + 1) if tokens else 0):
                    own = tokens[s : s + window]
                    rows.append((xxhash.xxh128_digest(b" ".join(own)), own, name, c[s : s + len(own) - size + 1].tolist(), size))
                if len(rows) > BUFFER // 10:
                    yield out(rows)
                    rows = []
            yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.binary(), pa.list_(pa.binary()), pa.string(), pa.list_(pa.int64()), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["wid", "words", "item_id", "codes", "size"])

    source = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text"))
    return source.transform(map_texts, kernel, "wid binary, words array<binary>, item_id string, codes array<long>, size int")


def count_codes(texts: DataFrame, wanted: Filter) -> DataFrame:
    """(code, n): how often the filter's shingles occur in the texts."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(np.fromiter(seen.keys(), np.int64, len(seen))), pa.array(np.fromiter(seen.values(), np.int64, len(seen)))], ["code", "n"])
            seen.clear()
            return b

        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                h = hashes(words(t))
                for k in wanted.sizes:
                    c = codes(h, k)
                    at = wanted.places(c)
                    if len(at):
                        found, n = np.unique(c[at].view(np.int64), return_counts=True)
                        seen.update(dict(zip(found.tolist(), n.tolist(), strict=True)))
                if len(seen) > BUFFER:
                    yield out()
        yield out()

    return texts.select("text").transform(map_texts, kernel, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def positions(texts: DataFrame, wanted: Filter, window: int) -> DataFrame:
    """(k1, k2, code, at, before, around) of each place of a wanted shingle: its word
    position, and the words of the text from up to a window before it on to one after."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for k1, k2, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                tokens = words(t)
                h = hashes(tokens)
                for k in wanted.sizes:
                    c = codes(h, k)
                    at = wanted.places(c)
                    for p, code in zip(at.tolist(), c[at].view(np.int64).tolist(), strict=True):
                        low = max(0, p - window + 1)
                        rows.append((k1, k2, code, p, p - low, tokens[low : p + window]))
                        if len(rows) >= BUFFER // 10:
                            yield out(rows)
                            rows = []
        yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["k1", "k2", "code", "at", "before", "around"])

    return texts.select("k1", "k2", "text").transform(map_texts, kernel, "k1 long, k2 long, code long, at int, before int, around array<binary>")


def _keys() -> list[Column]:
    return [F.xxhash64(F.coalesce("text", F.lit("")), F.lit(i)).alias(f"k{i}") for i in (1, 2)]


def find(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3) -> tuple[DataFrame, DataFrame] | None:
    """(k1, k2, start, end, wid) of every occurrence of a window in a text, and (wid,
    item_id) of the windows; None if there is nothing to look for."""
    cut = materialize(windows(items, window, shingle), "windows")
    sizes = sorted(r["size"] for r in cut.select("size").distinct().collect())
    if not sizes:
        return None
    texts = docs.select(*_keys(), F.col("text").alias("text"))
    elements = cut.select("wid", "words", F.posexplode("codes").alias("offset", "code")).distinct()
    elements = materialize(elements, "shingles")
    counted = materialize(count_codes(texts, Filter(elements, sizes)), "shingle-counts")
    # a window whose rarest shingle is nowhere occurs nowhere
    rarity = elements.join(counted, "code", "left").groupBy("wid", "words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "code")).alias("rarest"))
    prefix = rarity.where(F.col("rarest.n") > 0).select("wid", "words", F.size("words").alias("length"), F.col("rarest.offset").alias("offset"), F.col("rarest.code").alias("code"), F.col("rarest.n").alias("n"))
    prefix = materialize(prefix, "prefixes")
    found = materialize(positions(texts, Filter(prefix, sizes), window), "positions")

    def verify(places: DataFrame, of: DataFrame) -> DataFrame:
        start = F.col("at") - F.col("offset")
        first = F.col("before") - F.col("offset")
        joined = places.join(of, "code").where((start >= 0) & (first + F.col("length") <= F.size("around")))
        same = F.slice("around", first + 1, F.col("length")) == F.col("words")
        return joined.where(same).select("k1", "k2", start.alias("start"), (start + F.col("length")).alias("end"), "wid")

    rows = prefix.count()
    if rows <= BROADCAST_ROWS:
        hits = verify(found, F.broadcast(prefix))
    else:
        # no more than BROADCAST_ROWS shingles can be hot
        hot = F.col("n") >= max(HOT, found.count() // max(BROADCAST_ROWS, 1) + 1)
        often = materialize(prefix.where(hot), "hot")
        name = F.broadcast(often.select("code").distinct())
        hits = verify(found.join(name, "code", "left_semi"), maybe_broadcast(often, often.count()))
        hits = hits.unionByName(verify(found.join(name, "code", "left_anti"), prefix.where(~hot)))
    return materialize(hits.distinct(), "hits"), cut.select("wid", "item_id").distinct()


def flag(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3, keep: bool = False) -> DataFrame:
    """Adds n_words, n_hit, n_items, items_sha256 and contaminated; with `keep` gives the
    uncontaminated documents as they came instead."""
    found = find(docs, items, window, shingle)
    rows = pack(docs, *_keys(), F.col("text").alias("text"))
    key = ["k1", "k2"]
    if keep:
        if found is None:
            return docs
        gone = materialize(found[0].select(*key).distinct(), "hit-texts")
        return rows.join(maybe_broadcast(gone, gone.count()), key, "left_anti").select("document.*")
    @F.arrow_udf("long")
    def n_words(texts: pa.Array) -> pa.Array:
        return pa.array([len(words(t)) for t in texts.cast(pa.binary()).to_pylist()], pa.int64())

    if found is None:
        by = docs.sparkSession.createDataFrame([], "k1 long, k2 long, n_hit long, items array<string>")
    else:
        hits, owners = found
        runs = F.array_sort(F.collect_set(F.struct("start", "end")))
        zero = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("n"))
        step = lambda a, r: F.struct(F.greatest(a["at"], r["end"]).alias("at"), (a["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(a["at"], r["start"]))).alias("n"))
        covered = hits.groupBy(*key).agg(F.aggregate(runs, zero, step, lambda a: a["n"]).alias("n_hit"))
        own = hits.select(*key, "wid").distinct().join(owners.select("wid", "item_id"), "wid").select(*key, "item_id").distinct()
        by = covered.join(own.groupBy(*key).agg(F.array_sort(F.collect_list("item_id")).alias("items")), key)
        by = materialize(by, "hit-texts")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    taken = [F.col("document." + quoted(c)) for c in _names(docs)]
    return rows.join(maybe_broadcast(by, by.count()), key, "left").select(
        *taken, n_words("text").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def _names(docs: DataFrame) -> list[str]:
    return docs.select(*others(docs, ADDED)).columns
