"""SimHash near-duplicates by a binary-trie self-join.

Every document gets a 64-bit fingerprint; two documents link when their
fingerprints differ in at most `budget` bits, and a document's class is the
connected component of its links.

Equal fingerprints are one node, so groups of copies cost one row. The 64 bits are cut
into budget + 2 blocks: two fingerprints within the budget agree in two blocks at least.
For each choice of two blocks the bits are reordered, these two first, so every link is
between two leaves of one sub-trie under the exact prefix, and a fingerprint is sent to as
many sub-tries as there are choices (6 for a budget of 2, whatever the input's size). In a
sub-trie pairs of nodes are walked together: differing bits add up, and a pair is dropped
as soon as they exceed the budget. Sub-tries with more than `SUBTRIE` fingerprints are
counted beforehand and cut deeper, four bits a round, into pairs of smaller sub-tries
whose prefixes differ within the budget, until none is over the bound; so no task ever
holds more. Each group gives back a spanning forest of its links, not the links, so a
dense group stays linear; the components are the same. Components come by hooking nodes to
their least neighbours and contracting, each round written to the shared folder.

Edge cases: a null or blank text has fingerprint zero and links like any other;
fewer words than a shingle are one shingle; repeated rows fall into one class. A
null doc_id takes its class from rows with equal fingerprint but joins no two
classes; without any such row its component_id is null. An empty table gives no
rows. Other columns of the input are not looked at; `drop_near_duplicates` hands all of
them on, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, map_texts, materialize, maybe_broadcast, pack

#: Fingerprints that one sub-trie may hold; bits by which a larger one is cut deeper.
SUBTRIE, DEEPER = 16_384, 4
#: Rows of whole sub-tries that are walked at a time; rows from which a fingerprint is hot.
WALKED, HOT = 1 << 17, 100_000
#: Node pairs with at most so many leaf pairs are compared directly; pairs walked at a time.
LEAF_PAIRS, FRONTIER = 64, 100_000


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint: a bit is set where over half the shingles' hashes have it."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), seed)
    n = len(words) - shingle + 1
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends[:n] - np.fromiter(map(len, words), np.int64, len(words))[:n] - 1).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    totals = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded scratch for very long texts
        part = hashes[at : at + (1 << 16)]
        totals += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * totals > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, *more: Column) -> DataFrame:
    """(doc_id, more, fp): fp is the fingerprint as a signed long; more: columns of longs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, F.col("text").alias("text"))
    names = rows.columns[:-1]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, shingle, seed) for t in b.columns[-1].cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.array(fps, np.uint64).view(np.int64))], [*names, "fp"])

    return rows.transform(map_texts, kernel, ", ".join(f"{n} long" for n in [*names, "fp"]))


def _expand(lo1, hi1, lo2, hi2):
    """Index pairs of each rectangle [lo1,hi1) x [lo2,hi2)."""
    width = hi2 - lo2
    size = (hi1 - lo1) * width
    at = np.repeat(np.arange(len(size)), size)
    k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return lo1[at] + k // width[at], lo2[at] + k % width[at]


def trie_pairs(left: np.ndarray, right: np.ndarray, depth: int, budget: int, same: bool, roots: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints within `budget` bits: `left` and `right` are
    sorted, and each side's first `depth` bits are equal; `same`: one array. With `roots`
    (begins and ends of sub-tries in it) each of them is joined with itself instead, and
    `depth` bits are equal within each."""
    if not len(left) or not len(right):
        return
    one = lambda x: np.array([x], np.int64)
    if roots is None:
        gap = int(np.bitwise_count((left[0] ^ right[0]) >> np.uint64(64 - depth))) if depth else 0
        if gap > budget:
            return
        stack = [(depth, one(0), one(len(left)), one(0), one(len(right)), one(gap))]
    else:
        stack = [(depth, *roots, *roots, np.zeros(len(roots[0]), np.int64))]
    while stack:
        d, lo1, hi1, lo2, hi2, err = stack.pop()
        if len(lo1) > FRONTIER:
            cut = len(lo1) // 2
            stack += [(d, *(x[cut:] for x in (lo1, hi1, lo2, hi2, err))), (d, *(x[:cut] for x in (lo1, hi1, lo2, hi2, err)))]
            continue
        small = ((hi1 - lo1) * (hi2 - lo2) <= LEAF_PAIRS) | (d >= 64)
        if small.any():
            i, j = _expand(lo1[small], hi1[small], lo2[small], hi2[small])
            near = np.bitwise_count(left[i] ^ right[j]) <= budget
            if same:
                near &= i < j
            if near.any():
                yield i[near], j[near]
            lo1, hi1, lo2, hi2, err = (x[~small] for x in (lo1, hi1, lo2, hi2, err))
        if not len(lo1):
            continue
        bit = np.uint64(1) << np.uint64(63 - d)
        mask = ~((bit << np.uint64(1)) - np.uint64(1)) if d else np.uint64(0)
        mid1 = np.clip(np.searchsorted(left, (left[lo1] & mask) | bit), lo1, hi1)
        mid2 = np.clip(np.searchsorted(right, (right[lo2] & mask) | bit), lo2, hi2)
        parts = []
        for a, b in itertools.product((0, 1), (0, 1)):
            l1, h1 = (lo1, mid1) if a == 0 else (mid1, hi1)
            l2, h2 = (lo2, mid2) if b == 0 else (mid2, hi2)
            e = err + (a != b)
            ok = (l1 < h1) & (l2 < h2) & (e <= budget)
            if same:
                ok &= (l1 < l2) | ((l1 == l2) & (h1 == h2))  # the mirrored pair is walked once
            parts.append([x[ok] for x in (l1, h1, l2, h2, e)])
        stack.append((d + 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest index in each of n nodes' component."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        open_ = a != b
        if not open_.any():
            return root
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def layout(budget: int) -> tuple[list[tuple[int, int]], list[list[int]], int]:
    """Blocks of the 64 bits (shift, width), the orders of blocks, each with its two exact
    ones first, and the least bits that two blocks have."""
    n = budget + 2
    if n > 32:
        raise ValueError("the budget must leave blocks of two bits at least")
    ends = [64 * i // n for i in range(n + 1)]
    blocks = [(a, b - a) for a, b in itertools.pairwise(ends)]
    orders = [[i, j, *(k for k in range(n) if k not in (i, j))] for i, j in itertools.combinations(range(n), 2)]
    return blocks, orders, 2 * min(w for _, w in blocks)


def reorder(fp: np.ndarray, blocks: list[tuple[int, int]], order: list[int]) -> np.ndarray:
    """The fingerprints with their blocks in another order, the first on top."""
    out = np.zeros(len(fp), np.uint64)
    for i in order:
        shift, width = blocks[i]
        out = (out << np.uint64(width)) | ((fp >> np.uint64(shift)) & np.uint64((1 << width) - 1))
    return out


def deal(nodes: DataFrame, budget: int) -> DataFrame:
    """(key, bits, rep) of nodes (fp, rep): each fingerprint in every order, under the
    number of the order and its exact prefix."""
    blocks, orders, exact = layout(budget)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for k, order in enumerate(orders):
                bits = reorder(fp, blocks, order)
                key = (np.uint64(k) << np.uint64(exact)) | (bits >> np.uint64(64 - exact))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(bits.view(np.int64)), b.column(1)], ["key", "bits", "rep"])

    return nodes.select("fp", "rep").mapInArrow(kernel, "key long, bits long, rep long")


class _Forest:
    """Links among `n` rows, folded now and then, so that a dense group keeps to its rows."""

    def __init__(self, n: int):
        self.own, self.root, self.u, self.v, self.held = np.arange(n), np.arange(n), [], [], 0

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        self.u.append(u)
        self.v.append(v)
        self.held += len(u)
        if self.held > 1_000_000:
            self.fold()

    def fold(self) -> None:
        if self.u:
            self.root = forest(len(self.own), np.concatenate([*self.u, self.own]), np.concatenate([*self.v, self.root]))
            self.u, self.v, self.held = [], [], 0

    def edges(self, rep: np.ndarray) -> pa.RecordBatch:
        self.fold()
        # a component's centre is its least node, so that other orders of the bits give the same links again
        least = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(least, self.root, rep)
        centre = least[self.root]
        linked = np.flatnonzero(centre != rep)
        return pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(centre[linked])], ["src", "dst"])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches in pieces of about WALKED rows that end where the
    first `keys` columns change."""
    held: list[np.ndarray] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        new = [c.to_numpy() for c in b.columns]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        if len(held[0]) >= WALKED:
            changes = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in held[:keys]])) + 1
            if len(changes):
                cut = int(changes[-1])
                yield [c[:cut] for c in held]
                held = [c[cut:] for c in held]
    if held is not None:
        yield held


def links(nodes: DataFrame, budget: int = 2, subtrie: int = SUBTRIE) -> DataFrame:
    """(src, dst) over `nodes` (fp, rep; fp unique): forests that span all links."""
    _, _, exact = layout(budget)
    dealt = materialize(deal(nodes, budget), "dealt")
    heavy = materialize(dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > subtrie).select("key"), "heavy")
    rows = heavy.count()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, bits, rep in whole_groups(batches, 1):
            bits = bits.view(np.uint64)
            found = _Forest(len(key))
            order = key >> exact
            begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            ends = np.append(begins[1:], len(key))
            for k in np.unique(order):  # within an order all bits are sorted
                lo, hi = int(np.searchsorted(order, k)), int(np.searchsorted(order, k, side="right"))
                some = (begins >= lo) & (begins < hi) & (ends - begins > 1)
                if some.any():
                    part = bits[lo:hi]
                    for i, j in trie_pairs(part, part, exact, budget, True, (begins[some] - lo, ends[some] - lo)):
                        found.add(i + lo, j + lo)
            yield found.edges(rep)

    if not rows:
        return dealt.repartition("key").sortWithinPartitions("key", "bits").mapInArrow(walk, "src long, dst long")
    light = dealt.join(maybe_broadcast(heavy, rows), "key", "left_anti").repartition("key").sortWithinPartitions("key", "bits")
    out = light.mapInArrow(walk, "src long, dst long")
    state = dealt.join(maybe_broadcast(heavy, rows), "key", "left_semi").select("key", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), "bits", "rep")
    return out.unionByName(_deeper(state, budget, exact, subtrie))


def _deeper(state: DataFrame, budget: int, exact: int, subtrie: int) -> DataFrame:
    """The links within heavy sub-tries: rows (key, lo, hi, bits, rep), where lo and hi are
    the prefixes of the two sub-tries of a pair (0 to begin with)."""
    group = ["key", "lo", "hi"]
    out, depth, first = None, exact, True
    while True:
        step = min(DEEPER, 64 - depth)
        depth += step
        own = F.col("bits") if depth == 64 else F.expr(f"shiftrightunsigned(bits, {64 - depth})")
        parent = F.shiftright(F.col("own"), step)
        # the other side's prefix before this round: the row's own in a pair of one sub-trie with itself
        other = parent if first else F.when(parent == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
        masks = F.array(*(F.lit(m).cast("long") for m in range(1 << step)))
        low = F.lit((1 << step) - 1).cast("long")
        partner = F.shiftleft(F.col("other"), step).bitwiseOR(F.col("own").bitwiseAND(low).bitwiseXOR(F.col("mask")))
        state = state.withColumn("own", own).withColumn("other", other).withColumn("mask", F.explode(masks)).withColumn("partner", partner)
        state = state.where(F.bit_count(F.col("own").bitwiseXOR(F.col("partner"))) <= budget)
        state = state.select("key", F.least("own", "partner").alias("lo"), F.greatest("own", "partner").alias("hi"), "bits", "rep")
        state = materialize(state, "deeper")
        first = False
        counts = state.groupBy(*group).agg(F.count("*").alias("n"))
        heavy = materialize(counts.where((F.col("n") > subtrie) & F.lit(depth < 64)).select(*group), "heavy")
        rows = heavy.count()
        light = state.join(maybe_broadcast(heavy, rows), group, "left_anti") if rows else state
        at = depth

        def walk(batches: Iterator[pa.RecordBatch], at=at) -> Iterator[pa.RecordBatch]:
            for key, lo, hi, bits, rep in whole_groups(batches, 3):
                bits = bits.view(np.uint64)
                found = _Forest(len(key))
                begins = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
                for a, b in zip(begins.tolist(), np.append(begins[1:], len(key)).tolist(), strict=True):
                    same = bool(lo[a] == hi[a])
                    cut = b if same else a + int(np.count_nonzero((bits[a:b] >> np.uint64(64 - at)) == np.uint64(int(lo[a]) % (1 << 64))))
                    if b - a > 1 and (same or a < cut < b):
                        for i, j in trie_pairs(bits[a:cut], bits[a:b] if same else bits[cut:b], at, budget, same):
                            found.add(i + a, j + (a if same else cut))
                yield found.edges(rep)

        walked = light.repartition(*group).sortWithinPartitions(*group, "bits").mapInArrow(walk, "src long, dst long")
        out = walked if out is None else out.unionByName(walked)
        if not rows:
            return out
        state = state.join(maybe_broadcast(heavy, rows), group, "left_semi")


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, root) for each node of `edges` (src, dst): root is the smallest node
    reachable. In each round every node hooks to its least neighbour, pointers are jumped
    until all show to a root, and edges are taken between roots, where they soon vanish; a
    node that is no root is gone, so rounds are few. All is written."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct()
    both = materialize(both, f"{label}-edges")
    total = None
    while not both.isEmpty():
        up = materialize(both.groupBy(F.col("src").alias("node")).agg(F.least(F.first("src"), F.min("dst")).alias("root")), f"{label}-up")
        while True:
            over = up.select(F.col("node").alias("at"), F.col("root").alias("over"))
            jumped = materialize(up.join(over, up["root"] == over["at"]).select("node", F.col("over").alias("root"), (F.col("over") != F.col("root")).alias("moved")), f"{label}-up")
            up = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        if total is None:
            total = up
        else:
            later = up.select(F.col("node").alias("at"), F.col("root").alias("later"))
            total = materialize(total.join(later, total["root"] == later["at"], "left").select("node", F.coalesce("later", "root").alias("root")), f"{label}-total")
        ends = [up.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("src", "dst")]
        both = both.join(ends[0], "src").join(ends[1], "dst").select(F.col("src_root").alias("src"), F.col("dst_root").alias("dst"))
        both = materialize(both.where("src <> dst").distinct(), f"{label}-edges")
    return total if total is not None else both.select(F.col("src").alias("node"), F.col("dst").alias("root"))


def near_duplicates(docs: DataFrame, budget: int = 2, shingle: int = 3, seed: int = 42, subtrie: int = SUBTRIE) -> DataFrame:
    """(doc_id, fp, component_id) for every document."""
    return classes(materialize(fingerprints(docs, shingle, seed), "fp"), budget, subtrie).drop("class")


def classes(marked: DataFrame, budget: int = 2, subtrie: int = SUBTRIE) -> DataFrame:
    """Adds class (one of its fingerprints) and component_id to written rows (doc_id, fp,
    ...). Fingerprints are the nodes, so rows that share an id but not a text join nothing."""
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "nodes")
    known = nodes.where(F.col("rep").isNotNull())
    roots = components(links(known.select("fp", F.col("fp").alias("rep")), budget, subtrie)).select(F.col("node").alias("fp"), F.col("root").alias("class"))
    linked = materialize(roots.join(known, "fp").select("fp", "class", "rep"), "linked")
    least = linked.groupBy("class").agg(F.min("rep").alias("least"))
    named = nodes.join(linked.select("fp", "class").join(least, "class"), "fp", "left")
    named = named.select("fp", "n", F.coalesce("class", "fp").alias("class"), F.coalesce("least", "rep").alias("component_id"))
    named = materialize(named, "named")
    rows = named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # no more than BROADCAST_ROWS fingerprints can be hot
    hot = named.where(F.col("n") >= max(HOT, rows // BROADCAST_ROWS + 1)).drop("n")
    rest = named.where(F.col("n") < max(HOT, rows // BROADCAST_ROWS + 1)).drop("n")
    if hot.isEmpty():
        return marked.join(rest, "fp").select(*marked.columns, "class", "component_id")
    many = marked.join(F.broadcast(hot), "fp")
    few = marked.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(rest, "fp")
    return many.unionByName(few).select(*marked.columns, "class", "component_id")


def drop_near_duplicates(docs: DataFrame, budget: int = 2, shingle: int = 3) -> DataFrame:
    """Keeps one document of each class, all columns: the one whose doc_id is smallest. Of
    rows that share an id, those of other classes are judged in theirs; in one class the
    least by fingerprint and text hash stays, and one of rows with equal id and text.
    Rows without a doc_id stay.

    A row goes by its id and a 128-bit hash of its text, which both passes make anew, so
    the documents are neither numbered nor written."""
    key = ["id", "k1", "k2"]
    hashes = [F.xxhash64(F.col("text"), F.lit(i)).alias(f"k{i}") for i in (1, 2)]
    marked = materialize(fingerprints(docs, shingle, 42, *hashes), "fp")
    found = materialize(classes(marked, budget).withColumnRenamed("doc_id", "id"), "classes").where(F.col("id").isNotNull())
    firsts = found.where(F.col("id") == F.col("component_id")).groupBy(*key, "fp", "class").agg(F.count("*").alias("rows"))
    firsts = materialize(firsts, "firsts")
    tied = firsts.groupBy("id", "class").agg(F.min(F.struct("fp", "k1", "k2")).alias("least"), F.count("*").alias("n")).where(F.col("n") > 1)
    also = firsts.join(tied, ["id", "class"]).where(F.struct("fp", "k1", "k2") != F.col("least")).select(*key)
    gone = materialize(found.where(F.col("id") != F.col("component_id")).select(*key).unionByName(also).distinct(), "gone")
    rows = pack(docs, F.col("doc_id").cast("long").alias("id"), *hashes)
    kept = rows.join(maybe_broadcast(gone, gone.count()), key, "left_anti")
    again = firsts.where(F.col("rows") > 1).select(*key)
    n = again.count()
    if n:
        lone = kept.join(maybe_broadcast(again, n), key, "left_anti")
        kept = lone.unionByName(kept.join(maybe_broadcast(again, n), key, "left_semi").dropDuplicates(key))
    return kept.select("document.*")
