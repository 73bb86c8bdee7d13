"""Each query against brute force, on a small corpus with every odd case, and on
empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import brown, chat, decontam, langid, mixing, pii, quality, rules, simhash, toxicity
from tessera.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, size long, fp long, _words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def corpus():
    rng = random.Random(3)
    vocabulary = {"en": "the and of ing tion er with house river stone walk".split(), "de": "und der die nicht zwischen haus fluss stein gehen über".split()}
    rows = []

    def add(text, lang="en", source="a"):
        rows.append((len(rows), text, lang, source, None if text is None else len(text), 0.5, 1, 7, 3, "x"))

    for i in range(140):
        lang = "de" if i % 3 == 0 else "en"
        words = [rng.choice(vocabulary[lang]) + rng.choice(["", "s", "en", "er"]) for _ in range(rng.randint(55, 160))]
        if i % 5 == 0:
            words[10:10] = ["you", "stupid", "idiot", "moron", "loser"]
        if i % 7 == 0:
            words = [w + "$$$" for w in words]
        add(" ".join(words) + (".\nLine again\nLine again" if i % 4 == 0 else ""), lang, ["a", "b", None, "hot", "hot", "hot"][i % 6])
    base = rows[1][1]
    for _ in range(4):
        add(base)
    add(base.replace("the", "tha", 1))
    add(None, None, None)
    add("", "en", "a")
    add(" \t\n ", "en", "b")
    add("one", "en", "b")
    add("12345 !!! ...", None, "b")
    add("aa " * 6000 + "é" * 50, "de", "hot")
    add("mail me at a.b@c.d_e@f.g or x@y, host 1.2.3.4.5.6.7.8 and 300.1.1.1, card 4111 1111 1111 1111 or 4111-1111-1111-1112, call +1 (212) 555-0153. ok", "en", "a")
    add("😀 mañana +49 30 123456789 0 😀 user@mail.example.com; call 212-555-0153 or ssn 078-05-1121; b [at] c [dot] org", "en", "a")
    add("A zero one two three four five six seven eight nine ten eleven tail", "en", "b")
    add("short item", "en", "b")
    add("x Short ITEM y short-item", "en", "b")
    rows.append(rows[3])
    rows.append((None, "no id here " * 9, "en", "a", 99, None, None, None, None, None))
    return rows


ITEMS = [(1, "Zero one two three four five six seven eight nine ten eleven"), (2, "short item"), (3, None), (4, " .. "), (1, "short item"), (7, "never seen anywhere in this corpus at all by any chance"), (None, "short item")]
TURNS = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (2, 2, "user", "more"), (3, 0, "user", "hi"), (4, 0, "user", "hi"), (4, 1, "assistant", "yo"), (4, 2, "user", "more"), (5, 0, "user", None), (6, 0, "user", ""), (6, 1, None, "x"), (7, None, "user", "t"), (7, 0, "user", "a"), (7, 0, "user", "a"), (8, 0, "user", "a"), (None, 0, "user", "z"), (9, 0, "user", "yo"), (9, 1, "assistant", "hi")]
# rows repeated under a turn: 21 is no prefix of 22 (its turn 1 is another), 23 is one of 24
TURNS += [(21, 0, "user", "p"), (21, 1, "bot", "q"), (22, 0, "user", "p"), (22, 1, "bot", "q"), (22, 1, "bot", "q"), (23, 0, "z", "p"), (23, 1, "bot", "q"), (24, 0, "z", "p"), (24, 1, "bot", "q"), (24, 2, "bot", "q"), (24, 2, "bot", "a")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    rows = corpus()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(r[0], int(not r[1] or "$$$" not in r[1]), int(bool(r[1]) and "idiot" in r[1])) for r in rows if r[0] is not None] + [(None, 1, 1), (3, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(*t, 1) for t in TURNS], "conv_id long, turn long, role string, text string, n_rows int").write.parquet(f"{d}/conversations.parquet")
    return d


@pytest.fixture(scope="module")
def bare(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("bare"))
    for name, kind in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string"), ("conversations", "conv_id long, turn long, role string, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{d}/{name}.parquet")
    return d


@pytest.fixture(scope="module")
def got(spark, folder):
    held = {}

    def run(name):
        if name not in held:
            held[name] = [r.asDict() for r in QUERIES[name](spark, folder).collect()]
        return held[name]

    return run


def texts():
    return [(r[0], r[1] or "") for r in corpus()]


def by_id(rows, key="doc_id"):
    return {r[key]: r for r in rows}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, bare, name):
    assert QUERIES[name](spark, bare).collect() == []


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "op7_chat_format"])
def test_one_row_a_document(got, name):
    assert Counter(r["doc_id"] for r in got(name)) == Counter(r[0] for r in corpus())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, folder, got, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    want = sorted(repr([dict(zip(names, r, strict=True))[k] for k in sorted(names)]) for r in cur.fetchall())
    assert sorted(repr([r[k] for k in sorted(r)]) for r in got(name)) == want


def spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        g = re.sub("[^0-9]", "", m[0])
        if 12 <= len(g) <= 19 and sum((x := int(c) * (1 + i % 2)) - 9 * (x > 9) for i, c in enumerate(reversed(g))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_pii_base(got):
    rows = by_id(got("op1_pii"))
    for i, t in texts():
        if i is None:
            continue
        b = spans(t)
        shown = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in b]
        r = rows[i]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == j for _, k, _ in b) for j in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert set(shown) <= set(r["spans"].split(",") if r["spans"] else [])


def test_pii_adds_and_redacts(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = pii.fit(docs)
    out = pii.redact(docs, model)
    assert out.columns == docs.columns
    text = next(r.text for r in out.collect() if r.text and "mañana" in r.text)
    assert "user@mail" not in text and "[EMAIL]" in text and "[PHONE]" in text and "😀 mañana" in text


CLASHES = ["document", "cands", "pii", "_m0", "_e0", "m", "k1", "k2", "rid", "Score", "predicted", "N_WORDS", "failed", "kept", "_words", "_lines", "_windows", "size", "copies", "target", "row", "fp", "clean", "word_chars"]


@pytest.mark.parametrize("name,call,replaced", [
    ("detect", lambda d: pii.detect(d, pii.fit(d)), {"pii"}),
    ("redact", lambda d: pii.redact(d, pii.fit(d)), set()),
    ("ledger", rules.verdicts, {"N_WORDS", "failed", "kept", "word_chars"}),
    ("quality", lambda d: quality.score_documents(d, quality.Constant(0.6)), {"Score", "predicted"}),
    ("quality kept", lambda d: quality.score_documents(d, quality.Constant(0.9), keep=True), set()),
    ("mark", mixing.mark, {"copies"}),
    ("near", simhash.drop_near_duplicates, set()),
])
def test_clashing_names(spark, name, call, replaced):
    """An added column replaces the input's of its name; any other comes through."""
    rows = [(1, "call +49 30 123456789 now " + "word " * 60, "s", 7), (2, None, None, None), (3, "", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    out = call(docs)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    assert {c for c in docs.columns if c not in replaced} <= set(out.columns) and not {c for c in replaced if c in out.columns and c != c.lower()}
    got = out.collect()
    assert got and all(r[c] == f"own {c}" for r in got for c in CLASHES if c not in replaced)


def test_pii_many_matches(spark):
    text = " ".join(f"u{i}@h{i}.org" for i in range(3000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = pii.digest(docs, pii.Model()).first()
    assert r.n_email == 3000
    assert r.base_sha256 == hashlib.sha256(",".join(f"email:{s}:{e}" for s, _, e in spans(text)).encode()).hexdigest()


def test_pii_reliabilities():
    rng = random.Random(0)
    seen = Counter()
    for _ in range(4000):
        y = rng.random() < 0.4
        seen[tuple((1 if (rng.random() < a) == y else -1) if rng.random() < 0.8 else 0 for a in (0.95, 0.9, 0.85, 0.8, 0.6, 0.7))] += 1
    posterior, reliability, prior = pii.label_model([(0, v, n) for v, n in sorted(seen.items())])
    assert 0.3 < prior[0] < 0.5
    assert reliability[0, "check"][0] > 0.88 > 0.2 > reliability[0, "check"][1]
    assert reliability[0, "check"][0] > reliability[0, "edge"][0]


def test_language(got):
    rows = by_id(got("op2_language_id"))
    assert {r["lang_pred"] for r in rows.values()} <= {"en", "de", "und"}
    for i, t in texts():
        if i is not None:
            r = rows[i]
            assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
            assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, t)))
            assert 0 <= r["score"] <= 1
    right = [rows[r[0]]["lang_pred"] == r[2] for r in corpus()[:140]]
    assert sum(right) / len(right) > 0.97


def test_language_rejects(spark):
    assert langid.has_letter("é") and not langid.has_letter("12 ²_")


def test_rule_ablation(spark, folder):
    book = rules.ledger(spark.read.parquet(f"{folder}/documents.parquet")).cache()
    bits = [r.failed for r in book.collect()]
    for r in rules.ablation(book).collect():
        m, b = rules.mask(r.policy), rules.BIT[r.rule]
        assert r.kept == sum(not x & m for x in bits)
        assert r.rejected == sum(bool(x & b) for x in bits)
        assert r.rejected_alone == sum(x & m == b for x in bits)


def test_rule_counts_by_hand(spark):
    text = "a b c a b c\nx $ x\n\nx $ x\n"
    r = rules.verdicts(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_words, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.word_chars) == (12, 2, 1, 12, 12)
    assert r.base_failed and not r.kept


def brute_hits(t):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    windows = {}
    for i, x in ITEMS:
        w = find(lower(x or ""))
        if i is not None and w:
            for s in range(max(1, len(w) - 9)):
                windows.setdefault(tuple(w[s : s + 10]), set()).add(str(i))
    w = find(lower(t))
    hit, items = [0] * len(w), set()
    for k, names in windows.items():
        for s in range(len(w) - len(k) + 1):
            if tuple(w[s : s + len(k)]) == k:
                items |= names
                hit[s : s + len(k)] = [1] * len(k)
    return len(w), sum(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def test_decontamination(got):
    rows = by_id(got("op4_decontamination"))
    for i, t in texts():
        if i is not None:
            r = rows[i]
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == brute_hits(t)
            assert r["contaminated"] == (r["n_hit"] > 0)
    assert sum(r["contaminated"] for r in rows.values()) >= 3


def test_decontamination_by_shuffle(spark, folder, monkeypatch):
    """A benchmark too large to broadcast, with and without hot shingles: the same answer.
    Columns named as added ones are replaced, others come through."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", F.lit(7).alias("N_Words"), F.lit(8).alias("rid"), F.lit(9).alias("k1"), F.lit(10).alias("document"))
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    answer = lambda df: sorted(map(repr, df.drop("text").collect()))
    one, kept = decontam.flag(docs, items), decontam.flag(docs, items, keep=True)
    assert one.columns == ["doc_id", "text", "rid", "k1", "document", *decontam.ADDED]
    assert kept.columns == docs.columns and all((r.rid, r.k1, r.document, r.N_Words) == (8, 9, 10, 7) for r in kept.collect())
    want = answer(one), answer(kept)
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    for hot in (1, 10**9):
        monkeypatch.setattr(decontam, "HOT", hot)
        assert (answer(decontam.flag(docs, items)), answer(decontam.flag(docs, items, keep=True))) == want


def test_decontamination_of_passages(spark):
    """Random passages of items in random texts, against every window."""
    rng = random.Random(9)
    item = lambda: [rng.choice(["a", "b", "c", "d1", "Été", "f"]) for _ in range(rng.choice([2, 9, 10, 11, 30]))]
    items = [(i, item()) for i in range(30)]
    docs = [(i, sum((rng.choice([w[rng.randrange(len(w)) :][: rng.randint(1, 14)], [rng.choice("abcfxyz")]]) for _, w in rng.choices(items, k=12)), [])) for i in range(60)]
    found = decontam.flag(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string"), spark.createDataFrame([(i, ", ".join(w)) for i, w in items], "item_id long, text string"))
    rows = by_id([r.asDict() for r in found.collect()])
    low = [(str(i), [lower(x) for x in w]) for i, w in items]
    for i, w in docs:
        w, hit, names = [lower(x) for x in w], set(), set()
        for name, x in low:
            for win in [x[s : s + 10] for s in range(max(1, len(x) - 9))]:
                for s in range(len(w) - len(win) + 1):
                    if w[s : s + len(win)] == win:
                        names.add(name)
                        hit.update(range(s, s + len(win)))
        assert (rows[i]["n_hit"], rows[i]["n_items"]) == (len(hit), len(names))
        assert rows[i]["items_sha256"] == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def test_toxicity(got):
    rows = by_id(got("op5_toxicity"))
    for i, t in texts():
        if i is not None:
            assert rows[i]["predicted"] == int("idiot" in t) == int(rows[i]["score"] >= 0.5)
            assert rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_copies_are_alike(spark):
    """Texts that share some words stay; exact and near copies go, within a label."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=9))
    common = [word() for _ in range(20)]
    texts = [" ".join([word() for _ in range(60)] + common) for _ in range(30)]
    near = texts[0].split()
    near[7] = "new"
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(100, texts[0], 0), (101, " ".join(near), 0), (102, texts[0], 1), (103, None, 0), (104, "", 0)]
    left = {r.doc_id for r in toxicity.distinct_texts(spark.createDataFrame(rows, "doc_id long, text string, label int")).collect()}
    assert left == {*range(30), 102, 103}


def test_label_model_discounts_copies():
    rng = random.Random(1)
    seen = Counter()
    for _ in range(5000):
        y = rng.random() < 0.3
        v = [int(rng.random() < (0.8 if y else 0.05)) for _ in range(len(toxicity.VOTERS))]
        v[1] = v[2] = v[0]
        seen["".join("-0+"[x + 1] for x in v)] += 1
    m = toxicity.label_model(dict(seen), 0.3)
    assert m.weight[0] < 0.5 < m.weight[5]
    assert m.correlation[0, 1] > 0.9


def test_mix_near_target(got):
    by = {}
    for r in got("op6_source_mix"):
        s = by.setdefault(r["source"], [0, r["target"], 0])
        s[0] += r["taken"]
        s[2] = max(s[2], r["size"])
        assert r["taken"] <= 3 * r["size"]
    total = sum(len(WORD.findall(t)) for _, t in texts())
    assert sum(s[1] for s in by.values()) == pytest.approx(total)
    for taken, target, most in by.values():
        assert abs(taken - target) <= 2 * most


def test_mix_caps_targets(spark):
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate([("a", 600), ("b", 10), ("c", 20)])], "doc_id long, text string, source string")
    t = {r.source: r.target for r in mixing.targets(mixing.sizes(docs)).collect()}
    assert t == pytest.approx({"a": 540, "b": 30, "c": 60})


def test_mix_order_is_not_the_split(spark, folder, monkeypatch):
    """Other buckets, other partitions: the same copies. Ids with a common factor are dealt as well."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("doc_id", F.col("doc_id") * 64)
    show = lambda d: sorted(map(repr, mixing.mix(d).collect()))
    want = show(docs)
    monkeypatch.setattr(mixing, "DIGITS", 1)
    assert show(docs.repartition(7)) == want


def test_chat(got):
    rows = by_id(got("op7_chat_format"), "conv_id")
    assert sorted(rows) == [2, 5, 6, 7, 8, 9, 21, 22, 24]
    assert rows[2]["n_copies"] == 2
    assert rows[6]["rendered"] == "<|im_start|>user\n<|im_end|>\n<|im_start|>unknown\nx<|im_end|>\n"


def test_chat_long(spark):
    turns = [(1, i, "user", str(i)) for i in range(3000)] + [(2, i, "user", str(i)) for i in range(2999)] + [(3, i, "user", str(i + (i == 2500))) for i in range(2600)]
    kept = chat.maximal(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert sorted(r.conv_id for r in kept.collect()) == [1, 3]


def test_quality(got):
    rows = by_id(got("op8_quality_classifier"))
    wrong = [i for i, t in texts()[:140] if rows[i]["predicted"] != int("$$$" not in t)]
    assert len(wrong) <= 3
    for i, _ in texts():
        if i is not None:
            assert rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
            assert 0 <= rows[i]["score"] <= 1 and rows[i]["predicted"] == int(rows[i]["score"] >= 0.7)


def brute_passages(t):
    """Measurements of each passage, letter by letter."""
    data = (t or "").encode()
    spans = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    cuts = [0, *(spans[i][0] for i in range(quality.PASSAGE, len(spans), quality.PASSAGE)), len(data)]
    out = []
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        own = [data[x:y].lower() for x, y in spans[k * quality.PASSAGE : (k + 1) * quality.PASSAGE]]
        row = [0.0] * quality.WIDTH
        if own:
            for i in range(max(a, 1), b):
                row[int(quality._CLASS[data[i - 1]]) * quality.KINDS + int(quality._CLASS[data[i]])] += 1
            row = [math.sqrt(x / max(1, b - a)) for x in row]
            m, n = len(own), -(-len(spans) // quality.PASSAGE)
            three = list(zip(own, own[1:], own[2:], strict=False))
            row[-8:] = [len(set(own)) / m, sum(x == y for x, y in zip(own, own[1:], strict=False)) / m, (len(three) - len(set(three))) / m, sum(len(w) > 15 for w in own) / m, min(1.0, (b - a) / m / 20), m / quality.PASSAGE, min(1.0, n / 50), 1.0]
        out.append(row)
    return np.array(out)


@pytest.mark.parametrize("text", ["", None, " \n", "one", "ab\x01 c\x1c d " * 90, "".join(f"w{i}{'!' * (i % 3)} " for i in range(205)), "é" * 30 + "\u00a0x\x85 y" * 150, "A a a a\n" * 80])
def test_passages_by_brute_force(text):
    want = brute_passages(text)
    got = quality.passages(None if text is None else text.encode())
    assert got.shape == want.shape and np.allclose(got, want, atol=1e-5)


def test_scores_by_brute_force(spark):
    """Gated attention and the weighted passage, bag by bag."""
    rng = np.random.default_rng(2)
    m = quality.Attention(quality.WIDTH, seed=1)
    m.mean, m.scale, m.shift = rng.normal(size=quality.WIDTH), rng.uniform(1, 2, quality.WIDTH), 0.3
    texts = ["a b c " * 100, "", None, "x! " * 350]
    p = m.p
    for r in quality.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), m).collect():
        h = [np.tanh(((x - m.mean) / m.scale) @ p["W"] + p["b"]) for x in quality.passages((texts[r.doc_id] or "").encode())]
        a = [math.exp(float((np.tanh(v @ p["V"]) / (1 + np.exp(-(v @ p["U"])))) @ p["w"])) for v in h]
        z = float(sum(x / sum(a) * v for x, v in zip(a, h, strict=True)) @ p["c"] + p["d"][0]) + m.shift
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)
        assert r.predicted == int(r.score >= 0.7)


def test_attention_gradient():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(rng.integers(1, 9), 6)) for _ in range(300)]
    y = np.array([float((b[:, 0] > 1.2).any()) for b in bags])  # one passage decides
    size = np.array([len(b) for b in bags])
    m = quality.Attention(6, 16, 8)
    m.fit(np.concatenate(bags), np.cumsum(size) - size, y, epochs=150)
    assert np.mean((m.scores(np.concatenate(bags), np.cumsum(size) - size) > 0.5) == y) > 0.93


def test_language_model(got):
    tokens = [(i, WORD.findall(lower(t)) + [" "]) for i, t in texts()]
    seen = Counter()
    for i, w in tokens:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            seen.update(w)
    total, distinct = sum(seen.values()), len(seen)
    rows = by_id(got("op9_brown_lm"))
    for i, w in tokens:
        if i is not None:
            r = rows[i]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(seen[x] > 0 for x in w), total)
            assert r["base_score"] == pytest.approx(sum(math.log10((seen[x] + 1) / (total + distinct + 1)) for x in w), rel=1e-9)
    assert sum(r["score"] for r in rows.values()) > sum(r["base_score"] for r in rows.values())


def test_language_model_is_a_distribution(spark, folder, monkeypatch):
    """Given a class, the words and the unseen sum to one; so do transitions. Rare words
    take the join: the same scores as when all are frequent."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model, counts = brown.fit(docs)
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    held = F.lit(False)
    a = {(r.doc_id, r.n_tokens): r.score for r in brown.score(docs, model, counts, held).collect()}
    monkeypatch.setattr(brown, "FREQUENT", 9)
    monkeypatch.setattr(brown, "CLUSTERED", 9)
    few, counts = brown.fit(docs)
    assert len(few.words) <= 9
    b = brown.score(docs, few, counts, held)
    assert {(r.doc_id, r.n_tokens) for r in b.collect()} == set(a)
    c = by_id([r.asDict() for r in b.collect()])
    d = by_id([r.asDict() for r in brown.score(docs, model, counts, held).collect()])
    assert all(c[i]["base_score"] == pytest.approx(d[i]["base_score"]) and c[i]["n_known"] == d[i]["n_known"] for i in c)


def test_language_model_clusters_rare_words(spark, monkeypatch):
    """Words that are no unit by themselves, alike in ending, join the units that have the
    same words beside them."""
    monkeypatch.setattr(brown, "CLUSTERED", 6)
    monkeypatch.setattr(brown, "FREQUENT", 20)
    rng = random.Random(3)
    slot = lambda x: x * 2 if rng.random() < 0.5 else f"{x}{rng.randrange(60)}xx"
    lines = [" ".join(w for _ in range(30) for w in (("aa", slot("m"), "bb") if rng.random() < 0.5 else ("cc", slot("n"), "dd"))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    model, placed = brown.fit(docs)
    rows = placed.collect()
    tail = Counter(w for t in lines for w in t.split() if len(w) > 2)
    assert {r.word.decode(): r.c for r in rows} == dict(tail)
    of = {w: int(model.kinds[i]) for i, w in enumerate(model.words)}
    assert of[b"mm"] != of[b"nn"]
    assert all(r.k == of[b"mm" if r.word[:1] == b"m" else b"nn"] for r in rows)
    assert model.table.sum() == sum(len(t.split()) + 1 for t in lines)


def test_gains_by_brute_force():
    rng = np.random.default_rng(1)
    table = rng.integers(20, 60, (5, 5)).astype(float)
    out, into, home = rng.integers(0, 3, (4, 5)).astype(float), rng.integers(0, 3, (4, 5)).astype(float), np.array([0, 1, 2, 3])
    f = lambda x: (x * np.log(np.maximum(x, 1.0))).sum()
    got = brown.gains(table, out, into, home)
    for w in range(4):
        want = []
        for k in range(5):
            t = table.copy()
            t[home[w], :] -= out[w]
            t[:, home[w]] -= into[w]
            t[k, :] += out[w]
            t[:, k] += into[w]
            want.append(f(t) - f(t.sum(axis=1)) - f(t.sum(axis=0)))
        assert np.allclose(np.array(want) - want[0], got[w] - got[w, 0])


def test_gains_from_tables():
    """The same for words of few tokens as for any, up to the gain of staying at home."""
    rng = np.random.default_rng(5)
    k, n = 7, 400
    table = rng.integers(30, 90, (k, k)).astype(float)
    out, into, home = np.zeros((n, k)), np.zeros((n, k)), rng.integers(0, k, n)
    for w in range(n):
        for _ in range(rng.integers(1, 12)):
            out[w, rng.integers(k)] += 1
            into[w, rng.integers(k)] += 1
    assert np.allclose(brown.gains(table, out, into, home), brown.Steps(table)(out, into, home))


def test_exchange_finds_classes():
    rng = np.random.default_rng(0)
    truth = np.arange(24) % 3
    follow = np.array([[0.05, 0.9, 0.05], [0.05, 0.05, 0.9], [0.9, 0.05, 0.05]])
    counts = np.zeros((24, 24))
    at = 0
    for _ in range(30000):
        nxt = rng.choice(np.flatnonzero(truth == rng.choice(3, p=follow[truth[at]])))
        counts[at, nxt] += 1
        at = nxt
    home = brown.exchange(counts, 3)
    assert all(len({home[i] for i in np.flatnonzero(truth == k)}) == 1 for k in range(3))


def brute_fingerprint(t):
    w = WORD.findall(lower(t))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    n = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for k in range(64):
            n[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * n[k] > len(shingles))


def test_simhash(got):
    rows = by_id(got("op10_simhash"))
    fps = {i: brute_fingerprint(t) for i, t in texts() if i is not None}
    root = dict(zip(fps, fps, strict=True))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if b < a and (fps[a] ^ fps[b]).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    for i in ids:
        assert rows[i]["fingerprint"] == f"{fps[i]:016x}"
        assert rows[i]["component_id"] == find(i)


@pytest.mark.parametrize("budget,subtrie", [(2, 100), (2, 10_000), (5, 300)])
def test_trie_join_is_exact(spark, budget, subtrie):
    """Also where sub-tries are over the bound and have to be cut deeper, again and again."""
    rng = random.Random(subtrie)
    fps = set()
    while len(fps) < 1500:
        x = rng.getrandbits(64) if rng.random() < 0.3 or not fps else rng.choice(sorted(fps)[:50])
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    nodes = [(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(sorted(fps))]
    edges = simhash.links(spark.createDataFrame(nodes, "fp long, rep long"), budget, subtrie)
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    order = sorted(fps)
    root = list(range(len(order)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(order)):
        for b in range(a):
            if (order[a] ^ order[b]).bit_count() <= budget:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert all(found.get(i, i) == find(i) for i in range(len(order)))
    assert len(found) == sum(find(i) != i or any(find(j) == i for j in range(len(order)) if j != i) for i in range(len(order)))


def test_near_duplicates_lose_no_other_text(spark):
    """Rows that share an id but not a text are judged each in its class; equal rows are one;
    columns named as the working ones come through."""
    words = [" ".join(random.Random(i).choices("abcdefghijklmnop", k=80)) for i in range(4)]
    rows = [(1, words[0], 11), (1, words[1], 12), (1, words[1], 12), (2, words[0], 13), (3, words[2], 14), (None, words[2], 15), (None, words[3], 16), (5, None, 17), (6, "", 18)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 long").withColumns({c: F.lit(c) for c in ("document", "k2", "id", "fp", "component_id")})
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(r.k1 for r in out.collect()) == [11, 12, 14, 15, 16, 17]


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(900, 901)]
    random.Random(0).shuffle(edges)
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == {i: 0 for i in range(301)} | {900: 900, 901: 900}
    rng = random.Random(2)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(-5, 7)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    while True:
        new = {x: min([root[x]] + [root[b] for a, b in edges if a == x and a != b] + [root[a] for a, b in edges if b == x and a != b]) for x in root}
        if new == root:
            break
        root = new
    got = simhash.components(spark.createDataFrame(edges, "src long, dst long"))
    assert {r.node: r.root for r in got.collect()} == root
