"""Personal data by weak supervision, in DataFrame functions only.

Patterns find candidate spans. Base candidates (emails, addresses, cards, phones
that pass their checks) are always spans; looser ones (masked emails, phones
without a plus, social security numbers) are spans if the classifier says so.

Base candidates that fail their checks are never spans, but the labelers learn from
them what false ones look like. Labelers vote +1, 0 or -1 on each candidate: the pattern's own check, gazetteers
(domains, area codes, reserved numbers), words of context, and the characters
around. Only counts of vote patterns (at most 3^6 a kind) reach the driver, where
expectation-maximisation estimates each labeler's reliability by kind (Dawid and
Skene 1979). Its posteriors train the final classifier, a logistic regression on
the span's features, again from counts of feature patterns; its weights come back
as column arithmetic. Spark runs no Python on the rows.

Patterns have no nested backtracking, and positions come from sums over pieces in
blocks, so a text with very many matches stays near linear.

Edge cases: a null text is empty and has no spans; overlapping spans of different
kinds are all reported (redaction joins them); repeated rows and null ids are rows
like any other; without candidates the classifier keeps base spans alone; an empty
table gives no rows. All columns of the input pass through; `detect` replaces one named
pii, and `redact` changes text and n_chars alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import others, pack, quoted

#: Kinds in the order of ties; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "ssn")
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


@dataclass(frozen=True)
class Pattern:
    kind: str
    base: bool
    find: str  # Java regular expression
    hint: str  # what a text must match for the search to be worth it
    valid: str  # condition on m, the match; base candidates that fail it are dropped


PATTERNS = (
    # a run is entered at its start, or where the last match ended
    Pattern("email", True, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "true"),
    Pattern("ip", True, r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", rf"m rlike '^{_OCTET}(?:[.]{_OCTET}){{3}}$'"),
    Pattern("card", True, r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "length(digits) between 12 and 19 and luhn_check(digits)"),
    Pattern("phone", True, r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", "length(digits) between 9 and 15"),
    Pattern("email", False, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?)[A-Za-z0-9-]++)++", r"[\[(]\x20?at\x20?[\])]", "true"),
    Pattern("phone", False, r"(?<![0-9+().-])(?<!\+[0-9]{1,3}[\x20.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])", r"[0-9]{3}[\x20.-][0-9]{4}", "true"),
    Pattern("ssn", False, r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "true"),
)
#: Context that speaks for each kind, and against any.
CUES = {
    "email": r"e-?mail|contact|write|reach|correo|courriel|adresse|kontakt|schreib",
    "ip": r"\bip\b|server|host|address|addr|login|from|client|node|gateway|adresse",
    "card": r"card|visa|master|amex|credit|debit|pay|karte|carte|tarjeta",
    "phone": r"phone|tel|call|mobile|cell|fax|sms|whatsapp|ruf|appel|llam",
    "ssn": r"ssn|social|security|tax\s?id|s\.s\.n",
}
AGAINST = r"order|invoice|version|isbn|issn|item|part\s?no|serial|ticket|build|release|\bv\.?$|#$|rfc|page|figure|section"
#: Endings of domains in common use.
DOMAINS = "com org net edu gov mil int io co info biz name me tv dev app de fr es it uk us ca au nl be ch at se no dk fi pl pt ie br mx ar cl in jp cn ru eu".split()
LEFT, RIGHT = 32, 12
VOTES = ("check", "gazetteer", "cue", "against", "edge", "shape")


def _running(sizes: Column, block: int = 64) -> Column:
    """Running sums of an array of ints, in blocks, so that long arrays don't cost their square."""
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / block).cast("int")), lambda b: F.slice(sizes, b * block + 1, F.lit(block)))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    heads = F.aggregate(cuts, F.array(F.lit(0)), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + total(c))))
    inner = lambda both: F.flatten(F.zip_with(both["c"], both["h"], lambda c, h: F.transform(F.sequence(F.lit(1), F.size(c)), lambda i: h + total(F.slice(c, F.lit(1), i)))))
    # bound once, as the only element of an array
    bound = F.transform(F.array(F.struct(cuts.alias("c"), F.slice(heads, F.lit(1), F.size(cuts)).alias("h"))), inner)
    return F.when(F.size(sizes) > 0, F.element_at(bound, 1)).otherwise(F.array().cast("array<int>"))


def candidates(docs: DataFrame) -> DataFrame:
    """Adds `cands` to rows (text, ...) of no other name in use here: array of (kind, base, start, end, check, gazetteer, cue,
    against, edge, shape, digits, before, after, long), start and end in code points."""
    text = F.coalesce("text", F.lit(""))
    df = docs
    for i, p in enumerate(PATTERNS):
        found = F.regexp_extract_all(text, F.lit(p.find), F.lit(0))
        hinted = text.contains("@") if p.hint == "@" else text.rlike(p.hint)
        df = df.withColumn(f"_m{i}", F.when(hinted, found).otherwise(F.array().cast("array<string>")))
    for i, p in enumerate(PATTERNS):
        m = F.col(f"_m{i}")
        gaps = F.transform(F.split(text, p.find, -1), F.length)
        # position of match k: gaps up to it and matches before it
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), m, lambda g, x: g + F.length(x))
        df = df.withColumn(f"_e{i}", F.when(F.size(m) > 0, _running(steps)).otherwise(F.array().cast("array<int>")))
    parts = []
    for i, p in enumerate(PATTERNS):
        parts.append(F.when(F.size(f"_m{i}") > 0, F.zip_with(F.col(f"_m{i}"), F.col(f"_e{i}"), _maker(text, p))).otherwise(F.array().cast(_TYPE)))
    return df.withColumn("cands", F.array_sort(F.concat(*parts))).drop(*(f"_{x}{i}" for x in "me" for i in range(len(PATTERNS))))


_TYPE = "array<struct<start:int,kind:int,end:int,base:boolean,check:int,gazetteer:int,cue:int,against:int,edge:int,shape:int,digits:int,before:int,after:int,long:int>>"


def _vote(yes: Column, no: Column | None = None) -> Column:
    v = F.when(yes, F.lit(1))
    return (v if no is None else v.when(no, F.lit(-1))).otherwise(F.lit(0))


def _maker(text: Column, p: Pattern):
    return lambda m, end: _candidate(text, p, m, end)


def _candidate(text: Column, p: Pattern, m: Column, end: Column) -> Column:
    start = end - F.length(m)
    digits = F.regexp_replace(m, "[^0-9]", "")
    left = F.lower(F.substring(text, F.greatest(start - LEFT, F.lit(0)) + 1, F.least(start, F.lit(LEFT))))
    right = F.substring(text, end + 1, F.lit(RIGHT))
    if p.kind == "ip":
        check = m.rlike(rf"^{_OCTET}(?:[.]{_OCTET}){{3}}$")
        gazetteer = _vote(~m.rlike(r"^(?:0|127|255|169[.]254|192[.]0[.]2|198[.]51[.]100|203[.]0[.]113)[.]"), m.rlike(r"^0+[.]"))
        shape = _vote(F.length(m) >= 9, F.length(m) < 8)
    elif p.kind == "card":
        check = F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
        gazetteer = _vote(digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), digits.rlike("^0"))
        shape = _vote(F.length(digits).isin(15, 16), F.length(digits) < 14)
    elif p.kind == "phone":
        check = F.length(digits).between(9, 15) if p.base else F.lit(True)
        area = digits if not p.base else F.regexp_replace(digits, "^1", "")
        gazetteer = _vote(area.rlike("^[2-9][0-8][0-9][2-9]"), area.rlike("^[01]"))
        shape = _vote(m.rlike(r"[()]|[0-9]-[0-9]{4}$"), m.rlike(r"[0-9]\.[0-9]"))
    elif p.kind == "ssn":
        check = ~m.rlike("^(?:000|666|9)|-00-|-0000$")
        gazetteer = _vote(~m.rlike("^(?:078-05-1120|219-09-9999)$"), m.rlike("^(?:000|666|9)"))
        shape = F.lit(0)
    else:
        check = F.lit(True)
        tld = F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1))
        gazetteer = _vote(tld.isin(*DOMAINS), tld.rlike("^[0-9]+$"))
        shape = _vote(F.length(m).between(6, 64), F.length(m) > 100)
    cue, against = CUES[p.kind], AGAINST
    edge = _vote(~left.rlike(r"[\p{L}\p{N}]$") & ~right.rlike(r"^[\p{L}\p{N}]"), left.rlike(r"[\p{L}\p{N}=/_]$") & right.rlike(r"^[\p{L}\p{N}=/_]"))
    int_ = lambda c, name: c.cast("int").alias(name)
    return F.struct(
        int_(start, "start"), F.lit(KINDS.index(p.kind)).alias("kind"), int_(end, "end"), F.lit(p.base).alias("base"),
        int_(_vote(check, ~check), "check"), int_(gazetteer, "gazetteer"), int_(_vote(left.rlike(cue) | F.lower(right).rlike(cue)), "cue"),
        int_(F.when(left.rlike(against), F.lit(-1)).otherwise(F.lit(0)), "against"), int_(edge, "edge"), int_(shape, "shape"),
        int_(F.least(F.floor(F.length(digits) / 4), F.lit(5)), "digits"), int_(_beside(left, "$"), "before"), int_(_beside(right, "^"), "after"),
        int_(F.least(F.floor(F.log2(F.length(m) + F.lit(1.0))), F.lit(6)), "long"),
    )


def _beside(text: Column, end: str) -> Column:
    """What a context has beside the span: 0 nothing or a blank, 1 a letter or digit, 2 a mark."""
    at = lambda chars: rf"[{chars}]$" if end == "$" else rf"^[{chars}]"
    return F.when((text == "") | text.rlike(at(r"\x20\x09-\x0D")), 0).when(text.rlike(at(r"\p{L}\p{N}")), 1).otherwise(2)


@dataclass
class Model:
    """Weights of the span classifier, and the label model they were learned from."""

    weights: dict[str, float] = field(default_factory=dict)
    reliability: dict[tuple[int, str], tuple[float, float]] = field(default_factory=dict)
    prior: dict[int, float] = field(default_factory=dict)


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def label_model(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 50) -> tuple[dict, dict, dict]:
    """Posteriors by (kind, votes), reliabilities (share of +1 votes among votes, of
    true and of false spans) by (kind, labeler), and priors by kind."""
    posterior, reliability, prior = {}, {}, {}
    for kind in sorted({k for k, _, _ in patterns}):
        own = [(v, n) for k, v, n in patterns if k == kind]
        post = {v: _sigmoid(1.0 * sum(v)) for v, _ in own}
        for _ in range(rounds):
            true = sum(n * post[v] for v, n in own)
            false = sum(n for _, n in own) - true
            share = (true + 2) / (true + false + 4)
            rel = []
            for j in range(len(VOTES)):
                t, f = [[1.0, 1.0, 1.0] for _ in range(2)]
                t[2], f[0] = 2.0, 2.0  # labelers are better than chance to begin with
                for v, n in own:
                    t[v[j] + 1] += n * post[v]
                    f[v[j] + 1] += n * (1 - post[v])
                rel.append(([x / sum(t) for x in t], [x / sum(f) for x in f]))
            post = {v: _sigmoid(math.log(share / (1 - share)) + sum(math.log(t[x + 1] / f[x + 1]) for x, (t, f) in zip(v, rel, strict=True))) for v, _ in own}
        prior[kind] = share
        for name, (t, f) in zip(VOTES, rel, strict=True):
            reliability[kind, name] = (t[2] / (t[0] + t[2]), f[2] / (f[0] + f[2]))
        posterior |= {(kind, v): p for v, p in post.items()}
    return posterior, reliability, prior


#: What the classifier sees besides votes, and how many values each has.
MEASURED = {"kind": len(KINDS), "digits": 6, "before": 3, "after": 3, "long": 7}


def _features(measured: tuple[int, ...], votes: tuple[int, ...], base: bool) -> list[str]:
    """Names of the features that are 1: the votes, what stands beside a span and how long
    it is, the latter for each kind by itself."""
    kind = measured[0]
    out = ["bias", f"base{int(base)}", *(f"{name}{x}" for name, x in zip(MEASURED, measured, strict=True)), *(f"kind{kind}{name}{x}" for name, x in zip(list(MEASURED)[1:], measured[1:], strict=True))]
    return out + [f"{name}{v}" for name, v in zip(VOTES, votes, strict=True) if v]


def fit(docs: DataFrame, rounds: int = 200, rate: float = 0.5) -> Model:
    """Learns from the candidates of all documents; only counts reach the driver."""
    spans = candidates(docs.select("text")).select(F.explode("cands").alias("c"))
    cols = [*MEASURED, *VOTES, "base"]
    counted = spans.groupBy(*(F.col(f"c.{c}").alias(c) for c in cols)).agg(F.count("*").alias("n")).collect()
    rows = [(tuple(r[c] for c in MEASURED), tuple(r[v] for v in VOTES), r["base"], r["n"]) for r in counted]
    votes: dict[tuple[int, tuple[int, ...]], int] = {}
    for seen, v, _, n in rows:
        votes[seen[0], v] = votes.get((seen[0], v), 0) + n
    posterior, reliability, prior = label_model([(k, v, n) for (k, v), n in sorted(votes.items())])
    weights: dict[str, float] = {}
    total = sum(n for *_, n in rows) or 1
    items = [(_features(m, v, b), posterior[m[0], v], n / total) for m, v, b, n in sorted(rows)]
    for _ in range(rounds):
        step: dict[str, float] = {}
        for names, y, share in items:
            e = share * (_sigmoid(sum(weights.get(x, 0.0) for x in names)) - y)
            for x in names:
                step[x] = step.get(x, 0.0) + e
        for x, g in step.items():
            weights[x] = weights.get(x, 0.0) - rate * (g + 1e-4 * weights.get(x, 0.0))
    return Model(weights, reliability, prior)


def _probability(c: Column, model: Model) -> Column:
    w = lambda name: F.lit(float(model.weights.get(name, 0.0)))
    z = w("bias") + F.when(c["base"], w("base1")).otherwise(w("base0"))
    for name, size in MEASURED.items():
        z = z + F.element_at(F.array(*(w(f"{name}{x}") for x in range(size))), c[name] + 1)
        if name != "kind":
            cells = F.array(*(w(f"kind{k}{name}{x}") for k in range(len(KINDS)) for x in range(size)))
            z = z + F.element_at(cells, c["kind"] * size + c[name] + 1)
    for v in VOTES:
        z = z + F.when(c[v] == 1, w(f"{v}1")).when(c[v] == -1, w(f"{v}-1")).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _found(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """(document, text, pii): the input's columns in one, so that none is in the way."""
    found = F.transform("cands", lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), c["base"].alias("base"), _probability(c, model).alias("probability"), (c["check"] == 1).alias("ok")))
    df = candidates(pack(docs, F.col("text").alias("text"))).withColumn("pii", F.filter(found, lambda c: F.when(c["base"], c["ok"]).otherwise(c["probability"] >= threshold)))
    return df.drop("cands")


def detect(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Adds `pii`: array of (start, kind, end, base, probability, ok), by start, then
    kind. A base candidate is a span if it passes its check, whatever the classifier
    says; a looser one if the classifier says so."""
    kept = docs.select(*others(docs, ["pii"])).columns
    return _found(docs, model, threshold).select(*(F.col("document." + quoted(c)) for c in kept), "pii")


def _is_base(kind: int):
    return lambda c: c["base"] & (c["kind"] == kind)


def digest(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, counts of base spans by kind, the hash of the base spans, all spans."""
    name = F.array(*(F.lit(k) for k in KINDS))
    shown = lambda a: F.array_join(F.transform(a, lambda c: F.concat_ws(":", F.element_at(name, c["kind"] + 1), c["start"], c["end"])), ",")
    base = F.filter("pii", lambda c: c["base"])
    counts = [F.size(F.filter("pii", _is_base(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    found = detect(docs.select("doc_id", "text"), model)
    return found.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"))


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with each span's text replaced by its kind in brackets;
    overlapping spans become one, named after the first. n_chars follows."""
    df = _found(docs, model, 0.5)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def cut(acc: Column, c: Column) -> Column:
        mark = F.concat(F.lit("["), F.upper(F.element_at(F.array(*(F.lit(k) for k in KINDS)), c["kind"] + 1)), F.lit("]"))
        fresh = c["start"] >= acc["at"]
        gap = F.substring(F.col("text"), acc["at"] + 1, c["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], c["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(gap, mark))).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    clean = F.when(F.size("pii") > 0, F.aggregate("pii", zero, cut, rest)).otherwise(F.col("text"))
    df = df.select("document", "pii", clean.alias("clean"))
    any_ = F.size("pii") > 0
    new = {"text": F.col("clean"), "n_chars": F.when(any_, F.length("clean"))}
    out = []
    for f in docs.schema.fields:
        old = F.col("document." + quoted(f.name))
        made = new.get(f.name.lower())
        out.append(old if made is None else (F.when(any_, made).otherwise(old).cast(f.dataType)).alias(f.name))
    return df.select(*out)
