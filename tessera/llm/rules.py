"""Quality rules in a bitmask ledger.

Every rule is evaluated once. The ledger keeps the measurements and one failure
bit for each rule; a policy is a named, versioned mask of the rules that count, so
a new version, or the loss that one rule causes, is bit arithmetic on the ledger
and never reads a text again.

Edge cases: a null or blank text has no words (every count 0, fails rule 0); lines
without a word are no lines; repeated rows and null ids are rows like any other; an
empty table gives an empty ledger. Other columns pass through `measure`, `ledger` and
`verdicts` untouched; one with the name of a column that they add is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, others, pack, quoted

#: Rule by bit: name and failure condition, over the measurements, in integers.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines"),
    ("capitals", "2 * n_capitals > word_chars"),
    ("exclamations", "5 * n_exclamations > n_words"),
    ("digits", "3 * n_digits > word_chars"),
    ("ellipses", "10 * n_ellipses > 3 * n_lines"),
    ("long_lines", "n_lines > 0 AND n_words > 5000 * n_lines"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Measurements that are added.
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_digits", "n_exclamations", "n_ellipses"]
#: Policies: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_windows"),
    "web-1": ("few_words", "repeated_windows", "word_length", "symbols", "duplicate_lines"),
    "web-2": ("few_words", "repeated_windows", "word_length", "symbols", "duplicate_lines", "capitals", "exclamations", "digits", "ellipses"),
}
CURRENT = "web-2"


def mask(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def _repeat_words(h: Column) -> Column:
    """Words inside windows whose hash comes twice or more; h: hash by position."""
    placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        n = F.size(s) - 1
        twins = F.zip_with(F.slice(s, 1, n), F.slice(s, 2, n), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
        at = F.array_sort(F.array_distinct(F.flatten(twins)))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        step = lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + (p + 3 - F.greatest(p, a["end"]))).alias("n"))
        return F.aggregate(at, zero, step, lambda a: a["n"])

    # the sorted array is bound once, as the only element of an array
    return F.element_at(F.transform(F.array(placed), covered), 1)


def measure(docs: DataFrame) -> DataFrame:
    """Adds the measurements to all columns of `docs` (text)."""
    text = F.coalesce("text", F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    kept = docs.select(*others(docs, MEASURES)).columns
    docs = pack(docs, F.col("text").alias("text"))
    df = docs.withColumn("_words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    df = df.withColumn("_lines", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.greatest(F.size("_words") - 2, F.lit(0))
    pairs = F.zip_with(F.slice("_words", 1, n), F.slice("_words", 2, n), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("_windows", F.zip_with(pairs, F.slice("_words", 3, n), lambda h, c: F.xxhash64(h, c)))
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.aggregate("_words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)),
        "n_symbols": count(r"[#*$%&|<>]"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), _repeat_words(F.col("_windows"))).otherwise(F.lit(0)).cast("long"),
        "n_capitals": count(r"[A-Z]"), "n_digits": count(r"[0-9]"), "n_exclamations": count(r"!"), "n_ellipses": count(r"\.\.\.[\x20\x09\x0D]*(?:\n|$)"),
    })
    return df.select(*(F.col("document." + quoted(c)) for c in kept), *MEASURES)


def ledger(docs: DataFrame) -> DataFrame:
    """Adds the measurements and `failed`, the bits of the rules that fail."""
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, rule) in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measure(docs).withColumn("failed", failed)


def passes(failed: Column, policy: str) -> Column:
    return failed.bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablation(book: DataFrame, policies: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """For each policy and rule of it: documents kept, rejected by the rule, and
    rejected by it alone (kept if the rule were left out). Counts by bit pattern
    come first, so only as many rows as there are patterns meet the policies."""
    patterns = book.groupBy("failed").agg(F.count("*").alias("n"))
    cells = [F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit"), F.lit(mask(p)).cast("long").alias("mask")) for p in policies for r in POLICIES[p]]
    rows = patterns.select("failed", "n", F.inline(F.array(*cells)))
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).alias
    return rows.groupBy("policy", "rule").agg(total(hit == 0)("kept"), total(hit.bitwiseAND(F.col("bit")) != 0)("rejected"), total(hit == F.col("bit"))("rejected_alone"), F.bit_or(hit).alias("seen"))


def verdicts(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with base_failed and kept under the policy."""
    book = ledger(docs)
    base = ~passes(F.col("failed"), "base-1")
    return book.withColumns({"base_failed": base, "kept": ~base & passes(F.col("failed"), policy)})


def _sql() -> str:
    n = lambda pattern: f"len(regexp_extract_all(t, '{pattern}'))::BIGINT"
    bits = " | ".join(f"(CASE WHEN {rule} THEN {1 << i} ELSE 0 END)" for i, (_, rule) in enumerate(RULES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT r, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
rep AS (SELECT r, count(DISTINCT i + k)::BIGINT AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  {n("[#*$%&|<>]")} AS n_symbols, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  {n("[A-Z]")} AS n_capitals, {n("[0-9]")} AS n_digits, {n("!")} AS n_exclamations, {n("[.][.][.][ \\x09\\x0D]*(?:\\n|$)")} AS n_ellipses
  FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, ({bits})::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {mask("base-1")}) != 0 AS base_failed,
  (failed & {mask("base-1") | mask(CURRENT)}) = 0 AS kept, failed FROM b
"""


SQL = _sql()
