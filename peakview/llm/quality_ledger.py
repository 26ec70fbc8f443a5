"""Quality rules as a bitmask ledger: measure once, judge many times. DataFrame functions only.

Every rule is evaluated once per text; the ledger keeps the measurements and
one bit per failed rule. A policy is a versioned mask: it keeps a text whose
failures don't meet its mask. Policies and ablations (what a rule alone costs
a policy) are bitwise work on the ledger and never touch the texts again.

Words are runs without space and \\x09-\\x0D. Null text has no words. Repeated
windows of eight words are found per text on 64-bit hashes of the windows,
sorted with their positions; a text whose window hashes are all different, as
most are, skips the sort. Repeated rows give repeated ledger rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
_BLANK = "[\\x20\\x09-\\x0D]"

#: rule -> failing condition over the measurements; the position is the bit. Append only: bits are stored.
RULES: list[tuple[str, str]] = [
    ("too_few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("too_many_words", "n_words > 10000000"),
    ("mean_word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 16 * n_words)"),
    ("symbols", "10 * n_symbols > 5 * n_words"),
    ("duplicate_lines", "n_lines > 0 and 100 * n_dup_lines > 60 * n_lines"),
    ("no_letters", "n_words > 0 and n_letters * 2 < word_chars"),
    ("mostly_capitals", "n_letters >= 200 and 100 * n_capitals > 95 * n_letters"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: version -> rules that drop a text
POLICIES: dict[str, list[str]] = {
    "v1-base": ["too_few_words", "repeated_windows"],
    "v2-shape": ["too_few_words", "repeated_windows", "mean_word_length", "no_letters"],
    "v3-strict": [name for name, _ in RULES],
}


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _wider(hashes: Column, width: int) -> Column:
    """Hashes of windows twice as wide: each with the one `width` words on."""
    return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + width)))


def _covered(windows: Column) -> Column:
    """Words that lie in a window whose hash occurs twice or more."""
    # (hash, start) sorted: a window is repeated if a neighbour has its hash
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda a, i, j: F.coalesce(F.get(a, i)["h"] == F.get(a, j)["h"], F.lit(False))
    twice = _let(placed, lambda a: F.filter(a, lambda x, i: same(a, i, i - 1) | same(a, i, i + 1)))
    at = F.array_sort(F.transform(twice, lambda x: x["i"]))
    return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
                       lambda acc, i: F.struct((acc["n"] + F.least(i - acc["last"], F.lit(WINDOW))).alias("n"), i.alias("last")),
                       lambda acc: acc["n"].cast("long"))


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of eight that occurs twice or more."""
    n = F.size(words) - (WINDOW - 1)
    eight = _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h1: _let(
        _wider(h1, 1), lambda h2: _let(_wider(h2, 2), lambda h4: _wider(h4, 4))))
    none = F.lit(0).cast("long")
    return F.when(n < 2, none).otherwise(_let(F.slice(eight, F.lit(1), F.greatest(n, F.lit(0))), lambda w: F.when(
        F.size(F.array_distinct(w)) == F.size(w), none).otherwise(_covered(w))))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` without its text, with the measurements."""
    keep = [c for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    solid = F.translate(text, " \t\n\x0b\f\r", "")
    words = F.array_remove(F.split(text, _BLANK + "+"), "")
    lines = F.filter(F.split(text, "\n"), lambda s: F.length(F.translate(s, " \t\x0b\f\r", "")) > 0)
    df = docs.select(*keep, text.alias("_text"), words.alias("_words"), lines.alias("_lines"), solid.alias("_solid"))
    return df.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length("_solid").cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_words")).alias("n_repeat_words"),
        F.length(F.regexp_replace("_solid", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace("_solid", r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"))


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Measurements and `fail_bits`, one bit per rule."""
    bits = F.lit(0).cast("long")
    for name, fails in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return measure(docs, text_col).withColumn("fail_bits", bits)


def mask_of(policy: list[str]) -> int:
    return sum(BIT[r] for r in policy)


def kept(policy: list[str]) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask_of(policy))) == 0


def ablations(book: DataFrame, policies: dict[str, list[str]] = POLICIES) -> DataFrame:
    """Per policy and rule: rows failed, rows dropped by this rule alone, rows the policy drops in all.

    The ledger is first reduced to its distinct failure patterns, at most 2^rules.
    """
    patterns = book.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    asked = book.sparkSession.createDataFrame(
        [(v, r, mask_of(p), BIT[r]) for v, p in policies.items() for r in p], "policy string, rule string, mask long, bit long")
    met = F.col("fail_bits").bitwiseAND(F.col("mask"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    # a few policies beside a few patterns
    return (asked.join(patterns, F.col("fail_bits") >= 0, "left").groupBy("policy", "rule")
            .agg(total(met.bitwiseAND(F.col("bit")) != 0).alias("failed"), total(met == F.col("bit")).alias("only_this"),
                 total(met != 0).alias("dropped")))


def judged(docs: DataFrame, policy: str = "v2-shape") -> DataFrame:
    """doc_id, the base measurements, base_failed, kept, fail_bits."""
    book = ledger(docs.select("doc_id", "text"))
    base = ~kept(POLICIES["v1-base"])
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       base.alias("base_failed"), (~base & kept(POLICIES[policy])).alias("kept"), "fail_bits")
