"""Quality rules as a bitmask ledger.

`ledger` evaluates each rule once per document and stores one failure bit for each rule beside the
measurements. A policy is a named, versioned set of rules; `apply_policy` and `ablation` work on the bits
alone, so a changed policy never reads a text again. Built-in column expressions only.

Defined results: a null or empty text has zero words and fails `few_words`; repeated rows are measured one by
one; an empty table gives an empty ledger; other columns are passed through, but a column named as one of the
ledger's own is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import check_columns, words

WINDOW = 5

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "n_alpha_words", "n_caps_words", "n_distinct_words", "n_pipe_words",
)


@dataclass(frozen=True)
class Rule:
    """`fails` is a condition over the measurements; `bit` never changes once given out."""

    bit: int
    name: str
    fails: str


RULES: tuple[Rule, ...] = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "word_length", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    Rule(3, "symbols", "10 * n_symbols > 2 * n_words"),
    Rule(4, "duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule(5, "few_letters", "10 * n_alpha_words < 6 * n_words"),
    Rule(6, "capitals", "10 * n_caps_words > 4 * n_words"),
    Rule(7, "poor_vocabulary", "n_words >= 50 AND 10 * n_distinct_words < n_words AND 100 * n_repeat_words > 10 * n_words"),
    Rule(8, "tables", "10 * n_pipe_words > 2 * n_words"),
)

#: Version -> rules of the policy.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_words"),
    "web-1": tuple(r.name for r in RULES),
}


def _let(value: Column, body) -> Column:
    """Binds a value once: `body` may use it any number of times."""
    return F.transform(F.array(value), body)[0]


def _covered(windows: Column) -> Column:
    """Words under the windows that occur twice or more; `windows` are the hashes by start."""

    def count(s: Column) -> Column:
        same = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
        starts = F.sort_array(F.transform(same, lambda x: x["i"]))
        zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(starts, zero, lambda a, q: F.struct(q.alias("last"), (a["n"] + F.least(F.lit(WINDOW), q - a["last"])).alias("n")))["n"]

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(ordered, count))


def _window_hashes(w: Column) -> Column:
    """64-bit hash of each window of `WINDOW` words. A false match needs two of one text's windows to collide."""
    return _let(w, lambda v: F.when(
        F.size(v) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(v) - WINDOW), lambda i: F.xxhash64(*[F.get(v, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>")))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the columns `MEASURES` (bigint)."""
    check_columns(docs, text)
    kept = [F.col(c) for c in docs.columns if c not in MEASURES]
    content = F.coalesce(F.col(text), F.lit(""))
    # an overwritten text column (say, one named n_words) would be a caller's mistake; the name is kept apart
    a = docs.select(*kept, content.alias("__text"), words(F.col(text)).alias("__words"), F.filter(F.split(content, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"))
    b = a.select("*", _window_hashes(F.col("__words")).alias("__windows"))
    of = F.col("__words")
    measured = {
        "n_words": F.size(of),
        "word_chars": F.length(F.array_join(of, "")),
        "n_symbols": F.length(F.regexp_replace("__text", r"[^#*$%&|<>]+", "")),
        "n_lines": F.size("__lines"),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": _covered(F.col("__windows")),
        "n_alpha_words": F.size(F.filter(of, lambda x: x.rlike(r"\p{L}"))),
        "n_caps_words": F.size(F.filter(of, lambda x: x.rlike(r"^\P{L}*\p{Lu}\P{Ll}*\p{Lu}\P{Ll}*$"))),
        "n_distinct_words": F.size(F.array_distinct(of)),
        "n_pipe_words": F.size(of) - F.size(F.array_remove(of, "|")),
    }
    return b.select(*kept, *[measured[m].cast("bigint").alias(m) for m in MEASURES])


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """`measure` with `failed_bits`: bit k is set where the rule with bit k fails."""
    if len({r.bit for r in rules}) != len(rules) or any(not 0 <= r.bit < 63 for r in rules):
        raise ValueError("each rule needs a bit of its own from 0 to 62")
    bits = F.lit(0).cast("bigint")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(0).cast("bigint"))
    return measure(docs, text).withColumn("failed_bits", bits)


def policy_mask(policy: str, rules: tuple[Rule, ...] = RULES) -> int:
    bit = {r.name: r.bit for r in rules}
    return sum(1 << bit[n] for n in POLICIES[policy])


def apply_policy(book: DataFrame, policy: str = "web-1", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with `policy` and `kept` under it."""
    return book.withColumn("policy", F.lit(policy)).withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(policy_mask(policy, rules))) == 0)


def ablation(book: DataFrame, policy: str = "web-1", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that only it rejects.

    One pass: documents are counted by failure bits first, and the (few) combinations are then expanded.
    """
    mask = policy_mask(policy, rules)
    combos = book.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    named = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("one")) for r in rules if r.name in POLICIES[policy]])
    each = combos.select("bits", "n", F.explode(named).alias("r"))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.one")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.one"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def filter_documents(docs: DataFrame, policy: str = "web-1", text: str = "text") -> DataFrame:
    """The rows of `docs` that a policy keeps, with the columns of `docs`."""
    row = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("__row"), F.col(text).alias("__doc_text"))
    # the bits go through a generator: a filter on them is not pushed into the rules, which would then run many times
    bits = ledger(row, text="__doc_text").select("__row", F.explode(F.array("failed_bits")).alias("bits"))
    return bits.where(F.col("bits").bitwiseAND(F.lit(policy_mask(policy))) == 0).select("__row.*")
