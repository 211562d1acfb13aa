"""Quality rules as a bitmask ledger.

Each rule is evaluated once per document.  The ledger stores the measurements and one failure bit per rule;
policies are named, versioned sets of rules that are applied to the stored bits, and ablations are bitwise
aggregates over the ledger, so that neither reads a text again.  Everything is DataFrame functions: no shuffle
is needed until an ablation counts the few distinct bit patterns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import SPACE

SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  #: SQL condition over the measurements

    def failed(self) -> Column:
        return F.coalesce(F.expr(self.fails), F.lit(False))


#: A rule's position is its bit; append, never reorder, so that stored ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines"),  # one refrain in a short text is no boilerplate
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 25 * n_words"),
)
BASE = ("few_words", "repeated_words")
#: Policies by version; each names the rules that reject a document.
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbols"),
    "v2": (*BASE, "symbols", "duplicate_lines", "short_words", "long_words"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def mask(names, rules=RULES) -> int:
    """The bits of the named rules; an unknown name raises."""
    at = {rule.name: 1 << i for i, rule in enumerate(rules)}
    return sum(at[name] for name in dict.fromkeys(names))


def measured(docs: DataFrame, text_col: str = "text", keep=()) -> DataFrame:
    """``keep`` columns and the measurements of each whole text; a null text measures as an empty one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.select(
        *[F.col(c) for c in keep],
        F.array_remove(F.split(text, SPACE), "").alias("_words"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    last = F.greatest(F.size("_words") - 2, F.lit(0))
    shifted = [F.slice("_words", i, last).alias(f"w{i}") for i in (1, 2, 3)]
    second = first.select(
        *keep,
        "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform(F.arrays_zip(*shifted), lambda w: F.concat_ws(" ", w["w1"], w["w2"], w["w3"])).alias("_windows"),
    )
    return second.select(*keep, *[c for c in MEASURES if c != "n_repeat_words"], _repeated("_windows").alias("n_repeat_words"))


def _repeated(windows: str) -> Column:
    """Number of words under windows that occur twice or more.  Sorting windows with their positions puts equal
    ones side by side, which stays n log n for a text of nothing but repeats; most texts have none and skip it."""
    placed = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    n = F.size(windows) - 1
    pairs = F.arrays_zip(F.slice(placed, 1, n).alias("a"), F.slice(placed, 2, n).alias("b"))
    equal = F.filter(pairs, lambda p: p["a"]["x"] == p["b"]["x"])
    words = F.flatten(F.transform(equal, lambda p: F.flatten(F.transform(F.array(p["a"]["i"], p["b"]["i"]), lambda i: F.array(i, i + 1, i + 2)))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.size(F.array_distinct(words))).otherwise(0).cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """(doc_id, measurements, failed): one row per input row, ``failed`` holding a bit for each failing rule.

    Repeated rows give repeated rows, null ids stay null, other columns are not read.
    """
    found = measured(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), "_text", ["doc_id"])
    bits = [F.when(rule.failed(), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(rules)]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return found.withColumn("failed", failed.cast("long"))


def kept(failed: Column, policy: str, policies=POLICIES, rules=RULES) -> Column:
    return failed.bitwiseAND(F.lit(mask(policies[policy], rules)).cast("long")) == 0


def ablations(entries: DataFrame, policy: str, policies=POLICIES, rules=RULES) -> DataFrame:
    """(policy, rule, n_failed, n_only, n_kept_without): documents that fail each rule of the policy, those
    rejected by it alone, and those kept if it were dropped.  Counts bit patterns first, at most 2^rules rows."""
    whole = mask(policies[policy], rules)
    patterns = entries.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    each = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(mask([name], rules)).cast("long").alias("bit")) for name in policies[policy]])
    rows = patterns.select("failed", "n", F.explode(each).alias("r")).select("failed", "n", "r.rule", "r.bit")
    hit = F.col("failed").bitwiseAND(F.col("bit")) != 0
    others = F.col("failed").bitwiseAND(F.lit(whole).cast("long")).bitwiseAND(F.bitwise_not("bit"))
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    return rows.groupBy("rule").agg(total(hit).alias("n_failed"), total(hit & (others == 0)).alias("n_only"), total(others == 0).alias("n_kept_without")).select(F.lit(policy).alias("policy"), "*")
