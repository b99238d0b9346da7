"""Quality rules as a bitmask ledger: every rule runs once, policies and ablations only read bits.

`ledger` measures each text and stores one failure bit per rule beside the measurements. A `Policy` is a
versioned mask over those bits; applying another version, or asking what a rule costs, never reads a
text again. All of it is built from DataFrame functions and needs no exchange.

Null and empty texts have no words: every count is 0, they fail `few_words` and are not kept. Rows are
judged one by one, so repeated rows and repeated ids get equal verdicts; an empty table gives an empty
ledger. Columns of the input other than the id and the text are ignored (`ledger`) or passed on
unchanged (`keep`), whatever they are called.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, pinned

#: Words of a window in which repetition is counted.
WINDOW = 5


class Rule(NamedTuple):
    """fails: SQL over the measurements that is true where a text breaks the rule."""

    name: str
    fails: str


class Policy(NamedTuple):
    """A version of the verdict: a text is kept if it breaks none of these rules."""

    version: str
    rules: tuple[str, ...]


#: The place of a rule in this list is its bit; new rules go to the end, so that old ledgers stay valid.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("capitals", "100 * n_capitals > 30 * word_chars"),
)
BASE = Policy("base", ("few_words", "repeated_windows"))
STRICT = Policy("2", tuple(r.name for r in RULES))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")


def mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    bit = {r.name: 1 << i for i, r in enumerate(rules)}
    return sum(bit[name] for name in policy.rules)


def _removed(text: str, pattern: str) -> Column:
    """How many characters of the text the pattern matches."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and MEASURES of every row.

    Intermediate arrays are pinned, so that no filter on the result computes them anew inside the lambdas.
    Only texts with a repeated window pay for sorting.
    """
    doc = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    doc = doc.withColumn("_w", pinned(F.array_remove(F.split("_t", SPACE + "+"), "")))
    doc = doc.withColumn("_l", pinned(F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))))
    doc = doc.select(
        id_col,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        _removed("_t", r"[#*$%&|<>]+").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _removed("_t", r"\p{Lu}+").alias("n_capitals"),
        pinned(F.when(F.size("_w") > WINDOW, F.transform(F.sequence(F.lit(0), F.size("_w") - WINDOW), lambda i: F.xxhash64(*(F.get("_w", i + k) for k in range(WINDOW)))))).alias("_h"),
    )
    repeats = F.size("_h") > F.size(F.array_distinct("_h"))
    doc = doc.withColumn("_s", pinned(F.when(repeats, F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))))
    same = lambda e, at: F.coalesce(F.get("_s", at)["h"] == e["h"], F.lit(False))
    found = F.filter("_s", lambda e, k: same(e, k - 1) | same(e, k + 1))
    doc = doc.withColumn("_p", pinned(F.sort_array(F.transform(found, lambda e: e["i"]))))
    steps = F.transform(F.sequence(F.lit(1), F.size("_p") - 1), lambda k: F.least(F.lit(WINDOW), F.get("_p", k) - F.get("_p", k - 1)))
    covered = F.aggregate(steps, F.lit(WINDOW), lambda a, x: a + x)
    return doc.withColumn("n_repeat_words", F.when(F.col("_p").isNull(), 0).otherwise(covered).cast("long")).select(id_col, *MEASURES)


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, MEASURES and fail_bits: bit i is set where rules[i] is broken. At most 63 rules."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs, id_col, text_col).withColumn("fail_bits", bits)


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a row of the ledger is kept under the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0


def ablations(judged: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """rule, n_failed, n_only: rows that break the rule, and those that no other rule of the policy rejects.

    n_only is how many rows the policy would keep besides if it lost the rule. The ledger is first reduced
    to its distinct bit patterns, so the rules are weighed against at most 2**rules rows.
    """
    patterns = judged.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    of = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(rules) if r.name in policy.rules)))
    each = patterns.select("bits", "n", of.alias("r")).select("bits", "n", "r.*")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only"),
        F.coalesce(F.bit_or(F.when(hit, F.col("bits"))), F.lit(0)).alias("seen_with"),
    )


def keep(docs: DataFrame, policy: Policy = STRICT, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows that pass, with all their columns. One pass over the texts, no exchange."""
    own = [f"_c{i}" for i in range(len(docs.columns))]
    row = docs.toDF(*own).select(F.struct(*own).alias("_row"))
    judged = ledger(row.withColumn("_text", F.col(f"_row.{own[docs.columns.index(text_col)]}")), rules, "_row", "_text")
    return judged.filter(passes(policy, rules)).select("_row.*").toDF(*docs.columns)
