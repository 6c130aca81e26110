"""Quality rules kept as a ledger of failure bits and measurements.

Every rule is evaluated once per document. Its outcome is one bit and its measurements
are columns, so a policy is only a bit mask: verdicts of any policy, old or new, and the
effect of leaving a rule out follow from the ledger without reading texts again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import GAP_CHARACTERS, WORD, pick
from threadlens.llm.secrets import let, quoted

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """`fails` is SQL over the measurements; a rule's place in a list is its bit."""

    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule("few_letters", "2 * n_letters < word_chars"),
    Rule("many_words", "n_words > 100000"),
)
BASE = ("few_words", "repeated_words")

#: Versions are never changed, only added.
POLICIES = {
    "base-1": BASE,
    "default-1": (*BASE, "word_length", "symbols", "duplicate_lines", "few_letters"),
    "strict-1": tuple(rule.name for rule in RULES),
}


def mask_of(names: tuple[str, ...] | list[str], rules: tuple[Rule, ...] = RULES) -> int:
    places = {rule.name: i for i, rule in enumerate(rules)}
    return sum(1 << places[name] for name in names)


def repeat_words(words: str) -> str:
    """Words inside a 3-word window that occurs at least twice, the first included.

    Windows are sorted, so equal ones are neighbours; the places of those with an
    equal neighbour are sorted again, and the gaps between them give what they cover.
    """
    window = "named_struct('g', concat_ws(' ', get(w, i), get(w, i + 1), get(w, i + 2)), 'i', i)"
    ordered = f"sort_array(transform(sequence(0, size(w) - 3), i -> {window}))"
    again = "if(x.g = get(s, k - 1).g OR x.g = get(s, k + 1).g, x.i, NULL)"
    places = f"sort_array(filter(transform(s, (x, k) -> {again}), y -> y IS NOT NULL))"
    covered = "transform(q, (y, k) -> least(3, coalesce(get(q, k + 1) - y, 3)))"
    total = f"aggregate({covered}, 0L, (n, y) -> n + y)"
    return let("w", words, f"if(size(w) < 3, 0L, {let('s', ordered, let('q', places, total))})")


def measurements(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_letters).

    Null texts measure like empty ones: all zero. n_lines counts lines with a word.
    """
    gaps = quoted(GAP_CHARACTERS).replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    rows = pick(documents, "doc_id", "text").select("doc_id", F.expr("coalesce(text, '')").alias("body"))
    parts = rows.select(
        "doc_id",
        "body",
        F.expr(f"regexp_extract_all(body, {quoted(WORD)}, 0)").alias("words"),
        F.expr(f"filter(split(body, '\\n', -1), line -> translate(line, {gaps}, '') <> '')").alias("lines"),
    )
    return parts.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.expr(f"CAST(length(translate(body, {gaps}, '')) AS bigint)").alias("word_chars"),
        F.expr(f"CAST(length(body) - length(translate(body, '{SYMBOLS}', '')) AS bigint)").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        F.expr("CAST(size(lines) - size(array_distinct(lines)) AS bigint)").alias("n_dup_lines"),
        F.expr(repeat_words("words")).alias("n_repeat_words"),
        F.expr("CAST(length(regexp_replace(body, '\\\\P{L}+', '')) AS bigint)").alias("n_letters"),
    )


def ledger(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measurements and `failed`, a long whose bit i is set if rule i fails.

    One row per row of (doc_id, text), repeated rows included. An empty text fails
    the rule on few words and no other.
    """
    bits = [F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(rules)]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measurements(documents).withColumn("failed", failed)


def passes(policy: tuple[str, ...] | list[str], rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a ledger row fails none of a policy's rules."""
    return F.col("failed").bitwiseAND(F.lit(mask_of(policy, rules)).cast("long")) == 0


def ablations(rows: DataFrame, policy: tuple[str, ...] | list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(rule, n_failed, n_failed_alone, n_kept_without) for each rule of a policy.

    The ledger is first counted by failure bits, at most one row per combination of
    rules; all figures follow from those rows by bit operations.
    """
    mask = mask_of(policy, rules)
    combined = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(
        F.count(F.lit(1)).alias("n")
    )
    named = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(mask_of([name], rules)).cast("long").alias("bit")) for name in policy])
    each = combined.select("bits", "n", F.inline(named))
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    count = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0)).cast("long")
    return each.groupBy("rule").agg(
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(F.col("bits") == F.col("bit")).alias("n_failed_alone"),
        count(rest == 0).alias("n_kept_without"),
    )
