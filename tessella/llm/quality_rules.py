"""Rule bitmask ledger: each rule is evaluated once per document, policies are masks over the stored bits.

The ledger has one row per document with its measurements and a long whose bit i is set where rule i fails.
A policy is a version name and a set of rules; a verdict is ``failed & mask = 0``. Ablations group the ledger by
its bits (at most 2^rules groups, whatever the input) and evaluate every mask on those groups.

Nulls and edge cases: a null or empty text has zero words and fails ``too_few_words``; repeated rows (equal doc_id)
are judged one by one; an empty table gives an empty ledger; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import add_columns, map_rows, with_key

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SPACES = b" \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """fails: SQL predicate over the measurements. The rule's bit is its place in RULES; places are never reused."""

    name: str
    fails: str


RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbol_heavy", "100 * n_symbols > 30 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 70 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 25 * n_words"),
)

#: Versioned policies; new versions are added, old ones stay as they are.
POLICIES = {
    "base-1": ("too_few_words", "repeated_windows"),
    "web-1": ("too_few_words", "repeated_windows", "symbol_heavy", "repeated_lines"),
    "web-2": ("too_few_words", "repeated_windows", "symbol_heavy", "repeated_lines", "short_words", "long_words"),
}
CURRENT = "web-2"


def bit(rule: str) -> int:
    return 1 << [r.name for r in RULES].index(rule)


def mask(policy: str) -> int:
    return sum(bit(rule) for rule in POLICIES[policy])


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASURES of one text. Words are maximal runs without space, tab, newline, \\v, \\f and \\r."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() splits at exactly these six
    blanks = sum(map(raw.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip(SPACES)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts, covered = Counter(windows), 0
        for i, window in enumerate(windows):
            if counts[window] > 1:
                repeated += i + 3 - max(i, covered)
                covered = i + 3
    return len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def measurements(docs: DataFrame) -> DataFrame:
    def block(rows: dict) -> dict:
        measured = [measure(t) for t in rows["text"]]
        return {"doc_id": rows["doc_id"]} | {m: [x[i] for x in measured] for i, m in enumerate(MEASURES)}

    schema = pa.schema([("doc_id", pa.int64()), *((m, pa.int64()) for m in MEASURES)])
    return map_rows(with_key(docs, ("doc_id", "text")), block, schema)


def failed_bits(prefix: str = "") -> Column:
    """The bits of the rules that fail, over measurement columns whose names begin with prefix."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        fails = rule.fails
        for m in MEASURES:
            fails = fails.replace(m, prefix + m)
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failed``, the rules' bits."""
    return measurements(docs).withColumn("failed", failed_bits())


def kept_rows(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of docs that the policy keeps, with their own columns; no join, as rows are measured where they are."""

    prefix = "_rule_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix

    def block(rows: dict) -> dict:
        measured = [measure(t) for t in rows["text"]]
        return {prefix + m: [x[i] for x in measured] for i, m in enumerate(MEASURES)}

    schema = pa.schema([(prefix + m, pa.int64()) for m in MEASURES])
    return add_columns(docs, ("text",), block, schema).where(failed_bits(prefix).bitwiseAND(F.lit(mask(policy))) == 0).select(*docs.columns)


def apply_policy(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with ``kept`` under one policy."""
    return book.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(book: DataFrame) -> DataFrame:
    """For each policy and each of its rules (and none): documents kept without that rule; and how many it alone rejects."""
    groups = book.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    cases = [(p, rule or "none", mask(p), mask(p) & ~(bit(rule) if rule else 0)) for p in POLICIES for rule in (None, *POLICIES[p])]
    table = F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(r).alias("without"), F.lit(full).cast("long").alias("full"), F.lit(m).cast("long").alias("m")) for p, r, full, m in cases))
    kept = F.when(F.col("failed").bitwiseAND(F.col("m")) == 0, F.col("n")).otherwise(0)
    alone = F.when((F.col("failed").bitwiseAND(F.col("m")) == 0) & (F.col("failed").bitwiseAND(F.col("full")) != 0), F.col("n")).otherwise(0)
    return groups.select("failed", "n", F.inline(table)).groupBy("policy", "without").agg(F.sum(kept).alias("n_kept"), F.sum(alone).alias("n_only_by_this"))


def quality_rules(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Ledger with the digest columns ``base_failed`` and ``kept``."""
    base = F.col("failed").bitwiseAND(F.lit(mask("base-1"))) != 0
    return apply_policy(ledger(docs).withColumn("base_failed", base), policy)
