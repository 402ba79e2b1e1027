"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per
failed rule; a policy is a named, versioned set of rules, i.e. a mask. Applying another
policy, or asking what a rule alone changes, needs the ledger only and never the texts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from playlens.llm.common import SPACES, fresh

SYMBOLS = "#*$%&|<>"
WINDOW = 5

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutters",
)


def measure(text: str) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    return (
        n,
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        _covered(windows),
        sum(a == b for a, b in zip(words, words[1:])),
    )


def _covered(windows: list[tuple]) -> int:
    """Words that lie in a window found twice or more."""
    if len(set(windows)) == len(windows):
        return 0
    seen, twice = set(), set()
    for window in windows:
        (twice if window in seen else seen).add(window)
    covered, end = 0, 0
    for i, window in enumerate(windows):
        if window in twice:
            covered += i + WINDOW - max(i, end)
            end = i + WINDOW
    return covered


def measures(text: Column) -> Column:
    """The measurements as a struct."""
    @F.arrow_udf(", ".join(f"{name} long" for name in MEASURES))
    def measure_all(texts: pa.Array) -> pa.Array:
        rows = [measure(t.as_py() or "") for t in texts]
        columns = zip(*rows) if rows else ([] for _ in MEASURES)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=MEASURES)

    return measure_all(text)


@dataclass(frozen=True)
class Rule:
    """`fails` is SQL over the measurements. The bit never changes once it was published."""

    name: str
    bit: int
    fails: str

    @property
    def mask(self) -> int:
        return 1 << self.bit


RULES = (
    Rule("few_words", 0, "n_words < 10"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", 2, "100 * n_symbols > 10 * n_words"),
    Rule("repeated_lines", 3, "100 * n_dup_lines > 50 * n_lines"),
    Rule("short_words", 4, "10 * word_chars < 20 * n_words"),
    Rule("long_words", 5, "10 * word_chars > 150 * n_words"),
    Rule("stutter", 6, "100 * n_stutters > 20 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A versioned set of rules; a document that fails any of them is rejected."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(rule.mask for rule in RULES if rule.name in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
CORPUS = Policy("corpus", 2, tuple(rule.name for rule in RULES))


def ledger(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> tuple[DataFrame, str]:
    """`docs` with one more column, a struct of the measurements and `failed`, and its name.

    A null text counts as empty, and an empty one fails `few_words`. Rows are independent:
    ties, repeated rows, null ids and empty tables need no special case, and the name of the
    new column is one that `docs` doesn't have.
    """
    name = fresh(docs, "quality")
    got = docs.withColumn(name, measures(F.col(text)))
    bits = [
        F.when(_on(rule.fails, name), F.lit(rule.mask).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        for rule in rules
    ]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return got.withColumn(name, F.col(name).withField("failed", failed)), name


def _on(condition: str, struct: str) -> Column:
    """SQL over measurement names, read from the fields of `struct`."""
    words = (f"`{struct}`.{w}" if w in MEASURES else w for w in condition.split())
    return F.expr(" ".join(words))


def passes(failed: Column, policy: Policy) -> Column:
    """True for a document that fails no rule of `policy`."""
    return failed.bitwiseAND(F.lit(policy.mask).cast("bigint")) == 0


def ablation(failed: DataFrame, policies: Sequence[Policy] = (BASE, CORPUS)) -> DataFrame:
    """What each rule of each policy does: (policy, version, rule, failing, sole, rejected, documents).

    `failed` needs the column failed. The documents are first counted per bit pattern, of
    which there are at most 2^rules; all else happens on those few rows. `sole` counts
    documents that the policy would keep without that rule.
    """
    def entry(p: Policy, rule: Rule) -> Column:
        return F.struct(
            F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(rule.name).alias("rule"),
            F.lit(p.mask).cast("bigint").alias("mask"), F.lit(rule.mask).cast("bigint").alias("bit"),
        )

    entries = [entry(p, rule) for p in policies for rule in RULES if rule.name in p.rules]
    patterns = failed.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    rows = patterns.select("failed", "n", F.explode(F.array(*entries)).alias("e")).select("failed", "n", "e.*")
    hit = F.col("failed").bitwiseAND(F.col("mask"))

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0).cast("bigint")))

    return rows.groupBy("policy", "version", "rule").agg(
        total(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("failing"),
        total(hit == F.col("bit")).alias("sole"),
        total(hit != 0).alias("rejected"),
        F.sum("n").alias("documents"),
    )


def kept(docs: DataFrame, policy: Policy = CORPUS) -> DataFrame:
    """The rows of `docs` that pass `policy`, with the columns of `docs`."""
    rows, name = ledger(docs)
    return rows.where(passes(F.col(f"{name}.failed"), policy)).select(*(F.col(f"`{c}`") for c in docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    """Per document: measurements, base verdict, failure bits and the verdict of CORPUS."""
    rows, name = ledger(docs)
    failed = F.col(f"{name}.failed")
    return rows.select(
        "doc_id",
        *(F.col(f"{name}.{m}").alias(m) for m in MEASURES),
        (~passes(failed, BASE)).alias("base_failed"),
        failed.alias("failed"),
        passes(failed, CORPUS).alias("kept"),
    )
