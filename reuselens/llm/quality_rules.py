"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; its outcome is one bit of ``failed_rules`` beside the measurements it used.
Policies are versioned masks over these bits, so a new policy, or the ablation of one, reads the ledger and no text.

Defined cases: null text counts as empty (no words: the base rule few_words fails); very long texts are measured as a whole; null
ids and repeated rows are rows like any other; other columns, whatever their names, pass through; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .textstats import FIELDS, measure_column


@dataclass(frozen=True)
class Rule:
    """A predicate over measurements, in whole numbers only; true: the document fails."""

    name: str
    bit: int
    fails: Callable[[Callable[[str], Column]], Column]


#: A bit keeps its meaning for good; rules are added with new bits.
RULES = (
    Rule("few_words", 0, lambda m: m("n_words") < 50),
    Rule("repeated_words", 1, lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
    Rule("symbols", 2, lambda m: 20 * m("n_symbols") > m("word_chars")),
    Rule("bangs", 3, lambda m: 10 * m("n_bang") > 3 * m("n_words")),
    Rule("capitals", 4, lambda m: 10 * m("n_upper") > 6 * (m("n_upper") + m("n_lower"))),
    Rule("stutter", 5, lambda m: 10 * m("n_repeat_next") > 3 * m("n_words")),
    Rule("duplicate_lines", 6, lambda m: 2 * m("n_dup_lines") > m("n_lines")),
    Rule("short_words", 7, lambda m: m("word_chars") < 2 * m("n_words")),
    Rule("long_words", 8, lambda m: (m("word_chars") > 15 * m("n_words")) | (10 * m("n_long_words") > m("n_words"))),
    Rule("few_distinct", 9, lambda m: (m("n_words") >= 100) & (20 * m("n_distinct_words") < m("n_words"))),
)
BIT = {r.name: 1 << r.bit for r in RULES}


@dataclass(frozen=True)
class Policy:
    """A document passes if at most ``allowed`` of the rules fail."""

    version: str
    rules: tuple[str, ...]
    allowed: int = 0

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)

    def passes(self, bits: Column) -> Column:
        failed = bits.bitwiseAND(F.lit(self.mask).cast("bigint"))
        return failed == 0 if not self.allowed else F.bit_count(failed) <= self.allowed


POLICIES = {
    p.version: p
    for p in (
        Policy("base-1", ("few_words", "repeated_words")),
        Policy("strict-1", tuple(BIT)),
        Policy("lenient-1", tuple(BIT), allowed=1),
    )
}
DEFAULT = "strict-1"


def bits_of(m: Callable[[str], Column], rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules as one bigint."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(r.fails(m), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("bigint") for r in rules])


def ledger(docs: DataFrame, text: str = "text", bits: str = "failed_rules", measured: str = "measured") -> DataFrame:
    """``docs`` with the measurements (a struct) and the failure bits (bigint). One pass, no shuffle."""
    out = docs.withColumn(measured, measure_column(F.col(text)))
    return out.withColumn(bits, bits_of(lambda f: F.col(measured)[f]))


def ablations(book: DataFrame, policy: Policy, bits: str = "failed_rules") -> DataFrame:
    """What each rule of a policy does: a row per rule with n_rows, n_failed, n_alone (no other rule of the policy fails)
    and n_kept_without (rows that the policy without this rule keeps).

    Rows are first counted by bit pattern, of which there are at most 2^rules whatever the input, and only those counts
    are combined with the rules.
    """
    counts = book.groupBy(F.col(bits).bitwiseAND(F.lit(policy.mask).cast("bigint")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("bigint").alias("bit")) for r in policy.rules])
    b, bit, n = F.col("bits"), F.col("r.bit"), F.col("n")
    rest = F.bit_count(b.bitwiseAND(F.bitwise_not(bit)))
    return (
        counts.select("bits", "n", F.explode(rules).alias("r"))
        .groupBy(F.lit(policy.version).alias("policy"), F.col("r.rule").alias("rule"))
        .agg(
            F.sum(n).alias("n_rows"),
            F.sum(F.when(b.bitwiseAND(bit) != 0, n).otherwise(0)).alias("n_failed"),
            F.sum(F.when((b.bitwiseAND(bit) != 0) & (rest == 0), n).otherwise(0)).alias("n_alone"),
            F.sum(F.when(rest <= policy.allowed, n).otherwise(0)).alias("n_kept_without"),
        )
    )


def keep(docs: DataFrame, policy: Policy | None = None, text: str = "text") -> DataFrame:
    """The rows that pass, with the columns of ``docs``."""
    policy = policy or POLICIES[DEFAULT]
    bits, measured = fresh(docs, "failed_rules", "measured")
    return ledger(docs, text, bits, measured).where(policy.passes(F.col(bits))).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(docs: DataFrame, policy: Policy | None = None) -> DataFrame:
    """The ledger as flat columns, with the base outcome and the policy's verdict."""
    policy = policy or POLICIES[DEFAULT]
    book = ledger(docs.select("doc_id", "text"))
    return book.select(
        "doc_id",
        *[F.col("measured")[f].alias(f) for f in FIELDS],
        "failed_rules",
        (~POLICIES["base-1"].passes(F.col("failed_rules"))).alias("base_failed"),
        (POLICIES["base-1"].passes(F.col("failed_rules")) & policy.passes(F.col("failed_rules"))).alias("kept"),
    )


_W = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {_W} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln
  FROM documents
), g AS (
  SELECT rid, i, struct_pack(a := w[i], b := w[i + 1], c := w[i + 2]) AS s
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), hit AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM g) WHERE n > 1
), rep AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM hit) GROUP BY rid
), m AS (
  SELECT doc_id, octet_length(encode(t)) AS n_bytes, length(t) AS n_chars, len(w) AS n_words,
    length(t) - length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')) AS word_chars, len(ln) AS n_lines,
    len(ln) - len(list_distinct(ln)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(list_distinct(w)) AS n_distinct_words,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_repeat_next,
    len(list_filter(w, lambda x: octet_length(encode(x)) > 30)) AS n_long_words,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower,
    length(regexp_replace(t, '[^0-9]', '', 'g')) AS n_digits, length(regexp_replace(t, '[^!?]', '', 'g')) AS n_bang,
    length(regexp_replace(t, '[^.,;:]', '', 'g')) AS n_stops
  FROM d LEFT JOIN rep USING (rid)
), b AS (
  SELECT *,
    (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 20 * n_symbols > word_chars THEN 4 ELSE 0 END) + (CASE WHEN 10 * n_bang > 3 * n_words THEN 8 ELSE 0 END)
    + (CASE WHEN 10 * n_upper > 6 * (n_upper + n_lower) THEN 16 ELSE 0 END)
    + (CASE WHEN 10 * n_repeat_next > 3 * n_words THEN 32 ELSE 0 END) + (CASE WHEN 2 * n_dup_lines > n_lines THEN 64 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words THEN 128 ELSE 0 END)
    + (CASE WHEN word_chars > 15 * n_words OR 10 * n_long_words > n_words THEN 256 ELSE 0 END)
    + (CASE WHEN n_words >= 100 AND 20 * n_distinct_words < n_words THEN 512 ELSE 0 END) AS failed_rules
  FROM m
)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(n_chars AS BIGINT) AS n_chars, CAST(n_words AS BIGINT) AS n_words,
  CAST(word_chars AS BIGINT) AS word_chars, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_distinct_words AS BIGINT) AS n_distinct_words,
  CAST(n_repeat_next AS BIGINT) AS n_repeat_next, CAST(n_long_words AS BIGINT) AS n_long_words,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_upper AS BIGINT) AS n_upper, CAST(n_lower AS BIGINT) AS n_lower,
  CAST(n_digits AS BIGINT) AS n_digits, CAST(n_bang AS BIGINT) AS n_bang, CAST(n_stops AS BIGINT) AS n_stops,
  CAST(failed_rules AS BIGINT) AS failed_rules, (failed_rules & 3) <> 0 AS base_failed, failed_rules = 0 AS kept
FROM b
"""
