"""Operator 3: quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger keeps the measurements and one failure bit for each rule. A versioned policy is a
mask: a document is kept if no failed bit is in the mask. Ablations count documents by failure bits (a number of groups bounded by 2 ** rules,
whatever the size of the corpus) and then look at each mask with one rule taken out.

Words are runs of characters other than blank, tab, line feed, vertical tab, form feed and carriage return. A null text has no
words and fails the length rule, as an empty one does. Texts are measured whole. Repeated rows and null ids stay as rows of their own.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import documents, map_text

_WORD = re.compile("[^ \t-\r]+")
_UPPER, _LOWER, _DIGIT = re.compile("[A-Z]"), re.compile("[a-z]"), re.compile("[0-9]")
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits")
MEASURE_SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)

#: Rule name to failure condition over the measurements, in SQL that Spark and DuckDB share. The order gives the bits.
RULES = {
    "too_few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "100 * n_dup_lines > 60 * n_lines",
    "shouting": "n_upper > n_lower AND n_upper > 20",
    "digits": "100 * n_digits > 30 * word_chars",
    "word_length": "word_chars < 2 * n_words OR word_chars > 25 * n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
POLICIES = {
    "base": BIT["too_few_words"] | BIT["repeated_words"],
    "v1": sum(BIT.values()),
}
CURRENT_POLICY = "v1"


def measure_text(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = _WORD.findall(text)
    n = len(words)
    seen, dup_lines, n_lines = set(), 0, 0
    for line in text.split("\n"):
        if _WORD.search(line):
            n_lines += 1
            dup_lines += line in seen
            seen.add(line)
    number: dict[str, int] = {}
    code = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    repeated = 0
    if n > 3 and len(number) < n:
        pair = np.unique(code[:-2] * len(number) + code[1:-1], return_inverse=True)[1]
        _, where, times = np.unique(pair * len(number) + code[2:], return_inverse=True, return_counts=True)
        again = times[where] > 1
        covered = np.zeros(n, bool)
        for shift in range(3):
            covered[shift : n - 2 + shift] |= again
        repeated = int(covered.sum())
    digits = sum(text.count(d) for d in "0123456789")
    upper = len(_UPPER.findall(text))
    lower = len(text.encode().translate(None, _NOT_LOWER))
    return n, sum(map(len, words)), sum(text.count(c) for c in SYMBOLS), dup_lines, repeated, n_lines, upper, lower, digits


_NOT_LOWER = bytes(b for b in range(256) if not 97 <= b <= 122)


def measure(df: DataFrame) -> DataFrame:
    """doc_id and the measurements of each row."""

    def run(ids, texts):
        columns = list(zip(*map(measure_text, texts))) or [()] * len(MEASURES)
        return {"doc_id": ids, **{m: list(c) for m, c in zip(MEASURES, columns)}}

    return map_text(df, run, MEASURE_SCHEMA)


def failure_bits() -> Column:
    return sum((F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long") for name, rule in RULES.items()), F.lit(0).cast("long"))


def ledger(df: DataFrame) -> DataFrame:
    """Measurements and failure bits, each rule evaluated once."""
    return measure(df).withColumn("failure_bits", failure_bits())


def apply_policy(entries: DataFrame, policy: str = CURRENT_POLICY) -> DataFrame:
    """Adds base_failed and kept under a policy; the ledger itself isn't evaluated again."""
    bits = F.col("failure_bits")
    base_failed = bits.bitwiseAND(F.lit(POLICIES["base"])) != 0
    return entries.withColumns({"base_failed": base_failed, "kept": ~base_failed & (bits.bitwiseAND(F.lit(POLICIES[policy])) == 0), "policy": F.lit(policy)})


def ablation(entries: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """policy, rule, kept, kept_without_rule, failed_only_by_rule: one row for each policy and rule in its mask."""
    spark = entries.sparkSession
    masks = [(p, name, mask, BIT[name]) for p, mask in (policies or POLICIES).items() for name in RULES if mask & BIT[name]]
    wanted = spark.createDataFrame(masks, "policy string, rule string, mask long, bit long")
    counts = entries.groupBy("failure_bits").agg(F.count(F.lit(1)).alias("n"))
    failed = F.col("failure_bits").bitwiseAND(F.col("mask"))
    # both sides are bounded by the number of rules, not by the corpus
    paired = counts.join(F.broadcast(wanted), F.col("failure_bits") >= 0)
    return paired.groupBy("policy", "rule").agg(
        F.sum(F.when(failed == 0, F.col("n")).otherwise(0)).alias("kept"),
        F.sum(F.when(failed.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("kept_without_rule"),
        F.sum(F.when(failed == F.col("bit"), F.col("n")).otherwise(0)).alias("failed_only_by_rule"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_policy(ledger(documents(spark, sf_dir))).select("doc_id", *MEASURES, "failure_bits", "base_failed", "kept")


_SPACE = r"[ \t\n\x0B\f\r]+"
OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+') AS ws, text FROM d),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
g AS (SELECT doc_id, i, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, b, c) AS times FROM g WHERE c IS NOT NULL),
r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS j FROM h WHERE times > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM
  (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n_dup, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
  coalesce(l.n_lines, 0)::BIGINT AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(text, '[^a-z]', '', 'g'))::BIGINT AS n_lower,
  length(regexp_replace(text, '[^0-9]', '', 'g'))::BIGINT AS n_digits
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id LEFT JOIN l ON l.doc_id = w.doc_id),
b AS (SELECT *, ({' + '.join(f"CASE WHEN {rule} THEN {BIT[name]} ELSE 0 END" for name, rule in RULES.items())})::BIGINT AS failure_bits FROM m)
SELECT *, (failure_bits & {POLICIES['base']}) <> 0 AS base_failed, (failure_bits & {POLICIES['base'] | POLICIES[CURRENT_POLICY]}) = 0 AS kept FROM b
"""
