"""Quality rules as a bitmask ledger.

One pass over the texts measures each document and evaluates every rule once; the ledger keeps the measurements and one
failure bit per rule. Policies are versioned masks over these bits: applying one, comparing two, or asking what a rule
alone costs (ablation) reads the ledger's bits only, never the texts again.

A null text has no words and fails as a short one. Repeated rows are judged alike, one by one; ids may be null; extra
columns of any name are kept as they are.
An empty table gives an empty ledger, and its ablation says zero for each rule.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kalkula.llm.common import free_name, read_table, slices, strings_at, text_bytes, words

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", "n_letters", "n_upper")
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.isin(np.arange(256), range(65, 91))
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])

#: Name of each rule and when a document fails it, in the order of their bits. Append only: bits keep their meaning.
RULES: tuple[tuple[str, str], ...] = (
    ("too_few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("many_symbols", "10 * n_symbols > n_words"),
    ("few_letter_words", "100 * n_letter_words < 80 * n_words"),
    ("odd_word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    ("shouting", "2 * n_upper > n_letters"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
)
#: Masks of the rules that a version of the policy applies.
POLICIES = {"base-1": 0b0000011, "web-1": 0b1111111}
POLICY = "web-1"


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _mix(x: np.ndarray) -> np.ndarray:
    """64 well-spread bits of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _repeat_words(word: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Words of each text in a window of so many words that occurs twice or more in it."""
    n = len(word)
    if n < window:
        return np.zeros(len(at) - 1, np.int64)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    key = np.zeros(n - window + 1, np.uint64)
    for j in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + _mix(word[j : n - window + 1 + j].astype(np.uint64) + np.uint64(1))
    inside = np.flatnonzero(text[: n - window + 1] == text[window - 1 :])
    key = _mix(key[inside]) + _mix(text[inside].astype(np.uint64) + np.uint64(1 << 40))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, inside[twice], 1)
    np.add.at(step, inside[twice] + window, -1)
    return _per_text(np.cumsum(step[:-1]) > 0, at)


def _measured(texts: pa.Array) -> list[np.ndarray]:
    data, offsets = text_bytes(texts)
    starts, ends, at = words(data, offsets)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    in_word = np.cumsum(inside[:-1], dtype=np.int8) > 0
    letter = _LETTER[data]
    letters_before = np.concatenate([[0], np.cumsum(letter)])
    has_letter = letters_before[ends] > letters_before[starts]
    word = strings_at(data, starts, ends).dictionary_encode().indices.to_numpy(zero_copy_only=False) if len(starts) else np.zeros(0, np.int64)
    # lines: each text has one more than its line feeds
    feeds = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    line_ends = np.sort(np.concatenate([feeds, offsets[1:]]), kind="stable")
    line_text = np.repeat(np.arange(len(offsets) - 1), np.searchsorted(feeds, offsets[1:]) - np.searchsorted(feeds, offsets[:-1]) + 1)
    full = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_text = line_starts[full], line_ends[full], line_text[full]
    n_lines = np.bincount(line_text, minlength=len(offsets) - 1)
    if len(line_text):
        line = strings_at(data, line_starts, line_ends).dictionary_encode()
        pairs = np.unique(line_text * np.int64(len(line.dictionary)) + line.indices.to_numpy(zero_copy_only=False))
        distinct = np.bincount(pairs // len(line.dictionary), minlength=len(offsets) - 1)
    else:
        distinct = np.zeros(len(offsets) - 1, np.int64)
    return [
        np.diff(at),
        _per_text(in_word & ((data & 0xC0) != 0x80), offsets),
        _per_text(_SYMBOL[data], offsets),
        n_lines - distinct,
        _repeat_words(word, at, WINDOW),
        n_lines,
        _per_text(has_letter, at),
        _per_text(letter & ((data & 0xC0) != 0x80), offsets),
        _per_text(_UPPER[data], offsets),
    ]


@F.arrow_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def measures(text: pa.Array) -> pa.Array:
    """All measurements of each text in one pass."""
    parts = [_measured(b.column(0)) for b in slices(iter([pa.RecordBatch.from_arrays([text], ["text"])]))]
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0)] * len(MEASURES)
    return pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=list(MEASURES))


def failure_bits(measured: str, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """One bit per rule, set where the document fails it; measured names the struct of measurements."""
    names = re.compile(r"\b(" + "|".join(MEASURES) + r")\b")
    bits = F.lit(0).cast("long")
    for i, (_, fails) in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(names.sub(rf"`{measured}`.\1", fails)), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def rule_ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the struct quality_measures and the bits quality_failed as last columns; names that docs has already get underscores behind."""
    measured, failed = free_name(docs, "quality_measures"), free_name(docs, "quality_failed")
    return docs.withColumn(measured, measures(text_col)).withColumn(failed, failure_bits(measured))


def passes(mask: int, failed: str = "quality_failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask).cast("long")) == 0


def apply_policy(docs: DataFrame, policy: str = POLICY, text_col: str = "text") -> DataFrame:
    """The documents that the policy keeps, with their own columns, whatever their names."""
    ledger = rule_ledger(docs, text_col)
    measured, failed = ledger.columns[-2:]
    return ledger.filter(passes(POLICIES[policy], failed)).drop(measured, failed)


def ablation(ledger: DataFrame, mask: int = POLICIES[POLICY], rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """For each rule: documents that fail it, that fail no other rule of the policy, and that the policy without it keeps.

    The ledger is first counted by its bits, at most one row for each set of failed rules.
    """
    counted = ledger.groupBy(F.col("quality_failed").alias("bits")).agg(F.count("*").alias("n"))
    bit = lambda i: F.lit(1 << i).cast("long")
    of = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    in_policy = F.col("bits").bitwiseAND(F.lit(mask).cast("long"))
    sums = [
        F.struct(
            F.lit(name).alias("rule"), of(F.col("bits").bitwiseAND(bit(i)) != 0).alias("n_failed"), of(in_policy == bit(i)).alias("n_alone"),
            of(in_policy.bitwiseAND(F.lit(mask & ~(1 << i)).cast("long")) == 0).alias("n_kept_without"),
        )
        for i, (name, _) in enumerate(rules)
    ]
    return counted.agg(F.array(*sums).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def op4_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = rule_ledger(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ~passes(POLICIES["base-1"])
    kept = F.when(base, F.lit(False)).otherwise(passes(POLICIES[POLICY]))
    return ledger.select("doc_id", *(f"quality_measures.{m}" for m in MEASURES[:5]), base.alias("base_failed"), kept.alias("kept"), F.col("quality_failed").alias("failed_rules"))
