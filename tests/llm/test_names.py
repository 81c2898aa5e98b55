"""Extra columns with the operators' own names, in either case of letters, keep their values."""

import pytest
from pyspark.sql import functions as F

from kalkula.llm import language, mixing, pii, quality, resemblance, simhash
from tests.llm.fixtures import SCHEMA

NAMES = [
    "row", "ID", "node", "key", "keys", "hub", "root", "n", "sure", "Dedup_Row", "dedup_name", "without_may", "print", "least_id", "component_id", "quality_measures", "QUALITY_FAILED", "n_words",
    "pii_blob", "pii_may", "Pii_Spans", "pii_text", "spans", "blob", "mix_row", "mix_copies", "mix_turn", "keep_mix_row", "copies", "share", "bucket", "place", "target", "lang_guess", "LANG_PRED", "score", "block", "range",
]
ROWS = [(i, f"write to person{i % 7}@work.org about topic {i} " + " ".join(f"w{i // 2}x{j}" for j in range(30)), "en", "ab"[i % 2], 9, "x") for i in range(40)]


@pytest.mark.parametrize("work", [quality.apply_policy, quality.rule_ledger, simhash.drop_near_duplicates, resemblance.drop_near_duplicates, pii.sanitise, mixing.apply_mix, lambda d: language.predict(d, language.fit(d))], ids=["policy", "ledger", "simhash", "resemblance", "pii", "mixing", "language"])
def test_names(spark, tmp_path, work):
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    out = work(docs.select("*", *(F.lit(f"my {c}").alias(c) for c in NAMES)))
    assert out.columns[: len(docs.columns) + len(NAMES)] == [*docs.columns, *NAMES]
    rows = out.collect()
    assert rows and all(tuple(r)[len(docs.columns) : len(docs.columns) + len(NAMES)] == tuple(f"my {c}" for c in NAMES) for r in rows)
    plain = sorted(tuple(r)[: len(docs.columns)] for r in work(docs).collect())
    assert sorted(tuple(r)[: len(docs.columns)] for r in rows) == plain
