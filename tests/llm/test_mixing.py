import re
from collections import defaultdict

import numpy as np
import pytest

from kalkula.llm.mixing import apply_mix, meet, mix, op5_pivotal_mix
from tests.llm.fixtures import ROWS, SCHEMA, write


def targets(sizes):
    """Targets by the rule, one source after the other."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full, out = sum(sizes.values()), set(), {}
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        w = sum(weight[s] for s in order if s not in full)
        out = {s: 3 * sizes[s] if s in full else left * weight[s] / w for s in order}
        over = {s for s in order if s not in full and out[s] > 3 * sizes[s]}
        if not over:
            return out
        full |= over


def check(rows, got):
    sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
        sizes[r[3]] += n
        most[r[3]] = max(most[r[3]], n)
    want = targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s], s


def test_awkward_rows(spark, tmp_path):
    check(ROWS, [r.asDict() for r in op5_pivotal_mix(spark, write(spark, tmp_path)).collect()])


def test_many_sources_one_of_them_hot_and_reruns_agree(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(0, 60)), "en", f"s{rng.integers(0, 9)}" if i % 3 else "hot", 1, "x") for i in range(1500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [mix(docs.repartition(n), bucket_rows=20, fan_in=3) for n in (2, 5)]
    first, second = (sorted((r["doc_id"], r["copies"]) for r in x.collect()) for x in got)
    assert first == second
    check(rows, [r.asDict() | {"taken": r["copies"] * r["size"]} for r in got[0].collect()])


def test_copies_are_unbiased_and_words_kept():
    size, share = np.array([3, 50, 7, 7, 120, 1]), np.full(6, 0.3)
    mean = np.zeros(6)
    for seed in range(4000):
        out = meet(size, share, np.random.default_rng(seed).random(6))
        assert ((out > 0) & (out < 1)).sum() <= 1
        assert (out * size).sum() == pytest.approx((share * size).sum())
        mean += out / 4000
    assert np.allclose(mean, 0.3, atol=0.03)


def test_apply_repeats_documents(spark, tmp_path):
    rows = [(i, "a b c", "en", "one" if i < 40 else "two", 5, "x") for i in range(60)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    out = apply_mix(docs)
    assert out.columns == docs.columns
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["one"] - 60 * 5 / 7) <= 1 and abs(n["two"] - 60 * 2 / 7) <= 1


def test_empty_table(spark, tmp_path):
    assert op5_pivotal_mix(spark, write(spark, tmp_path, [], SCHEMA)).count() == 0
