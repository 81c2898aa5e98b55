import hashlib
import re
from functools import cmp_to_key

import numpy as np
import pytest
from pyspark.sql import functions as F

from kalkula.llm import sketches as S
from tests.llm.fixtures import ROWS, SCHEMA, write


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    """(id, n_chars, sha of the edited text, exact likenesses) in the order of the walk."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, r in enumerate(order):
        text, nxt = r[1] or "", order[(i + 1) % len(order)][1] or ""
        h = len(text) // 2
        changed = text[: len(text) - h] + nxt[:h]
        out.append((r[0], len(text), hashlib.sha256(changed.encode()).hexdigest(), likeness(text, changed), likeness(text, nxt)))
    return out


@pytest.mark.parametrize("range_rows", [1, 2, 3, 1000])
def test_awkward_rows(spark, tmp_path, monkeypatch, range_rows):
    monkeypatch.setattr(S.with_next, "__defaults__", ("doc_id", "text", range_rows))
    got = sorted((tuple(r) for r in S.op8_bottom_k(spark, write(spark, tmp_path)).collect()), key=str)
    want = sorted(brute(ROWS), key=str)
    assert sorted(map(str, (g[:3] for g in got))) == sorted(map(str, (w[:3] for w in want)))
    near = lambda rows, i, j: sorted((str(r[:3]), r[i], r[j]) for r in rows)
    for g, w in zip(near(got, 5, 6), near(want, 3, 4)):
        assert g[1:] == pytest.approx(w[1:])


def test_many_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S.with_next, "__defaults__", ("doc_id", "text", 3))
    monkeypatch.setattr(S, "FAN", 4)
    rows = [(i * 7 % 101, f"text number {i} of many words", "en", "a", 1, "x") for i in range(101)]
    got = sorted(tuple(r)[:3] for r in S.op8_bottom_k(spark, write(spark, tmp_path, rows)).collect())
    assert got == sorted(w[:3] for w in brute(rows))


def test_estimates_on_real_rows(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in S.op8_bottom_k(spark, "/root/testdata/sf0.001").collect()}
    want = brute(docs)
    assert len(got) == len(want)
    wrong = []
    for i, n, sha, edited, nxt in want:
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        wrong += [r["near_edited"] - edited, r["near_next"] - nxt]
    assert np.abs(wrong).max() < 0.2 and abs(np.mean(wrong)) < 0.01


def test_merge_containment_and_counts(spark):
    words = [f"w{i}" for i in range(3000)]
    df = spark.createDataFrame([(" ".join(words[:2000]), " ".join(words[:1000]), " ".join(words[996:2000]))], "a string, b string, c string")
    s = df.select(*(S.sketch(F.col(c)).alias(c) for c in "abc"))
    r = s.select(S.merged(F.col("b"), F.col("c")) == F.col("a"), S.containment(F.col("b"), F.col("a")), S.containment(F.col("a"), F.col("b")), S.distinct_shingles(F.col("a"))).first()
    assert r[0] and r[1] > 0.8 and r[2] == pytest.approx(0.5, abs=0.15) and r[3] == pytest.approx(1996, rel=0.3)
    parts = s.select(F.lit(1).alias("g"), F.explode(F.array("b", "c")).alias("s"))
    assert S.merge_sketches(parts, ["g"], "s").first()["s"] == s.first()["a"]


def test_plan_is_native(spark):
    plan = S.op8_bottom_k(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark, tmp_path):
    assert S.op8_bottom_k(spark, write(spark, tmp_path, [], SCHEMA)).count() == 0
