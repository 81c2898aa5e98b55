import re
from collections import Counter

import pytest

from kalkula.llm.quality import RULES, ablation, apply_policy, op4_rule_ledger, rule_ledger
from tests.llm.fixtures import ROWS, SCHEMA, write

MORE = [
    (20, "a b c d e f g h x a b c d e f g h", "en", "a", 1, "x"),
    (21, "one two\none two\n \n \none two \nthree\n\n\n", "en", "a", 1, "x"),
    (22, "Ä#ö *$%&|<> 　x y", "en", "a", 1, "x"),
    (23, "SHOUT!! " * 3 + " ".join(f"WORD{i}!!" for i in range(30)), "en", "a", 1, "x"),
    (24, " ".join(f"word{i} |" for i in range(30)), "en", "a", 1, "x"),
    (25, " ".join(f"plain{i}" for i in range(30)) + ".\nAnother line follows.", "en", "a", 1, "x"),
    (26, " ".join(["same"] * 20), "en", "a", 1, "x"),
]


def brute(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + j for i, w in enumerate(windows) if w in twice for j in range(8)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_measures(spark, tmp_path):
    rows = ROWS + MORE
    got = sorted((tuple(r) for r in op4_rule_ledger(spark, write(spark, tmp_path, rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()), key=str)
    want = []
    for r in rows:
        m = brute(r[1])
        want.append((r[0], *m, m[0] < 20 or 100 * m[4] > 30 * m[0]))
    assert got == sorted(want, key=str)


def test_measures_on_real_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: tuple(r[m] for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in op4_rule_ledger(spark, "/root/testdata/sf0.001").collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == brute(r["text"]), r["doc_id"]


def test_junk_goes_and_clean_stays(spark):
    docs = spark.createDataFrame(MORE, SCHEMA)
    assert {r["doc_id"] for r in apply_policy(docs).collect()} == {25}
    assert apply_policy(docs).columns == docs.columns


def test_labels_agree(spark):
    """Held against the quality labels: nearly all junk is rejected, nearly all good text kept."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = op4_rule_ledger(spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("n_words >= 20").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in judged}
    assert n.get((0, True), 0) <= 0.05 * n[0, False]
    assert n.get((1, False), 0) <= 0.02 * n[1, True]


def test_ablation(spark):
    ledger = rule_ledger(spark.createDataFrame(MORE + ROWS, SCHEMA)).cache()
    bits = [r["quality_failed"] for r in ledger.collect()]
    mask = (1 << len(RULES)) - 1
    for i, r in enumerate(ablation(ledger, mask).collect()):
        assert r["rule"] == RULES[i][0]
        assert r["n_failed"] == sum(b >> i & 1 for b in bits)
        assert r["n_alone"] == sum(b == 1 << i for b in bits)
        assert r["n_kept_without"] == sum(b & ~(1 << i) == 0 for b in bits)


@pytest.mark.parametrize("rows", [[]])
def test_empty_table(spark, tmp_path, rows):
    assert op4_rule_ledger(spark, write(spark, tmp_path, rows, SCHEMA)).count() == 0
    assert [r["n_failed"] for r in ablation(rule_ledger(spark.createDataFrame(rows, SCHEMA))).collect()] == [0] * len(RULES)
