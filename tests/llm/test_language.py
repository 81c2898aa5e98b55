import zlib

import numpy as np
import pyarrow as pa

from kalkula.llm.language import byte_grams, fit, gram_counts, op2_language_bitmask, predict
from tests.llm.fixtures import ROWS, SCHEMA, write


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = op2_language_bitmask(spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("lang is not null").collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    held = [r["lang"] == r["lang_pred"] for r in got if r["held_out"]]
    assert len(held) > 100 and np.mean(held) >= 0.98


def test_awkward_rows(spark, tmp_path):
    got = op2_language_bitmask(spark, write(spark, tmp_path)).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got}
    assert by[4]["lang_pred"] == by[3]["lang_pred"] == by[7]["lang_pred"] == "und" and by[4]["score"] == 0
    assert all(r["lang_pred"] in ("en", "de", "el", "und") for r in got)


def test_counts_and_filter_match_brute_force(spark):
    rows = [(1, "ab ba", "x", "s", 1, ""), (2, "ab", "x", "s", 1, ""), (3, "éa-b", "y", "s", 1, ""), (4, None, "y", "s", 1, "")]
    docs = spark.createDataFrame(rows, SCHEMA)

    def grams(text):
        b = b" " + "".join(c.lower() if c.isalpha() else " " for c in text).encode() + b" "
        return {b[i : i + 4] for i in range(len(b) - 3) if b[i : i + 4].count(b" ") <= 1}

    want = {}
    for r in rows[:3]:
        for g in grams(r[1]):
            want[r[2], int.from_bytes(g, "big")] = want.get((r[2], int.from_bytes(g, "big")), 0) + 1
    got = {(r["lang"], r["gram"]): r["n"] for r in gram_counts(docs.filter("text is not null")).collect()}
    assert got == want
    model = fit(docs)
    hits = model.hits(pa.array(["ab ba", "éa-b", "zzzz", "", None]))
    assert hits[0, 0] > hits[0, 1] and hits[1, 1] > hits[1, 0] and hits[2:].sum() < 1


def test_more_than_64_languages(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + i % 26)}q word{i}", f"l{i:03}", "s", 1, "") for i in range(100)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = predict(docs, fit(docs)).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.9


def test_no_gram_spans_two_texts():
    code, text = byte_grams(pa.array(["ab", None, "", "cd"]))
    assert [(int(c).to_bytes(4, "big"), int(t)) for c, t in zip(code, text)] == []
    code, text = byte_grams(pa.array(["abc", "", "def"]))
    assert [(int(c).to_bytes(4, "big"), int(t)) for c, t in zip(code, text)] == [(b" abc", 0), (b"abc ", 0), (b" def", 2), (b"def ", 2)]


def test_empty_table_and_nothing_learned(spark, tmp_path):
    assert op2_language_bitmask(spark, write(spark, tmp_path / "a", [], SCHEMA)).count() == 0
    got = op2_language_bitmask(spark, write(spark, tmp_path / "b", [(1, "some text", None, "s", 1, "")], SCHEMA)).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)]
