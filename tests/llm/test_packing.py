import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kalkula.llm.packing import CAPACITY, op9_best_fit_packing, plan_packing
from tests.llm.fixtures import ROWS, SCHEMA, write


def brute(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for r in rows:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), CAPACITY)):
            part = ids[at : at + CAPACITY]
            out.append((r[0], n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out, key=str)


def test_pieces_and_places(spark, tmp_path):
    got = [tuple(r) for r in op9_best_fit_packing(spark, write(spark, tmp_path)).collect()]
    assert sorted((r[:5] for r in got), key=str) == brute(ROWS)
    sequences = defaultdict(list)
    for r in got:
        sequences[r[5]].append((r[6], r[3]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= CAPACITY
    assert len(sequences) == -(-sum(r[3] for r in got) // CAPACITY)


def test_tokenizer_matches_on_real_rows(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id")
    rows = [tuple(r) for r in docs.collect()]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r)[:5] for r in op9_best_fit_packing(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_empty_table(spark, tmp_path):
    assert op9_best_fit_packing(spark, write(spark, tmp_path, [], SCHEMA)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=20))
def test_plan_uses_every_piece_once(histogram):
    used, n_sequences = defaultdict(int), 0
    for pattern, n in plan_packing(histogram, 50):
        assert n > 0 and sum(pattern) <= 50
        n_sequences += n
        for x in pattern:
            used[x] += n
    assert used == histogram
    assert n_sequences >= -(-sum(k * v for k, v in histogram.items()) // 50)


def test_plan_fills_exactly_by_single_pair_and_triple():
    assert plan_packing({60: 1, 40: 1}, 100) == [((60, 40), 1)]
    assert plan_packing({60: 2, 25: 2, 15: 2}, 100) == [((60, 25, 15), 2)]
    assert plan_packing({70: 1, 12: 1, 11: 1, 7: 1}, 100) == [((70, 12, 11, 7), 1)]


def test_ids_are_the_tokenizers_while_units_are_forgotten(monkeypatch):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from kalkula.llm import packing

    monkeypatch.setattr(packing, "REMEMBERED", 40)
    monkeypatch.setattr(packing, "CALL_UNITS", 3)
    monkeypatch.setattr(packing, "_workers", {})
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    texts = [
        "Plain words, it's 12.5% of them!", "", None, "ÀÉÎ õü ÿß×÷ ªºµ", "é é ée", "don't we'LL 'tis a's", "<|endoftext|> x <|startoftext|>", "a<|b <| end", " nbsp wide\x1cfile\x85next",
        "Привет МИР ΣΑΣ İstanbul", "漢字かな 한국어", "tab\tline\nfeed\x0bvt\x0cff\rcr", "\x00\x01 nul", "x" * 300, "!?!?…—«»", "١٢٣ ½ ²", *(f"word{i} same again" for i in range(60)), "Plain words again",
    ]
    for _ in range(2):
        got = [x.tolist() for x in packing.token_ids(pa.array(texts), path)]
        assert got == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
