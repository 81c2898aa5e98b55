import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kalkula.llm.slack import Places, closest_fill, op13_minimum_bin_slack, pack, plan_windows
from tests.llm.fixtures import ROWS, SCHEMA, write


def check(got, rows, capacity):
    """Each id is in one piece, pieces have their checksums, sequences have no gaps and a length that needs no padding."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = Counter()
    for r in rows:
        ids[(r[0], tuple([*t.encode(r[1] or "", add_special_tokens=False).ids, 1]))] += 1
    left = Counter()  # by document: copies of each of its ranges
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        left[(r["doc_id"], r["doc_tokens"], r["start"], r["length"], r["ids_crc32"])] += 1
    for (doc, tokens), n in ids.items():
        crc = {(a, b): zlib.crc32(np.array(tokens[a : a + b], "<u4").tobytes()) for (d, m, a, b, _) in left if d == doc and m == len(tokens) for a, b in [(a, b)]}
        for _ in range(n):
            at = 0
            while at < len(tokens):
                k = next(k for k in left if left[k] and k[:3] == (doc, len(tokens), at) and k[4] == crc[k[2:4]])
                left[k] -= 1
                at += k[3]
            assert at == len(tokens)
    assert not +left
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        assert at & (at - 1) == 0


def test_pieces_and_places(spark, tmp_path):
    got = op13_minimum_bin_slack(spark, write(spark, tmp_path)).collect()
    check(got, ROWS, 2048)


def test_small_windows_cut_documents(spark, tmp_path):
    rows = [r for r in ROWS if r[0] != 5] + [(20 + i % 3, "ten words make eleven tokens with the one that ends", "en", "a", 50, "x") for i in range(9)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = pack(docs, capacity=16).withColumnRenamed("id", "doc_id").collect()
    check(got, rows, 16)
    assert any(r["start"] % 16 for r in got)


def test_real_rows_fill_every_window(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_minimum_bin_slack(spark, str(tmp_path)).collect()
    check(got, [tuple(r) for r in docs.collect()], 2048)
    whole = {r["doc_id"] for r in got if r["doc_tokens"] > 2048 or r["length"] == r["doc_tokens"]}
    assert len(whole) > 0.8 * docs.select("doc_id").distinct().count()  # a window that no lengths fill costs one cut


def test_empty_table(spark, tmp_path):
    assert op13_minimum_bin_slack(spark, write(spark, tmp_path, [], SCHEMA)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 40), st.dictionaries(st.integers(1, 20), st.integers(1, 3), max_size=5))
def test_fill_is_closest(gap, count):
    have = [count.get(x, 0) for x in range(21)]
    taken = closest_fill(gap, have, sum(1 << x for x in count))
    assert all(0 < k <= count[x] for x, k in taken.items())
    best = max(s for k in itertools.product(*(range(n + 1) for n in count.values())) if (s := sum(a * b for a, b in zip(k, count, strict=True))) <= gap)
    assert sum(x * k for x, k in taken.items()) == best


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 9), max_size=12))
def test_every_token_has_one_place(histogram):
    plan, rest = plan_windows(histogram, 32)
    used = Counter(rest)
    for pattern, n in plan:
        assert sum(pattern) == 32
        for x in pattern:
            used[x] += n
    assert used == histogram
    length = np.array([x for x, n in histogram.items() for _ in range(n)], np.int64)
    number = np.array([i for n in histogram.values() for i in range(n)], np.int64)
    row, begin, size, sequence, offset = Places(histogram, 32).of(length, number)
    assert len(set(zip(sequence.tolist(), offset.tolist(), strict=True))) == len(row)
    tokens = {(r, b + i) for r, b, s in zip(row.tolist(), begin.tolist(), size.tolist(), strict=True) for i in range(s)}
    assert tokens == {(r, i) for r, x in enumerate(length.tolist()) for i in range(x)}
    assert size.sum() == length.sum()
    ends = defaultdict(int)
    for s, o, z in zip(sequence.tolist(), offset.tolist(), size.tolist(), strict=True):
        ends[s] = max(ends[s], o + z)
    filled = np.bincount(sequence, size, minlength=len(ends)) if len(sequence) else []
    assert all(filled[s] == e and e & (e - 1) == 0 and e <= 32 for s, e in ends.items())
    assert sum(e < 32 for e in ends.values()) <= 5


@pytest.mark.parametrize("histogram", [{1500: 1000}, {1025: 7, 1024: 3}, {2048: 5}, {}])
def test_lengths_that_never_meet(histogram):
    plan, rest = plan_windows(histogram, 2048)
    assert sum(n * x for x, n in rest.items()) + sum(n for _, n in plan) * 2048 == sum(x * n for x, n in histogram.items())
