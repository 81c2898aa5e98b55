import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kalkula.llm import context_tree as C
from tests.llm.fixtures import ROWS, SCHEMA, write


def lower(text):
    return "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or "")


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


class Tree:
    """Context-tree weighting by its definition, one decision after the other."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.children = depth, {}, {}
        for x in texts:
            for context, decision, one in self.decisions(x):
                for d in range(depth + 1):
                    node = (context[depth - d :], decision)
                    self.counts.setdefault(node, [0, 0])[one] += 1
                    if d:
                        self.children.setdefault((context[depth - d + 1 :], decision), set()).add(node)
        self.weighted = {}

    def decisions(self, text):
        b = bytes(self.depth) + lower(text).encode() + b"\xff"
        for i in range(self.depth, len(b)):
            decision = 1
            for j in range(7, -1, -1):
                yield b[i - self.depth : i], decision, b[i] >> j & 1
                decision = decision * 2 + (b[i] >> j & 1)

    def kt(self, node):
        z, o = self.counts.get(node, (0, 0))
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi) if z + o else 0.0

    def w(self, node):
        if node not in self.weighted:
            if len(node[0]) == self.depth:
                self.weighted[node] = self.kt(node)
            else:
                self.weighted[node] = np.logaddexp(math.log(0.5) + self.kt(node), math.log(0.5) + sum(self.w(c) for c in self.children.get(node, ())))
        return self.weighted[node]

    def p(self, context, decision, one, d=0):
        node = (context[self.depth - d :], decision)
        z, o = self.counts.get(node, (0, 0))
        own = ((o if one else z) + 0.5) / (z + o + 1)
        if d == self.depth:
            return own
        stay = math.exp(math.log(0.5) + self.kt(node) - self.w(node))
        return stay * own + (1 - stay) * self.p(context, decision, one, d + 1)

    def bits(self, text):
        return -sum(math.log2(self.p(*x)) for x in self.decisions(text))


@pytest.mark.parametrize(("depth", "block_bytes"), [(2, 1 << 20), (3, 40)])
def test_code_length_is_that_of_the_definition(spark, depth, block_bytes):
    texts = ["Abra kadabra", "abrakadabra abra", "", None, "größe und maße", "zzz", "abra zzz kadabra", "abra kadabra"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    tree = Tree([t for i, t in enumerate(texts) if i % 3], depth)
    got = C.score(docs, F.col("doc_id") % 3 != 0, depth=depth, block_bytes=block_bytes).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["code_bits"] == pytest.approx(tree.bits(texts[r["id"]]), rel=1e-9)
        assert r["n_bytes"] == len(lower(texts[r["id"]]).encode()) + 1


def base(rows):
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", lower(r[1])), None] for r in rows]
    count = Counter(w for r, t in zip(rows, tokens) if not held(r[0]) for w in t)
    n, v = sum(count.values()), len(count)
    return sorted(((r[0], held(r[0]), len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), 4)) for r, t in zip(rows, tokens)), key=str)


def test_awkward_rows(spark, tmp_path):
    got = C.op3_context_tree(spark, write(spark, tmp_path)).collect()
    assert sorted(((*tuple(r)[:5], round(r["base_score"], 4)) for r in got), key=str) == base(ROWS)
    assert all(r["score"] < 0 for r in got)


def test_real_rows_and_held_out_texts(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = C.op3_context_tree(spark, "/root/testdata/sf0.01").collect()
    want = base(rows)
    for g, w in zip(sorted((tuple(r)[:6] for r in got), key=str), want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], abs=1e-3)
    out = [r for r in got if r["held_out"]]
    assert np.median([r["bits_per_byte"] for r in out]) < 3


def test_empty_table(spark, tmp_path):
    assert C.op3_context_tree(spark, write(spark, tmp_path, [], SCHEMA)).count() == 0


def test_deep_contexts_beat_words_on_held_out_texts(spark):
    """With contexts of seven bytes the sum over held-out texts is over that of the base word model, on 2 MB to learn from."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    r = C.score(docs, ~held, depth=7).filter(~F.col("known")).agg(F.sum("code_bits").alias("bits"), F.sum("base").alias("base")).first()
    assert -r["bits"] * math.log10(2) > r["base"]
