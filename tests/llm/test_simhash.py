import random
import re

import numpy as np
import pytest
import xxhash

from kalkula.llm import simhash as S
from tests.llm.fixtures import ROWS, SCHEMA, write


def fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or ""))
    grams = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows):
    prints = [fingerprint(r[1]) for r in rows]
    distinct = sorted(set(prints))
    x = np.array(distinct, np.uint64)
    edges = [(distinct[i], distinct[j]) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 3)]
    root = roots(distinct, edges)
    least = {}
    for r, p in zip(rows, prints):
        if r[0] is not None:
            least[root[p]] = min(least.get(root[p], r[0]), r[0])
    return sorted(((r[0], f"{p:016x}", least.get(root[p])) for r, p in zip(rows, prints)), key=str)


def test_awkward_rows(spark, tmp_path):
    got = sorted((tuple(r) for r in S.op7_simhash_pigeonhole(spark, write(spark, tmp_path)).collect()), key=str)
    assert got == brute(ROWS)


def test_real_rows(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in S.op7_simhash_pigeonhole(spark, "/root/testdata/sf0.01").collect()), key=str)
    assert got == brute(docs)
    assert sum(r[0] != r[2] for r in got) > 20


def _prints(n, seed=5):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)]
    out = set()
    while len(out) < n:
        x = rng.choice(centres)
        for _ in range(rng.choice((1, 2, 4, 7))):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize(("crowded", "in_task"), [(1000, 1000), (3, 1000), (3, 5)])
@pytest.mark.parametrize("parts", [1, 3, 4])
def test_every_way_of_linking_connects_the_same(spark, crowded, in_task, parts):
    prints = _prints(40 if parts == 1 else 60)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "print long")
    n, both = S.bit_statistics(df)
    groups = S.group_bits(n, both, parts)
    assert sorted(b for g in groups for b in g) == list(range(64))
    if parts == 1:
        groups, thresholds = [groups[0][:20], groups[0][20:42], groups[0][42:]], [1, 0, 0]  # the general bound with three partitions
    else:
        thresholds = S.allocate(n, both, groups)[1]
        assert sum(thresholds) == 3 - parts + 1
    partitions = [(g, t) for g, t in zip(groups, thresholds) if t >= 0]
    if sum(len(S._flips(g, t)) for g, t in partitions) > 1200:
        pytest.skip("too many signatures for a test")
    found = [(r["a"], r["b"]) for r in S.links(df, partitions, crowded=crowded, in_task=in_task).collect()]
    x = np.array(signed, np.int64).view(np.uint64)
    true = {(signed[i], signed[j]) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 3) if i != j}
    assert set(found) <= true
    assert roots(signed, found) == roots(signed, true)
    if crowded == 1000:
        assert {tuple(sorted(e)) for e in found} == {tuple(sorted(e)) for e in true}


def test_components_of_a_long_chain(spark):
    order = list(range(200))
    random.Random(2).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(150)] + [(order[160], order[161]), (order[161], order[160])]
    got = {r["node"]: r["root"] for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots({x for e in edges for x in e}, edges)
    assert got == want


def test_empty_table_and_no_edges(spark, tmp_path):
    assert S.op7_simhash_pigeonhole(spark, write(spark, tmp_path, [], SCHEMA)).count() == 0
    assert S.components(spark.createDataFrame([], "a long, b long")).count() == 0
