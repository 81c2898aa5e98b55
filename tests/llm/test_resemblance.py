import random
from itertools import combinations

import numpy as np
import pyarrow as pa

from kalkula.llm import resemblance as R
from kalkula.llm import simhash
from kalkula.llm.common import cut_lineage
from tests.llm.fixtures import ROWS, SCHEMA, write
from tests.llm.test_simhash import roots


def shingles(text):
    ws = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return frozenset(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def linked(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9


def brute(rows):
    """Ids that stay."""
    sets = [shingles(r[1]) for r in rows]
    edges = [(i, j) for i, j in combinations(range(len(rows)), 2) if linked(sets[i], sets[j])]
    root, first = roots(range(len(rows)), edges), {}
    for i, r in enumerate(rows):
        first[root[i]] = min(first.get(root[i], (True, 0)), (r[0] is None, r[0] or 0))
    return sorted(None if none else x for none, x in first.values() if not none) + [None for none, _ in first.values() if none]


def edited():
    """Texts, copies with edited words, copies with another tail, and a line that all have."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows = []
    for _ in range(60):
        ws = [word() for _ in range(rng.choice((20, 60, 150, 400)))]
        rows.append(ws)
        for share in (0.01, 0.02, 0.03):
            rows.append([word() if rng.random() < share else w for w in ws])
        rows.append(ws[: -max(1, len(ws) // 12)] + [word() for _ in range(max(1, len(ws) // 12))])
    return [(i, " ".join(ws) + "\none line that all of these texts have in common at the end", "en", "a", 1, "x") for i, ws in enumerate(rows)]


def kept(spark, rows):
    return [r["doc_id"] for r in R.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()]


def test_edited_copies(spark):
    rows = edited()
    want = brute(rows)
    assert sorted(kept(spark, rows)) == want
    assert 60 <= len(want) < 200


def test_pipeline_stage_drops_edited_copies(spark):
    import corpus_pipeline

    rows = edited()
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r["doc_id"] for r in out.collect()) == brute(rows)


def test_real_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = R.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_awkward_rows_and_empty_table(spark, tmp_path):
    got = kept(spark, ROWS)
    assert sorted(x for x in got if x is not None) == [x for x in brute(ROWS) if x is not None]
    assert got.count(None) == brute(ROWS).count(None)
    assert R.drop_near_duplicates(spark.read.parquet(f"{write(spark, tmp_path, [], SCHEMA)}/documents.parquet")).count() == 0


def test_forest_connects_what_is_linked():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(12):
        own = rng.integers(0, 1 << 62, 40)
        sets += [np.unique(np.concatenate([own[: 40 - k], rng.integers(0, 1 << 62, k)])) for k in rng.integers(0, 9, 6)]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    links = R.forest(np.concatenate(sets).astype(np.uint64), at)
    true = [(i, j) for i, j in combinations(range(len(sets)), 2) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9]
    assert {tuple(sorted(e)) for e in links} <= set(true)
    assert roots(range(len(sets)), links) == roots(range(len(sets)), true)


def test_simhash_finds_links_that_are_checked(spark, monkeypatch):
    """Links within the distance by all pairs of fingerprints; those of 0.8 or more hold, and the exact search gets none of these components."""
    rows = list({r[1]: r for r in edited()}.values())
    hashes, at = R.shingle_sets(pa.array([r[1] for r in rows]))
    node, print_ = R._nodes(hashes, at).tolist(), simhash.majorities(hashes, at)
    sets = dict(zip(node, (shingles(r[1]) for r in rows), strict=True))
    near = [(a, b) for (a, p), (b, q) in combinations(zip(node, print_.tolist(), strict=True), 2) if (p ^ q).bit_count() <= R.DISTANCE]
    nodes = spark.createDataFrame([(a, int(p), i) for i, (a, p) in enumerate(zip(node, print_.view(np.int64).tolist(), strict=True))], "node long, print long, row long")
    docs = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows)], "row long, text string")
    found = R.fingerprint_candidates(nodes.select("node", "print"))
    pairs = [tuple(r) for r in found.select("hub", "node").collect()]
    assert roots(node, pairs) == roots(node, near)
    assert len(near) > 20 and {tuple(sorted(p)) for p in pairs} <= {tuple(sorted(p)) for p in near}
    unlike = spark.createDataFrame([(node[0], x) for x in node if not linked(sets[node[0]], sets[x])], "hub long, node long")
    held = [tuple(r) for r in R.checked(found.unionByName(unlike), nodes, docs).collect()]
    assert sorted(held) == sorted(p for p in pairs if linked(sets[p[0]], sets[p[1]]))
    seen, first = [], R.checked
    monkeypatch.setattr(R, "checked", lambda *args: seen.append(first(*args)) or seen[-1])
    _, named = R.near_copies(docs.withColumn("id", docs["row"]))
    assert {tuple(sorted(r)) for r in seen[0].collect()} == {tuple(sorted(p)) for p in held}
    true = [(a, b) for a, b in combinations(node, 2) if linked(sets[a], sets[b])]
    assert len({x for p in true for x in p}) > len({x for p in held for x in p})  # the others by the exact search
    of = dict(tuple(r) for r in named.collect())
    assert len(set(of.values())) == len({roots(node, true)[x] for p in true for x in p})


def test_exact_search_leaves_out_what_is_connected(spark):
    batch = pa.RecordBatch.from_pydict({"key": [1, 1, 2, 2, 3, 3, 4, 4], "node": [10, 11, 10, 12, 13, 14, 10, 15], "n": [50, 50, 50, 50, 50, 50, 50, 90], "root": pa.array([10, 10, 10, 10, None, None, 10, None], pa.int64())})
    hub, node = R._met([batch], 0.8)
    assert list(zip(hub.tolist(), node.tolist(), strict=True)) == [(13, 13), (13, 14)]
    at, hashes = np.array([0, 10, 20, 30]), np.tile(np.arange(10, dtype=np.uint64), 3)
    assert len(R.forest(hashes, at)) == 2
    assert len(R.forest(hashes, at, known=np.array([5, 7, 5]))) == 1
    df = spark.createDataFrame([(i, i * 2) for i in range(20)], "node long, n long")
    named = R.with_root(df, cut_lineage(spark.createDataFrame([(3, 1), (4, 1)], "node long, root long")))
    assert sorted(tuple(r) for r in named.select("node", "n", "root").collect()) == [(i, 2 * i, 1 if i in (3, 4) else None) for i in range(20)]
