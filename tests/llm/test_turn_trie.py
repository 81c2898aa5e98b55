import hashlib
import random
import zlib
from collections import Counter

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kalkula.llm import turn_trie
from kalkula.llm.turn_trie import OP12_SQL, WIDTH, Node, build, insert, op12_adaptive_radix, prefix_trie, rebuilt, trie_nodes

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def brute(rows):
    """The contract word by word."""
    given_ = {}
    for c, turn, role, text in sorted((r[:4] for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "")):
        given_.setdefault(c, []).append((role or "", text or ""))
    members = {}
    for c, own in given_.items():
        h = zlib.crc32(str(c).encode()) % 6
        turns = tuple(given_.get(c - c % 100, [])[:h] + own[h:])
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append((c, len(turns)))
    out = []
    for path, have in members.items():
        below = [p for p in members if p[: len(path)] == path]
        childless = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(c for c, n in have if n == len(path)))
        parent = min(members[path[:-1]])[0] if path else None
        out.append((min(have)[0], len(path), parent, len(have), sum(len(p) == len(path) + 1 for p in below), len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{path}/conversations.parquet")
    return str(path)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=repr)


ROWS = [
    (0, 0, "user", "hello", "x"), (0, 1, "bot", "hi there", "x"), (0, None, None, "first of all", "x"),
    (1, 0, "user", "hello", None), (2, 0, None, None, None), (2, 0, None, None, None), (3, 5, "user", "é\U0001f600", "x"), (3, 4, "bot", "", "x"),
    (101, 0, "user", "alone", "x"), (107, 0, "user", "alone", "x"), (108, 0, "user", "alone", "x"), (108, 1, "user", "more", "x"), (None, 0, "user", "nobody's", "x"),
    *((c, t, "user", f"turn {t}", "x") for c in range(200, 260) for t in range(c % 7)),
    *((c, t, "user", f"turn {t} of {c}", "x") for c in range(300, 340) for t in range(9)),
    (400, 0, "user", "long " * 100_000, "x"), (401, 0, "user", "long " * 100_000, "x"),
]


def test_against_brute_force_and_sql(spark, tmp_path):
    path = write(spark, tmp_path, ROWS)
    want = brute(ROWS)
    assert rows_of(op12_adaptive_radix(spark, path)) == want
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet/*.parquet'")
    assert sorted(c.execute(f"SELECT {', '.join(COLUMNS)} FROM ({OP12_SQL})").fetchall(), key=repr) == want


def test_subtrees_and_lists_that_span_tasks(spark, tmp_path, monkeypatch):
    """Tasks of a few conversations each: hot openings and copies lie in many, and lists of members go in pieces."""
    rows = [(c, t, "user", f"t{t if t < 3 else (t, c % 3)}", "x") for c in range(90) for t in range(c % 8)] + [(c, 0, "user", "same", "x") for c in range(90, 170)]
    strings = rebuilt(spark.createDataFrame(rows, SCHEMA))
    want = brute(rows)
    monkeypatch.setattr(turn_trie, "PIECE_IDS", 2)
    for task_rows in (1, 7, 10_000):
        assert rows_of(prefix_trie(strings, task_rows)) == want


def test_empty_table(spark, tmp_path):
    assert op12_adaptive_radix(spark, write(spark, tmp_path, [])).count() == 0


def test_extra_columns_of_clashing_names(spark):
    df = spark.createDataFrame(ROWS[:12], SCHEMA)
    more = df.withColumn("key", F.lit(1)).withColumn("node", F.lit(2)).withColumn("own", F.lit(3)).withColumn("base", F.lit(4))
    assert rows_of(prefix_trie(rebuilt(more))) == rows_of(prefix_trie(rebuilt(df)))


def walk(node, at=b""):
    at += node.path
    yield at, node
    children = node.in_order()
    if node.layout == 48:
        bytes_ = [b for b, i in enumerate(node.index) if i]
    elif node.layout == 256:
        bytes_ = [b for b, c in enumerate(node.children) if c is not None]
    else:
        bytes_ = list(node.index)
    for b, child in zip(bytes_, children, strict=True):
        yield from walk(child, at + bytes([b]))


def test_layouts_grow():
    root = Node(b"")
    layouts = []
    for i in random.Random(1).sample(range(256), 256):
        insert(root, bytes([i, 7, 7]))
        layouts.append(root.layout)
    assert layouts == [4] * 4 + [16] * 12 + [48] * 32 + [256] * 208
    assert [p[0] for p, _ in walk(root) if p] == list(range(256))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=40))
def test_tree_keeps_strings(keys):
    root = build((k, i) for i, k in enumerate(keys))
    found = Counter({path: len(node.members) for path, node in walk(root) if node.members})
    assert found == Counter(keys)
    assert all(len(n.in_order()) != 1 or n.members or n is root for _, n in walk(root))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=4), min_size=1, max_size=30))
def test_nodes_lie_between_turns(conversations):
    ids = [hashlib.sha256(bytes([i])).digest()[: WIDTH - 4] + i.to_bytes(4, "big") for i in range(3)]
    keys = sorted((b"".join(ids[i] for i in c), n) for n, c in enumerate(conversations))
    nodes = list(trie_nodes(build(iter(keys)), keys[0][0], keys[-1][0]))
    assert len([n for n in nodes if "n_convs" in n]) == len({tuple(c[:d]) for c in conversations for d in range(len(c) + 1)})
