"""Conversation prefix trie by adaptive radix trees over turn ids.

A turn's id has a fixed width: 16 bytes of a hash of its role and text, then its code points, big-endian. A conversation is
the string of its turns' ids. Conversations are dealt to tasks by ranges of (string, conv_id), so a subtree lies in one task or
in tasks side by side, and copies of one conversation can be parted too. Each task builds an adaptive radix tree of its
strings: nodes with up to 4, 16, 48 or 256 children in layouts that grow, and with compressed paths. Only depths between
turns become nodes of the trie.

Nodes on the way to a task's first or last string may go on in other tasks. They are handed on as parts and added up by
hash; the others are complete. Lists of members that end at such a node are handed on in pieces and hashed in order as
they stream by.

Null role or text counts as empty; rows without conv_id belong to no conversation and are left out. Turns of equal number go by
role, then by their hash; repeated rows are turns of their own. An empty table gives no nodes, not even a root. Texts are
only hashed, so long ones cost no memory; a conversation is held as 20 bytes a turn. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kalkula.llm.common import cut_lineage, read_table

#: Bytes of a turn's id. The last four of them are the code points of its text.
WIDTH = 20
#: Conversations for each task that builds a tree, and the most member ids in one piece of a list.
TASK_ROWS, PIECE_IDS = 30_000, 10_000
NO_MEMBERS = hashlib.sha256(b"").hexdigest()

NODES = (
    "node binary, parent binary, above array<binary>, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, first_end long, ends string, chars long"
)


class Node:
    """A node of the radix tree: the bytes of its compressed path, the members that end here, and children by next byte.

    Up to 16 children lie beside their sorted bytes; up to 48 behind an index of 256 places; more in 256 places.
    """

    __slots__ = ("children", "index", "layout", "members", "path")

    def __init__(self, path: bytes) -> None:
        self.path, self.members, self.layout = path, None, 4
        self.index, self.children = bytearray(), []

    def find(self, byte: int) -> Node | None:
        if self.layout <= 16:
            at = self.index.find(byte)
            return self.children[at] if at >= 0 else None
        if self.layout == 48:
            at = self.index[byte]
            return self.children[at - 1] if at else None
        return self.children[byte]

    def add(self, byte: int, child: Node) -> None:
        if self.layout <= 16:
            if len(self.children) < self.layout:
                at = next((i for i, b in enumerate(self.index) if b > byte), len(self.index))
                self.index.insert(at, byte)
                self.children.insert(at, child)
                return
            if self.layout == 4:
                self.layout = 16
            else:
                wide = bytearray(256)
                for i, b in enumerate(self.index):
                    wide[b] = i + 1
                self.layout, self.index = 48, wide
            self.add(byte, child)
        elif self.layout == 48:
            if len(self.children) < 48:
                self.children.append(child)
                self.index[byte] = len(self.children)
                return
            self.layout, self.children = 256, [self.children[i - 1] if i else None for i in self.index]
            self.index = bytearray()
            self.children[byte] = child
        else:
            self.children[byte] = child

    def in_order(self) -> list[Node]:
        if self.layout == 48:
            return [self.children[i - 1] for i in self.index if i]
        return [c for c in self.children if c is not None]

    def part_at(self, length: int) -> None:
        """The path is cut after so many bytes; what follows moves to an only child."""
        lower = Node(self.path[length + 1 :])
        lower.members, lower.layout, lower.index, lower.children = self.members, self.layout, self.index, self.children
        byte = self.path[length]
        self.path, self.members, self.layout, self.index, self.children = self.path[:length], None, 4, bytearray([byte]), [lower]


def insert(root: Node, key: bytes) -> Node:
    """The node where key ends, made where there is none."""
    node, at = root, 0
    while True:
        path = node.path
        if not key.startswith(path, at):
            rest = key[at : at + len(path)]
            node.part_at(next((i for i, (a, b) in enumerate(zip(path, rest, strict=False)) if a != b), len(rest)))
        at += len(node.path)
        if at == len(key):
            return node
        child = node.find(key[at])
        if child is None:
            child = Node(key[at + 1 :])
            node.add(key[at], child)
            return child
        node, at = child, at + 1


def build(rows: Iterator[tuple[bytes, int]]) -> Node:
    """The tree of the strings, each with its members in the order in which they come."""
    root = Node(b"")
    for key, member in rows:
        node = insert(root, key)
        if node.members is None:
            node.members = []
        node.members.append(member)
    return root


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def prefix_hashes(key: bytes) -> list[bytes]:
    """A hash for each depth of a string of turn ids, from that of the depth before."""
    out = [b"\0" * 16]
    for at in range(0, len(key), WIDTH):
        out.append(hashlib.blake2b(out[-1] + key[at : at + WIDTH], digest_size=16).digest())
    return out


def listed(members: list[int] | None) -> str:
    return ",".join(map(str, members or ()))


class _Sums:
    """What the subtree below an aligned depth has gathered: members, and children, leaves and savings of complete nodes."""

    __slots__ = ("children", "first", "leaves", "members", "saved", "waiting")

    def __init__(self) -> None:
        self.first, self.members, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.waiting: list[dict] = []  # complete nodes that wait for their parent's conv_id

    def add(self, o: _Sums) -> None:
        self.first = o.first if self.first is None else self.first if o.first is None else min(self.first, o.first)
        self.members += o.members
        self.children += o.children
        self.leaves += o.leaves
        self.saved += o.saved
        self.waiting = self.waiting + o.waiting if len(o.waiting) < len(self.waiting) else o.waiting + self.waiting


def trie_nodes(root: Node, first: bytes, last: bytes) -> Iterator[dict]:
    """Rows of NODES: complete nodes, and parts of those on the way to the first or last string."""
    ways = [(first, prefix_hashes(first)), (last, prefix_hashes(last))]

    def emit(sums: _Sums, depth: int, chars: int, along: tuple[int, int], members: list[int] | None) -> Iterator[dict]:
        """The trie's node at this depth is done; sums then is what it hands to the node above."""
        way = next((w for w, n in zip(ways, along, strict=True) if n >= depth * WIDTH), None)
        for row in sums.waiting:
            yield row | ({"parent": way[1][depth]} if way else {"parent_conv_id": sums.first})
        row = {"depth": depth, "conv_id": sums.first, "n_convs": sums.members, "chars": chars}
        if way:
            hashes = way[1]
            pieces = [members[i : i + PIECE_IDS] for i in range(0, len(members or ()), PIECE_IDS)] or [None]
            own = {"node": hashes[depth], "parent": hashes[depth - 1] if depth else None, "above": hashes[: depth + 1], "n_children": sums.children, "n_leaves": sums.leaves, "saved_tokens": sums.saved}
            yield row | own | {"first_end": pieces[0][0] if pieces[0] else None, "ends": listed(pieces[0])}
            for piece in pieces[1:]:  # only lists: nothing that would be added twice
                yield {"node": hashes[depth], "depth": depth, "n_convs": 0, "n_children": 0, "n_leaves": 0, "saved_tokens": 0, "first_end": piece[0], "ends": listed(piece)}
            sums.children, sums.leaves, sums.saved, sums.waiting = 0, 0, 0, []
            return
        sums.leaves += not sums.children
        sums.saved += (sums.members - 1) * chars
        own = {"n_children": sums.children, "n_leaves": sums.leaves, "saved_tokens": sums.saved, "ends_sha256": hashlib.sha256(listed(members).encode()).hexdigest() if members else NO_MEMBERS}
        sums.children, sums.waiting = 1, [row | own]

    # Depth first without recursion: (node, bytes above it, bytes up to it, bytes that it shares with each way, its sums, children left)
    def open_(node: Node, byte: bytes, start: int, along: tuple[int, int], tail: bytes) -> tuple:
        """tail: the bytes since the last turn's start."""
        part = byte + node.path
        end = start + len(part)
        along = tuple(n if n < start else start + common_prefix(part, w[0][start:end]) for n, w in zip(along, ways, strict=True))
        return node, part, start, end, along, tail, _Sums(), iter([])

    def children(node: Node) -> Iterator[tuple[int, Node]]:
        if node.layout <= 16:
            return iter(list(zip(node.index, node.children, strict=True)))
        if node.layout == 48:
            return iter([(b, node.children[i - 1]) for b, i in enumerate(node.index) if i])
        return iter([(b, c) for b, c in enumerate(node.children) if c is not None])

    stack = [[*open_(root, b"", 0, (0, 0), b"")[:7], children(root)]]
    while stack:
        node, part, start, end, along, tail, sums, left = stack[-1]
        step = next(left, None)
        if step is not None:
            byte, child = step
            whole = tail + part
            below = whole[len(whole) - end % WIDTH :] if end % WIDTH else b""
            stack.append([*open_(child, bytes([byte]), end, along, below)[:7], children(child)])
            continue
        stack.pop()
        if node.members:
            sums.members += len(node.members)
            sums.first = node.members[0] if sums.first is None else min(sums.first, node.members[0])
        whole = tail + part  # ends at `end`, begins at a turn's start
        begin = end - len(whole)
        depth = end // WIDTH
        while depth and depth * WIDTH > start:
            at = depth * WIDTH - begin
            yield from emit(sums, depth, int.from_bytes(whole[at - 4 : at], "big"), along, node.members if depth * WIDTH == end else None)
            depth -= 1
        if stack:
            stack[-1][6].add(sums)
        else:
            yield from emit(sums, 0, 0, along, node.members if end == 0 else None)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id and key: each conversation's own turns behind the opening that it shares with others of its hundred."""
    text, role = (F.coalesce(F.col(c), F.lit("")) for c in ("text", "role"))
    content = F.unhex(F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), role, text), 256))
    turn = F.concat(F.substring(content, 1, WIDTH - 4), F.unhex(F.lpad(F.hex(F.char_length(text)), 8, "0")))
    own = conversations.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), turn.alias("id")))), lambda t: t["id"]).alias("own"))
    own = cut_lineage(own)
    opening = own.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("own", 1, 5).alias("opening"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    both = own.withColumn("base", F.expr("conv_id - conv_id % 100")).join(opening, "base", "left").withColumn("h", h)
    empty = F.array().cast("array<binary>")
    turns = F.concat(F.slice(F.coalesce("opening", empty), F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.size("own")))
    return both.select("conv_id", F.unhex(F.array_join(F.transform(turns, F.hex), "")).alias("key"))


def prefix_trie(strings: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Nodes of the trie of strings (conv_id, key), a row each."""
    spark = strings.sparkSession
    strings = cut_lineage(strings.select("conv_id", "key"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-strings.count() // task_rows))

    def tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: list[bytes] = []

        def rows() -> Iterator[tuple[bytes, int]]:
            for batch in batches:
                keys = batch.column("key").to_pylist()
                ends[:] = [ends[0] if ends else keys[0], keys[-1]] if keys else ends
                yield from zip(keys, batch.column("conv_id").to_pylist(), strict=True)

        root = build(rows())
        if not ends:
            return
        held: list[dict] = []
        for row in trie_nodes(root, ends[0], ends[1]):
            held.append(row)
            if len(held) == 5000:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        yield pa.RecordBatch.from_pylist(held, schema)

    kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string(), "array<binary>": pa.list_(pa.binary())}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in NODES.split(", ")])
    nodes = cut_lineage(strings.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(tree, NODES))

    partial = nodes.where("node IS NOT NULL")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = partial.groupBy("node").agg(*[F.max(c).alias(c) for c in ("parent", "depth", "chars")], F.max("above").alias("above"), F.min("conv_id").alias("conv_id"), *sums)
    below = merged.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("shared"))
    merged = cut_lineage(merged.join(below, "node", "left").withColumn("n_children", F.expr("n_children + coalesce(shared, 0)")).drop("shared"))
    adds = merged.select(F.explode("above").alias("node"), F.expr("n_leaves + int(n_children = 0)").alias("n_leaves"), F.expr("saved_tokens + (n_convs - 1) * chars").alias("saved_tokens"))
    subtree = adds.groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, hashed, done = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["node"] != node:
                    if node is not None:
                        done.append((node, hashed.hexdigest()))
                    node, hashed = row["node"], hashlib.sha256(row["ends"].encode())
                else:
                    hashed.update(b"," + row["ends"].encode())
        if node is not None:
            done.append((node, hashed.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["node", "ends_sha256"])

    ends = partial.where("first_end IS NOT NULL").select("node", "first_end", "ends").repartition("node").sortWithinPartitions("node", "first_end").mapInArrow(in_order, "node binary, ends_sha256 string")
    parents = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("shared_conv_id"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    shared = merged.drop("n_leaves", "saved_tokens").join(subtree, "node").join(ends, "node", "left").join(parents, "parent", "left")
    shared = shared.withColumn("parent_conv_id", F.col("shared_conv_id")).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_MEMBERS)))
    inner = nodes.where("node IS NULL AND parent IS NULL")
    under = nodes.where("node IS NULL AND parent IS NOT NULL").join(parents, "parent").withColumn("parent_conv_id", F.col("shared_conv_id"))
    return shared.select(*out).unionByName(inner.select(*out)).unionByName(under.select(*out))


def op12_adaptive_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(read_table(spark, sf_dir, "conversations")))


# CRC-32 of the decimal digits, bit by bit: the polynomial 0xEDB88320 is 3988292384.
_CRC32 = """xor(list_reduce(list_transform(range(length(c::VARCHAR)), lambda i: ascii(substr(c::VARCHAR, i::INT + 1, 1))::UBIGINT),
  lambda crc, b: list_reduce(range(8)::UBIGINT[], lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END, xor(crc, b)), 4294967295::UBIGINT), 4294967295::UBIGINT)"""
OP12_SQL = f"""
WITH t AS (SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY ALL),
h AS (SELECT c, turns, ({_CRC32})::BIGINT % 6 AS h FROM t),
r AS (SELECT a.c, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns FROM h a LEFT JOIN t b ON b.c = a.c - a.c % 100),
p AS (SELECT c, turns, len(turns) AS n, unnest(range(len(turns) + 1)) AS d FROM r),
m AS (SELECT c, d, n, turns[1:d] AS path FROM p),
nodes AS (SELECT path, d AS depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * CASE WHEN d > 0 THEN length(path[d].text) ELSE 0 END AS own,
  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256 FROM m GROUP BY path, d),
kids AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
k AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (path, depth)),
u AS (SELECT path, depth, own, n_children, unnest(range(depth + 1)) AS d FROM k),
s AS (SELECT path[1:d] AS path, d AS depth, sum(own) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM u GROUP BY ALL)
SELECT k.conv_id, k.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, k.n_convs, k.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
FROM k JOIN s USING (path, depth) LEFT JOIN nodes q ON q.depth = k.depth - 1 AND q.path = k.path[1:k.depth - 1]
"""
