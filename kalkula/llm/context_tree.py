"""Scoring texts by context-tree weighting over bytes.

Each byte is eight binary decisions. A decision (the bits of the byte so far) has a context tree over the bytes before it:
a node for every context of 0 to `depth` bytes, with counts of zeros and ones. A node's Krichevsky-Trofimov estimate is
mixed, half and half, with the product of its children's mixtures, from the deepest contexts up; this weights all prunings
of the tree by their size. After training, the code length of a byte is that of its eight decisions, each a mixture of the
KT predictions along its context, weighted by the posterior of the tree ending at that depth.

On Spark: texts are dealt into blocks of about block_bytes. Each block lists the distinct contexts with next byte
(depth + 1 bytes) and the distinct words in it, with their counts in training texts. Lists are cut by hash and meet
in buckets, where counts are summed over all blocks; the tree is built from the counts level by level with groupBy
and joins; every block then gets back exactly the code lengths and counts of its own contexts and words and scores its
texts with them. Nothing that grows with the corpus is sent to the driver or to every task.

Texts are lower-cased (A-Z) and end with byte 255, which UTF-8 never has; depth zero bytes stand before each. A null text
counts as empty. Rows with null ids are training rows, not held out. Repeated rows are scored and counted one by
one; extra columns are ignored; an empty table gives an empty result; with nothing to learn from, every decision costs
one bit and no word is known.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kalkula.llm.common import cut_lineage, lower_ascii, range_hashes, read_table, text_bytes, words

DEPTH, BLOCK_BYTES = 4, 6 << 20
END = 255
_ENDS = np.uint64(0xE7037ED1A0B428DB)  # the end token among the words' hashes


def _grams(texts: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of depth + 1 bytes ending at each byte of the texts and at their end, and the n+1 places that part the texts."""
    data, offsets = text_bytes(texts)
    at = offsets + (depth + 1) * np.arange(len(offsets))
    out = np.zeros(len(data) + (depth + 1) * (len(offsets) - 1), np.uint8)
    keep = np.ones(len(out), dtype=bool)
    for i in range(depth):
        keep[at[:-1] + i] = False
    keep[at[1:] - 1] = False
    out[at[1:] - 1] = END
    out[keep] = lower_ascii(data)
    size = max(0, len(out) - depth)
    code = np.zeros(size, np.uint64)
    for i in range(depth + 1):
        code = (code << np.uint64(8)) | out[i : size + i]
    # the code at place p ends at byte p + depth of out: it belongs to a text if that byte isn't one of the zeros before it
    ends = np.ones(len(out), dtype=bool)
    for i in range(depth):
        ends[at[:-1] + i] = False
    own = ends[depth:]
    return code[own], offsets + np.arange(len(offsets))


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text and of its end token, and the n+1 places that part the texts."""
    data, offsets = text_bytes(texts)
    data = lower_ascii(data)
    starts, ends, at = words(data, offsets)
    out = np.full(len(starts) + len(texts), _ENDS, np.uint64)
    keep = np.ones(len(out), dtype=bool)
    places = at + np.arange(len(at))
    keep[places[1:] - 1] = False
    out[keep] = range_hashes(data, starts, ends)
    return out, places


def _counted(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sum of their weights. Keys are hashed together first, so only distinct ones are sorted."""
    code, distinct = pd.factorize(key)
    order = np.argsort(distinct)
    total = np.bincount(code, weight, minlength=len(distinct)) if len(key) else np.zeros(0)
    return distinct[order].astype(np.uint64), np.rint(total[order]).astype(np.int64)


def _looked_up(key: np.ndarray, keys: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The value of each key; all keys are among the sorted keys."""
    code, distinct = pd.factorize(key)
    return value[np.searchsorted(keys, distinct)][code]


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (((key + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets


def _slices(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    _, offsets = text_bytes(texts)
    edges = np.flatnonzero(np.diff(offsets[:-1] // limit, prepend=-1)) if len(texts) else []
    for a, b in zip(edges, [*edges[1:], len(texts)], strict=True):
        yield int(a), texts.slice(int(a), int(b - a))


KINDS = {"gram": _grams, "word": _tokens}


def _parts(texts: pa.Array, kind: str, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for first, part in _slices(texts):
        key, at = _grams(part, depth) if kind == "gram" else _tokens(part)
        yield first, key, at


def block_lists(blocks: DataFrame, depth: int, buckets: int) -> DataFrame:
    """block, kind, bucket, keys (sorted 64-bit numbers) and counts in training texts, for every block of (block, known, text)."""

    def lists(block: pa.Table) -> pa.Table:
        texts, known = block.column("text").combine_chunks(), block.column("known").to_numpy(zero_copy_only=False).astype(bool)
        rows: list[tuple[str, int, bytes, bytes]] = []
        for kind in KINDS:
            keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for first, key, at in _parts(texts, kind, depth):
                k, n = _counted(key, np.repeat(known[first : first + len(at) - 1], np.diff(at)))
                keys.append(k)
                counts.append(n)
            key, n = _counted(np.concatenate(keys), np.concatenate(counts))
            b = _bucket(key, buckets)
            order = np.argsort(b, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(b[order])) + 1) if len(order) else []:
                rows.append((kind, int(b[part[0]]), key[part].astype("<u8").tobytes(), n[part].astype("<i4").tobytes()))
        kinds, bucket, keys_, counts_ = zip(*rows, strict=True)
        block_id = block.column("block")[0].as_py()
        return pa.table({"block": pa.array([block_id] * len(rows), pa.int64()), "kind": pa.array(kinds), "bucket": pa.array(bucket, pa.int32()), "keys": pa.array(keys_, pa.binary()), "counts": pa.array(counts_, pa.binary())})

    return blocks.groupBy("block").applyInArrow(lists, "block long, kind string, bucket int, keys binary, counts binary")


def _keys(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in column.to_pylist()]


def word_counts(lists: DataFrame) -> DataFrame:
    """block, bucket, values: the training count of each word of the list; total and distinct: the bucket's sums, on one of its rows."""

    def total(group: pa.Table) -> pa.Table:
        keys = _keys(group.column("keys"))
        counts = [np.frombuffer(x, "<i4") for x in group.column("counts").to_pylist()]
        key, n = _counted(np.concatenate(keys), np.concatenate(counts))
        values = [n[np.searchsorted(key, k)].astype("<i8").tobytes() for k in keys]
        once = np.zeros(len(keys), np.int64)
        once[0] = 1
        return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "values": pa.array(values, pa.binary()), "total": pa.array(once * n.sum()), "distinct": pa.array(once * (n > 0).sum())})

    return lists.filter("kind = 'word'").groupBy("bucket").applyInArrow(total, "block long, bucket int, values binary, total long, distinct long")


def gram_counts(lists: DataFrame) -> DataFrame:
    """gram and n (0 for those of held-out texts alone) over all blocks."""

    def total(group: pa.Table) -> pa.Table:
        key, n = _counted(np.concatenate(_keys(group.column("keys"))), np.concatenate([np.frombuffer(x, "<i4") for x in group.column("counts").to_pylist()]))
        return pa.table({"gram": pa.array(key.astype(np.int64)), "n": pa.array(n)})

    return lists.filter("kind = 'gram'").groupBy("bucket").applyInArrow(total, "gram long, n long")


def _log_gamma(x: Column) -> Column:
    """Natural logarithm of the gamma function by Stirling's series, eight steps up."""
    up = F.lit(0.0)
    for i in range(8):
        up = up + F.log(x + i)
    y = x + 8
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - up


def _log_kt(zeros: Column, ones: Column) -> Column:
    """Log of the KT probability of a sequence with so many zeros and ones."""
    a, b = zeros.cast("double"), ones.cast("double")
    return F.when(a + b == 0, F.lit(0.0)).otherwise(_log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1) - math.log(math.pi))


def code_lengths(grams: DataFrame, depth: int) -> DataFrame:
    """gram and bits: the code length of its last byte after the bytes before, under the weighted trees of all eight decisions."""
    # decision: 1 and then the bits of the byte so far; a node is a context (its last d bytes) and a decision
    bit = F.explode(F.array(*(F.struct(F.shiftrightunsigned(F.col("byte").bitwiseOR(F.lit(256)), 8 - j).alias("decision"), F.shiftrightunsigned(F.col("byte"), 7 - j).bitwiseAND(F.lit(1)).alias("one")) for j in range(8)))).alias("bit")
    decisions = grams.withColumn("byte", F.col("gram").bitwiseAND(F.lit(255)).cast("int")).select("gram", F.shiftrightunsigned("gram", 8).alias("context"), "n", bit).select("gram", "context", "bit.*", "n")
    level = decisions.groupBy("context", "decision").agg(F.sum(F.when(F.col("one") == 0, F.col("n")).otherwise(0)).alias("zeros"), F.sum(F.when(F.col("one") == 1, F.col("n")).otherwise(0)).alias("ones")).withColumn("children", F.lit(None).cast("double"))
    levels = {}
    for d in range(depth, -1, -1):
        if d < depth:
            shorter = F.col("context").bitwiseAND(F.lit((1 << 8 * d) - 1)).alias("context")
            level = levels[d + 1].groupBy(shorter, "decision").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("children"))
        level = level.withColumn("kt", _log_kt(F.col("zeros"), F.col("ones")))
        # ln(e^x / 2 + e^y / 2) without overflow
        both = F.greatest("kt", "children") + F.log1p(F.exp(-F.abs(F.col("kt") - F.col("children")))) - math.log(2)
        level = level.withColumn("weighted", F.when(F.col("children").isNull(), F.col("kt")).otherwise(both))
        levels[d] = cut_lineage(level.withColumn("stay", F.when(F.col("children").isNull(), F.lit(1.0)).otherwise(F.exp(F.col("kt") - math.log(2) - F.col("weighted")))).select("context", "decision", "zeros", "ones", "weighted", "stay"))
    # from the root down: what the shorter contexts have said so far, and the weight left for the longer ones
    path = None
    for d in range(depth + 1):
        node = levels[d].select("context", "decision", "stay", ((F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)).alias("own"))
        if path is None:
            node = node.withColumn("said", F.lit(0.0)).withColumn("left", F.lit(1.0))
        else:
            node = node.withColumn("shorter", F.col("context").bitwiseAND(F.lit((1 << 8 * (d - 1)) - 1))).join(path, ["shorter", "decision"])
        path = node.select(F.col("context").alias("shorter"), "decision", (F.col("said") + F.col("left") * F.col("stay") * F.col("own")).alias("said"), (F.col("left") * (1 - F.col("stay"))).alias("left"))
    one = path.select(F.col("shorter").alias("context"), "decision", F.col("said").alias("p"))
    priced = decisions.join(one, ["context", "decision"])
    return priced.groupBy("gram").agg((-F.sum(F.log2(F.when(F.col("one") == 1, F.col("p")).otherwise(1 - F.col("p"))))).alias("bits"))


def list_prices(lists: DataFrame, prices: DataFrame, buckets: int) -> DataFrame:
    """block, bucket, values: the code length of each gram of the list."""

    def bucket_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column("gram").to_numpy().astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_bucket(key, buckets).astype(np.int32)), *b.columns], ["bucket", *b.schema.names])

    def match(wanted: pa.Table, known: pa.Table) -> pa.Table:
        key, bits = known.column("gram").to_numpy().astype(np.uint64), known.column("bits").to_numpy()
        order = np.argsort(key)
        key, bits = key[order], bits[order]
        values = [bits[np.searchsorted(key, k)].astype("<f8").tobytes() for k in _keys(wanted.column("keys"))]
        return pa.table({"block": wanted.column("block"), "bucket": wanted.column("bucket"), "values": pa.array(values, pa.binary())})

    priced = prices.mapInArrow(bucket_of, "bucket int, gram long, bits double")
    return lists.filter("kind = 'gram'").select("block", "bucket", "keys").groupBy("bucket").cogroup(priced.groupBy("bucket")).applyInArrow(match, "block long, bucket int, values binary")


def score(docs: DataFrame, known: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, known, n_bytes, code_bits, n_tokens, n_known, base (sum of log10 probabilities of the words), train_tokens.

    known: which rows are learned from. depth: 7 at most.
    """
    rows = docs.select(F.col(id_col).alias("id"), known.alias("known"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)))
    buckets = max(1, -(-n_blocks // 4))
    lists = cut_lineage(block_lists(rows.select("block", "known", "text"), depth, buckets))
    counts = cut_lineage(word_counts(lists))
    prices = code_lengths(cut_lineage(gram_counts(lists)), depth)
    priced = list_prices(lists, prices, buckets)
    sums = counts.agg(F.sum("total"), F.sum("distinct")).first()
    n_tokens, n_distinct = (sums[0] or 0), (sums[1] or 0)
    values = counts.drop("total", "distinct").withColumn("kind", F.lit("word")).unionByName(priced.withColumn("kind", F.lit("gram")))

    def block_scores(texts: pa.Table, found: pa.Table) -> pa.Table:
        column = texts.column("text").combine_chunks()
        lookup = {}
        for kind, dtype in (("gram", "<f8"), ("word", "<i8")):
            parts = {b: np.frombuffer(v, dtype) for k, b, v in zip(found.column("kind").to_pylist(), found.column("bucket").to_pylist(), found.column("values").to_pylist(), strict=True) if k == kind}
            # the block's own list once more, in the order in which it was sent out
            keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(pd.unique(key) for _, key, _ in _parts(column, kind, depth))]))
            b = _bucket(keys, buckets)
            value = np.zeros(len(keys), np.float64)
            for x, v in parts.items():
                value[b == x] = v
            lookup[kind] = keys, value
        bits, base, n_known = (np.zeros(len(column)) for _ in range(3))
        n_bytes, tokens = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
        for first, key, at in _parts(column, "gram", depth):
            keys, value = lookup["gram"]
            sums = np.concatenate([[0.0], np.cumsum(_looked_up(key, keys, value))])
            bits[first : first + len(at) - 1], n_bytes[first : first + len(at) - 1] = sums[at[1:]] - sums[at[:-1]], np.diff(at)
        for first, key, at in _parts(column, "word", depth):
            keys, value = lookup["word"]
            c = _looked_up(key, keys, value)
            here = slice(first, first + len(at) - 1)
            tokens[here] = np.diff(at)
            base[here] = np.add.reduceat(np.log10((c + 1) / (n_tokens + n_distinct + 1)), at[:-1])
            n_known[here] = np.add.reduceat((c > 0).astype(np.int64), at[:-1])
        return pa.table(
            {"id": texts.column("id"), "known": texts.column("known"), "n_bytes": pa.array(n_bytes), "code_bits": pa.array(bits), "n_tokens": pa.array(tokens), "n_known": pa.array(n_known.astype(np.int64)), "base": pa.array(base)}
        )

    kind = dict(docs.dtypes)[id_col]
    out = rows.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(block_scores, f"id {kind}, known boolean, n_bytes long, code_bits double, n_tokens long, n_known long, base double")
    return out.withColumn("train_tokens", F.lit(n_tokens).cast("long"))


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    found = score(read_table(spark, sf_dir, "documents"), ~held)
    return found.select(
        F.col("id").alias("doc_id"), (~F.col("known")).alias("held_out"), "n_tokens", "n_known", "train_tokens", F.col("base").alias("base_score"),
        (-F.col("code_bits") * math.log10(2)).alias("score"), (F.col("code_bits") / F.col("n_bytes")).alias("bits_per_byte"),
    )
