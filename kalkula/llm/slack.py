"""Packing by minimum bin slack.

Documents become token ids; longer ones give whole windows and a rest. From the largest open length down, each window is
filled by the multiset of the remaining lengths whose sum comes closest to its gap: subset sums as a set of bits, length by
length with as many copies as are left, and the counts found by going back through the sets. The plan is made on the
histogram of lengths (one count for each length up to the capacity, however many documents there are); a pattern is used
as often as its counts allow. Windows that can't be filled exactly are opened again: their pieces are laid end to end
and cut at multiples of the capacity, the last of them into powers of two, so that no sequence needs padding.

Pieces are numbered within their length as they are written down and take their places by number. Only documents whose
pieces are cut again are tokenized twice. Null text counts as empty and gives the single end token; an empty table gives an
empty result; repeated rows are packed as often as they occur; null ids are carried along; long texts are tokenized one by
one; pieces of equal length take their places in no particular order. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kalkula.llm.common import content_key, cut_lineage, read_table, slices
from kalkula.llm.packing import END_ID, TEXT_BYTES, TOKENIZER, token_ids

CAPACITY = 2048


def closest_fill(gap: int, count: list[int], here: int) -> Counter:
    """How often to take each length so that the sum is as close to gap as the counts allow, and not above it.

    here: the lengths that can be taken, as a set of bits. Larger lengths are taken before smaller ones.
    """
    reach, whole, layers = 1, (2 << gap) - 1, []
    open_ = here & whole & ~1
    while open_ and not reach >> gap & 1:
        x = open_.bit_length() - 1
        open_ ^= 1 << x
        layers.append((x, reach))
        copies, step = min(count[x], gap // x), 1
        while copies > 0:
            some = min(step, copies)
            reach |= reach << some * x & whole
            copies, step = copies - some, 2 * step
    total, taken = reach.bit_length() - 1, Counter()
    for x, before in reversed(layers):
        while not before >> total & 1:
            total -= x
            taken[x] += 1
    return taken


def plan_windows(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], Counter]:
    """Patterns of lengths that fill a window exactly, with how many windows follow each, and how many pieces of which length
    are in windows with slack."""
    count = [0] * (capacity + 1)
    for length, n in histogram.items():
        count[length] += n
    here = sum(1 << x for x in histogram)
    plan, rest = [], Counter()
    for largest in range(capacity, 0, -1):
        while count[largest]:
            count[largest] -= 1
            if not count[largest]:
                here &= ~(1 << largest)
            need = closest_fill(capacity - largest, count, here)
            count[largest] += 1
            need[largest] += 1
            n = min(count[x] // k for x, k in need.items())
            for x, k in need.items():
                count[x] -= k * n
                here = here | 1 << x if count[x] else here & ~(1 << x)
            if sum(x * k for x, k in need.items()) == capacity:
                plan.append((tuple(sorted(need.elements(), reverse=True)), n))
            else:
                rest.update({x: k * n for x, k in need.items()})
    return plan, rest


def window_pieces(docs: DataFrame, tokenizer: str | None, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """id, key (of the text), doc_tokens, start, length, ids_crc32, and the piece's number among those of its length in its part."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        path = tokenizer or public_tokenizers.path(TOKENIZER)
        part, numbers = TaskContext.get().partitionId(), Counter()
        for batch in slices(batches, limit=TEXT_BYTES):
            rows: list[tuple[int, ...]] = []
            for i, ids in enumerate(token_ids(batch.column("text"), path)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for at in range(0, len(ids), capacity):
                    some = ids[at : at + capacity]
                    rows.append((i, len(ids), at, len(some), zlib.crc32(some.tobytes()), part, numbers[len(some)]))
                    numbers[len(some)] += 1
            row, *values = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), batch.column("key").take(pa.array(row)), *(pa.array(v, pa.int64()) for v in values)], ["id", "key", "doc_tokens", "start", "length", "ids_crc32", "part", "in_part"])

    kind = dict(docs.dtypes)[id_col]
    given = docs.select(F.col(id_col).alias("id"), content_key(text_col).alias("key"), F.col(text_col).alias("text"))
    return given.mapInArrow(pieces, f"id {kind}, key binary, doc_tokens long, start long, length long, ids_crc32 long, part long, in_part long")


class Places:
    """Where the pieces of each length go, by their number: runs of (first number, sequence or -1, offset or place in the rest)."""

    def __init__(self, histogram: dict[int, int], capacity: int) -> None:
        plan, rest = plan_windows(histogram, capacity)
        runs: dict[int, list[tuple[int, int, int]]] = {x: [] for x in histogram}
        used: Counter = Counter()
        sequence = 0
        for pattern, n in plan:
            offset = 0
            for x in pattern:
                runs[x].append((used[x], sequence, offset))
                used[x] += n
                offset += x
            sequence += n
        total = 0
        for x, n in sorted(rest.items()):
            runs[x].append((used[x], -1, total))
            total += x * n
        self.runs = {x: np.array(r, np.int64) for x, r in runs.items()}
        self.capacity, self.first_rest, self.whole = capacity, sequence, total // capacity
        tail = total % capacity
        sizes = [1 << b for b in range(tail.bit_length() - 1, -1, -1) if tail >> b & 1]
        self.tail = self.whole * capacity + np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each piece, or part of a piece that is cut: its row, its first token in the piece, its length, sequence and offset."""
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
            own = self.runs[int(length[some[0]])]
            run = own[np.searchsorted(own[:, 0], number[some], "right") - 1]
            past, in_rest = number[some] - run[:, 0], run[:, 1] < 0
            sequence[some] = np.where(in_rest, -1, run[:, 1] + past)
            offset[some] = run[:, 2] + np.where(in_rest, past * length[some], 0)
        row, begin, size = np.arange(len(length)), np.zeros(len(length), np.int64), length.copy()
        for bound in (None, *self.tail):  # None: the end of the window where a piece starts
            at = (offset // self.capacity + 1) * self.capacity if bound is None else np.full(len(row), bound)
            over = np.flatnonzero((sequence < 0) & (offset < at) & (at < offset + size))
            left = (at - offset)[over]
            row, sequence = np.append(row, row[over]), np.append(sequence, sequence[over])
            begin, offset, size = np.append(begin, begin[over] + left), np.append(offset, at[over]), np.append(size, size[over] - left)
            size[over] = left
        rest = np.flatnonzero(sequence < 0)
        in_tail = np.searchsorted(self.tail, offset[rest], "right") - 1  # -1: before it
        sequence[rest] = self.first_rest + np.where(in_tail < 0, offset[rest] // self.capacity, self.whole + in_tail)
        offset[rest] = np.where(in_tail < 0, offset[rest] % self.capacity, offset[rest] - self.tail[in_tail])
        return row, begin, size, sequence, offset


def cut_checksums(docs: DataFrame, cut: DataFrame, tokenizer: str | None, text_col: str, end_id: int) -> DataFrame:
    """key, start, length, ids_crc32 of the parts in cut, from the texts that these are cut out of, each once."""

    def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        path = tokenizer or public_tokenizers.path(TOKENIZER)
        for batch in slices(batches, limit=TEXT_BYTES):
            rows = []
            for i, (ids, parts) in enumerate(zip(token_ids(batch.column("text"), path), batch.column("parts"), strict=True)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                rows += [(i, p["start"], p["length"], zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())) for p in parts.as_py()]
            row, *values = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row)), *(pa.array(v, pa.int64()) for v in values)], ["key", "start", "length", "ids_crc32"])

    wanted = cut.groupBy("key").agg(F.collect_set(F.struct("start", "length")).alias("parts"))
    texts = docs.select(content_key(text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(cut.select("key"), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    return texts.join(wanted, "key").mapInArrow(checksums, "key binary, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer: path of the vocabulary, on every executor. capacity must be a power of two.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    pieces = cut_lineage(window_pieces(docs, tokenizer, id_col, text_col, capacity, end_id))
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    places = spark.sparkContext.broadcast(Places(histogram, capacity))
    names = ["id", "key", "doc_tokens", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, length, number = (batch.column(c).to_numpy().astype(np.int64) for c in ("start", "length", "number"))
            row, begin, size, sequence, offset = places.value.of(length, number)
            taken = batch.select(["id", "key", "doc_tokens", "ids_crc32"]).take(pa.array(row))
            crc = pa.array(taken.column("ids_crc32").to_numpy(), mask=size != length[row])
            yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in names[:3]), pa.array(start[row] + begin), pa.array(size), crc, pa.array(sequence), pa.array(offset)], names)

    numbered = pieces.join(first, ["length", "part"]).select(*names[:6], (F.col("first") + F.col("in_part")).alias("number"))
    placed = cut_lineage(numbered.mapInArrow(place, f"id {kind}, key binary, doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, offset long"))
    cut = placed.where("ids_crc32 IS NULL").drop("ids_crc32")
    done = cut.join(cut_checksums(docs, cut, tokenizer, text_col, end_id), ["key", "start", "length"])
    out = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return placed.where("ids_crc32 IS NOT NULL").select(*out).unionByName(done.select(*out))


def op13_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
