"""Helpers that the text operators share: tables, lineage cuts and byte-level views of Arrow text."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space; every operator here splits words on runs of it.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Rows of text are handled in slices of about this many bytes, so that a task's memory doesn't follow the batch.
SLICE_BYTES = 1 << 19
#: Rows of text in an Arrow batch, unless the session says otherwise: executors hold a few batches at once, on both sides.
BATCH_ROWS = 1000

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True


def small_batches(spark: SparkSession) -> None:
    """Texts are long, so batches get fewer rows than Spark's default; a session's own setting is left alone."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or with a local master one of our own where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="kalkula-checkpoints-")
        spark.sparkContext.setCheckpointDir(at)
    return at


#: The lists that get the paths of tables written now, by thread: what another thread writes meanwhile isn't ours.
_recording: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("recording", default=())


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """Gives a list that gets the paths of all tables that cut_lineage writes meanwhile in this thread."""
    paths: list[str] = []
    before = _recording.set((*_recording.get(), paths))
    try:
        yield paths
    finally:
        _recording.reset(before)


def delete_tables(spark: SparkSession, paths: list[str], but: DataFrame | None = None) -> list[str]:
    """Deletes tables that cut_lineage wrote, apart from those that `but` reads; these are given back."""
    reads = but.inputFiles() if but is not None and paths else []
    read = [path for path in paths if any(path.rpartition("/")[2] in f for f in reads)]
    for path in set(paths) - set(read):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return read


#: Under this key a column's metadata have the tables that a result was made from. Parquet keeps them.
MADE_FROM = "kalkula.made_from"


def made_from(df: DataFrame, paths: list[str]) -> DataFrame:
    """df with a note of the tables that it reads and that nobody else needs, in place of any note before."""
    first, *rest = df.schema.fields
    known = {k: v for k, v in first.metadata.items() if k != MADE_FROM}
    return df.select(F.col(f"`{first.name}`").alias(first.name, metadata=known | {MADE_FROM: paths}), *(f"`{f.name}`" for f in rest))


def noted_tables(df: DataFrame) -> list[str]:
    return list(df.schema.fields[0].metadata.get(MADE_FROM, []))


def row_hash(df: DataFrame):
    """A number that rows share that are equal in all columns, nulls included."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    return F.xxhash64(*columns, *(c.isNull() for c in columns))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: a lost executor then costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/kalkula-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _recording.get():
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or the name with as many underscores as make it one that df has no column of, in either case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def content_key(text: str = "text"):
    """256-bit address of a text; null counts as empty. Equal texts share it, whatever their ids."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in batches of about limit bytes of text and at least one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(size) - size) // limit
        edges = np.flatnonzero(np.diff(group, prepend=-1))
        for start, stop in zip(edges, [*edges[1:], batch.num_rows], strict=True):
            yield batch.slice(int(start), int(stop - start))
        del batch
        pa.default_memory_pool().release_unused()


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the n+1 offsets between them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes as they are."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes, none of them across two texts."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(mask) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty_like(mask)
    before[0], before[1:] = True, ~mask[:-1]
    after = np.empty_like(mask)
    after[-1], after[:-1] = True, ~mask[1:]
    return np.flatnonzero(mask & (before | edge[:-1])), np.flatnonzero(mask & (after | edge[1:])) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n+1 positions in these that part the texts."""
    starts, ends = runs(~_IS_SPACE[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def strings_at(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges (in order, none empty, none over another) as one large_binary array."""
    length = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(length, out=offsets[1:])
    step = np.zeros(len(data) + 1, np.int8)
    step[starts] += 1
    step[ends] -= 1
    kept = data[np.cumsum(step[:-1], dtype=np.int8).astype(bool)]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept))])


_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Bytes that are hashed at once, and the longest range among them; longer ones are hashed one by one.
_AT_ONCE, _LONGEST = 1 << 18, 1 << 12


def _powers(base: int) -> np.ndarray:
    steps = np.full(_AT_ONCE + _LONGEST + 1, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, given in order, equal for equal bytes. Memory follows the number of ranges, not of bytes.

    They are differences of one running sum of each byte's number by a power, moved to the same power, and mixed.
    """
    out = np.zeros(len(starts), np.uint64)
    edges = np.flatnonzero(np.diff(starts // _AT_ONCE, prepend=-1)) if len(starts) else []
    for a, b in zip(edges, [*edges[1:], len(starts)], strict=True):
        first = int(starts[a])
        begin, length = starts[a:b] - first, ends[a:b] - starts[a:b]
        short = np.flatnonzero(length <= _LONGEST)
        if len(short):
            part = data[first : first + int((begin + length)[short].max())]
            running = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTE[part] * _UP[: len(part)], out=running[1:])
            out[a + short] = (running[(begin + length)[short]] - running[begin[short]]) * _DOWN[begin[short]]
        for i in np.flatnonzero(length > _LONGEST).tolist():
            out[a + i] = xxhash.xxh64_intdigest(data[int(starts[a + i]) : int(ends[a + i])].tobytes())
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def bit_table(numbers: DataFrame, bits: int) -> np.ndarray:
    """A table of so many bits (a power of two), in words of 32: those at the numbers (one column, long) modulo bits are set.

    bits / 32 rows at most come to the driver, whatever the size of numbers.
    """
    slot = F.col(numbers.columns[0]).bitwiseAND(F.lit(bits - 1))
    words = numbers.select(slot.alias("slot")).groupBy(F.shiftrightunsigned("slot", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 32 as int))")).alias("mask")).toArrow()
    table = np.zeros(bits // 32, np.uint32)
    table[words.column("word").to_numpy()] = words.column("mask").to_numpy().astype(np.uint32)
    return table


def in_table(table: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Which of the numbers (unsigned) have their bit set in the table."""
    slot = numbers & np.uint64(32 * len(table) - 1)
    return (table[(slot >> np.uint64(5)).astype(np.int64)] >> (slot & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (unsigned) with the sum of their counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    distinct, code = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct.astype(np.uint64), np.bincount(code, np.concatenate(counts), minlength=len(distinct)).astype(np.int64)


#: What count_lists gives.
LISTS = "bucket int, keys binary, counts binary"


def count_lists(key: np.ndarray, n: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Keys (unsigned) and their counts as a row for each bucket that they fall in."""
    bucket = (key >> np.uint64(32)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []
    return pa.RecordBatch.from_arrays([pa.array([int(bucket[p[0]]) for p in parts], pa.int32()), pa.array([key[p].tobytes() for p in parts], pa.binary()), pa.array([n[p].tobytes() for p in parts], pa.binary())], ["bucket", "keys", "counts"])


def added_up(lists: DataFrame) -> DataFrame:
    """key (long) and n: the counts of all lists. A bucket has each key once for each task, however often it occurs."""

    def total(group: pa.Table) -> pa.Table:
        key, n = summed([np.frombuffer(x, np.uint64) for x in group.column("keys").to_pylist()], [np.frombuffer(x, np.int64) for x in group.column("counts").to_pylist()])
        return pa.table({"key": pa.array(key.view(np.int64)), "n": pa.array(n)})

    return lists.groupBy("bucket").applyInArrow(total, "key long, n long")


#: Bits of the filter that lets rows pass a join by.
FILTER_BITS = 1 << 23


def bit_filter(values: DataFrame, bits: int = FILTER_BITS):
    """A column function: false only for values that aren't in values (one column); true for these and for few others."""
    shared = values.sparkSession.sparkContext.broadcast(bit_table(values.select(F.xxhash64(values.columns[0])), bits))

    @F.arrow_udf(T.BooleanType())
    def has(hashes: pa.Array) -> pa.Array:
        return pa.array(in_table(shared.value, hashes.to_numpy(zero_copy_only=False).view(np.uint64)))

    return lambda value: has(F.xxhash64(value))


@F.arrow_udf(T.LongType())
def word_count(text: pa.Array) -> pa.Array:
    """Number of words of each text; null has none."""
    out, batch = [], pa.RecordBatch.from_arrays([text], ["text"])
    for part in slices(iter([batch])):
        _, _, at = words(*text_bytes(part.column(0)))
        out.append(np.diff(at))
    return pa.array(np.concatenate(out) if out else np.zeros(0, np.int64), pa.int64())
