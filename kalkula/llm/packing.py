"""Best-fit packing by exact-complement hashing.

Documents become token ids, longer ones are cut into whole-sequence pieces, and the pieces are packed into as few
sequences as possible. The plan is made on the histogram of piece lengths (at most one count per length up to the
capacity, however many documents there are): the largest open length looks up, under the counts still available, the
single length, the pair and the triple that fill its gap exactly; what has no exact filling is packed best-fit. The
plan is a short list of patterns with multiplicities. Pieces are then numbered within their length by a distributed
rank and take their places by number, so that no task ever holds more than its own pieces.

Null text counts as empty and gives the single end token; an empty table gives an empty result; repeated rows are packed
as often as they occur; null ids are carried along. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kalkula.llm.common import cut_lineage, lower_ascii, read_table, runs, slices, strings_at, text_bytes

CAPACITY, END_ID, TOKENIZER = 4096, 1, "word_bpe_49k.json"
#: Words whose ids a Python worker remembers; when there are more, the half looked up least often makes room.
REMEMBERED = 300_000
#: Units that the tokenizer surely takes as one: Latin letters up to U+00FF, one digit, or printable ASCII without apostrophe.
_SINGLE = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]|[!-&(-/:-@\[-`{-~]+")
#: Such units that are coded in one call, and bytes of text whose distinct units are looked up together.
CALL_UNITS, TEXT_BYTES = 4000, 1 << 20

# 0 white space, 1 letters and all bytes beyond ASCII, 2 digits, 3 other ASCII
_KIND = np.full(256, 3, np.uint8)
_KIND[128:] = 1
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[[32, 9, 10, 11, 12, 13]] = 0

_workers: dict[str, "_Ids"] = {}


class _Ids:
    """Token ids of units, remembered in a Python worker; ids of all units lie end to end in one array."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # tokens that end a unit
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.units = pa.array([], pa.large_binary())
        self.ids, self.starts, self.hits = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def forget(self) -> None:
        """Only the half of REMEMBERED with most lookups stays; their numbers of lookups are halved."""
        kept = np.sort(np.argsort(-self.hits, kind="stable")[: REMEMBERED // 2])
        length = np.diff(self.starts)
        stays = np.zeros(len(length), dtype=bool)
        stays[kept] = True
        self.ids = self.ids[np.repeat(stays, length)]
        self.starts = np.concatenate([[0], np.cumsum(length[kept])])
        self.units, self.hits = self.units.take(pa.array(kept)), self.hits[kept] // 2

    def add(self, new: pa.Array) -> np.ndarray:
        """The places that the new units get."""
        given = new.to_pylist()
        is_single = np.array([_SINGLE.fullmatch(unit) is not None for unit in given])
        order = np.concatenate([np.flatnonzero(is_single), np.flatnonzero(~is_single)])
        single, other = [given[i] for i in order[: is_single.sum()]], [given[i] for i in order[is_single.sum() :]]
        places = np.empty(len(given), np.int64)
        places[order] = np.arange(len(given)) + len(self.units)
        ids, lengths = [self.ids], []
        for at in range(0, len(single), CALL_UNITS):
            flat = np.array(self.tokenizer.encode_batch_fast([b" ".join(single[at : at + CALL_UNITS]).decode()], add_special_tokens=False)[0].ids, np.uint32)
            ids.append(flat)
            lengths.append(np.diff(np.flatnonzero(self.ends[flat]), prepend=-1))
        for at in range(0, len(other), CALL_UNITS):
            coded = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in other[at : at + CALL_UNITS]], add_special_tokens=False)]
            ids.append(np.array([x for c in coded for x in c], np.uint32))
            lengths.append(np.array([len(c) for c in coded], np.int64))
        self.units = pa.concat_arrays([self.units, new.take(pa.array(order))])
        self.ids = np.concatenate(ids)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate(lengths))])
        self.hits = np.concatenate([self.hits, np.zeros(len(new), np.int64)])
        return places

    def of(self, distinct: pa.Array) -> np.ndarray:
        """Places of the units; self.starts has where the ids of each lie."""
        if len(self.units) + len(distinct) > REMEMBERED:
            self.forget()
        found = pc.index_in(distinct, value_set=self.units)
        places = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if found.null_count:
            places[places < 0] = self.add(distinct.filter(pc.is_null(found)))
        self.hits[places] += 1
        return places


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges that the tokenizer handles apart from each other, and the text as looked up.

    Words of ASCII white space always are. Within them, letters, digits and other ASCII part where both neighbours are
    ASCII, except around an apostrophe, which starts contractions; digits are single. A slice that holds the start of a
    special token keeps whole words and upper case.
    """
    kind = _KIND[data]
    starts, ends = runs(kind != 0, offsets)
    if not len(data) or not len(starts) or bool(((data[:-1] == 60) & (data[1:] == 124)).any()):
        return data, starts, ends
    ascii_ = data < 128
    cut = np.zeros(len(data), dtype=bool)
    cut[1:] = ((kind[1:] != kind[:-1]) | (kind[1:] == 2)) & (kind[1:] != 0) & (kind[:-1] != 0) & ascii_[1:] & ascii_[:-1]
    quotes = np.flatnonzero(data == 39)
    if len(quotes):
        word = np.searchsorted(starts, quotes, "right") - 1
        for a, b in zip(starts[np.unique(word)], ends[np.unique(word)], strict=True):
            cut[a:b] = False
    more = np.flatnonzero(cut)
    return lower_ascii(data), np.sort(np.concatenate([starts, more])), np.sort(np.concatenate([ends, more]))


def token_ids(texts: pa.Array, path: str) -> Iterator[np.ndarray]:
    """The ids of each text, without special tokens added."""
    known = _workers.get(path) or _workers.setdefault(path, _Ids(path))
    data, offsets = text_bytes(texts)
    data, starts, ends = _units(data, offsets)
    coded = strings_at(data, starts, ends).dictionary_encode()
    place = known.of(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)] if len(starts) else np.zeros(0, np.int64)
    begin = known.starts[place]
    length = known.starts[place + 1] - begin
    flat_at = np.zeros(len(place) + 1, np.int64)
    np.cumsum(length, out=flat_at[1:])
    flat = known.ids[np.arange(flat_at[-1]) + np.repeat(begin - flat_at[:-1], length)] if len(place) else np.zeros(0, np.uint32)
    edges = flat_at[np.searchsorted(starts, offsets)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield flat[a:b]


def token_pieces(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32. tokenizer: path of the vocabulary, on every executor."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        path = tokenizer or public_tokenizers.path(TOKENIZER)
        for batch in slices(batches, limit=TEXT_BYTES):
            rows: list[tuple[int, int, int, int, int]] = []
            for i, ids in enumerate(token_ids(batch.column("text"), path)):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                rows += [(i, n, at, len(part := ids[at : at + capacity]), zlib.crc32(part.tobytes())) for n, at in enumerate(range(0, len(ids), capacity))]
            row, piece, start, length, crc = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"]
            )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(pieces, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with how many sequences follow each; every counted piece is in exactly one.

    From the largest length down: equal-sum lookups of one, two and three available lengths fill the gap exactly, for
    as many sequences as the counts allow. Sequences without an exact filling take the largest length that still fits,
    again and again.
    """
    count = [0] * (capacity + 1)
    for length, n in histogram.items():
        count[length] += n
    # The lengths at hand as a set of bits, and the same from the other end: all pairs of one sum are then an AND.
    here = sum(1 << x for x in histogram)
    mirrored = sum(1 << (capacity - x) for x in histogram)
    plan: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...], n: int) -> None:
        nonlocal here, mirrored
        for x in lengths:
            count[x] -= n
            bit, other = 1 << x, 1 << (capacity - x)
            here, mirrored = (here | bit, mirrored | other) if count[x] > 0 else (here & ~bit, mirrored & ~other)

    def pair(total: int, besides: int = 0) -> tuple[int, int] | None:
        """The pair of available lengths of this sum whose larger part is largest; one length besides is spoken for."""
        if total < 2:
            return None
        low = here & (mirrored >> (capacity - total)) & ((2 << (total // 2)) - 1)
        if not low:
            return None
        if besides and count[besides] == 1 and besides < total:
            low &= ~(1 << min(besides, total - besides))
        if total % 2 == 0 and count[total // 2] - (besides == total // 2) < 2:
            low &= ~(1 << (total // 2))
        if not low:
            return None
        x = (low & -low).bit_length() - 1
        return total - x, x

    def exact(gap: int) -> tuple[int, ...] | None:
        if count[gap] > 0:
            return (gap,)
        if two := pair(gap):
            return two
        firsts = here & ((1 << max(0, gap - 1)) - 1)
        while firsts:
            first = firsts.bit_length() - 1
            firsts &= ~(1 << first)
            if two := pair(gap - first, first):
                return (first, *two)
        return None

    def settle(pattern: tuple[int, ...]) -> None:
        """As many sequences of the pattern (its lengths are taken once) as the counts allow."""
        take(pattern, -1)
        need = Counter(pattern)
        n = min(count[x] // k for x, k in need.items())
        take(pattern, n)
        plan.append((pattern, n))

    for length in range(capacity, 0, -1):
        while count[length] > 0:
            pattern, gap = (length,), capacity - length
            take(pattern, 1)
            while gap:
                filled = exact(gap) if len(pattern) < 64 else None
                if not filled:  # best fit: as each step takes the largest length that fits, the gap left is the least
                    fits = here & ((1 << (gap + 1)) - 1)
                    if not fits:
                        break
                    filled = (fits.bit_length() - 1,)
                take(filled, 1)
                pattern, gap = (*pattern, *filled), gap - sum(filled)
            settle(pattern)
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY, rank_rows: int = 100_000) -> DataFrame:
    """Give every piece (id, piece, start, length, ...) its sequence_id and its offset there.

    rank_rows: pieces are numbered in buckets of about this many rows; the buckets' counts give each its first number.
    """
    spark = pieces.sparkSession
    columns = pieces.columns
    pieces = cut_lineage(pieces)
    buckets = max(16, -(-pieces.count() // rank_rows))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int"))
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row per length
    first = counts.select("length", "bucket", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    # For each length the runs of ranks that one slot of one pattern takes: bounded by the patterns, not by the pieces.
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = dict.fromkeys(histogram, 0)
    sequence = 0
    for pattern, n in plan_packing(histogram, capacity):
        offset = 0
        for x in pattern:
            slots.setdefault(x, []).append((used[x], sequence, offset))
            used[x] += n
            offset += x
        sequence += n
    tables = spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in slots.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "number"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                own = tables.value[int(length[part[0]])]
                at = np.searchsorted(own[:, 0], number[part], "right") - 1
                sequence[part], offset[part] = own[at, 1] + number[part] - own[at, 0], own[at, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    ranked = pieces.withColumn("rank", F.row_number().over(W.partitionBy("length", "bucket").orderBy(*columns)))
    numbered = ranked.join(first, ["length", "bucket"]).select(*columns, (F.col("rank") - 1 + F.col("first")).alias("number"))
    return numbered.mapInArrow(place, ", ".join([*(f"`{c}` {t}" for c, t in pieces.dtypes if c in columns), "sequence_id long", "offset long"]))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pack(token_pieces(docs)).withColumnRenamed("id", "doc_id").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
