"""Language identification by language-bitmask n-gram filters.

Learning counts, per language, the documents that hold each n-gram; n-grams in min_share of a language's documents or
more belong to it. All languages share one bit-sliced Bloom filter: a slot is a bitmask with a bit per language, and
the AND of an n-gram's slots gives all languages that contain it at once. A text's bits are counted per language,
the hits expected from false positives (the share of a language's bits that are set, to the power of the hashes) are
taken off, and the language with most hits is predicted; of equals, the first by code point.

The n-grams of a language number at most (mean distinct n-grams of a document) / min_share, whatever the corpus, and
the filter has max_slots slots at most, so it can be sent to every task; nothing else of the corpus is.

A null text, or one without a letter, is 'und' with score 0, as is everything if nothing was learned. A text with
letters but no known n-gram gets the language with most training documents. Repeated rows get the same prediction;
null ids count as neither held out nor learned from; extra columns of any name are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kalkula.llm.common import cut_lineage, free_name, lower_ascii, read_table, slices, text_bytes

N, HASHES, MIN_SHARE, MAX_SLOTS = 4, 3, 0.003, 1 << 22
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_CLASS = np.full(256, 32, np.uint8)  # all but letters is a space
_CLASS[128:] = np.arange(128, 256)
_CLASS[97:123] = np.arange(97, 123)


def byte_grams(texts: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of letters' bytes with at most one space, and the text that each is in."""
    data, offsets = text_bytes(texts)
    # a space before and after each text, so that words at its ends look like others and no n-gram spans two texts
    at = offsets + 2 * np.arange(len(offsets))
    out = np.full(len(data) + 2 * (len(offsets) - 1), 32, np.uint8)
    keep = np.ones(len(out), dtype=bool)
    keep[at[:-1]] = keep[at[1:] - 1] = False
    out[keep] = _CLASS[lower_ascii(data)]
    if len(out) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = len(out) - n + 1
    code, spaces = np.zeros(size, np.uint64), np.zeros(size, np.int8)
    for i in range(n):
        part = out[i : size + i]
        code = (code << np.uint64(8)) | part
        spaces += part == 32
    good = np.flatnonzero(spaces <= 1)
    return code[good], np.searchsorted(at, good, "right") - 1


def slots_of(code: np.ndarray, slots: int, hashes: int) -> list[np.ndarray]:
    shift = np.uint64(64 - slots.bit_length() + 1)
    return [((code + np.uint64(1)) * _FACTORS[j]) >> shift for j in range(hashes)]


@dataclass
class LanguageModel:
    languages: list[str]
    default: str
    #: One row of slots for each 64 languages.
    filter: np.ndarray
    hashes: int = HASHES
    n: int = N

    def hits(self, texts: pa.Array) -> np.ndarray:
        """Per text and language, the n-grams that the language contains, without those expected by chance."""
        code, text = byte_grams(texts, self.n)
        total = np.bincount(text, minlength=len(texts))
        where = slots_of(code, self.filter.shape[1], self.hashes)
        out = np.zeros((len(texts), len(self.languages)))
        for w, row in enumerate(self.filter):
            mask = row[where[0]]
            for at in where[1:]:
                mask = mask & row[at]
            for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                bit = np.uint64(1) << np.uint64(i - 64 * w)
                chance = float(np.count_nonzero(row & bit) / len(row)) ** self.hashes
                seen = np.bincount(text, (mask & bit) != 0, minlength=len(texts))
                out[:, i] = np.maximum(0, (seen - total * chance) / max(1e-9, 1 - chance))
        return out


def held_out(id_col: str, parts: int, remainder: int = 0) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == remainder, F.lit(False))


def gram_counts(docs: DataFrame, n: int = N) -> DataFrame:
    """lang, gram, n: documents of the language with the n-gram, summed within each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)
            of = pa.array(list(names))
            return pa.RecordBatch.from_arrays([of.take(pa.array((key >> np.uint64(40)).astype(np.int64))), pa.array((key & np.uint64((1 << 40) - 1)).astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        for batch in slices(batches):
            lang = np.array([names.setdefault(x, len(names)) for x in batch.column("lang").to_pylist()], np.uint64)
            code, text = byte_grams(batch.column("text"), n)
            if not len(code):
                continue
            pairs = np.unique((text.astype(np.uint64) << np.uint64(40)) | code)
            key, seen = np.unique((lang[(pairs >> np.uint64(40)).astype(np.int64)] << np.uint64(40)) | (pairs & np.uint64((1 << 40) - 1)), return_counts=True)
            keys.append(key)
            counts.append(seen)
            if sum(map(len, keys)) > 1_000_000:
                yield flush()
                keys, counts = [], []
        if keys:
            yield flush()

    return docs.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, min_share: float = MIN_SHARE, max_slots: int = MAX_SLOTS, hashes: int = HASHES, n: int = N) -> LanguageModel:
    """Learn from the columns text and lang of docs (rows that lack one teach nothing). n: 5 at most."""
    docs = docs.filter("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text")
    sizes = docs.groupBy("lang").agg(F.count("*").alias("docs"))
    known = sorted(((r["lang"], r["docs"]) for r in sizes.collect()), key=lambda x: x[0].encode())  # a row per language
    if not known:
        return LanguageModel([], "und", np.zeros((1, 64), np.uint64), hashes, n)
    spark = docs.sparkSession
    least = spark.createDataFrame([(x, i, max(1.0, min_share * d)) for i, (x, d) in enumerate(known)], "lang string, place int, least double")
    owned = cut_lineage(gram_counts(docs, n).join(F.broadcast(least), "lang").filter("n >= least").select("place", "gram"))
    slots = 64
    while slots < min(max_slots, 16 * owned.count()):
        slots *= 2

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, code = b.column("place").to_numpy(), b.column("gram").to_numpy().astype(np.uint64)
            at = np.concatenate(slots_of(code, slots, hashes)).astype(np.int64)
            bits = np.tile(np.left_shift(np.int64(1), (place % 64).astype(np.int64)), hashes)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(place // 64, hashes).astype(np.int32)), pa.array(at), pa.array(bits)], ["word", "slot", "bits"])

    masks = owned.mapInArrow(spread, "word int, slot long, bits long").groupBy("word", "slot").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most max_slots rows for each 64 languages
    table = np.zeros(((len(known) + 63) // 64, slots), np.uint64)
    table[masks["word"].to_numpy(), masks["slot"].to_numpy()] = masks["bits"].to_numpy().view(np.uint64)
    return LanguageModel([x for x, _ in known], max(known, key=lambda x: x[1])[0], table, hashes, n)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (the predicted language's share of all languages' hits) as last columns; names that docs has already get underscores behind."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def guess(text: pa.Array) -> pa.Array:
        model = shared.value
        names, scores = [], []
        for batch in slices(iter([pa.RecordBatch.from_arrays([text], ["text"])])):
            hits = model.hits(batch.column(0))
            best, most, total = hits.argmax(axis=1), hits.max(axis=1), hits.sum(axis=1)
            names += [model.languages[b] if m > 0 else model.default for b, m in zip(best, most, strict=True)]
            scores.append(np.divide(most, total, out=np.zeros(len(most)), where=total > 0))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["lang_pred", "score"])

    pred, score, both = (free_name(docs, x) for x in ("lang_pred", "score", "lang_guess"))
    found = F.lit(bool(model.languages)) & F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    if not model.languages:
        return docs.withColumn(pred, F.lit("und")).withColumn(score, F.lit(0.0))
    out = docs.withColumn(both, guess(F.col(text_col)))
    return out.withColumn(pred, F.when(found, F.col(f"{both}.lang_pred")).otherwise("und")).withColumn(score, F.when(found, F.col(f"{both}.score")).otherwise(0.0)).drop(both)


def op2_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    known = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    model = fit(docs.filter(known).select("text", "lang"))
    return predict(docs.select("doc_id", held_out("doc_id", 5).alias("held_out"), "text"), model).drop("text")
