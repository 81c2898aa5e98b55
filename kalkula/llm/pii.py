"""Personal data: direct identifiers by pattern, and terms that reveal them by corpus statistics.

E-mail addresses, IP addresses, card and phone numbers are found by pattern and check digits. Each distinct value is a
protected entity. A term (word of letters) discloses an entity as far as it takes away the entity's information content:

    disclosure = PMI(term; entity) / IC(entity),  IC = log2(N / n_e),  PMI = log2((n_et / n_e) / (n_t / N))

n_e counts the entity's distinct contexts (the words around a mention; copies of a context count once), n_et those with
the term, n_t the documents with the term, and N all documents. Entities with a single context count like all others. Pairs
that may be chance are left out: the chance of a term with rate q = n_t / N to be in so many of n_e contexts is at most
exp(-n_e KL(n_et / n_e, q)), which is q itself where all contexts have the term, and must not be over `chance`. Terms that
reach the threshold with some entity are spans of kind `term` wherever they occur, also in documents without the entity.
Sanitising generalises identifiers to their kind and removes disclosing terms.

Spans are in code points, end exclusive. One pass over the texts finds identifiers and the words around them, a second counts
the documents of those words, and a third, if any word discloses something, finds where such words occur. Words meet the
texts through a bit table of fixed size; counts go by 64-bit hashes of words, spans by an exact join that corrects what the
table lets through. Texts aren't shuffled for it: spans go by the text's address, and only texts that change meet them.

A null text counts as empty (sanitising leaves it null); rows with equal texts get equal spans; null ids and repeated rows do
no harm; extra columns of any name are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kalkula.llm.common import LISTS, added_up, bit_filter, bit_table, content_key, count_lists, cut_lineage, free_name, in_table, lower_ascii, range_hashes, read_table, runs, slices, summed, text_bytes

KINDS = ("email", "ip", "card", "phone", "term")
THRESHOLD, CHANCE, WINDOW, MIN_LETTERS = 0.9, 0.05, 6, 3
#: Bits of the table that words pass, and distinct words that a task counts before it hands them on.
SLOTS, COUNTED = 1 << 23, 1 << 18

_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: All bytes that an IP address, card or phone number can have; the shortest of these has seven.
_NUMBER = np.isin(np.arange(256), list(b"0123456789 .()+-"))
_DIGIT = np.isin(np.arange(256), list(b"0123456789"))
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Each starts where its digits or sign start, so a match can't begin within a run of them.
_IP = re.compile(rb"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(rb"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")

_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType())]))


def _luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = (d - 48) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(match: bytes) -> bytes:
    return re.sub(rb"[^0-9]", b"", match)


def end_to_end(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a zero byte behind each, and where each starts (n+1 places)."""
    data, offsets = text_bytes(texts)
    apart = offsets + np.arange(len(offsets))
    out = np.zeros(len(data) + len(offsets) - 1, np.uint8)
    keep = np.ones(len(out), dtype=bool)
    keep[apart[1:] - 1] = False
    out[keep] = data
    return out, apart


def identifiers(data: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, sorted."""
    joined = data.tobytes()
    found, last = [], 0
    for at in np.flatnonzero(data == 64).tolist():
        begin = at
        while begin > last and joined[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(joined, at + 1)):
            found.append((begin, 0, m.end()))
            last = m.end()
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data], dtype=np.int32)])
    starts, ends = runs(_NUMBER[data], np.array([0, len(data)]))
    some = (ends - starts >= 7) & (digits[ends] - digits[starts] >= 4)
    for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(joined, a, b) if all(len(x.lstrip(b"0")) < 4 and int(x) <= 255 for x in m[0].split(b"."))]
        found += [(m.start(), 2, m.end()) for m in _CARD.finditer(joined, a, b) if 14 <= len(d := _digits(m[0])) <= 19 and _luhn(d)]
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(joined, a, b) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found)


def _covered(spans: list[tuple[int, int, int]], size: int) -> np.ndarray:
    """Which bytes lie in a span."""
    step = np.zeros(size + 1, np.int32)
    for a, _, b in spans:
        step[a] += 1
        step[b] -= 1
    return np.cumsum(step[:-1]) > 0


def _code_points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte, and before the end."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def _address(data: np.ndarray) -> bytes:
    return hashlib.sha256(data.tobytes()).digest()


_MENTION = "struct<entity:string,context:bigint,terms:array<string>>"


def identified(docs: DataFrame, text_col: str = "text", window: int = WINDOW, min_letters: int = MIN_LETTERS) -> DataFrame:
    """blob (address of a text), spans (start, kind, end) and mentions, for each text with identifiers.

    A mention is the entity, a hash of the words around it (its context), and those words of min_letters or more.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, apart = end_to_end(batch.column("text"))
            found = identifiers(data)
            rows: list[tuple[bytes, list[dict], list[dict]]] = []
            of = np.searchsorted(apart, [a for a, _, _ in found], "right") - 1
            for row in np.unique(of).tolist():
                first, own = int(apart[row]), data[apart[row] : apart[row + 1] - 1]
                here = [(a - first, kind, b - first) for a, kind, b in found[slice(*np.searchsorted(of, (row, row + 1)))]]
                low, place = lower_ascii(own), _code_points(own)
                starts, ends = runs(_LETTER[own] & ~_covered(here, len(own)), np.array([0, len(own)]))
                mentions = []
                for a, kind, b in here:
                    at = np.searchsorted(starts, a)
                    near = [low[x:y].tobytes() for x, y in zip(starts[max(0, at - window) : at + window], ends[max(0, at - window) : at + window], strict=True)]
                    terms = sorted({t for w in near if len(t := w.decode()) >= min_letters})
                    mentions.append({"entity": f"{KINDS[kind]}:{low[a:b].tobytes().decode()}", "context": xxhash.xxh64_intdigest(b" ".join(near)) - (1 << 63), "terms": terms})
                rows.append((_address(own), [{"start": int(place[a]), "kind": kind, "end": int(place[b])} for a, kind, b in here], mentions))
            spans = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
            about = pa.list_(pa.struct([("entity", pa.string()), ("context", pa.int64()), ("terms", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], spans), pa.array([r[2] for r in rows], about)], ["blob", "spans", "mentions"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(find, f"blob binary, spans {_SPAN.simpleString()}, mentions array<{_MENTION}>")


@F.arrow_udf(T.LongType())
def word_hash(term: pa.Array) -> pa.Array:
    data, offsets = text_bytes(term)
    return pa.array(range_hashes(data, offsets[:-1], offsets[1:]).view(np.int64))


def _hits(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, end (bytes) and hash of the words whose bit is set in the table; the bytes searched and where texts start."""
    data, apart = end_to_end(texts)
    starts, ends = runs(_LETTER[data], apart)
    number = range_hashes(lower_ascii(data), starts, ends)
    pick = np.flatnonzero(in_table(table, number))
    return np.searchsorted(apart, starts[pick], "right") - 1, starts[pick], ends[pick], number[pick], data, apart


def term_documents(docs: DataFrame, table: np.ndarray, buckets: int = 16, text_col: str = "text") -> DataFrame:
    """hash and n: how many documents hold the word, for the words whose bit is set in the table.

    Tasks hand their counts on as lists, cut by hash into buckets, in which the lists of all tasks are added up.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for batch in slices(batches):
            row, _, _, number, _, _ = _hits(batch.column("text"), shared.value)
            distinct, code = np.unique(number, return_inverse=True)
            once = np.unique(row * np.int64(max(1, len(distinct))) + code)  # a word counts once for each document
            keys.append(distinct)
            counts.append(np.bincount(once % max(1, len(distinct)), minlength=len(distinct)))
            if sum(map(len, keys)) > COUNTED:
                key, n = summed(keys, counts)
                keys, counts = [key], [n]
                if len(key) > COUNTED // 2:
                    yield count_lists(key, n, buckets)
                    keys, counts = [], []
        yield count_lists(*summed(keys, counts), buckets)

    return added_up(docs.select(F.col(text_col).alias("text")).mapInArrow(count, LISTS)).withColumnRenamed("key", "hash")


def disclosing_terms(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, chance: float = CHANCE, found: DataFrame | None = None) -> DataFrame:
    """term, entity and disclosure of the pairs that reach the threshold. found: what identified gave, if it is at hand."""
    mentions = (identified(docs, text_col) if found is None else found).select(F.explode("mentions").alias("m")).select("m.*")
    contexts = cut_lineage(mentions.groupBy("entity", "context").agg(F.first("terms").alias("terms")))
    known = contexts.groupBy("entity").agg(F.count("*").alias("n_e"))
    pairs = contexts.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_et"))
    pairs = cut_lineage(pairs.join(known, "entity").withColumn("hash", word_hash("term")))
    table = bit_table(pairs.select("hash"), SLOTS)
    total = docs.count()
    counted = pairs.join(term_documents(docs, table, max(16, total // 10_000), text_col), "hash") if table.any() else pairs.withColumn("n", F.lit(1).cast("long"))
    rate = F.least(F.greatest("n", "n_et") / F.lit(float(max(total, 1))), F.lit(1.0))
    share = F.col("n_et") / F.col("n_e")
    without = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - F.least(rate, share)))).otherwise(0.0)
    rare = F.col("n_e") * (share * F.log(share / F.least(rate, share)) + without) >= -math.log(chance)
    content = F.log2(F.lit(float(max(total, 1))) / F.col("n_e"))
    pmi = F.log2((F.col("n_et") / F.col("n_e")) / (F.greatest("n", "n_et") / F.lit(float(max(total, 1)))))
    return counted.withColumn("disclosure", F.when(content > 0, pmi / content).otherwise(0.0)).filter((F.col("disclosure") >= threshold) & rare).select("term", "entity", "disclosure")


def term_spans(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """blob and span (start, kind, end) of each occurrence of a term outside of identifiers."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(terms.select("term").distinct().select(word_hash("term")), SLOTS))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, start, end, _, data, apart = _hits(batch.column("text"), shared.value)
            if not len(row):
                continue
            blobs, words, starts, ends = [], [], [], []
            edges = np.flatnonzero(np.diff(row, prepend=-1))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(row)], strict=True):
                first, own = apart[row[a]], data[apart[row[a]] : apart[row[a] + 1] - 1]
                free = ~_covered(identifiers(own), len(own))
                here = [(x, y) for x, y in zip((start[a:b] - first).tolist(), (end[a:b] - first).tolist(), strict=True) if free[x:y].all()]
                low, place, blob = lower_ascii(own), _code_points(own), _address(own)
                blobs += [blob] * len(here)
                words += [low[x:y].tobytes().decode() for x, y in here]
                starts += [int(place[x]) for x, _ in here]
                ends += [int(place[y]) for _, y in here]
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(words, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["blob", "term", "start", "end"])

    seen = docs.select(F.col(text_col).alias("text")).mapInArrow(find, "blob binary, term string, start long, end long").distinct()
    return seen.join(terms.select("term").distinct(), "term").select("blob", F.struct("start", F.lit(KINDS.index("term")).alias("kind"), "end").alias("span"))


def spans_by_blob(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """blob and spans (identifiers, and disclosing terms outside of these), sorted; texts without any are left out."""
    found = cut_lineage(identified(docs, text_col))
    terms = cut_lineage(disclosing_terms(docs, text_col, found=found, **options))
    spans = found.select("blob", F.explode("spans").alias("span"))
    if terms.limit(1).count():
        spans = spans.unionByName(term_spans(docs, terms, text_col))
    return spans.groupBy("blob").agg(F.sort_array(F.collect_set("span")).alias("spans"))


@F.arrow_udf(T.StringType())
def _without(text: pa.Array, spans: pa.Array) -> pa.Array:
    out: list[str | None] = []
    for x, found in zip(text.to_pylist(), spans.to_pylist(), strict=True):
        if x is None or not found:
            out.append(x)
            continue
        parts, at = [], 0
        for s in found:
            if s["end"] <= at:
                continue
            parts.append(x[at : max(at, s["start"])])
            parts.append("" if KINDS[s["kind"]] == "term" else f"<{KINDS[s['kind']]}>" if s["start"] >= at else "")
            at = s["end"]
        out.append("".join([*parts, x[at:]]))
    return pa.array(out, pa.string())


def sanitise(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs with identifiers generalised to <kind> and disclosing terms removed; n_chars, where there is one, is counted anew for changed texts.

    Only texts that may change, by a bit table of the addresses, are shuffled.
    """
    spans = cut_lineage(spans_by_blob(docs, text_col, **options))
    blob, may, found, text = (free_name(docs, f"pii_{x}") for x in ("blob", "may", "spans", "text"))
    flagged = docs.withColumn(blob, content_key(text_col))
    flagged = flagged.withColumn(may, bit_filter(spans.select("blob"))(F.col(blob)))
    met = flagged.filter(F.col(may)).join(spans.select(F.col("blob").alias(blob), F.col("spans").alias(found)), blob, "left")
    changed = F.col(found).isNotNull() & F.col(text_col).isNotNull()
    met = met.withColumn(text, F.when(changed, _without(F.col(text_col), F.col(found))).otherwise(F.col(text_col)))
    columns = [F.col(text).alias(c) if c == text_col else F.when(changed, F.length(text)).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return flagged.filter(~F.col(may)).select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(met.select(*columns))


def listed(spans, kinds: int = len(KINDS)):
    """kind:start:end of the spans of the first kinds, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.filter(spans, lambda s: s["kind"] < kinds), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_information_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = cut_lineage(spans_by_blob(docs))
    found = docs.select("doc_id", content_key().alias("blob")).join(spans, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(_SPAN)))
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(n(k).alias(f"n_{KINDS[k]}") for k in range(4)), F.sha2(listed(F.col("spans"), 4), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
