"""Source divergence audit by single-pass in-memory indexing.

Each task reads its documents once and builds block postings: how often, and in how many documents, a term occurs in each
(language, source) group. When a block fills its memory it is spilled as a run sorted by shard (a hash of the term),
language, term and source, cut into chunks. Chunks of one shard meet ordered by their first term; a heap of open chunks
merges them into frequencies while they stream by, with one open chunk for each run at most. Terms of few documents go.

A pair of sources is compared over all V terms of its language. The sum is taken as if every term were absent from both
sources, then corrected: once for the terms of either source, by a histogram of its shares, and once for the terms of both,
which stream by term after term. So no term is visited for sources that lack it.

Null text, language and source count as ''; an empty table gives no rows; repeated rows count as often as they occur; long
texts are handled in slices between whole texts, one text by itself where it is longer than a slice. Equal values are ranked
by the item's UTF-8 bytes. Extra columns are ignored. Counts must stay below 9.2 * 10^15.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kalkula.llm.common import cut_lineage, lower_ascii, read_table, runs, slices, strings_at, text_bytes

#: A term must occur in so many documents of its language; so many terms are reported for each group.
LEAST_DOCS, TOP_TERMS = 3, 200
#: A block is spilled at so many postings, or so many bytes of distinct terms.
BLOCK_POSTINGS, BLOCK_BYTES = 1 << 20, 1 << 25
#: Postings in a chunk of a run, postings that are merged at once, and pairs of postings that are computed at once.
CHUNK, POSTINGS_WAITING, PAIRS_AT_ONCE = 1024, 1 << 17, 1 << 18
#: Chunks that are handed on, or taken up, at once.
ROWS_AT_ONCE = 32
#: Bytes of text that are indexed at once.
TEXT_BYTES = 1 << 21
#: Sums of pairs of sources that a task holds before it hands them on.
SUMS_HELD = 1 << 20

RUNS = "shard int, first binary, terms array<binary>, term_at array<int>, names array<string>, source_at array<int>, counts array<long>, docs array<long>"
FREQUENCIES = "term_id long, lang string, term string, total long, sources array<string>, counts array<long>"
#: Behind the language in a sort key; no UTF-8 text has this byte, so no language's key is the start of another's.
BETWEEN = b"\xff"

_IS_LETTER = np.zeros(256, dtype=bool)
_IS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _list_of(values: pa.Array, edges: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)


def _reduced(key: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, and for each of sums its total by key."""
    if not len(key):
        return key, *sums
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[at], *(np.add.reduceat(s[order], at) for s in sums)


class Block:
    """Postings in memory: a number for each term and for each group, counts and documents by (group, term)."""

    def __init__(self) -> None:
        self.terms: dict[bytes, int] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self.bytes, self.held = 0, 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, texts: pa.Array, langs: list[str], sources: list[str]) -> None:
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources, strict=True)], np.int64)
        data, offsets = text_bytes(texts)
        starts, ends = runs(_IS_LETTER[data], offsets)
        if not len(starts):
            return
        coded = strings_at(lower_ascii(data), starts, ends).dictionary_encode()
        number = np.empty(len(coded.dictionary), np.int64)
        for i, term in enumerate(coded.dictionary.to_pylist()):
            number[i] = at = self.terms.setdefault(term, len(self.terms))
            if at == len(self.terms) - 1:
                self.bytes += len(term)
        code = number[coded.indices.to_numpy(zero_copy_only=False)]
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
        each = np.sort(doc << 32 | code)
        at = np.flatnonzero(np.concatenate([[True], each[1:] != each[:-1]]))
        each, n = each[at], np.diff(at, append=len(each))
        key = group[each >> 32] << 32 | each & 0xFFFFFFFF
        self.parts.append(_reduced(key, n, np.ones(len(n), np.int64)))
        self.held += len(self.parts[-1][0])

    def full(self) -> bool:
        if self.held > 2 * BLOCK_POSTINGS:
            self.compact()
        return self.held > BLOCK_POSTINGS or self.bytes > BLOCK_BYTES

    def compact(self) -> None:
        if self.parts:
            self.parts = [_reduced(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
            self.held = len(self.parts[0][0])

    def run(self, shards: int) -> Iterator[pa.RecordBatch]:
        """The postings sorted by shard, language, term and source, a row for each chunk."""
        self.compact()
        if not self.held:
            return
        key, n, docs = self.parts[0]
        terms = pa.array(list(self.terms), pa.binary())
        place = np.empty(len(terms), np.int64)
        order = pc.sort_indices(terms).to_numpy()
        place[order] = np.arange(len(terms))
        terms = terms.take(pa.array(order))
        shard_of = np.array([zlib.crc32(t) % shards for t in terms.to_pylist()], np.int64)
        groups = list(self.groups)
        # Sorted with that byte, as keys are: `` comes behind `en`, and `en` behind `en-US`.
        langs = sorted({g[0].encode() + BETWEEN for g in groups})
        number = {x: i for i, x in enumerate(langs)}
        group, term = key >> 32, place[key & 0xFFFFFFFF]
        lang = np.array([number[g[0].encode() + BETWEEN] for g in groups], np.int64)[group]
        order = np.lexsort((group, term, lang, shard_of[term]))
        group, n, docs = group[order], n[order], docs[order]
        word = lang[order] * len(terms) + term[order]
        shard = shard_of[word % len(terms)]
        cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        edges = np.concatenate([np.arange(a, b, CHUNK) for a, b in zip(cut, [*cut[1:], len(word)], strict=True)])
        stops = np.append(edges[1:], len(word))
        kinds = [pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for some in np.array_split(np.arange(len(edges)), -(-len(edges) // ROWS_AT_ONCE)):
            rows: list[list] = [[] for _ in kinds]
            for a, b in zip(edges[some].tolist(), stops[some].tolist(), strict=True):
                here, term_at = np.unique(word[a:b], return_inverse=True)
                names, source_at = np.unique(group[a:b], return_inverse=True)
                written = terms.take(pa.array(here % len(terms))).to_pylist()
                keys = [langs[x] + w for x, w in zip((here // len(terms)).tolist(), written, strict=True)]
                for column, value in zip(rows, (int(shard[a]), keys[0], keys, term_at, [groups[g][1] for g in names.tolist()], source_at, n[a:b], docs[a:b]), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], [c.split()[0] for c in RUNS.split(", ")])


def spilled_runs(docs: DataFrame, text_col: str, lang_col: str, source_col: str, shards: int) -> DataFrame:
    """RUNS: the sorted chunks of all blocks."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for batch in slices(batches, limit=TEXT_BYTES):
            block.add(batch.column("text"), batch.column("lang").to_pylist(), batch.column("source").to_pylist())
            if block.full():
                yield from block.run(shards)
                block = Block()
        yield from block.run(shards)

    empty = F.lit("")
    given = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), empty).alias("lang"), F.coalesce(F.col(source_col), empty).alias("source"))
    return given.mapInArrow(index, RUNS)


class _Chunk:
    """Postings of one run that aren't merged yet."""

    def __init__(self, terms: pa.Array, term_at: np.ndarray, source: np.ndarray, counts: np.ndarray, docs: np.ndarray) -> None:
        self.terms, self.term_at, self.source, self.counts, self.docs = terms, term_at, source, counts, docs
        self.at = 0

    def next(self) -> bytes:
        return self.terms[self.at].as_py()

    def take_below(self, bound: bytes | None) -> tuple:
        """Postings of the terms below bound (None: all); those stay that aren't."""
        low, stop = self.at, len(self.terms)
        while bound is not None and low < stop:
            middle = (low + stop) // 2
            if self.terms[middle].as_py() < bound:
                low = middle + 1
            else:
                stop = middle
        a, b = np.searchsorted(self.term_at, [self.at, stop])
        terms, first = self.terms.slice(self.at, stop - self.at), self.at
        self.at = stop
        return terms, self.term_at[a:b] - first, self.source[a:b], self.counts[a:b], self.docs[a:b]


class _Merge:
    """A heap of open chunks by their next term. Chunks come in the order of their first terms."""

    def __init__(self, least_docs: int) -> None:
        self.heap: list[tuple[bytes, int, _Chunk]] = []
        self.names: dict[str, int] = {}
        self.least, self.task, self.chunks, self.rows = least_docs, TaskContext.get().partitionId(), 0, 0

    def push(self, first: bytes, row: pa.RecordBatch) -> None:
        """row: the one row of a chunk."""
        terms, term_at, names, source_at, counts, docs = (row.column(c).flatten() for c in ("terms", "term_at", "names", "source_at", "counts", "docs"))
        number = np.array([self.names.setdefault(s, len(self.names)) for s in names.to_pylist()], np.int64)
        # Copies, so that a chunk doesn't keep the whole batch that it came in.
        chunk = _Chunk(terms.take(pa.array(np.arange(len(terms)))), term_at.to_numpy().astype(np.int64), number[source_at.to_numpy()], counts.to_numpy().copy(), docs.to_numpy().copy())
        self.chunks += 1
        heapq.heappush(self.heap, (first, self.chunks, chunk))

    def below(self, bound: bytes | None) -> Iterator[pa.RecordBatch]:
        """FREQUENCIES of all terms below bound: no chunk to come has any of them."""
        taken = []
        while self.heap and (bound is None or self.heap[0][0] < bound):
            _, number, chunk = heapq.heappop(self.heap)
            taken.append(chunk.take_below(bound))
            if chunk.at < len(chunk.terms):
                heapq.heappush(self.heap, (chunk.next(), number, chunk))
        if not taken:
            return
        coded = pa.concat_arrays([part[0] for part in taken]).dictionary_encode()
        terms = coded.dictionary
        code, at, parts = coded.indices.to_numpy(), 0, []
        for part in taken:
            parts.append(code[at : at + len(part[0])].astype(np.int64)[part[1]] << 32 | part[2])
            at += len(part[0])
        key, counts, docs = _reduced(np.concatenate(parts), np.concatenate([p[3] for p in taken]), np.concatenate([p[4] for p in taken]))
        edges = np.searchsorted(key >> 32, np.arange(len(terms) + 1))
        kept = np.flatnonzero(np.add.reduceat(docs, edges[:-1]) >= self.least)
        if not len(kept):
            return
        stays = np.zeros(len(terms), dtype=bool)
        stays[kept] = True
        stays = np.repeat(stays, np.diff(edges))
        ends = np.concatenate([[0], np.cumsum(np.diff(edges)[kept])])
        ids = (self.task << 40) + self.rows + np.arange(len(kept))
        self.rows += len(kept)
        words = [t.split(BETWEEN) for t in terms.take(pa.array(kept)).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([w[0].decode() for w in words], pa.string()),
                pa.array([w[1].decode() for w in words], pa.string()),
                pa.array(np.add.reduceat(counts, edges[:-1])[kept]),
                _list_of(pa.array(list(self.names), pa.string()).take(pa.array(key[stays] & 0xFFFFFFFF)), ends),
                _list_of(pa.array(counts[stays]), ends),
            ],
            [c.split()[0] for c in FREQUENCIES.split(", ")],
        )


def merged_runs(chunks: DataFrame, least_docs: int, partitions: int) -> DataFrame:
    """FREQUENCIES: a row for each term of a language that enough of its documents have, with the sources that have it."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap, shard, waiting = _Merge(least_docs), None, 0
        for batch in batches:
            shards, firsts = (batch.column(c).to_pylist() for c in ("shard", "first"))
            for i, (own, first) in enumerate(zip(shards, firsts, strict=True)):
                if own != shard:
                    yield from heap.below(None)
                    shard, waiting = own, 0
                elif waiting >= POSTINGS_WAITING:
                    yield from heap.below(first)
                    waiting = 0
                heap.push(first, row := batch.slice(i, 1))
                waiting += len(row.column("counts").flatten())
        yield from heap.below(None)

    return chunks.repartition(partitions, "shard").sortWithinPartitions("shard", "first").mapInArrow(merge, FREQUENCIES)


def share(count: str, of: str) -> Column:
    """1 + floor(10^9 * (count + 1) / of), by three steps of long division, as the product may exceed 64 bits."""
    rest, parts = f"({count} + 1)", []
    for _ in range(3):
        parts.append(f"({rest} * 1000L div {of})")
        rest = f"({rest} * 1000L % {of})"
    return F.expr(f"1L + ({parts[0]} * 1000L + {parts[1]}) * 1000L + {parts[2]}")


def gap(p: str, q: str) -> str:
    """floor((p - q)^2 / q)"""
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def pair_corrections(postings: DataFrame) -> DataFrame:
    """lang, source, item, value: for each two sources, over the terms that both have, what the sums by source leave out.

    postings: a row for each term with lang and lists of source, p and p0 (the share of an absent term) of those that have it.
    """

    def correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple[str, str], int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def handed_on() -> pa.RecordBatch:
            key, value = _reduced(*(np.concatenate(x) for x in zip(*held, strict=True)))
            of = list(names)
            a, b = [of[i] for i in (key >> 32).tolist()], [of[i] for i in (key & 0xFFFFFFFF).tolist()]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in a], pa.string()), pa.array([x[1] for x in a], pa.string()), pa.array([x[1] for x in b], pa.string()), pa.array(value)], ["lang", "source", "item", "value"])

        for batch in batches:
            lists = batch.column("entries")
            edges = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values
            lang = batch.column("lang").to_pylist()
            source = flat.field("source").to_pylist()
            k = np.diff(edges)
            row = np.repeat(np.arange(len(k)), k)
            number = np.array([names.setdefault((lang[r], s), len(names)) for r, s in zip(row.tolist(), source[edges[0] :], strict=False)], np.int64)
            p, p0 = (flat.field(c).to_numpy()[edges[0] : edges[-1]] for c in ("p", "p0"))
            edges = edges - edges[0]
            partners = np.repeat(k, k)
            until = np.cumsum(partners)
            at = 0
            while at < len(partners):  # postings whose pairs fit are taken together, one at least
                stop = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
                left = np.repeat(np.arange(at, stop), partners[at:stop])
                begin = np.concatenate([[0], np.cumsum(partners[at:stop])[:-1]])
                right = np.arange(len(left)) - np.repeat(begin - edges[row[at:stop]], partners[at:stop])
                left, right = left[left != right], right[left != right]
                value = sum(sign * ((u - v) * (u - v) // v) for sign, u, v in ((1, p[left], p[right]), (-1, p[left], p0[right]), (-1, p0[left], p[right]), (1, p0[left], p0[right])))
                if len(left):
                    held.append(_reduced(number[left] << 32 | number[right], value))
                    size += len(held[-1][0])
                if size > SUMS_HELD and len(held) > 1:
                    held = [_reduced(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    size = len(held[0][0])
                if size > SUMS_HELD // 2:
                    yield handed_on()
                    held, size = [], 0
                at = stop
            if not held:
                names = {}
        if held:
            yield handed_on()

    return postings.mapInArrow(correct, "lang string, source string, item string, value long")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source's use of terms is from each other source of its language
    (part `pair`), and which terms it uses more than the language does (part `term`, the top ones)."""
    spark = docs.sparkSession
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.select(text_col).rdd.getNumPartitions())
    terms = cut_lineage(merged_runs(spilled_runs(docs, text_col, lang_col, source_col, partitions), least_docs, partitions))
    empty = F.lit("")
    occurring = docs.select(F.coalesce(F.col(lang_col), empty).alias("lang"), F.coalesce(F.col(source_col), empty).alias("source")).distinct()
    by_lang = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    entries = terms.select("term_id", "lang", "term", "total", F.explode(F.arrays_zip("sources", "counts")).alias("e")).select("term_id", "lang", "term", "total", F.col("e.sources").alias("source"), F.col("e.counts").alias("count"))
    by_group = entries.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = occurring.join(by_lang, "lang", "left").join(by_group, ["lang", "source"], "left").na.fill(0, ["v", "n", "lang_n"])
    groups = cut_lineage(groups.withColumn("p0", F.when(F.col("v") > 0, share("0L", "(n + v)"))))
    known = entries.join(groups, ["lang", "source"]).withColumn("p", share("count", "(n + v)"))

    ranked = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    own = known.withColumn("q", share("total", "(lang_n + v)")).where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(gap("p", "q")).alias("value"))
    own = own.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    both = pair_corrections(known.groupBy("term_id", "lang").agg(F.collect_list(F.struct("source", "p", "p0")).alias("entries")).where(F.size("entries") > 1).select("lang", "entries"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    absent = groups.join(others, "lang").where("source <> item").select("lang", "source", "item", F.expr(f"coalesce(v * {gap('p0', 'q0')}, 0L)").alias("value"))
    shares = known.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("terms")).join(others, "lang").where("source <> item")
    # A histogram of one source corrects its pairs in both directions.
    either = shares.select("lang", F.inline(F.array(
        F.struct("source", "item", F.expr(f"terms * ({gap('p', 'q0')} - {gap('p0', 'q0')})").alias("value")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.expr(f"terms * ({gap('q0', 'p')} - {gap('q0', 'p0')})").alias("value")),
    )))
    pairs = absent.unionByName(either).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    out = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*out).unionByName(own.withColumn("part", F.lit("term")).select(*out))


def op11_single_pass_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"))


_SHARE = "1 + (1000000000::HUGEINT * ({count} + 1)) // ({of})"
_GAP = "(({p}) - ({q})) * (({p}) - ({q})) // ({q})"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT lang, source, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
l AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT id) >= {LEAST_DOCS}),
c AS (SELECT lang, source, term, count(*) AS c FROM t GROUP BY ALL),
ln AS (SELECT lang, count(*) AS v, sum(total) AS n FROM l GROUP BY lang),
e AS (SELECT c.lang, c.source, c.term, c.c, l.total FROM c JOIN l USING (lang, term)),
g AS (SELECT o.lang, o.source, coalesce(v, 0) AS v, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) o LEFT JOIN ln USING (lang) LEFT JOIN (SELECT lang, source, sum(c) AS n FROM e GROUP BY ALL) s USING (lang, source)),
p AS (SELECT g.lang, g.source, l.term, {_SHARE.format(count="coalesce(e.c, 0)", of="g.n + g.v")} AS p FROM g JOIN l USING (lang) LEFT JOIN e ON e.lang = g.lang AND e.source = g.source AND e.term = l.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum({_GAP.format(p="a.p", q="b.p")}) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
w AS (SELECT e.lang, e.source, e.term, {_SHARE.format(count="e.c", of="g.n + g.v")} AS p, {_SHARE.format(count="e.total", of="ln.n + ln.v")} AS q FROM e JOIN g USING (lang, source) JOIN ln USING (lang)),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ({_GAP.format(p="p", q="q")})::BIGINT AS value FROM w WHERE p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
