"""Near copies by resemblance: texts whose sets of word shingles have a Jaccard similarity of `least` or more.

First by SimHash: a set's fingerprint is the bit by bit majority of its shingles' hashes, fingerprints within `distance` bits are
found by the generalised pigeonhole search (`kalkula.llm.simhash.links`), and each of these links is checked on the full sets.
Texts with such a link to the same least text are connected.

Fingerprints miss links, so an exact search follows for those between texts not yet connected, by the prefix filter: all shingles are
put in one order, and of a text's n distinct shingles the first
n - ceil(least * n) + 1 are its keys. Two texts of that similarity share a key, whatever the order is; here shingles that are
in two texts or more come last (by a bit table counted over all texts), the others by hash, so that a line in many texts is
hardly ever a key. A key all of whose texts are connected to one text needs no comparison. What shares any other key
is then counted: a text goes on only if ceil(least * n) of its shingles are in some other text that shares such a key, as
those with a partner are. Of the texts left, those that share a key form a group, cut where the next larger set is too
large for any smaller one, and named by its least member; all groups with one name are compared in one task on full shingle
sets, but not where texts are connected, which returns links of a spanning forest only. Texts with equal sets are one node throughout, so copies make no pairs.

Shingles are 64-bit hashes of lower-cased words in order; a shorter text is one shingle. Null text counts as empty; texts without
words are copies of each other; null ids are last; repeated rows count one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kalkula.llm.common import LISTS, added_up, bit_filter, bit_table, count_lists, cut_lineage, free_name, in_table, lower_ascii, range_hashes, row_hash, slices, summed, text_bytes, words
from kalkula.llm.simhash import SEED, bit_statistics, choose_partitions, components, links, majorities

#: DISTANCE: bits in which fingerprints of near copies may differ for SimHash to find them. By the estimates of choose_partitions
#: 14 M fingerprints take 67 probe rows each at five bits, but 298 at six and 508 at seven: more than the disk budget.
SHINGLE, LEAST, DISTANCE = 5, 0.8, 5
#: Candidates of one hub that are checked in a task.
CHECKED_AT_ONCE = 64
#: Only hashes below this are counted over the corpus: of a text's hashes few beyond its least third can be keys.
COUNTED = np.uint64(int(0.3 * 2**64))
#: Bits of the table of common shingles, and hashes that a task counts before it hands them on.
COMMON_BITS, IN_TASK = 1 << 25, 1 << 18
#: Documents for each bucket that lists of hashes are cut into.
BUCKET_DOCS = 2_500


def _shingles(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and the text that each is in."""
    starts, ends, at = words(data, offsets)
    word, n = range_hashes(data, starts, ends), np.diff(at)
    text = np.repeat(np.arange(len(n)), n)

    def joined(first: np.ndarray, length: int) -> np.ndarray:
        out = np.full(len(first), length, np.uint64)
        for j in range(length):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word[first + j]
        return (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)

    first = np.flatnonzero(text[: len(word) - shingle + 1] == text[shingle - 1 :]) if len(word) >= shingle else np.zeros(0, np.int64)
    hashes, of = [joined(first, shingle)], [text[first]]
    for length in range(1, shingle):
        short = np.flatnonzero(n == length)
        hashes.append(joined(at[short], length))
        of.append(short)
    return np.concatenate(hashes), np.concatenate(of)


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and the n+1 positions that part the texts."""
    data, offsets = text_bytes(texts)
    hashes, doc = _shingles(lower_ascii(data), offsets, shingle)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    first = np.ones(len(hashes), dtype=bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[first], doc[first]
    return hashes, np.searchsorted(doc, np.arange(len(offsets)))


def _nodes(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    view = memoryview(hashes.tobytes())
    return np.fromiter((xxhash.xxh64_intdigest(view[8 * a : 8 * b], SEED) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)), np.uint64, len(at) - 1).view(np.int64)


def _needed(n: np.ndarray, least: float) -> np.ndarray:
    return np.ceil(least * n - 1e-9).astype(np.int64)


def _among(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which of the hashes count as common."""
    return in_table(common, hashes) & (hashes < COUNTED)


def keys_of(hashes: np.ndarray, at: np.ndarray, is_common: np.ndarray, least: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all texts, and the n+1 positions that part the texts."""
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    ranked = hashes[np.argsort(2 * doc + is_common, kind="stable")]  # hashes are sorted within each text
    take = np.where(n > 0, n - _needed(n, least) + 1, 0)
    place = np.arange(len(ranked)) - np.repeat(at[:-1], n)
    return ranked[place < np.repeat(take, n)], np.concatenate([[0], np.cumsum(take)])


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64)))


def common_shingles(docs: DataFrame, shingle: int, buckets: int) -> np.ndarray:
    """A bit table of the shingles in two texts or more. Bits that others share with these only change the order of keys."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for batch in slices(batches):
            hashes = shingle_sets(batch.column("text"), shingle)[0]
            keys.append(hashes[hashes < COUNTED])
            counts.append(np.ones(len(keys[-1]), np.int64))
            if sum(map(len, keys)) > IN_TASK:
                yield count_lists(*summed(keys, counts), buckets)
                keys, counts = [], []
        yield count_lists(*summed(keys, counts), buckets)

    return bit_table(added_up(docs.select("text").mapInArrow(counted, LISTS)).filter("n >= 2").select("key"), COMMON_BITS)


def forest(hashes: np.ndarray, at: np.ndarray, least: float = LEAST, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (places of two sets) that connect all sets of that similarity. Sets in the largest component found by then are only compared with the others.

    known: the component of each set, where some are connected already.
    """
    n = np.diff(at)
    _, number = np.unique(hashes, return_inverse=True)
    owner = np.repeat(np.arange(len(n)), n)
    holders = owner[np.argsort(number, kind="stable")]
    begin = np.concatenate([[0], np.cumsum(np.bincount(number))])
    root, links = np.arange(len(n)) if known is None else np.unique(known, return_inverse=True)[1], []

    def compare(x: int) -> None:
        mine = number[at[x] : at[x + 1]]
        size = begin[mine + 1] - begin[mine]
        where = np.repeat(begin[mine] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        both = np.bincount(holders[where], minlength=len(n))
        for y in np.flatnonzero((both >= least * (n + n[x] - both) - 1e-9) & (root != root[x])).tolist():
            if root[y] != root[x]:
                links.append((x, y))
                root[root == root[y]] = root[x]

    done = np.zeros(len(n), dtype=bool)
    for x in range(len(n)):
        # pairs inside the largest component are connected, and each other pair has a side outside it
        members = np.bincount(root)
        if members.max() == len(n):
            break
        todo = np.flatnonzero(~done & ((root != members.argmax()) | (x == 0)))
        if not len(todo):
            break
        compare(int(todo[0]))
        done[todo[0]] = True
    return links


def without(df: DataFrame, gone: DataFrame, row: str) -> DataFrame:
    """df but for the rows whose number (column `row`) is in gone (one column, written down). Only rows that a bit table can't tell are shuffled."""
    may = free_name(df, "without_may")
    flagged = df.withColumn(may, bit_filter(gone)(F.col(row)))
    unsure = flagged.filter(F.col(may)).join(gone.toDF(row).hint("shuffle_hash"), row, "left_anti")
    columns = [F.col(f"`{c}`") for c in df.columns]
    return flagged.filter(~F.col(may)).select(*columns).unionByName(unsure.select(*columns))


def _met(batches: Iterator[pa.RecordBatch], least: float) -> tuple[np.ndarray, np.ndarray]:
    """hub and node of all groups of two components or more; all rows of a key are here, and groups are cut between sizes too far apart."""
    parts = [(*(b.column(c).to_numpy() for c in ("key", "node", "n")), pc.coalesce(b.column("root"), b.column("node")).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, node, n, root = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((node, n, key))
    key, node, n, root = key[order], node[order], n[order], root[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (n[:-1] < least * n[1:] - 1e-9)
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(key)))
    hub = np.repeat(np.minimum.reduceat(node, start), size)
    several = np.repeat(np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start), size)
    return hub[several], node[several]


def shingle_rows(docs: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """row and hashes (its whole set) of the rows of docs whose number is in rows (one column), written down."""
    chosen = bit_filter(rows)

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, at = shingle_sets(batch.column("text"), shingle)
            yield pa.RecordBatch.from_arrays([batch.column("row"), _lists(hashes, at)], ["row", "hashes"])

    return cut_lineage(docs.filter(chosen(F.col("row"))).select("row", "text").mapInArrow(full, "row long, hashes array<long>"))


def _sets_of(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all rows end to end, and the n+1 positions that part the rows."""
    lists = group.column("hashes").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    at = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy()[at[0] : at[-1]], at - at[0]


def fingerprint_candidates(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """hub and node: for nodes (node, print) whose fingerprints are within `distance` bits, links by SimHash's pigeonhole search.

    Nodes of one fingerprint are linked to the least of them, and these stand for their fingerprints.
    """
    prints = cut_lineage(nodes.groupBy("print").agg(F.min("node").alias("hub")))
    n, both = bit_statistics(prints)
    same = nodes.join(prints, "print").filter("node <> hub").select("hub", "node")
    if n < 2:
        return cut_lineage(same)
    of = lambda side: prints.select(F.col("print").alias(side), F.col("hub").alias(f"{side}_hub"))
    near = links(prints.select("print"), choose_partitions(n, both, distance), distance).join(of("a"), "a").join(of("b"), "b")
    return cut_lineage(same.unionByName(near.select(F.least("a_hub", "b_hub").alias("hub"), F.greatest("a_hub", "b_hub").alias("node"))))


def checked(candidates: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """a and b: the candidates (hub, node) whose sets have that similarity. nodes: node and row.

    A hub with many candidates meets them in parts, each with a copy of the hub's set.
    """
    of_hub = candidates.groupBy("hub").agg(F.ceil(F.count("*") / CHECKED_AT_ONCE).alias("parts"))
    members = candidates.join(of_hub, "hub").select("hub", F.pmod(F.xxhash64("node"), "parts").alias("part"), "node")
    members = members.unionByName(members.select("hub", "part", F.col("hub").alias("node")).distinct())
    members = members.join(nodes.select("node", "row"), "node")
    sets = shingle_rows(docs, members.select("row"), shingle)

    def check(group: pa.Table) -> pa.Table:
        node, hub = group.column("node").to_numpy(), group.column("hub").to_numpy()
        hashes, at = _sets_of(group)
        n, own = np.diff(at), int(np.flatnonzero(node == hub)[0])
        here = np.concatenate([[0], np.cumsum(np.isin(hashes, hashes[at[own] : at[own + 1]]))])
        both = here[at[1:]] - here[at[:-1]]
        holds = (both >= least * (n + n[own] - both) - 1e-9) & (node != hub)
        return pa.table({"a": pa.array(hub[holds], pa.int64()), "b": pa.array(node[holds], pa.int64())})

    return cut_lineage(members.join(sets, "row").select("hub", "part", "node", "hashes").groupBy("hub", "part").applyInArrow(check, "a long, b long"))


def with_root(df: DataFrame, roots: DataFrame) -> DataFrame:
    """df (with node) and root from roots (node, root), else null. Only rows that a bit table can't tell are shuffled."""
    flagged = df.withColumn("linked", bit_filter(roots.select("node"))(F.col("node")))
    alone = flagged.filter(~F.col("linked")).withColumn("root", F.lit(None).cast("long"))
    return alone.unionByName(flagged.filter("linked").join(roots, "node", "left").select(*alone.columns)).drop("linked")


def near_copies(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST, distance: int = DISTANCE) -> tuple[DataFrame, DataFrame]:
    """(row, id, node) for each row of docs (row, id, text), and (node, root) for the nodes that are linked to others."""
    buckets = max(16, docs.count() // BUCKET_DOCS)
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, shingle, buckets))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, at = shingle_sets(batch.column("text"), shingle)
            is_common = _among(hashes, shared.value)
            sure = np.concatenate([[0], np.cumsum(is_common)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), pa.array(_nodes(hashes, at)), pa.array(majorities(hashes, at).view(np.int64)), pa.array(np.diff(at)), pa.array(sure[at[1:]] - sure[at[:-1]]), _lists(*keys_of(hashes, at, is_common, least))],
                ["row", "id", "node", "print", "n", "sure", "keys"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    signed = cut_lineage(docs.select("row", "id", "text").mapInArrow(sign, f"row long, id {kind}, node long, print long, n long, sure long, keys array<long>"))
    rows = signed.select("row", "id", "node")
    one = cut_lineage(signed.groupBy("node").agg(F.min("row").alias("row"), *(F.first(c).alias(c) for c in ("print", "n", "sure"))))
    by_prints = checked(fingerprint_candidates(one.select("node", "print"), distance), one, docs, shingle, least)
    # Texts linked to the same least hub are connected; it needs no more than that to leave comparisons out.
    roots = by_prints.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    copies = cut_lineage(rows.select("row", "node").join(one.select("row"), "row", "left_anti").select("row"))
    single = with_root(without(signed.select("row", "node", "n", "keys"), copies, "row"), roots)

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(_met(batches, least)[1]))], ["node"])

    def keyed(df: DataFrame) -> DataFrame:
        return df.select(F.explode("keys").alias("key"), "node", "n", "root").repartition("key")

    met = cut_lineage(keyed(single).mapInArrow(meeting, "node long").distinct().join(one, "node"))
    passes = bit_filter(met.select("row"))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, at = shingle_sets(batch.column("text"), shingle)
            rare = ~_among(hashes, shared.value)
            yield count_lists(hashes[rare], np.repeat(_nodes(hashes, at), np.diff(at))[rare], buckets)

    def elsewhere(group: pa.Table) -> pa.Table:
        """How many of a node's shingles here are in another node too; all lists of a bucket of hashes are here."""
        key, node = (np.concatenate([np.frombuffer(x, np.uint64) for x in group.column(c).to_pylist()]) for c in ("keys", "counts"))
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[fresh], node[fresh]
        twice = np.zeros(len(key), dtype=bool)
        twice[1:] = key[1:] == key[:-1]
        twice[:-1] |= twice[1:]
        return pa.Table.from_batches([count_lists(*np.unique(node[twice], return_counts=True), buckets)])

    spread = docs.filter(passes(F.col("row"))).select("text").mapInArrow(rest, LISTS)
    counted = added_up(spread.groupBy("bucket").applyInArrow(elsewhere, LISTS)).toDF("node", "shared")
    enough = F.col("sure") + F.coalesce("shared", F.lit(0)) >= F.ceil(F.col("n") * least - 1e-9)
    left = cut_lineage(met.join(counted, "node", "left").filter(enough).select("node", "row"))

    def stars_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.unique(np.stack(_met(batches, least)), axis=1)
        for a in range(0, pairs.shape[1], 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0, a : a + 65_536]), pa.array(pairs[1, a : a + 65_536])], ["hub", "node"])

    again = signed.select("row", "node", "n", "keys").filter(bit_filter(left.select("row"))(F.col("row"))).join(left.select("row"), "row")
    stars = cut_lineage(keyed(with_root(again, roots)).mapInArrow(stars_of, "hub long, node long").distinct().join(left, "node").select("hub", "node", "row"))
    sets = shingle_rows(docs, stars.select("row"), shingle)

    def connect(group: pa.Table) -> pa.Table:
        node = group.column("node").to_numpy()
        found = forest(*_sets_of(group), least, pc.coalesce(group.column("root"), group.column("node")).to_numpy())
        return pa.table({"a": pa.array([node[x] for x, _ in found], pa.int64()), "b": pa.array([node[y] for _, y in found], pa.int64())})

    others = stars.join(roots, "node", "left").join(sets, "row").select("hub", "node", "root", "hashes").groupBy("hub").applyInArrow(connect, "a long, b long")
    return rows, components(by_prints.unionByName(others))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST, distance: int = DISTANCE) -> DataFrame:
    """One document of each component stays: that with the least id, of equal ids that with the least hash of all its columns.

    So the result is the same however the input is split; rows equal in all columns are alike. The documents are written down once with their number, and all steps read that table.
    """
    number = free_name(docs, "dedup_row")
    placed = cut_lineage(docs.withColumn(number, F.monotonically_increasing_id()))
    rows, roots = near_copies(placed.select(F.col(number).alias("row"), F.struct(F.col(id_col).alias("id"), row_hash(docs).alias("content")).alias("id"), F.col(text_col).alias("text")), shingle, least, distance)
    named = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    order = F.struct(F.col("id.id").isNull().alias("none"), "id", "row")
    first = named.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.row").alias("row"))
    gone = cut_lineage(rows.select("row").join(first, "row", "left_anti"))
    return without(placed, gone, number).drop(number)
