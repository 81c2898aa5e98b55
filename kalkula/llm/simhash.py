"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints have 64 bits; bit by bit the majority over a text's shingle hashes. Texts whose fingerprints differ in
`distance` bits or fewer are linked, and components of linked texts are found over distinct fingerprints only.

Candidate search: bits are grouped so that correlated ones share a partition, and each partition i gets a threshold t(i)
with sum t(i) = distance - partitions + 1; any two linked fingerprints then differ in t(i) bits or fewer within some
partition i (a partition with -1 is not probed). Groupings of several sizes compete: dynamic programming spreads the
thresholds so that signatures plus estimated candidates are fewest, where candidates are estimated from the share of
set bits counted over all distinct fingerprints. Probing is a join on (partition, value with up to t(i) bits flipped).

Probe values with many fingerprints are not paired up. Up to IN_TASK of them are compared inside one task, which returns
only the links of a spanning forest. Where there are more, every fingerprint x is dealt to all values at most one bit
off as a hub and to all at most `distance` - 1 bits off as a spoke, outside the partition's own bits. Hubs of one value
are two bits apart at most and each spoke is within `distance` of each hub, so linking all to the least hub adds true
links only, and no connection is missed: the count grows in proportion to the fingerprints, not with the square.

Null text counts as empty; texts without words have fingerprint zero and are linked like others; rows with equal
fingerprints are always linked; null ids belong to components but never name one (a component of null ids only has
a null name); repeated rows do no harm; extra columns of any name are kept by drop_near_duplicates and ignored otherwise; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kalkula.llm.common import cut_lineage, free_name, lower_ascii, read_table, slices, text_bytes, words

BITS, DISTANCE, SHINGLE, SEED = 64, 3, 3, 42
#: Probe values with more fingerprints than CROWDED aren't paired up by the join. Up to IN_TASK of them are compared in one
#: task, which returns a spanning forest; beyond, they are linked through hubs and spokes.
CROWDED, IN_TASK = 32, 20_000


def _hashes(data: np.ndarray, offsets: np.ndarray, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and the n+1 positions in these that part the texts."""
    starts, ends, at = words(data, offsets)
    n = np.diff(at)
    # the words with one space behind each, so that a shingle is a range of bytes
    length = ends - starts + 1
    place = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(length, out=place[1:])
    spaced = np.full(int(place[-1]), 32, np.uint8)
    source = np.arange(int(place[-1])) + np.repeat(starts - place[:-1], length)
    inner = np.ones(len(spaced), dtype=bool)
    inner[place[1:] - 1] = False
    spaced[inner] = data[source[inner]]
    count = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    first = np.repeat(at[:-1], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    last = np.minimum(first + shingle, np.repeat(at[1:], count))
    view, digest = memoryview(spaced.tobytes()), xxhash.xxh64_intdigest
    out = np.fromiter((digest(view[a:b], seed) for a, b in zip(place[first].tolist(), (place[last] - 1).tolist(), strict=True)), np.uint64, len(first))
    return out, np.concatenate([[0], np.cumsum(count)])


def fingerprints_of(texts: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    data, offsets = text_bytes(texts)
    return majorities(*_hashes(lower_ascii(data), offsets, shingle, seed))


def majorities(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The fingerprint of each list of hashes: a bit is 1 if set in over half of them. at: the n+1 positions that part the lists."""
    n = np.diff(at)
    some = np.flatnonzero(n)
    out = np.zeros(len(n), np.uint64)
    if len(some):
        for b in range(BITS):
            bit = ((hashes >> np.uint64(b)) & np.uint64(1)).astype(np.int32)
            set_ = np.add.reduceat(bit, at[some])
            out[some] |= (2 * set_ > n[some]).astype(np.uint64) << np.uint64(b)
    return out


@F.arrow_udf(T.LongType())
def simhash(text: pa.Array) -> pa.Array:
    """The fingerprint, as a signed number."""
    parts = [fingerprints_of(b.column(0)) for b in slices(iter([pa.RecordBatch.from_arrays([text], ["text"])]))]
    return pa.array((np.concatenate(parts) if parts else np.zeros(0, np.uint64)).view(np.int64))


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each two bits how many have both set; 64 x 64 sums whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 65_536):
                x = batch.column(0).slice(at, 65_536).to_numpy().view(np.uint64)
                bits = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                n += len(x)
                both += np.rint(bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(both.ravel(), n))], ["cell", "n"])

    rows = prints.select("print").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(BITS * BITS + 1, np.int64)
    for r in rows:
        cells[r["cell"]] = r["n"]
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """parts groups of bits of nearly the same size, correlated bits together.

    Each group starts with the bit that is most even among those left and takes the bits most correlated with its members.
    """
    p = np.diag(both) / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(1, n) - np.outer(p, p)) / np.outer(spread, spread)
    left, groups = set(range(BITS)), []
    for g in range(parts):
        size = -(-len(left) // (parts - g))
        group = [max(left, key=lambda b: (spread[b], -b))]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(left, key=lambda b: (sum(corr[b, x] for x in group), -b)))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def allocate(n: int, both: np.ndarray, groups: list[list[int]], distance: int = DISTANCE) -> tuple[float, list[int]]:
    """Estimated work and the thresholds that make it least, by dynamic programming over the groups and what is left to spread."""
    p = np.diag(both) / max(1, n)
    differ = 2 * p * (1 - p)
    total = distance - len(groups) + 1
    costs = []
    for group in groups:
        near = np.array([1.0] + [0.0] * distance)  # chance of so many differing bits in the group
        for b in group:
            near = near * (1 - differ[b]) + np.append(0.0, near[:-1]) * differ[b]
        cost = {-1: 0.0}
        for t in range(distance + 1):
            signatures = n * sum(math.comb(len(group), k) for k in range(t + 1))
            cost[t] = signatures + n * n / 2 * near[: t + 1].sum()
        costs.append(cost)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (c, chosen) in best.items():
            for t, extra in cost.items():
                if spent + t not in step or c + extra < step[spent + t][0]:
                    step[spent + t] = (c + extra, [*chosen, t])
        best = step
    return best[total]


def choose_partitions(n: int, both: np.ndarray, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to probe, for the number of partitions with least estimated work."""
    options = []
    for parts in range(1, 2 * distance + 3):
        groups = group_bits(n, both, parts)
        cost, thresholds = allocate(n, both, groups, distance)
        options.append((cost, parts, [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]))
    return min(options)[2]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def _flips(bits: list[int], most: int) -> list[int]:
    """Masks of at most so many of the bits."""
    out = [[]]
    for k in range(most):
        out += [[*m, b] for m in out if len(m) == k for b in bits if not m or b > m[-1]]
    return sorted({_mask(m) for m in out}) if most else [0]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def forest(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is linked among the fingerprints: each is compared with those not yet reached only."""
    left, a, b = np.unique(prints), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= distance
            reached, left = left[near], left[~near]
            a.append(np.full(len(reached), x))
            b.append(reached)
            queue += list(reached)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(prints: DataFrame, partitions: list[tuple[list[int], int]], distance: int = DISTANCE, crowded: int = CROWDED, in_task: int = IN_TASK) -> DataFrame:
    """a and b: distinct fingerprints in `distance` bits of each other or fewer; in crowded places enough of these to connect all."""
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= distance
    keyed, probes = [], []
    for i, (bits, t) in enumerate(partitions):
        own = F.col("print").bitwiseAND(F.lit(_mask(bits)))
        keyed.append(prints.select(F.lit(i).alias("part"), own.alias("value"), "print"))
        values = F.array(*(own.bitwiseXOR(F.lit(m)) for m in _flips(bits, t))) if t else F.array(own)
        probes.append(prints.select(F.lit(i).alias("part"), F.explode(values).alias("value"), F.col("print").alias("probe")))
    stored, probing = _union(keyed), _union(probes)
    crowds = cut_lineage(stored.groupBy("part", "value").agg(F.count("*").alias("n")).filter(F.col("n") > crowded).select("part", "value"))
    sparse = stored.join(crowds, ["part", "value"], "left_anti").join(probing, ["part", "value"]).filter((F.col("print") < F.col("probe")) & near(F.col("print"), F.col("probe")))
    found = [sparse.select(F.col("print").alias("a"), F.col("probe").alias("b"))]
    if crowds.limit(1).count():
        members = cut_lineage(stored.unionByName(probing.withColumnRenamed("probe", "print")).join(crowds, ["part", "value"]).distinct())
        sizes = members.groupBy("part", "value").agg(F.count("*").alias("n"))

        def connect(group: pa.Table) -> pa.Table:
            a, b = forest(group.column("print").to_numpy().view(np.uint64), distance)
            return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

        few = members.join(sizes.filter(F.col("n") <= in_task), ["part", "value"]).select("part", "value", "print")
        found.append(few.groupBy("part", "value").applyInArrow(connect, "a long, b long"))
        many = cut_lineage(members.join(sizes.filter(F.col("n") > in_task), ["part", "value"]).select("part", "print").distinct())
        if many.limit(1).count():
            for i, (bits, t) in enumerate(partitions):
                # Fingerprints that share the partition's bits differ outside them; with t flips allowed, anywhere.
                wide = F.array(*map(F.lit, _flips([b for b in range(BITS) if t or b not in bits], distance - 1)))
                dealt = many.filter(F.col("part") == i).select("print", F.explode(wide).alias("flip")).select("print", F.col("print").bitwiseXOR(F.col("flip")).alias("at"), F.bit_count("flip").alias("off"))
                hubs = dealt.groupBy("at").agg(F.min(F.when(F.col("off") <= 1, F.col("print"))).alias("hub"), F.collect_set("print").alias("spokes"))
                found.append(hubs.filter("hub is not null and size(spokes) > 1").select(F.col("hub").alias("a"), F.explode("spokes").alias("b")))
    return _union(found).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root (the least node of its component) for all nodes of the edges (a, b).

    Large-star and small-star steps take turns until nothing changes; the edges are written down after each pair of steps.
    """
    edges = cut_lineage(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b"))

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        joined = both.join(least, "a")
        moved = joined.filter(F.col("b") > F.col("a")) if large else joined
        moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
        return moved.filter("a <> b").distinct()

    sums = None
    for _ in range(most_rounds):
        edges = cut_lineage(star(star(edges, True), False))
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == sums:
            break
        sums = now
    else:
        raise RuntimeError(f"components are not settled after {most_rounds} rounds")
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.unionByName(edges.select(F.col("b").alias("node")).distinct().join(roots.select("node"), "node", "left_anti").withColumn("root", F.col("node")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, crowded: int = CROWDED) -> DataFrame:
    """id, print (signed) and component_id for every row."""
    rows = cut_lineage(docs.select(F.col(id_col).alias("id"), simhash_of(shingle)(text_col).alias("print")))
    prints = cut_lineage(rows.groupBy("print").agg(F.min("id").alias("least_id")))
    n, both = bit_statistics(prints)
    if n == 0:
        return rows.withColumn("component_id", F.col("id"))
    found = components(links(prints.select("print"), choose_partitions(n, both, distance), distance, crowded))
    rooted = cut_lineage(prints.join(found.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print")))
    names = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(names, "root").select("print", "component_id")
    return rows.join(named, "print").select("id", "print", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One document of each component stays: that with the least id, of equal ids the first row.

    The documents are written down once with their number, and all steps read that table.
    """
    name, number = free_name(docs, "dedup_name"), free_name(docs, "dedup_row")
    named = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"))
    placed = cut_lineage(docs.withColumn(name, named))
    first = near_duplicates(placed, name, **options).filter("id = component_id").select(F.col("id.row").alias(number))
    return placed.withColumn(number, F.col(f"{name}.row")).join(first.hint("shuffle_hash"), number, "left_semi").drop(name, number)


def simhash_of(shingle: int):
    if shingle == SHINGLE:
        return simhash

    @F.arrow_udf(T.LongType())
    def other(text: pa.Array) -> pa.Array:
        parts = [fingerprints_of(b.column(0), shingle) for b in slices(iter([pa.RecordBatch.from_arrays([text], ["text"])]))]
        return pa.array((np.concatenate(parts) if parts else np.zeros(0, np.uint64)).view(np.int64))

    return other


def hex_print(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def op7_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), hex_print(F.col("print")).alias("fingerprint"), "component_id")
