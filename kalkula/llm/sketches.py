"""Document fingerprints: bottom-k sketches of word shingles.

A sketch is the sorted array of the k least distinct 64-bit hashes of a text's shingles (five lower-cased words; a shorter
text is one shingle, a text without words none). Sketches of parts merge into the sketch of the whole. Two sketches
estimate resemblance (share of the union's k least hashes that both hold), containment and the number of distinct
shingles; where a sketch holds all of its text's shingles, the estimates are exact.

All of it is built-in functions. A null text counts as empty; two texts without words are alike (1), one of them is not
(0); equal texts have equal sketches; ids are whole numbers or null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kalkula.llm.common import read_table

K, WORDS = 128, 5
#: Rows of a range of ids, for the order of all documents, and the most ranges: beyond 5 * 10^8 documents ranges get more rows
#: (160,000 at 4 * 10^10), which a task sorts like any partition. FAN bounds are compared at once.
RANGE_ROWS, MAX_RANGES, FAN = 2000, 1 << 18, 64
_TOP = float(2**63)


def once(value: Column, use) -> Column:
    """use(value), with value computed once for each row even where use has it inside a loop over an array."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """Sorted array of the k least distinct hashes."""

    def hashes(tokens: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(tokens) - words + 1), lambda i: F.xxhash64(F.slice(tokens, i, words)))
        return F.when(F.size(tokens) >= words, many).when(F.size(tokens) > 0, F.array(F.xxhash64(tokens))).otherwise(F.array().cast("array<long>"))

    tokens = F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return F.slice(F.sort_array(F.array_distinct(once(tokens, hashes))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_sketches(df: DataFrame, by: list[str], column: str, k: int = K) -> DataFrame:
    """One sketch for each group: the k least distinct of the members' hashes, ranked after they were made distinct."""
    hashes = df.select(*by, F.explode(column).alias("hash")).distinct()
    least = hashes.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy("hash"))).filter(F.col("rank") <= k)
    return least.groupBy(*by).agg(F.array_sort(F.collect_list("hash")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    shared = lambda union: F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(union, a), b)) / F.size(union))
    return once(merged(a, b, k), shared)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """(k - 1) over the k-th least hash as a share of all; the number of hashes where there are fewer than k."""
    share = (F.element_at(a, -1).cast("double") + F.lit(_TOP)) / F.lit(2 * _TOP)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that are in b."""
    both = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def hexed(a: Column) -> Column:
    """16 hexadecimal digits for each hash, in order."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def bounds_over(bounds: list[int], x: Column) -> Column:
    """How many of the descending bounds are x or more; null for a null x. Found in steps of FAN comparisons, not one by one."""
    some = lambda among: F.size(F.filter(among, lambda b: b >= x))
    if len(bounds) <= FAN:
        return some(F.array(*map(F.lit, bounds)))
    chunks = F.array(*(F.array(*map(F.lit, bounds[i : i + FAN])) for i in range(0, len(bounds), FAN)))
    return once(bounds_over(bounds[::FAN], x), lambda c: F.when(c == 0, 0).otherwise((c - 1) * FAN + some(F.get(chunks, c - 1))))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> tuple[DataFrame, object]:
    """docs (id, text) dealt by ranges of ids, with the first row of the following range added to each, and the window to walk on.

    The order is by descending id (a whole number), nulls last, equal ids by text; after the last row comes the first. Texts
    are shuffled once. Only a number for each range comes to the driver, and goes out to find the first row of each range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = rows.count()
    parts = max(1, min(MAX_RANGES, -(-n // range_rows)))
    bounds: list[int] = []
    if parts > 1:
        bounds = sorted(set(rows.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or []), reverse=True)
    # range 0 has the ids over the first bound, and so on; nulls are in the last
    rows = rows.withColumn("range", F.when(F.col("id").isNull(), len(bounds)).otherwise(bounds_over(bounds, F.col("id")) if bounds else 0))
    order = [F.col("id").desc_nulls_last(), F.col("text")]
    full = sorted((r["range"], r["id"]) for r in rows.groupBy("range").agg(F.max("id").alias("id")).collect())  # a row per range
    heads = [(x, full[i - 1][0]) for i, (_, x) in enumerate(full)]
    # Of equal ids the one with the least text is first. The broadcast side has a row for each range, MAX_RANGES at most.
    first = rows.join(F.broadcast(spark.createDataFrame(heads, "head long, to int")), F.col("id").eqNullSafe(F.col("head"))).groupBy("to", "id").agg(F.min("text").alias("text"))
    ghosts = first.select("id", "text", F.col("to").alias("range"), F.lit(True).alias("ghost"))
    walk = W.partitionBy("range").orderBy("ghost", *order)
    return rows.select("id", "text", "range", F.lit(False).alias("ghost")).unionByName(ghosts), walk


def edited(text: Column, following: Column) -> Column:
    """The text with its last half (rounded down) replaced by as many characters of the beginning of the following text, or all of it."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def op8_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, walk = with_next(read_table(spark, sf_dir, "documents"))
    df = docs.withColumn("edited", edited(F.col("text"), F.coalesce(F.lead("text").over(walk), F.lit(""))))
    df = df.select("id", "range", "ghost", "text", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("text")).alias("own"), sketch(F.col("edited")).alias("changed"))
    df = df.withColumn("following", F.lead("own").over(walk)).filter("not ghost")
    return df.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", hexed(F.col("own")).alias("fingerprint"), hexed(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("changed")).alias("near_edited"), resemblance(F.col("own"), F.col("following")).alias("near_next"),
    )
