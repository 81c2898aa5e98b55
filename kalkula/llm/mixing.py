"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target in words by its weight, at most max_epochs times its own words. A document's expected copies are
its source's target over its source's words. Whole copies are given outright; the fractional rest is rounded by pivotal
sampling: two open documents of a source meet, words move at random from one's share to the other's until one of the
two shares is 0 or 1 copy, and the open one goes on to the next. Words, not copies, are moved, so the expected words of a
source stay exactly what they were through every meeting, and each document's own expected copies too. Documents of a
source are dealt to buckets; what stays open in each bucket (one document at most) meets the others' in a reduction
tree of fan_in branches. At the root a source has one open document at most, which is drawn by its share: a source
misses its target by less than the words of that one document.

Random numbers are hashes of the seed and the row, so reruns agree. A null text has no words, and documents without
words are never taken; null sources form a source of their own, last in order; repeated rows count one by one; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kalkula.llm.common import cut_lineage, free_name, read_table, row_hash, word_count

WEIGHTS, MAX_EPOCHS, BUCKET_ROWS, FAN_IN, SEED = (5, 2, 1), 3, 1000, 64, 20240501


def ranked_sources(sized: DataFrame) -> DataFrame:
    """source, source_size, source_docs and place: 0 for the first source by code point, null last.

    Places come from a range partitioning and the partitions' counts, so no task sorts all sources.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    dealt = cut_lineage(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    first = dealt.groupBy("part").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    within = dealt.withColumn("rank", F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())))
    return within.join(first.select("part", "first"), "part").select("source", "source_size", "source_docs", (F.col("first") + F.col("rank") - 1).alias("place"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, source_docs, place, target. What goes over a source's limit is shared anew by weight, round by round.

    Each round asks Spark for two sums over the open sources; none of them comes to the driver.
    """
    sources = ranked_sources(sized).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double"))
    sources = cut_lineage(sources.withColumn("most", F.lit(float(max_epochs)) * F.col("source_size")))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    rate, rounds = 0.0, -1
    while rounds != 0:  # a source whose share went over its limit stays at it
        full = F.col("most") <= rate * F.col("weight")
        rest = sources.agg(F.sum(F.when(~full, F.col("weight"))).alias("w"), F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)).alias("m")).first()
        now = (total - rest["m"]) / rest["w"] if rest["w"] else rate
        rounds = sources.filter((F.col("most") < now * F.col("weight")) & ~full).limit(1).count() if now > rate else 0
        rate = max(rate, now)
    return sources.withColumn("target", F.least(F.col("most"), F.lit(rate) * F.col("weight"))).drop("weight", "most")


def meet(size: np.ndarray, share: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Shares after the pivotal rounding of one bucket in the order given: all 0 or 1 but one at most."""
    share = share.astype(np.float64).copy()
    open_ = -1
    for i in np.flatnonzero((share > 0) & (share < 1)):
        if open_ < 0:
            open_ = i
            continue
        a, b, x, y = share[open_], share[i], float(size[open_]), float(size[i])
        to_first, to_second = min((1 - a) * x, b * y), min(a * x, (1 - b) * y)
        if draw[i] * (to_first + to_second) < to_second:  # the expected move is zero
            share[open_], share[i] = (1.0, b - to_first / y) if (1 - a) * x <= b * y else (a + to_first / x, 0.0)
        else:
            share[open_], share[i] = (0.0, b + to_second / y) if a * x <= (1 - b) * y else (a - to_second / x, 1.0)
        for j in (open_, i):
            share[j] = min(1.0, max(0.0, share[j]))
        open_ = open_ if 0 < share[open_] < 1 else i if 0 < share[i] < 1 else -1
    return share


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, fan_in: int = FAN_IN, keep: tuple[str, ...] = ("doc_id",), draw: str | None = None) -> DataFrame:
    """The columns in keep, and source, size, source_size, target, copies (how often the mix takes the document).

    draw: a column of numbers that decides the draws; without it the text and the columns in keep do.
    """
    given = docs.select(*(F.col(c).alias(f"keep_{c}") for c in keep), F.col("source").cast("string").alias("source"), word_count("text").alias("size"), (F.xxhash64(F.lit(seed), draw) if draw else F.xxhash64(F.lit(seed), F.xxhash64("text"), *keep)).alias("key"))
    sized = cut_lineage(given)
    sources = cut_lineage(source_targets(sized, weights, max_epochs))
    most = sources.agg(F.max("source_docs")).first()[0] or 0
    rows = sized.withColumnRenamed("source", "own").join(sources, F.col("own").eqNullSafe(F.col("source")), "inner").drop("own")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_epochs)))).otherwise(0.0)
    rows = rows.withColumn("whole", F.when(F.col("size") > 0, F.floor(ratio)).otherwise(0).cast("int"))
    rows = rows.withColumn("share", F.when(F.col("size") > 0, ratio - F.col("whole")).otherwise(0.0))
    rows = rows.withColumn("bucket", F.pmod("key", F.ceil(F.col("source_docs") / bucket_rows))).drop("source_docs")
    schema = rows.schema

    def bucket(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "size", *(f"keep_{c}" for c in keep)], kind="stable", ignore_index=True)
        draw = np.random.default_rng(abs(int(group["key"].iloc[0])) + int(group["bucket"].iloc[0])).random(len(group))
        return group.assign(share=meet(group["size"].to_numpy(), group["share"].to_numpy(), draw))

    open_ = (F.col("share") > 0) & (F.col("share") < 1)
    level = cut_lineage(rows.groupBy("place", "bucket").applyInPandas(bucket, schema))
    done = level.filter(~open_)
    buckets = max(1, math.ceil(most / bucket_rows))
    while buckets > 1:
        buckets = math.ceil(buckets / fan_in)
        level = cut_lineage(level.filter(open_).withColumn("bucket", F.floor(F.col("bucket") / fan_in)).groupBy("place", "bucket").applyInPandas(bucket, schema))
        done = done.unionByName(level.filter(~open_))
    last = F.pmod(F.xxhash64(F.lit(seed), "key", "place"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    done = done.unionByName(level.filter(open_).withColumn("share", last.cast("double")))
    return done.select(*(F.col(f"keep_{c}").alias(c) for c in keep), "source", "size", "source_size", "target", (F.col("whole") + F.col("share").cast("int")).alias("copies"))


def drawn_by_content(placed: DataFrame, number: str, draw: str) -> DataFrame:
    """A number for each row from its id, text and source and, where rows are equal in these, from its place among them by all its columns.

    So it doesn't matter which row has which number, nor which columns there are besides. Only rows that occur more than once are ranked.
    """
    own = [c for c in ("doc_id", "text", "source") if c in placed.columns]
    content = placed.select(number, row_hash(placed.select(*own)).alias(draw), row_hash(placed.drop(number)).alias("whole"))
    again = content.groupBy(draw).agg(F.count("*").alias("n")).filter("n > 1").select(draw)
    ranked = content.join(again, draw, "left_semi").select(number, F.row_number().over(W.partitionBy(draw).orderBy("whole", number)).alias("rank"))
    return content.select(number, draw).join(ranked, number, "left").select(number, F.xxhash64(draw, F.coalesce("rank", F.lit(1))).alias(draw))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with their own columns, whatever their names.

    The documents are written down once with their number, and all steps read that table. Draws depend on the content of
    a row, and for rows equal in all columns on their count, so that the result is the same however the input is split.
    """
    number, copies, turn, draw = (free_name(docs, f"mix_{x}") for x in ("row", "copies", "turn", "draw"))
    placed = cut_lineage(docs.withColumn(number, F.monotonically_increasing_id()))
    drawn = placed.select(number, "source", "text").join(drawn_by_content(placed, number, draw), number)
    taken = mix(drawn, keep=(number,), draw=draw, **options).filter("copies > 0").select(number, F.col("copies").alias(copies))
    # The few bytes of copies are the side that is built, whatever the size: documents are shuffled once and not sorted.
    return placed.join(taken.hint("shuffle_hash"), number).withColumn(turn, F.explode(F.sequence(F.lit(1), copies))).drop(number, copies, turn)


def op5_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
