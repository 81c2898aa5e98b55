"""Warnings and advice on the items of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def advice(item: Column, steps: Column) -> Column:
    """A sentence on the item with most weight (steps are hundredths of a percent); empty without one."""
    percent = F.concat(F.floor(steps / 100).cast("string"), F.lit("."), F.lpad((steps % 100).cast("string"), 2, "0"))
    return F.coalesce(F.concat(F.lit("Item "), item.cast("string"), F.lit(" has the highest cost weight ("), percent, F.lit("%). Consider reviewing it first.")), F.lit(""))


def availability(items: DataFrame, code: str = "code") -> DataFrame:
    """in_catalog: the item has a code that isn't blank."""
    return items.withColumn("in_catalog", F.coalesce(F.trim(code) != "", F.lit(False)))


def matched_availability(items: DataFrame, matches: DataFrame, item: str = "item_id") -> DataFrame:
    """in_catalog: some match is known for the item."""
    known = matches.select(item).distinct().withColumn("known", F.lit(True))
    return items.join(known, item, "left").withColumn("in_catalog", F.coalesce("known", F.lit(False))).drop("known")


def first_match(items: DataFrame, matches: DataFrame, item: str = "item_id", order: str = "rank") -> DataFrame:
    """match_code, match_price and in_catalog of the item's first match."""
    first = matches.groupBy(item).agg(F.min_by(F.struct("code", "price_cents"), order).alias("first"))
    out = items.join(first, item, "left")
    return out.withColumn("match_code", F.col("first.code")).withColumn("match_price", F.col("first.price_cents")).withColumn("in_catalog", F.col("first").isNotNull()).drop("first")


def missing_notifications(items: DataFrame, job: str = "job_id", name: str = "name") -> DataFrame:
    """One message for each different name not in the catalogue: job, kind, message. Duplicates go before messages are made."""
    gone = items.filter(~F.col("in_catalog")).select(job, name).distinct()
    return gone.select(job, F.lit("NOT_IN_CATALOG").alias("kind"), F.concat(F.lit("Item '"), F.col(name), F.lit("' is not in the catalogue.")).alias("message"))


def duplicate_stats(df: DataFrame, job: str, keys: list[str]) -> DataFrame:
    """has_duplicates and how many keys occur more than once, per job."""
    n = df.groupBy(job, *keys).agg(F.count("*").alias("n"))
    return n.groupBy(job).agg(F.max(F.col("n") > 1).alias("has_duplicates"), F.sum((F.col("n") > 1).cast("long")).alias("duplicate_keys"))


def warning_summary(items: DataFrame, warnings: DataFrame, job: str = "job_id") -> DataFrame:
    """items, distinct warnings, ratio (three decimals, half even), level and label per job."""
    n = items.groupBy(job).agg(F.count("*").alias("n_items"))
    w = warnings.groupBy(job).agg(F.countDistinct("kind", "message").alias("n_warnings"))
    out = n.join(w, job, "left").withColumn("n_warnings", F.coalesce("n_warnings", F.lit(0)))
    ratio = F.when(F.col("n_items") > 0, F.col("n_warnings") / F.col("n_items")).otherwise(0.0)
    level = F.when(F.col("n_warnings") == 0, "NONE").when(ratio >= 0.5, "CRITICAL").otherwise("WARN")
    out = out.withColumn("ratio", F.bround(ratio, 3)).withColumn("level", level)
    return out.withColumn("label", F.when(F.col("level") == "NONE", F.lit("No warnings")).otherwise(F.concat(F.col("n_warnings").cast("string"), F.lit(" of "), F.col("n_items").cast("string"), F.lit(" items"))))


def price_deviations(items: DataFrame, actual: str, reference: str, threshold: int = 10, job: str = "job_id", item: str = "item_id") -> DataFrame:
    """Deviation from the reference price in percent, three decimals half even (deviation_milli: in thousandths), where it exceeds the threshold.

    Prices are whole cents, rows without a positive reference are skipped; rank: by size within the job.
    """
    df = items.filter(F.col(reference) > 0).withColumn("scaled", (F.col(actual) - F.col(reference)) * 100_000)
    quotient, rest = F.abs(F.expr(f"abs(scaled) div {reference}")), F.expr(f"abs(scaled) % {reference}")
    up = (rest * 2 > F.col(reference)) | ((rest * 2 == F.col(reference)) & (quotient % 2 == 1))
    size = quotient + up.cast("long")
    df = df.withColumn("deviation_milli", F.when(F.col("scaled") < 0, -size).otherwise(size)).withColumn("exact", F.abs(F.col("scaled")))
    df = df.filter(F.abs("deviation_milli") > threshold * 1000)
    level = F.when(F.abs("deviation_milli") > 50_000, "CRITICAL").when(F.abs("deviation_milli") > 20_000, "HIGH").otherwise("MODERATE")
    way = F.when(F.col("deviation_milli") > 0, "above").otherwise("below")
    number = F.concat(F.expr("abs(deviation_milli) div 1000").cast("string"), F.lit("."), F.lpad((F.abs("deviation_milli") % 1000).cast("string"), 3, "0"))
    df = df.withColumn("level", level).withColumn("message", F.concat(F.lit("Price is "), number, F.lit("% "), way, F.lit(" the reference")))
    return df.withColumn("rank", F.row_number().over(W.partitionBy(job).orderBy(F.abs("deviation_milli").desc(), item)).cast("long")).drop("scaled", "exact")


def deviation_report(items: DataFrame, deviations: DataFrame, actual: str, reference: str, job: str = "job_id") -> DataFrame:
    """Per job: items checked (price and reference known and positive) and deviations found."""
    checked = items.groupBy(job).agg(F.sum(((F.col(actual) > 0) & (F.col(reference) > 0)).cast("long")).alias("n_checked"))
    found = deviations.groupBy(job).agg(F.count("*").alias("n_found"))
    return checked.join(found, job, "left").select(job, F.coalesce("n_checked", F.lit(0)).alias("n_checked"), F.coalesce("n_found", F.lit(0)).alias("n_found"))


def job_health(jobs: DataFrame, items: DataFrame, job: str = "job_id", cost: str = "cost_cents") -> DataFrame:
    """health of every job: no items, no cost, or ok."""
    sums = items.groupBy(job).agg(F.count("*").alias("n"), F.sum(cost).alias("total"))
    state = F.when(F.col("n").isNull(), "The job has no items.").when(F.coalesce("total", F.lit(0)) == 0, "The job has no cost.").otherwise("ok")
    return jobs.join(sums, job, "left").withColumn("health", state).drop("n", "total")
