"""Cost weights of the items of a job: shares of its total that add up to 100 exactly.

Costs are whole cents and weights whole steps of the grid (at dp decimals 100 * 10^dp steps are 100 %), so all results are
exact. Totals come from a groupBy joined back rather than a window over the whole job, so one huge job costs no huge
task. The steps left over are a fixed number at most (the grid's), so only so many rows of a job are ranked: the last that
gets a step is found among them, and rows are compared with it. Null costs count as zero; jobs without cost get zero
weights; ids are unique in a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def job_totals(items: DataFrame, job: str = "job_id", cost: str = "cost_cents") -> DataFrame:
    """job and total_cents."""
    return items.groupBy(job).agg(F.coalesce(F.sum(F.coalesce(cost, F.lit(0))), F.lit(0)).alias("total_cents"))


def with_totals(items: DataFrame, job: str = "job_id", cost: str = "cost_cents") -> DataFrame:
    return items.join(job_totals(items, job, cost), job)


def raw_weights(items: DataFrame, job: str = "job_id", cost: str = "cost_cents") -> DataFrame:
    """weight: cost over total in percent, not rounded; 0 without a total."""
    return with_totals(items, job, cost).withColumn("weight", F.when(F.col("total_cents") > 0, F.col(cost) * 100 / F.col("total_cents")).otherwise(F.lit(0.0)).cast("double"))


def _with_first(df: DataFrame, job: str, key: Column, n: Column, most: int) -> DataFrame:
    """df with `among`: whether a row is one of the first n (most at most) of its job in the order of key."""
    ranked = df.filter(n > 0).select(job, key.alias("last"), n.alias("take")).withColumn("place", F.row_number().over(W.partitionBy(job).orderBy("last"))).filter(F.col("place") <= most)
    return df.join(ranked.filter("place = take").select(job, "last"), job, "left").withColumn("among", F.coalesce(key <= F.col("last"), F.lit(False))).drop("last")


def largest_remainder(items: DataFrame, dp: int = 2, job: str = "job_id", item: str = "item_id", cost: str = "cost_cents") -> DataFrame:
    """weight_steps: floors, and one step more for the largest remainders (ties in item order) until the sum is 100 %."""
    full = 100 * 10**dp
    share = F.coalesce(F.col(cost), F.lit(0)) * F.lit(full)
    total = F.when(F.col("total_cents") > 0, F.col("total_cents"))
    df = with_totals(items, job, cost).withColumn("floor_steps", F.coalesce(F.expr(f"coalesce({cost}, 0) * {full} div nullif(total_cents, 0)"), F.lit(0)))
    df = df.withColumn("rest", F.coalesce(share % total, F.lit(0)))
    short = df.groupBy(job).agg((F.lit(full) - F.sum("floor_steps")).alias("short"), F.max("total_cents").alias("all"))
    df = df.join(short.select(job, F.when(F.col("all") > 0, F.col("short")).otherwise(0).alias("short")), job)
    df = _with_first(df, job, F.struct(-F.col("rest"), F.col(item)), F.col("short"), full)
    return df.withColumn("weight_steps", (F.col("floor_steps") + F.col("among").cast("long")).cast("long")).drop("floor_steps", "rest", "short", "among")


def nearest_then_adjust(items: DataFrame, dp: int = 1, job: str = "job_id", item: str = "item_id", cost: str = "cost_cents") -> DataFrame:
    """weight_steps by the other rule: each share is rounded half up; missing steps go to the items whose rounding took most
    away, surplus ones are taken from those whose rounding gave least; ties by the id as text.

    Surplus steps go by the signed distance alone, so an item without cost can end at one step below zero. Only items with half
    a step or more are rounded up, so 100 % in steps is the most that is missing and the most that is over.
    """
    full = 100 * 10**dp
    own = F.coalesce(F.col(cost), F.lit(0))
    df = with_totals(items, job, cost).filter(F.col("total_cents").isNotNull())
    df = df.withColumn("steps", F.when(F.col("total_cents") > 0, F.expr(f"(2 * coalesce({cost}, 0) * {full} + total_cents) div nullif(2 * total_cents, 0)")).otherwise(F.lit(0)))
    # exact distance to the rounded value, in parts of the total: cost * full - steps * total
    df = df.withColumn("gap", own * full - F.col("steps") * F.col("total_cents"))
    off = df.groupBy(job).agg((F.lit(full) - F.sum("steps")).alias("off"), F.max("total_cents").alias("all"))
    df = df.join(off.select(job, F.when(F.col("all") > 0, F.col("off")).otherwise(0).alias("off")), job)
    toward = F.when(F.col("off") > 0, -F.col("gap")).otherwise(F.col("gap"))
    df = _with_first(df, job, F.struct(toward, F.col(item).cast("string")), F.abs("off"), full)
    add = F.signum("off").cast("long") * F.col("among").cast("long")
    return df.withColumn("weight_steps", (F.col("steps") + add).cast("long")).drop("steps", "gap", "off", "among")


def round_percentages(items: DataFrame, percent: str, dp: int = 2, job: str = "job_id", item: str = "item_id", cost: str = "cost_cents", scale: int = 1000) -> DataFrame:
    """Given percentages (whole parts of 1/scale of the grid's step): floors, and leftover steps by remainder, value and cost.

    More leftover steps than items go round again; a sum over 100 is left alone; a zero sum gives zeros.
    """
    full = 100 * 10**dp
    df = items.withColumn("floor_steps", F.floor(F.col(percent) / scale)).withColumn("rest", F.col(percent) % scale)
    sums = df.groupBy(job).agg(F.sum(percent).alias("all"), F.greatest(F.lit(0), F.lit(full) - F.sum("floor_steps")).alias("short"), F.count("*").alias("n"))
    df = _with_first(df.join(sums, job), job, F.struct(-F.col("rest"), -F.col(percent), -F.coalesce(F.col(cost), F.lit(-1)), F.col(item)), F.col("short") % F.col("n"), full)
    more = F.expr("short div n") + F.col("among").cast("long")
    return df.withColumn("weight_steps", F.when(F.col("all") == 0, F.lit(0)).otherwise(F.col("floor_steps") + more).cast("long")).drop("floor_steps", "rest", "all", "short", "n", "among")


def normalize_on_largest(items: DataFrame, steps: str, dp: int = 2, job: str = "job_id", item: str = "item_id") -> DataFrame:
    """normal_steps: the gap to 100 % is put on the largest weight (ties in item order), all within 0 and 100 %."""
    full = 100 * 10**dp
    # the largest is a minimum with the gap's own sum: one partial aggregate, no window over a job
    gap = items.groupBy(job).agg((F.lit(full) - F.sum(steps)).alias("gap"), F.min_by(item, F.struct(-F.coalesce(F.col(steps), F.lit(-(1 << 62))), F.col(item))).alias("largest"))
    value = F.col(steps) + F.when(F.col(item) == F.col("largest"), F.col("gap")).otherwise(0)
    return items.join(gap, job).withColumn("normal_steps", F.greatest(F.lit(0), F.least(F.lit(full), value)).cast("long")).drop("gap", "largest")


def first_cost(*columns: str) -> Column:
    """The first of the columns that is neither null nor blank, as a number; 0 if there is none or it isn't one."""
    return F.coalesce(F.coalesce(*(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in columns)).try_cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))


def top_n(items: DataFrame, n: int = 3, by: str = "weight_steps", job: str = "job_id", item: str = "item_id") -> DataFrame:
    """The n largest of each job, with their place; ties in item order."""
    return items.withColumn("place", F.row_number().over(W.partitionBy(job).orderBy(F.col(by).desc(), item))).filter(F.col("place") <= n)


def highest_item(jobs: DataFrame, items: DataFrame, by: str = "weight_steps", job: str = "job_id", item: str = "item_id", total: str = "total_cents") -> DataFrame:
    """Every job with its largest item; null where the job has no items or no cost. One partial aggregate, no window."""
    best = items.filter(F.col(total) > 0).groupBy(job).agg(F.max_by(item, F.struct(F.col(by), -F.col(item))).alias("top_item"), F.max(by).alias("top_steps"))
    return jobs.join(best, job, "left")


def chart_series(items: DataFrame, name: str, steps: str, dp: int = 1, from_dp: int = 2, job: str = "job_id", item: str = "item_id") -> DataFrame:
    """label (the name, or the id where it's blank), value (steps of from_dp rounded half up to dp decimals) and place by value."""
    ratio = 10 ** (from_dp - dp)
    out = items.withColumn("label", F.coalesce(F.nullif(F.trim(name), F.lit("")), F.col(item).cast("string"))).withColumn("value", F.floor((F.col(steps) + ratio // 2) / ratio).cast("long"))
    return out.withColumn("place", F.row_number().over(W.partitionBy(job).orderBy(F.col("value").desc(), item)))
