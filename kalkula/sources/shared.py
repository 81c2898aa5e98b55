"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df under spark.checkpoint.dir (our own folder where it is unset and the master is local) and read it again.

    What several branches of a plan use is then computed once, and a lost executor costs nothing of it.
    """
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="kalkula-checkpoints-")
        spark.sparkContext.setCheckpointDir(at)
    path = f"{at.rstrip('/')}/kalkula-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt out to all shuffle partitions, which adaptive execution doesn't put together: for rows that are few in bytes and much work each."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def fan_out(many: DataFrame, few: DataFrame, key: str, at_once: int = 1 << 22) -> DataFrame:
    """many and few joined by key. A key with more than so many pairs is dealt out to several tasks, each of which gets all of few's rows of it."""
    counts = many.groupBy(key).agg(F.count("*").alias("n")).join(few.groupBy(key).agg(F.count("*").alias("m")), key)
    tasks = 4 * int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = F.least(F.lit(tasks), F.ceil(F.col("n").cast("double") * F.col("m") / at_once)).cast("int").alias("salts")
    hot = cut_lineage(counts.select(key, salts).filter("salts > 1"))
    one = many.join(hot, key, "left").withColumn("salt", F.pmod(F.xxhash64(*many.columns), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    all_ = few.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return spread(one, key, "salt").join(all_, [key, "salt"]).drop("salt")
