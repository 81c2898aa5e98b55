"""Rows keep their number when the splits of the input change between two reads of it."""

import pytest
from pyspark.sql import functions as F

from kalkula.llm import mixing, resemblance, simhash
from tests.llm.fixtures import SCHEMA

KEY = "spark.sql.files.openCostInBytes"


@pytest.fixture
def shuffled_splits(spark, tmp_path):
    """Many small files, read in few splits now and in one split each after `change`."""
    rows = [(i, f"text {i} " + " ".join(f"w{i}x{j}" for j in range(20 + i % 7)), "en", "ab"[i % 2], 1, "x") for i in range(120)]
    rows += [(1000 + i, rows[i][1], "en", "ab"[i % 2], 1, "x") for i in range(0, 120, 3)]
    at = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, SCHEMA).repartition(24).write.parquet(at)
    was = spark.conf.get(KEY)
    spark.conf.set(KEY, "1k")
    docs = spark.read.parquet(at)
    few = docs.rdd.getNumPartitions()

    def change():
        spark.conf.set(KEY, "512m")
        assert spark.read.parquet(at).rdd.getNumPartitions() != few

    yield docs, rows, change
    spark.conf.set(KEY, was)


def test_near_duplicates(shuffled_splits, monkeypatch):
    docs, rows, change = shuffled_splits
    find = simhash.near_duplicates

    def then_change(*args, **options):
        from kalkula.llm.common import cut_lineage

        found = cut_lineage(find(*args, **options))
        change()
        return found

    monkeypatch.setattr(simhash, "near_duplicates", then_change)
    got = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect())
    assert got == sorted(r[0] for r in rows if r[0] < 1000)


def test_mix(shuffled_splits, monkeypatch):
    docs, rows, change = shuffled_splits
    mix, taken = mixing.mix, []

    def then_change(placed, **options):
        from kalkula.llm.common import cut_lineage

        found = cut_lineage(mix(placed, **options))
        ids = docs.sparkSession.read.schema("doc_id long, mix_row long").parquet(*placed.select("mix_row").inputFiles()).join(found.filter("copies > 0"), "mix_row").collect()
        taken.extend(sorted(r["doc_id"] for r in ids for _ in range(r["copies"])))
        change()
        return found

    monkeypatch.setattr(mixing, "mix", then_change)
    assert sorted(r["doc_id"] for r in mixing.apply_mix(docs).collect()) == taken


def bag(df):
    return sorted(tuple(map(repr, r)) for r in df.collect())


def test_results_do_not_depend_on_splits(shuffled_splits, spark):
    """Equal ids with other columns, and rows that are equal in all columns, among them."""
    docs, _, change = shuffled_splits
    docs = docs.unionByName(docs.filter("doc_id % 5 = 0").withColumn("lang", F.lit("de"))).unionByName(docs.filter("doc_id % 4 = 0")).unionByName(docs.filter("doc_id % 8 = 0"))
    first = bag(mixing.apply_mix(docs)), bag(resemblance.drop_near_duplicates(docs))
    change()
    docs = docs.repartition(7)
    assert (bag(mixing.apply_mix(docs)), bag(resemblance.drop_near_duplicates(docs))) == first
