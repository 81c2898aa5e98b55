"""Registration of queries, and the roles that the given tables play in them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Items of jobs: an id that is unique and the same in every engine, money in cents.
ITEMS = """SELECT l_orderkey AS job_id, l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
 l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS item_id, l_partkey AS part_id, l_suppkey AS supp_id, l_linenumber AS line,
 CAST(round(l_extendedprice * 100) AS BIGINT) AS cost_cents, CAST(l_quantity AS BIGINT) AS quantity, CAST(round(l_discount * 100) AS BIGINT) AS discount,
 l_returnflag AS flag, l_linestatus AS status FROM {lineitem}"""
#: The catalogue of works: code, name, unit and price in cents.
CATALOG = """SELECT p_partkey AS id, 'AT.' || CAST(p_partkey AS STRING) || '-' || substr(p_brand, 7) AS code, p_name AS name, lower(p_type) AS unit,
 CAST(round(p_retailprice * 100) AS BIGINT) AS price_cents FROM {part}"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ITEMS, lineitem=table(spark, sf_dir, "lineitem"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CATALOG, part=table(spark, sf_dir, "part"))


def duck(sql: str) -> str:
    """DuckDB SQL with the roles as common table expressions."""
    return f"WITH RECURSIVE items AS ({ITEMS.format(lineitem='lineitem')}), catalog AS ({CATALOG.format(part='part')}), {sql.strip()[5:]}" if sql.strip().upper().startswith("WITH ") else f"WITH items AS ({ITEMS.format(lineitem='lineitem')}), catalog AS ({CATALOG.format(part='part')}) {sql}"


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = duck(sql)
        return f

    return register
