"""Queries on warnings and advice."""

from pyspark.sql import functions as F

from kalkula.operators import recommend as O
from kalkula.plans.base import catalog, items, query, table

_NAMED = "n AS (SELECT *, CASE WHEN part_id % 5 = 0 THEN ' ' WHEN part_id % 7 = 0 THEN NULL ELSE 'AT.' || part_id END AS code, 'work ' || part_id AS name FROM items), a AS (SELECT *, coalesce(trim(code) <> '', false) AS in_catalog FROM n)"
_MSG = "m AS (SELECT DISTINCT job_id, 'NOT_IN_CATALOG' AS kind, 'Item ''' || name || ''' is not in the catalogue.' AS message FROM a WHERE NOT in_catalog)"


def _named(spark, sf_dir):
    code = "case when part_id % 5 = 0 then ' ' when part_id % 7 = 0 then null else concat('AT.', part_id) end as code"
    return items(spark, sf_dir).selectExpr("*", code, "concat('work ', part_id) as name")


@query(f"WITH {_NAMED} SELECT item_id, in_catalog FROM a")
def catalog_availability(spark, sf_dir):
    return O.availability(_named(spark, sf_dir)).select("item_id", "in_catalog")


@query("SELECT item_id, part_id % 3 = 0 AS in_catalog FROM items")
def matched_availability(spark, sf_dir):
    df = items(spark, sf_dir)
    found = df.join(catalog(spark, sf_dir).filter("id % 3 = 0"), F.col("part_id") == F.col("id")).select("item_id")
    return O.matched_availability(df, found.unionByName(found)).select("item_id", "in_catalog")


@query("""WITH m AS (SELECT item_id, code, price_cents, row_number() OVER (PARTITION BY item_id ORDER BY c.id) AS k FROM items JOIN catalog c ON c.id IN (part_id, part_id + 1) AND c.id % 3 <> 0)
SELECT items.item_id, m.code AS match_code, m.price_cents AS match_price, m.code IS NOT NULL AS in_catalog FROM items LEFT JOIN m ON m.item_id = items.item_id AND k = 1""")
def match_to_catalog_columns(spark, sf_dir):
    df = items(spark, sf_dir)
    wanted = df.select("item_id", F.explode(F.array("part_id", F.col("part_id") + 1)).alias("id"))
    matches = wanted.join(catalog(spark, sf_dir).filter("id % 3 <> 0"), "id").select("item_id", "code", "price_cents", F.col("id").alias("rank"))
    return O.first_match(df, matches).select("item_id", "match_code", "match_price", "in_catalog")


@query(f"WITH {_NAMED}, {_MSG} SELECT * FROM m")
def missing_item_notifications(spark, sf_dir):
    return O.missing_notifications(O.availability(_named(spark, sf_dir)))


@query("WITH k AS (SELECT job_id, flag, status, count(*) AS n FROM items GROUP BY ALL) SELECT job_id, bool_or(n > 1) AS has_duplicates, sum((n > 1)::BIGINT)::BIGINT AS duplicate_keys FROM k GROUP BY 1")
def duplicate_stats(spark, sf_dir):
    return O.duplicate_stats(items(spark, sf_dir), "job_id", ["flag", "status"])


@query(f"""WITH {_NAMED}, {_MSG}, c AS (SELECT a.job_id, count(*) AS n_items, coalesce(any_value(w.n), 0) AS n_warnings FROM a LEFT JOIN (SELECT job_id, count(*) AS n FROM m GROUP BY 1) w ON w.job_id = a.job_id GROUP BY 1)
SELECT job_id, n_items, n_warnings, round_even(n_warnings / n_items, 3) AS ratio, CASE WHEN n_warnings = 0 THEN 'NONE' WHEN n_warnings / n_items >= 0.5 THEN 'CRITICAL' ELSE 'WARN' END AS level,
 CASE WHEN n_warnings = 0 THEN 'No warnings' ELSE n_warnings || ' of ' || n_items || ' items' END AS label FROM c""")
def warning_summary(spark, sf_dir):
    df = O.availability(_named(spark, sf_dir))
    return O.warning_summary(df, O.missing_notifications(df))


_DEV = """p AS (SELECT item_id, job_id, cost_cents // quantity AS actual, price_cents AS ref FROM items JOIN catalog ON id = part_id), s AS (SELECT *, (actual - ref) * 100000 AS x FROM p WHERE ref > 0),
q AS (SELECT *, abs(x) // ref AS d, abs(x) % ref AS r FROM s), z AS (SELECT *, (d + CASE WHEN r * 2 > ref OR (r * 2 = ref AND d % 2 = 1) THEN 1 ELSE 0 END) * CASE WHEN x < 0 THEN -1 ELSE 1 END AS dev FROM q),
v AS (SELECT * FROM z WHERE abs(dev) > 10000)"""


def _priced(spark, sf_dir):
    df = items(spark, sf_dir).join(catalog(spark, sf_dir), F.col("part_id") == F.col("id"), "left")
    return df.selectExpr("item_id", "job_id", "cost_cents div quantity as actual", "price_cents as reference")


@query(f"""WITH {_DEV} SELECT item_id, dev AS deviation_milli, CASE WHEN abs(dev) > 50000 THEN 'CRITICAL' WHEN abs(dev) > 20000 THEN 'HIGH' ELSE 'MODERATE' END AS level,
 'Price is ' || abs(dev) // 1000 || '.' || lpad((abs(dev) % 1000)::VARCHAR, 3, '0') || '% ' || CASE WHEN dev > 0 THEN 'above' ELSE 'below' END || ' the reference' AS message,
 row_number() OVER (PARTITION BY job_id ORDER BY abs(dev) DESC, item_id) AS rank FROM v""")
def price_deviations(spark, sf_dir):
    return O.price_deviations(_priced(spark, sf_dir), "actual", "reference").select("item_id", "deviation_milli", "level", "message", "rank")


@query(f"""WITH {_DEV} SELECT p.job_id, count(*) FILTER (actual > 0 AND ref > 0) AS n_checked, coalesce(any_value(f.n), 0) AS n_found FROM p LEFT JOIN (SELECT job_id, count(*) AS n FROM v GROUP BY 1) f ON f.job_id = p.job_id GROUP BY 1""")
def price_deviation_report(spark, sf_dir):
    df = _priced(spark, sf_dir)
    return O.deviation_report(df, O.price_deviations(df, "actual", "reference"), "actual", "reference")


@query("SELECT o_orderkey AS job_id, CASE WHEN n IS NULL THEN 'The job has no items.' WHEN t = 0 THEN 'The job has no cost.' ELSE 'ok' END AS health FROM orders LEFT JOIN (SELECT job_id, count(*) AS n, sum(CASE WHEN job_id % 3 = 0 THEN 0 ELSE cost_cents END) AS t FROM items GROUP BY 1) i ON i.job_id = o_orderkey")
def boq_health(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"))
    df = items(spark, sf_dir).withColumn("cost_cents", F.when(F.col("job_id") % 3 == 0, 0).otherwise(F.col("cost_cents")))
    return O.job_health(jobs, df)
