"""Queries on cost weights."""

from pyspark.sql import functions as F

from kalkula.operators import weights as O
from kalkula.plans.base import items, query

_LR = """lr AS (SELECT job_id, item_id, part_id, cost_cents, total, CASE WHEN total > 0 THEN f + CASE WHEN row_number() OVER (PARTITION BY job_id ORDER BY r DESC, item_id) <= 10000 - sum(f) OVER (PARTITION BY job_id) THEN 1 ELSE 0 END ELSE 0 END AS steps
 FROM (SELECT *, cost_cents * 10000 // total AS f, cost_cents * 10000 % total AS r FROM (SELECT *, sum(cost_cents) OVER (PARTITION BY job_id)::BIGINT AS total FROM items)))"""


@query("SELECT job_id, sum(cost_cents)::BIGINT AS total_cents, count(*) AS n_items FROM items GROUP BY 1")
def job_totals(spark, sf_dir):
    df = items(spark, sf_dir)
    return O.job_totals(df).join(df.groupBy("job_id").agg(F.count("*").alias("n_items")), "job_id")


@query("SELECT item_id, cost_cents * 100 / sum(cost_cents) OVER (PARTITION BY job_id)::BIGINT AS weight FROM items")
def raw_weights(spark, sf_dir):
    return O.raw_weights(items(spark, sf_dir)).select("item_id", "weight")


@query(f"WITH {_LR} SELECT job_id, item_id, steps::BIGINT AS weight_steps FROM lr")
def cost_weights(spark, sf_dir):
    return O.largest_remainder(items(spark, sf_dir)).select("job_id", "item_id", "weight_steps")


@query("""WITH s AS (SELECT *, (2 * cost_cents * 1000 + total) // (2 * total) AS steps FROM (SELECT *, sum(cost_cents) OVER (PARTITION BY job_id)::BIGINT AS total FROM items)),
g AS (SELECT *, cost_cents * 1000 - steps * total AS gap, 1000 - sum(steps) OVER (PARTITION BY job_id) AS away FROM s)
SELECT item_id, (steps + CASE WHEN away > 0 THEN CASE WHEN row_number() OVER (PARTITION BY job_id ORDER BY gap DESC, item_id::VARCHAR) <= away THEN 1 ELSE 0 END
 ELSE CASE WHEN row_number() OVER (PARTITION BY job_id ORDER BY gap, item_id::VARCHAR) <= -away THEN -1 ELSE 0 END END)::BIGINT AS weight_steps FROM g""")
def recalc_weights(spark, sf_dir):
    return O.nearest_then_adjust(items(spark, sf_dir)).select("item_id", "weight_steps")


@query("""WITH p AS (SELECT *, cost_cents * 10000000 // sum(cost_cents) OVER (PARTITION BY job_id)::BIGINT AS pct FROM items),
f AS (SELECT *, pct // 1000 AS fl, pct % 1000 AS r FROM p), s AS (SELECT *, greatest(0, 10000 - sum(fl) OVER (PARTITION BY job_id)) AS short, count(*) OVER (PARTITION BY job_id) AS n FROM f)
SELECT item_id, (fl + short // n + CASE WHEN row_number() OVER (PARTITION BY job_id ORDER BY r DESC, pct DESC, cost_cents DESC, item_id) <= short % n THEN 1 ELSE 0 END)::BIGINT AS weight_steps FROM s""")
def round_percentages(spark, sf_dir):
    df = O.with_totals(items(spark, sf_dir)).withColumn("percent", F.expr("cost_cents * 10000000 div total_cents"))
    return O.round_percentages(df, "percent").select("item_id", "weight_steps")


@query("""WITH w AS (SELECT *, (2 * cost_cents * 10000 + total) // (2 * total) AS steps FROM (SELECT *, sum(cost_cents) OVER (PARTITION BY job_id)::BIGINT AS total FROM items))
SELECT item_id, greatest(0, least(10000, steps + CASE WHEN row_number() OVER (PARTITION BY job_id ORDER BY steps DESC, item_id) = 1 THEN 10000 - sum(steps) OVER (PARTITION BY job_id) ELSE 0 END))::BIGINT AS normal_steps FROM w""")
def normalize_weights(spark, sf_dir):
    df = O.with_totals(items(spark, sf_dir)).withColumn("steps", F.expr("(2 * cost_cents * 10000 + total_cents) div (2 * total_cents)"))
    return O.normalize_on_largest(df, "steps").select("item_id", "normal_steps")


@query("""SELECT item_id, (coalesce(CASE WHEN line % 3 = 0 THEN cost_cents END, CASE WHEN line % 3 = 1 THEN quantity END, 0) * 100)::BIGINT AS value FROM items""")
def cost_from_fallbacks(spark, sf_dir):
    df = items(spark, sf_dir).selectExpr("item_id", "case when line % 3 = 0 then cast(cost_cents as string) when line % 3 = 1 then ' ' end as total_cost", "case when line % 3 = 1 then cast(quantity as string) else '' end as cost", "cast(null as string) as price")
    return df.select("item_id", (O.first_cost("total_cost", "cost", "price") * 100).cast("long").alias("value"))


@query(f"""WITH {_LR} SELECT item_id, CASE WHEN item_id % 4 = 0 THEN item_id::VARCHAR ELSE 'work ' || part_id END AS label, ((steps + 5) // 10)::BIGINT AS value,
 row_number() OVER (PARTITION BY job_id ORDER BY (steps + 5) // 10 DESC, item_id) AS place FROM lr""")
def chart_series(spark, sf_dir):
    df = O.largest_remainder(items(spark, sf_dir)).withColumn("name", F.expr("case when item_id % 4 = 0 then ' ' else concat('work ', part_id) end"))
    return O.chart_series(df, "name", "weight_steps").select("item_id", "label", "value", F.col("place").cast("long").alias("place"))


@query("SELECT job_id, item_id, cost_cents, row_number() OVER (PARTITION BY job_id ORDER BY cost_cents DESC, item_id) AS place FROM items")
def items_by_cost(spark, sf_dir):
    df = O.top_n(items(spark, sf_dir), n=1 << 30, by="cost_cents")
    return df.select("job_id", "item_id", "cost_cents", F.col("place").cast("long").alias("place"))


@query(f"WITH {_LR} SELECT * FROM (SELECT job_id, item_id, steps::BIGINT AS weight_steps, row_number() OVER (PARTITION BY job_id ORDER BY steps DESC, item_id) AS place FROM lr) WHERE place <= 3")
def top_contributors(spark, sf_dir):
    return O.top_n(O.largest_remainder(items(spark, sf_dir))).select("job_id", "item_id", "weight_steps", F.col("place").cast("long").alias("place"))


def _highest(spark, sf_dir):
    from kalkula.plans.base import table

    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"))
    return O.highest_item(jobs, O.largest_remainder(items(spark, sf_dir)))


_HIGH = f"{_LR}, top AS (SELECT job_id, max(steps)::BIGINT AS top_steps, arg_min(item_id, (-steps, item_id)) AS top_item FROM lr WHERE total > 0 GROUP BY 1), h AS (SELECT o_orderkey AS job_id, top_item, top_steps FROM orders LEFT JOIN top ON top.job_id = o_orderkey)"


@query(f"WITH {_HIGH} SELECT * FROM h")
def highest_item(spark, sf_dir):
    return _highest(spark, sf_dir).select("job_id", "top_item", "top_steps")


@query(f"""WITH {_HIGH} SELECT job_id, CASE WHEN top_item IS NULL THEN '' ELSE 'Item ' || top_item || ' has the highest cost weight (' || top_steps // 100 || '.' || lpad((top_steps % 100)::VARCHAR, 2, '0') || '%). Consider reviewing it first.' END AS advice FROM h""")
def recommendation_text(spark, sf_dir):
    from kalkula.operators.recommend import advice

    return _highest(spark, sf_dir).select("job_id", advice(F.col("top_item"), F.col("top_steps")).alias("advice"))
