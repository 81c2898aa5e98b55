"""Queries on prices, breakdowns and budgets."""

from pyspark.sql import functions as F

from kalkula.operators import breakdown as B
from kalkula.operators import pricing as P
from kalkula.operators import weights as O
from kalkula.plans.base import catalog, items, query, table

_ROWS = """SELECT item_id, part_id % 9 = 0 AS is_section, CASE WHEN part_id % 10 = 0 THEN 'skipped' ELSE 'found' END AS status, CASE WHEN part_id % 13 = 0 THEN ' ' ELSE 'work' END AS description,
 CASE line % 4 WHEN 0 THEN 'x' WHEN 1 THEN '-1' ELSE CAST(quantity AS STRING) END AS quantity, CASE part_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '-5' ELSE CAST(CAST(floor(cost_cents / 100) AS BIGINT) AS STRING) || '.' || lpad(CAST(cost_cents % 100 AS STRING), 2, '0') END AS unit_price,
 CASE WHEN part_id % 3 = 0 THEN ' ' ELSE 'AT.' || CAST(part_id AS STRING) END AS code FROM {items}"""


@query(f"""WITH r AS (SELECT item_id, code, coalesce(CASE WHEN try_cast(quantity AS DECIMAL(10,2)) > 0 THEN try_cast(quantity AS DECIMAL(10,2)) END, 1) AS q, coalesce(CASE WHEN try_cast(unit_price AS DECIMAL(18,2)) >= 0 THEN try_cast(unit_price AS DECIMAL(18,2)) END, 0) AS p FROM ({_ROWS.format(items='items')}) WHERE NOT is_section AND status <> 'skipped' AND trim(description) <> '')
SELECT item_id, (q * p * 100)::BIGINT AS cost_cents, nullif(trim(code), '') AS code FROM r""")
def build_job_items(spark, sf_dir):
    df = P.build_job_items(spark.sql(_ROWS, items=items(spark, sf_dir)))
    return df.select("item_id", (F.col("cost") * 100).cast("long").alias("cost_cents"), "code")


@query("""WITH e AS (SELECT user_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT item_id, coalesce(CASE WHEN e.event_type <> 'error' THEN round(e.value * 100)::BIGINT END, cost_cents) AS cost_cents FROM items LEFT JOIN e ON e.user_id = part_id AND k = 1""")
def apply_overrides(spark, sf_dir):
    changes = table(spark, sf_dir, "events").selectExpr("user_id as row_key", "struct(ts, event_id) as ts", "case when event_type <> 'error' then cast(round(value * 100) as bigint) end as cost_cents")
    rows = items(spark, sf_dir).selectExpr("item_id", "part_id as row_key", "cost_cents")
    return P.apply_overrides(rows, changes, ("cost_cents",)).select("item_id", "cost_cents")


_LIST = "SELECT canon AS code, price_cents * 2 AS price_cents FROM k WHERE id % 4 = 0"
_K = "k AS (SELECT *, regexp_replace(upper(code), '[-\\s/_]', '.', 'g') AS canon FROM catalog), works AS (SELECT upper(CASE id % 3 WHEN 0 THEN code WHEN 1 THEN replace(code, '.', '-') ELSE replace(replace(code, '.', ''), '-', '') END) AS v, price_cents FROM catalog WHERE id % 5 <> 0)"
_WANT = "w AS (SELECT item_id, part_id, quantity, line, cost_cents, CASE WHEN part_id % 11 = 0 THEN '' ELSE canon END AS canon FROM items JOIN k ON k.id = part_id)"
_KNOWN = f"""l AS ({_LIST}), t AS (SELECT DISTINCT canon, unnest([0, 1, 2, 3]) AS turn FROM w WHERE canon <> ''), d AS (SELECT canon, arg_min(price_cents, turn) AS db FROM (SELECT canon, turn, CASE turn WHEN 0 THEN canon WHEN 1 THEN replace(canon, '.', '-') WHEN 2 THEN replace(canon, '-', '.') ELSE replace(canon, '.', '') END AS v FROM t) JOIN works USING (v) GROUP BY 1),
p AS (SELECT w.*, coalesce(l.price_cents, d.db) AS known FROM w LEFT JOIN l ON l.code = w.canon LEFT JOIN d ON d.canon = w.canon)"""


def _looked_up(spark, sf_dir):
    from kalkula.functions.text import canonical_code

    cat = catalog(spark, sf_dir)
    listed = cat.filter("id % 4 = 0").select(canonical_code(F.col("code")).alias("code"), (F.col("price_cents") * 2).alias("price_cents"))
    works = cat.filter("id % 5 <> 0").select("id", "price_cents", F.expr("case id % 3 when 0 then code when 1 then replace(code, '.', '-') else replace(replace(code, '.', ''), '-', '') end").alias("code"))
    rows = items(spark, sf_dir).join(cat.select(F.col("id").alias("part_id"), F.lower("code").alias("code")), "part_id").withColumn("code", F.when(F.col("part_id") % 11 == 0, " ").otherwise(F.col("code")))
    return P.lookup_price(rows, listed, works)


@query(f"WITH {_K}, {_WANT}, {_KNOWN} SELECT item_id, known AS known_price FROM p")
def lookup_price(spark, sf_dir):
    return _looked_up(spark, sf_dir).select("item_id", "known_price")


@query(f"""WITH {_K}, {_WANT}, {_KNOWN}, g AS (SELECT *, CASE line % 3 WHEN 0 THEN known WHEN 1 THEN cost_cents END AS given FROM p)
SELECT item_id, coalesce(given, known) AS price, CASE WHEN given IS NOT NULL THEN CASE WHEN known <> given THEN 'Overridden' ELSE 'Provided' END WHEN known IS NOT NULL THEN 'Matched' ELSE 'Needs Manual Input' END AS status,
 NOT (given IS NULL AND known IS NOT NULL) AS editable, coalesce((quantity * 1005 * coalesce(given, known) + 500) // 1000, 0)::BIGINT AS total FROM g""")
def price_match(spark, sf_dir):
    df = _looked_up(spark, sf_dir).withColumn("unit_price", F.when(F.col("line") % 3 == 0, F.col("known_price")).when(F.col("line") % 3 == 1, F.col("cost_cents"))).withColumn("volume_milli", F.col("quantity") * 1005)
    return P.price_match(df).select("item_id", "price", "status", "editable", "total")


@query(f"WITH {_K}, {_WANT}, {_KNOWN} SELECT item_id, coalesce(((CASE WHEN line % 2 = 0 THEN 0 ELSE quantity * 1005 END) * coalesce(CASE WHEN line = 1 THEN cost_cents END, known) + 500) // 1000, 0)::BIGINT AS total FROM p")
def recompute_total(spark, sf_dir):
    df = _looked_up(spark, sf_dir).withColumn("unit_price", F.when(F.col("line") == 1, F.col("cost_cents"))).withColumn("volume_milli", F.when(F.col("line") % 2 == 1, F.col("quantity") * 1005))
    return P.recompute_total(df).select("item_id", "total")


@query("SELECT item_id, CASE WHEN line % 2 = 0 THEN price_cents END AS item_price FROM items LEFT JOIN catalog ON id = part_id AND id % 3 <> 0")
def resolve_item_price(spark, sf_dir):
    refs = items(spark, sf_dir).selectExpr("item_id", "cast(part_id as string) as itemable_id", "case when line % 2 = 0 then 'ItemPrice' else 'Other' end as itemable_type")
    return P.resolve_item_price(refs, catalog(spark, sf_dir).filter("id % 3 <> 0")).select("item_id", "item_price")


@query("""WITH t AS (SELECT item_id, regexp_replace(lower(name), '^([0-9]+|[ivxlcdm]+)\\s+', '') IN ('red widget', 'small ring') AS black, CASE WHEN line = 2 THEN 1 END AS custom, CASE WHEN part_id % 4 = 0 THEN '' ELSE 'c' END AS code FROM items JOIN catalog ON id = part_id)
SELECT item_id, CASE WHEN black THEN 'excluded' WHEN custom IS NOT NULL THEN 'adjustable' WHEN code <> '' THEN 'locked' ELSE 'adjustable' END AS adjustment_status, CASE WHEN black THEN 'name_blacklist' WHEN custom IS NOT NULL THEN 'custom_override' ELSE 'analysis_code' END AS reason FROM t""")
def classify_adjustable(spark, sf_dir):
    df = items(spark, sf_dir).join(catalog(spark, sf_dir).select(F.col("id").alias("part_id"), "name"), "part_id")
    df = df.selectExpr("item_id", "case when line % 3 = 0 then concat('IV. ', name) else name end as name", "case when line = 2 then 1 end as custom_id", "case when part_id % 4 = 0 then '' else 'c' end as code", "line = 1 as is_locked")
    return P.classify_adjustable(df, ("red widget", "small ring")).select("item_id", "adjustment_status", "reason")


_COMP = "SELECT item_id, job_id AS code, CASE line % 3 WHEN 0 THEN 'labor' WHEN 1 THEN 'equipment' ELSE 'material' END AS kind, CASE line % 3 WHEN 0 THEN part_id % 1500 WHEN 1 THEN supp_id ELSE part_id END AS component_id, CASE WHEN discount > 2 THEN quantity END AS quantity, CASE WHEN discount > 0 THEN CAST(discount AS BIGINT) END AS coefficient FROM {items}"
_CAT3 = """SELECT 'labor' AS kind, c_custkey AS id, c_name AS name, 'day' AS unit, CAST(round(abs(c_acctbal) * 100) AS BIGINT) AS unit_price, 'none' AS brand FROM {customer}
UNION ALL SELECT 'equipment', s_suppkey, s_name, 'hour', CASE WHEN s_suppkey % 7 <> 0 THEN CAST(round(abs(s_acctbal) * 100) AS BIGINT) END, 'none' FROM {supplier}
UNION ALL SELECT 'material', p_partkey, p_name, lower(p_type), CAST(round(p_retailprice * 100) AS BIGINT), p_brand FROM {part}"""
_LINES = f"comp AS ({_COMP.format(items='items')}), cat3 AS ({_CAT3.format(customer='customer', supplier='supplier', part='part')}), lines AS (SELECT item_id, code, comp.kind, component_id, name, unit, coalesce(quantity, coefficient, 0) AS amount, unit_price, CASE WHEN comp.kind = 'material' THEN brand END AS brand, coalesce(quantity, coefficient, 0) * unit_price AS line_total FROM comp LEFT JOIN cat3 ON cat3.kind = comp.kind AND cat3.id = component_id)"


def _lines(spark, sf_dir):
    cat = spark.sql(_CAT3, **{t: table(spark, sf_dir, t) for t in ("customer", "supplier", "part")})
    return B.breakdown_lines(spark.sql(_COMP, items=items(spark, sf_dir)), cat)


@query(f"WITH {_LINES} SELECT item_id, kind, name AS component_name, amount, unit_price, line_total, brand FROM lines")
def work_breakdown_lines(spark, sf_dir):
    return _lines(spark, sf_dir).select("item_id", "kind", "component_name", "amount", "unit_price", "line_total", "brand")


_TOTALS = "coalesce(sum(line_total) FILTER (kind = 'labor'), 0)::BIGINT AS labor, coalesce(sum(line_total) FILTER (kind = 'equipment'), 0)::BIGINT AS equipment, coalesce(sum(line_total) FILTER (kind = 'material'), 0)::BIGINT AS materials, coalesce(sum(line_total) FILTER (kind <> 'material'), 0)::BIGINT AS labor_equipment, coalesce(sum(line_total), 0)::BIGINT AS overall"


@query(f"WITH {_LINES} SELECT code, {_TOTALS} FROM lines GROUP BY 1")
def work_breakdown_totals(spark, sf_dir):
    return B.breakdown_totals(_lines(spark, sf_dir))


@query(f"WITH {_LINES}, e AS (SELECT code, kind, amount * unit_price + CASE WHEN code % 10 = 0 THEN 0 ELSE amount END AS line_total FROM lines WHERE code % 5 = 0), u AS (SELECT code, kind, line_total FROM lines WHERE code % 5 <> 0 UNION ALL SELECT * FROM e) SELECT code, {_TOTALS} FROM u GROUP BY 1")
def apply_breakdown_overrides(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    edits = lines.filter("code % 5 = 0").select("code", "kind", "component_id", "amount", F.expr("unit_price + case when code % 10 = 0 then 0 else 1 end").alias("unit_price"))
    return B.breakdown_totals(B.apply_breakdown_overrides(lines, edits))


_SHOP = "SELECT p_partkey AS id, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' extra' ELSE '' END AS name, p_type AS unit, CAST(round(p_retailprice * 100) AS BIGINT) - p_partkey % 97 AS price, 'shop' || CAST(p_partkey % 4 AS STRING) AS source, 'u' || CAST(p_partkey AS STRING) AS url FROM {part}"
_BRAND = "SELECT p_name AS material, p_type AS unit, p_brand AS brand, CAST(round(p_retailprice * 100) AS BIGINT) - 5 AS price FROM {part} WHERE p_partkey % 40 = 3"
_ALT = f"""shop AS ({_SHOP.format(part='part')}), brand AS ({_BRAND.format(part='part')}), probe AS (SELECT DISTINCT name, unit, price_cents AS price FROM catalog),
alt AS (SELECT p.*, s.name AS offer, s.price AS offer_price, s.source, s.url FROM probe p JOIN shop s ON lower(s.unit) = p.unit AND s.price < p.price AND len([w for w in [w for w in string_split(lower(p.name), ' ') if length(w) > 2][1:3] if NOT contains(lower(s.name), w)]) = 0
 UNION ALL SELECT p.*, b.brand, b.price, 'brand', '' FROM probe p JOIN brand b ON lower(b.unit) = p.unit AND lower(b.material) = lower(p.name) AND b.price < p.price)"""


def _sides(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return catalog(spark, sf_dir).withColumnRenamed("price_cents", "price"), spark.sql(_SHOP, part=part), spark.sql(_BRAND, part=part)


@query(f"WITH {_ALT} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, unit, price ORDER BY offer_price, source, offer, url) AS rank FROM alt) WHERE rank <= 5")
def cheaper_alternatives(spark, sf_dir):
    return B.cheaper_alternatives(*_sides(spark, sf_dir))


@query(f"WITH {_ALT} SELECT name, unit, price, offer, offer_price FROM alt WHERE source = 'brand'")
def brand_alternatives(spark, sf_dir):
    probes, _, brands = _sides(spark, sf_dir)
    return B.brand_alternatives(probes, brands).select("name", "unit", "price", "offer", "offer_price")


_OPT = f"""{_LINES}, {_ALT}, best AS (SELECT name, unit, price, min(offer_price) AS best FROM alt GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY line_total DESC, component_id) AS place FROM lines WHERE kind = 'material' AND unit_price IS NOT NULL AND amount <> 0),
sv AS (SELECT code, sum((unit_price - best) * amount)::BIGINT AS saving, count(*) AS swaps FROM rk JOIN best ON best.name = rk.name AND best.unit = rk.unit AND best.price = rk.unit_price WHERE place <= 2 AND best < unit_price GROUP BY 1),
opt AS (SELECT l.code, l.before, coalesce(saving, 0) AS saving, coalesce(swaps, 0) AS swaps, l.before - coalesce(saving, 0) AS after FROM (SELECT code, coalesce(sum(line_total), 0)::BIGINT AS before FROM lines GROUP BY 1) l LEFT JOIN sv ON sv.code = l.code)"""


def _optimized(spark, sf_dir):
    return B.optimize_materials(_lines(spark, sf_dir), B.cheaper_alternatives(*_sides(spark, sf_dir), limit=1))


@query(f"WITH {_OPT} SELECT * FROM opt")
def optimize_work_materials(spark, sf_dir):
    return _optimized(spark, sf_dir)


@query(f"""WITH {_OPT}, n AS (SELECT *, CASE WHEN code % 2 = 0 THEN before * 9525 // 10000 + CASE WHEN before * 9525 % 10000 > 5000 OR (before * 9525 % 10000 = 5000 AND before * 9525 // 10000 % 2 = 1) THEN 1 ELSE 0 END ELSE 50000000 END AS nominal FROM opt)
SELECT code, nominal::BIGINT AS nominal, before <= nominal AS met_before, after <= nominal AS met_after, greatest(0, after - nominal)::BIGINT AS gap FROM n""")
def budget_check(spark, sf_dir):
    df = _optimized(spark, sf_dir).withColumn("mode", F.when(F.col("code") % 2 == 0, "percentage").otherwise("absolute")).withColumn("target", F.when(F.col("code") % 2 == 0, 9525).otherwise(50_000_000).cast("long"))
    return P.budget_check(df, "before", "after").select("code", "nominal", "met_before", "met_after", "gap")


_FACTOR = "f AS (SELECT job_id, t * 10000 // c + CASE WHEN t * 10000 % c * 2 > c OR (t * 10000 % c * 2 = c AND t * 10000 // c % 2 = 1) THEN 1 ELSE 0 END AS factor FROM (SELECT job_id, sum(cost_cents)::BIGINT AS c, sum(cost_cents)::BIGINT // 3 + job_id AS t FROM items GROUP BY 1))"


def _factors(spark, sf_dir):
    return P.proportional_factor(O.job_totals(items(spark, sf_dir)).withColumn("target_cents", F.expr("total_cents div 3 + job_id")))


@query(f"WITH {_FACTOR} SELECT job_id, factor::BIGINT AS factor FROM f")
def proportional_factor(spark, sf_dir):
    return _factors(spark, sf_dir).select("job_id", "factor")


@query(f"WITH {_FACTOR} SELECT item_id, (cost_cents * factor)::BIGINT AS new_price, (cost_cents * factor * CASE WHEN line = 3 THEN 0 ELSE quantity END)::BIGINT AS new_total FROM items JOIN f USING (job_id)")
def scale_prices(spark, sf_dir):
    df = items(spark, sf_dir).withColumnRenamed("cost_cents", "price_cents").withColumn("quantity", F.when(F.col("line") != 3, F.col("quantity")))
    return P.scale_prices(df, _factors(spark, sf_dir)).select("item_id", "new_price", "new_total")
