"""Queries on readers, sinks and streams, over text as files would hold it."""

import uuid

from pyspark.sql import functions as F

from kalkula.operators import sheets as H
from kalkula.operators.weights import job_totals, largest_remainder
from kalkula.plans.base import items, query, table
from kalkula.plans.sheets import _CARRY, _ROWS, cells
from kalkula.sources import catalogs as S
from kalkula.sources.shared import cut_lineage
from kalkula.streaming import feeds

_PRICE = "CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING)"
_FILE = f"SELECT p_partkey AS file_order, CASE WHEN p_partkey % 17 = 0 THEN ' ' ELSE ' ' || CAST(p_partkey % 700 AS STRING) || ' ' END AS id, CASE WHEN p_partkey % 13 = 0 THEN ' ' ELSE 'at-' || CAST(p_partkey % 600 AS STRING) || ' 1' END AS code, p_name || ' ' AS name, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS unit, CASE WHEN p_partkey % 5 = 0 THEN 'n/a' ELSE {_PRICE} || '.50' END AS unit_price, p_brand AS brand FROM {{part}}"
_F = f"f AS ({_FILE.format(part='part')})"
_CODE = "regexp_replace(upper(trim(code)), '[-\\s/_]', '.', 'g')"


def _file(spark, sf_dir):
    return spark.sql(_FILE, part=table(spark, sf_dir, "part"))


@query(f"WITH {_F} SELECT trim(id) AS id, arg_max(trim(name), file_order) AS name, arg_max(coalesce(nullif(unit, ''), '?'), file_order) AS unit, arg_max(coalesce(try_cast(unit_price AS DECIMAL(20,2))::DOUBLE, -1), file_order) AS price, arg_max(brand, file_order) AS brand FROM f WHERE trim(id) <> '' GROUP BY 1")
def read_component_catalog(spark, sf_dir):
    df = S.read_component_catalog(_file(spark, sf_dir), ("brand",))
    return df.select("id", "name", F.coalesce("unit", F.lit("?")).alias("unit"), F.coalesce(F.col("unit_price").cast("double"), F.lit(-1.0)).alias("price"), "brand")


@query(f"WITH {_F} SELECT {_CODE} AS code, arg_max(trim(name), file_order) AS name, arg_max(coalesce(try_cast(unit_price AS DECIMAL(20,2))::DOUBLE, -1), file_order) AS price FROM f WHERE trim(code) <> '' GROUP BY 1")
def read_work_catalog(spark, sf_dir):
    return S.read_work_catalog(_file(spark, sf_dir)).select("code", "name", F.coalesce(F.col("unit_price").cast("double"), F.lit(-1.0)).alias("price"))


@query("SELECT item_id, 'AT.' || job_id AS code, CASE line % 4 WHEN 0 THEN 'labor' WHEN 1 THEN 'equipment' ELSE 'material' END AS kind, part_id::VARCHAR AS component_id, quantity::DOUBLE AS quantity FROM items WHERE line % 4 <> 3 AND job_id % 9 <> 0 AND part_id % 8 <> 0")
def read_components(spark, sf_dir):
    rows = items(spark, sf_dir).selectExpr("item_id as coefficient", "case when job_id % 9 = 0 then ' ' else concat('at-', job_id) end as ahs_code", "case line % 4 when 0 then 'Labor' when 1 then ' equipment' when 2 then 'material' else 'other' end as component_type", "case when part_id % 8 = 0 then '' else concat(' ', part_id) end as component_id", "concat(quantity, ' ') as quantity")
    return S.read_components(rows.withColumn("coefficient", F.col("coefficient").cast("string"))).select(F.col("coefficient").cast("long").alias("item_id"), "code", "kind", "component_id", F.col("quantity").cast("double").alias("quantity"))


@query(f"WITH {_F} SELECT {_CODE} AS code, arg_max(floor(p_retailprice) + 0.25, file_order)::DOUBLE AS price FROM f JOIN part ON p_partkey = file_order WHERE trim(code) <> '' AND file_order % 5 <> 0 GROUP BY 1")
def read_price_list(spark, sf_dir):
    rows = _file(spark, sf_dir).join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("file_order"))
    rows = rows.select("file_order", F.when(F.col("file_order") % 2 == 0, F.col("code")).alias("NO"), F.when(F.col("file_order") % 2 == 1, F.col("code")).alias("NO."), F.expr("case when file_order % 5 = 0 then '-' else concat('Rp ', replace(format_number(floor(p_retailprice), 0), ',', '.'), ',25') end").alias("HARGA SATUAN"))
    return S.read_price_list(rows).select("code", F.col("unit_price").cast("double").alias("price"))


@query(f"WITH {_F} SELECT row_number() OVER (ORDER BY file_order) AS id, regexp_replace(translate(trim(code), '-', '.'), '\\s+', '', 'g') AS code, trim(name) AS name FROM f WHERE trim(code) <> ''")
def read_reference_names(spark, sf_dir):
    return S.read_reference_names(cut_lineage(_file(spark, sf_dir))).select(F.col("id").cast("long").alias("id"), "code", "name")


@query(f"WITH {_F} SELECT file_order AS material_id, brand, try_cast(unit_price AS DECIMAL(20,2))::DOUBLE AS price, file_order % 4 IN (0, 1) AS is_default FROM f WHERE file_order % 5 <> 0 AND file_order % 6 <> 0")
def read_brand_prices(spark, sf_dir):
    rows = _file(spark, sf_dir).selectExpr("case when file_order % 6 = 0 then 'x' else cast(file_order as string) end as material_id", "brand as brand_name", "unit_price", "case file_order % 4 when 0 then '1' when 1 then 'True' when 2 then 'no' end as is_default")
    return S.read_brand_prices(rows).select("material_id", "brand", F.col("price").cast("double").alias("price"), "is_default")


@query("SELECT 'shop' || p_partkey % 4 AS source, count(*) AS n, sum(p_partkey)::BIGINT AS ids FROM part GROUP BY 1")
def read_shop_products(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    df = S.read_shop_products({f"shop{i}": part.filter(f"p_partkey % 4 = {i}") for i in range(4)})
    return df.groupBy("source").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("ids"))


@query("SELECT item_id, CASE WHEN supp_id % 5 <> 0 THEN 'Supplier#' || lpad(supp_id::VARCHAR, 9, '0') END AS section, CASE WHEN line % 5 < 4 THEN 'unit ' || line % 5 END AS unit, (quantity * cost_cents)::DOUBLE AS total, CASE WHEN part_id % 2 = 0 THEN 'c' || part_id END AS code FROM items")
def read_boq_items(spark, sf_dir):
    rows = items(spark, sf_dir).selectExpr("item_id", "supp_id as header_id", "line % 5 as unit_id", "cost_cents as price", "quantity as volume", "case when part_id % 2 = 0 then concat('c', part_id) else ' ' end as code")
    headers = table(spark, sf_dir, "supplier").filter("s_suppkey % 5 <> 0").selectExpr("s_suppkey as header_id", "s_name as name")
    units = table(spark, sf_dir, "region").filter("r_regionkey < 4").selectExpr("r_regionkey as unit_id", "concat('unit ', r_regionkey) as name")
    return S.read_boq_items(rows, headers, units).select("item_id", "section", "unit", F.col("total").cast("double").alias("total"), "code")


def _scratch(spark):
    from kalkula.sources.shared import cut_lineage

    at = cut_lineage(spark.range(1)).inputFiles()[0].rsplit("/", 2)[0]
    return f"{at}/{uuid.uuid4().hex}"


@query("SELECT job_id, sum(cost_cents)::BIGINT AS total_cents, count(*) AS n, 10000::BIGINT AS steps FROM items GROUP BY 1")
def write_jobs_and_items(spark, sf_dir):
    df, path = items(spark, sf_dir), _scratch(spark)
    S.write_jobs_and_items(job_totals(df), largest_remainder(df).select("job_id", "item_id", "weight_steps"), path)
    read = spark.read.parquet(f"{path}/items").groupBy("job_id").agg(F.count("*").alias("n"), F.sum("weight_steps").alias("steps"))
    return spark.read.parquet(f"{path}/jobs").drop("bucket").join(read, "job_id")


@query("SELECT DISTINCT text AS name FROM documents WHERE trim(text) <> ''")
def append_unmatched(spark, sf_dir):
    found, path = table(spark, sf_dir, "documents").select(F.col("text").alias("name")), _scratch(spark)
    S.append_unmatched(found.filter("length(name) % 2 = 0"), path)
    S.append_unmatched(found, path)
    S.append_unmatched(found, path)
    return S.read_unmatched(spark, path)


def _stream(spark, df):
    """df as a stream of files, in two batches at least."""
    path = _scratch(spark)
    df.repartition(4).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


@query("""WITH j AS (SELECT DISTINCT l_orderkey AS job_id FROM lineitem JOIN events ON user_id = l_orderkey), s AS (SELECT *, (2 * cost_cents * 1000 + total) // (2 * total) AS steps FROM (SELECT *, sum(cost_cents) OVER (PARTITION BY job_id)::BIGINT AS total FROM items JOIN j USING (job_id))),
g AS (SELECT *, cost_cents * 1000 - steps * total AS gap, 1000 - sum(steps) OVER (PARTITION BY job_id) AS away FROM s)
SELECT job_id, item_id, (steps + CASE WHEN away > 0 THEN CASE WHEN row_number() OVER (PARTITION BY job_id ORDER BY gap DESC, item_id::VARCHAR) <= away THEN 1 ELSE 0 END
 ELSE CASE WHEN row_number() OVER (PARTITION BY job_id ORDER BY gap, item_id::VARCHAR) <= -away THEN -1 ELSE 0 END END)::BIGINT AS weight_steps FROM g""")
def stream_recalc_weights(spark, sf_dir):
    changes, own = table(spark, sf_dir, "events").selectExpr("user_id as job_id", "ts"), items(spark, sf_dir)
    path = _scratch(spark)
    S.write_jobs_and_items(job_totals(own), own, f"{path}/store")
    feeds.stream_recalc_weights(_stream(spark, changes), spark.read.parquet(f"{path}/store/items"), f"{path}/out", f"{path}/state").awaitTermination()
    return feeds.current_weights(spark.read.parquet(f"{path}/out"))


@query("WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id AS row_key, event_type FROM e WHERE k = 1")
def stream_overrides(spark, sf_dir):
    changes = table(spark, sf_dir, "events").selectExpr("user_id as row_key", "struct(ts, event_id) as ts", "event_type")
    path = _scratch(spark)
    feeds.stream_overrides(_stream(spark, changes), f"{path}/out", f"{path}/state").awaitTermination()
    return feeds.current_overrides(spark, f"{path}/out").select("row_key", "event_type")


@query(f"WITH {_CARRY} SELECT file_id, row_idx, section_letter, section_roman, CASE index_kind WHEN 'letter' THEN 'CATEGORY' WHEN 'roman' THEN 'SECTION' END AS section_type FROM c")
def stream_ingest_boq(spark, sf_dir):
    sheets = cells(spark, sf_dir)
    path = _scratch(spark)
    # Rows of a sheet lie in several files, so it arrives over both batches.
    whole = sheets.join(sheets.groupBy("file_id").agg(F.count("*").alias("n_rows")), "file_id")
    feeds.stream_ingest_boq(_stream(spark, whole), f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("file_id", "row_idx", "section_letter", "section_roman", "section_type")


_WORKS = "works AS (SELECT p_partkey AS id, 'work ' || p_partkey AS query_id FROM part WHERE p_partkey % 3 = 0)"


@query(f"""WITH {_CARRY}, {_WORKS}, it AS (SELECT file_id, row_idx, works.id AS match_id, CASE WHEN works.id IS NULL THEN 'not found' ELSE 'found' END AS status, ((CASE WHEN volume > 0 THEN volume ELSE 1 END) * 100025)::DECIMAL(38, 1)::DECIMAL(38, 0)::BIGINT AS cost_cents FROM c LEFT JOIN works ON works.query_id = lower(trim(description)) WHERE NOT is_section),
wt AS (SELECT *, sum(cost_cents) OVER (PARTITION BY file_id)::BIGINT AS total FROM it), wf AS (SELECT *, cost_cents::HUGEINT * 10000 // total AS floor, cost_cents::HUGEINT * 10000 % total AS rest FROM wt), wk AS (SELECT *, 10000 - sum(floor) OVER (PARTITION BY file_id) AS short, row_number() OVER (PARTITION BY file_id ORDER BY rest DESC, row_idx) AS place FROM wf)
SELECT file_id, row_idx, match_id, status, cost_cents, (floor + CASE WHEN place <= short THEN 1 ELSE 0 END)::BIGINT AS weight_steps FROM wk""")
def stream_ingest_jobs(spark, sf_dir):
    sheets, path = cells(spark, sf_dir), _scratch(spark)
    source = f"{path}/in"
    sheets.repartition(4, "file_id").write.parquet(source)
    works = table(spark, sf_dir, "part").filter("p_partkey % 3 = 0").selectExpr("p_partkey as id", "concat('work ', p_partkey) as query_id", "1.0D as score")
    stream = spark.readStream.schema(sheets.schema).option("maxFilesPerTrigger", 2).parquet(source)
    feeds.stream_ingest_boq(stream, f"{path}/out", f"{path}/state", lambda q: q.join(works, "query_id")).awaitTermination()
    return spark.read.parquet(f"{path}/out").select("file_id", "row_idx", "match_id", "status", (F.col("cost") * 100).cast("long").alias("cost_cents"), "weight_steps")


@query(f"WITH {_ROWS}, e AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY row_idx) AS row_index FROM t) SELECT file_id, row_index, CASE WHEN is_section THEN 'SECTION' ELSE 'ITEM' END AS entry_type, number AS item_number, description, volume FROM e")
def write_entries(spark, sf_dir):
    path = _scratch(spark)
    S.write_entries(H.typed_entries(H.parse_sheet_rows(cells(spark, sf_dir))), path)
    return spark.read.parquet(path).select("file_id", "row_index", "entry_type", "item_number", "description", F.col("volume").cast("double").alias("volume"))
