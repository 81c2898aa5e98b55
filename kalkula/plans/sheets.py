"""Queries on rebuilding sheets and PDF pages: each job is a sheet and a document."""

from pyspark.sql import functions as F

from kalkula.operators import pdf as D
from kalkula.operators import sheets as H
from kalkula.plans.base import items, query
from kalkula.sources.shared import cut_lineage

_NO = "CASE part_id % 8 WHEN 0 THEN 'A' WHEN 1 THEN 'II.' WHEN 2 THEN '1' WHEN 3 THEN ' 3) ' WHEN 4 THEN '' WHEN 5 THEN 'III' END"
_TXT = "CASE supp_id % 6 WHEN 0 THEN 'PEKERJAAN TANAH' WHEN 1 THEN ' ' ELSE 'Work ' || CAST(part_id AS STRING) END"
_CELLS = f"""SELECT job_id AS file_id, 0 AS row_idx, ARR('Judul', CASE WHEN job_id % 5 = 0 THEN 'Volume' ELSE 'Meta' END, NULL, NULL, NULL, NULL) AS cells FROM {{items}} GROUP BY 1
UNION ALL SELECT job_id, 1, CASE WHEN job_id % 7 = 0 THEN ARR('x', 'Uraian', 'Qty', 'Total', 'Harga', NULL) ELSE ARR(' No. ', 'Uraian Pekerjaan', 'Volume', 'SATUAN', 'Harga Satuan', 'Jumlah Harga') END FROM {{items}} GROUP BY 1
UNION ALL SELECT job_id, CAST(1 + item_id % 100 AS INT), ARR({_NO}, {_TXT}, CAST(quantity AS STRING) || ',5', 'm2', '1.000,25', CAST(cost_cents AS STRING)) FROM {{items}}"""


def _spark(sql):
    return sql.replace("ARR(", "array(")


def _duck(sql):
    return sql.replace("ARR(", "list_value(").format(items="items")


def cells(spark, sf_dir):
    return spark.sql(_spark(_CELLS), items=items(spark, sf_dir))


_C = f"cells AS ({_duck(_CELLS)})"
_HEAD = "h AS (SELECT job_id AS file_id FROM items WHERE job_id % 7 <> 0 GROUP BY 1)"


@query(f"WITH {_HEAD} SELECT file_id, 1 AS header_row, 'description:1,number:0,price:4,total_price:5,unit:3,volume:2' AS columns FROM h")
def find_header_strict(spark, sf_dir):
    df = H.find_header_strict(cells(spark, sf_dir))
    return df.select("file_id", F.col("header_row").cast("int").alias("header_row"), F.array_join(F.array_sort(F.transform(F.map_entries("columns"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))), ",").alias("columns"))


@query("SELECT DISTINCT job_id AS file_id, 1 AS header_row, CASE WHEN job_id % 7 = 0 THEN 'harga_satuan:4,jumlah:3,uraian:1,volume:2' ELSE 'harga_satuan:4,jumlah:5,no:0,satuan:3,uraian:1,volume:2' END AS columns, CASE WHEN job_id % 7 = 0 THEN 'no,satuan' ELSE '' END AS missing FROM items")
def find_header_best(spark, sf_dir):
    df = H.find_header_best(cells(spark, sf_dir))
    return df.select("file_id", F.col("header_row").cast("int").alias("header_row"), F.array_join(F.array_sort(F.transform(F.map_entries("columns"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))), ",").alias("columns"), F.array_join("missing", ",").alias("missing"))


@query("SELECT DISTINCT job_id AS file_id, CASE WHEN job_id % 7 = 0 THEN 'name:1,price:4,quantity:2,total:3' ELSE 'name:1,price:4,quantity:2,total:5' END AS columns FROM items")
def map_cost_columns(spark, sf_dir):
    df = H.map_cost_columns(cells(spark, sf_dir).filter("row_idx = 1"))
    return df.select("file_id", F.array_join(F.array_sort(F.transform(F.map_entries("columns"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))), ",").alias("columns"))


_ROWS = f"""{_C}, r AS (SELECT file_id, row_idx, trim(coalesce(cells[1], '')) AS number, trim(cells[2]) AS description, replace(cells[3], ',', '.')::DOUBLE AS v, cells[6]::DOUBLE AS total FROM cells WHERE row_idx > 1 AND file_id % 7 <> 0 AND trim(cells[2]) <> ''),
k AS (SELECT *, CASE WHEN upper(regexp_replace(number, '[ .)]+$', '')) = 'A' THEN 'letter' WHEN regexp_matches(regexp_replace(number, '[ .)]+$', ''), '^[IVX]+$') THEN 'roman' WHEN regexp_matches(number, '^[0-9]') THEN 'numeric' ELSE 'none' END AS index_kind FROM r),
s AS (SELECT *, CASE WHEN index_kind IN ('letter', 'roman') THEN true WHEN index_kind = 'numeric' THEN false ELSE description = upper(description) END AS is_section FROM k),
t AS (SELECT *, CASE WHEN is_section AND index_kind <> 'letter' THEN 0 ELSE v END AS volume FROM s)"""


@query(f"WITH {_ROWS} SELECT file_id, row_idx, number, description, index_kind, is_section, volume, total AS total_price, 1000.25::DOUBLE AS price FROM t")
def parse_sheet_rows(spark, sf_dir):
    df = H.parse_sheet_rows(cells(spark, sf_dir))
    return df.select("file_id", "row_idx", "number", "description", "index_kind", "is_section", *(F.col(c).cast("double").alias(c) for c in ("volume", "total_price", "price")))


_CARRY = f"""{_ROWS}, g AS (SELECT *, count(*) FILTER (index_kind = 'letter') OVER (PARTITION BY file_id ORDER BY row_idx) AS letters FROM t),
c AS (SELECT *, last_value(CASE WHEN index_kind = 'letter' THEN description END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY row_idx) AS section_letter, last_value(CASE WHEN index_kind = 'roman' THEN description END IGNORE NULLS) OVER (PARTITION BY file_id, letters ORDER BY row_idx) AS section_roman FROM g)"""


@query(f"WITH {_CARRY} SELECT file_id, row_idx, section_letter, section_roman, CASE index_kind WHEN 'letter' THEN 'CATEGORY' WHEN 'roman' THEN 'SECTION' END AS section_type FROM c")
def carry_sections(spark, sf_dir):
    return H.carry_sections(H.parse_sheet_rows(cells(spark, sf_dir))).select("file_id", "row_idx", "section_letter", "section_roman", "section_type")


@query(f"""WITH {_CARRY}, p AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY row_idx) - 1 AS place FROM c) SELECT file_id, row_idx, lpad(place::VARCHAR, 4, '0') || '-' || substr(sha1(lower(description) || '|' || lower(number)), 1, 12) AS row_key, volume::DECIMAL(28,2)::VARCHAR AS volume, '1000.25' AS price, total::DECIMAL(28,2)::VARCHAR AS total_price FROM p""")
def preview_rows(spark, sf_dir):
    return H.preview_rows(H.carry_sections(H.parse_sheet_rows(cells(spark, sf_dir)))).select("file_id", "row_idx", "row_key", "volume", "price", "total_price")


_COST = "SELECT job_id AS file_id, 0 AS row_idx, ARR('Nama', 'Qty', 'Unit Price', CASE WHEN job_id % 2 = 0 THEN 'Total' ELSE 'x' END) AS cells FROM {items} GROUP BY 1 UNION ALL SELECT job_id, CAST(item_id % 100 AS INT), ARR(CASE line WHEN 1 THEN NULL WHEN 2 THEN 'nan' ELSE 'work ' || CAST(line AS STRING) END, CASE WHEN line = 3 THEN 'x' ELSE CAST(quantity AS STRING) END, CASE WHEN line = 4 THEN NULL ELSE '2.5' END, CASE WHEN line = 5 THEN '?' ELSE CAST(cost_cents AS STRING) END) FROM {items}"


@query("""WITH t AS (SELECT job_id AS file_id, (item_id % 100)::INT AS row_idx, CASE line WHEN 1 THEN 'Item ' || item_id % 100 ELSE 'work ' || line END AS name, CASE WHEN line = 3 THEN 1 ELSE quantity END::DOUBLE AS quantity, CASE WHEN line = 4 THEN 0 ELSE 2.5 END::DOUBLE AS unit_price, line, job_id, cost_cents FROM items WHERE line <> 2)
SELECT file_id, row_idx, name, quantity, unit_price, CASE WHEN job_id % 2 = 0 AND line <> 5 THEN cost_cents ELSE quantity * unit_price END::DOUBLE AS cost FROM t""")
def parse_cost_sheet(spark, sf_dir):
    df = H.parse_cost_sheet(spark.sql(_spark(_COST), items=items(spark, sf_dir)))
    return df.select("file_id", "row_idx", "name", *(F.col(c).cast("double").alias(c) for c in ("quantity", "unit_price", "cost")))


_AT = "CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y, {text} AS text"
_HEADS = "SELECT job_id AS doc_id, 1 AS page, inline(array(" + ", ".join(f"struct({_AT.format(x=x, y=y, text=repr(t))})" for x, y, t in ((10, 50, "No"), (120, 50, "Uraian"), (150, 50, "Pekerjaan"), (260, 50, "Volume"), (360, 50, "Satuan"), (12, 20, "Pekerjaan Unit"))) + ")) FROM {items} GROUP BY job_id"
_UNIT = "CASE WHEN part_id % 4 = 0 THEN 'beton cor' WHEN part_id % 4 = 1 THEN 'a very long unit text' ELSE 'm2' END"
_BODY = "SELECT job_id AS doc_id, CAST(1 + item_id % 2 AS INT) AS page, inline(array(" + ", ".join(f"struct({_AT.format(x=x, y='40 + 20 * (item_id % 100)', text=t)})" for x, t in ((10, "CAST(line AS STRING)"), (120, "'Work ' || CAST(part_id AS STRING)"), (255, "CAST(quantity AS STRING)"), (355, _UNIT))) + ")) FROM {items}"


def fragments(spark, sf_dir):
    """Six header fragments a job and four an item."""
    return spark.sql(f"{_BODY} UNION ALL {_HEADS}", items=items(spark, sf_dir))


def _written(spark, sf_dir):
    """Fragments written down as a table of them would be, for steps that read them more than once."""
    return cut_lineage(fragments(spark, sf_dir))


@query("WITH e AS (SELECT DISTINCT job_id, (1 + item_id % 2)::INT AS page FROM items UNION SELECT job_id, 1 FROM items) SELECT job_id AS doc_id, page, CASE WHEN page = 1 THEN 500 END::BIGINT AS header_bucket FROM e WHERE page = 1")
def find_pdf_header(spark, sf_dir):
    return D.find_pdf_header(fragments(spark, sf_dir)).filter("page = 1").select("doc_id", "page", "header_bucket")


@query("SELECT DISTINCT job_id AS doc_id, 1 AS page, 'no:10.0,satuan:360.0,uraian:120.0,volume:260.0' AS columns FROM items")
def map_pdf_headers(spark, sf_dir):
    frags = _written(spark, sf_dir)
    df = D.map_pdf_headers(frags, D.find_pdf_header(frags))
    return df.select("doc_id", "page", F.array_join(F.array_sort(F.transform(F.map_entries("columns"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))), ",").alias("columns"))


_BND = "bnd(key, low, high) AS (VALUES ('no', NULL, 65.0), ('uraian', 65.0, 190.0), ('volume', 190.0, 310.0), ('satuan', 310.0, NULL))"


@query(f"WITH {_BND} SELECT doc_id, 1 AS page, key, low::DOUBLE AS low, high::DOUBLE AS high FROM (SELECT DISTINCT job_id AS doc_id FROM items), bnd")
def column_boundaries(spark, sf_dir):
    return D.page_boundaries(fragments(spark, sf_dir)).select("doc_id", "page", "key", "low", "high")


@query("""WITH b(key, x) AS (VALUES ('no', 10.0), ('uraian', 120.0), ('volume', 260.0), ('satuan', 360.0)), d AS (SELECT DISTINCT job_id FROM items WHERE job_id % 3 = 0), r AS (SELECT DISTINCT job_id, 20.0 + 60 * line AS x FROM items)
SELECT job_id AS doc_id, key, (SELECT max(r.x) FROM r WHERE r.job_id = d.job_id AND r.x <= b.x)::DOUBLE AS low, (SELECT min(r.x) FROM r WHERE r.job_id = d.job_id AND r.x > b.x)::DOUBLE AS high FROM d, b
UNION ALL SELECT job_id, key, low::DOUBLE, high::DOUBLE FROM (SELECT DISTINCT job_id FROM items WHERE job_id % 3 <> 0), (VALUES ('no', NULL, 65.0), ('uraian', 65.0, 190.0), ('volume', 190.0, 310.0), ('satuan', 310.0, NULL)) m(key, low, high)""")
def rule_boundaries(spark, sf_dir):
    frags = _written(spark, sf_dir)
    rules = items(spark, sf_dir).filter("job_id % 3 = 0").selectExpr("job_id as doc_id", "1 as page", "cast(20 + 60 * line as double) as x")
    return D.column_boundaries(D.map_pdf_headers(frags, D.find_pdf_header(frags)), rules).select("doc_id", "key", "low", "high")


@query("""WITH t AS (SELECT item_id, CASE line WHEN 1 THEN 'abc' WHEN 2 THEN '' ELSE quantity::VARCHAR END AS volume, CASE part_id % 3 WHEN 0 THEN 'M2' WHEN 1 THEN 'xyz' ELSE '' END AS unit FROM items)
SELECT item_id, CASE WHEN lower(unit) <> 'm2' AND NOT regexp_matches(volume, '[0-9]') THEN '0' ELSE volume END AS volume, CASE WHEN lower(unit) <> 'm2' AND NOT regexp_matches(volume, '[0-9]') THEN '' ELSE unit END AS unit FROM t""")
def reset_implausible(spark, sf_dir):
    df = items(spark, sf_dir).selectExpr("item_id", "map('volume', case line when 1 then 'abc' when 2 then '' else cast(quantity as string) end, 'satuan', case part_id % 3 when 0 then 'M2' when 1 then 'xyz' else '' end, 'no', '1') as values")
    values = D.reset_implausible(F.col("values"))
    return df.select("item_id", values["volume"].alias("volume"), values["satuan"].alias("unit"))


@query(f"WITH {_BND}, p AS (SELECT DISTINCT job_id AS doc_id, (1 + item_id % 2)::INT AS page FROM items UNION SELECT job_id, 1 FROM items) SELECT doc_id, page, key, low::DOUBLE AS low, CASE WHEN page = 1 THEN 50.0 END::DOUBLE AS header_y FROM p, bnd")
def carry_header(spark, sf_dir):
    return D.carried_boundaries(fragments(spark, sf_dir)).select("doc_id", "page", "key", "low", "header_y")


@query("WITH l AS (SELECT job_id AS doc_id, (1 + item_id % 2)::INT AS page, (40 + 20 * (item_id % 100))::DOUBLE AS row_y FROM items) SELECT doc_id, page, row_y, 4::BIGINT AS n FROM l WHERE page = 2 OR row_y > 56")
def group_fragments_to_rows(spark, sf_dir):
    return D.page_fragments(fragments(spark, sf_dir)).groupBy("doc_id", "page", "row_y").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT *, (1 + item_id % 2)::INT AS page, (40 + 20 * (item_id % 100))::DOUBLE AS row_y FROM items) SELECT job_id AS doc_id, page, row_y, line::VARCHAR AS number, 'Work ' || part_id || CASE part_id % 4 WHEN 0 THEN ' beton cor' WHEN 1 THEN ' a very long unit text' ELSE '' END AS description, CASE WHEN part_id % 4 > 1 THEN 'm2' END AS unit, quantity::VARCHAR AS volume FROM l WHERE page = 2 OR row_y > 56""")
def assign_columns(spark, sf_dir):
    df = D.page_rows(fragments(spark, sf_dir))
    return df.select("doc_id", "page", "row_y", F.col("values")["no"].alias("number"), F.col("values")["uraian"].alias("description"), F.col("values")["satuan"].alias("unit"), F.col("values")["volume"].alias("volume"))


_BROKEN = "SELECT job_id AS doc_id, item_id AS row_idx, CASE WHEN part_id % 3 = 0 THEN CAST(line AS STRING) ELSE '' END AS number, 'text ' || CAST(part_id AS STRING) AS description, CASE part_id % 5 WHEN 0 THEN 'mm' WHEN 1 THEN 'unit' ELSE '' END AS unit, CASE WHEN part_id % 4 = 0 THEN quantity ELSE 0 END AS volume FROM {items}"


@query(f"""WITH b AS ({_BROKEN.format(items='items')}), s AS (SELECT *, number <> '' OR volume <> 0 OR row_number() OVER (PARTITION BY doc_id ORDER BY row_idx) = 1 AS starts FROM b), i AS (SELECT *, count(*) FILTER (starts) OVER (PARTITION BY doc_id ORDER BY row_idx) AS island FROM s)
SELECT doc_id, min(row_idx) AS row_idx, string_agg(CASE WHEN NOT starts AND unit = 'mm' THEN description || ' mm' ELSE description END, ' ' ORDER BY row_idx) AS description, arg_min(unit, row_idx) AS unit, arg_min(volume, row_idx) AS volume FROM i GROUP BY doc_id, island""")
def merge_broken_rows(spark, sf_dir):
    return D.merge_broken_rows(spark.sql(_BROKEN, items=items(spark, sf_dir))).select("doc_id", "row_idx", "description", "unit", "volume")


@query("SELECT item_id, CASE line WHEN 1 THEN 'A' WHEN 2 THEN 'xv' WHEN 3 THEN 'XVI' ELSE '' END AS number, line IN (1, 2) AS is_section, CASE line WHEN 1 THEN 'CATEGORY' WHEN 2 THEN 'SECTION' END AS section_type, (quantity * cost_cents)::BIGINT AS total_price FROM items")
def mark_pdf_sections(spark, sf_dir):
    df = items(spark, sf_dir).selectExpr("item_id", "case line when 1 then 'I' when 2 then 'xv' when 3 then 'XVI' else '' end as number", "quantity as volume", "cost_cents as price")
    return D.mark_pdf_sections(df).select("item_id", "number", "is_section", "section_type", F.col("total_price").cast("long").alias("total_price"))
