"""Queries on row typing and validation."""

from pyspark.sql import functions as F

from kalkula.operators import rows as R
from kalkula.plans.base import items, query, table

_SHEET = """SELECT item_id, job_id, line, CASE part_id % 14 WHEN 0 THEN 'A' WHEN 1 THEN 'II.' WHEN 2 THEN 'I' WHEN 3 THEN '1.2' WHEN 4 THEN ' 3) ' WHEN 5 THEN 'b' WHEN 6 THEN '' WHEN 7 THEN 'x1' WHEN 8 THEN 'IV' WHEN 10 THEN '12' END AS number,
 CASE supp_id % 11 WHEN 0 THEN 'PEKERJAAN TANAH' WHEN 1 THEN 'Sub Total 5' WHEN 2 THEN 'Terbilang : Seratus: Juta' WHEN 3 THEN ' ' WHEN 4 THEN 'TOTAL' WHEN 5 THEN '12 m2' WHEN 6 THEN 'galian tanah' ELSE 'Work ' || CAST(part_id AS STRING) END AS description,
 CASE line % 3 WHEN 0 THEN '1.234,50' WHEN 1 THEN CAST(quantity AS STRING) END AS volume, CASE line % 2 WHEN 0 THEN 'Rp 5.000' ELSE CAST(cost_cents AS STRING) END AS unit_price, CAST(cost_cents AS STRING) || '.5' AS total_price FROM {items}"""
_S = f"s AS ({_SHEET.format(items='items')})"
_TOK = "upper(regexp_replace(trim(coalesce(number, '')), '[ .)]+$', ''))"
_KIND = f"CASE WHEN regexp_matches({_TOK}, '^[A-Z]$') THEN 'letter' WHEN regexp_matches({_TOK}, '^[IVXLCDM]+$') THEN 'roman' WHEN regexp_matches(regexp_replace({_TOK}, '[.,]', '', 'g'), '^[0-9]+$') THEN 'numeric' ELSE 'none' END"
_UP = "coalesce(trim(description) = upper(trim(description)) AND trim(description) <> lower(description), false)"
_N, _D = "nullif(trim(number), '')", "nullif(trim(description), '')"
_ENTRY = f"CASE WHEN {_N} IS NULL AND {_D} IS NULL THEN NULL WHEN starts_with(lower({_D}), 'terbilang') THEN 'GRAND_TOTAL' WHEN starts_with(lower({_D}), 'sub total') OR starts_with(lower({_D}), 'total') THEN 'SUB_TOTAL' WHEN upper({_N}) IN {R.SUB_SECTIONS} THEN 'SUB_SECTION' WHEN regexp_matches({_N}, '^[A-Z]$') THEN 'SECTION' WHEN {_N} IS NOT NULL THEN 'ITEM' WHEN {_UP} THEN 'SITE' ELSE 'ITEM' END"


def sheet(spark, sf_dir):
    return spark.sql(_SHEET, items=items(spark, sf_dir))


@query(f"WITH {_S} SELECT item_id, {_KIND} AS kind, CASE WHEN {_KIND} IN ('letter', 'roman') THEN true WHEN {_KIND} = 'numeric' THEN false ELSE trim(description) = upper(trim(description)) AND trim(description) <> lower(trim(description)) END AS is_section FROM s")
def classify_index_token(spark, sf_dir):
    return sheet(spark, sf_dir).select("item_id", R.classify_index_token(F.col("number")).alias("kind"), R.is_section_row(F.col("number"), F.col("description")).alias("is_section"))


@query(f"WITH {_S} SELECT item_id, {_ENTRY} AS entry_type FROM s")
def classify_entry(spark, sf_dir):
    return sheet(spark, sf_dir).select("item_id", R.classify_entry(F.col("number"), F.col("description")).alias("entry_type"))


@query(f"WITH {_S}, e AS (SELECT *, {_ENTRY} AS entry_type FROM s) SELECT item_id, entry_type, trim(description) AS description, CASE line % 3 WHEN 0 THEN 1234.5 WHEN 1 THEN volume::DOUBLE END::DOUBLE AS volume, CASE WHEN entry_type = 'GRAND_TOTAL' AND contains(description, ':') THEN trim(description[instr(description, ':') + 1:]) END AS amount_words FROM e WHERE entry_type IS NOT NULL AND {_D} IS NOT NULL")
def parse_entry(spark, sf_dir):
    return R.parse_entries(sheet(spark, sf_dir)).select("item_id", "entry_type", "description", F.col("volume").cast("double").alias("volume"), "amount_words")


_DESC = "SELECT item_id, CASE part_id % 12 WHEN 0 THEN 'II. Pekerjaan' WHEN 1 THEN 'Iris besi' WHEN 2 THEN '1Penyiapan m1' WHEN 3 THEN '2. Sosialisasi' WHEN 4 THEN 'a.Peralatan P3K' WHEN 5 THEN 'Bouwplank m1' WHEN 6 THEN '23 Watt' WHEN 7 THEN 'dan Reng' WHEN 8 THEN 'X-ray' WHEN 9 THEN 'm2' ELSE 'Kayu unit kg' END AS d, CASE line % 6 WHEN 0 THEN 'kayu m2' WHEN 1 THEN 'set' WHEN 2 THEN 'a b m2' WHEN 3 THEN '' WHEN 4 THEN 'Unit.' END AS u FROM {items}"
_IN = lambda x: f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g') IN {R.UNIT_WORDS}"
_ROM = "regexp_extract(d, '^\\s*([IVXLCDMivxlcdm]+)', 1)"
_GLUED = "regexp_matches(d, '^\\s*[IVXLCDMivxlcdm]+[\\pL\\pN]')"


@query(f"""WITH t AS ({_DESC.format(items='items')}) SELECT item_id, CASE WHEN {_ROM} <> '' THEN CASE WHEN {_GLUED} THEN '' ELSE {_ROM} END WHEN regexp_matches(d, '^\\s*[0-9]') THEN regexp_extract(d, '^\\s*([0-9]+)', 1) ELSE regexp_extract(d, '^\\s*([a-zA-Z])[.)]', 1) END AS number,
 CASE WHEN {_ROM} <> '' THEN CASE WHEN {_GLUED} THEN d ELSE regexp_extract(d, '^\\s*[IVXLCDMivxlcdm]+\\.?\\s*(.*)$', 1) END WHEN regexp_matches(d, '^\\s*[0-9]') THEN regexp_extract(d, '^\\s*[0-9]+[.)-]?\\s*(.*)$', 1) WHEN regexp_matches(d, '^\\s*[a-zA-Z][.)]') THEN regexp_extract(d, '^\\s*[a-zA-Z][.)]\\s*(.*)$', 1) ELSE d END AS rest FROM t""")
def split_number_prefix(spark, sf_dir):
    return spark.sql(_DESC, items=items(spark, sf_dir)).select("item_id", R.split_number_prefix(F.col("d")).alias("r")).select("item_id", "r.number", "r.rest")


@query(f"""WITH t AS (SELECT item_id, d, trim(coalesce(u, '')) AS u, [w for w in string_split(trim(coalesce(u, '')), ' ') if w <> ''] AS k, string_split(d, ' ') AS p FROM ({_DESC.format(items='items')})), v AS (SELECT *, [w for w in k if {_IN('w')}] AS units, len(p) >= 2 AND {_IN('p[-1]')} AS ends FROM t)
SELECT item_id, CASE WHEN len(units) = 0 OR len(k) > 2 THEN u ELSE array_to_string([w for w in k if w <> units[1]], ' ') END AS cell_words, CASE WHEN len(units) = 0 OR len(k) > 2 THEN '' ELSE units[1] END AS cell_unit, CASE WHEN ends THEN array_to_string(p[:-2], ' ') ELSE d END AS words, CASE WHEN ends THEN p[-1] ELSE '' END AS unit FROM v""")
def split_unit_tokens(spark, sf_dir):
    df = spark.sql(_DESC, items=items(spark, sf_dir)).select("item_id", R.split_unit_cell(F.col("u")).alias("c"), R.split_unit_tail(F.col("d")).alias("t"))
    return df.select("item_id", F.col("c.words").alias("cell_words"), F.col("c.unit").alias("cell_unit"), F.col("t.words").alias("words"), F.col("t.unit").alias("unit"))


@query()
def normalize_pdf_row(spark, sf_dir):
    rows = spark.sql(_DESC, items=items(spark, sf_dir)).selectExpr("item_id", "case when item_id % 5 = 0 then 'di' when item_id % 7 = 0 then '3' else '' end as no", "d as uraian", "u as satuan", "case when item_id % 3 = 0 then '1.000,50' end as volume", "'2,5' as price", "cast(null as string) as total_price")
    return R.normalize_pdf_rows(rows).withColumn("volume", F.col("volume").cast("double")).withColumn("price", F.col("price").cast("double")).withColumn("total_price", F.col("total_price").cast("double"))


@query("SELECT page_id, url FROM pages WHERE NOT regexp_matches(lower(trim(url)), '^https?://|^www\\.|\\.com|\\.id|\\.org|\\.net|\\.gov') UNION ALL SELECT doc_id + 1000000, text FROM documents WHERE NOT regexp_matches(lower(trim(text)), '^https?://|^www\\.|\\.com|\\.id|\\.org|\\.net|\\.gov')")
def drop_url_rows(spark, sf_dir):
    both = table(spark, sf_dir, "pages").select("page_id", "url").union(table(spark, sf_dir, "documents").select(F.col("doc_id") + 1000000, "text"))
    return R.drop_url_rows(both, "url")


_MATCHIN = "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 9 = 1 THEN '  ' ELSE text END AS description, CASE doc_id % 5 WHEN 0 THEN ' m2 ' WHEN 1 THEN 'a;b' WHEN 2 THEN '' WHEN 3 THEN text END AS unit FROM {documents}"


@query(f"WITH t AS (SELECT doc_id, trim(description) AS d, nullif(trim(unit), '') AS u FROM ({_MATCHIN.format(documents='documents')})), r AS (SELECT doc_id, CASE WHEN d IS NULL THEN 'Description is required.' WHEN d = '' THEN 'Description cannot be empty.' WHEN length(d) > 1024 THEN 'Description is too long.' WHEN length(u) > 32 OR NOT regexp_matches(u, '^[A-Za-z0-9./\\s-]*$') THEN 'Unit contains invalid characters.' END AS reason FROM t) SELECT doc_id, reason, CASE WHEN reason IS NULL THEN 'ok' ELSE 'error' END AS status FROM r")
def validate_match_input(spark, sf_dir):
    return R.validate_match_input(spark.sql(_MATCHIN, documents=table(spark, sf_dir, "documents"))).select("doc_id", "reason", "status")


@query("""WITH t AS (SELECT item_id, part_id % 7 = 0 AS no_code, part_id % 11 = 0 AS bad_code, line = 2 AS no_name, line = 3 AS no_unit, quantity % 5 = 0 AS bad_volume, quantity % 5 = 1 AS negative, line = 4 AS bad_part FROM items)
SELECT item_id, array_to_string([x for x in [CASE WHEN no_code THEN 'code: required' END, CASE WHEN bad_code AND NOT no_code THEN 'code: invalid' END, CASE WHEN no_name THEN 'name: required' END, CASE WHEN no_unit THEN 'unit: required' END, CASE WHEN bad_volume THEN 'volume: not a number' END, CASE WHEN negative THEN 'volume: negative' END, CASE WHEN bad_part THEN 'components[1].coefficient: not a number' END] if x IS NOT NULL], '; ') AS errors FROM t""")
def validate_price_payload(spark, sf_dir):
    df = items(spark, sf_dir).selectExpr("item_id", "case when part_id % 7 = 0 then ' ' when part_id % 11 = 0 then 'a;b' else ' at-1 ' end as code", "case when line = 2 then '' else 'n' end as name", "case when line = 3 then null else 'm2' end as unit", "case when quantity % 5 = 0 then 'abc' when quantity % 5 = 1 then '-3' else '1,5' end as volume", "'250.00' as unit_price", "array(struct('c' as code, 'n' as name, '0.75' as coefficient), struct('d' as code, 'm' as name, case when line = 4 then '=x' else '' end as coefficient)) as components")
    return R.validate_price_payload(df).select("item_id", F.array_join("errors", "; ").alias("errors"))


@query("""WITH t AS (SELECT item_id, line = 1 AS bad_key, part_id % 6 = 0 AS bad_code, quantity % 4 = 0 AS bad_volume, CASE WHEN part_id % 6 = 0 THEN '1; DROP TABLE' WHEN part_id % 5 = 0 THEN NULL ELSE 'ab 0' || line END AS code FROM items)
SELECT item_id, array_to_string([x for x in [CASE WHEN bad_key THEN 'row_key: invalid' END, CASE WHEN bad_code THEN 'code: invalid' END, CASE WHEN bad_volume THEN 'volume: invalid' END] if x IS NOT NULL], '; ') AS errors, CASE WHEN NOT bad_code THEN upper(replace(code, ' ', '.')) ELSE '1;.DROP.TABLE' END AS analysis_code FROM t""")
def validate_recompute_payload(spark, sf_dir):
    df = items(spark, sf_dir).selectExpr("item_id", "case when line = 1 then 'bad<script>' else concat('row-', line) end as row_key", "case when part_id % 6 = 0 then '1; DROP TABLE' when part_id % 5 = 0 then null else concat('ab 0', line) end as code", "'' as analysis_code", "cast(null as string) as volume", "case when quantity % 4 = 0 then '-1' else '2,5' end as quantity", "cast(null as string) as unit_price", "'1.000,5' as price")
    return R.validate_recompute_payload(df).select("item_id", F.array_join("errors", "; ").alias("errors"), "analysis_code")


@query("SELECT item_id, CASE WHEN line % 3 = 0 THEN 'not a number' ELSE 'negative' END AS reason FROM items WHERE line % 3 = 0 OR line % 5 = 1")
def validate_costs(spark, sf_dir):
    df = items(spark, sf_dir).selectExpr("item_id", "case when line % 3 = 0 then 'x1' when line % 5 = 1 then concat('-', cost_cents) else cast(cost_cents as string) end as cost")
    return R.cost_rejects(df).select("item_id", "reason")
