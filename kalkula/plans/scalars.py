"""Queries on the column functions: every row of a given table, written out in the forms that sheets use."""

from pyspark.sql import functions as F

from kalkula.functions import numbers as N
from kalkula.functions import text as T
from kalkula.plans.base import catalog, items, query, table

_A, _B, _Q = "CAST(floor(cost_cents / 100) AS BIGINT)", "lpad(CAST(cost_cents % 100 AS STRING), 2, '0')", "CAST(quantity AS STRING)"
_THOUSANDS = f"CAST(CAST(floor({_A} / 1000) AS BIGINT) AS STRING) || '{{d}}' || lpad(CAST({_A} % 1000 AS STRING), 3, '0')"
_DOTS, _COMMAS = _THOUSANDS.replace("{d}", "."), _THOUSANDS.replace("{d}", ",")
RAW = f"""SELECT item_id, CASE item_id % 13 WHEN 0 THEN {_DOTS} || ',' || {_B} WHEN 1 THEN {_COMMAS} || '.' || {_B} WHEN 2 THEN 'Rp ' || {_DOTS} WHEN 3 THEN CAST({_A} AS STRING)
 WHEN 4 THEN CAST({_A} AS STRING) || ',' || {_B} WHEN 5 THEN '-' WHEN 6 THEN {_Q} || ' x ' || {_Q} WHEN 7 THEN {_Q} || '.000' WHEN 8 THEN ' ' WHEN 9 THEN '= ' || {_Q} WHEN 10 THEN 'abc' WHEN 11 THEN {_DOTS} || '.' || lpad({_Q}, 3, '0') END AS raw FROM {{items}}"""
_RAW = f"raw AS ({RAW.format(items='items')})"


def _raw(spark, sf_dir):
    return spark.sql(RAW, items=items(spark, sf_dir))


def _last(s):
    return f"CASE WHEN contains({s}, ',') AND contains({s}, '.') THEN CASE WHEN instr(reverse({s}), ',') < instr(reverse({s}), '.') THEN replace(replace({s}, '.', ''), ',', '.') ELSE replace({s}, ',', '') END WHEN contains({s}, ',') THEN replace({s}, ',', '.') ELSE {s} END"


_SHEET = f"CASE WHEN regexp_matches(s, '^[0-9]{{1,3}}(\\.[0-9]{{3}})+,[0-9]+$') THEN replace(replace(s, '.', ''), ',', '.') WHEN regexp_matches(s, '^[0-9]{{1,3}}(,[0-9]{{3}})+\\.[0-9]+$') THEN replace(s, ',', '') ELSE {_last('s')} END"
_BADS = "NOT regexp_matches(s, '[0-9]') OR contains(s, '=') OR regexp_matches(s, '[0-9]+\\s*[xX]\\s*[0-9]+')"


@query(f"WITH {_RAW}, t AS (SELECT item_id, trim(replace(upper(trim(raw)), 'RP', '')) AS s FROM raw) SELECT item_id, CASE WHEN s <> '-' AND regexp_matches(s, '[0-9]') THEN try_cast(regexp_replace(replace(replace(s, '.', ''), ',', '.'), '[^0-9.-]', '', 'g') AS DECIMAL(20,2)) END::DOUBLE AS value FROM t")
def parse_rupiah(spark, sf_dir):
    return _raw(spark, sf_dir).select("item_id", N.parse_rupiah(F.col("raw")).cast("double").alias("value"))


@query(f"WITH {_RAW}, t AS (SELECT item_id, trim(raw) AS s FROM raw) SELECT item_id, coalesce(CASE WHEN NOT ({_BADS}) THEN try_cast(regexp_replace({_SHEET}, '[^0-9.-]', '', 'g') AS DECIMAL(38,6)) END, 0)::DOUBLE AS value FROM t")
def parse_sheet_decimal(spark, sf_dir):
    return _raw(spark, sf_dir).select("item_id", N.parse_sheet_decimal(F.col("raw")).cast("double").alias("value"))


@query(f"WITH {_RAW}, t AS (SELECT item_id, nullif(trim(raw), '') AS s FROM raw), v AS (SELECT item_id, s, CASE WHEN NOT ({_BADS}) THEN try_cast(regexp_replace({_SHEET}, '[^0-9.+-]', '', 'g') AS DECIMAL(38,6)) END AS v FROM t) SELECT item_id, v::DOUBLE AS value, CASE WHEN s IS NOT NULL AND v IS NULL THEN 'not a number' END AS error FROM v")
def coerce_decimal(spark, sf_dir):
    return _raw(spark, sf_dir).select("item_id", N.coerce_decimal(F.col("raw")).alias("r")).select("item_id", F.col("r.value").cast("double").alias("value"), "r.error")


@query(f"""WITH {_RAW}, t AS (SELECT item_id, trim(replace(raw, 'Rp', '')) AS s FROM raw), p AS (SELECT item_id, CASE WHEN contains(upper(s), 'E') THEN s WHEN contains(s, ',') AND contains(s, '.') THEN CASE WHEN length(s) - length(replace(s, '.', '')) = 1 AND regexp_matches(string_split(s, '.')[-1], '^[0-9]{{1,3}}$') THEN replace(s, ',', '') ELSE replace(replace(s, '.', ''), ',', '.') END
 WHEN contains(s, ',') THEN replace(s, ',', '.') WHEN length(s) - length(replace(s, '.', '')) > 1 OR s LIKE '%.000' THEN replace(s, '.', '') ELSE s END AS p FROM t)
SELECT item_id, CASE WHEN regexp_matches(p, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN try_cast(p AS DECIMAL(38,6)) END::DOUBLE AS value FROM p""")
def convert_decimal(spark, sf_dir):
    return _raw(spark, sf_dir).select("item_id", N.convert_decimal(F.col("raw")).cast("double").alias("value"))


@query(f"WITH {_RAW}, t AS (SELECT item_id, replace(trim(raw), ' ', '') AS s FROM raw) SELECT item_id, coalesce(try_cast(regexp_replace({_last('s')}, '[^0-9.-]', '', 'g') AS DECIMAL(38,6)), 0)::DOUBLE AS value FROM t")
def parse_pdf_decimal(spark, sf_dir):
    return _raw(spark, sf_dir).select("item_id", N.parse_pdf_decimal(F.col("raw")).cast("double").alias("value"))


_MODES = "CASE item_id % 5 WHEN 0 THEN ' Percent ' WHEN 1 THEN 'IDR' WHEN 2 THEN 'other' WHEN 3 THEN '%' ELSE 'absolute' END"
_TARGET = f"SELECT item_id, CASE item_id % 4 WHEN 0 THEN {_Q} || ' %' WHEN 1 THEN 'Rp {{x}}' || {_DOTS} || ',50' WHEN 2 THEN '-' || {_Q} WHEN 3 THEN CASE WHEN item_id % 3 = 0 THEN '' ELSE '1_0' || {_Q} END END AS value, {_MODES} AS mode FROM {{items}}".replace("{x}", "")


@query(f"""WITH t AS (SELECT item_id, nullif(trim(value), '') AS text, CASE WHEN lower(trim(mode)) IN ('percent', 'percentage', '%') THEN 'percentage' WHEN lower(trim(mode)) IN ('absolute', 'currency', 'rupiah', 'idr', 'value') THEN 'absolute' END AS kind FROM ({_TARGET.format(items='items')})),
c AS (SELECT *, regexp_replace(regexp_replace(text, 'rp|idr', '', 'gi'), '[^0-9.,+-]', '', 'g') AS s, coalesce(kind <> 'percentage', true) AND contains(text, '%') AS sign FROM t),
n AS (SELECT *, CASE WHEN NOT sign AND regexp_matches(s, '[0-9]') THEN try_cast({_SHEET} AS DECIMAL(38,6)) END AS v FROM c)
SELECT item_id, kind AS mode, v::DOUBLE AS value, (kind IS NULL)::INT + (text IS NULL OR sign OR v IS NULL OR coalesce(kind = 'percentage' AND (v <= 0 OR v > 100), false) OR coalesce(kind = 'absolute' AND v <= 0, false))::INT AS n_errors FROM n""")
def parse_budget_target(spark, sf_dir):
    df = spark.sql(_TARGET, items=items(spark, sf_dir)).select("item_id", N.parse_budget_target(F.col("value"), F.col("mode")).alias("r"))
    return df.select("item_id", "r.mode", F.col("r.value").cast("double").alias("value"), F.size("r.errors").alias("n_errors"))


_TYPED = f"SELECT item_id, CASE item_id % 8 WHEN 0 THEN {_Q} || '%' WHEN 1 THEN ' TRUE ' WHEN 2 THEN 'false' WHEN 3 THEN '2024-0' || CAST(1 + item_id % 7 AS STRING) || '-1' || CAST(item_id % 10 AS STRING) WHEN 4 THEN '1' || CAST(item_id % 10 AS STRING) || '/0' || CAST(1 + item_id % 9 AS STRING) || '/2023' WHEN 5 THEN 'x%' WHEN 6 THEN '2024-13-40' ELSE 'yes' END AS raw FROM {{items}}"


@query(f"WITH t AS (SELECT item_id, trim(raw) AS s FROM ({_TYPED.format(items='items')})) SELECT item_id, CASE WHEN s LIKE '%!%' ESCAPE '!' AND s LIKE '%\\%' ESCAPE '\\' THEN try_cast(s[:-2] AS DECIMAL(28,8)) END::DOUBLE / 100 AS percent, CASE lower(s) WHEN 'true' THEN true WHEN 'false' THEN false END AS flag, CASE WHEN contains(s, '-') THEN try_strptime(s, '%Y-%m-%d')::DATE WHEN contains(s, '/') THEN try_strptime(s, '%d/%m/%Y')::DATE END AS day FROM t".replace("s LIKE '%!%' ESCAPE '!' AND s LIKE '%\\%' ESCAPE '\\'", "ends_with(s, '%')"))
def parse_percent_bool_date(spark, sf_dir):
    df = spark.sql(_TYPED, items=items(spark, sf_dir))
    return df.select("item_id", N.parse_percent(F.col("raw")).cast("double").alias("percent"), N.parse_bool(F.col("raw")).alias("flag"), N.parse_date(F.col("raw")).alias("day"))


@query("SELECT item_id, CASE WHEN item_id % 11 <> 0 THEN ((quantity * 1000 + line) * cost_cents + 500) // 1000 END::BIGINT AS total_cents FROM items")
def total_cost(spark, sf_dir):
    df = items(spark, sf_dir).select("item_id", ((F.col("quantity") * 1000 + F.col("line")).cast("decimal(18,3)") / F.lit(1000).cast("decimal(4,0)")).cast("decimal(18,3)").alias("v"), (F.col("cost_cents").cast("decimal(18,2)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,2)").alias("p"))
    return df.select("item_id", (N.total_cost(F.when(F.col("item_id") % 11 != 0, F.col("v")), F.col("p")) * 100).cast("long").alias("total_cents"))


@query("SELECT item_id, regexp_replace(regexp_replace((cost_cents // 100)::VARCHAR || '.' || lpad((cost_cents % 100)::VARCHAR, 2, '0') || '00', '0+$', ''), '\\.$', '') AS plain, (cost_cents // 100)::VARCHAR || '.' || lpad((cost_cents % 100)::VARCHAR, 2, '0') AS fixed FROM items")
def plain_and_fixed_strings(spark, sf_dir):
    v = (F.col("cost_cents").cast("decimal(20,4)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(20,4)")
    return items(spark, sf_dir).select("item_id", N.plain_decimal_string(v).alias("plain"), N.format_weights(v).alias("fixed"))


_CODES = "SELECT id, CASE id % 6 WHEN 0 THEN lower(code) WHEN 1 THEN ' ' || replace(code, '.', ' ') || ' ' WHEN 2 THEN replace(code, '.', '_') || '..' WHEN 3 THEN '-' || code || '/x' WHEN 4 THEN name END AS raw FROM {catalog}"
_KEY = "regexp_replace(upper(coalesce(raw, '')), '[^A-Z0-9]', '', 'g')"


@query(f"SELECT id, {_KEY} AS alnum, regexp_replace(regexp_replace(regexp_replace(upper(trim(coalesce(raw, ''))), '[-\\s/_]', '.', 'g'), '\\.+', '.', 'g'), '^\\.|\\.$', '', 'g') AS canonical, coalesce(regexp_matches(raw, '[a-zA-Z]') AND regexp_matches(raw, '[0-9]') AND length({_KEY}) >= 3, false) AS is_code FROM ({_CODES.format(catalog='catalog')})")
def code_functions(spark, sf_dir):
    raw = F.col("raw")
    return spark.sql(_CODES, catalog=catalog(spark, sf_dir)).select("id", T.alnum_code_key(raw).alias("alnum"), T.canonical_code(raw).alias("canonical"), T.looks_like_code(raw).alias("is_code"))


_STOP = ("the", "of", "and", "de", "la", "der", "die")


@query(f"SELECT doc_id, array_to_string([w for w in string_split_regex(trim(text), '\\s+') if w <> '' AND w NOT IN {_STOP}], ' ') AS kept FROM documents")
def remove_stopwords(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.remove_stopwords(F.col("text"), _STOP).alias("kept"))


_NAMES = "SELECT id, CASE id % 7 WHEN 0 THEN 'PLST ' || upper(name) || ' bt' WHEN 1 THEN 'II. ' || name || ' plstx' WHEN 2 THEN '12 ' || name || ' 10×20 m²' WHEN 3 THEN name || '/smn ‘x’' WHEN 4 THEN 'iv ' || name WHEN 5 THEN '  BKK-' || name END AS raw FROM {catalog}"


@query(f"SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(raw), '\\bplst\\b', 'plester', 'g'), '\\bsmn\\b', 'semen', 'g'), '\\bbkk\\b', 'bata kokoh', 'g'), '\\bbt\\b', 'batu', 'g') AS expanded FROM ({_NAMES.format(catalog='catalog')})")
def expand_abbreviations(spark, sf_dir):
    return spark.sql(_NAMES, catalog=catalog(spark, sf_dir)).select("id", T.expand_abbreviations(F.col("raw")).alias("expanded"))


@query(f"SELECT id, trim(regexp_replace(regexp_replace(translate(lower(trim(coalesce(raw, ''))), '×²³‘’/', 'x23'''' '), '[^a-z0-9\\s.''-]', ' ', 'g'), '\\s+', ' ', 'g')) AS reference_name, regexp_replace(lower(trim(regexp_replace(coalesce(raw, ''), '[^0-9a-zA-Z]+', ' ', 'g'))), '^([0-9]+|[ivxlcdm]+)\\s+', '') AS stripped FROM ({_NAMES.format(catalog='catalog')})")
def reference_names(spark, sf_dir):
    return spark.sql(_NAMES, catalog=catalog(spark, sf_dir)).select("id", T.normalize_reference_name(F.col("raw")).alias("reference_name"), T.strip_leading_numeral(F.col("raw")).alias("stripped"))


_UNITS = "SELECT item_id, CASE item_id % 12 WHEN 0 THEN 'M²' WHEN 1 THEN ' m 2 ' WHEN 2 THEN 'Meter2' WHEN 3 THEN 'm1' WHEN 4 THEN 'BUAH' WHEN 5 THEN 'm^3' WHEN 6 THEN '' WHEN 7 THEN 'Unit' WHEN 8 THEN 'ls.' WHEN 9 THEN 'kilogram' WHEN 10 THEN 'paket' END AS unit, CASE part_id % 14 WHEN 0 THEN 'Pemasangan 1 m2 dinding' WHEN 1 THEN 'Kubik pasir' WHEN 2 THEN 'Kabel 10 m panjang' WHEN 3 THEN 'Item lumpsum' WHEN 4 THEN 'AC 2 unit' WHEN 5 THEN 'Besi 100 kg' WHEN 6 THEN 'mobilisasi alat' WHEN 7 THEN 'galian tanah' WHEN 8 THEN 'listrik kamar' WHEN 9 THEN 'lantai kayu' WHEN 10 THEN 'pintu besi' WHEN 11 THEN 'lain lain' WHEN 12 THEN 'Plint 1 m panjang' ELSE 'pipa air' END AS text FROM {items}"
_NU = lambda c: f"nullif(regexp_replace(CASE WHEN {(n := 'replace(replace(replace(replace(replace(replace(lower(trim(' + c + ')), chr(32), chr(0)), chr(94), chr(0)), chr(178), chr(50)), chr(179), chr(51)), ' + chr(39) + 'meter' + chr(39) + ', chr(109)), ' + chr(39) + 'buah' + chr(39) + ', ' + chr(39) + 'bh' + chr(39) + ')').replace('chr(0)', chr(39) * 2)} = 'm1' THEN 'm' ELSE {n} END, '[^0-9a-z/]+', '', 'g'), '')"


def _infer_sql():
    arms = [f"WHEN regexp_matches(t, '{p.replace(chr(39), chr(39) * 2)}') THEN '{u}'" for u, p in T.UNIT_MARKS]
    arms += [f"WHEN regexp_matches(t, '{'|'.join(parts)}') THEN '{u}'" for u, parts in T.UNIT_HINTS]
    return f"CASE {' '.join(arms)} END"


_KIND = lambda c: "CASE " + " ".join(f"WHEN {c} IN {g} THEN '{g[0]}'" for g in T.UNIT_GROUPS) + f" ELSE {c} END"


@query(f"""WITH t AS (SELECT item_id, unit, {_NU('unit')} AS n, lower(text) AS t FROM ({_UNITS.format(items='items')})), i AS (SELECT *, {_infer_sql()} AS inferred FROM t), k AS (SELECT *, {_NU('inferred')} AS m FROM i)
SELECT item_id, n AS normal, inferred, CASE WHEN coalesce(unit, '') = '' THEN true ELSE coalesce({_KIND('m')} = {_KIND('n')}, false) END AS compatible, CASE WHEN coalesce(trim(unit), '') <> '' AND inferred IS NOT NULL AND coalesce({_KIND('m')} = {_KIND('n')}, false) THEN 0.08 ELSE 0 END::DOUBLE AS score FROM k""")
def unit_functions(spark, sf_dir):
    df = spark.sql(_UNITS, items=items(spark, sf_dir)).withColumn("inferred", T.infer_unit(F.col("text")))
    return df.select("item_id", T.normalize_unit(F.col("unit")).alias("normal"), "inferred", T.units_compatible(F.col("inferred"), F.col("unit")).alias("compatible"), T.unit_score(F.col("inferred"), F.col("unit")).alias("score"))


@query("SELECT item_id, CASE WHEN item_id < 1000 THEN lpad(item_id::VARCHAR, 4, '0') ELSE item_id::VARCHAR END || '-' || substr(sha1('work ' || part_id || '|' || CASE WHEN line % 2 = 0 THEN '' ELSE 'a' || line END), 1, 12) AS key FROM items")
def row_key(spark, sf_dir):
    df = items(spark, sf_dir).selectExpr("item_id", "concat(' WORK ', part_id, ' ') as d", "case when line % 2 = 1 then concat('A', line, ' ') end as n")
    return df.select("item_id", T.row_key(F.col("d"), F.col("n"), F.col("item_id")).alias("key"))


@query("SELECT doc_id, nullif(trim(regexp_replace(replace(replace(text, chr(160), ' '), chr(10), ' '), '\\s+', ' ', 'g')), '') AS cell FROM documents")
def clean_cell(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_cell(F.col("text")).alias("cell"))


@query()
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_text("text", ("the", "of")).alias("plain"))


_TEMPL = "SELECT id, upper(name) || ' (' || unit || '), Size: ' || CAST(id % 50 AS STRING) || ' @ [x]!' AS raw FROM {catalog}"


@query(f"SELECT id, trim(regexp_replace(lower(raw), '[^0-9a-z]+', ' ', 'g')) AS plain FROM ({_TEMPL.format(catalog='catalog')})")
def normalize_plain_text(spark, sf_dir):
    return spark.sql(_TEMPL, catalog=catalog(spark, sf_dir)).select("id", T.normalize_text("raw").alias("plain"))
