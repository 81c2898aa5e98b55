"""Queries on matching descriptions to the catalogue."""

from pyspark.sql import functions as F

from kalkula.functions import similarity as S
from kalkula.functions import synonyms as Y
from kalkula.functions.text import normalize_text
from kalkula.operators import matching as M
from kalkula.plans.base import query, table

_ACT = "CASE {k} % 6 WHEN 0 THEN 'pekerjaan' WHEN 1 THEN 'pemasangan' WHEN 2 THEN 'galian' WHEN 3 THEN 'pengecatan' WHEN 4 THEN 'pembongkaran' ELSE 'pembuatan' END"
_MAT = "CASE CAST(floor({k} / 6) AS BIGINT) % 9 WHEN 0 THEN 'beton' WHEN 1 THEN 'besi tulangan' WHEN 2 THEN 'pipa air bersih' WHEN 3 THEN 'cat dinding' WHEN 4 THEN 'keramik lantai' WHEN 5 THEN 'bata ringan' WHEN 6 THEN 'tanah biasa' WHEN 7 THEN 'wastafel' ELSE 'hebel 10 m2' END"
#: A work of the catalogue for each part, named by what the part has, so that distinct names grow with the table.
_CAT = f"SELECT p_partkey AS id, 'AT.' || CAST(CAST(floor(p_partkey / 4) AS BIGINT) AS STRING) || '-' || CAST(p_partkey % 4 AS STRING) AS code, {_ACT} || ' ' || {_MAT} || CASE p_partkey % 5 WHEN 0 THEN ' k225' WHEN 1 THEN ' dengan semen' WHEN 2 THEN ' 1 m3' ELSE '' END || ' ' || p_name || ' ' || substr(p_brand, 7) || ' ' || CAST(p_size AS STRING) AS name FROM {{part}}".replace("{k}", "p_partkey")
#: What orders ask for: the work with the customer's number, as it is named or otherwise, so that distinct descriptions grow with the customers.
_SAY = f"CASE {{k}} % 8 WHEN 0 THEN {_MAT} || ' ' || p_name WHEN 1 THEN name WHEN 2 THEN 'pasang ' || {_MAT} || ' ' || p_name WHEN 3 THEN code WHEN 4 THEN 'galiann ' || {_MAT} || ' ' || substr(p_brand, 7) WHEN 5 THEN 'keramik' WHEN 6 THEN 'lain dan tidak ada' ELSE ' ' END"
_DESC = f"SELECT o_orderkey AS row_id, {_SAY} AS description FROM {{orders}} JOIN ({_CAT}) cat ON cat.id = o_custkey JOIN {{part}} ON p_partkey = o_custkey".replace("{k}", "o_custkey")
_BASE = f"cat AS (SELECT *, name AS plain FROM ({_CAT.format(part='part')})), des AS ({_DESC.format(orders='orders', part='part')}), q AS (SELECT DISTINCT lower(trim(description)) AS query FROM des WHERE trim(description) <> '')"
_SYN = "syn(word, synonyms) AS (VALUES " + ", ".join(f"('{w}', {s!r})" for w, s in Y.synonym_map().items()) + ")"
_TECH = lambda w: f"(regexp_matches({w}, '{'|'.join(S.MATERIAL_MARKS)}') OR (length({w}) >= 6 AND {w} NOT IN {S.GENERIC_WORDS}))"
_WEIGHT = lambda w: f"CASE WHEN {w} IN {S.GENERIC_WORDS} THEN 0.15 WHEN {_TECH(w)} THEN 3.0 WHEN regexp_matches({w}, '{'|'.join(S.ACTION_MARKS)}') THEN 1.0 WHEN length({w}) <= 2 THEN 0.3 ELSE 1.0 END::DOUBLE"


def names(spark, sf_dir):
    return spark.sql(_CAT, part=table(spark, sf_dir, "part")).withColumn("plain", F.col("name"))


def descriptions(spark, sf_dir):
    return spark.sql(_DESC, orders=table(spark, sf_dir, "orders"), part=table(spark, sf_dir, "part"))


def queries(spark, sf_dir):
    return descriptions(spark, sf_dir).select(F.lower(F.trim("description")).alias("query")).filter("query <> ''").distinct().withColumn("query_id", F.col("query"))


@query(f"WITH {_BASE} SELECT code, arg_min(id, (r, id)) AS id, arg_min(name, (r, id)) AS name FROM (SELECT 0 AS r, id, code, name FROM cat WHERE id % 3 = 0 UNION ALL SELECT 1, id + 100000, code, 'csv ' || name FROM cat) GROUP BY 1")
def merge_catalogs(spark, sf_dir):
    df = names(spark, sf_dir).select("id", "code", "name")
    return M.merge_catalogs(df.filter("id % 3 = 0"), df.select((F.col("id") + 100000).alias("id"), "code", F.concat(F.lit("csv "), "name").alias("name")))


@query(f"WITH {_BASE} SELECT DISTINCT query AS query_id, id, code FROM q, cat WHERE upper(code) IN (upper(query), upper(replace(query, '-', '.')), upper(replace(query, '.', '-')))")
def code_variant_lookup(spark, sf_dir):
    return M.code_variant_lookup(queries(spark, sf_dir), names(spark, sf_dir)).select("query_id", "id", "code")


@query(f"WITH {_BASE} SELECT DISTINCT query AS query_id, id FROM (SELECT query, unnest([query, replace(query, '-', '.'), replace(query, '.', '-')]) AS v FROM q), cat WHERE contains(upper(code), upper(v))")
def code_containment(spark, sf_dir):
    return M.code_variant_lookup(queries(spark, sf_dir), names(spark, sf_dir), contained=True).select("query_id", "id")


@query(f"WITH {_BASE} SELECT query AS query_id, id FROM q, cat WHERE starts_with(lower(name), string_split(query, ' ')[1])")
def prefix_candidates(spark, sf_dir):
    return M.prefix_candidates(queries(spark, sf_dir).withColumn("token", F.split("query", " ")[0]), names(spark, sf_dir)).select("query_id", "id")


@query(f"WITH {_BASE}, m AS (SELECT query AS query_id, id, code FROM q, cat WHERE regexp_matches(query, '[a-z]') AND regexp_matches(query, '[0-9]') AND upper(code) IN (upper(query), upper(replace(query, '-', '.')), upper(replace(query, '.', '-'))) AND regexp_replace(upper(code), '[^A-Z0-9]', '', 'g') = regexp_replace(upper(query), '[^A-Z0-9]', '', 'g')) SELECT query_id, min(id) AS id, arg_min(code, id) AS code FROM m GROUP BY 1")
def exact_code_match(spark, sf_dir):
    return M.exact_code_match(queries(spark, sf_dir), names(spark, sf_dir)).select("query_id", "id", "code")


@query(f"WITH {_BASE} SELECT query AS query_id, min(id) AS id FROM q JOIN cat ON plain = query GROUP BY 1")
def exact_name_match(spark, sf_dir):
    return M.exact_name_match(queries(spark, sf_dir).withColumn("raw", F.col("query")), names(spark, sf_dir)).select("query_id", "id")


@query(f"WITH {_BASE}, w AS (SELECT DISTINCT unnest(string_split(plain, ' ')) AS word FROM cat), {_SYN} SELECT w.word, coalesce(array_to_string(synonyms, ' '), '') AS synonyms FROM w LEFT JOIN syn USING (word)")
def synonym_table(spark, sf_dir):
    words = names(spark, sf_dir).select(F.explode(F.split("plain", " ")).alias("word")).distinct()
    return words.join(Y.synonym_table(spark), "word", "left").select("word", F.coalesce(F.array_join("synonyms", " "), F.lit("")).alias("synonyms"))


@query(f"SELECT doc_id, sum({_WEIGHT('w')}) AS weight FROM (SELECT doc_id, unnest([w for w in string_split_regex(lower(text), '\\s+') if w <> '']) AS w FROM documents) GROUP BY 1")
def word_weight(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(S.tokens(F.lower("text"))).alias("w"))
    return words.groupBy("doc_id").agg(F.sum(S.word_weight(F.col("w"))).alias("weight"))


@query(f"WITH {_BASE}, {_SYN}, x AS (SELECT query, unnest(string_split(query, ' ')) AS w, generate_subscripts(string_split(query, ' '), 1) AS i FROM q) SELECT query AS query_id, string_agg(w || coalesce(' ' || array_to_string(synonyms[1:2], ' '), ''), ' ' ORDER BY i) AS expanded FROM x LEFT JOIN syn ON word = w GROUP BY 1")
def expand_query(spark, sf_dir):
    return queries(spark, sf_dir).select("query_id", Y.expand_query(F.col("query")).alias("expanded"))


@query(f"WITH {_BASE} SELECT id, array_to_string([c for c in ['bata ringan', 'hebel'] if contains(plain, c)], ',') AS compounds, contains(plain, 'bata') AND contains(plain, 'ringan') AS has_parts FROM cat")
def detect_compounds(spark, sf_dir):
    return names(spark, sf_dir).select("id", F.array_join(Y.detect_compounds(F.col("plain")), ",").alias("compounds"), Y.contains_compound(F.col("plain"), F.lit("bata ringan")).alias("has_parts"))


@query(f"""WITH {_BASE}, {_SYN}, w AS (SELECT DISTINCT query, unnest(string_split(query, ' ')) AS word FROM q), t AS (SELECT w.*, coalesce(synonyms, []) AS synonyms FROM w LEFT JOIN syn USING (word) WHERE {_TECH('word')}), n AS (SELECT DISTINCT plain FROM cat)
SELECT DISTINCT query AS query_id, plain FROM t, n WHERE contains(plain, word) OR len([s for s in synonyms if contains(plain, s)]) > 0 OR (contains(query, 'hebel') AND word = 'hebel' AND contains(plain, 'hebel')) OR (contains(query, 'bata ringan') AND word IN ('bata', 'ringan') AND contains(plain, 'bata') AND contains(plain, 'ringan'))""")
def candidates_any_material(spark, sf_dir):
    return M.candidates_any_material(queries(spark, sf_dir), names(spark, sf_dir))


@query()
def candidates_all_words(spark, sf_dir):
    return M.candidates_all_words(queries(spark, sf_dir), names(spark, sf_dir))


@query()
def retrieve_candidates(spark, sf_dir):
    return M.retrieve_candidates(queries(spark, sf_dir), names(spark, sf_dir)).select("query_id", "id", "way")


def _pairs(spark, sf_dir):
    q, n = queries(spark, sf_dir), names(spark, sf_dir).select("plain").distinct()
    return q.withColumn("key", F.explode(F.array_distinct(F.split("query", " ")))).join(n.withColumn("key", F.explode(F.array_distinct(F.split("plain", " ")))), "key").select("query", "plain").distinct()


_PAIRS = "n AS (SELECT DISTINCT plain FROM cat), pairs AS (SELECT query, plain FROM q, n WHERE len(list_intersect(string_split(query, ' '), string_split(plain, ' '))) > 0)"


@query(f"""WITH {_BASE}, {_PAIRS}, w AS (SELECT query, plain, unnest(string_split(query, ' ')) AS w FROM pairs), b AS (SELECT *, list_max([CASE WHEN w = x THEN 1.0 WHEN contains(x, w) OR contains(w, x) THEN least(length(w), length(x)) / greatest(length(w), length(x)) ELSE 0 END for x in string_split(plain, ' ')]) AS best FROM w)
SELECT query, plain, round(sum({_WEIGHT('w')} * best) / sum({_WEIGHT('w')}), 9) AS score FROM b GROUP BY 1, 2""")
def partial_similarity(spark, sf_dir):
    return _pairs(spark, sf_dir).withColumn("score", F.round(S.partial_similarity(F.col("query"), F.col("plain")), 9))


@query(f"""WITH {_BASE}, {_PAIRS}, t AS (SELECT query, plain, string_split(query, ' ') AS a, list_distinct(string_split(query, ' ')) AS q, list_distinct(string_split(plain, ' ')) AS c, len(string_split(plain, ' ')) AS m FROM pairs), k AS (SELECT *, len(list_intersect(q, c)) AS common, len([x for x in a if length(x) >= 4]) AS long, len([x for x in a if length(x) >= 4 AND list_contains(c, x)]) AS hits FROM t)
SELECT query, plain, common / len(list_distinct(list_concat(q, c))) AS jaccard, (common / len(q) + common / len(c)) / 2 AS coverage, least(len(a), m) / greatest(len(a), m) AS balance, CASE WHEN hits >= 2 THEN 0.2::DOUBLE * hits / long ELSE 0 END::DOUBLE AS bonus FROM k""")
def token_overlap_metrics(spark, sf_dir):
    m = S.token_overlap_metrics(F.col("query"), F.col("plain"))
    return _pairs(spark, sf_dir).select("query", "plain", *(c.alias(k) for k, c in m.items()))


@query()
def sequence_similarity(spark, sf_dir):
    return _pairs(spark, sf_dir).withColumn("score", S.sequence_similarity("query", "plain"))


@query()
def confidence_score(spark, sf_dir):
    return _pairs(spark, sf_dir).withColumn("score", S.confidence_score("query", "plain"))


@query(f"WITH {_BASE} SELECT id, u FROM cat, (VALUES ('m2'), ('M³'), ('')) v(u) WHERE u = '' OR CASE WHEN contains(plain, 'm2') THEN 'm2' WHEN contains(plain, 'm3') THEN 'm3' WHEN regexp_matches(plain, 'galian|tanah|pembongkaran beton') THEN 'm3' WHEN regexp_matches(plain, 'lis') THEN 'm' WHEN regexp_matches(plain, 'lantai|dinding|keramik|cat') THEN 'm2' WHEN regexp_matches(plain, 'pipa|tulangan') THEN 'm' WHEN contains(plain, 'wastafel') THEN 'bh' ELSE replace(lower(u), '³', '3') END = replace(lower(u), '³', '3')")
def filter_by_unit(spark, sf_dir):
    df = names(spark, sf_dir).withColumn("u", F.explode(F.array(F.lit("m2"), F.lit("M³"), F.lit(""))))
    return M.filter_by_unit(df, "u").select("id", "u")


def _matched(spark, sf_dir):
    q = queries(spark, sf_dir).withColumn("raw", F.col("query")).withColumn("query", normalize_text("query"))
    return M.best_match(q, names(spark, sf_dir).withColumn("plain", normalize_text("name")))


@query()
def fuzzy_match_topk(spark, sf_dir):
    return M.fuzzy_match_topk(queries(spark, sf_dir), names(spark, sf_dir), k=5, explain=True).select("query_id", "id", "score", "rank", "sequence", "partial", "words")


@query()
def confidence_match_topk(spark, sf_dir):
    return M.confidence_match_topk(queries(spark, sf_dir), names(spark, sf_dir), k=5).select("query_id", "id", "score", "rank")


@query()
def best_match(spark, sf_dir):
    return _matched(spark, sf_dir)


_EXACT = "m AS (SELECT query AS query_id, id, CASE WHEN plain = query THEN 1.0 ELSE 0.8 END AS score FROM q JOIN cat ON starts_with(plain, query))"
_STATUS = "st AS (SELECT des.*, CASE WHEN row_id % 10 = 0 OR trim(description) = '' THEN 'skipped' WHEN row_id % 11 = 0 THEN 'found' WHEN k.n IS NULL THEN 'not found' WHEN k.n = 1 AND top = 1 THEN 'found' WHEN k.n = 1 THEN 'similar' ELSE 'found ' || k.n || ' similar' END AS status FROM des LEFT JOIN (SELECT query_id, count(*) AS n, max(score) AS top FROM m GROUP BY 1) k ON k.query_id = lower(trim(description)))"


def _statuses(spark, sf_dir):
    """All descriptions against all names that start with them."""
    asked = queries(spark, sf_dir)
    matches = M.prefix_candidates(asked.withColumn("token", F.col("query")), names(spark, sf_dir)).select("query_id", "id", F.when(F.col("name") == F.col("query_id"), 1.0).otherwise(0.8).alias("score"))
    rows = descriptions(spark, sf_dir).withColumn("query_id", F.lower(F.trim("description"))).withColumn("is_section", F.col("row_id") % 10 == 0).withColumn("code", F.when(F.col("row_id") % 11 == 0, "A.1").otherwise("none"))
    return M.match_status(rows, matches)


@query(f"WITH {_BASE}, {_EXACT}, {_STATUS} SELECT row_id, status FROM st")
def match_status(spark, sf_dir):
    return _statuses(spark, sf_dir).select("row_id", "status")


@query(f"WITH {_BASE}, {_EXACT}, {_STATUS} SELECT row_id, CASE WHEN status = 'not found' THEN 'unmatched' ELSE 'needs review' END AS queue FROM st WHERE status = 'not found' OR status LIKE '%similar'")
def review_queue(spark, sf_dir):
    return M.review_queue(_statuses(spark, sf_dir)).select("row_id", "queue")


@query(f"WITH {_BASE} SELECT row_id, c.id FROM des LEFT JOIN (SELECT plain, min(id) AS id FROM cat GROUP BY 1) c ON c.plain = lower(trim(description))")
def match_distinct(spark, sf_dir):
    first = names(spark, sf_dir).groupBy("plain").agg(F.min("id").alias("id")).withColumnRenamed("plain", "query_id")
    return M.match_distinct(descriptions(spark, sf_dir), lambda q: q.join(first, "query_id")).select("row_id", "id")


@query(f"WITH {_BASE} SELECT count(*) AS lookups, count(DISTINCT lower(trim(description))) AS misses, count(*) - count(DISTINCT lower(trim(description))) AS hits FROM des WHERE trim(description) <> ''")
def match_cache_stats(spark, sf_dir):
    return M.cache_stats(descriptions(spark, sf_dir))
