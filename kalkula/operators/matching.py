"""Matching work descriptions to the catalogue: by code, by name, by shared words, by similarity.

Queries are distinct descriptions (query_id, query: their normal form); catalogue rows have id (their order), code, name and
plain (the name's normal form). Words of queries meet the distinct words of names, as no word goes beyond one of them, through
an index of these words' character sequences of two to four letters: a word, or a synonym, can only be inside a word that
holds its first four letters, so nothing is missed and no word is compared with the whole catalogue.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kalkula.functions import similarity as S
from kalkula.functions import synonyms as Y
from kalkula.functions.text import alnum_code_key, expand_abbreviations, infer_unit, letter_grams, looks_like_code, normalize_text, normalize_unit, units_compatible
from kalkula.sources.shared import cut_lineage, fan_out, spread


def merge_catalogs(*catalogs: DataFrame) -> DataFrame:
    """One row for each code: that of the first source that has it, of that the first by id."""
    tagged = [c.withColumn("source_rank", F.lit(i)) for i, c in enumerate(catalogs)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    columns = [c for c in catalogs[0].columns if c != "code"]
    return out.groupBy("code").agg(F.min_by(F.struct(*columns), F.struct("source_rank", "id")).alias("r")).select("code", "r.*")


def code_variants(code: Column) -> Column:
    return F.array_distinct(F.array(code, F.replace(code, F.lit("-"), F.lit(".")), F.replace(code, F.lit("."), F.lit("-"))))


def code_variant_lookup(queries: DataFrame, catalog: DataFrame, contained: bool = False) -> DataFrame:
    """query_id, query and the catalogue rows whose code is, but for case, the query or its dotted or dashed form.

    contained: rows whose code holds one of these (the rule for catalogues in files). Of a code, at each place where the first
    four characters of a form stand, the parts as long as such forms are taken, and forms meet these as equals.
    """
    wanted = queries.select("query_id", "query", F.explode(code_variants(F.trim("query"))).alias("variant")).select("query_id", "query", F.upper("variant").alias("key")).filter("key <> ''").distinct()
    if not contained:
        return wanted.join(catalog.withColumn("key", F.upper("code")), "key").drop("key")
    lengths = wanted.groupBy(F.substring("key", 1, 4).alias("gram")).agg(F.collect_set(F.length("key")).alias("lengths"))
    codes = catalog.select(F.upper("code").alias("held")).filter("held <> ''").distinct().withColumn("size", F.length("held"))
    at = codes.select("held", "size", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("at"))
    begins = at.withColumn("gram", F.substring("held", F.col("at"), 4)).join(lengths, "gram").withColumn("n", F.explode("lengths")).filter(F.col("at") + F.col("n") - 1 <= F.col("size"))
    short = at.select("held", F.explode(F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda n: F.substring("held", F.col("at"), n))).alias("key"))
    parts = begins.select("held", F.substring("held", F.col("at"), F.col("n")).alias("key")).unionByName(short.join(wanted.filter(F.length("key") < 4).select("key").distinct(), "key", "left_semi"))
    hits = wanted.join(parts, "key").select("query_id", "query", "held").distinct()
    return hits.join(catalog.withColumn("held", F.upper("code")), "held").drop("held")


#: Lengths of the beginnings by which tokens and names meet first.
_BEGINNINGS = tuple(1 << i for i in range(7))


def prefix_candidates(queries: DataFrame, catalog: DataFrame, token: str = "token", limit: int | None = None) -> DataFrame:
    """query_id and the catalogue rows whose name starts with the token, but for case.

    Of a name only the beginnings as long as tokens that begin like it are taken, and tokens meet these as equals.
    """
    q = queries.select("query_id", F.lower(token).alias("token")).filter("token <> ''")
    # Of a query's tokens that begin alike the shortest finds all, so no row is found twice.
    least = F.filter("tokens", lambda t: ~F.exists("tokens", lambda u: (u != t) & F.startswith(t, u)))
    q = cut_lineage(q.groupBy("query_id").agg(F.collect_set("token").alias("tokens")).select("query_id", F.explode(least).alias("token")))
    sizes = lambda text: F.filter(F.array(*map(F.lit, _BEGINNINGS)), lambda n: n <= F.length(text))
    lengths = q.select("token").distinct().groupBy(F.substring("token", F.lit(1), F.array_max(sizes("token"))).alias("begin")).agg(F.collect_set(F.length("token")).alias("lengths"))
    low = catalog.select(F.lower("name").alias("low")).distinct()
    met = low.select("low", F.explode(F.transform(sizes("low"), lambda n: F.substring("low", F.lit(1), n))).alias("begin")).join(lengths, "begin")
    met = met.withColumn("n", F.explode("lengths")).filter(F.col("n") <= F.length("low")).select("low", F.substring("low", F.lit(1), F.col("n")).alias("token"))
    met = met.join(q.select("token").distinct(), "token", "left_semi").join(catalog.distinct().withColumn("low", F.lower("name")), "low").drop("low")
    found = fan_out(cut_lineage(met), q, "token").select("query_id", *catalog.columns)
    if limit is None:
        return found
    return found.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("id"))).filter(F.col("n") <= limit).drop("n")


def _first(found: DataFrame, *extra: str) -> DataFrame:
    return found.groupBy("query_id").agg(F.min_by(F.struct("id", "code", "name", *extra), "id").alias("m")).select("query_id", "m.*")


def exact_code_match(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """First catalogue row by code for queries that look like one: a variant of the code as written, equal in letters and digits."""
    q = queries.filter(looks_like_code(F.trim("query")))
    return _first(code_variant_lookup(q, catalog).filter(alnum_code_key(F.trim("query")) == alnum_code_key(F.col("code")))).withColumn("matched_on", F.lit("code"))


def exact_name_match(queries: DataFrame, catalog: DataFrame, raw: str = "raw") -> DataFrame:
    """First catalogue row with the same normal form whose name starts with the description as written."""
    found = queries.filter("query <> ''").select("query_id", F.col("query").alias("plain"), F.lower(raw).alias("start")).join(catalog, "plain").filter(F.startswith(F.lower("name"), F.col("start")))
    return _first(found).withColumn("matched_on", F.lit("name"))


def word_hits(words: DataFrame, others: DataFrame, near: DataFrame) -> DataFrame:
    """word, other and how (substring, synonym or fuzzy) for distinct words of queries (word) and of names (other); near: word and others like it."""
    terms = cut_lineage(words.select("word", F.explode(F.concat(F.array(F.struct(F.col("word").alias("term"), F.lit("substring").alias("how"))), F.transform(Y.synonyms_of(F.col("word")), lambda s: F.struct(s.alias("term"), F.lit("synonym").alias("how"))))).alias("t")).select("word", "t.*"))
    index = others.select("other", F.explode(letter_grams(F.col("other"))).alias("gram"))
    hits = terms.filter(F.length("term") >= 2).withColumn("gram", F.substring("term", 1, 4)).join(index, "gram").filter(F.contains("other", F.col("term"))).select("word", "other", "how")
    letters = others.select("other", F.explode(F.array_distinct(F.split("other", ""))).alias("term"))
    hits = hits.unionByName(terms.filter(F.length("term") == 1).join(letters, "term").select("word", "other", "how"))
    return hits.unionByName(near.select("word", "other", F.lit("fuzzy").alias("how"))).distinct()


def near_words(words: DataFrame, others: DataFrame, least: float = 0.8) -> DataFrame:
    """word and other: different words of six letters or more with one first letter and a sequence similarity of least or more.

    A longest common subsequence of c letters keeps all but 2 (a - c) + (b - c) of a word's a - 1 letter pairs, b being the
    other word's length; for a similarity of 0.8 that is one pair at the very least. So words meet through first letter and
    pairs, and only those with enough pairs in common are compared.
    """
    pairs = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, 2)))
    index = lambda df, w: df.select(w, F.substring(w, 1, 1).alias("first"), F.explode(pairs(F.col(w))).alias("pair"))
    met = index(words, "word").join(index(others, "other"), ["first", "pair"]).groupBy("word", "other").agg(F.count("*").alias("shared"))
    a, b = F.length("word"), F.length("other")
    common = F.ceil((a + b) * least / 2 - 1e-9)
    repeated = a - 1 - F.size(pairs(F.col("word")))
    need = a - 1 - repeated - 2 * (a - common) - (b - common)
    close = met.filter((common <= F.least(a, b)) & (F.col("word") != F.col("other")) & (F.col("shared") >= need))
    return close.withColumn("ratio", S.sequence_similarity("word", "other")).filter(F.col("ratio") >= least).select("word", "other")


def _part_of(word: Column, compounds: Column) -> Column:
    """Those of the compound materials that the word is part of."""
    return F.filter(compounds, lambda c: (F.length(word) >= 3) & F.array_contains(F.split(c, " "), word))


def _terms(words: Column) -> Column:
    """The words and their synonyms."""
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.concat(F.array(w), Y.synonyms_of(w)))))


def _holds(plain: Column, terms: Column, parts: Column) -> Column:
    """Whether a name holds one of the terms, or all parts of one of the compound materials."""
    return F.exists(terms, lambda t: F.contains(plain, t)) | F.exists(parts, lambda c: Y.contains_compound(plain, c))


@dataclass(frozen=True)
class Factors:
    """Which names each query may be matched with, kept apart: queries have a set of words, sets have kinds of names, kinds have names.

    asked: query_id, query, words, significant, technical (and their terms, the compounds that they are part of, and the key
    material of both), compounds, head, first and the key of the set of significant words. names: name (a number), plain, words,
    held (distinct words), kind (a number, or null). kinds: kind, held (the words of a name that any query's word hits, or that
    hold a part of a compound, sorted) and plain (these in one text). As neither a word nor its synonyms hold a space, they
    hit names of one kind alike. hits: word, kind, how. every: set, kind: kinds that all its words hit.
    Only who needs rows joins them.
    """

    asked: DataFrame
    names: DataFrame
    kinds: DataFrame
    hits: DataFrame
    every: DataFrame

    @staticmethod
    def of(queries: DataFrame, catalog: DataFrame) -> Factors:
        names = catalog.filter("plain <> ''").select("plain").distinct().withColumn("words", S.tokens(F.col("plain"))).withColumn("held", F.array_distinct("words"))
        names = cut_lineage(spread(names, "plain").withColumn("name", F.monotonically_increasing_id()))
        asked = spread(queries.select("query_id", "query"), "query_id").withColumn("words", S.tokens(F.col("query")))
        significant = F.filter("words", lambda w: (F.length(w) >= 4) & ~w.isin(*S.GENERIC_WORDS))
        asked = asked.withColumn("all_significant", significant).withColumn("technical", F.array_sort(F.array_distinct(F.filter("words", S.is_technical)))).withColumn("compounds", Y.detect_compounds(F.col("query")))
        asked = asked.select("*", F.array_sort(F.array_distinct("all_significant")).alias("significant"), F.get("all_significant", F.lit(0)).alias("head"), F.get("words", F.lit(0)).alias("first"), F.size("all_significant").alias("n_significant")).drop("all_significant")
        parts = F.array_distinct(F.flatten(F.transform("technical", lambda w: _part_of(w, F.col("compounds")))))
        asked = asked.withColumn("terms", _terms(F.col("technical"))).withColumn("parts", parts)
        key = lambda words, whole: F.concat_ws("|", F.array_join(words, " "), F.array_join(whole, ","))
        asked = cut_lineage(asked.withColumn("set", key("significant", "compounds")).withColumn("material", key("technical", "parts")))
        others = cut_lineage(names.select(F.explode("held").alias("other")).distinct())
        hard = asked.select(F.explode("significant").alias("word")).distinct()
        near = cut_lineage(near_words(hard.filter(F.length("word") >= 6), others.filter(F.length("other") >= 6)))
        words = cut_lineage(asked.select(F.explode(F.array_union("significant", "technical")).alias("word")).distinct())
        pairs = cut_lineage(word_hits(words, others, near))
        part = [p for c in sorted(Y.COMPOUNDS) for p in c.split(" ")]
        telling = pairs.select("other").unionByName(others.filter(F.exists(F.array(*map(F.lit, part)), lambda p: F.contains("other", p)))).distinct()
        of_name = cut_lineage(names.select("name", F.explode("held").alias("other")).join(telling, "other").groupBy("name").agg(F.array_sort(F.collect_list("other")).alias("held")))
        kinds = cut_lineage(of_name.select("held").distinct().withColumn("kind", F.monotonically_increasing_id()).withColumn("plain", F.array_join("held", " ")))
        names = cut_lineage(names.join(of_name.join(kinds.select("held", "kind"), "held").select("name", "kind"), "name", "left"))
        hits = cut_lineage(pairs.join(kinds.select("kind", F.explode("held").alias("other")), "other").select("word", "kind", "how").distinct())
        return Factors(asked, names, kinds, hits, _all_words(asked, kinds, hits, near))


def _all_words(asked: DataFrame, kinds: DataFrame, hits: DataFrame, near: DataFrame) -> DataFrame:
    """set, kind: kinds of names that every significant word of the set hits. A set takes kinds from the word that hits fewest and looks the others up."""
    often = hits.groupBy("word").agg(F.countDistinct("kind").alias("n")).join(near.groupBy("word").agg(F.collect_set("other").alias("near")), "word", "left")
    sets = asked.filter(F.size("significant") > 0).select("set", "significant", "compounds").distinct()
    each = sets.select("set", "compounds", F.explode("significant").alias("word")).join(often, "word", "left")
    found = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", F.coalesce("near", F.array().cast("array<string>")).alias("near"), _terms(F.array("word")).alias("terms"), _part_of(F.col("word"), F.col("compounds")).alias("parts"))
    each = each.groupBy("set", "compounds").agg(F.array_sort(F.collect_list(found)).alias("of")).select("set", "of", F.col("of")[0]["word"].alias("word"))
    each = cut_lineage(each)
    outright = spread(each.join(hits.select("word", "kind").distinct(), "word").select("set", "of", "kind"), "set", "kind").join(kinds, "kind")
    parts = each.select("set", "of", F.explode(F.col("of")[0]["parts"]).alias("compound"))
    met = outright.unionByName(parts.join(_whole(kinds), "compound").drop("compound"))
    hit = lambda w: _holds(F.col("plain"), w["terms"], w["parts"]) | F.exists(w["near"], lambda x: F.array_contains("held", x))
    return cut_lineage(met.filter(F.forall("of", hit)).select("set", "kind").distinct())


def _whole(kinds: DataFrame) -> DataFrame:
    """kinds with each compound material of which they hold all parts."""
    return kinds.select("*", F.explode(Y.compound_names()).alias("compound")).filter(Y.contains_compound(F.col("plain"), F.col("compound")))


def _expanded(asked: DataFrame, key: str, pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """asked with the rows of each kind that its key is paired with (key, kind); queries of one key go to the rows in lists, so no pairs of both are exchanged."""
    columns = [c for c in asked.columns if c != key]
    part = F.pmod(F.xxhash64(*columns), F.ceil(F.count("*").over(W.partitionBy(key)) / 256))
    lists = asked.withColumn("part", part).groupBy(key, "part").agg(F.collect_list(F.struct(*columns)).alias("asked"))
    met = fan_out(cut_lineage(pairs.join(lists, key).select("kind", "asked")), rows, "kind")
    return met.select(F.inline("asked"), *(c for c in rows.columns if c != "kind"))


def _material(asked: DataFrame, f: Factors) -> DataFrame:
    """material, kind: kinds of names that a technical word of the queries hits outright, by a synonym or as part of a compound."""
    sets = asked.select("material", "technical", "parts").distinct()
    outright = sets.select("material", F.explode("technical").alias("word")).join(f.hits.filter("how <> 'fuzzy'").select("word", "kind").distinct(), "word").select("material", "kind")
    parts = sets.select("material", F.explode("parts").alias("compound")).join(_whole(f.kinds), "compound").select("material", "kind")
    return outright.unionByName(parts).distinct()


def candidates_all_words(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """query_id, plain: names that every significant word hits, outright, by a synonym, nearly, or as part of a compound."""
    f = Factors.of(queries, catalog)
    return _expanded(f.asked.select("query_id", "set"), "set", f.every, f.names.select("kind", "plain"))


def candidates_any_material(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """query_id, plain: names that any technical word hits, outright, by a synonym or as part of a compound."""
    f = Factors.of(queries, catalog)
    return _expanded(f.asked.select("query_id", "material"), "material", _material(f.asked, f), f.names.select("kind", "plain"))


def candidate_ways(f: Factors, catalog: DataFrame, small_pool: int = 1000) -> DataFrame:
    """asked with way: the first that finds any name, and small: whether fewer than small_pool rows start with the head.

    Several significant words: 1, names that start with the first of them (if fewer than small_pool rows do) and hit all;
    2, any name that hits all. Then 3, names with any technical word; then 4, names that start with the first word or a
    synonym of it. A single technical word looks for names with it straight away.
    """
    several = f.asked.filter("n_significant >= 2").select("set", "head").distinct()
    heads = several.select(F.col("head").alias("query_id"), "head").distinct()
    # found for each head once, not for each query
    begun = cut_lineage(prefix_candidates(heads, catalog, "head").select(F.col("query_id").alias("head"), "plain"))
    starts = cut_lineage(begun.groupBy("head").agg(F.count("*").alias("n")).filter(F.col("n") < small_pool).select("head", F.lit(True).alias("small")))
    led = begun.join(starts, "head").join(f.names.select("plain", "kind"), "plain").select("head", "kind").distinct()
    narrow = several.join(f.every, "set").join(led, ["head", "kind"]).select("set", "head").distinct().withColumn("narrow", F.lit(True))
    narrow = several.join(f.every.select("set").distinct(), "set").join(narrow, ["set", "head"], "left").select("set", "head", F.coalesce("narrow", F.lit(False)).alias("narrow"))
    material = f.hits.filter("how <> 'fuzzy'").select("word").distinct()
    whole = f.kinds.agg(F.array_compact(F.array(*(F.max(F.when(Y.contains_compound(F.col("plain"), F.lit(c)), c)) for c in Y.COMPOUNDS))).alias("held"))  # one row
    outright = f.asked.select("query_id", F.explode("technical").alias("word")).join(material, "word", "left_semi").select("query_id")
    parts = f.asked.crossJoin(F.broadcast(whole)).filter(F.arrays_overlap("parts", "held")).select("query_id")
    some = outright.unionByName(parts).distinct().withColumn("some", F.lit(True))
    out = f.asked.join(narrow, ["set", "head"], "left").join(some, "query_id", "left").join(starts, "head", "left")
    way = F.when((F.col("n_significant") >= 2) & F.col("narrow"), 1).when((F.col("n_significant") >= 2) & F.col("narrow").isNotNull(), 2).when(F.col("some"), 3).otherwise(4)
    return cut_lineage(out.withColumn("way", way).drop("narrow", "some"))


def _found_rows(f: Factors, ways: DataFrame, catalog: DataFrame, material: DataFrame | None = None) -> DataFrame:
    """query_id, way and catalogue rows: by all words or by the head as ways say, by material, or as material gives them (query_id, name)."""
    rows = cut_lineage(f.names.select("name", "kind", "plain").join(catalog.select("id", "code", F.col("name").alias("written"), "plain"), "plain"))
    columns = ["query_id", "id", "code", F.col("written").alias("name"), "plain", "way"]
    every = _expanded(ways.filter("way <= 2").select("query_id", "set", "head", "way"), "set", f.every, rows)
    every = every.filter((F.col("way") == 2) | F.startswith(F.lower("written"), F.col("head"))).select(*columns)
    if material is None:
        third = ways.filter("way = 3").select("query_id", "material", "technical", "parts", "way")
        by_material = _expanded(third.select("query_id", "material", "way"), "material", _material(third, f), rows).select(*columns)
    else:
        by_material = material.withColumn("way", F.lit(3)).join(rows, "name").select(*columns)
    head = ways.filter("way = 4").select("query_id", F.explode(F.array_union(F.array("first"), Y.synonyms_of(F.col("first")))).alias("token"))
    head = cut_lineage(prefix_candidates(head, catalog.select("id", "code", "name", "plain")))
    head = head.join(head.groupBy("query_id", "code").agg(F.min("id").alias("id")), ["query_id", "code", "id"], "left_semi")
    return every.unionByName(by_material).unionByName(head.withColumn("way", F.lit(4)).select("query_id", "id", "code", "name", "plain", "way"))


def retrieve_candidates(queries: DataFrame, catalog: DataFrame, small_pool: int = 1000) -> DataFrame:
    """query_id, way and the catalogue rows of the first way that finds any (candidate_ways), all of them."""
    f = Factors.of(queries, catalog)
    return _found_rows(f, candidate_ways(f, catalog, small_pool), catalog)


def filter_by_unit(candidates: DataFrame, unit: str = "user_unit", name: str = "name") -> DataFrame:
    """Without candidates whose inferred unit conflicts with the user's; those without one stay, as do all if the user has none."""
    inferred = infer_unit(F.col(name))
    return candidates.filter(normalize_unit(F.col(unit)).isNull() | inferred.isNull() | units_compatible(inferred, F.col(unit)))


def fuzzy_match_topk(queries: DataFrame, catalog: DataFrame, least: float = 0.6, k: int = 1, explain: bool = False) -> DataFrame:
    """Candidates by the larger of sequence and partial similarity; with explain also both, and for each word its weight and best score.

    Letters are only compared where lengths and words leave `least` within reach.
    """
    found = retrieve_candidates(queries, catalog).join(queries, "query_id")
    found = filter_by_unit(found) if "user_unit" in queries.columns else found
    a, b = F.length("query"), F.length("plain")
    within = F.when(a + b > 0, 2 * F.least(a, b) / (a + b)).otherwise(1.0)
    near = found.withColumn("partial", S.partial_similarity(F.col("query"), F.col("plain"))).filter(F.greatest("partial", within) >= least)
    scored = near.withColumn("sequence", S.sequence_similarity("query", "plain")).withColumn("score", F.greatest("sequence", "partial")).filter(F.col("score") >= least)
    out = scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))).filter(F.col("rank") <= k)
    if explain:
        return out.withColumn("words", F.transform(S.tokens(F.col("query")), lambda w: F.struct(w.alias("word"), S.word_weight(w).alias("weight"), S.partial_similarity(w, F.col("plain")).alias("score"))))
    return out.drop("sequence", "partial")


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _shapes(names: DataFrame) -> Column:
    """For each number of distinct words (of 64 or more together) the range of letters and words that names of it have, as a literal array."""
    size = F.least(F.size(F.array_distinct("words")), F.lit(64)).alias("distinct")
    of = names.groupBy(size).agg(F.min(F.length("plain")).alias("a"), F.max(F.length("plain")).alias("b"), F.min(F.size("words")).alias("m"), F.max(F.size("words")).alias("n")).collect()  # 64 rows at most
    return F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in r.asDict().items())) for r in of)) if of else F.array().cast("array<struct<distinct:int,a:int,b:int,m:int,n:int>>")


def _sharing(asked: DataFrame, f: Factors) -> DataFrame:
    """query_id, name: names with a technical word of the query whose confidence may reach the query's least, where that takes a common word.

    Words are taken rarest first. The most frequent ones, of which all together can't lift any name to least, aren't
    looked up (no name of the sizes that occur reaches it with only these in common); the others are, each name by the
    rarest of its words that it has in common. Names that can't reach least by their sizes and common words go.
    """
    often = f.names.select(F.explode("held").alias("word"), "name").groupBy("word").agg(F.count("*").alias("n"))
    spelt = asked.select("query_id", F.explode(F.array_distinct("expanded_words")).alias("word")).join(often, "word")
    spelt = spelt.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda w: w["word"]).alias("rare_first"))
    shapes = _shapes(f.names)
    inside = lambda x, low, high: F.greatest(low, F.least(high, x))
    reach = lambda q, s, r: S.confidence_bound(q, inside(q["letters"], s["a"], s["b"]), inside(q["words"], s["m"], s["n"]), s["distinct"], F.least(r, s["distinct"], q["distinct"]))
    # A size class of 64 stands for larger ones, too, whose shares of common words are smaller.
    most = lambda r: F.coalesce(F.array_max(F.transform(shapes, lambda s: F.greatest(reach(F.col("shape"), s, r), reach(F.col("expanded_shape"), s, r)))), F.lit(0.0))
    useless = F.size(F.filter(F.sequence(F.lit(0), F.size("rare_first")), lambda r: most(r) < F.col("least") - 1e-9)) - 1
    looked_up = asked.join(spelt, "query_id").withColumn("useless", F.greatest(F.lit(0), useless))
    looked_up = cut_lineage(looked_up.withColumn("key", F.slice("rare_first", F.lit(1), F.size("rare_first") - F.col("useless"))))
    postings = f.names.select("name", "plain", "held", F.size("words").alias("m"), F.length("plain").alias("letters"))
    met = spread(looked_up.withColumn("word", F.explode("key")), "query_id", "word").join(postings.withColumn("word", F.explode("held")), "word")
    bound = lambda shape, both: S.confidence_bound(F.col(shape), F.col("letters"), F.col("m"), F.size("held"), both)
    within = lambda n: F.greatest(bound("shape", n["own"]), bound("expanded_shape", n["spelt"])) >= F.col("least") - 1e-9
    met = met.filter(_with(F.array_intersect("rare_first", "held"), lambda common: (common[0] == F.col("word")) & _with(F.struct(F.size(F.array_intersect("words", common)).alias("own"), F.size(common).alias("spelt")), within)))
    return met.filter(_holds(F.col("plain"), F.col("terms"), F.col("parts"))).select("query_id", "name")


def confidence_match_topk(queries: DataFrame, catalog: DataFrame, least: float = 0.6, k: int = 1, scorer: str = "fuzzy") -> DataFrame:
    """The k best candidates of each query (confident_rows), scores with four decimals."""
    return confident_rows(queries, catalog, least, k, scorer).withColumn("score", F.round("score", 4))


def confident_rows(queries: DataFrame, catalog: DataFrame, least: float = 0.6, k: int = 1, scorer: str = "fuzzy") -> DataFrame:
    """Candidates by the larger confidence of the query and of the query with synonyms, with score and rank.

    queries may have least and k of their own. Where least takes a common word, names are met through the words in common
    (_sharing) instead of through all candidates. Each query's rows come with the highest bound first; it keeps k rows
    and passes over those whose bound is below the worst of them.
    """
    for name, value in (("least", F.lit(float(least))), ("k", F.lit(k))):
        queries = queries if name in queries.columns else queries.withColumn(name, value)
    f = Factors.of(queries, catalog)
    expanded = Y.expand_query(F.col("query"))
    own = queries.select("query_id", "least", "k", *(["user_unit"] if "user_unit" in queries.columns else []))
    ways = candidate_ways(f, catalog).join(own, "query_id").withColumn("expanded", expanded).withColumn("expanded_words", S.tokens(expanded)).withColumn("shape", S.shape(F.col("query"))).withColumn("expanded_shape", S.shape(expanded))
    ways = cut_lineage(ways)
    shares = F.col("least") > S.WITHOUT_COMMON_WORD + 1e-9
    third = ways.filter("way = 3")
    few = third.filter(~shares)
    outright = _expanded(few.select("query_id", "material"), "material", _material(few, f), f.names.select("kind", "name"))
    material = _sharing(third.filter(shares), f).unionByName(outright)
    of_query = ways.drop("way", "set", "material", "head", "first", "significant", "technical", "terms", "parts", "compounds", "n_significant", "small")
    # Dealt out before the bounds are worked out: Catalyst takes filters down through what is dealt out after them.
    rows = spread(_found_rows(f, ways, catalog, material), "query_id", "plain").join(of_query, "query_id").join(f.names.select("plain", "held", F.size("words").alias("m")), "plain")
    rows = filter_by_unit(rows) if "user_unit" in queries.columns else rows
    bound = lambda shape, both: S.confidence_bound(F.col(shape), F.length("plain"), F.col("m"), F.size("held"), both)
    same = (F.col("plain") == F.col("query")) | (F.col("plain") == F.col("expanded"))
    common = F.struct(F.size(F.array_intersect("words", "held")).alias("own"), F.size(F.array_intersect("expanded_words", "held")).alias("spelt"))
    rows = rows.withColumn("bound", _with(common, lambda n: F.when(same, 1.0).otherwise(F.greatest(bound("shape", n["own"]), bound("expanded_shape", n["spelt"])))))
    rows = rows.filter(F.col("bound") >= F.col("least") - 1e-9).select("query_id", "query", "expanded", "id", "code", "name", "plain", "way", "least", "k", "bound")
    return best_rows(rows, scorer).drop("expanded", "least", "k", "bound")


def best_rows(rows: DataFrame, scorer: str = "fuzzy") -> DataFrame:
    """The k best rows of each query with score and rank; rows have query_id, query, expanded, id, plain, least, k and bound."""

    def score(query: list[str], expanded: list[str], plain: list[str], least: np.ndarray) -> np.ndarray:
        ic, names = pd.factorize(np.array(plain, object))
        out = np.full(len(plain), -1.0)
        for texts in (query, expanded):
            iq, asked = pd.factorize(np.array(texts, object))
            out = np.maximum(out, S.confidences(list(asked), list(names), iq, ic, least) if scorer == "fuzzy" else [float(scorer == "exact" and a != "" and a == b) for a, b in zip(texts, plain, strict=True)])
        return out

    kept = [*rows.columns, "score", "rank"]
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, known = None, np.zeros(0)  # rows of the query that may go on in the next batch, and their scores
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if waiting is None else pa.concat_tables([waiting, pa.Table.from_batches([batch])])
            scores = np.concatenate([known, np.full(batch.num_rows, np.nan)])
            group = np.cumsum(np.concatenate([[False], pc.not_equal(table.column("query_id").combine_chunks()[1:], table.column("query_id").combine_chunks()[:-1]).to_numpy(zero_copy_only=False)]))
            top = top_of(table, group, scores, score)
            goes_on = group[top] == group[-1]
            waiting, known = table.take(pa.array(top[goes_on])), scores[top[goes_on]]
            yield from ranked(table.take(pa.array(top[~goes_on])), scores[top[~goes_on]], group[top[~goes_on]])
        if waiting is not None:
            yield from ranked(waiting, known, np.zeros(len(known), np.int64))

    def ranked(table: pa.Table, scores: np.ndarray, group: np.ndarray) -> list[pa.RecordBatch]:
        rank = np.arange(len(group)) - np.searchsorted(group, group) + 1
        return table.append_column("score", pa.array(scores)).append_column("rank", pa.array(rank, pa.int32())).select(kept).combine_chunks().to_batches()

    return spread(rows, "query_id").sortWithinPartitions("query_id", F.desc("bound"), "id").mapInArrow(best, schema)


def top_of(table: pa.Table, group: np.ndarray, scores: np.ndarray, score) -> np.ndarray:
    """Places of the best k rows of each group, by score, then id. Fills in scores, a wave of rows with the highest bounds at a time."""
    bound, least, k, ids = (table.column(c).to_numpy() for c in ("bound", "least", "k", "id"))
    query, expanded, plain = (np.array(table.column(c).to_pylist(), object) for c in ("query", "expanded", "plain"))
    first = np.searchsorted(group, np.arange(group[-1] + 1))
    wave = 1
    while True:
        order = np.lexsort((ids, -np.where(np.isnan(scores), -2.0, scores), group))
        place = np.arange(len(order)) - first[group[order]]
        last = order[(place == k[order] - 1) & (scores[order] >= 0)]  # the worst of k rows, where there are k
        floor = least[first].astype(float)
        floor[group[last]] = np.maximum(floor[group[last]], scores[last])
        open_ = np.isnan(scores)
        scores[open_ & (bound < floor[group] - 1e-9)] = -1.0
        open_ = np.flatnonzero(np.isnan(scores))
        if not len(open_):
            return order[(place < k[order]) & (scores[order] >= least[order])]
        turn = np.arange(len(open_)) - np.searchsorted(group[open_], group[open_])
        some = open_[turn < wave * k[open_]]
        found = score(query[some].tolist(), expanded[some].tolist(), plain[some].tolist(), floor[group[some]])
        scores[some] = np.where(found >= least[some], found, -1.0)
        wave *= 2


def best_match(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """The cascade for query_id and raw: exact by code or name; one word: five at 0.25 or more; more words: one at 0.9, else ten at 0.6.

    Abbreviations are written out first. A user_unit leaves out rows whose names say another unit, but for exact ones.
    """
    spelt = expand_abbreviations(F.col("raw"))
    queries = cut_lineage(queries.withColumn("raw", spelt).withColumn("query", normalize_text("raw")).filter("query <> ''"))
    columns = ["query_id", "id", "code", "name", "matched_on", "score", "rank"]
    by_code = exact_code_match(queries.withColumn("query", F.trim("raw")), catalog)
    by_name = exact_name_match(queries, catalog).join(by_code, "query_id", "left_anti")
    exact = cut_lineage(by_code.unionByName(by_name).withColumn("score", F.lit(1.0)).withColumn("rank", F.lit(1)))
    one = F.size(S.tokens(F.col("query"))) == 1
    rest = queries.join(exact, "query_id", "left_anti").withColumn("least", F.when(one, 0.25).otherwise(0.6)).withColumn("k", F.when(one, 5).otherwise(10))
    top = cut_lineage(confident_rows(rest, catalog).withColumn("one", one))
    sure = top.filter("not one and rank = 1 and score >= 0.9").select("query_id", F.lit(True).alias("sure"))
    top = top.join(sure, "query_id", "left").filter("rank = 1 or sure is null").withColumn("matched_on", F.lit("fuzzy")).withColumn("score", F.round("score", 4))
    return exact.select(*columns).unionByName(top.select(*columns))


def match_status(rows: DataFrame, matches: DataFrame, description: str = "description", key: str = "query_id", single: str = "similar") -> DataFrame:
    """status of each row: skipped (section or blank), found (a code with a digit, or an exact match), similar, found N similar, or not found.

    single: what one inexact hit is called; sheets say similar, PDF rows found.
    """
    n = matches.groupBy(key).agg(F.count("*").alias("n"), F.max("score").alias("top"))
    out = rows.join(n, key, "left")
    blank = F.coalesce("is_section", F.lit(False)) | (F.coalesce(F.trim(description), F.lit("")) == "")
    status = F.when(blank, "skipped").when(F.coalesce(F.col("code").rlike("[0-9]"), F.lit(False)), "found").when(F.col("n").isNull(), "not found").when((F.col("n") == 1) & (F.col("top") == 1), "found").when(F.col("n") == 1, single).otherwise(F.concat(F.lit("found "), F.col("n").cast("string"), F.lit(" similar")))
    return out.withColumn("status", status).drop("n", "top")


def match_distinct(rows: DataFrame, match, description: str = "description") -> DataFrame:
    """match(queries) for each distinct trimmed lower-case description once, joined back to all rows by query_id."""
    keyed = rows.withColumn("query_id", F.lower(F.trim(description)))
    found = match(keyed.filter("query_id <> ''").select("query_id").distinct())
    return keyed.join(found, "query_id", "left")


def cache_stats(rows: DataFrame, description: str = "description") -> DataFrame:
    """lookups, misses (distinct descriptions) and hits of one match for each distinct description."""
    key = F.nullif(F.lower(F.trim(description)), F.lit(""))
    return rows.agg(F.count(key).alias("lookups"), F.countDistinct(key).alias("misses")).withColumn("hits", F.col("lookups") - F.col("misses"))


def review_queue(rows: DataFrame) -> DataFrame:
    """Rows for people to look at: not found goes to the unmatched log, similar and the like to review."""
    status = F.col("status")
    queue = F.when(status == "not found", "unmatched").when(status.isin("similar", "unit mismatch") | status.rlike("^found [0-9]+ similar$"), "needs review")
    return rows.withColumn("queue", queue).filter("queue is not null")
