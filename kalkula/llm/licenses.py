"""License scans: an exact set-similarity join of license templates against the blocks of texts.

Tokens are lower-cased words, and line breaks are blanks like others, so that a wrapped notice is found like one line. For a
template of m words the blocks of a text are its windows of 2 m words, each m words after the one before; whatever
stands in m words one after the other is wholly in one of them. A template of n distinct tokens is contained in a block that
holds ceil(threshold * n) of them or more.

All tokens are put in one global order, rarest in the corpus first. A block that contains a template holds one of the
template's first n - ceil(threshold * n) + 1 tokens (prefix filter): an inverted index maps these tokens to their templates,
and only where a text has such a token are blocks looked at. A block needs so many words at all (length filter), and from the
first shared token on the template must have enough tokens left (positional filter); these are then counted in the block. Each
block is found from its first shared token in the order, so the count is its whole overlap and no block is missed.

Templates are a list given by the caller; index and token frequencies (a row per template token, counted over the whole
corpus) follow its length alone. Built-in functions only; texts are never shuffled.

A null text counts as empty and has no words; empty texts have no labels; repeated rows get the same labels each; ids may
be null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kalkula.llm.common import read_table
from kalkula.llm.sketches import once

PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "apache license version 2"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "gnu general public license"),
    ("lgpl", "gnu lesser general public"),
    ("mpl", "mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("public-domain", "dedicated to the public domain"),
    ("all-rights-reserved", "all rights reserved"),
)
THRESHOLD = 0.8
_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal(text: Column) -> Column:
    """The words, lower-cased, with one space between and around them; one space if there are none.

    lower() maps the Kelvin sign, alone beyond ASCII, to a letter of a-z; it is set aside first.
    """
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("�"))), _APART, " ")), F.lit(" "))


def words_of(padded: Column) -> Column:
    return F.filter(F.split(padded, " "), lambda w: w != "")


def n_words(padded: Column) -> Column:
    return F.when(padded == "  ", F.lit(0)).otherwise(F.length(padded) - F.length(F.replace(padded, F.lit(" "), F.lit(""))) - 1).cast("long")


def places(padded: Column, phrase: str) -> Column:
    """Word numbers, from 0, at which the phrase's words stand one after the other."""
    want = phrase.split()
    n = len(want)
    words = words_of(padded)
    at = F.filter(F.transform(words, lambda w, i: F.when(w == want[0], i)), lambda i: i.isNotNull())
    found = F.filter(at, lambda i: F.slice(words, i + 1, n) == F.array(*map(F.lit, want)))
    return F.when(F.contains(padded, F.lit(f" {phrase} ")), found).otherwise(F.array().cast("array<int>"))


def token_order(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, text_col: str = "text") -> list[str]:
    """The templates' tokens, rarest first, by the number of texts that hold them; ties by code point."""
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    has = docs.select(F.explode(F.array_intersect(F.split(normal(F.col(text_col)), " "), F.array(*map(F.lit, vocabulary)))).alias("token"))
    count = {r["token"]: r["n"] for r in has.groupBy("token").agg(F.count("*").alias("n")).collect()}  # a row per template token at most
    return sorted(vocabulary, key=lambda w: (count.get(w, 0), w))


def inverted_index(order: list[str], templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> tuple[list[str], Column]:
    """The prefix tokens, and a map from each to its templates: number, label, words, distinct tokens, tokens needed, and the tokens from this one on."""
    rank = {w: i for i, w in enumerate(order)}
    entries: dict[str, list[Column]] = {}
    for t, (label, text) in enumerate(templates):
        tokens = sorted(set(text.split()), key=rank.__getitem__)
        least = math.ceil(threshold * len(tokens) - 1e-9)
        for place, w in enumerate(tokens[: len(tokens) - least + 1]):
            entries.setdefault(w, []).append(F.struct(
                F.lit(t).alias("t"), F.lit(label).alias("label"), F.lit(len(text.split())).alias("m"), F.lit(len(tokens)).alias("n"), F.lit(least).alias("least"), F.array(*map(F.lit, tokens[place:])).alias("rest"),
            ))
    return sorted(entries), F.create_map(*(x for w in sorted(entries) for x in (F.lit(w), F.array(*entries[w]))))


def contained(words: Column, prefixes: list[str], index: Column) -> Column:
    """t, label and share of each template for each block that contains it."""
    hits = lambda ws: F.array_compact(F.transform(ws, lambda w, i: F.when(w.isin(*prefixes), F.struct(w.alias("word"), i.alias("at")))))

    def of_block(ws: Column, e: Column, block: Column) -> Column:
        mine = F.slice(ws, block * e["m"] + 1, 2 * e["m"])
        shared = F.when((F.size(mine) >= e["least"]) & (F.size(e["rest"]) >= e["least"]), F.size(F.array_intersect(e["rest"], mine))).otherwise(0)
        return F.struct(e["t"].alias("t"), e["label"].alias("label"), F.when(shared >= e["least"], shared / e["n"]).otherwise(0.0).alias("share"))

    def of_hit(ws: Column, hit: Column) -> Column:
        block = lambda e: F.floor(hit["at"] / e["m"]).cast("int")
        return F.flatten(F.transform(index[hit["word"]], lambda e: F.transform(F.array(block(e), F.greatest(block(e) - 1, F.lit(0))), lambda k: of_block(ws, e, k))))

    found = lambda ws: F.array_distinct(F.filter(F.flatten(F.transform(hits(ws), lambda h: of_hit(ws, h))), lambda f: f["share"] > 0))
    return F.when(F.arrays_overlap(words, F.array(*map(F.lit, prefixes))), once(words, found)).otherwise(F.array().cast("array<struct<t:int,label:string,share:double>>"))


def license_scan(docs: DataFrame, phrases: tuple[tuple[str, str], ...] = PHRASES, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, places (label and word number of each exact phrase), contained (label and greatest share of each template found)."""
    prefixes, index = inverted_index(token_order(docs, templates, text_col), templates, threshold)
    df = docs.select(F.col(id_col).alias("id"), normal(F.col(text_col)).alias("padded"))
    labelled = lambda label, at: F.transform(at, lambda i: F.struct(F.lit(label).alias("label"), i.alias("word")))
    exact = F.flatten(F.array(*(labelled(label, places(F.col("padded"), p)) for label, p in phrases)))
    df = df.select("id", n_words(F.col("padded")).alias("n_words"), exact.alias("places"), contained(words_of(F.col("padded")), prefixes, index).alias("blocks"))
    most = lambda t: F.array_max(F.transform(F.filter("blocks", lambda b: b["t"] == t), lambda b: F.struct(b["share"].alias("share"), b["label"].alias("label"))))
    best = F.transform(F.array_distinct(F.transform("blocks", lambda b: b["t"])), most)
    return df.select("id", "n_words", "places", F.transform(best, lambda b: F.struct(b["label"].alias("label"), b["share"].alias("share"))).alias("contained"))


def op1_license_setjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = license_scan(read_table(spark, sf_dir, "documents"))
    base, added, at = F.col("places.label"), F.col("contained.label"), F.col("places.word")
    text = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("contained.share"), F.lit(0.0)))
    return df.select(
        F.col("id").alias("doc_id"), "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        text(base).alias("base_labels"), text(F.concat(base, added)).alias("labels"), score.alias("score"),
    )


def _sql() -> str:
    """The same by plain DuckDB SQL: every block against every template, without any filter."""
    spaced = lambda x: f"' ' || trim(regexp_replace(translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')) || ' '"
    phrases = ", ".join(f"('{label}', '{p}')" for label, p in PHRASES)
    templates = ", ".join(f"({i}, '{label}', {len(t.split())}, {sorted(set(t.split()))!r}, {math.ceil(THRESHOLD * len(set(t.split())) - 1e-9)})" for i, (label, t) in enumerate(TEMPLATES))
    return f"""
WITH phrase(label, p) AS (VALUES {phrases}),
template(t, label, m, tokens, least) AS (VALUES {templates}),
d AS (SELECT row_number() OVER () AS r, doc_id, text, {spaced("text")} AS padded FROM documents),
w AS (SELECT r, doc_id, text, [x for x in string_split(padded, ' ') if x <> ''] AS words FROM d),
place AS (SELECT r, label, i - 1 AS word FROM w, phrase, LATERAL (SELECT unnest(range(1, len(words) + 1)) AS i) WHERE words[i : i + len(string_split(p, ' ')) - 1] = string_split(p, ' ')),
base AS (SELECT r, count(*) AS n, min(word) AS a, max(word) AS z, list(DISTINCT label) AS labels FROM place GROUP BY r),
block AS (SELECT r, label, tokens, least, words[s + 1 : s + 2 * m] AS b FROM w, template, LATERAL (SELECT unnest(range(0, len(words), m)) AS s)),
hit AS (SELECT r, label, len(list_intersect(tokens, b)) / len(tokens)::DOUBLE AS share FROM block WHERE len(list_intersect(tokens, b)) >= least),
more AS (SELECT r, list(DISTINCT label) AS labels, max(share) AS share FROM hit GROUP BY r)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, z::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
  CASE WHEN n > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN base ON base.r = w.r LEFT JOIN more ON more.r = w.r"""


OP1_SQL = _sql()
