"""Strings, codes and units of cost sheets, as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Abbreviations and what they stand for.
ABBREVIATIONS = {"plst": "plester", "smn": "semen", "bt": "batu", "bkk": "bata kokoh"}
# Units of the same kind.
UNIT_GROUPS = (("m", "m1", "meter"), ("m2", "meter2", "persegi"), ("m3", "meter3", "kubik"), ("bh", "buah", "unit", "set"), ("ls", "lumpsum", "paket"), ("kg", "kilogram"))
# Patterns that say a unit outright, in the order in which they are tried.
UNIT_MARKS = (
    ("m2", r"\b(m2|m²|meter2|persegi)\b"),
    ("m3", r"\b(m3|m³|meter3|kubik)\b"),
    ("m", r"(m'|m1\b|\b1\s*m\s+([^23²³\s]|$))"),
    ("ls", r"\b(ls|lumpsum|paket)\b"),
    ("bh", r"\b(bh|buah|unit|set)\b"),
    ("kg", r"\b(kg|kilogram)\b"),
)
# Parts of descriptions that suggest a unit, in the order in which they are tried.
UNIT_HINTS = (
    ("ls", ("mobilisasi", "demobilisasi", "penyiapan", "persiapan", "papan proyek", "papan nama", "direksi keet", "barak", "administrasi", "dokumentasi", "laporan", "rapat", "sertifikat", "ijin", "perijinan")),
    ("m3", ("galian", "urugan", "timbunan", "pemadatan", "pengurugan", "beton cor", "pengecoran", "volume", "tanah", "pasir urug", "sirtu", "agregat", "pembongkaran beton")),
    ("m", ("plint", "lis")),
    ("m2", ("lantai", "dinding", "plafon", "ceiling", "keramik", "granit", "marmer", "parket", "vinyl", "cat", "pengecatan", "plester", "acian", "aci", "lapangan", "perataan", "permukaan", "waterproofing", "membran", "geotextile", "aspal", "paving", "conblock", "grass block")),
    ("m", ("pipa", "kabel", "pagar", "railing", "handrail", "list", "profil", "besi beton", "tulangan", "drainase", "saluran", "gorong", "talang", "kawat", "tali", "selang")),
    ("bh", ("pintu", "jendela", "lampu", "saklar", "stop kontak", "kunci", "handle", "engsel", "pompa", "tangki", "reservoir", "septictank", "closet", "wastafel", "kran", "shower", "ac ", "air conditioner", "exhaust fan")),
)
# Symbols and what replaces them before accents are stripped.
SYMBOLS = {"m²": "m2", "㎡": "m2", "²": "2", "m³": "m3", "㎥": "m3", "³": "3", "–": "-", "—": "-", "·": " ", "×": "x"}

_SPACED_CODE = re.compile(r"\b(AT)\s+(\d+)(?:\s+(\d+))?\b", re.IGNORECASE)
_CODE = re.compile(r"\b[A-Za-z]+(?:[.-][A-Za-z0-9]+)+\b")


def _plain(text: str) -> str:
    """Lower case, symbols spelt out, accents off, one space between runs of letters and digits."""
    text = text.lower()
    for symbol, word in SYMBOLS.items():
        text = text.replace(symbol, word)
    text = re.sub(r"[@/:;,.!?()\[\]{}']", " ", text)
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).encode("ascii", "ignore").decode()
    return " ".join(re.findall("[0-9a-z]+", text))


def normal_form(text: str | None, stopwords: frozenset[str] = frozenset()) -> str:
    """One text by the rule of normalize_text: codes stay as they were written, all else is made plain piece by piece."""
    text = _SPACED_CODE.sub(lambda m: f"{m[1]}.{m[2]}" + (f"-{m[3]}" if m[3] else ""), text or "")
    out, at = [], 0
    for m in _CODE.finditer(text):
        out += [w for w in _plain(text[at : m.start()]).split() if w not in stopwords] + [m[0]]
        at = m.end()
    return " ".join(out + [w for w in _plain(text[at:]).split() if w not in stopwords])


#: Texts of printable ASCII and white space need no NFKD.
_ASCII = r"^[\t-\r\x20-\x7e]*$"
_MARK = "\u0001"


def normalize_text(text: Column | str, stopwords: tuple[str, ...] = ()) -> Column:
    """Comparable form of a description (normal_form): by built-in functions where it is ASCII, in Arrow batches where NFKD is needed."""
    drop = frozenset(stopwords)
    text = F.col(text) if isinstance(text, str) else text

    @F.pandas_udf(T.StringType())
    def normal(s: pd.Series) -> pd.Series:
        known = {x: normal_form(x, drop) for x in s.dropna().unique()}
        return pd.Series([known.get(x) for x in s], dtype=object)

    given = F.coalesce(text, F.lit(""))
    simple = given.rlike(_ASCII)
    spelt = F.regexp_replace(F.regexp_replace(given, r"(?i)\b(AT)\s+(\d+)\s+(\d+)\b", "$1.$2-$3"), r"(?i)\b(AT)\s+(\d+)\b", "$1.$2")
    # Codes stand at the odd places between marks.
    parts = F.split(F.regexp_replace(spelt, r"\b([A-Za-z]+(?:[.-][A-Za-z0-9]+)+)\b", f"{_MARK}$1{_MARK}"), _MARK)
    words = F.flatten(F.transform(parts, lambda part, i: F.when(i % 2 == 1, F.array(part)).otherwise(F.filter(F.split(F.lower(part), "[^0-9a-z]+"), lambda w: (w != "") & (~w.isin(*drop) if drop else F.lit(True))))))
    return F.when(simple, F.array_join(words, " ")).otherwise(normal(F.when(~simple, text)))


def remove_stopwords(text: Column, stopwords: tuple[str, ...]) -> Column:
    return F.array_join(F.filter(F.split(F.trim(text), r"\s+"), lambda w: (w != "") & ~w.isin(*stopwords)), " ")


def expand_abbreviations(text: Column, table: dict[str, str] = ABBREVIATIONS) -> Column:
    """Lower case; whole words replaced, longest first."""
    out = F.lower(text)
    for short in sorted(table, key=len, reverse=True):
        out = F.regexp_replace(out, rf"\b{re.escape(short)}\b", table[short])
    return out


def alnum_code_key(code: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(code, F.lit(""))), r"[^\p{L}\p{N}]", "")


def canonical_code(code: Column) -> Column:
    dots = F.regexp_replace(F.regexp_replace(F.upper(F.trim(F.coalesce(code, F.lit("")))), r"[-\s/_]", "."), r"\.+", ".")
    return F.regexp_replace(dots, r"^\.|\.$", "")


def looks_like_code(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}") & text.rlike(r"\p{Nd}") & (F.length(alnum_code_key(text)) >= 3), F.lit(False))


def normalize_reference_name(name: Column) -> Column:
    spelt = F.translate(F.lower(F.trim(F.coalesce(name, F.lit("")))), "×²³‘’”“/", "x23''\"\" ")
    return F.trim(F.regexp_replace(F.regexp_replace(spelt, r"[^a-z0-9\s.\-']", " "), r"\s+", " "))


def strip_leading_numeral(name: Column) -> Column:
    plain = F.lower(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), "[^0-9a-zA-Z]+", " ")))
    return F.regexp_replace(plain, r"^([0-9]+|[ivxlcdm]+)\s+", "")


def normalize_unit(unit: Column) -> Column:
    s = F.lower(F.trim(unit))
    for old, new in ((" ", ""), ("^", ""), ("²", "2"), ("³", "3"), ("㎡", "m2"), ("㎥", "m3"), ("meter", "m"), ("buah", "bh")):
        s = F.replace(s, F.lit(old), F.lit(new))
    s = F.when(s == "m1", "m").otherwise(s)
    return F.nullif(F.regexp_replace(s, "[^0-9a-z/]+", ""), F.lit(""))


def infer_unit(description: Column) -> Column:
    text = F.lower(description)
    out = F.lit(None).cast("string")
    for unit, parts in reversed(UNIT_HINTS):
        out = F.when(text.rlike("|".join(map(re.escape, parts))), unit).otherwise(out)
    for unit, mark in reversed(UNIT_MARKS):
        out = F.when(text.rlike(mark), unit).otherwise(out)
    return out


def units_compatible(inferred: Column, user: Column) -> Column:
    """True without a user's unit, false without an inferred one, else whether they are equal or of one kind."""
    kind = lambda u: F.coalesce(*(F.when(u.isin(*group), group[0]) for group in UNIT_GROUPS), u)
    given = F.coalesce(user != "", F.lit(False))
    same = F.coalesce(kind(normalize_unit(inferred)) == kind(normalize_unit(user)), F.lit(False))
    return F.when(~given, True).otherwise(same)


def unit_score(inferred: Column, user: Column) -> Column:
    """What a compatible unit adds to a match's score."""
    given = F.coalesce(F.trim(user) != "", F.lit(False)) & F.coalesce(F.trim(inferred) != "", F.lit(False))
    return F.when(given & units_compatible(inferred, user), F.lit(0.08)).otherwise(F.lit(0.0))


def row_key(description: Column, number: Column, index: Column) -> Column:
    """Four-digit place and the beginning of a digest of description and number."""
    part = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    place = F.when(F.length(index.cast("string")) < 4, F.lpad(index.cast("string"), 4, "0")).otherwise(index.cast("string"))
    return F.concat(place, F.lit("-"), F.substring(F.sha1(F.concat(part(description), F.lit("|"), part(number)).cast("binary")), 1, 12))


def clean_cell(cell: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(cell, "[\u00a0\n]", " "), r"\s+", " ")), F.lit(""))


def letter_grams(text: Column) -> Column:
    """Distinct sequences of two to four characters."""
    n = F.length(text)
    return F.array_distinct(F.flatten(F.transform(F.array(F.lit(2), F.lit(3), F.lit(4)), lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - k + 1)), lambda i: F.substring(text, i, k))).otherwise(F.array().cast("array<string>")))))
