"""Small literal cases of single operators."""

import random
from decimal import Decimal
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kalkula.functions import numbers as N
from kalkula.functions import similarity as S
from kalkula.functions import synonyms as Y
from kalkula.functions import text as T
from kalkula.functions.letters import coded, matching_blocks
from kalkula.operators import breakdown as B
from kalkula.operators import matching as M
from kalkula.operators import pdf, pricing, rows, sheets, weights
from kalkula.sources.shared import fan_out
from tests import brute


def values(spark, raw, column):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, raw string")
    return [r["v"] for r in df.withColumn("v", column(F.col("raw"))).orderBy("i").collect()]


TEXTS = {
    "Kafé São José – résumé": "kafe sao jose resume", "Harga/m²: Rp. 1.000,00!": "harga m2 rp 1 000 00", "Volume: 12 m²; Ø16mm, @200mm": "volume 12 m2 16mm 200mm", "m^2": "m 2", "3×4 a·b": "3x4 a b",
    "AT 19 1": "AT.19-1", "AT 20": "AT.20", "T.14.d | 1 m³ Pemadatan pasir": "T.14.d 1 m3 pemadatan pasir", "A B C": "a b c", "aØb": "ab", None: "", " ": "", "?!": "",
}


def test_normalize_text(spark):
    assert values(spark, list(TEXTS), T.normalize_text) == list(TEXTS.values())


def test_both_ways_of_normalizing_agree(spark):
    """ASCII texts by built-in functions, the same by the rule for any text."""
    rng = random.Random(3)
    bits = ["AT", "at", "19", "1", "A.1", "B-2.c", "T.14.d", "m2", "x_y", "'", "-", ".", ",", "|", "\t", "\n", "dan", "Dan", "pasir", "1 x", "AT 5 6x", "é", "²", "\x1c", ""]
    raw = [rng.choice(["", " "]).join(rng.choices(bits, k=rng.randint(0, 9))) for _ in range(600)]
    for stop in ((), ("dan", "x")):
        assert values(spark, raw, lambda c: T.normalize_text(c, stop)) == [T.normal_form(x, frozenset(stop)) for x in raw]  # noqa: B023


@pytest.mark.parametrize(
    ("parse", "cases"),
    [
        (N.parse_sheet_decimal, {"1.234,56": "1234.56", "1,234.56": "1234.56", "12.34,56": "1234.56", "1.2.3,4": "123.4", "12,34.56": "1234.56", "1,2,3.4": "123.4", "not_a_number": "0", "7 = 5 x 6": "0", "1.000,50": "1000.50", "2,5": "2.5", None: "0"}),
        (N.convert_decimal, {"1234.56": "1234.56", "123": "123", "Rp 5.000": "5000", "1.234.567,89": "1234567.89", "1,234,567.89": "1234567.89", "x": None, "123456789012345678901234567890": "123456789012345678901234567890"}),
        (N.parse_rupiah, {"Rp 1.250.000,00": "1250000", "Rp 500.000": "500000", "-": None, "invalid": None}),
        (N.parse_percent, {"75%": "0.75", "75": None}),
    ],
)
def test_numbers(spark, parse, cases):
    assert values(spark, list(cases), parse) == [None if v is None else Decimal(v) for v in cases.values()]


def test_units(spark):
    cases = {"Pemasangan 1 m2 Dinding Keramik": "m2", "Kubik pasir": "m3", "Pemasangan 1 m' Plint Keramik": "m", "Kabel 10 m panjang": "m", "Item lumpsum": "ls", "AC 2 unit": "bh", "Besi 100 kg": "kg", "mobilisasi alat berat": "ls", "galian tanah biasa": "m3"}
    assert values(spark, list(cases), T.infer_unit) == list(cases.values())
    assert values(spark, ["M²", "m^2", " m 2 ", "m-2", "Meter2", "㎡", "m1", "m'", "BUAH", " "], T.normalize_unit) == ["m2"] * 6 + ["m", "m", "bh", None]
    assert values(spark, ["PLST DINDING", "template_plstx", "plst dinding + bt belah"], T.expand_abbreviations) == ["plester dinding", "template_plstx", "plester dinding + batu belah"]


PAIR_WORDS = ["pekerjaan", "pekerjan", "pasang", "pemasangan", "beton", "keramikk", "keramik", "m2", "é", "ab", "abc", "x" * 70]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc d", max_size=15), min_size=1, max_size=8), st.lists(st.text("abc d", max_size=140), min_size=1, max_size=8))
def test_sequence_ratios_are_the_common_subsequences(a, b):
    ia, ib = (x.ravel() for x in np.meshgrid(np.arange(len(a)), np.arange(len(b))))
    assert S.sequence_ratios(a, b, ia, ib).tolist() == [brute.sequence_ratio(a[i], b[j]) for i, j in zip(ia, ib, strict=True)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PAIR_WORDS), max_size=7).map(" ".join), min_size=1, max_size=8), st.lists(st.text("ab c", max_size=12), min_size=1, max_size=4), st.floats(0, 1))
def test_confidences_by_their_definition(names, others, least):
    names = [*names, *others, "pekerjaan beton " * 20]
    ia, ib = (x.ravel() for x in np.meshgrid(np.arange(len(names)), np.arange(len(names))))
    want = np.array([brute.confidence(names[i], names[j]) for i, j in zip(ia, ib, strict=True)])
    assert np.abs(S.confidences(names, names, ia, ib) - want).max() < 1e-12
    cut = S.confidences(names, names, ia, ib, least)
    assert ((np.abs(cut - want) < 1e-12) | ((cut == -1) & (want < least))).all()


@given(st.text("ab cd", max_size=60), st.text("ab cd", max_size=199))
def test_blocks_are_those_of_the_standard_library(a, b):
    left, right, _ = coded([a], [b])
    assert matching_blocks(left, right, np.array([0]), np.array([0]))[0] == sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())


def test_bounds_hold(spark):
    names = [" ".join(random.Random(i).choices(PAIR_WORDS, k=i % 7)) for i in range(60)]
    df = spark.createDataFrame([(a, b, brute.confidence(a, b)) for a in names for b in names], "a string, b string, c double")
    held, mine = F.array_distinct(S.tokens(F.col("b"))), F.array_distinct(S.tokens(F.col("a")))
    bound = F.when(F.col("a") == F.col("b"), 1.0).otherwise(S.confidence_bound(S.shape(F.col("a")), F.length("b"), F.size(S.tokens(F.col("b"))), F.size(held), F.size(F.array_intersect(mine, held))))
    assert df.filter(bound < F.col("c") - 1e-9).count() == 0


CATALOG = [(1, "AT.01.001", "pekerjaan galian tanah biasa"), (2, "AT.01.002", "pekerjaan galian tanah keras"), (3, "BT.02.001", "pekerjaan beton k225"), (4, "ST.03.001", "pemasangan besi tulangan d10"), (5, "CT.04.001", "pekerjaan cat dinding interior"), (6, "PT.05.001", "pemasangan pipa air bersih")]


def test_best_match(spark):
    cat = spark.createDataFrame(CATALOG, "id long, code string, name string").withColumn("plain", T.normalize_text("name"))
    asked = ["pekerjaan galian tanah biasa", "galian tanah", "AT-01.001", "zzz qqq", "pekerjaan galiann tanah biasa"]
    q = spark.createDataFrame([(x, x) for x in asked], "query_id string, raw string").withColumn("query", T.normalize_text("raw"))
    got = {}
    for r in M.best_match(q, cat).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["matched_on"], r["score"]))
    assert got["pekerjaan galian tanah biasa"] == [(1, "name", 1.0)]
    assert {x[0] for x in got["galian tanah"]} <= {1, 2} and all(0.6 <= x[2] < 0.9 for x in got["galian tanah"])
    assert "zzz qqq" not in got
    near = got["pekerjaan galiann tanah biasa"]
    assert near[0][0] == 1 and near[0][2] >= 0.85


def test_retrieval_matches_brute_force(spark):
    cat = spark.createDataFrame(CATALOG, "id long, code string, name string").withColumn("plain", F.col("name"))
    asked = ["galian tanah", "pengecatan tembok", "pipa", "besi tulangn", "bongkar cor", "pasang keramik dinding"]
    q = spark.createDataFrame([(x, x) for x in asked], "query_id string, query string")
    words = {(r["query_id"], r["plain"]) for r in M.candidates_all_words(q, cat).collect()}
    syn = Y.synonym_map()

    def hits(w, name):
        return w in name or any(s in name for s in syn.get(w, ())) or any(len(w) >= 6 <= len(c) and c[0] == w[0] and brute.sequence_ratio(w, c) >= 0.8 for c in name.split())

    want = set()
    for x in asked:
        sig = [w for w in x.split() if len(w) >= 4 and w not in S.GENERIC_WORDS]
        want |= {(x, n) for _, _, n in CATALOG if sig and all(hits(w, n) for w in sig)}
    assert words == want


def test_synonyms_are_the_same_in_both_forms(spark):
    assert {r["word"]: r["synonyms"] for r in Y.synonym_table(spark).collect()} == Y.synonym_map()
    assert Y.synonym_map()["pekerjaan"] == ["pengecoran"] and Y.synonym_map()["pengecatan"] == ["cat"]


def test_weights(spark):
    jobs = spark.createDataFrame([(1, 1, 50_000_000_000), (1, 2, 8_000_000_000), (1, 3, 5_000_000_000), (2, 4, 0), (3, 5, None), (3, 6, 7)], "job_id long, item_id long, cost_cents long")
    got = {r["item_id"]: r["weight_steps"] for r in weights.largest_remainder(jobs).collect()}
    assert got == {1: 7936, 2: 1270, 3: 794, 4: 0, 5: 0, 6: 10000}
    rounded = spark.createDataFrame([(1, i, 111_100, 1) for i in range(90)], "job_id long, item_id long, percent long, cost_cents long")
    assert weights.round_percentages(rounded, "percent").agg(F.sum("weight_steps")).first()[0] == 10000


PDF_ROWS = [
    ("", "PEKERJAAN PERSIAPAN & SMKK", "", "", ("", "PEKERJAAN PERSIAPAN & SMKK", "")), ("", "a.Peralatan P3K", "set", "1", ("a", "Peralatan P3K", "set")), ("", "dan Reng", "", "", ("", "dan Reng", "")),
    ("", "23 Watt", "", "", ("", "23 Watt", "")), ("", "CNP 150.65.20.2,3", "", "", ("", "CNP 150.65.20.2,3", "")), ("di", "uraikan dalam gambar", "", "", ("", "di uraikan dalam gambar", "")), ("", "Bouwplank m1", "", "5", ("", "Bouwplank", "m1")),
]


def test_pdf_rows(spark):
    df = spark.createDataFrame([(i, *r[:4], None, None) for i, r in enumerate(PDF_ROWS)], "i int, no string, uraian string, satuan string, volume string, price string, total_price string")
    got = [(r["number"], r["description"], r["unit"]) for r in rows.normalize_pdf_rows(df).orderBy("i").collect()]
    assert got == [r[4] for r in PDF_ROWS]


def test_merge_broken_rows(spark):
    data = [("d", 1, "1", "Lampu LED Downlight", "unit", 76.0), ("d", 2, "", "23 Watt", "", 0.0), ("d", 3, "6", "Kaso C75", "m", 1302.22), ("d", 4, "", "tebal 0,75", "mm", 0.0), ("e", 1, "", "one", "", 0.0), ("e", 2, "", "two", "", 0.0)]
    got = [(r["doc_id"], r["row_idx"], r["description"], r["unit"]) for r in pdf.merge_broken_rows(spark.createDataFrame(data, "doc_id string, row_idx int, number string, description string, unit string, volume double")).orderBy("doc_id", "row_idx").collect()]
    assert got == [("d", 1, "Lampu LED Downlight 23 Watt", "unit"), ("d", 3, "Kaso C75 tebal 0,75 mm", "m"), ("e", 1, "one two", "")]


def test_sections_carry(spark):
    data = [(1, 0, ["No.", "Uraian", "Volume", "Satuan"])] + [(1, i + 1, r) for i, r in enumerate([["A", "Satu", "2,5", ""], ["II", "Dua", "9", ""], ["1", "x", "1,5", "pcs"], ["B", "Tiga", "", ""], ["2", "y", "", "m"], [None, None, None, None]])]
    got = [(r["description"], r["section_letter"], r["section_roman"], float(r["volume"])) for r in sheets.carry_sections(sheets.parse_sheet_rows(spark.createDataFrame(data, "file_id int, row_idx int, cells array<string>"))).orderBy("row_idx").collect()]
    assert got == [("Satu", "Satu", None, 2.5), ("Dua", "Satu", "Dua", 0.0), ("x", "Satu", "Dua", 1.5), ("Tiga", "Tiga", None, 0.0), ("y", "Tiga", None, 0.0)]


def test_price_match_and_breakdown(spark):
    prices = spark.createDataFrame([("AT.01.001", 25_000_000)], "code string, price_cents long")
    works = spark.createDataFrame([(1, "BT-02-010", 1_250_000)], "id long, code string, price_cents long")
    data = [(1, "AT-01-001", 2000, 10050), (2, "AT.01.001", 1500, None), (3, " ", 3000, None), (4, "  bt.02.010  ", 1000, None)]
    df = pricing.price_match(pricing.lookup_price(spark.createDataFrame(data, "row_id long, code string, volume_milli long, unit_price long"), prices, works))
    assert [(r["status"], r["total"], r["editable"]) for r in df.orderBy("row_id").collect()] == [("Overridden", 20100, True), ("Matched", 37_500_000, False), ("Needs Manual Input", 0, True), ("Matched", 1_250_000, False)]
    lines = spark.createDataFrame([("A", "labor", "L1", 2, None), ("A", "equipment", "E1", None, 3), ("A", "material", "M1", 4, None)], "code string, kind string, component_id string, quantity long, coefficient long")
    cat = spark.createDataFrame([("labor", "L1", "l", "h", 100, "b"), ("equipment", "E1", "e", "h", 25, "b"), ("material", "M1", "m", "kg", 25, "StubBrand")], "kind string, id string, name string, unit string, unit_price long, brand string")
    r = B.breakdown_totals(B.breakdown_lines(lines, cat), arrays=True).first()
    assert (r["labor"], r["equipment"], r["materials"], r["overall"]) == (200, 75, 100, 375) and r["material_lines"][0]["component_id"] == "M1"


def test_places_of_reference_names_on_many_rows(spark):
    """Ranges are written down before they are counted and ranked, however partitions are coalesced."""
    from kalkula.sources.catalogs import read_reference_names

    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    was = spark.conf.get(key)
    spark.conf.set(key, "2m")
    try:
        n = 1_500_000
        rows = spark.range(n).selectExpr("id as file_order", "concat('A-', id) as code", "concat('name ', id) as name")
        got = read_reference_names(rows).selectExpr("id", "cast(substr(code, 3) as long) + 1 as want")
        assert got.agg(F.count("*"), F.countDistinct("id"), F.sum((F.col("id") != F.col("want")).cast("int"))).first() == (n, n, 0)
    finally:
        spark.conf.set(key, was)


def test_topk_by_brute_force(spark):
    """Every candidate is scored; pruning, distinct pairs and ranks change nothing."""
    cat = spark.createDataFrame([*CATALOG, (7, "PT.05.002", "pemasangan pipa air bersih"), (8, "PT.05.003", "pipa"), (9, "GL.01", "galian tanah"), (10, "GL.02", "galian tanah liat di lereng curam sekali untuk pondasi jalan")], "id long, code string, name string").withColumn("plain", F.col("name"))
    asked = ["galian tanah", "pekerjaan galiann tanah", "pipa", "pipa air", "besi tulangn d10", "bongkar cor", "cat dinding", "pemasangan pipa air bersih", "zzz qqq"]
    q = spark.createDataFrame([(x, x) for x in asked], "query_id string, query string")
    found = [(r["query_id"], r["id"], r["plain"]) for r in M.retrieve_candidates(q, cat).collect()]
    expand = {r["query_id"]: r["e"] for r in q.withColumn("e", Y.expand_query(F.col("query"))).collect()}
    pairs = spark.createDataFrame(list({(a, c) for a, _, c in found}), "a string, c string").withColumn("p", S.partial_similarity(F.col("a"), F.col("c")))
    partial = {(r["a"], r["c"]): r["p"] for r in pairs.collect()}

    def top(score, least, k):
        out = set()
        for x in asked:
            own = sorted((-score(x, c), i) for a, i, c in found if a == x and score(x, c) >= least)
            out |= {(x, i, n + 1, round(-s, 4)) for n, (s, i) in enumerate(own[:k])}
        return out

    fuzzy = lambda a, c: max(brute.sequence_ratio(a, c), partial[a, c])
    sure = lambda a, c: max(brute.confidence(a, c), brute.confidence(expand[a], c))
    for least, k in ((0.6, 1), (0.25, 5), (0.8, 3)):
        assert {(r["query_id"], r["id"], r["rank"], round(r["score"], 4)) for r in M.fuzzy_match_topk(q, cat, least, k).collect()} == top(fuzzy, least, k)
        assert {(r["query_id"], r["id"], r["rank"], r["score"]) for r in M.confidence_match_topk(q, cat, least, k).collect()} == top(sure, least, k)


def test_near_words_by_brute_force(spark):
    import random

    rng = random.Random(5)
    ws = sorted({"".join(rng.choice("aeiknrst") for _ in range(rng.randint(6, 11))) for _ in range(150)} | {"galian", "galiann", "gallian", "tulangan", "tulangn", "tulangannya", "aaaaaa", "aaaaaaa", "aaaaab"})
    df = spark.createDataFrame([(w,) for w in ws], "word string")
    got = {(r["word"], r["other"]) for r in M.near_words(df, df.withColumnRenamed("word", "other")).collect()}
    assert got == {(a, b) for a in ws for b in ws if a != b and a[0] == b[0] and brute.sequence_ratio(a, b) >= 0.8}


def test_whole_cascade_by_brute_force(spark):
    """Abbreviations, exact matches, thresholds of one and more words, units, ties: every candidate is scored by definition."""
    cat_rows = [*CATALOG, (7, "PL.1", "plester dinding 1 m2"), (8, "PL.2", "plester dinding bata 1 m3"), (9, "PL.3", "plester dinding batu dan bata"), (10, "KR.1", "keramik"), (11, "KR.2", "keramik lantai"), (12, "KR.3", "keramik dinding 20x20"), (13, "KR.4", "pasang keramik lantai merah"), (14, "KR.5", "pasang keramik lantai putih"), (15, "BT.9", "beton beton cor k225"), (16, "PT.7", "pekerjaan pipa air bersih")]
    cat = spark.createDataFrame(cat_rows, "id long, code string, name string").withColumn("plain", T.normalize_text("name"))
    asked = [("PLST dinding", None), ("plst dinding bt", "m2"), ("plester dinding", "m3"), ("keramik", "m2"), ("keramikk", None), ("pasang keramik lantai", None), ("pasang keramik lantai hijau", "m2"), ("AT-01.001", None), ("pekerjaan galian tanah biasa", "kg"), ("beton k225", None), ("pipa air", "m"), ("zzz qqq", None), (" ", None), ("dan", None)]
    q = spark.createDataFrame([(i, r, u) for i, (r, u) in enumerate(asked)], "query_id long, raw string, user_unit string")
    spelt = q.withColumn("raw", T.expand_abbreviations(F.col("raw"))).withColumn("query", T.normalize_text("raw")).filter("query <> ''")
    known = {r["query_id"]: r for r in spelt.withColumn("e", Y.expand_query(F.col("query"))).collect()}
    found = M.filter_by_unit(M.retrieve_candidates(spelt, cat).join(spelt.select("query_id", "user_unit"), "query_id")).collect()
    key = lambda s: "".join(c for c in s.upper() if c.isalnum())
    want = set()
    for i, r in known.items():
        raw, query = r["raw"].strip(), r["query"]
        exact = [c for c in cat_rows if any(x.isdigit() for x in raw) and any(x.isalpha() for x in raw) and key(c[1]) == key(raw) and c[1].upper() in {raw.upper(), raw.upper().replace("-", "."), raw.upper().replace(".", "-")}] or [c for c in cat_rows if T.normal_form(c[2]) == query and c[2].lower().startswith(r["raw"])]
        if exact:
            want.add((i, min(exact)[0], 1, 1.0))
            continue
        least, k = (0.25, 5) if len(query.split()) == 1 else (0.6, 10)
        own = sorted((-s, c["id"]) for c in found if c["query_id"] == i and (s := max(brute.confidence(query, c["plain"]), brute.confidence(r["e"], c["plain"]))) >= least)[:k]
        own = own[:1] if len(query.split()) > 1 and own and -own[0][0] >= 0.9 else own
        want |= {(i, c, n + 1, round(-s, 4)) for n, (s, c) in enumerate(own)}
    got = {(r["query_id"], r["id"], r["rank"], round(r["score"], 4)) for r in M.best_match(q, cat).collect()}
    assert got == want
    assert len({w[0] for w in want}) >= 8


def test_code_containment_compares_no_codes_that_only_begin_alike(spark):
    codes = [(i, f"AT.{i // 4}-{i % 4}") for i in range(2000)] + [(5000, "B"), (5001, "xat.7"), (5002, "b.1.b.1")]
    asked = [f"at.{i}-1" for i in range(300, 420)] + ["t.49", "b", "-3", "at-7", "9-2", "b.1", "1234567890123"]
    catalog = spark.createDataFrame(codes, "id long, code string")
    df = M.code_variant_lookup(spark.createDataFrame([(q, q) for q in asked], "query_id string, query string"), catalog, contained=True).select("query_id", "id")
    rows = df.collect()
    forms = lambda q: {q, q.replace("-", "."), q.replace(".", "-")}
    assert sorted(map(tuple, rows)) == sorted((q, i) for q in asked for i, c in codes if any(f.upper() in c.upper() for f in forms(q)))
    # equal keys alone decide: no pairs of a form and a code are compared letter by letter
    assert "Contains(" not in df._jdf.queryExecution().executedPlan().toString()


def test_words_meet_kinds_of_names_not_every_name(spark):
    names = [f"{a} {m} {i}" for a in ("galian", "pekerjaan", "urugan pasir") for m in ("tanah", "hebel", "bata merah ringan", "betonku") for i in range(40)]
    catalog = spark.createDataFrame([(i, f"C.{i}", n, n) for i, n in enumerate(names)], "id long, code string, name string, plain string")
    asked = ["galiann tanah", "penggalian beton", "bata ringan", "hebel", "tanah", "urug pasir", "pasang lantai"]
    queries = spark.createDataFrame([(q, q) for q in asked], "query_id string, query string")
    assert M.Factors.of(queries, catalog).hits.count() < 60
    words = lambda q: [w for w in q.split() if len(w) >= 4]
    near = {("galiann", "galian"), ("galiann", "penggalian"), ("penggalian", "galian")}
    synonyms = Y.synonym_map()

    def hit(q, w, n):
        if any(t in n for t in (w, *synonyms.get(w, ()))):
            return True
        if any((w, x) in near and brute.sequence_ratio(w, x) >= 0.8 and w[0] == x[0] for x in n.split()):
            return True
        return any(c in q and w in c.split() and all(p in n for p in c.split()) for c in Y.COMPOUNDS)

    got = sorted(map(tuple, M.candidates_all_words(queries, catalog).collect()))
    assert got == sorted((q, n) for q in asked for n in names if all(hit(q, w, n) for w in words(q)))
    technical = lambda w: any(w.startswith(x) or w.endswith(x) for x in ("beton", "pasir")) or len(w) >= 6
    outright = lambda q, w, n: any(t in n for t in (w, *synonyms.get(w, ()))) or any(c in q and w in c.split() and all(p in n for p in c.split()) for c in Y.COMPOUNDS)
    got = sorted(map(tuple, M.candidates_any_material(queries, catalog).collect()))
    assert got == sorted((q, n) for q in asked for n in names if any(technical(w) and outright(q, w, n) for w in q.split()))


def test_expansion_deals_out_hot_kinds_and_gives_all_pairs(spark):
    asked = [(f"q{i}", "all" if i < 700 else f"s{i % 5}", i) for i in range(720)]
    pairs = [("all", k) for k in range(3)] + [(f"s{i}", i) for i in range(4)]
    rows = [(k, k * 100 + i) for k in range(5) for i in range(90 if k == 1 else 7)]
    frame = lambda data, schema: spark.createDataFrame(data, schema)
    want = sorted((q, n, r) for q, s, n in asked for s2, k in pairs if s == s2 for k2, r in rows if k == k2)
    got = M._expanded(frame(asked, "query_id string, set string, n int"), "set", frame(pairs, "set string, kind long"), frame(rows, "kind long, row int"))
    assert sorted(map(tuple, got.select("query_id", "n", "row").collect())) == want
    many, few = frame([(1, i) for i in range(500)] + [(2, 1), (None, 3)], "key int, a int"), frame([(1, i) for i in range(40)] + [(2, 2), (None, 4), (3, 1)], "key int, b int")
    dealt = fan_out(many, few, "key", at_once=1000)
    assert sorted(map(tuple, dealt.select("a", "b").collect())) == sorted([(i, j) for i in range(500) for j in range(40)] + [(1, 2)])
    assert len({r["p"] for r in dealt.select("a", "b", F.spark_partition_id().alias("p")).collect()}) > 1


def test_prefixes_meet_as_equals(spark):
    names = ["Galian", "galian tanah", "galian tanah 1", "gali", "g", "", "ga", "pekerjaan galian", "p" * 70, "p" * 150, "İstanbul", "galian tanah"]
    tokens = [("a", "gal"), ("a", "GALIAN"), ("b", "g"), ("c", "galian tanah"), ("d", ""), ("e", None), ("f", "p" * 65), ("f", "p" * 3), ("g", "p" * 151), ("h", "i̇s"), ("c", "galian tanah"), ("k", "galian tanah 1")]
    catalog = spark.createDataFrame(list(enumerate(names)) + [(0, "Galian")], "id long, name string")
    df = M.prefix_candidates(spark.createDataFrame(tokens, "query_id string, token string"), catalog).select("query_id", "id")
    rows = df.collect()
    assert sorted(map(tuple, rows)) == sorted({(q, i) for q, t in tokens if t for i, n in enumerate(names) if n.lower().startswith(t.lower())})
    assert "StartsWith(" not in df._jdf.queryExecution().executedPlan().toString()
