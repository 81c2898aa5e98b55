"""Running values in blocks against loops over the rows, and how the work is spread."""

import random

import pytest
from pyspark.sql import functions as F

from kalkula.operators import pdf, scans, sheets

SHEET = "file_id long, row_idx long, is_section boolean, index_kind string, description string, number string, volume decimal(38,6), unit string, analysis_code string, price decimal(38,6), total_price decimal(38,6)"


def sheet_rows(rng):
    """Files with gaps in their numbers, without sections, with sections far above the last block, and of one row."""
    out = []
    for f, n in ((1, 60), (2, 1), (3, 45), (None, 9)):
        for i in sorted(rng.sample(range(3 * n), n)):
            kind = rng.choice(["letter", "roman", "numeric", "none", "none", "none"]) if f != 3 else rng.choice(["none"] * 30 + ["letter", "roman"])
            section = kind in ("letter", "roman") and rng.random() < 0.9 or (None if rng.random() < 0.1 else False)
            out.append((f, i, section, kind, f"text {i}" if rng.random() < 0.9 else None, "1", None, "m", "", None, None))
    rng.shuffle(out)
    return out


def carried(rows):
    out, state = {}, {}
    for r in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        letter, roman, letter_at, roman_at = state.get(r[0], (None, None, -1, -1))
        if r[2] and r[3] == "letter":
            letter, letter_at = r[4], r[1]
        if r[2] and r[3] == "roman":
            roman, roman_at = r[4], r[1]
        state[r[0]] = (letter, roman, letter_at, roman_at)
        out[r[0], r[1]] = (letter, roman if roman_at > letter_at else None)
    return out


@pytest.mark.parametrize("block", [None, 1, 7, 1000])
def test_sections_are_those_of_a_loop(spark, block):
    rows = sheet_rows(random.Random(block))
    df = sheets.carry_sections(spark.createDataFrame(rows, SHEET), block)
    got = {(r["file_id"], r["row_idx"]): (r["section_letter"], r["section_roman"]) for r in df.collect()}
    assert got == carried(rows) and df.count() == len(rows)


@pytest.mark.parametrize("block", [None, 1, 7, 1000])
def test_places_are_those_of_a_sort(spark, block):
    rows = sheet_rows(random.Random(block))
    got = {(r["file_id"], r["row_idx"]): r["p"] for r in scans.numbered(spark.createDataFrame(rows, SHEET), "file_id", "row_idx", "p", block).collect()}
    want = {}
    for f in {r[0] for r in rows}:
        want |= {(f, i): p + 1 for p, i in enumerate(sorted(r[1] for r in rows if r[0] == f))}
    assert got == want
    typed = spark.createDataFrame(rows, SHEET)
    assert sorted(map(repr, sheets.typed_entries(typed, block).collect())) == sorted(map(repr, sheets.typed_entries(typed, None).collect()))
    shown = sheets.carry_sections(typed)
    assert sorted(map(repr, sheets.preview_rows(shown, block).collect())) == sorted(map(repr, sheets.preview_rows(shown, None).collect()))


@pytest.mark.parametrize("block", [None, 1, 5, 1000])
def test_broken_rows_are_those_of_a_loop(spark, block):
    rng = random.Random(7)
    rows = [(d, i, rng.choice(["", "", "", None, "1"]), f"w{i} ", rng.choice(["mm", " M2", "unit", "", None]), rng.choice([0.0, 0.0, 0.0, None, 2.5])) for d, n in (("a", 40), ("b", 1), ("c", 23)) for i in sorted(rng.sample(range(2 * n), n))]
    want = []
    for d in "abc":
        first = True
        for _, i, number, text, unit, volume in sorted((r for r in rows if r[0] == d), key=lambda r: r[1]):
            if first or number or volume:
                want.append([d, i, text])
            else:
                want[-1][2] += f" {text.strip()} {unit}" if (unit or "").strip().lower() in pdf.MEASURES else f" {text}"
            first = False
    df = pdf.merge_broken_rows(spark.createDataFrame(rows, "doc_id string, row_idx long, number string, description string, unit string, volume double"), block)
    assert sorted((r["doc_id"], r["row_idx"], r["description"]) for r in df.collect()) == sorted((d, i, t.strip()) for d, i, t in want)


@pytest.mark.parametrize("block", [1, 3])
def test_headers_carried_in_blocks(spark, block):
    pages = spark.createDataFrame([(d, p) for d in (1, 2, 3) for p in range(1, 12)], "doc_id long, page int")
    bounds = spark.createDataFrame([(d, p, 50.0, k, 1.0 * p, None) for d, ps in ((1, (2, 9)), (2, (1, 4, 5))) for p in ps for k in ("no", "uraian")], "doc_id long, page int, header_y double, key string, low double, high double")
    rows = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    assert rows(pdf.carry_header(pages, bounds, block)) == rows(pdf.carry_header(pages, bounds, None)) != []


def test_names_of_the_input_stay(spark):
    df = spark.createDataFrame([(1, i, f"p{i}", "x", "y", "z") for i in range(6)], "file_id long, row_idx long, part string, same string, own_part string, n string")
    out = scans.carry_down(df, "file_id", "row_idx", {"mark": (F.col("row_idx") % 4 == 1, F.col("part"))}, 2)
    assert [(r["part"], r["n"], r["mark"] and tuple(r["mark"])) for r in out.orderBy("row_idx").collect()] == [(f"p{i}", "z", None if i < 1 else (1, "p1") if i < 5 else (5, "p5")) for i in range(6)]
    assert [r["k"] for r in scans.numbered(df, "file_id", "row_idx", "k", 2).orderBy("row_idx").collect()] == list(range(1, 7))
    assert scans.carry_down(df.limit(0), "file_id", "row_idx", {"mark": (F.lit(True), None)}, 2).count() == 0


def test_one_long_file_is_spread(spark):
    """A file of 200,000 rows: no task of the window holds more than a few blocks."""
    rows = spark.range(200_000).selectExpr("7L as file_id", "id as row_idx", "id % 50000 = 3 as is_section", "if(id % 100000 = 3, 'letter', 'roman') as index_kind", "concat('t', id) as description")
    out = sheets.carry_sections(rows, 5000).withColumn("task", F.spark_partition_id())
    sizes = [r["n"] for r in out.groupBy("task").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 200_000 and max(sizes) <= 100_000 and len(sizes) > 1
    got = {r["row_idx"]: (r["section_letter"], r["section_roman"]) for r in out.filter("row_idx in (2, 3, 49999, 50003, 99999, 100003, 199999)").collect()}
    assert got == {2: (None, None), 3: ("t3", None), 49999: ("t3", None), 50003: ("t3", "t50003"), 99999: ("t3", "t50003"), 100003: ("t100003", None), 199999: ("t100003", "t150003")}
