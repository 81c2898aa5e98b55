"""Rows of PDF pages against a plain page-by-page version."""

import random

from kalkula.operators import pdf
from kalkula.operators.rows import UNIT_WORDS

SCHEMA = "doc_id long, page int, x double, y double, text string"
KEYWORDS = {v for names in pdf.HEADERS.values() for v in names}


def plain(text):
    return " ".join(text.lower().split())


def page_header(frags):
    lines = {}
    for x, y, text in frags:
        lines.setdefault(int(y * 10 + 0.5), []).append(plain(text))
    held = {b: {k for k in KEYWORDS if any(k in t for t in ts)} for b, ts in lines.items()}
    core = [b for b in lines if set(pdf.CORE) <= held[b]]
    if core:
        return min(core)
    some = [b for b in lines if len(held[b]) >= 2]
    return min(some, key=lambda b: (-len(held[b]), b)) if some else min(lines, key=lambda b: (-len(lines[b]), b))


def page_columns(frags, top):
    runs = []
    for x, text in sorted((x, t.strip()) for x, y, t in frags if abs(y - top / 10) <= 0.5):
        if runs and x - runs[-1][0] <= 50:
            runs[-1][1] += " " + text
        else:
            runs.append([x, text])
    found = {k: next((x for x, t in runs if any(n in plain(t) for n in names)), None) for k, names in pdf.HEADERS.items()}
    found = {k: x for k, x in found.items() if x is not None}
    return found if set(pdf.CORE) <= set(found) else None


def brute(rows):
    out, bounds = [], {}
    pages = {}
    for doc, page, x, y, text in rows:
        if doc is not None and page is not None and text and text.strip():
            pages.setdefault((doc, page), []).append((x, y, text))
    for (doc, page), frags in sorted(pages.items()):
        top = page_header(frags)
        columns, header_y = page_columns(frags, top), None
        if columns:
            order = sorted((x, k) for k, x in columns.items())
            mid = [(a[0] + b[0]) / 2 for a, b in zip(order, order[1:])]
            bounds[doc] = [(k, mid[i - 1] if i else None, mid[i] if i < len(mid) else None) for i, (_, k) in enumerate(order)]
            header_y = top / 10
        if doc not in bounds:
            continue
        centres = [(0 if lo is None and hi is None else hi - 50 if lo is None else lo + 50 if hi is None else (lo + hi) / 2, float("-inf") if lo is None else lo, k) for k, lo, hi in bounds[doc]]
        lines = {}
        for x, y, text in frags:
            if header_y is None or y > header_y + 6:
                lines.setdefault(int(y * 10 + 0.5), []).append((x, text.strip(), y))
        for cells in lines.values():
            values, described = {}, False
            for x, text, _ in sorted(cells):
                key = min((abs(x - c), at, k) for c, at, k in centres)[2]
                token = "".join(c for c in text.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")
                long = key == "satuan" and (len(text.split()) > 2 or len(text) > 15)
                if long or (key == "satuan" and token and token not in UNIT_WORDS and described):
                    key = "uraian"
                described = described or key == "uraian"
                values.setdefault(key, []).append(text)
            values = {k: " ".join(v) for k, v in values.items()}
            if not any(c.isdigit() for c in values.get("volume", "")) and values.get("satuan", "").lower() not in UNIT_WORDS:
                values |= {"satuan": "", "volume": "0"}
            out.append((doc, page, round(sum(c[2] for c in cells) / len(cells), 6), tuple(sorted(values.items()))))
    return sorted(out)


def made(seed):
    r = random.Random(seed)
    rows = [(None, 1, 1.0, 1.0, "x"), (1, None, 1.0, 1.0, "x"), (1, 1, 3.0, 500.0, "  "), (1, 1, 3.0, 500.0, None)]
    for doc in range(25):
        for page in range(1, r.randint(2, 5)):
            heads = [["No", "Uraian", "Pekerjaan", "Volume", "Satuan", "Harga Satuan"], ["No", "URAIAN  PEKERJAAN", "Satuan", "Vol", "volume"], ["Catatan", "Jumlah"], []][r.randrange(4)]
            y0 = r.randint(10, 60)
            rows += [(doc, page, 10.0 + 70 * i + r.randint(0, 9), y0 + r.choice([0.0, 0.0, 0.1, 0.3]), h) for i, h in enumerate(heads)]
            rows += [(doc, page, float(r.randint(5, 420)), y0 + 4.0 * r.randint(-2, 12) + r.choice([0.0, 0.01, 0.02]), r.choice(["m2", "kg", "beton cor", "12,5", "3", "Pekerjaan tanah", " a b c d ", "x" * 20, "²"])) for _ in range(30)]
    return rows


def test_page_rows(spark):
    for seed in (1, 2):
        rows = made(seed)
        got = sorted((r.doc_id, r.page, round(r.row_y, 6), tuple(sorted(r["values"].items()))) for r in pdf.page_rows(spark.createDataFrame(rows, SCHEMA)).collect())
        assert got == brute(rows)
        assert len({p for _, p, _, _ in got}) > 1
    assert pdf.page_rows(spark.createDataFrame([], SCHEMA)).collect() == []


def test_same_rows_step_by_step(spark):
    frags = spark.createDataFrame(made(3), SCHEMA)
    bounds = pdf.carry_header(frags, pdf.column_boundaries(pdf.map_pdf_headers(frags, pdf.find_pdf_header(frags))))
    steps = pdf.assign_columns(pdf.group_fragments_to_rows(frags, bounds), bounds)
    key = lambda r: (r.doc_id, r.page, round(r.row_y, 6), tuple(sorted(r["values"].items())))
    assert sorted(map(key, steps.collect())) == sorted(map(key, pdf.page_rows(frags).collect()))


def test_one_exchange_steps_give_what_single_steps_give(spark):
    heads = [(10, "No"), (120, "Uraian"), (150, "Pekerjaan"), (260, "Volume"), (360, "Satuan")]
    rows = [("a", 1, float(x), 50.0, t) for x, t in heads] + [("b", 2, float(x), 30.0, t) for x, t in heads if t != "No"]
    rows += [("a", p, float(x), y, t) for p in (1, 2, 4) for y in (20.0, 55.0, 70.0, 90.0) for x, t in ((12, "1"), (125, "galian tanah"), (262, "3"), (361, "m2"))]
    rows += [("a", 3, 10.0, 10.0, " "), ("c", 1, 10.0, 10.0, "Uraian"), ("b", 1, 5.0, 5.0, "x"), ("b", 3, 5.0, 5.0, " ")]
    frags = spark.createDataFrame(rows, "doc_id string, page int, x double, y double, text string")
    plain = lambda df, *c: sorted((tuple(r) for r in df.select(*c).collect()), key=repr)
    columns = ("doc_id", "page", "header_y", "key", "low", "high")
    bounds = pdf.column_boundaries(pdf.map_pdf_headers(frags, pdf.find_pdf_header(frags)))
    assert plain(pdf.page_boundaries(frags), *columns) == plain(bounds, *columns) != []
    carried = pdf.carry_header(frags, bounds)
    assert plain(pdf.carried_boundaries(frags), *columns) == plain(carried, *columns)
    assert {(r["doc_id"], r["page"]) for r in carried.collect()} == {("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 2), ("b", 3)}
    cells = ("doc_id", "page", "bucket", "row_y", "x", "y", "text")
    assert plain(pdf.page_fragments(frags), *cells) == plain(pdf.group_fragments_to_rows(frags, carried), *cells) != []
    made = pdf.page_fragments(frags)
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    assert sum("REPARTITION_BY_COL" in line and "ReusedExchange" not in line for line in plan) == 1
