"""Table rows from the text fragments of PDF pages: (doc_id, page, x, y, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kalkula.operators.names import free
from kalkula.operators.rows import PDF_SECTIONS, UNIT_WORDS, drop_url_rows, normalize_pdf_rows
from kalkula.operators.scans import BLOCK, carry_down
from kalkula.sources.shared import cut_lineage

# Parts of header texts and the columns they name.
HEADERS = {
    "no": ("no", "nomor", "urut"),
    "uraian": ("uraian", "uraian pekerjaan", "deskripsi", "pekerjaan", "jenis barang/jasa", "uraian pekerjaan/barang", "keterangan", "uraian barang"),
    "volume": ("volume", "vol", "qty", "jumlah", "kuantitas"),
    "satuan": ("satuan", "unit", "satuan unit", "uom"),
    "price": ("harga", "harga satuan", "nilai satuan", "harga/unit", "biaya"),
    "total_price": ("jumlah harga", "total harga", "jumlah", "harga total", "total biaya", "grand total"),
}
CORE = ("uraian", "satuan", "volume")
# Units that belong to the text of a continued row.
MEASURES = ("mm", "cm", "cm2", "cm3", "m2", "m3")
_KEYWORDS = sorted({v for variants in HEADERS.values() for v in variants})


def text_lines(fragments: DataFrame, blank_pages: bool = False) -> DataFrame:
    """doc_id, page, bucket (tenths of y) and cells: the line's fragments (x, text, y) from left to right, blank ones left out.

    blank_pages: blank fragments are in a line of their page with neither bucket nor cells, so that pages of only these stay.
    """
    shown = F.trim("text") != ""
    fragments = fragments.withColumn("bucket", F.when(shown, F.round(F.col("y") * 10).cast("long"))) if blank_pages else fragments.filter(shown).withColumn("bucket", F.round(F.col("y") * 10).cast("long"))
    cell = F.struct(F.col("x").cast("double").alias("x"), F.trim("text").alias("text"), F.col("y").cast("double").alias("y"))
    return fragments.groupBy("doc_id", "page", "bucket").agg(F.array_sort(F.collect_list(F.when(shown, cell) if blank_pages else cell)).alias("cells"))


def _ranked(lines: DataFrame) -> DataFrame:
    """text_lines with rank: a page's header has the least: all core words, then most header words (two at least), then most fragments."""
    # No keyword holds the separator, so a line holds a keyword just where one of its fragments does.
    df = lines.withColumn("plain", F.regexp_replace(F.lower(F.array_join("cells.text", "\x01")), r"\s+", " "))
    # Written out in place of a loop over an array, so that it is compiled.
    holds = lambda k: F.contains(F.col("plain"), F.lit(k))
    df = df.withColumn("words", sum((holds(k).cast("int") for k in _KEYWORDS), F.lit(0))).withColumn("core", holds(CORE[0]) & holds(CORE[1]) & holds(CORE[2]))
    rank = lambda a, b, c: F.struct(F.lit(a).alias("a"), b.cast("long").alias("b"), c.cast("long").alias("c"))
    order = F.when(F.col("core"), rank(0, F.col("bucket"), F.lit(0))).when(F.col("words") >= 2, rank(1, -F.col("words"), F.col("bucket"))).otherwise(rank(2, -F.size("cells"), F.col("bucket")))
    return df.withColumn("rank", F.when(F.col("bucket").isNotNull(), order)).drop("plain", "words", "core")


def find_pdf_header(fragments: DataFrame) -> DataFrame:
    """doc_id, page, header_bucket (tenths of y): the first line with all core words, else the first with most header words (two at least), else the fullest."""
    return _ranked(text_lines(fragments)).groupBy("doc_id", "page").agg(F.min_by("bucket", "rank").alias("header_bucket"))


def _near(y_tolerance: float) -> Column:
    """The cells of a line within the tolerance of the header."""
    return F.filter("cells", lambda c: F.abs(c["y"] - F.col("header_bucket") / 10) <= y_tolerance)


def _header_columns(near: DataFrame, gap: float) -> DataFrame:
    """doc_id, page, header_y and columns from lines (doc_id, page, header_bucket, cells) that hold the header's fragments.

    Columns are null where a core column lacks (a filter here would have them made twice).
    """
    lists = near.groupBy("doc_id", "page").agg(F.first("header_bucket").alias("header_bucket"), F.array_sort(F.flatten(F.collect_list("cells"))).alias("parts"))
    start = F.array().cast("array<struct<x:double,text:string>>")

    def step(runs, part):
        last = F.get(runs, F.size(runs) - 1)
        joined = F.struct(last["x"].alias("x"), F.concat_ws(" ", last["text"], part["text"]).alias("text"))
        rest = F.slice(runs, F.lit(1), F.greatest(F.lit(0), F.size(runs) - 1))
        return F.when((F.size(runs) > 0) & (part["x"] - last["x"] <= gap), F.concat(rest, F.array(joined))).otherwise(F.concat(runs, F.array(F.struct(part["x"].alias("x"), part["text"].alias("text")))))

    plain = F.transform(F.aggregate("parts", start, step), lambda r: F.struct(r["x"].alias("x"), F.regexp_replace(F.lower(r["text"]), r"\s+", " ").alias("text")))
    # Runs are stretches of the whole text: where that lacks a core column, they aren't made.
    text = F.regexp_replace(F.lower(F.array_join("parts.text", " ")), r"\s+", " ")
    some = text.rlike("|".join(HEADERS[CORE[0]])) & text.rlike("|".join(HEADERS[CORE[1]])) & text.rlike("|".join(HEADERS[CORE[2]]))
    merged = lists.withColumn("runs", F.when(some, plain))
    first = lambda variants: F.get(F.filter("runs", lambda r: r["text"].rlike("|".join(variants))), F.lit(0))["x"]
    entries = F.array(*(F.struct(F.lit(k).alias("key"), first(v).alias("x")) for k, v in HEADERS.items()))
    out = merged.select("doc_id", "page", (F.col("header_bucket") / 10).alias("header_y"), F.filter(entries, lambda e: e["x"].isNotNull()).alias("found"))
    whole = F.size(F.array_intersect("found.key", F.array(*map(F.lit, CORE)))) == 3
    return out.select("doc_id", "page", "header_y", F.when(whole, F.map_from_entries("found")).alias("columns"))


def _dealt(fragments: DataFrame) -> DataFrame:
    """Fragments dealt by page, without those that lack a document or page."""
    return fragments.filter("doc_id is not null and page is not null").select("doc_id", "page", "x", "y", "text").repartition("doc_id", "page")


def _headed(lines: DataFrame, y_tolerance: float, gap: float) -> DataFrame:
    """_header_columns of all pages of lines, nothing is exchanged."""
    header = _ranked(lines).withColumn("header_bucket", F.min_by("bucket", "rank").over(W.partitionBy("doc_id", "page"))).drop("rank")
    # Lines away from the header keep no cells, but their pages stay.
    near = header.withColumn("cells", F.when(F.abs(F.col("bucket") - F.col("header_bucket")) <= y_tolerance * 10 + 1, _near(y_tolerance)).otherwise(F.slice("cells", 1, 0)))
    return _header_columns(near, gap)


def page_boundaries(fragments: DataFrame, rules: DataFrame | None = None, y_tolerance: float = 0.5, gap: float = 50.0) -> DataFrame:
    """column_boundaries of the headers that find_pdf_header and map_pdf_headers find, with one exchange of the fragments for all three."""
    return _rows(page_bounds(_headed(text_lines(_dealt(fragments)), y_tolerance, gap), rules))


def _known(pages: DataFrame) -> DataFrame:
    """page_bounds of all pages of documents, each with its own or those of the last page with a header (header_y null then)."""
    top = F.when(F.col("bounds").isNotNull(), F.col("header_y"))
    before = W.partitionBy("doc_id").orderBy("page")
    return pages.select("doc_id", "page", top.alias("header_y"), F.last("bounds", ignorenulls=True).over(before).alias("bounds")).filter("bounds is not null")


def carried_boundaries(fragments: DataFrame, rules: DataFrame | None = None, y_tolerance: float = 0.5, gap: float = 50.0) -> DataFrame:
    """carry_header of fragments and their column_boundaries. Fragments are exchanged once; a row for each page goes to its document."""
    pages = page_bounds(_headed(text_lines(_dealt(fragments), blank_pages=True), y_tolerance, gap), rules)
    return _rows(_known(pages))


def map_pdf_headers(fragments: DataFrame, headers: DataFrame, y_tolerance: float = 0.5, gap: float = 50.0) -> DataFrame:
    """doc_id, page, header_y and a map from column to x. Fragments within gap of the first of a run are one header text.

    Pages whose header lacks a core column are left out.
    """
    lines = text_lines(fragments).join(headers, ["doc_id", "page"]).withColumn("cells", _near(y_tolerance)).filter(F.size("cells") > 0)
    return _header_columns(lines, gap).filter("columns is not null")


def page_bounds(mapped: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """doc_id, page, header_y and bounds: an array of (key, low, high), null at open ends; a row for each page, no exchange without rules.

    Bounds are midpoints between neighbouring headers; on pages with vertical rules (doc_id, page, x) the rules around the header.
    """
    out = mapped.withColumn("order", F.array_sort(F.transform(F.map_entries("columns"), lambda e: F.struct(e["value"].alias("x"), e["key"].alias("key")))))

    def middle(c, i):
        low = F.when(i > 0, (F.get("order", i - 1)["x"] + c["x"]) / 2)
        return F.struct(c["key"].alias("key"), low.alias("low"), ((F.get("order", i + 1)["x"] + c["x"]) / 2).alias("high"))

    if rules is None:
        return out.select("doc_id", "page", "header_y", F.transform("order", middle).alias("bounds"))

    def ruled(c):
        left, right = F.array_max(F.filter("lines", lambda r: r <= c["x"])), F.array_min(F.filter("lines", lambda r: r > c["x"]))
        return F.struct(c["key"].alias("key"), left.alias("low"), right.alias("high"))

    out = out.join(rules.groupBy("doc_id", "page").agg(F.collect_set("x").alias("lines")), ["doc_id", "page"], "left")
    bounds = F.when(F.col("lines").isNull(), F.transform("order", middle)).otherwise(F.transform("order", ruled))
    return out.select("doc_id", "page", "header_y", bounds.alias("bounds"))


def column_boundaries(mapped: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """page_bounds as doc_id, page, header_y, key, low, high."""
    return _rows(page_bounds(mapped, rules))


def _rows(bounds: DataFrame) -> DataFrame:
    """A row for each column. An outer inline, as for a plain one Catalyst puts a filter below, for which the bounds are made once more."""
    return bounds.select("doc_id", "page", "header_y", F.inline_outer("bounds")).filter("key is not null")


def carry_header(pages: DataFrame, bounds: DataFrame, block: int | None = BLOCK) -> DataFrame:
    """Bounds for every page (doc_id, page): its own, else those of the last page with a header, and then the body starts at the top (header_y null).

    block: documents beyond so many pages are carried down in parts (scans.carry_down).
    """
    own = bounds.select("doc_id", "page").distinct().withColumn("own_page", F.col("page"))
    known = pages.select("doc_id", "page").distinct().join(own, ["doc_id", "page"], "left")
    source = carry_down(known, "doc_id", "page", {"source": (F.col("own_page").isNotNull(), None)}, block).filter("source is not null").select("doc_id", "page", F.col("source.at").alias("from_page"))
    out = source.join(bounds.withColumnRenamed("page", "from_page"), ["doc_id", "from_page"])
    return out.withColumn("header_y", F.when(F.col("page") == F.col("from_page"), F.col("header_y"))).drop("from_page")


def group_fragments_to_rows(fragments: DataFrame, bounds: DataFrame, below: float = 6.0) -> DataFrame:
    """Fragments under the header with their line: bucket (tenths of y) and row_y (mean)."""
    tops = bounds.groupBy("doc_id", "page").agg(F.first("header_y").alias("header_y"))
    body = fragments.filter("trim(text) <> ''").join(tops, ["doc_id", "page"]).filter(F.col("header_y").isNull() | (F.col("y") > F.col("header_y") + below)).withColumn("bucket", F.round(F.col("y") * 10).cast("long"))
    # Dealt by page for the join already, so lines need no exchange of their own.
    return body.drop("header_y").withColumn("row_y", F.avg("y").over(W.partitionBy("doc_id", "page", "bucket")))


def _rows_of(lines: DataFrame) -> DataFrame:
    """doc_id, page, row_y and values from lines (cells) with their page's bounds; nothing is exchanged."""

    def centred(b):
        low, high = b["low"], b["high"]
        centre = F.when(low.isNull() & high.isNull(), 0.0).when(low.isNull(), high - 50).when(high.isNull(), low + 50).otherwise((low + high) / 2)
        return F.struct(centre.alias("centre"), F.coalesce(low, F.lit(float("-inf"))).alias("at"), b["key"].alias("key"))

    def placed(c):
        nearest = F.array_min(F.transform("cols", lambda k: F.struct(F.abs(c["x"] - k["centre"]).alias("d"), k["at"].alias("at"), k["key"].alias("key"))))["key"]
        return F.struct(c["text"].alias("text"), nearest.alias("key"))

    def marked(c):
        unit = c["key"] == "satuan"
        long = unit & ((F.size(F.split(c["text"], r"\s+")) > 2) | (F.length(c["text"]) > 15))
        token = F.when(unit, F.regexp_replace(F.lower(c["text"]), "[^a-z0-9]", ""))
        other = F.coalesce((token != "") & ~token.isin(*UNIT_WORDS), F.lit(False))
        return F.struct(c["text"].alias("text"), F.when(long, "uraian").otherwise(c["key"]).alias("key"), other.alias("other"))

    def settled(c, i):
        described = (F.col("described") > 0) & (i >= F.col("described"))
        return F.struct(c["text"].alias("text"), F.when(c["other"] & described, "uraian").otherwise(c["key"]).alias("key"))

    df = lines.withColumn("cols", F.transform("bounds", centred)).withColumn("row_y", F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["y"]) / F.size("cells"))
    df = df.withColumn("cells", F.transform("cells", placed)).withColumn("cells", F.transform("cells", marked))
    df = df.withColumn("described", F.array_position("cells.key", F.lit("uraian"))).withColumn("cells", F.transform("cells", settled))
    df = df.withColumn("keys", F.array_sort(F.array_distinct("cells.key")))
    value = lambda k: F.array_join(F.transform(F.filter("cells", lambda c: c["key"] == k), lambda c: c["text"]), " ")
    values = F.map_from_entries(F.transform("keys", lambda k: F.struct(k.alias("key"), value(k).alias("value"))))
    return df.select("doc_id", "page", "row_y", values.alias("values")).select("doc_id", "page", "row_y", reset_implausible(F.col("values")).alias("values"))


def assign_columns(lines: DataFrame, bounds: DataFrame) -> DataFrame:
    """doc_id, page, row_y and values (map from column to text): each fragment goes to the column with the nearest centre.

    A fragment in the unit column that is long, or no unit while the description already has text, goes to the description. A
    row with neither a digit in its volume nor a known unit gets an empty unit and the volume 0. Lines are dealt by page once.
    """
    columns = bounds.groupBy("doc_id", "page").agg(F.collect_list(F.struct("key", "low", "high")).alias("bounds"))
    return _rows_of(text_lines(lines).join(columns, ["doc_id", "page"]))


def page_rows(fragments: DataFrame, rules: DataFrame | None = None, y_tolerance: float = 0.5, gap: float = 50.0, below: float = 6.0) -> DataFrame:
    """Rows of all pages (assign_columns) from fragments, which are dealt by page in one exchange for all steps.

    Lines, headers and cells are made within a page's partition; what else moves is a row of bounds for each page: to its
    document, for pages that take the bounds of an earlier one (carry_header), and back. Fragments without document or page go.
    """
    return _rows_of(_body(fragments, rules, y_tolerance, gap, below))


def _body(fragments: DataFrame, rules: DataFrame | None, y_tolerance: float, gap: float, below: float) -> DataFrame:
    """Lines with their page's bounds and the cells under its header."""
    lines = text_lines(_dealt(fragments.filter("trim(text) <> ''")))
    known = _known(page_bounds(_headed(lines, y_tolerance, gap), rules))
    body = F.filter("cells", lambda c: F.col("header_y").isNull() | (c["y"] > F.col("header_y") + below))
    # Hashed are the pages' bounds: lines stay where they are dealt, and neither side is sent to all.
    return lines.join(known.hint("shuffle_hash"), ["doc_id", "page"]).withColumn("cells", body).filter(F.size("cells") > 0)


def page_fragments(fragments: DataFrame, rules: DataFrame | None = None, y_tolerance: float = 0.5, gap: float = 50.0, below: float = 6.0) -> DataFrame:
    """group_fragments_to_rows of fragments and their carried_boundaries: doc_id, page, bucket, row_y, x, text (trimmed) and y, dealt by page once."""
    lines = _body(fragments, rules, y_tolerance, gap, below)
    return lines.select("doc_id", "page", "bucket", (F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["y"]) / F.size("cells")).alias("row_y"), F.inline("cells"))


def reset_implausible(values: Column) -> Column:
    """The map from column to text, with an empty unit and the volume 0 if the volume has no digit and the unit is unknown."""
    volume, unit = (F.coalesce(values[k], F.lit("")) for k in ("volume", "satuan"))
    odd = ~volume.rlike("[\\p{Nd}\u00b2\u00b3\u00b9\u2070-\u2079\u2080-\u2089]") & ~F.lower(unit).isin(*UNIT_WORDS)
    rest = F.map_filter(values, lambda k, _: ~k.isin("satuan", "volume"))
    return F.when(odd, F.map_concat(rest, F.create_map(F.lit("satuan"), F.lit(""), F.lit("volume"), F.lit("0")))).otherwise(values)


def merge_broken_rows(rows: DataFrame, block: int | None = BLOCK) -> DataFrame:
    """Rows (doc_id, row_idx, number, description, unit, volume, ...) without number and volume are appended to the last row kept.

    Their unit is appended too if it is a measure, and lost if it is another. The first row of a document is always kept.
    block: documents beyond so many rows are marked in parts (scans.carry_down); what is appended to one row is gathered once.
    """
    island = free(rows, "island")
    starts = (F.coalesce("number", F.lit("")) != "") | (F.col("volume") != 0)
    marked = carry_down(rows, "doc_id", "row_idx", {island: (starts, None)}, block)
    suffix = F.when(F.lower(F.trim("unit")).isin(*MEASURES), F.concat_ws(" ", F.trim("description"), "unit")).otherwise(F.col("description"))
    parts = F.array_sort(F.collect_list(F.struct("row_idx", F.col("description").alias("first"), suffix.alias("text"))))
    text = F.trim(F.array_join(F.transform(parts, lambda s, i: F.when(i == 0, s["first"]).otherwise(s["text"])), " ")).alias("description")
    rest = [c for c in rows.columns if c not in ("doc_id", "description")]
    merged = marked.groupBy("doc_id", island).agg(text, F.min_by(F.struct(*rest), "row_idx").alias("head"))
    return merged.select("doc_id", "description", *(F.col(f"head.{c}").alias(c) for c in rest))


def mark_pdf_sections(rows: DataFrame) -> DataFrame:
    """is_section, section_type and number: numerals up to fifteen are sections, of these `I` a category numbered A; total is volume by price."""
    number = F.upper(F.trim(F.coalesce("number", F.lit(""))))
    out = rows.withColumn("is_section", number.isin(*PDF_SECTIONS)).withColumn("section_type", F.when(number == "I", "CATEGORY").when(number.isin(*PDF_SECTIONS), "SECTION"))
    return out.withColumn("number", F.when(number == "I", "A").otherwise(F.col("number"))).withColumn("total_price", F.coalesce("volume", F.lit(0)) * F.coalesce("price", F.lit(0)))


#: Numbers of row_idx for each page: tenths of a point down the page stay below it.
_PAGE = 1 << 20


def document_rows(fragments: DataFrame, rules: DataFrame | None = None, pages: int = 1000) -> DataFrame:
    """Typed rows of documents (file_id, row_idx) from the fragments of their pages: repaired, continued rows joined, rows
    with links left out, sections marked.

    row_idx grows down the pages. Documents beyond so many pages are gone through in parts.
    """
    cell = lambda k: F.col("values")[k].alias(k)
    at = (F.col("page").cast("long") * _PAGE + F.round(F.col("row_y") * 10).cast("long")).alias("row_idx")
    # Written down between the steps: as one plan their expressions would be put into each other many times over.
    cells = cut_lineage(page_rows(fragments, rules).select("doc_id", at, *map(cell, HEADERS)))
    whole = merge_broken_rows(cut_lineage(normalize_pdf_rows(cells)), pages * _PAGE)
    return mark_pdf_sections(drop_url_rows(whole)).withColumnRenamed("doc_id", "file_id")
