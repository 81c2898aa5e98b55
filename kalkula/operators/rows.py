"""Typing, repair and validation of single rows of cost sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalkula.functions.numbers import coerce_decimal, convert_decimal, parse_pdf_decimal
from kalkula.functions.text import canonical_code, clean_cell

# Words that a unit cell may hold.
UNIT_WORDS = ("ls", "m", "m1", "m2", "m3", "mm", "cm", "cm2", "cm3", "kg", "ton", "l", "lt", "ltr", "bh", "buah", "unit", "set", "paket", "hari", "jam", "mtr", "btg", "batang", "lembar", "lbr", "orang", "pak", "roll", "pcs", "meter", "pasang", "kegiatan", "psg", "titik", "ttk")
# Numbers of sub-sections of typed entries, and of sections of PDF rows.
SUB_SECTIONS = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X")
PDF_SECTIONS = (*SUB_SECTIONS, "XI", "XII", "XIII", "XIV", "XV")


def classify_index_token(token: Column) -> Column:
    """letter, roman, numeric or none. One character is a letter, whatever it could mean as a numeral."""
    t = F.upper(F.regexp_replace(F.trim(F.coalesce(token, F.lit(""))), r"[ .)]+$", ""))
    return F.when(t.rlike("^[A-Z]$"), "letter").when(t.rlike("^[IVXLCDM]+$"), "roman").when(F.regexp_replace(t, "[.,]", "").rlike("^[0-9]+$"), "numeric").otherwise("none")


def is_upper(text: Column) -> Column:
    """No lower-case letter, and some upper-case one."""
    return F.coalesce((text == F.upper(text)) & (text != F.lower(text)), F.lit(False))


def is_section_row(number: Column, description: Column) -> Column:
    kind = classify_index_token(number)
    return F.when(kind.isin("letter", "roman"), True).when(kind == "numeric", False).otherwise(is_upper(F.trim(description)))


def classify_entry(number: Column, description: Column) -> Column:
    """Kind of a typed entry, null for an empty row. Numerals up to ten come before letters here."""
    n, d = clean_cell(number), clean_cell(description)
    low = F.lower(d)
    return (
        F.when(n.isNull() & d.isNull(), F.lit(None).cast("string")).when(low.startswith("terbilang"), "GRAND_TOTAL").when(low.startswith("sub total") | low.startswith("total"), "SUB_TOTAL")
        .when(F.upper(n).isin(*SUB_SECTIONS), "SUB_SECTION").when(n.rlike(r"^\p{Lu}$"), "SECTION").when(n.isNotNull(), "ITEM").when(is_upper(d), "SITE").otherwise("ITEM")
    )


def parse_entries(rows: DataFrame) -> DataFrame:
    """entry_type, cleaned cells, numbers, and the words of a grand total after its first colon; rows without a description go."""
    out = rows.withColumn("entry_type", classify_entry(F.col("number"), F.col("description"))).withColumn("description", clean_cell(F.col("description"))).filter(F.col("description").isNotNull() & F.col("entry_type").isNotNull())
    for c in ("volume", "unit_price", "total_price"):
        out = out.withColumn(c, convert_decimal(F.col(c)))
    colon = F.instr("description", ":")
    words = F.when((F.col("entry_type") == "GRAND_TOTAL") & (colon > 0), F.trim(F.expr("substring(description, instr(description, ':') + 1)")))
    return out.withColumn("amount_words", words).withColumn("number", clean_cell(F.col("number")))


def split_number_prefix(description: Column) -> Column:
    """struct(number, rest): a numeral (not before a letter or digit), else digits, else a letter before a dot or bracket, from the beginning."""
    roman, rest = F.regexp_extract(description, r"^\s*([IVXLCDMivxlcdm]+)", 1), F.regexp_extract(description, r"^\s*[IVXLCDMivxlcdm]+\.?\s*([\s\S]*)$", 1)
    glued = description.rlike(r"^\s*[IVXLCDMivxlcdm]+[\p{L}\p{N}]")
    pick = lambda number, tail: F.struct(number.alias("number"), tail.alias("rest"))
    digits = pick(F.regexp_extract(description, r"^\s*(\d+)", 1), F.regexp_extract(description, r"^\s*\d+(?:[.)\-]?\s*)?([\s\S]*)$", 1))
    letter = pick(F.regexp_extract(description, r"^\s*([a-zA-Z])[.)]", 1), F.regexp_extract(description, r"^\s*[a-zA-Z][.)]\s*([\s\S]*)$", 1))
    none = pick(F.lit(""), description)
    return F.when((roman != "") & ~glued, pick(roman, rest)).when(roman != "", none).when(description.rlike(r"^\s*\d"), digits).when(description.rlike(r"^\s*[a-zA-Z][.)]"), letter).otherwise(none)


def _unit_key(token: Column) -> Column:
    return F.regexp_replace(F.lower(token), "[^a-z0-9]", "")


def split_unit_cell(cell: Column) -> Column:
    """struct(words, unit): the first unit word of a cell of one or two words, and what else it holds; else all of it is words."""
    text = F.trim(F.coalesce(cell, F.lit("")))
    tokens = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    units = F.filter(tokens, lambda w: _unit_key(w).isin(*UNIT_WORDS))
    rest = F.array_join(F.filter(F.transform(tokens, lambda w, i: F.when((i + 1) != F.array_position(tokens, F.get(units, F.lit(0))), w)), lambda w: w.isNotNull()), " ")
    whole = F.struct(text.alias("words"), F.lit("").alias("unit"))
    return F.when((F.size(units) == 0) | (F.size(tokens) > 2), whole).otherwise(F.struct(rest.alias("words"), F.get(units, F.lit(0)).alias("unit")))


def split_unit_tail(description: Column) -> Column:
    """struct(words, unit): a unit word at the end of a longer description."""
    tokens = F.filter(F.split(F.trim(description), r"\s+"), lambda w: w != "")
    last = F.get(tokens, F.size(tokens) - 1)
    ends = (F.size(tokens) >= 2) & _unit_key(last).isin(*UNIT_WORDS)
    return F.when(ends, F.struct(F.array_join(F.slice(tokens, F.lit(1), F.greatest(F.lit(0), F.size(tokens) - 1)), " ").alias("words"), last.alias("unit"))).otherwise(F.struct(description.alias("words"), F.lit("").alias("unit")))


def normalize_pdf_rows(rows: DataFrame) -> DataFrame:
    """Repairs rows (no, uraian, satuan, volume, price, total_price): number, description, unit and numbers.

    Headings (all upper case, or naming a `pekerjaan`) keep number and description only. In other rows words in the unit
    cell go to the description and a unit at the description's end to the unit; a short numbered piece without unit or
    volume is a continuation; a word in the number cell goes back to the description.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    out = rows.withColumn("number", blank(F.col("no"))).withColumn("description", blank(F.col("uraian"))).withColumn("unit_cell", blank(F.col("satuan")))
    out = out.withColumn("no_text", F.col("description") == "").withColumn("split", split_number_prefix(F.col("description")))
    glued = (F.col("number") == "") & (F.col("description") != "") & (F.col("split.number") != "") & (F.trim("split.rest") != "")
    out = out.withColumn("glued", glued).withColumn("number", F.when(F.col("glued"), F.trim("split.number")).otherwise(F.col("number"))).withColumn("description", F.when(F.col("glued"), F.trim("split.rest")).otherwise(F.col("description")))
    out = out.withColumn("heading", is_upper(F.col("description")) | F.contains(F.lower("description"), F.lit("pekerjaan")))
    # what is left at the front of a row without number may be one more
    out = out.withColumn("cell", split_unit_cell(F.col("unit_cell"))).withColumn("full", F.trim(F.concat_ws(" ", F.nullif("description", F.lit("")), F.nullif(F.col("cell.words"), F.lit("")))))
    out = out.withColumn("tail", split_unit_tail(F.col("full"))).withColumn("real", F.when(F.col("cell.unit") != "", F.col("cell.unit")).otherwise(F.col("tail.unit")))
    low = F.lower("unit_cell")
    odd = F.contains(low, F.lit("pekerjaan")) | F.contains(low, F.lit("sistem")) | F.contains(low, F.lit("manajemen")) | is_upper(F.col("unit_cell")) | (F.size(F.split("unit_cell", r"\s+")) > 2)
    unit = F.when(F.col("real") != "", F.col("real")).when(F.col("no_text") & odd & ~_unit_key(F.col("unit_cell")).isin(*UNIT_WORDS), "").otherwise(F.col("unit_cell"))
    out = out.withColumn("unit", unit).withColumn("text", F.when(F.col("tail.unit") != "", F.col("tail.words")).otherwise(F.col("full"))).withColumn("amount", parse_pdf_decimal(F.col("volume")))
    piece = F.col("number").rlike("^[0-9]+$") & (F.col("text") != "") & (F.size(F.split("text", r"\s+")) <= 3) & (F.length("text") <= 25) & (F.trim("unit") == "") & (F.col("amount") == 0)
    out = out.withColumn("piece", piece).withColumn("text", F.when(F.col("piece"), F.concat_ws(" ", "number", "text")).otherwise(F.col("text"))).withColumn("no2", F.when(F.col("piece"), "").otherwise(F.col("number")))
    letters = F.regexp_replace("no2", "[^a-zA-Z]", "")
    word = (F.length(letters) > 1) & ~(is_upper(F.col("no2")) & F.upper(letters).rlike("^[IVXLCDM]+$"))
    out = out.withColumn("word", word).withColumn("text", F.when(F.col("word"), F.trim(F.concat_ws(" ", "no2", F.nullif("text", F.lit(""))))).otherwise(F.col("text"))).withColumn("no2", F.when(F.col("word"), "").otherwise(F.col("no2")))
    head = lambda kept, value: F.when(F.col("heading"), kept).otherwise(value)
    zero = F.lit(0).cast("decimal(38,6)")
    own = [c for c in rows.columns if c not in ("no", "uraian", "satuan", "volume", "price", "total_price")]
    return out.select(
        *own, head(F.col("number"), F.col("no2")).alias("number"), head(F.col("description"), F.col("text")).alias("description"), head(F.lit(""), F.col("unit")).alias("unit"),
        head(zero, F.col("amount")).alias("volume"), head(zero, parse_pdf_decimal(F.col("price"))).alias("price"), head(zero, parse_pdf_decimal(F.col("total_price"))).alias("total_price"),
    )


def is_link(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.coalesce(t.rlike(r"^https?://|^www\.|\.com|\.id|\.org|\.net|\.gov"), F.lit(False))


def drop_url_rows(rows: DataFrame, description: str = "description") -> DataFrame:
    return rows.filter(~is_link(F.col(description)))


def validate_match_input(rows: DataFrame) -> DataFrame:
    """description and unit trimmed, status ok or error with a reason; bad rows stay."""
    d, u = F.trim("description"), F.nullif(F.trim("unit"), F.lit(""))
    reason = F.when(d.isNull(), "Description is required.").when(d == "", "Description cannot be empty.").when(F.length(d) > 1024, "Description is too long.").when((F.length(u) > 32) | ~u.rlike(r"^[A-Za-z0-9./\-\s]*$"), "Unit contains invalid characters.")
    return rows.withColumn("description", d).withColumn("unit", u).withColumn("reason", reason).withColumn("status", F.when(reason.isNull(), "ok").otherwise("error"))


def _named(field: str, bad: Column, message: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.lit(f"{field}: {message}"))


def validate_price_payload(rows: DataFrame) -> DataFrame:
    """Rows (code, name, unit, volume, unit_price, components) with canonical code, numbers and the array of errors; components report their place."""
    code, volume, price = canonical_code(F.col("code")), coerce_decimal(F.col("volume")), coerce_decimal(F.col("unit_price"))
    own = F.array(
        _named("code", F.coalesce(F.trim("code"), F.lit("")) == "", "required"), _named("code", (F.length(code) > 64) | (F.coalesce(F.trim("code"), F.lit("")) != "") & ~F.col("code").rlike(r"^[A-Za-z0-9._/\-\s]*$"), "invalid"),
        _named("name", F.coalesce(F.trim("name"), F.lit("")) == "", "required"), _named("unit", F.coalesce(F.trim("unit"), F.lit("")) == "", "required"),
        _named("volume", volume["error"].isNotNull(), "not a number"), _named("volume", volume["value"] < 0, "negative"), _named("unit_price", price["error"].isNotNull(), "not a number"), _named("unit_price", price["value"] < 0, "negative"),
    )
    parts = F.flatten(F.transform("components", lambda c, i: F.array(*(F.when(F.coalesce(F.trim(c[f]), F.lit("")) == "", F.concat(F.lit("components["), i.cast("string"), F.lit(f"].{f}: required"))) for f in ("code", "name")), F.when(coerce_decimal(c["coefficient"])["error"].isNotNull(), F.concat(F.lit("components["), i.cast("string"), F.lit("].coefficient: not a number"))))))
    errors = F.array_compact(F.concat(own, F.coalesce(parts, F.array().cast("array<string>"))))
    return rows.withColumn("errors", errors).withColumn("code", code).withColumn("volume", volume["value"]).withColumn("unit_price", price["value"]).withColumn("total", F.round(F.col("volume") * F.col("unit_price"), 2))


def validate_recompute_payload(rows: DataFrame) -> DataFrame:
    """row_key pattern, codes made canonical (the analysis code defaults to the code), numbers not negative; errors by field."""
    key, code = F.trim("row_key"), canonical_code(F.col("code"))
    volume, price = coerce_decimal(F.coalesce("volume", "quantity")), coerce_decimal(F.coalesce("unit_price", "price"))
    errors = F.array_compact(F.array(
        _named("row_key", F.coalesce(key, F.lit("")) == "", "required"), _named("row_key", (F.length(key) > 128) | ~F.coalesce(key, F.lit("")).rlike(r"^[A-Za-z0-9_.:\-]*$"), "invalid"), _named("code", ~F.coalesce("code", F.lit("")).rlike(r"^[A-Za-z0-9._/\-\s]*$"), "invalid"),
        _named("volume", volume["error"].isNotNull() | (volume["value"] < 0), "invalid"), _named("unit_price", price["error"].isNotNull() | (price["value"] < 0), "invalid"),
    ))
    return rows.withColumn("errors", errors).withColumn("analysis_code", F.coalesce(F.nullif(canonical_code(F.col("analysis_code")), F.lit("")), F.nullif(code, F.lit("")))).withColumn("code", F.nullif(code, F.lit(""))).withColumn("volume", volume["value"]).withColumn("unit_price", price["value"])


def cost_rejects(rows: DataFrame, cost: str = "cost") -> DataFrame:
    """Rows whose cost isn't a number or is negative, with the reason."""
    value = F.col(cost).try_cast("decimal(28,6)")
    return rows.withColumn("reason", F.when(value.isNull(), "not a number").when(value < 0, "negative")).filter("reason is not null")
