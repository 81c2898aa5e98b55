"""The six grammars of written numbers, dates and the rounding of money, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = "decimal(38,6)"


def _without(s: Column, *parts: str) -> Column:
    for p in parts:
        s = F.replace(s, F.lit(p), F.lit(""))
    return s


def _comma_to_dot(s: Column) -> Column:
    return F.replace(s, F.lit(","), F.lit("."))


def _separators(s: Column) -> Column:
    """The last of the two separators, or a comma alone, marks the decimals."""
    comma, dot = F.length(s) - F.locate(",", F.reverse(s)), F.length(s) - F.locate(".", F.reverse(s))
    both = F.contains(s, F.lit(",")) & F.contains(s, F.lit("."))
    last_comma = _comma_to_dot(_without(s, "."))
    return F.when(both, F.when(comma > dot, last_comma).otherwise(_without(s, ","))).when(F.contains(s, F.lit(",")), _comma_to_dot(s)).otherwise(s)


def parse_rupiah(raw: Column) -> Column:
    """Dots are always thousands, a comma marks decimals; a dash or no digit is null."""
    s = F.trim(_without(F.upper(F.trim(raw)), "RP", "\u2009"))
    kept = F.regexp_replace(_comma_to_dot(_without(s, ".")), r"[^0-9.\-]", "")
    return F.when((s != "-") & s.rlike("[0-9]"), kept.try_cast("decimal(20,2)"))


def _sheet(s: Column) -> Column:
    thousands_dot, thousands_comma = s.rlike(r"^\d{1,3}(\.\d{3})+,\d+$"), s.rlike(r"^\d{1,3}(,\d{3})+\.\d+$")
    return F.when(thousands_dot, _comma_to_dot(_without(s, "."))).when(thousands_comma, _without(s, ",")).otherwise(_separators(s))


def parse_sheet_decimal(raw: Column) -> Column:
    """Whatever isn't a number, a formula or a product among others, is 0."""
    s = F.trim(raw)
    bad = s.isNull() | ~s.rlike("[0-9]") | F.contains(s, F.lit("=")) | s.rlike(r"\d+\s*[xX]\s*\d+")
    return F.coalesce(F.when(~bad, F.regexp_replace(_sheet(s), r"[^\d.\-]", "").try_cast(NUMBER)), F.lit(0).cast(NUMBER))


def coerce_decimal(raw: Column) -> Column:
    """struct(value, error): a blank is null without error, whatever isn't a number is null with one; a plus sign stays."""
    s = F.nullif(F.trim(raw), F.lit(""))
    bad = ~s.rlike("[0-9]") | F.contains(s, F.lit("=")) | s.rlike(r"\d+\s*[xX]\s*\d+")
    value = F.when(~bad, F.regexp_replace(_sheet(s), r"[^0-9.+\-]", "").try_cast(NUMBER))
    return F.struct(value.alias("value"), F.when(s.isNotNull() & value.isNull(), F.lit("not a number")).alias("error"))


def convert_decimal(raw: Column) -> Column:
    """Currency off, scientific notation as it is; with both separators up to three digits after a single dot are decimals."""
    s = F.trim(_without(raw, "Rp"))
    after, dots = F.substring_index(s, ".", -1), F.length(s) - F.length(_without(s, "."))
    has_comma = F.contains(s, F.lit(","))
    us = (dots == 1) & after.rlike(r"^\d{1,3}$")
    mixed = F.when(us, _without(s, ",")).otherwise(_comma_to_dot(_without(s, ".")))
    dotted = F.when((dots > 1) | ((dots == 1) & (after == "000")), _without(s, ".")).otherwise(s)
    plain = F.when(F.upper(s).contains("E"), s).when(has_comma & (dots > 0), mixed).when(has_comma, _comma_to_dot(s)).otherwise(dotted)
    return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast(NUMBER))


def parse_pdf_decimal(raw: Column) -> Column:
    """Spaces out, the last separator marks decimals, failures are 0."""
    s = F.regexp_replace(_separators(_without(F.trim(raw), " ")), r"[^\d.\-]", "")
    return F.coalesce(s.try_cast(NUMBER), F.lit(0).cast(NUMBER))


def parse_budget_target(value: Column, mode: Column) -> Column:
    """struct(mode, value, errors) of a budget target in percent (0 to 100) or money (over 0)."""
    key = F.lower(F.trim(mode))
    # The names of the two modes.
    kind = F.when(key.isin("percent", "percentage", "%"), "percentage").when(key.isin("absolute", "currency", "rupiah", "idr", "value"), "absolute")
    text = F.nullif(F.trim(value), F.lit(""))
    percent = F.coalesce(kind == "percentage", F.lit(False))
    sign = ~percent & F.contains(text, F.lit("%"))
    cleaned = F.regexp_replace(F.regexp_replace(text, r"(?i)rp|idr", ""), r"[^0-9.,+\-]", "")
    number = F.when(~sign & cleaned.rlike("[0-9]"), _sheet(cleaned).try_cast(NUMBER))
    errors = F.array_compact(
        F.array(
            F.when(kind.isNull(), "Mode must be either 'percentage' or 'absolute'."),
            F.when(text.isNull(), "Target budget is required.").when(sign, "Percentage input is not allowed when mode is absolute.").when(number.isNull(), "Target budget must be numeric.")
            .when((kind == "percentage") & ((number <= 0) | (number > 100)), "Percentage value must be between 0 and 100.").when((kind == "absolute") & (number <= 0), "Target budget must be greater than zero."),
        )
    )
    return F.struct(kind.alias("mode"), number.alias("value"), errors.alias("errors"))


def parse_percent(raw: Column) -> Column:
    s = F.trim(raw)
    return F.when(s.endswith("%"), s.substr(F.lit(1), F.length(s) - 1).try_cast("decimal(28,8)") / 100)


def parse_bool(raw: Column) -> Column:
    s = F.lower(F.trim(raw))
    return F.when(s == "true", True).when(s == "false", False)


def parse_date(raw: Column) -> Column:
    s = F.trim(raw)
    return F.when(F.contains(s, F.lit("-")), F.to_date(F.try_to_timestamp(s, F.lit("yyyy-M-d")))).when(F.contains(s, F.lit("/")), F.to_date(F.try_to_timestamp(s, F.lit("d/M/yyyy"))))


def total_cost(volume: Column, price: Column) -> Column:
    """Product at two decimals, half up; null if either is."""
    return F.round(volume * price, 2)


def plain_decimal_string(value: Column) -> Column:
    """No exponent, no zeros at the end."""
    s = value.cast("string")
    return F.when(F.contains(s, F.lit(".")), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)


def format_weights(value: Column, dp: int = 2) -> Column:
    return F.round(value, dp).cast(f"decimal(28,{dp})").cast("string")
