"""Standard works broken down into labor, equipment and materials, and cheaper materials for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kalkula.functions.text import letter_grams
from kalkula.sources.shared import cut_lineage

KINDS = ("labor", "equipment", "material")


def breakdown_lines(components: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each component (code, kind, component_id, quantity, coefficient) with name, price and total from one catalogue of all kinds.

    The quantity is quantity, else coefficient, else 0; the total is null without a price; only materials have brands.
    """
    known = catalog.select(F.col("kind"), F.col("id").alias("component_id"), F.col("name").alias("component_name"), "unit", "unit_price", "brand")
    out = components.join(known, ["kind", "component_id"], "left").withColumn("amount", F.coalesce("quantity", "coefficient", F.lit(0)))
    return out.withColumn("line_total", F.col("amount") * F.col("unit_price")).withColumn("brand", F.when(F.col("kind") == "material", F.col("brand")))


def breakdown_totals(lines: DataFrame, code: str = "code", arrays: bool = False) -> DataFrame:
    """Per work: total of each kind, labor and equipment together, and overall; with arrays also the lines of each kind, nested."""
    kind = lambda *k: F.coalesce(F.sum(F.when(F.col("kind").isin(*k), F.col("line_total"))), F.lit(0)).cast("long")
    sums = [kind("labor").alias("labor"), kind("equipment").alias("equipment"), kind("material").alias("materials"), kind("labor", "equipment").alias("labor_equipment"), kind(*KINDS).alias("overall")]
    nested = [F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("component_id", "amount", "unit_price", "line_total")))).alias(f"{k}_lines") for k in KINDS] if arrays else []
    return lines.groupBy(code).agg(*sums, *nested)


def apply_breakdown_overrides(lines: DataFrame, edits: DataFrame, code: str = "code") -> DataFrame:
    """An edited work has its edited lines only; a work whose edit says the same as the lines at hand is left alone.

    edits: code, kind, component_id, amount, unit_price.
    """
    columns = [code, "kind", "component_id", "amount", "unit_price"]
    shape = lambda df: df.groupBy(code).agg(F.sort_array(F.collect_list(F.struct("kind", "component_id", "amount", "unit_price"))).alias("shape"))
    changed = shape(edits).join(shape(lines), [code, "shape"], "left_anti").select(code)
    kept = lines.join(changed, code, "left_anti").select(*columns)
    return kept.unionByName(edits.join(changed, code, "left_semi").select(*columns)).withColumn("line_total", F.col("amount") * F.col("unit_price"))


def first_words(name: str, n: int = 3, longer_than: int = 2):
    """The first n words of more than so many letters, lower-cased."""
    return F.slice(F.filter(F.split(F.lower(name), r"\s+"), lambda w: F.length(w) > longer_than), 1, n)


def brand_alternatives(probes: DataFrame, brands: DataFrame) -> DataFrame:
    """Brands of the material with the probe's name and unit that cost less: name, unit, price, offer, offer_price, source, url."""
    keyed = probes.select("name", "unit", "price").distinct().withColumn("key", F.lower("unit")).withColumn("material_key", F.lower(F.trim("name")))
    same = brands.select(F.lower("unit").alias("key"), F.lower(F.trim("material")).alias("material_key"), F.col("brand").alias("offer"), F.col("price").alias("offer_price"))
    found = keyed.join(same, ["key", "material_key"]).filter(F.col("offer_price") < F.col("price"))
    return found.select("name", "unit", "price", "offer", "offer_price", F.lit("brand").alias("source"), F.lit("").alias("url"))


def cheaper_alternatives(probes: DataFrame, products: DataFrame, brands: DataFrame | None = None, limit: int = 5) -> DataFrame:
    """For each distinct probe (name, unit, price): products of the same unit that cost less and whose name holds all of the
    first three words of more than two letters; brands of the material with the same name and unit that cost less.

    limit: offers kept per probe. No more than limit of a (unit, name) can be among a probe's cheapest, so products are first
    cut to these. Distinct names are indexed by unit and their sequences of two to four letters, and a probe's words meet
    only names that hold the first letters of its longest word.
    """
    probes = probes.select("name", "unit", "price").distinct().withColumn("key", F.lower("unit"))
    offers = products.select(F.lower("unit").alias("key"), F.lower("name").alias("offer_key"), F.col("name").alias("offer"), F.col("price").alias("offer_price"), F.col("source"), F.col("url"))
    cheapest = F.row_number().over(W.partitionBy("key", "offer_key").orderBy("offer_price", "source", "offer", "url"))
    offers = cut_lineage(offers.withColumn("place", cheapest).filter(F.col("place") <= limit).drop("place"))
    index = offers.select("key", "offer_key").distinct().select("key", "offer_key", F.explode(F.array_union(F.array(F.lit("")), letter_grams(F.col("offer_key")))).alias("gram"))
    wanted = probes.select("key", "name").distinct().withColumn("words", first_words("name"))
    longest = F.array_max(F.transform("words", lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))["word"]
    pairs = wanted.withColumn("gram", F.coalesce(F.substring(longest, 1, 4), F.lit(""))).join(index, ["key", "gram"]).filter(F.forall("words", lambda w: F.contains(F.col("offer_key"), w))).select("key", "name", "offer_key")
    best = pairs.join(offers, ["key", "offer_key"]).withColumn("place", F.row_number().over(W.partitionBy("key", "name").orderBy("offer_price", "source", "offer", "url"))).filter(F.col("place") <= limit)
    found = probes.join(best, ["key", "name"]).filter(F.col("offer_price") < F.col("price")).select("name", "unit", "price", "offer", "offer_price", "source", "url")
    if brands is not None:
        found = found.unionByName(brand_alternatives(probes, brands))
    rank = F.row_number().over(W.partitionBy("name", "unit", "price").orderBy("offer_price", "source", "offer", "url"))
    return found.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= limit)


def optimize_materials(lines: DataFrame, alternatives: DataFrame, limit: int = 2, code: str = "code") -> DataFrame:
    """Per work: the dearest materials (limit of them, with an amount and a price) swapped for the cheapest alternative that saves.

    alternatives: name, unit, price, offer_price. Returns total before and after, saving and number of swaps.
    """
    material = (F.col("kind") == "material") & F.col("unit_price").isNotNull() & (F.col("amount") != 0)
    ranked = lines.withColumn("place", F.when(material, F.row_number().over(W.partitionBy(code, material).orderBy(F.col("line_total").desc(), "component_id"))))
    best = alternatives.groupBy("name", "unit", "price").agg(F.min("offer_price").alias("best"))
    chosen = ranked.join(best.select(F.col("name").alias("component_name"), "unit", F.col("price").alias("unit_price"), "best"), ["component_name", "unit", "unit_price"], "left")
    saving = F.when((F.col("place") <= limit) & (F.col("best") < F.col("unit_price")), (F.col("unit_price") - F.col("best")) * F.col("amount")).otherwise(F.lit(0))
    out = chosen.withColumn("saving", saving).groupBy(code).agg(F.coalesce(F.sum("line_total"), F.lit(0)).cast("long").alias("before"), F.sum("saving").cast("long").alias("saving"), F.sum((F.col("saving") > 0).cast("long")).alias("swaps"))
    return out.withColumn("after", F.col("before") - F.col("saving"))
