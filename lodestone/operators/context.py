"""Context extraction: element-material edges, host sets, property projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.numbers import clean_number, converted, nonzero
from lodestone.functions.text import first_filled

# Export keys by group; recommended ones are in RECOMMENDED.
IDENTITY = ("class", "description", "keywords", "subclass", "type", "manufacturer", "model", "source", "url")
HOST = ("host_categories", "host_types")
PHYSICAL = (
    "density_kg_m3", "structural_class", "concrete_compression_mpa", "lightweight", "youngs_modulus_mpa", "poissons_ratio", "shear_modulus_mpa",
    "damping_ratio", "yield_strength_mpa", "tensile_strength_mpa", "thermal_expansion_inv_C", "shear_strength_reduction", "reduction_factor",
)
THERMAL = (
    "thermal_conductivity_w_mk", "density_kg_m3", "specific_heat_j_gC", "emissivity", "permeability_ng_Pas_m2", "porosity", "reflectivity",
    "electrical_resistivity_ohm_m", "thermal_class", "transmits_light",
)
ALWAYS = ("identity.name",)
ONLY_FOR = {"concrete_compression_mpa": ("Concrete",), "lightweight": ("Concrete",), "yield_strength_mpa": ("Metal",), "tensile_strength_mpa": ("Metal",)}
DROP_ZERO = ("poissons_ratio", "damping_ratio", "reduction_factor")


def catalog_keys() -> list[str]:
    groups = {"identity": ("name", *IDENTITY), "host": HOST, "physical": PHYSICAL, "thermal": THERMAL}
    return [f"{g}.{k}" for g, keys in groups.items() for k in keys]


def export_keys(selected: list[str]) -> list[str]:
    """The selection with what is always exported; without anything else selected there is nothing to export."""
    if not set(selected) - set(ALWAYS):
        raise ValueError("select at least one property")
    return list(dict.fromkeys([*ALWAYS, *selected]))


def scoped_elements(elements: DataFrame, categories: list[str] | None = None, view: int | None = None, picked: list[int] | None = None) -> DataFrame:
    """Elements of a scope: all, of categories, of a view, or picked; without a category, links and curtain hosts are left out."""
    out = elements.where(F.col("category").isNotNull() & ~F.col("category").isin("", "RVT Links") & ~F.coalesce("has_curtain_grid", F.lit(False)))
    if categories is not None:
        out = out.where(F.col("category").isin(*categories))
    if view is not None:
        out = out.where(F.col("view_id") == view)
    return out if picked is None else out.where(F.col("element_id").isin(*picked))


def edges(*sources: DataFrame) -> DataFrame:
    """Distinct (element_id, material_id) of any number of sources; ids that are not positive are none."""
    parts = [s.select("element_id", "material_id") for s in sources]
    return reduce(DataFrame.unionByName, parts).where("material_id > 0").distinct()


def host_map(links: DataFrame, elements: DataFrame) -> DataFrame:
    """Per material the sorted sets of its elements' categories and type names; an empty type name is not added.

    Pairs are made distinct before the sets are collected, so a material's rows are bounded by its different hosts.
    """
    hosts = links.join(elements.select("element_id", "category", "type_name"), "element_id").select("material_id", "category", F.nullif("type_name", F.lit("")).alias("type_name")).distinct()
    return hosts.groupBy("material_id").agg(F.sort_array(F.collect_set("category")).alias("categories"), F.sort_array(F.collect_set("type_name")).alias("types"))


def type_names(elements: DataFrame, types: DataFrame) -> DataFrame:
    """elements with type_name by the first of: its type's name, its own name, its family, nothing."""
    named = elements.join(types.select("type_id", F.col("name").alias("__type")), "type_id", "left")
    return named.withColumn("type_name", first_filled(F.col("__type"), F.col("own_name"), F.col("family"))).drop("__type")


def conditional(key: str, value: Column, structural_class: Column, behaviour: Column | None = None) -> Column:
    """A property as exported: null where its class does not have it, zero dropped where zero means missing, numbers converted and cleaned."""
    if key in ONLY_FOR:
        value = F.when(structural_class.isin(*ONLY_FOR[key]), value)
    if key == "shear_modulus_mpa" and behaviour is not None:
        value = F.when(~behaviour.isin("Gas", "Liquid"), value)
    return nonzero(value) if key in DROP_ZERO else value


def numeric(key: str, value: Column) -> Column:
    return clean_number(converted(value, key))


def project(materials: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (revit_id, name, record): the JSON of the selected properties.

    Id and name are always there, an identity text only if not empty, an asset's property only if not null, an asset only if
    it has one, the host lists whenever one is selected. materials has the catalog's columns as identity texts, host lists and the structs physical and thermal.
    """
    chosen = set(export_keys(keys))
    parts = [F.col("revit_id"), F.col("name")]
    parts += [F.nullif(F.trim(F.col(k)), F.lit("")).alias(k) for k in IDENTITY if f"identity.{k}" in chosen]
    hosts = [k for k in HOST if f"host.{k}" in chosen]
    if hosts:
        empty = F.expr("cast(array() as array<string>)")
        parts.append(F.struct(*[F.coalesce(F.col(k), empty).alias(k.removeprefix("host_")) for k in hosts]).alias("host_elements"))
    for group, names in (("physical", PHYSICAL), ("thermal", THERMAL)):
        mine = [k for k in names if f"{group}.{k}" in chosen and k in materials.schema[group].dataType.names]
        if mine:
            held = reduce(lambda a, b: a | b, [F.col(group)[k].isNotNull() for k in mine])
            parts.append(F.when(held, F.struct(*[F.col(group)[k].alias(k) for k in mine])).alias(f"{group}_asset"))
    return materials.select("revit_id", "name", F.to_json(F.struct(*parts)).alias("record"))


def filter_catalog(catalog: DataFrame, text: str, regex: bool = False) -> DataFrame:
    """Rows of the catalog or of categories whose display name fits a text filter."""
    from lodestone.functions.text import fuzzy_match, regex_match

    name = F.col("display_name")
    return catalog.where(regex_match(name, text) if regex else fuzzy_match(name, F.lit(text)))


def select_visible(catalog: DataFrame, selected: DataFrame, text: str, regex: bool = False) -> DataFrame:
    """The keys of a selection after "select all" on what a filter shows: those selected before and those visible."""
    return selected.select("key").unionByName(filter_catalog(catalog, text, regex).select("key")).distinct()
