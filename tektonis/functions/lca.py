"""Column functions of life-cycle impact rows and pipe-separated work sections."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Indicator columns and the predicates they are written under.
INDICATORS = {
    "gwp": "hasGWP", "pm": "hasPM", "ep": "hasEP", "aci": "hasAP", "pof": "hasPOCP", "htc": "hasHT_c", "htnc": "hasHT_nc", "irhh": "hasIR", "ecofw": "hasET_fw", "ws": "hasWU",
    "luosom": "hasLU_osom", "luobio": "hasLU_bio", "luourb": "hasLU_urb", "luoagr": "hasLU_agr", "luofor": "hasLU_for", "lutsom": "hasLU_tsom", "lutbio": "hasLU_tbio", "luturb": "hasLU_turb", "lutagr": "hasLU_tagr",
}
# Activities, units and stage suffixes by their spelling in the rows.
ACTIVITIES = {"Material in": "MaterialIn", "Transport to site": "TransportToSite", "Transport EOL": "TransportEoL", "Process": "Process", "Material loss": "MaterialLoss", "Material out": "MaterialOut"}
UNITS = {"kg": "KiloGM", "tkm": "TONNE-KM", "m3": "M3", "m2": "M2", "hr": "HR"}
STAGES = {"A1-3": "LCSA1A2A3", "A4": "LCSA4", "A5": "LCSA5", "B2.1": "LCSB2_1", "B2.2": "LCSB2_2", "B2.3": "LCSB2_3", "B4": "LCSB4", "C1": "LCSC1", "C2": "LCSC2", "C3": "LCSC3", "C4": "LCSC4"}
# Layer function by the functional segment of a work section.
SEGMENT_FUNCTIONS = {
    "demolition": "LoadBearing", "primary part": "LoadBearing", "slab": "LoadBearing", "cladding": "Finishing", "cladding - horizontal surfaces": "Finishing", "screed": "Finishing", "sloping layer": "Finishing",
    "infrastructure": "Infrastructure", "counter battens": "Infrastructure", "support structure": "Infrastructure", "boarding": "Infrastructure", "vapour barrier": "Infrastructure", "thermal insulation": "Insulating", "air cavity": "NonLoadBearing",
}


def lookup(table: dict[str, str], key: Column) -> Column:
    """The entry of a fixed table; null for other keys and for null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*table.items())]), key)


def safe_id(text: Column) -> Column:
    """Runs of separators become one underscore, none at the ends; 'Unknown' for null and empty text."""
    made = F.regexp_replace(F.regexp_replace(F.trim(text), r"[\s|/\\:*?\"<>+\-.]+", "_"), "_+", "_")
    return F.when(text.isNull() | (text == ""), "Unknown").otherwise(F.regexp_replace(made, "^_+|_+$", ""))


def stage_code(nested: Column, flat: Column) -> Column:
    """The nested code if there is one, else the flat one, else 'Unknown'."""
    return F.coalesce(F.trim(nested), F.trim(flat), F.lit("Unknown"))


def stage_suffix(code: Column) -> Column:
    return F.coalesce(lookup(STAGES, F.trim(code)), F.concat(F.lit("LCS_"), safe_id(F.trim(code))))


def stage_types(code: Column) -> Column:
    """The stages a code stands for: three for the product stage, else the part before the point."""
    return F.when(F.trim(code) == "A1-3", F.array(*map(F.lit, ("A1", "A2", "A3")))).otherwise(F.array(F.substring_index(F.trim(code), ".", 1)))


def activity(name: Column) -> Column:
    return lookup(ACTIVITIES, F.trim(name))


def unit(name: Column) -> Column:
    return lookup(UNITS, F.lower(F.trim(name)))


def segments(worksection: Column) -> Column:
    """Struct of the four pipe-separated segments; missing ones are empty."""
    parts = F.transform(F.split(worksection, r"\|"), lambda x: F.trim(x))
    at = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(""))
    return F.struct(at(1).alias("context"), at(2).alias("function_segment"), at(3).alias("component_segment"), at(4).alias("material_segment"))


def material_hint(worksection: Column) -> Column:
    """The most specific segment that is set, without its brackets."""
    s = segments(worksection)
    pick = F.coalesce(*[F.nullif(s[x], F.lit("")) for x in ("material_segment", "component_segment", "function_segment", "context")], F.lit(""))
    return F.trim(F.regexp_replace(pick, r"\([^)]*\)", ""))


def segment_function(worksection: Column) -> Column:
    """The layer function of a work section: by its functional segment, its context, else by keywords; null if none tells."""
    s, low = segments(worksection), F.lower(worksection)
    key = F.lower(s["function_segment"])
    context = F.replace(F.lower(s["context"]), F.lit("-"), F.lit(" "))
    bearing = (F.contains(context, F.lit("loadbearing")) | F.contains(context, F.lit("load bearing"))) & key.isin("", "demolition", "primary part", "slab")
    return (
        F.when(lookup(SEGMENT_FUNCTIONS, key).isNotNull(), lookup(SEGMENT_FUNCTIONS, key))
        .when(bearing, "LoadBearing")
        .when(low.contains("thermal insulation"), "Insulating")
        .when(low.contains("cladding") | low.contains("thick coating"), "Finishing")
        .when(low.contains("infrastructure"), "Infrastructure")
    )


def element_class(name: Column, worksections: Column, sfb: Column) -> Column:
    """Roof, Slab or Wall from the words of an element, its first three work sections and its class code."""
    all_words = F.lower(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.array_join(F.slice(worksections, 1, 3), " "), F.coalesce(sfb, F.lit(""))))
    has = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(all_words, w))
    code = F.coalesce(sfb, F.lit(""))
    return F.when(has("roof", "fr0", "ceiling") | code.startswith("27"), "Roof").when(has("slab", "floor", "if0", "deck") | code.startswith("23"), "Slab").otherwise("Wall")


def bracketed_thickness(text: Column) -> Column:
    """Struct (value_text, value, unit) of the first thickness or range in brackets; a range has no value."""
    pattern = r"(?i)\([^)]*?(\d+(?:\s*-\s*\d+)?)\s*(mm|cm)\)"
    raw = F.replace(F.regexp_extract(text, pattern, 1), F.lit(" "), F.lit(""))
    return F.when(raw != "", F.struct(raw.alias("value_text"), raw.try_cast("double").alias("value"), F.when(F.lower(F.regexp_extract(text, pattern, 2)) == "mm", "MilliM").otherwise("CentiM").alias("unit")))
