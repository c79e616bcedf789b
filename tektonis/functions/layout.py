"""Column functions over lines read from scanned pages: digits, sections, key and value lines, property values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters read for digits, and the digits meant.
LOOKS, DIGITS = "SsiIl|Oo", "55111100"
# Writings of umlauts in lookup keys.
UMLAUTS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"))


def digits(token: Column) -> Column:
    """A token with the letters that are read for digits made digits."""
    return F.translate(token, LOOKS, DIGITS)


def section_numbers(section: Column) -> Column:
    """'1.2.3' as an array of integers; null for anything else."""
    return F.when(F.rlike(section, F.lit(r"^\d+(\.\d+)*$")), F.transform(F.split(section, r"\."), lambda x: x.cast("int")))


def clean_text(text: Column) -> Column:
    """One line without form feeds, bars and runs of spaces."""
    return F.trim(F.regexp_replace(F.translate(text, "\x0c|\n", "   "), r"\s+", " "))


def clean_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def is_key_line(line: Column) -> Column:
    """A line with a colon after a capitalised key of up to 40 characters."""
    return F.rlike(line, F.lit(r"^\p{Lu}[^:]{0,39}:"))


def key_value(line: Column) -> Column:
    """Struct (key, value) split at the first colon."""
    parts = F.split(line, ":", 2)
    return F.struct(F.trim(parts[0]).alias("key"), F.trim(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))).alias("value"))


def lookup_key(key: Column) -> Column:
    """A property key for lookup: lower case, umlauts written out, letters and digits only."""
    out = F.lower(key)
    for a, b in UMLAUTS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, "[^a-z0-9]+", "")


def property_values(value: Column, long: int = 40) -> Column:
    """A property as an array: split at semicolons where long, at commas between lengths in metres, else one value."""
    split = lambda by: F.filter(F.transform(F.split(value, by), lambda x: F.trim(x)), lambda x: x != "")
    metres = F.rlike(value, F.lit(r"\d\s*m\s*,\s*\d"))
    return F.when(F.contains(value, F.lit(";")) & (F.length(value) > long), split(";")).when(metres, split(r",\s+")).otherwise(F.array(F.trim(value)))


def slab(value: Column) -> Column:
    """Struct (raw, thickness, construction, material) of a slab property."""
    thick = F.nullif(F.regexp_extract(value, r"(?i)(\d+(?:[.,]\d+)?\s*(?:mm|cm|m))\b", 1), F.lit(""))
    low = F.lower(value)
    kind = F.when(F.contains(low, F.lit("hohl")), "hollow").when(F.contains(low, F.lit("voll")), "solid").when(F.contains(low, F.lit("rippe")), "ribbed")
    material = F.when(F.contains(low, F.lit("stahlbeton")), "reinforced concrete").when(F.contains(low, F.lit("beton")), "concrete").when(F.contains(low, F.lit("holz")), "wood").when(F.contains(low, F.lit("ziegel")), "brick")
    return F.struct(value.alias("raw"), thick.alias("thickness"), kind.alias("construction"), material.alias("material"))


def strip_bullets(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"^[\s•·*\-–—°]+", ""))


def ends_with_page(line: Column) -> Column:
    """The page number at the end of a contents line, misread digits put right; null if there is none."""
    tail = digits(F.regexp_extract(line, r"(?:\s|\.)([0-9SsiIl|Oo]{1,3})\s*$", 1))
    return tail.try_cast("int")


def section_header(line: Column) -> Column:
    """Struct (section, title) of a numbered header line, misread digits put right; null for other lines."""
    pattern = r"^\s*([0-9SsiIl|Oo]{1,2}(?:\.[0-9SsiIl|Oo]{1,2}){0,2})\.?\s+(\p{Lu}.*)$"
    number = digits(F.regexp_extract(line, pattern, 1))
    return F.when(F.rlike(line, F.lit(pattern)) & F.rlike(number, F.lit(r"^\d+(\.\d+)*$")), F.struct(number.alias("section"), F.trim(F.regexp_extract(line, pattern, 2)).alias("title")))


def line_kind(line: Column) -> Column:
    """'section', 'page', 'key' or 'text'."""
    return F.when(F.rlike(F.trim(line), F.lit(r"^[\-–\[(]*\s*[0-9SsiIl|Oo]{1,3}\s*[\-–\])]*$")), "page").when(section_header(line).isNotNull(), "section").when(is_key_line(line), "key").otherwise("text")


def wall(value: Column) -> Column:
    """Struct (raw, thickness, material, layers) of a wall property."""
    thick = F.regexp_extract_all(value, F.lit(r"(?i)\d+(?:[.,]\d+)?\s*(?:mm|cm|m)\b"), F.lit(0))
    low = F.lower(value)
    material = F.when(F.contains(low, F.lit("beton")), "concrete").when(F.contains(low, F.lit("ziegel")), "brick").when(F.contains(low, F.lit("gips")), "gypsum")
    layers = F.when(F.contains(low, F.lit("dreischicht")), 3).when(F.contains(low, F.lit("zweischicht")), 2).when(F.contains(low, F.lit("einschicht")), 1)
    return F.struct(value.alias("raw"), F.try_element_at(thick, F.lit(1)).alias("thickness"), material.alias("material"), layers.alias("layers"))


def measurement(value: Column) -> Column:
    """A measure with one space before its unit and a decimal comma."""
    return F.regexp_replace(F.regexp_replace(value, r"(\d)\s*(mm|cm|m)\b", "$1 $2"), r"(\d)\.(\d)", "$1,$2")


def pick_field(properties: Column, needles: list[str]) -> Column:
    """The value of the first key, in code point order, that contains one of the needles when both are folded."""
    keys = F.array_sort(F.filter(F.map_keys(properties), lambda k: F.exists(F.array(*map(F.lit, needles)), lambda n: F.contains(lookup_key(k), n))))
    return F.try_element_at(properties, F.try_element_at(keys, F.lit(1)))


def rename_sections(sections: Column) -> Column:
    """Sections (section, title, properties) as (id, title, data)."""
    return F.transform(sections, lambda s: F.struct(s["section"].alias("id"), s["title"].alias("title"), s["properties"].alias("data")))


def contents_label(section: Column, title: Column, page: Column) -> Column:
    """'1.2 Title ... 7' with what is known."""
    return F.trim(F.concat_ws(" ", section, title, F.when(page.isNotNull(), F.concat(F.lit("... "), page.cast("string")))))
