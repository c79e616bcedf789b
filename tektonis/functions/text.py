"""Column functions over German and English descriptions of building elements, and over IRIs.

All tests are substring tests unless a word boundary is named; Unicode-aware case folding is used throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chunk, and the substrings of which one must occur in the lower-cased text.
CHUNKS = (
    ("slab", ("slab", "decke")), ("hollow-core slab", ("hohlraumdecke", "cavity slab", "hollow-core")), ("solid concrete slab", ("vollbetondecke", "solid slab")),
    ("wall", ("wall", "wand")), ("floor", ("floor", "fußboden", "fussboden")), ("roof", ("roof", "dach")),
    ("reinforced concrete", ("reinforced concrete", "stahlbeton")), ("prestressed concrete", ("spannbeton", "prestressed concrete")), ("lightweight concrete", ("leichtbeton", "lightweight concrete")),
    ("lightweight aggregate concrete", ("leichtzuschlagstoffbeton", "lzs-beton")), ("aerated concrete", ("porenbeton", "aerated concrete")), ("no-fines porous concrete", ("haufwerksporig", "no-fines concrete")),
    ("mineral wool", ("mineral wool", "mineralwolle")), ("expanded polystyrene insulation", ("schaumpolystyrol", "polystyrene", "eps")),
    ("brickwork", ("brick", "ziegel", "mauerwerk")), ("hollow-hole brick elements", ("hohlloch", "hollow-hole", "hollow hole")), ("wood timber", ("wood", "timber", "holz")),
    ("glazing", ("glazing", "verglasung", "fenster")), ("door opening", ("door", "tür", "tur")), ("gypsum plaster binders", ("plaster", "gips", "putz", "geputzt")),
    ("single layer", ("single layer", "einschichtig")), ("two layer", ("two layer", "zweischichtig")),
)
# Words of insulation, and chunks that count only beside one of them.
INSULATED = "dämmung|daemmung|insulation|insulated|gedämmt|gedaemmt"
INSULATION_PLACES = (("core insulation", ("kerndämmung", "kerndaemmung")), ("exterior insulation", ("außendämmung", "aussendaemmung")), ("interior insulation", ("innendämmung", "innendaemmung")))
# Word patterns of material and opening families, in order of precedence.
WORDS = {
    "insulation": "insulation|insulated|dämmung|daemmung|dämmkern|daemmkern|wärmedämm|waermedaemm|dämmstoff|daemmstoff|gedämmt|gedaemmt",
    "glazing": "glazing|glazed|verglasung|scheiben|fenster|window|triple glazing|double glazing|isolierverglasung",
    "opening": "door|tür|tur|haustür|entry door|metal door",
    "brick": "brick|brickwork|ziegel|mauerwerk",
    "concrete": "concrete|beton|ortbeton|stahlbeton",
    "wood": "wood|timber|holz|clt|sparren|balken|faserplatte|fibreboard|fiberboard",
    "polymer": "plastic|kunststoff|pvc|polymer",
    "glass": "glass|glas|glazing|verglasung|scheiben",
    "steel": "steel|stahl",
}
MATERIAL_ORDER = (("brick", "Brick"), ("concrete", "Concrete"), ("wood", "WoodTimber"), ("polymer", "Polymer"), ("glass", "Glass"), ("steel", "Concrete"), ("insulation", "MineralFibre"))
ELEMENT_CLASSES = (("roof", "Roof"), ("wall", "Wall"), ("floor", "Slab"), ("slab", "Slab"), ("door", "Door"), ("window", "Window"))


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the substrings occurs."""
    out = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(text, F.lit(w))
    return out


def has_word(text: Column, family: str) -> Column:
    """Whether a word of a family occurs as a whole word."""
    found = F.rlike(text, F.lit(rf"(?iU)\b({WORDS[family]})\b"))
    return found | F.contains(F.lower(text), F.lit("holz")) if family == "wood" else found


def combined(german: Column, english: Column) -> Column:
    """The non-empty texts, joined by a space."""
    return F.trim(F.concat_ws(" ", F.nullif(german, F.lit("")), F.nullif(english, F.lit(""))))


def rule_chunks(text: Column) -> Column:
    """The distinct chunks of a text in rule order, thicknesses last; empty if no rule applies."""
    low = F.lower(text)
    by_rule = lambda rules: [F.when(any_of(low, words), name) for name, words in rules]
    at = {name: i for i, (name, _) in enumerate(CHUNKS)}
    concrete = F.when(any_of(low, ("normalbeton", "normal concrete")), "normal concrete").when(any_of(low, ("concrete", "beton")), "concrete")
    insulated = F.rlike(low, F.lit(rf"(?U)\b({INSULATED})\b"))
    place = [F.when(insulated & any_of(low, words), name) for name, words in INSULATION_PLACES]
    word = lambda w, name: F.when(F.rlike(low, F.lit(rf"(?U)\b{w}\b")), name)
    multi = F.when(F.rlike(low, F.lit(r"(?U)\bmulti[- ]?layer")) | any_of(low, ("mehrschichtig", "dreischichtig", "3-layered")), "multi layer")
    cavity = F.when(F.contains(low, F.lit("cavity wall")) | F.rlike(low, F.lit(r"(?U)\b(kellerwand|hohlraumwand)\b")), "cavity wall")
    rules = by_rule(CHUNKS)
    parts = [*rules[: at["mineral wool"]], concrete, *rules[at["mineral wool"] : at["brickwork"]], F.when(insulated, "thermal insulation"), *place, *rules[at["brickwork"] : at["glazing"]], word("cork", "cork"), F.when(F.rlike(low, F.lit(r"(?U)\bstraw\b")), "straw plant fiber"), *rules[at["glazing"] :], multi, cavity]
    thick = lambda unit: F.transform(F.regexp_extract_all(low, F.lit(rf"\d+(?:,\d+)?\s*{unit}"), F.lit(0)), lambda x: F.concat(x, F.lit(" thickness")))
    return F.array_distinct(F.concat(F.array_compact(F.array(*parts)), thick("cm"), thick("mm")))


def decompose(german: Column, english: Column) -> Column:
    """The chunks of a description; the whole text where no rule applies."""
    text = combined(german, english)
    chunks = rule_chunks(text)
    return F.when(text == "", F.array().cast("array<string>")).when(F.size(chunks) == 0, F.array(text)).otherwise(chunks)


def thickness_cm(text: Column) -> Column:
    """The first figure in cm, else the first in mm divided by ten; comma and point are decimal marks."""
    first = lambda unit: F.replace(F.regexp_extract(text, rf"(?i)(\d+(?:[.,]\d+)?)\s*{unit}", 1), F.lit(","), F.lit(".")).try_cast("double")
    return F.coalesce(first("cm"), first("mm") / 10.0)


def material_family(text: Column, label: Column) -> Column:
    """The material category of a text by the first family that occurs."""
    both = F.lower(F.concat_ws(" ", text, label))
    out = F
    for family, name in MATERIAL_ORDER:
        out = out.when(has_word(both, family), name)
    return out


def element_type(label: Column) -> Column:
    low = F.lower(label)
    out = F
    for word, name in ELEMENT_CLASSES:
        out = out.when(F.contains(low, F.lit(word)), name)
    return out.otherwise("BuiltElement")


def is_opening(label: Column) -> Column:
    return element_type(label).isin("Door", "Window")


def opening_function(label: Column) -> Column:
    low = F.lower(label)
    return F.when(F.contains(low, F.lit("window")), "Glazing").when(F.contains(low, F.lit("door")), "Opening")


def existing_function(text: Column, label: Column) -> Column:
    """The function of an as-built layer from its text and element."""
    both, low = F.lower(F.concat_ws(" ", text, label)), F.lower(label)
    window = F.contains(low, F.lit("window")) | (F.contains(both, F.lit("fenster")) & ~F.contains(low, F.lit("door")))
    return (
        F.when(window, "Glazing")
        .when(F.contains(low, F.lit("door")) | has_word(both, "opening"), "Opening")
        .when(has_word(both, "insulation"), "Insulating")
        .when(any_of(both, ("cladding", "verputz", "coating")), "Finishing")
        .otherwise("LoadBearing")
    )


def placement_kinds(text: Column) -> Column:
    """Where insulation is to be placed: below, top, both; 'add' where the text doesn't tell."""
    low = F.lower(F.coalesce(text, F.lit("")))
    kinds = F.array_compact(F.array(F.when(F.rlike(low, F.lit(r"\bbelow\b")), "below"), F.when(F.contains(low, F.lit("on top")), "top"), F.when(F.contains(low, F.lit("combination")), "both")))
    return F.when(F.size(kinds) == 0, F.array(F.lit("add"))).otherwise(kinds)


def local_name(iri: Column) -> Column:
    """The part of an IRI after '#', else after the last '/'."""
    return F.when(F.contains(iri, F.lit("#")), F.substring_index(iri, "#", -1)).otherwise(F.substring_index(iri, "/", -1))


def camel_split(name: Column) -> Column:
    return F.regexp_replace(name, "(?<!^)(?=[A-Z])", " ")


def clean_iri(value: Column) -> Column:
    """An IRI out of a markdown link or brackets; null if nothing with a scheme is left."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(value), r"\[[^\]]*\]\(([^)]*)\)", "$1"), r"^[\[\]() <>]+|[\[\]() <>]+$", "")
    return F.when(F.startswith(bare, F.lit("http")), bare)


def strip_fences(raw: Column) -> Column:
    """JSON without the fence of a code block."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(raw), r"(?i)^```(json)?\s*", ""), r"\s*```$", ""))


def mean_number(literal: Column, default: float = 1.0) -> Column:
    """A literal as a number: itself, else the mean of the figures in it, else the default."""
    found = F.transform(F.regexp_extract_all(literal, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.try_cast("double"))
    mean = F.aggregate(found, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(found), F.lit(0))
    return F.coalesce(literal.try_cast("double"), mean, F.lit(default))


def mask_secret(value: Column) -> Column:
    """First and last four characters; asterisks for short values."""
    return F.when(F.length(value) <= 8, "****").otherwise(F.concat(F.left(value, F.lit(4)), F.lit("..."), F.right(value, F.lit(4))))


def composite_score(cosine: Column, validity: Column, gold: Column) -> Column:
    """Gold fidelity where there is one, else validity times cosine, to one decimal (half to even); null without both."""
    return F.when(gold.isNotNull(), gold).when(cosine.isNotNull() & validity.isNotNull(), F.bround(validity * cosine, 1))
