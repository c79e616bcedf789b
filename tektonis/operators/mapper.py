"""Descriptions to layer sets: profiles, prompts, a replaceable mapping provider, and the pipeline from text to validated layers.

The provider is called once per distinct description, in Arrow batches; a failure gives null. The one that comes with the engine is deterministic and works offline."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tektonis.functions import text as tx
from tektonis.operators import compose, retrieval
from tektonis.runtime import cut, too_big

# Branches, mode, final limit, hits per chunk and threshold of each profile.
PROFILES = {
    "bbsr": {"branches": ("material", "layer_function", "layerset"), "mode": "full", "limit": 10, "per_chunk": 4, "threshold": 0.25},
    "tabula": {"branches": ("material", "layer_function", "layerset"), "mode": "full", "limit": 8, "per_chunk": 4, "threshold": 0.25},
    "slice": {"branches": ("material", "layer_function"), "mode": "material_only", "limit": 8, "per_chunk": 6, "threshold": 0.30},
}
Provider = Callable[[str, str], list[dict] | None]
# Functions by the words that stand for them, in order of precedence.
WORD_FUNCTIONS = (("insulation", "Insulating"), ("dämm", "Insulating"), ("daemm", "Insulating"), ("air gap", "Air"), ("luftschicht", "Air"), ("putz", "Finishing"), ("plaster", "Finishing"), ("cladding", "Facade"), ("fassade", "Facade"))


def profile(name: str) -> dict:
    if name not in PROFILES:
        raise KeyError(f"no profile {name}; there are {', '.join(PROFILES)}")
    return PROFILES[name]


def offline_layers(description: Column) -> Column:
    """One layer per clause: its function by words, its material by the first mention, its thickness in cm; null where no clause names any of them."""
    clauses = F.split(description, r";|,(?!\d)|\s+/\s+", -1)

    def one(clause: Column) -> Column:
        low = F.lower(clause)
        fn = F.coalesce(*[F.when(F.contains(low, F.lit(word)), name) for word, name in WORD_FUNCTIONS])
        part = lambda n: F.nullif(F.regexp_extract(low, r"(\d+(?:[.,]\d+)?)\s*(cm|mm)", n), F.lit(""))
        figure = F.translate(part(1), ",", ".").cast("double")
        return F.struct(F.when(part(2) == "mm", figure / 10).otherwise(figure).alias("cm"), fn.alias("fn"), F.try_element_at(compose.find_mentions(clause), F.lit(1)).alias("m"))

    def made(x: Column) -> Column:
        fn = F.coalesce(x["fn"], F.lit(compose.LOAD_BEARING))
        material = lambda c: F.when(fn != compose.AIR, x["m"][c])
        return compose.layer(fn, material("cat"), material("typ"), x["cm"])

    told = F.filter(F.transform(clauses, one), lambda x: x["cm"].isNotNull() | x["fn"].isNotNull() | x["m"].isNotNull())
    return F.nullif(compose.reindex(F.transform(told, made)), F.array().cast(f"array<{compose.LAYER}>"))


def map_layers(description: Column, context: Column, provider: Provider | None = None, failures=None) -> Column:
    """Layers of a description by a provider, or by offline_layers; null where it fails or finds nothing. `failures` is an accumulator that counts the failed calls."""
    if provider is None:
        return offline_layers(description)

    @F.pandas_udf(f"array<{compose.LAYER}>")
    def run(texts: pd.Series, contexts: pd.Series) -> pd.Series:
        def one(t: str | None, c: str | None):
            if not t:
                return None
            try:
                return provider(t, c or "")
            except Exception:
                if failures is not None:
                    failures.add(1)
                return None

        return pd.Series([one(t, c) for t, c in zip(texts, contexts)], dtype=object)

    return run(description, context)


def distinct_apply(df: DataFrame, column: str, out: str, apply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with a column that is computed once per distinct value."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    return df.join(apply(values).select(column, out), column, "left")


def matches(descriptions: DataFrame, corpus: DataFrame, name: str, key: str = "id", text: str = "text") -> DataFrame:
    """(key, branch, item, score): the best entries of each branch for the chunks of a text and for the text itself.

    The corpus has item, branch and text. Chunks are embedded once per distinct chunk."""
    p = profile(name)
    chunks = descriptions.select(key, F.explode(F.array_distinct(F.concat(tx.decompose(F.lit(""), F.col(text)), F.array(F.col(text))))).alias("chunk")).where("chunk IS NOT NULL AND chunk <> ''")
    q = chunks.select("chunk").distinct().select(F.col("chunk").alias("query_id"), retrieval.embed("chunk").alias("vector"))
    items = corpus.where(F.col("branch").isin(*p["branches"])).select(F.col("item").alias("item_id"), "branch", retrieval.embed("text").alias("vector"))
    hits = retrieval.top_matches(q, items, p["per_chunk"], branch="branch").where(F.col("score") >= p["threshold"])
    got = chunks.join(hits, F.col("chunk") == F.col("query_id")).groupBy(key, "branch", F.col("item_id").alias("item")).agg(F.max("score").alias("score"))
    return retrieval.dedupe_limit(got.withColumn("_k", F.struct(key, "branch")), "_k", "item", p["limit"]).select(f"_k.{key}", "_k.branch", "item", "score", "rank")


def context_text(found: DataFrame, key: str = "id") -> DataFrame:
    """(key, context): the matches of a description as lines, best first."""
    line = F.format_string("%s %s score=%.3f", "branch", "item", "score")
    return found.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), line.alias("l")))), lambda x: x["l"]), "\n").alias("context"))


@dataclass
class Vocabulary:
    """What layers may be made of: (iri, anchor), (iri) of functions, (iri) of types, and the closure (child, ancestor, depth)."""

    anchors: DataFrame
    functions: DataFrame
    types: DataFrame
    closed: DataFrame

    def classes(self) -> DataFrame:
        return self.anchors.select("iri").union(self.anchors.select("anchor")).union(self.functions.select("iri")).union(self.types.select("iri")).distinct()


def first_match_set(found: DataFrame, key: str) -> DataFrame:
    """(key, fn, cat): the best function and the best material among the matches of a description, for those that no layer is found for."""
    best = lambda b: F.min(F.when(F.col("branch") == b, F.struct(-F.col("score"), "item")))["item"]
    return found.groupBy(key).agg(best("layer_function").alias("fn"), best("material").alias("cat"))


def process(descriptions: DataFrame, corpus: DataFrame, name: str, provider: Provider | None = None, key: str = "id", text: str = "text", vocabulary: Vocabulary | None = None, failures=None) -> DataFrame:
    """(key, pos, topology, layers), one row for each set of a description: retrieval, mapping, validation, rules on the materials named, and validation again.

    With a vocabulary, layers keep only what it and the matches of their description allow. A description without any layer gets one of its best function and material, load-bearing where no function is matched. Without a provider the mapping is that of offline_layers."""
    found = cut(matches(descriptions, corpus, name, key, text))
    d = descriptions.select(key, text).join(context_text(found, key), key, "left")
    mapped = map_layers(F.col(text), F.col("context"), provider, failures)
    sets = cut(d.select(F.struct(F.col(key).alias("key"), F.lit(0).alias("pos")).alias("_id"), F.col(text).alias("_text"), mapped.alias("layers")))
    schema = None if vocabulary is None or profile(name)["mode"] != "full" else vocabulary.classes()

    def checked(df: DataFrame) -> DataFrame:
        if vocabulary is None:
            return df.select("_id", "layers")
        own = found.groupBy(F.col(key).alias("_own")).agg(F.collect_set("item").alias("_ok"))  # at most the profile's limit for each branch
        df = df.select("_id", "layers").join(own, F.col("_id.key").eqNullSafe(F.col("_own")), "left")
        v = vocabulary
        return compose.validate_sets(df, "_id", "layers", v.anchors, v.functions, v.types, v.closed, "_ok", schema)

    texts = sets.select(F.col("_id.key").alias("_k"), "_text")
    back = lambda df: df.join(texts, F.col("_id.key").eqNullSafe(F.col("_k"))).select(F.col("_id.key").alias("_key"), F.col("_id.pos").alias("pos"), F.lit(compose.SINGLE).alias("topology"), tx.thickness_cm(F.col("_text")).alias("thickness_cm"), compose.reindex(compose.with_signal(F.col("layers"))).alias("layers"), "_text")
    ruled = compose.named_material_rules(back(checked(sets.where("layers IS NOT NULL"))), "_text")
    final = checked(ruled.select(F.struct(F.col("_key").alias("key"), "pos").alias("_id"), "layers")).where(F.size("layers") > 0)
    final = cut(final.select(F.col("_id.key").alias(key), F.col("_id.pos").alias("pos"), compose.reindex(compose.with_signal(F.col("layers"))).alias("layers")))
    none = descriptions.select(key, text).join(final.select(F.col(key).alias("_k")).distinct(), F.col(key).eqNullSafe(F.col("_k")), "left_anti").join(first_match_set(found, key), key, "left")
    one = compose.layer(F.coalesce("fn", F.lit(compose.LOAD_BEARING)), F.col("cat"), thickness=tx.thickness_cm(F.col(text)))
    out = final.unionByName(none.select(key, F.lit(0).alias("pos"), compose.reindex(F.array(one)).alias("layers")))
    return out.select(key, "pos", compose.topology(F.col("layers"), F.lit(compose.SINGLE)).alias("topology"), "layers")


def zip_variants(german: Column, english: Column) -> Column:
    """Pairs (de, en) by place; the German text stands for the English where the numbers differ."""
    same = F.size(german) == F.size(english)
    return F.transform(F.arrays_zip(german.alias("de"), F.when(same, english).otherwise(german).alias("en")), lambda x: F.struct(x["de"].alias("de"), x["en"].alias("en")))


def translate(text: Column, words: dict[str, str]) -> Column:
    """Word by word by a dictionary; null where no word is known."""
    low = F.transform(F.split(text, r"\s+"), lambda w: F.lower(w))
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    known = F.exists(low, lambda w: F.map_contains_key(table, w))
    return F.when(known, F.array_join(F.transform(low, lambda w: F.coalesce(F.try_element_at(table, w), w)), " "))


def candidate_flags(corpus: DataFrame, functions: DataFrame, topologies: DataFrame, categories: DataFrame, types: DataFrame, anchor: str, key: str = "item") -> DataFrame:
    """The corpus with the flags of the branches an entry may be retrieved for; the abstract anchor is none."""
    out = corpus
    for name, t in (("is_function", functions), ("is_topology", topologies), ("is_category", categories), ("is_type", types)):
        out = out.join(t.select(F.col("iri").alias(key), F.lit(True).alias(name)).distinct(), key, "left").na.fill(False, [name])
    real = F.col(key) != anchor
    return out.withColumns({"is_function": F.col("is_function") & real, "is_category": F.col("is_category") & real, "is_type": F.col("is_type") & real & ~F.col("is_function")})


def allowed_items(found: DataFrame, name: str, schema: DataFrame | None = None, key: str = "id", limit: int = 10_000) -> DataFrame:
    """(key, allowed): the items of a description's matches; in full mode also those of the schema, of which there may be at most `limit` (validate_sets takes a schema of any size)."""
    own = found.groupBy(key).agg(F.collect_set("item").alias("allowed"))
    if profile(name)["mode"] != "full" or schema is None:
        return own
    if too_big(schema, limit):
        raise ValueError(f"the schema has more than {limit} classes; give it to validate_sets")
    extra = schema.agg(F.collect_set("iri").alias("extra"))  # one row: the schema's classes
    return own.crossJoin(F.broadcast(extra)).select(key, F.array_union("allowed", "extra").alias("allowed"))


def axiom_listing(triples: DataFrame, domain: str, range_: str) -> DataFrame:
    """(property, line): 'property: domain -> range', a dash where one is missing."""
    of = lambda p, n: triples.where(F.col("p") == p).groupBy(F.col("s").alias("property")).agg(F.array_join(F.sort_array(F.collect_set("o")), ", ").alias(n))
    both = of(domain, "d").join(of(range_, "r"), "property", "full_outer")
    return both.select("property", F.concat("property", F.lit(": "), F.coalesce("d", F.lit("—")), F.lit(" -> "), F.coalesce("r", F.lit("—"))).alias("line"))


def hierarchy_listing(edges: DataFrame) -> DataFrame:
    """(parent, line): a class and its sorted direct children."""
    return edges.groupBy("parent").agg(F.concat(F.first("parent"), F.lit(": "), F.array_join(F.sort_array(F.collect_set("child")), ", ")).alias("line"))
