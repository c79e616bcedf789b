"""Triples as a DataFrame (s, p, o, o_kind, o_lang, o_dt) with set semantics, and patterns over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "s string, p string, o string, o_kind string, o_lang string, o_dt string"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
SUBCLASS = "http://www.w3.org/2000/01/rdf-schema#subClassOf"
LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
COMMENT = "http://www.w3.org/2000/01/rdf-schema#comment"


def make(df: DataFrame, s: Column, p: str, o: Column, kind: str = "iri", lang: str | None = None, dt: str | None = None) -> DataFrame:
    """One triple per row with a subject and an object."""
    out = df.select(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit(lang).cast("string").alias("o_lang"), F.lit(dt).cast("string").alias("o_dt"))
    return out.where(F.col("s").isNotNull() & F.col("o").isNotNull())


def union(*graphs: DataFrame) -> DataFrame:
    """The set union of graphs: a triple that occurs several times counts once."""
    return reduce(DataFrame.unionByName, graphs).distinct()


def explode_triples(df: DataFrame, triples: Column) -> DataFrame:
    """The triples of an array of structs (s, p, o, o_kind), nulls left out: one pass for any number of properties of a row."""
    out = df.select(F.explode(F.array_compact(triples)).alias("t")).select("t.*").where(F.col("s").isNotNull() & F.col("o").isNotNull())
    return out.select("s", "p", "o", "o_kind", F.lit(None).cast("string").alias("o_lang"), F.lit(None).cast("string").alias("o_dt")).distinct()


def triple(s: Column, p: str, o: Column, kind: str = "iri") -> Column:
    """A struct for explode_triples; null where the object is null."""
    return F.when(o.isNotNull(), F.struct(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind")))


def match(g: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """The triples of a pattern; a constant that is given reaches the scan as a filter."""
    for name, value in (("s", s), ("p", p), ("o", o)):
        if value is not None:
            g = g.where(F.col(name) == value)
    return g


def subjects(g: DataFrame, p: str, o: str | None = None) -> DataFrame:
    """One row per triple, as a bag."""
    return match(g, p=p, o=o).select("s")


def subject_objects(g: DataFrame, p: str) -> DataFrame:
    return match(g, p=p).select("s", "o")


def value(g: DataFrame, p: str, name: str) -> DataFrame:
    """(s, name): the first object of a property in code point order."""
    return match(g, p=p).groupBy("s").agg(F.min("o").alias(name))


def exists(df: DataFrame, g: DataFrame, p: str, o: str | None = None, key: str = "s") -> DataFrame:
    """The rows of df whose key has the property."""
    return df.join(match(g, p=p, o=o).select(F.col("s").alias(key)).distinct(), key, "left_semi")


def path(g: DataFrame, start: DataFrame, steps: list[tuple[str, str, str]]) -> DataFrame:
    """Joins along properties: each step is (property, column to write, 'inner' or 'left')."""
    at, key = start, start.columns[-1]
    for p, name, how in steps:
        at = at.join(match(g, p=p).select(F.col("s").alias(key), F.col("o").alias(name)), key, how)
        key = name
    return at


def languages(g: DataFrame, *langs: str) -> DataFrame:
    """Literals without a language or in one of the languages."""
    return g.where(F.col("o_lang").isNull() | F.col("o_lang").isin(*langs))


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(node, hops): nodes within so many undirected steps of a seed, with the smallest number of steps.

    Levels are distinct before they are joined again, so a hub is expanded once per level."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    found = seeds.select(F.col(seeds.columns[0]).alias("node")).distinct().withColumn("hops", F.lit(0))
    level = found
    for n in range(1, hops + 1):
        level = level.join(both, level["node"] == both["src"]).select(F.col("dst").alias("node")).distinct()
        level = level.join(found.select("node"), "node", "left_anti").withColumn("hops", F.lit(n))
        found = found.unionByName(level)
    return found


def reverse_edges(edges: DataFrame, prefix: str = "rev_") -> DataFrame:
    """Edges (src, dst, rel) and their reverses."""
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.concat(F.lit(prefix), "rel").alias("rel")))


def highlight(nodes: DataFrame, selected: Column) -> DataFrame:
    """Nodes with a flag for those that a selection hides."""
    return nodes.withColumn("hidden", ~F.coalesce(selected, F.lit(False)))


def edges_between(g: DataFrame, left: DataFrame, right: DataFrame, p: str | None = None) -> DataFrame:
    """(src, dst): ids of the ends of triples whose subject is in `left` and whose object is in `right`, both (iri, id); of any property if none is named."""
    ends = match(g, p=p).select("s", "o").distinct()
    ends = ends.join(left.select(F.col("iri").alias("s"), F.col("id").alias("src")), "s")
    return ends.join(right.select(F.col("iri").alias("o"), F.col("id").alias("dst")), "o").select("src", "dst")


def taxonomy_index(g: DataFrame, parent: str) -> DataFrame:
    """(iri, text): the direct subclasses of a class with their labels in one text."""
    below = match(g, p=SUBCLASS, o=parent).select("s").distinct()
    labels = match(g, p=LABEL).join(below, "s", "left_semi").groupBy("s").agg(F.array_join(F.sort_array(F.collect_set("o")), " ").alias("text"))
    return below.join(labels, "s", "left").select(F.col("s").alias("iri"), F.coalesce("text", F.lit("")).alias("text"))
