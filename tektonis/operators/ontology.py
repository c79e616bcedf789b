"""Subclass reasoning: closure, vocabularies, anchors, and the resolution of category and type.

The closure is a fix-point of distributed joins: the frontier alone is joined in each round, new pairs are found by an anti join with those of all rounds, and each round is written once to the checkpoint folder, so cycles end and a lost executor costs one round. Depths are those of the shortest way."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tektonis.runtime import cut, number_distinct


def closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(child, ancestor, depth), reflexive and transitive; edges are (child, parent). Null ends are left out.

    Rounds go on until no pair is new; where a `max_depth` is given, pairs beyond it are an error."""
    edges = cut(edges.select("child", "parent").where("child IS NOT NULL AND parent IS NOT NULL AND child <> parent").distinct())
    nodes = edges.select(F.col("child").alias("n")).union(edges.select("parent")).distinct()
    frontier = found = cut(nodes.select(F.col("n").alias("child"), F.col("n").alias("ancestor"), F.lit(0).alias("depth")))
    for depth in count(1):
        step = frontier.select("child", F.col("ancestor").alias("at")).join(edges.select(F.col("child").alias("at"), F.col("parent").alias("ancestor")), "at")
        new = step.select("child", "ancestor").distinct().join(found, ["child", "ancestor"], "left_anti").withColumn("depth", F.lit(depth))
        frontier = cut(new)
        if frontier.isEmpty():
            return found
        if max_depth is not None and depth > max_depth:
            raise ValueError(f"the hierarchy is deeper than {max_depth}")
        found = found.unionByName(frontier)
    return found


def strict_descendants(closed: DataFrame, ancestor: str) -> DataFrame:
    return closed.where((F.col("ancestor") == ancestor) & (F.col("child") != ancestor)).select(F.col("child").alias("iri")).distinct()


def children(edges: DataFrame, parent: str) -> DataFrame:
    return edges.where(F.col("parent") == parent).select(F.col("child").alias("iri")).distinct()


def vocabulary(fixed: list[str], closed: DataFrame, anchors: list[str]) -> DataFrame:
    """Fixed members and all descendants of the anchors, without the anchors."""
    spark = closed.sparkSession
    own = spark.createDataFrame([(x,) for x in fixed], "iri string")
    below = closed.where(F.col("ancestor").isin(*anchors)).select(F.col("child").alias("iri"))
    return own.union(below).distinct().where(~F.col("iri").isin(*anchors))


def types_without_anchors(closed: DataFrame, root: str, categories: DataFrame) -> DataFrame:
    """Descendants of a root that are no categories."""
    return strict_descendants(closed, root).join(categories.select("iri"), "iri", "left_anti")


def nearest_anchor(closed: DataFrame, anchors: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """(iri, anchor): the nearest ancestor among the anchors, the first in code point order among equally near ones."""
    near = closed.join(anchors.select(F.col("iri").alias("ancestor")), "ancestor", "left_semi")
    if skip is not None:
        near = near.join(skip.select(F.col("iri").alias("ancestor")), "ancestor", "left_anti")
    return near.groupBy(F.col("child").alias("iri")).agg(F.min(F.struct("depth", "ancestor")).alias("a")).select("iri", F.col("a.ancestor").alias("anchor"))


def category_tree(categories: DataFrame, types: DataFrame, closed: DataFrame) -> DataFrame:
    """(category, types): sorted types below each category, an empty list where there are none."""
    below = closed.where("child <> ancestor").join(types.select(F.col("iri").alias("child")), "child").select(F.col("ancestor").alias("iri"), "child")
    grouped = below.groupBy("iri").agg(F.sort_array(F.collect_set("child")).alias("types"))
    return categories.select("iri").distinct().join(grouped, "iri", "left").select(F.col("iri").alias("category"), F.coalesce("types", F.array().cast("array<string>")).alias("types"))


def resolve_pair(df: DataFrame, anchors: DataFrame, functions: DataFrame, types: DataFrame, closed: DataFrame, cat: str = "cat", typ: str = "typ") -> DataFrame:
    """df with `cat` and `typ` made a legal pair.

    A function is no material. A category that is no anchor gives way to its anchor and becomes the type if none is given. A type alone finds its category. A type equal to its category, or that is an anchor only, is dropped; one under another category moves the category, or is dropped if it has none."""
    fn = functions.select(F.col("iri").alias("_fn")).distinct()
    an = anchors.select(F.col("iri").alias("_of"), F.col("anchor").alias("_anchor"))
    is_anchor = anchors.select(F.col("anchor").alias("_is")).distinct()
    below = closed.select(F.col("child").alias("_c"), F.col("ancestor").alias("_a")).distinct()
    known = types.select(F.col("iri").alias("_t")).distinct()

    def flag(d: DataFrame, col: str, table: DataFrame, key: str, name: str) -> DataFrame:
        return d.join(table.withColumn(name, F.lit(True)), d[col] == table[key], "left").drop(key)

    d = flag(df, cat, fn, "_fn", "_cf")
    d = flag(d, typ, fn, "_fn", "_tf")
    d = d.withColumn(cat, F.when(F.col("_cf").isNull(), F.col(cat))).withColumn(typ, F.when(F.col("_tf").isNull(), F.col(typ))).drop("_cf", "_tf")
    d = flag(d, cat, is_anchor, "_is", "_ca")
    d = d.join(an.withColumnRenamed("_anchor", "_cat_anchor"), d[cat] == an["_of"], "left").drop("_of")
    demoted = F.col(cat).isNotNull() & F.col("_ca").isNull()
    d = d.withColumn(typ, F.when(demoted & F.col(typ).isNull(), F.col(cat)).otherwise(F.col(typ))).withColumn(cat, F.when(demoted, F.col("_cat_anchor")).otherwise(F.col(cat))).drop("_ca", "_cat_anchor")
    d = d.join(an.withColumnRenamed("_anchor", "_typ_anchor"), d[typ] == an["_of"], "left").drop("_of")
    d = d.withColumn(cat, F.coalesce(F.col(cat), F.col("_typ_anchor")))
    d = flag(d, typ, is_anchor, "_is", "_ta")
    d = flag(d, typ, known, "_t", "_tk")
    d = d.join(below.withColumn("_under", F.lit(True)), (d[typ] == below["_c"]) & (d[cat] == below["_a"]), "left").drop("_c", "_a")
    gone = F.col(cat).isNull() | (F.col(typ) == F.col(cat)) | (F.col("_ta").isNotNull() & F.col("_tk").isNull())
    moves = F.col("_under").isNull() & F.col("_typ_anchor").isNotNull() & (F.col("_typ_anchor") != F.col(typ))
    lost = F.col("_under").isNull() & ~F.coalesce(moves, F.lit(False))
    d = d.withColumn("_gone", F.coalesce(gone, F.lit(False)) | F.col(typ).isNull())
    d = d.withColumn("_cat", F.when(~F.col("_gone") & F.coalesce(moves, F.lit(False)), F.col("_typ_anchor")).otherwise(F.col(cat)))
    d = d.withColumn("_typ", F.when(~F.col("_gone") & ~lost, F.col(typ)))
    return d.withColumn(cat, F.col("_cat")).withColumn(typ, F.col("_typ")).drop("_typ_anchor", "_ta", "_tk", "_under", "_gone", "_cat", "_typ")


def resolve_member(column: Column, allowed: list[str], default: str | None = None) -> Column:
    """A value of a small fixed vocabulary; the default where it is missing, null where it is illegal."""
    out = F.when(column.isin(*allowed), column)
    return F.when(column.isNull() | (column == ""), F.lit(default)).otherwise(out)


def profiles(triples: DataFrame, label: str, comment: str, subclass: str, langs: tuple[str, ...] = ("en", "de")) -> DataFrame:
    """(entity, labels, comments, parents, text): the sorted texts of each entity."""
    ok = F.col("o_lang").isNull() | F.col("o_lang").isin(*langs)
    pick = lambda p, cond=F.lit(True): F.sort_array(F.collect_set(F.when((F.col("p") == p) & cond, F.col("o"))))
    g = triples.groupBy(F.col("s").alias("entity")).agg(pick(label, ok).alias("labels"), pick(comment, ok).alias("comments"), pick(subclass).alias("parents"))
    return g.withColumn("text", F.concat_ws(" | ", F.array_distinct(F.concat("labels", "comments"))))


def encode(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the rank of a label among the sorted distinct labels, from 0."""
    return df.join(number_distinct(df, column, name), column, "left")


def sanitize_slots(df: DataFrame, anchors: DataFrame, functions: DataFrame, fn: str = "fn", cat: str = "cat", typ: str = "typ") -> DataFrame:
    """df with values moved to the slot they belong to.

    A function leaves the material slots. A material in the function slot moves to the type slot if that is empty, its anchor to an empty category slot, and the function becomes null, as does anything else that is no function."""
    known = functions.select(F.col("iri").alias("_f")).distinct()
    flag = lambda d, c, n: d.join(known.withColumn(n, F.lit(True)), d[c] == F.col("_f"), "left").drop("_f")
    d = df
    for c, n in ((fn, "_in_fn"), (cat, "_in_cat"), (typ, "_in_typ")):
        d = flag(d, c, n)
    d = d.withColumn(cat, F.when(F.col("_in_cat").isNull(), F.col(cat))).withColumn(typ, F.when(F.col("_in_typ").isNull(), F.col(typ)))
    an = anchors.select(F.col("iri").alias("_of"), F.col("anchor").alias("_anchor"))
    d = d.join(an, d[fn] == an["_of"], "left").drop("_of")
    material = F.col("_in_fn").isNull() & F.col("_anchor").isNotNull()
    d = d.withColumn(typ, F.when(material, F.coalesce(F.col(typ), F.col(fn))).otherwise(F.col(typ))).withColumn(cat, F.when(material, F.coalesce(F.col(cat), F.col("_anchor"))).otherwise(F.col(cat)))
    return d.withColumn(fn, F.when(F.col("_in_fn").isNotNull(), F.col(fn))).drop("_in_fn", "_in_cat", "_in_typ", "_anchor")
