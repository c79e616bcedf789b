"""Rows to triples: buildings, elements, layer sets, layers, materials and impacts.

Every row makes its triples in one pass (an array of structs that is exploded); set semantics come from one distinct at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tektonis.functions import lca
from tektonis.operators.triples import RDF_TYPE, explode_triples, triple

BASE = "https://data.example/"
NS = "https://vocab.example/bm#"


def layer_uri(owner: Column, index: Column) -> Column:
    """Owner and a two-digit number."""
    return F.concat(owner, F.lit("_Layer_"), F.lpad(index.cast("string"), 2, "0"))


def material_triples(layer: Column, cat: Column, typ: Column) -> list[Column]:
    """A material with its category; the type only where it differs. Nothing without a category."""
    material = F.when(cat.isNotNull(), F.concat(layer, F.lit("_Material")))
    return [triple(layer, NS + "hasMaterial", material), triple(material, RDF_TYPE, F.lit(NS + "Material")), triple(material, NS + "hasCategory", cat), triple(material, NS + "hasType", F.when(~typ.eqNullSafe(cat), typ))]


def measure_triples(subject: Column, value: Column, unit: str = "cm") -> list[Column]:
    """A measure node with value and unit, named after its subject."""
    node = F.when(value.isNotNull(), F.concat(subject, F.lit("_Thickness")))
    return [triple(subject, NS + "hasThickness", node), triple(node, NS + "value", value, "literal"), triple(node, NS + "unit", F.when(value.isNotNull(), F.lit(NS + unit)))]


def composition_triples(df: DataFrame, owner: str, layers: str, topology: str) -> DataFrame:
    """The triples of layer sets: one row per set, with its layers as an array of structs (layer_index, fn, cat, typ, thickness_cm)."""
    sets = df.select(F.concat(F.lit(BASE), F.col(owner).cast("string")).alias("set"), F.col(topology).alias("topology"), F.explode_outer(layers).alias("l"))
    one = F.when(F.col("l").isNotNull(), layer_uri(F.col("set"), F.col("l.layer_index")))
    rows = [
        triple(F.col("set"), RDF_TYPE, F.lit(NS + "LayerSet")), triple(F.col("set"), RDF_TYPE, F.col("topology")), triple(F.col("set"), NS + "hasLayer", one), triple(one, RDF_TYPE, F.lit(NS + "Layer")),
        triple(one, NS + "hasFunction", F.col("l.fn")), *material_triples(one, F.when(one.isNotNull(), F.col("l.cat")), F.col("l.typ")), *measure_triples(one, F.col("l.thickness_cm")),
    ]
    return explode_triples(sets, F.array(*rows))


def impact_triples(rolled: DataFrame, keys: list[str], indicators: tuple[str, ...] = tuple(lca.INDICATORS)) -> DataFrame:
    """The impact node of every roll-up row: stage types, suffix, sums that are not null."""
    node = F.concat(F.lit(BASE + "Impact_"), F.concat_ws("_", *[lca.safe_id(F.col(k)) for k in keys]), F.lit("_"), F.col("stage_suffix"))
    rows = [triple(node, RDF_TYPE, F.lit(NS + "Impact")), triple(node, NS + "stage", F.col("stage_suffix"), "literal"), triple(node, NS + "activity", F.concat(F.lit(NS), F.col("activity"))), triple(node, NS + "amount", F.col("amount"), "literal")]
    rows += [triple(node, NS + lca.INDICATORS[x], F.col(x), "literal") for x in indicators]
    return explode_triples(rolled, F.array(*rows))


def network(g: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) for a drawing: nodes with their class and style, edges labelled with the property's local name."""
    kinds = g.where(F.col("p") == RDF_TYPE).groupBy(F.col("s").alias("id")).agg(F.min(F.substring_index("o", "#", -1)).alias("kind"))
    edges = g.where((F.col("o_kind") != "literal") & (F.col("p") != RDF_TYPE)).select(F.col("s").alias("src"), F.col("o").alias("dst"), F.substring_index(F.substring_index("p", "#", -1), "/", -1).alias("label")).distinct()
    style = F.when(F.col("kind") == "LayerSet", "box").when(F.col("kind") == "Layer", "ellipse").when(F.col("kind") == "Material", "diamond").otherwise("dot")
    return kinds.withColumn("style", style), edges

# Renovation states and the status classes they stand for.
STATUS = {"existing": "NotRenovated", "usual": "SmallRenovation", "advanced": "LargeRenovation"}


def status_schema(df: DataFrame) -> DataFrame:
    """The classes of the renovation states as triples; df lends its session."""
    rows = [(NS + name, RDF_TYPE, "http://www.w3.org/2002/07/owl#Class", "iri", None, None) for name in STATUS.values()]
    return df.sparkSession.createDataFrame(rows, "s string, p string, o string, o_kind string, o_lang string, o_dt string")


def staged_triples(stages: DataFrame, building: str, element: str, state: str, layers: str) -> DataFrame:
    """Triples of buildings, their elements and their states: one row per state, with the uris of its layers as an array of strings, so that a layer that a later state keeps is one node."""
    b = F.concat(F.lit(BASE + "Building_"), lca.safe_id(F.col(building)))
    e = F.concat(b, F.lit("_"), lca.safe_id(F.col(element)))
    s = F.concat(e, F.lit("_"), F.col(state))
    status = lca.lookup({k: NS + v for k, v in STATUS.items()}, F.col(state))
    rows = stages.select(b.alias("b"), e.alias("e"), s.alias("s_"), status.alias("status"), F.explode_outer(layers).alias("l"))
    parts = [triple(F.col("b"), RDF_TYPE, F.lit(NS + "Building")), triple(F.col("b"), NS + "hasElement", F.col("e")), triple(F.col("e"), NS + "hasLayerSet", F.col("s_")), triple(F.col("s_"), NS + "status", F.col("status")), triple(F.col("s_"), NS + "hasLayer", F.col("l"))]
    return explode_triples(rows, F.array(*parts))
