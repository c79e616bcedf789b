"""The core's queries over the project's tables: packed values (p2), units (p4) and nested records (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tektonis.operators import nested, packed, units
from tektonis.runtime import spread
from tektonis.sources import table

STATES = [("renovation_states", "states"), ("layer_sets", "sets"), ("layers", "layers")]


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return packed.explode_packed(table(spark, sf, "material_alternatives"), "set_id", "layer_set_description", "element_no")


def p2_delimiters(spark: SparkSession, sf: str) -> DataFrame:
    """How well each candidate delimiter of each source does."""
    got = packed.delimiter_scores(table(spark, sf, "material_alternatives").select("set_id", "layer_set_description", "element_no").distinct(), "layer_set_description", "element_no")
    return got.select("source", "delimiter", F.col("n").cast("bigint").alias("n"), *[F.round(c, 6).alias(c) for c in ("consistency", "regularity", "score")])


def _layers(df: DataFrame) -> DataFrame:
    """One row per layer with its node as 'state/set/layer'."""
    a = df.select("case_id", "unit_note", F.posexplode("renovation_states").alias("i", "state"))
    b = a.select("case_id", "unit_note", F.col("state.english").alias("english"), "i", F.posexplode("state.layer_sets").alias("j", "set"))
    c = b.select("case_id", "unit_note", "english", "i", "j", F.posexplode("set.layers").alias("k", "layer"))
    node = F.concat_ws("/", *[(F.col(x) + 1).cast("string") for x in "ijk"])
    return c.select("case_id", node.alias("node"), "unit_note", "english", "layer.thickness_text", "layer.thickness_cm")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    floors = spread(table(spark, sf, "tabula_floor_renovation").select("case_id", "unit_note", "renovation_states"), "case_id")
    layers = _layers(floors).where(F.col("thickness_text").isNotNull() | (F.col("thickness_cm") > 0)).distinct()
    layer = units.layer_quantities(layers.withColumnRenamed("case_id", "record_id"))
    layer = layer.select(F.lit("layer").alias("src"), "record_id", "node", F.lit(1).cast("bigint").alias("mention_no"), "figure", "unit")
    got = nested.triples(table(spark, sf, "building_records").select("record_id", "payload"), "record_id", "payload")
    roofs = got.where((F.col("grp") == "elements/*") & (F.col("field") == "type_of_construction_eng") & F.expr("lower(substr(node, 10)) like 'roof%'"))
    roofs = roofs.select("record_id", F.expr("substr(node, 10)").alias("node"), F.col("value").alias("text"))
    roof = units.text_quantities(roofs, "text").select(F.lit("roof").alias("src"), "record_id", "node", "mention_no", "figure", "unit")
    return units.to_common(layer.unionByName(roof)).where(F.col("um") > 0).select("src", "record_id", "node", "mention_no", "um").distinct()


def p4_unread(spark: SparkSession, sf: str) -> DataFrame:
    """Thickness texts that hold no readable length, with the number of layers that have them: what p4_found leaves out is said here."""
    layers = _layers(table(spark, sf, "tabula_floor_renovation")).where("thickness_text IS NOT NULL AND trim(thickness_text) <> ''").distinct()
    texts = layers.groupBy("thickness_text").agg(F.count("*").alias("layers")).withColumnRenamed("thickness_text", "text")
    read = units.text_quantities(texts.select("text", F.col("text").alias("of")), "of").select("text").distinct()
    bare = F.rlike("text", F.lit(r"^\D*?\d+([.,/]\d+)?\s*$"))  # a figure alone, in the unit of the remark
    return texts.join(read, "text", "left_anti").where(~bare)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    building = nested.nodes(nested.triples(table(spark, sf, "building_records").select("record_id", "payload"), "record_id", "payload"), "record_id")
    floors = nested.array_nodes(table(spark, sf, "tabula_floor_renovation"), "case_id", "renovation_states", STATES)
    return (
        building.select(F.lit("building").alias("src"), "record_id", "parent_node", "node")
        .unionByName(floors.select(F.lit("renovation").alias("src"), F.col("case_id").alias("record_id"), "parent_node", "node"))
    )


def p5_element_table(spark: SparkSession, sf: str) -> DataFrame:
    """The flat table of building elements, each row naming its record."""
    got = nested.triples(table(spark, sf, "building_records").select("record_id", "payload"), "record_id", "payload")
    return nested.pivot_group(got, "record_id", "elements/*", ["surface_area_m2", "type_of_construction_eng", "type_of_construction_de", "type_of_construction"])


def _building_group(spark: SparkSession, sf: str, grp: str, fields: list[str]) -> DataFrame:
    got = nested.triples(table(spark, sf, "building_records").select("record_id", "payload"), "record_id", "payload", every=True)
    return nested.pivot_group(got, "record_id", grp, fields)


def _renovation_group(spark: SparkSession, sf: str, depth: int, fields: list[str]) -> DataFrame:
    levels = STATES[:depth]
    got = nested.array_triples(table(spark, sf, "tabula_floor_renovation"), "case_id", "renovation_states", STATES)
    return nested.pivot_group(got, "case_id", "/".join(f"{name}/*" for _, name in levels), fields)


def p5_building_table(spark: SparkSession, sf: str) -> DataFrame:
    """The flat table of records, to which the rows of the other groups belong by record_id."""
    fields = ["id", "building_json", "size_class", "construction_period", "reference_floor_area_m2", "climate_region"]
    states = ["existing_state", "usual_refurbishment", "advanced_refurbishment"]
    energy = [f"{at}.{x}" for at in ("energy_need_for_heating", "energy.heating_demand.states") for x in states]
    got = _building_group(spark, sf, nested.ROOT, [*[f"building.{f}" for f in fields], "energy_need_for_heating.unit", *energy, "energy_need_for_heating.advanced_refurbishment.total"])
    return got.select("record_id", "node", "ordinal", *[F.col(f"`{c}`").alias(c.replace("energy_need_for_heating", "need").replace("energy.heating_demand.states", "demand").replace("building.", "").replace(".", "_")) for c in got.columns[4:]])


def p5_leaf_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many values each group and field holds: the columns that a pivot of the group can have."""
    got = nested.triples(table(spark, sf, "building_records").select("record_id", "payload"), "record_id", "payload", every=True)
    return got.where("field IS NOT NULL").groupBy("grp", "field").agg(F.count("*").alias("n"), F.countDistinct("record_id").alias("records"))


def p5_heat_table(spark: SparkSession, sf: str) -> DataFrame:
    """The flat table of heat supply systems; `value` is a bare value in place of the object."""
    return _building_group(spark, sf, "heat", ["type", "efficiency", "category", "value"])


def p5_element_state_table(spark: SparkSession, sf: str) -> DataFrame:
    """The flat table of the states of building elements, each row naming its element."""
    return _building_group(spark, sf, "elements/*/*", ["u_value_W_m2K", "measure_eng"])


def p5_renovation_state_table(spark: SparkSession, sf: str) -> DataFrame:
    """The flat table of renovation states, each row naming its case."""
    return _renovation_group(spark, sf, 1, ["id", "status_iri", "english", "german"])


def p5_renovation_set_table(spark: SparkSession, sf: str) -> DataFrame:
    """The flat table of layer sets, each row naming its state."""
    return _renovation_group(spark, sf, 2, ["kind"])


def p5_renovation_layer_table(spark: SparkSession, sf: str) -> DataFrame:
    """The flat table of layers, each row naming its layer set."""
    return _renovation_group(spark, sf, 3, ["predicted_function_iri", "predicted_category_iri", "predicted_type_iri", "thickness_cm", "thickness_text"])


TABLES = (p5_element_table, p5_building_table, p5_leaf_counts, p5_heat_table, p5_element_state_table, p5_renovation_state_table, p5_renovation_set_table, p5_renovation_layer_table)
QUERIES = {f.__name__: f for f in (p2_found, p2_delimiters, p4_found, p4_unread, p5_found, *TABLES)}

_LAYERS = """d AS (SELECT DISTINCT case_id, renovation_states FROM tabula_floor_renovation), s AS (SELECT case_id, unnest(renovation_states) AS s, generate_subscripts(renovation_states, 1) AS i FROM d),
    t AS (SELECT case_id, i, unnest(s.layer_sets) AS t, generate_subscripts(s.layer_sets, 1) AS j FROM s), l AS (SELECT case_id, i, j, unnest(t.layers) AS l, generate_subscripts(t.layers, 1) AS k FROM t)"""
SQL = {
    "p5_renovation_state_table": f"WITH {_LAYERS} SELECT case_id, '' AS parent_node, 'states/' || i AS node, CAST(i AS BIGINT) AS ordinal, s.id AS id, s.status_iri AS status_iri, s.english AS english, s.german AS german FROM s",
    "p5_renovation_set_table": f"WITH {_LAYERS} SELECT case_id, 'states/' || i AS parent_node, 'states/' || i || '/sets/' || j AS node, CAST(j AS BIGINT) AS ordinal, t.kind AS kind FROM t",
    "p5_renovation_layer_table": f"""WITH {_LAYERS} SELECT case_id, 'states/' || i || '/sets/' || j AS parent_node, 'states/' || i || '/sets/' || j || '/layers/' || k AS node, CAST(k AS BIGINT) AS ordinal,
        l.predicted_function_iri AS predicted_function_iri, l.predicted_category_iri AS predicted_category_iri, l.predicted_type_iri AS predicted_type_iri, CAST(l.thickness_cm AS VARCHAR) AS thickness_cm, l.thickness_text AS thickness_text FROM l""",
}
