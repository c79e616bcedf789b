"""Queries over layer sets: repair, variants, triples, audits and comparison, with DuckDB twins where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tektonis.functions import text
from tektonis.operators import compose, emit, mapper, nested, ontology, triples, validate
from tektonis.plans.registry import Registry
from tektonis.runtime import cut
from tektonis.sources import table

R = Registry()
FUNCTIONS = {"AirSpace": "Air", "ThermalInsulation": "Insulating", "SurfaceFinish": "Finishing", "LoadCarrying": "LoadBearing", "OuterCladding": "Facade"}

# the sets of the table with local names for IRIs; redelivered rows once
_FN = "CASE split_part(l.predicted_function_iri, '#', 2) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FUNCTIONS.items()) + " ELSE nullif(split_part(l.predicted_function_iri, '#', 2), '') END"
LAYERS_SQL = f"""r AS (SELECT DISTINCT set_id, layers, thickness_cm, layer_set_description FROM material_alternatives), u AS (SELECT set_id, unnest(layers) AS l, generate_subscripts(layers, 1) AS i FROM r),
    n AS (SELECT set_id, i, {_FN} AS fn, nullif(split_part(l.predicted_category_iri, '#', 2), '') AS cat, nullif(split_part(l.predicted_type_iri, '#', 2), '') AS typ, l.thickness_cm AS cm FROM u)"""
OUT = "set_id, layer_index, fn, cat, typ, thickness_cm"


def _sets(spark: SparkSession, sf: str) -> DataFrame:
    """(set_id, layers, thickness_cm, description): the sets with layers of local names."""
    rows = table(spark, sf, "material_alternatives").select("set_id", "layers", "thickness_cm", "layer_set_description").distinct()
    name = lambda c: F.nullif(F.split_part(c, F.lit("#"), F.lit(2)), F.lit(""))
    fn = lambda c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FUNCTIONS.items() for x in kv]), name(c)), name(c))
    layers = F.transform("layers", lambda x, i: F.struct((i + 1).cast("int").alias("layer_index"), fn(x["predicted_function_iri"]).alias("fn"), name(x["predicted_category_iri"]).alias("cat"), name(x["predicted_type_iri"]).alias("typ"), x["thickness_cm"].alias("thickness_cm")))
    return rows.select("set_id", layers.alias("layers"), "thickness_cm", F.col("layer_set_description").alias("description")).where("layers IS NOT NULL")


def _functions(vocabulary: DataFrame) -> DataFrame:
    """(iri): the functions of the vocabulary, also under the names that layers have for them."""
    return vocabulary.where("kind = 'function'").select(F.explode(F.array(F.col("local_name"), F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FUNCTIONS.items() for x in kv]), F.col("local_name")), F.col("local_name")))).alias("iri")).distinct()


def _flat(df: DataFrame, layers: str = "layers", *keys: str) -> DataFrame:
    return df.select("set_id", *keys, F.explode(layers).alias("l")).select("set_id", *keys, "l.*")


@R.add(f"WITH {LAYERS_SQL} SELECT set_id, CAST(row_number() OVER (PARTITION BY set_id ORDER BY i) AS INT) AS layer_index, fn, cat, typ, cm AS thickness_cm FROM n WHERE coalesce(CAST(cm AS VARCHAR), fn, cat, typ) IS NOT NULL")
def layer_json_validate(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(_sets(spark, sf).withColumn("layers", compose.reindex(compose.with_signal(F.col("layers")))))


@R.add(f"WITH {LAYERS_SQL} SELECT set_id, CAST(i AS INT) AS layer_index, fn, CASE WHEN fn IS DISTINCT FROM 'Air' THEN cat END AS cat, CASE WHEN fn IS DISTINCT FROM 'Air' THEN typ END AS typ, cm AS thickness_cm FROM n")
def strip_air(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(_sets(spark, sf).withColumn("layers", compose.strip_air(F.col("layers"))))


PLASTER_SQL = """f AS (SELECT set_id, bool_or(fn IS NOT DISTINCT FROM 'Finishing') OR count_if(fn IS DISTINCT FROM 'Air') = 0 AS same FROM n GROUP BY set_id), p AS (
    SELECT set_id, i AS o, fn, cat, typ, cm FROM n JOIN f USING (set_id) WHERE same UNION ALL SELECT set_id, i, fn, cat, typ, cm FROM n JOIN f USING (set_id) WHERE NOT same AND fn IS DISTINCT FROM 'Air'
    UNION ALL SELECT set_id, unnest([0, 1000000]), 'Finishing', 'Binders', 'Gypsum', NULL FROM f WHERE NOT same)"""


@R.add(f"WITH {LAYERS_SQL}, {PLASTER_SQL} SELECT set_id, CAST(row_number() OVER (PARTITION BY set_id ORDER BY o) AS INT) AS layer_index, fn, cat, typ, cm AS thickness_cm FROM p")
def plaster_faces(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(_sets(spark, sf).withColumn("layers", compose.plaster_faces(F.col("layers"))))


@R.add(f"""WITH {LAYERS_SQL}, b AS (SELECT set_id, count_if(fn = 'LoadBearing') AS bearing, count(*) AS n FROM n GROUP BY set_id),
    s AS (SELECT n.*, fn IS NOT NULL AND fn <> 'Finishing' AND NOT (fn = 'LoadBearing' AND cat IS NULL AND cm IS NULL AND bearing > 1) AS structural FROM n JOIN b USING (set_id)),
    k AS (SELECT set_id, count_if(structural) AS st FROM s GROUP BY set_id), c AS (SELECT s.set_id, row_number() OVER (PARTITION BY s.set_id ORDER BY i) AS o, fn, cat, typ, cm FROM s JOIN k USING (set_id) WHERE structural OR (st = 0 AND i = 1)),
    a AS (SELECT set_id, coalesce(min(o) FILTER (fn = 'LoadBearing'), 1) AS pos FROM c GROUP BY set_id), v AS (SELECT unnest([1, 2]) AS alt, unnest(['Brick', 'Concrete']) AS ac, unnest(['BrickMasonryUnit', NULL]) AS aty)
    SELECT c.set_id, alt, CAST(o AS INT) AS layer_index, fn, CASE WHEN o = pos THEN ac ELSE cat END AS cat, CASE WHEN o = pos THEN aty ELSE typ END AS typ, CASE WHEN o = pos THEN coalesce(cm, t.thickness_cm) ELSE cm END AS thickness_cm
    FROM c JOIN a USING (set_id) JOIN r t ON t.set_id = c.set_id CROSS JOIN v""")  # fmt: skip
def alternative_sets(spark: SparkSession, sf: str) -> DataFrame:
    s = _sets(spark, sf).where(F.size("layers") > 0)
    options = F.expr("array(named_struct('cat', 'Brick', 'typ', 'BrickMasonryUnit'), named_struct('cat', 'Concrete', 'typ', CAST(NULL AS STRING)), named_struct('cat', 'Brick', 'typ', 'third'))")
    alts = s.select("set_id", F.posexplode(compose.alternatives(F.col("layers"), F.col("thickness_cm"), options)).alias("alt", "layers"))
    return _flat(alts.withColumn("layers", compose.reindex(F.col("layers"))).withColumn("alt", F.col("alt") + 1), "layers", "alt")


@R.add(f"""WITH {LAYERS_SQL}, k AS (SELECT unnest(['below', 'top', 'both', 'add']) AS kind), x AS (SELECT set_id, kind, i AS o, fn, cat, typ, cm FROM n CROSS JOIN k
      UNION ALL SELECT set_id, kind, 0, 'Insulating', NULL, NULL, thickness_cm FROM r CROSS JOIN k WHERE kind IN ('top', 'both') AND layers IS NOT NULL UNION ALL SELECT set_id, kind, 1000000, 'Insulating', NULL, NULL, thickness_cm FROM r CROSS JOIN k WHERE kind <> 'top' AND layers IS NOT NULL)
    SELECT set_id, kind, CAST(row_number() OVER (PARTITION BY set_id, kind ORDER BY o) AS INT) AS layer_index, fn, cat, typ, cm AS thickness_cm FROM x""")
def placement_variants(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.explode(F.array(*map(F.lit, ("below", "top", "both", "add"))))
    s = _sets(spark, sf).withColumn("kind", kinds)
    return _flat(s.withColumn("layers", compose.place_insulation(F.col("layers"), F.col("kind"), F.col("thickness_cm"))), "layers", "kind")


_CM = r"TRY_CAST(replace(nullif(regexp_extract({0}, '(?i)(\d+(?:[.,]\d+)?)\s*cm', 1), ''), ',', '.') AS DOUBLE)"


@R.add(f"""WITH {LAYERS_SQL}, d AS (SELECT set_id, thickness_cm, 'concrete with ' || CAST(CAST(floor(thickness_cm) AS INT) AS VARCHAR) || ' cm insulation' AS en FROM r WHERE layers IS NOT NULL), t AS (SELECT set_id, {_CM.format('en')} AS cm0, en IS NOT NULL AS named FROM d),
    a AS (SELECT n.set_id, i, fn, CASE WHEN named AND fn IS NOT DISTINCT FROM 'Insulating' THEN NULL ELSE cat END AS cat, CASE WHEN named AND fn IS NOT DISTINCT FROM 'Insulating' THEN NULL ELSE typ END AS typ,
      CASE WHEN NOT named THEN cm WHEN fn IS NOT DISTINCT FROM 'Insulating' THEN coalesce(cm0, cm) WHEN cm0 IS NOT NULL AND cm IS NOT DISTINCT FROM cm0 THEN NULL ELSE cm END AS cm FROM n JOIN t USING (set_id)),
    b AS (SELECT * FROM a UNION ALL SELECT t.set_id, 1000000, 'Insulating', NULL, NULL, cm0 FROM t WHERE named AND NOT EXISTS (SELECT 1 FROM n WHERE n.set_id = t.set_id AND fn = 'Insulating')),
    c AS (SELECT set_id, i, CASE WHEN contains(coalesce(cat, ''), 'Concrete') AND fn IS DISTINCT FROM 'Insulating' THEN coalesce(fn, 'LoadBearing') ELSE fn END AS fn, CASE WHEN contains(coalesce(cat, ''), 'Concrete') AND fn IS DISTINCT FROM 'Insulating' THEN 'Concrete' ELSE cat END AS cat,
      CASE WHEN contains(coalesce(cat, ''), 'Concrete') AND fn IS DISTINCT FROM 'Insulating' THEN NULL ELSE typ END AS typ, cm FROM b),
    x AS (SELECT c.* FROM c UNION ALL SELECT t.set_id, 0, 'LoadBearing', 'Concrete', NULL, NULL FROM t WHERE named AND NOT EXISTS (SELECT 1 FROM c WHERE c.set_id = t.set_id AND c.cat = 'Concrete' AND c.fn IS DISTINCT FROM 'Insulating'))
    SELECT set_id, CAST(row_number() OVER (PARTITION BY set_id ORDER BY i) AS INT) AS layer_index, fn, cat, typ, cm AS thickness_cm FROM x""")  # fmt: skip
def align_existing(spark: SparkSession, sf: str) -> DataFrame:
    s = _sets(spark, sf).withColumn("en", F.concat(F.lit("concrete with "), F.floor("thickness_cm").cast("int").cast("string"), F.lit(" cm insulation")))
    return _flat(s.withColumn("layers", compose.align_existing(F.col("layers"), F.col("en"))))


@R.add(f"""WITH {LAYERS_SQL} SELECT set_id, string_agg('L' || i || ':' || coalesce(fn, '-') || '/' || coalesce(cat, '-') || '/' || coalesce(typ, '-') || CASE WHEN cm IS NULL THEN '' ELSE '@' || regexp_replace(CAST(cm AS VARCHAR), '\\.0$', '') || 'cm' END, ', ' ORDER BY i) AS summary FROM n GROUP BY set_id""")
def layer_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return _sets(spark, sf).where(F.size("layers") > 0).select("set_id", compose.summary(F.col("layers")).alias("summary"))


@R.add(f"""WITH {LAYERS_SQL}, k AS (SELECT set_id, '[' || string_agg(concat_ws('|', coalesce(fn, '-'), coalesce(cat, '-'), coalesce(CAST(cm AS VARCHAR), '-')), ';' ORDER BY concat_ws('|', coalesce(fn, '-'), coalesce(cat, '-'), coalesce(CAST(cm AS VARCHAR), '-'))) || ']' AS s FROM n GROUP BY set_id),
    o AS (SELECT DISTINCT set_id, element_no FROM material_alternatives) SELECT element_no, string_agg(s, '' ORDER BY s) AS signature FROM k JOIN o USING (set_id) WHERE element_no IS NOT NULL GROUP BY element_no""")
def composition_signature(spark: SparkSession, sf: str) -> DataFrame:
    owner = table(spark, sf, "material_alternatives").select("set_id", "element_no").where("element_no IS NOT NULL").distinct()
    return validate.signature(_flat(_sets(spark, sf)).join(owner, "set_id"), "element_no", "set_id", ["fn", "cat", "thickness_cm"])


TRIPLES_SQL = f"""{LAYERS_SQL}, q AS (SELECT 'https://data.example/' || set_id AS st, 'https://data.example/' || set_id || '_Layer_' || lpad(CAST(i AS VARCHAR), 2, '0') AS l, fn, cat, typ, cm FROM n), v AS (SELECT 'https://vocab.example/bm#' AS ns, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS ty),
    g AS (SELECT st AS s, ty AS p, ns || 'LayerSet' AS o FROM q, v UNION SELECT st, ns || 'hasLayer', l FROM q, v UNION SELECT l, ty, ns || 'Layer' FROM q, v UNION SELECT l, ns || 'hasFunction', fn FROM q, v WHERE fn IS NOT NULL
      UNION SELECT st, ty, CASE WHEN (SELECT count(*) FROM n WHERE 'https://data.example/' || n.set_id = st) > 1 THEN 'MultiLayer' ELSE 'SingleLayer' END FROM q, v
      UNION SELECT l, ns || 'hasMaterial', l || '_Material' FROM q, v WHERE cat IS NOT NULL UNION SELECT l || '_Material', ty, ns || 'Material' FROM q, v WHERE cat IS NOT NULL UNION SELECT l || '_Material', ns || 'hasCategory', cat FROM q, v WHERE cat IS NOT NULL
      UNION SELECT l || '_Material', ns || 'hasType', typ FROM q, v WHERE cat IS NOT NULL AND typ IS NOT NULL AND typ <> cat UNION SELECT l, ns || 'hasThickness', l || '_Thickness' FROM q, v WHERE cm IS NOT NULL
      UNION SELECT l || '_Thickness', ns || 'value', CAST(cm AS VARCHAR) FROM q, v WHERE cm IS NOT NULL UNION SELECT l || '_Thickness', ns || 'unit', ns || 'cm' FROM q, v WHERE cm IS NOT NULL)"""


def _composition(spark: SparkSession, sf: str) -> DataFrame:
    s = _sets(spark, sf).where(F.size("layers") > 0).withColumn("topology", compose.topology(F.col("layers"), F.lit("SingleLayer")))
    return emit.composition_triples(s, "set_id", "layers", "topology")


@R.add(f"WITH {TRIPLES_SQL} SELECT s, p, o FROM g")
def composition_triples(spark: SparkSession, sf: str) -> DataFrame:
    return _composition(spark, sf).select("s", "p", "o")


NS = emit.NS
V = f"(SELECT '{NS}' AS ns)"


@R.add(f"""WITH {TRIPLES_SQL}, fns AS (SELECT unnest(['Air', 'Insulating', 'Finishing', 'LoadBearing']) AS o), cats AS (SELECT local_name AS o FROM vocabulary WHERE kind = 'category' AND ref_id % 3 > 0), tys AS (SELECT local_name AS o FROM vocabulary WHERE kind = 'material' AND ref_id % 2 = 0),
    i AS (SELECT 'function_range' AS kind, s, o FROM g WHERE p = '{NS}hasFunction' AND o NOT IN (SELECT o FROM fns) UNION ALL SELECT 'category_range', s, o FROM g WHERE p = '{NS}hasCategory' AND o NOT IN (SELECT o FROM cats)
      UNION ALL SELECT 'type_orphan', s, o FROM g WHERE p = '{NS}hasType' AND o NOT IN (SELECT o FROM cats) AND o IN (SELECT o FROM tys) UNION ALL SELECT 'type_invalid', s, o FROM g WHERE p = '{NS}hasType' AND o NOT IN (SELECT o FROM cats) AND o NOT IN (SELECT o FROM tys))
    SELECT kind, count(*) AS n, count(DISTINCT o) AS objects, min(s) AS first FROM i GROUP BY kind""")  # fmt: skip
def range_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Values outside the vocabulary, by kind of fault. SQL knows four functions and leaves out a third of the categories and half of the materials."""
    v = table(spark, sf, "vocabulary")
    anchors = v.where("kind = 'category'").select(F.col("local_name").alias("iri"), F.col("local_name").alias("anchor"))
    types = v.where("kind = 'material'").select(F.col("local_name").alias("iri"))
    got = validate.range_audit(cut(_composition(spark, sf)), _functions(v), anchors, types, NS + "hasFunction", NS + "hasCategory", NS + "hasType", NS + "Layer")
    return got.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("o").alias("objects"), F.min("s").alias("first"))


@R.add(f"""WITH {TRIPLES_SQL}, l AS (SELECT DISTINCT s FROM g WHERE o = '{NS}Layer'), c AS (SELECT l.s, count(DISTINCT f.o) AS nf, count(DISTINCT h.o) AS nh FROM l LEFT JOIN g f ON f.s = l.s AND f.p = '{NS}hasFunction' LEFT JOIN g h ON h.s = l.s AND h.p = '{NS}hasThickness' GROUP BY l.s)
    SELECT 'violation' AS severity, s AS focus, '{NS}hasFunction: ' || nf || ' values' AS message FROM c WHERE nf < 1 OR nf > 1 UNION ALL SELECT 'warning', s, '{NS}hasThickness: ' || nh || ' values' FROM c WHERE nh < 1""")
def shape_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    g = _composition(spark, sf)
    return validate.cardinality(g, NS + "Layer", NS + "hasFunction", 1, 1).unionByName(validate.cardinality(g, NS + "Layer", NS + "hasThickness", 1, None, "warning"))


@R.add(f"""WITH {TRIPLES_SQL}, m AS (SELECT s, string_agg(o, ', ' ORDER BY o) AS k, count(*) AS n FROM g WHERE p LIKE '%#type' AND o IN ('{NS}LayerSet', 'MultiLayer') GROUP BY s)
    SELECT 'violation' AS severity, s AS focus, k AS message FROM m WHERE n > 1 UNION ALL SELECT DISTINCT 'warning', s, 'no topology' FROM g WHERE o = '{NS}LayerSet' AND s NOT IN (SELECT s FROM g WHERE p LIKE '%#type' AND o = 'MultiLayer')
    UNION ALL SELECT DISTINCT 'violation', s, 'has {NS}hasMaterial' FROM g WHERE p = '{NS}hasFunction' AND o = 'Air' AND s IN (SELECT s FROM g WHERE p = '{NS}hasMaterial')
    UNION ALL SELECT 'violation', s, '{NS}hasMaterial: no {NS}Layer: ' || o FROM g WHERE p = '{NS}hasMaterial'
    UNION ALL SELECT DISTINCT 'violation', s, 'value or unit is missing' FROM g WHERE o = '{NS}Layer' AND NOT (s IN (SELECT s FROM g WHERE p IN ('{NS}hasThickness', '{NS}other')) AND s IN (SELECT s FROM g WHERE p = '{NS}hasMaterial'))""")  # fmt: skip
def shape_checks(spark: SparkSession, sf: str) -> DataFrame:
    g = cut(_composition(spark, sf))  # read by each check
    layers = triples.match(g, p=triples.RDF_TYPE, o=NS + "Layer")
    parts = [
        validate.mixed_types(g, [NS + "LayerSet", "MultiLayer"]),
        validate.none_of(g, NS + "LayerSet", ["MultiLayer"]),
        validate.forbidden_with(g, NS + "hasFunction", "Air", NS + "hasMaterial"),
        validate.object_class(g, NS + "hasMaterial", NS + "Layer"),
        validate.either_property(g, layers, [[NS + "hasThickness", NS + "other"], [NS + "hasMaterial"]]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@R.add(f"""WITH {LAYERS_SQL}, w AS (SELECT set_id, cat AS v, row_number() OVER (PARTITION BY set_id ORDER BY cat) AS k FROM n WHERE cat IS NOT NULL), h AS (SELECT set_id, cat AS v, row_number() OVER (PARTITION BY set_id ORDER BY cat) AS k FROM n WHERE cat IS NOT NULL AND i > 1)
    SELECT coalesce(w.set_id, h.set_id) AS set_id, coalesce(w.k, h.k) AS place, w.v AS predicted, h.v AS gold FROM w FULL JOIN h ON w.set_id = h.set_id AND w.k = h.k WHERE w.v IS DISTINCT FROM h.v""")
def gold_positional_diff(spark: SparkSession, sf: str) -> DataFrame:
    n = _flat(_sets(spark, sf)).where("cat IS NOT NULL")
    return validate.positional_diff(n.select("set_id", "cat"), n.where("layer_index > 1").select("set_id", "cat"), "set_id", "cat").select("set_id", F.col("place").cast("bigint").alias("place"), "predicted", "gold")


@R.add(f"WITH {LAYERS_SQL} SELECT typ, count(DISTINCT set_id) AS owners FROM n GROUP BY typ HAVING count(DISTINCT set_id) > 1")
def reused_members(spark: SparkSession, sf: str) -> DataFrame:
    return validate.reused(_flat(_sets(spark, sf)), "set_id", "typ")


@R.add(f"""WITH {LAYERS_SQL}, v AS (SELECT local_name FROM vocabulary WHERE ref_id % 2 = 0), b AS (SELECT set_id, count(cat) AS slots, count_if(cat IS NOT NULL AND cat NOT IN (SELECT local_name FROM v)) AS bad FROM n GROUP BY set_id)
    SELECT set_id, slots, bad, CASE WHEN slots = 0 THEN CASE WHEN bad = 0 THEN 100.0 ELSE 0.0 END ELSE greatest(0.0, round_even(100.0 * (1 - bad / slots), 1)) END AS validity FROM b""")
def validity_pct(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the categories of a set that the vocabulary has. SQL leaves out half of the vocabulary."""
    known = table(spark, sf, "vocabulary").select(F.col("local_name").alias("cat"), F.lit(True).alias("ok")).distinct()
    n = _flat(_sets(spark, sf)).join(known, "cat", "left")
    b = n.groupBy("set_id").agg(F.count("cat").alias("slots"), F.count_if(F.col("cat").isNotNull() & F.col("ok").isNull()).alias("bad"))
    return b.withColumn("validity", validate.validity_pct(F.col("bad"), F.col("slots")))


@R.add()
def material_mentions(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "material_alternatives").select(F.col("layer_set_description").alias("txt")).where("txt IS NOT NULL").distinct()
    found = d.select("txt", F.explode(compose.find_mentions("txt", unique=True)).alias("m"))
    return found.select("txt", "m.*")


@R.add()
def assigned_materials(spark: SparkSession, sf: str) -> DataFrame:
    s = _sets(spark, sf)
    bare = F.transform("layers", lambda x: x.withField("cat", F.lit(None).cast("string")).withField("typ", F.lit(None).cast("string")))
    return _flat(compose.with_materials(s.withColumn("layers", bare), "layers", "description", "assigned"), "assigned")


def vocabulary_levels(spark: SparkSession, sf: str, more: tuple[tuple[str, str], ...] = ()) -> mapper.Vocabulary:
    """A vocabulary of two levels: the categories are anchors, the types of each name stand below one of them; `more` are further (type, category)."""
    v = table(spark, sf, "vocabulary")
    cats = v.where("kind = 'category'").select(F.col("local_name").alias("parent"), (F.row_number().over(Window.partitionBy(F.col("kind")).orderBy("ref_id")) - 1).alias("n"))
    mats = v.where("kind = 'material'").select(F.col("local_name").alias("child"), (F.row_number().over(Window.partitionBy(F.col("kind")).orderBy("ref_id")) - 1).alias("n"))
    edges = mats.join(cats, "n").select("child", "parent")  # the vocabulary is the reference list
    names = cats.select("parent")
    if more:
        extra = spark.createDataFrame(list(more), "child string, parent string")
        edges, names = edges.unionByName(extra), names.union(extra.select("parent")).distinct()
    own = names.select(F.col("parent").alias("child"), F.col("parent").alias("ancestor"), F.lit(0).alias("depth"))  # categories without a type below them have no edge
    closed = ontology.closure(edges).unionByName(own).distinct()
    anchors = ontology.nearest_anchor(closed, names.select(F.col("parent").alias("iri")))
    return mapper.Vocabulary(anchors, _functions(v), edges.select(F.col("child").alias("iri")).distinct(), closed)


@R.add()
def validated_layer_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Layers against a vocabulary of two levels."""
    v = vocabulary_levels(spark, sf)
    return _flat(compose.validate_sets(_sets(spark, sf), "set_id", "layers", v.anchors, v.functions, v.types, v.closed))


# the pairs that the cues of the material rules stand for, below the categories they name
CUE_PAIRS = tuple((t, c) for _, c, t in compose.TYPE_CUES)


@R.add()
def repaired_layer_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Layer sets after the rules on named materials and a second validation."""
    v = vocabulary_levels(spark, sf, CUE_PAIRS)
    s = _sets(spark, sf).withColumn("pos", F.lit(0)).withColumn("topology", compose.topology(F.col("layers"), F.lit(None)))
    ruled = compose.named_material_rules(s.select("set_id", "pos", "topology", "thickness_cm", "layers", "description"), "description")
    ruled = ruled.withColumn("_id", F.struct("set_id", "pos"))
    got = compose.validate_sets(ruled, "_id", "layers", v.anchors, v.functions, v.types, v.closed)
    return got.select("_id.set_id", "_id.pos", F.explode("layers").alias("l")).select("set_id", "pos", "l.*")


STATES_SQL = """d AS (SELECT DISTINCT case_id, renovation_states FROM tabula_floor_renovation), s AS (SELECT case_id, unnest(renovation_states) AS s, generate_subscripts(renovation_states, 1) AS i FROM d),
    q AS (SELECT case_id, i, s.id AS state, s.layer_sets[1].layers AS ls FROM s), x AS (SELECT case_id, state, i, first(ls) OVER (PARTITION BY case_id ORDER BY i) AS base, ls FROM q)"""


@R.add(f"WITH {STATES_SQL} SELECT case_id, i, state, coalesce(len(base), 0) AS reused, coalesce(len(ls), 0) - coalesce(len(base), 0) AS added FROM x")
def renovation_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """How many layers each set (j) of each state keeps from the first state's sets and adds to them. SQL reads the first set alone and takes it that all of the first state is kept."""
    sets = compose.renovation_sets(table(spark, sf, "tabula_floor_renovation")).withColumn("ls", F.transform(F.coalesce("layers", F.array()), compose.layer_identity))
    base = F.flatten(F.collect_list(F.when(F.col("i") == 1, F.col("ls"))).over(Window.partitionBy("case_id")))
    alike = lambda x, y: x["fn"].eqNullSafe(y["fn"]) & x["cat"].eqNullSafe(y["cat"]) & x["typ"].eqNullSafe(y["typ"]) & x["cm"].eqNullSafe(y["cm"])
    kept = sets.withColumn("base", base).withColumn("reused", F.size(F.filter("ls", lambda x: F.exists("base", lambda y: alike(x, y)))).cast("bigint"))
    return kept.select("case_id", "i", "state", "j", "kind", "reused", (F.size("ls") - F.col("reused")).cast("bigint").alias("added"))


ENERGY_ROOTS = (*nested.BUILDING["roots"], "energy_need_for_heating", "energy")


@R.add("""WITH b AS (SELECT DISTINCT record_id, payload FROM building_records WHERE payload LIKE '{%' AND json_valid(payload)),
    h AS (SELECT record_id, CASE WHEN json_type(payload, '$.building') = 'OBJECT' THEN json_extract_string(payload, '$.building.id') END AS id, json_extract_string(payload, '$.building.size_class') AS size_class,
      coalesce(json_extract_string(payload, '$.energy_need_for_heating.existing_state'), json_extract_string(payload, '$.energy.heating_demand.states.existing_state')) AS existing,
      coalesce(json_extract_string(payload, '$.energy_need_for_heating.advanced_refurbishment.total'), CASE WHEN json_type(payload, '$.energy_need_for_heating.advanced_refurbishment') <> 'OBJECT' THEN json_extract_string(payload, '$.energy_need_for_heating.advanced_refurbishment') END) AS advanced FROM b)
    SELECT record_id, id, size_class, TRY_CAST(existing AS DOUBLE) AS existing, TRY_CAST(advanced AS DOUBLE) AS advanced FROM h""")  # fmt: skip
def building_energy(spark: SparkSession, sf: str) -> DataFrame:
    """Header and energy figures of each record of each payload, however it is wrapped: two layouts, and a total that is a figure or an object. SQL reads bare objects alone, and of the second layout neither `existing` nor the advanced figure."""
    b = nested.unwrapped(table(spark, sf, "building_records"), "record_id", "payload", ENERGY_ROOTS).withColumn("v", F.try_parse_json("record")).where("v IS NOT NULL")
    get = lambda path, kind="string": F.try_variant_get("v", path, kind)
    need, states = "$.energy_need_for_heating.", "$.energy.heating_demand.states."
    first = lambda *paths: F.coalesce(*[get(p, "double") for p in paths])
    return b.select(
        "record_id",
        get("$.building.id").alias("id"),
        get("$.building.size_class").alias("size_class"),
        first(need + "existing_state", states + "existing_state", states + "existing").alias("existing"),
        first(*[at + "advanced_refurbishment" + total for at in (need, states) for total in (".total", "")]).alias("advanced"),
    )
