"""Queries over whole tables, one or more for each operator family, with DuckDB twins where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tektonis.functions import lca, text
from tektonis.functions import layout as lines
from tektonis.operators import features, impact, layout, ontology, retrieval, triples, validate
from tektonis.plans.registry import Registry
from tektonis.sources import table, turtle

R = Registry()
IND = list(lca.INDICATORS)
IND_COLS = ", ".join(f"indicator_{x}" for x in IND)


def _case(key: str, entries: dict[str, str], default: str = "NULL") -> str:
    return "CASE " + key + "".join(f" WHEN '{k}' THEN '{v}'" for k, v in entries.items()) + f" ELSE {default} END"


def _like_any(col: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


# --- impact rows ----------------------------------------------------------------------------------------------------

IMPACT = ["row_id", "element_name", "worksection_name", "element_class_sfb_mmg", "lcm_nest1_code", "lcm_code", "lcs_name", "techflow_name", "techflow_amount", "techflow_unit", "activity_type", *[f"indicator_{x}" for x in IND]]
IMPACT_SQL = f"d AS (SELECT DISTINCT {', '.join(IMPACT)} FROM impact_rows)"
STAGE_SQL = "coalesce(trim(lcm_nest1_code), trim(lcm_code), 'Unknown')"
SAFE = lambda c: f"CASE WHEN {c} IS NULL OR {c} = '' THEN 'Unknown' ELSE regexp_replace(regexp_replace(regexp_replace(trim({c}), '[\\s|/\\\\:*?\"<>+.\\-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') END"


def _impact(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "impact_rows").select(*IMPACT).distinct()


@R.add(f"""WITH {IMPACT_SQL}, r AS (SELECT element_name, {STAGE_SQL} AS stage, {', '.join(f'round(sum(indicator_{x}), 4) AS {x}' for x in IND)}, round(sum(techflow_amount), 4) AS amount,
    first(lcs_name ORDER BY row_id) AS first_lcs_name, first(activity_type ORDER BY row_id) AS first_activity_type, first(techflow_unit ORDER BY row_id) AS first_techflow_unit, min(row_id) AS first_row, count(*) AS n_rows
    FROM d WHERE element_name IS NOT NULL GROUP BY ALL)
    SELECT *, coalesce({_case('stage', lca.STAGES)}, 'LCS_' || {SAFE('stage')}) AS stage_suffix, {_case('trim(first_activity_type)', lca.ACTIVITIES)} AS activity, {_case('lower(trim(first_techflow_unit))', lca.UNITS)} AS unit FROM r""")  # fmt: skip
def impact_rollup_by_stage(spark: SparkSession, sf: str) -> DataFrame:
    rows = _impact(spark, sf).where(F.col("element_name").isNotNull())
    got = impact.rollup(rows, ["element_name"])
    return got.withColumns({c: F.round(c, 4) for c in (*IND, "amount")})


@R.add(f"""WITH {IMPACT_SQL} SELECT element_name, coalesce(string_agg(DISTINCT nullif(trim(techflow_name), ''), ' | ' ORDER BY nullif(trim(techflow_name), '')), '') AS flows FROM d WHERE element_name IS NOT NULL GROUP BY element_name""")
def techflow_distinct_join(spark: SparkSession, sf: str) -> DataFrame:
    return _impact(spark, sf).where(F.col("element_name").isNotNull()).groupBy("element_name").agg(impact.joined_distinct("techflow_name").alias("flows"))


@R.add(f"""WITH {IMPACT_SQL}, u AS (UNPIVOT (SELECT row_id, {IND_COLS} FROM d) ON {IND_COLS} INTO NAME indicator VALUE value)
    SELECT row_id, indicator, value FROM u WHERE value IS NOT NULL""")
def unpivot_indicators(spark: SparkSession, sf: str) -> DataFrame:
    return impact.unpivot(_impact(spark, sf), ["row_id"], [f"indicator_{x}" for x in IND])


@R.add(f"""WITH {IMPACT_SQL}, f AS (SELECT element_name, worksection_name, min(row_id) AS first_row FROM d WHERE element_name IS NOT NULL GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY element_name ORDER BY first_row, worksection_name) AS no, lpad(CAST(row_number() OVER (PARTITION BY element_name ORDER BY first_row, worksection_name) AS VARCHAR), 4, '0') AS padded FROM f""")
def first_seen_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return impact.sequence_ids(_impact(spark, sf).where(F.col("element_name").isNotNull()), ["element_name"], "row_id", "worksection_name", 4)


@R.add(f"""WITH c AS (SELECT DISTINCT {STAGE_SQL} AS code FROM impact_rows)
    SELECT code, coalesce({_case('code', lca.STAGES)}, 'LCS_' || {SAFE('code')}) AS suffix, unnest(CASE WHEN code = 'A1-3' THEN ['A1', 'A2', 'A3'] ELSE [split_part(code, '.', 1)] END) AS stage FROM c""")
def stage_types(spark: SparkSession, sf: str) -> DataFrame:
    codes = table(spark, sf, "impact_rows").select(lca.stage_code(F.col("lcm_nest1_code"), F.col("lcm_code")).alias("code")).distinct()
    return codes.select("code", lca.stage_suffix(F.col("code")).alias("suffix"), F.explode(lca.stage_types(F.col("code"))).alias("stage"))


@R.add(f"""SELECT DISTINCT activity_type, techflow_unit, {_case('trim(activity_type)', lca.ACTIVITIES)} AS activity, {_case('lower(trim(techflow_unit))', lca.UNITS)} AS unit FROM impact_rows""")
def dictionary_maps(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "impact_rows").select("activity_type", "techflow_unit").distinct().withColumns({"activity": lca.activity(F.col("activity_type")), "unit": lca.unit(F.col("techflow_unit"))})


_SEG = "list_transform(string_split(worksection_name, '|'), lambda x: trim(x))"


@R.add(f"""WITH w AS (SELECT DISTINCT worksection_name FROM impact_rows WHERE worksection_name IS NOT NULL),
    s AS (SELECT worksection_name, {', '.join(f"coalesce({_SEG}[{i}], '') AS {n}" for i, n in enumerate(('context', 'function_segment', 'component_segment', 'material_segment'), 1))} FROM w)
    SELECT *, trim(regexp_replace(coalesce(nullif(material_segment, ''), nullif(component_segment, ''), nullif(function_segment, ''), nullif(context, ''), ''), '\\([^)]*\\)', '', 'g')) AS hint,
    coalesce({_case('lower(function_segment)', lca.SEGMENT_FUNCTIONS)}, CASE WHEN (contains(replace(lower(context), '-', ' '), 'loadbearing') OR contains(replace(lower(context), '-', ' '), 'load bearing')) AND lower(function_segment) IN ('', 'demolition', 'primary part', 'slab') THEN 'LoadBearing'
      WHEN contains(lower(worksection_name), 'thermal insulation') THEN 'Insulating' WHEN contains(lower(worksection_name), 'cladding') OR contains(lower(worksection_name), 'thick coating') THEN 'Finishing' WHEN contains(lower(worksection_name), 'infrastructure') THEN 'Infrastructure' END) AS fn FROM s""")  # fmt: skip
def worksection_segments(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "impact_rows").select("worksection_name").where("worksection_name IS NOT NULL").distinct()
    c = F.col("worksection_name")
    return w.select("worksection_name", lca.segments(c).alias("s"), lca.material_hint(c).alias("hint"), lca.segment_function(c).alias("fn")).select("worksection_name", "s.*", "hint", "fn")


@R.add(f"""WITH {IMPACT_SQL}, f AS (SELECT element_name, worksection_name, min(row_id) AS r FROM d WHERE element_name IS NOT NULL AND worksection_name IS NOT NULL GROUP BY ALL),
    l AS (SELECT element_name, list(worksection_name ORDER BY r) AS ws FROM f GROUP BY element_name), c AS (SELECT element_name, first(element_class_sfb_mmg ORDER BY row_id) AS sfb FROM d WHERE element_name IS NOT NULL GROUP BY element_name),
    t AS (SELECT c.element_name, sfb, lower(concat_ws(' ', c.element_name, coalesce(array_to_string(ws[1:3], ' '), ''), coalesce(sfb, ''))) AS w FROM c LEFT JOIN l USING (element_name))
    SELECT element_name, {SAFE('element_name')} AS safe, CASE WHEN {_like_any('w', ('roof', 'fr0', 'ceiling'))} OR coalesce(sfb, '') LIKE '27%' THEN 'Roof' WHEN {_like_any('w', ('slab', 'floor', 'if0', 'deck'))} OR coalesce(sfb, '') LIKE '23%' THEN 'Slab' ELSE 'Wall' END AS class FROM t""")  # fmt: skip
def element_classes(spark: SparkSession, sf: str) -> DataFrame:
    d = _impact(spark, sf).where(F.col("element_name").isNotNull())
    # the first three distinct work sections suffice; they are kept as a bounded list per element
    seen = impact.sequence_ids(d.where("worksection_name IS NOT NULL"), ["element_name"], "row_id", "worksection_name").where("no <= 3")
    ws = seen.groupBy("element_name").agg(F.transform(F.sort_array(F.collect_list(F.struct("no", "worksection_name"))), lambda x: x["worksection_name"]).alias("ws"))
    c = d.groupBy("element_name").agg(impact.first_by("element_class_sfb_mmg", "row_id").alias("sfb")).join(ws, "element_name", "left")
    empty = F.coalesce("ws", F.array().cast("array<string>"))
    return c.select("element_name", lca.safe_id(F.col("element_name")).alias("safe"), lca.element_class(F.col("element_name"), empty, F.col("sfb")).alias("class"))


# --- texts ----------------------------------------------------------------------------------------------------------

TEXTS_SQL = "s AS (SELECT unnest(renovation_states) AS s FROM tabula_floor_renovation), t AS (SELECT DISTINCT s.german AS de, s.english AS en FROM s WHERE s.english IS NOT NULL)"


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "tabula_floor_renovation").select(F.explode("renovation_states").alias("s"))
    return s.select(F.col("s.german").alias("de"), F.col("s.english").alias("en")).where("en IS NOT NULL").distinct()


def _chunk_sql() -> str:
    low = "low"
    rules = {n: f"CASE WHEN {_like_any(low, w)} THEN '{n}' END" for n, w in text.CHUNKS}
    names = [n for n, _ in text.CHUNKS]
    cut_ = lambda a, b: [rules[n] for n in names[names.index(a) : names.index(b) if b else None]]
    word = rf"regexp_matches({low}, '\b({text.INSULATED})\b')"
    parts = cut_("slab", "mineral wool") + [f"CASE WHEN {_like_any(low, ('normalbeton', 'normal concrete'))} THEN 'normal concrete' WHEN {_like_any(low, ('concrete', 'beton'))} THEN 'concrete' END"]
    parts += cut_("mineral wool", "brickwork") + [f"CASE WHEN {word} THEN 'thermal insulation' END"] + [f"CASE WHEN {word} AND {_like_any(low, w)} THEN '{n}' END" for n, w in text.INSULATION_PLACES]
    parts += cut_("brickwork", "glazing") + [rf"CASE WHEN regexp_matches({low}, '\bcork\b') THEN 'cork' END", rf"CASE WHEN regexp_matches({low}, '\bstraw\b') THEN 'straw plant fiber' END"] + cut_("glazing", None)
    parts += [rf"CASE WHEN regexp_matches({low}, '\bmulti[- ]?layer') OR {_like_any(low, ('mehrschichtig', 'dreischichtig', '3-layered'))} THEN 'multi layer' END", rf"CASE WHEN contains({low}, 'cavity wall') OR regexp_matches({low}, '\b(kellerwand|hohlraumwand)\b') THEN 'cavity wall' END"]
    thick = " || ".join(rf"list_transform(regexp_extract_all({low}, '\d+(?:,\d+)?\s*{u}'), lambda x: x || ' thickness')" for u in ("cm", "mm"))
    return f"""WITH {TEXTS_SQL}, c AS (SELECT de, en, trim(concat_ws(' ', nullif(de, ''), nullif(en, ''))) AS txt FROM t), l AS (SELECT de, en, txt, lower(txt) AS low FROM c WHERE txt <> ''),
        k AS (SELECT de, en, txt, list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL) || {thick} AS chunks FROM l)
        SELECT DISTINCT de, en, unnest(CASE WHEN len(chunks) = 0 THEN [txt] ELSE chunks END) AS chunk FROM k"""


@R.add(_chunk_sql())
def chunk_rules(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("de", "en", F.explode(text.decompose(F.col("de"), F.col("en"))).alias("chunk"))


@R.add(rf"""WITH {TEXTS_SQL} SELECT DISTINCT en, coalesce(TRY_CAST(replace(nullif(regexp_extract(en, '(?i)(\d+(?:[.,]\d+)?)\s*cm', 1), ''), ',', '.') AS DOUBLE), TRY_CAST(replace(nullif(regexp_extract(en, '(?i)(\d+(?:[.,]\d+)?)\s*mm', 1), ''), ',', '.') AS DOUBLE) / 10.0) AS cm FROM t""")
def thickness_extract(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("en").distinct().withColumn("cm", text.thickness_cm(F.col("en")))


@R.add(rf"""WITH {TEXTS_SQL} SELECT DISTINCT en, unnest(CASE WHEN NOT regexp_matches(lower(en), '\bbelow\b') AND NOT contains(lower(en), 'on top') AND NOT contains(lower(en), 'combination') THEN ['add']
    ELSE list_filter([CASE WHEN regexp_matches(lower(en), '\bbelow\b') THEN 'below' END, CASE WHEN contains(lower(en), 'on top') THEN 'top' END, CASE WHEN contains(lower(en), 'combination') THEN 'both' END], lambda x: x IS NOT NULL) END) AS kind FROM t""")
def placement_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("en").distinct().select("en", F.explode(text.placement_kinds(F.col("en"))).alias("kind"))


def _family(col: str) -> str:
    def has(f: str) -> str:
        return rf"regexp_matches({col}, '\b({text.WORDS[f]})\b')" + (f" OR contains({col}, 'holz')" if f == "wood" else "")

    return "CASE " + " ".join(f"WHEN {has(f)} THEN '{n}'" for f, n in text.MATERIAL_ORDER) + " END"


@R.add(f"""WITH x AS (SELECT DISTINCT english AS en, element_label AS label FROM tabula_floor_renovation WHERE english IS NOT NULL AND element_label IS NOT NULL), b AS (SELECT *, lower(en || ' ' || label) AS w, lower(label) AS l FROM x)
    SELECT en, label, {_family('w')} AS material, CASE {' '.join(f"WHEN contains(l, '{w}') THEN '{n}'" for w, n in text.ELEMENT_CLASSES)} ELSE 'BuiltElement' END AS element,
    CASE WHEN contains(l, 'window') OR (contains(w, 'fenster') AND NOT contains(l, 'door')) THEN 'Glazing' WHEN contains(l, 'door') OR regexp_matches(w, '\\b({text.WORDS['opening']})\\b') THEN 'Opening' WHEN regexp_matches(w, '\\b({text.WORDS['insulation']})\\b') THEN 'Insulating' WHEN {_like_any('w', ('cladding', 'verputz', 'coating'))} THEN 'Finishing' ELSE 'LoadBearing' END AS fn FROM b""")  # fmt: skip
def keyword_families(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "tabula_floor_renovation").select(F.col("english").alias("en"), F.col("element_label").alias("label")).dropna().distinct()
    en, label = F.col("en"), F.col("label")
    return x.withColumns({"material": text.material_family(en, label), "element": text.element_type(label), "fn": text.existing_function(en, label)})


@R.add("""WITH i AS (SELECT DISTINCT iri FROM vocabulary UNION SELECT DISTINCT unnest(layers).predicted_category_iri FROM material_alternatives), c AS (SELECT iri FROM i WHERE iri IS NOT NULL)
    SELECT iri, CASE WHEN contains(iri, '#') THEN split_part(iri, '#', len(string_split(iri, '#'))::INT) ELSE split_part(iri, '/', len(string_split(iri, '/'))::INT) END AS name,
    CASE WHEN starts_with(regexp_replace(trim(iri), '^[\\[\\]() <>]+|[\\[\\]() <>]+$', '', 'g'), 'http') THEN regexp_replace(trim(iri), '^[\\[\\]() <>]+|[\\[\\]() <>]+$', '', 'g') END AS clean FROM c""")
def iri_names(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "vocabulary").select("iri")
    b = table(spark, sf, "material_alternatives").select(F.explode("layers").alias("l")).select(F.col("l.predicted_category_iri").alias("iri"))
    i = a.union(b).where("iri IS NOT NULL").distinct()
    return i.select("iri", text.local_name(F.col("iri")).alias("name"), text.clean_iri(F.col("iri")).alias("clean"))


@R.add("""SELECT ref_id, regexp_replace(local_name, '([a-z])([A-Z])', '\\1 \\2', 'g') AS name FROM vocabulary""")
def camel_split(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "vocabulary").select("ref_id", text.camel_split(F.col("local_name")).alias("name"))


# --- graph ----------------------------------------------------------------------------------------------------------

EDGES_SQL = """e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'r0', 'n0')"""
CLOSURE_SQL = f"WITH RECURSIVE {EDGES_SQL}, k(child, ancestor) AS (SELECT child, child FROM e UNION SELECT parent, parent FROM e UNION SELECT k.child, e.parent FROM k JOIN e ON k.ancestor = e.child)"


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    tag = lambda t, c: F.concat(F.lit(t), F.col(c).cast("string"))
    n = table(spark, sf, "nation").select(tag("n", "n_nationkey").alias("child"), tag("r", "n_regionkey").alias("parent"))
    c = table(spark, sf, "customer").select(tag("c", "c_custkey").alias("child"), tag("n", "c_nationkey").alias("parent"))
    s = table(spark, sf, "supplier").select(tag("s", "s_suppkey").alias("child"), tag("n", "s_nationkey").alias("parent"))
    back = n.sparkSession.createDataFrame([("r0", "n0")], "child string, parent string")  # a cycle
    return n.union(c).union(s).union(back).distinct()


@R.add(CLOSURE_SQL + " SELECT child, ancestor FROM k")
def subclass_closure(spark: SparkSession, sf: str) -> DataFrame:
    return ontology.closure(_edges(spark, sf)).select("child", "ancestor")


@R.add(CLOSURE_SQL + " SELECT DISTINCT child AS iri FROM k WHERE ancestor = 'r1' AND child <> 'r1'")
def strict_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return ontology.strict_descendants(ontology.closure(_edges(spark, sf)), "r1")


@R.add(CLOSURE_SQL + " SELECT iri FROM (SELECT 'fixed' AS iri UNION SELECT child FROM k WHERE ancestor IN ('r1', 'r2')) WHERE iri NOT IN ('r1', 'r2')")
def vocabulary_sets(spark: SparkSession, sf: str) -> DataFrame:
    return ontology.vocabulary(["fixed"], ontology.closure(_edges(spark, sf)), ["r1", "r2"])


@R.add(CLOSURE_SQL + """, d AS (SELECT c AS child, a AS ancestor, min(depth) AS depth FROM (
      SELECT child AS c, child AS a, 0 AS depth FROM e UNION ALL SELECT parent, parent, 0 FROM e UNION ALL SELECT child, parent, 1 FROM e UNION ALL SELECT x.child, y.parent, 2 FROM e x JOIN e y ON x.parent = y.child
      UNION ALL SELECT x.child, z.parent, 3 FROM e x JOIN e y ON x.parent = y.child JOIN e z ON y.parent = z.child) GROUP BY ALL)
    SELECT child AS iri, arg_min(ancestor, (depth, ancestor)) AS anchor FROM d WHERE ancestor IN ('r0', 'r1', 'r2', 'n0', 'n5', 'n7') GROUP BY child""")
def nearest_anchor(spark: SparkSession, sf: str) -> DataFrame:
    anchors = spark.createDataFrame([(x,) for x in ("r0", "r1", "r2", "n0", "n5", "n7")], "iri string")
    return ontology.nearest_anchor(ontology.closure(_edges(spark, sf)), anchors)


PART_SQL = "pt AS (SELECT DISTINCT p_brand AS typ, p_type AS cat FROM part)"


@R.add(f"WITH {PART_SQL} SELECT cat AS category, string_agg(typ, ',' ORDER BY typ) AS types FROM pt GROUP BY cat")
def category_type_tree(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "part").select(F.col("p_brand").alias("child"), F.col("p_type").alias("parent")).distinct()
    cats, types = e.select(F.col("parent").alias("iri")).distinct(), e.select(F.col("child").alias("iri")).distinct()
    return ontology.category_tree(cats, types, ontology.closure(e)).select("category", F.array_join("types", ",").alias("types"))


_CT = "(SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 7 = 1 THEN p_brand WHEN p_partkey % 7 = 2 THEN 'fn' ELSE p_type END AS c0, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN p_type WHEN p_partkey % 5 = 2 THEN 'x' ELSE p_brand END AS t0 FROM part)"


@R.add(f"""WITH b AS (SELECT DISTINCT p_brand AS typ, p_type AS cat FROM part), an AS (SELECT typ AS iri, min(cat) AS anchor FROM b GROUP BY typ UNION ALL SELECT DISTINCT cat, cat FROM b),
    s1 AS (SELECT id, CASE WHEN c0 <> 'fn' THEN c0 END AS c, CASE WHEN t0 <> 'fn' THEN t0 END AS t FROM {_CT}),
    s2 AS (SELECT id, CASE WHEN c IS NOT NULL AND c NOT IN (SELECT cat FROM b) THEN a.anchor ELSE c END AS c2, CASE WHEN c IS NOT NULL AND c NOT IN (SELECT cat FROM b) AND t IS NULL THEN c ELSE t END AS t2 FROM s1 LEFT JOIN an a ON a.iri = s1.c),
    s3 AS (SELECT id, coalesce(c2, a.anchor) AS c3, t2 AS t3, a.anchor AS ta, (t2 IN (SELECT cat FROM b)) AS is_anchor FROM s2 LEFT JOIN an a ON a.iri = s2.t2),
    s4 AS (SELECT s3.*, (b.typ IS NOT NULL OR c3 = t3) AS under FROM s3 LEFT JOIN b ON b.typ = t3 AND b.cat = c3)
    SELECT id, CASE WHEN c3 IS NOT NULL AND t3 IS NOT NULL AND t3 <> c3 AND NOT is_anchor AND NOT under AND ta IS NOT NULL AND ta <> t3 THEN ta ELSE c3 END AS cat,
      CASE WHEN c3 IS NOT NULL AND t3 IS NOT NULL AND t3 <> c3 AND NOT is_anchor AND (under OR (ta IS NOT NULL AND ta <> t3)) THEN t3 END AS typ FROM s4""")  # fmt: skip
def resolve_category_type(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    e = p.select(F.col("p_brand").alias("child"), F.col("p_type").alias("parent")).distinct()
    closed = ontology.closure(e)
    cats = e.select(F.col("parent").alias("iri")).distinct()
    anchors = ontology.nearest_anchor(closed, cats)
    k = F.col("p_partkey")
    rows = p.select(k.alias("id"), F.expr("CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 7 = 1 THEN p_brand WHEN p_partkey % 7 = 2 THEN 'fn' ELSE p_type END").alias("cat"), F.expr("CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN p_type WHEN p_partkey % 5 = 2 THEN 'x' ELSE p_brand END").alias("typ"))
    fns = spark.createDataFrame([("fn",)], "iri string")
    return ontology.resolve_pair(rows, anchors, fns, e.select(F.col("child").alias("iri")).distinct(), closed)


TRIPLES_SQL = """g AS (SELECT 'n' || n_nationkey AS s, 'inRegion' AS p, 'r' || n_regionkey AS o FROM nation UNION SELECT 'n' || n_nationkey, 'name', n_name FROM nation UNION SELECT 'c' || c_custkey, 'inNation', 'n' || c_nationkey FROM customer
    UNION SELECT 'c' || c_custkey, 'segment', c_mktsegment FROM customer UNION SELECT 's' || s_suppkey, 'inNation', 'n' || s_nationkey FROM supplier UNION SELECT 'r' || r_regionkey, 'name', r_name FROM region)"""


def _graph(spark: SparkSession, sf: str) -> DataFrame:
    tag = lambda t, c: F.concat(F.lit(t), F.col(c).cast("string"))
    n, c, s, r = (table(spark, sf, x) for x in ("nation", "customer", "supplier", "region"))
    nk, ck = tag("n", "n_nationkey"), tag("c", "c_custkey")
    return triples.union(
        triples.explode_triples(n, F.array(triples.triple(nk, "inRegion", tag("r", "n_regionkey")), triples.triple(nk, "name", F.col("n_name"), "literal"))),
        triples.explode_triples(c, F.array(triples.triple(ck, "inNation", tag("n", "c_nationkey")), triples.triple(ck, "segment", F.col("c_mktsegment"), "literal"))),
        triples.make(s, tag("s", "s_suppkey"), "inNation", tag("n", "s_nationkey")),
        triples.make(r, tag("r", "r_regionkey"), "name", F.col("r_name"), "literal"),
    )


@R.add(f"WITH {TRIPLES_SQL} SELECT s, p, o FROM g")
def star_triples(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf).select("s", "p", "o")


@R.add(f"WITH {TRIPLES_SQL} SELECT a.s, a.o AS segment, b.o AS nation, c.o AS region, d.o AS name FROM g a JOIN g b ON a.s = b.s AND b.p = 'inNation' LEFT JOIN g c ON c.s = b.o AND c.p = 'inRegion' LEFT JOIN g d ON d.s = c.o AND d.p = 'name' WHERE a.p = 'segment'")
def triple_pattern_chain(spark: SparkSession, sf: str) -> DataFrame:
    g = _graph(spark, sf)
    start = triples.subject_objects(g, "segment").select(F.col("o").alias("segment"), "s")
    return triples.path(g, start, [("inNation", "nation", "inner"), ("inRegion", "region", "left"), ("name", "name", "left")]).select("s", "segment", "nation", "region", "name")


@R.add(f"WITH {TRIPLES_SQL} SELECT p, count(*) AS n, count(DISTINCT s) AS subjects, min(o) AS first FROM g GROUP BY p")
def triple_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf).groupBy("p").agg(F.count("*").alias("n"), F.countDistinct("s").alias("subjects"), F.min("o").alias("first"))


@R.add(f"""WITH {TRIPLES_SQL}, t AS (SELECT s, '<' || p || '> ' || CASE WHEN p IN ('name', 'segment') THEN '"' || o || '"' ELSE '<' || o || '>' END AS po FROM g)
    SELECT s, '<' || s || '> ' || string_agg(po, ' ;' || chr(10) || '    ' ORDER BY po) || ' .' AS value FROM t GROUP BY s""")
def turtle_statements(spark: SparkSession, sf: str) -> DataFrame:
    return turtle.turtle_lines(_graph(spark, sf))


@R.add("""SELECT iri AS entity, CASE WHEN label_de < label_en THEN label_de || ' | ' || label_en WHEN label_de = label_en THEN label_en ELSE label_en || ' | ' || label_de END AS text FROM vocabulary""")
def text_profiles(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "vocabulary")
    g = triples.union(triples.make(v, F.col("iri"), triples.LABEL, F.col("label_en"), "literal", "en"), triples.make(v, F.col("iri"), triples.LABEL, F.col("label_de"), "literal", "de"), triples.make(v, F.col("iri"), triples.LABEL, F.upper("label_de"), "literal", "fr"))
    return ontology.profiles(g, triples.LABEL, triples.COMMENT, triples.SUBCLASS).select("entity", "text")


@R.add(f"""WITH {EDGES_SQL}, b AS (SELECT child AS a, parent AS z FROM e UNION SELECT parent, child FROM e), h1 AS (SELECT DISTINCT z FROM b WHERE a = 's1'), h2 AS (SELECT DISTINCT b.z FROM h1 JOIN b ON b.a = h1.z)
    SELECT node, min(hops) AS hops FROM (SELECT 's1' AS node, 0 AS hops UNION ALL SELECT z, 1 FROM h1 UNION ALL SELECT z, 2 FROM h2) GROUP BY node""")
def khop_neighbourhood(spark: SparkSession, sf: str) -> DataFrame:
    e = _edges(spark, sf).select(F.col("child").alias("src"), F.col("parent").alias("dst"))
    return triples.neighbourhood(e, spark.createDataFrame([("s1",)], "node string"), 2)


@R.add(f"WITH {EDGES_SQL} SELECT child AS src, parent AS dst, 'sub' AS rel FROM e UNION ALL SELECT parent, child, 'rev_sub' FROM e")
def undirected_edges(spark: SparkSession, sf: str) -> DataFrame:
    return triples.reverse_edges(_edges(spark, sf).select(F.col("child").alias("src"), F.col("parent").alias("dst"), F.lit("sub").alias("rel")))
