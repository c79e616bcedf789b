"""Queries of scans and sinks, candidate flags, edges, reports, scores and samples, with DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tektonis.functions import layout as lines
from tektonis.functions import lca, text
from tektonis.operators import compose, emit, features, layout, mapper, retrieval, triples, validate
from tektonis.plans.composition import FUNCTIONS, LAYERS_SQL, TRIPLES_SQL, _composition, _flat, _sets, range_audit, validity_pct
from tektonis.plans.pipeline import renovation_layer_uris
from tektonis.plans.reference import SAFE
from tektonis.plans.registry import Registry
from tektonis.runtime import ensure_checkpoint_dir
from tektonis.sources import files, sinks, table, turtle

R = Registry()
NS = emit.NS


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{ensure_checkpoint_dir(spark)}/written-{uuid.uuid4().hex}"


# --- scans and sinks: written, then read again ----------------------------------------------------------------------


@R.add("SELECT DISTINCT row_id, element_name, techflow_amount FROM impact_rows WHERE element_name IS NOT NULL")
def csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    at = _folder(spark)
    table(spark, sf, "impact_rows").select("row_id", "element_name", "techflow_amount").distinct().write.csv(at, header=True)
    return files.read_csv(spark, at, "row_id bigint, element_name string, techflow_amount double", ["element_name"])


@R.add("SELECT kind, ref_id, local_name FROM vocabulary")
def json_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Files of JSON, one with its records in an object and the others bare arrays."""
    at = _folder(spark)
    v = table(spark, sf, "vocabulary").groupBy("kind").agg(F.to_json(F.collect_list(F.struct("ref_id", "local_name", "kind"))).alias("items"))  # the reference list
    v.select("kind", F.when(F.col("kind") == "category", F.concat(F.lit('{"items": '), "items", F.lit("}"))).otherwise(F.col("items")).alias("value")).write.partitionBy("kind").text(at)
    got = files.read_json_records(spark, [f"{at}/*/*.txt"], "items").withColumn("v", F.try_parse_json("record"))
    return got.select(F.try_variant_get("v", "$.kind", "string").alias("kind"), F.try_variant_get("v", "$.ref_id", "bigint").alias("ref_id"), F.try_variant_get("v", "$.local_name", "string").alias("local_name"))


@R.add(f"""SELECT iri AS s, '{triples.LABEL}' AS p, label_en AS o, 'literal' AS o_kind, 'en' AS o_lang FROM vocabulary WHERE label_en IS NOT NULL UNION SELECT iri, '{triples.LABEL}', label_de, 'literal', 'de' FROM vocabulary WHERE label_de IS NOT NULL
    UNION SELECT iri, '{triples.SUBCLASS}', '{NS}' || kind, 'iri', NULL FROM vocabulary""")
def turtle_scan(spark: SparkSession, sf: str) -> DataFrame:
    at, v = _folder(spark), table(spark, sf, "vocabulary")
    label = lambda c, lang: triples.make(v.where(F.col(c).isNotNull()), F.col("iri"), triples.LABEL, F.col(c), "literal", lang)
    turtle.write_turtle(triples.union(label("label_en", "en"), label("label_de", "de"), triples.make(v, F.col("iri"), triples.SUBCLASS, F.concat(F.lit(NS), "kind"))), at)
    return turtle.read_turtle(spark, [at]).select("s", "p", "o", "o_kind", "o_lang")


@R.add("SELECT DISTINCT 'https://data.example/doc/' || doc_id AS s, text AS o FROM documents WHERE text IS NOT NULL")
def ntriples_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts, with all their quotes, backslashes and line ends, as literals of N-Triples."""
    at = _folder(spark)
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    turtle.write_turtle(triples.make(d, F.concat(F.lit("https://data.example/doc/"), F.col("doc_id").cast("string")), f"{NS}text", F.col("text"), "literal"), at)
    return turtle.read_ntriples(spark, at).select("s", "o")


@R.add('SELECT count(*) AS "rows", CAST(sum(ref_id) AS BIGINT) AS total, count(DISTINCT kind) AS kinds FROM vocabulary')
def report_totals(spark: SparkSession, sf: str) -> DataFrame:
    at = _folder(spark)
    sinks.write_report(table(spark, sf, "vocabulary"), at, {"total": F.sum("ref_id"), "kinds": F.countDistinct("kind")})
    return spark.read.json(f"{at}/totals").select("rows", "total", "kinds")


@R.add("SELECT DISTINCT set_id, thickness_cm, CAST(len(layers) AS BIGINT) AS layers FROM material_alternatives WHERE layers IS NOT NULL")
def payload_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Layer sets written as a set, a list of sets and an object with sets, read as one form."""
    d = table(spark, sf, "material_alternatives").where("layers IS NOT NULL").select("set_id", "thickness_cm", "layers").distinct()
    one = F.to_json(F.struct("thickness_cm", "layers"))
    raw = F.when(F.col("set_id") % 3 == 0, one).when(F.col("set_id") % 3 == 1, F.concat(F.lit("["), one, F.lit("]"))).otherwise(F.concat(F.lit('{"layer_sets": ['), one, F.lit("]}")))
    p = d.select("set_id", F.explode(compose.normalise_payload(raw)["layer_sets"]).alias("s"))
    return p.select("set_id", "s.thickness_cm", F.size("s.layers").cast("bigint").alias("layers"))


# --- descriptions ---------------------------------------------------------------------------------------------------

_STATES = "d AS (SELECT DISTINCT case_id, building_id, element_label, renovation_states FROM tabula_floor_renovation), s AS (SELECT case_id, building_id, element_label, unnest(renovation_states) AS s FROM d)"


@R.add(f"""WITH {_STATES} SELECT 'Building_' || {SAFE('building_id')} || '_Layer_' || {SAFE('element_label')} || '_' || s.id AS subject, s.german AS german, s.english AS english FROM s WHERE length(trim(coalesce(s.german, '') || coalesce(s.english, ''))) > 0""")
def stage_description_rows(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "tabula_floor_renovation").select("case_id", "building_id", "element_label", "renovation_states").distinct()
    s = d.select("building_id", "element_label", F.explode("renovation_states").alias("s")).select("building_id", "element_label", "s.id", "s.german", "s.english")
    return files.stage_descriptions(s, "building_id", "element_label", "id", "german", "english").select("subject", "german", "english")


@R.add("SELECT DISTINCT printf('E%02d_L%02d', row_id, row_id) AS subject, worksection_name AS english FROM impact_rows WHERE worksection_name IS NOT NULL")
def worksection_description_rows(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "impact_rows").select("row_id", "worksection_name").distinct().withColumn("layer", F.col("row_id"))
    return files.worksection_descriptions(d, "worksection_name", "row_id", "layer").select("subject", "english")


@R.add("WITH v AS (SELECT DISTINCT worksection_name FROM impact_rows WHERE worksection_name IS NOT NULL), a AS (SELECT worksection_name, upper(trim(worksection_name)) || '/' || length(worksection_name) AS axioms FROM v) SELECT DISTINCT i.row_id, i.worksection_name, a.axioms FROM impact_rows i LEFT JOIN a USING (worksection_name)")
def memo_join(spark: SparkSession, sf: str) -> DataFrame:
    """What is derived from a work section is derived once for each distinct one."""
    d = table(spark, sf, "impact_rows").select("row_id", "worksection_name").distinct()
    derive = lambda v: v.select("worksection_name", F.concat(F.upper(F.trim("worksection_name")), F.lit("/"), F.length("worksection_name").cast("string")).alias("axioms"))
    return mapper.distinct_apply(d, "worksection_name", "axioms", derive).select("row_id", "worksection_name", "axioms")


@R.add("""WITH v AS (SELECT ref_id, string_split(label_de, ' ') AS d, string_split(label_en, ' ') AS e FROM vocabulary WHERE label_de IS NOT NULL AND label_en IS NOT NULL), i AS (SELECT *, unnest(range(1, len(d) + 1)) AS i FROM v)
    SELECT ref_id, d[i] AS de, CASE WHEN len(d) = len(e) THEN e[i] ELSE d[i] END AS en, CAST(i AS INT) AS place FROM i""")
def zipped_variants(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "vocabulary").where("label_de IS NOT NULL AND label_en IS NOT NULL")
    z = v.select("ref_id", F.posexplode(mapper.zip_variants(F.split("label_de", " "), F.split("label_en", " "))).alias("i", "z"))
    return z.select("ref_id", "z.de", "z.en", (F.col("i") + 1).alias("place"))


@R.add("""WITH t AS (SELECT DISTINCT layer_set_description || ' (' || CAST(CAST(thickness_cm AS INT) AS VARCHAR) || ' mm)' AS t FROM material_alternatives WHERE layer_set_description IS NOT NULL AND thickness_cm IS NOT NULL),
    p AS (SELECT t, regexp_replace(regexp_extract(t, '(?i)\\([^)]*?(\\d+(?:\\s*-\\s*\\d+)?)\\s*(mm|cm)\\)', 1), ' ', '', 'g') AS v, lower(regexp_extract(t, '(?i)\\([^)]*?(\\d+(?:\\s*-\\s*\\d+)?)\\s*(mm|cm)\\)', 2)) AS u FROM t)
    SELECT t, v AS value_text, TRY_CAST(v AS DOUBLE) AS value, CASE WHEN u = 'mm' THEN 'MilliM' ELSE 'CentiM' END AS unit FROM p WHERE v <> ''""")
def bracketed_thicknesses(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "material_alternatives").where("layer_set_description IS NOT NULL AND thickness_cm IS NOT NULL")
    t = d.select(F.concat("layer_set_description", F.lit(" ("), F.rint("thickness_cm").cast("int").cast("string"), F.lit(" mm)")).alias("t")).distinct()
    return t.select("t", lca.bracketed_thickness(F.col("t")).alias("b")).where("b IS NOT NULL").select("t", "b.value_text", "b.value", "b.unit")


_TYPE = "CASE " + " ".join(f"WHEN contains(lower(element_name), '{w}') THEN '{n}'" for w, n in text.ELEMENT_CLASSES) + " ELSE 'BuiltElement' END"


@R.add(f"""WITH e AS (SELECT DISTINCT element_name FROM impact_rows WHERE element_name IS NOT NULL)
    SELECT element_name, {_TYPE} AS type, {_TYPE} IN ('Door', 'Window') AS opening, CASE WHEN contains(lower(element_name), 'window') THEN 'Glazing' WHEN contains(lower(element_name), 'door') THEN 'Opening' END AS fn FROM e""")
def element_openings(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "impact_rows").select("element_name").where("element_name IS NOT NULL").distinct()
    c = F.col("element_name")
    return e.select(c, text.element_type(c).alias("type"), text.is_opening(c).alias("opening"), text.opening_function(c).alias("fn"))


@R.add("""SELECT DISTINCT box_id, trim(concat_ws(' ', page_header.main_section.section, page_header.main_section.title, CASE WHEN printed_page IS NOT NULL THEN '... ' || printed_page END)) AS label FROM page_boxes""")
def contents_labels(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "page_boxes")
    return b.select("box_id", lines.contents_label(F.col("page_header.main_section.section"), F.col("page_header.main_section.title"), F.col("printed_page")).alias("label")).distinct()


@R.add("""WITH b AS (SELECT DISTINCT box_id, printed_page, page_no, box_no FROM page_boxes) SELECT box_id, coalesce(CASE WHEN box_no = 1 THEN page_no END, printed_page) AS printed_page FROM b""")
def patched_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Printed pages, corrected by the page's own number where a correction is given: here for the first box of each page."""
    b = table(spark, sf, "page_boxes").select("box_id", "printed_page", "page_no", "box_no").distinct()
    fix = b.where("box_no = 1").select("box_id", F.col("page_no").alias("printed_page"))
    return layout.patch(b.select("box_id", "printed_page"), fix, ["box_id"], ["printed_page"])


# --- vocabulary and candidates --------------------------------------------------------------------------------------


@R.add("""SELECT local_name AS item, kind = 'function' AND local_name <> 'AirSpace' AS is_function, kind = 'construction' AS is_topology, kind = 'category' AS is_category, kind = 'material' AS is_type FROM vocabulary""")
def candidate_branches(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "vocabulary")
    of = lambda kind: v.where(F.col("kind") == kind).select(F.col("local_name").alias("iri"))
    return mapper.candidate_flags(v.select(F.col("local_name").alias("item")), of("function"), of("construction"), of("category"), of("material"), "AirSpace")


@R.add("""WITH d AS (SELECT local_name AS property, string_agg(label_en, ', ' ORDER BY label_en) AS d FROM vocabulary WHERE kind <> 'material' AND label_en IS NOT NULL GROUP BY 1), r AS (SELECT local_name AS property, string_agg(label_de, ', ' ORDER BY label_de) AS r FROM vocabulary WHERE kind <> 'function' AND label_de IS NOT NULL GROUP BY 1)
    SELECT property, property || ': ' || coalesce(d, '—') || ' -> ' || coalesce(r, '—') AS line FROM d FULL JOIN r USING (property)""")
def axiom_lines(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "vocabulary")
    g = triples.union(
        triples.make(v.where("kind <> 'material' AND label_en IS NOT NULL"), F.col("local_name"), "domain", F.col("label_en")),
        triples.make(v.where("kind <> 'function' AND label_de IS NOT NULL"), F.col("local_name"), "range", F.col("label_de")),
    )
    return mapper.axiom_listing(g, "domain", "range")


@R.add("SELECT iri, trim(concat_ws(' ', least(label_en, label_de), greatest(label_en, label_de))) AS text FROM vocabulary WHERE kind = 'category'")
def taxonomy_lines(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "vocabulary")
    label = lambda c: triples.make(v.where(F.col(c).isNotNull()), F.col("iri"), triples.LABEL, F.col(c), "literal")
    return triples.taxonomy_index(triples.union(label("label_en"), label("label_de"), triples.make(v, F.col("iri"), triples.SUBCLASS, F.col("kind"))), "category")


@R.add("SELECT ref_id, NOT coalesce(kind = 'category' AND contains(label_de, 'stein'), false) AS hidden FROM vocabulary")
def highlighted_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return triples.highlight(table(spark, sf, "vocabulary"), (F.col("kind") == "category") & F.contains("label_de", F.lit("stein"))).select("ref_id", "hidden")


@R.add("""SELECT kind AS id, string_agg('b ' || local_name || ' score=' || printf('%.3f', ref_id / 1000.0), chr(10) ORDER BY ref_id DESC) AS context FROM vocabulary GROUP BY kind""")
def match_lines(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "vocabulary").select(F.col("kind").alias("id"), F.lit("b").alias("branch"), F.col("local_name").alias("item"), (F.col("ref_id") / 1000.0).alias("score"))
    return mapper.context_text(v)


@R.add("""WITH v AS (SELECT ref_id, lower(coalesce(label_de, '') || ' ' || lower(local_name)) AS h, list_distinct(string_split(lower(label_en), ' ')) AS t FROM vocabulary WHERE label_en IS NOT NULL), n AS (SELECT ref_id, len(list_filter(t, lambda x: length(x) > 0 AND contains(h, x))) AS n FROM v)
    SELECT ref_id, CASE WHEN n > 0 THEN round(0.5 + 0.1 * n, 6) END AS score FROM n""")
def overlap_scores(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "vocabulary").where("label_en IS NOT NULL")
    hint = F.concat(F.coalesce("label_de", F.lit("")), F.lit(" "), F.lower("local_name"))
    return v.select("ref_id", F.round(retrieval.overlap_score(hint, F.split(F.lower("label_en"), " ")), 6).alias("score"))


# --- layer sets -----------------------------------------------------------------------------------------------------


@R.add(f"WITH {LAYERS_SQL} SELECT set_id, CAST(i AS INT) AS layer_index, CASE WHEN cat IN (SELECT local_name FROM vocabulary WHERE kind = 'category') THEN cat END AS cat FROM n")
def whitelisted_categories(spark: SparkSession, sf: str) -> DataFrame:
    allowed = table(spark, sf, "vocabulary").where("kind = 'category'").agg(F.collect_set("local_name").alias("allowed"))  # one row: the reference list
    d = _flat(_sets(spark, sf)).crossJoin(F.broadcast(allowed))
    return d.select("set_id", "layer_index", compose.whitelist(F.col("cat"), F.col("allowed")).alias("cat"))


@R.add(f"WITH {LAYERS_SQL} SELECT set_id, CAST(i AS INT) AS layer_index, cat, CASE WHEN typ IN ('HollowPot', 'StoneWoolSlab', 'ZincSheet') THEN typ END AS typ FROM n")
def attested_types(spark: SparkSession, sf: str) -> DataFrame:
    named = F.array(*map(F.lit, ("HollowPot", "StoneWoolSlab", "ZincSheet")))
    return _flat(_sets(spark, sf).withColumn("layers", compose.drop_unattested(F.col("layers"), named))).select("set_id", "layer_index", "cat", "typ")


@R.add("""WITH d AS (SELECT DISTINCT set_id, regexp_extract(layer_topology, '[^#/]*$') AS t FROM material_alternatives) SELECT set_id, CASE WHEN t IS NULL OR t = '' THEN 'SingleLayer' WHEN t IN ('SingleLayer', 'MultiLayer') THEN t END AS topology FROM d""")
def resolved_topologies(spark: SparkSession, sf: str) -> DataFrame:
    from tektonis.operators.ontology import resolve_member

    d = table(spark, sf, "material_alternatives").select("set_id", F.regexp_extract("layer_topology", "[^#/]*$", 0).alias("t")).distinct()
    return d.select("set_id", resolve_member(F.col("t"), ["SingleLayer", "MultiLayer"], "SingleLayer").alias("topology"))


@R.add(f"WITH {TRIPLES_SQL} SELECT DISTINCT s AS src, o AS dst FROM g WHERE p = '{NS}hasLayer'")
def layer_edges(spark: SparkSession, sf: str) -> DataFrame:
    g = _composition(spark, sf)
    ends = lambda cls: triples.match(g, p=triples.RDF_TYPE, o=NS + cls).select(F.col("s").alias("iri"), F.col("s").alias("id")).distinct()
    return triples.edges_between(g, ends("LayerSet"), ends("Layer"))


_FILES = f"""{LAYERS_SQL}, o AS (SELECT DISTINCT set_id, element_no AS path FROM material_alternatives WHERE element_no IS NOT NULL), f AS (SELECT path, n.* FROM o JOIN n USING (set_id))"""


@R.add(f"""WITH {_FILES}, a AS (SELECT path, count_if(cat IS NOT NULL AND cat NOT IN (SELECT local_name FROM vocabulary WHERE kind = 'category')) AS issues, count_if(fn IS NULL) AS violations, count_if(cm IS NULL) AS warnings FROM f GROUP BY path)
    SELECT DISTINCT o.path, coalesce(issues, 0) AS issues, coalesce(violations, 0) AS violations, coalesce(warnings, 0) AS warnings, coalesce(violations, 0) = 0 AS conforms FROM o LEFT JOIN a USING (path)""")
def element_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The audit of each element's layers: unknown categories, layers without function, layers without thickness."""
    owner = table(spark, sf, "material_alternatives").where("element_no IS NOT NULL").select("set_id", F.col("element_no").alias("path")).distinct()
    f = owner.join(_flat(_sets(spark, sf)), "set_id")
    known = table(spark, sf, "vocabulary").where("kind = 'category'").select(F.col("local_name").alias("cat")).distinct()
    shapes = f.where("fn IS NULL").select("path", F.lit("violation").alias("severity")).unionByName(f.where("thickness_cm IS NULL").select("path", F.lit("warning").alias("severity")))
    return validate.file_audit(f.where("cat IS NOT NULL").join(known, "cat", "left_anti"), shapes, owner)


@R.add(f"""WITH {_FILES}, p AS (SELECT path AS id, count(DISTINCT set_id) AS n FROM f GROUP BY path), g AS (SELECT path AS id, count(DISTINCT set_id) AS n FROM f WHERE cat IS NOT NULL GROUP BY path)
    SELECT DISTINCT o.path AS id, CASE WHEN g.n IS NULL THEN 100.0 WHEN p.n IS NULL THEN NULL WHEN p.n = g.n THEN 100.0 ELSE 0.0 END AS score FROM o LEFT JOIN p ON p.id = o.path LEFT JOIN g ON g.id = o.path""")
def gold_scores(spark: SparkSession, sf: str) -> DataFrame:
    owner = table(spark, sf, "material_alternatives").where("element_no IS NOT NULL").select("set_id", F.col("element_no").alias("id")).distinct()
    f = owner.join(_flat(_sets(spark, sf)), "set_id")
    made = lambda d: d.groupBy("id").agg(F.countDistinct("set_id").cast("string").alias("signature"))
    return validate.gold_score(owner, made(f), made(f.where("cat IS NOT NULL")))


_CARD = f"""{TRIPLES_SQL}, l AS (SELECT DISTINCT s FROM g WHERE o = '{NS}Layer'), c AS (SELECT l.s, count(DISTINCT f.o) AS nf, count(DISTINCT h.o) AS nh FROM l LEFT JOIN g f ON f.s = l.s AND f.p = '{NS}hasFunction' LEFT JOIN g h ON h.s = l.s AND h.p = '{NS}hasThickness' GROUP BY l.s),
    m AS (SELECT 'violation' AS severity, s AS focus, '{NS}hasFunction: ' || nf || ' values' AS message FROM c WHERE nf <> 1 UNION ALL SELECT 'warning', s, '{NS}hasThickness: ' || nh || ' values' FROM c WHERE nh < 1)"""


def _results(spark: SparkSession, sf: str) -> DataFrame:
    g = _composition(spark, sf)
    return validate.cardinality(g, NS + "Layer", NS + "hasFunction", 1, 1).unionByName(validate.cardinality(g, NS + "Layer", NS + "hasThickness", 1, None, "warning"))


@R.add(f"WITH {_CARD} SELECT severity, count(*) AS n FROM m GROUP BY severity")
def severity_counts(spark: SparkSession, sf: str) -> DataFrame:
    return validate.frequencies(_results(spark, sf), "severity")


@R.add(f"WITH {_CARD} SELECT severity, focus, message FROM m ORDER BY severity <> 'violation', focus, message LIMIT 50")
def report_head(spark: SparkSession, sf: str) -> DataFrame:
    """The first fifty results of a report, violations first."""
    return validate.ordered_report(_results(spark, sf)).limit(50)


@R.add("""WITH c AS (SELECT ref_id, CASE WHEN kind = 'function' THEN 'warning' WHEN kind = 'category' THEN 'violation' WHEN kind = 'material' THEN 'info' END AS r, CASE WHEN contains(label_de, 'e') THEN 'warning' ELSE 'violation' END AS k FROM vocabulary)
    SELECT ref_id, CASE WHEN r = 'warning' OR k = 'warning' THEN 'warning' ELSE coalesce(r, 'violation') END AS severity FROM c""")
def severities(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("kind")
    r = F.when(kind == "function", "warning").when(kind == "category", "violation").when(kind == "material", "info")
    k = F.when(F.contains("label_de", F.lit("e")), "warning").otherwise("violation")
    return table(spark, sf, "vocabulary").select("ref_id", validate.severity_of(r, k).alias("severity"))


# --- twins that read the whole tables -------------------------------------------------------------------------------

_WHOLE = """d AS (SELECT DISTINCT case_id, renovation_states FROM tabula_floor_renovation), s AS (SELECT case_id, unnest(renovation_states) AS s, generate_subscripts(renovation_states, 1) AS i FROM d),
    t AS (SELECT case_id, i, unnest(s.layer_sets) AS t, generate_subscripts(s.layer_sets, 1) AS j FROM s), l AS (SELECT case_id, i, j, unnest(t.layers) AS l, generate_subscripts(t.layers, 1) AS k FROM t),
    n AS (SELECT case_id, i, j, k, l.predicted_function_iri AS fn, l.predicted_category_iri AS cat, l.predicted_type_iri AS typ, l.thickness_cm AS cm FROM l)"""


@R.add(f"""WITH {_WHOLE}, e AS (SELECT case_id, fn, cat, typ, cm, min(j * 1000000 + k) AS jk FROM n WHERE i = 1 GROUP BY ALL)
    SELECT n.case_id, n.i, n.j, n.k, 'case_' || n.case_id || CASE WHEN jk IS NOT NULL THEN '_state_1_set_' || (jk // 1000000) || '_layer_' || (jk % 1000000) ELSE '_state_' || n.i || '_set_' || n.j || '_layer_' || n.k END AS uri, jk IS NOT NULL AND n.i > 1 AS reused
    FROM n LEFT JOIN e ON e.case_id = n.case_id AND e.fn IS NOT DISTINCT FROM n.fn AND e.cat IS NOT DISTINCT FROM n.cat AND e.typ IS NOT DISTINCT FROM n.typ AND e.cm IS NOT DISTINCT FROM n.cm""")
def layer_uris_of_all_sets(spark: SparkSession, sf: str) -> DataFrame:
    """renovation_layer_uris against SQL that reads every set."""
    return renovation_layer_uris(spark, sf)


@R.add(f"""WITH {_WHOLE}, x AS (SELECT n.*, EXISTS (SELECT 1 FROM n b WHERE b.case_id = n.case_id AND b.i = 1 AND b.fn IS NOT DISTINCT FROM n.fn AND b.cat IS NOT DISTINCT FROM n.cat AND b.typ IS NOT DISTINCT FROM n.typ AND b.cm IS NOT DISTINCT FROM n.cm) AS kept FROM n),
    c AS (SELECT case_id, i, j, count_if(kept) AS reused, count_if(NOT kept) AS added FROM x GROUP BY ALL)
    SELECT s.case_id, CAST(s.i AS BIGINT) AS i, s.s.id AS state, CAST(t.j AS BIGINT) AS j, t.t.kind AS kind, coalesce(reused, 0) AS reused, coalesce(added, 0) AS added FROM s LEFT JOIN t ON t.case_id = s.case_id AND t.i = s.i LEFT JOIN c ON c.case_id = t.case_id AND c.i = t.i AND c.j = t.j""")
def reuse_of_all_sets(spark: SparkSession, sf: str) -> DataFrame:
    """renovation_reuse against SQL that reads every set."""
    from tektonis.plans.composition import renovation_reuse

    return renovation_reuse(spark, sf)


_FN_NAMES = "SELECT local_name AS o FROM vocabulary WHERE kind = 'function' UNION SELECT CASE local_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FUNCTIONS.items()) + " ELSE local_name END FROM vocabulary WHERE kind = 'function'"


@R.add(f"""WITH {TRIPLES_SQL}, fns AS ({_FN_NAMES}), cats AS (SELECT local_name AS o FROM vocabulary WHERE kind = 'category'), tys AS (SELECT local_name AS o FROM vocabulary WHERE kind = 'material'),
    i AS (SELECT 'function_range' AS kind, s, o FROM g WHERE p = '{NS}hasFunction' AND o NOT IN (SELECT o FROM fns) UNION ALL SELECT 'category_range', s, o FROM g WHERE p = '{NS}hasCategory' AND o NOT IN (SELECT o FROM cats)
      UNION ALL SELECT 'type_orphan', s, o FROM g WHERE p = '{NS}hasType' AND o NOT IN (SELECT o FROM cats) AND o IN (SELECT o FROM tys) UNION ALL SELECT 'type_invalid', s, o FROM g WHERE p = '{NS}hasType' AND o NOT IN (SELECT o FROM cats) AND o NOT IN (SELECT o FROM tys))
    SELECT kind, count(*) AS n, count(DISTINCT o) AS objects, min(s) AS first FROM i GROUP BY kind""")  # fmt: skip
def audit_of_all_names(spark: SparkSession, sf: str) -> DataFrame:
    """range_audit against SQL that knows the whole vocabulary."""
    return range_audit(spark, sf)


@R.add(f"""WITH {LAYERS_SQL}, b AS (SELECT set_id, count(cat) AS slots, count_if(cat IS NOT NULL AND cat NOT IN (SELECT local_name FROM vocabulary)) AS bad FROM n GROUP BY set_id)
    SELECT set_id, slots, bad, CASE WHEN slots = 0 THEN CASE WHEN bad = 0 THEN 100.0 ELSE 0.0 END ELSE greatest(0.0, round_even(100.0 * (1 - bad / slots), 1)) END AS validity FROM b""")
def validity_by_all_names(spark: SparkSession, sf: str) -> DataFrame:
    """validity_pct against SQL that knows the whole vocabulary."""
    return validity_pct(spark, sf)


# --- learning -------------------------------------------------------------------------------------------------------

_EDGES = "e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem), k AS (SELECT s_suppkey AS node, row_number() OVER (ORDER BY s_suppkey) - 1 AS no FROM supplier), c AS (SELECT count(*) AS n FROM k)"
_NEGATIVE = f"""{_EDGES}, r AS (SELECT DISTINCT src, k.node AS dst FROM e, c JOIN k ON k.no = CAST('0x' || substr(md5('neg' || src || '|' || dst || '|0'), 1, 8) AS BIGINT) % c.n), x AS (SELECT src, dst FROM r EXCEPT SELECT src, dst FROM e)"""


def _links(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    edges = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    return edges, features.negative_edges(edges, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node")))


@R.add(f"WITH {_NEGATIVE} SELECT src, dst FROM x")
def negative_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _links(spark, sf)[1]


@R.add(f"""WITH {_NEGATIVE}, a AS (SELECT (src * 7 + dst * 3) % 11 / 11.0 AS score, 1 AS label FROM e UNION ALL SELECT (src * 7 + dst * 3) % 11 / 11.0, 0 FROM x)
    SELECT round(avg(CASE WHEN label = 1 THEN ln(1 + exp(-score)) ELSE ln(1 + exp(score)) END), 6) AS loss, count(*) AS n FROM a""")
def link_loss(spark: SparkSession, sf: str) -> DataFrame:
    edges, negative = _links(spark, sf)
    both = edges.withColumn("label", F.lit(1)).unionByName(negative.withColumn("label", F.lit(0)))
    got = features.link_loss(both.withColumn("score", (F.col("src") * 7 + F.col("dst") * 3) % 11 / F.lit(11.0)), "score", "label")
    return got.select(F.round("loss", 6).alias("loss"), "n")


QUERIES = R.queries
