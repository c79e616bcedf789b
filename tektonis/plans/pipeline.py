"""Queries of the pipeline from descriptions to layer sets, and of renovation states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tektonis.functions import layout as lines
from tektonis.functions import text
from tektonis.operators import compose, emit, mapper, triples
from tektonis.plans.composition import CUE_PAIRS, vocabulary_levels
from tektonis.plans.registry import Registry
from tektonis.sources import table

R = Registry()
BRANCH = {"function": "layer_function", "category": "material", "material": "material", "construction": "layerset"}


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    branch = F.try_element_at(F.create_map(*[F.lit(x) for kv in BRANCH.items() for x in kv]), F.col("kind"))
    return table(spark, sf, "vocabulary").select(F.col("local_name").alias("item"), branch.alias("branch"), F.concat_ws(" ", "label_en", "label_de").alias("text"))


def _described(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "tabula_floor_renovation").select(F.col("english").alias("id"), F.col("english").alias("text")).where("id IS NOT NULL AND trim(id) <> ''").distinct()


@R.add()
def description_matches(spark: SparkSession, sf: str) -> DataFrame:
    return mapper.matches(_described(spark, sf), _corpus(spark, sf), "tabula")


@R.add()
def described_layer_sets(spark: SparkSession, sf: str) -> DataFrame:
    known = vocabulary_levels(spark, sf, CUE_PAIRS)
    words = spark.createDataFrame([(x,) for x in sorted({f for _, f in mapper.WORD_FUNCTIONS} | {compose.LOAD_BEARING})], "iri string")
    known.functions = known.functions.union(words).distinct()
    got = mapper.process(_described(spark, sf), _corpus(spark, sf), "tabula", vocabulary=known)
    return got.select("id", "pos", "topology", compose.summary(F.col("layers")).alias("summary"))


@R.add("""WITH d AS (SELECT DISTINCT case_id, renovation_states FROM tabula_floor_renovation), s AS (SELECT case_id, unnest(renovation_states) AS s, generate_subscripts(renovation_states, 1) AS i FROM d),
    l AS (SELECT case_id, i, unnest(s.layer_sets[1].layers) AS l, generate_subscripts(s.layer_sets[1].layers, 1) AS k FROM s), n AS (SELECT case_id, i, k, l.predicted_function_iri AS fn, l.predicted_category_iri AS cat, l.predicted_type_iri AS typ, l.thickness_cm AS cm FROM l),
    e AS (SELECT case_id, fn, cat, typ, cm, min(k) AS k FROM n WHERE i = 1 GROUP BY ALL)
    SELECT n.case_id, n.i, n.k, 'case_' || n.case_id || CASE WHEN e.k IS NOT NULL THEN '_state_1_layer_' || e.k ELSE '_state_' || n.i || '_layer_' || n.k END AS uri, e.k IS NOT NULL AND n.i > 1 AS reused
    FROM n LEFT JOIN e ON e.case_id = n.case_id AND e.fn IS NOT DISTINCT FROM n.fn AND e.cat IS NOT DISTINCT FROM n.cat AND e.typ IS NOT DISTINCT FROM n.typ AND e.cm IS NOT DISTINCT FROM n.cm""")
def renovation_layer_uris(spark: SparkSession, sf: str) -> DataFrame:
    """Names of the layers of every set (j) of every state: a layer equal to one of the first state keeps that one's name. SQL reads the first set alone."""
    sets = compose.renovation_sets(table(spark, sf, "tabula_floor_renovation"))
    l = sets.select("case_id", "i", "j", F.posexplode("layers").alias("q", "l"))  # noqa: E741
    n = l.select("case_id", "i", "j", (F.col("q") + 1).cast("bigint").alias("k"), compose.layer_identity(F.col("l")).alias("x")).select("case_id", "i", "j", "k", "x.*")
    e = n.where("i = 1").groupBy("case_id", "fn", "cat", "typ", "cm").agg(F.min(F.struct("j", "k")).alias("e"))
    e = e.select(F.col("case_id").alias("c"), *[F.col(x).alias("_" + x) for x in ("fn", "cat", "typ", "cm")], "e")
    same = F.col("case_id") == F.col("c")
    for x in ("fn", "cat", "typ", "cm"):
        same = same & F.col(x).eqNullSafe(F.col("_" + x))
    m = n.join(e, same, "left")
    known = F.col("e").isNotNull()
    place = lambda i, j, k: F.concat(F.lit("_state_"), i.cast("string"), F.lit("_set_"), j.cast("string"), F.lit("_layer_"), k.cast("string"))
    uri = F.concat(F.lit("case_"), F.col("case_id").cast("string"), F.when(known, place(F.lit(1), F.col("e.j"), F.col("e.k"))).otherwise(place(F.col("i"), F.col("j"), F.col("k"))))
    return m.select("case_id", "i", "j", "k", uri.alias("uri"), (known & (F.col("i") > 1)).alias("reused"))


@R.add("""WITH b AS (SELECT DISTINCT box_id, building_id, section_title, page_header FROM page_boxes), v AS (SELECT 'https://data.example/' AS d, 'https://vocab.example/bm#' AS n)
    SELECT DISTINCT d || building_id AS s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, n || 'Building' AS o FROM b, v WHERE building_id IS NOT NULL UNION SELECT d || building_id, n || 'describedBy', d || 'box_' || box_id FROM b, v WHERE building_id IS NOT NULL
    UNION SELECT d || 'box_' || box_id, n || 'title', section_title FROM b, v WHERE section_title IS NOT NULL UNION SELECT d || 'box_' || box_id, n || 'series', page_header.main_section.title FROM b, v WHERE page_header.main_section.title IS NOT NULL""")
def page_triples(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "page_boxes").select("box_id", "building_id", "section_title", "page_header.main_section.title").distinct()
    building, box = F.concat(F.lit(emit.BASE), "building_id"), F.concat(F.lit(emit.BASE + "box_"), F.col("box_id").cast("string"))
    rows = [triples.triple(building, triples.RDF_TYPE, F.when(building.isNotNull(), F.lit(emit.NS + "Building"))), triples.triple(building, emit.NS + "describedBy", F.when(building.isNotNull(), box)), triples.triple(box, emit.NS + "title", F.col("section_title"), "literal"), triples.triple(box, emit.NS + "series", F.col("title"), "literal")]
    return triples.explode_triples(b, F.array(*rows)).select("s", "p", "o")


@R.add("""WITH b AS (SELECT DISTINCT box_id, properties FROM page_boxes), u AS (SELECT unnest(map_values(properties)) AS v FROM b), l AS (SELECT DISTINCT unnest(string_split(v, chr(10))) AS line FROM u WHERE v IS NOT NULL)
    SELECT line, CASE WHEN regexp_matches(trim(line, ' '), '^[\\-–\\[(]*\\s*[0-9SsiIl|Oo]{1,3}\\s*[\\-–\\])]*$') THEN 'page'
      WHEN regexp_matches(line, '^\\s*([0-9SsiIl|Oo]{1,2}(?:\\.[0-9SsiIl|Oo]{1,2}){0,2})\\.?\\s+(\\p{Lu}.*)$') AND regexp_matches(translate(regexp_extract(line, '^\\s*([0-9SsiIl|Oo]{1,2}(?:\\.[0-9SsiIl|Oo]{1,2}){0,2})\\.?\\s+(\\p{Lu}.*)$', 1), 'SsiIl|Oo', '55111100'), '^\\d+(\\.\\d+)*$') THEN 'section'
      WHEN regexp_matches(line, '^\\p{Lu}[^:]{0,39}:') THEN 'key' ELSE 'text' END AS kind FROM l WHERE line IS NOT NULL""")
def line_kinds(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "page_boxes").select(F.explode("properties").alias("k", "v")).where("v IS NOT NULL").select("v").distinct()
    return v.select(F.explode(F.split("v", "\n")).alias("line")).distinct().withColumn("kind", lines.line_kind(F.col("line")))


@R.add("""WITH i AS (SELECT DISTINCT iri, local_name, kind FROM vocabulary) SELECT kind AS parent, kind || ': ' || string_agg(DISTINCT local_name, ', ' ORDER BY local_name) AS line FROM i GROUP BY kind""")
def hierarchy_listing(spark: SparkSession, sf: str) -> DataFrame:
    return mapper.hierarchy_listing(table(spark, sf, "vocabulary").select(F.col("kind").alias("parent"), F.col("local_name").alias("child")))


@R.add("""WITH t AS (SELECT DISTINCT english AS en FROM tabula_floor_renovation WHERE english IS NOT NULL) SELECT en, CASE WHEN length(en) <= 8 THEN '****' ELSE left(en, 4) || '...' || right(en, 4) END AS masked, regexp_replace(regexp_replace(trim(en), '(?i)^```(json)?\\s*', ''), '\\s*```$', '') AS bare FROM t""")
def masked_texts(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "tabula_floor_renovation").select(F.col("english").alias("en")).where("en IS NOT NULL").distinct()
    return t.select("en", text.mask_secret(F.col("en")).alias("masked"), text.strip_fences(F.col("en")).alias("bare"))
