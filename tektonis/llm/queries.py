"""Queries of the text operators over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tektonis.llm import canon, leaks, mixing, scans, sentences
from tektonis.llm.terms import SYNONYMS
from tektonis.sources import table


def _typed_values(spark: SparkSession, sf: str) -> DataFrame:
    """(src, row_id, node, kind, value) of every freely entered value; redelivered rows count once."""
    floors = table(spark, sf, "tabula_floor_renovation")
    english = floors.where(F.col("english").isNotNull()).select(F.lit("english").alias("src"), F.col("case_id").alias("row_id"), F.lit("").alias("node"), F.lit("construction").alias("kind"), F.col("english").alias("value"))
    a = floors.select("case_id", F.posexplode("renovation_states").alias("i", "state"))
    b = a.select("case_id", "i", F.posexplode("state.layer_sets").alias("j", "set"))
    c = b.select("case_id", "i", "j", F.posexplode("set.layers").alias("k", "layer"))
    node = F.concat_ws("/", *[(F.col(x) + 1).cast("string") for x in "ijk"])
    category = c.select(F.lit("category").alias("src"), F.col("case_id").alias("row_id"), node.alias("node"), F.lit("category").alias("kind"), F.col("layer.predicted_category_iri").alias("value"))
    sets = table(spark, sf, "material_alternatives").select("set_id", F.posexplode("layers").alias("k", "layer"))
    function = sets.select(F.lit("function").alias("src"), F.col("set_id").alias("row_id"), (F.col("k") + 1).cast("string").alias("node"), F.lit("function").alias("kind"), F.col("layer.predicted_function_iri").alias("value"))
    iris = table(spark, sf, "vocabulary").select(F.col("iri").alias("value")).where(F.col("value").isNotNull()).distinct()
    # the anti join's right side is the reference list
    coded = category.unionByName(function).where(F.col("value").isNotNull() & F.col("value").rlike(r"\S")).join(iris, "value", "left_anti")
    return english.unionByName(coded.select(*english.columns)).distinct()


def trade_synonyms(spark: SparkSession) -> DataFrame:
    """(kind, local_name, name): the thesaurus of the building trade."""
    return spark.createDataFrame([(kind, local, name) for (kind, local), names in SYNONYMS.items() for name in names], "kind string, local_name string, name string")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    got = canon.map_to_reference(_typed_values(spark, sf), table(spark, sf, "vocabulary"), synonyms=trade_synonyms(spark))
    return got.select("src", "row_id", "node", "ref_id")


def p1_without_thesaurus(spark: SparkSession, sf: str) -> DataFrame:
    """The same by the entries' own names alone."""
    got = canon.map_to_reference(_typed_values(spark, sf), table(spark, sf, "vocabulary"))
    return got.select("src", "row_id", "node", "ref_id")


def p1_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """The values that no entry is meant by, with the number of their places."""
    got = canon.map_to_reference(_typed_values(spark, sf), table(spark, sf, "vocabulary"), synonyms=trade_synonyms(spark))
    return got.where("ref_id = 0").groupBy("src", "value").agg(F.count("*").alias("places"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return scans.repair(table(spark, sf, "page_boxes"))


def p3_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """The repaired texts, as continuous paragraphs."""
    return scans.paragraphs(table(spark, sf, "page_boxes"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = mixing.with_token_counts(table(spark, sf, "documents"), "doc_id", "text", keep=("source",))
    return mixing.mix(docs, table(spark, sf, "mix_targets"))


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The selected documents with the number of their copies."""
    return _mixed(spark, sf)[0].select("doc_id", "source", "n_tokens", "copies")


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The shares reached, in tokens."""
    got = _mixed(spark, sf)[1]
    return got.select("source", "target_share", "max_repeat", "documents", "selected", F.round("share", 6).alias("share"))


def p7_mix_chars(spark: SparkSession, sf: str) -> DataFrame:
    """The same selection with sizes in characters, which SQL can count too."""
    docs = table(spark, sf, "documents").where(F.col("text").isNotNull())
    return mixing.mix(docs, table(spark, sf, "mix_targets"), size="n_chars")[0].select("doc_id", "source", "n_chars", "copies")


def p7_shares_chars(spark: SparkSession, sf: str) -> DataFrame:
    """The shares that p7_mix_chars reaches."""
    docs = table(spark, sf, "documents").where(F.col("text").isNotNull())
    return mixing.mix(docs, table(spark, sf, "mix_targets"), size="n_chars")[1].select("source", F.round("share", 6).alias("share"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.split_documents(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_without_thesaurus, p1_unmatched, p3_found, p3_paragraphs, p6_found, p7_mix, p7_shares, p7_mix_chars, p7_shares_chars, p8_found)}

SQL = {
    "p7_shares_chars": """
        WITH d AS (SELECT doc_id, source, n_chars, CAST('0x' || substr(md5('mix' || CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) AS rnd
                   FROM documents WHERE text IS NOT NULL AND n_chars > 0 AND source IN (SELECT source FROM mix_targets)),
        s AS (SELECT source, CAST(sum(n_chars) AS DOUBLE) AS size FROM d GROUP BY source),
        q AS (SELECT source, size, max_repeat, target_share / sum(target_share) OVER () AS share FROM mix_targets JOIN s USING (source) WHERE target_share > 0),
        b AS (SELECT source, size, CAST(floor(least(min(size * max_repeat / share) OVER () * share + 1e-6, size * max_repeat)) AS BIGINT) AS budget FROM q),
        e AS (SELECT source, CAST(floor(budget / size) AS BIGINT) AS epochs, budget - CAST(floor(budget / size) AS BIGINT) * CAST(size AS BIGINT) AS rest FROM b),
        p AS (SELECT doc_id, source, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY rnd, doc_id ROWS UNBOUNDED PRECEDING) AS place FROM d),
        r AS (SELECT source, n_chars * (epochs + CASE WHEN place <= rest THEN 1 ELSE 0 END) AS n, epochs + CASE WHEN place <= rest THEN 1 ELSE 0 END AS c FROM p JOIN e USING (source)),
        g AS (SELECT source, CAST(sum(n) AS DOUBLE) AS got FROM r WHERE c > 0 GROUP BY source)
        SELECT t.source, round(coalesce(got, 0) / (SELECT sum(got) FROM g), 6) AS share FROM mix_targets t LEFT JOIN g USING (source)""",
    "p7_mix_chars": """
        WITH d AS (SELECT doc_id, source, n_chars, CAST('0x' || substr(md5('mix' || CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) AS rnd
                   FROM documents WHERE text IS NOT NULL AND n_chars > 0 AND source IN (SELECT source FROM mix_targets)),
        s AS (SELECT source, CAST(sum(n_chars) AS DOUBLE) AS size FROM d GROUP BY source),
        q AS (SELECT source, size, max_repeat, target_share / sum(target_share) OVER () AS share FROM mix_targets JOIN s USING (source) WHERE target_share > 0),
        b AS (SELECT source, size, CAST(floor(least(min(size * max_repeat / share) OVER () * share + 1e-6, size * max_repeat)) AS BIGINT) AS budget FROM q),
        e AS (SELECT source, CAST(floor(budget / size) AS BIGINT) AS epochs, budget - CAST(floor(budget / size) AS BIGINT) * CAST(size AS BIGINT) AS rest FROM b),
        p AS (SELECT doc_id, source, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY rnd, doc_id ROWS UNBOUNDED PRECEDING) AS place FROM d),
        r AS (SELECT doc_id, source, n_chars, epochs + CASE WHEN place <= rest THEN 1 ELSE 0 END AS copies FROM p JOIN e USING (source))
        SELECT doc_id, source, n_chars, copies FROM r WHERE copies > 0""",
}
