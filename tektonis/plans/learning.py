"""Queries of retrieval, page layout and learning features, with DuckDB twins where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tektonis.functions import layout as lines
from tektonis.functions import text
from tektonis.operators import features, impact, layout, matching, ontology, retrieval, validate
from tektonis.plans.registry import Registry
from tektonis.sources import table

R = Registry()

# --- retrieval: queries are the vectors whose id is divisible by 50, against all vectors ------------------------------

COS_SQL = """q AS (SELECT vec_id AS query_id, embedding AS e, label AS ql FROM embeddings WHERE vec_id % 50 = 0), c AS (SELECT vec_id AS item_id, embedding AS e, label FROM embeddings),
    m AS (SELECT query_id, item_id, label, round(list_cosine_similarity(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])), 6) AS score FROM q CROSS JOIN c WHERE query_id <> item_id)"""


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "embeddings")
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), "label")


def _top(spark: SparkSession, sf: str, k: int, branch: bool) -> DataFrame:
    """The k best other vectors, of each label or of all."""
    q, c = _vectors(spark, sf)
    got = retrieval.top_matches(q, c, k + 1, branch="label" if branch else None).where("query_id <> item_id")
    w = Window.partitionBy("query_id", "branch").orderBy(F.desc("score"), "item_id")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@R.add(f"WITH {COS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM m) SELECT query_id, item_id, score, rank FROM r WHERE rank <= 10")
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf, 10, False).select("query_id", "item_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@R.add(f"WITH {COS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, item_id) AS rank FROM m) SELECT query_id, CAST(label AS VARCHAR) AS branch, item_id, score, rank FROM r WHERE rank <= 3")
def top3_per_branch(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf, 3, True).select("query_id", "branch", "item_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@R.add(f"WITH {COS_SQL}, b AS (SELECT query_id, arg_min(item_id, (-score, item_id)) AS i, max(score) AS score FROM m GROUP BY query_id) SELECT query_id, CASE WHEN score > 0.3 THEN CAST(i AS VARCHAR) ELSE 'none' END AS item, score FROM b")
def argmax_match(spark: SparkSession, sf: str) -> DataFrame:
    got = _top(spark, sf, 1, False)
    return retrieval.best_match(got, threshold=0.3, fallback="none").withColumn("score", F.round("score", 6))


@R.add(f"WITH {COS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM m) SELECT query_id, round(avg(score), 5) AS mean_score FROM r WHERE rank <= 3 GROUP BY query_id")
def mean_top3_score(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.mean_top3(_top(spark, sf, 5, False)).withColumn("mean_score", F.round("mean_score", 5))


@R.add(f"""WITH {COS_SQL}, k AS (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, item_id) AS rank, label FROM m), p AS (SELECT * FROM k WHERE rank <= 20),
    b AS (SELECT query_id, arg_min(label, (-score, label)) AS category, max(score) AS cat_score FROM (SELECT query_id, label, max(score) AS score FROM p GROUP BY ALL) GROUP BY query_id),
    x AS (SELECT p.query_id, item_id, score FROM p JOIN b USING (query_id) WHERE (cat_score >= 0.25 AND label = category) OR (cat_score < 0.25 AND score >= 0.25)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM x) SELECT query_id, item_id, score, rank FROM r WHERE rank <= 8""")
def hierarchical_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    m = _top(spark, sf, 20, True).withColumn("score", F.round("score", 6))
    cats = m.groupBy("query_id", F.col("branch").cast("int").alias("item_id")).agg(F.max("score").alias("score"))
    members = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").alias("category"))
    got = retrieval.hierarchical(cats, m.select("query_id", "item_id", "score"), members, 0.25, 8)
    return got.select("query_id", "item_id", "score", F.col("rank").cast("bigint").alias("rank"))


@R.add("""WITH p AS (SELECT a.vec_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS n, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS l, list_cosine_similarity(CAST(b.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS f
      FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1 LEFT JOIN embeddings c ON c.vec_id = a.vec_id + 2)
    SELECT vec_id, round(greatest(coalesce(n, 0), 0.7 * coalesce(l, n, 0) + 0.3 * coalesce(f, l, n, 0)), 6) AS score FROM p""")
def best_of_name_label_full(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    shift = lambda n, name: e.select((F.col("vec_id") - n).alias("vec_id"), F.col("embedding").alias(name))
    x = e.join(shift(1, "b"), "vec_id", "left").join(shift(2, "c"), "vec_id", "left")
    cos = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), retrieval.cosine(F.col(a), F.col(b)))
    return x.select("vec_id", F.round(retrieval.item_score(cos("embedding", "b"), cos("embedding", "c"), cos("b", "c")), 6).alias("score"))


@R.add("""WITH t AS (SELECT unnest(['red', 'ring', 'wood', 'clt']) AS token, unnest(['Red', 'Ring', 'WoodTimber', 'WoodTimber']) AS item), h AS (SELECT p_partkey AS query_id, lower(p_name || CASE WHEN p_partkey % 3 = 0 THEN ' wood' ELSE '' END) AS hint FROM part),
    m AS (SELECT p_partkey AS query_id, CASE WHEN p_partkey % 2 = 0 THEN 'Red' ELSE 'Other' END AS item, 0.5 AS score FROM part) SELECT query_id, item, score FROM m UNION ALL SELECT DISTINCT h.query_id, t.item, 0.95 FROM h JOIN t ON contains(h.hint, t.token) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.query_id = h.query_id AND m.item = t.item)""")
def keyword_boost(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    rules = spark.createDataFrame([("red", "Red"), ("ring", "Ring"), ("wood", "WoodTimber"), ("clt", "WoodTimber")], "token string, item string")
    hints = p.select(F.col("p_partkey").alias("query_id"), F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " wood").otherwise("")).alias("hint"))
    m = p.select(F.col("p_partkey").alias("query_id"), F.when(F.col("p_partkey") % 2 == 0, "Red").otherwise("Other").alias("item"), F.lit(0.5).alias("score"))
    return retrieval.boost(hints, m, rules)


@R.add(f"WITH {COS_SQL}, b AS (SELECT query_id, label AS item, max(score) AS score FROM m GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM b) SELECT query_id, item, score, rank FROM r WHERE rank <= 4")
def dedupe_and_limit(spark: SparkSession, sf: str) -> DataFrame:
    m = _top(spark, sf, 3, True).select("query_id", F.col("branch").cast("int").alias("item"), F.round("score", 6).alias("score"))
    return retrieval.dedupe_limit(m, "query_id", "item", 4).withColumn("rank", F.col("rank").cast("bigint"))


@R.add()
def text_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of the vocabulary nearest to each other by the offline encoder."""
    v = table(spark, sf, "vocabulary").select("ref_id", retrieval.embed("label_en").alias("vector"))
    got = retrieval.top_matches(v.withColumnRenamed("ref_id", "query_id"), v.withColumnRenamed("ref_id", "item_id"), 2)
    return got.select("query_id", "item_id", "score", "rank")


@R.add("""WITH s AS (SELECT label AS source, vec_id, round(embedding[1] + 0.5, 3) AS cosine, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE 90.5 END AS validity, CASE WHEN vec_id % 5 = 0 THEN 100.0 END AS gold FROM embeddings),
    c AS (SELECT *, CASE WHEN gold IS NOT NULL THEN gold WHEN cosine IS NOT NULL AND validity IS NOT NULL THEN round_even(validity * cosine, 1) END AS composite FROM s)
    SELECT source, count(*) AS n, round(avg(coalesce(cosine, 0)) * 100, 3) AS cosine_pct, round(avg(validity), 3) AS validity, round(avg(composite), 2) AS composite FROM c GROUP BY source""")
def source_means(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    cos = F.round(F.element_at("embedding", 1) + F.lit(0.5).cast("float"), 3).cast("double")
    s = e.select(F.col("label").alias("source"), cos.alias("cosine"), F.expr("CASE WHEN vec_id % 3 = 0 THEN NULL ELSE 90.5D END").alias("validity"), F.expr("CASE WHEN vec_id % 5 = 0 THEN 100.0D END").alias("gold"))
    s = s.withColumn("composite", text.composite_score(F.col("cosine"), F.col("validity"), F.col("gold")))
    return s.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("cosine", F.lit(0.0))) * 100, 3).alias("cosine_pct"), F.round(F.avg("validity"), 3).alias("validity"), F.round(F.avg("composite"), 2).alias("composite"))


# --- layout ---------------------------------------------------------------------------------------------------------

BOX_SQL = "b AS (SELECT DISTINCT box_id, scan_id, page_no, printed_page, properties FROM page_boxes), v AS (SELECT box_id, unnest(map_keys(properties)) AS prop, unnest(map_values(properties)) AS value FROM b)"


def _values(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "page_boxes").select("box_id", F.explode("properties").alias("prop", "value")).distinct()
    return b.where("value IS NOT NULL")


@R.add(f"WITH {BOX_SQL}, l AS (SELECT box_id, prop, unnest(string_split(value, chr(10))) AS line FROM v WHERE value IS NOT NULL), w AS (SELECT box_id, count(*) AS lines, sum(len(list_filter(string_split(trim(line), ' '), lambda x: x <> ''))) AS words FROM l WHERE trim(line) <> '' GROUP BY box_id) SELECT box_id, lines, CAST(words AS BIGINT) AS words FROM w")
def page_line_counts(spark: SparkSession, sf: str) -> DataFrame:
    v = _values(spark, sf).select("box_id", F.explode(lines.clean_lines(F.col("value"))).alias("line"))
    n = F.size(F.filter(F.split("line", " "), lambda x: x != ""))
    return v.groupBy("box_id").agg(F.count("*").alias("lines"), F.sum(n).cast("bigint").alias("words"))


@R.add(f"WITH {BOX_SQL} SELECT DISTINCT prop, regexp_replace(replace(replace(replace(replace(lower(prop), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[^a-z0-9]+', '', 'g') AS key, translate(prop, 'SsiIl|Oo', '55111100') AS digits FROM v")
def property_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _values(spark, sf).select("prop").distinct().select("prop", lines.lookup_key(F.col("prop")).alias("key"), lines.digits(F.col("prop")).alias("digits"))


@R.add(f"""WITH {BOX_SQL}, t AS (SELECT DISTINCT value, lower(value) AS l FROM v WHERE value IS NOT NULL)
    SELECT value, nullif(regexp_extract(value, '(?i)(\\d+(?:[.,]\\d+)?\\s*(?:mm|cm|m))\\b', 1), '') AS thickness, CASE WHEN contains(l, 'hohl') THEN 'hollow' WHEN contains(l, 'voll') THEN 'solid' WHEN contains(l, 'rippe') THEN 'ribbed' END AS construction,
    CASE WHEN contains(l, 'stahlbeton') THEN 'reinforced concrete' WHEN contains(l, 'beton') THEN 'concrete' WHEN contains(l, 'holz') THEN 'wood' WHEN contains(l, 'ziegel') THEN 'brick' END AS material,
    json_extract_string(CASE WHEN json_valid(value) THEN value END, '$.dicke') AS dicke FROM t""")
def slab_properties(spark: SparkSession, sf: str) -> DataFrame:
    v = _values(spark, sf).select("value").distinct()
    return v.select("value", lines.slab(F.col("value")).alias("s"), F.get_json_object("value", "$.dicke").alias("dicke")).select("value", "s.thickness", "s.construction", "s.material", "dicke")


@R.add("""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, trim(unnest(ls), ' ') AS line FROM d),
    k AS (SELECT doc_id, i, CASE WHEN regexp_matches(line, '^[A-Za-z ]{1,30}:') THEN trim(split_part(line, ':', 1), ' ') END AS k, CASE WHEN regexp_matches(line, '^[A-Za-z ]{1,30}:') THEN trim(substr(line, strpos(line, ':') + 1), ' ') ELSE line END AS v FROM l),
    n AS (SELECT *, count(k) OVER (PARTITION BY doc_id ORDER BY i) AS no FROM k), g AS (SELECT doc_id, no, min(k) AS key, string_agg(v, ' ' ORDER BY i) FILTER (v <> '') AS value FROM n WHERE no > 0 GROUP BY doc_id, no)
    SELECT doc_id, no, key, coalesce(value, '') AS value FROM g""")
def carry_forward_kv(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "raw"))
    line, has = F.trim("raw"), F.rlike(F.trim("raw"), F.lit("^[A-Za-z ]{1,30}:"))
    kv = lines.key_value(line)
    x = d.select("doc_id", "i", F.when(has, kv["key"]).alias("k"), F.when(has, kv["value"]).otherwise(line).alias("v"))
    return layout.carry_forward(x, "doc_id", "i", "k", "v")


@R.add(f"""WITH {BOX_SQL}, p AS (SELECT DISTINCT scan_id, page_no, max(page_no) OVER (PARTITION BY scan_id) AS last FROM b WHERE page_no % 5 = 0) SELECT scan_id, page_no, coalesce(lead(page_no) OVER (PARTITION BY scan_id ORDER BY page_no) - 1, last) AS end_page FROM p""")
def section_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Sections begin where the page header's main section or the section's title changes, and end before the next one or on the scan's last page. SQL takes every fifth page for a start."""
    main, title = F.col("page_header.main_section"), F.col("section_title")
    b = table(spark, sf, "page_boxes").select("scan_id", "page_no", "box_no", "box_id", F.when(F.coalesce(main["section"], main["title"]).isNotNull(), main).alias("main"), F.when(F.trim(title) != "", title).alias("title"))
    p = layout.section_starts(b, "scan_id", "page_no", ["box_no", "box_id"], ["main", "title"])
    return layout.section_ranges(p, "scan_id", "page_no", "last").select("scan_id", "page_no", "end_page")


@R.add(f"""WITH {BOX_SQL}, p AS (SELECT scan_id, page_no, max(CASE WHEN page_no % 3 = 0 THEN NULL ELSE printed_page END) AS printed FROM b GROUP BY ALL), g AS (SELECT *, CASE WHEN page_no - lag(page_no) OVER w = 1 THEN 0 ELSE 1 END AS gap FROM p WINDOW w AS (PARTITION BY scan_id ORDER BY page_no)),
    r AS (SELECT *, sum(gap) OVER (PARTITION BY scan_id ORDER BY page_no) AS run FROM g), k AS (SELECT *, last_value(CASE WHEN printed IS NOT NULL THEN printed - page_no END IGNORE NULLS) OVER (PARTITION BY scan_id, run ORDER BY page_no) AS shift FROM r)
    SELECT scan_id, page_no, printed, coalesce(printed, shift + page_no) AS filled FROM k""")
def fill_missing_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Printed page numbers, filled where none was read. SQL blanks those of every third page first."""
    b = table(spark, sf, "page_boxes").groupBy("scan_id", "page_no").agg(F.max("printed_page").alias("printed"))
    return layout.fill_missing_pages(b, "scan_id", "page_no", "printed")


@R.add("""WITH w AS (SELECT user_id, CAST(event_id % 40 AS INT) AS y, event_id, event_type FROM events) SELECT user_id, y, string_agg(event_type, ' ' ORDER BY event_id, event_type) AS line, min(event_id) AS "left", count(*) AS n_words FROM w GROUP BY user_id, y""")
def lines_from_words(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "events").select("user_id", (F.col("event_id") % 40).cast("int").alias("y"), "event_id", "event_type")
    return layout.lines_from_words(w, ["user_id", "y"], "event_id", "event_type")


@R.add()
def group_words_to_rows(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "events").select(F.col("user_id").alias("page_id"), (F.col("event_id") % 97).cast("int").alias("x"), (F.col("value") * 3).cast("int").alias("y"), F.col("event_type").alias("text"))
    return layout.group_rows(w, 10)


@R.add()
def repaired_numbers(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("place"), (F.col("event_id") % 7).alias("number"))
    return layout.repair_numbers(e, "user_id", "place", "number")


@R.add("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, translate(CAST(json_extract(props, '$.k') AS VARCHAR), 'SsiIl|Oo', '55111100') AS digits FROM events")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf, "events").select("event_id", k.alias("k"), lines.digits(k.cast("string")).alias("digits"))


# --- features -------------------------------------------------------------------------------------------------------


@R.add("SELECT p_partkey, p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS brand_id FROM part")
def label_encode(spark: SparkSession, sf: str) -> DataFrame:
    return ontology.encode(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", "brand_id").select("p_partkey", "p_brand", "brand_id")


@R.add("SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS price, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS size FROM part")
def standard_scale(spark: SparkSession, sf: str) -> DataFrame:
    got = features.standard_scale(table(spark, sf, "part"), ["p_retailprice", "p_size"])
    return got.select("p_partkey", F.round("p_retailprice_scaled", 6).alias("price"), F.round("p_size_scaled", 6).alias("size"))


@R.add("WITH d AS (SELECT DISTINCT row_id, indicator_gwp FROM impact_rows) SELECT row_id, round(log10(greatest(indicator_gwp, 1e-6)), 6) AS target FROM d WHERE indicator_gwp IS NOT NULL AND indicator_gwp <> 0")
def log_target(spark: SparkSession, sf: str) -> DataFrame:
    d = features.usable_targets(table(spark, sf, "impact_rows").select("row_id", "indicator_gwp").distinct(), "indicator_gwp")
    return d.select("row_id", F.round(features.log_target(F.col("indicator_gwp")), 6).alias("target"))


@R.add("WITH b AS (SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':42'), 1, 8) AS BIGINT) % 100 AS k FROM documents) SELECT doc_id, CASE WHEN k < 70 THEN 'train' WHEN k < 85 THEN 'valid' ELSE 'test' END AS split FROM b")
def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return features.hash_split(table(spark, sf, "documents").select("doc_id"), "doc_id").select("doc_id", "split")


@R.add("WITH x AS (SELECT l_extendedprice AS y, l_quantity * 1000.0 AS p FROM lineitem) SELECT round(avg((y - p) * (y - p)) / 1e6, 4) AS mse, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2 FROM x")
def r2_mse(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000.0).alias("p"))
    return features.regression_metrics(x, "y", "p").select(F.round(F.col("mse") / 1e6, 4).alias("mse"), F.round("r2", 6).alias("r2"))


@R.add(f"WITH {COS_SQL}, r AS (SELECT m.query_id, label, ql, row_number() OVER (PARTITION BY m.query_id ORDER BY score DESC, item_id) AS rank FROM m JOIN q USING (query_id)), h AS (SELECT query_id, max(CASE WHEN label = ql AND rank <= 1 THEN 1 ELSE 0 END) AS a, max(CASE WHEN label = ql AND rank <= 2 THEN 1 ELSE 0 END) AS b FROM r GROUP BY query_id) SELECT avg(a) * 100 AS top1, avg(b) * 100 AS top2 FROM h")
def topk_hit_rate(spark: SparkSession, sf: str) -> DataFrame:
    lab = lambda k, n: table(spark, sf, "embeddings").select(F.col("vec_id").alias(k), F.col("label").alias(n))
    ranked = _top(spark, sf, 2, False).join(lab("item_id", "guess"), "item_id").join(lab("query_id", "truth"), "query_id")
    return features.hit_rate(ranked, "truth", "guess", 1).crossJoin(features.hit_rate(ranked, "truth", "guess", 2))  # one row each


@R.add("SELECT l_suppkey AS dst, round(avg(p_retailprice), 4) AS p_retailprice, round(avg(p_size), 4) AS p_size FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey")
def neighbour_mean(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    got = features.neighbour_mean(edges, table(spark, sf, "part"), "p_partkey", ["p_retailprice", "p_size"])
    return got.select("dst", *[F.round(c, 4).alias(c) for c in ("p_retailprice", "p_size")])


@R.add("WITH m AS (SELECT l_suppkey AS dst, p_size / 10.0 AS v FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT dst, round(sum(exp(v) * v) / sum(exp(v)), 6) AS v FROM m GROUP BY dst")
def attention_mean(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    f = table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 10.0).alias("v"))
    return features.attention_mean(edges, f, "p_partkey", "v").select("dst", F.round("v", 6).alias("v"))


@R.add("""WITH p AS (SELECT a.vec_id, a.embedding AS h, b.embedding AS r, c.embedding AS t FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2)
    SELECT vec_id, round(sqrt(list_sum(list_transform(generate_series(1, len(h)), lambda i: pow(CAST(h[i] AS DOUBLE) + r[i] - t[i], 2)))), 4) AS distance FROM p""")
def transe_scores(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    shift = lambda n, name: e.select((F.col("vec_id") - n).alias("vec_id"), F.col("embedding").cast("array<double>").alias(name))
    x = shift(0, "h").join(shift(1, "r"), "vec_id").join(shift(2, "t"), "vec_id")
    return x.select("vec_id", F.round(features.transe_score(F.col("h"), F.col("r"), F.col("t")), 4).alias("distance"))


@R.add("""WITH n AS (SELECT p_partkey, lower(p_name) AS name FROM part), k AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS word FROM part) SELECT p_partkey, word FROM n JOIN k ON contains(name, word)""")
def theta_key_match(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "part").select("p_partkey", F.lower("p_name").alias("name"))
    k = table(spark, sf, "part").select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("word"))
    return matching.substring_join(n, "p_partkey", "name", k, "word")


@R.add("SELECT DISTINCT props, coalesce(TRY_CAST(props AS DOUBLE), list_avg(list_transform(regexp_extract_all(props, '\\d+(?:\\.\\d+)?'), lambda x: CAST(x AS DOUBLE))), 1.0) AS v FROM events")
def mean_literal(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("props").distinct().select("props", text.mean_number(F.col("props")).alias("v"))


@R.add("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return validate.frequencies(table(spark, sf, "events"), "event_type")


@R.add("""WITH m AS (SELECT l_returnflag || l_linestatus AS stage, l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_tax END AS tax, l_extendedprice FROM lineitem)
    SELECT p_type, stage, round(sum(tax), 4) AS tax, round(sum(l_extendedprice), 2) AS price, count(DISTINCT p_brand) AS brands, string_agg(DISTINCT p_brand, ' | ' ORDER BY p_brand) AS names FROM m JOIN part ON p_partkey = l_partkey GROUP BY ALL""")
def lineitem_rollup(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("stage"), "l_partkey", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_tax")).alias("tax"), "l_extendedprice")
    x = m.join(table(spark, sf, "part").select("p_partkey", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return x.groupBy("p_type", "stage").agg(F.round(impact.null_sum("tax"), 4).alias("tax"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.countDistinct("p_brand").alias("brands"), impact.joined_distinct("p_brand").alias("names"))
