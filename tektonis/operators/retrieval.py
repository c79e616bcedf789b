"""Vector retrieval: cosine scores, ranking per branch, thresholds, boosts.

The corpus of an ontology is small and bounded by its classes; it is sent to the workers behind a check of its size, as stacked matrices, and queries stream past it in Arrow batches. A corpus beyond the check is taken in blocks, whose best hits are merged: what is kept per query stays k, whatever the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tektonis.operators.matching import substring_join

LABEL_WEIGHT, FULL_WEIGHT, BOOST = 0.70, 0.30, 0.95


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return F.coalesce(dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)), F.lit(0.0))


def item_score(name: Column, label: Column, full: Column) -> Column:
    """The better of the name's score and the mix of label and full text; missing ones count as the name's or nothing."""
    return F.greatest(F.coalesce(name, F.lit(0.0)), LABEL_WEIGHT * F.coalesce(label, name, F.lit(0.0)) + FULL_WEIGHT * F.coalesce(full, label, name, F.lit(0.0)))


def top_matches(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", item_id: str = "item_id", vector: str = "vector", branch: str | None = None, block: int = 20_000) -> DataFrame:
    """(query_id, branch, item_id, score, rank): the k best items of each branch for every query; ties go to the lower item id."""
    b = F.col(branch).cast("string") if branch else F.lit("")
    items = corpus.select(F.col(item_id).alias("i"), b.alias("b"), F.col(vector).alias("v")).where(F.col("v").isNotNull())
    n_blocks = -(-items.count() // block) or 1
    qk, ik = queries.schema[query_id].dataType.simpleString(), corpus.schema[item_id].dataType.simpleString()
    q = queries.select(F.col(query_id).alias("q"), F.col(vector).alias("v")).where(F.col("v").isNotNull())
    out = None
    for n in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("i"), F.lit(n_blocks)) == n).orderBy("i").collect()  # about `block` items
        groups: dict[str, tuple[list, np.ndarray]] = {}
        for name in sorted({r.b for r in part}):
            own = [r for r in part if r.b == name]
            m = np.array([r.v for r in own], np.float64)
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            groups[name] = ([r.i for r in own], m / np.where(norm == 0, 1, norm))

        def score(batches: Iterator[pd.DataFrame], groups=groups) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                if len(pdf):
                    m = np.array(pdf["v"].tolist(), np.float64)
                    norm = np.linalg.norm(m, axis=1, keepdims=True)
                    m = m / np.where(norm == 0, 1, norm)
                    for name, (ids, corpus_m) in groups.items():
                        s = np.round(m @ corpus_m.T, 9)
                        best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                        for r, q_id in enumerate(pdf["q"]):
                            rows += [(q_id, name, ids[c], float(s[r, c])) for c in best[r]]
                yield pd.DataFrame(rows, columns=["q", "b", "i", "score"])

        got = q.mapInPandas(score, f"q {qk}, b string, i {ik}, score double")
        out = got if out is None else out.unionByName(got)
    w = Window.partitionBy("q", "b").orderBy(F.desc("score"), "i")
    ranked = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_id), F.col("b").alias("branch"), F.col("i").alias(item_id), "score", "rank")


def best_match(matches: DataFrame, query_id: str = "query_id", item_id: str = "item_id", threshold: float = 0.0, fallback: str | None = None) -> DataFrame:
    """(query_id, item): the best item if its score is above the threshold, else the fallback."""
    best = matches.groupBy(query_id).agg(F.max(F.struct("score", (-F.col(item_id)).alias("neg"))).alias("b"))
    return best.select(query_id, F.when(F.col("b.score") > threshold, (-F.col("b.neg")).cast("string")).otherwise(F.lit(fallback)).alias("item"), F.col("b.score").alias("score"))


def dedupe_limit(matches: DataFrame, key: str, item: str, limit: int) -> DataFrame:
    """The best score of each item per key, cut to the first `limit` items."""
    best = matches.groupBy(key, item).agg(F.max("score").alias("score"))
    w = Window.partitionBy(key).orderBy(F.desc("score"), item)
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def hierarchical(parents: DataFrame, types: DataFrame, membership: DataFrame, threshold: float, k: int, query_id: str = "query_id") -> DataFrame:
    """Types for each query: those of the best category if it reaches the threshold (without a threshold of their own), else the types above it.

    parents and types are (query_id, item_id, score); membership is (item_id, category)."""
    best = parents.groupBy(query_id).agg(F.max(F.struct("score", (-F.col("item_id")).alias("neg"))).alias("b")).select(query_id, F.col("b.score").alias("cat_score"), (-F.col("b.neg")).alias("category"))
    scored = types.join(best, query_id, "left").join(membership.select("item_id", F.col("category").alias("of")), "item_id")
    inside = (F.col("cat_score") >= threshold) & (F.col("of") == F.col("category"))
    outside = F.coalesce(F.col("cat_score") < threshold, F.lit(True)) & (F.col("score") >= threshold)
    kept = scored.where(inside | outside).select(query_id, "item_id", "score").distinct()
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), "item_id")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def boost(hints: DataFrame, matches: DataFrame, rules: DataFrame, key: str = "query_id", item: str = "item") -> DataFrame:
    """Matches plus a fixed-score row for each rule (token, item) whose token the hint contains and whose item is not matched yet."""
    found = substring_join(hints.withColumn("hint", F.lower("hint")), key, "hint", rules, "token")
    hit = found.join(rules.distinct(), "token").select(key, item).distinct()
    new = hit.join(matches.select(key, item).distinct(), [key, item], "left_anti").withColumn("score", F.lit(BOOST))
    return matches.select(key, item, "score").unionByName(new)


def mean_top3(matches: DataFrame, key: str = "query_id") -> DataFrame:
    """The mean of the three best scores per key."""
    w = Window.partitionBy(key).orderBy(F.desc("score"))
    return matches.withColumn("_r", F.row_number().over(w)).where("_r <= 3").groupBy(key).agg(F.avg("score").alias("mean_score"))


def hashed_embedding(text: str, dim: int = 64, n: int = 3) -> list[float]:
    """A deterministic stand-in for a sentence encoder: hashed character n-grams, of unit length."""
    import xxhash

    v = np.zeros(dim)
    s = f" {text.lower()} "
    for i in range(max(0, len(s) - n + 1)):
        h = xxhash.xxh64_intdigest(s[i : i + n])
        v[h % dim] += 1 if h >> 63 else -1
    norm = float(np.linalg.norm(v))
    return (v / norm if norm else v).astype(np.float32).tolist()


def embed(text: Column | str, encoder=hashed_embedding) -> Column:
    """Texts to vectors, in Arrow batches; null stays null. The encoder is a parameter."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else encoder(t))

    return run(text)


def overlap_score(hint: Column, tokens: Column) -> Column:
    """0.5 and a tenth more for each distinct name token that the hint contains; null where it contains none."""
    n = F.size(F.filter(F.array_distinct(tokens), lambda t: (F.length(t) > 0) & F.contains(F.lower(hint), F.lower(t))))
    return F.when(n > 0, 0.5 + 0.1 * n)


def is_material_entity(parents: Column, tokens: Column, anchor: str, words: list[str]) -> Column:
    """Whether an entry is a child of the anchor or has one of the words among its name tokens."""
    return F.coalesce(F.array_contains(parents, anchor), F.lit(False)) | F.coalesce(F.arrays_overlap(F.transform(tokens, lambda t: F.lower(t)), F.array(*map(F.lit, words))), F.lit(False))
