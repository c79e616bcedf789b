"""Feature and edge tables for graph learning: encoders, scalers, splits, metrics, message passing, translation embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tektonis.runtime import number_distinct


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean, by their population deviation (1 where it is 0). The statistics are one row."""
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(stats))  # a single row of statistics
    for c in columns:
        out = out.withColumn(c + "_scaled", (F.col(c) - F.col(f"_m_{c}")) / F.coalesce(F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(1.0)))
    return out.drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def log_target(column: Column) -> Column:
    """The decimal logarithm of a target; zero and missing targets are dropped before, small ones are clamped."""
    return F.log10(F.greatest(column, F.lit(1e-6)))


def usable_targets(df: DataFrame, target: str) -> DataFrame:
    return df.where(F.col(target).isNotNull() & (F.col(target) != 0))


def hash_split(df: DataFrame, key: str, seed: int = 42, train: int = 70, valid: int = 15) -> DataFrame:
    """df with the split a key falls into; the same in every layout of the data."""
    bucket = F.pmod(F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("bigint"), F.lit(100))
    return df.withColumn("split", F.when(bucket < train, "train").when(bucket < train + valid, "valid").otherwise("test"))


def regression_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row (mse, r2) from one pass of sums."""
    y, p = F.col(truth), F.col(predicted)
    s = df.where(y.isNotNull() & p.isNotNull()).agg(F.sum((y - p) * (y - p)).alias("sse"), F.count("*").alias("n"), F.var_pop(y).alias("var"))
    return s.select((F.col("sse") / F.col("n")).alias("mse"), (1 - F.col("sse") / (F.col("var") * F.col("n"))).alias("r2"))


def hit_rate(ranked: DataFrame, truth: str, predicted: str, k: int) -> DataFrame:
    """The percentage of queries whose truth is among the first k predictions; ranked has query_id and rank."""
    hit = ranked.groupBy("query_id").agg(F.max(((F.col("rank") <= k) & (F.col(truth) == F.col(predicted))).cast("int")).alias("hit"))
    return hit.agg((F.avg("hit") * 100).alias(f"top{k}"))


def neighbour_mean(edges: DataFrame, features: DataFrame, node: str, columns: list[str]) -> DataFrame:
    """The mean features of each node's in-neighbours: one join and one partial aggregation."""
    f = features.select(F.col(node).alias("src"), *columns)
    return edges.select("src", "dst").join(f, "src").groupBy("dst").agg(*[F.avg(c).alias(c) for c in columns])


def attention_mean(edges: DataFrame, features: DataFrame, node: str, column: str) -> DataFrame:
    """A softmax-weighted mean of the in-neighbours' feature, the feature itself being the score."""
    f = features.select(F.col(node).alias("src"), F.col(column).alias("v"))
    m = edges.select("src", "dst").join(f, "src")
    top = m.groupBy("dst").agg(F.max("v").alias("top"))
    w = m.join(top, "dst").withColumn("w", F.exp(F.col("v") - F.col("top")))
    return w.groupBy("dst").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias(column))


def negative_edges(edges: DataFrame, nodes: DataFrame, per: int = 1, seed: str = "neg") -> DataFrame:
    """(src, dst): for each edge `per` edges to a node drawn by hash, those that exist left out.

    The node's number is a hash of the edge, so any run on any cluster draws the same ones; nodes are (node), numbered in ranges."""
    numbered = number_distinct(nodes, "node", "_no")
    n = numbered.count()
    if n == 0:
        return edges.select("src", "dst").limit(0)
    tries = edges.select("src", "dst", F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias("_i"))
    hashed = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.concat_ws("|", F.col("src").cast("string"), F.col("dst").cast("string"), F.col("_i").cast("string")))), 1, 8), 16, 10).cast("bigint")
    drawn = tries.select("src", (hashed % n).alias("_no")).distinct().join(numbered, "_no").select("src", F.col("node").alias("dst")).distinct()
    return drawn.join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def link_loss(scored: DataFrame, score: str, label: str) -> DataFrame:
    """(loss, n): the mean logistic loss of scored edges, labelled 1 where they exist and 0 where they are drawn."""
    s = F.col(score)
    return scored.agg(F.avg(F.log1p(F.exp(F.when(F.col(label) == 1, -s).otherwise(s)))).alias("loss"), F.count("*").alias("n"))


def number_entities(triples: DataFrame) -> DataFrame:
    """(iri, id): subjects and objects that are nodes, numbered from 0 in code point order of the distinct names."""
    nodes = triples.where("o_kind <> 'literal'").select(F.explode(F.array("s", "o")).alias("iri")).distinct()
    return number_distinct(nodes, "iri", "id")


def transe_score(head: Column, relation: Column, tail: Column) -> Column:
    """The length of head + relation - tail."""
    diff = F.zip_with(F.zip_with(head, relation, lambda a, b: a + b), tail, lambda a, b: a - b)
    return F.sqrt(F.aggregate(diff, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def bilinear(left: Column, right: Column, matrix: list[list[float]]) -> Column:
    """left' M right for a fixed matrix."""
    rows = F.array(*[F.array(*map(F.lit, r)) for r in matrix])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return dot(left, F.transform(rows, lambda r: dot(r, right)))


def train_transe(triples: np.ndarray, n_entities: int, n_relations: int, dim: int = 16, epochs: int = 50, margin: float = 1.0, rate: float = 0.05, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Translation embeddings of a bounded sample of triples (rows of head, relation, tail), by margin loss with corrupted tails."""
    rng = np.random.default_rng(seed)
    e, r = rng.normal(0, dim**-0.5, (n_entities, dim)), rng.normal(0, dim**-0.5, (n_relations, dim))
    for _ in range(epochs):
        bad = rng.integers(0, n_entities, len(triples))
        h, q, t = triples.T
        pos, neg = e[h] + r[q] - e[t], e[h] + r[q] - e[bad]
        dp, dn = np.linalg.norm(pos, axis=1) + 1e-9, np.linalg.norm(neg, axis=1) + 1e-9
        on = (margin + dp - dn > 0)[:, None] / len(triples) ** 0.5
        gp, gn = on * pos / dp[:, None], on * neg / dn[:, None]
        np.add.at(e, h, -rate * (gp - gn))
        np.add.at(r, q, -rate * (gp - gn))
        np.add.at(e, t, rate * gp)
        np.add.at(e, bad, -rate * gn)
        e /= np.maximum(1, np.linalg.norm(e, axis=1, keepdims=True))
    return e, r
