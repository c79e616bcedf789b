"""Sources mixed to target shares of the total size.

Every document gets a hash-random key. Documents are ordered by key within their source, in ranges of the key: the keys are uniform, so equal ranges hold about equally many documents, and a source of any size is spread over as many ranges as it needs. Sizes are summed per range, the ranges' sums give each range its offset, and within a range a running sum gives each document its place. A source's budget is its share of the total: whole epochs of the source first, then the documents whose place lies within the rest. The total is the largest for which no source needs more than its permitted epochs, or a given one.

Defined results
    null source, source without a target     not selected, not in the report
    target without documents                 reported with a reached share of 0; the other shares are taken of what is left
    total beyond what a source permits       the source gives all its epochs; the report shows the share it falls short of
    documents of size 0, null texts          not selected
    ties of keys                             in the order of the document key
    repeated documents                       each of its own
    empty documents                          empty selection; the report lists the targets with 0
    extra columns                            ignored
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tektonis.runtime import cut, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern by which byte-level tokenizers cut text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEY_BITS = 48


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a file of ranks, once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(docs: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, n_tokens) of documents with a text."""
    rows = spread(docs.select(key, *keep, F.col(text).alias("_text")).where(F.col(text).isNotNull()), key)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text") + ", n_tokens bigint"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(tokenizer)
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) for t in pdf.pop("_text")]
            yield pdf.assign(n_tokens=n)

    return rows.mapInPandas(count, schema)


def plan(sizes: DataFrame, targets: DataFrame, source: str, total: int | None = None) -> DataFrame:
    """(source, share, max_repeat, size, budget, epochs, rest) of every target with documents; `sizes` has source and size."""
    t = targets.select(F.col(source), F.col("target_share").alias("asked"), F.col("max_repeat").cast("bigint").alias("max_repeat")).where(F.col("asked") > 0)
    have = t.join(sizes.where(F.col("size") > 0), source)  # one row a target
    whole = Window.partitionBy(F.lit(0))
    have = have.withColumn("share", F.col("asked") / F.sum("asked").over(whole))
    reach = F.min(F.col("size") * F.col("max_repeat") / F.col("share")).over(whole)
    have = have.withColumn("total", F.lit(float(total)) if total is not None else reach)
    have = have.withColumn("budget", F.floor(F.least(F.col("total") * F.col("share") + 1e-6, (F.col("size") * F.col("max_repeat")).cast("double"))).cast("bigint"))
    return have.withColumn("epochs", F.floor(F.col("budget") / F.col("size")).cast("bigint")).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("size"))


def random_key(key: str, seed: str) -> F.Column:
    """48 hash-random bits of a document's key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), 1, KEY_BITS // 4), 16, 10).cast("bigint")


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", size: str = "n_tokens", seed: str = "mix", total: int | None = None, rows_per_range: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(selection, report). Selection: (key, source, size, copies). Report: (source, target_share, max_repeat, documents, selected, share)."""
    rows = docs.select(key, source, F.col(size).cast("bigint").alias("size")).where(F.col(source).isNotNull() & (F.col("size") > 0)).join(targets.select(source).distinct(), source, "left_semi")
    rows = cut(rows.withColumn("rnd", random_key(key, seed)))
    ranges = max(1, math.ceil(rows.count() / rows_per_range))
    rows = rows.withColumn("bucket", F.floor(F.col("rnd") * F.lit(float(ranges)) / F.lit(float(1 << KEY_BITS))).cast("bigint"))
    sums = cut(rows.groupBy(source, "bucket").agg(F.sum("size").alias("bucket_size")))
    quota = plan(sums.groupBy(source).agg(F.sum("bucket_size").alias("size")), targets, source, total)
    quota = cut(quota.select(source, "epochs", "rest", "budget"))
    before = Window.partitionBy(source).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))).join(quota, source).drop("bucket_size")
    order = Window.partitionBy(source, "bucket").orderBy("rnd", key).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(offsets, [source, "bucket"]).withColumn("place", F.col("offset") + F.sum("size").over(order))
    copies = F.col("epochs") + (F.col("place") <= F.col("rest")).cast("bigint")
    selection = placed.select(key, source, "size", copies.alias("copies")).where(F.col("copies") > 0)
    used = selection.groupBy(source).agg(F.sum(F.col("size") * F.col("copies")).alias("selected"), F.sum("copies").alias("documents"))
    report = targets.select(source, "target_share", F.col("max_repeat").cast("bigint").alias("max_repeat")).join(used, source, "left").na.fill(0, ["selected", "documents"])
    everything = Window.partitionBy(F.lit(0))  # one row a target
    share = F.col("selected") / F.greatest(F.sum("selected").over(everything), F.lit(1))
    report = report.withColumn("share", share).select(source, "target_share", "max_repeat", "documents", "selected", "share")
    return selection.withColumnRenamed("size", size), report
