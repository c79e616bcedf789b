"""Substring joins: texts and the key words that they contain."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def substring_join(df: DataFrame, key: str, text: str, words: DataFrame, word: str, block: int = 50_000) -> DataFrame:
    """(key, word), one row for each word that a text contains.

    Words go to the workers in blocks of about `block`, as an automaton that finds all of them in one pass over a text; so neither side is joined pairwise, whatever their sizes. Null texts and null or empty words meet nothing."""
    w = words.select(F.col(word).alias("w")).where("w IS NOT NULL AND w <> ''").distinct()
    blocks = -(-w.count() // block) or 1
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t IS NOT NULL")
    out = None
    for n in range(blocks):
        part = [r.w for r in w.where(F.pmod(F.xxhash64("w"), F.lit(blocks)) == n).collect()]  # about `block` words

        def find(batches: Iterator[pd.DataFrame], part=part) -> Iterator[pd.DataFrame]:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for x in part:
                machine.add_word(x, x)
            machine.make_automaton()
            for pdf in batches:
                yield pd.DataFrame([(k, x) for k, t in zip(pdf["k"], pdf["t"]) for x in ({y for _, y in machine.iter(t)} if part else ())], columns=["k", "w"])

        got = rows.mapInPandas(find, f"k {kind}, w string")
        out = got if out is None else out.unionByName(got)
    return out.distinct().select(F.col("k").alias(key), F.col("w").alias(word))
