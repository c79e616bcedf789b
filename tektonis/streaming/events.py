"""Structured Streaming over the engine's operators: the same functions on unbounded input.

The sources are folders of Parquet files or any streaming DataFrame. State is bounded by watermarks; late rows beyond them are dropped by Spark, which is the meaning of a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tektonis.functions import lca


def read_folder(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_rollup(events: DataFrame, time: str, keys: list[str], value: str, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Null-aware sums and counts per window and key."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = events.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "total", "n")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a key: activity without a gap longer than `gap`."""
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(rows: DataFrame, key: str, time: str, late: str = "30 days") -> DataFrame:
    """Redelivered rows dropped, as long as they come within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def staged(rows: DataFrame) -> DataFrame:
    """Impact rows with stage, suffix, activity and unit, row by row."""
    stage = lca.stage_code(F.col("lcm_nest1_code"), F.col("lcm_code"))
    return rows.withColumns({"stage": stage, "stage_suffix": lca.stage_suffix(stage), "activity": lca.activity(F.col("activity_type")), "unit": lca.unit(F.col("techflow_unit"))})


def carry_forward(lines: DataFrame, doc: str, key: str, value: str, idle_minutes: int | None = None) -> DataFrame:
    """(doc, key, value) in order of arrival: a line without a key belongs to the last key of its document, which is kept as state.

    State is dropped once no line has come for `idle_minutes`; it is kept for ever where none is given. A query with that timeout runs batches also without new data, so it must be run with a processing-time trigger and never ends by itself."""
    kind = lines.schema[doc].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        for pdf in batches:
            rows = []
            for a, b in zip(pdf[key], pdf[value]):
                last = a if isinstance(a, str) else last
                if last is not None:
                    rows.append((k[0], last, b))
            yield pd.DataFrame(rows, columns=[doc, "key", "value"])
        state.update((last,))
        if idle_minutes is not None:
            state.setTimeoutDuration(idle_minutes * 60_000)

    return lines.groupBy(doc).applyInPandasWithState(step, f"`{doc}` {kind}, key string, value string", "last string", "append", GroupStateTimeout.NoTimeout if idle_minutes is None else GroupStateTimeout.ProcessingTimeTimeout)
