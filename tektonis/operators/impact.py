"""Impact roll-ups: null-aware sums of indicators per element, work section and life-cycle stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tektonis.functions import lca


def null_sum(column: Column | str) -> Column:
    """A sum that is null only where no value was present."""
    return F.sum(column)


def first_by(column: str, order: str) -> Column:
    """The value of the row with the lowest order, also if it is null."""
    return F.min_by(F.struct(F.col(column)), F.col(order))[column]


def joined_distinct(column: str, separator: str = " | ") -> Column:
    """Sorted distinct non-blank texts in one string; empty if there is none."""
    return F.array_join(F.sort_array(F.collect_set(F.nullif(F.trim(F.col(column)), F.lit("")))), separator)


def rollup(rows: DataFrame, keys: list[str], order: str = "row_id", indicators: tuple[str, ...] = tuple(lca.INDICATORS)) -> DataFrame:
    """One row per key and stage: 19 sums, the amount, label, activity and unit of the first row, first position.

    Partial aggregation before the one shuffle keeps a hot element from becoming a hot task; no list of rows is ever gathered."""
    staged = rows.withColumn("stage", lca.stage_code(F.col("lcm_nest1_code"), F.col("lcm_code")))
    sums = [null_sum(f"indicator_{x}").alias(x) for x in indicators]
    firsts = [first_by(c, order).alias("first_" + c) for c in ("lcs_name", "activity_type", "techflow_unit")]
    out = staged.groupBy(*keys, "stage").agg(*sums, null_sum("techflow_amount").alias("amount"), *firsts, F.min(order).alias("first_row"), F.count("*").alias("n_rows"))
    return out.withColumn("stage_suffix", lca.stage_suffix(F.col("stage"))).withColumn("activity", lca.activity(F.col("first_activity_type"))).withColumn("unit", lca.unit(F.col("first_techflow_unit")))


def unpivot(df: DataFrame, keys: list[str], values: list[str], name: str = "indicator", value: str = "value") -> DataFrame:
    """One row per key and non-null value column."""
    return df.unpivot(keys, values, name, value).where(F.col(value).isNotNull())


def sequence_ids(df: DataFrame, group: list[str], order: str, name: str, width: int = 2) -> DataFrame:
    """Zero-padded numbers of distinct values within a group, in order of first appearance.

    First appearances are reduced before the window, so the window sees distinct values only."""
    from pyspark.sql import Window

    first = df.groupBy(*group, name).agg(F.min(order).alias("first_row"))
    w = Window.partitionBy(*group).orderBy("first_row", name)
    return first.withColumn("no", F.row_number().over(w)).withColumn("padded", F.lpad(F.col("no").cast("string"), width, "0"))
