"""JSON, CSV and configuration files of building data."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RECORD = "map<string,string>"


def resolve(path: str | None, variable: str, fallback: str) -> str:
    """A path given, named by an environment variable, or the fallback; FileNotFoundError if it doesn't exist."""
    got = path or os.environ.get(variable) or fallback
    if "://" not in got and not Path(got).exists():
        raise FileNotFoundError(got)
    return got


def read_env(path: str, environ: dict[str, str] | None = None) -> dict[str, str]:
    """key=value lines: comments, a byte-order mark, `export` and quotes are taken off; what is set already stays."""
    env = os.environ if environ is None else environ
    for line in Path(path).read_text(encoding="utf-8-sig").splitlines():
        line = line.strip()
        if line and not line.startswith("#") and "=" in line:
            key, value = line.removeprefix("export ").split("=", 1)
            env.setdefault(key.strip(), value.strip().strip("\"'"))
    return dict(env)


def read_json_records(spark: SparkSession, paths: list[str], wrapper: str, keep: str | None = None) -> DataFrame:
    """(path, record): one row per record, as JSON text, of files that hold an array or an object that wraps one.

    The text is parsed as a variant, so files of different shapes are read in one pass."""
    raw = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.try_parse_json(F.regexp_replace("value", "^﻿", "")).alias("v"))
    if keep:
        raw = raw.where(F.rlike("path", F.lit(keep)))
    whole = F.try_variant_get("v", "$", "array<variant>")
    inner = F.try_variant_get("v", f"$.{wrapper}", "array<variant>")
    return raw.select("path", F.explode(F.coalesce(inner, whole, F.array("v"))).alias("r")).select("path", F.to_json("r").alias("record")).where(F.col("record").isNotNull())


def combine(records: DataFrame) -> DataFrame:
    """The number of records and the sorted names of their files."""
    return records.agg(F.count("*").alias("count"), F.array_join(F.sort_array(F.collect_set(F.element_at(F.split("path", "/"), -1))), ",").alias("files"))


def read_csv(spark: SparkSession, path: str, schema: StructType | str, required: list[str]) -> DataFrame:
    """A CSV file without the rows in which a required column is null."""
    return spark.read.csv(path, schema=schema, header=True).dropna(subset=required)


def select_case(cases: DataFrame, order: str, number: int | None = None, case_id: str | None = None, id_column: str = "id") -> DataFrame:
    """The case of an id, or of a 1-based position; all where neither is given. IndexError for a position out of bounds."""
    if case_id is not None:
        return cases.where(F.col(id_column) == case_id)
    if number is None:
        return cases
    if number < 1 or number > cases.count():
        raise IndexError(number)
    return cases.orderBy(order).offset(number - 1).limit(1)


def descriptions(triples: DataFrame, classes: list[str], type_p: str, text_p: str) -> DataFrame:
    """(subject, german, english): the first text of each language of every subject of the classes; chunks of one language are taken in code point order."""
    subjects = triples.where((F.col("p") == type_p) & F.col("o").isin(*classes)).select("s").distinct()
    texts = triples.where(F.col("p") == text_p).join(subjects, "s", "left_semi")
    first = lambda lang: F.min(F.when(F.col("o_lang") == lang, F.col("o")))
    return texts.groupBy(F.col("s").alias("subject")).agg(first("de").alias("german"), first("en").alias("english"))


def numbered(df: DataFrame, group: str, order: str, name: str = "no") -> DataFrame:
    """Rows numbered from 1 within a group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(order)))


# Fixed value: the common record of all description sources.
DESCRIPTION = "subject string, source string, german string, english string, extra string, metadata map<string,string>"


def source_label(path: str) -> str:
    """The readable name of a source: its file name without the ending."""
    return Path(path).stem


def stage_descriptions(stages: DataFrame, building: str, element: str, stage: str, german: str, english: str) -> DataFrame:
    """Description records of building stages; a stage without any text gives none."""
    from tektonis.functions.lca import safe_id

    subject = F.concat(F.lit("Building_"), safe_id(F.col(building)), F.lit("_Layer_"), safe_id(F.col(element)), F.lit("_"), F.col(stage))
    has = F.length(F.trim(F.concat(F.coalesce(german, F.lit("")), F.coalesce(english, F.lit(""))))) > 0
    return stages.where(has).select(subject.alias("subject"), F.lit("stage").alias("source"), F.col(german).alias("german"), F.col(english).alias("english"), F.lit(None).cast("string").alias("extra"), F.create_map(F.lit("element"), F.col(element), F.lit("stage"), F.col(stage)).alias("metadata"))


def worksection_descriptions(rows: DataFrame, worksection: str, element_no: str, layer_no: str) -> DataFrame:
    """Description records of work sections; the numbers are written with two digits."""
    subject = F.format_string("E%02d_L%02d", F.col(element_no).cast("int"), F.col(layer_no).cast("int"))
    none = F.lit(None).cast("string")
    return rows.where(F.col(worksection).isNotNull()).select(subject.alias("subject"), F.lit("worksection").alias("source"), none.alias("german"), F.col(worksection).alias("english"), none.alias("extra"), F.create_map(F.lit("worksection"), F.col(worksection)).alias("metadata"))
