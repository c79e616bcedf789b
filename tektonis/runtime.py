"""Session, checkpoint and parallelism helpers shared by all operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "tektonis", **conf: str) -> SparkSession:
    """The active session, or a new one with adaptive execution and UTC time."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    # folders of checkpoints that nothing refers to any more are deleted
    b = b.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Where it is unset, a temporary one in local mode (tests); on a cluster an error, since other machines couldn't read it."""
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not at and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
    sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="tektonis-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise a DataFrame in the shared checkpoint folder, so that a lost executor costs no recomputation of its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def python_partitions(spark: SparkSession, factor: int = 2) -> int:
    """Partitions for a CPU-bound Python stage: as many as shuffles have, and a few for each core."""
    return max(spark.sparkContext.defaultParallelism * factor, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *keys: str, factor: int = 2) -> DataFrame:
    """Give a scan of few input partitions enough of them for CPU-bound Python stages.

    A scan with many splits is left alone; the shuffle happens only for small inputs. To be called on scans and their projections: counting the partitions of a plan with shuffles would run them. A later distinct or aggregation by the keys needs no shuffle of its own."""
    sc = df.sparkSession.sparkContext
    if df.rdd.getNumPartitions() >= sc.defaultParallelism:
        return df
    return df.repartition(sc.defaultParallelism * factor, *[F.col(k) for k in keys])


def too_big(df: DataFrame, limit: int) -> bool:
    """Whether a DataFrame has more than `limit` rows, found without counting it whole."""
    return df.limit(limit + 1).count() > limit


def number_distinct(values: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): distinct values numbered from 0 in their order, without bringing them into one task.

    Values are split into ranges and materialised; the ranges' counts, one row each, give the offsets."""
    from pyspark.sql import Window

    parts = cut(values.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(column))
    return parts.withColumn("_no", within).join(offsets, "_part").select(column, (F.col("_no") + F.col("_offset") - 1).cast("bigint").alias(name))


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once per context, wherever they run."""
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_tektonis_shipped", False):
        return
    home = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="tektonis-package-")) / "tektonis.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    sc.addPyFile(str(to))
    sc._tektonis_shipped = True
