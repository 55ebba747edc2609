"""What the operators of this subpackage share: input columns, lineage cuts, shared files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = "\t\n\x0b\x0c\r "
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Stands for a missing id; ids of real rows are expected to be 0 or more.
NO_ID = -1
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it. Where that is unset a temporary one is made and
    set on a local master (tests on one machine); a cluster is refused, as its executors see no folder of the driver's."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='segspark-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let go of what earlier plans shuffled. Spark deletes shuffle files once the driver's garbage collector has seen that
    nothing refers to them, which on a calm driver takes up to half an hour, while a loop of joins fills the disks."""
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a compressed table in the shared folder and read it back: smaller than a
    checkpoint, and read with column pruning."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lean(spark: SparkSession) -> None:
    """Texts can be long, so batches to Python get fewer rows than Spark's default of 10,000. The session has one
    setting for all its plans and reads it when a plan runs, so it stays changed; a setting that isn't the default is left
    alone."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def documents(df: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Only doc_id and text, so other columns can't clash; those named in carry come along in one struct,
    carried. A null id counts as NO_ID."""
    lean(df.sparkSession)
    own = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text")]
    return df.select(*own, *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []))


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(c, UPPER, UPPER.lower())


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
