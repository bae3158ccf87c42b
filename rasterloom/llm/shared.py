"""Table access, lineage cuts and small column helpers used by every operator of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space as the word definition names it: space, \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and runs on one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-checkpoint-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the session's file system closes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def cut(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: a lineage cut that survives lost executors.

    instead_of: a table from here that nothing reads once df is written, as in a loop; it is deleted then.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.cut_path = path
    if instead_of is not None:
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(instead_of.cut_path)
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return made


def word_array(text: Column) -> Column:
    """The runs of characters other than ASCII white space; null or blank text gives an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row.

    The optimizer inlines a projection that is used once, also into a lambda, where it would run again for each
    element; a lambda variable is never inlined.
    """
    return F.transform(F.array(value), body)[0]
