"""Small helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES, -1), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Only where Spark runs on this machine alone, as
    in tests, may it be unset: a local folder then serves."""
    sc = spark.sparkContext
    if sc.getConf().get("spark.checkpoint.dir"):
        return sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir names no folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="framelake-"))
    return sc.getCheckpointDir()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def columns(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost
    executors, and, unlike ``checkpoint()``, computes the rows a single time."""
    path = scratch_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
