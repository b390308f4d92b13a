"""Lineage cuts for iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of its own only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that the session names."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt_cut(df: DataFrame) -> DataFrame:
    """A cut that remembers by which columns rows are dealt; an adaptive plan does not tell."""
    conf = df.sparkSession.conf
    was = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df.select("*"))  # planned afresh, without what was planned before
    finally:
        conf.set("spark.sql.adaptive.enabled", was)


def dealt_table(df: DataFrame, keys: list[str], parts: int) -> tuple[DataFrame, str]:
    """df as a table in that folder, in ``parts`` buckets by keys, and its name.

    Rows that are dealt by the same keys over as many partitions are written where they
    are; and reading tells Spark how they lie, so that a join by the keys moves only the
    other side.
    """
    spark, name = df.sparkSession, f"dealt_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").bucketBy(parts, *keys).option("path", f"{checkpoint_dir(spark)}/{name}").option("compression", "none").option("parquet.enable.dictionary", "false")
    writer.saveAsTable(name)
    return spark.table(name), name


def drop_table(spark: SparkSession, name: str) -> None:
    """Drop a dealt table with its files."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/{name}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
