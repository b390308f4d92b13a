"""What the operators share: tables, word expressions, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and 0x09 to 0x0D (fixed value).
SPACE = r"[\x20\x09-\x0D]+"
#: A word of the contracts that split on white space (fixed value).
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone, whatever the locale or script; plain ASCII takes the fast way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of an id written as text, modulo n; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def named(column: str) -> Column:
    """A column by its name as it stands, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(df: DataFrame, *replaced: str) -> Column:
    """The columns of df, but for those that results replace, as one struct ``own``.

    Operators work on it and on columns of their own, so that no name of df can clash.
    """
    gone = {c.lower() for c in replaced}
    return F.struct(*[named(c) for c in df.columns if c.lower() not in gone]).alias("own")


#: A key is hot from this many rows on, and at most so many keys can be.
HOT_ROWS, HOT_KEYS = 1000, 50_000


def salted_join(big: DataFrame, small: DataFrame, key: str, spread: str, counts: DataFrame, few: int = 0) -> DataFrame:
    """Inner join of big to small, which has one row a key, where one key may have a third of big's rows.

    Up to ``few`` rows of small, whose width must be bounded, are broadcast.  Beyond,
    counts (key, n) tells how many rows of big a key has.  Rows of a hot key are dealt over
    parts by the column ``spread``, and small's row of that key goes to each part.  A key is
    hot if it has more rows than ``HOT_ROWS`` and more than one in ``HOT_KEYS`` of all; so at
    most HOT_KEYS hot keys exist, which are broadcast.
    """
    if few and small.count() <= few:
        return big.join(F.broadcast(small), key)
    many = cut(counts.filter(F.col("n") > HOT_ROWS).select(F.col(key).alias("__hot"), F.col("n").alias("__n")))
    rows = many.agg(F.sum("__n")).first()[0]
    if not rows:
        return big.join(small, key)
    least = max(HOT_ROWS, rows // HOT_KEYS)
    hot = F.broadcast(many.filter(F.col("__n") > least).select("__hot", F.ceil(F.col("__n") / least).cast("int").alias("__parts")))
    here = big.join(hot, F.col(key) == F.col("__hot"), "left")
    here = here.withColumn("__part", F.coalesce(F.pmod(F.xxhash64(spread), F.col("__parts")).cast("int"), F.lit(0))).drop("__hot", "__parts")
    there = small.join(hot, F.col(key) == F.col("__hot"), "left")
    there = there.withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__hot", "__parts")
    return here.join(there, [key, "__part"]).drop("__part")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; one of its own only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage of a wide table by writing it, compressed, to the shared folder."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
