"""Operator 12: a two-pass external shuffle into shards, in DataFrame functions only.

Pass one scatters the rows over buckets by a seeded hash of their ids; there are as many
buckets as make one fit in a task's memory.  Pass two shuffles each bucket by Fisher and
Yates (Spark's ``shuffle`` of the places 0 to n-1, by seed).  The buckets one after
another are then one random order of all rows, and a shard is a sixteenth of it: the
numbers of rows differ by one at most (law ``rows``), whatever the rows' sizes.

Rows move once, by bucket.  Number and offset of a bucket's rows come from a pass that
reads ids alone, and its permutation is one array of numbers that meets the bucket where
it already is.  So a bucket belongs to one or two shards, and a task writes few files.

Groups of equal texts have ids of their own and scatter like all rows.  Should one id
(or a missing one) stand in very many rows, these scatter by their place in the input; a
place is stable in a table as read or checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import HOT_KEYS, HOT_ROWS, cut, named, packed

#: Shards and seed of the registered query.
SHARDS, SEED = 16, 2024
#: Bytes of text of a mean bucket, and the least number of buckets a shard.
BUCKET_BYTES, BUCKETS_EACH = 64 << 20, 4


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with size (UTF-8 bytes plus 1; null: 1) and text_crc32 (unsigned; null as empty)."""
    t = F.coalesce(named(text), F.lit(""))
    size, crc = (F.octet_length(t) + 1).cast("long"), F.crc32(t.cast("binary"))
    return docs.select("*", size.alias("size"), crc.alias("text_crc32")) if not {"size", "text_crc32"} & {c.lower() for c in docs.columns} else docs.select(packed(docs, "size", "text_crc32"), size.alias("size"), crc.alias("text_crc32")).select("own.*", "size", "text_crc32")


def scattered(rows: DataFrame, doc_id: str, seed: int, hot: DataFrame | None) -> DataFrame:
    """rows with the hash ``h`` that scatters them: of seed and id, and of the place for hot ids."""
    h = F.xxhash64(F.lit(seed), named(doc_id))
    own = [named(c) for c in rows.columns]
    if hot is None:
        return rows.select(*own, h.alias("h"))
    placed = rows.select(*own, h.alias("h"), F.monotonically_increasing_id().alias("place"))
    return placed.join(F.broadcast(hot), "h", "left").select(*own, F.when(F.col("many"), F.xxhash64("h", "place")).otherwise(F.col("h")).alias("h"))


def shard(docs: DataFrame, doc_id: str = "doc_id", size: str = "size", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Rows of docs (with their sizes, see ``measured``) with law, shard, slot and grown_shard.

    Slots count from 0 without gaps in each shard.  Null ids hash as a value of their own;
    null and empty texts are rows like others.  A rerun gives the same shards and slots,
    but for rows that agree in all columns, which may change places, and for ids in more
    than a thousand rows, as said above.  An empty table gives an empty one.  Columns of docs
    that bear a result's name are replaced; other names, whatever they are, stay.
    """
    rows = docs.select(packed(docs, "law", "shard", "slot", "grown_shard"), named(doc_id).alias("i"), F.coalesce(named(size), F.lit(1)).cast("long").alias("bytes"))
    ids = cut(scattered(rows.select("i", "bytes"), "i", seed, None).groupBy("h").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")))
    n, total = ids.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    hot = cut(ids.filter(F.col("n") > max(HOT_ROWS, n // HOT_KEYS)).select("h", F.lit(True).alias("many")))  # at most HOT_KEYS rows
    hot = None if hot.isEmpty() else hot
    buckets = max(BUCKETS_EACH * shards, -(-total // bucket_bytes))
    bucket = F.pmod("h", F.lit(buckets)).cast("int").alias("bucket")

    counts = scattered(rows.select("i"), "i", seed, hot).groupBy(bucket).agg(F.count("*").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut(counts.select("bucket", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))  # a row a bucket
    # Buckets in order and in fixed partitions, so that the seeded generator gives a rerun the same places.
    places = counts.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    places = places.select("bucket", "before", F.shuffle(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), F.lit(seed)).alias("places"))

    moved = scattered(rows, "i", seed, hot).select("own", "i", "bytes", "h", bucket).repartition(buckets, "bucket")
    at = F.row_number().over(Window.partitionBy("bucket").orderBy("h", "i", "bytes", F.xxhash64("own"))) - 1
    moved = moved.withColumn("at", at).join(places, "bucket")
    place = F.col("before") + F.get("places", F.col("at"))
    of = F.expr(f"place * {shards} div {max(n, 1)}")
    first = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    out = moved.select("own", place.alias("place")).select("own", "place", of.cast("int").alias("shard")).withColumn("slot", F.col("place") - first)
    return out.select("own.*", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write whole rows as Parquet, a folder ``shard=k`` for each shard; files hold their rows in order of slot.

    Each task writes its buckets, which lie in one or two shards each.  Tasks that are lost
    are run again; what is committed at the end is one file of each.
    """
    sharded = shard(measured(docs, text), doc_id, "size", shards, seed, bucket_bytes)
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
