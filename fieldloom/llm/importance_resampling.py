"""Operator 13: resampling towards a target distribution by importance weights, in DataFrame functions only.

A document's features are its runs of consecutive words, hashed to buckets by crc32.

1. Both tables' feature arrays are exploded and counted per bucket (combined on the map
   side: at most ``buckets`` rows leave a task).
2. A bucket's gain is the scaled log ratio of its smoothed shares in target and corpus.
   The table has one row a bucket, a number that a parameter fixes, and is broadcast.
3. The documents' features meet the gains where they are; a document's gains are summed
   on the map side, so that one narrow row a document is shuffled and no text is.
4. The scores, weights plus a Gumbel number that hashes seed and id, are sorted across
   partitions.  A rank is the place in a partition plus the rows of the partitions before,
   so that no task sees more than its range.  Taking the highest of such scores draws
   without replacement by weight.

Rows that agree in id and text are scored once, with their number, and dealt out again
before the sort; so one id or text that a third of all rows share costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import cut, named, packed
from fieldloom.llm.decontamination import tokens

#: Buckets, scale of the logarithms, share drawn (percent), words a document must have, and seed (the contract's).
BUCKETS, SCALE, PERCENT, LEAST_WORDS, SEED = 10_000, 1000, 10, 20, 2024


def ngrams(words: str, least: int, most: int) -> Column:
    """All runs of least to most words of a column of word arrays, joined by one space."""
    if least == most == 1:
        return F.col(words)

    def runs(n: int) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))
        return F.when(F.size(words) >= n, each).otherwise(F.array().cast("array<string>"))

    return F.concat(*[runs(n) for n in range(least, most + 1)])


def bucket_of(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def bucket_counts(df: DataFrame, text: str, least: int, most: int, buckets: int) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket that any falls into."""
    words = df.select(tokens(F.coalesce(named(text), F.lit(""))).alias("w"))
    return words.select(F.explode(ngrams("w", least, most)).alias("f")).groupBy(bucket_of(F.col("f"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for the buckets of the corpus: floor(scale ln(share in target / share in corpus)), shares smoothed by one."""
    total = lambda df, name: df.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias(name))  # noqa: E731  one row
    both = corpus.select("bucket", F.col("n").cast("double").alias("s")).join(target.select("bucket", F.col("n").cast("double").alias("t")), "bucket", "left").na.fill(0.0, ["t"])
    both = both.join(F.broadcast(total(corpus, "all_s"))).join(F.broadcast(total(target, "all_t")))
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return both.select("bucket", F.floor(SCALE * F.log(ratio)).cast("long").alias("gain"))


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-scale ln(-ln u)), u from the first 32 bits of sha256 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scored(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text", least: int = 1, most: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """One row per id and text: id, digest of the text, copies (rows that agree in both), n_words, n_features, weight, score."""
    counted = cut(bucket_counts(docs, text, least, most, buckets))
    table = gains(counted, cut(bucket_counts(target, target_text, least, most, buckets)), buckets)
    t = F.coalesce(named(text), F.lit(""))
    rows = docs.select(named(doc_id).alias("id"), F.unhex(F.sha2(t.cast("binary"), 256)).alias("digest"), tokens(t).alias("w"))
    each = rows.select("id", "digest", F.size("w").alias("n_words"), F.posexplode_outer(ngrams("w", least, most)).alias("at", "f"))
    each = each.withColumn("bucket", bucket_of(F.col("f"), buckets)).join(F.broadcast(table), "bucket", "left")
    one = F.coalesce(F.col("at") == 0, F.lit(True)).cast("long")
    sums = each.groupBy("id", "digest").agg(F.first("n_words").cast("long").alias("n_words"), F.sum(one).alias("copies"), F.count("f").alias("n"), F.coalesce(F.sum("gain"), F.lit(0)).alias("sum"))
    weight = F.when(F.col("n") > 0, F.expr("(sum - pmod(sum, n)) div n")).otherwise(F.lit(0)).cast("long")
    out = sums.select("id", "digest", "copies", "n_words", F.expr("n div copies").alias("n_features"), weight.alias("weight"))
    return out.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))


def ranked(scores: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """A row per document, copies dealt out: scores' columns and rank, 1 for the highest score, null if not drawn.

    Of the documents with least_words words the highest percent are drawn, ties to the
    smaller id, null ids last; rows that agree in all are ranked in any order.
    """
    scores = cut(scores)
    rows = scores.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    may = F.col("n_words") >= least_words
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("digest"), F.col("copy")]
    # Written where it is sorted: the place within a partition then holds for all that read it.
    sorted_ = cut(rows.filter(may).orderBy(*order).withColumn("place", F.monotonically_increasing_id()))
    part, at = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = sorted_.groupBy(part.alias("part")).agg(F.count("*").alias("size"))  # a row a partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"), F.sum("size").over(Window.partitionBy(F.lit(0))).alias("total"))
    rank = F.col("before") + at + 1
    here = sorted_.withColumn("part", part).join(F.broadcast(offsets), "part")
    drawn = here.withColumn("rank", F.when(rank <= F.expr(f"total * {int(percent)} div 100"), rank))
    rest = rows.filter(~F.coalesce(may, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(*rest.columns).unionByName(rest)


def importance(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text", least: int = 1, most: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """One row per row of docs: the id, n_features, weight, score and rank (null: not drawn).

    A null or empty text has no features and weight 0, and cannot be drawn; a null id is
    hashed as empty text and comes last among ties.  Repeated rows each come back, with
    ranks of their own.  An empty target leaves its shares to the smoothing; an empty docs
    gives an empty table.  No other columns of docs are read.
    """
    out = ranked(scored(docs, target, text, doc_id, target_text, least, most, buckets, seed), percent, least_words)
    return out.select(F.col("id").alias(doc_id), "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text", least: int = 1, most: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The rows of docs that are drawn, whole, with their weight and score.

    Where the last rank falls between rows that agree in id and text, as many of them stay
    as ranks are left, any of them.  Columns of docs that bear a result's name are
    replaced; other names, whatever they are, stay.
    """
    drawn = ranked(scored(docs, target, text, doc_id, target_text, least, most, buckets, seed), percent, least_words).filter("rank is not null")
    drawn = cut(drawn.groupBy("id", "digest").agg(F.first("copies").alias("copies"), F.count("*").alias("taken"), F.first("weight").alias("weight"), F.first("score").alias("score")))
    digest = F.unhex(F.sha2(F.coalesce(named(text), F.lit("")).cast("binary"), 256))
    rows = docs.select(packed(docs, "weight", "score"), named(doc_id).alias("i"), digest.alias("d"))
    pick = lambda keys: rows.join(keys, F.col("i").eqNullSafe(F.col("id")) & (F.col("d") == F.col("digest"))).select("own.*", "weight", "score")
    out, last = pick(drawn.filter("taken = copies")), drawn.filter("taken < copies").first()  # ranks are consecutive: one at most
    if last is not None:
        out = out.unionByName(pick(F.broadcast(drawn.filter("taken < copies"))).limit(last["taken"]))
    return out
