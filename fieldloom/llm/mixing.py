"""Operator 3: mixing sources to target weights.

Words are summed per source (with map-side combination), the weights become targets by
water filling, and every document gets floor(rate) copies and one more by a Bernoulli
draw that hashes seed, with the rate's fraction as its probability.

Independent draws would leave a small source far off its target whenever a long document
is drawn or not.  So documents are drawn in cells (size class and hash bucket), and the
draws of a source's cells are made from the largest on: a cell is drawn with probability
p, which starts as the fraction, and p then moves so that the words expected of the cells
that are left make up for the outcome.  What p moves to is the same on average, so every
document keeps the fraction as its probability, and a source misses its target by about
its smallest cell.

The cells are one histogram of words (at most ``BUCKETS`` cells a doubling of size); nothing
is ordered or collected over documents, and a hot source costs no more than a small one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import WORD, cut, named, packed

#: Weights of the sources by code point, repeating (the contract's).
WEIGHTS = (5.0, 2.0, 1.0)
#: A source's words may be taken this often.
MOST = 3.0
#: Hash buckets of a size class; a multiple of 64.
BUCKETS = 1024
#: Rows of the plan (a source's size classes, 150 bytes each) up to which it is broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS = 100_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row per source (source, source_size) with its target.

    The targets share all words by weight; one that would exceed ``most`` times its
    source's words stops there, and the others share the rest by weight.  In the order
    of cap over weight, those capped come first: with the caps before a source taken out,
    it is capped if its share of what is left still exceeds its cap.  The windows run
    over one row per source.
    """
    # Code points order as UTF-8 bytes do, which is how Spark compares strings; null is last.
    ranked = sizes.withColumn("__rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), (F.col("__rank") - 1) % len(weights) + 1))
    ranked = ranked.withColumn("__cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("__cap") / F.col("__w"), "__rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / (F.sum("__w").over(whole) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("__level", level)
    ranked = ranked.withColumn("__capped", F.col("__level") * F.col("__w") >= F.col("__cap"))
    final = F.min(F.when(~F.col("__capped"), F.struct(F.col("__cap") / F.col("__w"), F.col("__rank"), F.col("__level").alias("level")))).over(whole)["level"]
    return ranked.withColumn("target", F.when(F.col("__capped"), F.col("__cap")).otherwise(F.coalesce(final, F.lit(0.0)) * F.col("__w"))).drop("__rank", "__w", "__cap", "__level", "__capped")


def draw(words: np.ndarray, fraction: float, uniform: np.ndarray) -> np.ndarray:
    """Which of the cells (words, the largest first) are drawn, each with the same probability.

    Cell by cell: if the words left can make up for either outcome, the cell is drawn with
    the present probability p and p moves to meet the outcome.  If not, as much as can be
    moves between the cell and the rest, whose outcome is then settled, and the cell is
    drawn by the probability it has come to.  Every step keeps each cell's expectation.
    """
    out, p = np.zeros(len(words), bool), fraction
    left = float(words.sum())
    for k, (own, u) in enumerate(zip(words.tolist(), uniform.tolist(), strict=True)):
        left -= own
        if p <= 0 or p >= 1:
            out[k:] = p >= 1
            break
        if own <= 0 or left <= 0:  # nothing to balance with
            out[k] = u < p
            continue
        into, back = min((1 - p) * own, p * left), min(p * own, (1 - p) * left)
        first = back / (into + back)
        moved = into if u < first else -back
        q = p + moved / own
        p -= moved / left
        p = 0.0 if p < 1e-12 else 1.0 if p > 1 - 1e-12 else p
        # q is 0 or 1, or the rest is settled and the cell is drawn by what is left of its chance.
        again = u / first if u < first else (u - first) / (1 - first)
        out[k] = q > 1 - 1e-12 or (q > 1e-12 and again < q)
    return out


def _drawn(cells: DataFrame, seed: int) -> DataFrame:
    """(source, class, bits): which buckets of a size class are drawn, as words of 64 bits."""

    def run(t):
        import pyarrow as pa

        t = t.sort_by([("words", "descending"), ("class", "descending"), ("bucket", "ascending")])
        words, kind, bucket, u = (t.column(c).to_numpy() for c in ("words", "class", "bucket", "u"))
        got = draw(words.astype(float), t.column("fraction")[0].as_py(), u)
        names = np.unique(kind)
        bits = np.zeros((len(names), BUCKETS // 64), np.uint64)
        at = np.searchsorted(names, kind)
        np.bitwise_or.at(bits, (at[got], bucket[got] // 64), np.uint64(1) << (bucket[got] % 64).astype(np.uint64))
        source = pa.array([t.column("source")[0].as_py()] * len(names), pa.string())
        return pa.table({"source": source, "class": pa.array(names, pa.int32()), "bits": pa.array(list(bits.view(np.int64)), pa.list_(pa.int64()))})

    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("draw"), "source", "class", "bucket"), 11).cast("double") + 0.5) * 2.0**-53
    return cells.withColumn("u", u).groupBy("source").applyInArrow(run, "source string, class int, bits array<long>")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 7, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """docs with size, source_size, target, copies and taken.

    A null text has size 0 and a null source is a source of its own, last in order.
    Rows that agree in id and text get the same copies; a rerun gives the same ones, and
    another seed another draw.  With no words at all every target is 0, and so are the
    copies; an empty table gives an empty one.  Columns of docs that bear a result's name
    are replaced; other names, whatever they are, stay.
    """
    t = F.coalesce(named(text), F.lit(""))
    hashed = F.pmod(F.xxhash64(F.lit(seed), named(doc_id), t), F.lit(BUCKETS)).cast("int")
    rows = docs.select(packed(docs, "size", "source_size", "target", "copies", "taken"), named(source).cast("string").alias("source"), word_count(t).alias("size"), hashed.alias("bucket"))
    # Doublings of the size: within a class no document has twice the words of another.
    rows = rows.withColumn("class", F.floor(F.log2(F.greatest("size", F.lit(1)))).cast("int"))
    cells = cut(rows.groupBy("source", "class", "bucket").agg(F.sum("size").alias("words")))
    rates = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # Rounding of the target must not open a fourth copy or lose a whole one.
    rates = rates.withColumn("rate", F.least(F.round(rate, 12), F.lit(most)))
    rates = cut(rates.withColumn("whole", F.floor("rate").cast("int")).withColumn("fraction", F.col("rate") - F.floor("rate")).withColumnRenamed("source", "s"))
    few = rates.count() <= BROADCAST_ROWS
    joined = cells.join(F.broadcast(rates) if few else rates, F.col("source").eqNullSafe(F.col("s")))
    drawn = _drawn(joined.select("source", "class", "bucket", "words", "fraction"), seed)
    plan = drawn.join(F.broadcast(rates) if few else rates, F.col("source").eqNullSafe(F.col("s"))).select("s", F.col("class").alias("c"), "bits", "source_size", "target", "whole")
    plan = cut(plan)
    few = plan.count() <= BROADCAST_ROWS
    out = rows.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")), "left")
    more = F.getbit(F.get("bits", F.floor(F.col("bucket") / 64).cast("int")), F.col("bucket") % 64).cast("int")
    out = out.withColumn("copies", F.col("whole") + more)
    return out.select("own.*", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def emit(mixed: DataFrame) -> DataFrame:
    """Each row as often as its copies say, with its number from 1 as ``copy``."""
    kept = mixed.filter("copies > 0")
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
