"""Operator 8: benchmark decontamination by a prefix-filtered join, in DataFrame functions only.

A benchmark item occurs in a document where a window of its words (``WINDOW`` of them, or
all of a shorter item) stands there word by word.  Containment of a whole window means
that its rarest word must occur too, so one word of each window is the necessary prefix:

1. The words of the benchmark are counted over all documents (rarity order).
2. Each window's rarest word is its anchor; neighbouring windows share most anchors, so
   an item has one for about every five words.
3. The documents' words, exploded with their positions, meet the anchors in one join;
   bounds on what can still fit left and right and the words beside the anchor are
   tested there and then.
4. What is left is verified word by word, as far as windows that hold the anchor reach.

The anchors are broadcast only while there are at most ``BROADCAST_ANCHORS``; texts then
never leave their task and only verified hits are shuffled.  Beyond, each document word
is shuffled with the few words around it, and skewed words are split at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import ascii_lower, cut, named, packed

#: What separates words: all ASCII but digits and letters (fixed value).
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Anchors up to which they are broadcast: at most 2 x WINDOW words each.
BROADCAST_ANCHORS = 100_000


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), NO_WORD), "")


def _full(text: str) -> Column:
    return F.coalesce(named(text), F.lit(""))


def anchors(benchmark: DataFrame, docs: DataFrame, text: str = "text", item_id: str = "item_id", window: int = WINDOW) -> DataFrame:
    """One row per anchor: its word, its item, the words left (nearest first) and right, and the run needed."""
    items = benchmark.select(named(item_id).cast("string").alias("item"), tokens(_full(text)).alias("w")).filter(F.size("w") > 0)
    items = cut(items.groupBy("w").agg(F.collect_set("item").alias("items")).withColumn("n", F.size("w")))
    vocabulary = items.select(F.explode("w").alias("word")).distinct()
    few = vocabulary.count() <= BROADCAST_ANCHORS
    seen = docs.select(F.explode(tokens(_full(text))).alias("word"))
    counts = cut(seen.join(F.broadcast(vocabulary) if few else vocabulary, "word").groupBy("word").agg(F.count("*").alias("seen")))
    key = items.select(F.xxhash64("w").alias("key"), "w", "n", "items")
    places = key.select("key", "n", F.posexplode("w").alias("at", "word")).join(F.broadcast(counts) if few else counts, "word", "left")
    rank = F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), F.col("word").alias("word"), F.col("at").alias("at"))
    # The rarest place of each window; ordering by rarity, then by the word itself.
    ahead = Window.partitionBy("key").orderBy("at").rowsBetween(0, window - 1)
    rarest = places.withColumn("low", F.min(rank).over(ahead)).filter(F.col("at") <= F.greatest(F.col("n") - window, F.lit(0)))
    chosen = rarest.select("key", F.col("low.at").alias("at")).distinct()
    at, w = F.col("at"), F.col("w")
    return chosen.join(key, "key").select(
        F.get("w", "at").alias("anchor"),
        "items",
        F.reverse(F.slice(w, F.greatest(at - window + 2, F.lit(1)), F.least(at, F.lit(window - 1)))).alias("item_left"),
        F.slice(w, at + 2, F.lit(window - 1)).alias("item_right"),
        F.least(F.col("n"), F.lit(window)).alias("need"),
    )


def _around(df: DataFrame, window: int) -> DataFrame:
    """The document's words left (nearest first) and right of a position, within a window's reach."""
    p = F.col("__at")
    return df.withColumns({
        "__left": F.reverse(F.slice("__w", F.greatest(p - window + 2, F.lit(1)), F.least(p, F.lit(window - 1)))),
        "__right": F.slice("__w", p + 2, F.lit(window - 1)),
    }).drop("__w")


def _common(a: str, b: str) -> Column:
    """Length of the common prefix of two arrays without nulls."""
    off = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(off == 0, F.size(a)).otherwise(off - 1).cast("int")


def occurrences(docs: DataFrame, found: DataFrame, keys: list[Column], text: str = "text", window: int = WINDOW) -> DataFrame:
    """Verified hits: the keys of the document, the items and the first and last word of the run."""
    few = found.count() <= BROADCAST_ANCHORS
    words = docs.select(*keys, tokens(_full(text)).alias("__w"))
    names = words.columns[:-1]
    rows = words.select(*names, "__w", F.size("__w").alias("__n"), F.posexplode("__w").alias("__at", "__word"))
    rows = rows.withColumns({"__next": F.get("__w", F.col("__at") + 1), "__prev": F.when(F.col("__at") > 0, F.get("__w", F.col("__at") - 1))})
    # Only the words around a place go on: a row for each place must not hold its whole text.
    rows = _around(rows, window)
    reach = F.least(F.col("__at"), F.size("item_left")) + F.least(F.col("__n") - F.col("__at") - 1, F.size("item_right")) + 1
    # A run of one word needs no neighbour; a longer one goes on at one side at least.
    beside = (F.col("need") == 1) | F.col("__next").eqNullSafe(F.get("item_right", F.lit(0))) | F.col("__prev").eqNullSafe(F.get("item_left", F.lit(0)))
    on = (F.col("__word") == F.col("anchor")) & (reach >= F.col("need")) & beside
    met = rows.join(F.broadcast(found) if few else found, on)
    met = met.withColumns({"__l": _common("item_left", "__left"), "__r": _common("item_right", "__right")})
    met = met.filter(F.col("__l") + F.col("__r") + 1 >= F.col("need"))
    return met.select(*names, "items", (F.col("__at") - F.col("__l")).alias("first"), (F.col("__at") + F.col("__r")).alias("last"))


def _covered(spans: Column) -> Column:
    """How many places sorted spans cover together."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end"))

    def add(s: Column, x: Column) -> Column:
        return F.struct((s["n"] + F.greatest(x["last"] - F.greatest(x["first"] - 1, s["end"]), F.lit(0))).alias("n"), F.greatest(x["last"], s["end"]).alias("end"))

    return F.aggregate(spans, start, add)["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", window: int = WINDOW) -> DataFrame:
    """One row per contaminated document (id and text hash): spans hit, n_hit and the items.

    Null and empty texts and items have no words: they are never hit and hit nothing.
    Items without an id hit words but are not listed.  Repeated rows, which agree in id
    and text, share one row here.
    """
    keys = [named(doc_id).alias("__id"), F.xxhash64(_full(text)).alias("__th")]
    found = cut(anchors(benchmark, docs, text, item_id, window))
    hits = occurrences(docs, found, keys, text, window)
    spans = F.sort_array(F.collect_set(F.struct("first", "last")))
    return hits.groupBy("__id", "__th").agg(spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")).withColumn("n_hit", _covered(F.col("spans")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", window: int = WINDOW) -> DataFrame:
    """docs, whole rows, with n_words, n_hit, n_items, items, spans and contaminated.

    Every row of docs comes back once; columns of docs that bear a result's name are
    replaced, other names, whatever they are, stay; an empty benchmark or table gives rows
    without hits, or no rows.
    """
    names = ("n_words", "n_hit", "n_items", "items", "spans", "contaminated")
    rows = docs.select(packed(docs, *names), named(doc_id).alias("id"), F.xxhash64(_full(text)).alias("hash"), F.size(tokens(_full(text))).cast("long").alias("n_words"))
    hits = contamination(docs, benchmark, text, doc_id, item_id, window)
    out = rows.join(hits, F.col("id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__th")), "left")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.select("own.*", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans", (F.col("n_hit") > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", window: int = WINDOW) -> DataFrame:
    """docs, whole rows and columns, without those in which a window of an item occurs.

    Null and empty texts stay; rows that agree in id and text share their verdict; an empty
    benchmark takes nothing.
    """
    hits = contamination(docs, benchmark, text, doc_id, item_id, window).select("__id", "__th")
    rows = docs.select(packed(docs), named(doc_id).alias("id"), F.xxhash64(_full(text)).alias("hash"))
    return rows.join(hits, F.col("id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__th")), "left_anti").select("own.*")
