"""Operator 11: spelling variants by merging the errata of a trie.

Words that are one inserted, deleted or replaced character apart part ways at one node of
the trie of all words, the one of their longest common prefix.

1. Words are counted over all documents, combined on the map side; what follows works on
   the vocabulary alone.
2. Every node knows how many words go through each of its children; the child with the
   most is heavy, the others (and the end of a word) are light.  On its way a word takes a
   light step at no more than log2 of the number of words, for each at least halves the
   words that are left.
3. Small to large: only words in light subtrees are copied, for each light step
   * with the character skipped, which meets the one-shorter words anywhere;
   * with the heavy child's character in its place, or before it, which meets the words
     of the heavy subtree;
   * with the character left open, which meets the other light subtrees.
   Where a copy ends on a word, or two copies with the same place open end alike, the two
   are one edit apart; each pair is met exactly once.
4. Words of one open copy differ in one character, so there are at most as many as the
   alphabet has letters; their number and their most frequent word serve them all, and no
   pairs within are written.
5. Chains of forms are followed by pointer jumping; counts grow along a chain at least
   by the ratio, so that few rounds suffice.

A node is named by a hash of its prefix.  Should two nodes share a hash, the heavy child is
chosen for both; every choice of heavy children gives the same pairs, only at other cost.
Nodes near the root, which a third of all words may pass, are combined and salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import ascii_lower, cut, named, salted_join

#: Least code points and occurrences of a word, least ratio of counts to a form, and the mutation's modulus (the contract's).
LETTERS, OFTEN, RATIO, MUTATED = 6, 5, 5, 199
#: What separates runs in lower-cased texts (fixed value).
NO_LETTER = r"[^a-zÀ-ÿ]+"
#: Branching nodes (two numbers and a character) up to which their table is broadcast.
FEW = 200_000
#: Modulus (a Mersenne prime) and base of the prefix hashes.
_PRIME, _BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E681


def mutated(doc_id: Column, run: Column, modulus: int) -> Column:
    """The run without one code point, if the crc32 of id and run says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % modulus == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", letters: int = LETTERS, often: int = OFTEN, modulus: int | None = MUTATED) -> DataFrame:
    """(word, n): lower-cased runs of letters of whole texts with their occurrences.

    With a modulus some runs lose a code point first.  Null texts have no runs; a null id
    is written as empty text; repeated rows each count.
    """
    runs = docs.select(named(doc_id).alias("id"), F.explode(F.split(ascii_lower(named(text)), NO_LETTER)).alias("run")).filter(F.length("run") >= letters)
    word = F.col("run") if modulus is None else mutated(F.col("id"), F.col("run"), modulus)
    return runs.select(word.alias("word")).filter(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= often)


def steps(words: DataFrame) -> DataFrame:
    """(wid, at, node, c): each word's way through the trie; its end is a step with c empty."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, ats, nodes, chars = [], [], [], []
            for wid, word in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                node = 1
                for at, c in enumerate(word):
                    nodes.append(node)
                    chars.append(c)
                    node = (node * _BASE + ord(c) + 1) % _PRIME
                nodes.append(node)
                chars.append("")
                ids.extend([wid] * (len(word) + 1))
                ats.extend(range(len(word) + 1))
                if len(ids) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ats, pa.int32()), pa.array(nodes, pa.int64()), pa.array(chars, pa.string())], names=["wid", "at", "node", "c"])
                    ids, ats, nodes, chars = [], [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ats, pa.int32()), pa.array(nodes, pa.int64()), pa.array(chars, pa.string())], names=["wid", "at", "node", "c"])

    return words.select("wid", "word").mapInArrow(run, "wid long, at int, node long, c string")


def light_steps(words: DataFrame) -> DataFrame:
    """(wid, at, heavy): the steps that leave the heavy path, with the heavy child's character."""
    way = cut(steps(words))
    sizes = way.groupBy("node", "c").agg(F.count("*").alias("n"))
    nodes = cut(sizes.groupBy("node").agg(F.max(F.struct((F.col("c") != "").alias("goes_on"), "n", "c"))["c"].alias("heavy"), F.count("*").alias("kids"), F.sum("n").alias("n")).filter("kids > 1"))
    met = salted_join(way, nodes.select("node", "heavy"), "node", "wid", nodes.select("node", "n"), FEW)
    return met.filter("c != heavy").select("wid", "at", "heavy")


def near_words(words: DataFrame) -> DataFrame:
    """(wid, n_near, form, form_n): how many words are one edit away, and the most frequent of them.

    words has (wid, word, n), each word once.  Ties go to the smallest word in code points.
    """
    light = light_steps(words).groupBy("wid").agg(F.collect_list(F.struct("at", "heavy")).alias("light"))  # few a word
    each = words.join(light, "wid").select("wid", "word", "n", F.explode("light").alias("x")).select("wid", "word", "n", "x.*")
    head, c = F.substring("word", F.lit(1), F.col("at")), F.substring("word", F.col("at") + 1, F.lit(1))
    tail = F.substring("word", F.col("at") + 2, F.length("word"))
    each = cut(each.select("wid", "word", "n", "at", "heavy", head.alias("head"), c.alias("c"), tail.alias("tail")))
    goes_on, both = F.col("c") != "", F.concat("head", "tail")
    skipped = F.when(goes_on & (F.substring("tail", 1, 1) != F.col("c")), both)  # of equal letters in a row the last is skipped
    replaced = F.when(goes_on, F.concat("head", "heavy", "tail"))
    longer = F.concat("head", "heavy", "c", "tail")
    copies = each.select("wid", "word", "n", F.explode(F.array(skipped, replaced, longer)).alias("copy")).filter("copy is not null")
    there = words.select(F.col("wid").alias("wid2"), F.col("word").alias("copy"), F.col("n").alias("n2"))
    pairs = cut(copies.join(there, "copy"))
    best = lambda n, word: F.struct((-F.col(n)).alias("less"), F.col(word).alias("form")).alias("best")
    near = pairs.select("wid", F.lit(1).alias("k"), best("n2", "copy")).unionByName(pairs.select(F.col("wid2").alias("wid"), F.lit(1).alias("k"), best("n", "word")))
    alike = each.filter(goes_on).groupBy("at", both.alias("both")).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), F.col("word").alias("form"), "wid"))).alias("all")).filter(F.size("all") > 1)
    first = lambda k: F.struct(F.col("all")[k]["less"].alias("less"), F.col("all")[k]["form"].alias("form"))
    one = alike.select(F.posexplode(F.col("all.wid")).alias("rank", "wid"), (F.size("all") - 1).alias("k"), first(0).alias("first"), first(1).alias("second"))
    near = near.unionByName(one.select("wid", "k", F.when(F.col("rank") == 0, F.col("second")).otherwise(F.col("first")).alias("best")))
    out = near.groupBy("wid").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))
    return out.select("wid", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: the last word of the chain (word, form)."""
    t = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = t.select(F.col("word").alias("root"), F.col("root").alias("further"))
        t = cut(t.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if t.filter("moved").isEmpty():
            return t.select("word", "root")
        t = t.select("word", "root")


def group_variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Each word (word, n) with form, root, n_near and form_n.

    A word's form is its most frequent near word, if that is at least ``ratio`` times as
    frequent, and else null; its root ends the chain of forms and is the word itself where
    there is none.  Null and repeated words must have been counted away; an empty table
    gives an empty one.
    """
    words = cut(counts.select("word", "n").withColumn("wid", F.monotonically_increasing_id()))
    near = cut(words.join(near_words(words), "wid", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form_n") >= ratio * F.col("n"), F.struct("form", "form_n")).alias("f")))
    near = near.select("word", "n", "n_near", "f.form", "f.form_n")
    chain = roots(near.filter("form is not null"))
    return near.join(chain, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", letters: int = LETTERS, often: int = OFTEN, ratio: int = RATIO, modulus: int | None = MUTATED) -> DataFrame:
    """The variants of all words of docs, a row per word; see ``word_counts`` and ``group_variants``.

    Other columns of docs are not read.  Texts without a word that is long and frequent
    enough, null and empty ones give no rows.
    """
    return group_variants(word_counts(docs, text, doc_id, letters, often, modulus), ratio)
