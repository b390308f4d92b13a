"""Operator 7: near-duplicates by HyperMinHash, with every link confirmed on full sets.

A document's set holds its distinct word shingles.  A sketch has ``BUCKETS`` registers; a
register is the minimum of the set under the bucket's own hash, kept as its number of
leading zeros and ``MANTISSA`` bits after them (16 bits in all).  Every bucket sees the
whole set, rather than a share of it, so that short documents leave no register empty.

1. Documents with equal sets form classes; only the smallest id of a class goes on.
2. Bands of registers are hashed to keys; a key that two classes share makes them meet.
   At a similarity of 0.8 a pair is missed by all bands with a chance of 5e-8.
3. Stars: of all classes with a key, the one that meets the most others anywhere is
   paired with the rest.  Pairs pass a bound on sizes and the collision-corrected estimate
   of the similarity (five deviations below the threshold, so that it costs no links),
   and are then verified on their full sets.  The links make components.
4. Where a key's classes are still apart, each class outside the largest component asks
   for the best estimate of another.  One that finds none has no link across components.
5. For those that find one, the keys are searched in full, block by block: every
   pair across components that the estimate lets pass is checked on small hashes of the
   full sets, and verified.  So no link is lost, and the pairs within a group of copies,
   which are already connected, never appear.

Every step is a join or an aggregation on ids or keys.  A set, a key or a centre that a
third of all rows share is combined before its shuffle, and salted where it is joined.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.common import cut, named, packed, salted_join

BUCKETS, ROWS = 128, 4
#: Bits kept after the leading one of a register's minimum.
MANTISSA = 10
#: Deviations below the threshold at which the estimate still lets a pair pass.
SLACK = 5.0
#: Rows of a key's block in the search across components.
BLOCK = 1000
#: Elements that are hashed at once.
CHUNK = 8192
#: Rows of two or three numbers, and of sketches (300 bytes), up to which a table of keys is broadcast.
FEW, FEW_SKETCHES = 200_000, 20_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240607)
_A = _RNG.integers(0, 1 << 63, BUCKETS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BUCKETS, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """128 bits of blake2b of each word met, kept while they are not too many."""

    MOST = 500_000

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = hashlib.blake2b(word, digest_size=16).digest()
        return h


class Shingler:
    """Hashes of a text's distinct shingles: strong hashes of its words, mixed in order.

    Sketches and candidates rest on them; links do not, see ``Pairs``.
    """

    def __init__(self, width: int):
        self.width = width
        self.words = _WordHashes()

    def both(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each distinct shingle, sorted by the first.

        Shorter texts are one shingle, and those without words have none.
        """
        words = text_words(text)
        if not words:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        w = np.frombuffer(b"".join([self.words[x] for x in words]), np.uint64).reshape(-1, 2)
        k = min(self.width, len(words))
        n = len(words) - k + 1
        h = np.full((n, 2), np.uint64(k))
        for j in range(k):
            h = _mix(h * _STEP + w[j : j + n])
        first, at = np.unique(h[:, 0], return_index=True)
        return first, h[at, 1]

    def shingles(self, text: str | None) -> np.ndarray:
        """The first hashes, sorted."""
        return self.both(text)[0]


def text_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


class Pairs:
    """Whether two texts are linked, decided on their shingles themselves.

    Words get numbers by a dictionary and shingles numbers by rank, so nothing is hashed.
    The left text, which many pairs in a row share, is numbered once.
    """

    def __init__(self, width: int, percent: int):
        self.width, self.percent, self.left = width, percent, None

    def linked(self, key, left: str, right: str) -> bool:
        if self.left is None or self.left[0] != key:
            number: dict[bytes, int] = {}
            own = [number.setdefault(w, len(number)) for w in text_words(left)]
            self.left = (key, number, np.array(own, np.int64))
        _, number, own = self.left
        more: dict[bytes, int] = {}
        words = text_words(right)
        other = np.array([number[w] if w in number else more.setdefault(w, len(number) + len(more)) for w in words], np.int64)
        if not len(own) or not len(other) or min(len(own), self.width) != min(len(other), self.width):
            return False
        k = min(len(own), self.width)
        rank = np.concatenate((own, other))
        at, split = rank, len(own)
        for j in range(1, k):  # the rank of each run of j+1 words; runs over the seam are cut off below
            _, rank = np.unique((rank[: len(at) - j] << 32) | at[j:], return_inverse=True)
        a, b = np.unique(rank[: split - k + 1]), np.unique(rank[split:])
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= self.percent * (len(a) + len(b) - both)


def sketch(x: np.ndarray) -> np.ndarray:
    """The registers of a set of at least one hash."""
    low = np.full(BUCKETS, np.iinfo(np.uint64).max)
    for i in range(0, len(x), CHUNK):
        low = np.minimum(low, (x[None, i : i + CHUNK] * _A[:, None] + _B[:, None]).min(1))
    _, exponent = np.frexp((low >> np.uint64(11)).astype(np.float64))
    zeros = np.uint64(53) - exponent.astype(np.uint64)
    after = (low << np.minimum(zeros, np.uint64(63))) << np.uint64(1)
    return ((zeros << np.uint64(MANTISSA)) | (after >> np.uint64(64 - MANTISSA))).astype(np.uint16)


def band_keys(registers: np.ndarray) -> np.ndarray:
    words = registers.astype(np.uint64).reshape(-1, ROWS)
    h = np.arange(len(words), dtype=np.uint64)
    for j in range(ROWS):
        h = _mix(h * np.uint64(0x100000001B3) + words[:, j] + np.uint64(1))
    return h.view(np.int64)


def collision(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that the registers of disjoint sets of n and m elements agree.

    A minimum of n hashes is near to exponential with rate n; the chance is summed over
    the cells (leading zeros, mantissa) by the density at each doubling's middle.
    """
    total = np.zeros(len(n))
    cells = float(1 << MANTISSA)
    for zeros in range(54):
        width = 2.0 ** -(zeros + 1)
        for part in (0.125, 0.375, 0.625, 0.875):
            at = width * (1 + part)
            total += 0.25 / cells * (n * width * np.exp(-n * at)) * (m * width * np.exp(-m * at))
    return total


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of rows of registers."""
    agree = (a == b).mean(1)
    c = collision(n.astype(float), m.astype(float))
    return np.clip((agree - c) / (1 - c), 0.0, 1.0)


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    """Per document (id, hash, text) its id, hash, set size, the set's fingerprint, registers and band keys."""
    schema = T.StructType([docs.schema["id"], docs.schema["hash"], T.StructField("n", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("regs", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches):
        import pyarrow as pa

        shingler = Shingler(width)
        for b in batches:
            sets = (shingler.both(t) for t in b.column(2).to_pylist())
            rows = [(len(s), hashlib.blake2b(s.tobytes() + more.tobytes(), digest_size=16).digest(), (r := sketch(s)).tobytes(), band_keys(r)) if len(s) else (0, None, None, None) for s, more in sets]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=schema.names)

    return docs.select("id", "hash", "text").mapInArrow(run, schema)


def _least_estimate(percent: int) -> float:
    j = percent / 100
    return j - SLACK * (j * (1 - j) / BUCKETS) ** 0.5


def _estimated(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb, ra, rb) whose estimate comes near the threshold, as (a, b)."""
    least = _least_estimate(percent)
    schema = pairs.select("a", "b").schema

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n, m = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(-1, BUCKETS) for k in (4, 5))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(estimate(x, y, n, m) >= least))

    fits = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.col("a") != F.col("b"))
    return pairs.filter(fits).select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, schema)


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs that 100 * intersection >= percent * union confirms on their full sets, word by word."""
    pairs = cut(pairs)
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    rows = salted_join(pairs.join(right, "b"), left, "a", "b", pairs.groupBy("a").agg(F.count("*").alias("n"))).select("a", "b", "ta", "tb")

    def run(batches):
        import pyarrow as pa

        pairs = Pairs(width, percent)
        for batch in batches:
            keep = [pairs.linked(a, ta, tb) for a, ta, tb in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, pairs.select("a", "b").schema)


def _compact(df: DataFrame) -> DataFrame:
    """A checkpointed table in as many partitions as its rows are worth, at least eight."""
    return df.coalesce(max(8, df.count() // 200_000))


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: those of the graph whose nodes are the old components."""
    if links.isEmpty():
        return found
    for side in ("a", "b"):
        links = links.join(found.select(F.col("id").alias(side), F.col("component").alias(f"c{side}")), side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    links = _compact(cut(links))
    new = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")).filter("a != b").distinct())
    alone = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    every = found.unionByName(alone.join(found, "id", "left_anti").withColumn("component", F.col("id")))
    every = every.join(new.select(F.col("id").alias("component"), F.col("component").alias("low")), "component", "left")
    return cut(every.select("id", F.coalesce("low", "component").alias("component")))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each end of an edge (a, b) reaches.

    Labels take the minimum over neighbours and then jump to their label's label, until
    none changes; each round ends in a checkpoint.
    """
    both = _compact(cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()))
    labels = _compact(cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c"))))
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), F.col("c").alias("cb")), "b").groupBy("a").agg(F.min("cb").alias("cb"))
        step = labels.join(near, "a").select("a", "c", F.least("c", "cb").alias("low"))
        jump = labels.select(F.col("a").alias("low"), F.col("c").alias("cc"))
        moved = _compact(cut(step.join(jump, "low").select("a", "c", F.least("low", "cc").alias("new"))))
        labels = moved.select("a", F.col("new").alias("c"))
        if moved.filter("new != c").isEmpty():
            return labels.select(F.col("a").alias("id"), F.col("c").alias("component"))


def _star(keyed: DataFrame, shared: DataFrame) -> DataFrame:
    """Of each key's classes, the one that meets the most others paired with the rest."""
    centre = keyed.groupBy("key").agg(F.max(F.struct("met", (-F.col("id")).alias("low"), "id")).alias("centre"))
    each = salted_join(keyed, cut(centre.select("key", F.col("centre.id").alias("a"))), "key", "id", shared, FEW)
    return each.filter("a != id").select("a", F.col("id").alias("b")).distinct()


def _apart(keyed: DataFrame, found: DataFrame, asking: DataFrame | None = None) -> DataFrame:
    """Rows of keys whose classes lie in several components, dealt into blocks.

    Those that ask are the classes outside a key's largest component, or the ones given.
    Every block of them meets every block of all, so that no task holds more than two.
    """
    rows = keyed.select("key", "band", "id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    if asking is not None:
        rows = rows.join(asking.withColumn("asks", F.lit(True)), "id", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
        asked = F.sum(F.when(F.col("asks"), 1).otherwise(0))
    else:
        rows, asked = rows.withColumn("asks", F.lit(False)), F.lit(0)
    sizes = rows.groupBy("key", "component").agg(F.count("*").alias("c"), asked.alias("asked"))
    sizes = sizes.groupBy("key").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("all"), F.sum("asked").alias("asked"))
    n = F.col("all") - F.col("top.c") if asking is None else F.col("asked")
    mixed = sizes.filter(F.col("top.c") < F.col("all")).filter(n > 0)
    mixed = mixed.select("key", F.col("top.component").alias("major"), F.ceil(n / BLOCK).cast("int").alias("is"), F.ceil(F.col("all") / BLOCK).cast("int").alias("js"))
    rows = rows.join(mixed, "key")
    if asking is None:
        rows = rows.withColumn("asks", F.col("component") != F.col("major"))
    own = F.pmod(F.xxhash64(F.lit(5), "id"), F.col("js")).cast("int")
    as_any = rows.select("*", F.lit(False).alias("query"), F.explode(F.sequence(F.lit(0), F.col("is") - 1)).alias("i"), own.alias("j"))
    turn = F.pmod(F.xxhash64(F.lit(6), "id"), F.col("is")).cast("int")
    as_query = rows.filter("asks").select("*", F.lit(True).alias("query"), turn.alias("i"), F.explode(F.sequence(F.lit(0), F.col("js") - 1)).alias("j"))
    return as_any.unionByName(as_query).select("key", "i", "j", "query", "band", "id", "component", "asks")


def _small_sets(texts: DataFrame, width: int) -> DataFrame:
    """(id, set): the low 32 bits of the hashes of full sets."""
    schema = T.StructType([texts.schema["id"], T.StructField("set", T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        shingler = Shingler(width)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingler.shingles(t).astype(np.uint32).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["id", "set"])

    return texts.select("id", "text").mapInArrow(run, schema)


def _across(apart: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs across components whose sizes and estimate fit, each once.

    Either each asking class's best estimate alone, or all pairs that their sets of 32-bit
    hashes leave possible (two elements of slack cover any clash of hashes; what passes is
    verified on full sets).  A pair that shares several keys is taken in the first band
    that agrees.
    """
    least, clash = _least_estimate(percent), float(collision(np.array([1e3]), np.array([1e3]))[0])
    schema = T.StructType([T.StructField("a", apart.schema["id"].dataType), T.StructField("b", apart.schema["id"].dataType), T.StructField("e", T.DoubleType())])

    def possible(own: np.ndarray, others: list[bytes]) -> np.ndarray:
        sizes = np.array([len(x) // 4 for x in others])
        both = np.add.reduceat(np.isin(np.frombuffer(b"".join(others), np.uint32), own).astype(np.int64), np.concatenate(([0], np.cumsum(sizes)[:-1]))) + 2
        return 100 * both >= percent * (len(own) + sizes - both)

    def block(t) -> list[tuple]:
        query, ids, comp, asks, n = (t.column(k).to_numpy(zero_copy_only=False) for k in ("query", "id", "component", "asks", "n"))
        regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), np.uint16).reshape(-1, BUCKETS)
        sets = None if nearest else t.column("set").to_pylist()
        any_ = np.flatnonzero(~query)
        band, out = t.column("band")[0].as_py(), []
        for q in np.flatnonzero(query):
            fits = (comp[any_] != comp[q]) & (100 * np.minimum(n[any_], n[q]) >= percent * np.maximum(n[any_], n[q]))
            if not nearest:  # two that both ask meet twice
                fits &= ~asks[any_] | (ids[any_] > ids[q])
            to = any_[fits]
            if not len(to):
                continue
            same = regs[to] == regs[q]
            e = (same.mean(1) - clash) / (1 - clash)
            good = (e >= least) & (same.reshape(len(to), -1, ROWS).all(2).argmax(1) == band)
            to, e = to[good], e[good]
            if nearest and len(to):
                e, to = e[[k := int(e.argmax())]], to[[k]]
            elif len(to):
                fit = possible(np.frombuffer(sets[q], np.uint32), [sets[k] for k in to])
                to, e = to[fit], e[fit]
            if len(to):
                out.append((np.full(len(to), ids[q]), ids[to], e))
        return out

    def run(batches):
        import pyarrow as pa

        held = None
        for b in _with_end(batches):
            if b is not None:
                held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if held is None or not held.num_rows:
                continue
            keys = np.stack([held.column(k).to_numpy() for k in ("key", "i", "j")])
            starts = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1))
            ends = np.append(starts[1:], held.num_rows)
            upto = len(starts) if b is None else len(starts) - 1  # the last group may go on
            found = [x for s, e in zip(starts[:upto], ends[:upto], strict=True) for x in block(held.slice(s, e - s).combine_chunks())]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in range(3)], names=["a", "b", "e"])
            held = held.slice(starts[-1]) if b is not None else None

    dealt = apart.select("key", "i", "j", "query", "band", "id", "component", "asks", "n", "regs", *([] if nearest else ["set"]))
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    pairs = dealt.mapInArrow(run, schema)
    if nearest:
        pairs = pairs.groupBy("a").agg(F.max(F.struct("e", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    return pairs.select("a", "b").distinct()


def _with_end(batches):
    yield from batches
    yield None


def _with_sketches(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    a, b = (classes.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("regs").alias(f"r{side}")) for side in "ab")
    counts = cut(pairs.groupBy("a").agg(F.count("*").alias("n")))
    return salted_join(pairs.join(b, "b"), cut(a.join(counts.select("a"), "a", "left_semi")), "a", "b", counts, FEW_SKETCHES)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: the id, n_shingles, component_id and kept.

    Two documents are linked if 100 times their sets' intersection is at least percent
    times their union.  Null and empty texts have no shingles and are linked with
    nothing; rows that share an id count as one document, each by its own text if that is the
    set of another, and else by the text whose set has the least fingerprint; rows without
    an id are linked with nothing, have no component and are kept.  Repeated rows each come
    back.  An empty table gives an empty one.
    """
    ids = docs.select(named(doc_id).alias("id"), F.coalesce(named(text), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    sketched = cut(_sketches(ids, width))
    linked = (F.col("n") > 0) & F.col("id").isNotNull()
    of_set = cut(sketched.filter(linked).groupBy("fp").agg(F.min("id").alias("class"), F.count("*").alias("c")))
    narrow = sketched.select("id", "n", "fp")
    rows = salted_join(narrow.filter(linked), of_set.select("fp", "class"), "fp", "id", of_set.select("fp", F.col("c").alias("n")), FEW).drop("fp")
    rows = cut(rows.unionByName(narrow.filter(~linked).select("id", "n", F.lit(None).cast(rows.schema["class"].dataType).alias("class"))))
    first = of_set.groupBy(F.col("class").alias("id")).agg(F.min("fp").alias("fp"))
    classes = cut(sketched.filter(linked).join(first, ["id", "fp"]).select("id", "hash", "n", "regs", "keys").dropDuplicates(["id"]))

    keyed = classes.select("id", F.posexplode("keys").alias("band", "key"))
    shared = cut(keyed.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"))
    hot = shared.select("key", F.col("c").alias("n"))
    keyed = cut(salted_join(keyed, shared, "key", "id", hot, FEW))
    met = keyed.groupBy("id").agg(F.sum(F.col("c") - 1).alias("met"))
    keyed = cut(keyed.drop("c").join(met, "id"))
    wanted = cut(classes.join(met, "id").select("id", "hash"))
    texts = ids.join(F.broadcast(wanted) if wanted.count() <= FEW else wanted, ["id", "hash"])
    texts = cut(texts.select("id", "text").dropDuplicates(["id"]))

    classes = classes.select("id", "n", "regs")
    stars = _estimated(_with_sketches(cut(_star(keyed, hot)), classes), percent)
    found = components(cut(_verified(stars, texts, width, percent)))
    apart = _apart(keyed, found).join(classes, "id")
    near = _compact(cut(_across(apart, percent, nearest=True)))
    apart = cut(_apart(keyed, found, near.select(F.col("a").alias("id"))))
    sets = _small_sets(texts.join(apart.select("id").distinct(), "id"), width)
    apart = apart.join(classes, "id").join(sets, "id")
    found = _merged(found, cut(_verified(_across(apart, percent, nearest=False), texts, width, percent)))
    found = found.withColumnRenamed("id", "class")
    out = rows.join(found, "class", "left")
    component = F.coalesce("component", "class", "id")
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"), (component == F.col("id")).alias("kept")).withColumn("kept", F.coalesce("kept", F.lit(True)))


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """docs, whole rows, without the near-duplicates: of each component the smallest id stays.

    Only the ids that go meet the texts.  Of rows that share an id one stays, the one with
    the least hash of its columns; rows without an id all stay, and so do null and empty
    texts; an empty table gives an empty one.  Columns stay, whatever their names are.
    """
    found = cut(near_duplicates(docs, text, doc_id, width, percent).select(F.col(doc_id).alias("i"), "kept").filter("i is not null"))
    gone = found.filter("not kept").select("i").distinct()
    again = found.filter("kept").groupBy("i").agg(F.count("*").alias("c")).filter("c > 1").select("i")
    rows = docs.select(packed(docs), named(doc_id).alias("id"))
    on = F.col("id") == F.col("i")
    once = rows.join(gone.unionByName(again), on, "left_anti").select("own.*")
    if again.isEmpty():
        return once
    one = rows.join(again, on, "left_semi").groupBy("id").agg(F.min_by("own", F.xxhash64("own")).alias("own"))
    return once.unionByName(one.select("own.*"))
