"""Operator 4: language identification by the nearest of several centroids per language.

A text's vector counts the 1- to 3-grams of its lower-cased words in hashed slots,
with logarithmic frequencies times inverse document frequencies, normalised.  Each
language's sample is clustered (spherical k-means) into several centroids; a text gets
the language of the centroid with the largest cosine, and is marked as rejected where
even that one lies farther off than nearly all of the language's own sample.

The classifier is fitted on a bounded sample of labelled rows (``SAMPLE_DOCS`` in all, shared
equally by the languages, but ``LEAST_DOCS`` each at least); prediction is a map over whole
texts without a shuffle.  The model that is broadcast has ``CLUSTERS`` x ``SLOTS`` numbers, 64 KB,
a language, for ``MOST_LANGUAGES`` at most: more values in that column are no languages, and raise.
"""

from __future__ import annotations

import re

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.common import named, packed

SLOTS = 4096
CLUSTERS = 4
#: The bound of the sample that the classifier is fitted on, in documents: in all, but each language may have the least.
SAMPLE_DOCS, LEAST_DOCS = 3000, 20
MOST_LANGUAGES = 2000
#: The sample's distances within which a text is accepted, as a quantile, and the slack over it.
RADIUS, SLACK = 0.995, 1.25
#: Sharpness of the score over the languages' best cosines.
SHARPNESS = 20.0
CHUNK = 1_000_000
LETTER = regex.compile(r"\p{L}")
#: What stands between words; signs and digits say nothing about the language.
OTHER = re.compile(r"[\W\d_]+")
_PRIMES = np.array([2654435761, 40503, 97], dtype=np.uint64)


def frequencies(text: str) -> np.ndarray:
    """log(1 + count) of the hashed 1-, 2- and 3-grams of a whole text, chunk by chunk."""
    out = np.zeros(SLOTS, dtype=np.int64)
    low = OTHER.sub(" ", text.lower())
    for start in range(0, max(len(low), 1), CHUNK):
        # Grams belong to the chunk in which they start.
        codes = np.frombuffer(low[start : start + CHUNK + 2].encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        n = min(CHUNK, len(low) - start)
        h = np.zeros(len(codes), dtype=np.uint64)
        for size in (1, 2, 3):
            if len(codes) < size:
                break
            h = h[: len(codes) - size + 1] * np.uint64(1000003) + codes[size - 1 :]
            slots = (((h + _PRIMES[size - 1]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64)
            out += np.bincount(slots[:n], minlength=SLOTS)
    return np.log1p(out).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _centroids(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from farthest-first starts; deterministic."""
    c = [_unit(x.mean(0))]
    while len(c) < min(k, len(x)):
        c.append(x[np.argmin((x @ np.array(c).T).max(1))])
    c = np.array(c)
    for _ in range(12):
        own = (x @ c.T).argmax(1)
        c = np.array([_unit(x[own == j].mean(0)) if (own == j).any() else c[j] for j in range(len(c))])
    return c


class Model:
    """Inverse document frequencies, centroids, their languages and the languages' radii."""

    def __init__(self, langs: list[str], vectors: np.ndarray, labels: np.ndarray):
        n = len(vectors)
        self.langs = langs
        self.idf = (np.log((1 + n) / (1 + (vectors > 0).sum(0))) + 0.1).astype(np.float32)
        x = _unit(vectors * self.idf) if n else vectors
        parts = [_centroids(x[labels == k], CLUSTERS) for k in range(len(langs))]
        self.owner = np.repeat(np.arange(len(langs)), [len(p) for p in parts])
        self.centroids = np.concatenate(parts).astype(np.float32) if parts else np.zeros((0, SLOTS), np.float32)
        self.radius = np.array([np.quantile(1 - (x[labels == k] @ p.T).max(1), RADIUS) * SLACK for k, p in enumerate(parts)])

    def predict(self, text: str) -> tuple[str, float, float, bool]:
        """Language, score, cosine and whether the distance rejects it."""
        if not LETTER.search(text) or not self.langs:
            return "und", 0.0, 0.0, True
        cosines = self.centroids @ _unit(frequencies(text) * self.idf)
        best = np.array([cosines[self.owner == k].max() for k in range(len(self.langs))], dtype=np.float64)
        k = int(best.argmax())
        share = np.exp(SHARPNESS * (best - best[k]))
        return self.langs[k], float(1 / share.sum()), float(min(max(best[k], 0.0), 1.0)), bool(1 - best[k] > self.radius[k])


def fit(docs: DataFrame, trainable: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from a bounded sample of the trainable rows with a language and a letter.

    Rows without a text or a language teach nothing.  A language's sample are the rows with
    its lowest hashes of id and text, rows that agree in both counting once: so it does not
    depend on how rows are dealt.  An empty table gives a model that knows no language.
    """
    rows = docs.filter(trainable).select(named(lang).cast("string").alias("l"), named(text).alias("t"), F.xxhash64(F.lit(11), named(doc_id), named(text)).alias("h")).filter("l is not null")
    counts = {r[0]: r[1] for r in rows.groupBy("l").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs = sorted(counts)
    each = max(LEAST_DOCS, sample_docs // max(1, len(langs)))
    # Of 62 bits, so that a language of any size has about twice ``each`` rows below its limit.
    limit = F.lit(0).cast("long")
    for name in langs:
        limit = F.when(F.col("l") == name, F.lit(2**62 if 2 * each >= counts[name] else 2**62 * 2 * each // counts[name]).cast("long")).otherwise(limit)
    low = rows.filter(F.shiftrightunsigned("h", 2) < limit).dropDuplicates(["l", "h"])
    rank = F.row_number().over(Window.partitionBy("l").orderBy(F.shiftrightunsigned("h", 2), "h"))
    sample = low.withColumn("rank", rank).filter(F.col("rank") <= each).select(F.col("h").cast("string").alias("d"), "l", "t")

    def vectors(batches):
        import pyarrow as pa

        for b in batches:
            keep = [(d, l, frequencies(t).astype(np.float16).tobytes()) for d, l, t in zip(*(c.to_pylist() for c in b.columns), strict=True) if t and LETTER.search(t)]
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keep], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.binary()))], names=["d", "l", "v"])

    got = sorted(tuple(r) for r in sample.mapInArrow(vectors, "d string, l string, v binary").collect()) if langs else []
    langs = sorted({r[1] for r in got})
    x = np.array([np.frombuffer(r[2], dtype=np.float16) for r in got], dtype=np.float32).reshape(-1, SLOTS)
    return Model(langs, x, np.array([langs.index(r[1]) for r in got], dtype=np.int64))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score, cosine and rejected in place of the text.

    A null text, or one without a letter, is ``und`` with score 0, and so is every text
    if there was nothing to learn from.  Repeated rows get the same prediction; an empty
    table gives an empty one; columns that bear a result's name are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    results = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cosine", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    kept = [f for f in docs.schema if f.name.lower() not in {text.lower(), *(r.name for r in results)}]
    schema = T.StructType([*kept, *results])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            got = [shared.value.predict(t or "") for t in b.column(1).to_pylist()]
            found = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.column(0).flatten(), *found], names=schema.names)

    return docs.select(packed(docs, text, *(r.name for r in results)), named(text).alias("text")).mapInArrow(run, schema)
