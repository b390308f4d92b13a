"""Operator 2: language-model scores by prediction by partial matching (PPM).

A text is read as its lower-cased words with single spaces between them and an end byte.
A byte is predicted in the longest context of up to ``ORDER`` bytes that the byte trie
has; where the context has not seen it, the code escapes (method C: as often as the
context has different children) to the next shorter context, in which the symbols already
ruled out are excluded; below order 0 the bytes that are left are equally likely.  The
score is the sum of the log10 probabilities, pretrained on a corpus or adaptive within
each document.  Beside it stands a unigram baseline over words with add-one smoothing.

Training is one pass: each task counts the words and the byte grams of its documents,
combines them in bounded memory, and one shuffle sums them.  All counts cover the whole
corpus, and so do both scores.  What is broadcast is bounded: the trie holds the contexts
met most often, each with all its children, up to ``MAX_GRAMS`` grams, and the baseline its
``MAX_WORDS`` most counted words.  A context is met at least as often as a longer one that
ends in it, so a byte whose longest context is held is scored there and then.  The others,
the tail of a document, are shuffled: words meet the full counts, and distinct grams are
scored by shards of the full gram table, which are dealt by the last bytes of the context.
Both are summed back, so the scores are exact at any size; hot words and grams never enter
that shuffle.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.common import cut, named, stored

#: Bytes of the longest context.
ORDER = 5
MAX_GRAMS, MAX_WORDS = 1_500_000, 400_000
#: Orders that the trie always holds whole: few byte strings are so short (fixed value).
WHOLE = 2
#: Bytes of text that are handled at once, and combined counts that a task holds.
CHUNK, HELD = 500_000, 1_000_000
END = b"\n"
#: The end of a text as a token of the baseline; no word has a space.
END_TOKEN = b" "
#: Counts are graded so finely for the choice of the least count.
GRADES = 16.0


def normal(text: str | None) -> list[bytes]:
    """The words of a text with A-Z lower-cased; bytes split at ASCII white space."""
    return (text or "").encode().lower().split()


def coded(words: list[bytes]) -> bytes:
    """The bytes that PPM codes, after ORDER zero bytes as the first context."""
    return bytes(ORDER) + b" ".join(words) + END


def grams(data: np.ndarray) -> np.ndarray:
    """The ORDER + 1 bytes up to each place as one number, the last byte lowest."""
    a = data.astype(np.uint64)
    code = a[: len(a) - ORDER].copy()
    for j in range(1, ORDER + 1):
        code = (code << np.uint64(8)) | a[j : len(a) - ORDER + j]
    return code


def _chunks(texts: list[str | None]):
    """Lists of (place, words, bytes to code) of about CHUNK bytes; a longer text is alone."""
    held, size = [], 0
    for k, t in enumerate(texts):
        words = normal(t)
        data = coded(words)
        held.append((k, words, data))
        size += len(data)
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _codes(held: list) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all places of some texts, and where each text's start."""
    parts = [grams(np.frombuffer(data, np.uint8)) for _, _, data in held]
    return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1]))


def _merge(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    all_codes = np.concatenate(codes)
    order = np.argsort(all_codes, kind="stable")
    all_codes, all_counts = all_codes[order], np.concatenate(counts)[order]
    first = np.flatnonzero(np.concatenate(([True], all_codes[1:] != all_codes[:-1]))) if len(all_codes) else np.zeros(0, np.int64)
    return all_codes[first], np.add.reduceat(all_counts, first) if len(first) else all_counts


def corpus_counts(docs: DataFrame, text: str) -> DataFrame:
    """Summed counts of words (word, null gram) and of full-order grams (null word, gram)."""

    def run(batches):
        import pyarrow as pa

        words: Counter = Counter()
        codes, counts = [], []

        def flush():
            if words:
                yield pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.binary()), pa.nulls(len(words), pa.int64()), pa.array(words.values(), pa.int64())], names=["word", "gram", "n"])
            words.clear()
            if codes:
                u, n = _merge(codes, counts)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(u), pa.binary()), pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "gram", "n"])
            codes.clear()
            counts.clear()

        for b in batches:
            for held in _chunks(b.column(0).to_pylist()):
                for _, own, _ in held:
                    words.update(own)
                words[END_TOKEN] += len(held)
                u, n = np.unique(_codes(held)[0], return_counts=True)
                codes.append(u)
                counts.append(n)
                if len(codes) > 8 and sum(map(len, codes)) > HELD:
                    u, n = _merge(codes, counts)
                    codes[:], counts[:] = [u], [n]
                if len(words) + (len(codes[0]) if codes else 0) > HELD:
                    yield from flush()
        yield from flush()

    rows = docs.select(named(text).alias("t")).mapInArrow(run, "word binary, gram bigint, n bigint")
    return rows.groupBy("word", "gram").agg(F.sum("n").alias("n"))


def _least(rows: DataFrame, most: int) -> int:
    """The least count n at which no more than ``most`` rows have that many."""
    grade = F.floor(F.log2("n") * GRADES).cast("int")
    left, least = most, None
    for r in rows.groupBy(grade.alias("g")).agg(F.count("*").alias("c"), F.min("n").alias("n")).orderBy(F.col("g").desc()).collect():
        left -= r["c"]
        if left < 0:
            break
        least = r["n"]
    return least if least is not None else np.iinfo(np.int64).max


class Trie:
    """The byte trie as sorted arrays: per order its grams with counts and its contexts.

    A context has the sum of its children's counts, their number, and the sum that the
    same symbols have in the next shorter context: what exclusion takes away there.
    """

    def __init__(self, by_order: list[tuple[np.ndarray, np.ndarray]]):
        self.grams, self.counts, self.contexts, self.total, self.kinds, self.lower = [], [], [], [], [], []
        for j, (codes, n) in enumerate(by_order):
            order = np.argsort(codes)
            codes, n = codes[order], n[order].astype(np.float64)
            context = codes >> np.uint64(8)
            first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(codes) else np.zeros(0, np.int64)
            self.grams.append(codes)
            self.counts.append(n)
            self.contexts.append(context[first])
            self.total.append(np.add.reduceat(n, first) if len(first) else n)
            self.kinds.append(np.diff(np.append(first, len(codes))).astype(np.float64))
            if j:
                below = self._find(self.grams[j - 1], codes & np.uint64((1 << 8 * j) - 1))
                taken = np.where(below >= 0, self.counts[j - 1][below], 0.0)
                self.lower.append((np.add.reduceat(taken, first), np.add.reduceat((below >= 0).astype(np.float64), first)) if len(first) else (n, n))
            else:
                self.lower.append((self.total[0], self.kinds[0]))

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Where each wanted number stands in sorted keys, or -1."""
        if not len(keys):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, at, -1)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each full-order code in its context."""
        out = np.zeros(len(codes))
        left = np.arange(len(codes))
        gone = np.zeros(len(codes))  # counts and kinds that exclusion takes from this order
        gone_kinds = np.zeros(len(codes))
        for j in range(ORDER, -1, -1):
            own = codes[left] & np.uint64((1 << 8 * (j + 1)) - 1)
            place = self._find(self.contexts[j], own >> np.uint64(8))
            known = place >= 0
            total = np.where(known, self.total[j][place] - gone[left], 0.0) if len(self.total[j]) else np.zeros(len(left))
            kinds = np.where(known, self.kinds[j][place] - gone_kinds[left], 0.0) if len(self.total[j]) else np.zeros(len(left))
            gram = self._find(self.grams[j], own)
            seen = gram >= 0
            out[left[seen]] += np.log10(self.counts[j][gram[seen]] / (total[seen] + kinds[seen])) if seen.any() else 0.0
            escape = ~seen & known & (kinds > 0)
            out[left[escape]] += np.log10(kinds[escape] / (total[escape] + kinds[escape]))
            rest = ~seen & known
            gone[left], gone_kinds[left] = 0.0, 0.0
            if j and rest.any():
                gone[left[rest]], gone_kinds[left[rest]] = self.lower[j][0][place[rest]], self.lower[j][1][place[rest]]
            left = left[~seen]
            if not len(left):
                return out
        out[left] -= np.log10(256.0 - (self.kinds[0][0] if len(self.kinds[0]) else 0.0))
        return out

    def holds(self, codes: np.ndarray) -> np.ndarray:
        """Whether the longest context of each full-order code is held."""
        return self._find(self.contexts[ORDER], codes >> np.uint64(8)) >= 0


def _key(gram: int) -> bytes:
    """The key of a gram of the tail: no word and no row has it."""
    return END + gram.to_bytes(8, "big")


def _shard(low: list[tuple[np.ndarray, np.ndarray]], gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes without a count and their log10, from the counts of all grams in their shards."""
    train = n > 0
    codes, counts = gram[train], n[train]
    orders = [*low, *[_merge([codes & np.uint64((1 << 8 * (j + 1)) - 1)], [counts]) for j in range(WHOLE + 1, ORDER + 1)]]
    asked = np.unique(gram[~train])
    return asked, Trie(orders).log10(asked)


def tail_scores(asked: DataFrame, full: DataFrame, low: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """The log10 probability of distinct full-order grams (word, the key, and s) by the full counts.

    All grams that end in the same WHOLE + 1 bytes of context come to one task together;
    so it has every longer context of theirs whole, and the shorter orders are in ``low``.
    """
    shared = asked.sparkSession.sparkContext.broadcast(low)
    deal = F.shiftright("gram", 8).bitwiseAND((1 << 8 * (WHOLE + 1)) - 1)
    both = full.select("gram", "n").unionByName(asked.select("gram", F.lit(0).cast("long").alias("n")))
    both = both.withColumn("shard", deal).repartition("shard").sortWithinPartitions("shard")

    def run(batches):
        import pyarrow as pa

        def scored(parts):
            gram, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            if (n > 0).all():
                return
            codes, s = _shard(shared.value, gram.astype(np.uint64), n)
            yield pa.RecordBatch.from_arrays([pa.array([_key(g) for g in codes.tolist()], pa.binary()), pa.array(s)], names=["word", "s"])

        held, size = [], 0
        for b in batches:
            gram, n, shard = (b.column(i).to_numpy() for i in range(3))
            if not len(gram):
                continue
            # What is held ends with a whole shard before it is scored.
            if size + len(gram) > HELD and held:
                first = int(np.searchsorted(shard, held[-1][2][-1], "right"))
                if first < len(gram):
                    yield from scored([*held, (gram[:first], n[:first])])
                    held, size = [], 0
                    gram, n, shard = gram[first:], n[first:], shard[first:]
            held.append((gram, n, shard))
            size += len(gram)
        if held:
            yield from scored(held)

    return both.mapInArrow(run, "word binary, s double")


class Model:
    """The full word and gram counts (tables), and what is broadcast of them."""

    def __init__(self, corpus: DataFrame, text: str = "text", max_grams: int = MAX_GRAMS, max_words: int = MAX_WORDS):
        summed = cut(corpus_counts(corpus, text))
        self.words = summed.filter("word is not null").select("word", "n")
        n, v, end = self.words.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("word") == F.lit(END_TOKEN), F.col("n")))).first()
        self.tokens, self.distinct, self.ends = n or 0, v, end or 0
        full = summed.filter("gram is not null")
        orders = [F.struct(F.lit(j).alias("o"), F.col("gram").bitwiseAND((1 << 8 * (j + 1)) - 1).alias("g")) for j in range(ORDER + 1)]
        by_order = full.select(F.explode(F.array(*orders)).alias("x"), "n").groupBy("x.o", "x.g").agg(F.sum("n").alias("n"))
        # How often a gram's context is met; one has 256 children at most.
        by_order = cut(by_order.withColumn("met", F.sum("n").over(Window.partitionBy("o", F.shiftright("g", 8)))))
        kept = by_order.filter((F.col("met") >= _least(by_order.select(F.col("met").alias("n")), max_grams)) | (F.col("o") <= WHOLE)).select("o", "g", "n").toArrow()
        o, g, n = (kept.column(k).to_numpy() for k in range(3))
        self.full, self.whole = full.select("gram", "n"), len(o) == by_order.count()
        self.trie = Trie([(g[o == j].astype(np.uint64), n[o == j]) for j in range(ORDER + 1)])
        self.least_word = _least(self.words, max_words)
        hot = self.words.filter(F.col("n") >= self.least_word).toArrow()
        self.hot = dict(zip(hot.column(0).to_pylist(), np.log10(hot.column(1).to_numpy() + 1.0).tolist(), strict=True))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score and score in place of the text.

    A null text is an empty one: its only token is its end.  Repeated rows each keep
    their row; an empty table gives an empty one; with an empty training corpus every byte
    is as likely as any other.  Columns that bear a result's name are replaced.
    """
    results = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    kept = [c for c in docs.columns if c.lower() not in {text.lower(), *results}]
    shared = docs.sparkSession.sparkContext.broadcast((model.trie, model.whole, model.hot, np.log10(model.ends + 1.0), int(model.ends > 0)))
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), F.struct(*[named(c) for c in kept]).alias("__own"), named(text).alias("__text"))
    schema = T.StructType([
        T.StructField("__row", T.LongType()), T.StructField("__own", rows.schema["__own"].dataType), T.StructField("word", T.BinaryType()), T.StructField("k", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType()),
        T.StructField("gram", T.LongType()),
    ])

    def run(batches):
        import pyarrow as pa

        trie, whole, hot, end_log, end_known = shared.value
        for b in batches:
            ids = b.column(0).to_pylist()
            for held in _chunks(b.column(2).to_pylist()):
                codes, starts = _codes(held)
                u, back = np.unique(codes, return_inverse=True)
                near = np.ones(len(u), bool) if whole else trie.holds(u)
                logs = np.zeros(len(u))
                logs[near] = trie.log10(u[near])
                scores = np.add.reduceat(logs[back], starts)
                # Per text of the batch and distinct gram of its tail: how often it stands there.
                far = np.flatnonzero(~near[back])
                pair, often = np.unique((np.searchsorted(starts, far, "right") - 1) * len(u) + back[far], return_counts=True)
                line, word, k, tokens, known, base = [], [], [], [], [], []
                tail_line, tail_word, tail_k = [], [], []
                for place, own, _ in held:
                    total, n = end_log, end_known
                    for w, c in Counter(own).items():
                        h = hot.get(w)
                        if h is None:
                            tail_line.append(ids[place])
                            tail_word.append(w)
                            tail_k.append(c)
                        else:
                            total += c * h
                            n += c
                    line.append(place)
                    # A key of its own that is no word: the row meets nothing and no other.
                    word.append(END_TOKEN + ids[place].to_bytes(8, "big"))
                    tokens.append(len(own) + 1)
                    known.append(n)
                    base.append(total)
                m, t = len(line), len(tail_line)
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[p] for p in line], pa.int64()), b.column(1).take(pa.array(line)), pa.array(word, pa.binary()), pa.array([0] * m, pa.int64()),
                    pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores), pa.nulls(m, pa.int64()),
                ], names=schema.names)
                own_type = b.column(1).type
                if t:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(tail_line, pa.int64()), pa.nulls(t, own_type), pa.array(tail_word, pa.binary()), pa.array(tail_k, pa.int64()),
                        pa.nulls(t, pa.int64()), pa.nulls(t, pa.int64()), pa.nulls(t, pa.float64()), pa.nulls(t, pa.float64()), pa.nulls(t, pa.int64()),
                    ], names=schema.names)
                g = len(pair)
                if g:
                    gram = u[pair % len(u)].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([ids[held[p][0]] for p in (pair // len(u)).tolist()], pa.int64()), pa.nulls(g, own_type), pa.array([_key(x) for x in gram.tolist()], pa.binary()), pa.array(often, pa.int64()),
                        pa.nulls(g, pa.int64()), pa.nulls(g, pa.int64()), pa.nulls(g, pa.float64()), pa.nulls(g, pa.float64()), pa.array(gram),
                    ], names=schema.names)

    scored = rows.mapInArrow(run, schema)
    tail = model.words.filter(F.col("n") < model.least_word).select("word", F.col("n").alias("c"), F.lit(None).cast("double").alias("s"))
    if not model.whole:
        scored = stored(scored)  # read twice: for the grams that are asked and for the join
        low = [(model.trie.grams[j], model.trie.counts[j].astype(np.int64)) for j in range(WHOLE + 1)]
        far = tail_scores(scored.filter("gram is not null").select("gram").distinct(), model.full, low)
        tail = tail.unionByName(far.select("word", F.lit(None).cast("long").alias("c"), "s"))
    met = scored.drop("gram").join(tail, "word", "left")
    found = F.col("c").isNotNull()
    sums = met.groupBy("__row").agg(
        F.first("__own", ignorenulls=True).alias("__own"),
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("known") + F.sum(F.when(found, F.col("k")).otherwise(0))).alias("n_known"),
        (F.sum("base") + F.sum(F.when(found, F.col("k") * F.log10(F.col("c") + 1.0)).otherwise(0.0))).alias("b"),
        (F.sum("score") + F.sum(F.when(F.col("s").isNotNull(), F.col("k") * F.col("s")).otherwise(0.0))).alias("score"),
    )
    each = float(np.log10(model.tokens + model.distinct + 1))
    return sums.select("__own.*", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("b") - F.col("n_tokens") * each).alias("base_score"), "score")


def adaptive_log10(text: str | None, order: int = 3) -> float:
    """log10 probability of one text by PPM that learns only from the text so far."""
    children: dict[bytes, Counter] = {}
    data = b" ".join(normal(text)) + END
    total = 0.0
    for i, s in enumerate(data):
        ruled_out: set[int] = set()
        for j in range(min(order, i), -1, -1):
            seen = children.get(data[i - j : i], {})
            open_ = {x: n for x, n in seen.items() if x not in ruled_out}
            if s in open_:
                total += np.log10(open_[s] / (sum(open_.values()) + len(open_)))
                break
            if open_:
                total += np.log10(len(open_) / (sum(open_.values()) + len(open_)))
                ruled_out |= open_.keys()
        else:
            total -= np.log10(256 - len(ruled_out))
        for j in range(min(order, i) + 1):
            children.setdefault(data[i - j : i], Counter())[s] += 1
    return float(total)


def score_adaptive(docs: DataFrame, text: str = "text", order: int = 3) -> DataFrame:
    """docs with adaptive_score: each text coded by a model of its own, which starts empty."""

    @F.pandas_udf("double")
    def coded_length(texts):
        return texts.map(lambda t: adaptive_log10(t, order))

    return docs.withColumn("adaptive_score", coded_length(F.col(text)))


def trained_on(doc_id: str = "doc_id") -> Column:
    """The contract's training rows."""
    from fieldloom.llm.common import crc_mod

    return crc_mod(doc_id, 7) != 2
