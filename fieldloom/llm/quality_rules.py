"""Operator 10: quality rules with robust multivariate outliers, in DataFrame functions only.

Base rules fail documents of few words or of mostly repeated three-word windows.  The
method adds minimum-covariance-determinant (MCD) estimates per language and source over
a vector of transformed statistics, and rejects what lies far by Mahalanobis distance.

A statistic's variance has a floor: differences that small say nothing about quality, so
that a statistic which is nearly always zero does not make its every mention an outlier.
The cut is the quantile of the distance's chi-square distribution at a stated share of false
rejects.  The steps start from medians and median absolute deviations, and go on until no
determinant falls any more.  Small groups are not switched off: each language and source is
estimated, and so are its language and all rows together, and an estimate is shrunk towards
that of the level above as if ``PRIOR_ROWS`` rows of that level belonged to it.

The statistics come from one pass over each whole text and never leave its row, so no
words are shuffled.  The fit works on a narrow table (keys and six numbers a row): each
concentration step is a few aggregations that combine before their shuffle, so that a hot
language and source costs few rows from each task.  Quantiles are taken exactly over bins
(1/1024 of a statistic, 1/256 of a doubling of a distance), so they do not depend on how
rows are dealt.  The estimates, some sixty numbers a cell, are joined back; they are
broadcast only while there are at most ``BROADCAST_CELLS`` of them, and joined by shuffle
(with skew splitting) beyond.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import SPACE, cut, named, packed, stored

#: The statistics, in the order of the vector.
VECTOR = ("x_word_length", "x_symbols", "x_dup_lines", "x_repeats", "x_upper", "x_marks")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")
#: The least standard deviation of each: below, a difference says nothing about quality.
FLOOR = (0.08, 0.25, 0.35, 0.60, 0.10, 0.15)
#: Rows of the level above that an estimate counts as its own.
PRIOR_ROWS = 100.0
#: Share of a group's rows that the minimum-determinant subset holds.
SUBSET = 0.7
#: A step counts if it lowers the logarithm of a determinant by more than this.
PROGRESS = 1e-3
#: Share of good documents that the cut may reject.
FALSE_REJECTS = 1e-4
#: Bins of a statistic, and of a doubling of a squared distance, in quantiles.
BINS, DISTANCE_BINS = 1024, 256
BROADCAST_CELLS = 20_000


def chi2_share(x: float, freedom: int) -> float:
    """Chi-square distribution function for an even number of degrees of freedom."""
    half = x / 2
    return 1 - math.exp(-half) * sum(half**k / math.factorial(k) for k in range(freedom // 2))


def chi2_quantile(share: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    while high - low > 1e-9:
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_share(middle, freedom) < share else (low, middle)
    return high


#: Factor from the covariance of the nearest SUBSET to that of all rows of a Gaussian.
CONSISTENCY = SUBSET / chi2_share(chi2_quantile(SUBSET, len(VECTOR)), len(VECTOR) + 2)
#: Robust distance from which a document is rejected.
CUTOFF = chi2_quantile(1 - FALSE_REJECTS, len(VECTOR)) ** 0.5


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the COUNTS of their texts: words, characters in words, signs, equal lines, words in repeated windows, capitals and marks.

    A null text has no words and counts of 0.  Windows of three words are compared by a
    64-bit hash of their words' hashes within their text.  Columns of docs that bear a count's name are replaced.
    """
    t = F.coalesce(named(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # All characters that are counted, in one pass: what is left is short.
    signs = F.regexp_replace(t, r"[^#*$%&|<>A-Z!?]+", "")
    out = docs.select(packed(docs, *COUNTS), F.array_remove(F.split(t, SPACE), "").alias("w"), lines.alias("lines"), signs.alias("signs"))
    out = out.select(
        "own",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("signs", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("signs", F.lit(r"[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("signs", F.lit(r"[!?]")).cast("long").alias("n_marks"),
        F.transform("w", lambda w: F.xxhash64(w)).alias("h"),
    )
    grams = F.transform("h", lambda h, i: F.xxhash64(h, F.get("h", i + 1), F.get("h", i + 2)))
    out = out.select("own", *[c for c in COUNTS if c != "n_repeat_words"], F.slice(grams, F.lit(1), F.greatest(F.size("h") - 2, F.lit(0))).alias("g"))
    return out.select("own.*", *[repeated("g", 3).alias(c) if c == "n_repeat_words" else c for c in COUNTS])


def _once(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated(grams: str, width: int) -> Column:
    """Positions within windows whose gram occurs twice or more in the array.

    Texts without such windows, most of them, stop at one hash set.
    """
    by_gram = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def starts(b: Column) -> Column:
        """Places of windows that equal the one beside them in the order by gram."""
        beside = F.zip_with(b, F.slice(b, F.lit(2), F.size(b)), lambda x, y: F.struct(x["i"].alias("i"), y["i"].alias("j"), F.coalesce(x["g"] == y["g"], F.lit(False)).alias("same")))
        return F.sort_array(F.array_distinct(F.flatten(F.transform(F.filter(beside, lambda x: x["same"]), lambda x: F.array(x["i"], x["j"])))))

    def covered(at: Column) -> Column:
        steps = F.zip_with(at, F.slice(at, F.lit(2), F.size(at)), lambda a, b: F.coalesce(F.least(b - a, F.lit(width)), F.lit(width)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    total = _once(_once(by_gram, starts), covered)
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), total).otherwise(F.lit(0).cast("long"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def with_vector(df: DataFrame) -> DataFrame:
    """The transformed statistics: logarithms of shares, level for tiny shares."""
    chars, n = F.col("word_chars") + 1.0, F.col("n_words") + 1.0
    return df.withColumns({
        "x_word_length": F.log(chars / n),
        "x_symbols": F.log1p(100.0 * F.col("n_symbols") / chars),
        "x_dup_lines": F.log1p(100.0 * F.col("n_dup_lines") / n),
        "x_repeats": F.log1p(20.0 * F.col("n_repeat_words") / n),
        "x_upper": F.log1p(10.0 * F.col("n_upper") / chars),
        "x_marks": F.log1p(20.0 * F.col("n_marks") / chars),
    })


def _cells(stats: DataFrame, lang: str, source: str) -> DataFrame:
    """Keys of each language and source: of its own cell, of its language's and of all rows."""
    pair = stats.select(named(lang).alias("l"), named(source).alias("s")).distinct()
    own = F.xxhash64(F.lit(2), F.col("l").isNull(), F.col("l"), F.col("s").isNull(), F.col("s"))
    return pair.select("l", "s", own.alias("c2"), F.xxhash64(F.lit(1), F.col("l").isNull(), F.col("l")).alias("c1"), F.lit(0).cast("long").alias("c0"))


def _small(df: DataFrame) -> DataFrame:
    """A table of cells, marked for broadcast behind a check of its number of rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_CELLS else df


def _off(i: int) -> Column:
    return F.col(VECTOR[i]) - F.col(f"m{i}")


def _distance() -> Column:
    """Squared Mahalanobis distance by the inverse Cholesky factor of the cell."""
    p = len(VECTOR)
    return reduce(add, [F.pow(reduce(add, [F.col(f"v{i}_{k}") * _off(k) for k in range(i + 1)]), F.lit(2.0)) for i in range(p)])


def _distance_bin() -> Column:
    return F.floor(F.log2(_distance() + 1e-9) * DISTANCE_BINS).cast("int")


def _quantile(bins: DataFrame, share: float) -> DataFrame:
    """Per cell and k the least bin that with those below holds the share of rows, from rows (cell, k, bin).

    The windows run over the bins of a cell, whose number does not grow with its rows.
    """
    counts = bins.groupBy("cell", "k", "bin").agg(F.count("*").alias("n"))
    each = Window.partitionBy("cell", "k")
    upto = each.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(each)})
    return counts.filter(F.col("upto") >= share * F.col("all")).groupBy("cell", "k").agg(F.min("bin").alias("bin"))


def _medians(rows: DataFrame, values: list[Column]) -> DataFrame:
    """Per cell the medians of the values, as q0, q1, ..., to the nearest bin."""
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.floor(v * BINS).cast("int").alias("bin")) for k, v in enumerate(values)])
    got = _quantile(rows.select("cell", F.explode(each).alias("x")).select("cell", "x.k", "x.bin"), 0.5)
    return got.groupBy("cell").agg(*[F.max(F.when(F.col("k") == k, (F.col("bin") + 0.5) / BINS)).alias(f"q{k}") for k in range(len(values))])


def _start(rows: DataFrame) -> DataFrame:
    """Medians and scales by median absolute deviations: where the steps begin."""
    p = range(len(VECTOR))
    mid = cut(_medians(rows, [F.col(x) for x in VECTOR]).withColumnsRenamed({f"q{i}": f"m{i}" for i in p}))
    mad = _medians(rows.join(_small(mid), "cell"), [F.abs(_off(i)) for i in p])
    out = mid.join(mad, "cell")
    scale = [F.greatest(1.4826 * F.col(f"q{i}"), F.lit(FLOOR[i])) for i in p]
    v = [(1.0 / scale[i] if i == k else F.lit(0.0)).alias(f"v{i}_{k}") for i in p for k in range(i + 1)]
    return cut(out.select("cell", *[f"m{i}" for i in p], *v, F.lit(float("inf")).alias("det")))


def _factor(out: DataFrame) -> DataFrame:
    """The inverse Cholesky factor v of the covariance c, and the logarithm of its determinant."""
    p = len(VECTOR)
    for j in range(p):  # Cholesky factor, column by column
        left = reduce(add, [F.pow(f"l{j}_{k}", F.lit(2.0)) for k in range(j)], F.lit(0.0))
        out = out.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(F.col(f"c{j}_{j}") - left, F.lit(FLOOR[j] ** 2 / 4))))
        below = {f"l{i}_{j}": (F.col(f"c{i}_{j}") - reduce(add, [F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)], F.lit(0.0))) / F.col(f"l{j}_{j}") for i in range(j + 1, p)}
        out = out.withColumns(below) if below else out
    for i in range(p):  # its inverse, row by row
        inner = [-reduce(add, [F.col(f"l{i}_{k}") * F.col(f"v{k}_{j}") for k in range(j, i)], F.lit(0.0)) / F.col(f"l{i}_{i}") for j in range(i)]
        out = out.withColumns({f"v{i}_{j}": x for j, x in enumerate([*inner, 1.0 / F.col(f"l{i}_{i}")])})
    return out.withColumn("det", 2.0 * reduce(add, [F.log(f"l{j}_{j}") for j in range(p)]))


def _params() -> list[str]:
    p = range(len(VECTOR))
    return ["cell", *[f"m{i}" for i in p], *[f"v{i}_{k}" for i in p for k in range(i + 1)], "det"]


def _step(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """One concentration step: number of rows, centre m and covariance c of the SUBSET of each cell that lies nearest."""
    p = range(len(VECTOR))
    at = rows.join(_small(cells), "cell").withColumn("bin", _distance_bin())
    near = cut(_quantile(at.select("cell", F.lit(0).alias("k"), "bin"), SUBSET).select("cell", F.col("bin").alias("last")))
    inside = at.join(_small(near), "cell").filter("bin <= last").withColumns({f"z{i}": _off(i) for i in p})
    # Sums are taken about the last centre, which keeps them small.
    sums = [F.avg(f"z{i}").alias(f"a{i}") for i in p] + [F.avg(F.col(f"z{i}") * F.col(f"z{k}")).alias(f"b{i}_{k}") for i in p for k in range(i + 1)]
    moments = inside.groupBy("cell").agg(*sums).join(cells.select("cell", *[f"m{i}" for i in p]), "cell")
    c = {f"c{i}_{k}": CONSISTENCY * (F.col(f"b{i}_{k}") - F.col(f"a{i}") * F.col(f"a{k}")) + (FLOOR[i] ** 2 if i == k else 0.0) for i in p for k in range(i + 1)}
    return moments.withColumns(c).withColumns({f"m{i}": F.col(f"m{i}") + F.col(f"a{i}") for i in p}).drop(*[f"a{i}" for i in p], *[f"b{i}_{k}" for i in p for k in range(i + 1)])


def _converged(rows: DataFrame) -> DataFrame:
    """Centre and covariance of every cell, after steps until no determinant falls by more than PROGRESS.

    A cell keeps its estimate unless a step lowers its determinant, which the floors bound
    from below: so the steps end.
    """
    p = range(len(VECTOR))
    moments = [f"m{i}" for i in p] + [f"c{i}_{k}" for i in p for k in range(i + 1)]
    best = None
    at = _start(rows)
    while True:
        new = cut(_factor(_step(rows, at)).select(*_params(), *[c for c in moments if c[0] == "c"]))
        if best is None:
            best = at = new
            continue
        old = best.select("cell", *[F.col(c).alias(f"old_{c}") for c in best.columns if c != "cell"])
        both = new.join(old, "cell").withColumn("better", F.col("det") < F.col("old_det") - PROGRESS)
        kept = cut(both.select("cell", "better", *[F.when(F.col("better"), F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in best.columns if c != "cell"]))
        best = at = kept.drop("better")
        if kept.filter("better").isEmpty():
            return best.select("cell", *moments)


def _shrunk(cells: DataFrame, moments: DataFrame, sizes: DataFrame) -> DataFrame:
    """Parameters of each own cell, shrunk towards its language's, and that towards all rows'."""
    p = range(len(VECTOR))
    names = [f"m{i}" for i in p] + [f"c{i}_{k}" for i in p for k in range(i + 1)]
    both = moments.join(sizes, "cell")
    out = cells
    for level in (0, 1, 2):
        out = out.join(_small(both.select(F.col("cell").alias(f"c{level}"), F.col("n").alias(f"n{level}"), *[F.col(c).alias(f"{c}_at{level}") for c in names])), f"c{level}")
    for level in (1, 2):
        own = F.col(f"n{level}") / (F.col(f"n{level}") + PRIOR_ROWS)
        out = out.withColumns({f"{c}_at{level}": own * F.col(f"{c}_at{level}") + (1 - own) * F.col(f"{c}_at{level - 1}") for c in names})
    return _factor(out.select("l", "s", *[F.col(f"{c}_at2").alias(c) for c in names])).select("l", "s", *[c for c in _params() if c not in ("cell", "det")])


class Estimates:
    """The fitted estimates, one row for each language and source."""

    def __init__(self, params: DataFrame):
        self.params = params

    def distance(self, df: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
        """df, which has the vector, with robust_distance."""
        rows = df.select(packed(df, "robust_distance"), named(lang).alias("lang"), named(source).alias("source"), *VECTOR)
        on = F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))
        return rows.join(_small(self.params), on, "left").select("own.*", F.round(F.sqrt(_distance()), 6).alias("robust_distance"))


def fit(vectors: DataFrame, lang: str = "lang", source: str = "source") -> Estimates:
    """MCD estimates of a materialised table of vectors, per language and source."""
    cells = cut(_cells(vectors, lang, source))
    at = vectors.select(named(lang).alias("lang"), named(source).alias("source"), *VECTOR)
    on = F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))
    rows = at.join(_small(cells), on).select(F.explode(F.array("c0", "c1", "c2")).alias("cell"), *VECTOR)
    sizes = cut(rows.groupBy("cell").agg(F.count("*").cast("double").alias("n")))
    return Estimates(cut(_shrunk(cells, _converged(rows), sizes)))


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """docs, whole rows, with the statistics, base_failed, robust_distance and kept.

    The rows are written with their statistics once, so that texts are analysed once and
    filters on the verdict do not repeat the analysis.

    Null texts have no words and fail the base rules, as empty ones do.  Null languages
    and sources are groups of their own.  Repeated rows each get the same verdict and
    each count in the estimates.  An empty table gives an empty one.  A column of docs
    that bears a result's name is replaced by the result; other names, whatever they are, stay.
    """
    rows = docs.select(packed(docs, *COUNTS[:5], "base_failed", "robust_distance", "kept"), named(text).alias("text"), named(lang).alias("lang"), named(source).alias("source"))
    stats = stored(with_vector(text_stats(rows)).drop("text"))
    out = verdict(stats, fit(stats), cutoff=cutoff)
    return out.select("own.*", *COUNTS[:5], "base_failed", "robust_distance", "kept")


def verdict(stats: DataFrame, estimates: Estimates, lang: str = "lang", source: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    out = estimates.distance(stats, lang, source).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("robust_distance") <= cutoff))


def quality_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, with the statistics kept narrow so that texts are read once."""
    stats = cut(with_vector(text_stats(docs.select("doc_id", "lang", "source", "text"))).drop("text"))
    return verdict(stats, fit(stats)).select("doc_id", *COUNTS[:5], "base_failed", "kept", "robust_distance")


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", doc_id: str = "doc_id", cutoff: float = CUTOFF) -> DataFrame:
    """docs, whole rows and columns, without those that the rules reject.

    Texts are analysed once into a narrow table; only the keys of rejected rows (the id and
    a hash of text, language and source) meet the texts again.  Rows that agree in all of
    these share their verdict, nulls included; an empty table gives an empty one.
    """
    l, s = named(lang), named(source)
    keys = [named(doc_id).alias("id"), F.xxhash64(F.coalesce(named(text), F.lit("")), l.isNull(), l, s.isNull(), s).alias("key")]
    rows = docs.select(packed(docs), *keys)
    narrow = docs.select(*keys, l.alias("lang"), s.alias("source"), named(text).alias("text"))
    stats = cut(with_vector(text_stats(narrow)).drop("text"))
    gone = verdict(stats, fit(stats), cutoff=cutoff).filter(~F.col("kept")).select(F.col("id").alias("i"), F.col("key").alias("k"))
    return rows.join(gone, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left_anti").select("own.*")
