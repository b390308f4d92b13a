"""Operator 5: quality by regularised quadratic discriminant analysis.

Each class of labelled rows gets a mean and a covariance over transformed document
statistics; the covariance is shrunk towards the pooled one and towards its own diagonal.
The score is the logistic of the tempered difference of the two Mahalanobis log densities,
taken with the classes' cached inverse Cholesky factors.

All statistics come from one pass over whole texts in DataFrame functions.  The labels
meet narrow rows of numbers, never texts.  The fit is one aggregation to two rows of
moments, whatever the number of labelled rows; scoring is a projection.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import named, packed
from fieldloom.llm.quality_rules import VECTOR, text_stats, with_vector

#: The transformed statistics of the classifier.
FEATURES = (*VECTOR, "x_words", "x_separators")
#: Weights of the pooled covariance and of the diagonal in a class's covariance.
POOLED, DIAGONAL = 0.15, 0.10
#: Least variance of a statistic.
RIDGE = 1e-3
#: The log densities' difference is taken a statistic (over their number): statistics that
#: depend on each other beyond a Gaussian's covariance would else count several times.
TEMPERATURE = float(len(FEATURES))
#: Pseudo-labels that pull the prior odds to 1.
PRIOR_ROWS = 2.0


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with FEATURES in place of the text; a null text counts as an empty one.

    Columns of docs that bear a feature's name are replaced; other names, whatever they
    are, stay.
    """
    t = F.coalesce(named(text), F.lit(""))
    rows = docs.select(packed(docs, text, *FEATURES), t.alias("text"), F.regexp_count(t, F.lit(r"[|=_/\\]")).alias("separators"))
    out = with_vector(text_stats(rows)).withColumns({
        "x_words": F.log1p("n_words"),
        "x_separators": F.log1p(50.0 * F.col("separators") / (F.col("word_chars") + 1.0)),
    })
    return out.select("own.*", *FEATURES)


class Discriminant:
    """Two Gaussian classes with cached inverse Cholesky factors."""

    def __init__(self, n: np.ndarray, means: np.ndarray, covs: np.ndarray):
        p = len(FEATURES)
        self.fitted = bool((n >= 2).all())
        pooled = (n[:, None, None] * covs).sum(0) / max(n.sum(), 1.0)
        self.means, self.inverse, self.constant = means, [], []
        prior = np.log((n + PRIOR_ROWS) / (n + PRIOR_ROWS).sum())
        for k in range(2):
            own = (1 - POOLED - DIAGONAL) * covs[k] + POOLED * pooled + DIAGONAL * np.diag(np.diag(covs[k])) + RIDGE * np.eye(p)
            factor = np.linalg.cholesky(own)
            self.inverse.append(np.linalg.inv(factor))
            self.constant.append(prior[k] - np.log(np.diag(factor)).sum())

    def log_density(self, k: int) -> Column:
        z = [F.col(x) - float(m) for x, m in zip(FEATURES, self.means[k], strict=True)]
        rows = [sum((z[j] * float(self.inverse[k][i, j]) for j in range(i + 1)), F.lit(0.0)) for i in range(len(z))]
        return F.lit(float(self.constant[k])) - 0.5 * sum((r * r for r in rows), F.lit(0.0))

    def score(self) -> Column:
        if not self.fitted:
            return F.lit(0.5)
        return 1.0 / (1.0 + F.exp(F.least((self.log_density(0) - self.log_density(1)) / TEMPERATURE, F.lit(700.0))))


def fit(labelled: DataFrame, label: str = "label") -> Discriminant:
    """Moments of each class from rows of FEATURES and a label of 0 or 1; other labels are left out.

    With fewer than two rows of either class every score is 0.5.
    """
    p = len(FEATURES)
    rows = labelled.filter(F.col(label).isin(0, 1))
    sums = [F.count("*").alias("n"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(FEATURES)]]
    sums += [F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i + 1)]
    n, means, covs = np.zeros(2), np.zeros((2, p)), np.stack([np.eye(p)] * 2)
    for r in rows.groupBy(F.col(label).cast("int").alias("k")).agg(*sums).collect():
        n[r["k"]] = r["n"]
        means[r["k"]] = [r[f"m{i}"] for i in range(p)]
        covs[r["k"]] = [[r[f"c{max(i, j)}_{min(i, j)}"] for j in range(p)] for i in range(p)]
    return Discriminant(n, means, covs)


def classify(rows: DataFrame, model: Discriminant, threshold: float = 0.7) -> DataFrame:
    """rows of FEATURES with score and predicted.

    Each label row counts as one observation, so a document labelled twice counts twice;
    labels of unknown documents count for nothing.  Empty and null texts have the
    statistics of an empty text and a score like any other.
    """
    return rows.withColumn("score", model.score()).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
