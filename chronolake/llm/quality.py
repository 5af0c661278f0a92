"""Quality classifier: regularised quadratic discriminant over document statistics.

Each class has a mean and a covariance of transformed statistics, the covariance shrunk towards
the pooled one and its diagonal.  A text's margin is the difference of the classes' log densities, from
Mahalanobis distances by cached Cholesky factors; a logistic curve fitted to the margins of the
training sample turns it into a score.  The sample's rows are weighted back to the classes' shares
among all training labels, so that a score means the same at any size of the table.

Defined results: a null or empty text has statistics of 0 and a score like any other; labels other
than 0 and 1 and labels of unknown documents are ignored; repeated labels of a document count
once, as 1 if any says so; with no labels of a class all scores are the share of label 1 in the
sample (0.5 where there is none); an empty table gives an empty result; further columns pass
through scored() unless they are named score, which is replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import loaded, pieces, shared_value, table, text_buffers
from .docstats import COUNTS, SHARES, held_out, labelled_sample, measured, statistics

#: Labelled documents of each class, at most, that the model is fitted to.
SAMPLE = 10_000
#: Weight of the pooled covariance, then of its diagonal, in each class's covariance.
POOL, DIAGONAL = 0.3, 0.2
LIMIT = 60.0


def transformed(stats: dict) -> np.ndarray:
    """A row of features per text: logarithms of the word count and word length, roots of shares."""
    columns = [np.log1p(stats["n_words"]), np.log(np.asarray(stats["mean_word"]) + 1)]
    columns += [np.sqrt(np.asarray(stats[c])) for c in SHARES if c != "mean_word"]
    return np.stack(columns, 1).astype(float)


class Discriminant:
    """Two Gaussian classes; factors are those of the inverse covariances.

    weight has what each row stands for, 1 by default.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None):
        weight = np.ones(len(y)) if weight is None else np.asarray(weight, float)
        self.prior = float(np.average(y, weights=weight)) if len(y) else 0.5
        self.usable = 0 < y.sum() < len(y)
        if not self.usable:
            return
        self.center = np.average(x, axis=0, weights=weight)
        self.scale = np.sqrt(np.average((x - self.center) ** 2, axis=0, weights=weight)) + 1e-3
        z = (x - self.center) / self.scale
        own = {k: np.cov(z[y == k].T, bias=True, aweights=weight[y == k]) for k in (0, 1)}
        pooled = own[1] * self.prior + own[0] * (1 - self.prior)
        target = (1 - DIAGONAL) * pooled + DIAGONAL * np.diag(np.diag(pooled)) + 1e-3 * np.eye(x.shape[1])
        self.classes = []
        for k in (0, 1):
            factor = np.linalg.cholesky((1 - POOL) * own[k] + POOL * target)
            self.classes.append((np.average(z[y == k], axis=0, weights=weight[y == k]), np.linalg.inv(factor), float(np.log(np.diag(factor)).sum())))
        self.slope, self.shift = 1.0, 0.0
        self.slope, self.shift = fitted_curve(self.margin(x), y, weight=weight)

    def margin(self, x: np.ndarray) -> np.ndarray:
        z, logs = (x - self.center) / self.scale, []
        for mean, inverse, logdet in self.classes:
            logs.append(-0.5 * (((z - mean) @ inverse.T) ** 2).sum(1) - logdet)
        return np.clip(logs[1] - logs[0], -LIMIT, LIMIT)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.usable:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -30, 30)))


def fitted_curve(margin: np.ndarray, y: np.ndarray, rounds: int = 50, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and shift of a logistic curve over weighted rows, by Newton steps with a small penalty on the slope."""
    a, b = 0.1, 0.0
    weight = np.ones(len(y)) if weight is None else weight
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        w, off = weight * (p * (1 - p) + 1e-6), weight * (p - y)
        gradient = np.array([(off * margin).sum() + 1e-2 * a, off.sum() + 1e-2 * b])
        hessian = np.array([[(w * margin**2).sum() + 1e-2, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(hessian, gradient)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def fitted(docs: DataFrame, labels: DataFrame, train, sample: int = SAMPLE) -> Discriminant:
    """The model of the labels' quality, from the documents that the condition train selects."""
    rows = measured(labelled_sample(docs, labels, "quality", sample, train)).toPandas().sort_values("doc_id", kind="stable")
    x = transformed({c: rows[c].to_numpy() for c in COUNTS + SHARES})
    return Discriminant(x, rows["label"].to_numpy().astype(float), rows["weight"].to_numpy())


def _score(model, text: str, keep_text: bool, name: str):
    def run(batches):
        import pyarrow as pa

        known = loaded(model)
        for whole in batches:
            for batch in pieces(whole, text):
                names = batch.schema.names
                got = known.score(transformed(statistics(*text_buffers(batch.column(names.index(text))))))
                keep = [k for k, c in enumerate(names) if keep_text or c != text]
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + [pa.array(got)], names=[names[k] for k in keep] + [name])

    return run


def scored(docs: DataFrame, model: Discriminant, text: str = "text", keep_text: bool = True, name: str = "score") -> DataFrame:
    """docs with a score column, from 0 to 1, higher where label 1 is likelier."""
    docs = docs.drop(name)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if keep_text or f.name != text]
    shared = shared_value(docs.sparkSession, model)
    return docs.mapInArrow(_score(shared, text, keep_text, name), ", ".join([*kept, f"{name} double"]))


def accepted(docs: DataFrame, model: Discriminant, least: float, text: str = "text") -> DataFrame:
    """Rows whose text scores at least that much, with their columns as they were."""
    return scored(docs, model, text, name="_quality").where(F.col("_quality") >= least).select(*docs.columns)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = fitted(docs, labels, ~held_out(5, 0))
    out = scored(docs, model, keep_text=False)
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
