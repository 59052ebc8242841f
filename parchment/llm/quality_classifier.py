"""Quality scores by regularised quadratic discriminant analysis over transformed document statistics.

The class means and covariances come from sums and sums of products over all training rows, added up in the cluster
(the driver sees a matrix a class).  Each covariance is shrunk towards the pooled one and towards a multiple of the
identity; its Cholesky factor is computed once and sent out, and a score is the logistic of the difference of the two
log densities: Mahalanobis distances by one triangular product, log determinants and log priors.

Defined cases: a null or empty text has zero statistics and is scored like any other; labels that are null or of
unknown documents are ignored; of several labels of one document the larger counts; with a class that has no label
every score is the labelled share of class 1; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from . import text_stats

SHRINK, RIDGE = 0.7, 0.05
_PER_WORD = ("n_symbols", "n_repeat_words", "n_bars", "n_bangs", "n_stop", "n_stutter", "n_caps_words", "n_marked_words", "n_digits", "n_lines")


def transformed(s: dict[str, np.ndarray]) -> np.ndarray:
    """One row of features a document: logarithms of sizes and of ratios, kept off zero."""
    words = np.maximum(s["n_words"], 1)
    cols = [np.log1p(s["n_words"]), np.log1p(s["word_chars"] / words)]
    cols += [np.log(0.01 + s[c] / words) for c in _PER_WORD]
    cols += [np.log(0.01 + s["n_dup_lines"] / np.maximum(s["n_lines"], 1)), np.log(0.01 + s["n_upper"] / np.maximum(s["n_letters"], 1))]
    return np.stack(cols, 1)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<double>) of every row."""
    import pyarrow as pa

    C.tune(docs.sparkSession)

    def one(batch, data, off):
        x = transformed(text_stats.document_stats(data, off))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))
        yield {"doc_id": C.column(batch, "doc_id"), "x": flat}

    return C.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), one, "doc_id long, x array<double>")


def fit(rows: DataFrame, shrink: float = SHRINK, ridge: float = RIDGE) -> dict:
    """Model from (x, label) rows: per class the mean, inverse Cholesky factor and constant of the log density."""
    dims = len(transformed({c: np.zeros(1) for c in text_stats.COLUMNS})[0])
    pairs = [(i, j) for i in range(dims) for j in range(i + 1)]

    def sums(batches):
        import pandas as pd

        n, s, p = np.zeros(2), np.zeros((2, dims)), np.zeros((2, dims, dims))
        for frame in batches:
            x, y = np.stack(frame["x"].to_numpy()) if len(frame) else np.zeros((0, dims)), frame["label"].to_numpy()
            for c in (0, 1):
                own = x[y == c]
                n[c] += len(own)
                s[c] += own.sum(0)
                p[c] += own.T @ own
        yield pd.DataFrame({"label": [0, 1], "v": [np.concatenate(([n[c]], s[c], [p[c][i, j] for i, j in pairs])).tolist() for c in (0, 1)]})

    size = 1 + dims + len(pairs)
    total = rows.mapInPandas(sums, "label int, v array<double>").groupBy("label").agg(*[F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(size)]).collect()
    n, mean, cov = np.zeros(2), np.zeros((2, dims)), np.zeros((2, dims, dims))
    for r in total:
        v, c = np.array(r[1:], float), r["label"]
        n[c] = v[0]
        if v[0]:
            mean[c] = v[1 : 1 + dims] / v[0]
            for (i, j), q in zip(pairs, v[1 + dims :], strict=True):
                cov[c, i, j] = cov[c, j, i] = q / v[0] - mean[c, i] * mean[c, j]
    if not n.all():
        return {"share": float(n[1] / max(1, n.sum()))}
    scale = np.sqrt(np.maximum(((n[:, None, None] * cov).sum(0) / n.sum()).diagonal() + ((n[:, None] * (mean - (n[:, None] * mean).sum(0) / n.sum()) ** 2).sum(0) / n.sum()), 1e-12))
    cov = cov / scale[:, None] / scale[None, :]
    pooled = (n[:, None, None] * cov).sum(0) / n.sum()
    model = {"scale": scale, "classes": []}
    for c in (0, 1):
        s = (1 - shrink) * cov[c] + shrink * pooled
        s = (1 - ridge) * s + ridge * max(np.trace(s) / dims, 1e-6) * np.eye(dims)
        factor = np.linalg.cholesky(s)
        model["classes"].append((mean[c] / scale, np.linalg.inv(factor), float(np.log(n[c] / n.sum()) - np.log(factor.diagonal()).sum())))
    return model


def log_odds(model: dict, x: np.ndarray) -> np.ndarray:
    if "share" in model:
        share = np.clip(model["share"], 1e-6, 1 - 1e-6)
        return np.full(len(x), np.log(share / (1 - share)))
    density = [constant - 0.5 * (((x / model["scale"] - mean) @ inverse.T) ** 2).sum(1) for mean, inverse, constant in model["classes"]]
    return density[1] - density[0]


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", holdout: int = 5, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; trained on all labelled rows with crc32(doc_id) % holdout != 0.

    The features are computed from the text once and written; training and scoring read them.
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % holdout
    rows = C.written(features(docs))
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(crc != 0).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col(label) > 0).cast("int")).alias("label"))
    model = fit(rows.join(known, "doc_id").select("x", "label"))

    def run(batches):
        for frame in batches:
            if len(frame):
                d = log_odds(model, np.stack(frame.pop("x").to_numpy()))
                yield frame.assign(score=1 / (1 + np.exp(-np.clip(d, -700, 700))))

    scored = rows.mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", (crc == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
