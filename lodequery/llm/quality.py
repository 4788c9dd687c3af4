"""Quality by ordinal cumulative-link regression on graded ratings.

Grades y = 0..K-1 are modelled by one weight per hashed-text feature, shared by all
grades, and K - 1 ordered thresholds:  P(y <= k) = sigmoid(threshold_k - w.x).
The thresholds are the first one and positive steps, so they stay ordered.  A
text's expected grade ranks it; the tail probability P(y >= good) selects it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from . import textfeatures as T


class OrdinalModel:
    """Weights and thresholds; small enough for any closure."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, thresholds: np.ndarray, grades: np.ndarray):
        self.keys, self.weights, self.thresholds, self.grades = keys, weights, thresholds, grades

    @staticmethod
    def fit(rows: list[np.ndarray], y: np.ndarray, *, l2: float = 0.5, least: float = 3.5, fewest: int = 3, most: int = 4096) -> OrdinalModel:
        """Fit to feature hashes and ratings.  Without rows, or with one grade only, every text gets that grade."""
        grades, level = np.unique(y, return_inverse=True)
        k = len(grades)
        if k < 2:
            return OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), grades if k else np.zeros(1))
        keys = np.unique(np.concatenate([T.telling(rows, level >= c, least, fewest, most) for c in range(1, k)]))
        x_of = T.Sparse(rows, keys)
        share = np.clip(np.cumsum(np.bincount(level, minlength=k))[:-1] / len(y), 1e-4, 1 - 1e-4)
        start = np.log(share / (1 - share))
        x0 = np.concatenate([np.zeros(len(keys)), [start[0]], np.log(np.maximum(np.diff(start), 1e-3))])
        f = len(keys)
        gradient = OrdinalModel.gradient(x_of, level, k, l2)
        x = T.adam(gradient, x0)
        return OrdinalModel(keys, x[:f], x[f] + np.concatenate([[0], np.cumsum(np.exp(x[f + 1 :]))]), grades)

    @staticmethod
    def gradient(x_of: T.Sparse, level: np.ndarray, k: int, l2: float):
        """The gradient of the mean of -log P(level), plus l2 |w|^2 / 2n, by weights, first threshold and logs of the steps between thresholds."""
        f, n, index = x_of.shape[1], len(level), np.arange(len(level))

        def gradient(x: np.ndarray) -> np.ndarray:
            t = np.concatenate([[-np.inf], x[f] + np.concatenate([[0], np.cumsum(np.exp(x[f + 1 :]))]), [np.inf]])
            z = x_of.dot(x[:f])
            up, down = T.sigmoid(t[level + 1] - z), T.sigmoid(t[level] - z)
            p = np.maximum(up - down, 1e-12)
            d_up, d_down = up * (1 - up) / p, down * (1 - down) / p  # of -log p: -d_up by the upper threshold, +d_down by the lower
            g = np.zeros_like(x)
            g[:f] = x_of.back(d_up - d_down) + l2 * x[:f]
            by = np.zeros((n, k + 1))
            by[index, level + 1] -= np.where(level + 1 < k, d_up, 0)
            by[index, level] += np.where(level > 0, d_down, 0)
            by = by.sum(axis=0)[1:k]
            g[f] = by.sum()
            g[f + 1 :] = np.exp(x[f + 1 :]) * (np.cumsum(by[::-1])[::-1][1:])
            return g / n

        return gradient

    def tails(self, texts) -> np.ndarray:
        """P(grade >= grades[k]) for k = 1.., one row per text."""
        h, begins = T.document_features(texts, True)
        z = T.linear(h, begins, self.keys, self.weights)
        return 1 - T.sigmoid(self.thresholds[None] - z[:, None])


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 20_000, train=None) -> OrdinalModel:
    """Fit on at most ``most`` labelled rows."""
    sample = T.labelled_sample(docs, labels, label_col, id_col=id_col, text_col=text_col, most=most, train=train)
    model = OrdinalModel.fit(*T.fetch(sample, lambda t: T.document_features(t, True)))
    store.release_memory()  # the driver's, of the sample
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", good: float = 1.0, cut: float = 0.5, most: int = 20_000, model: OrdinalModel | None = None, keep: list | None = None) -> DataFrame:
    """Per row: the id, expected_grade, p_good (P(grade >= good)) and keep (p_good >= cut).

    Null and empty texts are scored as texts without words; null labels and labels of null or unknown
    ids don't count, of several labels of an id the highest does; repeated rows are scored each; extra
    columns don't matter.  Without labels every text gets grade 0; an empty table gives an empty result.
    """
    model = model or fit_quality(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, most=most)

    def score(texts):
        tails = model.tails(texts)
        expected = model.grades[0] + tails @ np.diff(model.grades)
        first = int(np.searchsorted(model.grades, good))  # the lowest grade that is good
        p = np.ones(len(tails)) if first == 0 else tails[:, first - 1] if first < len(model.grades) else np.zeros(len(tails))
        return expected, p, p >= cut

    return T.score_texts(docs, keep or [F.col(id_col)], "expected_grade double, p_good double, keep boolean", text_col, score)
