"""Toxicity by a counterfactual-regularised classifier.

A logistic regression on hashed words is fitted to labelled documents.  For every
document that names an identity group, its counterfactual has each such term
swapped for another group's; the fit also minimises the squared change of the
score, so that naming a group by itself moves no score and the weight of an
insult can't hide in the group it is aimed at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from . import textfeatures as T
from .wordhash import ALNUM, U64, split

#: Interchangeable group terms, a tuple for each kind of group.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("she", "he"),
    ("her", "his"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "trans", "heterosexual"),
    ("immigrant", "native", "refugee", "foreigner"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("disabled", "deaf", "blind", "autistic"),
    ("old", "young", "elderly", "teenage"),
    ("american", "mexican", "german", "french", "spanish", "chinese", "indian", "russian"),
)


def swaps(terms=IDENTITY_TERMS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the terms, and of what each is swapped for: the next of its kind."""
    pairs = {}
    for kind in terms:
        h = split(pa.array([" ".join(kind)]), ALNUM).hashes & ~U64(1)  # as features are
        for a, b in zip(h, np.roll(h, -1)):
            pairs.setdefault(int(a), int(b))
    keys = np.asarray(sorted(pairs), U64)
    return keys, np.asarray([pairs[int(k)] for k in keys], U64)


class CounterfactualModel:
    """Weights and bias, and by how much a swap of each term changes the sum; small enough for any closure."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float, terms=IDENTITY_TERMS):
        self.keys, self.weights, self.bias = keys, weights, bias
        term, other = swaps(terms)
        self.moves = np.zeros(len(keys))
        if len(keys):
            self.moves[np.searchsorted(keys, term)] = weights[np.searchsorted(keys, other)] - weights[np.searchsorted(keys, term)]

    @staticmethod
    def fit(rows: list[np.ndarray], y: np.ndarray, *, penalty: float = 10.0, l2: float = 0.3, least: float = 4.0, fewest: int = 3, most: int = 4096, terms=IDENTITY_TERMS) -> CounterfactualModel:
        """Fit to feature hashes and 0/1 labels; penalty weighs the score changes under swaps."""
        y = np.asarray(y, float) > 0
        if not len(y) or y.all() or not y.any():
            share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 1e-3
            return CounterfactualModel(np.zeros(0, U64), np.zeros(0), float(np.log(share / (1 - share))))
        term, other = swaps(terms)
        keys = np.union1d(T.telling(rows, y, least, fewest, most), term)
        f = len(keys)
        gradient = CounterfactualModel.gradient(T.Sparse(rows, keys), y, keys, term, other, penalty, l2)
        share = y.mean()
        x = T.adam(gradient, np.append(np.zeros(f), np.log(share / (1 - share))))
        return CounterfactualModel(keys, x[:f], float(x[f]), terms)

    @staticmethod
    def gradient(x_of: T.Sparse, y: np.ndarray, keys: np.ndarray, term: np.ndarray, other: np.ndarray, penalty: float, l2: float):
        """The gradient of the mean log loss + l2 |w|^2 / 2n + penalty * the mean square of w.change over rows with terms, by weights and bias."""
        f, n = x_of.shape[1], x_of.shape[0]
        # The counterfactuals, as differences: -1 for the terms that go, +1 for those that come.
        place = np.searchsorted(keys, term)
        swap = np.full(f, -1, np.int64)
        swap[place] = np.searchsorted(keys, other)
        what = x_of.col[swap[x_of.col] >= 0]
        where = np.repeat(np.arange(n), np.diff(x_of.row_begins))[swap[x_of.col] >= 0]
        d_row = np.concatenate([where, where])
        d_col = np.concatenate([what, swap[what]])
        d_sign = np.concatenate([-np.ones(len(what)), np.ones(len(what))])
        named = max(1, len(np.unique(where)))

        def gradient(x: np.ndarray) -> np.ndarray:
            error = T.sigmoid(x_of.dot(x[:f]) + x[f]) - y
            change = np.bincount(d_row, d_sign * x[d_col], n)
            g = np.empty_like(x)
            g[:f] = (x_of.back(error) + l2 * x[:f]) / n + 2 * penalty / named * np.bincount(d_col, d_sign * change[d_row], f)
            g[f] = error.sum() / n
            return g

        return gradient

    def scores(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The score of each text, and how much that of its counterfactual is above it."""
        h, begins = T.document_features(texts, False)
        z = T.linear(h, begins, self.keys, self.weights) + self.bias
        score = T.sigmoid(z)
        return score, T.sigmoid(z + T.linear(h, begins, self.keys, self.moves)) - score


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held: int = 1, cut: float = 0.7, most: int = 20_000, **options) -> DataFrame:
    """Per row: the id, held_out, score (0 to 1), predicted (1 if score >= cut) and swap_change.

    swap_change is the score of the text with every identity term swapped, less its own: 0 without such terms.

    Learns from at most ``most`` labels of ids whose crc32 as text mod folds is not held.  Only the text
    is an input of a score; null and empty texts get the score of no words.  Null labels and ids teach
    nothing, a null id is not held out, repeated rows are scored each, extra columns don't matter; with
    no labels of a kind all scores are near its absence; an empty table gives an empty result.
    """
    rest = F.crc32(F.col(id_col).cast("string")) % folds
    sample = T.labelled_sample(docs, labels, label_col, id_col=id_col, text_col=text_col, most=most, train=rest != held)
    model = CounterfactualModel.fit(*T.fetch(sample, lambda t: T.document_features(t, False)), **options)
    store.release_memory()  # the driver's, of the sample

    def score(texts):
        s, change = model.scores(texts)
        return s, (s >= cut).astype(np.int32), change

    return T.score_texts(docs, [F.col(id_col), F.coalesce(rest == held, F.lit(False)).alias("held_out")], "score double, predicted int, swap_change double", text_col, score)
