"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

Toxic documents are few, and fewer in some languages: in the fit they weigh WEIGHT times as much as all clean ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fit
from .common import bounded_batches, text_of

BITS = 19
SIZE = 1 << BITS
ORDERS = (4, 5, 6)
#: Characters of a text whose n-grams are made at a time.
PIECE = 1 << 18
#: n-grams of fewer documents of the sample weigh nothing.
LEAST_DOCS = 8
PENALTY, WEIGHT = 1e-3, 20.0


def ngrams(text: str, places: np.ndarray) -> np.ndarray:
    """The distinct hashed n-grams of a text's characters (lower case, white space runs as one space, one at either end).

    places: a work array of SIZE integers that calls may share.
    """
    data = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "replace"), "<u4")
    if len(data) <= PIECE:
        return _distinct(_hashed(data), places)
    seen = np.zeros(SIZE, bool)
    for at in range(0, len(data), PIECE):
        seen[_hashed(data[at : at + PIECE + max(ORDERS) - 1])] = True
    return np.flatnonzero(seen).astype(np.int32)


def _hashed(data: np.ndarray) -> np.ndarray:
    found, h = [], np.zeros(len(data) + 1, np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(data) < n:
            break
        h = h[: len(data) - n + 1] * np.uint32(0x01000193) + data[n - 1 :]
        if n in ORDERS:
            x = h * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            found.append(x >> np.uint32(32 - BITS))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


def _distinct(ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    order = np.arange(len(ids), dtype=places.dtype)
    places[ids] = order
    return ids[places[ids] == order].astype(np.int32)


@dataclass(frozen=True)
class Toxicity:
    """weights: for each hashed n-gram, the classifier's weight times the log-count ratio."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        places = np.zeros(SIZE, np.int32)
        raw = np.array([self.weights[ngrams(t, places)].sum(dtype=np.float64) for t in texts]) if texts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(raw + self.bias, -30, 30)))


def _features(sample: DataFrame) -> DataFrame:
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = np.zeros(SIZE, np.int32)
        for batch in batches:
            for at in range(0, len(batch), fit.ROWS):
                part = batch.iloc[at : at + fit.ROWS]
                yield pd.DataFrame({"y": part["y"], "ids": [packed(ngrams(t, places)) for t in part["text"]]})

    return fit.written(sample, make, "y double, ids binary", "ngrams")


def packed(ids: np.ndarray) -> bytes:
    """Ids in ascending order as the gaps between them, a byte each, behind a byte of 255 for each 255 of a gap."""
    gaps = np.diff(np.sort(ids), prepend=0)
    whole = gaps // 255
    out = np.full(len(ids) + int(whole.sum()), 255, np.uint8)
    out[np.cumsum(whole + 1) - 1] = gaps % 255
    return out.tobytes()


def _flat(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of a batch, and the row of each."""
    sizes = np.fromiter(map(len, batch["ids"]), np.intp, len(batch))
    gaps = np.frombuffer(b"".join(batch["ids"]), np.uint8)
    sums = np.concatenate(([0], np.cumsum(gaps, dtype=np.int64)))
    row, last = np.repeat(np.arange(len(batch)), sizes), gaps < 255
    return (sums[1:] - sums[np.cumsum(sizes) - sizes][row])[last], row[last]


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", rows: int = fit.SAMPLE_ROWS) -> Toxicity:
    """A classifier fitted on `rows` labelled documents at most (see fit.labelled_sample for nulls, ties and repeated ids).

    Without any labelled document all scores are near 0. Columns besides doc_id, text and the label are ignored.
    """
    sample = _features(fit.labelled_sample(docs, labels, label, rows))

    def counts(batch: pd.DataFrame) -> np.ndarray:
        ids, row = _flat(batch)
        toxic = batch["y"].to_numpy()[row] > 0
        return np.concatenate((np.bincount(ids[toxic], minlength=SIZE), np.bincount(ids[~toxic], minlength=SIZE), [len(batch), batch["y"].sum()]))

    total = fit.sums(sample, counts, 2 * SIZE, 2)
    p, q, (n, n_toxic) = total[:SIZE], total[SIZE : 2 * SIZE], total[2 * SIZE :]
    if not n:
        return Toxicity(np.zeros(SIZE, np.float32), -30.0)
    ratio = np.log((p + 1) / (p + 1).sum()) - np.log((q + 1) / (q + 1).sum())
    ratio[p + q < min(LEAST_DOCS, n_toxic)] = 0
    context = docs.sparkSession.sparkContext
    for_toxic, for_clean = WEIGHT * n / (2 * max(n_toxic, 1)), n / (2 * max(n - n_toxic, 1))

    def loss(z: np.ndarray) -> tuple[float, np.ndarray]:
        sent = context.broadcast(((z[:-1] * ratio).astype(np.float32), float(z[-1])))

        def partial(batch: pd.DataFrame) -> np.ndarray:
            weights, bias = sent.value
            ids, row = _flat(batch)
            y = batch["y"].to_numpy()
            raw = np.bincount(row, weights=weights[ids], minlength=len(batch)) + bias
            own = np.where(y > 0, for_toxic, for_clean)
            error = own * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y)
            return np.concatenate((np.bincount(ids, weights=error[row], minlength=SIZE), [error.sum(), (own * (np.logaddexp(0, raw) - y * raw)).sum()]))

        total = fit.sums(sample, partial, SIZE, 2) / n
        sent.destroy()
        gradient = np.concatenate((total[:SIZE] * ratio + PENALTY * z[:-1], [total[SIZE]]))
        return total[-1] + PENALTY / 2 * (z[:-1] @ z[:-1]), gradient

    z = fit.minimise(loss, np.zeros(SIZE + 1), memory=4)
    return Toxicity((z[:-1] * ratio).astype(np.float32), float(z[-1]))


def toxicity_score(model: Toxicity, docs: DataFrame, text: str = "text") -> Column:
    """The score from 0 to 1 of each whole text. The model (2 MB, a fixed size) is broadcast.

    Null counts as empty; empty texts, and texts of white space alone, have the score of a text without n-grams that weigh
    anything. Long texts are read whole, PIECE characters at a time. Equal texts have equal scores, rows come back as
    often as they are, an empty table stays empty, and no column but the text is read.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value.scores(texts.tolist()))

    return score(text_of(text))
