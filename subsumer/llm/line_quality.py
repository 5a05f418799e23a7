"""Quality: a linear-chain conditional random field labels every line of a text good or bad.

Lines are described by shares of characters, repetition and length, their own and their neighbours'. The field's
forward-backward marginals, weighted by the lines' lengths, add up to the document's quality. It is fitted on
documents' labels, which count for each of their lines; a last step maps the sum to the likelihood of the label.
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

#: The class of each byte.
CLASSES = ("lower", "upper", "digit", "space", "stop", "mark", "bar", "symbol", "other")
LOWER, UPPER, DIGIT, SPACE, STOP, MARK, BAR, SYMBOL, OTHER = range(len(CLASSES))
BYTE_CLASS = np.full(256, OTHER, np.uint8)
for _class, _bytes in (
    (LOWER, bytes(range(97, 123)) + bytes(range(128, 256))),
    (UPPER, bytes(range(65, 91))),
    (DIGIT, b"0123456789"),
    (SPACE, b" \t\r\f\v"),
    (STOP, b".,;:'\"()-"),
    (MARK, b"!?"),
    (BAR, b"|/\\_=<>[]{}~^`"),
    (SYMBOL, b"*#$%&@+"),
):
    BYTE_CLASS[list(_bytes)] = _class
OWN = 9
FEATURES = 3 * OWN + 1
#: Texts whose lines are described at a time have so many bytes, or are one text.
BATCH_BYTES = 1 << 22
PENALTY = 1e-3


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (rows of FEATURES) and lengths in bytes of all lines, and the number of lines of each text.

    Lines are split at line feeds; blank lines count as lines of length 0. A text has one line at least.
    """
    lines = [t.split("\n") for t in texts]
    per_text = np.array([len(x) for x in lines], np.int64)
    n = int(per_text.sum())
    data = np.frombuffer("\n".join(texts).encode("utf-8", "replace"), np.uint8)
    line_of = np.zeros(len(data), np.int64)
    ends = np.flatnonzero(data == 10)
    line_of[ends + 1 if len(ends) and ends[-1] + 1 < len(data) else ends[:-1] + 1] = 1
    line_of = np.cumsum(line_of)
    counts = np.bincount(line_of * len(CLASSES) + BYTE_CLASS[data], minlength=n * len(CLASSES))[: n * len(CLASSES)].reshape(n, len(CLASSES)).astype(float)
    counts[:, OTHER] -= np.bincount(line_of[ends], minlength=n)[:n]  # the line feeds
    length = counts.sum(axis=1)
    letters = counts[:, LOWER] + counts[:, UPPER]
    solid = np.maximum(length - counts[:, SPACE], 1)
    repeated = np.zeros((n, 2))
    at = 0
    for own in lines:
        seen: set[str] = set()
        for line in own:
            words = line.split()
            if len(words) > 1:
                repeated[at, 0] = 1 - len(set(words)) / len(words)
            if line and line in seen:
                repeated[at, 1] = 1
            seen.add(line)
            at += 1
    own = np.column_stack(
        (
            counts[:, UPPER] / np.maximum(letters, 1),
            np.minimum(1, 4 * counts[:, SYMBOL] / solid),
            np.minimum(1, 4 * counts[:, MARK] / solid),
            counts[:, DIGIT] / solid,
            np.minimum(1, 2 * counts[:, BAR] / solid),
            counts[:, STOP] / solid,
            repeated,
            np.log1p(length) / 8,
        )
    )
    first = np.zeros(n, bool)
    last = np.zeros(n, bool)
    if n:
        ends_at = np.cumsum(per_text)
        first[np.concatenate(([0], ends_at[:-1]))] = True
        last[ends_at - 1] = True
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first], after[last] = 0, 0
    return np.column_stack((own, before, after, np.ones(n))), length, per_text


def marginals(evidence: np.ndarray, per_text: np.ndarray, stay: float) -> tuple[np.ndarray, np.ndarray]:
    """For each line the log odds that it is good, and the likelihood that the next line of its text has the same label.

    evidence: log odds of each line alone. A pair of equal labels has the potential exp(stay). Messages are log
    odds and go over all texts at once, a line of each at a time.
    """
    n, starts = len(evidence), np.cumsum(per_text) - per_text
    forward, backward, same = evidence.copy(), np.zeros(n), np.ones(n)
    order = np.argsort(-per_text, kind="stable")
    counts, begin = per_text[order], starts[order]
    longest = int(counts[0]) if len(counts) else 0
    active = np.searchsorted(-counts, -np.arange(longest + 1), side="left")  # texts with more than t lines

    def passed(m: np.ndarray) -> np.ndarray:
        return np.logaddexp(stay + m, 0) - np.logaddexp(m, stay)

    for t in range(1, longest):
        i = begin[: active[t]] + t
        forward[i] += passed(forward[i - 1])
    for t in range(longest - 1, 0, -1):
        i = begin[: active[t]] + t
        later = evidence[i] + backward[i]
        backward[i - 1] = passed(later)
        equal = np.logaddexp(forward[i - 1] + later, 0) + stay
        same[i - 1] = 1 / (1 + np.exp(np.clip(np.logaddexp(forward[i - 1], later) - equal, -50, 50)))
    return forward + backward, same


def _log_partition(evidence: np.ndarray, per_text: np.ndarray, stay: float) -> np.ndarray:
    """The log of the sum over all labellings, for each text, where a bad line has potential 1."""
    starts = np.cumsum(per_text) - per_text
    order = np.argsort(-per_text, kind="stable")
    counts, begin = per_text[order], starts[order]
    good, bad = evidence[begin].copy(), np.zeros(len(begin))
    longest = int(counts[0]) if len(counts) else 0
    active = np.searchsorted(-counts, -np.arange(longest + 1), side="left")
    for t in range(1, longest):
        k = active[t]
        g, b = good[:k], bad[:k]
        good[:k], bad[:k] = evidence[begin[:k] + t] + np.logaddexp(g + stay, b), np.logaddexp(g, b + stay)
    out = np.empty(len(begin))
    out[order] = np.logaddexp(good, bad)
    return out


@dataclass(frozen=True)
class LineQuality:
    """weights of a line's features, potential of equal neighbours, and slope and offset of the last step."""

    weights: np.ndarray
    stay: float
    slope: float
    offset: float

    def line_odds(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log odds that each line is good, its length, and the number of lines of each text."""
        x, length, per_text = line_features(texts)
        odds, _ = marginals(x @ self.weights, per_text, self.stay)
        return odds, length, per_text

    def shares(self, texts: list[str]) -> np.ndarray:
        """The length-weighted share of good lines of each text."""
        out, at = [], 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (end == at or held + len(texts[end]) <= BATCH_BYTES):
                held += len(texts[end])
                end += 1
            odds, length, per_text = self.line_odds(texts[at:end])
            row = np.repeat(np.arange(end - at), per_text)
            weight = length + 1
            good = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            out.append(np.bincount(row, good * weight, end - at) / np.bincount(row, weight, end - at))
            at = end
        return np.concatenate(out) if out else np.zeros(0)

    def scores(self, texts: list[str]) -> np.ndarray:
        share = np.clip(self.shares(texts), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log(share / (1 - share)) + self.offset, -30, 30)))


def fit_quality(docs: DataFrame, labels: DataFrame, *, label: str = "quality", rows: int = fit.SAMPLE_ROWS) -> LineQuality:
    """A field fitted on `rows` labelled documents at most (see fit.labelled_sample for nulls, ties and repeated ids).

    Without any labelled document all scores are 1/2. Columns besides doc_id, text and the label are ignored.
    """

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), fit.ROWS):
                x, length, per_text = line_features(batch["text"].iloc[at : at + fit.ROWS].tolist())
                cuts = np.cumsum(per_text)[:-1]
                yield pd.DataFrame(
                    {
                        "y": batch["y"].iloc[at : at + fit.ROWS].to_numpy(),
                        "lines": [v.astype(np.float32).tobytes() for v in np.split(x, cuts)],
                        "length": [v.astype(np.float32).tobytes() for v in np.split(length, cuts)],
                    }
                )

    sample = fit.written(fit.labelled_sample(docs, labels, label, rows), describe, "y double, lines binary, length binary", "lines")

    def unpacked(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        per_text = np.array([len(v) // 4 for v in batch["length"]], np.int64)
        x = np.frombuffer(b"".join(batch["lines"]), np.float32).reshape(-1, FEATURES).astype(float)
        return x, np.frombuffer(b"".join(batch["length"]), np.float32).astype(float), per_text, batch["y"].to_numpy()

    n = fit.sums(sample, lambda b: np.array([len(b)]), 0, 1)[0]
    if not n:
        return LineQuality(np.zeros(FEATURES), 0.0, 0.0, 0.0)

    def loss(z: np.ndarray) -> tuple[float, np.ndarray]:
        def partial(batch: pd.DataFrame) -> np.ndarray:
            x, _, per_text, y = unpacked(batch)
            weights, stay = z[:-1], float(z[-1])
            evidence = x @ weights
            odds, same = marginals(evidence, per_text, stay)
            row = np.repeat(np.arange(len(y)), per_text)
            error = 1 / (1 + np.exp(-np.clip(odds, -50, 50))) - y[row]
            share = 1 / per_text  # each document counts alike
            value = _log_partition(evidence, per_text, stay) - y * np.bincount(row, evidence, len(y)) - stay * (per_text - 1)
            return np.concatenate((x.T @ (error * share[row]), [((same - 1) * share[row]).sum(), (value * share).sum()]))

        total = fit.sums(sample, partial, 0, FEATURES + 2) / n
        return total[-1] + PENALTY / 2 * (z @ z), total[:-1] + PENALTY * z

    z = fit.minimise(loss, np.zeros(FEATURES + 1), evaluations=40)
    field = LineQuality(z[:-1], float(z[-1]), 1.0, 0.0)

    def last_step(ab: np.ndarray) -> tuple[float, np.ndarray]:
        def partial(batch: pd.DataFrame) -> np.ndarray:
            x, length, per_text, y = unpacked(batch)
            odds, _ = marginals(x @ field.weights, per_text, field.stay)
            row = np.repeat(np.arange(len(y)), per_text)
            good = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            share = np.clip(np.bincount(row, good * (length + 1), len(y)) / np.bincount(row, length + 1, len(y)), 1e-6, 1 - 1e-6)
            v = np.log(share / (1 - share))
            raw = ab[0] * v + ab[1]
            error = 1 / (1 + np.exp(-np.clip(raw, -50, 50))) - y
            return np.array([(error * v).sum(), error.sum(), (np.logaddexp(0, raw) - y * raw).sum()])

        total = fit.sums(sample, partial, 0, 3) / n
        return total[2] + PENALTY / 2 * (ab @ ab), total[:2] + PENALTY * ab

    slope, offset = fit.minimise(last_step, np.array([1.0, 0.0]), evaluations=20)
    return LineQuality(field.weights, field.stay, float(slope), float(offset))


def quality_score(model: LineQuality, docs: DataFrame, text: str = "text") -> Column:
    """The score from 0 to 1 of each whole text.

    Null counts as empty: one blank line. Long texts are read whole. Equal texts have equal scores, rows come back as
    often as they are, an empty table stays empty, and no column but the text is read.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value.scores(texts.tolist()))

    return score(text_of(text))
