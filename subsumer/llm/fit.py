"""Fitting: bounded labelled samples, sums over a sample's partitions, and a quasi-Newton minimiser.

A step's loss and gradient are sums over the sample that Spark's tasks make; the driver only holds the parameters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, table

#: Labelled documents that a classifier is fitted on, at most.
SAMPLE_ROWS = 8192
#: Files, and so partial sums, of a sample; rows of a batch that a task works on at a time.
PARTS = 4
ROWS = 64


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Whether the document is kept from fitting: crc32 of its id as text is divisible by 5 (a null id counts as empty)."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, y) of the `rows` labelled documents, none held out, whose ids have the smallest hashes.

    Of several labels of a document the largest counts; null labels are none. Texts without white space around
    count as they are; null texts are left out.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").select("text", "y")


def sums(sample: DataFrame, function: Callable[[pd.DataFrame], np.ndarray], size: int, tail: int = 0) -> np.ndarray:
    """The sum of function(batch), a vector of size + tail, over all batches of a written sample; one partial sum a task.

    The first `size` numbers travel in single precision.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                total = np.asarray(function(batch.iloc[at : at + ROWS]), np.float64) + (0 if total is None else total)
        if total is not None:  # a task without rows sends nothing
            yield pd.DataFrame({"part": [total[:size].astype(np.float32).tobytes() + total[size:].tobytes()]})

    total = np.zeros(size + tail)
    for row in sample.mapInPandas(partial, "part binary").collect():
        total += np.concatenate((np.frombuffer(row["part"], np.float32, size), np.frombuffer(row["part"], np.float64, tail, 4 * size)))
    return total


def written(sample: DataFrame, make: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, name: str) -> DataFrame:
    """What make() makes of the sample, in PARTS files."""
    return table(sample.repartition(PARTS).mapInPandas(make, schema), name)


def minimise(value_and_gradient: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, evaluations: int = 30, memory: int = 5) -> np.ndarray:
    """L-BFGS with step halving, for so many evaluations at most."""
    z, steps = start, []
    f, g = value_and_gradient(z)
    used = 1
    while used < evaluations and np.abs(g).max() > 1e-6:
        d, kept = g.copy(), []
        for s, y in reversed(steps):
            a = (s @ d) / (y @ s)
            kept.append(a)
            d -= a * y
        d *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, np.linalg.norm(g))
        for (s, y), a in zip(steps, reversed(kept), strict=True):
            d += s * (a - (y @ d) / (y @ s))
        length = 1.0
        while used < evaluations:
            z2 = z - length * d
            f2, g2 = value_and_gradient(z2)
            used += 1
            if f2 <= f - 1e-4 * length * (g @ d):
                break
            length /= 2
        else:
            break
        s, y = z2 - z, g2 - g
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
        z, f, g = z2, f2, g2
    return z
