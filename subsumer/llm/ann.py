"""Approximate nearest neighbours with balanced posting lists.

Balanced clusters are fitted on a bounded sample. Every vector goes to the list of its nearest centroid and, near a
boundary, to those of further centroids. A query walks a graph of the centroids, held in memory, and reads the
lists whose centroids are not much farther than the nearest. Lists are read in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import table


#: More than rounding changes a cosine.
ROOM = 1e-9


@dataclass(frozen=True)
class Lists:
    """k: answers. list_rows: distinct vectors a list, on average, until there are most_lists. boundary: a vector is
    replicated to centroids that are farther by this share at most, `replicas` lists in all. reach: a query reads
    lists that are farther by this share at most. degree, beam: of the graph and of the walk."""

    k: int = 5
    list_rows: int = 256
    most_lists: int = 2048
    boundary: float = 0.1
    replicas: int = 4
    reach: float = 0.3
    degree: int = 24
    beam: int = 96


@dataclass(frozen=True)
class Graph:
    """Unit centroids, and for each its neighbours."""

    centroids: np.ndarray
    neighbours: np.ndarray
    entries: np.ndarray

    def walk(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The `beam` nearest centroids of each row of q that a best-first walk finds, nearest first, and their distances."""
        n, k = len(q), len(self.centroids)
        beam = min(beam, k)
        dist = np.full((n, k), np.inf)
        done = np.zeros((n, k), bool)
        rows = np.arange(n)
        dist[:, self.entries] = _distances(q, self.centroids[self.entries])
        for _ in range(beam):
            open_ = np.where(done, np.inf, dist)
            at = open_.argmin(axis=1)
            worst = np.partition(dist, beam - 1, axis=1)[:, beam - 1]
            go = open_[rows, at] < np.where(np.isfinite(worst), worst * (1 + 1e-12) + 1e-300, np.inf)
            if not go.any():
                break
            r, at = rows[go], at[go]
            done[r, at] = True
            near = self.neighbours[at]
            d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nd,nkd->nk", q[r], self.centroids[near])))
            dist[r[:, None], near] = d
        order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        return order, np.take_along_axis(dist, order, axis=1)


def _distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (q @ c.T)))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither over- nor underflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_graph(sample: np.ndarray, n_lists: int, settings: Lists) -> Graph:
    x = _unit(sample)
    means = np.stack([x[rows].mean(axis=0) for rows in vectors.balanced_clusters(x, n_lists)])
    centroids = _unit(means + 1e-12)
    near = np.argsort(_distances(centroids, centroids), axis=1, kind="stable")[:, 1 : settings.degree + 1]
    entries = np.unique(np.linspace(0, len(centroids) - 1, min(16, len(centroids))).astype(int))
    # a ring joins what the nearest neighbours leave apart
    ring = (np.arange(len(centroids))[:, None] + np.array([1, -1])) % len(centroids)
    return Graph(centroids, np.column_stack((near, ring)), entries)


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of rows of a and b in doubles."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def nearest(rows: DataFrame, queries: DataFrame, settings: Lists = Lists()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query in rows (vec_id, embedding), by cosine.

    queries: ids (query_id) of rows. A row isn't its own neighbour. Null ids, and vectors that are null, zero or hold null or
    non-finite components, take no part; nor do vectors of another length than the most frequent one. Rows
    that repeat an id and vector count once. Ties go to smaller ids. Fewer than k candidates found give fewer rows; empty
    tables give none. Other columns are ignored.
    """
    spark = rows.sparkSession
    held = table(vectors.as_bytes(rows, lambda v: v, F.exists("x", lambda v: v != 0)), "vectors")
    classes = table(vectors.classes_of(held, settings.k + 1), "classes")
    asked = held.join(queries.select(F.col("query_id").alias("vec_id")).distinct(), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), *vectors.keys(), "vec").distinct()
    asked = table(asked, "queries")
    n = classes.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = vectors.sample_of(classes)
    graph = fit_graph(sample, max(1, min(settings.most_lists, n // settings.list_rows, len(sample) // 4)), settings)
    sent = spark.sparkContext.broadcast(graph)

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = sent.value.centroids
        between = _distances(c, c)
        for batch in batches:
            d = _distances(_unit(vectors.matrix(batch["vec"])), c)
            order = np.argsort(d, axis=1, kind="stable")[:, : settings.replicas]
            lists = []
            for own, by in zip(d, order, strict=True):
                chosen = [by[0]]
                for j in by[1:]:
                    # not where a list it has already is nearer to that centroid than the vector is
                    if own[j] <= (1 + settings.boundary) * own[by[0]] and all(between[j, i] > own[j] for i in chosen):
                        chosen.append(j)
                lists.append(np.array(chosen, np.int32))
            yield batch.assign(list=lists)[["list", "vec", "ids"]]

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            order, dist = sent.value.walk(_unit(vectors.matrix(batch["vec"])), settings.beam)
            lists = [o[d <= (1 + settings.reach) * d[0]].astype(np.int32) for o, d in zip(order, dist, strict=True)]
            yield batch.assign(list=lists)[["list", "k1", "k2", "vec"]]

    one = asked.groupBy("k1", "k2").agg(F.first("vec").alias("vec"))
    postings = table(classes.mapInPandas(post, "list array<int>, vec binary, ids array<long>").withColumn("list", F.explode("list")), "postings")
    probes = table(one.mapInPandas(probe, "list array<int>, k1 long, k2 long, vec binary").withColumn("list", F.explode("list")), "probes")
    keep = settings.k + 1

    def score(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        a, b = vectors.matrix(q["vec"]), vectors.matrix(v["vec"])
        near = _unit(a) @ _unit(b).T
        # all that reach the last wanted cosine, with room for rounding: ties go by id
        few = min(len(v), keep)
        rows_, cols = np.nonzero(near >= np.partition(near, len(v) - few, axis=1)[:, len(v) - few, None] - ROOM)
        s = exact_cosine(a[rows_], b[cols])
        first = np.array([x[0] for x in v["ids"]])
        order = np.lexsort((first[cols], -s, rows_))
        rows_, cols, s = rows_[order], cols[order], s[order]
        kept = np.arange(len(rows_)) - np.searchsorted(rows_, rows_) < keep
        return vectors.best_of(q["k1"].to_numpy(), q["k2"].to_numpy(), v["ids"].to_numpy(), rows_[kept], cols[kept], s[kept])

    found = vectors.search_blocks(postings, probes, score)
    return vectors.ranked(found, asked.select("query_id", "k1", "k2"), settings.k)
