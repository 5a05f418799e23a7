"""Centroid clustering by Lloyd's rounds, with Yinyang bounds: groups of centroids, one lower bound a group.

Centroids are grouped once. A vector keeps an upper bound of the distance to its centroid and a lower bound for each
group of the others; both follow how far centroids moved. A vector whose least lower bound is above its upper bound is left
alone (global filter); of others the groups whose bound is not are found (group filter), and their centroids are
scanned exactly. A round is one map over the written vectors, which leaves each task's sums beside them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Room for rounding in bounds, as a share of them.
SLACK = 1e-9
#: Components up to which squared distances of 1024 dimensions fit a long.
LARGEST = 1 << 25
STATE = "vec_id long, own boolean, x binary, cluster int, upper double, lower binary, distance long, sums array<long>"


@dataclass(frozen=True)
class Clustering:
    """k centroids in groups of `group` on average, moved in so many rounds. Components are floor(scale * x); vectors have
    `dims` of them. The first centroids are the vectors with the smallest sha256 of `seed:vec_id`."""

    k: int = 40
    dims: int = 64
    rounds: int = 5
    scale: float = 256.0
    seed: int = 2
    group: int = 10


class Work:
    """Squared distances that were made, and those that a full scan makes."""

    def __init__(self) -> None:
        self.made = self.all = 0


def whole_vectors(rows: DataFrame, c: Clustering) -> DataFrame:
    """(vec_id, x): the vectors that take part, as 32-bit whole numbers in bytes."""
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.size("x") == c.dims).where(finite)
    fits = F.forall("x", lambda v: F.abs(v * c.scale) < LARGEST)
    y = F.when(fits, F.transform("x", lambda v: F.floor(v * c.scale).cast("int"))).otherwise(F.raise_error(F.lit(f"components reach {LARGEST}: squared distances need not fit a long")))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"vec_id": batch["vec_id"], "x": [np.asarray(v, "<i4").tobytes() for v in batch["y"]]})

    # ids travel as text: a column of longs with nulls would come as doubles
    return good.select(F.col("vec_id").cast("string").alias("vec_id"), y.alias("y")).mapInPandas(pack, "vec_id string, x binary").select(F.col("vec_id").cast("long").alias("vec_id"), "x")


def first_centroids(vectors: DataFrame, c: Clustering) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in their order; all where there are fewer. Rows without an id come last."""
    order = [F.sha2(F.concat(F.lit(f"{c.seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "x"]
    rows = vectors.orderBy(*order).limit(c.k).collect()
    return np.array([np.frombuffer(r["x"], "<i4") for r in rows], np.int64).reshape(len(rows), c.dims)


def grouped(centroids: np.ndarray, n: int) -> np.ndarray:
    """A group for each centroid: five rounds of means, from centroids that stand far apart."""
    x = centroids.astype(np.float64)
    chosen = [0]
    while len(chosen) < min(n, len(x)):
        far = np.min([((x - x[i]) ** 2).sum(axis=1) for i in chosen], axis=0)
        chosen.append(int(far.argmax()))
    means = x[chosen]
    for _ in range(5):
        of = np.argmin(((x[:, None] - means[None]) ** 2).sum(axis=2), axis=1)
        means = np.array([x[of == g].mean(axis=0) if (of == g).any() else means[g] for g in range(len(means))])
    return np.unique(of, return_inverse=True)[1]


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x and y, whole numbers: by products in doubles where these are exact, else by differences."""
    if not len(x) or not len(y):
        return np.zeros((len(x), len(y)), np.int64)
    most = max(int(np.abs(x).max()), int(np.abs(y).max()))
    if 4 * x.shape[1] * most * most < 1 << 53:
        a, b = x.astype(np.float64), y.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(axis=1) for row in y], axis=1)


def assigned(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, groups: np.ndarray, moved: np.ndarray, work: Work | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid of each row of x, ties to the smaller number, and its bounds. cluster: the one before, -1 for none; moved: how far each centroid has moved since."""
    work = work or Work()
    n, members = len(x), [np.flatnonzero(groups == g) for g in range(groups.max() + 1)]
    work.all += n * len(centroids)
    cluster, known = cluster.copy(), cluster >= 0
    upper = np.where(known, (upper + moved[cluster]) * (1 + SLACK) + SLACK, np.inf)
    lower = (lower - np.array([moved[m].max() for m in members])) * (1 - np.sign(lower) * SLACK) - SLACK
    lower[~known] = -np.inf
    # global filter, with the bound and then with the distance itself
    rows = np.flatnonzero(lower.min(axis=1) <= upper)
    best = np.full(len(rows), np.iinfo(np.int64).max)
    old = known[rows]
    best[old] = ((x[rows[old]] - centroids[cluster[rows[old]]]) ** 2).sum(axis=1)
    work.made += int(old.sum())
    upper[rows] = np.where(old, np.sqrt(best.astype(np.float64)) * (1 + SLACK), np.inf)
    still = lower[rows].min(axis=1) <= upper[rows]
    rows, best = rows[still], best[still]
    for g, own in enumerate(members):
        at = np.flatnonzero(lower[rows, g] <= upper[rows])  # group filter
        if not len(at):
            continue
        r = rows[at]
        d = squared(x[r], centroids[own])
        work.made += d.size
        first = d.argmin(axis=1)
        least = d[np.arange(len(at)), first]
        second = np.partition(d, 1, axis=1)[:, 1].astype(np.float64) if len(own) > 1 else np.full(len(at), np.inf)
        before = cluster[r]
        wins = (least < best[at]) | ((least == best[at]) & (own[first] < before))
        # the centroid that is left counts in its group from now on; in this group all were looked at
        left = wins & (before >= 0)
        of = groups[before]
        other = left & (of != g)
        lower[r[other], of[other]] = np.minimum(lower[r[other], of[other]], np.sqrt(best[at][other].astype(np.float64)) * (1 - SLACK))
        inside = wins | ((before >= 0) & (of == g))
        lower[r, g] = np.where(inside, np.sqrt(second) * (1 - SLACK), np.sqrt(least.astype(np.float64)) * (1 - SLACK))
        cluster[r[wins]] = own[first[wins]]
        best[at[wins]] = least[wins]
        upper[r] = np.sqrt(best[at].astype(np.float64)) * (1 + SLACK)
    return cluster, upper, lower


def _round(state: DataFrame, centroids: np.ndarray, groups: np.ndarray, moved: np.ndarray, *, last: bool) -> DataFrame:
    """The written state after one assignment. A task leaves a row (own is false) of its vectors' number and sum for each cluster."""
    k, dims = centroids.shape
    n_groups = int(groups.max()) + 1

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            x = np.frombuffer(b"".join(batch["x"]), "<i4").reshape(len(batch), dims).astype(np.int64)
            lower = np.frombuffer(b"".join(batch["lower"]), np.float64).reshape(len(batch), n_groups)
            cluster, upper, lower = assigned(x, batch["cluster"].to_numpy(np.int64), batch["upper"].to_numpy(np.float64), lower.copy(), centroids, groups, moved)
            out = pd.DataFrame({"vec_id": batch["vec_id"], "own": True, "x": batch["x"], "cluster": cluster.astype(np.int32), "upper": upper, "lower": [b.tobytes() for b in lower]})
            out["distance"] = ((x - centroids[cluster]) ** 2).sum(axis=1) if last else 0
            order = np.argsort(cluster, kind="stable")
            present, at = np.unique(cluster[order], return_index=True)
            sums[present, :dims] += np.add.reduceat(x[order], at, axis=0)
            sums[present, dims] += np.diff(np.append(at, len(x)))
            out["sums"] = None
            yield out
        if not last and sums[:, dims].any():
            yield pd.DataFrame({"vec_id": [None], "own": [False], "x": [None], "cluster": [0], "upper": [0.0], "lower": [None], "distance": [0], "sums": [sums.ravel()]})

    held = state.where("own").select(F.col("vec_id").cast("string").alias("vec_id"), "x", "cluster", "upper", "lower")
    made = held.mapInPandas(make, STATE.replace("vec_id long", "vec_id string"))
    return table(made.withColumn("vec_id", F.col("vec_id").cast("long")), "state")


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid as the floor of its vectors' mean, empty ones as they are; k * (dims + 1) sums come to the driver."""
    k, dims = centroids.shape
    cells = state.where("not own").select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros(k * (dims + 1), np.int64)
    for row in cells:
        sums[row["at"]] = row["v"]
    sums = sums.reshape(k, dims + 1)
    n = sums[:, dims:]
    return np.where(n > 0, sums[:, :dims] // np.maximum(n, 1), centroids)


def cluster(rows: DataFrame, c: Clustering = Clustering()) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each row of rows (vec_id, embedding) that takes part.

    Vectors take part if they have `dims` components, none of them null or non-finite; rows that repeat an id or a vector
    count each; a null id is kept, but is no first centroid while there are others. Distances are squared and exact, ties go
    to the smaller number; a cluster that loses its vectors keeps its centroid. Fewer vectors than k start as so many
    centroids; an empty table gives no rows. Components of LARGEST and more, whose squared distances need not fit a
    long, raise an error. Other columns are ignored.
    """
    spark = rows.sparkSession
    vectors = table(whole_vectors(rows, c), "vectors")
    centroids = first_centroids(vectors, c)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    groups = grouped(centroids, max(1, len(centroids) // c.group))
    none = np.full(int(groups.max()) + 1, -np.inf).tobytes()
    zero: Column = F.lit(0)
    state = vectors.select("vec_id", F.lit(True).alias("own"), "x", F.lit(-1).alias("cluster"), zero.cast("double").alias("upper"), F.lit(none).alias("lower"))
    moved = np.zeros(len(centroids))
    for _ in range(c.rounds):
        state = _round(state, centroids, groups, moved, last=False)
        new = _means(state, centroids)
        moved = np.sqrt(((new - centroids) ** 2).sum(axis=1).astype(np.float64)) * (1 + SLACK)
        centroids = new
    state = _round(state, centroids, groups, moved, last=True)
    own = {r["cluster"]: r["n"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]
    about = spark.createDataFrame([(j, n, sum(own.values()), digest[j]) for j, n in own.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
