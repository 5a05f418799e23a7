"""What the vector searches share: vectors as bytes, classes of equal vectors, balanced clusters, bounded blocks, ranks.

Equal vectors are one class, of which the smallest ids are kept, as many as an answer can need: a vector that a
third of all rows have is searched once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: Distinct vectors that clusters are fitted on, at most.
SAMPLE = 16_384
#: Vectors, and queries, in a block at most, on average.
BLOCK, QUERY_BLOCK = 2048, 512


def as_bytes(rows: DataFrame, component: Callable[[Column], Column], some: Column) -> DataFrame:
    """(vec_id, vec): component(x) of each x as doubles in bytes, of the rows that take part.

    Rows take part if id and vector aren't null, all components are finite, and `some` holds of the components. Of
    several lengths only the most frequent (of those the largest) takes part.
    """
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null and size(x) > 0").where(finite & some)
    lengths = good.groupBy(F.size("x").alias("n")).agg(F.count("*").alias("c")).agg(F.max_by("n", F.struct("c", "n"))).first()[0]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"vec_id": batch["vec_id"], "vec": [np.asarray(v, np.float64).tobytes() for v in batch["x"]]})

    changed = F.transform("x", lambda v: component(v) + F.lit(0.0))  # no negative zero
    return good.where(F.size("x") == (lengths or 0)).select("vec_id", changed.alias("x")).mapInPandas(pack, "vec_id long, vec binary")


def floor_of(scale: float) -> Callable[[Column], Column]:
    """floor(scale * x) as a double: F.floor() makes a long, which cuts what is beyond its range; larger doubles are whole numbers."""
    return lambda x: F.when(F.abs(x * scale) < float(1 << 53), F.floor(x * scale).cast("double")).otherwise(x * scale)


def classes_of(vectors: DataFrame, keep: int) -> DataFrame:
    """(k1, k2, vec, ids): each distinct vector, a key of 128 bits, and its `keep` smallest ids in order."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids: dict[bytes, list[int]] = {}
            for i, v in sorted(zip(batch["vec_id"].tolist(), batch["vec"], strict=True)):
                own = ids.setdefault(v, [])
                if len(own) < keep and i not in own:
                    own.append(i)
            yield pd.DataFrame({"vec": list(ids), "ids": list(ids.values())})

    few = vectors.mapInPandas(partial, "vec binary, ids array<long>")
    one = few.groupBy("vec").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))
    return one.select(*keys(), "vec", "ids")


def keys() -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), "vec").alias("k1"), F.xxhash64(F.lit(2), "vec").alias("k2")


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float64) for v in column]) if len(column) else np.zeros((0, 1))


def sample_of(classes: DataFrame, rows: int = SAMPLE) -> np.ndarray:
    """The distinct vectors with the smallest keys, `rows` at most. Only keys below a bound that about so many reach are put in order: else every task sends its own smallest ones."""
    share = 1.2 * rows / max(classes.count(), 1)
    while share < 1:
        some = classes.where(F.col("k1") < int(share * 2.0**64) - (1 << 63))
        if some.count() >= rows:
            break
        share *= 2
    else:
        some = classes
    return matrix(some.orderBy("k1", "k2").limit(rows).select("vec").toPandas()["vec"])


def balanced_clusters(x: np.ndarray, leaves: int) -> list[np.ndarray]:
    """Rows of x in clusters of sizes that differ by one at most between siblings: each is cut at the median along the line between two means."""
    done, todo = [], [(np.arange(len(x)), leaves)]
    while todo:
        rows, n = todo.pop()
        if n <= 1 or len(rows) < 2 * n:
            done.append(rows)
            continue
        own = x[rows]
        a, b = own[0], own[np.argmax(((own - own[0]) ** 2).sum(axis=1))]
        for _ in range(8):
            side = own @ (b - a) > (b - a) @ (a + b) / 2
            if side.all() or not side.any():
                break
            a, b = own[~side].mean(axis=0), own[side].mean(axis=0)
        order = np.argsort(own @ (b - a), kind="stable")
        cut = len(rows) * (n // 2) // n
        todo += [(rows[order[:cut]], n // 2), (rows[order[cut:]], n - n // 2)]
    return done


def search_blocks(postings: DataFrame, probes: DataFrame, score: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """(k1, k2, ids, score, whole): score(queries, vectors) for each list's probes (list, k1, k2, vec) and postings (list, vec, ids).

    A list's postings and probes are dealt to blocks of bounded size by hash, each block of the one meeting each of
    the other: a list of any size is many small tasks. Lists are as many as clusters, so their sizes fit the driver.
    """
    spark = postings.sparkSession
    size = lambda df, most, name: df.groupBy("list").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    sizes = size(postings, BLOCK, "nb").join(size(probes, QUERY_BLOCK, "nq"), "list")
    sizes = F.broadcast(spark.createDataFrame(sizes.collect(), "list int, nb int, nq int"))
    deal = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    left = probes.join(sizes, "list").withColumn("qb", F.pmod(F.xxhash64("k1", "k2"), "nq").cast("int")).withColumn("pb", F.explode(deal("nb")))
    right = postings.join(sizes, "list").withColumn("pb", F.pmod(F.xxhash64("vec"), "nb").cast("int")).withColumn("qb", F.explode(deal("nq")))
    on = ["list", "pb", "qb"]
    left, right = left.select(*on, "k1", "k2", "vec"), right.select(*on, "vec", "ids")
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(lambda q, v: score(q, v) if len(q) and len(v) else EMPTY.copy(), "k1 long, k2 long, ids array<long>, score double, whole binary")


#: No result. Columns of lists and bytes are objects even if empty: Arrow takes no lists from the doubles that pandas makes of nothing.
EMPTY = pd.DataFrame({"k1": np.zeros(0, np.int64), "k2": np.zeros(0, np.int64), "ids": pd.Series([], dtype=object), "score": np.zeros(0), "whole": pd.Series([], dtype=object)})
#: Whole numbers of smaller size are exact in doubles.
EXACT = 1 << 53


def whole_key(score: int) -> bytes:
    """Bytes in the order of whole numbers; the last eight are the number itself if it is a long."""
    return (score + (1 << 255)).to_bytes(32, "big")


def long_of(score: Column, whole: Column) -> Column:
    """The whole number of a score and its whole_key(), cut to the range of a long."""
    low, high = -(1 << 63), (1 << 63) - 1
    own = F.conv(F.hex(F.substring(whole, 25, 8)), 16, -10).cast("long")
    cut = F.when(whole.isNull(), score.cast("long")).when(whole >= F.lit(whole_key(high)), F.lit(high))
    return cut.when(whole <= F.lit(whole_key(low)), F.lit(low)).otherwise(own)


def best_of(k1: np.ndarray, k2: np.ndarray, ids: np.ndarray, rows: np.ndarray, cols: np.ndarray, score: np.ndarray) -> pd.DataFrame:
    """The result of a block: query rows[i] (of keys k1, k2) and the vector cols[i] (of ids) have score[i]. whole: the whole_key() of scores that are Python's whole numbers of EXACT or more, else null."""
    whole = [whole_key(s) if abs(s) >= EXACT else None for s in score] if score.dtype == object else [None] * len(score)
    return pd.DataFrame({"k1": k1[rows], "k2": k2[rows], "ids": pd.Series(list(ids[cols]), dtype=object), "score": score.astype(np.float64), "whole": pd.Series(whole, dtype=object)})


def ranked(found: DataFrame, queries: DataFrame, k: int, *, whole: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query but itself, ties by vec_id.

    found: (k1, k2, ids, score) of classes of queries, k + 1 best at least where there are so many; queries: (query_id, k1, k2).
    whole: scores are whole numbers, of which those with equal doubles go by their keys (whole), and score is a long.
    """
    # equal doubles below EXACT are equal numbers without keys, and all others have keys
    score = F.struct("score", "whole") if whole else F.col("score")
    each = found.select("k1", "k2", F.explode("ids").alias("vec_id"), score.alias("score")).groupBy("k1", "k2", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "vec_id")
    top = each.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    lists = table(top.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("top")), "top")
    joined = queries.join(lists, ["k1", "k2"])
    own = F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("query_id")), 1, k)
    score = long_of(F.col("t.score.score"), F.col("t.score.whole")) if whole else F.col("t.score")
    return joined.select("query_id", F.posexplode(own).alias("at", "t")).select("query_id", (F.col("at") + 1).alias("rank"), "t.vec_id", score.alias("score"))
