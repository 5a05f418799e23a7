"""Importance resampling towards a target distribution, on bucketed n-gram features, by an external sort-count.

Every document's features are written once, as a packed stream of 16-bit buckets with the documents' offsets. Streams are
sorted and run-length encoded for counts, runs are merged as they pile up; later the buckets' gains are gathered along
the streams and summed between the offsets. Draws are the highest weights with a keyed Gumbel noise, ranked by prefix
sums over range partitions.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, running_sum, table

#: Features of a block of the stream, but for documents that have more; runs that are held before they are merged.
BLOCK, RUNS = 16_384, 1 << 20
#: Words whose buckets a task remembers.
CACHED = 1 << 18
#: What separates words: ASCII but digits and a-z, after A-Z are lower-cased; all of it becomes a blank.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WORDS = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in _LOWER)
BLOCKS = "ids array<long>, ends array<int>, words array<int>, stream binary"


@dataclass(frozen=True)
class Resampling:
    """Features are runs of `shortest` to `longest` words; buckets: 65,536 at most. Of the documents with at least
    `least_words` words, `percent` of 100 are drawn, with noise keyed by `seed`."""

    shortest: int = 1
    longest: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: int = 2024


class Buckets(dict):
    """Buckets of features by their bytes: crc32 modulo a number."""

    def __init__(self, n: int) -> None:
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        out = self[feature] = zlib.crc32(feature) % self.n
        return out


def features(text: bytes | None, r: Resampling, buckets: Buckets) -> tuple[int, list[int]]:
    """The number of words, and the bucket of every feature; shorter runs first."""
    words = (text or b"").translate(WORDS).split()
    out = [buckets[w] for w in words] if r.shortest == 1 else []
    for n in range(max(2, r.shortest), r.longest + 1):
        out += [buckets[b" ".join(words[i : i + n])] for i in range(len(words) - n + 1)]
    return len(words), out


def streams(docs: DataFrame, r: Resampling, key: str | None, text: str = "text") -> DataFrame:
    """The written blocks of all rows of docs: documents' keys (null ones without a key column), ends and numbers of words, and the buckets as little-endian 16-bit numbers."""
    if r.buckets > 1 << 16 or not 1 <= r.shortest <= r.longest:
        raise ValueError("buckets fit 16 bits, and runs have a word at least")

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets = Buckets(r.buckets)
        for batch in batches:
            out, ids, ends, words, parts, total = [], [], [], [], [], 0

            def close() -> None:
                stream = np.concatenate(parts) if parts else np.zeros(0, "<u2")
                out.append((list(ids), list(ends), list(words), stream.tobytes()))

            for i, t in zip(batch["id"], batch["text"], strict=True):
                n, found = features(t, r, buckets)
                if parts and total + len(found) > BLOCK:
                    close()
                    for x in (ids, ends, words, parts):
                        x.clear()
                    total = 0
                total += len(found)
                parts.append(np.array(found, "<u2"))
                ids.append(None if pd.isna(i) else int(i))
                ends.append(total)
                words.append(n)
            if parts:
                close()
            yield pd.DataFrame(out, columns=["ids", "ends", "words", "stream"])

    bounded_batches(docs.sparkSession)
    # keys travel as text: a column of longs with nulls would come as doubles
    own = F.col(key).cast("long").cast("string") if key else F.lit(None).cast("string")
    return table(docs.select(own.alias("id"), F.col(text).cast("binary").alias("text")).mapInPandas(make, BLOCKS), "streams")


def runs(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a stream in order and how often each is there: sorted, then run-length encoded."""
    own = np.sort(stream)
    starts = np.flatnonzero(np.diff(own, prepend=-1 if len(own) else 0)) if len(own) else np.zeros(0, np.intp)
    return own[starts], np.diff(np.append(starts, len(own)))


def merged(values: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of several streams as those of one."""
    v, c = np.concatenate(values), np.concatenate(counts)
    order = np.argsort(v, kind="stable")
    v, c = v[order], c[order]
    starts = np.flatnonzero(np.diff(v, prepend=-1)) if len(v) else np.zeros(0, np.intp)
    return v[starts], np.add.reduceat(c, starts) if len(v) else c


def counts(blocks: DataFrame, r: Resampling) -> np.ndarray:
    """How often each bucket is in the streams. A task sends its runs, at most a row a bucket; so does the sum."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values, n, held = [], [], 0
        for batch in batches:
            for stream in batch["stream"]:
                v, c = runs(np.frombuffer(stream, "<u2").astype(np.int64))
                values.append(v)
                n.append(c)
                held += len(v)
                if held > RUNS:
                    v, c = merged(values, n)
                    values, n, held = [v], [c], len(v)
        if values:
            v, c = merged(values, n)
            yield pd.DataFrame({"bucket": v, "n": c})

    out = np.zeros(r.buckets, np.int64)
    for row in blocks.select("stream").mapInPandas(make, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share of the target over that of the raw features, both smoothed by one."""
    k = len(raw)
    raw_all, target_all = float(raw.sum() + k), float(target.sum() + k)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * raw_all / ((float(s) + 1) * target_all))) for s, t in zip(raw, target, strict=True)], np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document of the streams."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, ends, words, stream in zip(batch["ids"], batch["ends"], batch["words"], batch["stream"], strict=True):
                ends = np.asarray(ends, np.int64)
                n = np.diff(ends, prepend=0)
                some = n > 0
                weight = np.zeros(len(n), np.int64)
                if some.any():
                    # documents without features have no place in the stream
                    weight[some] = np.add.reduceat(gain[np.frombuffer(stream, "<u2")], (ends - n)[some]) // n[some]
                yield pd.DataFrame({"doc_id": pd.array([None if pd.isna(i) else int(i) for i in ids], dtype="Int64"), "n_words": np.asarray(words, np.int64), "n_features": n, "weight": weight})

    return blocks.mapInPandas(make, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 g), g a Gumbel variate keyed by seed and id (a null id counts as empty)."""
    own = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(own, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, r: Resampling = Resampling()) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs (doc_id, text), towards target (text); rank is null where a document isn't drawn.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased, of whole texts however long. Null and
    empty texts have no features and weigh 0. Ranks go by score, then smaller doc_id, null ids last, then weight: rows
    that repeat are ranked one after the other. Empty tables give no rows, an empty target no counts. Other columns are
    ignored. Everything but ranks is one pass over the texts and two over the streams.
    """
    blocks = streams(docs, r, "doc_id")
    gain = gains(counts(blocks, r), counts(streams(target, r, None), r))
    scored = weights(blocks, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), r.seed))
    scored = table(scored, "scored")
    may = F.col("n_words") >= r.least_words
    drawn = r.percent * scored.where(may).count() // 100
    order = ["_down", "_null", "doc_id", "weight", "n_features"]
    own = scored.where(may).withColumns({"_down": -F.col("score"), "_null": F.col("doc_id").isNull(), "_one": F.lit(1)})
    ranks = running_sum(own, order, "_one", "_before")
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = ranks.select(*columns, F.when(F.col("_before") < drawn, F.col("_before") + 1).cast("long").alias("rank"))
    return ranked.union(scored.where(~may).select(*columns, F.lit(None).cast("long").alias("rank")))
