"""Near duplicates: fast similarity sketches, banding, verification on whole shingle sets, connected components.

The sketch is that of Dahlgaard, Knudsen and Thorup: in round i of the first BINS each shingle is hashed to a
bin with a value in [i, i + 1); in round BINS + j every shingle goes to bin j. A bin keeps its smallest value, and
rounds end when all bins are filled, which the second half guarantees. A bin's values in two sets agree with
the likelihood of their similarity, with concentration bounds, at about one hash a shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, small_join, table, text_of

#: Ids up to which a counted table of ids alone may be broadcast (16 bytes a row).
BROADCAST_IDS = 500_000
#: Prefix entries of one shingle that a task joins with all others of it.
DEALT_ROWS = 2000


@dataclass(frozen=True)
class Near:
    """Documents are linked if 100 * intersection >= percent * union of their sets of `words`-word shingles.

    bands * rows values are sketched. At a similarity of 0.8 a pair agrees in none of 32 bands of 6 with a
    likelihood of 6e-5.
    """

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 6
    seed: int = 11


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    """The last steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, or more, of the multiplier and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            inverse = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
            for name, base in (("up", _MULTIPLIER), ("down", inverse)):
                values = np.full(size, base, np.uint64)
                values[0] = 1
                _POWERS[name] = np.cumprod(values)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased: polynomials in their bytes, from prefix sums."""
    raw = text.encode("utf-8", "replace").lower()
    data = np.frombuffer(raw, np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])))
        return _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of `words` words; of the whole sequence where there are fewer; none without words."""
    hashes = word_hashes(text)
    n = min(words, len(hashes))
    if not n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(len(hashes) - n + 1, n, np.uint64)
        for i in range(n):
            out = _mixed(out * _MULTIPLIER + hashes[i : len(hashes) - n + 1 + i])
    return np.unique(out)


def sketch(shingles: np.ndarray, bins: int, seed: int) -> np.ndarray:
    """The fast similarity sketch of a set that is not empty: for each bin the round and value of its smallest entry."""
    out = np.zeros(bins, np.uint64)
    empty = np.ones(bins, bool)
    with np.errstate(over="ignore"):
        for i in range(2 * bins):
            h = _mixed(shingles ^ (np.uint64(seed * 1_000_003 + i) * _MULTIPLIER))
            if i < bins:
                to, value = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32), h & np.uint64(0xFFFFFFFF)
                new = empty[to.astype(np.intp)]
                both = np.sort((to[new] << np.uint64(32)) | value[new])
                to = (both >> np.uint64(32)).astype(np.intp)
                first = np.flatnonzero(np.diff(to, prepend=-1))
                out[to[first]] = (np.uint64(i) << np.uint64(32)) | (both[first] & np.uint64(0xFFFFFFFF))
                empty[to[first]] = False
            elif empty[i - bins]:
                out[i - bins] = (np.uint64(i) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)).min()
                empty[i - bins] = False
            if not empty.any():
                break
    return out


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.arange(bands, dtype=np.uint64)
        for i in range(rows):
            key = _mixed(key * _MULTIPLIER + values.reshape(bands, rows)[:, i])
    return key.view(np.int64)


def sketched(docs: DataFrame, near: Near) -> DataFrame:
    """(doc_id, n, f1, f2, keys) of each row: size and fingerprint of its shingle set, and its bands' keys (none if empty)."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                s = shingle_set(text, near.words)
                if len(s):
                    with np.errstate(over="ignore"):
                        f1, f2 = _mixed(s).sum(), _mixed(s ^ _MULTIPLIER).sum()
                    rows.append((len(s), int(f1.view(np.int64)), int(f2.view(np.int64)), band_keys(sketch(s, near.bands * near.rows, near.seed), near.bands, near.rows)))
                else:
                    rows.append((0, 0, 0, np.zeros(0, np.int64)))
            out = pd.DataFrame(rows, columns=["n", "f1", "f2", "keys"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield out.astype({"doc_id": "Int64"})

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).mapInPandas(make, "doc_id long, n long, f1 long, f2 long, keys array<long>")


def shingles_of(docs: DataFrame, ids: DataFrame, near: Near) -> DataFrame:
    """(doc_id, shingles) of the documents in ids: their whole sets, as bytes."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "shingles": [shingle_set(t, near.words).tobytes() for t in batch["text"]]})

    chosen = small_join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")), ids, ["doc_id"], "left_semi", BROADCAST_IDS)
    return chosen.mapInPandas(make, "doc_id long, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = []
            for x, y in zip(batch["sa"], batch["sb"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(common > 0 and 100 * common >= near.percent * (len(x) + len(y) - common))
            yield batch.loc[kept, ["a", "b"]]

    first = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = first.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInPandas(check, "a long, b long")


def prefix_pairs(docs: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """All pairs (a, b) of docs (rep, n, component) in different components that can be similar enough.

    The sets are ordered by how rare their shingles are among docs. Two sets that are similar enough share one
    of the first n - ceil(percent * n / 100) + 1, where what is left behind it on either side is long enough
    (prefix and position filters, exact). Documents with a fifth of shingles of their own, such as heavily
    edited copies, meet nobody; no pairs within a band are listed. Each text of a document is a set of its own.
    A shingle that stands in more than DEALT_ROWS prefixes is dealt out: one side over parts by document, the other to all parts.
    """

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                size = [len(x) // 8 for x in part["shingles"]]
                yield pd.DataFrame({"rep": np.repeat(part["doc_id"].to_numpy(), size), "own": np.repeat(part["own"].to_numpy(), size), "shingle": np.frombuffer(b"".join(part["shingles"]), np.int64)})

    chosen = small_join(sets, docs.select(F.col("rep").alias("doc_id")).distinct(), ["doc_id"], "left_semi", BROADCAST_IDS)
    chosen = chosen.select("doc_id", F.xxhash64("shingles").alias("own"), "shingles")
    owners = chosen.select(F.col("doc_id").alias("rep"), "own", (F.length("shingles") / 8).cast("long").alias("n")).distinct()
    owners = owners.join(docs.groupBy("rep").agg(F.min("component").alias("component")), "rep")
    entries = table(chosen.mapInPandas(explode, "rep long, own long, shingle long").distinct(), "entries")
    common = entries.groupBy("shingle").agg(F.count("*").alias("df"))
    order = Window.partitionBy("rep", "own").orderBy("df", "shingle")
    placed = entries.join(common, "shingle").withColumn("at", F.row_number().over(order)).join(owners, ["rep", "own"])
    prefix = table(placed.where((F.col("df") > 1) & (F.col("at") <= F.col("n") - F.ceil(near.percent * F.col("n") / 100) + 1)), "prefixes")
    parts = F.ceil(F.col("df") / DEALT_ROWS)
    x = prefix.select("shingle", F.pmod(F.xxhash64("rep"), parts).alias("part"), F.col("rep").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa"), F.col("component").alias("ca"))
    y = prefix.select("shingle", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"), F.col("component").alias("cb"))
    # holds at the first shingle that two similar sets share: nothing before it is common
    enough = (1 + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))) * (100 + near.percent) >= near.percent * (F.col("na") + F.col("nb"))
    sizes = 100 * F.least("na", "nb") >= near.percent * F.greatest("na", "nb")
    return x.join(y, ["shingle", "part"]).where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & sizes & enough).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (a, b): the smallest id that it is connected with.

    Large-star and small-star steps take turns (Kiveris and others, 2014) until the edges stay the same; all that
    the driver sees is a count and a checksum.
    """

    def star(pairs: DataFrame) -> DataFrame:
        """(u, v, m): for each u and neighbour v the smallest m of u and its neighbours. m is summed up before the
        shuffle and written, so that a hub's rows stay where they are (broadcast) or are split (AQE's skew join)."""
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return small_join(pairs, least, ["u"], rows=BROADCAST_IDS)

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = state(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = star(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        e = table(small.where("u <> v").distinct(), "edges")
        after = state(e)
        if after == before:
            break
        before = after
    members = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, near: Near = Near(), *, exact: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    Texts with equal sets are one class, found by a fingerprint of 128 bits; the smallest doc_id stands for it.
    Class representatives that share a band are compared on their whole sets with the smallest id of the band and a
    second one; then, over all bands that still hold several components, an exact join of prefixes finds what links
    different components. What is lost are pairs that share no band at all (see Near for how likely that is), unless `exact`:
    then the join of prefixes covers all classes in different components, whatever bands they are in, and no link is lost;
    every distinct shingle of every class is shuffled for it. Texts of any length are read whole; an empty table stays empty.
    Null texts are empty; texts without words are linked with nothing. Rows with equal doc_id are one document that is linked as each of them. Rows with a
    null doc_id are linked with nothing: component_id is null and kept false. Other columns are ignored.
    """
    rows = table(sketched(docs, near), "sketches")
    some = rows.where("n > 0 and doc_id is not null")
    classes = table(some.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")), "classes")
    shared = classes.select("rep", "n", F.explode("keys").alias("key"))
    leaders = shared.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("one"), F.min_by(F.struct("rep", "n"), F.xxhash64("rep")).alias("two"), F.count("*").alias("members")).where("members > 1").drop("members")
    multi = table(shared.join(leaders, "key"), "bands")
    compared = classes.select("rep", "n") if exact else multi.select("rep", "n").distinct()
    sets = table(shingles_of(docs, compared.select(F.col("rep").alias("doc_id")).distinct(), near), "sets")

    def fits(n: str, m: str):
        return 100 * F.least(n, m) >= near.percent * F.greatest(n, m)

    def with_leader(which: str) -> DataFrame:
        pair = F.struct(F.least("rep", f"{which}.rep").alias("a"), F.greatest("rep", f"{which}.rep").alias("b"))
        return multi.where(fits("n", f"{which}.n") & (F.col("rep") != F.col(f"{which}.rep"))).select(pair.alias("p")).select("p.*").distinct()

    tried = table(with_leader("one").union(with_leader("two")).distinct(), "pairs")
    links = table(verified(tried, sets, near), "links")
    found = table(components(links), "components")

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))

    if exact:
        several = table(labelled(compared), "several")
    else:  # documents of bands that still hold several components
        bands = table(labelled(multi.select("key", "rep", "n")), "labelled")
        mixed = bands.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
        several = table(bands.join(mixed, "key", "left_semi").select("rep", "n", "component").distinct(), "several")
    rest = prefix_pairs(several, sets, near).join(tried, ["a", "b"], "left_anti")
    rest = table(rest, "rest")
    more = table(verified(rest, sets, near), "more-links")
    # documents with several texts, so in several classes
    members = some.select("doc_id", "f1", "f2", "n").join(classes.select("f1", "f2", "n", "rep"), ["f1", "f2", "n"])
    members = table(members.select("doc_id", "rep").distinct(), "members")
    several_texts = members.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    own = members.join(several_texts, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    extra = table(more.union(own), "extra")
    if extra.head(1):
        found = table(components(links.union(extra)), "components")
    placed = members.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
    placed = placed.groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(placed, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
