"""Repeated passages by the common-prefix interval tree of an enhanced suffix array, and their removal.

A suffix array of all bytes of a corpus doesn't fit a task, so starts are dealt out by content. Each start of a window of
`length` bytes belongs to an anchor in it: the place of the window's smallest hash of GRAM bytes. Equal windows have
their anchors at the same place, so a repeat lies among the starts of anchors with equal hashes. The starts of one anchor and
all bytes that their windows reach are a context. Contexts meet by anchor in one shuffle of places alone: equal ones count
once, at their first place, and anchors with a single context are unique. Only the rest fetch their bytes; they are dealt to tasks
by anchor, where a suffix array with common-prefix lengths is scanned with a stack: each interval of the tree is a repeat with
all its places, maximal if the bytes before them differ.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, partitions_for, running_sum, small_join, table

#: Bytes of an anchor's gram. Window starts that are hashed at a time. Contexts of a batch of suffix arrays.
GRAM, PIECE, BATCH = 32, 1 << 20, 8192
#: Documents whose anchors are looked at for frequent ones, on average at most; places of a frequent one in them at least; parts of it, a power of 2.
LOOKED_AT, OFTEN, PARTS = 4096, 16, 64
#: Window starts beside each other that a crowded anchor deals out together.
STRIDE = 8
#: Copies' ids up to which a counted table of them is broadcast.
BROADCAST_IDS = 500_000
_EVEN = np.uint64(0xBF58476D1CE4E5B9)
_ODD = np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Repeats:
    """length: bytes of a repeat at least. crowd: distinct contexts of one anchor that a suffix array holds; the starts of anchors with more are dealt out
    again, see finer(). If there still are more, they are dealt out in parts, and what is first in each part is compared by windows across the parts."""

    length: int = 100
    crowd: int = 2048


# --- hashes of all windows ------------------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _EVEN
    return x ^ (x >> np.uint64(29))


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the `size` bytes from each place that has so many behind it."""
    with np.errstate(over="ignore"):
        h, n = _mixed((data.astype(np.uint64) + np.uint64(1)) * _STEP), 1
        while n < size:
            step = min(n, size - n)  # the last step may overlap
            h = _mixed(h[: len(h) - step] * _ODD + (h[step:] ^ _STEP))
            n += step
        return h


def _least(keys: np.ndarray, size: int) -> np.ndarray:
    """The smallest of `size` keys from each place."""
    n = 1
    while n < size:
        step = min(n, size - n)
        keys = np.minimum(keys[: len(keys) - step], keys[step:])
        n += step
    return keys


def anchored(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last): of each anchor of the documents that end at `ends` in data, its gram's hash, and its first and last window start."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none
    h = grams(data, GRAM)
    # the upper half of a hash, then the place: the leftmost of the smallest
    least = _least((h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1)
    sizes = np.diff(ends, prepend=0)
    end_of = np.repeat(ends, sizes)
    starts = np.flatnonzero(np.arange(len(least)) + length <= end_of[: len(least)])
    if not len(starts):
        return none, none, none
    anchor = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = np.flatnonzero(np.diff(anchor, prepend=-1))
    return h[anchor[at]].view(np.int64), starts[at], starts[np.append(at[1:], len(starts)) - 1]


def contexts_of(docs: DataFrame, r: Repeats, often: np.ndarray, *, known: bool = True) -> DataFrame:
    """(h, c, ord, place): the contexts of each document (ord, body): hashes of anchor and context, and where it is, see placed(). Anchors in `often` have
    as many hashes as parts, equal but for their last bits (see whole()); h and c together are 128 bits, 122 of those anchors. known: contexts that equal an earlier one of the texts at hand need not
    meet others, so they are dealt out evenly (by a hash in place of h)."""
    if not GRAM < r.length < 1 << 15:
        raise ValueError(f"repeats have more than {GRAM} bytes, and contexts less than 65536")

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # pieces of some documents, or of one; pieces of a long document share what their windows reach
            pieces, size = [], 0
            for ord_, body in zip(batch["ord"], batch["body"], strict=True):
                for at in range(0, max(1, len(body) - r.length + 1), PIECE):
                    piece = body[at : at + PIECE + r.length - 1]
                    if size + len(piece) > PIECE + r.length and pieces:
                        yield _context_rows(pieces, r.length, often, known)
                        pieces, size = [], 0
                    if len(piece) >= r.length:
                        pieces.append((ord_, at, piece))
                        size += len(piece)
            if pieces:
                yield _context_rows(pieces, r.length, often, known)

    bounded_batches(docs.sparkSession)
    return docs.select("ord", "body").mapInPandas(make, "h long, c long, ord long, place long")


def placed() -> tuple[Column, Column, Column]:
    """at, len and split (is it of a part of a frequent anchor) of a place; the second of its bits says that an equal context is before it."""
    own = F.col("place")
    return F.shiftright(own, 18).alias("at"), F.shiftright(own, 2).bitwiseAND(F.lit(65535)).cast("int").alias("len"), (own.bitwiseAND(F.lit(1)) == 1).alias("split")


def whole() -> Column:
    """What the hashes of all parts of a frequent anchor have in common."""
    return F.col("h").bitwiseAND(F.lit(-PARTS))


def _context_rows(pieces: list[tuple[int, int, bytes]], length: int, often: np.ndarray, known: bool) -> pd.DataFrame:
    whole = b"".join(p[2] for p in pieces)
    sizes = np.array([len(p[2]) for p in pieces])
    ends = np.cumsum(sizes)
    h, first, last = anchored(np.frombuffer(whole, np.uint8), ends, length)
    of = np.searchsorted(ends, first, side="right")
    digest = xxhash.xxh3_64_intdigest
    c = np.array([digest(whole[a:b]) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)], np.uint64)
    at = first - (ends - sizes)[of] + np.array([p[1] for p in pieces])[of]
    split = np.isin(h, often)
    if split.any():
        h[split] = (h[split] & -PARTS) | (c[split] % np.uint64(PARTS)).astype(np.int64)
    ord_ = np.array([p[0] for p in pieces], np.int64)[of]
    return _placed_rows(h, c.view(np.int64), ord_, at, last - first + length, split, known)


def _placed_rows(h: np.ndarray, c: np.ndarray, ord_: np.ndarray, at: np.ndarray, size: np.ndarray, split: np.ndarray, known: bool) -> pd.DataFrame:
    again = np.zeros(len(h), bool)
    if known and len(h):
        order = np.lexsort((at, ord_, c, h))
        again[order[1:]] = (h[order][1:] == h[order][:-1]) & (c[order][1:] == c[order][:-1])
        with np.errstate(over="ignore"):
            h[again] = _mixed(ord_[again].view(np.uint64) * _ODD + at[again].view(np.uint64)).view(np.int64)
    return pd.DataFrame({"h": h, "c": c, "ord": ord_, "place": (at << 18) | (size << 2) | (again.astype(np.int64) << 1) | split})


def frequent(docs: DataFrame, r: Repeats, rows: int) -> np.ndarray:
    """Anchors with more places than a quarter of a task's share, as far as a bounded number of the `rows` documents shows: how work is dealt, not its result, depends on them."""
    some = docs.where(F.pmod(F.xxhash64("ord"), F.lit(-(-rows // LOOKED_AT))) == 0) if rows else docs
    held = table(contexts_of(some, r, np.zeros(0, np.int64), known=False).groupBy("h").agg(F.count("*").alias("n")), "sampled")
    most = held.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    least = max(OFTEN, most // (4 * partitions_for(docs)))
    return np.array([x["h"] for x in held.where(F.col("n") >= least).select("h").collect()], np.int64)


def met(anchors: DataFrame) -> DataFrame:
    """(h, ord, place, later): of contexts that meet others at their anchor, those that are equal to one before them (later), and first ones among several."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # h and c of the row before, the number of the context among those of h, and the first of h while it is alone
        h0, c0, n, alone = 0, 0, 0, None
        for batch in batches:
            known = (batch["place"].to_numpy(np.int64) & 2) > 0
            if known.any():
                yield batch[["h", "ord", "place"]][known].assign(later=True)
                batch = batch[~known]
            h, c = batch["h"].to_numpy(np.int64), batch["c"].to_numpy(np.int64)
            if not len(h):
                continue
            run = np.diff(h, prepend=h[:1]) != 0
            run[0] = not n or h[0] != h0
            new = run | (np.diff(c, prepend=c[:1]) != 0)
            new[0] = run[0] or c[0] != c0
            firsts = np.flatnonzero(new)
            before = np.cumsum(new) - new
            # contexts of its h that stand before each first one
            since = np.maximum.accumulate(np.where(run, before, -n))
            number = (before - since)[firsts]
            split = (batch["place"].to_numpy(np.int64)[firsts] & 1) == 1
            followed = np.append(number[1:] == 1, False)
            shown = np.zeros(len(h), bool)
            shown[firsts] = (number > 0) | followed | split
            out = batch[["h", "ord", "place"]][shown | ~new].assign(later=~new[shown | ~new])
            if alone is not None and len(firsts) and number[0] == 1:
                out = pd.concat([alone, out], ignore_index=True)
            if len(firsts):
                last = firsts[-1]
                alone = batch[["h", "ord", "place"]].iloc[[last]].assign(later=False) if number[-1] == 0 and not split[-1] else None
                n = int(number[-1]) + 1
            h0, c0 = h[-1], c[-1]
            yield out

    dealt = anchors.repartition(partitions_for(anchors), "h").sortWithinPartitions("h", "c", "ord", "place")
    return dealt.mapInPandas(make, "h long, ord long, place long, later boolean")


# --- the interval tree of a batch of contexts -----------------------------------------------------------------------


@dataclass(frozen=True)
class Intervals:
    """The interval tree of the suffixes of contexts that start a repeat: in suffix order each one's context, place in it and cover (the length of the
    longest repeat that it is a later place of, 0 if of none); and the maximal repeats as (length, first, last) in that order."""

    context: np.ndarray
    place: np.ndarray
    cover: np.ndarray
    maximal: list[tuple[int, int, int]]


def repeated_starts(data: np.ndarray, bases: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in data, its context) of every window start whose window is there more than once and doesn't always follow the same byte; a context's first place always counts as such."""
    n = sizes - length + 1
    context = np.repeat(np.arange(len(sizes)), n)
    starts = np.arange(len(context)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bases, n)
    h = grams(data, length)[starts]
    order = np.argsort(h, kind="stable")
    new = np.flatnonzero(np.diff(h[order], prepend=h[order][:1] + np.uint64(1)))
    count = np.diff(np.append(new, len(order)))
    left = np.where(starts == bases[context], -1, data[np.maximum(starts - 1, 0)].astype(np.int16))[order]
    diverse = (np.minimum.reduceat(left, new) < 0) | (np.minimum.reduceat(left, new) != np.maximum.reduceat(left, new))
    kept = np.sort(order[np.repeat((count > 1) & diverse, count)])
    return starts[kept], context[kept]


def intervals(bodies: list[bytes], rank: np.ndarray, length: int) -> Intervals:
    """The tree over distinct contexts. rank: the order of the contexts' places; of equal ranks the earlier place in the context is first."""
    sizes = np.array([len(b) for b in bodies])
    bases = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(bodies), np.uint8)
    starts, context = repeated_starts(data, bases, sizes, length)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return Intervals(none, none, none, [])
    ends = (bases + sizes)[context]
    width = int((ends - starts).max())
    padded = np.concatenate((data, np.zeros(width, np.uint8)))
    suffix = np.lib.stride_tricks.sliding_window_view(padded, width)[starts]
    suffix[np.arange(width) >= (ends - starts)[:, None]] = 0
    order = np.lexsort((ends - starts, suffix.view(f"S{width}").ravel()))
    starts, context, ends, suffix = starts[order], context[order], ends[order], suffix[order]
    same = suffix[1:] == suffix[:-1]
    common = np.where(same.all(axis=1), width, same.argmin(axis=1))
    common = np.minimum(common, np.minimum((ends - starts)[1:], (ends - starts)[:-1]))
    place = starts - bases[context]
    left = np.where(place == 0, -1, data[np.maximum(starts - 1, 0)].astype(np.int16))
    # a change of the byte before, or a place where it isn't known
    unlike = np.cumsum(np.concatenate(([0], (left[1:] != left[:-1]) | (left[1:] < 0) | (left[:-1] < 0))))
    turn = np.lexsort((place, rank[context]))
    when = np.empty(len(turn), np.int64)
    when[turn] = np.arange(len(turn))
    cover, maximal = _scan(common.tolist(), when.tolist(), unlike.tolist(), length)
    return Intervals(context, place, np.array(cover, np.int64), maximal)


def _scan(common: list[int], when: list[int], unlike: list[int], length: int) -> tuple[list[int], list[tuple[int, int, int]]]:
    """The stack scan: an open interval is (its length, its first suffix, the earliest of its suffixes). When it closes, or a suffix or an inner
    interval joins one, whichever of the two earliest is later is covered by that length."""
    cover, maximal = [0] * len(when), []
    stack: list[list[int]] = []
    for i in range(1, len(when) + 1):
        n = common[i - 1] if i < len(when) else 0
        start, early = i - 1, i - 1
        while stack and stack[-1][0] > n:
            depth, start, own = stack.pop()
            # the last suffix or inner interval belongs to it
            own, late = (own, early) if when[own] < when[early] else (early, own)
            cover[late] = max(cover[late], depth)
            early = own
            if unlike[i - 1] > unlike[start]:
                maximal.append((depth, start, i - 1))
        if n < length:
            continue
        if stack and stack[-1][0] == n:
            top = stack[-1]
            own, late = (top[2], early) if when[top[2]] < when[early] else (early, top[2])
            cover[late] = max(cover[late], n)
            top[2] = own
        else:
            stack.append([n, start, early])
    return cover, maximal


def _joined(context: np.ndarray, place: np.ndarray, cover: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, place, bytes) of the runs of bytes that the covers at these places make, as long as they go on."""
    order = np.lexsort((place, context))
    context, place, cover = context[order], place[order], cover[order]
    reached = np.maximum.accumulate((context << 20) + place + cover)
    new = np.ones(len(order), bool)
    new[1:] = (context[1:] << 20) + place[1:] > reached[:-1]
    first = np.flatnonzero(new)
    last = np.append(first, len(order))[1:] - 1
    return context[first], place[first], reached[last] - (context[first] << 20) - place[first]


def _arrays(contexts: DataFrame, r: Repeats, *, groups: bool) -> DataFrame:
    """What the suffix arrays of contexts (g, h, split, ord, at, ctx), those of one g together, show: rows of kind "span" (ord, at, len), the runs of covered bytes of
    each context; of kind "window" (w1, w2, ord, at), the windows that are first in their part of a split anchor; with groups, of kind "place" (w1, w2, len, h, c, at), places of maximal repeats in contexts."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        bodies = list(rows["ctx"])
        ord_, at = rows["ord"].to_numpy(np.int64), rows["at"].to_numpy(np.int64)
        turn = np.lexsort((at, ord_))
        rank = np.empty(len(turn), np.int64)
        rank[turn] = np.arange(len(turn))
        tree = intervals(bodies, rank, r.length)
        late = tree.cover > 0
        c, place, cover = tree.context[late], tree.place[late], tree.cover[late]
        own, first, size = _joined(c, place, cover)
        out = [pd.DataFrame({"kind": "span", "w1": 0, "w2": 0, "h": 0, "c": 0, "ord": ord_[own], "at": at[own] + first, "len": size})]
        split = np.flatnonzero(rows["split"].to_numpy(bool))
        if len(split):
            covered = {i: np.zeros(len(bodies[i]) - r.length + 1, bool) for i in split.tolist()}
            for i, p, n in zip(c.tolist(), place.tolist(), cover.tolist(), strict=True):
                if i in covered:
                    covered[i][p : p + n - r.length + 1] = True
            found = [(*_key(bodies[i][p : p + r.length]), ord_[i], at[i] + p) for i, done in covered.items() for p in np.flatnonzero(~done).tolist()]
            if found:
                both = np.array(found, np.int64)
                out.append(pd.DataFrame({"kind": "window", "w1": both[:, 0], "w2": both[:, 1], "h": 0, "c": 0, "ord": both[:, 2], "at": both[:, 3], "len": r.length}))
        if groups:
            h, digest = rows["h"].to_numpy(np.int64), np.array([xxhash.xxh3_64_intdigest(b) for b in bodies], np.uint64).view(np.int64)
            for i, b in enumerate(bodies):
                w1, w2 = _key(b)
                out.append(pd.DataFrame({"kind": "place", "w1": [w1], "w2": w2, "h": h[i], "c": digest[i], "ord": 0, "at": 0, "len": len(b)}))
            for n, first, last in tree.maximal:
                own, p = tree.context[first : last + 1], tree.place[first : last + 1]
                w1, w2 = _key(bodies[own[0]][p[0] : p[0] + n])
                out.append(pd.DataFrame({"kind": "place", "w1": w1, "w2": w2, "h": h[own], "c": digest[own], "ord": 0, "at": p, "len": n}))
        return pd.concat(out, ignore_index=True)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        cut = None  # the anchor of which a part was worked on already
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < BATCH:
                continue
            rows = pd.concat(held, ignore_index=True)
            # all but the last anchor are complete; one with too many contexts goes on in parts
            rest = rows["g"] == rows["g"].iloc[-1]
            rows.loc[rows["g"] == cut, "split"] = True
            if rest.sum() >= r.crowd:
                cut = rows["g"].iloc[-1]
                rows.loc[rest, "split"] = True
                rest[:] = False
            held = [rows[rest]]
            if not rest.all():
                yield work(rows[~rest].reset_index(drop=True))
        if held and sum(map(len, held)):
            rows = pd.concat(held, ignore_index=True)
            rows.loc[rows["g"] == cut, "split"] = True
            yield work(rows)

    dealt = contexts.repartition(partitions_for(contexts), "g").sortWithinPartitions("g")
    return dealt.mapInPandas(make, "kind string, w1 long, w2 long, h long, c long, ord long, at long, len long")


def _key(window: bytes) -> tuple[int, int]:
    both = np.frombuffer(xxhash.xxh3_128_intdigest(window).to_bytes(16, "little"), "<i8")
    return int(both[0]), int(both[1])


# --- the corpus -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Found:
    """docs (ord, doc_id, body): all documents in their order; copies (ord): those whose whole text is that of an earlier one; met, shown: what
    contexts that meet and their suffix arrays show; anchors: all contexts, if groups were asked for."""

    docs: DataFrame
    copies: DataFrame
    met: DataFrame
    shown: DataFrame
    anchors: DataFrame | None = None


def _in_order(docs: DataFrame) -> DataFrame:
    """(ord, doc_id, body, t1, t2): ord orders documents by id: the id itself, unless ids are null or repeat; then rows are numbered, null ids last, rows of an id by their text's hash."""
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("body"), F.xxhash64(F.lit(1), body).alias("t1"), F.xxhash64(F.lit(2), body).alias("t2"))
    odd = own.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is null or n > 1")
    if not odd.head(1):
        return own.select(F.col("doc_id").alias("ord"), "doc_id", "body", "t1", "t2")
    # equal rows may share a key of the ranges: their place in the input parts them
    numbered = own.withColumns({"_null": F.col("doc_id").isNull(), "_at": F.monotonically_increasing_id(), "_one": F.lit(1)})
    return running_sum(numbered, ["_null", "doc_id", "t1", "t2", "_at"], "_one", "ord").select("ord", "doc_id", "body", "t1", "t2")


def regrouped(asked: DataFrame, r: Repeats, *, alone: bool) -> DataFrame:
    """asked (h, ord, place) with g, what meets in one suffix array, at, len and split. Once equal contexts are out, the parts of a frequent anchor
    meet again: in one array, or in as few as hold `crowd` each, and only the latter stay split. alone: keep the context of an anchor that has no other."""
    at, size, split = placed()
    own = asked.select("h", "ord", at, size, split)
    held = own.where("split").groupBy(whole().alias("w")).agg(F.count("*").alias("n"))
    sized = small_join(own.where("split").withColumn("w", whole()), held, ["w"]).where(F.lit(alone) | (F.col("n") > 1))
    arrays = F.least(F.ceil(F.col("n") / r.crowd), F.lit(PARTS)).cast("long")
    part = F.floor(F.col("h").bitwiseAND(F.lit(PARTS - 1)) * arrays / PARTS).cast("long")
    again = sized.select(F.col("w").bitwiseOR(part).alias("g"), "h", "ord", "at", "len", (arrays > 1).alias("split"))
    return own.where("not split").select(F.col("h").alias("g"), "h", "ord", "at", "len", "split").union(again)


def _asked(shown: DataFrame) -> DataFrame:
    return shown.where("not later").select("h", "ord", "place")


def _fetched(rows: DataFrame, meets: DataFrame, *, few: bool = False) -> DataFrame:
    """meets with ctx, the bytes of each context. few: its documents are counted first."""
    lists = meets.groupBy("ord").agg(F.collect_list(F.struct("g", "h", "split", "at", "len")).alias("xs"))
    cut = F.transform("xs", lambda x: F.struct(x["g"].alias("g"), x["h"].alias("h"), x["split"].alias("split"), x["at"].alias("at"), F.substring(F.col("body"), (x["at"] + 1).cast("int"), x["len"]).alias("ctx")))
    bodies = rows.select("ord", "body")
    joined = small_join(bodies, lists, ["ord"]) if few else bodies.join(lists, "ord")
    return joined.select("ord", F.explode(cut).alias("x")).select("ord", "x.*")


def finer(contexts: DataFrame, r: Repeats) -> DataFrame:
    """contexts (ord, at, ctx) of crowded anchors as contexts (h, c, ord, place) of at most STRIDE starts each. Equal windows have their anchor at the same
    place, so those that start as far before it, in strides, meet by the bytes that all windows of a stride hold: where these bytes differ, nothing meets."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest, most = xxhash.xxh3_64_intdigest, r.length - GRAM
        for batch in batches:
            hashes, places = [], []
            for ord_, at, body in zip(batch["ord"].tolist(), batch["at"].tolist(), batch["ctx"], strict=True):
                anchor = int((grams(np.frombuffer(body, np.uint8, r.length), GRAM) & np.uint64(0xFFFFFFFF00000000)).argmin())
                for near in range(0, most + 1, STRIDE):
                    far = min(near + STRIDE - 1, most)
                    first, last = max(anchor - far, 0), min(anchor - near, len(body) - r.length)
                    if first > last:
                        continue
                    own = digest(body[first : last + r.length])
                    both = digest(body[anchor - near : anchor - far + r.length], near)
                    hashes.append((both & ~(PARTS - 1) | own % PARTS, own))
                    places.append((ord_, at + first, last - first + r.length))
            h, c = np.array(hashes, np.uint64).reshape(-1, 2).T.copy().view(np.int64)
            ord_, at, size = np.array(places, np.int64).reshape(-1, 3).T.copy()
            yield _placed_rows(h, c, ord_, at, size, np.ones(len(h), bool), True)

    return contexts.select("ord", "at", "ctx").mapInPandas(make, "h long, c long, ord long, place long")


def find_repeats(docs: DataFrame, r: Repeats = Repeats(), *, groups: bool = False) -> Found:
    """Contexts and repeats of docs (doc_id, text); see Found. Hashes of 128 bits stand for whole texts, contexts (with their anchors') and windows."""
    rows = _in_order(docs)
    ids = table(rows.select("ord", "t1", "t2"), "ids")
    firsts = ids.groupBy("t1", "t2").agg(F.min("ord").alias("first"), F.count("*").alias("n")).where("n > 1")
    # counted and broadcast, or a join of its own: a text that many documents have is not one task's
    copies = table(small_join(ids, firsts, ["t1", "t2"], rows=BROADCAST_IDS).where("ord <> first").select("ord"), "copies")
    single = small_join(rows.select("ord", "body"), copies, ["ord"], "left_anti", BROADCAST_IDS)
    anchors = contexts_of(single, r, frequent(rows, r, ids.count()), known=not groups)
    if groups:
        anchors = table(anchors, "anchors")
    shown = table(met(anchors), "met")
    asked = _asked(shown)
    if groups:
        several = anchors.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("ord", "place")).alias("x")).where("n > 1")
        asked = asked.union(several.select("h", "x.ord", "x.place")).distinct()
    meets = regrouped(asked, r, alone=groups)
    crowded = meets.where("split")
    if not groups and crowded.head(1):
        again = table(met(finer(_fetched(rows, crowded, few=True), r)), "met")
        meets, shown = meets.where("not split").union(regrouped(_asked(again), r, alone=False)), shown.union(again)
    contexts = _fetched(rows, meets)
    return Found(rows, copies, shown, table(_arrays(contexts, r, groups=groups), "shown"), anchors if groups else None)


def spans(found: Found) -> DataFrame:
    """(ord, at, len): bytes of documents, copies apart, that repeat earlier ones; spans of a document may overlap."""
    at, size, _ = placed()
    later = found.met.where("later").select("ord", at, size.cast("long").alias("len"))
    own = found.shown.where("kind = 'span'").select("ord", "at", "len")
    windows = found.shown.where("kind = 'window'").select("w1", "w2", "ord", "at", "len")
    least = windows.groupBy("w1", "w2").agg(F.min(F.struct("ord", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    across = windows.join(least, ["w1", "w2"]).where(F.struct("ord", "at") != F.col("first")).select("ord", "at", "len")
    return later.union(own).union(across)


def maximal_repeats(docs: DataFrame, r: Repeats = Repeats()) -> DataFrame:
    """(g1, g2, n_bytes, doc_id, start): each maximal repeat of docs (a hash of 128 bits, its bytes) with all places, within what an anchor's windows reach.

    A longer passage comes as overlapping repeats, one or more an anchor. Copies of whole documents take part through the first of
    them. Of an anchor that is dealt out in parts, the places of one repeat are those of the parts in which it is maximal.
    """
    found = find_repeats(docs, r, groups=True)
    own = found.shown.where("kind = 'place'").select("w1", "w2", F.col("len").alias("n_bytes"), "h", "c", F.col("at").alias("shift")).distinct()
    places = own.join(found.anchors.select("h", "c", "ord", placed()[0]), ["h", "c"])
    each = table(places.select("w1", "w2", "n_bytes", "ord", (F.col("at") + F.col("shift")).alias("start")).distinct(), "places")
    several = each.groupBy("w1", "w2", "n_bytes").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return each.join(several, ["w1", "w2", "n_bytes"]).join(found.docs.select("ord", "doc_id"), "ord").select(F.col("w1").alias("g1"), F.col("w2").alias("g2"), "n_bytes", "doc_id", "start")


def remove_repeats(docs: DataFrame, r: Repeats = Repeats()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of each row of docs (doc_id, text): without every byte that a string of `length` bytes which starts earlier covers.

    Texts are UTF-8 bytes, whole however long; null is empty, and texts shorter than `length` lose nothing. Earlier is by
    smaller doc_id, then start; null ids come last, rows of one id in the order of their texts' hashes, equal rows in any
    order: one stays. kept is the rest in binary. An empty table gives no rows. Other columns are ignored.
    """
    found = find_repeats(docs, r)
    long_ = found.docs.where(F.length("body") >= r.length)
    copies = small_join(long_.select("ord", F.length("body").cast("long").alias("len")), found.copies, ["ord"], "left_semi", BROADCAST_IDS)
    all_spans = spans(found).union(copies.select("ord", F.lit(0).cast("long").alias("at"), "len"))
    lists = table(all_spans.groupBy("ord").agg(F.collect_list(F.struct("at", "len")).alias("spans")), "spans")

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, body, own in zip(batch["doc_id"], batch["body"], batch["spans"], strict=True):
                if own is None:
                    out.append((i, len(body), 0, 0, body))
                    continue
                turns = np.zeros(len(body) + 1, np.int64)
                at = np.array([s["at"] for s in own], np.int64)
                np.add.at(turns, at, 1)
                np.add.at(turns, at + np.array([s["len"] for s in own], np.int64), -1)
                gone = np.cumsum(turns[:-1]) > 0
                kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
                out.append((i, len(body), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) > 0).sum()), kept))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    bounded_batches(docs.sparkSession)
    base = found.docs.select("ord", F.col("doc_id").cast("string").alias("doc_id"), "body")
    columns = "doc_id string, n_bytes long, n_removed long, n_spans long, kept binary"
    cut = base.join(lists, "ord", "left").select("doc_id", "body", "spans").mapInPandas(make, columns)
    return cut.select(F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "kept")
