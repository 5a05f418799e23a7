"""Resampling, repeats and clusters on small tables with odd rows, against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from subsumer.llm import repeats, resampling, yinyang
from test_text import docs_of, odd_rows


def plain_resample(rows, target, r):
    def found(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % r.buckets for n in range(r.shortest, r.longest + 1) for i in range(len(words) - n + 1)]

    docs, aim = [(i, *found(t)) for i, t, _ in rows], [b for t in target for b in found(t)[1]]
    raw = [b for d in docs for b in d[2]]
    gain = [math.floor(1000 * math.log((aim.count(b) + 1) * (len(raw) + r.buckets) / ((raw.count(b) + 1) * (len(aim) + r.buckets)))) for b in range(r.buckets)]
    out = []
    for i, words, fs in docs:
        weight = sum(gain[b] for b in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{r.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, words, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    may = sorted((d for d in out if d[1] >= r.least_words), key=lambda d: (-d[4], d[0] is None, d[0] or 0, d[3], d[2]))
    drawn = len(may) * r.percent // 100
    got = [(d[0], *d[2:], n + 1 if n < drawn else None) for n, d in enumerate(may)]
    return got + [(d[0], *d[2:], None) for d in out if d[1] < r.least_words]


@pytest.mark.parametrize("r", [resampling.Resampling(percent=30), resampling.Resampling(1, 3, 512, least_words=5, percent=50, seed=7), resampling.Resampling(2, 2, 64)])
def test_resample(spark, r, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK", 50)
    rows = [(i, t, s) for i, t, s in odd_rows() if i not in (104,)] + [(200, "one two " * 40, "s"), (201, "A\x00b_C9 ÀÉ　x", None)]
    target = ["alpha beta gamma", None, "", "cc by the general public"]
    aim = spark.createDataFrame([(k, t, 1) for k, t in enumerate(target)], "item_id long, text string, doc_id long")
    got = [tuple(x) for x in resampling.resample(docs_of(spark, rows), aim, r).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_resample(rows, target, r)))
    assert resampling.resample(docs_of(spark, []), aim, r).count() == 0


def test_runs_are_counts():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 9, n) for n in (0, 1, 50, 200)]
    v, c = resampling.merged(*zip(*(resampling.runs(p) for p in parts), strict=True))
    assert dict(zip(v.tolist(), c.tolist(), strict=True)) == dict(zip(*(x.tolist() for x in np.unique(np.concatenate(parts), return_counts=True)), strict=True))


def plain_removed(bodies, length):
    """(n_removed, n_spans, kept) of each of the bodies in order."""
    seen, out = set(), []
    for b in bodies:
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = [True] * length
            seen.add(b[p : p + length])
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def passages(seed=5, n=60):
    rng = random.Random(seed)
    words = ["alpha", "beta", "x", "\x00", "ñandú", "語", "gamma delta"]
    text = lambda k: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(k))
    common, base, out = text(25), text(120), []
    for i in range(n):
        kind = i % 6
        near = base.split(" ")
        near[rng.randrange(len(near))] = "edit"
        own = (text(30), text(8) + common + text(9), " ".join(near), text(30), common[: rng.randrange(60, 200)] + text(3), "ab" * rng.randrange(40, 90))[kind]
        out.append(own)
    return out + [base, base, out[0], "long " * 4000]


@pytest.mark.parametrize(("length", "crowd", "piece", "often"), [(100, 2048, 1 << 20, 9999), (60, 3, 150, 9999), (80, 9, 300, 4)])
def test_remove_repeats(spark, monkeypatch, length, crowd, piece, often):
    monkeypatch.setattr(repeats, "OFTEN", often)
    monkeypatch.setattr(repeats, "PIECE", piece)
    monkeypatch.setattr(repeats, "BATCH", 40)
    texts = passages()
    rows = [(i * 3, t, None) for i, t in enumerate(texts)]
    random.Random(2).shuffle(rows)
    rows += [(1000, None, None), (1001, "", None), (1002, "short", None)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]), r["kept_sha256"]) for r in repeats.remove_repeats(docs_of(spark, rows), repeats.Repeats(length, crowd)).collect()}
    rows.sort(key=lambda r: r[0])
    bodies = [(t or "").encode() for _, t, _ in rows]
    for (i, _, _), b, (n, spans, kept) in zip(rows, bodies, plain_removed(bodies, length), strict=True):
        assert got[i] == (len(b), n, spans, kept, hashlib.sha256(kept).hexdigest()), i
    assert len(got) == len(rows)
    assert repeats.remove_repeats(docs_of(spark, []), repeats.Repeats(length, crowd)).count() == 0


@pytest.mark.parametrize(("n", "crowd"), [(120, 2048), (240, 2048), (240, 48), (240, 3)])
def test_near_copies_make_few_rows(spark, monkeypatch, n, crowd):
    """A group of near copies, one edit in each: a few rows a copy, however large the group is, and no window apart unless even strides are crowded."""
    monkeypatch.setattr(repeats, "OFTEN", 4)
    rng = random.Random(11)
    base = " ".join(rng.choice(("alpha", "beta", "ñandú", "gamma")) + str(rng.randrange(400)) for _ in range(40))
    rows = []
    for i in range(n):
        p = rng.randrange(len(base) - 3)
        rows.append((i, base[:p] + f"{i:03d}" + base[p + 3 :], None))
    docs, r = docs_of(spark, rows), repeats.Repeats(100, crowd)
    got = {x["doc_id"]: (x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in repeats.remove_repeats(docs, r).collect()}
    assert [got[i] for i in range(n)] == plain_removed([t.encode() for _, t, _ in rows], 100)
    made = {x["kind"]: x["count"] for x in repeats.find_repeats(docs, r).shown.groupBy("kind").count().collect()}
    if crowd > 3:
        assert sum(made.values()) <= 12 * n and "window" not in made
    else:
        assert made["window"] > 0


def test_repeats_of_rows_without_ids_of_their_own(spark):
    a, b = "one passage " * 20, "another one " * 20
    rows = [(5, a, None), (5, a, None), (5, b, None), (None, a, None), (None, None, None), (9, b + a, None)]
    got = sorted((str(r["doc_id"]), r["n_bytes"], len(r["kept"])) for r in repeats.remove_repeats(docs_of(spark, rows)).collect())
    bodies = sorted((a, b), key=len)
    assert len(got) == 6 and sum(n for _, _, n in got) < 2 * sum(map(len, bodies))
    whole = [k for i, n, k in got if i == "5"]
    assert sorted(whole)[0] == 0 and ("None", 0, 0) in got and ("None", len(a), 0) in got


def test_maximal_repeats(spark, monkeypatch):
    monkeypatch.setattr(repeats, "OFTEN", 9999)
    texts = passages(7, 40)[:40] + ["q" + "same middle part " * 9 + "r", "s" + "same middle part " * 9 + "t"]
    docs = docs_of(spark, [(i, t, None) for i, t in enumerate(texts)])
    groups = {}
    for r in repeats.maximal_repeats(docs).collect():
        groups.setdefault((r["g1"], r["g2"], r["n_bytes"]), set()).add((r["doc_id"], r["start"]))
    bodies, first = [t.encode() for t in texts], {}
    for i, b in enumerate(bodies):
        first.setdefault(b, i)
    covered = {i: set() for i in range(len(bodies))}
    for (_, _, n), places in groups.items():
        i, at = min(places)
        own = bodies[i][at : at + n]
        everywhere = {(j, p) for j in set(first.values()) for p in range(len(bodies[j]) - n + 1) if bodies[j][p : p + n] == own}
        assert n >= 100 and len(own) == n and len(places) > 1 and places == everywhere
        for j, p in places:
            covered[j] |= set(range(p, p + n))
    seen = {}
    for j in set(first.values()):
        for p in range(len(bodies[j]) - 99):
            seen.setdefault(bodies[j][p : p + 100], []).append((j, p))
    for places in seen.values():
        if len(places) > 1:
            assert all(set(range(p, p + 100)) <= covered[j] for j, p in places)


def plain_tree(bodies, rank, length):
    """Of every start, the longest common prefix with an earlier start."""
    all_ = [(rank[c], p, c) for c, b in enumerate(bodies) for p in range(len(b) - length + 1)]
    common = lambda x, y: next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
    return {(c, p): max((n for q, o, e in all_ if (q, o) < (k, p) and (n := common(bodies[c][p:], bodies[e][o:])) >= length), default=0) for k, p, c in all_}


def test_interval_tree():
    rng = random.Random(3)
    for length in (3, 5):
        bodies = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(length, 12))) for _ in range(30)]
        bodies = list(dict.fromkeys(bodies))
        rank = np.array(rng.sample(range(len(bodies)), len(bodies)))
        tree = repeats.intervals(bodies, rank, length)
        wanted = plain_tree(bodies, rank, length)
        reach = {}
        for c, p, n in zip(tree.context.tolist(), tree.place.tolist(), tree.cover.tolist(), strict=True):
            assert n == wanted[c, p]
            for q in range(p, p + n - length + 1):
                reach[c, q] = True
        assert set(reach) == {k for k, n in wanted.items() if n}


def plain_clusters(vectors, c):
    x = np.array([v for _, v in vectors], np.int64)
    order = sorted(range(len(x)), key=lambda i: (vectors[i][0] is None, hashlib.sha256(f"{c.seed}:{vectors[i][0]}".encode()).hexdigest(), x[i].astype("<i4").tobytes()))
    means = x[order[: c.k]].copy()
    for n in range(c.rounds + 1):
        d = ((x[:, None] - means[None]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        for j in range(len(means)) if n < c.rounds else ():
            if (own == j).any():
                means[j] = x[own == j].sum(axis=0) // (own == j).sum()
    d = d[np.arange(len(x)), own]
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means.tolist()]
    return sorted((str(i), int(j), int(e), int(d[own == j].sum()), int(d.sum()), digest[j]) for (i, _), j, e in zip(vectors, own, d, strict=True))


@pytest.mark.parametrize(("k", "spread"), [(12, 1.0), (23, 0.1), (3000, 1.0)])
def test_clusters(spark, k, spread):
    rng = np.random.default_rng(k)
    middles = rng.normal(size=(9, 6))
    x = (middles[rng.integers(0, 9, 400)] + spread * rng.normal(size=(400, 6))).astype(np.float32)
    x[50:150] = x[3]  # one very common vector
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(7, [0.5] * 6), (7, [0.5] * 6), (None, [0.25] * 6)]
    odd = [(500, None), (501, []), (502, [1.0] * 5), (503, [None] * 6), (504, [float("nan")] + [0.0] * 5), (505, [float("-inf")] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<double>, cluster int")
    c = yinyang.Clustering(k=k, dims=6, rounds=4, group=4)
    got = sorted((str(r[0]), *tuple(r)[1:]) for r in yinyang.cluster(df, c).collect())
    assert got == plain_clusters([(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows], c)
    assert yinyang.cluster(df.limit(0), c).count() == 0


def test_bounds_save_distances():
    rng = np.random.default_rng(5)
    middles = rng.integers(-500, 500, (40, 64))
    x = middles[rng.integers(0, 40, 3000)] + rng.integers(-30, 30, (3000, 64))
    means, work = x[:40].copy(), yinyang.Work()
    groups = yinyang.grouped(means, 4)
    own, upper, lower, moved = np.full(len(x), -1), np.zeros(len(x)), np.full((len(x), groups.max() + 1), -np.inf), np.zeros(40)
    for _ in range(6):
        own, upper, lower = yinyang.assigned(x, own, upper, lower, means, groups, moved, work)
        assert (own == yinyang.squared(x, means).argmin(axis=1)).all()
        new = np.array([x[own == j].sum(axis=0) // max(1, (own == j).sum()) if (own == j).any() else means[j] for j in range(40)])
        moved, means = np.sqrt(((new - means) ** 2).sum(axis=1)), new
    assert work.made < 0.6 * work.all
    big = rng.integers(-(1 << 24), 1 << 24, (50, 9))
    assert (yinyang.squared(big, big) == ((big[:, None] - big[None]) ** 2).sum(axis=2)).all()
