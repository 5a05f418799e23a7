"""The mix of sources, the field of lines and exact near duplicates, against plain versions."""

import itertools
import math
import re
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from subsumer.llm import common, fit, line_quality, mixing, near_dups, token_blocks, warc
from test_text import docs_of, labelled, odd_rows


def _hash(seed, *parts):
    """xxhash64 of a 32-bit seed and of the parts behind it, nulls left out, each hashed with what came before."""
    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
    for part in parts:
        if part is not None:
            h = xxhash.xxh64_intdigest(struct.pack("<q", part) if isinstance(part, int) else part.encode(), h)
    return h


def _signed(h):
    return h - (1 << 64) if h >> 63 else h


def plain_mix(rows, quality, mix):
    """(doc_id, size, source_size, target, taken) of each of the rows: weighted sampling without replacement behind whole epochs."""
    best = {}
    for i, q in quality:
        if i is not None and q is not None:
            best.setdefault(i, []).append(q)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    whole = {s: sum(size(t) for _, t, o in rows if o == s) for s in sources}
    weight = {s: mix.weights[k % len(mix.weights)] for k, s in enumerate(sources)}
    cut = set()
    while True:
        left = mix.total * sum(whole.values()) - sum(mix.most * whole[s] for s in cut)
        free = sum(weight[s] for s in sources if s not in cut)
        more = {s for s in sources if s not in cut and left / free * weight[s] > mix.most * whole[s]}
        if not more or len(more | cut) == len(sources):
            cut |= more
            break
        cut |= more
    target = {s: mix.most * whole[s] if s in cut else left / free * weight[s] for s in sources}
    out = []
    for s in sources:
        members, words = {}, math.floor(target[s] + 0.5)
        for i, t, o in rows:
            if o == s:
                members.setdefault((i, t or ""), []).append(size(t))
        epochs = words // whole[s] if whole[s] else 0
        left = words - epochs * whole[s]
        order = []
        for (i, t), copies in members.items():
            row = _signed(_hash(mix.seed, i, t))
            u = ((_hash(mix.seed + 1, row) >> 11) + 0.5) / 2**53
            values = best.get(i, [1.0])
            q = 1.0 if any(map(math.isnan, values)) else max(values)
            order.append(((0, -math.log(u) / q) if q > 0 else (1, -math.log(u)), i, copies))
        for _, i, copies in sorted(order, key=lambda r: r[0]):
            got = min(sum(copies), left)
            left -= got
            out += [(i, n, whole[s], round(target[s], 6), epochs * n + got // len(copies)) for n in copies]
    return sorted(map(str, out))


@pytest.mark.parametrize(
    ("mix", "digit"),
    [(mixing.Mix(), 12), (mixing.Mix(), 2), (mixing.Mix(weights=(9, 1), total=0.4, seed=3), 1), (mixing.Mix(weights=(1,), total=1.9, most=3.0), 12), (mixing.Mix(total=5.0), 12)],
)
def test_mix_is_a_plain_weighted_draw(spark, monkeypatch, mix, digit):
    monkeypatch.setattr(mixing, "DIGIT_BITS", digit)
    rng = np.random.default_rng(8)
    rows = odd_rows(60) + [(200 + i, "hot word " * int(rng.integers(1, 9)), "s1") for i in range(120)]
    quality = [(i, float(rng.choice([0.25, 1.0, 3.0, 0.0, -1.0]))) for i in range(0, 320, 2)]
    quality += [(2, 9.0), (4, float("nan")), (6, None), (201, None), (None, 5.0), (9999, 1.0)]
    table = spark.createDataFrame(quality, "doc_id long, quality double")
    got = mixing.mix_rows(docs_of(spark, rows), table, mix=mix).collect()
    assert sorted(str((r[0], r[1], r[2], round(r[3], 6), r[4])) for r in got) == plain_mix(rows, quality, mix)
    assert mixing.mix_rows(docs_of(spark, []), table, mix=mix).count() == 0


def test_both_mixes_agree(spark):
    rows = odd_rows()
    table = spark.createDataFrame([(i, 1.0 + i % 3) for i in range(110)], "doc_id long, quality double")
    known = F.when(F.col("doc_id") < 110, 1.0 + F.col("doc_id") % 3)
    one = mixing.mix_rows(docs_of(spark, rows), table).select("doc_id", "size", "taken").collect()
    two = mixing.mix_sources(docs_of(spark, rows), quality=known).select("doc_id", "size", "taken").collect()
    assert sorted(map(str, one)) == sorted(map(str, two))


KINDS = ("lower", "upper", "digit", "space", "stop", "mark", "bar", "symbol")


def plain_kind(b):
    c = chr(b)
    if c.isascii() and c.islower() or b >= 128:
        return "lower"
    for kind, members in zip(KINDS[1:], ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\f\v", ".,;:'\"()-", "!?", "|/\\_=<>[]{}~^`", "*#$%&@+"), strict=True):
        if c in members:
            return kind
    return "other"


def plain_features(text):
    """(features, length) of each line, one at a time."""
    own, lengths, seen = [], [], []
    for line in text.split("\n"):
        kinds = [plain_kind(b) for b in line.encode("utf-8", "replace")]
        n, count = len(kinds), {k: kinds.count(k) for k in KINDS}
        solid, words = max(n - count["space"], 1), line.split()
        own.append(
            [
                count["upper"] / max(count["lower"] + count["upper"], 1),
                min(1, 4 * count["symbol"] / solid),
                min(1, 4 * count["mark"] / solid),
                count["digit"] / solid,
                min(1, 2 * count["bar"] / solid),
                count["stop"] / solid,
                1 - len(set(words)) / len(words) if len(words) > 1 else 0,
                float(bool(line) and line in seen),
                math.log(1 + n) / 8,
            ]
        )
        seen.append(line)
        lengths.append(n)
    none = [0.0] * len(own[0])
    return [[*o, *(own[k - 1] if k else none), *(own[k + 1] if k + 1 < len(own) else none), 1.0] for k, o in enumerate(own)], lengths


TEXTS = ["", "\n", "one line", "UPPER lower 12\n\n\tx | y / z\nsame same same!!\nUPPER lower 12\n", "ÀÉ 語\x00\x7f\r\n*** $$ ?!\n*** $$ ?!\nlast", "\n\n", "a\nb\na"]


def test_features_of_lines_are_those_of_plain_loops():
    for texts in (TEXTS, TEXTS[::-1], TEXTS[:1], ["x" * 5000 + "\n" + "y 1." * 900]):
        x, length, per_text = line_quality.line_features(texts)
        wanted = [plain_features(t) for t in texts]
        assert per_text.tolist() == [len(w[1]) for w in wanted]
        assert length.tolist() == [n for w in wanted for n in w[1]]
        np.testing.assert_allclose(x, [f for w in wanted for f in w[0]], atol=1e-12)


def labellings(evidence, stay):
    """Every labelling with its log potential."""
    for y in itertools.product((0, 1), repeat=len(evidence)):
        yield y, sum(e * v for e, v in zip(evidence, y, strict=True)) + stay * sum(a == b for a, b in zip(y, y[1:], strict=False))


def test_scores_are_those_of_all_labellings(monkeypatch):
    rng = np.random.default_rng(4)
    field = line_quality.LineQuality(rng.normal(size=line_quality.FEATURES), 0.8, 1.3, -0.2)
    wanted = []
    for t in TEXTS:
        x, length = plain_features(t)
        all_ = [(y, math.exp(v)) for y, v in labellings([float(np.dot(f, field.weights)) for f in x], field.stay)]
        z = sum(v for _, v in all_)
        good = [sum(v for y, v in all_ if y[k]) / z for k in range(len(x))]
        share = sum(g * (n + 1) for g, n in zip(good, length, strict=True)) / sum(n + 1 for n in length)
        wanted.append(1 / (1 + math.exp(-(field.slope * math.log(share / (1 - share)) + field.offset))))
    np.testing.assert_allclose(field.scores(TEXTS), wanted, rtol=1e-9)
    monkeypatch.setattr(line_quality, "BATCH_BYTES", 3)
    np.testing.assert_allclose(field.scores(TEXTS), wanted, rtol=1e-9)
    assert len(field.scores([])) == 0


def test_loss_is_that_of_all_labellings(spark, monkeypatch):
    docs, labels = labelled(spark)
    docs = docs.where("length(text) - length(replace(text, '\n', '')) < 8")
    seen, plain = [], fit.minimise

    def spy(loss, start, evaluations):
        rng = np.random.default_rng(len(seen))
        for z in (start, start + 0.1 * rng.normal(size=len(start))):
            seen.append((z, *loss(z)))
        return plain(loss, start, evaluations=2)

    monkeypatch.setattr(fit, "minimise", spy)
    line_quality.fit_quality(docs, labels)
    sample = fit.labelled_sample(docs, labels, "quality").collect()
    described = [(plain_features(r["text"])[0], r["y"]) for r in sample]

    def wanted(z):
        total = 0.0
        for x, y in described:
            evidence = [float(np.dot(f, z[:-1])) for f in x]
            told = y * sum(evidence) + z[-1] * (len(x) - 1)
            total += (math.log(sum(math.exp(v) for _, v in labellings(evidence, z[-1]))) - told) / len(x)
        return total / len(described) + line_quality.PENALTY / 2 * float(z @ z)

    assert len(described) > 20 and len(seen) == 4
    for z, value, gradient in seen[:2]:
        assert value == pytest.approx(wanted(z), rel=1e-5)
        for k in (0, 6, 8, 17, 27, 28):
            step = np.zeros(len(z))
            step[k] = 1e-4
            assert gradient[k] == pytest.approx((wanted(z + step) - wanted(z - step)) / 2e-4, abs=2e-5)


def test_exact_links_where_bands_find_none(spark):
    rng = np.random.default_rng(6)
    base, other = [f"w{k}" for k in range(50)], [f"v{k}" for k in range(40)]
    texts = [base, [*base[:-3], "x", "y", "z"], ["q", *base[1:]], other, [*other, "end"], other[:20], ["common"] * 3 + [f"c{rng.integers(9)}" for _ in range(30)]]
    rows = [(10 * i, " ".join(t), "s") for i, t in enumerate(texts)]
    rows += [(1000 + i, " ".join([*(f"b{k}" for k in range(45)), f"own{i}"]), "s") for i in range(40)] + [(5, " ".join(base), "s"), (None, " ".join(base), "s"), (6, None, "s")]
    few = near_dups.Near(words=4, bands=1, rows=64)  # one band of 64: hardly any pair of different texts shares it
    sets = {i: near_dups.shingle_set(t or "", 4) for i, t, _ in rows if i is not None}
    group = {i: i for i in sets}
    for _ in range(4):
        for a in group:
            for b in group:
                both = len(np.intersect1d(sets[a], sets[b]))
                if both and 100 * both >= 80 * len(np.union1d(sets[a], sets[b])):
                    group[a] = group[b] = min(group[a], group[b])

    def found(near, **more):
        return {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(docs_of(spark, rows), near, **more).collect() if r["doc_id"] is not None}

    assert found(few) != group
    assert found(few, exact=True) == group
    assert near_dups.near_duplicates(docs_of(spark, []), few, exact=True).count() == 0


def test_prefixes_of_a_hot_shingle_are_dealt_out(spark, monkeypatch):
    rows = [(i, f"same four words here {'a' * (i % 7)}{i}", "s") for i in range(60)]
    near = near_dups.Near(words=4, percent=30)
    ids = [(i, 2, i) for i, _, _ in rows]
    sets = near_dups.shingles_of(docs_of(spark, rows), spark.createDataFrame([(i,) for i, _, _ in rows], "doc_id long"), near)
    classes = spark.createDataFrame(ids, "rep long, n long, component long")
    wanted = sorted((a, b) for a in range(60) for b in range(a + 1, 60))
    for dealt in (10_000, 7, 1):
        monkeypatch.setattr(near_dups, "DEALT_ROWS", dealt)
        assert sorted(map(tuple, near_dups.prefix_pairs(classes, sets, near).collect())) == wanted


def test_starts_go_by_the_numbers_of_files(spark, monkeypatch):
    names = [f"file:/x/part-{task:05d}-ab-c{nth:03d}.txt" for task in (0, 7, 99999, 100000) for nth in (0, 2, 999, 1000, 1001)]
    rows = [(f, 10 * k + i, 3 * i, 3) for k, f in enumerate(names) for i in range(k % 3 + 1)]
    wanted = {r[1]: 3 * n for n, r in enumerate(rows)}
    df = spark.createDataFrame(rows[::-1], "file string, doc_id long, start_in_file long, n_tokens long")
    for few in (common.BROADCAST_ROWS, 0):  # by broadcast, and by a shuffle
        monkeypatch.setattr(common.small_join, "__defaults__", ("inner", few))
        assert {r["doc_id"]: r["start"] for r in token_blocks.with_starts(df).collect()} == wanted
    assert token_blocks.with_starts(df.limit(0)).count() == 0


@pytest.mark.parametrize("few", [20_000, 0])
def test_archives_of_one_common_payload(spark, monkeypatch, few):
    monkeypatch.setattr(common.small_join, "__defaults__", ("inner", few))
    monkeypatch.setattr(warc, "FILE_BYTES", 3000)
    rows = [(i, f"u{i}", b"common" * 300 if i % 3 else b"page %d" % i) for i in range(90)]
    path = common.scratch_path(spark, "warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, payload binary").repartition(2), path, segment_bytes=700)
    files = spark.read.format("binaryFile").load(path).count()
    assert files >= (60 + 30 + 3) // (3000 // 700)
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.resolve_revisits(warc.read_archives(spark, path)).collect()}
    assert got == {i: (len(p), "revisit" if i % 3 and i > 1 else "response", 1 if i % 3 and i > 1 else None) for i, _, p in rows}
