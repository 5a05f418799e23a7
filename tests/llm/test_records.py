"""WARC archives and vector searches, against plain versions."""

import base64
import hashlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from subsumer.llm import ann, cover_tree, vectors, warc
from subsumer.llm.common import scratch_path


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_warc_round_trip(spark):
    long = bytes(range(256)) * 300  # many segments, no valid UTF-8
    rows = [(3, "u3", b"same"), (1, "u1", b"same"), (2, "u2", None), (4, None, b""), (5, "u5", long), (6, "u6", b"a\r\n\r\nWARC/1.1\r\n"), (7, "u7", long), (None, "n", b"same"), (8, "u8", b"q"), (8, "u8", b"q")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, payload binary, digest string")
    path = scratch_path(spark, "warc")
    warc.write_archives(df, path, chunk_bytes=100, segment_bytes=1000)
    records = warc.read_archives(spark, path)
    assert {bytes(r["payload"]) for r in records.where("record_type = 'response'").collect()} == {b"same", b"", long, b"a\r\n\r\nWARC/1.1\r\n", b"q"}
    got = sorted(map(str, (tuple(r) for r in warc.resolve_revisits(warc.read_archives(spark, path, payloads=False)).collect())))
    first = {b"same": 1, b"": 2, long: 5, rows[5][2]: 6, b"q": 8}
    wanted = []
    for i, _, p in rows:
        p = p or b""
        own = i == first[p]
        wanted.append((i, len(p), digest(p), "response" if own else "revisit", None if own else first[p]))
    assert got == sorted(map(str, wanted))


def test_warc_empty(spark):
    path = scratch_path(spark, "warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, payload binary"), path)
    assert warc.resolve_revisits(warc.read_archives(spark, path)).count() == 0


def test_framing_that_is_cut_off_raises():
    assert warc.unchunk(b"3;x=y\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunk(b"5\r\nabc\r\n0\r\n\r\n")
    with pytest.raises(ValueError):
        list(warc.records_in(io.BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")))


def vector_rows(n=700, dims=8, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)).astype(np.float32)
    x[100:200] = x[50]  # one very common vector
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    odd = [(1000, None), (1050, [0.0] * dims), (1100, [float("nan")] * dims), (1150, [None] * dims), (None, [1.0] * dims), (1200, [1.0] * 3), (1250, []), (1300, [float("inf")] + [1.0] * (dims - 1))]
    return rows, rows + odd + [rows[7]]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")


def results(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}


def queries_of(df):
    return df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"))


def test_nearest(spark):
    good, rows = vector_rows()
    df = frame(spark, rows)
    got = results(ann.nearest(df, queries_of(df), ann.Lists(list_rows=40)))
    x = np.array([v for _, v in good])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 700, 50):
        s = unit @ unit[q]
        s[q] = -2
        best = np.lexsort((np.arange(700), -np.round(s, 12)))[:5]
        hits += len(set(best.tolist()) & {i for i, _ in got[q]})
        assert all(abs(v - s[i]) < 1e-9 for i, v in got[q])
    assert hits >= 0.9 * 5 * 14
    assert [i for i, _ in got[150]] == [50, 100, 101, 102, 103] and set(got) == set(range(0, 700, 50))
    assert ann.nearest(df.limit(0), queries_of(df).limit(0)).count() == 0
    two = frame(spark, good[:2])
    assert results(ann.nearest(two, queries_of(two))).keys() == {0}


def test_nearest_ties_go_by_id(spark):
    # 120 multiples of one vector in one list
    rows = [(i, [float(2**k) for k in range(i % 7, i % 7 + 1)] + [0.0, 0.0]) for i in range(1, 121)] + [(i, [0.0, 1.0, float(i)]) for i in range(150, 160)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = results(ann.nearest(df, spark.createDataFrame([(50,)], "query_id long")))
    assert [i for i, _ in got[50]] == [1, 2, 3, 4, 5]


def test_largest_products(spark):
    good, rows = vector_rows()
    rows = [r for r in rows if r[0] != 1050]
    df = frame(spark, rows)
    got = results(cover_tree.largest_products(df, queries_of(df), cover_tree.Search(cell_rows=60, cell_queries=5, first=2)))
    x = np.floor(256 * np.array([v for _, v in good])).astype(np.int64)
    for q in range(0, 700, 50):
        s = x @ x[q]
        s[q] = -(10**15)
        best = np.lexsort((np.arange(700), -s))[:5]
        assert got[q] == [(int(i), int(s[i])) for i in best]
    assert cover_tree.largest_products(df.limit(0), queries_of(df).limit(0)).count() == 0


def test_products_that_doubles_cannot_tell_apart(spark):
    big = 1 << 28
    # the later ids have the larger products: 2**60 + i, all the same double; and both ends of a long's range are passed
    good = [(0, [float(big), 1.0])] + [(i, [float(1 << 32), float(i)]) for i in range(1, 40)] + [(50, [-float(1 << 40), 0.0]), (60, [float(1 << 40), 3.0]), (61, [float(1 << 40), 7.0])]
    df = spark.createDataFrame(good, "vec_id long, embedding array<double>")
    got = results(cover_tree.largest_products(df, queries_of(df), cover_tree.Search(scale=1.0, cell_rows=4, cell_queries=1, first=1)))
    for q, own in [g for g in good if g[0] % 50 == 0]:
        products = [(-sum(int(a) * int(b) for a, b in zip(own, v, strict=True)), i) for i, v in good if i != q]
        assert got[q] == [(i, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for s, i in sorted(products)[:5]]


def in_order(q, v, found):
    i, j, s = found
    return [[(int(v.first_id[b]), int(c)) for a, b, c in zip(i, j, s, strict=True) if a == r] for r in np.argsort(q.order)]


@pytest.mark.parametrize("scale", [1, 1 << 30])
def test_dual_tree_is_brute_force(scale):
    rng = np.random.default_rng(6)
    a, b = rng.integers(-9, 9, (70, 5)).astype(float) * scale, rng.integers(-9, 9, (400, 5)).astype(float) * scale
    ids = rng.permutation(400)
    q, v = cover_tree.Tree.of(a, np.arange(70)), cover_tree.Tree.of(b, ids)
    assert v.root.children
    products = a.astype(np.int64).astype(object) @ b.astype(np.int64).astype(object).T
    wanted = [sorted(zip((-x for x in row), ids))[:6] for row in products.tolist()]
    wanted = [[(int(i), int(-s)) for s, i in row] for row in wanted]
    assert in_order(q, v, cover_tree.dual_tree(q, v, 6)) == wanted
    least = np.array([wanted[i][3][1] for i in q.order], float)  # nothing below the fourth is wanted
    got = in_order(q, v, cover_tree.dual_tree(q, v, 6, least))
    assert all(g[:4] == w[:4] for g, w in zip(got, wanted, strict=True))
    few = cover_tree.Tree.of(b[:3], ids[:3])
    assert all(len(x) == 3 for x in in_order(q, few, cover_tree.dual_tree(q, few, 6)))


def test_cover_tree_covers():
    rng = np.random.default_rng(7)
    x = np.concatenate((rng.normal(size=(300, 4)), rng.normal(size=(20, 4)).repeat(10, axis=0) + 0.01 * rng.normal(size=(200, 4)), np.ones((5, 4))))
    order, levels = cover_tree.nets(x)
    radius = np.inf
    for n, nearest in levels:
        centers = x[order[:n]]
        away = np.linalg.norm(x - x[nearest], axis=1)
        apart = np.linalg.norm(centers[:, None] - centers[None], axis=2) + np.diag(np.full(n, np.inf))
        assert set(nearest.tolist()) <= set(order[:n].tolist())
        # covering, separation and halving: all are nearer to a centre than centres are to each other
        assert away.max() <= apart.min() + 1e-9 and (radius == np.inf or away.max() <= radius + 1e-9)
        radius = away.max()
    assert levels[-1][0] == len(np.unique(x, axis=0)) and radius == 0
    root, order = cover_tree.cover_tree(x)
    todo, leaves = [root], 0
    while todo:
        n = todo.pop()
        own = x[order[n.start : n.end]]
        assert (np.linalg.norm(own - n.center, axis=1) <= n.radius + 1e-9).all() and (np.linalg.norm(own, axis=1) <= n.largest + 1e-9).all()
        if n.children:
            assert sum(c.end - c.start for c in n.children) == n.end - n.start and n.children[-1].last == n.last
        leaves += not n.children
        todo += n.children
    assert sorted(order.tolist()) == list(range(len(x))) and leaves > 20


@pytest.mark.parametrize(("clusters", "each", "asked", "most"), [(512, 8, 4096, 0.05), (512, 8, 80, 0.05), (64, 64, 4096, 0.05), (64, 64, 80, 0.05), (2000, 1, 400, 1.0)])
def test_pairs_of_far_nodes_are_pruned(clusters, each, asked, most):
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(clusters, 64))
    middles /= np.linalg.norm(middles, axis=1, keepdims=True)
    x = np.floor(256 * (middles.repeat(each, axis=0) + 0.01 * rng.normal(size=(clusters * each, 64))))
    x = x[rng.permutation(len(x))]
    counts = cover_tree.Counts()
    q, v = cover_tree.Tree.of(x[:asked], np.arange(asked)), cover_tree.Tree.of(x, np.arange(len(x)))
    i, j, s = cover_tree.dual_tree(q, v, 6, counts=counts)
    assert counts.made <= most * counts.all
    wanted = np.sort(x[:asked] @ x.T, axis=1)[:, :-7:-1]
    assert (s.reshape(asked, 6) == wanted[q.order]).all() and (i == np.arange(asked).repeat(6)).all()


def test_balanced_clusters():
    found = vectors.balanced_clusters(np.random.default_rng(8).normal(size=(1000, 4)), 16)
    assert sorted(np.concatenate(found).tolist()) == list(range(1000))
    assert max(map(len, found)) - min(map(len, found)) <= 2


def test_ranges_of_ids(spark):
    from subsumer.llm.token_blocks import in_ranges

    ids = [None, None, -(2**63), 2**63 - 1, 2**63 - 2, *range(50), *[7] * 30]
    df = spark.createDataFrame([(x, str(i)) for i, x in enumerate(ids)], "doc_id long, text string")
    rows = in_ranges(df).withColumn("at", F.spark_partition_id()).collect()
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"])
    assert len(rows) == len(ids) and rows == sorted(rows, key=key)
    assert len({r["at"] for r in rows}) > 2
    assert in_ranges(df.where("false")).count() == 0
    assert in_ranges(df.where("doc_id is null")).count() == 2


def moved(spark, job, field):
    """The sum of a figure of the stages that a job runs, and what it returns."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    at, total, missing = sc.dagScheduler().nextStageId(), 0, 0
    out = job()
    sc.listenerBus().waitUntilEmpty()
    while missing < 50:
        try:
            total, missing = total + getattr(sc.statusStore().lastStageAttempt(at), field)(), 0
        except Exception:
            missing += 1
        at += 1
    return total, out


def test_samples_of_many_vectors_are_all_that_is_sent(spark):
    from subsumer.llm.common import table

    held = spark.range(0, 20_000, 1, 20).selectExpr("xxhash64(id) as k1", "id as k2", "unhex(repeat(lpad(hex(id), 16, '0'), 8)) as vec")
    held = table(held, "some")
    sent, sample = moved(spark, lambda: vectors.sample_of(held, 500), "resultSize")
    wanted = held.orderBy("k1", "k2").limit(500).toPandas()["vec"]
    assert np.array_equal(sample, vectors.matrix(wanted), equal_nan=True)
    assert sent < 400_000  # the smallest 500 of each task are over a million bytes
    assert len(vectors.sample_of(held, 30_000)) == 20_000


def test_trees_are_sent_once_for_a_tile(spark):
    from subsumer.llm.cover_tree import Search, largest_products

    x = np.random.default_rng(3).normal(size=(1000, 32))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = rows.where("vec_id % 4 = 0").selectExpr("vec_id as query_id")
    sent, found = moved(spark, lambda: largest_products(rows, asked, Search(k=3, cell_rows=50, cell_queries=10)).collect(), "shuffleWriteBytes")
    whole = np.floor(256 * x).astype(np.int64)
    for r in found:
        scores = whole @ whole[r["query_id"]]
        order = [i for i in np.lexsort((np.arange(1000), -scores)).tolist() if i != r["query_id"]]
        assert (r["vec_id"], r["score"]) == (order[r["rank"] - 1], scores[order[r["rank"] - 1]])
    assert len(found) == 750 and sent < 4_000_000


def test_blocks_without_a_result_are_lists_to_arrow():
    import pyarrow as pa

    none = np.zeros(0, np.intp)
    for found in (vectors.best_of(np.zeros(3, np.int64), np.zeros(3, np.int64), np.array([[1], [2, 3], [4]], object), none, none, np.zeros(0)), vectors.EMPTY):
        assert pa.Array.from_pandas(found["ids"], type=pa.list_(pa.int64())).to_pylist() == []
        assert pa.Array.from_pandas(found["whole"], type=pa.binary()).to_pylist() == []
