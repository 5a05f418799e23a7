"""The fixpoint and the reduction, against a plain saturation of sets."""

import random

import pytest

from subsumer.operators.taxonomy import direct_children, direct_parents
from subsumer.plans.saturation import Axioms, saturate

TOP, BOTTOM = 0, 1
COLUMNS = {"nf1": "sub sup", "nf2": "l r sup", "nf3": "sub role fill", "nf4": "role fill sup", "nf5": "sub sup", "nf6": "r1 r2 sup"}


def plain(concepts, ax):
    """All rules, over and over, until nothing changes."""
    s, r = {(c, c) for c in concepts} | {(c, TOP) for c in concepts}, set()
    nf2 = {(a, b, x) for a, b, x in ax["nf2"]} | {(b, a, x) for a, b, x in ax["nf2"]}
    while True:
        new_s = {(c, y) for c, d in s for x, y in ax["nf1"] if x == d}
        new_s |= {(c, y) for c, d in s for a, b, y in nf2 if a == d and (c, b) in s}
        new_s |= {(c, y) for c, q, d in r for p, f, y in ax["nf4"] if p == q and (d, f) in s}
        new_s |= {(c, BOTTOM) for c, _, d in r if (d, BOTTOM) in s}
        new_r = {(c, q, f) for c, d in s for x, q, f in ax["nf3"] if x == d}
        new_r |= {(c, y, d) for c, q, d in r for x, y in ax["nf5"] if x == q}
        new_r |= {(c, y, e) for c, p, d in r for d2, q, e in r if d == d2 for a, b, y in ax["nf6"] if (a, b) == (p, q)}
        if new_s <= s and new_r <= r:
            return s, r
        s |= new_s
        r |= new_r


def run(spark, concepts, ax):
    frames = {n: spark.createDataFrame(ax[n], ", ".join(f"{c} long" for c in COLUMNS[n].split())) for n in COLUMNS if ax[n]}
    out = saturate(spark.createDataFrame([(c,) for c in concepts], "id long"), Axioms(**frames))
    return out


def check(spark, concepts, **given):
    ax = {n: given.get(n, []) for n in COLUMNS}
    out = run(spark, concepts, ax)
    s, r = plain(concepts, ax)
    assert {tuple(x) for x in out.subsumers.collect()} == s
    assert {(x["c"], int(x["r"]), x["d"]) for x in out.links.collect()} == r
    return out, s


def test_cycle_chain_and_hierarchy(spark):
    check(spark, range(6), nf1=[(2, 3), (3, 4), (4, 2)], nf3=[(2, 0, 5), (5, 0, 3)], nf5=[(0, 1)], nf6=[(0, 0, 0), (0, 1, 2)])


def test_bottom_spreads_back(spark):
    _, s = check(spark, range(5), nf1=[(4, BOTTOM)], nf3=[(2, 0, 3), (3, 0, 4)])
    assert {c for c, d in s if d == BOTTOM} == {1, 2, 3, 4}


def test_joint_rules(spark):
    # a = 2, b = 3, f = 4, g = 5, e = 6, x = 7, d = 8
    _, s = check(
        spark, range(9), nf1=[(2, 5), (3, 6), (4, BOTTOM)], nf2=[(5, 7, 8)], nf3=[(2, 0, 3), (3, 0, 4)], nf4=[(0, 6, 7)], nf6=[(0, 0, 0)]
    )
    assert {d for c, d in s if c == 2} == {2, TOP, 5, 7, 8, BOTTOM}


@pytest.mark.parametrize("seed", range(2))
def test_random(spark, seed):
    rng = random.Random(seed)
    c = range(2, 9)
    pick = lambda *sizes: [tuple(rng.choice(c) if s == "c" else rng.randrange(3) for s in sizes) for _ in range(4)]
    check(spark, range(9), nf1=pick("c", "c"), nf2=pick("c", "c", "c"), nf3=pick("c", "r", "c"), nf4=pick("r", "c", "c"), nf5=pick("r", "r")[:1], nf6=pick("r", "r", "r")[:2])


def test_direct_parents(spark):
    # equivalents 2 and 3 below 5; 4 below both
    out, s = check(spark, range(6), nf1=[(2, 3), (3, 2), (4, 2), (2, 5)])
    concepts = spark.createDataFrame([(c,) for c in range(6)], "id long")
    direct = direct_parents(out.subsumers, concepts)
    assert sorted(map(tuple, direct.collect())) == [(2, 3), (3, 2), (4, 0), (5, 0)]
    assert {r["parent"]: r["children"] for r in direct_children(direct).collect()}[0] == [4, 5]
    once = direct_parents(out.subsumers, concepts, collapse_equivalents=True)
    assert sorted(map(tuple, once.collect())) == [(2, 5), (4, 2), (5, 0)]


def test_no_axioms(spark):
    out, _ = check(spark, range(3))
    assert out.rounds == 1


def test_axioms_that_start_from_top(spark):
    check(spark, range(6), nf1=[(TOP, 2), (2, 3), (4, TOP)], nf2=[(TOP, 4, 5)], nf3=[(TOP, 0, 4)], nf4=[(0, TOP, 3)])
    check(spark, range(6), nf1=[(2, TOP), (3, 2)], nf3=[(2, 0, 3)], nf4=[(0, 3, 4)])


def test_deep_ladder_closes_in_few_rounds(spark):
    from subsumer.plans.saturation import closed

    edges = [(i, i + 1) for i in range(40)] + [(40, 38), (7, 7)]
    found = {tuple(x) for x in closed(spark.createDataFrame(edges, "sub long, sup long")).collect()}
    assert found == {(a, b) for a in range(41) for b in range(41) if a != b and (b > a or min(a, b) >= 38)}


def frames(spark, ax):
    return {n: spark.createDataFrame(ax[n], ", ".join(f"{c} long" for c in COLUMNS[n].split())) for n in COLUMNS if ax.get(n)}


@pytest.mark.parametrize("seed", range(2, 5))
def test_what_is_wanted_is_whole(spark, seed):
    rng = random.Random(seed)
    c = range(1 if seed == 4 else 2, 9)
    pick = lambda *sizes: [tuple(rng.choice(c) if s == "c" else rng.randrange(2) for s in sizes) for _ in range(4)]
    ax = {"nf1": pick("c", "c"), "nf2": pick("c", "c", "c")[: seed - 2], "nf3": pick("c", "r", "c"), "nf4": pick("r", "c", "c")[:3], "nf5": pick("r", "r")[:1], "nf6": pick("r", "r", "r")[:1]}
    s, r = plain(range(9), {n: ax.get(n, []) for n in COLUMNS})
    # concepts come from the axioms
    named = {0, 1} | {x for n, at in (("nf1", (0, 1)), ("nf2", (0, 1, 2)), ("nf3", (0, 2)), ("nf4", (1, 2))) for row in ax[n] for i in at for x in (row[i],)}
    one = saturate(None, Axioms(**frames(spark, ax)), want=("subsumers",))
    assert {tuple(x) for x in one.subsumers.collect()} == {x for x in s if x[0] in named}
    two = saturate(None, Axioms(**frames(spark, ax)), want=("links",), parallelism=2)
    assert {tuple(x) for x in two.links.select("c", "r", "d").collect()} == r


def test_rules_that_add_nothing_are_left_out(spark):
    ax = {"nf1": [(2, 3)], "nf2": [(3, 4, 5)], "nf3": [(2, 0, 4)], "nf4": [(0, 4, 6)], "nf5": [(0, 1)]}
    every = saturate(None, Axioms(**frames(spark, ax)))
    assert every.rules == {"CR1", "CR2", "CR3", "CR4", "CR10"}
    # no link starts from 5 or 6, so facts add none
    links = saturate(None, Axioms(**frames(spark, ax)), want=("links",))
    assert links.rules == {"CR1", "CR3", "CR10"} and links.links.count() == 2
    # without NF4 and bottom links add no facts
    facts = saturate(None, Axioms(**frames(spark, {**ax, "nf4": []})), want=("subsumers",))
    assert facts.rules == {"CR1", "CR2"} and facts.links.count() == 0
    with pytest.raises(ValueError):
        saturate(None, Axioms(**frames(spark, ax)), want=("all",))


def test_what_is_known_stays_in_place(spark):
    from subsumer.plans.lineage import Buckets
    from subsumer.plans.saturation import _by_part_of_the_key

    rows = spark.range(1000).selectExpr("id as c", "id % 3 as r", "id % 7 as d")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    held = Buckets(rows, "x", ["c"], 8)
    try:
        with _by_part_of_the_key(spark):
            held.add(rows)
            new, n = held.add(rows.selectExpr("c + 990 as c", "r", "d").join(held.all(), ["c", "r", "d"], "left_anti"))
            for on, how in ((["c", "r", "d"], "left_anti"), (["c", "r"], "inner")):
                plan = new.select(*on).join(held.all(), on, how)._jdf.queryExecution().executedPlan().toString()
                # only the delta may move
                known = plan[plan.rindex("FileScan") :]
                assert plan.count("Exchange") <= 1 and "Exchange" not in known and plan.count("Bucketed: true") == 2
        assert n == 1000 - len({(i, i % 3, i % 7) for i in range(1000)} & {(i + 990, i % 3, i % 7) for i in range(1000)}) and held.all().count() == 1000 + n
        assert held.plain(1).count() == n
    finally:
        held.forget()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert held.plain().count() == 1000 + n


def test_small_deltas_take_one_task(spark, monkeypatch):
    from subsumer.plans import saturation

    edges = [(i, 0, i + 1) for i in range(2, 400)]
    ax = frames(spark, {"nf3": edges, "nf6": [(0, 0, 0)]})
    seen = []
    plain_join = saturation.Buckets.add

    def add(self, delta):
        seen.append(self.buckets)
        return plain_join(self, delta)

    monkeypatch.setattr(saturation.Buckets, "add", add)
    out = saturate(None, Axioms(**ax), want=("links",), parallelism=3, most_rounds=2)
    assert set(seen) == {3} and out.links.rdd.getNumPartitions() <= 8
    monkeypatch.setattr(saturation, "SMALL", 100)
    deltas = []
    monkeypatch.setattr(saturation, "together", lambda spark, *jobs: deltas.append(jobs) or [j() for j in jobs])
    saturate(None, Axioms(**ax), want=("links",), parallelism=3, most_rounds=2)
    tasks = [x.rdd.getNumPartitions() for jobs in deltas for j in jobs for x in getattr(j, "args", ()) if hasattr(x, "rdd") and x.columns == ["c", "r", "d"]]
    assert tasks and max(tasks) == 3


def test_children_are_counted_without_a_row_of_all(spark):
    from subsumer.operators.taxonomy import child_counts

    direct = spark.createDataFrame([(f"c{i}", f"p{i % 3}") for i in range(50)], "child string, parent string")
    wanted = {(r["parent"], len(r["children"]), r["children"][0], r["children"][-1]) for r in direct_children(direct).collect()}
    counts = child_counts(direct)
    assert {tuple(r) for r in counts.collect()} == wanted
    assert "collect" not in counts._jdf.queryExecution().executedPlan().toString()


def plain_direct(pairs, concepts):
    k = {(c, d) for c, d in pairs if c != d and min(c, d) > 1}
    hidden = {(c, e) for c, d in k for d2, e in k if d == d2}
    out = k - hidden
    return out | {(c, TOP) for c in concepts if c > 1 and c not in {x for x, _ in out}}


@pytest.mark.parametrize("seed", range(3))
def test_reduction(spark, seed, monkeypatch):
    from subsumer.operators import taxonomy

    monkeypatch.setattr(taxonomy, "FIRST", 1 + seed)
    rng = random.Random(seed)
    n = 40
    # layers, with many parents and some cycles
    edges = {(rng.randrange(2, n), rng.randrange(2, n)) for _ in range(60)}
    edges = {(a, b) for a, b in edges if a > b or rng.random() < (0, 0.05, 0.3)[seed]} | {(39, x) for x in range(2, 20)}
    pairs = set(edges)
    while more := {(a, d) for a, b in pairs for c, d in edges if b == c} - pairs:
        pairs |= more
    pairs |= {(c, c) for c in range(n)} | {(c, TOP) for c in range(n)} | {(5, BOTTOM)}
    concepts = spark.createDataFrame([(c,) for c in range(n)], "id long")
    got = direct_parents(spark.createDataFrame(sorted(pairs), "c long, d long"), concepts)
    assert sorted(map(tuple, got.collect())) == sorted(plain_direct(pairs, range(n)))


def shuffled(spark, job):
    """Rows that all shuffles of a job write."""
    sc = spark.sparkContext
    bus, store, stages = sc._jsc.sc().listenerBus(), sc._jsc.sc().statusStore(), set(range(100_000))

    def written_by(first):
        total, i, missing = 0, first, 0
        while missing < 50:
            try:
                total, missing = total + store.lastStageAttempt(i).shuffleWriteRecords(), 0
            except Exception:
                missing += 1
            i += 1
        return total, i - missing

    bus.waitUntilEmpty()
    first = sc._jsc.sc().dagScheduler().nextStageId()
    job()
    bus.waitUntilEmpty()
    return written_by(first)[0]


@pytest.mark.parametrize("kind", ("conjunctions", "fillers"))
def test_facts_do_not_meet_every_axiom_of_a_hub(spark, kind):
    n = 300
    low, new, end = range(10, 10 + n), range(1000, 1000 + n), range(2000, 2000 + n)
    if kind == "conjunctions":  # all are below 2, each has an axiom of 2 and a premise of its own, which every third has
        ax = {"nf1": [(c, 2) for c in low] + [(c, x) for c, x in zip(low, new) if c % 3 == 0], "nf2": [(2, x, y) for x, y in zip(new, end)]}
    else:  # one role has many axioms, and many links
        ax = {"nf3": [(c, 0, x) for c, x in zip(low, new)], "nf4": [(0, x, y) for x, y in zip(new, end)]}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    out = []
    try:
        rows = shuffled(spark, lambda: out.append(saturate(None, Axioms(**frames(spark, ax)), want=("subsumers",))))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    wanted = {(c, y) for c, y in zip(low, end) if kind == "fillers" or c % 3 == 0}
    assert {tuple(r) for r in out[0].subsumers.where("d >= 2000 and c < 1000").collect()} == wanted
    assert rows < n * n / 2


def test_writes_leave_no_shuffle_files(spark):
    from subsumer.plans.lineage import Buckets, written

    held = lambda: sum("shuffle_" in str(f) for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n"))
    before, key = held(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, "false")
    rows = spark.range(1000).selectExpr("id % 10 as c", "id as d")
    assert written(rows.groupBy("c").count()).count() == 10
    table = Buckets(rows, "x", ["c"], 4)
    assert table.add(rows)[1] == 1000 and table.merge(rows.union(rows.selectExpr("c", "d + 1")))[1] == 1000
    table.forget()
    # only count() and the like may leave some
    assert held() - before <= 8 and spark.conf.get(key) == was
