"""Direct parents and children: the transitive reduction of the subsumers.

A concept's candidates are one row: their ids, those with the most candidates of their own first. The first that is left
is direct, since only a candidate with more could hide it; what it has itself is hidden, and taken out of the row. So a
row meets the rows of a few of its candidates, not those of all: rounds give each row that is not done its first ones,
twice as many each time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written

#: Candidates that a row meets in the first round.
FIRST = 4


def candidates(subsumers: DataFrame, top: object = 0, bottom: object = 1) -> DataFrame:
    """(c, d): what may be a parent: no concept itself, no top, no bottom."""
    reserved = [top, bottom]
    return subsumers.where((F.col("c") != F.col("d")) & ~F.col("c").isin(reserved) & ~F.col("d").isin(reserved))


def reduced(k: DataFrame) -> DataFrame:
    """(c, d): the candidates (c, d, closed under composition) that no other candidate of c has among its own."""
    sizes = k.groupBy(F.col("c").alias("d")).agg(F.count("*").alias("n"))
    sized = k.join(sizes, "d", "left").groupBy("c").agg(F.array_sort(F.collect_list(F.struct((-F.coalesce("n", F.lit(0))).alias("n"), "d"))).alias("x"))
    ids = lambda x: F.transform(x, lambda y: y["d"])
    # equivalent concepts have as many candidates
    same = F.filter("x", lambda y: y["n"] == -F.size("x"))
    held = written(sized.select("c", ids(F.col("x")).alias("todo"), ids(same).alias("same")), "rows")
    own = held.select(F.col("c").alias("d"), F.col("todo").alias("own"))
    todo, rounds, many = held.select("c", "todo"), [], FIRST
    while todo.head(1):
        asked = todo.select("c", F.explode(F.slice("todo", 1, many)).alias("d"))
        met = asked.join(own, "d", "left").groupBy("c").agg(F.collect_list(F.struct("d", "own")).alias("met"))
        # in order: what is still there is direct, and what it has goes
        none = "filter(todo, x -> false)"
        step = f"""aggregate(slice(todo, 1, {many}), struct(todo, {none} as direct),
            (a, d) -> if(array_contains(a.todo, d),
                struct(array_except(a.todo, array_append(coalesce(filter(met, m -> m.d = d)[0].own, {none}), d)) as todo, array_append(a.direct, d) as direct), a))"""
        done = written(todo.join(met, "c").select("c", F.expr(step).alias("a")).select("c", "a.todo", "a.direct"), "reduced")
        rounds.append(done.select("c", F.explode("direct").alias("d")))
        todo = done.where(F.size("todo") > 0).select("c", "todo")
        many *= 2
    out = k.select("c", "d").limit(0) if not rounds else rounds[0]
    for r in rounds[1:]:
        out = out.union(r)
    # of each pair of equivalents both are the other's candidates; one that has another besides c is hidden by it
    same = held.where(F.size("same") > 0).select("c", F.explode("same").alias("d"))
    if not same.head(1):
        return out
    mutual = written(same.join(same.select(F.col("d").alias("c"), F.col("c").alias("d")), ["c", "d"]), "equivalents")
    others = mutual.groupBy(F.col("c").alias("d")).agg(F.count("*").alias("n"))
    hid = out.join(others, "d").join(mutual.withColumn("back", F.lit(1)), ["c", "d"], "left").where(F.col("n") > F.coalesce("back", F.lit(0))).select("c", "d")
    return out.join(hid, ["c", "d"], "left_anti")


def direct_parents(subsumers: DataFrame, concepts: DataFrame, *, top: object = 0, bottom: object = 1, collapse_equivalents: bool = False) -> DataFrame:
    """(child, parent): d is direct for c unless another candidate of c has d among its own; without any, top.

    Subsumers are closed: what is above a concept's subsumers is among its own. Equivalent concepts are each other's parents
    and hide what is above them; collapse_equivalents=True keeps of each set of equivalents the smallest id and reduces those.
    """
    k = candidates(subsumers, top, bottom)
    if collapse_equivalents:
        back = k.select(F.col("d").alias("c"), F.col("c").alias("d"))
        least = k.join(back, ["c", "d"]).groupBy("c").agg(F.min("d").alias("m")).where("m < c").select("c")
        k = k.join(least, "c", "left_anti").join(least.withColumnRenamed("c", "d"), "d", "left_anti").select("c", "d")
        concepts = concepts.join(least.withColumnRenamed("c", "id"), "id", "left_anti")
    direct = reduced(written(k.select("c", "d"), "candidates")).select(F.col("c").alias("child"), F.col("d").alias("parent"))
    own = concepts.where(~F.col("id").isin([top, bottom])).select(F.col("id").alias("child"))
    orphans = own.join(direct, "child", "left_anti").withColumn("parent", F.lit(top).cast(direct.schema["parent"].dataType))
    return direct.union(orphans)


def child_counts(direct: DataFrame) -> DataFrame:
    """(parent, n_children, first_child, last_child) of distinct pairs (child, parent): sums of partitions meet, so a parent may have any number of children."""
    return direct.groupBy("parent").agg(F.count("*").alias("n_children"), F.min("child").alias("first_child"), F.max("child").alias("last_child"))


def direct_children(direct: DataFrame) -> DataFrame:
    """(parent, children), children in order. A parent's children are one row; child_counts() does without."""
    return direct.groupBy("parent").agg(F.sort_array(F.collect_set("child")).alias("children"))


def inferred_count(subsumers: DataFrame, concepts: DataFrame, *, named_only: bool = True) -> DataFrame:
    """One row (inferred_subsumptions): over all concepts but top and bottom, named ones only, the subsumers less itself and top."""
    own = concepts.where(F.col("id") >= 2)
    if named_only:
        own = own.where("is_named")
    sizes = subsumers.join(own.select(F.col("id").alias("c")), "c", "left_semi").groupBy("c").agg(F.greatest(F.count("*") - 2, F.lit(0)).alias("n"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("inferred_subsumptions"))
