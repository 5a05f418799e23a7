"""Names to dense ids, and terms to axioms in normal form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ontology import Ontology
from ..plans.lineage import together, written
from ..plans.saturation import Axioms
from ..schema import BOTTOM, BOTTOM_ID, FIRST_ID, TOP, TOP_ID


def dense_ids(df: DataFrame, order: list[str], start: int, out: str = "id") -> DataFrame:
    """df with `out` = start, start + 1, ... in `order`, numbered in range partitions; only their sizes meet."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = written(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    base, acc = [], start
    for part, count in sorted((r["_part"], r["count"]) for r in held.groupBy("_part").count().collect()):
        base.append((part, acc))
        acc += count
    bases = df.sparkSession.createDataFrame(base, "_part int, _base long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return held.join(F.broadcast(bases), "_part").withColumn(out, F.col("_base") + place).drop("_part", "_base")


def active(terms: DataFrame) -> DataFrame:
    """The terms that aren't obsolete."""
    return terms.where(~F.coalesce("is_obsolete", F.lit(False)))


def edges(terms: DataFrame) -> DataFrame:
    """(id, type, target_id) of the relationships of terms, is_a among them."""
    return terms.select("id", F.explode("relationships").alias("x")).select("id", "x.type", "x.target_id")


def parts(terms: DataFrame) -> DataFrame:
    """(id, stanza, at, n, relationship, target_id) of the intersections of terms; at counts from 0."""
    own = terms.where(F.size("intersection_of") > 0).select("id", F.xxhash64("id", "intersection_of").alias("stanza"), F.size("intersection_of").alias("n"), F.posexplode("intersection_of").alias("at", "x"))
    return own.select("id", "stanza", "at", "n", F.coalesce("x.relationship", F.lit("")).alias("relationship"), "x.target_id").distinct()


@dataclass(frozen=True)
class Normalized:
    """concepts (id, name, is_named), roles (id, name, is_transitive, is_reflexive), axioms over ids."""

    concepts: DataFrame
    roles: DataFrame
    axioms: Axioms


def intern_concepts(names: DataFrame) -> DataFrame:
    """(id, name) for the distinct names: reserved ones first, the others in their order."""
    spark = names.sparkSession
    other = names.select(F.coalesce("name", F.lit("")).alias("name")).distinct().where(~F.col("name").isin(TOP, BOTTOM))
    reserved = spark.createDataFrame([(TOP_ID, TOP), (BOTTOM_ID, BOTTOM)], "id long, name string")
    return reserved.unionByName(dense_ids(other, ["name"], FIRST_ID).select("id", "name"))


def intern_roles(names: DataFrame) -> DataFrame:
    """(id, name) for the distinct role names in their order, from 0."""
    return dense_ids(names.select(F.coalesce("name", F.lit("")).alias("name")).distinct(), ["name"], 0).select("id", "name")


def normalize(ontology: Ontology, *, nf5: DataFrame | None = None, nf6: DataFrame | None = None) -> Normalized:
    """Axioms of the terms that aren't obsolete. nf5 (sub, sup), nf6 (r1, r2, sup): further axioms, over role names.

    An intersection makes its term a superclass of the conjunction: each differentia gets a fresh concept of its own and
    an NF4 axiom, several conjuncts a chain of NF2 axioms through fresh concepts. Fresh concepts have no name; their
    ids follow (term, place), so runs agree.
    """
    spark = ontology.terms.sparkSession
    # documents are parsed once for terms and once for typedefs
    terms, typedefs = together(
        spark,
        lambda: written(active(ontology.terms).select("id", "relationships", "intersection_of"), "terms"),
        lambda: written(ontology.typedefs.select("id", "is_transitive", "is_reflexive"), "typedefs"),
    )
    rel, part = edges(terms), parts(terms)
    is_a = rel.where("type = 'is_a'")
    other = rel.where("type <> 'is_a'")
    names = [terms.select("id"), rel.select("target_id"), part.select("target_id")]
    role_names = other.select("type").union(part.where("relationship <> ''").select("relationship")).union(typedefs.select("id"))
    for extra, columns in ((nf5, ("sub", "sup")), (nf6, ("r1", "r2", "sup"))):
        for c in columns if extra is not None else ():
            role_names = role_names.union(extra.select(c))
    flags = typedefs.groupBy("id").agg(F.max(F.coalesce("is_transitive", F.lit(False))).alias("is_transitive"), F.max(F.coalesce("is_reflexive", F.lit(False))).alias("is_reflexive"))

    def named_roles() -> DataFrame:
        roles = intern_roles(role_names.toDF("name")).join(flags.withColumnRenamed("id", "name"), "name", "left")
        shown = [F.coalesce(c, F.lit(False)).alias(c) for c in ("is_transitive", "is_reflexive")]
        return written(roles.select("id", "name", *shown), "roles")

    named, roles, part = together(
        spark,
        lambda: written(intern_concepts(names[0].union(names[1]).union(names[2]).toDF("name")), "concepts"),
        named_roles,
        lambda: written(part, "parts"),
    )

    def concept(df: DataFrame, name: str, out: str) -> DataFrame:
        return df.join(named.select(F.col("name").alias(name), F.col("id").alias(out)), name)

    def role(df: DataFrame, name: str, out: str) -> DataFrame:
        return df.join(roles.select(F.col("name").alias(name), F.col("id").alias(out)), name)

    nf1 = concept(concept(is_a, "id", "sub"), "target_id", "sup").select("sub", "sup")
    nf3 = role(concept(concept(other, "id", "sub"), "target_id", "fill"), "type", "role").select("sub", "role", "fill")

    # fresh concepts: one for each differentia, one for each inner node of a chain
    slots = part.where("relationship <> ''").select("id", "stanza", "at", F.lit(0).alias("kind")).union(
        part.where("at >= 1 and at < n - 1").select("id", "stanza", "at", F.lit(1).alias("kind"))
    )
    first_free = named.agg(F.max("id")).first()[0] + 1
    fresh = written(dense_ids(slots, ["id", "stanza", "at", "kind"], first_free, "fresh"), "fresh")
    at = ["id", "stanza", "at"]
    own = part.join(fresh.where("kind = 0").select(*at, F.col("fresh").alias("x")), at, "left")
    own = concept(own, "target_id", "target")
    own = written(own.withColumn("conjunct", F.coalesce("x", "target")), "conjuncts")
    nf4 = role(own.where("x is not null"), "relationship", "role").select("role", F.col("target").alias("fill"), F.col("x").alias("sup"))
    whole = concept(own, "id", "term")
    nf1 = nf1.union(whole.where("n = 1").select(F.col("conjunct").alias("sub"), F.col("term").alias("sup")))
    inner = fresh.where("kind = 1").select(*at, F.col("fresh").alias("inner"))
    chain = whole.where("n > 1").join(inner, at, "left")
    by_place = Window.partitionBy("id", "stanza").orderBy("at")
    left: Column = F.when(F.col("at") == 1, F.lag("conjunct").over(by_place)).otherwise(F.lag("inner").over(by_place))
    nf2 = chain.withColumn("l", left).where("at >= 1").select("l", F.col("conjunct").alias("r"), F.when(F.col("at") == F.col("n") - 1, F.col("term")).otherwise(F.col("inner")).alias("sup"))
    transitive = roles.where("is_transitive").select(F.col("id").alias("r1"), F.col("id").alias("r2"), F.col("id").alias("sup"))
    if nf6 is not None:
        more = role(role(role(nf6.withColumnRenamed("sup", "s"), "r1", "a"), "r2", "b"), "s", "c")
        transitive = transitive.union(more.select("a", "b", "c"))
    sub_roles = None if nf5 is None else role(role(nf5.withColumnRenamed("sub", "p").withColumnRenamed("sup", "q"), "p", "sub"), "q", "sup").select("sub", "sup")
    concepts = named.select("id", "name", (F.col("name") != "").alias("is_named")).union(fresh.select("fresh", F.lit("").alias("name"), F.lit(False)))
    axioms = Axioms(nf1.distinct(), nf2.distinct(), nf3.distinct(), nf4.distinct(), sub_roles, transitive.distinct())
    return Normalized(written(concepts, "all-concepts"), roles, axioms)
