"""An ontology of a star schema: entities are concepts, foreign keys are axioms, ids are names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.saturation import Axioms
from ..schema import BOTTOM, TOP


def name(kind: str, key: Column | str) -> Column:
    return F.concat(F.lit(kind + ":"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def literal(spark: SparkSession, columns: str, *rows: tuple[str, ...]) -> DataFrame:
    """A few rows of strings, made in one task without a Python worker."""
    named = [F.struct(*(F.lit(v).alias(c) for c, v in zip(columns.split(), row, strict=True))) for row in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*named)))


class Warehouse:
    """Axioms of the tables under a folder. Axioms that no table holds are literals below: classes of customers by
    region (defined through links), disjoint customers and suppliers, and one entity that is both."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def nf1(self) -> DataFrame:
        customer, supplier, nation, part = map(self.table, ("customer", "supplier", "nation", "part"))
        told = [
            customer.select(name("CUST", "c_custkey"), name("NATION", "c_nationkey")),
            customer.select(name("CUST", "c_custkey"), F.lit("CUSTOMER")),
            supplier.select(name("SUPP", "s_suppkey"), name("NATION", "s_nationkey")),
            nation.select(name("NATION", "n_nationkey"), name("REGION", "n_regionkey")),
            part.select(name("PART", "p_partkey"), name("BRAND", "p_brand")),
            part.where("p_partkey > 0").select(name("PART", "p_partkey"), name("PART", F.floor(F.col("p_partkey") / 3))),
            literal(self.spark, "sub sup", ("BOTH", "CUSTOMER"), ("BOTH", "SUPPLIER")),
        ]
        out = told[0].toDF("sub", "sup")
        for t in told[1:]:
            out = out.union(t.toDF("sub", "sup"))
        return out.distinct()

    def nf2(self) -> DataFrame:
        """Customers in a region's class are its customers; customers and suppliers are disjoint."""
        by_region = self.table("region").select(F.lit("CUSTOMER").alias("l"), name("IN", "r_regionkey").alias("r"), name("CUST_IN", "r_regionkey").alias("sup"))
        return by_region.union(literal(self.spark, "l r sup", ("CUSTOMER", "SUPPLIER", BOTTOM)))

    def nf3(self) -> DataFrame:
        customer, supplier, nation, orders = map(self.table, ("customer", "supplier", "nation", "orders"))
        told = [
            orders.select(name("ORDER", "o_orderkey"), F.lit("placed_by"), name("CUST", "o_custkey")),
            customer.select(name("CUST", "c_custkey"), F.lit("located_in"), name("NATION", "c_nationkey")),
            supplier.select(name("SUPP", "s_suppkey"), F.lit("located_in"), name("NATION", "s_nationkey")),
            nation.select(name("NATION", "n_nationkey"), F.lit("located_in"), name("REGION", "n_regionkey")),
            literal(self.spark, "sub role fill", ("HOLDER", "holds", "BOTH"), ("HOLDER2", "holds", "HOLDER")),
        ]
        out = told[0].toDF("sub", "role", "fill")
        for t in told[1:]:
            out = out.union(t.toDF("sub", "role", "fill"))
        return out.distinct()

    def nf4(self) -> DataFrame:
        return self.table("region").select(F.lit("located_in").alias("role"), name("REGION", "r_regionkey").alias("fill"), name("IN", "r_regionkey").alias("sup"))

    def nf5(self) -> DataFrame:
        return literal(self.spark, "sub sup", ("located_in", "related_to"))

    def nf6(self) -> DataFrame:
        return literal(self.spark, "r1 r2 sup", ("located_in", "located_in", "located_in"), ("placed_by", "located_in", "ordered_from"))

    def concepts(self) -> DataFrame:
        """(id): every name in an axiom, and the reserved ones."""
        names = literal(self.spark, "id", (TOP,), (BOTTOM,))
        for axioms, columns in ((self.nf1(), ("sub", "sup")), (self.nf2(), ("l", "r", "sup")), (self.nf3(), ("sub", "fill")), (self.nf4(), ("fill", "sup"))):
            names = names.union(axioms.select(F.explode(F.array(*columns))))
        return names.distinct()

    def axioms(self) -> Axioms:
        return Axioms(self.nf1(), self.nf2(), self.nf3(), self.nf4(), self.nf5(), self.nf6())


class WholeWarehouse(Warehouse):
    """The warehouse with its suppliers' parts, from line items, and classes of the orders placed by customers of a nation."""

    def supplies(self) -> DataFrame:
        items = self.table("lineitem").select("l_suppkey", "l_partkey").distinct()
        return items.select(name("SUPP", "l_suppkey").alias("sub"), F.lit("supplies").alias("role"), name("PART", "l_partkey").alias("fill"))

    def nf1(self) -> DataFrame:
        return super().nf1().union(self.table("orders").select(name("ORDER", "o_orderkey"), F.lit("ORDER"))).distinct()

    def nf2(self) -> DataFrame:
        nation = self.table("nation")
        return super().nf2().union(nation.select(F.lit("ORDER"), name("PLACED_FROM", "n_nationkey"), name("ORDER_FROM", "n_nationkey")))

    def nf3(self) -> DataFrame:
        return super().nf3().union(self.supplies())

    def nf4(self) -> DataFrame:
        nation = self.table("nation")
        return super().nf4().union(nation.select(F.lit("placed_by"), name("NATION", "n_nationkey"), name("PLACED_FROM", "n_nationkey")))
