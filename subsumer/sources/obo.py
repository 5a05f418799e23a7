"""OBO documents: blocks between blank lines, parsed by column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..ontology import Ontology
from ..plans.lineage import written

TERM, TYPEDEF = "[Term]", "[Typedef]"


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The blocks of each split's lines. The lines before its first blank one and those behind its last may be parts of blocks."""
    key, held, n, blank = None, [], 0, False

    def cut(whole: bool) -> list[tuple]:
        nonlocal held, n
        text, held = "\n".join(held), []
        n += 1
        return [(*key, n, whole, blank, text)]

    for batch in batches:
        out: list[tuple] = []
        for (file, start), own in batch.groupby(["file", "start"], sort=False):
            if key != (file, start):
                if key:
                    out += cut(False)
                key, held, n, blank = (file, start), [], 0, False
            lines = own["value"].tolist()
            at = 0
            for stop in [i for i, x in enumerate(lines) if not x or x == "\r"]:
                held += lines[at:stop]
                at = stop + 1
                if held or not blank:
                    # a file's first block has nothing before it
                    out += cut(blank or not start)
                blank = True
            held += lines[at:]
        yield pd.DataFrame(out, columns=["file", "start", "row", "whole", "blank", "value"])
    if key:
        yield pd.DataFrame(cut(False), columns=["file", "start", "row", "whole", "blank", "value"])


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(at, value): the blocks between blank lines of the files of a path, and their order, whatever ends their lines.

    Files may be larger than a split. What a split holds of a block that goes on beyond its borders is put together with the rest: it
    belongs to the last split before it that has a blank line.
    """
    rows = spark.read.option("lineSep", "\n").text(path)
    lines = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    cut = written(lines.mapInPandas(_blocks, "file string, start long, row long, whole boolean, blank boolean, value string"), "blocks")
    parts = cut.where(~F.col("whole"))
    splits = cut.groupBy("file", "start").agg(F.max("blank").alias("blank"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    owners = splits.select("file", "start", F.coalesce(F.max(F.when(F.col("blank"), F.col("start"))).over(before), F.lit(0)).alias("owner"))
    # a split's own last lines follow a blank one of its own
    placed = parts.join(owners, ["file", "start"]).withColumn("owner", F.when(F.col("blank"), F.col("start")).otherwise(F.col("owner")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "row", "value"))), lambda x: x["value"]), "\n")
    joined = placed.groupBy("file", "owner").agg(whole.alias("value")).select("file", F.col("owner").alias("start"), F.lit(1 << 62).alias("row"), "value")
    blocks = cut.where("whole").select("file", "start", "row", "value").union(joined).where("value <> ''")
    return blocks.select(F.struct("file", "start", "row").alias("at"), "value")


def blocks_of(documents: DataFrame, column: str, key: str) -> DataFrame:
    """(at, value): the blocks of documents held in a string column, in the order of a key and their place."""
    blocks = documents.select(F.col(key).alias("key"), F.posexplode(F.split(column, "\r?\n\r?\n")).alias("place", "value"))
    return blocks.select(F.struct("key", "place").alias("at"), "value")


def parse(blocks: DataFrame) -> Ontology:
    """Header, terms and typedefs of a document's blocks (at, value).

    The header is all lines before the first that starts with `[`. If that isn't a term's marker, its stanza is lost.
    A stanza ends at a blank line only; lines are not trimmed; a field is what stands behind the first `: `. Of a key
    that occurs once the last value counts. Absent values are null, an absent id is empty. Nothing fails on odd input.
    """
    lines = F.split(F.regexp_replace("value", "\r(?=\n|$)", ""), "\n")
    rows = blocks.select("at", lines.alias("lines"))
    bracket = F.array_position(F.transform("lines", lambda x: x.startswith("[")), True)
    first = rows.where(bracket > 0).agg(F.min("at").alias("at")).first()
    first_at = first["at"] if first else None
    as_at = None if first_at is None else F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(blocks.schema["at"].dataType, first_at, strict=True)])

    in_header = F.lit(True) if as_at is None else F.col("at") < as_at
    is_first = F.lit(False) if as_at is None else F.col("at") == as_at
    head = rows.where(in_header | is_first).select("at", F.posexplode(F.when(is_first, F.slice("lines", 1, F.greatest(bracket - 1, F.lit(0)).cast("int"))).otherwise(F.col("lines"))).alias("i", "line"))

    def header(key: str) -> Column:
        return F.max_by(F.when(t.before(F.col("line"), ": ") == key, t.after(F.col("line"), ": ")), F.when((t.before(F.col("line"), ": ") == key) & t.after(F.col("line"), ": ").isNotNull(), F.struct("at", "i"))).alias(key.replace("-", "_"))

    top = head.agg(header("format-version"), header("data-version"), header("ontology"))
    if as_at is not None:
        # a first stanza that isn't a term's is lost: reading goes on behind its marker
        lost = is_first & (F.get("lines", (bracket - 1).cast("int")) != TERM)
        rows = rows.where(~in_header).withColumn("lines", F.when(lost, F.slice("lines", (bracket + 1).cast("int"), F.size("lines") + 1)).otherwise(F.col("lines")))
    else:
        rows = rows.where(F.lit(False))
    marker = F.array_position(F.transform("lines", lambda x: x.isin(TERM, TYPEDEF)), True).cast("int")
    stanzas = rows.where(marker > 0).select("at", F.get("lines", marker - 1).alias("kind"), F.slice("lines", marker + 1, F.size("lines") + 1).alias("body"))
    fields = F.transform(F.filter("body", lambda x: F.instr(x, ": ") > 0), lambda x: F.struct(t.before(x, ": ").alias("key"), t.after(x, ": ").alias("val")))
    stanzas = stanzas.select("at", "kind", fields.alias("fields"))

    def all_of(*keys: str) -> Column:
        return F.filter("fields", lambda f: f["key"].isin(*keys))

    def values(key: str) -> Column:
        return F.transform(all_of(key), lambda f: f["val"])

    def last(key: str) -> Column:
        return F.try_element_at(values(key), F.lit(-1))

    pairs = F.filter(F.transform(values("property_value"), t.property_value), lambda p: p["key"].isNotNull())
    related = F.transform(all_of("is_a", "relationship"), lambda f: F.when(f["key"] == "is_a", t.is_a(f["val"])).otherwise(t.relationship(f["val"])))
    terms = stanzas.where(F.col("kind") == TERM).select(
        F.coalesce(last("id"), F.lit("")).alias("id"),
        last("name").alias("name"),
        last("namespace").alias("namespace"),
        t.quoted(last("def")).alias("definition"),
        F.coalesce(last("is_obsolete") == "true", F.lit(False)).alias("is_obsolete"),
        last("comment").alias("comment"),
        t.none_if_empty(values("subset")).alias("subsets"),
        t.none_if_empty(F.transform(values("synonym"), t.synonym)).alias("synonyms"),
        t.none_if_empty(values("xref")).alias("xrefs"),
        t.none_if_empty(values("alt_id")).alias("alt_ids"),
        t.none_if_empty(related).alias("relationships"),
        t.none_if_empty(F.transform(values("intersection_of"), t.intersection_part)).alias("intersection_of"),
        t.last_entries(pairs).alias("properties"),
    )
    typedefs = stanzas.where(F.col("kind") == TYPEDEF).select(
        F.coalesce(last("id"), F.lit("")).alias("id"),
        last("name").alias("name"),
        F.coalesce(last("is_transitive") == "true", F.lit(False)).alias("is_transitive"),
        F.coalesce(last("is_reflexive") == "true", F.lit(False)).alias("is_reflexive"),
    )
    return Ontology(top, terms, typedefs)


def read_obo(spark: SparkSession, path: str) -> Ontology:
    return parse(read_blocks(spark, path))
