"""JSON of parsed ontologies and of classified hierarchies.

Rows become JSON where they are. A single document is made in parts: range-partitioned tasks write the rows in order, separators and
indents with them, and the file system's client joins the parts' bytes; no row passes through Python in the driver.
"""

from __future__ import annotations

import codecs
import json
import uuid
from dataclasses import dataclass
from typing import TextIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..ontology import Ontology
from ..plans.lineage import new_path, written
from ..schema import BOTTOM_ID, TOP

_NONE_IF_EMPTY = ("name", "namespace", "definition", "comment")


def term_json(terms: DataFrame) -> DataFrame:
    """(id, json): a line for each term. Null, empty and false values are left out; a synonym's text and scope, and a relationship's type and target, stay."""
    shown = terms.select(
        F.col("id").alias("key"),
        F.to_json(
            F.struct(
                F.nullif("id", F.lit("")).alias("id"),
                *[F.nullif(c, F.lit("")).alias(c) for c in _NONE_IF_EMPTY[:3]],
                F.when(F.col("is_obsolete"), True).alias("is_obsolete"),
                F.nullif("comment", F.lit("")).alias("comment"),
                "subsets",
                F.transform(
                    "synonyms",
                    lambda s: F.struct(F.coalesce(s["text"], F.lit("")).alias("text"), F.coalesce(s["scope"], F.lit("")).alias("scope"), F.nullif(s["type"], F.lit("")).alias("type"), s["xrefs"].alias("xrefs")),
                ).alias("synonyms"),
                "xrefs",
                "alt_ids",
                F.transform(
                    "relationships",
                    lambda r: F.struct(F.coalesce(r["type"], F.lit("")).alias("type"), F.coalesce(r["target_id"], F.lit("")).alias("target_id"), F.nullif(r["name"], F.lit("")).alias("name")),
                ).alias("relationships"),
                F.transform("intersection_of", lambda x: F.struct(F.nullif(x["relationship"], F.lit("")).alias("relationship"), x["target_id"].alias("target_id"))).alias("intersection_of"),
                "properties",
            )
        ).alias("json"),
    )
    return shown.select(F.col("key").alias("id"), "json")


def write_term_lines(terms: DataFrame, path: str) -> None:
    """The distributed sink: JSON lines in as many files as there are partitions."""
    term_json(terms).select("json").write.text(path)


@F.pandas_udf(StringType())
def _indented(rows: pd.Series) -> pd.Series:
    """JSON objects with an indent of 2, as they stand in a list that is a document's own field."""
    return rows.map(lambda r: json.dumps(json.loads(r), indent=2, ensure_ascii=False).replace("\n", "\n    "))


@dataclass(frozen=True)
class _Parts:
    """A folder of text files that hold a list's rows in order of their numbers; a separator stands before each row, so `skip` bytes are too many at the start."""

    folder: str
    skip: int


def _parts(rows: DataFrame, pretty: bool) -> _Parts:
    """rows (id, json) in order of both. A row's own closing brace ends its record."""
    separator = ",\n    " if pretty else ","
    # written once, since the sort reads its input twice
    held = written(rows.select("id", "json"), "json").orderBy("id", "json")
    shown = _indented("json") if pretty else F.col("json")
    path = new_path(rows.sparkSession, "document-parts")
    held.select(F.concat(F.lit(separator), F.regexp_replace(shown, r"\}\z", "")).alias("value")).write.option("lineSep", "}").text(path)
    return _Parts(path, len(separator))


class _Files:
    """The Hadoop file system of a path, through the client of this application's JVM."""

    def __init__(self, spark: SparkSession) -> None:
        self.gateway, self.jvm, self.conf = spark.sparkContext._gateway, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def of(self, path):
        return path.getFileSystem(self.conf)

    def files(self, folder: str) -> list:
        """The paths of a folder's part files that hold anything, by number."""
        path = self.path(folder)
        found = [s for s in self.of(path).listStatus(path) if s.getPath().getName().startswith("part-") and s.getLen()]
        return sorted((s.getPath() for s in found), key=lambda p: int(p.getName().split("-")[1]))

    def join(self, pieces: list[str | _Parts], target: str) -> None:
        """The pieces' bytes as one file. It is written beside the target and renamed over it when whole: readers see the old file or the new one."""
        whole = self.path(target)
        # an instance of our own, since it is told to leave no checksum files beside the target
        fs = self.jvm.org.apache.hadoop.fs.FileSystem.newInstance(self.of(whole).makeQualified(whole).toUri(), self.conf)
        try:
            fs.setWriteChecksum(False)
            whole = fs.makeQualified(whole)
            held = self.path(f"{whole.toString()}.{uuid.uuid4().hex}")
            try:
                out = fs.create(held)
                try:
                    for piece in pieces:
                        self._copy(piece, out)
                finally:
                    out.close()
                over = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
                over[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), self.conf).rename(held, whole, over)
            except BaseException:
                fs.delete(held, False)
                raise
        finally:
            fs.close()

    def _copy(self, piece: str | _Parts, out) -> None:
        if isinstance(piece, str):
            out.write(bytearray(piece.encode()))
            return
        for i, path in enumerate(self.files(piece.folder)):
            stream = self.of(path).open(path)
            try:
                stream.seek(0 if i else piece.skip)
                self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
            finally:
                stream.close()

    def show(self, name: str, out: TextIO) -> None:
        path, decoder = self.path(name), codecs.getincrementaldecoder("utf-8")()
        stream = self.of(path).open(path)
        try:
            while chunk := stream.readNBytes(1 << 20):
                out.write(decoder.decode(chunk))
        finally:
            stream.close()


def write_document(spark: SparkSession, out: str | TextIO, head: dict, lists: list[tuple[str, DataFrame, str | None]], *, pretty: bool = False) -> None:
    """One JSON document: the fields of head, then lists of rows (id, json) in order of both, each a JSON object.

    lists: a name, rows, and the value if there are no rows (None: the field is left out). out: a path of any Hadoop file system,
    replaced at once and only when the document is whole, or an open text file. With pretty, the bytes are those of json.dumps() with an
    indent of 2 and a line end. Rows whose json is null are left out; rows that repeat are repeated.
    """
    files = _Files(spark)
    start = json.dumps(head, indent=2, ensure_ascii=False)[: -2 if head else -1] if pretty else json.dumps(head, ensure_ascii=False, separators=(",", ":"))[:-1]
    pieces: list[str | _Parts] = [start]
    some = bool(head)
    for name, rows, empty in lists:
        parts = _parts(rows.where("json is not null"), pretty)
        has_rows = bool(files.files(parts.folder))
        if not has_rows and empty is None:
            continue
        pieces.append(("," if some else "") + (f'\n  "{name}": ' if pretty else f'"{name}":'))
        pieces += (["[\n    ", parts, "\n  ]"] if pretty else ["[", parts, "]"]) if has_rows else [empty]
        some = True
    pieces.append("\n}\n" if pretty and some else "}\n")
    if isinstance(out, str):
        files.join(pieces, out)
        return
    path = new_path(spark, "document")
    files.join(pieces, path)
    files.show(path, out)


def typedef_json(typedefs: DataFrame) -> DataFrame:
    """(id, json): a line for each typedef. Null, empty and false values are left out."""
    flags = [F.when(F.col(c), True).alias(c) for c in ("is_transitive", "is_reflexive")]
    return typedefs.select("id", F.to_json(F.struct(F.nullif("id", F.lit("")).alias("id"), F.nullif("name", F.lit("")).alias("name"), *flags)).alias("json"))


def write_json(ontology: Ontology, out: str | TextIO, *, pretty: bool = False) -> None:
    """The parsed ontology as one document; `terms` is there even if empty. Terms and typedefs are in order of id."""
    row = ontology.header.first()
    head = {k: v for k, v in (row.asDict() if row else {}).items() if v}
    lists = [("terms", term_json(ontology.terms), "[]"), ("typedefs", typedef_json(ontology.typedefs), None)]
    write_document(ontology.terms.sparkSession, out, head, lists, pretty=pretty)


def classified(direct: DataFrame, concepts: DataFrame) -> DataFrame:
    """(id, direct_parents, direct_children) by name, in order, for each named concept but top and bottom; unnamed ones are hidden."""
    named = concepts.where("is_named").select("id", "name")
    own = named.where(F.col("id") > BOTTOM_ID)
    pairs = direct.join(named.select(F.col("id").alias("parent"), F.col("name").alias("parent_name")), "parent").join(
        named.select(F.col("id").alias("child"), F.col("name").alias("child_name")), "child"
    )
    parents = pairs.groupBy("child").agg(F.array_sort(F.collect_set("parent_name")).alias("direct_parents")).withColumnRenamed("child", "id")
    children = pairs.where(F.col("parent_name") != TOP).groupBy("parent").agg(F.array_sort(F.collect_set("child_name")).alias("direct_children")).withColumnRenamed("parent", "id")
    return own.join(parents, "id", "left").join(children, "id", "left").select(F.col("name").alias("id"), F.coalesce("direct_parents", F.array().cast("array<string>")).alias("direct_parents"), "direct_children")


def write_classified(hierarchy: DataFrame, stats: dict, out: str | TextIO) -> None:
    """The hierarchy and its statistics as one pretty document; `concepts` is null if there are none."""
    rows = hierarchy.select("id", F.to_json(F.struct("*")).alias("json"))
    write_document(hierarchy.sparkSession, out, {"stats": stats}, [("concepts", rows, "null")], pretty=True)
