"""OWL in RDF/XML: the elements below each document's root, as rows of their children, and these as columns of terms.

Elements are cut by a scan for depth (see events), so what is nested in others is no class. Names match by namespace,
whatever prefix a document, or an inner element, declares for it. Text is all character data of an element in order,
nested elements' and CDATA sections' too, as it stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..ontology import Ontology
from ..plans.lineage import written
from .events import top_elements

#: The namespaces.
OWL = "http://www.w3.org/2002/07/owl#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
#: Elements with a place of their own, by local name.
SYNONYMS = {"hasExactSynonym": "EXACT", "hasBroadSynonym": "BROAD", "hasNarrowSynonym": "NARROW", "hasRelatedSynonym": "RELATED"}
XREFS = ("hasDbXref", "hasDbXRef")
DEFINITIONS = ("Definition", "definition")

#: An element: its place, its kind (Ontology, Class or ObjectProperty), rdf:about, and its children in order. links: the existential restrictions in a child.
ELEMENTS = (
    "file string, owner long, seq long, kind string, about string, "
    "children array<struct<ns:string,name:string,resource:string,text:string,links:array<struct<type:string,target:string>>>>"
)
KINDS = ("Ontology", "Class", "ObjectProperty")


def _split(tag: str) -> tuple[str, str]:
    """Namespace and local name."""
    ns, _, local = tag.rpartition("}")
    return ns[1:], local


def _child(x: ElementTree.Element) -> tuple:
    ns, name = _split(x.tag)
    links = []
    for r in x.findall(f"{{{OWL}}}Restriction"):
        ends = [[y.get(f"{{{RDF}}}resource") for y in r.findall(f"{{{OWL}}}{n}")] for n in ("onProperty", "someValuesFrom")]
        if all(e and e[-1] for e in ends):
            links.append((ends[0][-1], ends[1][-1]))
    return ns, name, x.get(f"{{{RDF}}}resource") or None, "".join(x.itertext()), links


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Elements of one document are parsed together, below its own root and with all that its prolog declares."""
    for batch in batches:
        out = []
        for prolog, own in batch.groupby("prolog", sort=False):
            if "<" not in prolog:
                continue
            tag = prolog[prolog.rindex("<") + 1 : -1].split()[0]
            root = ElementTree.fromstring(f"{prolog}{''.join(own['xml'])}</{tag}>")
            if root.tag != f"{{{RDF}}}RDF":
                continue
            for x, at in zip(root, zip(own["file"], own["owner"], own["seq"], strict=True), strict=True):
                ns, kind = _split(x.tag)
                if ns == OWL and kind in KINDS:
                    out.append((*at, kind, x.get(f"{{{RDF}}}about") or None, [_child(y) for y in x]))
        yield pd.DataFrame(out, columns=["file", "owner", "seq", "kind", "about", "children"])


def elements(spark: SparkSession, path: str) -> DataFrame:
    """The Ontology, Class and ObjectProperty elements right below the root of each rdf:RDF document of a path; see ELEMENTS."""
    return written(top_elements(spark, path).mapInPandas(_parsed, ELEMENTS), "owl")


def _named(*local: str) -> Column:
    return F.filter("children", lambda c: c["name"].isin(*local))


def _in(ns: str, local: str) -> Column:
    return F.filter("children", lambda c: (c["ns"] == ns) & (c["name"] == local))


def _texts(children: Column) -> Column:
    return F.transform(children, lambda c: c["text"])


def _resources(children: Column) -> Column:
    return F.filter(F.transform(children, lambda c: c["resource"]), lambda r: r.isNotNull())


def _last(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def _relationships(restrictions: str) -> Column:
    """Of each rdfs:subClassOf in order: is_a its resource, else its existential restrictions."""
    none = F.lit(None).cast("string")
    is_a = lambda c: F.array(F.struct(F.lit("is_a").alias("type"), t.curie(c["resource"]).alias("target_id"), none.alias("name")))
    link = lambda x: F.struct(t.curie(x["type"]).alias("type"), t.curie(x["target"]).alias("target_id"), none.alias("name"))
    told = F.array().cast("array<struct<type:string,target_id:string,name:string>>")
    return F.flatten(F.transform(_in(RDFS, "subClassOf"), lambda c: F.when(c["resource"].isNotNull(), is_a(c)).otherwise(F.transform(c["links"], link) if restrictions == "extract" else told)))


def read_owl(spark: SparkSession, path: str, *, restrictions: str = "extract") -> Ontology:
    """Header, classes as terms and object properties as typedefs of the documents of a path.

    restrictions: "extract" makes existential restrictions relationships; "reference" drops them. Classes and
    properties without rdf:about are left out, and so is all that isn't right below an rdf:RDF root. Child elements without a
    place of their own become properties under their local names if they have text; the last of a name counts. Of several
    documents' headers the last counts, by path. Malformed XML raises.
    """
    if restrictions not in ("extract", "reference"):
        raise ValueError("restrictions is 'extract' or 'reference'")
    found = elements(spark, path)
    none = F.lit(None).cast("string")
    at = F.struct("file", "owner", "seq")
    head = found.where("kind = 'Ontology'").withColumn("version", _last(_resources(_named("versionIRI"))))
    header = head.agg(
        none.alias("format_version"),
        F.max_by("version", F.when(F.col("version").isNotNull(), at)).alias("data_version"),
        F.max_by("about", F.when(F.col("about").isNotNull(), at)).alias("ontology"),
    )
    known = {"deprecated", "hasAlternativeId", "inSubset", "comment", *DEFINITIONS, *SYNONYMS, *XREFS}
    placed = lambda c: ((c["ns"] == RDFS) & c["name"].isin("label", "subClassOf")) | c["name"].isin(*known)
    scope = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    synonym = lambda c: F.struct(c["text"].alias("text"), scope[c["name"]].alias("scope"), none.alias("type"), F.lit(None).cast("array<string>").alias("xrefs"))
    pairs = F.transform(F.filter("children", lambda c: ~placed(c) & (c["text"] != "")), lambda c: F.struct(c["name"].alias("key"), c["text"].alias("value")))
    terms = found.where("kind = 'Class' and about is not null").select(
        t.curie(F.col("about")).alias("id"),
        _last(_texts(_in(RDFS, "label"))).alias("name"),
        none.alias("namespace"),
        _last(_texts(_named(*DEFINITIONS))).alias("definition"),
        F.coalesce(_last(_texts(_named("deprecated"))) == "true", F.lit(False)).alias("is_obsolete"),
        _last(_texts(_named("comment"))).alias("comment"),
        t.none_if_empty(F.transform(_resources(_named("inSubset")), t.curie)).alias("subsets"),
        t.none_if_empty(F.transform(_named(*SYNONYMS), synonym)).alias("synonyms"),
        t.none_if_empty(_texts(_named(*XREFS))).alias("xrefs"),
        t.none_if_empty(_texts(_named("hasAlternativeId"))).alias("alt_ids"),
        t.none_if_empty(_relationships(restrictions)).alias("relationships"),
        F.lit(None).cast("array<struct<relationship:string,target_id:string>>").alias("intersection_of"),
        t.last_entries(pairs).alias("properties"),
    )
    kinds = _resources(_in(RDF, "type"))
    typedefs = found.where("kind = 'ObjectProperty' and about is not null").select(
        t.curie(F.col("about")).alias("id"),
        _last(_texts(_in(RDFS, "label"))).alias("name"),
        F.array_contains(kinds, OWL + "TransitiveProperty").alias("is_transitive"),
        F.array_contains(kinds, OWL + "ReflexiveProperty").alias("is_reflexive"),
    )
    return Ontology(header, terms, typedefs)
