"""Parsers, normalisation and JSON on small documents."""

import io
import json

import pytest

from subsumer.__main__ import main
from subsumer.classify import classify
from subsumer.operators.export import write_classified, write_document, write_json
from subsumer.operators.normalize import normalize
from subsumer.sources import detect_format, obo, owl, read_ontology

SAMPLE = """format-version: 1.2
ontology: things

[Term]
id: T:1
name: kettle
def: "A thing." [src:1]
subset: S
synonym: "boiler" EXACT BRAND [X:1, X:2]
synonym: "pot" RELATED []
synonym: ""
xref: R:1
xref: R:2
is_a: T:2 ! second
relationship: stands_on T:3 ! third
property_value: k "v one" xsd:string
property_value: k "v two" xsd:string
property_value: bare value xsd:string
property_value: short

[Term]
id: T:2
alt_id: A:1
is_a: T:9 {source="x"}
relationship: lonely
id:ignored

[Term]
id: T:4
is_obsolete: true
is_a: T:2

[Typedef]
id: stands_on
name: stands on
is_transitive: true
"""


def write(tmp_path, text, name="a.obo"):
    p = tmp_path / name
    p.write_text(text, newline="")
    return str(p)


def terms(ontology):
    return {r["id"]: r for r in ontology.terms.collect()}


def test_obo_fields(spark, tmp_path):
    o = obo.read_obo(spark, write(tmp_path, SAMPLE))
    assert o.header.first().asDict() == {"format_version": "1.2", "data_version": None, "ontology": "things"}
    t = terms(o)
    assert set(t) == {"T:1", "T:2", "T:4"}
    one = t["T:1"]
    assert one["definition"] == "A thing." and one["xrefs"] == ["R:1", "R:2"] and one["is_obsolete"] is False
    assert [(s["text"], s["scope"], s["type"], s["xrefs"]) for s in one["synonyms"]] == [
        ("boiler", "EXACT", "BRAND", ["X:1", "X:2"]),
        ("pot", "RELATED", None, None),
        ("", None, None, None),
    ]
    assert [tuple(r) for r in one["relationships"]] == [("is_a", "T:2", "second"), ("stands_on", "T:3", "third")]
    assert one["properties"] == {"bare": "value", "k": "v two"}
    assert [tuple(r) for r in t["T:2"]["relationships"]] == [("is_a", 'T:9 {source="x"}', None), ("lonely", "", None)]
    assert t["T:4"]["is_obsolete"] is True
    assert [tuple(r) for r in o.typedefs.collect()] == [("stands_on", "stands on", True, False)]


def test_obo_odd_stanzas(spark, tmp_path):
    lost = obo.read_obo(spark, write(tmp_path, "a: b\n\n[Typedef]\nid: r\n\n[Term]\nid: A\n[Term]\nname: n\nid: B\n\n[Typedef]\nid: s\n"))
    assert [r["id"] for r in lost.terms.collect()] == ["B"]  # markers inside a stanza are swallowed
    assert [r["id"] for r in lost.typedefs.collect()] == ["s"]  # a first stanza that isn't a term's is lost
    crlf = obo.read_obo(spark, write(tmp_path, "ontology: x\r\n\r\n[Term]\r\nid: A\r\nname: n\r\n", "c.obo"))
    assert crlf.header.first()["ontology"] == "x" and crlf.terms.first()["name"] == "n"
    empty = obo.read_obo(spark, write(tmp_path, "ontology: y\n", "e.obo"))
    assert empty.terms.count() == 0 and empty.header.first()["ontology"] == "y"
    several = spark.createDataFrame([(1, SAMPLE)], "k long, doc string")
    assert obo.parse(obo.blocks_of(several, "doc", "k")).terms.count() == 3


def test_intersections(spark, tmp_path):
    text = "x: y\n\n[Term]\nid: D\nintersection_of: G\nintersection_of: r A ! a\nintersection_of: H\nintersection_of: s B\n\n[Term]\nid: E\nintersection_of: r F\n"
    n = normalize(obo.read_obo(spark, write(tmp_path, text)))
    fresh = n.concepts.where("not is_named").count()
    assert (n.axioms.nf4.count(), n.axioms.nf2.count(), fresh, n.axioms.nf1.count()) == (3, 3, 5, 1)


def test_json(spark, tmp_path):
    out = io.StringIO()
    write_json(obo.read_obo(spark, write(tmp_path, SAMPLE)), out, pretty=True)
    doc = json.loads(out.getvalue())
    assert list(doc) == ["format_version", "ontology", "terms", "typedefs"]
    two = next(t for t in doc["terms"] if t["id"] == "T:2")
    assert "is_obsolete" not in two and "synonyms" not in two and two["alt_ids"] == ["A:1"]
    out = io.StringIO()
    write_json(obo.read_obo(spark, write(tmp_path, "ontology: z\n", "z.obo")), out)
    assert json.loads(out.getvalue()) == {"ontology": "z", "terms": []}


def test_classified(spark, tmp_path):
    c = classify(obo.read_obo(spark, write(tmp_path, SAMPLE)))
    got = {r["id"]: (r["direct_parents"], r["direct_children"]) for r in c.hierarchy.collect()}
    assert got["T:1"] == (["T:2"], None) and got["T:2"][1] == ["T:1"] and got["T:3"] == (["owl:Thing"], None)
    assert c.stats["inferred_subsumptions"] == 3 and c.stats["role_count"] == 2


@pytest.mark.parametrize("pretty", (False, True))
def test_documents_are_those_of_a_plain_writer(spark, tmp_path, pretty):
    def plain(value):
        return json.dumps(value, ensure_ascii=False, **({"indent": 2} if pretty else {"separators": (",", ":")})) + "\n"

    odd = [{"id": "A", "xs": ["a\nb", "ü}"], "e": []}, {"id": "B", "m": {"k": {}}}, {}]
    many = [{"id": f"{i:04}", "t": "x" * (i % 7)} for i in range(500)]
    frame = lambda rows: spark.createDataFrame([(f"{i:04}", json.dumps(r, ensure_ascii=False, separators=(",", ":"))) for i, r in enumerate(rows)], "id string, json string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n, (head, rows, more) in enumerate([({"h": "x"}, odd, many), ({}, many, []), ({}, [], odd), ({}, [], [])]):
            path = str(tmp_path / f"{n}.json")
            for _ in range(2):  # the second replaces the first
                write_document(spark, path, head, [("terms", frame(rows).repartition(5), "[]"), ("typedefs", frame(more), None)], pretty=pretty)
            wanted = plain({**head, "terms": rows} | ({"typedefs": more} if more else {}))
            assert (tmp_path / f"{n}.json").read_text(encoding="utf-8") == wanted
            out = io.StringIO()
            write_document(spark, out, head, [("terms", frame(rows), "[]"), ("typedefs", frame(more), None)], pretty=pretty)
            assert out.getvalue() == wanted
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(p.name for p in tmp_path.iterdir()) == [f"{n}.json" for n in range(4)]  # nothing is left beside them


def test_a_document_that_fails_leaves_the_old_one(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text("old")
    bad = spark.createDataFrame([("a", "{")], "id string, json string")
    with pytest.raises(Exception):
        write_document(spark, str(path), {}, [("terms", bad, "[]")], pretty=True)
    assert path.read_text() == "old" and [p.name for p in tmp_path.iterdir()] == ["a.json"]


def test_hierarchies_are_documents(spark):
    for ids, wanted in ((["b", "a"], [{"id": "a"}, {"id": "b"}]), ([], None)):
        out = io.StringIO()
        write_classified(spark.createDataFrame([(i,) for i in ids], "id string"), {"n": 1}, out)
        assert out.getvalue() == json.dumps({"stats": {"n": 1}, "concepts": wanted}, indent=2) + "\n"


def test_command_line(spark, tmp_path, capsys):
    source, target = write(tmp_path, SAMPLE), tmp_path / "out.json"
    assert main(["-input", source, "-output", str(target), "-pretty"]) == 0
    doc = json.loads(target.read_text(encoding="utf-8"))
    assert [t["id"] for t in doc["terms"]] == ["T:1", "T:2", "T:4"] and target.read_text().startswith('{\n  "format_version"')
    assert "Parsed 3 terms" in capsys.readouterr().err
    assert main(["-input", source]) == 0
    assert json.loads(capsys.readouterr().out) == doc
    assert main(["-input", source, "-classify", "-output", str(target)]) == 0
    found = json.loads(target.read_text(encoding="utf-8"))
    assert found["stats"]["inferred_subsumptions"] == 3 and {"id": "T:1", "direct_parents": ["T:2"]} in found["concepts"]
    assert main(["-input", str(tmp_path / "a.txt")]) == 1 and main(["-input", str(tmp_path / "none.obo")]) == 1
    assert "Error" in capsys.readouterr().err


OWL = """<?xml version="1.0"?>
<rdf:RDF xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"
 xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:x="http://x/">
<owl:Ontology rdf:about="http://o"><owl:versionIRI rdf:resource="http://o/1"/></owl:Ontology>
<owl:ObjectProperty rdf:about="http://purl.obolibrary.org/obo/stands_on"><rdfs:label>stands on</rdfs:label></owl:ObjectProperty>
<owl:Class rdf:about="http://purl.obolibrary.org/obo/A_1"><rdfs:label>a</rdfs:label>
 <rdfs:subClassOf rdf:resource="http://purl.obolibrary.org/obo/A_2"/>
 <rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="http://purl.obolibrary.org/obo/stands_on"/>
 <owl:someValuesFrom rdf:resource="http://purl.obolibrary.org/obo/A_3"/></owl:Restriction></rdfs:subClassOf>
 <x:hasExactSynonym>aa</x:hasExactSynonym><x:mass>18.0</x:mass></owl:Class>
<owl:Class><rdfs:label>nobody</rdfs:label></owl:Class>
<owl:Class rdf:about="http://purl.obolibrary.org/obo/A_2"><owl:deprecated>true</owl:deprecated></owl:Class>
</rdf:RDF>
"""


def test_owl(spark, tmp_path):
    path = write(tmp_path, OWL, "a.owl")
    o = owl.read_owl(spark, path)
    assert o.header.first()["data_version"] == "http://o/1"
    t = terms(o)
    assert set(t) == {"A:1", "A:2"} and t["A:2"]["is_obsolete"]
    assert [tuple(r) for r in t["A:1"]["relationships"]] == [("is_a", "A:2", None), ("stands:on", "A:3", None)]
    assert t["A:1"]["synonyms"][0]["scope"] == "EXACT" and t["A:1"]["properties"] == {"mass": "18.0"}
    assert [r["id"] for r in o.typedefs.collect()] == ["stands:on"]
    dropped = terms(owl.read_owl(spark, path, restrictions="reference"))
    assert [r["type"] for r in dropped["A:1"]["relationships"]] == ["is_a"]
    assert read_ontology(spark, path).terms.count() == 2


def test_line_ends(spark, tmp_path):
    crlf, half = SAMPLE.replace("\n", "\r\n"), SAMPLE.index("[Term]\nid: T:4")
    texts = {
        "crlf": crlf,
        "cut": crlf[:-2],
        "mixed": SAMPLE[:half] + SAMPLE[half:].replace("\n", "\r\n"),
        "blanks": SAMPLE.replace("\n\n", "\n\r\n\n\n"),
        "lines": crlf.replace("\r\n\r\n", "\r\n\n"),
    }
    wanted = [b for b in SAMPLE.rstrip("\n").split("\n\n") if b]
    plain = lambda rows: [r["value"].replace("\r", "").strip("\n") for r in sorted(rows, key=lambda r: r["at"])]
    for size in (33, 150, 1 << 20):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            for name, text in texts.items() if size > 33 else [("mixed", texts["mixed"])]:
                assert plain(obo.read_blocks(spark, write(tmp_path, text, f"{name}.obo")).collect()) == wanted, name
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    found = read_ontology(spark, write(tmp_path, texts["mixed"], "mixed.obo"))
    assert terms(found) == terms(read_ontology(spark, write(tmp_path, SAMPLE, "whole.obo")))
    assert found.typedefs.count() == 1 and found.header.first()["ontology"] == "things"
    assert terms(read_ontology(spark, write(tmp_path, "", "empty.obo"))) == {}


def test_formats():
    assert [detect_format(p) for p in ("a.OBO", "a.xml", "a.rdf", "a.owl")] == ["obo", "owl", "owl", "owl"]
    for bad in (("a.txt", "auto"), ("a.obo", "other")):
        with pytest.raises(ValueError):
            detect_format(*bad)
