"""The scan for top-level elements, against a parser that reads whole documents, over splits of any size."""

import random
from xml.etree import ElementTree

import pytest

from subsumer.sources import owl
from subsumer.sources.events import top_elements

ROOT = (
    '<?xml version="1.0"?>\n<!DOCTYPE rdf:RDF [ <!ENTITY obo "http://purl.obolibrary.org/obo/"> <!ENTITY gt2 "x"> ]>\n<!-- <a> "b\' --><?pi a > b?>\n'
    f'<rdf:RDF xmlns:rdf="{owl.RDF}" xmlns:owl=\'{owl.OWL}\' xmlns:rdfs="{owl.RDFS}" note="a > \'b">'
)


def document(seed, n=14):
    rng = random.Random(seed)

    def element(depth):
        name = rng.choice(["owl:Class", "owl:Axiom", "rdfs:label", "x"])
        attribute = rng.choice(["", " rdf:about='a>\"b'", ' rdf:about="it\'s > &lt; /"', ' rdf:about="&obo;A_1"', " a='/'"])
        if rng.random() < 0.2:
            return f"<{name}{attribute}/>"
        inner = "".join(rng.choice([element, text])(depth + 1) for _ in range(rng.randrange(4))) if depth < 4 else ""
        return f"<{name}{attribute}\n>{inner}</{name} >"

    def text(_):
        return rng.choice(["a > b", "<![CDATA[ </owl:Class> > ]] ]]>", "<!-- <owl:Class> - > \" ' -->", "\r\n", "é語 &amp; -- ]] ?", "<?p <a> ?>", "<!---->", "<![CDATA[]]>"])

    return ROOT + "".join(rng.choice([element, text])(1) for _ in range(n)) + "</rdf:RDF>\n<!-- <after> -->"



def plain(x):
    x.tail = None
    return ElementTree.tostring(x)


@pytest.mark.parametrize("size", [61, 300, 1 << 20])
def test_elements_of_any_splits(spark, tmp_path, size):
    wanted = []
    for i in range(4):
        text = document(i)
        (tmp_path / f"{i}.owl").write_text(text, newline="")
        wanted += [plain(x) for x in ElementTree.fromstring(text.encode())]
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = top_elements(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = []
    for r in rows:
        root = ElementTree.fromstring(f"{r['prolog']}{r['xml']}</rdf:RDF>".encode())
        assert len(root) == 1 and not root[0].tail
        got.append(plain(root[0]))
    assert sorted(got) == sorted(wanted)


@pytest.mark.parametrize("size", [60, 1 << 20])
def test_documents_that_end_early_raise(spark, tmp_path, size):
    (tmp_path / "a.owl").write_text(document(1).rsplit("</rdf:RDF>", 1)[0])
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        with pytest.raises(Exception, match="ends before its root"):
            top_elements(spark, str(tmp_path)).count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_documents_without_elements(spark, tmp_path):
    for name, text in (("a", ""), ("b", ROOT + "</rdf:RDF>"), ("c", f'<rdf:RDF xmlns:rdf="{owl.RDF}"/>'), ("d", '<x><owl:Class xmlns:owl="http://www.w3.org/2002/07/owl#"/></x>')):
        (tmp_path / f"{name}.owl").write_text(text)
        o = owl.read_owl(spark, str(tmp_path / f"{name}.owl"))
        assert o.terms.count() == o.typedefs.count() == 0 and o.header.first()["ontology"] is None


def test_the_last_header_by_path_counts(spark, tmp_path):
    """The last ontology and the last version of many files, in the order of their names."""
    for i in range(24):
        version = f'<owl:versionIRI rdf:resource="v{i}"/>' if i % 5 == 0 else ""
        inner = "".join(f'<owl:Ontology rdf:about="o{i}_{j}">{version}</owl:Ontology>' for j in range(3))
        (tmp_path / f"{i:03}.owl").write_text(f'<rdf:RDF xmlns:rdf="{owl.RDF}" xmlns:owl="{owl.OWL}">{inner}</rdf:RDF>')
    assert owl.read_owl(spark, str(tmp_path)).header.first().asDict() == {"format_version": None, "data_version": "v20", "ontology": "o23_2"}
