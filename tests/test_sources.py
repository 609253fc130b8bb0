"""Table parsers, Turtle and N-Triples."""

import pytest

from strataweave.operators.ontology import OWL, RDFS, XSD
from strataweave.sources import rdf, tables


@pytest.mark.parametrize(
    ("text", "kind"),
    [("a,b\n1,2", "csv"), ("a\tb\n1\t2", "tsv"), ("| a | b |\n|---|---|\n| 1 | 2 |", "markdown"), ("<p><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>", "html"), ('[{"a": 1, "b": 2}]', "json")],
)
def test_formats_agree(spark, text, kind):
    assert tables.detect_format(text) == kind
    rows = tables.parse_table(spark, text).collect()
    assert [(r.a, r.b) for r in rows] == [("1", "2")]


def test_json_shapes():
    assert tables.parse_json('{"headers": ["a"], "rows": [[1], [null]]}') == (["a"], [["1"], [""]])
    assert tables.parse_json('{"columns": ["a"], "data": [["x"]]}') == (["a"], [["x"]])
    assert tables.parse_json('{"a": [1, 2], "b": [3]}') == (["a", "b"], [["1", "3"], ["2", ""]])
    assert tables.parse_json('[["h"], ["v"]]') == (["h"], [["v"]])


def test_ragged_and_blank_headers(spark):
    df = tables.grid(spark, ["a", "", "a"], [["1"], ["", "", ""], ["1", "2", "3", "4"]])
    assert df.columns == ["_row", "a", "column_2", "a_2", "column_4"]
    assert [tuple(r) for r in df.collect()] == [(0, "1", "", "", ""), (1, "1", "2", "3", "4")]


def test_markdown_escapes():
    assert tables.parse_markdown("a | b\\|c\n1 | 2") == (["a", "b|c"], [["1", "2"]])


TTL = """@prefix : <urn:x#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
:A a owl:Class ; rdfs:label "a [tricky] label"@en , "two" . # a comment
:p rdfs:domain [ a owl:Class ; owl:unionOf ( :A :B ) ] ; :n 3 , 2.5 , true .
[] a owl:AllDisjointClasses ; owl:members ( :A :B :C ) .
"""


def test_turtle(spark):
    rows = rdf.parse_turtle(TTL)
    assert ("urn:x#A", RDFS + "label", "a [tricky] label", "literal", None, "en") in rows
    assert {r[2] for r in rows if r[1] == RDFS + "domain"} == {"urn:x#A", "urn:x#B"}
    assert {r[2] for r in rows if r[1] == OWL + "members"} == {"urn:x#A", "urn:x#B", "urn:x#C"}
    assert {r[4] for r in rows if r[1] == "urn:x#n"} == {XSD + "integer", XSD + "decimal", XSD + "boolean"}
    assert rdf.parse_turtle("@base <http://x/y/> . <a> <b> <../c> .") == [("http://x/y/a", "http://x/y/b", "http://x/c", "iri", None, None)]
    with pytest.raises(rdf.TurtleError):
        rdf.parse_turtle("q:a q:b q:c .")


def test_ntriples_round_trip(spark, tmp_path):
    triples = spark.createDataFrame([("urn:a", "urn:p", 'say "hi"\nthere \\ done', "literal", XSD + "string", None), ("_:b1", "urn:p", "urn:c", "iri", None, None), ("urn:a", "urn:p", "hallo", "literal", None, "de"), ("urn:a", "urn:p", "3", "literal", XSD + "integer", None)], rdf.TRIPLE)
    rdf.write_ntriples(triples, str(tmp_path / "nt"))
    back = rdf.read_ntriples(spark, str(tmp_path / "nt"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, triples.collect()), key=str)


def test_read_turtle_skips_bad_files(spark, tmp_path):
    (tmp_path / "good.ttl").write_text(TTL)
    (tmp_path / "bad.ttl").write_text("this is not turtle")
    assert rdf.read_turtle(spark, str(tmp_path)).filter("p = '" + RDFS + "label'").count() == 2
