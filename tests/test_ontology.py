"""Ontology operators on hierarchies deeper than those of the test tables, and on cycles."""

import pytest

from strataweave.operators import ontology as O

DEEP = 21


@pytest.fixture(scope="module")
def deep(spark):
    """Two lines of DEEP classes under disjoint heads, with a short cut in the first, under one top."""
    rows = [(f"{x}{i}", O.RDFS + "subClassOf", f"{x}{i + 1}") for x in "ab" for i in range(DEEP)]
    rows += [(f"{x}{DEEP}", O.RDFS + "subClassOf", "top") for x in "ab"] + [("a0", O.RDFS + "subClassOf", "a4"), (f"a{DEEP}", O.OWL + "disjointWith", f"b{DEEP}")]
    return O.triples_from_rows(spark, rows).cache()


def test_closure_and_depth_have_no_end_but_the_top(spark, deep):
    up = {(r.child, r.ancestor): r.distance for r in O.closure(O.class_edges(deep)).collect()}
    assert len(up) == 2 * (DEEP + 1) * (DEEP + 2) // 2 and up["b0", "top"] == DEEP + 1 and up["a0", "top"] == DEEP - 2
    depth = {r.uri: r.depth for r in O.class_depth(deep).collect()}
    assert depth["a0"] == depth["b0"] == DEEP + 2 and depth["top"] == 1


def test_what_rests_on_the_closure(spark, deep):
    groups = spark.createDataFrame([(1, "a0"), (1, "b0"), (2, "a0"), (2, "a20")], "grp int, class_uri string")
    assert {r.grp: r.lcs for r in O.least_common_subsumer(groups, deep).collect()} == {1: "top", 2: "a20"}
    pairs = {(r.a, r.b) for r in O.disjoint_inherited(deep).collect()}
    assert len(pairs) == 2 * (DEEP + 1) ** 2 and ("a0", "b0") in pairs


def test_chain_goes_to_the_end(spark, deep):
    start = spark.createDataFrame([("b0",), ("alone",)], "uri string")
    got = sorted((r.uri, r.step, r.node) for r in O.chain(deep, start, O.RDFS + "subClassOf").collect())
    assert got == sorted([("alone", 0, "alone"), ("b0", DEEP + 1, "top")] + [("b0", i, f"b{i}") for i in range(DEEP + 1)])


def test_cycles_end(spark):
    edges = [("x", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("b", "top"), ("y", "x")]
    triples = O.triples_from_rows(spark, [(s, O.RDFS + "subClassOf", o) for s, o in edges])
    up = {(r.child, r.ancestor): r.distance for r in O.closure(O.class_edges(triples)).collect()}
    assert up["y", "top"] == 4 and up["c", "b"] == 2 and ("a", "a") not in up
    assert {r.uri: r.depth for r in O.class_depth(triples).collect()} == {"top": 1, "a": 2, "b": 2, "c": 2, "x": 3, "y": 4}
    got = {(r.node, r.step) for r in O.chain(triples, spark.createDataFrame([("a",)], "uri string"), O.RDFS + "subClassOf").collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2), ("top", 2)}
