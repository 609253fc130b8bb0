"""Sources, search index, conflicts, discourse, schema and plans on small inputs, with brute force where SQL cannot say it."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataweave.functions.salvage import salvage_json
from strataweave.functions.similarity import hash_embed, jaro_winkler
from strataweave.operators import annotate, conflicts, discourse, proposals, schema, search
from strataweave.operators import ontology as O
from strataweave.plans import benchmark, dialogue
from strataweave.sources import exports, rdf, rdf_formats, tables

EX = "http://x.org/"


# ---- sources


def test_light_tables_are_told_by_how_lines_start():
    assert tables.parse_light("a,b\n1,x|y\n") == (["a", "b"], [["1", "x|y"]])
    assert tables.parse_light("| a | b |\n|---|:-:|\n| 1 |\n| 1 | 2 | 3 |") == (["a", "b"], [["1", ""], ["1", "2"]])
    assert tables.parse_light("a\tb\n\n1\t2") == (["a", "b"], [["1", "2"]])
    assert tables.parse_light("  ") == ([], [])


def test_large_tables_are_not_cut_in_silence(spark, monkeypatch):
    monkeypatch.setattr(tables, "MOST_ROWS", 3)
    small = spark.createDataFrame([("a|b", None), ("c", "d")], "x string, y string")
    assert tables.to_markdown(small) == "| x | y |\n| --- | --- |\n| a\\|b |  |\n| c | d |" and tables.to_csv(small).splitlines() == ["x,y", "a|b,", "c,d"]
    for out in (tables.to_markdown, tables.to_csv):
        with pytest.raises(ValueError):
            out(small.unionByName(small))


TURTLE = f'''@prefix ex: <{EX}> .
PREFIX owl: <http://www.w3.org/2002/07/owl#>
@base <{EX}base/> .
ex:A a owl:Class ; ex:says """long "quoted"
text""" , 'short' , "caf\\u00e9"@fr ; ex:n 3, 2.5 ; ex:to <rel> .
ex:B ex:has [ ex:in ex:A ] .
'''
JSONLD = json.dumps({
    "@context": {"ex": EX, "owl": "http://www.w3.org/2002/07/owl#", "to": {"@id": "ex:to", "@type": "@id"}, "@base": EX + "base/"},
    "@graph": [{"@id": "ex:A", "@type": "owl:Class", "ex:says": ['long "quoted"\ntext', "short", {"@value": "café", "@language": "fr"}], "ex:n": [3, {"@value": "2.5", "@type": O.XSD + "decimal"}], "to": "rel", "unknown": 1}, {"@id": "ex:B", "ex:has": {"ex:in": {"@id": "ex:A"}}}],
})
RDFXML = f'''<rdf:RDF xmlns:rdf="{O.RDF}" xmlns:ex="{EX}" xmlns:owl="http://www.w3.org/2002/07/owl#" xml:base="{EX}base/">
<owl:Class rdf:about="{EX}A"><ex:says>long "quoted"\ntext</ex:says><ex:says>short</ex:says><ex:says xml:lang="fr">café</ex:says>
<ex:n rdf:datatype="{O.XSD}integer">3</ex:n><ex:n rdf:datatype="{O.XSD}decimal">2.5</ex:n><ex:to rdf:resource="rel"/></owl:Class>
<rdf:Description rdf:about="{EX}B"><ex:has rdf:parseType="Resource"><ex:in rdf:resource="{EX}A"/></ex:has></rdf:Description></rdf:RDF>'''


def _no_names(rows):
    return {tuple("_:" if isinstance(x, str) and x.startswith("_:") else x for x in r) for r in rows}


def test_three_formats_say_the_same():
    a, b, c = rdf.parse_rdf(TURTLE, "turtle"), rdf.parse_rdf(JSONLD, "json-ld"), rdf.parse_rdf(RDFXML, "xml")
    assert _no_names(a) == _no_names(b) == _no_names(c) and len(a) == 9
    assert (EX + "A", EX + "to", EX + "base/rel", "iri", None, None) in a and (EX + "A", EX + "says", "café", "literal", None, "fr") in a
    for text, kind in (("{", "json-ld"), ("<a>", "xml"), ("ex:a ex:b .", "turtle"), ('{"@context": "http://remote"}', "json-ld")):
        with pytest.raises(ValueError):
            rdf.parse_rdf(text, kind)
    listed = rdf.parse_rdf(json.dumps({"@id": "urn:a", O.OWL + "unionOf": {"@list": [{"@id": "urn:x"}, {"@id": "urn:y"}]}}), "json-ld")
    assert {r[2] for r in listed} == {"urn:x", "urn:y"}
    assert rdf_formats.parse_rdfxml(f'<rdf:RDF xmlns:rdf="{O.RDF}"/>') == []


def test_files_that_cannot_be_read_are_told(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(TURTLE)
    (tmp_path / "b.jsonld").write_text(JSONLD)
    (tmp_path / "c.owl").write_text(RDFXML)
    good = rdf.read_rdf(spark, str(tmp_path))
    assert good.filter(~F.col("s").startswith("_:") & ~F.col("o").startswith("_:")).count() == 7
    (tmp_path / "bad.ttl").write_text("ex:a ex:b")
    (tmp_path / "bytes.ttl").write_bytes(b"\xff\xfe")
    assert {r.path.rsplit("/", 1)[1] for r in rdf.rdf_errors(spark, str(tmp_path)).collect()} == {"bad.ttl", "bytes.ttl"}
    with pytest.raises(Exception, match="cannot read RDF"):
        rdf.read_rdf(spark, str(tmp_path)).collect()
    assert rdf.read_rdf(spark, str(tmp_path), bad="skip").count() == good.count()
    assert rdf.load_ontology(spark, good).count() == good.count()
    aliases = spark.createDataFrame([(EX + "to", EX + "via"), (EX + "via", EX + "by")], "src string, dst string")
    loaded = rdf.load_defaults(spark, [str(tmp_path / "a.ttl"), good], aliases)
    assert {r.p for r in loaded.filter(F.col("o") == EX + "base/rel").collect()} == {EX + "to", EX + "via", EX + "by"}


def test_assembly_writes_triples_and_report(spark, tmp_path):
    emitted = spark.createDataFrame([("a", "urn:p", "x, \"y\"", 0.9, "Stage0-Exact", False, "Literal Typed"), ("b", "urn:p", "2", 0.4, "Unmapped", True, "HITL Validation")], "subject string, predicate string, object string, confidence double, method string, review_flag boolean, module_action string")
    report = exports.assemble(emitted, str(tmp_path / "out"))
    assert "Literal Typed" in report and "".join(p.read_text() for p in (tmp_path / "out/report").glob("*.txt")).strip() == report.strip()
    back = spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "out/triples"))
    assert sorted(r.object for r in back.collect()) == ["2", 'x, "y"']
    shapes = spark.createDataFrame([("S", "urn:C", ["urn:p"], "minCount", "2", "m")], "shape string, target string, path array<string>, kind string, arg string, message string")
    types = O.triples_from_rows(spark, [("urn:strataweave:id/a", O.RDF + "type", "urn:C")])
    assert exports.assemble(emitted, str(tmp_path / "two"), shapes, types).endswith("Shapes: 1 violations")


@pytest.mark.parametrize("text, want", [("", None), (None, None), ('{"a": 1}', {"a": 1}), ("x ```json\n[1, 2]\n``` y", [1, 2]), ('so {"a": {"b": 2}} it', {"a": {"b": 2}}), ("so [1] it", [1]), ("{cut", None), ("```\n{bad}\n``` but [3]", [3])])
def test_salvage(text, want):
    assert salvage_json(text) == want


# ---- search


def _terms(spark):
    rows = [("urn:Weapon", O.RDF + "type", O.OWL + "Class"), ("urn:Weapon", O.RDFS + "label", "Weapon", "literal", None, None), ("urn:GreatSword", O.RDFS + "subClassOf", "urn:Weapon"), ("urn:madeBy", O.RDF + "type", O.OWL + "ObjectProperty"), ("urn:madeBy", O.RDFS + "label", "made by", "literal", None, None), ("urn:weight", O.RDF + "type", O.OWL + "DatatypeProperty"), ("urn:s1", O.RDF + "type", "urn:GreatSword"), ("urn:s1", O.RDFS + "label", "Old Sword", "literal", None, None), ("urn:s2", O.RDF + "type", "urn:GreatSword"), ("urn:s2", O.RDFS + "label", "New Sword", "literal", None, None)]
    return O.triples_from_rows(spark, rows)


def test_index_is_filled_saved_and_searched(spark, tmp_path):
    index = search.SearchIndex.empty(spark).add_ontology(_terms(spark)).add_defaults("urn:d:").add_item("Individual", "urn:h", "Hammer", ("Mallet",), ("urn:Tool",), "hits things")
    index = index.add_item("Individual", "urn:h", "Another", ())  # the first one stays
    index.save(str(tmp_path / "index"))
    back = search.SearchIndex.load(spark, str(tmp_path / "index"))
    assert back.items.count() == index.items.count() and back.items.filter("iri = 'urn:h'").first().label == "Hammer"
    ask = lambda *q: spark.createDataFrame([(x,) for x in q], "query string")
    top = lambda rows: {r.query: r.iri for r in rows.filter("rank = 1").collect()}
    assert top(back.search(ask("old sword", "MALLET", ""))) == {"old sword": "urn:s1", "MALLET": "urn:h"}
    assert top(back.search(ask("sword"), type_filter="tool")) == {"sword": "urn:h"}
    assert top(back.search_classes(ask("weapon"))) == {"weapon": "urn:Weapon"}
    assert top(back.search_properties(ask("made by", "located in zone"))) == {"made by": "urn:madeBy", "located in zone": "urn:d:locatedInZone"}
    assert {r.kind for r in back.search_relation(ask("made by")).collect()} <= {"ObjectProperty", "DatatypeProperty"}
    assert {r.kind for r in back.search_datatype_property(ask("weight")).collect()} == {"DatatypeProperty"}
    assert back.search_class(ask("weapon"), 3).count() == 3 and back.search_individual(ask("hammer")).filter("rank = 1").first().iri == "urn:h"
    assert back.search_concept(ask("hammer"), 4).count() == 4 and back.search_object_property(ask("made")).filter("rank = 1").first().kind == "ObjectProperty"


def test_hybrid_search_against_brute_force(spark):
    rng = random.Random(4)
    words = ["old", "new", "great", "sword", "axe", "of", "fire", "Ice", "bow"]
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))
    items = [(f"urn:{i}", name(), [name()] if i % 3 == 0 else [], ["urn:T"]) for i in range(40)]
    queries = sorted({name() for _ in range(15)})
    from strataweave.functions.normalize import normalize_leet
    from strataweave.operators.retrieval import hybrid_search

    norm = {r.x: r.n for r in spark.createDataFrame([(x,) for i in items for x in (i[1], *i[2])] + [(q,) for q in queries], "x string").distinct().select("x", normalize_leet(F.col("x")).alias("n")).collect()}

    def lexical(a, b):
        a, b = norm[a], norm[b]
        if not a or not b:
            return 0.0
        if a == b:
            return 1.0
        jac = lambda x, y: len(x & y) / len(x | y) if x | y else 0.0
        grams = lambda s: {f"^{s}$"[i : i + 3] for i in range(len(s))}
        d = np.arange(len(b) + 1)
        for i, c in enumerate(a):
            prev, d[0] = d.copy(), i + 1
            for j, e in enumerate(b):
                d[j + 1] = min(prev[j] + (c != e), prev[j + 1] + 1, d[j] + 1)
        mean = (jac(set(re.findall(r"\w+", a)), set(re.findall(r"\w+", b))) + jac(grams(a), grams(b)) + 1 - d[-1] / max(len(a), len(b)) + jaro_winkler(a, b)) / 4
        return min(1.0, mean + (0.15 if a in b or b in a else 0.0))

    def score(q, item):
        lex = max(lexical(q, t) for t in {item[1], *item[2]})
        near = float(hash_embed(q) @ hash_embed(item[1]))
        out = 0.6 * ((near + 1) / 2 if near < 0 else near) + 0.4 * lex
        return max(out, 0.95) if any(norm[q] == norm[t] for t in {item[1], *item[2]}) else out

    found = hybrid_search(spark.createDataFrame([(q,) for q in queries], "query string"), spark.createDataFrame(items, "iri string, label string, aliases array<string>, types array<string>"), 5).collect()
    assert len(found) == 5 * len(queries)
    for q in queries:
        want = sorted((-round(score(q, i), 5), i[0]) for i in items)[:5]
        got = sorted((-round(r.score, 5), r.iri) for r in found if r.query == q)
        assert np.allclose([w[0] for w in want], [g[0] for g in got], atol=2e-5)


def test_embedders(spark):
    a, b, c = (search.word_char_embed(x) for x in ("great sword", "Great  sword", "oak plank"))
    assert a.shape == (384,) and abs(np.linalg.norm(a) - 1) < 1e-5 and a @ b > 0.8 > a @ c and not search.word_char_embed("  ").any()
    embed = search.model_embedder(lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]))
    assert [r.v for r in spark.createDataFrame([("ab",), (None,)], "x string").select(embed("x").alias("v")).collect()] == [[2.0, 1.0], [0.0, 1.0]]


# ---- readings and conflicts


def test_rows_without_a_subject_and_known_types(spark):
    cells = spark.createDataFrame([(1, 0, "Name", "Plank"), (1, 1, "Amount", "4"), (1, 2, "Other", "2x Ingot"), (1, 3, "Name 2", ""), (2, 0, "Name", "Rope")], "row_id int, ordinal int, header string, value string")
    known = spark.createDataFrame([("Plank", "CraftingMaterial"), ("Rope", "CraftingMaterial")], "label string, type string")
    columns = proposals.classify_columns(cells, known)
    assert {r.header: r.role for r in columns.collect()} == {"Name": "subject", "Amount": "quantity", "Other": "ingredient", "Name 2": "ingredient"}
    got = proposals.row_relations(proposals.mentions(cells, columns, known)).collect()
    assert sorted((r.row_id, r.subject, r.object, r.quantity) for r in got) == [(1, "TargetRecipe", "Ingot", 2.0), (1, "TargetRecipe", "Plank", 4.0), (2, "TargetRecipe", "Rope", None)]
    assert proposals.row_relations(proposals.mentions(cells, columns, known), subject="Box").select("subject").distinct().collect()[0].subject == "Box"


def test_components_stop_at_their_depth_and_at_cycles(spark):
    rows = [(f"urn:{i}", "urn:of", f"urn:{i + 1}") for i in range(8)] + [("urn:2", "urn:of", "urn:0")]
    made = conflicts.components(O.triples_from_rows(spark, rows), spark.createDataFrame([("urn:0",)], "uri string"), ("urn:of",)).collect()
    assert sorted((r.component, r.distance) for r in made) == [(f"urn:{i}", i) for i in (1, 2, 3, 4)]


def test_components_upwards_agree_and_dead_ends_are_not_followed(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(f"urn:{rng.randrange(30)}", rng.choice(["urn:of", "urn:makes"]), f"urn:{rng.randrange(30)}") for _ in range(70)]
    triples, products = O.triples_from_rows(spark, rows), spark.createDataFrame([(f"urn:{i}",) for i in range(0, 30, 2)], "uri string")
    every = {tuple(r) for r in conflicts.components(triples, products, ("urn:of",), ("urn:makes",)).collect()}
    parts = spark.createDataFrame([("urn:3",), ("urn:4",), ("urn:17",)], "component string")
    some = {tuple(r) for r in conflicts.components(triples, products, ("urn:of",), ("urn:makes",), parts=parts).collect()}
    assert some == {r for r in every if r[1] in ("urn:3", "urn:4", "urn:17")} and some
    settled = []
    monkeypatch.setattr(conflicts, "_settled", lambda df: settled.append(df) or df.cache())
    flat = O.triples_from_rows(spark, [(f"urn:{i}", "urn:of", "urn:x") for i in range(9)])
    assert conflicts.components(flat, products, ("urn:of",)).count() == 5 and len(settled) == 2  # the edges and one step


def test_vetoes_of_values_and_of_columns_agree(spark):
    from strataweave.operators import predicate as P

    rng = random.Random(6)
    roles = ["Numeric property", "Measurement value/unit pair", "Categorical", "Text", "Timestamp", "Entity ID"]
    ranges = lambda: [rng.choice(["urn:C", *(O.XSD + x for x in ("string", "double", "integer", "date", "boolean"))]) for _ in range(rng.randint(0, 3))]
    number = lambda: rng.choice([None, 0.0, 5.0, 9.0])
    rows = [(i, rng.choice(roles), rng.choice(["ObjectProperty", "DatatypeProperty"]), ranges(), ranges(), number(), number(), number(), number()) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, role string, kind string, a array<string>, b array<string>, lo double, hi double, least double, most double")
    c = F.col
    got = df.select("id", P.violates_axiom(c("role"), c("kind"), c("a")).alias("v"), P.ranges_compatible(c("a"), c("b")).alias("r"), P.violates_bounds(c("lo"), c("hi"), c("least"), c("most")).alias("o"))
    assert {r.id: (r.v, r.r, r.o) for r in got.collect()} == {i: (P.vetoed(role, kind, a), P.compatible(a, b), P.outside(lo, hi, least, most)) for i, role, kind, a, b, lo, hi, least, most in rows}


def test_neighbours_in_blocks(spark, monkeypatch):
    from strataweave.operators import retrieval as R

    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 6))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    asked = vectors.filter("id < 20").selectExpr("id as qid", "vec as qvec")
    whole = {(r.qid, r.rank): r.id for r in R.knn(vectors, asked, 4).collect()}
    monkeypatch.setattr(R, "QUERY_BLOCK", 6)
    assert {(r.qid, r.rank): r.id for r in R.knn(vectors, asked, 4).collect()} == whole
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert whole == {(q, k + 1): int(i) for q in range(20) for k, i in enumerate(np.argsort(-(u[q] @ u.T))[:4])}


def test_equal_vectors_rank_by_id_and_tiles_are_small(spark):
    from strataweave.operators import retrieval as R

    rng = np.random.default_rng(4)
    v = np.repeat(rng.normal(size=(700, 9)), 7, axis=0)[rng.permutation(4900)]
    vectors = spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>").coalesce(1)
    asked = vectors.filter("id % 8 = 0").selectExpr("id as qid", "vec as qvec")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    want = {(q, k + 1): int(i) for q in range(0, 4900, 8) for k, i in enumerate(np.lexsort((np.arange(4900), -s[q]))[:10])}
    assert {(r.qid, r["rank"]): r.id for r in R.knn(vectors, asked, 10).collect()} == want
    run = R._nearest_of(asked.collect(), 10)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(4900)), pa.array(v.tolist(), pa.list_(pa.float64()))], names=["id", "vec"])
    import tracemalloc

    tracemalloc.start()
    list(run(iter([batch] * 3)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6  # one product of all is 24 MB


# ---- discourse


def test_clause_slots(spark):
    aliases = spark.createDataFrame([("urn:p", "Spiritwood Plank", "CraftingMaterial", "spiritwood planks"), ("urn:h", "H.O.P.E.", "PrecursorWeapon", "H.O.P.E."), ("urn:z", "Arc", "Zone", "Arc"), ("urn:never", "arc", "Zone", "arc")], "uri string, label string, type string, alias string")
    docs = spark.createDataFrame([(1, "You must combine 30 Spiritwood Planks with H.O.P.E.; Chef 400 is required; it costs 5 laurels and 3 gold in Arc. In my opinion the arc is nice")], "doc_id int, text string")
    rows = {r.clause_no: r for r in discourse.parse(docs, aliases, disciplines=("chef",)).collect()}
    said = lambda n, name: [s.value for s in rows[n].slots if s.name == name]
    assert rows[0].anchor == "H.O.P.E." and said(0, "quantity") == ["30"] and said(0, "entity") == ["Spiritwood Plank"] and said(0, "relation") == ["requiresIngredient"]
    assert said(1, "discipline") == ["Chef"] and said(1, "min_rating") == ["400"] and rows[1].anchor is None
    assert said(2, "cost") == ["5 laurels", "3 gold"] and rows[2].anchor == "Arc" and rows[3].pruned and rows[3].slots is None
    triples = {(r.subject, r.predicate, r.object) for r in discourse.frame_triples(discourse.parse(docs, aliases)).collect()}
    assert triples == {("H.O.P.E.", "requiresIngredient", "Spiritwood Plank")}


def _shuffled(df):
    """What each exchange of a plan carries."""
    def walk(node):
        if node.nodeName() == "Exchange":
            yield node.output().mkString(",")
        for i in range(node.children().size()):
            yield from walk(node.children().apply(i))

    plan = df._jdf.queryExecution().executedPlan()
    return list(walk(plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan))


@pytest.mark.parametrize("name", ["aboutness", "frame_entities", "frame_triples", "induced_dimensions", "slot_counts", "frame_anchors"])
def test_clauses_are_not_shuffled(spark, name):
    from strataweave.plans.queries import QUERIES

    assert not any("clause#" in x for x in _shuffled(QUERIES[name](spark, "/root/testdata/sf0.001")))


def test_frames_by_row_and_by_join_agree(spark, monkeypatch):
    from strataweave.plans.text_queries import ALIASES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(40)
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "The Ärger_x and the İ, then The\nThe-and That; 3 Pour")], "doc_id long, text string"))
    aliases = spark.createDataFrame([*ALIASES, ("urn:the", "The", "CraftingMaterial", "The-and"), (None, None, None, "pour"), ("urn:x", "X", None, "ärger"), ("urn:y", "Y", "Zone", None)], "uri string, label string, type string, alias string")
    own = sorted(map(str, discourse.parse(docs, aliases, disciplines=("chef",)).collect()))
    monkeypatch.setattr(discourse, "FEW_ALIASES", 0)
    by_join = discourse.parse(docs, aliases, disciplines=("chef",)).select("doc_id", "clause_no", "sentence_no", "clause", "modality", "confidence", "pruned", "anchor", "anchor_uri", "anchor_type", "slots")
    assert own == sorted(map(str, by_join.collect())) and len(own) > 400


def test_clauses_of_a_repeated_key_are_numbered_together(spark):
    from strataweave.operators import text as T

    docs = spark.createDataFrame([(1, "One thing. Two things"), (1, "One thing. Two things"), (2, "Alone")], "doc_id int, text string")
    got = sorted((r.doc_id, r.clause_no, r.clause) for r in T.clauses(docs).collect())
    assert got == [(1, 0, "One thing."), (1, 1, "One thing."), (1, 2, "Two things"), (1, 3, "Two things"), (2, 0, "Alone")]


# ---- schema


def test_trees_with_two_parents_and_cycles(spark):
    rows = [("urn:b", "urn:a"), ("urn:c", "urn:a"), ("urn:d", "urn:b"), ("urn:d", "urn:c"), ("urn:x", "urn:y"), ("urn:y", "urn:x"), ("urn:x", "urn:a")]
    triples = O.triples_from_rows(spark, [(s, O.RDFS + "subClassOf", o) for s, o in rows])
    tree = schema.class_tree(triples, "urn:a")
    assert [c["iri"] for c in tree["children"]] == ["urn:b", "urn:c", "urn:x"] and [c["children"][0]["iri"] for c in tree["children"]] == ["urn:d", "urn:d", "urn:y"]
    assert [c["iri"] for c in schema.class_tree(triples)["children"]] == ["urn:a"]


def test_deep_hierarchies_have_all_ancestors(spark):
    triples = O.triples_from_rows(spark, [(f"urn:{i}", O.RDFS + "subClassOf", f"urn:{i + 1}") for i in range(40)])
    assert O.closure(O.class_edges(triples)).count() == 820
    assert O.chain(triples, spark.createDataFrame([("urn:0",)], "uri string"), O.RDFS + "subClassOf").count() == 41


@pytest.mark.parametrize("name", ["entity_catalog", "shacl_alternative_mincount", "shacl_nodekind", "shacl_maxcount", "cardinality"])
def test_subjects_are_shuffled_once(spark, name):
    from strataweave.plans.queries import QUERIES

    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(_shuffled(df)) == 1 and df._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 0
    before = O.TASK_BYTES
    try:
        O.TASK_BYTES = 1 << 10  # the tasks grow in number with the input
        assert "4), REPARTITION" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        O.TASK_BYTES = before


# ---- plans


def test_dialogue_repairs_what_violates(spark):
    cells = spark.createDataFrame([(1, 0, "Precursor", "Old Tooth"), (1, 1, "Material", "2x Oak Plank"), (1, 2, "Discipline", "Chef"), (2, 0, "Precursor", "The Staff"), (2, 1, "Material", "Ingot"), (2, 2, "Discipline", "Artificer")], "row_id int, ordinal int, header string, value string")
    entities = spark.createDataFrame([("urn:e/tooth", "Old Tooth", [], ["urn:t/TrophyItem"]), ("urn:e/staff", "The Staff", [], ["urn:t/PrecursorWeapon"]), ("urn:e/plank", "Oak Plank", [], ["urn:t/CraftingMaterial"]), ("urn:e/ingot", "Ingot", [], ["urn:t/CraftingMaterial"])], "iri string, label string, aliases array<string>, types array<string>")
    triples = O.triples_from_rows(spark, [("urn:t/TrophyItem", O.OWL + "disjointWith", "urn:t/PrecursorWeapon"), ("urn:e/staff", "urn:by", "urn:d/Weaponsmith")])
    known = spark.createDataFrame([], "iri string, label string, aliases array<string>, types array<string>")
    out = dialogue.run(cells, entities, known, triples, "urn:x/", ("urn:by",))
    assert [(r.round, r.action, r.n) for r in out.trace.collect()] == [(1, "PROPOSE", 6), (1, "EVALUATE", 2), (2, "REPAIR", 2), (2, "VERIFY", out.triples.count())]
    assert {(r.kind, r.row_id, r.focus) for r in out.violations.collect()} == {("DisjointClassViolation", 1, "Old Tooth"), ("DisciplineMismatchViolation", 2, "The Staff")}
    assert {r.type for r in out.cells.filter("ordinal = 0").collect()} == {"PrecursorWeapon"}
    said = {(r.s, r.p, r.o) for r in out.triples.filter("row_id = 1").collect()}
    assert ("urn:e/tooth", "requiresIngredient", "urn:e/plank") in said and ("urn:e/tooth", "type", "PrecursorWeapon") in said
    assert {r.type for r in out.columns.collect()} >= {"PrecursorWeapon", "CraftingDiscipline"}


def test_benchmark_scores(spark):
    from strataweave.plans.fixtures import CEA, CPA, CTA

    pair = "source string, target string, property string"
    truth = {"by_cell": spark.createDataFrame(CEA[1], "row_id int, col int, expected string"), "by_mention": spark.createDataFrame(CEA[2], "mention string, expected string"), "columns": spark.createDataFrame(CTA[1], "header string, class_iri string"), "pairs": spark.createDataFrame(CPA[1], pair)}
    one = lambda model, n: benchmark.score_table("t1", "Trade", model, spark.createDataFrame(CEA[0], "row_id int, col int, raw string, iri string"), spark.createDataFrame(CTA[0], "header string, iri string"), spark.createDataFrame(CPA[0], pair), truth, n, 10)
    scores = benchmark.suite([one("a", 1), one("b", 20)])
    got = {r.model: (r.avg_cea, r.avg_validity, r.total_violations) for r in benchmark.summary(scores).collect()}
    assert got == {"a": (0.5, 0.9, 1), "b": (0.5, 0.0, 20)}
    assert benchmark.of_domain(scores, "trade").count() == 2
    with pytest.raises(ValueError):
        benchmark.of_domain(scores, "nothing")


def test_cells_take_parts_and_headers(spark):
    cells = spark.createDataFrame([(1, 0, "Item", "3x Oak Plank + Rope"), (1, 1, "From", "Hobbs in Lion's Arch"), (1, 2, "Qty", "4"), (1, 3, "Zone", "Grove"), (1, 4, "Item", "true")], "row_id int, ordinal int, header string, value string")
    entities = spark.createDataFrame([("urn:e/plank", "Oak Plank", [], ["urn:t/Material"])], "iri string, label string, aliases array<string>, types array<string>")
    got = {(r.ordinal, r.value): (r.iri, r.type) for r in annotate.cell_entities(cells, entities, "urn:x/").collect()}
    assert got[0, "Oak Plank"] == ("urn:e/plank", "Material") and got[1, "Hobbs"] == ("urn:x/ref/npcvendor/hobbs", "NPCVendor") and got[1, "Lion's Arch"] == ("urn:x/ref/zone/lions_arch", "Zone")
    assert got[3, "Grove"][1] == "Zone" and (4, "true") not in got and not any(k[0] == 2 for k in got)
