"""Small fixed inputs of the registered queries, with the results they must give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataweave.operators.ontology import OWL, RDF, RDFS, XSD, triples_from_rows

#: (raw cell, cleaned name, (name, quantity, unit), parts as (kind, name, quantity, rating, zone))
CELLS = [
    ("[[Spiritwood Plank]] x10", "Spiritwood Plank", ("Spiritwood Plank", 10, "count"), [("ingredient", "Spiritwood Plank", 10, None, None)]),
    ("10x [[Elonian Leather Square]]", "Elonian Leather Square", ("Elonian Leather Square", 10, "count"), [("ingredient", "Elonian Leather Square", 10, None, None)]),
    ("3x Spiritwood Plank + 3x Deldrimor Ingot", "Spiritwood Plank + 3x Deldrimor Ingot", ("Spiritwood Plank + 3x Deldrimor Ingot", 3, "count"), [("ingredient", "Spiritwood Plank", 3, None, None), ("ingredient", "Deldrimor Ingot", 3, None, None)]),
    ("Artificer (450)", "Artificer", ("Artificer", 450, "count"), [("discipline", "Artificer", None, 450, None)]),
    ("Hobbs in Lion's Arch", "Hobbs in Lion's Arch", ("Hobbs in Lion's Arch", None, None), [("vendor", "Hobbs", None, None, "Lion's Arch")]),
    ("10g + 500 karma", "+", ("10g + 500 karma", None, None), [("currency", "Gold", 10, None, None), ("currency", "Karma", 500, None, None)]),
    ("5g 50s", "", ("5g 50s", 5.5, "Gold"), [("currency", "Gold", 5, None, None), ("currency", "Silver", 50, None, None)]),
    ("The Raven (Tier 1)", "The Raven", ("The Raven (Tier 1)", None, None), [("vendor", "The Raven", None, None, "Tier 1")]),
    ("Mystic Clover", "Mystic Clover", ("Mystic Clover", None, None), [("name", "Mystic Clover", None, None, None)]),
    ("", "", ("", None, None), []),
]

#: (clause, modality, confidence)
CLAUSES = [
    ("You must talk to Hobbs", "DEONTIC_RULE", 0.92),
    ("in my opinion this staff is nice", "BOULETIC_FLUFF", 0.95),
    ("I realized that you must talk to Hobbs", "DEONTIC_RULE", 0.92),
    ("if you want the staff, go on", "HYPOTHETICAL", 0.90),
    ("it will take about 50 planks", "EPISTEMIC_ESTIMATE", 0.88),
    ("the zone is green", "DEONTIC_RULE", 0.75),
]

#: (uri, alias) counted in whole documents: several aliases of one entity, several words, capitals, accents, words that are parts of others, one that never occurs.
MENTIONS = [
    ("urn:article", "the"), ("urn:article", "der"), ("urn:article", "la"), ("urn:of", "of"), ("urn:of", "of the"), ("urn:is", "IS"), ("urn:is", "ist"),
    ("urn:that", "that"), ("urn:that", "que"), ("urn:to", "to the"), ("urn:to", "à"), ("urn:for", "für"), ("urn:for", "for"), ("urn:nothing", "zyzzyva"),
]

#: Predictions and truth: one entity by coordinates, one by mention, one unknown though expected, one wrong.
CEA = (
    [(0, 0, "Raven", "urn:e/TheRaven"), (0, 1, "Plank", "urn:e/plank"), (1, 0, "Clover", "urn:e/unknown/clover"), (1, 1, "Ingot", "urn:e/stone")],
    [(0, 0, "urn:x/TheRaven")],
    [("plank", "urn:x/plank"), ("clover", "urn:x/clover"), ("ingot", "urn:x/ingot")],
)
CTA = ([("Name", "urn:a/Item"), ("Zone", "urn:a/Zone"), ("Cost", "urn:a/Zone")], [("name", "urn:b/Item"), ("zone", "urn:b/Zone"), ("cost", "urn:b/Cost")])
CPA = ([("A", "B", "urn:p/requires"), ("A", "C", "urn:p/requiresItem"), ("B", "C", "urn:p/x")], [("a", "b", "urn:q/requires"), ("a", "c", "urn:q/requires"), ("c", "a", "urn:q/y")])


def trade_ontology(spark: SparkSession) -> DataFrame:
    """A small ontology of orders: classes, disjointness, object and datatype properties."""
    t = "urn:trade:"
    rows: list[tuple] = []
    for c in ("Order", "Customer", "Segment", "Automobile", "Building", "Furniture", "Household", "Machinery"):
        rows += [(t + c, RDF + "type", OWL + "Class"), (t + c, RDFS + "label", c, "literal", XSD + "string", None)]
    rows += [(t + c, RDFS + "subClassOf", t + "Segment") for c in ("Automobile", "Building", "Furniture", "Household", "Machinery")]
    rows += [(t + "Order", OWL + "disjointWith", t + "Customer")]
    for name, label, kind, domain, range_ in (
        ("orderId", "order identifier", "Datatype", "Order", XSD + "string"),
        ("totalPrice", "total price", "Datatype", "Order", XSD + "double"),
        ("orderDate", "order date", "Datatype", "Order", XSD + "dateTime"),
        ("customerName", "customer name", "Datatype", "Order", XSD + "string"),
        ("marketSegment", "market segment", "Object", "Order", t + "Segment"),
        ("placedBy", "placed by", "Object", "Order", t + "Customer"),
    ):
        rows += [(t + name, RDF + "type", OWL + kind + "Property"), (t + name, RDFS + "label", label, "literal", XSD + "string", None), (t + name, RDFS + "domain", t + domain), (t + name, RDFS + "range", range_)]
    return triples_from_rows(spark, rows)
