"""More of an ontology as triples: runtime registration, membership tests, class trees, disciplines, layer checks, vocabularies of
concept schemes, and row-wise verification of linked columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.functions.normalize import local_name
from strataweave.operators.ontology import OWL, RDF, RDFS, SH, SKOS, THING, class_edges, classes, closure, disjoint_inherited, individuals, of, triples_from_rows
from strataweave.rules import headers

# ---- registration


def register_class(triples: DataFrame, uri: str, superclass: str | None = THING, label: str | None = None, description: str | None = None) -> DataFrame:
    rows = [(uri, RDF + "type", OWL + "Class")] + ([(uri, RDFS + "subClassOf", superclass)] if superclass and uri != THING else [])
    return _added(triples, rows, uri, label, description)


def register_disjoint(triples: DataFrame, a: str, b: str) -> DataFrame:
    return _added(triples, [(a, OWL + "disjointWith", b), (b, OWL + "disjointWith", a)])


def register_property(triples: DataFrame, uri: str, domain: str | None = None, range_: str | None = None, is_datatype: bool = False, label: str | None = None, description: str | None = None) -> DataFrame:
    rows = [(uri, RDF + "type", OWL + ("DatatypeProperty" if is_datatype else "ObjectProperty"))]
    rows += [(uri, RDFS + "domain", domain)] if domain else []
    rows += [(uri, RDFS + "range", range_)] if range_ else []
    return _added(triples, rows, uri, label, description)


def register_entity(triples: DataFrame, uri: str, class_uri: str, label: str | None = None, description: str | None = None) -> DataFrame:
    return _added(triples, [(uri, RDF + "type", class_uri)], uri, label, description)


def register_triple(triples: DataFrame, s: str, p: str, o: object) -> DataFrame:
    return _added(triples, [_triple(s, p, o)])


def _triple(s: str, p: str, o: object) -> tuple:
    """Text with a colon in it is an IRI; any other object is a literal."""
    return (s, p, o) if isinstance(o, str) and ":" in o else (s, p, str(o).lower() if isinstance(o, bool) else str(o), "literal", None, None)


def _added(triples: DataFrame, rows: list[tuple], uri: str | None = None, label: str | None = None, description: str | None = None) -> DataFrame:
    rows = rows + [(uri, RDFS + p, x, "literal", None, None) for p, x in (("label", label), ("comment", description)) if x]
    return triples.unionByName(triples_from_rows(triples.sparkSession, rows)).dropDuplicates()


def has_triples(asked: DataFrame, triples: DataFrame) -> DataFrame:
    """asked(s, p, o) -> also ``present``. A left join on all three parts."""
    there = triples.select("s", "p", "o").distinct().withColumn("present", F.lit(True))
    return asked.join(there, ["s", "p", "o"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


# ---- membership and trees


def is_subclass_of(pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """pairs(child, ancestor) -> also ``holds``: equal, under owl:Thing, equivalent, or above by subclasses and equivalents."""
    same = of(triples, OWL + "equivalentClass").filter("o_kind = 'iri'").select(F.col("s").alias("child"), F.col("o").alias("parent"))
    edges = class_edges(triples).unionByName(same).unionByName(same.select(F.col("parent").alias("child"), F.col("child").alias("parent")))
    up = closure(edges).select("child", "ancestor").distinct().withColumn("_up", F.lit(True))
    met = pairs.join(up, ["child", "ancestor"], "left")
    return met.withColumn("holds", (F.col("child") == F.col("ancestor")) | (F.col("ancestor") == THING) | F.col("_up").isNotNull()).drop("_up")


def is_instance_of(pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """pairs(uri, class_uri) -> also ``holds``: some type of the individual is the class or under it."""
    typed = pairs.join(individuals(triples), "uri", "left")
    asked = typed.select(F.col("type").alias("child"), F.col("class_uri").alias("ancestor")).filter("child is not null").distinct()
    under = is_subclass_of(asked, triples).filter("holds").select(F.col("child").alias("type"), F.col("ancestor").alias("class_uri"), F.lit(True).alias("_in"))
    return typed.join(under, ["type", "class_uri"], "left").groupBy("uri", "class_uri").agg(F.coalesce(F.bool_or("_in"), F.lit(False)).alias("holds"))


def tree_paths(triples: DataFrame, root: str | None = None) -> DataFrame:
    """(uri, label, parent, depth, path): a row per place of a class in the tree below ``root``, or below every class without a
    superclass; a class with two parents has two places. ``path`` names the classes from the top, and orders siblings by IRI.

    Level by level: a join of the last level with the edges. A class is never put below itself, so cycles end.
    """
    edges = class_edges(triples).filter(F.col("child") != F.col("parent")).distinct()
    every = classes(triples).select("uri", "label")
    tops = every.filter(F.col("uri") == root) if root is not None else every.join(edges.filter(F.col("parent") != THING).select(F.col("child").alias("uri")), "uri", "left_anti")
    level = tops.select("uri", F.lit(None).cast("string").alias("parent"), F.array("uri").alias("path"))
    out, depth = level.withColumn("depth", F.lit(0)), 0
    while level.limit(1).count():
        depth += 1
        below = level.join(edges, F.col("uri") == edges["parent"]).filter(~F.array_contains("path", F.col("child")))
        level = below.select(F.col("child").alias("uri"), F.col("uri").alias("parent"), F.array_append("path", F.col("child")).alias("path"))
        level = level.checkpoint() if triples.sparkSession.sparkContext.getCheckpointDir() else level.cache()
        out = out.unionByName(level.withColumn("depth", F.lit(depth)))
    return out.join(every, "uri", "left").select("uri", F.coalesce("label", local_name(F.col("uri"))).alias("label"), "parent", "depth", "path")


def class_tree(triples: DataFrame, root: str | None = None) -> dict:
    """The tree as nested dicts (iri, name, children). A hierarchy is a small dimension: it is put together on the driver."""
    nodes = {tuple(r.path): {"iri": r.uri, "name": r.label, "children": []} for r in tree_paths(triples, root).collect()}
    top: list[dict] = []
    for path in sorted(nodes):
        (nodes[path[:-1]]["children"] if len(path) > 1 else top).append(nodes[path])
    return top[0] if root is not None and top else {"root": "owl:Thing", "children": top}


def disjoint_types(triples: DataFrame) -> DataFrame:
    """(key, apart): a class under its IRI and its local name, with the names of all classes it is disjoint from."""
    pairs = disjoint_inherited(triples).select(F.explode(F.array_distinct(F.array("a", local_name(F.col("a"))))).alias("key"), "b")
    return pairs.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("b", local_name(F.col("b"))))))).alias("apart"))


# ---- disciplines


def disciplines(items: DataFrame, triples: DataFrame, predicates: tuple[str, ...]) -> DataFrame:
    """items(uri) -> (uri, discipline, named): the discipline that facts give an item, as a lower-case name, all of them in
    ``named``; without one, the first that a word in its IRI tells."""
    facts = of(triples, *predicates).filter("o_kind = 'iri'")
    rank = F.coalesce(*(F.when(F.col("p") == p, F.lit(i)) for i, p in enumerate(predicates)))
    name = F.lower(local_name(F.col("o")))
    said = facts.groupBy(F.col("s").alias("uri")).agg(F.min_by(name, F.struct(rank, "o")).alias("first"), F.array_sort(F.collect_set(name)).alias("named"))
    low = F.lower("uri")
    guess = F.coalesce(*(F.when(low.rlike("|".join(words)), F.lit(d)) for d, words in headers.DISCIPLINE_WORDS))
    return items.select("uri").distinct().join(said, "uri", "left").select("uri", F.coalesce("first", guess).alias("discipline"), F.coalesce("named", F.array().cast("array<string>")).alias("named"))


def discipline_compatible(pairs: DataFrame, triples: DataFrame, predicates: tuple[str, ...]) -> DataFrame:
    """pairs(uri, discipline) -> also ``compatible``: an item of no known discipline goes with any."""
    known = disciplines(pairs, triples, predicates).withColumn("expected", F.array_union("named", F.array_compact(F.array("discipline")))).select("uri", "expected")
    return pairs.join(known, "uri").withColumn("compatible", (F.size("expected") == 0) | F.array_contains("expected", F.lower(local_name(F.col("discipline"))))).drop("expected")


# ---- layers and namespaces

# What a schema term may be typed as.
SCHEMA_TYPES = tuple(OWL + x for x in "Class ObjectProperty DatatypeProperty AnnotationProperty FunctionalProperty TransitiveProperty SymmetricProperty AsymmetricProperty IrreflexiveProperty ReflexiveProperty InverseFunctionalProperty Ontology NamedIndividual".split()) + (RDFS + "Class",)
METACLASSES = (OWL + "Class", RDFS + "Class", OWL + "Ontology", OWL + "ObjectProperty", OWL + "DatatypeProperty")


def layer_violations(triples: DataFrame, data: tuple[str, ...], schema: tuple[str, ...]) -> DataFrame:
    """(subject, type, kind): data terms typed as a metaclass, and schema terms typed as anything but a construct of OWL, SHACL,
    SKOS or the schema itself. ``data`` and ``schema`` are namespaces. A filter over the type triples."""
    starts = lambda c, spaces: F.greatest(*(F.col(c).startswith(x).cast("int") for x in spaces), F.lit(0)) == 1
    typed = of(triples, RDF + "type")
    proper = F.col("o").isin(*SCHEMA_TYPES) | F.col("o").startswith(SH) | F.col("o").startswith(SKOS) | starts("o", schema)
    kind = F.when(starts("s", data) & F.col("o").isin(*METACLASSES), "DataAsSchema").when(starts("s", schema) & ~proper, "ImproperSchemaType")
    return typed.select(F.col("s").alias("subject"), F.col("o").alias("type"), kind.alias("kind")).filter("kind is not null").distinct()


def namespace_violations(triples: DataFrame, base: str, segments: tuple[str, ...], predicates: str) -> DataFrame:
    """(term, kind): IRIs under ``base`` outside its ``segments``, and predicates under it outside the segment ``predicates``."""
    iri = F.when(F.col("o_kind") == "iri", F.col("o"))
    terms = triples.select(F.explode(F.array(F.struct(F.col("s").alias("term"), F.lit(False).alias("is_p")), F.struct(F.col("p").alias("term"), F.lit(True).alias("is_p")), F.struct(iri.alias("term"), F.lit(False).alias("is_p")))).alias("t"))
    terms = terms.select("t.*").filter(F.col("term").startswith(base)).distinct()
    inside = F.greatest(*(F.col("term").startswith(f"{base}{x}/").cast("int") for x in segments), F.lit(0)) == 1
    segment = terms.filter(~inside).select("term", F.lit("Segment").alias("kind"))
    misplaced = terms.filter(F.col("is_p") & ~F.col("term").startswith(f"{base}{predicates}/")).select("term", F.lit("Predicate").alias("kind"))
    return segment.unionByName(misplaced).distinct()


# ---- vocabularies

# Predicates that tie concepts to each other and say nothing about a column.
STRUCTURAL = tuple(SKOS + x for x in "broader narrower inScheme topConceptOf hasTopConcept exactMatch".split()) + (RDFS + "subClassOf", OWL + "disjointWith", RDFS + "seeAlso", OWL + "hasValue", OWL + "someValuesFrom", OWL + "allValuesFrom")


def scheme_labels(triples: DataFrame) -> DataFrame:
    """(scheme, label): lower-case preferred and other labels and notations of a scheme's concepts that have a preferred one."""
    concepts = of(triples, RDF + "type").filter(F.col("o") == SKOS + "Concept").select(F.col("s").alias("concept")).distinct()
    placed = of(triples, SKOS + "inScheme").select(F.col("s").alias("concept"), F.col("o").alias("scheme")).join(concepts, "concept", "left_semi")
    named = of(triples, SKOS + "prefLabel").select(F.col("s").alias("concept")).distinct()
    said = of(triples, SKOS + "prefLabel", SKOS + "altLabel", SKOS + "notation").select(F.col("s").alias("concept"), F.lower(F.trim("o")).alias("label"))
    return placed.join(named, "concept", "left_semi").join(said, "concept").filter("label <> ''").select("scheme", "label").distinct()


def scheme_properties(triples: DataFrame, associated: str | None = None) -> DataFrame:
    """(scheme, property, n): the property that most often leads to a scheme's concepts (ties: the last by IRI); one that says so
    by the predicate ``associated`` goes before it, with n null."""
    concepts = of(triples, RDF + "type").filter(F.col("o") == SKOS + "Concept").select(F.col("s").alias("o")).distinct()
    placed = of(triples, SKOS + "inScheme").select(F.col("s").alias("o"), F.col("o").alias("scheme")).join(concepts, "o", "left_semi")
    uses = triples.filter(~F.col("p").isin(*STRUCTURAL) & ~F.col("s").startswith("_:")).select("s", "p", "o").join(placed, "o")
    counts = uses.groupBy("scheme", F.col("p").alias("property")).agg(F.count("*").alias("n"))
    best = counts.groupBy("scheme").agg(F.max(F.struct("n", "property")).alias("b")).select("scheme", "b.property", "b.n")
    if associated is None:
        return best
    said = of(triples, associated).groupBy(F.col("o").alias("scheme")).agg(F.max("s").alias("property")).withColumn("n", F.lit(None).cast("long"))
    return said.unionByName(best.join(said.select("scheme"), "scheme", "left_anti"))


def shape_bounds(triples: DataFrame) -> DataFrame:
    """(property, min_inclusive, max_inclusive, datatype, targets): what node shapes say of a path, a plain or an alternative one."""
    shapes = of(triples, RDF + "type").filter(F.col("o") == SH + "NodeShape").select(F.col("s").alias("shape")).distinct()
    targets = of(triples, SH + "targetClass").select(F.col("s").alias("shape"), F.col("o").alias("target")).join(shapes, "shape", "left_semi")
    parts = of(triples, SH + "property").select(F.col("s").alias("shape"), F.col("o").alias("part")).join(targets, "shape")
    heads = of(triples, SH + "path").select(F.col("s").alias("part"), F.col("o").alias("path"), "o_kind")
    plain = heads.filter("o_kind = 'iri'").select("part", F.col("path").alias("property"))
    direct = of(triples, SH + "alternativePath").filter("o_kind = 'iri'").select(F.col("s").alias("path"), F.col("o").alias("property"))  # a list flattened
    rest = closure(of(triples, RDF + "rest").select(F.col("s").alias("child"), F.col("o").alias("parent")), reflexive=True).select("child", "ancestor")
    lists = of(triples, SH + "alternativePath").select(F.col("s").alias("path"), F.col("o").alias("child"))
    item = of(triples, RDF + "first").filter("o_kind = 'iri'").select(F.col("s").alias("ancestor"), F.col("o").alias("property"))
    listed = lists.join(rest, "child", "left").withColumn("ancestor", F.coalesce("ancestor", "child")).join(item, "ancestor")
    paths = plain.unionByName(heads.join(listed.select("path", "property").unionByName(direct), "path").select("part", "property")).distinct()
    value = lambda p, name: of(triples, SH + p).groupBy(F.col("s").alias("part")).agg(F.max("o").alias(name))
    rows = parts.join(paths, "part").join(value("minInclusive", "lo"), "part", "left").join(value("maxInclusive", "hi"), "part", "left").join(value("datatype", "datatype"), "part", "left")
    whole = lambda c: F.expr(f"try_cast({c} as bigint)")
    return rows.groupBy("property").agg(F.max(whole("lo")).alias("min_inclusive"), F.min(whole("hi")).alias("max_inclusive"), F.max("datatype").alias("datatype"), F.array_sort(F.collect_set("target")).alias("targets"))


def known_ids(triples: DataFrame, predicates: dict[str, str]) -> DataFrame:
    """(kind, id): whole numbers that facts give by the predicate of each kind."""
    kind = F.coalesce(*(F.when(F.col("p") == p, F.lit(k)) for k, p in predicates.items()))
    return of(triples, *predicates.values()).select(kind.alias("kind"), F.expr("try_cast(o as bigint)").alias("id")).filter("id is not null").distinct()


# ---- verification of linked columns


def verified_rows(pairs: DataFrame, triples: DataFrame, left_id: str, link: str, right_id: str) -> DataFrame:
    """pairs(row_id, left, right) -> also ``verified``: something with id ``left`` is linked with something with id ``right``.
    Joins on ids: a row meets the facts of its own ids only."""
    ids = lambda p, uri, name: of(triples, p).select(F.col("s").alias(uri), F.expr("try_cast(o as bigint)").alias(name))
    linked = of(triples, link).select(F.col("s").alias("x"), F.col("o").alias("y")).join(ids(left_id, "x", "left"), "x").join(ids(right_id, "y", "right"), "y")
    return pairs.join(linked.select("left", "right").distinct().withColumn("verified", F.lit(True)), ["left", "right"], "left").withColumn("verified", F.coalesce("verified", F.lit(False)))


def verified_relation(pairs: DataFrame, triples: DataFrame, left_id: str, link: str, right_id: str, rows: int | None = 20) -> DataFrame:
    """(relation, n_verified, n_rows, confidence), if any is verified, over the first ``rows`` rows (the report's sample) or all."""
    first = pairs if rows is None else pairs.orderBy("row_id").limit(rows)
    out = verified_rows(first, triples, left_id, link, right_id).agg(F.count_if("verified").alias("n_verified"), F.count("*").alias("n_rows"))
    return out.filter("n_verified > 0").select(F.lit(link).alias("relation"), "n_verified", "n_rows", (F.col("n_verified") / F.col("n_rows")).alias("confidence"))
