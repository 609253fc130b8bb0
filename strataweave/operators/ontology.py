"""Ontologies as triples: introspection, closure, disjointness and validation by joins. The ontology is the small side."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataweave.functions.normalize import local_name

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
SH = "http://www.w3.org/ns/shacl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
THING = OWL + "Thing"
TRIPLE = "s string, p string, o string, o_kind string, datatype string, lang string"

# The families of XSD ranges.
NUMERIC = tuple(XSD + x for x in "integer int decimal float double nonNegativeInteger positiveInteger nonPositiveInteger negativeInteger long short byte unsignedInt unsignedLong unsignedShort".split())
NUMERIC_WHOLE = tuple("integer int nonNegativeInteger positiveInteger nonPositiveInteger negativeInteger long short byte unsignedInt unsignedLong unsignedShort".split())
TEMPORAL = tuple(XSD + x for x in "dateTime date time gYear gYearMonth".split())
STRINGS = tuple(XSD + x for x in "string normalizedString token language".split())
BOOLEAN = (XSD + "boolean",)


def triples_from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(s, p, o[, o_kind[, datatype[, lang]]]) rows as a set of triples; IRIs unless said otherwise."""
    full = [(r + ("iri", None, None)[len(r) - 3 :]) for r in rows]
    return spark.createDataFrame(full, TRIPLE).dropDuplicates()


def of(triples: DataFrame, *predicates: str) -> DataFrame:
    return triples.filter(F.col("p").isin(*predicates))


def query_triples(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Triples with the given parts; the filters reach the scan."""
    for name, value in (("s", s), ("p", p), ("o", o)):
        if value is not None:
            triples = triples.filter(F.col(name) == value)
    return triples


def _settled(df: DataFrame) -> DataFrame:
    """Cut lineage: a checkpoint in the shared folder, or a cache where none is set."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.cache()


#: Estimated bytes that a task of _dealt gets.
TASK_BYTES = 8 << 20


def _dealt(df: DataFrame, source: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` over tasks whose number grows with the estimated bytes of ``source``, so that what a task holds
    does not; and which are not put together again for being small when compressed."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(least, min(size, 1 << 40) // TASK_BYTES) if size < 1 << 50 else least, *keys)


def closure(edges: DataFrame, reflexive: bool = False, longest: bool = False) -> DataFrame:
    """edges(child, parent) -> (child, ancestor, distance) with the shortest (or longest) distance, at any depth.

    Reach doubles from step to step (paths are joined with paths), so depth d takes log2(d) joins; a step that changes
    nothing is the last. Shortest distances end by themselves on cycles; for longest ones a cycle counts as one class.
    """
    best = F.max if longest else F.min
    step = _settled(edges.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")).filter("child <> ancestor").dropDuplicates(["child", "ancestor"]))
    size = step.agg(F.count("*"), F.sum("distance")).first()
    while True:
        far = step.alias("a").join(step.alias("b"), F.col("a.ancestor") == F.col("b.child")).select(F.col("a.child"), F.col("b.ancestor"), (F.col("a.distance") + F.col("b.distance")).alias("distance"))
        # A class that is its own ancestor tells of a cycle, on which longest distances would grow for ever.
        far = far if longest else far.filter("child <> ancestor")
        step = _settled(step.unionByName(far).groupBy("child", "ancestor").agg(best("distance").alias("distance")))
        *grown, looped = step.agg(F.count("*"), F.sum("distance"), F.count_if(F.col("child") == F.col("ancestor"))).first()
        if looped:
            step = _longest_over_cycles(edges)
            break
        if grown == list(size):
            break
        size = grown
    if reflexive:
        nodes = edges.select("child").union(edges.select("parent")).distinct()
        step = step.unionByName(nodes.select("child", F.col("child").alias("ancestor"), F.lit(0).alias("distance")))
    return step


def _longest_over_cycles(edges: DataFrame) -> DataFrame:
    """Longest distances with classes that reach each other taken as one, at distance 0 from each other."""
    up = closure(edges)
    peers = _settled(up.select("child", "ancestor").join(up.select(F.col("ancestor").alias("child"), F.col("child").alias("ancestor")), ["child", "ancestor"]))
    nodes = edges.select("child").union(edges.select("parent")).distinct()
    one = nodes.join(peers.groupBy("child").agg(F.min("ancestor").alias("peer")), "child", "left")
    one = _settled(one.select(F.col("child").alias("member"), F.least("child", "peer").alias("one")))
    low, high = one.toDF("child", "low"), one.toDF("ancestor", "high")
    met = edges.toDF("child", "ancestor").join(low, "child").join(high, "ancestor").select(F.col("low").alias("child"), F.col("high").alias("parent"))
    far = closure(met, longest=True).toDF("low", "high", "distance")
    return _settled(far.join(low, "low").join(high, "high").select("child", "ancestor", "distance").unionByName(peers.withColumn("distance", F.lit(0))))


def class_edges(triples: DataFrame) -> DataFrame:
    return of(triples, RDFS + "subClassOf", SKOS + "broader").filter("o_kind = 'iri'").select(F.col("s").alias("child"), F.col("o").alias("parent"))


def property_edges(triples: DataFrame) -> DataFrame:
    return of(triples, RDFS + "subPropertyOf").filter("o_kind = 'iri'").select(F.col("s").alias("child"), F.col("o").alias("parent"))


def _label_parts() -> list[Column]:
    """Aggregates of a subject's triples that _labelled makes labels of."""
    get = lambda p: F.min(F.when(F.col("p") == p, F.col("o")))
    many = F.array_sort(F.collect_set(F.when(F.col("p") == SKOS + "altLabel", F.col("o"))))
    return [get(SKOS + "prefLabel").alias("pref_label"), get(RDFS + "label").alias("rdfs_label"), many.alias("alts"), get(RDFS + "comment").alias("comment")]


def _labelled(s: Column) -> tuple[Column, Column]:
    """Label and other labels of ``s`` from _label_parts."""
    name = local_name(s)
    split = F.trim(F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), "[_-]+", " "))
    label = F.coalesce("pref_label", "rdfs_label", split)
    alts = F.array_sort(F.array_except(F.array_union(F.array_union("alts", F.array(name)), F.when(F.col("rdfs_label").isNotNull(), F.array("rdfs_label")).otherwise(F.array().cast("array<string>"))), F.array(label)))
    return label, alts


def labels(triples: DataFrame) -> DataFrame:
    """Per subject: label (preferred, else label, else the split local name), pref_label, alt_labels with the local name, comment."""
    label, alts = _labelled(F.col("s"))
    return triples.groupBy("s").agg(*_label_parts()).select(F.col("s").alias("uri"), label.alias("label"), "pref_label", alts.alias("alt_labels"), "comment")


def disjoint_declared(triples: DataFrame) -> DataFrame:
    """(a, b) both ways: owl:disjointWith, and members of one owl:AllDisjointClasses list."""
    pairs = of(triples, OWL + "disjointWith").select(F.col("s").alias("a"), F.col("o").alias("b"))
    lists = of(triples, OWL + "members").select(F.col("s").alias("list"), F.col("o").alias("a"))
    pairs = pairs.unionByName(lists.join(lists.withColumnRenamed("a", "b"), "list").select("a", "b"))
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()


def disjoint_inherited(triples: DataFrame, classes_closure: DataFrame | None = None) -> DataFrame:
    """(a, b): classes with declared-disjoint ancestors, themselves included."""
    up = closure(class_edges(triples), reflexive=True) if classes_closure is None else classes_closure
    pairs = disjoint_declared(triples)
    alone = pairs.select(F.col("a").alias("child"), F.col("a").alias("ancestor"), F.lit(0).alias("distance"))
    up = up.select("child", "ancestor", "distance").unionByName(alone).select("child", "ancestor").distinct()
    left = pairs.join(up, F.col("a") == F.col("ancestor")).select(F.col("child").alias("x"), "b")
    return left.join(up, F.col("b") == F.col("ancestor")).select(F.col("x").alias("a"), F.col("child").alias("b")).filter("a <> b").distinct()


def disjoint_from(triples: DataFrame, classes_closure: DataFrame | None = None) -> DataFrame:
    """(uri, apart): classes that a class or an ancestor of it is declared disjoint from; as many rows as there are declarations
    above a class, whatever lies below ``apart``."""
    up = closure(class_edges(triples), reflexive=True) if classes_closure is None else classes_closure
    pairs = disjoint_declared(triples)
    up = up.select("child", "ancestor").unionByName(pairs.select(F.col("a").alias("child"), F.col("a").alias("ancestor"))).distinct()
    return up.join(pairs, F.col("ancestor") == F.col("a")).select(F.col("child").alias("uri"), F.col("b").alias("apart")).filter("uri <> apart").distinct()


def classes(triples: DataFrame) -> DataFrame:
    """uri, label, pref_label, alt_labels, comment, super_classes, sub_classes, disjoint_with."""
    typed = of(triples, RDF + "type").filter(F.col("o").isin(OWL + "Class", RDFS + "Class", SKOS + "Concept")).select(F.col("s").alias("uri"))
    edges = class_edges(triples)
    every = typed.union(edges.select("child")).union(edges.select("parent")).distinct().filter(F.col("uri") != THING)
    sup = edges.groupBy(F.col("child").alias("uri")).agg(F.array_sort(F.collect_set("parent")).alias("super_classes"))
    sub = edges.groupBy(F.col("parent").alias("uri")).agg(F.array_sort(F.collect_set("child")).alias("sub_classes"))
    dis = disjoint_declared(triples).groupBy(F.col("a").alias("uri")).agg(F.array_sort(F.collect_set("b")).alias("disjoint_with"))
    out = every.join(_named(triples, every), "uri", "left")
    empty = F.array().cast("array<string>")
    for part, name in ((sup, "super_classes"), (sub, "sub_classes"), (dis, "disjoint_with")):
        out = out.join(part, "uri", "left").withColumn(name, F.coalesce(name, empty))
    return out


def _named(triples: DataFrame, uris: DataFrame) -> DataFrame:
    """Labels of ``uris``, also of those that are never a subject."""
    blank = uris.select(F.col("uri").alias("s"), F.lit("").alias("p"), F.lit("").alias("o"), F.lit("literal").alias("o_kind"), F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang"))
    return labels(triples.join(uris, F.col("s") == F.col("uri"), "left_semi").unionByName(blank))


def properties(triples: DataFrame) -> DataFrame:
    """uri, labels, property_type, domains, ranges, min_inclusive, max_inclusive (tightest shape, else from the comment)."""
    kind = of(triples, RDF + "type").filter(F.col("o").isin(OWL + "ObjectProperty", OWL + "DatatypeProperty", RDF + "Property", OWL + "AnnotationProperty"))
    kind = kind.groupBy(F.col("s").alias("uri")).agg(F.min_by(local_name(F.col("o")), F.when(F.col("o") == OWL + "DatatypeProperty", 0).when(F.col("o") == OWL + "ObjectProperty", 1).otherwise(2)).alias("property_type"))
    ends = of(triples, RDFS + "domain", RDFS + "range")
    every = kind.select("uri").union(ends.select("s")).distinct()
    out = every.join(_named(triples, every), "uri", "left").join(kind, "uri", "left").withColumn("property_type", F.coalesce("property_type", F.lit("Property")))
    for p, name in ((RDFS + "domain", "domains"), (RDFS + "range", "ranges")):
        part = of(triples, p).groupBy(F.col("s").alias("uri")).agg(F.array_sort(F.collect_set("o")).alias(name))
        out = out.join(part, "uri", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    paths = of(triples, SH + "path").select(F.col("s").alias("shape"), F.col("o").alias("uri"))
    limits = of(triples, SH + "minInclusive", SH + "maxInclusive").join(paths, F.col("s") == F.col("shape"))
    limits = limits.groupBy("uri").agg(F.max(F.when(F.col("p") == SH + "minInclusive", F.expr("try_cast(o as double)"))).alias("lo"), F.min(F.when(F.col("p") == SH + "maxInclusive", F.expr("try_cast(o as double)"))).alias("hi"))
    said = r"(?i)(?:[(\[]|range:?\s*|between\s+)\s*(-?[0-9]+(?:\.[0-9]+)?)\s*(?:-|to|and)\s*(-?[0-9]+(?:\.[0-9]+)?)"
    worded = lambda g: F.when(F.col("lo").isNull() & F.col("hi").isNull() & F.col("comment").rlike(said), F.regexp_extract("comment", said, g).cast("double"))
    out = out.join(limits, "uri", "left")
    return out.select("uri", "label", "pref_label", "alt_labels", "comment", "property_type", "domains", "ranges", F.coalesce("lo", worded(1)).alias("min_inclusive"), F.coalesce("hi", worded(2)).alias("max_inclusive"))


def class_depth(triples: DataFrame) -> DataFrame:
    """(uri, depth): longest path up to owl:Thing; a class without parents is at 1."""
    edges = class_edges(triples).filter(F.col("parent") != THING)
    far = closure(edges, longest=True).groupBy(F.col("child").alias("uri")).agg(F.max("distance").alias("distance"))
    every = edges.select(F.col("child").alias("uri")).union(edges.select("parent")).union(classes(triples).select("uri")).distinct()
    return every.join(far, "uri", "left").select("uri", (1 + F.coalesce("distance", F.lit(0))).alias("depth"))


def least_common_subsumer(groups: DataFrame, triples: DataFrame) -> DataFrame:
    """groups(grp, class_uri) -> (grp, lcs): the common ancestor (the class itself included) with most ancestors; ties by IRI."""
    up = closure(class_edges(triples), reflexive=True).select("child", "ancestor")
    n_up = up.groupBy("child").agg(F.count("*").alias("n_ancestors"))
    asked = groups.select("grp", "class_uri").distinct()
    wanted = asked.groupBy("grp").agg(F.count("*").alias("wanted"))
    # A class outside the hierarchy is its own only ancestor.
    met = asked.join(up, F.col("class_uri") == F.col("child"), "left").withColumn("ancestor", F.coalesce("ancestor", "class_uri"))
    common = met.groupBy("grp", "ancestor").agg(F.count_distinct("class_uri").alias("n")).join(wanted, "grp").filter("n = wanted")
    common = common.join(n_up, F.col("ancestor") == F.col("child"), "left").withColumn("n_ancestors", F.coalesce("n_ancestors", F.lit(1)))
    best = Window.partitionBy("grp").orderBy(F.col("n_ancestors").desc(), "ancestor")
    return common.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select("grp", F.col("ancestor").alias("lcs"))


def connecting_paths(triples: DataFrame, ends: DataFrame, max_hops: int = 3, directed: bool = False) -> DataFrame:
    """ends(src, dst) -> (src, dst, hops, nodes, predicates): simple paths of up to ``max_hops`` edges; labels and types are no edges."""
    edges = triples.filter("o_kind = 'iri'").filter(~F.col("p").isin(RDF + "type", RDFS + "label", RDFS + "comment", SKOS + "prefLabel", SKOS + "altLabel"))
    edges = edges.select(F.col("s").alias("x"), F.col("p").alias("via"), F.col("o").alias("y"))
    if not directed:
        edges = edges.unionByName(edges.select(F.col("y").alias("x"), F.concat(F.lit("^"), F.col("via")).alias("via"), F.col("x").alias("y")))
    here = ends.select("src", "dst", F.col("src").alias("at"), F.array("src").alias("nodes"), F.array().cast("array<string>").alias("predicates"))
    found = None
    for hop in range(1, max_hops + 1):
        here = here.join(edges, F.col("at") == F.col("x")).filter(~F.array_contains("nodes", F.col("y")))
        here = here.select("src", "dst", F.col("y").alias("at"), F.array_append("nodes", F.col("y")).alias("nodes"), F.array_append("predicates", F.col("via")).alias("predicates"))
        done = here.filter("at = dst").select("src", "dst", F.lit(hop).alias("hops"), "nodes", "predicates")
        found = done if found is None else found.unionByName(done)
        here = here.filter("at <> dst")
    return found


def chain(triples: DataFrame, start: DataFrame, predicate: str, backwards: bool = False) -> DataFrame:
    """start(uri) -> (uri, step, node): nodes met by following ``predicate`` from it to the end, each once at its first step."""
    edges = of(triples, predicate).select(*(("o", "s") if backwards else ("s", "o"))).toDF("x", "y")
    here = _settled(start.select("uri", F.col("uri").alias("node")).distinct())
    out = here.withColumn("step", F.lit(0))
    for k in count(1):
        there = here.join(edges, F.col("node") == F.col("x")).select("uri", F.col("y").alias("node")).distinct()
        here = _settled(there.join(out.select("uri", "node"), ["uri", "node"], "left_anti"))
        if here.isEmpty():
            return out.select("uri", "node", "step")
        out = out.unionByName(here.withColumn("step", F.lit(k)))


def expected_ends(triples: DataFrame) -> DataFrame:
    """(uri, end, class_uri): domains and ranges, own or, where a property has none, those of its super-properties."""
    own = of(triples, RDFS + "domain", RDFS + "range").select(F.col("s").alias("uri"), local_name(F.col("p")).alias("end"), F.col("o").alias("class_uri"))
    up = closure(property_edges(triples)).select("child", "ancestor")
    lent = own.join(up, F.col("uri") == F.col("ancestor")).select(F.col("child").alias("uri"), "end", "class_uri")
    lent = lent.join(own.select("uri", "end").distinct(), ["uri", "end"], "left_anti")
    return own.unionByName(lent).distinct()


def _outside_vocabulary(kind: Column) -> Column:
    return ~kind.startswith(OWL) & ~kind.startswith(RDFS) & ~kind.startswith(RDF) & ~kind.startswith(SKOS)


def individuals(triples: DataFrame) -> DataFrame:
    """(uri, type): subjects typed by something other than the vocabulary of ontologies."""
    typed = of(triples, RDF + "type").filter(_outside_vocabulary(F.col("o")))
    return typed.select(F.col("s").alias("uri"), F.col("o").alias("type")).distinct()


def instances_of(triples: DataFrame, class_uri: str) -> DataFrame:
    """(uri): individuals of a class or of a class under it."""
    under = closure(class_edges(triples)).filter(F.col("ancestor") == class_uri).select(F.col("child").alias("type"))
    mine = under.union(triples.sparkSession.createDataFrame([(class_uri,)], "type string"))
    return individuals(triples).join(mine, "type", "left_semi").select("uri").distinct()


def _has_form(value: Column, range_: Column) -> Column:
    """Whether a literal has the form of an XSD range; a range of no known family takes anything."""
    whole = range_.isin(*(XSD + x for x in NUMERIC_WHOLE))
    number = F.when(whole, value.rlike("^[+-]?[0-9]+$")).otherwise(value.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"))
    return F.when(range_.isin(*NUMERIC), number).when(range_.isin(*BOOLEAN), F.lower(value).isin("true", "false", "0", "1")).when(range_.isin(*TEMPORAL), value.rlike(r"^-?[0-9]{4}|^[0-9]{2}:[0-9]{2}")).otherwise(F.lit(True))


def violations(statements: DataFrame, triples: DataFrame) -> DataFrame:
    """statements(s, p, o, o_is_literal) -> also violation: the first rule broken, or null.

    In order: UndefinedProperty, ObjectPropertyRequiresURI, DisjointDomain, Domain, DisjointRange, Range, Functional,
    DatatypeMismatch. A literal mismatches if the property's ranges are numbers, truth values or dates and it has none of
    their forms.
    """
    props = properties(triples).select(F.col("uri").alias("p"), "property_type", "domains", "ranges")
    functional = of(triples, RDF + "type").filter(F.col("o") == OWL + "FunctionalProperty").select(F.col("s").alias("p"), F.lit(True).alias("functional"))
    up = closure(class_edges(triples), reflexive=True).select("child", "ancestor")
    kinds = individuals(triples)
    full = kinds.join(up, F.col("type") == F.col("child"), "left").select("uri", F.explode(F.array_distinct(F.array("type", F.coalesce("ancestor", "type")))).alias("type"))
    full = full.groupBy("uri").agg(F.collect_set("type").alias("types"))
    apart = disjoint_inherited(triples).groupBy(F.col("a").alias("cls")).agg(F.collect_set("b").alias("apart"))
    banned = kinds.join(apart, F.col("type") == F.col("cls")).groupBy("uri").agg(F.array_distinct(F.flatten(F.collect_list("apart"))).alias("banned"))
    out = statements.join(F.broadcast(props), "p", "left").join(F.broadcast(functional), "p", "left")
    for end in ("s", "o"):
        side = full.join(banned, "uri", "left").select(F.col("uri").alias(end), F.col("types").alias(f"{end}_types"), F.col("banned").alias(f"{end}_banned"))
        out = out.join(side, end, "left")
    out = out.withColumn("n_values", F.size(F.collect_set("o").over(Window.partitionBy("s", "p"))))
    broken = lambda types, wanted: (F.size(wanted) > 0) & types.isNotNull() & ~F.arrays_overlap(types, wanted)
    clash = lambda ban, wanted: F.coalesce(F.arrays_overlap(ban, wanted), F.lit(False))
    is_object = F.col("property_type") == "ObjectProperty"
    first = (
        F.when(F.col("property_type").isNull(), "UndefinedProperty")
        .when(is_object & F.col("o_is_literal"), "ObjectPropertyRequiresURI")
        .when(clash(F.col("s_banned"), F.col("domains")), "DisjointDomainViolation")
        .when(broken(F.col("s_types"), F.col("domains")), "DomainViolation")
        .when(is_object & clash(F.col("o_banned"), F.col("ranges")), "DisjointRangeViolation")
        .when(is_object & broken(F.col("o_types"), F.col("ranges")), "RangeViolation")
        .when(F.coalesce("functional", F.lit(False)) & (F.col("n_values") > 1), "FunctionalPropertyViolation")
        .when(~is_object & F.col("o_is_literal") & (F.size("ranges") > 0) & ~F.exists("ranges", lambda r: _has_form(F.col("o"), r)), "DatatypeMismatch")
    )
    return out.select("s", "p", "o", "o_is_literal", first.alias("violation"))


def axiom_bonus(sub_ok: Column, sub_disjoint: Column, obj_ok: Column, obj_disjoint: Column) -> Column:
    """0.2 for each side that fits, -0.5 for each that is disjoint."""
    side = lambda ok, apart: F.when(apart, -0.5).when(ok, 0.2).otherwise(0.0)
    return side(sub_ok, sub_disjoint) + side(obj_ok, obj_disjoint)


def validate_shapes(triples: DataFrame, shapes: DataFrame, use_closure: bool = True) -> DataFrame:
    """shapes(shape, target, path array, kind, arg, message) -> (focus, shape, kind, path, message) violations.

    Kinds: minCount, maxCount, datatype, minInclusive, maxInclusive, nodeKind (arg "iri"). A path of several predicates is
    an alternative. Focus nodes are instances of the target, through subclasses if ``use_closure``.
    """
    types = of(triples, RDF + "type").select(F.col("s").alias("focus"), F.col("o").alias("cls"))
    if use_closure:
        up = closure(class_edges(triples)).select(F.col("child").alias("cls"), F.col("ancestor").alias("up"))
        types = types.unionByName(types.join(up, "cls").select("focus", F.col("up").alias("cls")))
    # Shapes are few: rows carry their numbers.
    asked = shapes.select("shape", "target", "path", "kind", "arg", "message").filter(F.size("path") > 0).distinct()
    asked = triples.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(asked.collect())], "id int, shape string, target string, path array<string>, kind string, arg string, message string")
    targets = types.join(F.broadcast(asked.select("id", "target")), F.col("cls") == F.col("target")).select("focus", "id")
    number = F.expr("try_cast(o as double)")
    bad = (
        F.when(F.col("kind") == "datatype", (F.col("o_kind") != "literal") | F.coalesce(F.col("datatype") != F.col("arg"), F.lit(True)))
        .when(F.col("kind") == "minInclusive", F.coalesce(number < F.col("arg").cast("double"), F.lit(True)))
        .when(F.col("kind") == "maxInclusive", F.coalesce(number > F.col("arg").cast("double"), F.lit(True)))
        .when(F.col("kind") == "nodeKind", F.col("o_kind") == "literal")
        .otherwise(F.lit(False))
    )
    counts = F.col("kind").isin("minCount", "maxCount")
    paths = asked.select("id", "kind", "arg", F.explode(F.array_distinct("path")).alias("p"))
    values = triples.filter("s is not null and o is not null").join(F.broadcast(paths), "p").select(F.col("s").alias("focus"), "id", F.when(counts, F.col("o")).alias("o"), F.coalesce(bad, F.lit(False)).alias("bad"), counts.alias("counts"))
    # Focus nodes and values meet in one shuffle by focus; of shapes that count nothing only bad values go out.
    rows = targets.select("focus", "id", F.lit(True).alias("focused"), F.lit(None).cast("string").alias("o"), F.lit(False).alias("bad"))
    rows = rows.unionByName(values.filter("bad or counts").select("focus", "id", F.lit(False).alias("focused"), "o", "bad"))
    seen = _dealt(rows, triples, "focus").groupBy("focus", "id").agg(F.max("focused").alias("focused"), F.count_distinct("o").alias("n"), F.max("bad").alias("bad")).filter("focused").join(F.broadcast(asked), "id")
    broken = F.when(F.col("kind") == "minCount", F.col("n") < F.expr("try_cast(arg as int)")).when(F.col("kind") == "maxCount", F.col("n") > F.expr("try_cast(arg as int)")).otherwise(F.col("bad"))
    return seen.filter(broken).select("focus", "shape", "kind", F.array_join("path", "|").alias("path"), "message")


def typed_literal(o: Column) -> Column:
    """Datatype an exported literal gets: integer, double, boolean or string."""
    return F.when(o.rlike("^[+-]?[0-9]+$"), XSD + "integer").when(o.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?[0-9]+[eE][+-]?[0-9]+$"), XSD + "double").when(F.lower(o).isin("true", "false"), XSD + "boolean").otherwise(XSD + "string")


def extension_proposals(mentions: DataFrame, known: DataFrame, namespace: str) -> DataFrame:
    """mentions(mention) without a known(label) of the same normalised spelling -> mention, proposed IRI."""
    norm = lambda c: F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_")
    new = mentions.select("mention").distinct().join(known.select(norm(F.col("label")).alias("k")).distinct(), norm(F.col("mention")) == F.col("k"), "left_anti")
    return new.select("mention", F.concat(F.lit(namespace), F.regexp_replace(norm(F.col("mention")), "^_+|_+$", "")).alias("proposed_iri"))


def restrictions(triples: DataFrame) -> DataFrame:
    """(class_uri, property, kind, value): OWL restrictions a class stands under, cardinalities included."""
    node = of(triples, OWL + "onProperty").select(F.col("s").alias("node"), F.col("o").alias("property"))
    kinds = [OWL + k for k in ("someValuesFrom", "allValuesFrom", "hasValue", "cardinality", "minCardinality", "maxCardinality", "qualifiedCardinality", "minQualifiedCardinality", "maxQualifiedCardinality")]
    said = of(triples, *kinds).select(F.col("s").alias("node"), local_name(F.col("p")).alias("kind"), F.col("o").alias("value"))
    under = of(triples, RDFS + "subClassOf", OWL + "equivalentClass").select(F.col("s").alias("class_uri"), F.col("o").alias("node"))
    return under.join(node, "node").join(said, "node").select("class_uri", "property", "kind", "value")


def cardinality_violations(facts: DataFrame, limits: DataFrame) -> DataFrame:
    """facts(s, p, o) and limits(p, least, most, null where open) -> (s, p, n): subjects with too few or too many distinct values."""
    # Only facts with a limit are shuffled, once, by subject; counts before that would hold whole files.
    asked = facts.select("s", "p", "o").join(F.broadcast(limits.select("p")), "p", "left_semi")
    counted = _dealt(asked, facts, "s").groupBy("s", "p").agg(F.count_distinct("o").alias("n"))
    over = (F.col("n") > F.col("most")) | (F.col("n") < F.col("least"))
    return counted.join(F.broadcast(limits), "p").filter(over).select("s", "p", "n")


def entity_catalog(triples: DataFrame, groups: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row per typed individual: type, label, alt_labels, and a column per group holding the value of the group's first
    predicate that has one. ``groups`` maps a column to its predicates by priority."""
    pick = []
    for name, predicates in groups.items():
        rank = F.coalesce(*(F.when(F.col("p") == p, F.lit(i)) for i, p in enumerate(predicates)))
        pick.append(F.min_by(F.when(rank.isNotNull(), F.col("o")), F.when(rank.isNotNull(), F.struct(rank, F.col("o")))).alias(name))
    # One shuffle by subject of the predicates that count; aggregates of strings would sort whole files before it.
    facts = of(triples, RDF + "type", RDFS + "label", SKOS + "prefLabel", SKOS + "altLabel", *(p for ps in groups.values() for p in ps)).select("s", "p", "o")
    facts = _dealt(facts, triples, "s")
    kind = F.min(F.when((F.col("p") == RDF + "type") & _outside_vocabulary(F.col("o")), F.col("o")))
    wide = facts.groupBy("s").agg(kind.alias("type"), *pick, *_label_parts()).filter("s is not null and type is not null")
    label, alts = _labelled(F.col("s"))
    return wide.select(F.col("s").alias("uri"), *groups, "type", label.alias("label"), alts.alias("alt_labels"))


def find_by_label(triples: DataFrame, text: str, exact: bool = True, case_sensitive: bool = False) -> DataFrame:
    """(uri, label): individuals with a label equal to, or holding, ``text``."""
    said = of(triples, RDFS + "label", SKOS + "prefLabel", SKOS + "altLabel").select(F.col("s").alias("uri"), F.col("o").alias("label"))
    a, b = (F.col("label"), F.lit(text)) if case_sensitive else (F.lower("label"), F.lit(text.lower()))
    return said.filter(a == b if exact else a.contains(b)).join(individuals(triples).select("uri").distinct(), "uri", "left_semi").distinct()


def predicate_signatures(triples: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """(key, uri, domains, ranges): a property under its IRI, its local name and, with prefixes(prefix -> namespace), its short form."""
    props = properties(triples).select("uri", "domains", "ranges")
    keys = [F.col("uri"), local_name(F.col("uri"))]
    keys += [F.when(F.col("uri").startswith(ns), F.concat(F.lit(p + ":"), F.substring("uri", F.lit(len(ns) + 1), F.length("uri")))) for p, ns in (prefixes or {}).items()]
    return props.select(F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias("key"), "uri", "domains", "ranges")


def compatible_properties(triples: DataFrame, subject_type: str, object_type: str) -> DataFrame:
    """(uri): properties whose expected domain and range, where they have one, hold the two types or an ancestor of them."""
    up = closure(class_edges(triples)).select("child", "ancestor")
    above = lambda t: [t, *(r.ancestor for r in up.filter(F.col("child") == t).collect())]  # noqa: E731  ancestors of one class
    ends = expected_ends(triples).groupBy("uri").agg(F.collect_set(F.when(F.col("end") == "domain", F.col("class_uri"))).alias("d"), F.collect_set(F.when(F.col("end") == "range", F.col("class_uri"))).alias("r"))
    fits = lambda c, t: (F.size(c) == 0) | F.arrays_overlap(F.col(c) if isinstance(c, str) else c, F.array(*(F.lit(x) for x in above(t))))
    named = properties(triples).select("uri").join(ends, "uri", "left")
    empty = F.array().cast("array<string>")
    named = named.withColumns({"d": F.coalesce("d", empty), "r": F.coalesce("r", empty)})
    return named.filter(fits(F.col("d"), subject_type) & fits(F.col("r"), object_type)).select("uri")
