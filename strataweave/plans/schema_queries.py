"""Registered queries of ontologies: membership, trees, registration, layers, vocabularies, verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.operators import ontology as O
from strataweave.operators import schema as C
from strataweave.plans.registry import query, table
from strataweave.rules import headers as H


def _row(d: DataFrame, s, p: str, o, kind: str = "iri", datatype: str | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return d.select(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit(datatype).cast("string").alias("datatype"), none.alias("lang"))


def _iri(kind: str, c: str):
    return F.concat(F.lit(f"urn:{kind}:"), F.col(c).cast("string"))


def _union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _places(spark, sf_dir) -> DataFrame:
    """Nations under regions under the world as classes, customers and suppliers as individuals of their nation."""
    nation, region, customer, supplier = (table(spark, sf_dir, n) for n in ("nation", "region", "customer", "supplier"))
    return _union(
        _row(nation, _iri("nation", "n_nationkey"), O.RDFS + "subClassOf", _iri("region", "n_regionkey")), _row(region, _iri("region", "r_regionkey"), O.RDFS + "subClassOf", F.lit("urn:world")),
        _row(region.filter("r_regionkey = 0"), _iri("region", "r_regionkey"), O.OWL + "equivalentClass", F.lit("urn:first")), _row(nation, _iri("nation", "n_nationkey"), O.RDFS + "label", F.col("n_name"), "literal"),
        _row(customer, _iri("customer", "c_custkey"), O.RDF + "type", _iri("nation", "c_nationkey")), _row(supplier, _iri("supplier", "s_suppkey"), O.RDF + "type", _iri("nation", "s_nationkey")),
    )


_CUSTOMERS = "c as (select c_custkey as k, n_nationkey as n, n_regionkey as r from customer join nation on c_nationkey = n_nationkey)"


@query("is_instance_of", f"with {_CUSTOMERS}, asked as (select k, n, r, a from c, (values ('urn:region:1'), ('urn:first'), ('urn:world'), ('urn:nation:3'), ('{O.THING}')) t(a)) select 'urn:customer:' || k as uri, a as class_uri, a in ('urn:nation:' || n, 'urn:region:' || r, 'urn:world', '{O.THING}') or (a = 'urn:first' and r = 0) as holds from asked")
def is_instance_of(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").select(_iri("customer", "c_custkey").alias("uri"), F.explode(F.array(*(F.lit(x) for x in ("urn:region:1", "urn:first", "urn:world", "urn:nation:3", O.THING)))).alias("class_uri"))
    return C.is_instance_of(asked, _places(spark, sf_dir))


@query(
    "class_tree",
    """select 'urn:nation:' || n_nationkey as uri, n_name as label, 'urn:region:' || n_regionkey as parent, 2 as depth, 'urn:world>urn:region:' || n_regionkey || '>urn:nation:' || n_nationkey as path from nation
union all select 'urn:region:' || r_regionkey, r_regionkey::varchar, 'urn:world', 1, 'urn:world>urn:region:' || r_regionkey from region union all select 'urn:world', 'world', null, 0, 'urn:world'""",
)
def class_tree(spark, sf_dir):
    out = C.tree_paths(_places(spark, sf_dir).filter(F.col("p") != O.OWL + "equivalentClass"), "urn:world")
    return out.select("uri", F.element_at(F.split("label", ":"), -1).alias("label"), "parent", "depth", F.array_join("path", ">").alias("path"))


@query("has_triples", "select 'urn:order:' || o_orderkey as s, 'urn:by' as p, 'urn:customer:' || (o_custkey + o_orderkey % 2) as o, o_orderkey % 2 = 0 or o_orderkey = 1 as present from orders")
def has_triples(spark, sf_dir):
    """Every second order asked about the wrong customer; one of those facts is registered on the way."""
    orders = table(spark, sf_dir, "orders")
    facts = _row(orders, _iri("order", "o_orderkey"), "urn:by", _iri("customer", "o_custkey"))
    asked = orders.select(_iri("order", "o_orderkey").alias("s"), F.lit("urn:by").alias("p"), F.concat(F.lit("urn:customer:"), F.col("o_custkey") + F.col("o_orderkey") % 2).alias("o"))
    said = asked.filter("s = 'urn:order:1'").first()
    return C.has_triples(asked, C.register_triple(facts, said.s, said.p, said.o))


@query(
    "registered_terms",
    """select uri, kind, label from (values ('urn:new:Class', 'Class', 'A class'), ('urn:new:prop', 'ObjectProperty', 'prop'), ('urn:new:size', 'DatatypeProperty', 'The size')) t(uri, kind, label)""",
)
def registered_terms(spark, sf_dir):
    out = _places(spark, sf_dir)
    out = C.register_class(out, "urn:new:Class", "urn:world", "A class", "said")
    out = C.register_property(out, "urn:new:prop", "urn:new:Class", "urn:world")
    out = C.register_property(out, "urn:new:size", "urn:new:Class", O.XSD + "int", True, "The size")
    kinds = out.filter((F.col("p") == O.RDF + "type") & F.col("s").startswith("urn:new:")).select(F.col("s").alias("uri"), F.element_at(F.split("o", "#"), -1).alias("kind"))
    return kinds.join(O.labels(out).select("uri", "label"), "uri").withColumn("label", F.element_at(F.split("label", ":"), -1))


_WORDS = "case " + " ".join(f"when regexp_matches(lower(uri), '{'|'.join(w)}') then '{d}'" for d, w in H.DISCIPLINE_WORDS) + " end"


@query(
    "disciplines",
    f"""with d as (select 'urn:part:' || replace(p_name, ' ', '_') || '_' || p_partkey as uri, case when p_size % 4 = 0 then 'chef' end as said, case when p_size % 8 = 0 then 'tailor' end as more from part)
select uri, coalesce(said, {_WORDS}) as discipline, list_sort(list_filter([said, more], lambda x: x is not null))::varchar as named from d""",
)
def disciplines(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("uri", F.concat(F.lit("urn:part:"), F.regexp_replace("p_name", " ", "_"), F.lit("_"), "p_partkey"))
    facts = _union(_row(part.filter("p_size % 4 = 0"), F.col("uri"), "urn:by", F.lit("urn:d/Chef")), _row(part.filter("p_size % 8 = 0"), F.col("uri"), "urn:also", F.lit("urn:d/Tailor")))
    out = C.disciplines(part.select("uri"), facts, ("urn:by", "urn:also"))
    return out.withColumn("named", F.concat(F.lit("["), F.array_join("named", ", "), F.lit("]")))


@query("discipline_compatible", "select 'urn:thing:' || p_partkey as uri, 'urn:d/' || d as discipline, case when p_size % 4 = 0 then d = 'Chef' else true end as compatible from part, (values ('Chef'), ('Tailor')) t(d)")
def discipline_compatible(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("uri", _iri("thing", "p_partkey"))
    pairs = part.select("uri", F.explode(F.array(F.lit("urn:d/Chef"), F.lit("urn:d/Tailor"))).alias("discipline"))
    return C.discipline_compatible(pairs, _row(part.filter("p_size % 4 = 0"), F.col("uri"), "urn:by", F.lit("urn:d/Chef")), ("urn:by",))


@query(
    "layer_violations",
    f"""select 'urn:data/customer/' || c_custkey as subject, '{O.OWL}Class' as type, 'DataAsSchema' as kind from customer where c_custkey % 3 = 0
union all select 'urn:def/' || p_partkey, 'urn:other/Part', 'ImproperSchemaType' from part where p_size % 2 = 0""",
)
def layer_violations(spark, sf_dir):
    customer, part = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    c, p = F.concat(F.lit("urn:data/customer/"), "c_custkey"), F.concat(F.lit("urn:def/"), "p_partkey")
    triples = _union(
        _row(customer, c, O.RDF + "type", F.when(F.col("c_custkey") % 3 == 0, O.OWL + "Class").otherwise("urn:def/Customer")),
        _row(part, p, O.RDF + "type", F.when(F.col("p_size") % 2 == 0, "urn:other/Part").otherwise(F.lit(O.OWL + "Class"))), _row(part, p, O.RDF + "type", F.lit(O.SKOS + "Concept")),
    )
    return C.layer_violations(triples, ("urn:data/",), ("urn:def/",))


@query("namespace_violations", "select distinct 'urn:x/odd/' || c_nationkey as term, 'Segment' as kind from customer union all select 'urn:x/id/says', 'Predicate'")
def namespace_violations(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    triples = _union(
        _row(customer, F.concat(F.lit("urn:x/id/"), "c_custkey"), "urn:x/def/in", F.concat(F.lit("urn:x/odd/"), "c_nationkey")),
        _row(customer, F.concat(F.lit("urn:x/id/"), "c_custkey"), "urn:x/id/says", F.concat(F.lit("urn:x/odd/text"), "c_name"), "literal"),
    )
    return C.namespace_violations(triples, "urn:x/", ("def", "ref", "id"), "def")


def _concepts(spark, sf_dir) -> DataFrame:
    """Part types and brands as concepts of two schemes, which parts lead to by several properties."""
    part = table(spark, sf_dir, "part")
    kinds, brands = part.select("p_type").distinct(), part.select("p_brand").distinct()
    t, b, p = _iri("t", "p_type"), _iri("b", "p_brand"), _iri("p", "p_partkey")
    concept = lambda d, c, label, scheme: _union(_row(d, c, O.RDF + "type", F.lit(O.SKOS + "Concept")), _row(d, c, O.SKOS + "inScheme", F.lit(scheme)), _row(d, c, O.SKOS + "prefLabel", F.concat(F.lit(" "), F.col(label)), "literal"))
    return _union(
        concept(kinds, t, "p_type", "urn:types"), concept(brands, b, "p_brand", "urn:brands"), _row(kinds, t, O.SKOS + "altLabel", F.reverse("p_type"), "literal"), _row(kinds, t, O.SKOS + "broader", F.lit("urn:t:ALL")),
        _row(part, p, "urn:hasType", t), _row(part.filter("p_size % 2 = 0"), p, "urn:looksLike", t), _row(part.filter("p_size % 3 = 0"), p, "urn:hasBrand", b), _row(part.filter("p_size % 5 = 0"), p, "urn:soldAs", b),
    )


@query("scheme_labels", "select distinct 'urn:types' as scheme, lower(p_type) as label from part union select 'urn:types', lower(reverse(p_type)) from part union select 'urn:brands', lower(p_brand) from part")
def scheme_labels(spark, sf_dir):
    return C.scheme_labels(_concepts(spark, sf_dir))


@query("scheme_properties", "select 'urn:types' as scheme, 'urn:hasType' as property, count(*) as n from part union all select * from (select 'urn:brands', p, n from (select 'urn:hasBrand' as p, count(*) as n from part where p_size % 3 = 0 union all select 'urn:soldAs', count(*) from part where p_size % 5 = 0) order by n desc, p desc limit 1)")
def scheme_properties(spark, sf_dir):
    return C.scheme_properties(_concepts(spark, sf_dir))


@query("scheme_properties_declared", "select 'urn:types' as scheme, 'urn:said' as property, null::bigint as n union all select * from (select 'urn:brands', p, n from (select 'urn:hasBrand' as p, count(*) as n from part where p_size % 3 = 0 union all select 'urn:soldAs', count(*) from part where p_size % 5 = 0) order by n desc, p desc limit 1)")
def scheme_properties_declared(spark, sf_dir):
    said = O.triples_from_rows(spark, [("urn:said", "urn:associated", "urn:types")])
    return C.scheme_properties(_concepts(spark, sf_dir).unionByName(said), "urn:associated")


@query("known_ids", "select 'order' as kind, o_orderkey as id from orders union select 'customer', o_custkey from orders where o_custkey % 2 = 0")
def known_ids(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    o = _iri("order", "o_orderkey")
    triples = _union(_row(orders, o, "urn:id", F.col("o_orderkey"), "literal"), _row(orders, o, "urn:customerId", F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise("none"), "literal"))
    return C.known_ids(triples, {"order": "urn:id", "customer": "urn:customerId"})


@query("shape_bounds", "select 'urn:' || lower(p_type) as property, min(p_size)::bigint as min_inclusive, max(p_size)::bigint as max_inclusive, 'urn:int' as datatype, 'urn:A|urn:B' as targets from part group by p_type")
def shape_bounds(spark, sf_dir):
    """A node shape with two targets and a property part per part type; every other path is an alternative."""
    kinds = table(spark, sf_dir, "part").groupBy("p_type").agg(F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))
    p, prop = _iri("shape", "p_type"), F.concat(F.lit("urn:"), F.lower("p_type"))
    plain = F.length("p_type") % 2 == 0
    node = F.concat(F.lit("_:"), "p_type")
    fixed = O.triples_from_rows(spark, [("urn:Shape", O.RDF + "type", O.SH + "NodeShape"), ("urn:Shape", O.SH + "targetClass", "urn:A"), ("urn:Shape", O.SH + "targetClass", "urn:B")])
    triples = _union(
        fixed, _row(kinds, F.lit("urn:Shape"), O.SH + "property", p), _row(kinds.filter(plain), p, O.SH + "path", prop), _row(kinds.filter(~plain), p, O.SH + "path", node, "bnode"), _row(kinds.filter(~plain), node, O.SH + "alternativePath", prop),
        _row(kinds, p, O.SH + "minInclusive", F.col("lo"), "literal"), _row(kinds, p, O.SH + "maxInclusive", F.col("hi"), "literal"), _row(kinds, p, O.SH + "datatype", F.lit("urn:int")),
    )
    return C.shape_bounds(triples).withColumn("targets", F.array_join("targets", "|"))


@query("verified_rows", "select o_orderkey as row_id, o_orderkey as left, o_custkey as right, o_orderkey % 3 > 0 as verified from orders")
def verified_rows(spark, sf_dir):
    return C.verified_rows(_pairs(spark, sf_dir), _sales(spark, sf_dir), "urn:orderId", "urn:by", "urn:customerId")


def _pairs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderkey").alias("left"), F.col("o_custkey").alias("right"))


def _sales(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    o, c = _iri("order", "o_orderkey"), _iri("customer", "o_custkey")
    return _union(_row(orders, o, "urn:orderId", F.col("o_orderkey"), "literal"), _row(orders, c, "urn:customerId", F.col("o_custkey"), "literal"), _row(orders.filter("o_orderkey % 3 > 0"), o, "urn:by", c))


@query("verified_relation", "select 'urn:by' as relation, count(*) filter (o_orderkey % 3 > 0) as n_verified, count(*) as n_rows, round(avg((o_orderkey % 3 > 0)::int), 9) as confidence from orders")
def verified_relation(spark, sf_dir):
    return C.verified_relation(_pairs(spark, sf_dir), _sales(spark, sf_dir), "urn:orderId", "urn:by", "urn:customerId", None).withColumn("confidence", F.round("confidence", 9))


@query(
    "disjoint_types",
    """with x as (select 'nation' || n_nationkey as c, n_regionkey as r from nation union all select 'region' || r_regionkey, r_regionkey from region), k as (select 'urn:x/' || c as key, r from x union all select c, r from x)
select key, (select count(*) * 2 from x where x.r <> k.r) as n_apart from k""",
)
def disjoint_types(spark, sf_dir):
    region = table(spark, sf_dir, "region")
    pair = region.select(F.col("r_regionkey").alias("x")).join(F.broadcast(region.select(F.col("r_regionkey").alias("y"))), F.col("x") < F.col("y"))
    at = lambda kind, c: F.concat(F.lit(f"urn:x/{kind}"), F.col(c).cast("string"))
    triples = _union(_row(table(spark, sf_dir, "nation"), at("nation", "n_nationkey"), O.RDFS + "subClassOf", at("region", "n_regionkey")), _row(pair, at("region", "x"), O.OWL + "disjointWith", at("region", "y")))
    return C.disjoint_types(triples).select("key", F.size("apart").cast("long").alias("n_apart"))


@query(
    "statement_violations",
    f"""select 'urn:order:' || o_orderkey as s, p, case k when 1 then 'urn:customer:' || o_custkey when 2 then 'urn:order:' || o_orderkey when 3 then 'urn:customer:' || o_custkey else o_orderstatus end as o, k = 4 or k = 5 as o_is_literal,
case k when 2 then 'DisjointRangeViolation' when 3 then 'UndefinedProperty' when 4 then 'ObjectPropertyRequiresURI' when 5 then 'DatatypeMismatch' end as violation
from orders, (values (1, 'urn:placedBy'), (2, 'urn:placedBy2'), (3, 'urn:nothing'), (4, 'urn:placedBy3'), (5, 'urn:size')) t(k, p)""",
)
def statement_violations(spark, sf_dir):
    """Every order said to be placed by a customer, by itself, by text; with a property nobody knows, and with a text for a number."""
    orders = table(spark, sf_dir, "orders")
    o, c = _iri("order", "o_orderkey"), _iri("customer", "o_custkey")
    rows: list[tuple] = [("urn:Order", O.RDF + "type", O.OWL + "Class"), ("urn:Customer", O.RDF + "type", O.OWL + "Class"), ("urn:Order", O.OWL + "disjointWith", "urn:Customer"), ("urn:size", O.RDF + "type", O.OWL + "DatatypeProperty"), ("urn:size", O.RDFS + "range", O.XSD + "integer")]
    for p in ("urn:placedBy", "urn:placedBy2", "urn:placedBy3"):
        rows += [(p, O.RDF + "type", O.OWL + "ObjectProperty"), (p, O.RDFS + "domain", "urn:Order"), (p, O.RDFS + "range", "urn:Customer")]
    triples = _union(O.triples_from_rows(spark, rows), _row(orders, o, O.RDF + "type", F.lit("urn:Order")), _row(orders, c, O.RDF + "type", F.lit("urn:Customer")).distinct())
    say = lambda p, obj, literal: orders.select(o.alias("s"), F.lit(p).alias("p"), obj.alias("o"), F.lit(literal).alias("o_is_literal"))
    said = _union(say("urn:placedBy", c, False), say("urn:placedBy2", o, False), say("urn:nothing", c, False), say("urn:placedBy3", F.col("o_orderstatus"), True), say("urn:size", F.col("o_orderstatus"), True))
    return O.violations(said, triples)
