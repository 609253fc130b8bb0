"""Registered queries of functions and operators that had none: normalisers, IRIs, introspection, closures, exports, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataweave.functions import cells as C
from strataweave.functions import normalize as N
from strataweave.functions import similarity as S
from strataweave.operators import emit as E
from strataweave.operators import fusion as U
from strataweave.operators import ontology as O
from strataweave.operators import profile as A
from strataweave.operators import text as T
from strataweave.plans.registry import query, table
from strataweave.plans.schema_queries import _iri, _places, _row, _union
from strataweave.sources import rdf

_PREFIXES = {"p": "urn:part/", "px": "urn:part/x", "c": "urn:c#"}


@query("numeric_summary", "select 'p_brand' as column_name, null::double as min_value, null::double as max_value union all select 'sized', min(p_size)::double, max(p_size)::double from part union all select 'p_retailprice', min(p_retailprice), max(p_retailprice) from part")
def numeric_summary(spark, sf_dir):
    return A.numeric_summary(table(spark, sf_dir, "part").select("p_brand", F.concat("p_size", F.lit(" cm wide")).alias("sized"), "p_retailprice"))


@query("leet_mesh", r"""select p_partkey, trim(regexp_replace(replace(replace(replace(translate(regexp_replace(replace(replace(translate(lower(trim(t)), '@0345', 'aoeas'), 's1ot', 'slot'), 'siot', 'slot'), '[#$%^&*_+=\[\]{};:<>?/\\|~]', ' ', 'g'), '1', 'i'), 'qu', chr(1)), 'q', 'g'), chr(1), 'qu'), '\s+', ' ', 'g')) as name
from (select p_partkey, p_brand || ' @s1ot 3q' || p_name || ' Quick' as t from part)""")
def leet_mesh(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", N.normalize_leet_mesh(F.concat("p_brand", F.lit(" @s1ot 3q"), "p_name", F.lit(" Quick"))).alias("name"))


@query("curies", """select p_partkey, case when p_size % 3 = 0 then 'px:' || p_partkey when p_size % 3 = 1 then 'p:' || p_partkey else 'urn:other/' || p_partkey end as curie,
case when p_size % 3 = 0 then 'urn:part/x' when p_size % 3 = 1 then 'urn:part/' else 'urn:other/' end || p_partkey as iri, 'urn:base/' || p_type as based, regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g') || '_s' as slug from part""")
def curies(spark, sf_dir):
    """Short forms, their way back, terms under a base, and slugs."""
    kind = F.when(F.col("p_size") % 3 == 0, "urn:part/x").when(F.col("p_size") % 3 == 1, "urn:part/").otherwise("urn:other/")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name", N.to_curie(F.concat(kind, "p_partkey"), _PREFIXES).alias("curie"))
    return rows.select("p_partkey", "curie", N.to_iri(F.col("curie"), _PREFIXES, "urn:base/").alias("iri"), N.to_iri(F.concat(F.lit("<"), "p_type", F.lit(">")), _PREFIXES, "urn:base/").alias("based"), N.clean_id(F.concat(F.lit(" "), "p_name", F.lit(" ’s! "))).alias("slug"))


@query("chat_links", "select p_partkey, p_partkey as id from part")
def chat_links(spark, sf_dir):
    """Codes made of ids, and the ids read back from them."""
    little = F.concat(*(F.lpad(F.hex(F.shiftright("p_partkey", 8 * k).bitwiseAND(255)), 2, "0") for k in range(4)))
    code = F.concat(F.lit("[&"), F.base64(F.unhex(F.concat(F.lit("0201"), little))), F.lit("]"))
    return table(spark, sf_dir, "part").select("p_partkey", C.chat_link_id(code).alias("id"))


@query("vector_cosine", "select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as sim from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def vector_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("other")), 6).alias("sim"))


@query("ontology_classes", """with e as (select 'urn:nation:' || n_nationkey as c, 'urn:region:' || n_regionkey as p, n_name as l from nation union all select 'urn:region:' || r_regionkey, 'urn:world', null from region)
select c as uri, coalesce(any_value(l), c) as label, string_agg(p, '|' order by p) as super_classes, (select count(*) from e x where x.p = e.c)::bigint as n_sub from e group by c union all select 'urn:world', 'urn:world', '', (select count(*) from region)""")
def ontology_classes(spark, sf_dir):
    out = O.classes(_places(spark, sf_dir).filter(~F.col("p").isin(O.OWL + "equivalentClass", O.RDF + "type")))
    return out.select("uri", "label", F.array_join("super_classes", "|").alias("super_classes"), F.size("sub_classes").cast("long").alias("n_sub"))


def _properties(spark, sf_dir):
    """A property per part, under the one of its type, with a domain for every second and a shape for every third."""
    part = table(spark, sf_dir, "part")
    p, t = _iri("p", "p_partkey"), _iri("t", "p_type")
    shape = F.concat(F.lit("_:s"), "p_partkey")
    return _union(
        _row(part, p, O.RDF + "type", F.when(F.col("p_size") % 2 == 0, O.OWL + "ObjectProperty").otherwise(O.OWL + "DatatypeProperty")), _row(part, p, O.RDFS + "subPropertyOf", t), _row(part.select("p_type").distinct(), t, O.RDFS + "subPropertyOf", F.lit("urn:top")),
        _row(part.filter("p_partkey % 2 = 0"), p, O.RDFS + "domain", F.lit("urn:Part")), _row(part.select("p_type").distinct(), t, O.RDFS + "domain", _iri("D", "p_type")), _row(part, p, O.RDFS + "label", F.col("p_name"), "literal"),
        _row(part.filter("p_partkey % 3 = 0"), shape, O.SH + "path", p), _row(part.filter("p_partkey % 3 = 0"), shape, O.SH + "minInclusive", F.col("p_size"), "literal"), _row(part.filter("p_partkey % 3 = 1"), p, O.RDFS + "comment", F.concat(F.lit("between 1 and "), "p_size"), "literal"),
    )


@query("ontology_properties", """select 'urn:p:' || p_partkey as uri, p_name as label, case when p_size % 2 = 0 then 'ObjectProperty' else 'DatatypeProperty' end as property_type, case when p_partkey % 2 = 0 then 'urn:Part' else '' end as domains,
case when p_partkey % 3 = 0 then p_size::double when p_partkey % 3 = 1 then 1.0 end as min_inclusive, case when p_partkey % 3 = 1 then p_size::double end as max_inclusive from part""")
def ontology_properties(spark, sf_dir):
    out = O.properties(_properties(spark, sf_dir)).filter("uri like 'urn:p:%'")
    return out.select("uri", "label", "property_type", F.array_join("domains", "|").alias("domains"), "min_inclusive", "max_inclusive")


@query("property_closure", "select 'urn:p:' || p_partkey as child, 'urn:t:' || p_type as ancestor, 1 as distance from part union all select 'urn:p:' || p_partkey, 'urn:top', 2 from part union all select distinct 'urn:t:' || p_type, 'urn:top', 1 from part")
def property_closure(spark, sf_dir):
    return O.closure(O.property_edges(_properties(spark, sf_dir)))


@query("expected_ends", "select 'urn:p:' || p_partkey as uri, 'domain' as end, case when p_partkey % 2 = 0 then 'urn:Part' else 'urn:D:' || p_type end as class_uri from part union all select distinct 'urn:t:' || p_type, 'domain', 'urn:D:' || p_type from part")
def expected_ends(spark, sf_dir):
    return O.expected_ends(_properties(spark, sf_dir))


@query("compatible_properties", "select 'urn:p:' || p_partkey as uri from part where p_partkey % 2 = 0")
def compatible_properties(spark, sf_dir):
    return O.compatible_properties(_properties(spark, sf_dir), "urn:Part", "urn:Any").filter("uri like 'urn:p:%'")


@query("predicate_signatures", "select 'urn:p:' || p_partkey as key, 'urn:p:' || p_partkey as uri from part union all select 'x:' || p_partkey, 'urn:p:' || p_partkey from part")
def predicate_signatures(spark, sf_dir):
    return O.predicate_signatures(_properties(spark, sf_dir), {"x": "urn:p:"}).filter("uri like 'urn:p:%'").select("key", "uri")


@query("instances_of", "select 'urn:customer:' || c_custkey as uri from customer join nation on c_nationkey = n_nationkey where n_regionkey = 1 union select 'urn:supplier:' || s_suppkey from supplier join nation on s_nationkey = n_nationkey where n_regionkey = 1")
def instances_of(spark, sf_dir):
    return O.instances_of(_places(spark, sf_dir), "urn:region:1")


@query("query_triples", "select 'urn:customer:' || c_custkey as s from customer where c_nationkey = 3 union all select 'urn:supplier:' || s_suppkey from supplier where s_nationkey = 3")
def query_triples(spark, sf_dir):
    return O.query_triples(_places(spark, sf_dir), p=O.RDF + "type", o="urn:nation:3").select("s")


@query("find_by_label", "select 'urn:c:' || c_custkey as uri, c_mktsegment as label from customer where c_mktsegment like '%IL%'")
def find_by_label(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    triples = _union(_row(c, _iri("c", "c_custkey"), O.RDF + "type", F.lit("urn:Customer")), _row(c, _iri("c", "c_custkey"), O.RDFS + "label", F.col("c_mktsegment"), "literal"), _row(c, _iri("other", "c_custkey"), O.RDFS + "label", F.col("c_mktsegment"), "literal"))
    return O.find_by_label(triples, "il", exact=False)


@query("axiom_bonus", "select p_partkey, round(case when p_size % 2 = 0 then -0.5 when p_size % 3 = 0 then 0.2 else 0 end + case when p_size % 5 = 0 then -0.5 when p_size % 7 = 0 then 0.2 else 0 end::double, 6)::double as bonus from part")
def axiom_bonus(spark, sf_dir):
    of = lambda n: F.col("p_size") % n == 0
    return table(spark, sf_dir, "part").select("p_partkey", F.round(O.axiom_bonus(of(3), of(2), of(7), of(5)), 6).alias("bonus"))


@query("subject_links", "select 'o' || o_orderkey as subject, 'urn:link' as predicate, o_custkey::varchar as object, o_orderkey as row_id, 'o' || o_orderkey || '->o_custkey' as column_name from orders where o_orderkey % 4 > 0")
def subject_links(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_row"), F.concat(F.lit("o"), "o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_custkey")).alias("o_custkey"))
    return E.links(rows, "_row", "id", [("o_custkey", "urn:link")]).select("subject", "predicate", "object", "row_id", "column_name")


@query("provenance_summary", "with f as (select o_orderstatus as provenance, (o_orderkey % 10) / 10.0::double as c_tab, (o_orderkey % 7) / 10.0::double as c_txt, (o_orderkey % 11) / 10.0::double as c_fused from orders) select provenance, count(*) as n, round(avg(c_tab) filter (c_tab > 0), 6) as avg_tab, round(avg(c_txt) filter (c_txt > 0), 6) as avg_txt, round(avg(c_fused), 6) as avg_fused, round(avg(c_fused - greatest(c_tab, c_txt)), 6) as gain from f group by provenance")
def provenance_summary(spark, sf_dir):
    part = lambda n: F.col("o_orderkey") % n / 10.0
    fused = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("provenance"), part(10).alias("c_tab"), part(7).alias("c_txt"), part(11).alias("c_fused"))
    return U.provenance_summary(fused).withColumns({c: F.round(c, 6) for c in ("avg_tab", "avg_txt", "avg_fused", "gain")})


@query("sentence_relations_orders", "with s as (select l_orderkey as d, l_partkey as name, row_number() over (partition by l_orderkey order by l_partkey) as r, p_size % 2 = 0 as m from (select distinct l_orderkey, l_partkey from lineitem) join part on l_partkey = p_partkey) select t.d as doc_id, 0 as sentence_no, 'p' || h.name as subject, case when t.m then 'hasIngredient' else 'relatesTo' end as predicate, 'p' || t.name as object from s h join s t on h.d = t.d where h.r = 1 and t.r > 1")
def sentence_relations_orders(spark, sf_dir):
    """An order as a sentence, its parts as spans in the order of their keys."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct().join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    spans = lines.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("sentence_no"), F.col("l_partkey").alias("start"), F.concat(F.lit("p"), "l_partkey").alias("name"), F.when(F.col("p_size") % 2 == 0, "Material").otherwise("Item").alias("kind"))
    return T.sentence_relations(spans)


@query("enriched_rdf", f"""with e as (select 'urn:o:' || o_orderkey as s, 'urn:c:' || o_custkey as o, case when o_orderkey % 2 = 0 then o_orderkey % 5 end as q from orders)
select 'straight' as kind, count(*) as n from e where q is null union all select 'through', count(*) from e where q is not null union all select 'item', count(*) from e where q is not null union all select 'quantity', count(*) from e where q is not null
union all select 'type', count(distinct c_custkey) from customer union all select 'label', count(distinct c_custkey) from customer""")
def enriched_rdf(spark, sf_dir):
    """Edges of orders to customers, every second with a quantity, and the customers' labels, by kind of triple."""
    orders = table(spark, sf_dir, "orders")
    edges = orders.select(_iri("o", "o_orderkey").alias("s"), F.lit("needs").alias("p"), _iri("c", "o_custkey").alias("o"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 5).cast("double").alias("quantity"))
    named = table(spark, sf_dir, "customer").select(_iri("c", "c_custkey").alias("iri"), F.col("c_name").alias("label"), F.lit("Customer").alias("type"))
    out = rdf.enrich(edges, named, "urn:def/")
    kind = F.when(F.col("p") == "urn:def/needs", F.when(F.col("o_kind") == "bnode", "through").otherwise("straight")).when(F.col("p") == "urn:def/item", "item").when(F.col("p") == "urn:def/quantity", "quantity").when(F.col("p") == O.RDF + "type", "type").when(F.col("lang") == "en", "label")
    return out.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("ntriples", "select count(*) as n_lines, count(*) filter (c_custkey % 2 = 0) as n_quoted from customer")
def ntriples(spark, sf_dir):
    """Labels of customers as N-Triples lines, every second with a quotation mark to escape."""
    c = table(spark, sf_dir, "customer")
    label = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('"'), "c_name")).otherwise(F.col("c_name"))
    rows = _row(c, _iri("c", "c_custkey"), O.RDFS + "label", label, "literal", O.XSD + "string")
    line = rdf.ntriples_line(*(F.col(x) for x in ("s", "p", "o", "o_kind", "datatype", "lang")))
    return rows.select(line.alias("x")).agg(F.count_if(F.col("x").rlike(r'^<urn:c:[0-9]+> <\S+> ".+" \.$')).alias("n_lines"), F.count_if(F.col("x").contains('\\"')).alias("n_quoted"))
