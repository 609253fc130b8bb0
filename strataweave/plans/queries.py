"""Registered queries over the test tables and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.functions import cells as C
from strataweave.functions import normalize as N
from strataweave.functions import similarity as S
from strataweave.operators import anchoring as G
from strataweave.operators import emit as E
from strataweave.operators import fusion as U
from strataweave.operators import matching as M
from strataweave.operators import mesh as B
from strataweave.operators import metrics as X
from strataweave.operators import ontology as O
from strataweave.operators import predicate as P
from strataweave.operators import profile as A
from strataweave.operators import retrieval as R
from strataweave.operators import spans as W
from strataweave.operators import text as T
from strataweave.plans import interpret
from strataweave.plans import more_queries, schema_queries, table_queries, text_queries
from strataweave.plans.fixtures import CELLS, CEA, CPA, CTA, CLAUSES, MENTIONS, trade_ontology
from strataweave.plans.registry import QUERIES, SQL, query, quoted, table

PROFILED = {
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "events": ("event_id", "ts", "user_id", "event_type", "props"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
}


# ---- profiles and roles

_UUID, _ID, _NUM, _MEAS, _ISO = (quoted(p.replace(r"[T\s]", "[T ]").replace(r"\s", "[ \t]")) for p in (A.UUID, A.STRUCTURED_ID, A.NUMBER, A.MEASUREMENT, A.ISO_DATE))


def _profile_cte(name: str, columns: tuple[str, ...]) -> str:
    cells = " union all ".join(f"select {i} as ordinal, '{c}' as column_name, trim(cast({c} as varchar)) as v from {name}" for i, c in enumerate(columns))
    return f"""cells as (select ordinal, column_name, case when lower(v) in ('', 'nan', 'none', 'null') then null else v end as v from ({cells})),
tested as (select *, regexp_matches(v, {_UUID}) or regexp_matches(v, {_ID}) as is_id, regexp_matches(replace(v, ',', ''), {_NUM}) as is_num,
  length(v) >= 8 and (regexp_matches(v, {_ISO}) or try_strptime(v, ['%Y-%m-%d', '%Y/%m/%d', '%d-%m-%Y', '%d/%m/%Y', '%Y-%m-%d %H:%M:%S']) is not null) as is_ts,
  regexp_matches(v, {_MEAS}) and length(regexp_extract(v, {_MEAS}, 1)) <= 8 as is_meas from cells),
stats as (select ordinal, column_name, count(*) as total_count, count(v) as non_empty_count, count(distinct v) as cardinality,
  coalesce(count(distinct v)::double / nullif(count(v), 0), 0) as uniqueness_ratio, coalesce(avg(case when v is not null then is_id::int end), 0) as id_shape_ratio,
  coalesce(avg(case when v is not null then is_num::int end), 0) as numeric_ratio, coalesce(avg(length(v)), 0) as avg_str_len,
  coalesce(avg(case when v is not null then is_ts::int end), 0) as timestamp_ratio, coalesce(avg(case when v is not null then is_meas::int end), 0) as measurement_ratio,
  min(case when is_num then replace(v, ',', '')::double end) as min_value, max(case when is_num then replace(v, ',', '')::double end) as max_value
  from tested group by ordinal, column_name)"""


_STATS = ("uniqueness_ratio", "id_shape_ratio", "numeric_ratio", "avg_str_len", "timestamp_ratio", "measurement_ratio")
_ROLES = """ranked as (select *, case when non_empty_count > 0 and uniqueness_ratio >= 0.85 then case when id_shape_ratio >= 0.70 then 2.0 when numeric_ratio >= 0.85 and avg_str_len <= 12 then 1.5 when avg_str_len <= 60 then 1.0 end end as tier from stats),
keyed as (select *, tier is not null and row_number() over (order by tier desc nulls last, uniqueness_ratio desc, ordinal) = 1 as is_primary from ranked)
select ordinal, column_name, is_primary, case when non_empty_count = 0 or (cardinality = 1 and total_count > 3) or avg_str_len > 300 then 'Skip' when is_primary then 'Entity ID'
  when id_shape_ratio >= 0.70 and uniqueness_ratio >= 0.85 then 'Entity ID' when id_shape_ratio >= 0.70 then 'Foreign Key' when timestamp_ratio >= 0.80 then 'Timestamp'
  when measurement_ratio >= 0.70 then 'Measurement value/unit pair' when numeric_ratio >= 0.85 then 'Numeric property'
  when avg_str_len <= 50 and (uniqueness_ratio <= 0.35 or (cardinality <= 25 and (total_count < 5 or uniqueness_ratio <= 0.50))) then 'Categorical' else 'Text' end as role from keyed"""


def _add_profiles(name: str, columns: tuple[str, ...]) -> None:
    def stats(spark, sf_dir):
        out = A.column_stats(table(spark, sf_dir, name).select(*columns))
        return out.select("ordinal", "column_name", "total_count", "non_empty_count", "cardinality", *(F.round(c, 9).alias(c) for c in _STATS), "min_value", "max_value")

    def roles(spark, sf_dir):
        return A.column_roles(A.column_stats(table(spark, sf_dir, name).select(*columns))).select("ordinal", "column_name", "is_primary", "role")

    cte = _profile_cte(name, columns)
    query(f"profile_columns_{name}", f"with {cte} select ordinal, column_name, total_count, non_empty_count, cardinality, {', '.join(f'round({c}, 9) as {c}' for c in _STATS)}, min_value, max_value from stats")(stats)
    query(f"column_roles_{name}", f"with {cte}, {_ROLES}")(roles)


for _name, _columns in PROFILED.items():
    _add_profiles(_name, _columns)


@query(
    "profile3_columns",
    "with cells as (" + " union all ".join(f"select {i} as ordinal, '{c}' as column_name, trim(cast({c} as varchar)) as v from part" for i, c in enumerate(PROFILED["part"])) + r"""),
p as (select ordinal, column_name, count(v) as n_values, count(distinct v) as d, bool_and(regexp_matches(v, '^[+-]?[0-9]+$')) as is_integer, bool_and(regexp_matches(replace(v, ',', ''), """ + _NUM + r""")) as num,
  min(try_cast(v as hugeint)) as lo, max(try_cast(v as hugeint)) as hi, avg(length(v)) as len, bool_or(contains(v, ' ')) as has_space, bool_or(contains(v, ',')) as has_comma from cells group by all)
select ordinal, column_name, n_values, is_integer, num and not is_integer as is_float, not num as is_string, case when is_integer then lo::double end as min_int, case when is_integer then hi::double end as max_int,
  round(d::double / n_values, 9) as uniqueness, round(len, 9) as avg_length, has_space, has_comma, 0.0::double as chat_code_ratio, 0.0::double as image_url_ratio from p""",
)
def profile3_columns(spark, sf_dir):
    out = A.profile3(table(spark, sf_dir, "part").select(*PROFILED["part"]))
    return out.withColumns({c: F.round(c, 9) for c in ("uniqueness", "avg_length")})


@query("table_type", "select count(*) as n_rows, 'GenericTable' as table_type from region")
def table_type(spark, sf_dir):
    return A.table_type(table(spark, sf_dir, "region"))


# ---- scalar functions on real columns

_LEET = r"trim(regexp_replace(regexp_replace(replace(translate(regexp_replace(lower(trim(X)), '[@#$%^&*_+=\[\]{};:<>?/\\|~]', ' ', 'g'), '01345', 'oieas'), 'qu', chr(1)), 'q', 'g', 'g'), '\s+', ' ', 'g'))"


@query("normalize_leet", f"select p_partkey, replace({_LEET.replace('X', 'p_brand')}, chr(1), 'qu') as brand, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') as squeezed from part")
def normalize_leet(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", N.normalize_leet(F.col("p_brand")).alias("brand"), N.normalize_string(F.col("p_name")).alias("squeezed"))


@query("tokenize_identifiers", r"select p_partkey, array_to_string(regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace(p_brand, '([a-z])([A-Z])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g'), '([a-zA-Z])([0-9])', '\1 \2', 'g')), '[a-z0-9]+'), ' ') as tokens from part")
def tokenize_identifiers(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(N.tokenize_string(F.col("p_brand")), " ").alias("tokens"))


@query("tokenize_documents", r"select doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_\p{Pc}]+')) as n_tokens from documents")
def tokenize_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(N.tokens(F.coalesce("text", F.lit("")))).cast("long").alias("n_tokens"))


@query("char_ngrams", "with n as (select distinct p_name, '^' || lower(trim(p_name)) || '$' as s from part) select p_name, len(list_distinct(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3)))) as n_grams from n")
def char_ngrams(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_name").distinct().select("p_name", F.size(N.char_ngrams(F.col("p_name"))).cast("long").alias("n_grams"))


def _name_pairs(spark, sf_dir) -> DataFrame:
    """Pairs of distinct part names: a fixed vocabulary of a few dozen, whatever the table's size."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return names.select(F.col("p_name").alias("a")).join(F.broadcast(names.select(F.col("p_name").alias("b"))), F.col("a") <= F.col("b"))


_PAIRS = "with names as (select distinct p_name from part), pairs as (select x.p_name as a, y.p_name as b from names x join names y on x.p_name <= y.p_name)"
_GRAMS = "list_distinct(list_transform(range(1, length('^' || lower(X) || '$') - 1), lambda i: substr('^' || lower(X) || '$', i, 3)))"
_TOKENS = "list_distinct(regexp_extract_all(lower(X), '\\w+'))"


def _jaccard_sql(parts: str) -> str:
    a, b = parts.replace("X", "a"), parts.replace("X", "b")
    return f"len(list_intersect({a}, {b}))::double / len(list_distinct(list_concat({a}, {b})))"


@query("levenshtein_pairs", f"{_PAIRS} select a, b, round(case when lower(a) = lower(b) then 1.0::double else 1 - levenshtein(lower(a), lower(b))::double / greatest(length(a), length(b)) end, 9) as sim from pairs")
def levenshtein_pairs(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select("a", "b", F.round(S.levenshtein_similarity(F.col("a"), F.col("b")), 9).alias("sim"))


@query("token_jaccard", f"{_PAIRS} select a, b, round({_jaccard_sql(_TOKENS)}, 9) as sim from pairs")
def token_jaccard(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select("a", "b", F.round(S.token_jaccard(F.col("a"), F.col("b")), 9).alias("sim"))


@query("ngram_jaccard", f"{_PAIRS} select a, b, round({_jaccard_sql(_GRAMS)}, 9) as sim from pairs")
def ngram_jaccard(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select("a", "b", F.round(S.ngram_jaccard(F.col("a"), F.col("b")), 9).alias("sim"))


@query("jaro_std_pairs", f"{_PAIRS} select a, b, round(jaro_similarity(lower(a), lower(b)), 9) as sim from pairs")
def jaro_std_pairs(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select("a", "b", F.round(S.jaro_std_udf("a", "b"), 9).alias("sim"))


@query("jaro_winkler_std_pairs", f"{_PAIRS} select a, b, round(jaro_winkler_similarity(lower(a), lower(b)), 9) as sim from pairs")
def jaro_winkler_std_pairs(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select("a", "b", F.round(S.jaro_winkler_std_udf("a", "b"), 9).alias("sim"))


@query("string_scores")
def string_scores(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return _name_pairs(spark, sf_dir).select("a", "b", S.jaro_udf(a, b).alias("jaro"), S.jaro_winkler_udf(a, b).alias("jaro_winkler"), S.seq_ratio_udf(a, b).alias("seq_ratio"), S.lexical_score(a, b).alias("lexical"))


@query("clean_cell_text", "select * from (values " + ", ".join(f"({i}, {quoted(want)})" for i, (_, want, *_) in enumerate(CELLS)) + ") t(id, cleaned)")
def clean_cell_text(spark, sf_dir):
    rows = spark.createDataFrame([(i, raw) for i, (raw, *_) in enumerate(CELLS)], "id int, raw string")
    return rows.select("id", C.clean_cell(F.col("raw")).alias("cleaned"))


@query("quantity_extract", "select * from (values " + ", ".join(f"({i}, {quoted(q[0])}, {'null' if q[1] is None else q[1]}::double, {'null' if q[2] is None else quoted(q[2])}::varchar)" for i, (_, _, q, _) in enumerate(CELLS)) + ") t(id, name, quantity, unit)")
def quantity_extract(spark, sf_dir):
    rows = spark.createDataFrame([(i, raw) for i, (raw, *_) in enumerate(CELLS)], "id int, raw string")
    return rows.select("id", C.extract_quantity(C.clean_text(F.col("raw"))).alias("q")).select("id", "q.name", "q.quantity", "q.unit")


@query(
    "decompose_cells",
    "select id, pos, kind, name, quantity::double as quantity, rating::int as rating, zone from (values "
    + ", ".join(f"({i}, {k}, {', '.join('null' if v is None else str(v) if isinstance(v, (int, float)) else quoted(v) for v in part)})" for i, (*_, parts) in enumerate(CELLS) for k, part in enumerate(parts))
    + ") t(id, pos, kind, name, quantity, rating, zone)",
)
def decompose_cells(spark, sf_dir):
    rows = spark.createDataFrame([(i, raw) for i, (raw, *_) in enumerate(CELLS)], "id int, raw string")
    parts = rows.select("id", F.posexplode(C.decompose_cell(C.clean_text(F.col("raw")))).alias("pos", "p"))
    return parts.select("id", "pos", "p.kind", "p.name", "p.quantity", "p.rating", "p.zone")


@query("noisy_or", "with s as (select doc_id, (doc_id % 11) / 10.0::double as t, (doc_id % 7) / 10.0::double as x, toxic = 0 as ok from labels) select doc_id, round(greatest(0.0::double, least(1.0::double, case when t > 0 and x > 0 then 1 - (1 - t) * (1 - x) when t > 0 then t when x > 0 then x else 0.5::double end + case when ok then 0.05::double else 0 end)), 9) as fused from s")
def noisy_or(spark, sf_dir):
    t, x = (F.col("doc_id") % 11) / 10.0, (F.col("doc_id") % 7) / 10.0
    return table(spark, sf_dir, "labels").select("doc_id", F.round(S.noisy_or(t, x, F.col("toxic") == 0), 9).alias("fused"))


# ---- search

_NEAR = "select qid, rank, id, round(score, 6) as score from (select q.vec_id as qid, v.vec_id as id, list_cosine_similarity(q.embedding::double[], v.embedding::double[]) as score, row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 9) desc, v.vec_id) as rank from (select * from embeddings where vec_id % 20 = 0) q join {0} v on true) where rank <= 10"


def _knn(spark, sf_dir, where):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    queries = vectors.filter("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    return R.knn(vectors, queries, 10, where).select("qid", F.col("rank").cast("long"), "id", F.round("score", 6).alias("score"))


@query("knn_embeddings", _NEAR.format("embeddings"))
def knn_embeddings(spark, sf_dir):
    return _knn(spark, sf_dir, None)


@query("knn_filtered", _NEAR.format("(select * from embeddings where label = 3)"))
def knn_filtered(spark, sf_dir):
    return _knn(spark, sf_dir, "label = 3")


@query("hybrid_search")
def hybrid_search(spark, sf_dir):
    names = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    entities = names.select(F.concat(F.lit("urn:part:"), "k").alias("iri"), F.col("p_name").alias("label"), F.array().cast("array<string>").alias("aliases"), F.array(F.lit("urn:Part")).alias("types"))
    return R.hybrid_search(table(spark, sf_dir, "part").select(F.concat(F.lit("the "), "p_name").alias("query")), entities, 5).drop("types")


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_\p{Pc}]+')"


@query(
    "tfidf_match",
    f"""with bench as (select item_id as id, text from benchmark), n as (select count(*) as n from bench), occ as (select id, unnest({_WORDS}) as token from bench), tf as (select id, token, count(*) as tf from occ group by all),
df as (select token, count(*) as df from tf group by token), w as (select id, token, tf * (ln((1.0 + n) / (1 + df)) + 1) as w from tf join df using (token), n), u as (select id, token, w / sqrt(sum(w * w) over (partition by id)) as w from w)
select x.id as a, y.id as b, round(sum(x.w * y.w), 6) as cosine from u x join u y using (token) where x.id < y.id group by all""",
)
def tfidf_match(spark, sf_dir):
    weights = R.tfidf_weights(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")).cache()
    return R.tfidf_cosine(weights, weights).filter("a < b").select("a", "b", F.round("cosine", 6).alias("cosine"))


@query("statistical_match", "select upper(p_name) as text, 'urn:part:' || min(p_partkey) as uri, 1.0::double as score from part group by p_name")
def statistical_match(spark, sf_dir):
    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("text")).agg(F.min("p_partkey").alias("id")).withColumn("uri", F.concat(F.lit("urn:part:"), "id"))
    return R.statistical_match(table(spark, sf_dir, "part").select(F.upper("p_name").alias("text")), names).withColumn("score", F.round("score", 9))


# ---- ontology

_EDGES = """edges as (select 'urn:nation:' || n_nationkey as child, 'urn:region:' || n_regionkey as parent from nation
  union select 'urn:customer:' || c_custkey, 'urn:nation:' || c_nationkey from customer
  union select 'urn:region:' || r_regionkey, 'urn:world' from region)"""


def _place_triples(spark, sf_dir) -> DataFrame:
    """Customers under nations under regions under the world, as a class hierarchy; regions are declared disjoint in pairs."""
    iri = lambda kind, c: F.concat(F.lit(f"urn:{kind}:"), F.col(c).cast("string"))
    none = F.lit(None).cast("string")
    row = lambda d, s, p, o: d.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit("iri").alias("o_kind"), none.alias("datatype"), none.alias("lang"))
    nation, region, customer = (table(spark, sf_dir, n) for n in ("nation", "region", "customer"))
    parts = [row(nation, iri("nation", "n_nationkey"), O.RDFS + "subClassOf", iri("region", "n_regionkey")), row(customer, iri("customer", "c_custkey"), O.RDFS + "subClassOf", iri("nation", "c_nationkey")), row(region, iri("region", "r_regionkey"), O.RDFS + "subClassOf", F.lit("urn:world"))]
    pair = region.select(F.col("r_regionkey").alias("x")).join(region.select(F.col("r_regionkey").alias("y")), F.col("x") < F.col("y"))
    parts.append(row(pair, iri("region", "x"), O.OWL + "disjointWith", iri("region", "y")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_UP = f"with recursive {_EDGES}, up as (select child, parent as ancestor, 1 as distance from edges union select u.child, e.parent, u.distance + 1 from up u join edges e on u.ancestor = e.child)"


@query("class_closure", f"{_UP} select child, ancestor, min(distance) as distance from up group by all")
def class_closure(spark, sf_dir):
    return O.closure(O.class_edges(_place_triples(spark, sf_dir)))


@query("class_depth", f"{_UP}, nodes as (select child as uri from edges union select parent from edges) select uri, 1 + coalesce(max(distance), 0)::int as depth from nodes left join up on uri = child group by uri")
def class_depth(spark, sf_dir):
    return O.class_depth(_place_triples(spark, sf_dir))


@query(
    "lcs",
    f"""{_UP}, rup as (select child, ancestor from up union select child, child from edges union select parent, parent from edges), asked as (select distinct c_mktsegment || c_nationkey % 3 as grp, 'urn:nation:' || c_nationkey as cls from customer),
n as (select grp, count(*) as n from asked group by grp), common as (select a.grp, ancestor from asked a join rup on cls = child join n on a.grp = n.grp group by a.grp, ancestor, n.n having count(distinct cls) = n.n),
up_n as (select child, count(*) as k from rup group by child) select grp, ancestor as lcs from (select grp, ancestor, row_number() over (partition by grp order by k desc, ancestor) as r from common join up_n on ancestor = child) where r = 1""",
)
def lcs(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").select(F.concat("c_mktsegment", (F.col("c_nationkey") % 3).cast("string")).alias("grp"), F.concat(F.lit("urn:nation:"), "c_nationkey").alias("class_uri"))
    return O.least_common_subsumer(asked, _place_triples(spark, sf_dir))


@query(
    "disjoint_from",
    f"""{_UP}, rup as (select child, ancestor from up union select child, child from edges union select parent, parent from edges)
select child as uri, 'urn:region:' || r_regionkey as apart from rup, region where ancestor like 'urn:region:%' and ancestor <> 'urn:region:' || r_regionkey""",
)
def disjoint_from(spark, sf_dir):
    """What every class, customers included, is declared or inherits to be disjoint from: a few rows per class."""
    return O.disjoint_from(_place_triples(spark, sf_dir))


@query(
    "disjoint_inherited",
    """with n as (select 'urn:nation:' || n_nationkey as c, n_regionkey as r from nation union all select 'urn:region:' || r_regionkey, r_regionkey from region)
select x.c as a, y.c as b from n x join n y on x.r <> y.r""",
)
def disjoint_inherited(spark, sf_dir):
    """All pairs, so of nations and regions only: pairs of customers grow with their square (see disjoint_from)."""
    triples = _place_triples(spark, sf_dir).filter(~F.col("s").startswith("urn:customer:"))
    return O.disjoint_inherited(triples)


def _customers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("urn:customer:"), "c_custkey").alias("uri"))


@query(
    "paths_3hop",
    """with c as (select 'urn:customer:' || c_custkey as c, c_nationkey as n, n_regionkey as r from customer join nation on c_nationkey = n_nationkey)
select c as src, 'urn:world' as dst, 3 as hops, c || '>urn:nation:' || n || '>urn:region:' || r || '>urn:world' as path from c""",
)
def paths_3hop(spark, sf_dir):
    """From every customer."""
    triples = _place_triples(spark, sf_dir).filter(F.col("p") == O.RDFS + "subClassOf")
    ends = _customers(spark, sf_dir).select(F.col("uri").alias("src"), F.lit("urn:world").alias("dst"))
    return O.connecting_paths(triples, ends, 3, True).select("src", "dst", "hops", F.array_join("nodes", ">").alias("path"))


@query("chain", f"{_UP} select child as uri, ancestor as node, distance as step from up where child like 'urn:customer:%' union all select 'urn:customer:' || c_custkey, 'urn:customer:' || c_custkey, 0 from customer")
def chain(spark, sf_dir):
    """From every customer."""
    return O.chain(_place_triples(spark, sf_dir), _customers(spark, sf_dir), O.RDFS + "subClassOf")


def _order_triples(spark, sf_dir) -> DataFrame:
    """Orders as focus nodes: status, price and one hasLine per line."""
    none = F.lit(None).cast("string")
    make = lambda d, s, p, o, kind, dt: d.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), (F.lit(dt) if dt else none).alias("datatype"), none.alias("lang"))
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    o = F.concat(F.lit("urn:order:"), F.col("o_orderkey").cast("string"))
    parts = [
        make(orders, o, O.RDF + "type", F.lit("urn:Order"), "iri", None),
        make(orders, o, "urn:price", F.col("o_totalprice").cast("string"), "literal", O.XSD + "double"),
        make(orders.filter("o_orderstatus <> 'P'"), o, "urn:status", F.col("o_orderstatus"), "literal", O.XSD + "string"),
        make(lines, F.concat(F.lit("urn:order:"), F.col("l_orderkey").cast("string")), "urn:hasLine", F.concat(F.lit("urn:line:"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")), "iri", None),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _shacl(kind: str, path: list[str], arg: str):
    def run(spark, sf_dir):
        shapes = spark.createDataFrame([("OrderShape", "urn:Order", path, kind, arg, "broken")], "shape string, target string, path array<string>, kind string, arg string, message string")
        return O.validate_shapes(_order_triples(spark, sf_dir), shapes, use_closure=False).select("focus", "kind", "path")

    return run


query("shacl_mincount", "select 'urn:order:' || o_orderkey as focus, 'minCount' as kind, 'urn:status' as path from orders where o_orderstatus = 'P'")(_shacl("minCount", ["urn:status"], "1"))
query("shacl_maxcount", "select 'urn:order:' || o_orderkey as focus, 'maxCount' as kind, 'urn:hasLine' as path from orders join lineitem on o_orderkey = l_orderkey group by o_orderkey having count(distinct l_linenumber) > 4")(_shacl("maxCount", ["urn:hasLine"], "4"))
query("shacl_datatype", "select 'urn:order:' || o_orderkey as focus, 'datatype' as kind, 'urn:price|urn:status' as path from orders where o_orderstatus <> 'P'")(_shacl("datatype", ["urn:price", "urn:status"], O.XSD + "double"))
query("shacl_nodekind", "select 'urn:order:' || o_orderkey as focus, 'nodeKind' as kind, 'urn:hasLine|urn:status' as path from orders where o_orderstatus <> 'P'")(_shacl("nodeKind", ["urn:hasLine", "urn:status"], "iri"))
query("shacl_alternative_mincount", "select 'urn:order:' || o_orderkey as focus, 'minCount' as kind, 'urn:status|urn:hasLine' as path from orders where o_orderstatus = 'P' and o_orderkey not in (select l_orderkey from lineitem)")(_shacl("minCount", ["urn:status", "urn:hasLine"], "1"))
query("shacl_mininclusive", "select 'urn:order:' || o_orderkey as focus, 'minInclusive' as kind, 'urn:price' as path from orders where o_totalprice < 100000")(_shacl("minInclusive", ["urn:price"], "100000"))


@query("relation_violations", """select * from (values ('urn:o1', 'urn:trade:placedBy', 'urn:c1', false, null), ('urn:c1', 'urn:trade:placedBy', 'urn:c1', false, 'DisjointDomainViolation'), ('urn:o1', 'urn:trade:placedBy', 'Smith', true, 'ObjectPropertyRequiresURI'),
('urn:o1', 'urn:nothing', 'x', true, 'UndefinedProperty'), ('urn:o1', 'urn:trade:placedBy', 'urn:o1', false, 'DisjointRangeViolation')) t(s, p, o, o_is_literal, violation)""")
def relation_violations(spark, sf_dir):
    said = spark.createDataFrame([("urn:o1", "urn:trade:placedBy", "urn:c1", False), ("urn:c1", "urn:trade:placedBy", "urn:c1", False), ("urn:o1", "urn:trade:placedBy", "Smith", True), ("urn:o1", "urn:nothing", "x", True), ("urn:o1", "urn:trade:placedBy", "urn:o1", False)], "s string, p string, o string, o_is_literal boolean")
    typed = O.triples_from_rows(spark, [("urn:o1", O.RDF + "type", "urn:trade:Order"), ("urn:c1", O.RDF + "type", "urn:trade:Customer")])
    return O.violations(said, trade_ontology(spark).unionByName(typed))


@query("extension_proposals", "select mention, 'urn:new:' || trim(regexp_replace(lower(trim(mention)), '[^a-z0-9]+', '_', 'g'), '_') as proposed_iri from (select distinct p_type as mention from part union select distinct p_name from part) where lower(trim(mention)) not in (select lower(trim(p_name)) from part)")
def extension_proposals(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    mentions = part.select(F.col("p_type").alias("mention")).union(part.select("p_name")).distinct()
    return O.extension_proposals(mentions, part.select(F.col("p_name").alias("label")).distinct(), "urn:new:")


@query("cardinality", "select 'urn:order:' || l_orderkey as s, 'urn:hasLine' as p, count(distinct l_linenumber) as n from lineitem group by l_orderkey having count(distinct l_linenumber) > 5 or count(distinct l_linenumber) < 2")
def cardinality(spark, sf_dir):
    limits = spark.createDataFrame([("urn:hasLine", 2, 5)], "p string, least int, most int")
    return O.cardinality_violations(_order_triples(spark, sf_dir), limits)


@query("entity_catalog", "select 'urn:order:' || o_orderkey as uri, 'urn:Order' as type, 'urn:order:' || o_orderkey as label, case when o_orderstatus = 'P' then cast(o_totalprice as varchar) else o_orderstatus end as state from orders")
def entity_catalog(spark, sf_dir):
    return O.entity_catalog(_order_triples(spark, sf_dir), {"state": ("urn:status", "urn:price")}).select("uri", "type", "label", "state")


# ---- resolving and emitting

@query("predicate_ladder")
def predicate_ladder(spark, sf_dir):
    columns = spark.createDataFrame([("ORDER_ID",), ("total price",), ("ship_date",), ("custmer name",), ("marketSegment",)], "query string")
    return P.score_pairs(columns, O.properties(trade_ontology(spark)))


@query("axiom_veto", "select 'Numeric property' as role, p, v from (values ('obj', true), ('str', true), ('num', false), ('time', true), ('bool', true), ('open', false), ('mix', false)) t(p, v)")
def axiom_veto(spark, sf_dir):
    x = O.XSD
    rows = [("obj", "ObjectProperty", ["urn:C"]), ("str", "DatatypeProperty", [x + "string"]), ("num", "DatatypeProperty", [x + "double"]), ("time", "DatatypeProperty", [x + "date"]), ("bool", "DatatypeProperty", [x + "boolean"]), ("open", "DatatypeProperty", []), ("mix", "DatatypeProperty", [x + "string", x + "int"])]
    props = spark.createDataFrame(rows, "p string, kind string, ranges array<string>")
    role = F.lit("Numeric property")
    return props.select(role.alias("role"), "p", P.violates_axiom(role, F.col("kind"), F.col("ranges")).alias("v"))


@query("bounds_veto", "select p_partkey, p_size < 5 or p_retailprice > 1500 as vetoed from part")
def bounds_veto(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", P.violates_bounds(F.col("p_size"), F.col("p_retailprice"), F.lit(5.0), F.lit(1500.0)).alias("vetoed"))


@query("resolve_columns")
def resolve_columns(spark, sf_dir):
    stats = A.column_roles(A.column_stats(table(spark, sf_dir, "orders")))
    return P.resolve(P.small(stats.filter("role <> 'Skip'")), P.small(O.properties(trade_ontology(spark)))).drop("domains", "ranges")


@query("concept_lookup", "select distinct c_mktsegment as value, 'urn:trade:' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) as uri, 0.98::double as confidence, 'Concept-StringMatch' as method from customer")
def concept_lookup(spark, sf_dir):
    return P.concept_matches(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("value")), O.classes(trade_ontology(spark)))


@query("anchor_links", "select * from (values ('TASK_ID', 'TASK', 'TASK_CPU_TIME'), ('SOLUTE_ID', 'SOLUTE', 'SOLUTE_FORMULA'), ('SOLUTE_ID', 'SOLUTE', 'SOLUTE_CHARGE')) t(anchor, prefix, sibling)")
def anchor_links(spark, sf_dir):
    names = ["CALCULATION_ID", "TOTAL_ENERGY", "SOLUTE_ID", "SOLUTE_FORMULA", "SOLUTE_CHARGE", "TASK_ID", "TASK_CPU_TIME"]
    rows = [(i, n, "Entity ID" if n.endswith("_ID") else "Text", 1.0 if n.endswith("_ID") else 0.0) for i, n in enumerate(names)]
    columns = spark.createDataFrame(rows, "ordinal int, column_name string, role string, id_shape_ratio double")
    return E.anchors(columns, "CALCULATION_ID").select("anchor", "prefix", "sibling")


def _fixed_context(spark, columns: list[tuple[str, str, str, float, bool]]):
    """(columns, predicates) frames of columns given as (name, role, predicate, confidence, review)."""
    cols = spark.createDataFrame([(i, c, r) for i, (c, r, *_) in enumerate(columns)], "ordinal int, column_name string, role string")
    preds = spark.createDataFrame([(c, r, u, c, f, "Stage0-Exact", v, [], []) for c, r, u, f, v in columns], "column_name string, role string, uri string, label string, confidence double, method string, review_flag boolean, domains array<string>, ranges array<string>")
    return cols, preds


def _emit(spark, rows: DataFrame, columns, primary: str) -> DataFrame:
    cols, preds = _fixed_context(spark, columns)
    none = spark.createDataFrame([], "sibling string, anchor string")
    concepts = spark.createDataFrame([("F", "urn:Filled", 0.98, "Concept-StringMatch"), ("O", "urn:Open", 0.5, "Concept-EmbeddingMatch")], "value string, uri string, confidence double, method string")
    return E.emit(rows, "_row", cols, preds, primary, none, concepts, spark.createDataFrame([], "a string, b string"))


@query(
    "triples_nation",
    """select n_name as subject, 'urn:inRegion' as predicate, r_name as object, 0.9::double as confidence, 'Stage0-Exact' as method, false as review_flag, 'Literal Typed' as module_action, 'region' as column_name from nation join region on n_regionkey = r_regionkey
union all select n_name, 'urn:key', cast(n_nationkey as varchar), 0.6::double, 'Stage0-Exact', true, 'HITL Validation', 'n_nationkey' from nation union all select n_name, 'urn:name', n_name, 0.98::double, 'Stage0-Exact', false, 'Literal Typed', 'n_name' from nation""",
)
def triples_nation(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("_row"), "n_name", F.col("r_name").alias("region"), "n_nationkey")
    return _emit(spark, rows, [("n_name", "Entity ID", "urn:name", 0.98, False), ("region", "Text", "urn:inRegion", 0.9, False), ("n_nationkey", "Numeric property", "urn:key", 0.6, True)], "n_name").drop("row_id")


_ORDERS_SQL = """orders_triples as (select cast(o_orderkey as varchar) as subject, 'urn:customer' as predicate, cast(o_custkey as varchar) as object, 0.95::double as confidence, 'Stage0-Exact' as method, false as review_flag, 'Literal Typed' as module_action, 'o_custkey' as column_name from orders
union all select cast(o_orderkey as varchar), 'urn:id', cast(o_orderkey as varchar), 0.98::double, 'Stage0-Exact', false, 'Literal Typed', 'o_orderkey' from orders
union all select cast(o_orderkey as varchar), 'urn:status', case o_orderstatus when 'F' then 'urn:Filled' when 'O' then 'urn:Open' else o_orderstatus end, round(case o_orderstatus when 'F' then 0.9 * 0.98 when 'O' then 0.9 * 0.5 else 0.9 end::double, 4),
  'Stage0-Exact' || case o_orderstatus when 'F' then '+Concept-StringMatch' when 'O' then '+Concept-EmbeddingMatch' else '' end, o_orderstatus = 'O', case o_orderstatus when 'F' then 'Deterministic Mapped' when 'O' then 'HITL Validation' else 'Literal Typed' end, 'o_orderstatus' from orders)"""


def _orders(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_row"), "o_orderkey", "o_custkey", "o_orderstatus")
    return _emit(spark, rows, [("o_orderkey", "Entity ID", "urn:id", 0.98, False), ("o_custkey", "Foreign Key", "urn:customer", 0.95, False), ("o_orderstatus", "Categorical", "urn:status", 0.9, False)], "o_orderkey")


@query("triples_orders", f"with {_ORDERS_SQL} select * from orders_triples")
def triples_orders(spark, sf_dir):
    return _orders(spark, sf_dir).drop("row_id")


@query("coverage_report", f"with {_ORDERS_SQL} select coalesce(module_action, 'ALL') as module_action, count(*) as n_triples, round(avg((not starts_with(method, 'Unmapped'))::int), 9) as mapped_ratio, round(avg((confidence >= 0.70)::int), 9) as strong_ratio, count(*) filter (review_flag) as n_review from orders_triples group by grouping sets ((module_action), ())")
def coverage_report(spark, sf_dir):
    return E.coverage(_orders(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("mapped_ratio", "strong_ratio")})


@query(
    "row_type_conflicts",
    """select cast(o_orderkey as varchar) as subject, c as column_name, 'Stage0-Exact+Row_Type_Conflict' as method from orders, (values ('total'), ('priority')) t(c) where o_orderstatus <> 'P'""",
)
def row_type_conflicts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_row"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("total"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("priority"))
    cols, preds = _fixed_context(spark, [("id", "Entity ID", "urn:id", 0.9, False), ("total", "Numeric property", "urn:total", 0.9, False), ("priority", "Text", "urn:tissue", 0.9, False)])
    preds = preds.withColumn("domains", F.when(F.col("column_name") == "total", F.array(F.lit("urn:A"))).when(F.col("column_name") == "priority", F.array(F.lit("urn:B"))).otherwise(F.array().cast("array<string>")))
    out = E.emit(rows, "_row", cols, preds, "id", spark.createDataFrame([], "sibling string, anchor string"), spark.createDataFrame([], "value string, uri string, confidence double, method string"), spark.createDataFrame([("urn:A", "urn:B"), ("urn:B", "urn:A")], "a string, b string"))
    return out.filter(F.col("method").endswith("Row_Type_Conflict")).select("subject", "column_name", "method")


# What the columns resolve to does not depend on the rows: predicates, confidences and methods are the resolution's own.
_SEGMENTS = {"AUTOMOBILE": 0.7093, "BUILDING": 0.6971, "FURNITURE": 0.7005, "HOUSEHOLD": 0.711, "MACHINERY": 0.7074}


@query(
    "interpret_orders",
    f"""with r as (select o_orderkey as row_id, cast(o_orderkey as varchar) as subject, cast(o_totalprice as varchar) as price, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as day, c_name, c_mktsegment as m from orders join customer on o_custkey = c_custkey),
t as (select row_id, subject, 'urn:trade:orderId' as predicate, subject as object, 0.98::double as confidence, 'Stage0-Exact' as method, 'Literal Typed' as module_action, 'order_id' as column_name from r
union all select row_id, subject, 'urn:trade:totalPrice', price, 0.95, 'Stage0-Normalised', 'Literal Typed', 'total_price' from r union all select row_id, subject, 'urn:trade:orderDate', day, 0.95, 'Stage0-Normalised', 'Literal Typed', 'order_date' from r
union all select row_id, subject, 'urn:trade:customerName', c_name, 0.95, 'Stage0-Normalised', 'Literal Typed', 'customer_name' from r
union all select row_id, subject, 'urn:trade:marketSegment', 'urn:trade:' || m[1] || lower(m[2:]), case m {" ".join(f"when '{k}' then {v}" for k, v in _SEGMENTS.items())} end, 'Stage0-Normalised+Concept-EmbeddingMatch', 'Deterministic Mapped', 'market_segment' from r)
select *, false as review_flag from t""",
)
def interpret_orders(spark, sf_dir):
    """The flagship: a table of orders and customers against an ontology, to scored triples."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = orders.select(F.col("o_orderkey").alias("_row"), F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("total_price"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("order_date"), F.col("c_name").alias("customer_name"), F.col("c_mktsegment").alias("market_segment"))
    return interpret.table_to_triples(rows, "_row", trade_ontology(spark))


# ---- matching

@query(
    "cpa_row_support",
    "select 'order' as col_i, 'customer' as col_j, 'urn:placedBy' as p, count(*) as n_support from orders where o_custkey % 2 = 0",
)
def cpa_row_support(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    o, c = F.concat(F.lit("urn:order:"), "o_orderkey"), F.concat(F.lit("urn:customer:"), "o_custkey")
    cell = lambda col, iri: orders.select(F.col("o_orderkey").alias("row_id"), F.lit(col).alias("col"), F.lit(1).alias("rank"), iri.alias("iri"))
    facts = orders.filter("o_custkey % 2 = 0").select(o.alias("s"), F.lit("urn:placedBy").alias("p"), c.alias("o"))
    return M.row_support(cell("order", o).unionByName(cell("customer", c)), facts)


@query(
    "cta_votes",
    """with p as (select 'urn:type:' || split_part(p_type, ' ', 1) as t from part), n as (select count(*) as n from p), v as (select t as uri, 0.9::double * count(*) as vote, count(*)::double / any_value(n) as support, 2 as depth, 0.0::double as sim from p, n group by t
union all select 'urn:Thing', 0.9::double * 0.6 * n + 3, 1.0, 1, 0.1 from n), c as (select *, 0.4 * vote / max(vote) over () + 0.4 * support * (0.5 + 0.5 * depth / 2.0) + 0.2 * sim + case when uri = 'urn:Thing' then 0.25 else 0 end as raw from v),
f as (select 'type' as col, uri, least(1.0::double, case when support < 0.5 then raw / 2 else raw end) as confidence, support as support_ratio, sim as header_similarity, depth from c)
select col, uri, round(confidence, 9) as confidence, round(support_ratio, 9) as support_ratio, header_similarity, depth, rank from (select *, (row_number() over (order by confidence desc, support_ratio desc, depth desc, uri))::int as rank from f) where rank <= 5""",
)
def cta_votes(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    cands = part.select(F.col("p_partkey").alias("row_id"), F.lit("type").alias("col"), F.lit(1).alias("rank"), F.lit(0.9).alias("score"), F.array(F.concat(F.lit("urn:type:"), F.element_at(F.split("p_type", " "), 1))).alias("types"))
    kinds = part.select(F.concat(F.lit("urn:type:"), F.element_at(F.split("p_type", " "), 1)).alias("child")).distinct()
    up = kinds.withColumn("ancestor", F.lit("urn:Thing"))
    depths = kinds.select(F.col("child").alias("uri"), F.lit(2).alias("depth")).union(spark.createDataFrame([("urn:Thing", 1)], "uri string, depth int"))
    out = M.column_types(cands, up, depths, spark.createDataFrame([("type", "urn:Thing", 0.1)], "col string, uri string, sim double"))
    return out.withColumns({c: F.round(c, 9) for c in ("confidence", "support_ratio")})


@query("mesh_solver_rows", "select * from (values (1::bigint, 'step', 'urn:TheRaven', 0.75::double, 2.95::double), (1, 'mat', 'urn:Plank', 0.9, 2.95)) t(row_id, col, iri, score, row_score)")
def mesh_solver_rows(spark, sf_dir):
    rows = [(1, "step", 1, "urn:Juvenile", ["urn:Pet"], 0.80), (1, "step", 2, "urn:TheRaven", ["urn:Precursor"], 0.75), (1, "mat", 1, "urn:Plank", ["urn:Material"], 0.90)]
    cands = spark.createDataFrame(rows, "row_id long, col string, rank int, iri string, types array<string>, score double")
    return M.solve_rows(cands, {"step": "urn:Precursor", "mat": "urn:Material"}, [("step", "mat", "urn:requires")], {}, {"urn:Pet": {"urn:Material"}}, {"urn:requires": ({"urn:Precursor"}, {"urn:Material"})})


@query("cell_annotation")
def cell_annotation(spark, sf_dir):
    names = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    entities = names.select(F.concat(F.lit("urn:part:"), "k").alias("iri"), F.col("p_name").alias("label"), F.array().cast("array<string>").alias("aliases"), F.array(F.lit("urn:Part")).alias("types"))
    cells = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.lit("name").alias("col"), F.concat(F.lit("3x "), "p_name").alias("value"))
    return M.annotate_cells(cells, entities, O.classes(trade_ontology(spark)), 3).drop("types")


@query("cell_annotation_best", "with k as (select p_name, min(p_partkey) as k from part group by p_name) select p_partkey as row_id, '3x ' || part.p_name as value, part.p_name as cleaned, 'urn:part:' || k as iri, 1.0::double as score from part join k using (p_name)")
def cell_annotation_best(spark, sf_dir):
    """The best entity of every cell: its own name, once the quantity is off."""
    found = cell_annotation(spark, sf_dir).filter("rank = 1")
    return found.select("row_id", "value", "cleaned", "iri", F.round("score", 6).alias("score"))


# ---- text

_MASKED = "text"
for _a in ("Vol.", "vol.", "e.g.", "i.e.", "vs.", "approx.", "ea.", "No.", "no."):
    _MASKED = f"replace({_MASKED}, {quoted(_a)}, chr(2))"


@query("sentences", rf"select doc_id, len(list_filter(regexp_split_to_array(regexp_replace({_MASKED}, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '')) as n from documents")
def sentences(spark, sf_dir):
    """Every document, abbreviations and all."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(C.split_sentences(F.col("text"))).cast("long").alias("n"))


@query("modality", "select * from (values " + ", ".join(f"({i}, {quoted(kind)}, {conf}::double)" for i, (_, kind, conf) in enumerate(CLAUSES)) + ") t(id, modality, confidence)")
def modality(spark, sf_dir):
    rows = spark.createDataFrame([(i, c) for i, (c, *_) in enumerate(CLAUSES)], "id int, clause string")
    return rows.select("id", T.modality(F.col("clause")).alias("m")).select("id", "m.modality", "m.confidence")


# Every word between chr(1) and chr(2): a whole word is then a plain substring, also beside the same word.
_BOUNDED = r"regexp_replace(lower({}), '([\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}]+)', chr(1) || '\1' || chr(2), 'g')"


@query(
    "entity_counts",
    f"""with names(uri, alias) as (values {", ".join(f"({quoted(u)}, {quoted(a)})" for u, a in MENTIONS)}), asked as (select uri, {_BOUNDED.format("alias")} as alias from names),
texts as (select doc_id, {_BOUNDED.format("text")} as text from documents)
select doc_id, uri, sum((length(text) - length(replace(text, alias, ''))) // length(alias))::bigint as n from texts, asked group by doc_id, uri having n > 0""",
)
def entity_counts(spark, sf_dir):
    """Mentions in whole documents."""
    return T.entity_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), spark.createDataFrame(MENTIONS, "uri string, alias string"))


@query("sentence_relations", "select doc_id, sentence_no, subject, predicate, object from (values (1, 0, 'Staff', 'hasIngredient', 'Plank'), (1, 0, 'Staff', 'relatesTo', 'Vendor')) t(doc_id, sentence_no, subject, predicate, object)")
def sentence_relations(spark, sf_dir):
    spans = spark.createDataFrame([(1, 0, 5, "Staff", "Item"), (1, 0, 20, "Plank", "Material"), (1, 0, 40, "Vendor", "NPC"), (1, 1, 0, "Alone", "Item")], "doc_id int, sentence_no int, start int, name string, kind string")
    return T.sentence_relations(spans)


@query("synth_grid", "select * from (values (1, 1, 'Plank', '10', 'Artificer', null, null, null, null), (1, 2, 'Ingot', '10', 'Artificer', null, null, null, null), (2, 0, null, null, null, null, null, 'Arch', null)) t(frame, pos, component, quantity, discipline, rating, cost, zone, vendor)")
def synth_grid(spark, sf_dir):
    slots = spark.createDataFrame([(1, 1, "entity", "Plank"), (1, 2, "entity", "Ingot"), (1, 3, "quantity", "10"), (1, 4, "discipline", "Artificer"), (2, 1, "zone", "Arch"), (3, 1, "zone", "Arch")], "frame int, pos int, name string, value string")
    return T.synthesize_grid(slots)


# ---- fusion and metrics

@query(
    "triangulate",
    """with t as (select 'urn:doc:' || doc_id as uri, 'doc ' || doc_id as label, 0.9::double as c from labels), x as (select 'urn:doc:' || doc_id as uri, 'doc ' || doc_id as label, 0.6::double as c from documents)
select coalesce(t.uri, x.uri) as uri, coalesce(t.label, x.label) as label, coalesce(t.c, 0) as c_tab, coalesce(x.c, 0) as c_txt, round(case when t.c is not null and x.c is not null then 1.0::double when t.c is not null then 0.9 else 0.6 end::double, 6) as c_fused,
  case when t.c is not null and x.c is not null then 'cross_modal' when t.c is not null then 'table_only' else 'text_only' end as provenance from t full join x using (uri)""",
)
def triangulate(spark, sf_dir):
    one = lambda d, c: d.select(F.concat(F.lit("urn:doc:"), "doc_id").alias("uri"), F.concat(F.lit("doc "), "doc_id").alias("label"), F.lit(c).alias("confidence"))
    return U.fuse_entities(one(table(spark, sf_dir, "labels"), 0.9), one(table(spark, sf_dir, "documents"), 0.6)).withColumn("c_fused", F.round("c_fused", 6))


@query("corroborated_triples", "with t as (select distinct lower(n_name) as s, 'in' as p, cast(n_regionkey as varchar) as o from nation), x as (select * from t where cast(o as int) < 3) select t.s, t.p, t.o, case when x.s is null then 0.7::double else 0.8::double end as confidence, case when x.s is null then 'table_only' else 'corroborated' end as provenance from t left join x using (s, p, o)")
def corroborated_triples(spark, sf_dir):
    t = table(spark, sf_dir, "nation").select(F.col("n_name").alias("s"), F.lit("In").alias("p"), F.col("n_regionkey").cast("string").alias("o"), F.lit(0.7).alias("confidence"))
    return U.corroborate(t, t.filter("cast(o as int) < 3").withColumn("confidence", F.lit(0.5))).withColumn("confidence", F.round("confidence", 6))


@query("topic_priors", "select event_type as topic, count(*) as n, round(count(*)::double / sum(count(*)) over (), 9) as prior from events group by event_type")
def topic_priors(spark, sf_dir):
    return U.topic_priors(table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("topic")).agg(F.count("*").alias("n"))).withColumn("prior", F.round("prior", 9))


@query("tier_chain", "select * from (select 'urn:o' || o_orderkey as subject, lead('urn:o' || o_orderkey) over (partition by o_custkey order by o_orderdate, 'urn:o' || o_orderkey) as object from orders) where object is not null")
def tier_chain(spark, sf_dir):
    return U.tier_chain(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("series"), F.col("o_orderdate").alias("tier"), F.concat(F.lit("urn:o"), "o_orderkey").alias("uri")))


def _mentions(spark):
    rows = [(1, f"c{i}", "ingredient", f"urn:{i}", "urn:Item", "urn:Item", 1.0) for i in range(5)] + [(2, "c0", "target", "urn:9", "urn:Pet", "urn:Item", 1.0), (2, "c1", "ingredient", "urn:8", "urn:Item", "urn:Item", 0.0)]
    return spark.createDataFrame(rows, "row_id int, col string, role string, iri string, type string, col_type string, quantity double")


@query("pingpong_trace", "select * from (values (0, 3::bigint), (1, 0::bigint)) t(iteration, n_conflicts)")
def pingpong_trace(spark, sf_dir):
    return U.ping_pong(_mentions(spark), spark.createDataFrame([("urn:Pet", "urn:Item")], "a string, b string"))[1]


@query("cea_metrics", "select 2::bigint as tp, 1::bigint as fp, 1::bigint as fn, 4::bigint as n_evaluated, 0.5::double as accuracy, 0.6667::double as precision, 0.6667::double as recall, 0.6667::double as f1")
def cea_metrics(spark, sf_dir):
    pred, by_cell, by_mention = CEA
    return X.cea_metrics(spark.createDataFrame(pred, "row_id int, col int, raw string, iri string"), spark.createDataFrame(by_cell, "row_id int, col int, expected string"), spark.createDataFrame(by_mention, "mention string, expected string"))


@query("cta_metrics", "select 3::bigint as n_columns, 2::bigint as n_right, 0.6667::double as accuracy, 0.5556::double as macro_f1")
def cta_metrics(spark, sf_dir):
    return X.cta_metrics(spark.createDataFrame(CTA[0], "header string, iri string"), spark.createDataFrame(CTA[1], "header string, class_iri string"))


@query("cpa_metrics", "select 2::bigint as tp, 1::bigint as fp, 1::bigint as fn, 0.6667::double as precision, 0.6667::double as recall, 0.6667::double as f1")
def cpa_metrics(spark, sf_dir):
    shape = "source string, target string, property string"
    return X.cpa_metrics(spark.createDataFrame(CPA[0], shape), spark.createDataFrame(CPA[1], shape))


@query("normalized_identifiers", r"select p_partkey, regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') as ident from part")
def normalized_identifiers(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", N.normalize_identifier(F.col("p_type")).alias("ident"))


# ---- anchors, mesh and spans

@query("scheme_coverage", "select 'c_mktsegment' as column_name, s as scheme, round(count(distinct case when hit then v end)::double / count(distinct v), 9) as coverage from (select c_mktsegment as v, s, lower(c_mktsegment) = any(l) as hit from customer, (values ('goods', ['furniture', 'machinery', 'household']), ('all', ['automobile', 'building', 'furniture', 'machinery', 'household'])) t(s, l)) group by s")
def scheme_coverage(spark, sf_dir):
    rows = [("goods", x) for x in ("Furniture", "Machinery", "Household")] + [("all", x) for x in ("Automobile", "Building", "Furniture", "Machinery", "Household")]
    out = G.scheme_coverage(table(spark, sf_dir, "customer").select("c_mktsegment"), spark.createDataFrame(rows, "scheme string, label string"))
    return out.withColumn("coverage", F.round("coverage", 9))


@query("id_overlap", "select 'o_custkey' as column_name, 'customer' as kind, round(count(distinct c_custkey)::double / count(distinct o_custkey), 9) as overlap from orders left join (select c_custkey from customer where c_custkey % 2 = 0) on o_custkey = c_custkey")
def id_overlap(spark, sf_dir):
    known = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"))
    return G.id_overlap(table(spark, sf_dir, "orders").select("o_custkey"), known).withColumn("overlap", F.round("overlap", 9))


@query("ordered_pairs", "select 'p_size' as low, 'p_retailprice' as high from part having bool_and(p_size <= p_retailprice) and bool_or(p_size < p_retailprice)")
def ordered_pairs(spark, sf_dir):
    return G.ordered_pairs(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"])


@query("three_phase_columns")
def three_phase_columns(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_name", "p_size", "p_type", "p_partkey")
    kinds = part.select(F.lit("types").alias("scheme"), F.col("p_type").alias("label")).distinct()
    rules = [G.IntegerRule("size", 0.95, 0, 80), G.IntegerRule("key", 0.95, least_max=80)]
    found = G.annotate(part, A.profile3(part), G.scheme_coverage(part, kinds), {"types": "hasType"}, rules, "label", ("comment", "name"), {})
    return spark.createDataFrame(found, "column_name string, property string, confidence double, phase string")


def _mesh(spark):
    cells = spark.createDataFrame([(1, "a_target", "The Raven Staff"), (1, "b_parts", "3x Spiritwood Plank + 2x Ingot"), (1, "c_from", "Hobbs in Lion's Arch"), (2, "a_target", "Clover"), (2, "c_from", "5g 50s")], "row_id int, col string, value string")
    known = spark.createDataFrame([("the raven staff", "urn:e:staff", "Precursor"), ("Spiritwood Plank", "urn:e:plank", "Material")], "label string, iri string, type string")
    return B.link(B.parts(cells), known)


@query("mesh_edges", """select * from (values (1, 'urn:e:staff', 'requiresIngredient', 'urn:e:plank', 3.0::double, 'table'), (1, 'urn:e:staff', 'requiresIngredient', 'urn:strataweave:id/ingot', 2.0, 'table'),
(1, 'urn:e:staff', 'soldBy', 'urn:strataweave:id/hobbs', null, 'table'), (1, 'urn:strataweave:id/hobbs', 'locatedInZone', 'urn:strataweave:id/lion_s_arch', null, 'table'),
(2, 'urn:strataweave:id/clover', 'costs', 'urn:strataweave:id/gold', 5.0, 'table'), (2, 'urn:strataweave:id/clover', 'costs', 'urn:strataweave:id/silver', 50.0, 'table')) t(row_id, s, p, o, quantity, provenance)""")
def mesh_edges(spark, sf_dir):
    return B.edges(_mesh(spark), ("Precursor",))


@query("mesh_nodes", "select * from (values ('urn:e:staff', 'matched', 1::bigint), ('urn:e:plank', 'matched', 1), ('urn:strataweave:id/ingot', 'minted', 1), ('urn:strataweave:id/hobbs', 'minted', 1), ('urn:strataweave:id/lion_s_arch', 'minted', 1), ('urn:strataweave:id/clover', 'minted', 1), ('urn:strataweave:id/gold', 'minted', 1), ('urn:strataweave:id/silver', 'minted', 1)) t(iri, provenance, n_mentions)")
def mesh_nodes(spark, sf_dir):
    return B.nodes(_mesh(spark)).select("iri", "provenance", "n_mentions")


@query("entity_spans", "select 1 as doc_id, 3 as start, 19 as \"end\", 'Spiritwood Plank' as name, 'Material' as kind, 3.0::double as quantity union all select 1, 24, 29, 'Ingot', 'Material', null")
def entity_spans(spark, sf_dir):
    docs = spark.createDataFrame([(1, "3x Spiritwood Plank and Ingot, not Ingots"), (2, None)], "doc_id int, text string")
    return W.entity_spans(docs, [("Spiritwood Plank", "Material"), ("Plank", "Material"), ("Ingot", "Material")])


__all__ = ["QUERIES", "SQL", "more_queries", "schema_queries", "table_queries", "text_queries"]
