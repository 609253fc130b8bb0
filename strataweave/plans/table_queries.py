"""Registered queries of first readings, conflict checks, mesh annotation and triangulation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.operators import annotate as A
from strataweave.operators import conflicts as K
from strataweave.operators import fusion as U
from strataweave.operators import mesh as B
from strataweave.operators import proposals as P
from strataweave.operators import search as S
from strataweave.plans import benchmark
from strataweave.plans.registry import query, table
from strataweave.rules import headers as H

_NUMBERED = """n as (select o_orderkey as rid, o_orderkey as l_orderkey, p_partkey as l_partkey, o_orderkey % 10 as l_suppkey, (o_orderkey % 7 + 1)::int as l_linenumber, (o_orderkey % 50 + 1)::double as l_quantity, o_totalprice as l_extendedprice,
 (o_orderkey % 9) / 100.0 as l_tax, case o_orderstatus when 'F' then 'A' else 'N' end as l_returnflag, o_orderstatus as l_linestatus, p_name, p_type, p_size from orders join part on o_custkey = p_partkey)"""


def _lines(spark, sf_dir) -> DataFrame:
    """Every order as a line of the part with its customer's number: one row each, under the order's key."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    rows = table(spark, sf_dir, "orders").join(part, F.col("o_custkey") == F.col("p_partkey"))
    key = F.col("o_orderkey")
    return rows.select(
        key.alias("rid"), key.alias("l_orderkey"), F.col("p_partkey").alias("l_partkey"), (key % 10).alias("l_suppkey"), (key % 7 + 1).cast("int").alias("l_linenumber"), (key % 50 + 1).cast("double").alias("l_quantity"),
        F.col("o_totalprice").alias("l_extendedprice"), (key % 9 / 100).alias("l_tax"), F.when(F.col("o_orderstatus") == "F", "A").otherwise("N").alias("l_returnflag"), F.col("o_orderstatus").alias("l_linestatus"), "p_name", "p_type", "p_size",
    )


def _cells(rows: DataFrame, columns: list[tuple[str, object]]) -> DataFrame:
    """A table as cells: (row_id, ordinal, header, value)."""
    return rows.select(F.col("rid").alias("row_id"), F.posexplode(F.array(*(F.struct(F.lit(h).alias("header"), v.cast("string").alias("value")) for h, v in columns))).alias("ordinal", "c")).select("row_id", "ordinal", "c.header", "c.value")


def _recipe(spark, sf_dir) -> DataFrame:
    whole = lambda c: F.floor(c).cast("long")
    columns = [("Output", F.col("p_type")), ("Material", F.col("p_name")), ("Qty", whole("l_quantity")), ("Cost", F.concat(whole("l_extendedprice").cast("string"), F.lit(" gold"))), ("Crafting", F.when(F.col("l_returnflag") == "A", "chef").otherwise("scribe")), ("Line", F.col("l_linenumber")), ("Part", F.col("p_name"))]
    return _cells(_lines(spark, sf_dir), columns)


def _known(spark, sf_dir) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("label")).distinct()
    return names.select("label", F.when(F.col("label").rlike("[bg]o|ea|[aeiou]d"), "CraftingMaterial").otherwise("TrophyItem").alias("type"))


_KNOWN = "known as (select distinct p_name as label, case when regexp_matches(p_name, '[bg]o|ea|[aeiou]d') then 'CraftingMaterial' else 'TrophyItem' end as type from part)"


@query(
    "classify_columns",
    f"""with {_NUMBERED}, {_KNOWN}, part_column as (select count(*) filter (type = 'CraftingMaterial') as k, count(*) as n from n join known on p_name = label)
select * from (values (0, 'Output', 'Item', 'reward', 0.85::double), (1, 'Material', 'CraftingMaterial', 'ingredient', 0.9), (2, 'Qty', 'Quantity', 'quantity', 0.95), (3, 'Cost', 'Currency', 'cost', 0.9), (4, 'Crafting', 'CraftingDiscipline', 'discipline', 0.9), (5, 'Line', 'Quantity', 'quantity', 0.8)) t(ordinal, header, predicted_type, role, confidence)
union all select 6, 'Part', case when k >= n * 0.5 then 'CraftingMaterial' else 'Item' end, 'ingredient', case when k >= n * 0.5 then 0.85 else 0.6 end from part_column""",
)
def classify_columns(spark, sf_dir):
    return P.classify_columns(_recipe(spark, sf_dir), _known(spark, sf_dir))


def _mentions(spark, sf_dir) -> DataFrame:
    cells, known = _recipe(spark, sf_dir).filter("ordinal < 5"), _known(spark, sf_dir)
    return P.mentions(cells, P.classify_columns(cells, known), known)


@query(
    "table_mentions",
    f"""with {_NUMBERED}, {_KNOWN}
select rid as row_id, 0 as ordinal, p_type as name, 'Item' as type, 'Item' as column_type, null::double as quantity, null::varchar as unit from n
union all select rid, 1, p_name, type, 'CraftingMaterial', null, null from n join known on p_name = label
union all select rid, 2, cast(floor(l_quantity)::bigint as varchar), 'Item', 'Quantity', floor(l_quantity), 'count' from n
union all select rid, 3, 'gold', 'Currency', 'Currency', floor(l_extendedprice), 'count' from n
union all select rid, 4, case when l_returnflag = 'A' then 'chef' else 'scribe' end, 'CraftingDiscipline', 'CraftingDiscipline', null, null from n""",
)
def table_mentions(spark, sf_dir):
    return _mentions(spark, sf_dir).drop("role")


_RELATIONS = """relations as (select rid as row_id, p_type as subject, 'requiresMaterial' as predicate, p_name as object, floor(l_quantity)::double as quantity from n
union all select rid, p_type, 'costsCurrency', 'gold', floor(l_extendedprice) from n
union all select rid, p_type, 'requiresDiscipline', case when l_returnflag = 'A' then 'chef' else 'scribe' end, floor(l_quantity) from n)"""


@query("row_relations", f"with {_NUMBERED}, {_RELATIONS} select * from relations")
def row_relations(spark, sf_dir):
    return P.row_relations(_mentions(spark, sf_dir), 0)


@query(
    "row_attributes",
    f"""with {_NUMBERED} select rid as row_id, case when l_tax > 0.045 then floor(l_extendedprice)::bigint else floor(l_quantity)::bigint end as quantity, p_type as discipline, l_linenumber * 10::bigint as min_rating,
's' || l_suppkey as vendor, case when l_linestatus = 'O' then p_name end as zone, null::bigint as tier from n""",
)
def row_attributes(spark, sf_dir):
    whole = lambda c: F.floor(c).cast("string")
    columns = [("Qty", F.concat(whole("l_quantity"), F.lit("x"))), ("Crafted by", F.col("p_type")), ("min LEVEL", F.concat(F.lit("lvl "), F.col("l_linenumber") * 10)), ("Source", F.concat(F.lit("s"), "l_suppkey")), ("where", F.when(F.col("l_linestatus") == "O", F.col("p_name")).otherwise(" ")), ("Item cost", F.when(F.col("l_tax") > 0.045, whole("l_extendedprice")).otherwise("none")), ("Tier", F.lit("top"))]
    return P.row_attributes(_cells(_lines(spark, sf_dir), columns))


_HEADERS = "h as (select p_partkey::int as ordinal, p_type || ' ' || ['cost', 'item', 'craft', 'vendor', 'place', 'x'][1 + p_partkey % 6] as header from part)"


def _contains(words: tuple[str, ...]) -> str:
    return " or ".join(f"contains(lower(header), '{w}')" for w in words)


def _headers(spark, sf_dir) -> DataFrame:
    ends = F.array(*(F.lit(x) for x in ("cost", "item", "craft", "vendor", "place", "x")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("ordinal"), F.concat_ws(" ", "p_type", F.get(ends, (F.col("p_partkey") % 6).cast("int"))).alias("header"))


_BASELINE = "case " + " ".join(f"when {_contains(words)} then {{{i}}}" for i, (words, _, _) in enumerate(H.BASELINE)) + " else {5} end"


@query("baseline_types", f"with {_HEADERS} select ordinal, header, {_BASELINE.format(*(repr(k) for _, k, _ in H.BASELINE), repr(H.BASELINE_ELSE[0]))} as type, {_BASELINE.format(*(c for *_, c in H.BASELINE), H.BASELINE_ELSE[1])}::double as confidence from h")
def baseline_types(spark, sf_dir):
    return P.baseline_types(_headers(spark, sf_dir))


@query("baseline_pairs", f"with {_HEADERS} select * from (select header as source, lead(header) over (order by ordinal) as target, 'relatesTo' as relation, 0.45::double as confidence from h) where target is not null")
def baseline_pairs(spark, sf_dir):
    return P.baseline_pairs(_headers(spark, sf_dir))


@query(
    "baseline_validity",
    """with l as (select p_brand as text, p_size % 3 = 0 as unknown, p_size / 50.0 < 0.6 and regexp_matches(p_brand, '[0-9]') as mixed from part)
select count(*) as n_cells, count(*) filter (unknown) as n_unknown, count(*) filter (unknown or mixed) as n_doubtful, count(*) filter (unknown) + count(*) filter (unknown or mixed) + 5 as n_violations,
round(greatest(0, count(*) - count(*) filter (unknown) - count(*) filter (unknown or mixed))::double / count(*), 4) as validity from l""",
)
def baseline_validity(spark, sf_dir):
    linked = table(spark, sf_dir, "part").select(F.col("p_brand").alias("text"), F.when(F.col("p_size") % 3 == 0, "urn:unknown/x").otherwise("urn:known").alias("uri"), (F.col("p_size") / 50.0).alias("score"))
    return P.baseline_validity(linked, 5)


# ---- conflicts

_DISJOINT = [("TrophyItem", "CraftingMaterial"), ("CraftingMaterial", "TrophyItem")]


@query("column_type_conflicts", f"with {_NUMBERED}, {_KNOWN} select 'TYPE_INCOMPATIBILITY' as kind, 'ERROR' as severity, rid::varchar as row_id, 1 as ordinal, p_name as offending from n join known on p_name = label where type = 'TrophyItem'")
def column_type_conflicts(spark, sf_dir):
    return K.column_type_conflicts(_mentions(spark, sf_dir), _known(spark, sf_dir), spark.createDataFrame(_DISJOINT, "a string, b string"))


@query(
    "range_conflicts",
    f"""with {_NUMBERED}, {_KNOWN}, {_RELATIONS} select 'RANGE_VIOLATION' as kind, 'ERROR' as severity, row_id::varchar as row_id, null::int as ordinal, object as offending
from relations left join known on object = label where predicate = 'requiresMaterial' and coalesce(type, 'Item') <> 'CraftingMaterial' or predicate = 'requiresDiscipline'""",
)
def range_conflicts(spark, sf_dir):
    """Materials are goods, trophies are not; a discipline is nothing the ranges know; money takes any item."""
    ranges = spark.createDataFrame([("requiresMaterial", "Good"), ("requiresDiscipline", "Skill"), ("costsCurrency", "Item")], "predicate string, range string")
    up = spark.createDataFrame([("CraftingMaterial", "Good"), ("TrophyItem", "Prize")], "child string, ancestor string")
    return K.range_conflicts(P.row_relations(_mentions(spark, sf_dir), 0), _known(spark, sf_dir), ranges, up)


@query("forge_and_quantity_conflicts", f"with {_NUMBERED} select 'CARDINALITY_VIOLATION' as kind, 'ERROR' as severity, rid::varchar as row_id, null::int as ordinal, cast(l_quantity - 10 as varchar) as offending from n where l_quantity <= 10 union all select 'CARDINALITY_VIOLATION', 'ERROR', null, null, count(*)::varchar from n")
def forge_and_quantity_conflicts(spark, sf_dir):
    relations = _lines(spark, sf_dir).select(F.col("rid").alias("row_id"), F.lit("hasIngredient").alias("predicate"), F.col("p_name").alias("object"), (F.col("l_quantity") - 10).alias("quantity"))
    return K.conflicts(K.quantity_conflicts(relations), K.forge_conflicts(relations, "MysticForgeRecipe"), K.forge_conflicts(relations, "CraftingRecipe"))


def _makings(spark, sf_dir) -> DataFrame:
    """Orders made of lines, lines of parts; suppliers put parts out and are made of their nation."""
    row = lambda d, s, p, o: d.select(F.concat(F.lit(f"urn:{s[0]}:"), s[1]).alias("s"), F.lit(p).alias("p"), F.concat(F.lit(f"urn:{o[0]}:"), o[1]).alias("o"), F.lit("iri").alias("o_kind"))
    lines = _lines(spark, sf_dir)
    parts = [row(lines, ("order", "l_orderkey"), "urn:has", ("line", "rid")), row(lines, ("line", "rid"), "urn:of", ("part", "l_partkey"))]
    supply = lines.select("l_suppkey", "l_partkey").distinct()
    parts += [row(supply, ("supplier", "l_suppkey"), "urn:makes", ("part", "l_partkey")), row(table(spark, sf_dir, "supplier"), ("supplier", "s_suppkey"), "urn:of", ("nation", "s_nationkey"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "components",
    f"""with {_NUMBERED}, made as (select distinct l_partkey, s_nationkey from n join supplier on l_suppkey = s_suppkey)
select distinct 'urn:order:' || l_orderkey as uri, 'urn:line:' || rid as component, 1 as distance from n
union select 'urn:order:' || l_orderkey, 'urn:part:' || l_partkey, 2 from n
union select 'urn:order:' || l_orderkey, 'urn:nation:' || s_nationkey, 3 from n join made using (l_partkey)""",
)
def components(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("urn:order:"), "o_orderkey").alias("uri"))
    return K.components(_makings(spark, sf_dir), orders, ("urn:has", "urn:of"), ("urn:makes",))


@query("subject_conflicts", f"with {_NUMBERED} select 'SLOT_MISMATCH' as kind, 'WARNING' as severity, null::varchar as row_id, null::int as ordinal, min('order ' || l_orderkey) as offending from n where l_partkey = 1 having count(*) > 0")
def subject_conflicts(spark, sf_dir):
    """Part 1 as the subject of a table that mentions every order: the first order it goes into is named."""
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("urn:order:"), "o_orderkey").alias("uri"), F.concat(F.lit("order "), "o_orderkey").alias("label"))
    part = spark.createDataFrame([("urn:part:1", "Part One")], "uri string, label string")
    subject, named = spark.createDataFrame([(" part one",)], "name string"), orders.unionByName(part)
    made = K.components(_makings(spark, sf_dir), orders.select("uri"), ("urn:has", "urn:of"), ("urn:makes",), parts=K.named_alike(subject, named))
    return K.subject_conflicts(subject, orders.select(F.col("label").alias("name")), made, named)


# ---- mesh and triangulation

def _entities(spark, sf_dir) -> DataFrame:
    names = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    return names.select(F.concat(F.lit("urn:part:"), "k").alias("iri"), F.col("p_name").alias("label"), F.array().cast("array<string>").alias("aliases"), F.array(F.lit("urn:type/CraftingMaterial")).alias("types"))


def _mesh_cells(spark, sf_dir) -> DataFrame:
    columns = [("Precursor", F.upper("p_name")), ("Tier", F.concat(F.lit("Tier "), "l_linenumber")), ("Qty", F.floor("l_quantity").cast("string")), ("Made where", F.concat(F.lit("Place-"), "l_suppkey")), ("Done", F.lit("true"))]
    return _cells(_lines(spark, sf_dir), columns)


_MATCHED = f"""{_NUMBERED}, k as (select p_name, min(p_partkey) as k from part group by p_name), cells as (
select rid as row_id, 0 as ordinal, upper(n.p_name) as value, 'urn:part:' || k as iri, n.p_name as label, 'CraftingMaterial' as type, 0.95::double as confidence from n join k on n.p_name = k.p_name
union all select rid, 1, 'Tier ' || l_linenumber, 'urn:x/ref/tier/tier_' || l_linenumber, 'Tier ' || l_linenumber, 'CollectionTier', 0.95 from n
union all select rid, 3, 'Place-' || l_suppkey, 'urn:x/id/item/place-' || l_suppkey, 'Place-' || l_suppkey, 'Item', 0.85 from n)"""


@query("match_cells", f"with {_MATCHED} select row_id, ordinal, value, iri, label, type from cells")
def match_cells(spark, sf_dir):
    """Exact names in capitals, tiers, numbers and truth values that name nothing, and places that are minted."""
    return A.match_cells(_mesh_cells(spark, sf_dir), _entities(spark, sf_dir), "urn:x/").select("row_id", "ordinal", "value", "iri", "label", "type")


def _typed_columns(spark) -> DataFrame:
    rows = [(0, "Precursor", "PrecursorWeapon"), (1, "Step", "CollectionStep"), (2, "Qty", "IngredientQuantity"), (3, "Merchant", "NPCVendor"), (4, "Where", "Zone"), (5, "Craft", "CraftingDiscipline"), (6, "Token", "Currency"), (7, "Part", "ComponentItem")]
    return spark.createDataFrame(rows, "ordinal int, header string, type string")


@query(
    "bind_roles",
    f"""with {_NUMBERED}, v as (select rid, 'urn:part:' || l_partkey as m, 'urn:s:' || l_suppkey as s, 'urn:z:' || p_type as z, 'urn:w:' || l_returnflag as w, cast(floor(l_quantity)::bigint as varchar) as q from n)
select rid as row_id, w as s, 'requiresIngredient' as p, m as o, 'iri' as o_kind from v union all select rid, w, 'obtainedFromVendor', s, 'iri' from v union all select rid, s, 'locatedInZone', z, 'iri' from v
union all select rid, m, 'ingredientQuantity', q, 'literal' from v union all select rid, m, 'obtainedFromVendor', s, 'iri' from v""",
)
def bind_roles(spark, sf_dir):
    """A weapon, a material, a quantity, a seller told by its header, and a zone in every row."""
    node = lambda h, v, iri, t, c: F.struct(F.lit(h).alias("header"), v.cast("string").alias("value"), iri.alias("iri"), F.lit(t).alias("type"), F.lit(c).alias("column_type"))
    lines = _lines(spark, sf_dir)
    iri = lambda kind, c: F.concat(F.lit(f"urn:{kind}:"), c)
    nodes = F.array(
        node("thing", F.col("l_returnflag"), iri("w", "l_returnflag"), "PrecursorWeapon", "Text"), node("part", F.col("p_name"), iri("part", "l_partkey"), "CraftingMaterial", "Text"),
        node("n", F.floor("l_quantity"), F.lit("urn:none"), "Literal", "IngredientQuantity"), node("The Source", F.col("l_suppkey"), iri("s", "l_suppkey"), "Text", "Text"), node("z", F.col("p_type"), iri("z", "p_type"), "Zone", "Text"),
    )
    return B.bind_roles(lines.select(F.col("rid").alias("row_id"), F.posexplode(nodes).alias("ordinal", "x")).select("row_id", "ordinal", "x.*"))


@query(
    "forge_recipe",
    f"with {_NUMBERED}, f as (select 'urn:part:' || l_partkey as iri, min(rid) as seen from n group by l_partkey) select 'urn:strataweave:id/my_forge_table_forge' as s, 'requiresIngredient' as p, iri as o from f order by seen limit 4",
)
def forge_recipe(spark, sf_dir):
    found = _lines(spark, sf_dir).select(F.col("rid").alias("row_id"), F.lit(0).alias("ordinal"), F.lit(0).alias("pos"), F.concat(F.lit("urn:part:"), "l_partkey").alias("iri"), F.col("p_name").alias("label"), F.lit("Item").alias("type"))
    return B.forge_recipe(found, "My forge table", ["Part"]).unionByName(B.forge_recipe(found, "plain", ["Part"]))


@query(
    "column_pairs",
    """with t as (select * from (values (0, 'Precursor', 'PrecursorWeapon'), (1, 'Step', 'CollectionStep'), (2, 'Qty', 'IngredientQuantity'), (3, 'Merchant', 'NPCVendor'), (4, 'Where', 'Zone'), (5, 'Craft', 'CraftingDiscipline'), (6, 'Token', 'Currency'), (7, 'Part', 'ComponentItem')) v(i, h, t)),
p as (select a.i as ai, a.h as ah, a.t as ta, b.i as bi, b.h as bh, b.t as tb, a.t in ('PrecursorWeapon', 'ComponentItem') as item_a, b.t in ('PrecursorWeapon', 'ComponentItem') as item_b, a.t = 'PrecursorWeapon' as main from t a join t b on a.i <> b.i),
r as (select *, case when item_a and tb = 'IngredientQuantity' then case when ai < bi and bi - ai <= 2 then 'ingredientQuantity' else 'none' end when main and item_b and ai < bi then 'requiresIngredient' when main and tb = 'CollectionStep' then 'requiresIngredient.'
 when main and tb = 'CraftingDiscipline' then 'craftedByDiscipline' when main and tb = 'NPCVendor' then 'obtainedFromVendor' when ta = 'NPCVendor' and tb = 'Zone' then 'locatedInZone' when item_a and tb = 'Currency' then 'costsCurrency' when ta = 'Zone' and tb = 'Currency' then 'urn:best' end as prop from p)
select ah as source, bh as target, rtrim(prop, '.') as property, case prop when 'ingredientQuantity' then 0.95 when 'requiresIngredient' then 0.92 when 'requiresIngredient.' then 0.90 when 'craftedByDiscipline' then 0.95 when 'obtainedFromVendor' then 0.92 when 'locatedInZone' then 0.98 when 'costsCurrency' then 0.95 else 0.88 end::double as confidence from r where prop <> 'none'""",
)
def column_pairs(spark, sf_dir):
    more = spark.createDataFrame([("Zone", "Currency", "urn:other", 0.8), ("Zone", "Currency", "urn:best", 0.88), ("PrecursorWeapon", "NPCVendor", "urn:never", 0.99)], "source_type string, target_type string, property string, confidence double")
    return A.column_pairs(_typed_columns(spark), more).select("source", "target", "property", "confidence")


def _fused(spark, sf_dir) -> DataFrame:
    """Parts as a table's entities, every other one of them in a text too, under its IRI or only its label; rows have attributes."""
    part = table(spark, sf_dir, "part")
    iri = F.concat(F.lit("urn:part:"), "p_partkey")
    cells = part.select(F.col("p_partkey").alias("row_id"), iri.alias("iri"), F.concat_ws(" ", "p_name", "p_partkey").alias("label"), F.when(F.col("p_size") % 10 == 0, "PrecursorWeapon").when(F.col("p_size") % 10 == 1, "NPCVendor").otherwise("Item").alias("type"), F.lit(0.9).alias("confidence"))
    said = part.filter("p_partkey % 2 = 0").select(F.when(F.col("p_partkey") % 4 == 0, iri).otherwise(F.concat(F.lit("urn:text:"), "p_partkey")).alias("uri"), F.upper(F.concat_ws(" ", "p_name", "p_partkey")).alias("label"), F.lit("Item").alias("type"), (F.col("p_size") % 7 + 1).alias("occurrences"))
    alone = part.select(F.concat(F.lit("urn:alone:"), "p_partkey").alias("uri"), F.concat(F.lit("alone "), "p_partkey").alias("label"), F.lit("Item").alias("type"), F.lit(2).alias("occurrences"))
    none = lambda t: F.lit(None).cast(t)
    attributes = part.select(F.col("p_partkey").alias("row_id"), (F.col("p_size") - 5).cast("long").alias("quantity"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).alias("vendor"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_type")).alias("zone"), F.when(F.col("p_partkey") % 7 == 0, "chef").alias("discipline"), none("long").alias("min_rating"), F.when(F.col("p_partkey") < 40, F.col("p_partkey")).cast("long").alias("tier"))
    return U.triangulate(cells, said.unionByName(alone), attributes, "anvil")


_FUSED = """c as (select p_partkey as k, p_name || ' ' || p_partkey as label, case when p_size % 10 = 0 then 'PrecursorWeapon' when p_size % 10 = 1 then 'NPCVendor' else 'Item' end as type, least(1.0::double, 0.9::double + case when contains(p_name, 'anvil') then 0.05::double else 0.02::double end) as c_tab,
 case when p_partkey % 2 = 0 then (p_size % 7 + 1)::bigint end as n, p_size - 5::bigint as quantity, case when p_partkey % 3 = 0 then p_brand end as vendor, case when p_partkey % 5 = 0 then p_type end as zone, case when p_partkey % 7 = 0 then 'chef' end as discipline, case when p_partkey < 40 then p_partkey end as tier from part),
t as (select *, case when n is null then 0.0::double else 0.85::double + least(0.10::double, 0.02::double * n) end as c_txt from c),
fused as (select 'urn:part:' || k as uri, label, type, c_tab, c_txt, least(1.0::double, case when c_txt > 0 then 1 - (1 - c_tab) * (1 - c_txt) else c_tab end + 0.05::double) as c_fused, case when n is null then 'table_only' else 'cross_modal_corroborated' end as provenance, coalesce(n, 0) as occurrences, quantity, vendor, zone, discipline, tier from t
union all select 'urn:alone:' || p_partkey, 'alone ' || p_partkey, 'Item', 0.0::double, 0.86::double, 0.91::double, 'text_only', 2, null, null, null, null, null from part)"""


@query("triangulate_parts", f"with {_FUSED} select uri, label, type, round(c_tab, 6) as c_tab, round(c_txt, 6) as c_txt, round(c_fused, 6) as c_fused, provenance, occurrences, quantity, vendor, zone, discipline, tier from fused")
def triangulate_parts(spark, sf_dir):
    out = _fused(spark, sf_dir).drop("min_rating").withColumn("occurrences", F.col("occurrences").cast("long"))
    return out.withColumns({c: F.round(c, 6) for c in ("c_tab", "c_txt", "c_fused")})


@query(
    "fused_triples",
    f"""with {_FUSED}, p as (select * from fused where type = 'PrecursorWeapon'), s as (
select label as subject, 'craftedByDiscipline' as predicate, 'Chef' as object, 'attribute' as hop from fused where discipline is not null union all select label, 'locatedInZone', zone, 'attribute' from fused where type = 'NPCVendor' and zone is not null
union all select label, 'ingredientQuantity', quantity::varchar, 'attribute' from fused where quantity > 0 union all select label, 'obtainedFromVendor', vendor, 'multi_hop' from fused where vendor is not null and zone is not null
union all select vendor, 'locatedInZone', zone, 'multi_hop' from fused where vendor is not null and zone is not null
union all select * from (select label, 'precursorTo', lead(label) over (order by tier, uri) as after, 'tier' from p where tier is not null) where after is not null
union all select a.label, 'precursorTo', b.label, 'fact' from p a join fused b on a.uri = 'urn:part:' || (regexp_extract(b.uri, '[0-9]+$')::int - 1) and b.uri like 'urn:part:%')
select subject, predicate, object, min(hop) as hop from s group by all""",
)
def fused_triples(spark, sf_dir):
    facts = table(spark, sf_dir, "part").select(F.concat(F.lit("urn:part:"), F.col("p_partkey") - 1).alias("s"), F.lit("precursorTo").alias("p"), F.concat(F.lit("urn:part:"), "p_partkey").alias("o"))
    return U.fused_triples(_fused(spark, sf_dir), facts)


@query(
    "confidence_summary",
    f"""with {_FUSED}, s as (select count(*) as n_entities, count(*) filter (provenance = 'cross_modal_corroborated') as n_cross, count(*) filter (provenance = 'table_only') as n_table, count(*) filter (provenance = 'text_only') as n_text,
avg(c_fused) as f, avg(c_tab) filter (c_tab > 0) as t, avg(c_txt) filter (c_txt > 0) as x from fused) select n_entities, n_cross, n_table, n_text, round(f, 4) as avg_fused, round(t, 4) as avg_tab, round(x, 4) as avg_txt, round((f - greatest(t, x)) * 100, 2) as gain_pct from s""",
)
def confidence_summary(spark, sf_dir):
    return U.confidence_summary(_fused(spark, sf_dir))


# ---- search texts and scores

@query(
    "entity_texts",
    """select 'urn:part:' || p_partkey as iri, '[Individual] ' || p_type || '_' || p_brand || ' (urn:part:' || p_partkey || ')' || case when p_size % 2 = 0 then '. Description: ' || p_name else '' end
|| '. Synonyms: ' || case when p_size % 3 = 0 then p_name || ', ' else '' end || p_type || ' ' || p_brand || '. Type: Part' || '.' as text from part""",
)
def entity_texts(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    item = lambda **k: S._items(part, **k)
    items = item(kind=F.lit("Individual"), iri=F.concat(F.lit("urn:part:"), "p_partkey"), label=F.concat_ws("_", "p_type", "p_brand"), aliases=F.when(F.col("p_size") % 3 == 0, F.array("p_name")), types=F.array(F.lit("urn:kind/Part")), description=F.when(F.col("p_size") % 2 == 0, F.col("p_name")))
    return S.SearchIndex(items).texts().select("iri", "text")


@query(
    "benchmark_summary",
    "select o_orderpriority as model, count(*) as n_tables, round(avg(o_totalprice), 4) as avg_cea, round(avg(o_orderkey % 7), 6) as avg_cta, round(avg(o_orderkey % 5), 6) as avg_cpa_f1, 1.0::double as avg_validity, sum(o_custkey)::bigint as total_violations from orders group by all",
)
def benchmark_summary(spark, sf_dir):
    scores = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("model"), F.col("o_totalprice").alias("cea_accuracy"), (F.col("o_orderkey") % 7).alias("cta_accuracy"), (F.col("o_orderkey") % 5).alias("cpa_f1"), F.lit(1.0).alias("validity"), F.col("o_custkey").alias("violations"))
    return benchmark.summary(scores).withColumns({"avg_cea": F.round("avg_cea", 4), "avg_cta": F.round("avg_cta", 6), "avg_cpa_f1": F.round("avg_cpa_f1", 6)})
