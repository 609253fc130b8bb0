"""The relational mesh of a table: nodes and typed edges from plain and compound cells. Facts that are made up to satisfy
shapes come from a stage of their own and say so."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.cells import clean_text, decompose_cell
from strataweave.rules import DEFAULT, Rules

MINT = "urn:strataweave:id/"
# The edge a part of a cell makes from its row's target, by the part's kind.
EDGE = {"ingredient": "requiresIngredient", "name": "relatesTo", "currency": "costs", "discipline": "craftedByDiscipline", "vendor": "soldBy"}


def parts(cells: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """cells(row_id, col, value) -> (row_id, col, pos, kind, name, quantity, rating, zone), a row per part of a compound cell."""
    apart = cells.select("row_id", "col", F.posexplode(decompose_cell(clean_text(F.col("value")), rules)).alias("pos", "p"))
    return apart.select("row_id", "col", "pos", "p.*").filter("name <> ''")


def link(apart: DataFrame, entities: DataFrame) -> DataFrame:
    """parts with entities(label, iri, type) -> also iri, type, provenance: matched by lower-case label, else minted."""
    known = entities.groupBy(F.lower(F.trim("label")).alias("k")).agg(F.min(F.struct("iri", "type")).alias("e"))
    out = apart.withColumn("k", F.lower(F.trim("name"))).join(known, "k", "left")
    slug = F.regexp_replace(F.regexp_replace("k", "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return out.select("row_id", "col", "pos", "kind", "name", "quantity", "rating", "zone", F.coalesce("e.iri", F.concat(F.lit(MINT), slug)).alias("iri"), F.coalesce("e.type", F.initcap("kind")).alias("type"), F.when(F.col("e").isNull(), "minted").otherwise("matched").alias("provenance"))


def nodes(linked: DataFrame) -> DataFrame:
    """(iri, label, type, provenance, n_mentions); zones of vendors are nodes too."""
    zones = linked.filter("zone is not null").select(F.concat(F.lit(MINT), F.regexp_replace(F.lower("zone"), "[^a-z0-9]+", "_")).alias("iri"), F.col("zone").alias("label"), F.lit("Zone").alias("type"), F.lit("minted").alias("provenance"))
    every = linked.select("iri", F.col("name").alias("label"), "type", "provenance").unionByName(zones)
    return every.groupBy("iri").agg(F.min("label").alias("label"), F.min("type").alias("type"), F.min("provenance").alias("provenance"), F.count("*").alias("n_mentions"))


def edges(linked: DataFrame, target_types: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, s, p, o, quantity, provenance): from each row's target - a node of the first target type, else its first - to its parts."""
    rank = F.coalesce(*(F.when(F.col("type") == t, F.lit(i)) for i, t in enumerate(target_types)), F.lit(len(target_types)))
    order = Window.partitionBy("row_id").orderBy(rank, "col", "pos")
    ranked = linked.withColumn("_r", F.row_number().over(order))
    head = ranked.filter("_r = 1").select("row_id", F.col("iri").alias("s"))
    name = F.create_map(*(F.lit(x) for kv in EDGE.items() for x in kv))
    rest = ranked.filter("_r > 1").join(head, "row_id").filter("iri <> s")
    own = rest.select("row_id", "s", name[F.col("kind")].alias("p"), F.col("iri").alias("o"), "quantity", F.lit("table").alias("provenance"))
    zone = linked.filter("zone is not null").select("row_id", F.col("iri").alias("s"), F.lit("locatedInZone").alias("p"), F.concat(F.lit(MINT), F.regexp_replace(F.lower("zone"), "[^a-z0-9]+", "_")).alias("o"), F.lit(None).cast("double").alias("quantity"), F.lit("table").alias("provenance"))
    return own.unionByName(zone)


def repair(mesh: DataFrame) -> DataFrame:
    """Edges to ingredients without a quantity get 1, marked synthesized."""
    lacks = (F.col("p") == "requiresIngredient") & F.col("quantity").isNull()
    return mesh.withColumn("provenance", F.when(lacks, "synthesized").otherwise(F.col("provenance"))).withColumn("quantity", F.when(lacks, 1.0).otherwise(F.col("quantity")))


# Node types and header words of the groups that a row's nodes are bound by; what binds a group's nodes to which.
ROLE_GROUPS = {
    "main": (("PrecursorWeapon",), ()),
    "item": (("ComponentItem", "CraftingMaterial", "Item", "TrophyItem", "GiftItem"), ()),
    "discipline": (("CraftingDiscipline",), ("discipline", "craft", "prof")),
    "vendor": (("NPCVendor",), ("vendor", "source", "npc")),
    "zone": (("Zone",), ("zone", "loc", "place", "where")),
    "quantity": (("IngredientQuantity",), ("qty", "quant", "cost", "count", "amount")),
    "rating": (("DisciplineRating",), ("rating", "minrating", "level")),
}
BINDINGS = (("main", "craftedByDiscipline", "discipline"), ("main", "requiresIngredient", "item"), ("main", "obtainedFromVendor", "vendor"), ("main", "requiresDisciplineRating", "rating"), ("vendor", "locatedInZone", "zone"), ("item", "ingredientQuantity", "quantity"), ("item", "obtainedFromVendor", "vendor"))
NUMBERED = ("requiresDisciplineRating", "ingredientQuantity")


def bind_roles(found: DataFrame) -> DataFrame:
    """found(row_id, ordinal, header, value, iri, type, column_type) -> distinct (row_id, s, p, o, o_kind): a row's nodes by role.

    A node belongs to a group by its type, its column's or its header; numbers go in as literals of their first digits. A
    row is as wide as its table, so its pairs are few.
    """
    low = F.lower("header")
    groups = F.array_compact(F.array(*(F.when(F.col("type").isin(*types) | F.col("column_type").isin(*types) | (F.greatest(*(F.instr(low, w) for w in words), F.lit(0)) > 0 if words else F.lit(False)), F.lit(g)) for g, (types, words) in ROLE_GROUPS.items())))
    rows = found.select("row_id", "ordinal", "value", "iri", F.explode(groups).alias("grp"))
    rules = F.array(*(F.struct(F.lit(a).alias("grp"), F.lit(p).alias("p"), F.lit(b).alias("to")) for a, p, b in BINDINGS))
    left = rows.select("row_id", F.col("ordinal").alias("i"), F.col("iri").alias("s"), F.explode(F.filter(rules, lambda r: r["grp"] == F.col("grp"))).alias("r")).select("row_id", "i", "s", "r.p", "r.to")
    right = rows.select("row_id", F.col("ordinal").alias("j"), F.col("iri").alias("to_iri"), "value", F.col("grp").alias("to"))
    number = F.nullif(F.regexp_extract("value", "[0-9]+", 0), F.lit(""))
    numbered = F.col("p").isin(*NUMBERED)
    out = left.join(right, ["row_id", "to"]).withColumn("o", F.when(numbered, number).otherwise(F.col("to_iri")))
    return out.filter("o is not null and s <> o").select("row_id", "s", "p", "o", F.when(numbered, "literal").otherwise("iri").alias("o_kind")).distinct()


def forge_recipe(found: DataFrame, name: str, headers: list[str], namespace: str = MINT) -> DataFrame:
    """(s, p, o): a recipe named after the table with its first four items, if the table or a header speaks of a forge."""
    speaks = any("forge" in h.lower() or "slot" in h.lower() for h in headers) or "forge" in name.lower() or "tribute" in name.lower()
    wanted = F.col("type").isin("PrecursorWeapon", "ComponentItem", "CraftingMaterial", "Item") & ~F.lower("label").startswith("slot") & F.lit(speaks)
    first = found.filter(wanted).groupBy("iri").agg(F.min(F.struct("row_id", "ordinal", "pos")).alias("at")).orderBy("at").limit(4)  # a forge has four slots
    tidy = "".join(c if c.isalnum() else "_" for c in name).strip("_").lower()
    return first.select(F.lit(f"{namespace}{tidy}_forge").alias("s"), F.lit("requiresIngredient").alias("p"), F.col("iri").alias("o"))
