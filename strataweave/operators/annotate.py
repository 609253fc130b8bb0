"""A table annotated for a mesh: cells to entities, columns to classes, column pairs to properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.normalize import local_name
from strataweave.operators.mesh import parts
from strataweave.operators.ontology import closure, class_edges
from strataweave.operators.proposals import _first, _holds
from strataweave.operators.retrieval import hybrid_search
from strataweave.rules import DEFAULT, Rules, headers

#: Scores from which a found entity counts, a header's agreement lifts one to, and a minted one gets.
LEAST, AGREED, MINTED = 0.70, 0.95, 0.85
# The header word that each kind of compound part is matched under.
PART_HEADERS = {"discipline": "discipline", "vendor": "vendor", "currency": "currency"}
PART_TYPES = {"discipline": "CraftingDiscipline", "vendor": "NPCVendor", "currency": "Currency"}


def is_entity(value: Column, header: Column) -> Column:
    """Whether a cell can name an entity: not blank, punctuation, a truth value or a number, nor digits under a header of numbers."""
    v = F.trim(value)
    return v.rlike(r"[\p{L}\p{N}]") & ~F.lower(v).isin("true", "false") & ~v.rlike(r"^[+-]?(?:\p{Nd}+\.?\p{Nd}*|\.\p{Nd}+)(?:[eE][+-]?\p{Nd}+)?$") & ~(_holds(header, headers.NUMBERS) & v.rlike(r"\p{Nd}"))


def slug(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(value, r"(?U)[^\w\s-]", ""))), " ", "_")


def match_cells(cells: DataFrame, entities: DataFrame, namespace: str) -> DataFrame:
    """cells(header, value, ..) -> also iri, label, type, confidence; cells that name no entity go.

    Headers of tiers and steps settle their cells. Others are searched once per distinct value; the best hit counts from
    LEAST on, lifted where its type agrees with the header; else an IRI of the kind the header tells is minted.
    entities: (iri, label, aliases, types), a dimension.
    """
    rows = cells.filter(is_entity(F.col("value"), F.col("header"))).withColumn("_v", F.trim("value"))
    is_tier = _holds(F.col("header"), ("tier",)) | F.lower("_v").startswith("tier")
    is_step = _holds(F.col("header"), ("step", "journey"))
    searched = rows.filter(~is_tier & ~is_step).select(F.col("_v").alias("query")).distinct()
    best = hybrid_search(searched, entities, 1).select(F.col("query").alias("_v"), F.col("iri").alias("_iri"), F.col("label").alias("_label"), local_name(F.get("types", F.lit(0))).alias("_type"), F.col("score").alias("_score"))
    rows = rows.join(best, "_v", "left").withColumn("_type", F.coalesce("_type", F.lit("Item")))
    low = F.lower("_type")
    agrees = F.lit(False)
    for words, kinds in headers.AGREEING:
        agrees = agrees | (_holds(F.col("header"), words) & F.greatest(*(F.instr(low, k) for k in kinds), F.lit(0)).cast("boolean"))
    score = F.when(agrees, F.greatest("_score", F.lit(AGREED))).otherwise(F.col("_score"))
    ref = lambda kind: F.concat(F.lit(f"{namespace}ref/{kind}/"), slug(F.col("_v")))
    hit = lambda iri, label, typ, conf: F.struct(iri.alias("iri"), label.alias("label"), typ.alias("type"), conf.cast("double").alias("confidence"))
    minted = [(_holds(F.col("header"), words), hit(ref(kind.lower()), F.col("_v"), F.lit(kind), F.lit(MINTED))) for words, kind in headers.MINTED]
    fallback = _first(minted, hit(F.concat(F.lit(f"{namespace}id/item/"), slug(F.col("_v"))), F.col("_v"), F.lit(headers.MINTED_ELSE), F.lit(MINTED)))
    found = (
        F.when(is_tier, hit(ref("tier"), F.col("_v"), F.lit("CollectionTier"), F.lit(0.95)))
        .when(is_step, hit(ref("step"), F.col("_v"), F.lit("CollectionStep"), F.lit(0.95)))
        .when(score >= LEAST, hit(F.col("_iri"), F.col("_label"), F.col("_type"), F.least(F.lit(1.0), score)))
        .otherwise(fallback)
    )
    return rows.withColumn("m", found).select(*cells.columns, "m.iri", "m.label", "m.type", "m.confidence")


def cell_entities(cells: DataFrame, entities: DataFrame, namespace: str, rules: Rules = DEFAULT) -> DataFrame:
    """cells(row_id, ordinal, header, value) -> (row_id, ordinal, pos, header, value, kind, quantity, iri, label, type, confidence).

    Compound cells are taken apart: a part of a known kind is matched under that kind's header, and a seller's place
    under "zone" beside it.
    """
    apart = parts(cells.select("row_id", F.col("ordinal").alias("col"), "value"), rules).join(F.broadcast(cells.select(F.col("ordinal").alias("col"), "header").distinct()), "col")
    under = F.coalesce(*(F.when(F.col("kind") == k, F.lit(h)) for k, h in PART_HEADERS.items()), F.col("header"))
    own = apart.select("row_id", F.col("col").alias("ordinal"), "pos", F.col("header").alias("column"), under.alias("header"), F.col("name").alias("value"), "kind", "quantity")
    zones = apart.filter("zone is not null").select("row_id", F.col("col").alias("ordinal"), (F.col("pos") + 1).alias("pos"), F.col("header").alias("column"), F.lit("zone").alias("header"), F.col("zone").alias("value"), F.lit("zone").alias("kind"), F.lit(None).cast("double").alias("quantity"))
    out = match_cells(own.unionByName(zones), entities, namespace)
    typed = F.coalesce(*(F.when(F.col("kind") == k, F.lit(t)) for k, t in (PART_TYPES | {"zone": "Zone"}).items()), F.col("type"))
    return out.select("row_id", "ordinal", "pos", F.col("column").alias("header"), "value", "kind", "quantity", "iri", "label", typed.alias("type"), "confidence")


def column_classes(columns: DataFrame, found: DataFrame, triples: DataFrame, known: DataFrame) -> DataFrame:
    """columns(ordinal, header), cell_entities, class triples and known(iri, label, aliases, types) classes -> (ordinal, header, type,
    confidence): by the header's words, else the types' deepest common ancestor, else their most frequent one but Item,
    else a class like the header, else Item. Types are counted per column first; what follows is as small as the header."""
    settled = _first([(_holds(F.col("header"), words) & ~((F.lit(kind) == "NPCVendor") & _holds(F.col("header"), ("zone", "zn"))), F.struct(F.lit(kind).alias("type"), F.lit(conf).alias("confidence"))) for words, kind, conf in headers.MESH_TYPES], F.lit(None))
    counts = found.groupBy("ordinal", "type").agg(F.count("*").alias("n"))
    modal = counts.filter("type <> 'Item'").groupBy("ordinal").agg(F.min(F.struct((-F.col("n")).alias("o"), "type")).alias("m")).select("ordinal", F.col("m.type").alias("modal"))
    up = closure(class_edges(triples), reflexive=True).select(local_name(F.col("child")).alias("type"), local_name(F.col("ancestor")).alias("ancestor")).distinct()
    depth = up.groupBy("type").agg(F.count("*").alias("depth")).withColumnRenamed("type", "ancestor")
    wanted = counts.groupBy("ordinal").agg(F.count("*").alias("wanted"))
    met = counts.join(up, "type", "left").withColumn("ancestor", F.coalesce("ancestor", "type")).groupBy("ordinal", "ancestor").agg(F.count_distinct("type").alias("n")).join(wanted, "ordinal").filter("n = wanted")
    met = met.filter(~F.col("ancestor").isin("Thing", "Item", "Entity")).join(depth, "ancestor", "left")
    lcs = met.groupBy("ordinal").agg(F.min(F.struct((-F.coalesce("depth", F.lit(1))).alias("o"), "ancestor")).alias("m")).select("ordinal", F.col("m.ancestor").alias("lcs"))
    like = hybrid_search(columns.select(F.lower(F.trim("header")).alias("query")), known, 1).filter(F.col("score") >= LEAST).select(F.col("query").alias("_q"), local_name(F.col("iri")).alias("like"), F.col("score").alias("like_score"))
    rows = columns.select("ordinal", "header").withColumn("s", settled).join(lcs, "ordinal", "left").join(modal, "ordinal", "left").join(like, F.lower(F.trim("header")) == F.col("_q"), "left")
    one = lambda t, c: F.struct(t.alias("type"), c.cast("double").alias("confidence"))
    said = F.when(F.col("s").isNotNull(), one(F.col("s.type"), F.col("s.confidence"))).when(F.col("lcs").isNotNull(), one(F.col("lcs"), F.lit(0.92))).when(F.col("modal").isNotNull(), one(F.col("modal"), F.lit(0.90)))
    said = said.when(F.col("like").isNotNull(), one(F.col("like"), F.col("like_score"))).otherwise(one(F.lit("Item"), F.lit(0.85)))
    return rows.select("ordinal", "header", said.alias("t")).select("ordinal", "header", "t.*")


# Parts of a type's name that make it an item; types and header words that make a column a row's main one.
ITEM_WORDS = ("item", "weapon", "component", "material", "tribute", "gift", "armor", "trinket")
MAIN_TYPES, MAIN_WORDS = ("PrecursorWeapon", "LegendaryWeapon", "Item"), ("precursor", "item", "hope", "bifrost", "ingred")


def column_pairs(typed: DataFrame, compatible: DataFrame | None = None) -> DataFrame:
    """column_classes -> (source, target, source_type, target_type, property, confidence) of ordered pairs of columns with a header.

    Rules by the two types and the columns' order; pairs that none fits take a property from compatible(source_type,
    target_type, property, confidence), if given. Pairs of columns are as few as a header is wide, squared.
    """
    side = lambda x: typed.filter(F.trim("header") != "").select(*(F.col(c).alias(f"{x}_{c}") for c in ("ordinal", "header", "type")))
    pairs = F.broadcast(side("a")).join(F.broadcast(side("b")), F.col("a_ordinal") != F.col("b_ordinal"))
    has = lambda c, *words: F.greatest(*(F.instr(F.lower(c), w) for w in words), F.lit(0)) > 0
    a_item, b_item = has("a_type", *ITEM_WORDS), has("b_type", *ITEM_WORDS)
    main = F.col("a_type").isin(*MAIN_TYPES) | has("a_header", *MAIN_WORDS)
    before, gap = F.col("a_ordinal") < F.col("b_ordinal"), F.col("b_ordinal") - F.col("a_ordinal")
    is_quantity = a_item & (F.col("b_type") == "IngredientQuantity")
    say = lambda p, c: F.struct(F.lit(p).alias("property"), F.lit(c).alias("confidence"))
    found = (
        F.when(is_quantity, F.when(before & (gap <= 2), say("ingredientQuantity", 0.95)))
        .when(main & b_item & before, say("requiresIngredient", 0.92))
        .when(main & (F.col("b_type") == "CollectionStep") & before, say("requiresIngredient", 0.90))
        .when(main & has("b_type", "discipline"), say("craftedByDiscipline", 0.95))
        .when(main & has("b_type", "vendor"), say("obtainedFromVendor", 0.92))
        .when(has("a_type", "vendor") & has("b_type", "zone"), say("locatedInZone", 0.98))
        .when(a_item & (F.col("b_type") == "Currency"), say("costsCurrency", 0.95))
    )
    out = pairs.withColumn("p", found).withColumn("open", ~is_quantity & F.col("p").isNull())
    if compatible is not None:
        order = Window.partitionBy("source_type", "target_type").orderBy(F.col("confidence").desc(), "property")
        best = compatible.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select(F.col("source_type").alias("a_type"), F.col("target_type").alias("b_type"), F.struct("property", "confidence").alias("c"))
        out = out.join(best, ["a_type", "b_type"], "left").withColumn("p", F.coalesce("p", F.when(F.col("open"), F.col("c"))))
    return out.filter("p is not null").select(F.col("a_header").alias("source"), F.col("b_header").alias("target"), F.col("a_type").alias("source_type"), F.col("b_type").alias("target_type"), "p.property", "p.confidence")
