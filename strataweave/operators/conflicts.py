"""Checks of a table's reading against an ontology, each a filter or an anti-join; their findings are rows of one shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.operators.ontology import _settled
from strataweave.operators.retrieval import dimension

#: Ingredients that a forge recipe takes.
FORGE_INPUTS = 4
#: Steps from a product to an intermediate component of it.
COMPONENT_DEPTH = 4
SHAPE = ("kind", "severity", "row_id", "ordinal", "offending")


def _finding(rows: DataFrame, kind: str, severity: str, offending: str, row: bool = True, column: bool = False) -> DataFrame:
    none = lambda t: F.lit(None).cast(t)
    return rows.select(
        F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), (F.col("row_id").cast("string") if row else none("string")).alias("row_id"),
        (F.col("ordinal").cast("int") if column else none("int")).alias("ordinal"), F.col(offending).cast("string").alias("offending"),
    )


def column_type_conflicts(found: DataFrame, known: DataFrame, disjoint: DataFrame) -> DataFrame:
    """mentions(row_id, ordinal, name, column_type), known(label, type), disjoint(a, b) -> cells of a known type that is disjoint
    from their column's."""
    types = known.groupBy(F.col("label").alias("name")).agg(F.min("type").alias("known_type"))
    pairs = disjoint.select(F.col("a").alias("column_type"), F.col("b").alias("known_type")).distinct()
    return _finding(found.join(types, "name").join(pairs, ["column_type", "known_type"], "left_semi"), "TYPE_INCOMPATIBILITY", "ERROR", "name", column=True)


def range_conflicts(relations: DataFrame, known: DataFrame, ranges: DataFrame, up: DataFrame) -> DataFrame:
    """relations(row_id, predicate, object), ranges(predicate, range), up(child, ancestor) -> objects of a type outside the
    predicate's ranges. A predicate without a range, or with Item in it, takes anything; an unknown object is an Item."""
    types = known.groupBy(F.col("label").alias("object")).agg(F.min("type").alias("type"))
    limits = ranges.groupBy("predicate").agg(F.collect_set("range").alias("ranges"))
    above = up.groupBy(F.col("child").alias("type")).agg(F.collect_set("ancestor").alias("above"))
    rows = relations.join(limits.filter(~F.array_contains("ranges", "Item")), "predicate").join(types, "object", "left").withColumn("type", F.coalesce("type", F.lit("Item")))
    rows = rows.join(above, "type", "left").withColumn("above", F.array_append(F.coalesce("above", F.array().cast("array<string>")), F.col("type")))
    return _finding(rows.filter(~F.arrays_overlap("above", "ranges")), "RANGE_VIOLATION", "ERROR", "object")


def forge_conflicts(relations: DataFrame, table_type: str) -> DataFrame:
    """One finding if a forge recipe names more ingredients than a forge takes."""
    used = relations.filter(F.col("predicate").isin("requiresMaterial", "hasIngredient")).agg(F.count("*").alias("n")).filter((F.col("n") > FORGE_INPUTS) & F.lit(table_type == "MysticForgeRecipe"))
    return _finding(used, "CARDINALITY_VIOLATION", "ERROR", "n", row=False)


def quantity_conflicts(relations: DataFrame) -> DataFrame:
    return _finding(relations.filter("quantity <= 0"), "CARDINALITY_VIOLATION", "ERROR", "quantity")


def components(triples: DataFrame, products: DataFrame, ingredient: tuple[str, ...], output: tuple[str, ...] = (), depth: int = COMPONENT_DEPTH, parts: DataFrame | None = None) -> DataFrame:
    """products(uri) -> (uri, component, distance): what a product is made of, ``depth`` steps down at most (the search's own
    bound), by ingredients of its own or of a recipe that puts it out. A frontier join per step; a component met before
    is not followed again, so cycles end. With parts(component), only those are looked for: the search then goes from them
    up to the products, and touches nothing that they are not in."""
    edges = triples.filter(F.col("p").isin(*ingredient) & (F.col("o_kind") == "iri")).select(F.col("s").alias("x"), F.col("o").alias("y"))
    if output:
        recipes = triples.filter(F.col("p").isin(*output) & (F.col("o_kind") == "iri")).select(F.col("s").alias("x"), F.col("o").alias("made"))
        edges = edges.unionByName(edges.join(recipes, "x").select(F.col("made").alias("x"), "y")).distinct()
    edges = _settled(edges)  # every step reads them
    if parts is not None:
        met = _reached(parts.select(F.col("component").alias("uri")), edges.toDF("y", "x"), depth).toDF("component", "uri", "distance")
        return met.join(products.select("uri").distinct(), "uri", "left_semi").select("uri", "component", "distance")
    return _reached(products, edges, depth)


def _reached(start: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """start(uri), edges(x, y) -> (uri, component, distance) of what is reached from it in 1 to ``depth`` steps, at its first."""
    here = start.select("uri", F.col("uri").alias("component")).distinct()
    out = here.withColumn("distance", F.lit(0))
    for step in range(1, depth + 1):
        there = here.join(edges, F.col("component") == F.col("x")).select("uri", F.col("y").alias("component")).distinct()
        here = _settled(there.join(out.select("uri", "component"), ["uri", "component"], "left_anti"))
        out = out.unionByName(here.withColumn("distance", F.lit(step)))
        # The last thing reached has often no edge of its own: its rows are not shuffled to find that out.
        if step < depth and here.select("component").distinct().join(edges, F.col("component") == F.col("x"), "left_semi").isEmpty():
            break
    return out.filter("distance > 0")


def named_alike(subject: DataFrame, named: DataFrame) -> DataFrame:
    """subject(name), named(uri, label) -> (component, own): what has the subject's name; the few subjects are broadcast."""
    key = lambda c: F.lower(F.trim(c))
    return named.select(F.col("uri").alias("component"), key("label").alias("own")).join(dimension(subject.select(key("name").alias("own"))), "own").select("component", "own")


def subject_conflicts(subject: DataFrame, found: DataFrame, made_of: DataFrame, named: DataFrame) -> DataFrame:
    """subject(name), mentions(name), made_of as from components, named(uri, label) -> the subject, where it is a component of
    something the table mentions: a warning that names the product. Joined from the subject's side, which is the smallest."""
    key = lambda c: F.lower(F.trim(c))
    met = made_of.select("uri", "component").join(dimension(named_alike(subject, named)), "component").select("uri", "own").distinct()
    met = named.select("uri", key("label").alias("k")).join(dimension(met), "uri").filter("k <> own").select("k").distinct()
    met = found.select(F.col("name").alias("product"), key("name").alias("k")).join(dimension(met), "k").agg(F.min("product").alias("product")).filter("product is not null")
    return _finding(met, "SLOT_MISMATCH", "WARNING", "product", row=False)


def conflicts(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
