"""Table -> triples, end to end: profile, resolve, anchor, emit, report, validate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.operators import emit as E
from strataweave.operators import ontology as O
from strataweave.operators import predicate as P
from strataweave.operators.profile import cells, column_roles, column_stats

#: A first vote needs this confidence; a second look at an outlier column must reach that one.
VOTE, ACCEPT = 0.70, 0.55


@dataclass
class Context:
    """What is known of a table's columns before its rows are read: a few rows per column."""

    columns: DataFrame
    predicates: DataFrame
    primary: str | None
    majority: str | None
    sibling: DataFrame
    links: list[tuple[str, str]]


def analyze(table: DataFrame, row_id: str, triples: DataFrame, arbiter=None) -> Context:
    """Roles, predicates with a majority-domain second look, anchors and links. Everything after the one aggregate pass
    over the table is as small as its header."""
    spark = table.sparkSession
    stats = column_stats(table.drop(row_id))
    columns = spark.createDataFrame(column_roles(stats).collect(), column_roles(stats).schema)
    properties = P.small(O.properties(triples))
    asked = columns.filter("role <> 'Skip'")
    first = P.small(P.resolve(asked, properties, arbiter=arbiter))
    votes = first.filter(F.col("confidence") >= VOTE).select(F.explode("domains").alias("d")).groupBy("d").count().orderBy(F.col("count").desc(), "d").head(1)
    majority = votes[0].d if votes else None
    predicates = first
    if majority is not None:
        odd = first.filter((F.size("domains") > 0) & ~F.array_contains("domains", majority)).select("column_name")
        if odd.limit(1).count():
            again = P.resolve(asked.join(odd, "column_name", "left_semi"), properties, majority, arbiter).alias("n")
            better = again.join(first.select("column_name", F.col("confidence").alias("was")), "column_name").filter((F.col("confidence") >= ACCEPT) & (F.array_contains("domains", majority) | (F.col("confidence") >= F.col("was")))).drop("was")
            predicates = first.join(better.select("column_name"), "column_name", "left_anti").unionByName(better)
    primary = next((r.column_name for r in columns.filter("role = 'Entity ID'").orderBy("ordinal").select("column_name").head(1)), None)
    predicates = P.small(predicates)
    pairs = P.small(E.anchors(columns, primary))
    sibling = E.sibling_anchor(pairs)
    domains = pairs.join(predicates.select(F.col("column_name").alias("sibling"), F.explode_outer("domains").alias("d")), "sibling", "left").groupBy("anchor", "prefix").agg(F.min("d").alias("anchor_domain"))
    links = [(r.anchor, r.link_uri) for r in E.link_property(domains, properties, majority).orderBy("anchor").collect()]
    return Context(columns, predicates, primary, majority, sibling, links)


def table_to_triples(table: DataFrame, row_id: str, triples: DataFrame, arbiter=None) -> DataFrame:
    """The whole path. The table is scanned for its profile, for the distinct values of its categorical columns, and to emit."""
    ctx = analyze(table, row_id, triples, arbiter)
    open_roles = [r.column_name for r in ctx.columns.filter("role = 'Categorical'").select("column_name").collect()]
    spark = table.sparkSession
    if open_roles:
        values = cells(table.select(*(F.col(f"`{c}`") for c in open_roles))).filter("value is not null").select("column_name", "value").distinct()
        ranges = ctx.predicates.select("column_name", "ranges")
        values = values.join(F.broadcast(ranges), "column_name").filter(~E.is_literal(F.col("value"), F.lit("Categorical"), F.col("ranges"))).cache()
        concepts = P.concept_matches(values, P.small(O.classes(triples)), values.select("value", F.explode("ranges").alias("range")))
    else:
        concepts = spark.createDataFrame([], "value string, uri string, confidence double, method string")
    out = E.emit(table, row_id, ctx.columns, ctx.predicates, ctx.primary, ctx.sibling, concepts, O.disjoint_declared(triples))
    return out.unionByName(E.links(table, row_id, ctx.primary, ctx.links)) if ctx.links else out
