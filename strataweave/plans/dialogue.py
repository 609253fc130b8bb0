"""The two-round dialogue over a table: propose, evaluate, repair, verify. The trace is a row per turn."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.functions.normalize import local_name
from strataweave.operators import annotate
from strataweave.operators.mesh import bind_roles
from strataweave.operators.ontology import _settled, disjoint_inherited
from strataweave.operators.proposals import _holds
from strataweave.operators.schema import discipline_compatible
from strataweave.rules import DEFAULT, Rules

TRACE = "round int, speaker string, action string, n long, confidence double"
# Headers under which a trophy cannot stand; headers of items and of disciplines.
NO_TROPHY = ("precursor", "thing", "step", "weapon", "output")
ITEM_HEADERS, DISCIPLINE_HEADERS = ("precursor", "weapon", "step", "item"), ("discipline", "craft", "prof")


@dataclass(frozen=True)
class Dialogue:
    trace: DataFrame
    violations: DataFrame  # kind, row_id, ordinal, focus
    cells: DataFrame  # entities of cells, their types repaired
    columns: DataFrame  # ordinal, header, type, confidence
    triples: DataFrame  # row_id, s, p, o, o_kind


def cell_violations(found: DataFrame, columns: DataFrame, triples: DataFrame, predicates: tuple[str, ...]) -> DataFrame:
    """(kind, row_id, ordinal, focus): types disjoint from their column's, trophies where a weapon is made, items with a discipline
    that does not go with them. Names of classes are compared by their local parts."""
    typed = found.join(F.broadcast(columns.select("ordinal", F.col("type").alias("column_type"))), "ordinal")
    apart = disjoint_inherited(triples).select(local_name(F.col("a")).alias("type"), local_name(F.col("b")).alias("column_type")).distinct()
    say = lambda rows, kind, focus="value": rows.select(F.lit(kind).alias("kind"), "row_id", "ordinal", F.col(focus).alias("focus"))
    clash = say(typed.join(apart, ["type", "column_type"], "left_semi"), "DisjointClassViolation")
    trophies = say(typed.filter((F.col("type") == "TrophyItem") & _holds(F.col("header"), NO_TROPHY)), "DisjointClassViolation")
    first = lambda words, name: found.filter(_holds(F.col("header"), words)).groupBy("row_id").agg(F.min(F.struct("ordinal", "pos", "iri", "value")).alias(name))
    met = first(ITEM_HEADERS, "i").join(first(DISCIPLINE_HEADERS, "d"), "row_id").select("row_id", F.col("i.ordinal").alias("ordinal"), F.col("i.value").alias("value"), F.col("i.iri").alias("uri"), F.col("d.iri").alias("discipline"))
    wrong = discipline_compatible(met.select("uri", "discipline").distinct(), triples, predicates).filter("not compatible").select("uri", "discipline")
    return clash.unionByName(trophies).unionByName(say(met.join(wrong, ["uri", "discipline"], "left_semi"), "DisciplineMismatchViolation")).distinct()


def run(cells: DataFrame, entities: DataFrame, known: DataFrame, triples: DataFrame, namespace: str, predicates: tuple[str, ...] = (), rules: Rules = DEFAULT) -> Dialogue:
    """cells(row_id, ordinal, header, value), entities and classes as dimensions, class triples.

    Round 1 proposes entities and finds violations; round 2 gives violating cells their column's type, and puts out what the
    repaired rows say. A table without violations is repaired in one step that changes nothing.
    """
    spark = cells.sparkSession
    found = _settled(annotate.cell_entities(cells, entities, namespace, rules))
    columns = _settled(annotate.column_classes(cells.select("ordinal", "header").distinct(), found, triples, known))
    wrong = _settled(cell_violations(found, columns, triples, predicates))
    n, mean = found.agg(F.count("*"), F.avg("confidence")).first()
    n_wrong = wrong.count()
    hit = wrong.filter("kind = 'DisjointClassViolation'").select("row_id", "ordinal", F.lit(True).alias("_hit")).distinct()
    repaired = found.join(F.broadcast(columns.select("ordinal", F.col("type").alias("column_type"))), "ordinal").join(hit, ["row_id", "ordinal"], "left")
    repaired = repaired.withColumn("type", F.when(F.col("_hit"), F.col("column_type")).otherwise(F.col("type"))).drop("_hit")
    typed = repaired.select("row_id", F.col("iri").alias("s"), F.lit("type").alias("p"), F.col("type").alias("o"), F.lit("iri").alias("o_kind")).distinct()
    out = _settled(typed.unionByName(bind_roles(repaired)))
    turns = [(1, "proposer", "PROPOSE", n, round(mean or 0.0, 2)), (1, "validator", "EVALUATE", n_wrong, 1.0), (2, "proposer", "REPAIR", max(1, n_wrong), 0.96), (2, "validator", "VERIFY", out.count(), 1.0)]
    return Dialogue(spark.createDataFrame(turns, TRACE), wrong, repaired, columns, out)
