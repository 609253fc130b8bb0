"""Scores of tables against their truth, per model, and their averages over a suite."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.operators import metrics

SCORE = "table_id string, domain string, model string, cea_accuracy double, cta_accuracy double, cpa_precision double, cpa_recall double, cpa_f1 double, validity double, violations long"


def score_table(table_id: str, domain: str, model: str, cells: DataFrame, columns: DataFrame, pairs: DataFrame, truth: dict[str, DataFrame], violations: int, elements: int) -> DataFrame:
    """One row of SCORE. cells(row_id, col, raw, iri), columns(header, iri), pairs(source, target, property); truth holds by_cell,
    by_mention, columns and pairs as ``operators.metrics`` takes them. Validity is the share of elements without a violation."""
    spark = cells.sparkSession
    cea = metrics.cea_metrics(cells, truth["by_cell"], truth["by_mention"]).first()
    cta = metrics.cta_metrics(columns, truth["columns"]).first()
    cpa = metrics.cpa_metrics(pairs, truth["pairs"]).first()
    valid = round(max(0.0, 1.0 - violations / elements), 4) if elements else 0.0
    return spark.createDataFrame([(table_id, domain, model, float(cea.accuracy), float(cta.accuracy), float(cpa.precision), float(cpa.recall), float(cpa.f1), valid, violations)], SCORE)


def suite(scores: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, scores)


def summary(scores: DataFrame) -> DataFrame:
    """(model, n_tables, avg_cea, avg_cta, avg_cpa_f1, avg_validity, total_violations)."""
    return scores.groupBy("model").agg(
        F.count("*").alias("n_tables"), F.avg("cea_accuracy").alias("avg_cea"), F.avg("cta_accuracy").alias("avg_cta"), F.avg("cpa_f1").alias("avg_cpa_f1"),
        F.avg("validity").alias("avg_validity"), F.sum("violations").alias("total_violations"),
    )


def of_domain(scores: DataFrame, domain: str) -> DataFrame:
    """Scores whose domain or table holds the words; none raises ValueError."""
    found = scores.filter(F.lower("domain").contains(domain.lower()) | F.lower("table_id").contains(domain.lower()))
    if not found.limit(1).count():
        raise ValueError(f"no table of domain {domain!r}")
    return found
