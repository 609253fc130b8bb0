"""Scores of annotations against ground truth, as joins and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.functions.normalize import normalize_entity_iri, normalize_identifier


def _rates(out: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.withColumns({"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(ratio(2 * p * r, p + r), 4)})


def cea_metrics(predictions: DataFrame, by_cell: DataFrame, by_mention: DataFrame) -> DataFrame:
    """predictions(row_id, col, raw, iri); by_cell(row_id, col, expected); by_mention(mention, expected) -> one row of counts.

    Expected entity: by coordinates, else by equal normalised mention, else by a mention inside the other (only the
    mentions still open meet, and the truth is the broadcast side). An unknown prediction misses if something was
    expected and is false otherwise; a wrong one is false.
    """
    base = predictions.withColumn("k", normalize_identifier(F.col("raw"))).join(by_cell.select("row_id", "col", F.col("expected").alias("e1")), ["row_id", "col"], "left")
    truth = by_mention.select(normalize_identifier(F.col("mention")).alias("m"), "expected").groupBy("m").agg(F.min("expected").alias("expected"))
    base = base.join(F.broadcast(truth.select(F.col("m").alias("k"), F.col("expected").alias("e2"))), "k", "left")
    rest = base.filter("e1 is null and e2 is null").select("k").distinct()
    loose = rest.join(F.broadcast(truth), F.col("k").contains(F.col("m")) | F.col("m").contains(F.col("k"))).groupBy("k").agg(F.min_by("expected", "m").alias("e3"))
    base = base.join(loose, "k", "left").withColumn("expected", F.coalesce("e1", "e2", "e3"))
    got, want = normalize_entity_iri(F.col("iri")), normalize_entity_iri(F.col("expected"))
    unknown = got.contains("unknown")
    out = base.agg(
        F.count_if(F.col("expected").isNotNull() & ~unknown & (got == want)).alias("tp"),
        F.count_if((F.col("expected").isNotNull() & ~unknown & (got != want)) | (F.col("expected").isNull() & (got != ""))).alias("fp"),
        F.count_if(F.col("expected").isNotNull() & unknown).alias("fn"), F.count("*").alias("n_evaluated"),
    )
    return _rates(out.withColumn("accuracy", F.round(F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("n_evaluated")), F.lit(0.0)), 4)))


def cta_metrics(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """predictions(header, iri), truth(header, class_iri) -> accuracy and macro F1 over the expected classes."""
    got = predictions.select(normalize_identifier(F.col("header")).alias("h"), normalize_identifier(F.col("iri")).alias("got"))
    met = truth.select(normalize_identifier(F.col("header")).alias("h"), normalize_identifier(F.col("class_iri")).alias("want")).join(got, "h", "left")
    right = met.agg(F.count("*").alias("n_columns"), F.count_if(F.col("got") == F.col("want")).alias("n_right"))
    by_class = met.groupBy("want").agg(F.count("*").alias("n"), F.count_if(F.col("got") == F.col("want")).alias("hit"))
    claimed = met.groupBy(F.col("got").alias("want")).agg(F.count("*").alias("claimed"))
    f1 = by_class.join(claimed, "want", "left").select(F.coalesce(F.try_divide(2.0 * F.col("hit"), F.col("n") + F.coalesce("claimed", F.lit(0))), F.lit(0.0)).alias("f1"))
    macro = f1.agg(F.round(F.coalesce(F.avg("f1"), F.lit(0.0)), 4).alias("macro_f1"))
    return right.join(macro).select("n_columns", "n_right", F.round(F.coalesce(F.try_divide(F.col("n_right").cast("double"), F.col("n_columns")), F.lit(0.0)), 4).alias("accuracy"), "macro_f1")


def cpa_metrics(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Both (source, target, property) -> counts and rates; a property matches if equal or one name holds the other."""
    norm = lambda d: d.select(*(normalize_identifier(F.col(c)).alias(c) for c in ("source", "target", "property"))).distinct()
    p, t = norm(predictions), norm(truth).withColumnRenamed("property", "wanted")
    met = p.join(t, ["source", "target"]).filter(F.col("property").contains(F.col("wanted")) | F.col("wanted").contains(F.col("property")))
    tp = met.select("source", "target", "property").distinct().agg(F.count("*").alias("tp"))
    hit = met.select("source", "target", "wanted").distinct().agg(F.count("*").alias("hit"))
    n = p.agg(F.count("*").alias("n_p")).join(t.agg(F.count("*").alias("n_t"))).join(tp).join(hit)
    return _rates(n.select("tp", (F.col("n_p") - F.col("tp")).alias("fp"), (F.col("n_t") - F.col("hit")).alias("fn")))


def validity_rate(n_violations: int, n_elements: int) -> float:
    return max(0.0, round(1.0 - n_violations / max(1, n_elements), 4))


__all__ = ["cea_metrics", "cpa_metrics", "cta_metrics", "validity_rate"]
