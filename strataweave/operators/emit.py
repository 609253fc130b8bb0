"""Rows -> triples: anchors, links, objects, trust, row conflicts and the coverage report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.normalize import normalize_string
from strataweave.operators.ontology import XSD
from strataweave.operators.profile import cells, is_id_shaped, is_numeric

LINK_NAMESPACE = "urn:strataweave:has_"


def trust(pred_conf: Column, pred_review: Column, obj_conf: Column, is_concept: Column) -> Column:
    """struct(module_action, confidence, review_flag) of a predicate and an object match."""
    conf = F.round(pred_conf * obj_conf, 4)
    out = lambda action, review: F.struct(F.lit(action).alias("module_action"), conf.alias("confidence"), F.lit(review).alias("review_flag"))
    return (
        F.when(~is_concept & pred_review, out("HITL Validation", True))
        .when(~is_concept, out("Literal Typed", False))
        .when((obj_conf >= 0.62) & pred_review, out("HITL Validation", True))
        .when(obj_conf >= 0.62, out("Deterministic Mapped", False))
        .when(obj_conf >= 0.40, out("HITL Validation", True))
        .otherwise(out("Literal Boxed", True))
    )


def anchors(columns: DataFrame, primary: str | None) -> DataFrame:
    """columns(ordinal, column_name, role, id_shape_ratio) -> (anchor, prefix, sibling): sub-entity columns and the columns
    that share their prefix; only anchors with a sibling."""
    name = F.col("column_name")
    parts = F.split(name, "[_ -]+")
    ends_id = (F.size(parts) > 1) & F.upper(F.element_at(parts, -1)).isin("ID", "CODE", "KEY", "IDENTIFIER")
    prefix = F.when(ends_id, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), "_")).otherwise(F.element_at(parts, 1))
    others = columns if primary is None else columns.filter(name != primary)
    anchor = others.filter(F.col("role").isin("Foreign Key", "Entity ID") | (F.col("id_shape_ratio") >= 0.70)).select(F.col("ordinal").alias("anchor_ordinal"), name.alias("anchor"), prefix.alias("prefix"))
    sibling = others.select(name.alias("sibling"))
    return anchor.join(F.broadcast(sibling), (F.col("sibling") != F.col("anchor")) & F.upper("sibling").startswith(F.upper("prefix")))


def sibling_anchor(pairs: DataFrame) -> DataFrame:
    """(sibling, anchor): of several anchors of a column the last in column order."""
    last = Window.partitionBy("sibling").orderBy(F.col("anchor_ordinal").desc())
    return pairs.withColumn("_r", F.row_number().over(last)).filter("_r = 1").select("sibling", "anchor")


def link_property(anchor_domains: DataFrame, properties: DataFrame, majority: str | None) -> DataFrame:
    """anchor_domains(anchor, prefix, anchor_domain) -> (anchor, link_uri): the first object property that leads from the
    majority domain to the anchor's, or whose label holds the prefix; else a minted has_<prefix>."""
    objects = properties.filter("property_type = 'ObjectProperty'").select("uri", "label", "domains", "ranges")
    pre = normalize_string(F.col("prefix"))
    fits = F.lit(False)
    if majority is not None:
        fits = F.col("anchor_domain").isNotNull() & ((F.size("domains") == 0) | F.array_contains("domains", majority)) & ((F.size("ranges") == 0) | F.array_contains("ranges", F.col("anchor_domain")))
    met = anchor_domains.join(F.broadcast(objects), fits | normalize_string(F.col("label")).contains(pre), "left")
    found = met.groupBy("anchor", "prefix").agg(F.min("uri").alias("uri"))
    minted = F.concat(F.lit(LINK_NAMESPACE), F.lower(F.regexp_replace("prefix", "^[_ ]+|[_ ]+$", "")))
    return found.select("anchor", F.coalesce("uri", minted).alias("link_uri"))


def is_literal(value: Column, role: Column, ranges: Column) -> Column:
    """Whether a cell stays a literal without looking for a concept."""
    plain = role.isin("Numeric property", "Measurement value/unit pair", "Timestamp", "Entity ID", "Foreign Key", "Skip", "Text")
    return plain | is_id_shaped(value) | is_numeric(value) | F.exists(ranges, lambda r: r.startswith(XSD))


TRIPLE_COLUMNS = ("subject", "predicate", "object", "confidence", "method", "review_flag", "module_action", "row_id", "column_name")


def emit(table: DataFrame, row_id: str, columns: DataFrame, predicates: DataFrame, primary: str | None, sibling: DataFrame, concepts: DataFrame, disjoint: DataFrame) -> DataFrame:
    """One triple per filled cell of a column that is not skipped.

    predicates(column_name, uri, confidence, method, review_flag, domains, ranges); sibling(sibling, anchor);
    concepts(value, uri, confidence, method) of distinct values; disjoint(a, b) declared. All of these are per column or
    per distinct value and are broadcast or joined by value; the table itself is unpivoted and never shuffled unless the
    concepts outgrow a broadcast.
    """
    roles = columns.filter("role <> 'Skip'").select("column_name", "role")
    context = predicates.drop("role", "label").join(roles, "column_name").join(sibling.withColumnRenamed("sibling", "column_name"), "column_name", "left")
    context = context.select("column_name", "role", F.col("uri").alias("p_uri"), F.col("confidence").alias("p_conf"), F.col("method").alias("p_method"), F.col("review_flag").alias("p_review"), "domains", "ranges", "anchor")
    names = [c for c in table.columns if c != row_id]
    text = {c: F.trim(F.col(f"`{c}`").cast("string")) for c in names}
    filled = lambda c: F.when(text[c] != "", text[c])
    anchors_map = F.create_map(*(x for c in names for x in (F.lit(c), filled(c))))
    subject = F.concat(F.lit("Row-"), F.col(row_id).cast("string"))
    # Which columns of a row clash: pairs of columns whose domains are declared disjoint, both filled and on the row's subject.
    cols = context.filter("anchor is null").select("column_name", F.explode("domains").alias("d"))
    clash = cols.join(disjoint, F.col("d") == F.col("a")).join(cols.select(F.col("column_name").alias("other"), F.col("d").alias("d2")), F.col("b") == F.col("d2")).filter("column_name <> other")
    clashes = sorted({tuple(r) for r in clash.select("column_name", "other").distinct().collect()})  # pairs of columns: bounded by the table's width
    missing = lambda c: F.coalesce(F.lower(text[c]).isin("", "nan", "none", "null"), F.lit(True))
    rivals = F.array_compact(F.array(*(F.when(~missing(a) & ~missing(b), F.lit(a)) for a, b in clashes))) if clashes else F.array().cast("array<string>")
    wide = table.withColumn("_subject", subject if primary is None else F.coalesce(filled(primary), subject)).withColumn("_of", anchors_map).withColumn("_clash", rivals)
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), text[c].alias("value")) for c in names)))
    long = wide.select(F.col(row_id).alias("row_id"), "_subject", "_of", "_clash", pairs.alias("c")).select("row_id", "_subject", "_of", "_clash", "c.*")
    long = long.filter(~F.lower("value").isin("", "nan", "none", "null")).join(F.broadcast(context), "column_name")
    clashing = F.array_contains("_clash", F.col("column_name"))
    found = concepts.select(F.col("value"), F.col("uri").alias("c_uri"), F.col("confidence").alias("c_conf"), F.col("method").alias("c_method"))
    open_value = F.when(~is_literal(F.col("value"), F.col("role"), F.col("ranges")), F.col("value"))
    long = long.withColumn("_open", open_value).join(found.withColumnRenamed("value", "_open"), "_open", "left")
    concept = F.col("c_uri").isNotNull()
    t = trust(F.col("p_conf"), F.col("p_review"), F.coalesce("c_conf", F.lit(1.0)), concept)
    method = F.concat(F.col("p_method"), F.when(concept, F.concat(F.lit("+"), "c_method")).otherwise(""), F.when(clashing, "+Row_Type_Conflict").otherwise(""))
    on = F.when(F.col("anchor").isNotNull(), F.coalesce(F.col("_of")[F.col("anchor")], F.col("_subject"))).otherwise(F.col("_subject"))
    return long.select(
        on.alias("subject"), F.col("p_uri").alias("predicate"), F.coalesce("c_uri", "value").alias("object"), t["confidence"].alias("confidence"), method.alias("method"),
        (t["review_flag"] | clashing).alias("review_flag"), F.when(clashing, "HITL Validation").otherwise(t["module_action"]).alias("module_action"), "row_id", "column_name",
    )


def links(table: DataFrame, row_id: str, primary: str | None, anchor_links: list[tuple[str, str]]) -> DataFrame:
    """Subject-link triples of each row to its anchors (anchor column, link IRI); none to itself or to an empty cell."""
    subject = F.concat(F.lit("Row-"), F.col(row_id).cast("string"))
    own = subject if primary is None else F.coalesce(F.when(F.trim(F.col(f"`{primary}`").cast("string")) != "", F.trim(F.col(f"`{primary}`").cast("string"))), subject)
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("anchor"), F.lit(u).alias("predicate"), F.trim(F.col(f"`{a}`").cast("string")).alias("object")) for a, u in anchor_links)))
    rows = table.select(F.col(row_id).alias("row_id"), own.alias("subject"), each.alias("l")).select("row_id", "subject", "l.*").filter("object <> '' and object <> subject")
    return rows.select(
        "subject", "predicate", "object", F.lit(0.95).alias("confidence"), F.lit("Schema-Driven-SubjectLink").alias("method"), F.lit(False).alias("review_flag"),
        F.lit("Deterministic Mapped").alias("module_action"), "row_id", F.concat("subject", F.lit("->"), "anchor").alias("column_name"),
    )


def coverage(triples: DataFrame) -> DataFrame:
    """Per module action, and in total (module_action 'ALL'): triples, mapped and strong ratios, reviews. One pass."""
    out = triples.groupingSets([["module_action"], []], "module_action").agg(
        F.count("*").alias("n_triples"), F.avg((~F.col("method").startswith("Unmapped")).cast("double")).alias("mapped_ratio"),
        F.avg((F.col("confidence") >= 0.70).cast("double")).alias("strong_ratio"), F.count_if("review_flag").alias("n_review"),
    )
    return out.withColumn("module_action", F.coalesce("module_action", F.lit("ALL")))


__all__ = ["anchors", "cells", "coverage", "emit", "is_literal", "link_property", "links", "sibling_anchor", "trust"]
