"""Evidence of tables and texts joined: entities and triples, fused confidence, provenance, priors, conflicts and repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.similarity import noisy_or


def fuse_entities(table: DataFrame, text: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Both (uri, label, confidence) -> (uri, label, c_tab, c_txt, c_fused, provenance); joined on the IRI or, without one,
    the lower-case label; the best confidence of each side counts."""
    key = F.coalesce("uri", F.lower(F.trim("label")))
    one = lambda d, c: d.groupBy(key.alias("k")).agg(F.min("uri").alias(f"uri_{c}"), F.min("label").alias(f"label_{c}"), F.max("confidence").alias(f"c_{c}"))
    met = one(table, "tab").join(one(text, "txt"), "k", "full")
    both = F.col("c_tab").isNotNull() & F.col("c_txt").isNotNull()
    origin = F.when(both, "cross_modal").when(F.col("c_tab").isNotNull(), "table_only").otherwise("text_only")
    zero = F.lit(0.0)
    return met.select(F.coalesce("uri_tab", "uri_txt").alias("uri"), F.coalesce("label_tab", "label_txt").alias("label"), F.coalesce("c_tab", zero).alias("c_tab"), F.coalesce("c_txt", zero).alias("c_txt"), noisy_or(F.col("c_tab"), F.col("c_txt"), both, alpha).alias("c_fused"), origin.alias("provenance"))


def corroborate(table: DataFrame, text: DataFrame) -> DataFrame:
    """Triples (s, p, o, confidence) of both sides on lower-case parts: 0.10 more and corroborated where both have one."""
    low = lambda d, c: d.groupBy(*(F.lower(F.trim(x)).alias(x) for x in ("s", "p", "o"))).agg(F.max("confidence").alias(c))
    met = low(table, "c_tab").join(low(text, "c_txt"), ["s", "p", "o"], "full")
    both = F.col("c_tab").isNotNull() & F.col("c_txt").isNotNull()
    conf = F.when(both, F.least(F.lit(1.0), F.greatest("c_tab", "c_txt") + 0.10)).otherwise(F.coalesce("c_tab", "c_txt"))
    return met.select("s", "p", "o", conf.alias("confidence"), F.when(both, "corroborated").when(F.col("c_tab").isNotNull(), "table_only").otherwise("text_only").alias("provenance"))


def provenance_summary(fused: DataFrame) -> DataFrame:
    """(provenance, n, mean of each side over its non-zero values, mean fused, gain over the better side)."""
    nonzero = lambda c: F.avg(F.when(F.col(c) > 0, F.col(c)))
    return fused.groupBy("provenance").agg(F.count("*").alias("n"), nonzero("c_tab").alias("avg_tab"), nonzero("c_txt").alias("avg_txt"), F.avg("c_fused").alias("avg_fused"), F.avg(F.col("c_fused") - F.greatest("c_tab", "c_txt")).alias("gain"))


def topic_priors(counts: DataFrame) -> DataFrame:
    """counts(topic, n) -> share of all occurrences per topic. Topics are few; their sum is a window over them."""
    return counts.groupBy("topic").agg(F.sum("n").alias("n")).select("topic", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("prior"))


def tier_chain(items: DataFrame) -> DataFrame:
    """items(series, tier, uri) -> (subject, object): each tier's item leads to the next tier's of its series."""
    order = Window.partitionBy("series").orderBy("tier", "uri")
    return items.select(F.col("uri").alias("subject"), F.lead("uri").over(order).alias("object")).filter("object is not null")


def interpretation_conflicts(mentions: DataFrame, disjoint: DataFrame, max_inputs: int = 4) -> DataFrame:
    """mentions(row_id, col, role, iri, type, col_type, quantity) -> (row_id, col, kind).

    TypeDisjointness: a cell's type is disjoint from its column's. ForgeInputs: more ingredients in a row than a forge
    takes. Quantity: a quantity that is not positive.
    """
    apart = mentions.join(disjoint, (F.col("type") == F.col("a")) & (F.col("col_type") == F.col("b")), "left_semi").select("row_id", "col", F.lit("TypeDisjointness").alias("kind"))
    crowded = mentions.filter("role = 'ingredient'").groupBy("row_id").agg(F.count("*").alias("n"), F.min("col").alias("col")).filter(F.col("n") > max_inputs).select("row_id", "col", F.lit("ForgeInputs").alias("kind"))
    amount = mentions.filter("quantity <= 0").select("row_id", "col", F.lit("Quantity").alias("kind"))
    return apart.unionByName(crowded).unionByName(amount)


def repair_mentions(mentions: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Conflicting cells drop their type for the column's, forge surplus beyond the fourth input becomes a relation, and
    quantities become 1; ``repaired`` says so."""
    hit = conflicts.groupBy("row_id", "col").agg(F.collect_set("kind").alias("kinds"))
    forge = conflicts.filter("kind = 'ForgeInputs'").select("row_id", F.lit(True).alias("crowded")).distinct()
    order = Window.partitionBy("row_id", "role").orderBy("col")
    out = mentions.join(hit, ["row_id", "col"], "left").join(forge, "row_id", "left").withColumn("_n", F.row_number().over(order))
    has = lambda k: F.coalesce(F.array_contains("kinds", k), F.lit(False))
    surplus = F.coalesce("crowded", F.lit(False)) & (F.col("role") == "ingredient") & (F.col("_n") > 4)
    return out.select("row_id", "col", F.when(surplus, "related").otherwise(F.col("role")).alias("role"), "iri", F.when(has("TypeDisjointness"), F.col("col_type")).otherwise(F.col("type")).alias("type"), "col_type", F.when(has("Quantity"), 1.0).otherwise(F.col("quantity")).alias("quantity"), (F.col("kinds").isNotNull() | surplus).alias("repaired"))


def ping_pong(mentions: DataFrame, disjoint: DataFrame, max_iterations: int = 3) -> tuple[DataFrame, DataFrame]:
    """(mentions, trace(iteration, n_conflicts)): repair until no conflict is left, their number stops falling, or the rounds end."""
    spark, trace, last = mentions.sparkSession, [], None
    for i in range(max_iterations + 1):
        found = interpretation_conflicts(mentions, disjoint)
        n = found.count()
        trace.append((i, n))
        if n == 0 or (last is not None and n >= last) or i == max_iterations:
            break
        last = n
        mentions = repair_mentions(mentions, found).drop("repaired")
        if spark.sparkContext.getCheckpointDir():
            mentions = mentions.checkpoint()
    return mentions, spark.createDataFrame(trace, "iteration int, n_conflicts long")


#: What a cell's or a text's confidence gains: with the topic or without, and by occurrences up to a limit.
TOPIC_GAIN, OTHER_GAIN = 0.05, 0.02


def triangulate(cells: DataFrame, mentioned: DataFrame, attributes: DataFrame, topic: str = "general") -> DataFrame:
    """Entities of a table and of a text as one: (uri, label, type, c_tab, c_txt, c_fused, provenance, occurrences, quantity, vendor,
    zone, discipline, min_rating, tier).

    cells(row_id, iri, label, type, confidence), mentioned(uri, label, type, occurrences), attributes as from
    proposals.row_attributes. A cell gains with the topic; a text gives 0.85 and 0.02 per occurrence (0.10 at most) where a
    cell has the same IRI or label, else 0.80 and 0.03 per occurrence (0.12 at most). Attributes are the first rows' that
    have them. Joined by IRI first, what is left by label.
    """
    low = lambda c: F.lower(F.trim(c))
    gain = F.when(low("label").contains(topic) | low("type").contains(topic), TOPIC_GAIN).otherwise(OTHER_GAIN)
    names = ("quantity", "vendor", "zone", "discipline", "min_rating", "tier")
    rows = cells.join(attributes, "row_id", "left").withColumn("c", F.least(F.lit(1.0), F.col("confidence") + gain))
    first = [F.min_by(a, F.when(F.col(a).isNotNull(), F.col("row_id"))).alias(a) for a in names]
    table = rows.groupBy(F.col("iri").alias("uri")).agg(F.min_by("label", "row_id").alias("label"), F.min_by("type", "row_id").alias("type"), F.max("c").alias("c_tab"), *first)
    text = mentioned.groupBy("uri").agg(F.min("label").alias("t_label"), F.min("type").alias("t_type"), F.sum("occurrences").alias("n"))
    by_uri = table.join(text, "uri", "left")
    spare = text.join(table.select("uri"), "uri", "left_anti").groupBy(low("t_label").alias("k")).agg(F.min_by(F.struct("uri", "n"), "uri").alias("t"))
    met = by_uri.withColumn("k", F.when(F.col("n").isNull(), low("label"))).join(spare, "k", "left").withColumn("n", F.coalesce("n", F.col("t.n")))
    both = F.col("n").isNotNull()
    c_txt = F.when(both, 0.85 + F.least(F.lit(0.10), 0.02 * F.col("n"))).otherwise(0.0)
    one = met.select("uri", "label", "type", "c_tab", c_txt.alias("c_txt"), noisy_or(F.col("c_tab"), c_txt, F.lit(True)).alias("c_fused"), F.when(both, "cross_modal_corroborated").otherwise("table_only").alias("provenance"), F.coalesce("n", F.lit(0)).alias("occurrences"), *names, F.col("t.uri").alias("_used"))
    alone = text.join(table.select("uri"), "uri", "left_anti").join(one.select(F.col("_used").alias("uri")).filter("uri is not null"), "uri", "left_anti")
    c_alone = 0.80 + F.least(F.lit(0.12), 0.03 * F.col("n"))
    empty = [F.lit(None).cast(table.schema[a].dataType).alias(a) for a in names]
    rest = alone.select("uri", F.col("t_label").alias("label"), F.col("t_type").alias("type"), F.lit(0.0).alias("c_tab"), c_alone.alias("c_txt"), noisy_or(F.lit(0.0), c_alone, F.lit(True)).alias("c_fused"), F.lit("text_only").alias("provenance"), F.col("n").alias("occurrences"), *empty)
    return one.drop("_used").unionByName(rest)


def fused_triples(fused: DataFrame, facts: DataFrame) -> DataFrame:
    """triangulate, facts(s, p, o) -> distinct (subject, predicate, object, hop): what attributes say, a step further from item to
    vendor to zone, precursors of successive tiers, those a fact links, and a legendary's last precursor."""
    say = lambda rows, s, p, o, hop: rows.select(s.cast("string").alias("subject"), F.lit(p).alias("predicate"), o.cast("string").alias("object"), F.lit(hop).alias("hop"))
    c = F.col
    out = say(fused.filter("discipline is not null"), c("label"), "craftedByDiscipline", F.initcap("discipline"), "attribute")
    out = out.unionByName(say(fused.filter("type = 'NPCVendor' and zone is not null"), c("label"), "locatedInZone", c("zone"), "attribute"))
    out = out.unionByName(say(fused.filter("quantity > 0"), c("label"), "ingredientQuantity", c("quantity"), "attribute"))
    sold = fused.filter("vendor is not null and zone is not null")
    out = out.unionByName(say(sold, c("label"), "obtainedFromVendor", c("vendor"), "multi_hop")).unionByName(say(sold, c("vendor"), "locatedInZone", c("zone"), "multi_hop"))
    precursors = fused.filter(F.lower("type").contains("precursor"))
    order = Window.partitionBy(F.lit(0)).orderBy("tier", "uri")  # precursors with a tier: as many as an ontology has tiers
    chain = precursors.filter("tier is not null").withColumn("after", F.lead("label").over(order))
    out = out.unionByName(say(chain.filter("after is not null"), c("label"), "precursorTo", c("after"), "tier"))
    named = fused.select(c("uri").alias("o"), c("label").alias("o_label"))
    linked = precursors.join(facts.filter("p = 'precursorTo'"), c("uri") == c("s")).join(named, "o")
    out = out.unionByName(say(linked, c("label"), "precursorTo", c("o_label"), "fact"))
    last = F.coalesce(F.min(F.when((c("tier") == 4) | F.lower("label").rlike("living|precursor"), F.struct("tier", "label"))), F.max(F.struct("tier", "label")))
    final = precursors.filter("tier is not null").agg(last.alias("l")).filter("l is not null").select(c("l.label").alias("final"))
    heroes = fused.filter("type = 'LegendaryWeapon'").join(F.broadcast(final))  # one row
    out = out.unionByName(say(heroes, c("label"), "hasPrecursor", c("final"), "tier"))
    return out.groupBy("subject", "predicate", "object").agg(F.min("hop").alias("hop"))


def confidence_summary(fused: DataFrame) -> DataFrame:
    """(n_entities, n_cross, n_table, n_text, avg_fused, avg_tab, avg_txt, gain_pct) of triangulate."""
    n = lambda p: F.count_if(F.col("provenance") == p)
    mean = lambda x: F.coalesce(F.avg(F.when(F.col(x) > 0, F.col(x))), F.lit(0.0))
    out = fused.agg(F.count("*").alias("n_entities"), n("cross_modal_corroborated").alias("n_cross"), n("table_only").alias("n_table"), n("text_only").alias("n_text"), F.coalesce(F.avg("c_fused"), F.lit(1.0)).alias("f"), mean("c_tab").alias("t"), mean("c_txt").alias("x"))
    return out.select("n_entities", "n_cross", "n_table", "n_text", F.round("f", 4).alias("avg_fused"), F.round("t", 4).alias("avg_tab"), F.round("x", 4).alias("avg_txt"), F.round((F.col("f") - F.greatest("t", "x")) * 100, 2).alias("gain_pct"))
