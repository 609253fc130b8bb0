"""Guide prose: clauses, modality, sentences, spans, slots, relations and synthesised grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.cells import split_sentences
from strataweave.rules.cues import CLAUSE_END, CONFIDENCE, CUES, STRONG_RULE

def clauses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sentence_no, clause_no, clause): sentences cut at semicolons, dashes and conjunctions; bullets dropped; three characters at least.

    Clauses are numbered within their row, so no text is shuffled. Only where a key stands in several rows, which are then
    numbered as one text, a window over the keys does it.
    """
    clean = lambda part: F.trim(F.regexp_replace(F.regexp_replace(F.trim(part), r"^[0-9]+[.)]\s*", ""), r"^[*•-]\s*", ""))
    sentences = F.split(F.col(text), r"(?<=[.!?])\s+|\n+")
    if docs.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        docs = _spread(docs)
        held = lambda s, i: F.transform(F.filter(F.transform(F.split(F.trim(s), CLAUSE_END), clean), lambda c: F.length(c) >= 3), lambda c: F.struct(i.alias("sentence_no"), c.alias("clause")))
        return docs.select(key, F.posexplode(F.flatten(F.transform(sentences, held))).alias("clause_no", "c")).select(key, "c.sentence_no", "clause_no", "c.clause")
    sentence = docs.select(key, F.posexplode(sentences).alias("sentence_no", "sentence"))
    parts = sentence.select(key, "sentence_no", F.posexplode(F.split(F.trim("sentence"), CLAUSE_END)).alias("part_no", "part"))
    kept = parts.select(key, "sentence_no", "part_no", clean(F.col("part")).alias("clause")).filter(F.length("clause") >= 3)
    order = Window.partitionBy(key).orderBy("sentence_no", "part_no")
    return kept.select(key, "sentence_no", (F.row_number().over(order) - 1).alias("clause_no"), "clause")


def _spread(docs: DataFrame) -> DataFrame:
    """Texts of fewer files than there are cores, dealt over the cores; all others as they are."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def _has(clause: Column, kind: str) -> Column:
    return clause.rlike("(?i)" + "|".join(CUES[kind]))


def modality(clause: Column) -> Column:
    """struct(modality, confidence): wishes and filler unless a strict rule stands beside it, then hypothesis, estimate, rule."""
    out = lambda kind, conf: F.struct(F.lit(kind).alias("modality"), F.lit(conf).alias("confidence"))
    found = F.when(_has(clause, "BOULETIC_FLUFF") & ~clause.rlike(STRONG_RULE), out("BOULETIC_FLUFF", 0.95))
    for kind in ("HYPOTHETICAL", "EPISTEMIC_ESTIMATE", "DEONTIC_RULE"):
        found = found.when(_has(clause, kind), out(kind, CONFIDENCE[kind]))
    return found.otherwise(out("DEONTIC_RULE", 0.75))


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(split_sentences(F.col(text))).alias("sentence_no", "sentence"))


def entity_counts(docs: DataFrame, aliases: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs x aliases(uri, alias) -> (key, uri, n): whole-word occurrences, summed over an entity's aliases.

    Token equi-join first: an alias can only occur where its first token does. Texts are exploded to distinct tokens, so
    no text meets an alias that shares nothing with it.
    """
    word = r"(?U)[\p{L}\p{N}]+"
    first = aliases.withColumn("token", F.lower(F.regexp_extract("alias", word, 0))).filter("token <> ''")
    held = docs.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(word), F.lit(0)))).alias("token"))
    pairs = held.join(first, "token").select(key, "uri", "alias").distinct()
    quoted = F.concat(F.lit(r"(?iU)(?<!\w)\Q"), F.col("alias"), F.lit(r"\E(?!\w)"))
    met = pairs.join(docs.select(key, text), key).withColumn("n", F.regexp_count(F.col(text), quoted))
    return met.groupBy(key, "uri").agg(F.sum("n").alias("n")).filter("n > 0")


def sentence_relations(spans: DataFrame) -> DataFrame:
    """spans(doc_id, sentence_no, start, name, kind) -> relations of a sentence's first span to each later one."""
    order = Window.partitionBy("doc_id", "sentence_no").orderBy("start", "name")
    ranked = spans.withColumn("_r", F.row_number().over(order))
    head = ranked.filter("_r = 1").select("doc_id", "sentence_no", F.col("name").alias("subject"))
    tail = ranked.filter("_r > 1").select("doc_id", "sentence_no", F.col("name").alias("object"), F.when(F.col("kind") == "Material", "hasIngredient").otherwise("relatesTo").alias("predicate"))
    return head.join(tail, ["doc_id", "sentence_no"]).filter("subject <> object").select("doc_id", "sentence_no", "subject", "predicate", "object")


def synthesize_grid(slots: DataFrame) -> DataFrame:
    """slots(frame, pos, name, value) -> one row per frame and component, other slots pivoted beside it; order-keeping dedup."""
    names = ("entity", "quantity", "discipline", "rating", "cost", "zone", "vendor")
    pick = [F.min_by(F.when(F.col("name") == n, F.col("value")), F.when(F.col("name") == n, F.col("pos"))).alias(n) for n in names if n != "entity"]
    wide = slots.groupBy("frame").agg(*pick)
    parts = slots.filter("name = 'entity'").select("frame", "pos", F.col("value").alias("component"))
    rows = wide.join(parts, "frame", "left")
    first = rows.groupBy("component", *[n for n in names if n != "entity"]).agg(F.min(F.struct("frame", F.coalesce("pos", F.lit(0)).alias("pos"))).alias("first"))
    return first.select(F.col("first.frame").alias("frame"), F.col("first.pos").alias("pos"), "component", *[n for n in names if n != "entity"])


def induced_dimensions(slots: DataFrame) -> DataFrame:
    """(name, n_frames, n_values): slot dimensions by how many frames hold them."""
    return slots.groupBy("name").agg(F.count_distinct("frame").alias("n_frames"), F.count_distinct("value").alias("n_values"))
