"""A first reading of a table: columns by their headers, mentions, relations within a row, attributes of a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.cells import clean_text, extract_quantity
from strataweave.rules import DEFAULT, Rules, headers


def _holds(header: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(F.trim(header))
    return F.greatest(*(F.instr(low, w) for w in words), F.lit(0)) > 0


def _first(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = F
    for test, value in cases:
        out = out.when(test, value)
    return out.otherwise(otherwise)


def classify_columns(cells: DataFrame, known: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """cells(row_id, ordinal, header, value) and known(label, type) -> (ordinal, header, predicted_type, role, confidence).

    A header decides if it can; else 0.7 of plain numbers make a quantity and 0.5 of known materials an ingredient. Blank
    cells count as cells. One aggregate over the cells; a column's rows never meet in one task.
    """
    bare = F.trim(F.regexp_replace("value", "[,.]", ""))
    name = extract_quantity(clean_text(F.col("value")), rules)["name"]
    materials = known.filter("type = 'CraftingMaterial'").select(F.col("label").alias("_name")).distinct().withColumn("_known", F.lit(1))
    # Values are counted first, so each distinct one is looked up once.
    values = cells.groupBy("ordinal", "header", "value").agg(F.count("*").alias("n")).withColumn("_name", name).join(materials, "_name", "left")
    stats = values.groupBy("ordinal", "header").agg(
        F.sum("n").alias("n"), F.sum(F.when(bare.rlike(r"^\p{Nd}+$"), F.col("n")).otherwise(0)).alias("numeric"), F.sum(F.when(F.col("_known").isNotNull(), F.col("n")).otherwise(0)).alias("materials")
    )
    low = F.lower(F.trim("header"))
    say = lambda kind, role, conf: F.struct(F.lit(kind).alias("predicted_type"), role.alias("role"), F.lit(conf).alias("confidence"))
    cases = [(low.rlike(p), say(kind, F.lit(role), conf)) for p, kind, role, conf in headers.PROPOSED]
    cases.append((low.rlike(headers.PLAIN_NAME), say("Item", F.when(F.col("ordinal") > 0, "ingredient").otherwise("subject"), 0.8)))
    cases.append((F.col("numeric") >= F.col("n") * 0.7, say("Quantity", F.lit("quantity"), 0.8)))
    cases.append((F.col("materials") >= F.col("n") * 0.5, say("CraftingMaterial", F.lit("ingredient"), 0.85)))
    return stats.select("ordinal", "header", _first(cases, say("Item", F.lit("ingredient"), 0.6)).alias("c")).select("ordinal", "header", "c.*")


def mentions(cells: DataFrame, columns: DataFrame, known: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """cells(row_id, ordinal, value) -> (row_id, ordinal, name, type, role, column_type, quantity, unit) of cells with a text.

    A known name has its own type, else its column's (no quantity is a type of a name), else Item. ``columns`` as from
    classify_columns is as wide as the table and is broadcast; known(label, type) is joined by name.
    """
    text = clean_text(F.col("value"))
    rows = cells.select("row_id", "ordinal", text.alias("cleaned")).filter("cleaned <> ''").withColumn("q", extract_quantity(F.col("cleaned"), rules))
    rows = rows.join(F.broadcast(columns.select("ordinal", F.col("predicted_type").alias("column_type"), "role")), "ordinal")
    named = known.groupBy(F.col("label").alias("_name")).agg(F.min("type").alias("_type"))
    rows = rows.join(named, F.col("q.name") == F.col("_name"), "left")
    own = F.when(~F.col("column_type").isin("Quantity", "Unknown"), F.col("column_type")).otherwise("Item")
    name = F.when(F.col("q.name") == "", F.col("cleaned")).otherwise(F.col("q.name"))
    return rows.select("row_id", "ordinal", name.alias("name"), F.coalesce("_type", own).alias("type"), "role", "column_type", "q.quantity", "q.unit")


def row_relations(found: DataFrame, subject_ordinal: int | None = None, subject: str | None = None) -> DataFrame:
    """mentions -> (row_id, subject, predicate, object, quantity): the row's subject with every other mention.

    The subject is given, or the mention in the subject column, or "TargetRecipe". Quantities are no objects; a mention
    without one takes that of the first other mention of its row that has a quantity or stands in a quantity column.
    """
    row = Window.partitionBy("row_id")
    at = F.lit(subject_ordinal).cast("int")
    heads = F.coalesce(F.lit(subject), F.min(F.when(F.col("ordinal") == at, F.col("name"))).over(row), F.lit("TargetRecipe"))
    carries = (F.col("column_type") == "Quantity") | F.col("quantity").isNotNull()
    beside = F.array_sort(F.collect_list(F.when(carries, F.struct("ordinal", "quantity"))).over(row))
    other = F.get(F.filter("beside", lambda x: x["ordinal"] != F.col("ordinal")), F.lit(0))["quantity"]
    out = found.withColumn("subject", heads).withColumn("beside", beside).withColumn("quantity", F.coalesce("quantity", other))
    out = out.filter((at.isNull() | (F.col("ordinal") != at)) & (F.col("role") != "quantity") & (F.col("column_type") != "Quantity"))
    is_a = lambda role, kind: (F.col("role") == role) | (F.col("column_type") == kind)
    predicate = F.when(is_a("cost", "Currency"), "costsCurrency").when(is_a("discipline", "CraftingDiscipline"), "requiresDiscipline").when(is_a("ingredient", "CraftingMaterial"), "requiresMaterial").otherwise("hasIngredient")
    return out.select("row_id", "subject", predicate.alias("predicate"), F.col("name").alias("object"), "quantity")


def row_attributes(cells: DataFrame) -> DataFrame:
    """cells(row_id, ordinal, header, value) -> row_id with quantity, discipline, min_rating, vendor, zone and tier.

    A header belongs to the first attribute that has a word in it; of several such columns the last one with a value
    counts. Numbers are a cell's digits put together.
    """
    name = _first([(_holds(F.col("header"), words), F.lit(a)) for a, words in headers.ATTRIBUTES], F.lit(None).cast("string"))
    digits = F.regexp_replace("value", "[^0-9]", "")
    rows = cells.select("row_id", "ordinal", name.alias("name"), F.trim("value").alias("value")).filter("value <> ''")
    rows = rows.withColumn("value", F.when(F.col("name").isin(*headers.NUMERIC_ATTRIBUTES), F.nullif(digits, F.lit(""))).otherwise(F.col("value")))
    of = lambda a: F.max_by(F.when(F.col("name") == a, F.col("value")), F.when((F.col("name") == a) & F.col("value").isNotNull(), F.col("ordinal")))
    kind = lambda a: "long" if a in headers.NUMERIC_ATTRIBUTES else "string"
    return rows.groupBy("row_id").agg(*(of(a).try_cast(kind(a)).alias(a) for a, _ in headers.ATTRIBUTES))


def baseline_types(columns: DataFrame) -> DataFrame:
    """columns(ordinal, header) -> also type and confidence, by words in the header alone."""
    say = lambda kind, conf: F.struct(F.lit(kind).alias("type"), F.lit(conf).alias("confidence"))
    cases = [(_holds(F.col("header"), words), say(kind, conf)) for words, kind, conf in headers.BASELINE]
    return columns.select("ordinal", "header", _first(cases, say(*headers.BASELINE_ELSE)).alias("t")).select("ordinal", "header", "t.*")


def baseline_pairs(columns: DataFrame) -> DataFrame:
    """columns(ordinal, header) -> (source, target, relation, confidence): each column relates to the next. A header is small."""
    following = F.lead("header").over(Window.orderBy("ordinal"))
    pairs = columns.select("ordinal", F.col("header").alias("source"), following.alias("target")).filter("target is not null")
    return pairs.select("source", "target", F.lit(headers.BASELINE_PAIR[0]).alias("relation"), F.lit(headers.BASELINE_PAIR[1]).alias("confidence"))


def baseline_validity(linked: DataFrame, n_pairs: int) -> DataFrame:
    """linked(text, uri, score), a row per linked cell -> (n_cells, n_unknown, n_doubtful, n_violations, validity).

    A cell is doubtful if no entity was found for it or if a text of letters and digits scores under 0.6. Violations are the
    unknown, the doubtful and the pairs, none of which the baseline can justify.
    """
    unknown = F.col("uri").contains("unknown")
    mixed = (F.col("score") < 0.60) & F.col("text").rlike(r"\p{N}") & F.col("text").rlike(r"\p{L}")
    out = linked.agg(F.count("*").alias("n_cells"), F.count_if(unknown).alias("n_unknown"), F.count_if(unknown | mixed).alias("n_doubtful"))
    good = F.greatest(F.lit(0), F.col("n_cells") - F.col("n_unknown") - F.col("n_doubtful"))
    return out.select("*", (F.col("n_unknown") + F.col("n_doubtful") + n_pairs).alias("n_violations"), F.when(F.col("n_cells") > 0, F.round(good / F.col("n_cells"), 4)).otherwise(F.lit(0.0)).alias("validity"))
