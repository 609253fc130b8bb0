"""Column profiles and roles from the shapes of values alone. One aggregate pass over the table, whatever its width."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.normalize import missing_to_null

# Shapes of identifiers, numbers, measurements and dates.
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
STRUCTURED_ID = r"^[A-Za-z0-9_-]+[:#_-][A-Za-z0-9_-]+$|^[0-9]{4,}$|^[&\[][A-Za-z0-9+/=]{4,}[&\]]?$"
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
MEASUREMENT = r"^-?[0-9]+(?:\.[0-9]+)?\s*([A-Za-z%°/]+)$"
ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T\s][0-9]{2}:[0-9]{2}(?::[0-9]{2})?(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d", "d-M-yyyy", "d/M/yyyy", "yyyy-M-d H:m:s")


def is_id_shaped(v: Column) -> Column:
    return v.rlike(UUID) | v.rlike(STRUCTURED_ID)


def is_numeric(v: Column) -> Column:
    return F.replace(v, F.lit(",")).rlike(NUMBER)


def number_of(v: Column) -> Column:
    """The value of a number with commas; null for anything else."""
    return F.when(is_numeric(v), F.replace(v, F.lit(",")).cast("double"))


def leading_number(v: Column) -> Column:
    """The value of a number, or of the number that a text begins with; null for any other text."""
    first = F.nullif(F.regexp_extract(F.replace(F.trim(v), F.lit(",")), r"^[+-]?[0-9]+(?:\.[0-9]+)?", 0), F.lit(""))
    return F.coalesce(number_of(v), first.cast("double"))


def numeric_summary(table: DataFrame) -> DataFrame:
    """(column_name, min_value, max_value) over leading numbers; columns without one have nulls. One aggregate."""
    v = leading_number(F.col("value"))
    return cells(table).groupBy("column_name").agg(F.min(v).alias("min_value"), F.max(v).alias("max_value"))


def is_timestamp(v: Column) -> Column:
    tried = [F.coalesce(F.try_to_timestamp(v, F.lit(f)).isNotNull(), F.lit(False)) for f in DATE_FORMATS]
    some = tried[0]
    for t in tried[1:]:
        some = some | t
    return (F.length(v) >= 8) & (v.rlike(ISO_DATE) | (v.rlike(r"^[0-9]{1,4}[-/][0-9]{1,2}[-/][0-9]{1,4}( [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2})?$") & some))


def measurement_unit(v: Column) -> Column:
    """The unit of a number with a unit of up to 8 characters; null for anything else."""
    unit = F.regexp_extract(v, MEASUREMENT, 1)
    return F.when((unit != "") & (F.length(unit) <= 8), unit)


def cells(table: DataFrame, row_id: str | None = None) -> DataFrame:
    """The table in long form: ordinal, column_name, value (trimmed, null where missing), and row_id if named."""
    names = [c for c in table.columns if c != row_id]
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column_name"), missing_to_null(F.col(f"`{c}`")).alias("value")) for i, c in enumerate(names))))
    keys = [] if row_id is None else [F.col(f"`{row_id}`").alias("row_id")]
    return table.select(*keys, pairs.alias("c")).select(*([] if row_id is None else ["row_id"]), "c.*")


def column_stats(table: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: counts, cardinality, shape ratios, mean length, numeric bounds, five smallest samples.

    Partial aggregates travel, not cells; the exact distinct count needs the distinct values of each column shuffled once,
    ``approximate`` replaces it by a sketch for tables where that is too much.
    """
    v = F.col("value")
    share = lambda cond: F.coalesce(F.avg(F.when(v.isNotNull(), cond.cast("double"))), F.lit(0.0))
    long = cells(table)
    if approximate:
        grouped = long.groupBy("ordinal", "column_name")
        weight, distinct = F.lit(1), F.approx_count_distinct("value")
        return _stats(grouped, v, weight, distinct, share)
    # Shape tests run once per distinct value, weighted by how often it occurs.
    values = long.groupBy("ordinal", "column_name", "value").agg(F.count("*").alias("n"))
    tested = values.select("ordinal", "column_name", "value", "n", is_id_shaped(v).alias("is_id"), is_numeric(v).alias("is_num"), is_timestamp(v).alias("is_ts"), measurement_unit(v).isNotNull().alias("is_meas"), number_of(v).alias("num"))
    some = F.sum(F.when(v.isNotNull(), F.col("n")).otherwise(0))
    ratio = lambda cond: F.coalesce(F.try_divide(F.sum(F.when(v.isNotNull() & cond, F.col("n")).otherwise(0)).cast("double"), some), F.lit(0.0))
    return tested.groupBy("ordinal", "column_name").agg(
        F.sum("n").alias("total_count"),
        some.alias("non_empty_count"),
        F.count("value").alias("cardinality"),
        F.coalesce(F.try_divide(F.count("value").cast("double"), some), F.lit(0.0)).alias("uniqueness_ratio"),
        ratio(F.col("is_id")).alias("id_shape_ratio"),
        ratio(F.col("is_num")).alias("numeric_ratio"),
        F.coalesce(F.try_divide(F.sum(F.length("value") * F.col("n")).cast("double"), some), F.lit(0.0)).alias("avg_str_len"),
        ratio(F.col("is_ts")).alias("timestamp_ratio"),
        ratio(F.col("is_meas")).alias("measurement_ratio"),
        F.min("num").alias("min_value"),
        F.max("num").alias("max_value"),
        F.min(F.when(F.col("is_meas"), F.col("value"))).alias("_measured"),
        F.min("value").alias("sample_value"),
    )


def _stats(grouped, v: Column, weight: Column, distinct: Column, share) -> DataFrame:
    return grouped.agg(
        F.count("*").alias("total_count"), F.count("value").alias("non_empty_count"), distinct.alias("cardinality"),
        F.coalesce(F.least(F.lit(1.0), F.try_divide(distinct.cast("double"), F.count("value"))), F.lit(0.0)).alias("uniqueness_ratio"),
        share(is_id_shaped(v)).alias("id_shape_ratio"), share(is_numeric(v)).alias("numeric_ratio"), F.coalesce(F.avg(F.length("value")), F.lit(0.0)).alias("avg_str_len"),
        share(is_timestamp(v)).alias("timestamp_ratio"), share(measurement_unit(v).isNotNull()).alias("measurement_ratio"),
        F.min(number_of(v)).alias("min_value"), F.max(number_of(v)).alias("max_value"), F.min(F.when(measurement_unit(v).isNotNull(), v)).alias("_measured"), F.min("value").alias("sample_value"),
    )


def column_roles(stats: DataFrame) -> DataFrame:
    """stats -> also role, confidence, unit and is_primary. Limits are tested in the order they stand."""
    s = {c: F.col(c) for c in stats.columns}
    tier = F.when(s["id_shape_ratio"] >= 0.70, 2.0).when((s["numeric_ratio"] >= 0.85) & (s["avg_str_len"] <= 12), 1.5).when(s["avg_str_len"] <= 60, 1.0)
    tier = F.when((s["non_empty_count"] > 0) & (s["uniqueness_ratio"] >= 0.85), tier)
    best = Window.orderBy(tier.desc_nulls_last(), s["uniqueness_ratio"].desc(), s["ordinal"])
    out = stats.withColumn("is_primary", (F.row_number().over(best) == 1) & tier.isNotNull())
    role = lambda name, conf: F.struct(F.lit(name).alias("role"), F.lit(conf).alias("confidence"))
    small = (s["uniqueness_ratio"] <= 0.35) | ((s["cardinality"] <= 25) & ((s["total_count"] < 5) | (s["uniqueness_ratio"] <= 0.50)))
    picked = (
        F.when(s["non_empty_count"] == 0, role("Skip", 1.0))
        .when((s["cardinality"] == 1) & (s["total_count"] > 3), role("Skip", 0.95))
        .when(s["avg_str_len"] > 300, role("Skip", 0.85))
        .when(F.col("is_primary"), role("Entity ID", 0.98))
        .when((s["id_shape_ratio"] >= 0.70) & (s["uniqueness_ratio"] >= 0.85), role("Entity ID", 0.90))
        .when(s["id_shape_ratio"] >= 0.70, role("Foreign Key", 0.92))
        .when(s["timestamp_ratio"] >= 0.80, role("Timestamp", 0.95))
        .when(s["measurement_ratio"] >= 0.70, role("Measurement value/unit pair", 0.90))
        .when(s["numeric_ratio"] >= 0.85, role("Numeric property", 0.95))
        .when((s["avg_str_len"] <= 50) & small, role("Categorical", 0.90))
        .otherwise(role("Text", 0.85))
    )
    out = out.withColumn("_r", picked)
    unit = F.when(F.col("_r.role") == "Measurement value/unit pair", measurement_unit(F.col("_measured")))
    return out.select("*", "_r.role", "_r.confidence", unit.alias("unit")).drop("_r", "_measured")


def profile3(table: DataFrame) -> DataFrame:
    """The three-phase annotator's profile: value type, integer bounds, uniqueness, blanks, commas, chat codes, image links."""
    v = F.col("value")
    every = lambda cond: F.coalesce(F.min(F.when(v.isNotNull(), cond)), F.lit(False))
    is_int = v.rlike("^[+-]?[0-9]+$")
    some = F.count("value")
    ratio = lambda cond: F.coalesce(F.try_divide(F.count_if(cond).cast("double"), some), F.lit(0.0))
    out = cells(table).groupBy("ordinal", "column_name").agg(
        some.alias("n_values"), F.count_distinct("value").alias("n_distinct"), every(is_int).alias("is_integer"), every(is_numeric(v)).alias("_numeric"),
        F.min(F.when(is_int, v.cast("decimal(38,0)"))).cast("double").alias("min_int"), F.max(F.when(is_int, v.cast("decimal(38,0)"))).cast("double").alias("max_int"),
        F.coalesce(F.avg(F.length("value")), F.lit(0.0)).alias("avg_length"),
        F.coalesce(F.max(v.contains(" ")), F.lit(False)).alias("has_space"), F.coalesce(F.max(v.contains(",")), F.lit(False)).alias("has_comma"),
        ratio(v.rlike(r"^\[&[A-Za-z0-9+/=]+\]$")).alias("chat_code_ratio"), ratio(F.lower(v).rlike(r"^https?://.*\.(png|jpe?g|gif|webp|svg)")).alias("image_url_ratio"),
    )
    unique = F.coalesce(F.try_divide(F.col("n_distinct").cast("double"), F.col("n_values")), F.lit(0.0))
    bound = lambda c: F.when(F.col("is_integer"), F.col(c))
    return out.select("ordinal", "column_name", "n_values", "is_integer", (F.col("_numeric") & ~F.col("is_integer")).alias("is_float"), (~F.col("_numeric")).alias("is_string"), bound("min_int").alias("min_int"), bound("max_int").alias("max_int"), unique.alias("uniqueness"), "avg_length", "has_space", "has_comma", "chat_code_ratio", "image_url_ratio")


def table_type(table: DataFrame) -> DataFrame:
    """One row: CraftingRecipe if a header speaks of ingredients or amounts, MysticForgeRecipe at exactly 4 rows without a
    discipline header, else GenericTable."""
    heads = [c.lower() for c in table.columns]
    has = lambda *words: any(w in h for h in heads for w in words)
    kind = F.lit("CraftingRecipe" if has("ingredient", "material", "component", "quantity", "qty", "amount") else "GenericTable")
    four = (F.col("n_rows") == 4) & F.lit(not has("discipline", "profession"))
    return table.agg(F.count("*").alias("n_rows")).select("n_rows", F.when(four, "MysticForgeRecipe").otherwise(kind).alias("table_type"))
