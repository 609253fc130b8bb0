"""Three-phase column annotation: values that prove a property, bounds and relations that leave one, an arbiter for ties.

Domain knowledge comes in as rows: schemes(scheme, label), scheme -> property, known ids, and ordered integer rules.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.cells import chat_link_id
from strataweave.functions.normalize import tokenize_string
from strataweave.operators.profile import cells

#: Share of a column's (distinct) values that must fit for an anchor.
ANCHOR = 0.85


@dataclass(frozen=True)
class IntegerRule:
    """The first free integer column whose values lie in [lo, hi], with so many distinct values, takes the property."""

    property: str
    confidence: float
    lo: float = float("-inf")
    hi: float = float("inf")
    least_max: float = float("-inf")
    least_distinct: int = 1
    most_distinct: int = 1 << 62


def scheme_coverage(table: DataFrame, schemes: DataFrame) -> DataFrame:
    """(column_name, scheme, coverage): share of a column's distinct lower-case values that are labels of the scheme."""
    values = cells(table).filter("value is not null").select("column_name", F.lower("value").alias("v")).distinct()
    n = values.groupBy("column_name").agg(F.count("*").alias("n"))
    labels = schemes.select("scheme", F.lower("label").alias("v")).distinct()
    hit = values.join(F.broadcast(labels), "v").groupBy("column_name", "scheme").agg(F.count("*").alias("hit"))
    return hit.join(n, "column_name").select("column_name", "scheme", (F.col("hit") / F.col("n")).alias("coverage"))


def id_overlap(table: DataFrame, known: DataFrame) -> DataFrame:
    """(column_name, kind, overlap): share of a column's distinct integers among known(kind, id)."""
    values = cells(table).filter(F.col("value").rlike("^[0-9]+$")).select("column_name", F.col("value").cast("long").alias("id")).distinct()
    n = values.groupBy("column_name").agg(F.count("*").alias("n"))
    hit = values.join(known.select("kind", "id").distinct(), "id").groupBy("column_name", "kind").agg(F.count("*").alias("hit"))
    return hit.join(n, "column_name").select("column_name", "kind", (F.col("hit") / F.col("n")).alias("overlap"))


def ordered_pairs(table: DataFrame, columns: list[str]) -> DataFrame:
    """(low, high): pairs of columns with low <= high on every row where both are positive, and not always equal. One pass."""
    number = {c: F.expr(f"try_cast(`{c}` as double)") for c in columns}
    pairs = [(a, b) for a in columns for b in columns if a != b]
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = (number[a] > 0) & (number[b] > 0)
        aggs += [F.min(F.when(both, number[a] <= number[b])).alias(f"le{i}"), F.max(F.when(both, number[a] < number[b])).alias(f"lt{i}")]
    if not pairs:
        return table.sparkSession.createDataFrame([], "low string, high string")
    one = table.agg(*aggs)
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"), (F.col(f"le{i}") & F.col(f"lt{i}")).alias("ok")) for i, (a, b) in enumerate(pairs))))
    return one.select(rows.alias("r")).filter("r.ok").select("r.low", "r.high")


def chat_links_match(table: DataFrame, code_column: str, id_column: str) -> DataFrame:
    """One row: share of rows whose decoded chat code is the id beside it."""
    same = chat_link_id(F.col(f"`{code_column}`")) == F.expr(f"try_cast(`{id_column}` as bigint)")
    return table.agg(F.coalesce(F.avg(same.cast("double")), F.lit(0.0)).alias("verified"))


def annotate(table: DataFrame, profile: DataFrame, coverage: DataFrame, scheme_property: dict[str, str], rules: list[IntegerRule], label: str, ties: tuple[str, ...], comments: dict[str, str], arbiter: Callable[[str, list[str]], str | None] | None = None) -> list[tuple[str, str, float, str]]:
    """(column, property, confidence, phase) of each column that gets one.

    profile as from profile3, coverage as from scheme_coverage: a few rows per column, decided on the driver because each
    rule takes one column and later rules see what is left.
    """
    best = {}
    for r in coverage.filter(F.col("coverage") >= ANCHOR).orderBy("column_name", F.col("coverage").desc(), "scheme").collect():
        best.setdefault(r.column_name, (r.scheme, r.coverage))
    out, left = [], []
    for p in profile.orderBy("ordinal").collect():
        if p.chat_code_ratio >= ANCHOR:
            out.append((p.column_name, "chatCode", 1.0, "anchor"))
        elif p.image_url_ratio >= ANCHOR:
            out.append((p.column_name, "icon", 1.0, "anchor"))
        elif p.is_string and p.column_name in best and best[p.column_name][0] in scheme_property:
            out.append((p.column_name, scheme_property[best[p.column_name][0]], float(best[p.column_name][1]), "anchor"))
        elif p.n_values:
            left.append(p)
    for rule in rules:
        fits = lambda p: p.is_integer and rule.lo <= p.min_int <= p.max_int <= rule.hi and p.max_int >= rule.least_max and rule.least_distinct <= round(p.uniqueness * p.n_values) <= rule.most_distinct  # noqa: B023, E731
        hit = next((p for p in left if fits(p)), None)
        if hit is not None:
            out.append((hit.column_name, rule.property, rule.confidence, "propagation"))
            left.remove(hit)
    for p in left:
        if not p.is_string:
            continue
        if p.uniqueness >= 0.90 and (not (p.has_space or p.has_comma) or p.avg_length < 35):
            out.append((p.column_name, label, 0.98, "propagation"))
        elif ties:
            chosen = arbiter(p.column_name, list(ties)) if arbiter is not None else None
            out.append((p.column_name, chosen or _closest(p.column_name, ties, comments), 0.92, "arbiter"))
    return out


def _closest(column: str, ties: tuple[str, ...], comments: dict[str, str]) -> str:
    """The tied property whose name and comment share most words with the column's name; the first if none does."""
    import re

    words = lambda s: set(re.findall("[a-z0-9]+", re.sub("([a-z])([A-Z])", r"\1 \2", s).lower()))
    return max(ties, key=lambda t: (len(words(column) & words(f"{t} {comments.get(t, '')}")), -ties.index(t)))


def header_overlap(columns: DataFrame, properties: DataFrame) -> DataFrame:
    """(column_name, uri, shared): words a header shares with a property's label, best first by rank."""
    c = columns.select("column_name", F.array_distinct(tokenize_string(F.col("column_name"))).alias("ct"))
    p = properties.select("uri", F.array_distinct(tokenize_string(F.col("label"))).alias("pt"))
    met = c.join(F.broadcast(p), F.arrays_overlap("ct", "pt")).select("column_name", "uri", F.size(F.array_intersect("ct", "pt")).alias("shared"))
    order = Window.partitionBy("column_name").orderBy(F.col("shared").desc(), "uri")
    return met.withColumn("rank", F.row_number().over(order))
