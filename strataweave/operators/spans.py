"""Entity spans with offsets and adjacent quantities, and the slots of a clause."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPAN = "array<struct<start:int,end:int,name:string,kind:string,quantity:double>>"


def entity_spans(docs: DataFrame, vocabulary: list[tuple[str, str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end, name, kind, quantity): whole-word mentions of vocabulary (name, kind), longest names first; a mention
    inside one already taken is dropped; a number right before it ("3x", "250") is its quantity.

    Overlaps depend on what was taken before, so this is an Arrow-batched function; the vocabulary is a small dimension.
    """
    order = sorted(set(vocabulary), key=lambda v: (-len(v[0]), v))
    kinds = {n.lower(): (n, k) for n, k in reversed(order)}
    pattern = re.compile("|".join(rf"(?<!\w){re.escape(n)}(?!\w)" for n, _ in order) or r"(?!)", re.I)
    amount = re.compile(r"(\d+(?:[.,]\d+)?)\s*x?\s*$", re.I)

    def find(t: str | None) -> list[dict]:
        out = []
        for m in pattern.finditer(t or ""):
            before = amount.search(t[max(0, m.start() - 16) : m.start()])
            name, kind = kinds[m[0].lower()]
            out.append({"start": m.start(), "end": m.end(), "name": name, "kind": kind, "quantity": float(before[1].replace(",", "")) if before else None})
        return out

    @F.pandas_udf(_SPAN)
    def run(s: pd.Series) -> pd.Series:
        return s.map(find)

    return docs.select(key, F.explode(run(F.col(text))).alias("s")).select(key, "s.*")


def clause_slots(clauses: DataFrame, spans: DataFrame, zones: tuple[str, ...] = (), vendors: tuple[str, ...] = (), disciplines: tuple[str, ...] = ()) -> DataFrame:
    """clauses(frame, clause) and spans(frame, start, name, kind, quantity) -> (frame, pos, name, value): entity, quantity,
    discipline, rating, cost, zone and vendor slots, by where they stand."""
    one = lambda name, pattern, group=0: clauses.select("frame", F.lit(1_000_000).alias("pos"), F.lit(name).alias("name"), F.regexp_extract("clause", pattern, group).alias("value")).filter("value <> ''")
    listed = lambda name, words: one(name, r"(?i)\b(" + "|".join(map(re.escape, words)) + r")\b", 1) if words else None
    out = spans.select("frame", F.col("start").alias("pos"), F.lit("entity").alias("name"), F.col("name").alias("value"))
    out = out.unionByName(spans.filter("quantity is not null").select("frame", F.col("start").alias("pos"), F.lit("quantity").alias("name"), F.col("quantity").cast("string").alias("value")))
    rest = [one("rating", r"(?i)\b(?:rating|level|lvl)\s*(\d{1,4})\b", 1), one("cost", r"(?i)\b\d[\d,]*\s*(?:gold|silver|copper|karma|g|s|c)\b"), listed("discipline", disciplines), listed("zone", zones), listed("vendor", vendors)]
    for part in rest:
        if part is not None:
            out = out.unionByName(part)
    return out


def anchor_entity(spans: DataFrame, priority: tuple[str, ...]) -> DataFrame:
    """(frame, anchor): a frame's span of the first kind in ``priority`` that it has, else its first span."""
    rank = F.coalesce(*(F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(priority)), F.lit(len(priority)))
    return spans.groupBy("frame").agg(F.min_by("name", F.struct(rank, F.col("start"))).alias("anchor"))
