"""Column name -> ontology property: a ladder of ever weaker matches, axiom and bounds vetoes, an arbiter for near ties.

Columns and properties are both small (columns of one table, properties of an ontology); they meet in one broadcast join
scored by expressions. The few properties that have a score are decided between on the driver, by (rung, score, IRI).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from strataweave.functions.normalize import normalize_string, tokenize_string
from strataweave.functions.similarity import HashedTfidf, seq_ratio_udf
from strataweave.operators.ontology import BOOLEAN, NUMERIC, STRINGS, TEMPORAL

METHODS = {1: "Stage0-Exact", 2: "Stage0-Normalised", 3: "Stage0-TokenSubset", 4: "Stage0-Containment", 5: "Stage0-Fuzzy", 6: "FAISS-Edge"}
UNMAPPED = "urn:strataweave:unmapped_property"
# Suffixes and the probes each gives ({} is the name without it).
SUFFIX_PROBES = (
    (("_ID", "_IDENTIFIER", "_CODE", "_UUID"), ("{} identifier", "{} id", "has {} identifier", "{}")),
    (("_VALUE", "_VAL"), ("{}", "{} value", "has {}")),
    (("_UNIT", "_UNITS"), ("{} unit", "{}")),
    (("_PERCENT", "_PCT", "_PERCENTAGE"), ("{} percentage", "{} ratio", "{}")),
)


def _all_in(ranges: Column, family: tuple[str, ...]) -> Column:
    return F.forall(ranges, lambda r: r.isin(*family))


def _any_in(ranges: Column, family: tuple[str, ...]) -> Column:
    return F.exists(ranges, lambda r: r.isin(*family))


def violates_axiom(role: Column, property_type: Column, ranges: Column) -> Column:
    """Whether a property's ranges rule out a column of this role; an open range never does."""
    number = (property_type == "ObjectProperty") | _all_in(ranges, STRINGS) | _all_in(ranges, TEMPORAL) | _all_in(ranges, BOOLEAN)
    text = _all_in(ranges, NUMERIC) | _all_in(ranges, TEMPORAL)
    time = _all_in(ranges, NUMERIC) | _all_in(ranges, BOOLEAN)
    by_role = F.when(role.isin("Numeric property", "Measurement value/unit pair"), number).when(role.isin("Categorical", "Text"), text).when(role == "Timestamp", time).otherwise(F.lit(False))
    return (F.size(ranges) > 0) & by_role


def violates_bounds(lo: Column, hi: Column, least: Column, most: Column) -> Column:
    return F.coalesce(lo < least, F.lit(False)) | F.coalesce(hi > most, F.lit(False))


def ranges_compatible(a: Column, b: Column) -> Column:
    """Open, overlapping or of one family."""
    same = F.arrays_overlap(a, b)
    for family in (NUMERIC, STRINGS, TEMPORAL, BOOLEAN):
        same = same | (_any_in(a, family) & _any_in(b, family))
    return (F.size(a) == 0) | (F.size(b) == 0) | F.coalesce(same, F.lit(False))


def subset_score(q: Column, t: Column) -> Column:
    """Token-subset score of two token sets; null unless one holds the other."""
    ratio = F.size(F.array_intersect(q, t)) / F.size(F.array_union(q, t))
    holds = (F.size(q) > 0) & (F.size(t) > 0) & ((F.size(F.array_except(q, t)) == 0) | (F.size(F.array_except(t, q)) == 0))
    return F.when(holds, F.when(ratio >= 0.5, 0.70 + 0.22 * ratio).otherwise(0.50 + 0.25 * ratio))


def containment_score(q: Column, t: Column) -> Column:
    """Score of one squeezed text inside the other; null unless it is."""
    ratio = F.least(F.length(q), F.length(t)) / F.greatest(F.length(q), F.length(t))
    return F.when((q != "") & (t != "") & (q.contains(t) | t.contains(q)), 0.51 + 0.34 * ratio)


def _best_rung(*rungs: tuple[int, Column]) -> Column:
    """struct(rung, score) of the first rung with a score."""
    return F.coalesce(*(F.when(score.isNotNull(), F.struct(F.lit(rung).alias("rung"), F.round(score, 4).alias("score"))) for rung, score in rungs))


def with_labels(dimension: DataFrame) -> DataFrame:
    """A row per label of each class or property (its own, the alternatives, the preferred one), squeezed and in tokens."""
    every = F.array_distinct(F.filter(F.concat(F.array("label"), "alt_labels", F.array("pref_label")), lambda x: x.isNotNull()))
    out = dimension.select("uri", F.explode(every).alias("lab"))
    return out.select("uri", F.lower(F.trim("lab")).alias("low"), normalize_string(F.col("lab")).alias("tn"), F.array_distinct(tokenize_string(F.col("lab"))).alias("tt"))


def _asked(queries: DataFrame) -> DataFrame:
    q = F.trim("query")
    return queries.select("query").distinct().select("query", F.lower(q).alias("q_low"), normalize_string(q).alias("qn"), F.array_distinct(tokenize_string(q)).alias("qt"))


def _scored(pairs: DataFrame, m: Column) -> DataFrame:
    """(query, uri, rung, score): each pair's first rung with a score, from its best label."""
    hits = pairs.select("query", "uri", m.alias("m")).filter("m is not null")
    return hits.groupBy("query", "uri").agg(F.min(F.struct(F.col("m.rung").alias("rung"), (-F.col("m.score")).alias("minus"))).alias("b")).select("query", "uri", "b.rung", (-F.col("b.minus")).alias("score"))


def score_pairs(queries: DataFrame, properties: DataFrame) -> DataFrame:
    """queries(query) x properties -> (query, uri, rung, score), rungs 1 to 5. Text is prepared once per query and label."""
    pairs = _asked(queries).join(F.broadcast(with_labels(properties))).withColumn("ratio", seq_ratio_udf("qn", "tn"))
    q, t = F.col("qn"), F.col("tn")
    fuzzy = F.when(F.col("ratio") >= 0.65, F.col("ratio") * 0.92)
    return _scored(pairs, _best_rung((1, F.when(F.col("q_low") == F.col("low"), 0.98)), (2, F.when(q == t, 0.95)), (3, subset_score(F.col("qt"), F.col("tt"))), (4, containment_score(q, t)), (5, fuzzy)))


def dense_pairs(queries: DataFrame, summaries: list[tuple[str, str]]) -> DataFrame:
    """(query, uri, dense) for every query and summary (uri, text): cosine of hashed TF-IDF vectors. Both sides are small."""
    model = HashedTfidf([t for _, t in summaries])
    uris = [u for u, _ in summaries]

    @F.pandas_udf("array<struct<uri:string,dense:double>>")
    def run(q: pd.Series) -> pd.Series:
        return q.map(lambda x: [{"uri": u, "dense": float(s)} for u, s in zip(uris, model.rows @ model.encode(x or ""), strict=True)])

    return queries.select("query").distinct().withColumn("d", F.explode(run("query"))).select("query", "d.uri", "d.dense")


def property_summaries(properties: DataFrame) -> list[tuple[str, str]]:
    text = F.concat_ws(" ", "label", F.array_join("alt_labels", " "), F.coalesce("comment", F.lit("")))
    return [tuple(r) for r in properties.select("uri", text).orderBy("uri").collect()]


def probes(columns: DataFrame) -> DataFrame:
    """(column_name, nth, query): the spellings a structural suffix suggests."""
    name, found = F.trim("column_name"), F.array().cast("array<string>")
    for suffixes, forms in SUFFIX_PROBES:
        base = F.coalesce(*(F.when(F.upper(name).endswith(s), F.regexp_replace(F.substring(name, F.lit(1), F.length(name) - len(s)), "^[_ ]+|[_ ]+$", "")) for s in suffixes))
        made = F.array(*(F.concat(F.lit(f.split("{}")[0]), base, F.lit(f.split("{}")[1])) for f in forms))
        found = F.concat(found, F.when(base.isNotNull(), made).otherwise(F.array().cast("array<string>")))
    return columns.select("column_name", F.posexplode(found).alias("nth", "query"))


def small(df: DataFrame) -> DataFrame:
    """Rows of column-by-ontology size, held by the driver from here on: later steps plan against a table, not its history.

    One partition: whatever is grouped, ranked or joined from it needs no shuffle.
    """
    return df.sparkSession.createDataFrame([tuple(r) for r in df.collect()], _nullable(df.schema)).coalesce(1)


def _nullable(kind):
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, _nullable(f.dataType), True) for f in kind.fields])
    return kind


def _rounded(x: float, digits: int) -> float:
    """Half away from zero, as the expressions round."""
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def vetoed(role: str, kind: str, ranges: list[str]) -> bool:
    """violates_axiom of plain values."""
    every = lambda *families: any(all(r in f for r in ranges) for f in families)
    if not ranges:
        return False
    if role in ("Numeric property", "Measurement value/unit pair"):
        return kind == "ObjectProperty" or every(STRINGS, TEMPORAL, BOOLEAN)
    return every(NUMERIC, TEMPORAL) if role in ("Categorical", "Text") else every(NUMERIC, BOOLEAN) if role == "Timestamp" else False


def outside(lo: float | None, hi: float | None, least: float | None, most: float | None) -> bool:
    """violates_bounds of plain values."""
    return (lo is not None and least is not None and lo < least) or (hi is not None and most is not None and hi > most)


def compatible(a: list[str], b: list[str]) -> bool:
    """ranges_compatible of plain values."""
    of_family = lambda f: any(r in f for r in a) and any(r in f for r in b)
    return not a or not b or bool(set(a) & set(b)) or any(map(of_family, (NUMERIC, STRINGS, TEMPORAL, BOOLEAN)))


def _tokens(text: str | None) -> list[str]:
    """tokenize_string of plain text, each token once."""
    text = re.sub("([a-zA-Z])([0-9])", r"\1 \2", re.sub("([0-9])([A-Za-z])", r"\1 \2", re.sub("([a-z])([A-Z])", r"\1 \2", text or "")))
    return list(dict.fromkeys(re.findall("[a-z0-9]+", text.lower())))


#: Nearest properties by dense similarity that an arbiter looks at, and of them in its pool.
NEAREST, POOL = 16, 8


@dataclass
class _Column:
    name: str
    role: str
    lo: float | None
    hi: float | None


class _Ladder:
    """What one column can be: its scored properties by spelling (own name: -1, then probes), and the nearest by meaning."""

    def __init__(self, column: _Column, facts: dict[str, dict], domain: str | None):
        self.column, self.facts, self.domain = column, facts, domain
        self.rows: list[tuple[int, str, int, float]] = []  # nth, uri, rung, score
        self.near: list[tuple[float, str]] = []  # dense, uri

    def barred(self, uri: str) -> bool:
        return vetoed(self.column.role, self.facts[uri]["property_type"], self.facts[uri]["ranges"])

    def beyond(self, uri: str) -> bool:
        return outside(self.column.lo, self.column.hi, self.facts[uri]["min_inclusive"], self.facts[uri]["max_inclusive"])

    def top(self, nth: int) -> tuple[str, float, int] | None:
        """(uri, score, rung) of the lowest rung, its best score, the first IRI."""
        found = min(((r, -s, u) for n, u, r, s in self.rows if n == nth and not self.barred(u)), default=None)
        return found and (found[2], -found[1], found[0])

    def candidate(self) -> tuple[str, float, int] | None:
        """The column's own best, or a probe's that is better: the first from 0.95 on, else the best; within bounds. Else the
        nearest by meaning that nothing rules out."""
        own, best = self.top(-1), None
        for nth in sorted({n for n, *_ in self.rows if n >= 0}):
            found = self.top(nth)
            if found and (best is None or (best[1] < 0.95 and found[1] > best[1])):
                best = found
        if best and (own is None or (best[1] > own[1] and not self.beyond(best[0]))):
            own = best
        if own and not self.beyond(own[0]):
            return own
        edge = max(((s, u) for n, u, r, s in self.rows if n == -1 and r == 6 and not self.barred(u) and not self.beyond(u)), default=None)
        return edge and (edge[1], edge[0], 6)

    def rivals(self, chosen: tuple[str, float, int] | None) -> tuple[list[tuple[float, str]], bool]:
        """(score, uri) of properties from 0.40 on whose ranges go with the best one's, best first, and whether the second is within
        0.15 of the best, or the best under 0.90."""
        lowest: dict[str, tuple[int, float]] = {}
        for n, u, r, s in self.rows:
            if n == -1 and not self.barred(u) and (u not in lowest or r < lowest[u][0]):
                lowest[u] = (r, s)
        scores = {u: s for u, (_, s) in lowest.items()} | ({chosen[0]: chosen[1]} if chosen else {})
        line = sorted((-s, u) for u, s in scores.items() if s >= 0.40)
        out = [(-s, u) for s, u in line if compatible(self.facts[u]["ranges"], self.facts[line[0][1]]["ranges"])]
        return out, len(out) > 1 and (out[1][0] >= -line[0][0] - 0.15 or -line[0][0] < 0.90)

    def pool(self, rivals: list[tuple[float, str]]) -> list[dict]:
        """What an arbiter chooses from: the rivals, then the nearest by meaning, less what roles and bounds rule out."""
        close = sorted((-d, u) for d, u in self.near)[:NEAREST]
        close = [(-d, u) for d, u in close if -d >= max(0.18, 0.40 * -close[0][0])]
        line = [(s, u, True) for s, u in rivals] + [(d, u, False) for d, u in close if u not in {x for _, x in rivals}]
        held = lambda u: not self.facts[u]["domains"] or self.domain in self.facts[u]["domains"]
        line = [x for x in line if x[2] or self.domain is None or held(x[1])]
        line = [x for i, x in enumerate(line) if x[2] or i < POOL]
        return [self.facts[u] | {"column_name": self.column.name, "role": self.column.role, "arb": s + self.bonus(u)} for s, u, _ in line if not self.barred(u) and not self.beyond(u)]

    def bonus(self, uri: str) -> float:
        """0.20 for the domain (0.05 for none), 0.20 and up to 0.10 for bounds that fit closely, 0.20 and 0.15 for the share of the
        name's words that alternative labels and the comment have."""
        f, c = self.facts[uri], self.column
        out = 0.05 if not f["domains"] else 0.20 if self.domain is not None and self.domain in f["domains"] else 0.0
        if (c.lo is not None or c.hi is not None) and (f["min_inclusive"] is not None or f["max_inclusive"] is not None):
            out += 0.20
            if None not in (c.lo, c.hi, f["min_inclusive"], f["max_inclusive"]):
                span, data = f["max_inclusive"] - f["min_inclusive"], c.hi - c.lo
                out += min(0.10, 0.10 * data / span) if span > 0 and 0 <= data <= span else 0.0
        words = _tokens(c.name)
        share = lambda said: sum(w in said for w in words) / len(words) if words else 0.0
        return out + 0.20 * share({t for a in f["alt_labels"] for t in _tokens(a)}) + 0.15 * share(set(_tokens(f["comment"])))


GRADES = {"HIGH": 0.75, "MEDIUM": 0.65, "LOW": 0.55}
RESOLVED = "column_name string, role string, uri string, label string, confidence double, method string, review_flag boolean, domains array<string>, ranges array<string>"


def resolve(columns: DataFrame, properties: DataFrame, domain: str | None = None, arbiter: Callable[[dict, list[dict]], tuple[str, str] | None] | None = None) -> DataFrame:
    """columns(column_name, role, min_value, max_value) -> one row each: uri, label, confidence, method, review_flag, domains, ranges.

    ``domain`` restricts candidates to properties of that domain or none (unless that leaves none). ``arbiter`` may settle
    near ties: it gets the column and the surviving candidates and returns (uri, "HIGH" | "MEDIUM" | "LOW") or None.

    Spelling is scored by Spark: columns and probes with every label. What has a score comes to the driver, a few properties
    a column, and is decided there; the ontology's properties are held as one small table.
    """
    spark = columns.sparkSession
    asked_of = columns.select("column_name", F.lit(-1).alias("nth"), F.col("column_name").alias("query")).unionByName(probes(columns))
    table = [_Column(r[0], r[1], r[2], r[3]) for r in columns.select("column_name", "role", F.col("min_value").cast("double"), F.col("max_value").cast("double")).collect()]
    facts = {r.uri: r.asDict() for r in properties.collect()}
    inside = {u for u, f in facts.items() if not f["domains"] or domain in f["domains"]} if domain is not None else set()
    allowed = inside or set(facts)
    asked = [(r.column_name, r.nth, r.query) for r in asked_of.collect()]
    queries = small(spark.createDataFrame([(q,) for q in sorted({q for *_, q in asked if q is not None})], "query string"))
    scored: dict[str, list[tuple[str, int, float]]] = {}
    for r in score_pairs(queries, properties.filter(F.col("uri").isin(sorted(allowed))) if inside else properties).collect():
        scored.setdefault(r.query, []).append((r.uri, r.rung, r.score))
    # The last rung is dense similarity, over summaries of all properties.
    summary = lambda f: " ".join(x for x in (f["label"], " ".join(f["alt_labels"]), f["comment"] or "") if x is not None)
    uris = sorted(facts)
    model = HashedTfidf([summary(facts[u]) for u in uris])
    ladders = {c.name: _Ladder(c, facts, domain) for c in table}
    for name, nth, query in asked:
        near = [(float(d), u) for d, u in zip(model.rows @ model.encode(query or ""), uris, strict=True)] if uris else []
        ladder = ladders[name]
        ladder.rows += [(nth, *x) for x in scored.get(query, [])] + [(nth, u, 6, _rounded(d, 4)) for d, u in near if d >= 0.40 and u in allowed]
        if nth == -1:
            ladder.near = near
    out = []
    for c in table:
        ladder = ladders[c.name]
        chosen = ladder.candidate()
        rivals, called = ladder.rivals(chosen)
        weak = chosen is None or chosen[2] == 6 or 0.40 <= chosen[1] <= 0.65
        judged = _judged(ladder.pool(rivals if called else []), arbiter) if weak or called else None
        if judged is not None:
            uri, conf, method, review = judged
        elif chosen is not None:
            uri, conf, method = chosen[0], chosen[1], METHODS[chosen[2]]
            review = weak or called or (chosen[2] in (3, 5) and conf < 0.70)
        else:
            uri, conf, method, review = UNMAPPED, 0.30, "Unmapped", True
        f = facts.get(uri, {})
        out.append((c.name, c.role, uri, f.get("label") or c.name, conf, method, review, f.get("domains") or [], f.get("ranges") or []))
    return spark.createDataFrame(out, RESOLVED).coalesce(1)


def _judged(pool: list[dict], arbiter) -> tuple[str, float, str, bool] | None:
    """(uri, confidence, method, review) of the only survivor, the arbiter's choice among several, or the one that scores best."""
    if not pool:
        return None
    line = sorted(pool, key=lambda f: (-f["arb"], f["uri"]))
    if len(line) == 1:
        return line[0]["uri"], 0.66, "AxiomFilter-Unique", False
    if arbiter is not None:
        said = arbiter({"column_name": line[0]["column_name"], "role": line[0]["role"]}, line)
        if said is not None:
            return said[0], GRADES.get(said[1], 0.55), "LLM-Reranked", True
    return line[0]["uri"], min(0.85, max(0.65, _rounded(line[0]["arb"], 2))), "Arbiter-Reranked", True


def concept_matches(values: DataFrame, classes: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """Distinct values(value) -> (value, uri, confidence, method): string cascade from 0.75, else dense similarity from 0.40.

    ``ranges`` (value, range) prefers classes in a value's ranges: they alone are tried if any is a known class; others
    weigh 0.8 in the dense rung. Score each distinct value once and join back to the cells.
    """
    values = values.select("value").distinct()
    pairs = _asked(values.withColumnRenamed("value", "query")).join(F.broadcast(with_labels(classes)))
    if ranges is not None:
        inside = ranges.join(F.broadcast(classes.select(F.col("uri").alias("range"))), "range", "left_semi").groupBy(F.col("value").alias("query")).agg(F.collect_set("range").alias("inside"))
        pairs = pairs.join(inside, "query", "left").filter(F.col("inside").isNull() | F.array_contains("inside", F.col("uri"))).drop("inside")
    qt, tt = F.col("qt"), F.col("tt")
    pairs = pairs.withColumn("share", F.size(F.array_intersect(qt, tt)) / F.size(F.array_union(qt, tt))).withColumn("ratio", seq_ratio_udf("qn", "tn"))
    holds = (F.size(qt) > 0) & (F.size(tt) > 0) & ((F.size(F.array_except(qt, tt)) == 0) | (F.size(F.array_except(tt, qt)) == 0))
    subset = F.when(holds & (F.col("share") >= 0.60), 0.75 + 0.17 * F.col("share"))
    m = _best_rung((1, F.when(F.col("q_low") == F.col("low"), 0.98)), (2, F.when(F.col("qn") == F.col("tn"), 0.95)), (3, subset), (4, F.when(F.col("ratio") >= 0.82, F.col("ratio") * 0.92)))
    hits = _scored(pairs, m).groupBy("query").agg(F.min(F.struct("rung", (-F.col("score")).alias("minus"), "uri")).alias("b"))
    hits = hits.select(F.col("query").alias("value"), "b.uri", (-F.col("b.minus")).alias("confidence"), F.lit("Concept-StringMatch").alias("method"))
    text = F.concat_ws(" ", "label", F.array_join("alt_labels", " "), F.coalesce("comment", F.lit("")))
    summaries = [tuple(r) for r in classes.select("uri", text).orderBy("uri").collect()]
    rest = values.join(hits, "value", "left_anti").withColumnRenamed("value", "query")
    dense = dense_pairs(rest, summaries)
    if ranges is not None:
        wanted = ranges.groupBy(F.col("value").alias("query")).agg(F.collect_set("range").alias("wanted"))
        dense = dense.join(wanted, "query", "left").withColumn("dense", F.when(F.col("wanted").isNotNull() & ~F.array_contains("wanted", F.col("uri")), F.col("dense") * 0.8).otherwise(F.col("dense"))).drop("wanted")
    near = dense.groupBy("query").agg(F.max_by(F.struct("uri", "dense"), F.struct("dense", "uri")).alias("b")).filter("b.dense >= 0.40")
    return hits.unionByName(near.select(F.col("query").alias("value"), "b.uri", F.round("b.dense", 4).alias("confidence"), F.lit("Concept-EmbeddingMatch").alias("method")))
