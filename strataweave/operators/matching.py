"""Cells to entities (CEA), columns to classes (CTA), column pairs to properties (CPA), and their joint solution per row."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.cells import clean_cell
from strataweave.operators.retrieval import hybrid_search
from strataweave.rules import DEFAULT, Rules


def annotate_cells(cells: DataFrame, entities: DataFrame, classes: DataFrame, top_k: int = 5, rules: Rules = DEFAULT) -> DataFrame:
    """cells(row_id, col, value) -> (row_id, col, value, cleaned, rank, iri, label, types, score).

    Distinct cleaned values are searched once and joined back. Where no entity exists, classes stand in at 0.9 of their score.
    """
    cleaned = cells.withColumn("cleaned", clean_cell(F.col("value"), rules))
    asked = cleaned.select(F.col("cleaned").alias("query")).distinct().filter("query <> ''")
    hits = hybrid_search(asked, entities, 2 * top_k)
    if not entities.limit(1).count():
        known = classes.select(F.col("uri").alias("iri"), "label", F.col("alt_labels").alias("aliases"), F.array("uri").alias("types"))
        hits = hybrid_search(asked, known, top_k).withColumn("score", F.col("score") * 0.9)
    hits = hits.filter(F.col("rank") <= top_k)
    return cleaned.join(hits.withColumnRenamed("query", "cleaned"), "cleaned").select("row_id", "col", "value", "cleaned", "rank", "iri", "label", "types", "score")


def row_support(candidates: DataFrame, facts: DataFrame, top: int = 3) -> DataFrame:
    """(col_i, col_j, p, n_support): rows where one of the ``top`` x ``top`` candidates of two cells stands in facts(s, p, o).

    From the facts' side: each fact meets the rows that name its subject, then those that name its object, by equi-joins.
    """
    near = candidates.filter(F.col("rank") <= top).select("row_id", "col", "iri").distinct()
    subjects = near.select("row_id", F.col("col").alias("col_i"), F.col("iri").alias("s"))
    objects = near.select("row_id", F.col("col").alias("col_j"), F.col("iri").alias("o"))
    met = subjects.join(facts.select("s", "p", "o").distinct(), "s").join(objects, ["row_id", "o"]).filter("col_i <> col_j")
    return met.select("row_id", "col_i", "col_j", "p").distinct().groupBy("col_i", "col_j", "p").agg(F.count("*").alias("n_support"))


def column_types(candidates: DataFrame, ancestors: DataFrame, depths: DataFrame, header_sims: DataFrame, weights: tuple[float, float, float] = (0.4, 0.4, 0.2), top_k: int = 5) -> DataFrame:
    """CTA. candidates as from annotate_cells; ancestors(child, ancestor) not reflexive; depths(uri, depth);
    header_sims(col, uri, sim) -> (col, rank, uri, confidence, support_ratio, header_similarity, depth).

    Votes: a candidate's score to each of its types, 0.6 of it to their superclasses, 3 more to the least common subsumer
    of the top candidates' types.
    """
    near = candidates.filter("rank <= 3").select("row_id", "col", "rank", "score", F.explode("types").alias("t"))
    up = near.join(F.broadcast(ancestors), F.col("t") == F.col("child")).select("row_id", "col", "score", F.col("ancestor").alias("uri"), F.lit(0.6).alias("w"))
    votes = near.select("row_id", "col", "score", F.col("t").alias("uri"), F.lit(1.0).alias("w")).unionByName(up)
    cells = candidates.select("row_id", "col").distinct().groupBy("col").agg(F.count("*").alias("n_cells"))
    tally = votes.groupBy("col", "uri").agg(F.sum(F.col("score") * F.col("w")).alias("vote"), F.count_distinct("row_id").alias("n_rows"))
    # A class that a type implies counts as held by the row, whether or not it was voted for.
    leaf = candidates.filter("rank = 1").select("col", F.explode("types").alias("t")).distinct()
    full = ancestors.select("child", "ancestor").unionByName(leaf.select(F.col("t").alias("child"), F.col("t").alias("ancestor")).distinct()).distinct()
    n_leaf = leaf.groupBy("col").agg(F.count("*").alias("n_leaf"))
    shared = leaf.join(full, F.col("t") == F.col("child")).groupBy("col", "ancestor").agg(F.count_distinct("t").alias("n")).join(n_leaf, "col").filter("n = n_leaf")
    n_up = full.groupBy("child").agg(F.count("*").alias("n_up"))
    deepest = Window.partitionBy("col").orderBy(F.col("n_up").desc(), "ancestor")
    lcs = shared.join(n_up, F.col("ancestor") == n_up["child"], "left").withColumn("_r", F.row_number().over(deepest)).filter("_r = 1").select("col", F.col("ancestor").alias("lcs"))
    out = tally.join(header_sims, ["col", "uri"], "full").join(cells, "col", "left").join(lcs, "col", "left").join(F.broadcast(depths), "uri", "left")
    out = out.withColumn("is_lcs", F.coalesce(F.col("uri") == F.col("lcs"), F.lit(False))).withColumn("vote", F.coalesce("vote", F.lit(0.0)) + F.when(F.col("is_lcs"), 3.0).otherwise(0.0))
    each = Window.partitionBy("col")
    out = out.withColumn("depth", F.coalesce("depth", F.lit(1))).withColumn("max_vote", F.max("vote").over(each)).withColumn("max_depth", F.greatest(F.lit(1), F.max("depth").over(each)))
    support = F.coalesce(F.col("n_rows") / F.col("n_cells"), F.lit(0.0))
    sim = F.coalesce("sim", F.lit(0.0))
    norm = F.when(F.col("max_vote") > 0, F.col("vote") / F.col("max_vote")).otherwise(0.0)
    conf = weights[0] * norm + weights[1] * support * (0.5 + 0.5 * F.col("depth") / F.col("max_depth")) + weights[2] * sim
    conf = F.when(F.col("is_lcs"), F.least(F.lit(1.0), conf + 0.25)).otherwise(conf)
    conf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(support < 0.5, conf * 0.5).otherwise(conf)))
    out = out.select("col", "uri", conf.alias("confidence"), support.alias("support_ratio"), sim.alias("header_similarity"), "depth")
    order = Window.partitionBy("col").orderBy(F.col("confidence").desc(), F.col("support_ratio").desc(), F.col("depth").desc(), "uri")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)


def column_properties(types: DataFrame, properties: DataFrame, reflexive: DataFrame, disjoint: DataFrame, support: DataFrame, valid_rows: DataFrame, header_sims: DataFrame, weights: tuple[float, float, float] = (0.35, 0.45, 0.20), top_k: int = 5) -> DataFrame:
    """CPA. types(col, uri) top class per column; properties(uri, domains, ranges); reflexive(child, ancestor); disjoint(a, b);
    support(col_i, col_j, p, n_support); valid_rows(col_i, col_j, n_valid); header_sims(col_i, col_j, p, sim)
    -> (col_i, col_j, rank, p, confidence, n_support, support_ratio)."""
    a, b = types.select(F.col("col").alias("col_i"), F.col("uri").alias("t_i")), types.select(F.col("col").alias("col_j"), F.col("uri").alias("t_j"))
    pairs = a.join(b, F.col("col_i") != F.col("col_j")).join(F.broadcast(properties.select(F.col("uri").alias("p"), "domains", "ranges")))
    for side in ("i", "j"):
        up = reflexive.groupBy(F.col("child").alias(f"t_{side}")).agg(F.collect_set("ancestor").alias(f"up_{side}"))
        apart = disjoint.groupBy(F.col("a").alias(f"t_{side}")).agg(F.collect_set("b").alias(f"apart_{side}"))
        pairs = pairs.join(F.broadcast(up), f"t_{side}", "left").join(F.broadcast(apart), f"t_{side}", "left")
    fits = lambda up, t, ends: (F.size(ends) == 0) | F.arrays_overlap(F.coalesce(up, F.array(t)), ends)
    d, r = fits(F.col("up_i"), F.col("t_i"), F.col("domains")), fits(F.col("up_j"), F.col("t_j"), F.col("ranges"))
    dr = F.when(d & r, 1.0).when(d | r, 0.3).otherwise(0.0)
    clash = F.coalesce(F.arrays_overlap("apart_i", "domains"), F.lit(False)) | F.coalesce(F.arrays_overlap("apart_j", "ranges"), F.lit(False))
    out = pairs.join(support, ["col_i", "col_j", "p"], "left").join(valid_rows, ["col_i", "col_j"], "left").join(header_sims, ["col_i", "col_j", "p"], "left")
    ratio = F.coalesce(F.try_divide(F.col("n_support").cast("double"), F.col("n_valid")), F.lit(0.0))
    conf = weights[0] * dr + weights[1] * ratio + weights[2] * F.coalesce("sim", F.lit(0.0))
    conf = F.when(ratio > 0, F.least(F.lit(1.0), conf + 0.3 * ratio)).otherwise(conf)
    out = out.select("col_i", "col_j", "p", F.when(clash, 0.0).otherwise(F.least(F.lit(1.0), conf)).alias("confidence"), F.coalesce("n_support", F.lit(0)).alias("n_support"), ratio.alias("support_ratio"))
    order = Window.partitionBy("col_i", "col_j").orderBy(F.col("confidence").desc(), F.col("support_ratio").desc(), F.col("n_support").desc(), "p")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)


def solve_rows(candidates: DataFrame, types: dict[str, str], relations: list[tuple[str, str, str]], up: dict[str, set[str]], apart: dict[str, set[str]], ends: dict[str, tuple[set[str], set[str]]], lambda_axiom: float = 2.0) -> DataFrame:
    """Joint choice of each row's entities: the best sum of scores, column coherence (+0.25 / -1) and axiom bonuses over up to
    three candidates of related columns (two if that makes over 128 combinations).

    Rows are independent, so this is one grouped map. types: column -> class; relations: (col_i, col_j, property); up:
    class -> itself and its ancestors; apart: class -> disjoint classes; ends: property -> (domains, ranges). All of
    these are per column or per ontology and travel in the closure. -> (row_id, col, iri, score, row_score).
    """
    tied = {c for r in relations for c in r[:2]}

    def fit(ts, wanted) -> float:
        if not wanted or not len(ts):
            return 0.0
        if any(up.get(t, {t}) & wanted for t in ts):
            return 0.2
        return -0.5 if any(apart.get(t, set()) & wanted for t in ts) else 0.0

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        options: dict[str, list] = {}
        for col, part in rows.sort_values(["col", "rank"]).groupby("col", sort=True):
            every = [(r.iri, tuple(r.types), float(r.score)) for r in part.itertuples()]
            good = [e for e in every if not any(types.get(col) in apart.get(t, ()) for t in e[1])] or every[:1]
            options[col] = good[:3] if col in tied else good[:1]
        n = 1
        for o in options.values():
            n *= len(o)
        if n > 128:
            options = {c: o[:2] for c, o in options.items()}
        best, best_score = None, -1e9
        for combo in itertools.product(*options.values()):
            chosen = dict(zip(options, combo, strict=True))
            score = sum(e[2] for e in combo)
            for col, (_, ts, _) in chosen.items():
                cls = types.get(col)
                if cls is not None:
                    score += 0.25 if any(cls in up.get(t, {t}) for t in ts) else -1.0 if any(cls in apart.get(t, ()) for t in ts) else 0.0
            for i, j, p in relations:
                if i in chosen and j in chosen:
                    domains, ranges = ends.get(p, (set(), set()))
                    score += lambda_axiom * (fit(chosen[i][1], domains) + fit(chosen[j][1], ranges))
            if score > best_score:
                best, best_score = chosen, score
        found = [(rows.row_id.iloc[0], c, e[0], e[2], best_score) for c, e in (best or {}).items()]
        return pd.DataFrame(found, columns=["row_id", "col", "iri", "score", "row_score"])

    return candidates.select("row_id", "col", "rank", "iri", "types", "score").groupBy("row_id").applyInPandas(solve, "row_id long, col string, iri string, score double, row_score double")
