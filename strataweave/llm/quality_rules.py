"""Quality rules: fixed limits first, then robust multivariate outliers. DataFrame operations only.

Each text becomes a vector of transformed statistics. Per language and source, whatever the group's size, a
minimum-covariance-determinant estimate is found by concentration steps: from four deterministic starts, take the share of
texts nearest by Mahalanobis distance, estimate mean and covariance anew, repeat. After a few steps the two starts with
the smallest determinants go on, each as long as its determinant falls; the smaller one wins and is reweighted. A text far
from its group's centre is rejected. The variance added to every statistic stands in for what a small group cannot show: of a
group of one or two texts none is rejected unless they lie far apart.

Vectors are held as whole multiples of 1/4096 and moments as decimal sums, so a rerun or another partitioning gives the
same estimates to the last bit. Order statistics come from counts per distance bin, never from a sort of a group, and a
step is one pass: moments are summed per bin, and the bins that hold the nearest texts are added up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.llm.common import SPACE_CHARS, WORD, materialize, null_safe_key, pick, smaller

MIN_WORDS = 50
#: The vector: log of the mean word length, roots of symbols per word, of capitals per letter, of repeated lines per line
#: and of words in repeated windows per word. None depends on a text's length as such.
FEATURES = ("x0", "x1", "x2", "x3", "x4")
SCALE = 4096
#: Share of a group that a concentration step keeps, and steps taken from every start before the best BEST go on.
KEPT_SHARE, STEPS, BEST = 0.75, 2, 2
#: A determinant that falls by less than this (its logarithm) is taken to stand.
STILL = 1e-6
#: chi-square(5): consistency factors of the 0.75 and 0.975 shares, and the 0.975 quantile that reweighting uses.
CONSISTENCY, NEAR, NEAR_FACTOR = 1.3877, 12.8325, 1.0527
#: Squared distance beyond which a text is rejected. Statistics of prose have heavier tails than a normal law.
CUTOFF = 40.0
#: Variance added to every statistic (0.1 squared): a nearly constant one must not reject all that differ a little.
FLOOR = 0.01
BINS_PER_UNIT = 64


def text_statistics(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source and counts of every whole text (null: no word): the contract's five, capitals and lines."""
    rows = pick(documents, "doc_id", "text", "lang", "source").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    three = F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    without = lambda chars: F.length("text") - F.length(F.translate("text", chars, ""))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    rows = rows.select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"), F.length(F.translate("text", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        without("#*$%&|<>").cast("long").alias("n_symbols"), without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_capitals"), lines.alias("lines"),
        F.when(F.size("words") >= 3, three).otherwise(F.array().cast("array<bigint>")).alias("three"),
    )
    counts = ("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_capitals")
    # Windows sorted by hash and place stand beside their copies. Most texts have none and skip the sort.
    paired = F.sort_array(F.transform("three", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.select(
        *counts, F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("three")) < F.size("three"), paired).alias("paired"),
    )
    twin = lambda x, i: F.coalesce(F.get("paired", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("paired", i + 1)["h"] == x["h"], F.lit(False))
    places = F.sort_array(F.transform(F.filter("paired", twin), lambda x: x["i"]))
    rows = rows.select(*counts, "n_lines", "n_dup_lines", places.alias("places"))
    # Each repeated window covers 3 words less what the next one covers too.
    covers = F.transform("places", lambda at, k: F.least(F.lit(3), F.coalesce(F.get("places", k + 1) - at, F.lit(3))))
    covered = F.aggregate(covers, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(*counts, "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def feature_vector() -> list[Column]:
    ratio = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    raw = (F.log(F.greatest("word_chars", F.lit(1)) / F.greatest("n_words", F.lit(1))), ratio("n_symbols", "n_words"), ratio("n_capitals", "word_chars"), ratio("n_dup_lines", "n_lines"), ratio("n_repeat_words", "n_words"))
    return [F.round(x * SCALE).cast("long").alias(name) for x, name in zip(raw, FEATURES, strict=True)]


_PAIRS = [(i, j) for i in range(5) for j in range(i + 1)]


def _sums() -> list[Column]:
    """Exact sums of the statistics and of their products."""
    exact = lambda x: F.sum(x.cast("decimal(20,0)"))
    return [F.count("*").alias("n"), *(exact(F.col(x)).alias(f"s{i}") for i, x in enumerate(FEATURES)), *(exact(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in _PAIRS)]


def _estimate(sums: DataFrame, factor: float) -> DataFrame:
    """Per group and start of _sums: centre m0..m4, the Cholesky factor l00..l44 of factor * covariance + FLOOR, and its log determinant."""
    value = lambda x: F.col(x).cast("double")
    centre = [(value(f"s{i}") / F.col("n") / SCALE).alias(f"m{i}") for i in range(5)]
    out = sums.select("grp", "start", *centre, *((value(f"s{i}{j}") / F.col("n") / (SCALE * SCALE)).alias(f"q{i}{j}") for i, j in _PAIRS))
    cov = [(F.greatest(F.lit(0.0) if i == j else F.lit(float("-inf")), F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * factor + (FLOOR if i == j else 0.0)).alias(f"c{i}{j}") for i, j in _PAIRS]
    out = out.select("grp", "start", *(f"m{i}" for i in range(5)), *cov)
    for i in range(5):
        for j in range(i + 1):
            inner = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.col(f"c{i}{j}"))  # noqa: B023
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(inner, F.lit(FLOOR / 100))) if i == j else inner / F.col(f"l{j}{j}"))
    logdet = reduce(lambda a, i: a + F.log(f"l{i}{i}"), range(5), F.lit(0.0))
    return out.withColumn("logdet", logdet).drop(*(f"c{i}{j}" for i, j in _PAIRS))


def _moments(rows: DataFrame, factor: float) -> DataFrame:
    return _estimate(rows.groupBy("grp", "start").agg(*_sums()), factor)


def _with_distance(rows: DataFrame, estimate: DataFrame, keys: list[str]) -> DataFrame:
    """Squared Mahalanobis distance d2 of each row to its group's estimate, by forward substitution."""
    out = rows.join(smaller(estimate, 250), keys)
    for i in range(5):
        inner = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"y{k}"), range(i), F.col(f"x{i}") / SCALE - F.col(f"m{i}"))  # noqa: B023
        out = out.withColumn(f"y{i}", inner / F.col(f"l{i}{i}"))
    d2 = reduce(lambda a, i: a + F.col(f"y{i}") * F.col(f"y{i}"), range(5), F.lit(0.0))
    return out.withColumn("d2", d2).drop(*(c for c in estimate.columns if c[0] in "ml" and c[1:].isdigit()), *(f"y{i}" for i in range(5)))


def _concentrated(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """A concentration step: of each group and start, the estimate of the nearest distance bins that together hold KEPT_SHARE of it."""
    met = _with_distance(rows, estimate.drop("logdet"), ["grp"]).withColumn("bin", F.floor(F.log1p("d2") * BINS_PER_UNIT).cast("int"))
    bins = met.groupBy("grp", "start", "bin").agg(*_sums())
    whole = Window.partitionBy("grp", "start")
    under = F.coalesce(F.sum("n").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.withColumn("under", under).withColumn("all", F.sum("n").over(whole)).filter(F.col("under") < F.ceil(F.col("all") * KEPT_SHARE))
    sums = bins.groupBy("grp", "start").agg(*(F.sum(c).alias(c) for c in bins.columns if c == "n" or c[0] == "s" and c[1:].isdigit()))
    return materialize(_estimate(sums, CONSISTENCY), "mcd-step")


#: Centre and spread of a start as ranks of a group's values: of all values, by the middle half, and by the lower part
#: (junk adds symbols, capitals and repeats).
STARTS = {"median": (0.5, None), "middle": (0.5, (0.25, 0.75)), "low": (0.25, (0.1, 0.5))}


def _starts(rows: DataFrame) -> DataFrame:
    ranks = [0.1, 0.25, 0.5, 0.75]
    found = rows.groupBy("grp").agg(*(F.percentile(x, F.array(*map(F.lit, ranks))).alias(f"p{i}") for i, x in enumerate(FEATURES)))
    out = _moments(rows.select("grp", *FEATURES, F.lit("all").alias("start")), 1.0)
    for name, (centre, spread) in STARTS.items():
        at = lambda i, rank: F.get(f"p{i}", F.lit(ranks.index(rank))) / SCALE
        width = lambda i: F.lit(0.0) if spread is None else at(i, spread[1]) - at(i, spread[0])  # noqa: B023, E731
        scale = [(F.sqrt(width(i) * width(i) + FLOOR) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in _PAIRS]
        out = out.unionByName(found.select("grp", F.lit(name).alias("start"), *(at(i, centre).alias(f"m{i}") for i in range(5)), *scale, F.lit(float("inf")).alias("logdet")))
    return materialize(out, "mcd-start")


def robust_estimates(rows: DataFrame) -> DataFrame:
    """grp, x0..x4 (materialised) -> one reweighted MCD estimate per group."""
    every = rows.select("grp", *FEATURES)
    moving = _starts(rows)
    for _ in range(STEPS):
        moving = _concentrated(every, moving)
    rank = F.row_number().over(Window.partitionBy("grp").orderBy("logdet", "start"))  # four rows a group
    moving = materialize(moving.withColumn("_r", rank).filter(F.col("_r") <= BEST).drop("_r"), "mcd-moving")
    found = moving
    while True:
        # Only starts whose determinant still falls go on; it is bounded by FLOOR, so they all stop.
        was = smaller(moving.select("grp", "start", F.col("logdet").alias("_was")), 60)
        moving = materialize(_concentrated(every, moving).join(was, ["grp", "start"]).filter(F.col("logdet") < F.col("_was") - STILL).drop("_was"), "mcd-moving")
        if not moving.limit(1).count():
            break
        found = materialize(found.join(smaller(moving.select("grp", "start"), 60), ["grp", "start"], "left_anti").unionByName(moving), "mcd-found")
    best = materialize(found.withColumn("_r", rank).filter("_r = 1").drop("_r", "logdet", "start"), "mcd-best")
    near = _with_distance(rows, best, ["grp"]).filter(F.col("d2") <= NEAR).withColumn("start", F.lit("near"))
    return materialize(_moments(near, NEAR_FACTOR).drop("logdet", "start"), "mcd-final")


def quality_rules(documents: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """One row per input row: doc_id, n_words, the counts, base_failed, distance (squared; null if none was taken), kept.

    Null text has no word and fails the base rules. A null lang or source is a value like any other. Rows that fail the
    base rules take no part in the estimates. Repeated rows each count. An empty table gives an empty result. Columns
    besides doc_id, text, lang and source are not read.
    """
    counts = text_statistics(documents)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    rows = counts.withColumn("base_failed", failed).withColumn("grp", F.when(~F.col("base_failed"), null_safe_key(F.col("lang"), F.col("source"))))
    rows = materialize(rows.select(*out, "grp", *feature_vector()), "rule-rows")
    estimates = robust_estimates(rows.filter("grp is not null").select("grp", *FEATURES))
    judged = _with_distance(rows.filter("grp is not null"), estimates, ["grp"]).select(*out, F.col("d2").alias("distance"))
    others = rows.filter("grp is null").select(*out, F.lit(None).cast("double").alias("distance"))
    return judged.unionByName(others).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True)))
