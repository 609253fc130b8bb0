"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame operations only.

Every source is a stream of words: its documents in the order of their MD5 keys, laid end to end and read again from
the start up to its target. The stream is cut in blocks of ``block_words``; source s has n_s of them. The n_s are the
weights of a van der Corput schedule: slot j of 2^m has the point x(j), j's bits reversed; the cumulative block counts
cut the points into one interval per source, and points past the last interval are empty slots. A slot's rank among
its source's slots names the block it takes, so blocks of all sources interleave evenly and each is taken once. Ranks
come in closed form (how many earlier slots have a point under a bound), hence no window over the slots. The slots are
the order of the mix: every row is told the first slot it fills, and ``mix_documents`` puts its rows out in that order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.llm.common import SPACE, WORD, materialize, pick, running_start, smaller, whole_rows

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_PASSES = 2
BLOCK_WORDS = 4096
#: Documents whose keys share a bucket are ordered together; about so many.
BUCKET_DOCS = 250


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> also weight and target: weights repeat over sources by code point, null last.

    A share fills by water level: with sources ordered by cap / weight, the level that remains for those from the k-th
    on is (total - caps before it) / (weights from it on); its largest value is the final level.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weights = F.array(*(F.lit(float(w)) for w in WEIGHTS))
    out = sizes.withColumn("weight", F.get(weights, F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))).cast("int")))
    out = out.withColumn("cap", F.col("source_size") * float(MOST_PASSES))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    every = Window.partitionBy()
    capped = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    out = out.withColumn("level", (F.sum("source_size").over(every) * SHARE - capped) / rest)
    out = out.withColumn("level", F.max("level").over(every))
    return out.select("source", "source_size", "weight", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def _reverse_bits(x: Column, bits: int) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(x), bits, "0")), 2, 10).cast("long")


def _earlier(slot: Column, below: Column, bits: int) -> Column:
    """How many slots before ``slot`` have a point under ``below``: slots before it split at each of its 1 bits into runs whose
    low b bits are free; reversed, those lead, so a run's points are evenly spaced by 2^(bits - b)."""
    total = F.lit(0).cast("long")
    for b in range(bits):
        high = F.shiftleft(F.shiftright(slot, b + 1), b + 1)
        step = F.lit(1 << (bits - b))
        least = F.shiftright(below - _reverse_bits(high, bits) + step - 1, bits - b)
        total = total + F.when(F.shiftright(slot, b).bitwiseAND(F.lit(1)) == 1, F.least(F.greatest(least, F.lit(0)), F.lit(1 << b))).otherwise(F.lit(0))
    return total


def slot_schedule(sources: DataFrame) -> DataFrame:
    """sources(source_no, n_blocks) -> slot, source_no, block: every block of every source once, in the order of slots."""
    spark = sources.sparkSession
    order = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    cuts = materialize(sources.withColumn("lo", F.coalesce(F.sum("n_blocks").over(order), F.lit(0))).withColumn("hi", F.col("lo") + F.col("n_blocks")), "mix-cuts")
    total, count = cuts.agg(F.coalesce(F.sum("n_blocks"), F.lit(0)), F.count("*")).first()
    bits = max(1, int(total - 1).bit_length()) if total else 1
    # Points and intervals meet on cells of equal width; most cells lie in one interval, so few pairs fail the bounds.
    width = max(1, total // max(4096, 16 * count))
    points = spark.range(total).select(F.col("id").alias("point"), F.expr(f"id div {width}").alias("cell"))
    spans = cuts.filter("n_blocks > 0").withColumn("cell", F.explode(F.expr(f"sequence(lo div {width}, (hi - 1) div {width})")))
    met = points.join(spans, "cell").filter("point >= lo and point < hi")
    slots = met.select(_reverse_bits(F.col("point"), bits).alias("slot"), "source_no", "lo", "hi")
    return slots.select("slot", "source_no", (_earlier(F.col("slot"), F.col("hi"), bits) - _earlier(F.col("slot"), F.col("lo"), bits)).alias("block"))


def mix(documents: DataFrame, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces). rows: one per input row with its place in its source; pieces: what each slot takes of which row.

    rows: doc_id, key, source_no, at (first word in the source's stream, also the row's identity there), size,
    source_size, target. pieces: slot, source_no, at, pass (of the stream, from 0), first (word of the row), words.
    """
    base = pick(documents, "doc_id", "text", "source").select(
        F.col("doc_id").cast("long"), "source", word_count(F.col("text")).alias("size"), F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))).alias("key")
    )
    base = materialize(base, "mix-base")
    sizes = source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")))
    number = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))
    sizes = materialize(sizes.withColumn("source_no", number), "mix-sources")
    rows = base.join(smaller(sizes.drop("weight"), 100).withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source")

    buckets = max(1, min(1 << 30, base.count() // BUCKET_DOCS))
    bucket = F.expr(f"(cast(conv(substring(key, 1, 8), 16, 10) as bigint) * {buckets}) div {1 << 32}")
    rows = rows.withColumn("bucket", bucket)
    starts = running_start(rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("in_bucket")), "source_no", "bucket", "in_bucket", "bucket_at").drop("in_bucket")
    earlier = Window.partitionBy("source_no", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("size").over(earlier), F.lit(0))).join(starts, ["source_no", "bucket"])
    rows = rows.select("doc_id", "key", "source_no", (F.col("bucket_at") + F.col("_in")).alias("at"), "size", "source_size", "target")
    rows = materialize(rows, "mix-rows")

    end = F.round("target").cast("long")
    blocks = F.ceil(F.round("target") / block_words).cast("long")
    slots = slot_schedule(sizes.select("source_no", blocks.alias("n_blocks")))
    # A row's stretches of the stream, one per pass, cut at the target; each stretch cut at block ends.
    spans = rows.filter("size > 0").select("source_no", "at", "size", end.alias("end"), F.posexplode(F.array(*(F.col("at") + F.col("source_size") * p for p in range(MOST_PASSES)))).alias("pass", "from"))
    spans = spans.withColumn("to", F.least(F.col("from") + F.col("size"), F.col("end"))).filter("to > from")
    pieces = spans.withColumn("block", F.explode(F.expr(f"sequence(from div {block_words}, (to - 1) div {block_words})")))
    lo, hi = F.greatest("from", F.col("block") * block_words), F.least("to", (F.col("block") + 1) * block_words)
    pieces = pieces.select("source_no", "at", "pass", "block", (lo - F.col("from")).alias("first"), (hi - lo).alias("words"))
    return rows, slots.join(pieces, ["source_no", "block"]).select("slot", "source_no", "at", "pass", "first", "words")


def mix_totals(documents: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, first_slot.

    ``first_slot`` is the first slot of the schedule that takes words of the row; null where none does. Null text has size
    0 and nothing is taken of it; a null source is a source, the last. Repeated rows each have their own place. With no
    words at all every target is 0. An empty table gives an empty result. Columns besides doc_id, text and source are not
    read.
    """
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return _taken(documents, block_words).select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.get("passes", F.lit(0))["slot"].alias("first_slot"))


def _taken(documents: DataFrame, block_words: int) -> DataFrame:
    """Rows of ``mix`` with ``passes``: (slot, words) of each pass that takes words of the row, the first slot of it."""
    rows, pieces = mix(documents, block_words)
    each = pieces.groupBy("source_no", "at", "pass").agg(F.min("slot").alias("slot"), F.sum("words").alias("words"))
    each = each.groupBy("source_no", "at").agg(F.sort_array(F.collect_list(F.struct("slot", "words"))).alias("passes")).withColumn("_some", F.lit(True))
    out = rows.withColumn("_some", F.col("size") > 0).join(each, ["source_no", "at", "_some"], "left").drop("_some")
    return out.withColumn("passes", F.coalesce("passes", F.array().cast("array<struct<slot:bigint,words:bigint>>")))


def mix_documents(documents: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as documents in the order of the schedule's slots.

    Each row comes once for every pass that takes words of it, where that pass is in the schedule, cut to the words taken;
    at most one row per source is cut. Rows of which nothing is taken go: those without a word, and what lies past the
    target. Columns as in the input, whatever their names; n_chars follows the text where there is such a column. Of rows
    equal in doc_id, text and source each is taken on its own, in the order of their places. An empty table gives an empty
    one.
    """
    totals = materialize(_taken(documents, block_words).select("key", "source_no", "size", "passes"), "mix-totals")
    repeated = smaller(materialize(totals.groupBy("key", "source_no").agg(F.count("*").alias("n")).filter("n > 1").select("key", "source_no"), "mix-repeated"), 60)
    sources = materialize(pick(documents, "source").distinct(), "mix-names")
    number = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))
    sources = materialize(sources.select(F.col("source").alias("_s"), number.alias("source_no")), "mix-numbers")
    key = F.md5(F.concat_ws("|", F.col("row.doc_id").cast("string"), F.md5(F.coalesce("row.text", F.lit("")))))
    rows = whole_rows(documents).withColumn("key", key).join(smaller(sources, 100), F.col("row.source").eqNullSafe(F.col("_s"))).drop("_s")
    # Rows that have no equal meet their totals by key. Of the others, both sides number equal ones and meet by number.
    alone = totals.filter("size(passes) > 0").join(repeated, ["key", "source_no"], "left_anti")
    lone = rows.join(smaller(alone, 140), ["key", "source_no"])
    with_id = lambda d, tag: _numbered(materialize(d.join(repeated, ["key", "source_no"], "left_semi").withColumn("id", F.monotonically_increasing_id()), tag))
    many = with_id(rows, "mix-equals").join(with_id(totals, "mix-places"), ["key", "source_no", "nth"])
    out = lone.select("row", "size", "passes").unionByName(many.select("row", "size", "passes"))
    out = out.withColumn("taken", F.explode("passes")).select("row", "size", "taken.slot", "taken.words")
    # A text split where each word ends: the first n parts hold its first n words and what stands between them.
    parts = F.split("row.text", rf"(?<=[^{SPACE}])(?=[{SPACE}])")
    cut = F.array_join(F.slice(parts, F.lit(1), F.col("words").cast("int")), "")
    out = out.repartitionByRange("slot").sortWithinPartitions("slot")
    out = out.withColumn("mixed", F.when(F.col("words") < F.col("size"), cut).otherwise(F.col("row.text")))
    new = {"text": F.col("mixed"), "n_chars": F.length("mixed").cast(documents.schema["n_chars"].dataType) if "n_chars" in documents.columns else None}
    return out.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in documents.columns))


def _numbered(rows: DataFrame) -> DataFrame:
    """Materialised rows with a unique ``id`` -> ``nth``: 1, 2, .. over rows of one key and source. An id's high bits name
    the partition it was made in, so no task numbers more rows of a key than one partition holds."""
    rows = rows.withColumn("part", F.shiftright("id", 33))
    counts = rows.groupBy("key", "source_no", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("key", "source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("key", "source_no", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    within = F.row_number().over(Window.partitionBy("key", "source_no", "part").orderBy("id"))
    return rows.withColumn("nth", within).join(counts, ["key", "source_no", "part"]).withColumn("nth", F.col("nth") + F.col("earlier")).drop("id", "part", "earlier")
