"""Helpers the corpus operators share: shared-folder tables, bounded Arrow batches, joins that check a side's size."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that separate words, as a regular-expression class body: space, tab, LF, VT, FF, CR.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: The same six characters, for translate().
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: A side of a join is broadcast only if its row count times its row width stays under this many bytes.
BROADCAST_BYTES = 16 << 20
#: Places whose running total one task makes.
RUN = 4096

_local_root: str | None = None
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every machine sees: spark.checkpoint.dir, or the one given to the context by setCheckpointDir.

    Where neither is set a local master, as in tests, gets a folder of its own; on a cluster this raises ValueError.
    """
    global _local_root
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _local_root is None:
        _local_root = f"/tmp/checkpoints/strataweave-{uuid.uuid4().hex}"
    return _local_root


def new_path(spark: SparkSession, tag: str) -> str:
    if not _written:
        atexit.register(release)
    _written.append(f"{shared_dir(spark)}/strataweave/{tag}-{uuid.uuid4().hex}")
    return _written[-1]


def release() -> None:
    """Delete the tables this process wrote to the shared folder; results that still read them are gone with it.

    Runs when the process ends with its session still up; a job that ends otherwise leaves its folder to the cluster.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _written:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
    _written.clear()


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost executor loses nothing.

    ``options`` go to the Parquet writer.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small even when texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def smaller(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a materialised table for broadcast if its counted size is under ``limit``; else leave the join to shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def null_safe_key(*cols: Column) -> Column:
    """A string that tells null from every value and each tuple of values from every other, for grouping and joining."""
    told = lambda c: F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))
    return F.concat(*(F.when(c.isNull(), F.lit("n")).otherwise(told(c)) for c in cols))


def running_start(sums: DataFrame, of: str, at: str, value: str, out: str) -> DataFrame:
    """sums(of, at, value), one row per place -> also ``out``: the total of ``value`` over earlier places of the same ``of``.

    Places are whole numbers. They are summed in runs of RUN first, so no task sees more than RUN rows of one ``of``, or
    one row per run.
    """
    runs = sums.withColumn("_run", F.expr(f"`{at}` div {RUN}"))
    before = Window.partitionBy(of).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    totals = runs.groupBy(of, "_run").agg(F.sum(value).alias("_in_run"))
    totals = totals.select(F.col(of).alias("_of"), F.col("_run").alias("_at_run"), F.coalesce(F.sum("_in_run").over(before), F.lit(0)).alias("_run_start"))
    within = Window.partitionBy(of, "_run").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn(out, F.coalesce(F.sum(value).over(within), F.lit(0)))
    runs = runs.join(totals, F.col(of).eqNullSafe(F.col("_of")) & (F.col("_run") == F.col("_at_run")))
    return runs.withColumn(out, F.col(out) + F.col("_run_start")).select(*sums.columns, out)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator reads: other columns, whatever their names, cannot clash."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def whole_rows(df: DataFrame) -> DataFrame:
    """One struct column ``row`` of all columns: whatever their names, they cannot clash with columns added beside it."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))


def join_group_facts(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Left-join one fact row per key to ``rows`` without letting a hot key gather in one task.

    Keys with over max(1000, total / 5000) rows number at most 5,000: they are broadcast. The rows they match, and rows
    with a null key, need no other fact: in the shuffled join for the rest they carry a null key beside a number of their
    own, and are dealt out by that number. So the largest key there holds 1/5000 of the rows. ``facts`` must be
    materialised and small enough in ``limit`` bytes to be broadcast, or it is shuffled; its columns other than ``key``
    must be new to ``rows``.
    """
    hottest = max(1000, total // 5000)
    names = [c for c in facts.columns if c != key]
    hot = facts.filter(F.col(count) > hottest).select(F.col(key).alias("_hot_key"), *(F.col(c).alias(f"_hot_{c}") for c in names))
    cold = facts.filter(F.col(count) <= hottest)
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    out = out.withColumn("_cold_key", F.when(F.col("_hot_key").isNull(), F.col(key)))
    out = out.withColumn("_turn", F.when(F.col("_cold_key").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1)))
    # Not a literal: the optimiser would take that out of the keys, and the rows without a fact would gather again.
    cold = cold.withColumnRenamed(key, "_cold_fact").withColumn("_fact_turn", F.least(F.col(count).cast("long"), F.lit(-1)))
    out = out.join(smaller(cold, 50 + 40 * len(names), limit), (F.col("_cold_key") == F.col("_cold_fact")) & (F.col("_turn") == F.col("_fact_turn")), "left")
    return out.select(*rows.columns, *(F.coalesce(F.col(f"_hot_{c}"), F.col(c)).alias(c) for c in names))
