"""Token ids in ORC: one row per document, ids as an integer column that ORC run-length encodes, in ascending doc_id order.

Each file is a range of doc_id; two more columns, nothing once run-length encoded, hold the range's number and a row's
place in it. Stripes are read in parallel; row indexes, stripe statistics and a Bloom filter on doc_id let a reader skip
what cannot hold an id (``read_token_ids``). ``start`` is not stored: it is the running total over ranges and places, from
the files' own lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataweave.llm import tokens
from strataweave.llm.common import RUN, bounded_batches, materialize, new_path, pick, running_start, smaller

STRIPE_BYTES = 16 << 20
INDEX_STRIDE = 1000
BLOOM_FPP = 0.01
STORED = "doc_id long, part int, place long, ids array<int>"


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, place = tokens.encoder(path), TaskContext.get().partitionId(), 0
        for b in batches:
            text = b.column("text")
            for at in range(0, len(b), 100):
                ids = [encoder.ids(t) for t in text.slice(at, 100).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))
                parts, places = pa.array(np.full(len(ids), part, np.int32)), pa.array(np.arange(place, place + len(ids)))
                place += len(ids)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, 100), parts, places, lists], ["doc_id", "part", "place", "ids"])

    return run


def write_token_ids(documents: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Write every document's ids (null text: the end id alone) to ``path``, in ascending doc_id order, nulls first.

    Rows with one doc_id stand side by side, ordered by a hash of the text and the text; a doc_id with many texts is dealt
    over ranges. Only texts are shuffled; ids are made after the sort.
    """
    bounded_batches(documents.sparkSession)
    rows = pick(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ids = ordered.mapInArrow(_encode(tokenizer or tokens.default_path()), STORED)
    (
        ids.write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(BLOOM_FPP))
        .option("orc.row.index.stride", str(INDEX_STRIDE))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("compression", "zstd")
        .orc(path)
    )


def read_token_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The stored rows; with ``doc_ids`` only those, by pushed-down predicates (statistics and Bloom filters prune)."""
    stored = spark.read.schema(STORED).orc(path)
    return stored if doc_ids is None else stored.filter(F.col("doc_id").isin(doc_ids))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("ids")
        at = lists.offsets.to_numpy()
        values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4"))
        crc = [zlib.crc32(values[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
        out = [b.column("part"), b.column("place"), b.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())]
        yield pa.RecordBatch.from_arrays(out, ["part", "place", "doc_id", "n_tokens", "ids_crc32"])


def token_summary(spark: SparkSession, path: str) -> DataFrame:
    """From the files alone: doc_id, start (ids of all rows before it), n_tokens, ids_crc32 of the little-endian uint32 ids."""
    stored = read_token_ids(spark, path)
    rows = materialize(stored.mapInArrow(_digest, "part int, place long, doc_id long, n_tokens long, ids_crc32 long"), "token-rows")
    rows = rows.withColumn("run", F.expr(f"place div {RUN}"))
    runs = rows.groupBy("part", "run").agg(F.sum("n_tokens").alias("in_run"))
    parts = runs.groupBy("part").agg(F.sum("in_run").alias("in_part"))
    parts = parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("in_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    runs = running_start(runs.select("part", "run", "in_run"), "part", "run", "in_run", "run_start").drop("in_run")
    earlier = Window.partitionBy("part", "run").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).join(runs, ["part", "run"])
    rows = rows.join(smaller(materialize(parts, "token-parts"), 16), F.col("part") == F.col("_part"))
    return rows.select("doc_id", (F.col("part_start") + F.col("run_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_ids(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``documents`` as ORC, read the files back and summarise them: one row per input row.

    Null text: one id (the end id). Repeated doc_ids: each row is kept, side by side. An empty table gives an empty
    result. Columns besides doc_id and text are not read.
    """
    path = new_path(documents.sparkSession, "token-orc")
    write_token_ids(documents, path, tokenizer)
    return token_summary(documents.sparkSession, path)
