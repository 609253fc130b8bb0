"""Quality classifier by compression: how much better does a dictionary of good text compress a document than one of bad text?

Two zstandard dictionaries are built from labelled text. A document is cut in blocks of ``BLOCK_BYTES`` (all of it, in
order); each block is compressed with either dictionary. The difference of the two compressed sizes over the text's length
is all that a score knows; a text is taken to be ``SMOOTH`` bytes longer, with the labelled texts' mean difference, so a few
bytes say little by themselves. A logistic curve in it, fitted on labelled texts that no dictionary has seen, makes it a
probability; rows count by how many labelled rows of their class they stand for, so classes of any size stay calibrated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.llm.common import bounded_batches, pick

#: Labelled rows per class that a fit looks at, and bytes of their text that it collects: half for the dictionaries, half
#: for the curve. Of one text at most SAMPLE_TEXT characters count, in blocks spread evenly over it. All three bound what
#: reaches the driver; they do not depend on the table's size.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_TEXT = 3000, 6 << 20, 64 << 10
DICTIONARY_BYTES = 384 << 10
BLOCK_BYTES = 1024
SMOOTH = 128
LEVEL = 3


class CompressionModel:
    """Dictionaries and curve; plain bytes and floats, so it travels to executors in a closure of under 1 MB."""

    def __init__(self, good: list[bytes], bad: list[bytes], share: float = 0.5):
        """``share``: of good ones among all labelled rows that the two samples stand for."""
        self.prior = None
        self.weights, self.mean = [0.0, 0.0], 0.0
        if not good or not bad:
            self.prior = 0.5 if good == bad else float(bool(good))
            self.good = self.bad = b""
            return
        self.good, self.bad = (_dictionary(texts[::2]) for texts in (good, bad))
        rest = [good[1::2] or good, bad[1::2] or bad]
        y = np.repeat([1.0, 0.0], [len(x) for x in rest])
        each = np.repeat([share / len(rest[0]), (1 - share) / len(rest[1])], [len(x) for x in rest]) * len(y)
        sizes = self.differences([t for x in rest for t in x])
        self.mean = float(np.average(sizes[:, 0] / sizes[:, 1], weights=each))
        self.weights = _logistic(self.features(sizes), y, each)

    def features(self, sizes: np.ndarray) -> np.ndarray:
        """1 and the normalised size difference of each text."""
        return np.column_stack([np.ones(len(sizes)), 10.0 * (sizes[:, 0] + self.mean * SMOOTH) / (sizes[:, 1] + SMOOTH)])

    def differences(self, texts: list[bytes]) -> np.ndarray:
        """By how many bytes either dictionary's sizes differ, and the text's own."""
        import zstandard as zstd

        packs = []
        for content in (self.good, self.bad):
            d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_AUTO)
            d.precompute_compress(level=LEVEL)
            packs.append(zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress)
        good, bad = packs
        out = np.zeros((len(texts), 2))
        for i, t in enumerate(texts):
            blocks = [t[at : at + BLOCK_BYTES] for at in range(0, len(t), BLOCK_BYTES)]
            out[i] = sum(len(bad(x)) - len(good(x)) for x in blocks), len(t)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        return 1.0 / (1.0 + np.exp(-np.clip(self.features(self.differences(texts)) @ np.array(self.weights), -30, 30)))


def _dictionary(texts: list[bytes]) -> bytes:
    """A zstandard dictionary trained on all blocks of the texts; where they are too few to train on, the texts themselves."""
    import zstandard as zstd

    blocks = [t[at : at + BLOCK_BYTES] for t in texts for at in range(0, len(t), BLOCK_BYTES)]
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, blocks, k=200, d=8).as_bytes()
    except zstd.ZstdError:
        return b"\n".join(blocks)[-DICTIONARY_BYTES:].ljust(64)


def _logistic(x: np.ndarray, y: np.ndarray, each: np.ndarray) -> list[float]:
    """Weights by iteratively reweighted least squares with a small ridge; row i counts each[i] times."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (each * (p * (1 - p) + 1e-6))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (each * (y - p)) - 1e-2 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def _spread(text: Column) -> Column:
    """A text of up to SAMPLE_TEXT characters, or as many of a longer one in blocks spread evenly over it."""
    n = SAMPLE_TEXT // BLOCK_BYTES
    parts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring(text, (i * F.length(text) / n).cast("int") + 1, F.lit(BLOCK_BYTES)))
    return F.when(F.length(text) <= SAMPLE_TEXT, text).otherwise(F.concat_ws("", parts))


def fit(documents: DataFrame, labels: DataFrame) -> CompressionModel:
    """Learn from labelled rows that are not held out: of each class the SAMPLE_ROWS with the lowest hashed id, up to
    SAMPLE_BYTES. A doc_id with both labels, or with a null one, teaches nothing."""
    known = pick(labels, "doc_id", "quality").filter("doc_id is not null and quality in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).filter("quality = _most").filter(~held_out())
    order = F.xxhash64("doc_id")
    sizes = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    chosen = [r for q in (1, 0) for r in known.filter(F.col("quality") == q).orderBy(order, "doc_id").select("doc_id", "quality").limit(SAMPLE_ROWS).collect()]
    spark = documents.sparkSession
    ids = F.broadcast(spark.createDataFrame(chosen, "doc_id long, quality int"))
    texts = pick(documents, "doc_id", "text").join(ids, "doc_id").filter("text <> ''").withColumn("text", _spread(F.col("text"))).withColumn("bytes", F.octet_length("text"))
    # One row per id. Then texts in hashed order as far as the budget goes; the window runs over the bounded sample.
    texts = texts.groupBy("doc_id", "quality").agg(F.min_by("text", "bytes").alias("text"), F.min("bytes").alias("bytes"))
    so_far = F.sum("bytes").over(Window.partitionBy("quality").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    sample = texts.withColumn("so_far", so_far).filter(F.col("so_far") <= SAMPLE_BYTES).select("quality", "text").orderBy("quality", order, "doc_id")
    rows = [(r.quality, r.text.encode()) for r in sample.collect()]
    return CompressionModel([t for q, t in rows if q == 1], [t for q, t in rows if q == 0], sizes.get(1, 0) / max(1, sum(sizes.values())))


def _score(model: CompressionModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(model.scores(texts))], ["doc_id", "held_out", "score"])

    return run


def score_quality(documents: DataFrame, labels: DataFrame, model: CompressionModel | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted.

    Only the text makes the score; a null text scores as an empty one. A null doc_id is not held out. Without labels of
    one class every score is that of the other, without any it is 0.5. Repeated rows score alike. An empty table gives
    an empty result. Columns besides doc_id and text are not read.
    """
    bounded_batches(documents.sparkSession)
    model = model or fit(documents, labels)
    rows = pick(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    out = rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def _filter(model: CompressionModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield b.filter(pa.array(model.scores(texts) >= 0.5))

    return run


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents``, all columns, whose text scores 0.5 or more.

    A null text scores as an empty one. Without labels of one class all rows get the score of the other's, without any all
    stay. Repeated rows stay or go together. An empty table gives an empty one. Columns of any name may stand beside text.
    """
    bounded_batches(documents.sparkSession)
    return documents.mapInArrow(_filter(fit(documents, labels)), documents.schema)
