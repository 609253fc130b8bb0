"""Repeated passages by a sparse suffix array.

A text is a string of words. Minimisers of its k-word windows (a window's k-mer with the smallest hash among ``WINDOW``
successive ones) are selected by content alone, so equal passages of k + WINDOW - 1 words or more share one. Only the
suffixes that start at minimisers are kept, and of those only the ones whose k-mer seems to occur elsewhere (a Bloom
filter of fixed size, made of the k-mers counted twice or more). They are sorted
by their words over the cluster (a range sort, so one frequent passage spreads over tasks); each suffix is compared
with its neighbours in the order, the match is extended to the left, and matches of ``MIN_WORDS`` words or more mark
their words. Marks of one text that touch are joined.

Words are compared by 32-bit hashes (the k-mer by all 64 bits) of a bounded context on either side: as many words as a
match needs to the right, a minimiser window to the left. A longer passage has minimisers all along it, so its marks
overlap and join to the whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataweave.llm.common import bounded_batches, materialize, pick
from strataweave.llm.words import Words, window_hashes

MIN_WORDS = 50
#: k-mer length and minimiser window; K + WINDOW - 1 must not exceed MIN_WORDS.
K, WINDOW = 12, 38
#: Words of context kept to the left of a suffix's start; to the right (its own k-mer included) as many as a match needs.
#: A match's first minimiser lies within its first WINDOW words.
LEFT = WINDOW
#: Bits of the Bloom filter of frequent k-mers (8 MB whatever the input). Where it fills up, more suffixes are sorted
#: that have no equal; the result is the same.
FILTER_BITS = 1 << 26


def minimisers(kmers: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions whose k-mer is the smallest of some ``window`` successive ones; a run of one selected k-mer keeps one in ``window`` words and its ends."""
    n = len(kmers)
    if n == 0:
        return np.zeros(0, np.int64)
    if n <= window:
        at = np.flatnonzero(kmers == kmers.min())
    else:
        least = _sliding(kmers, window, np.minimum)
        pad = np.zeros(window - 1, kmers.dtype)
        most = _sliding(np.concatenate([pad, least, pad]), window, np.maximum)
        at = np.flatnonzero(kmers == most)
    own = kmers[at]
    opens = np.append(True, own[1:] != own[:-1])
    begin = at[opens][np.cumsum(opens) - 1]
    step = (at - begin) // window
    return at[opens | np.append(True, step[1:] != step[:-1]) | np.append(opens[1:], True)]


def _sliding(x: np.ndarray, window: int, pick_one) -> np.ndarray:
    """pick_one over every ``window`` successive elements, by doubling."""
    have = 1
    while have * 2 <= window:
        x = pick_one(x[: len(x) - have], x[have:])
        have *= 2
    rest = window - have
    return pick_one(x[: len(x) - rest], x[rest:]) if rest else x


def _select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, len(b), 200):
            part, kmer = Words(b.column("text").slice(at, 200)), []
            for i in range(len(part)):
                own = window_hashes(part.of(i), K)
                kmer.append(own[minimisers(own)].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kmer))], ["kmer"])


def _filter_slots(kmers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(FILTER_BITS - 1)
    return kmers & mask, (kmers >> np.uint64(32)) & mask


def frequent_filter(kmers: DataFrame) -> np.ndarray:
    """Bits (as uint64 words) of the k-mers that occur more than once. What reaches the driver is bounded by the filter."""
    often = kmers.groupBy("kmer").agg(F.count("*").alias("n")).filter("n > 1")
    slots = F.explode(F.array(F.col("kmer").bitwiseAND(FILTER_BITS - 1), F.shiftrightunsigned("kmer", 32).bitwiseAND(FILTER_BITS - 1)))
    words = often.select(slots.alias("slot")).select(F.shiftright("slot", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    table = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits[table["word"].to_numpy()] = table["bits"].to_numpy()
    return bits.view(np.uint64)


_SUFFIX = "kmer long, suffix binary, prefix binary, doc_id long, text_key long, place int"


def _contexts(shared, right: int):
    """The kept suffixes of each text: words to the right, and words to the left in reverse order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _SUFFIX.split(", ")]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]
        bits = shared.value
        held = lambda slot: (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
        for b in batches:
            ids = list(zip(b.column("doc_id").to_pylist(), b.column("text_key").to_pylist(), strict=True))
            for at in range(0, len(b), 100):
                part, rows = Words(b.column("text").slice(at, 100)), []
                for i in range(len(part)):
                    own = part.of(i)
                    kmers = window_hashes(own, K)
                    found = minimisers(kmers)
                    one, two = _filter_slots(kmers[found])
                    found = found[held(one) & held(two)]
                    short = (own >> np.uint64(32)).astype(">u4")
                    for p, k in zip(found.tolist(), kmers[found].astype(np.int64).tolist(), strict=True):
                        rows.append((k, short[p : p + right].tobytes(), short[max(0, p - LEFT) : p][::-1].tobytes(), *ids[at + i], p))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def _common(a: bytes, b: bytes) -> int:
    """Leading words two contexts share."""
    n = min(len(a), len(b)) // 4
    differ = np.flatnonzero(np.frombuffer(a, "<u4", n) != np.frombuffer(b, "<u4", n))
    return int(differ[0]) if len(differ) else n


def _match(x: tuple, y: tuple, least: int) -> tuple[int, int] | None:
    """(words left of the start, words from it) that suffixes x and y share, if they are ``least`` or more together."""
    if x[0] != y[0]:
        return None
    right = _common(x[1], y[1])
    left = _common(x[2], y[2])
    return (left, right) if left + right >= least else None


_MARKED = "doc_id long, text_key long, first int, last int, match_doc_id long"
_MET = f"{_MARKED}, part int, edge string, " + ", ".join(f"e_{f}" for f in _SUFFIX.split(", "))
_NAMES = tuple(f.split()[0] for f in _SUFFIX.split(", "))


def _arrays(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _neighbours(least: int):
    """Over one sorted partition: a mark for each suffix that matches a neighbour, and its first and last suffix as edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = lambda x, part, name: (*[None] * 5, part, name, *x)
        last, part = None, 0
        for b in batches:
            rows = []
            for *x, part in zip(*(b.column(c).to_pylist() for c in (*_NAMES, "part")), strict=True):
                if x == last:
                    continue  # a repeated row
                if last is None:
                    rows.append(edge(x, part, "first"))
                else:
                    rows += [(*m, part, None, *[None] * 6) for m in _marks(last, x, least)]
                last = x
            if rows:
                yield _arrays(rows, _MET)
        if last is not None:
            yield _arrays([edge(last, part, "last")], _MET)

    return run


def _marks(x: list, y: list, least: int) -> list[tuple]:
    met = _match(x, y, least)
    if met is None:
        return []
    left, right = met
    return [(a[3], a[4], a[5] - left, a[5] + right, b[3]) for a, b in ((x, y), (y, x))]


def _across(least: int):
    """Edges: the last suffix of one partition beside the first of the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                x, y = ([r[f"{side}_{c}"] for c in _NAMES] for side in "ef")
                rows += _marks(x, y, least) if x != y else []
            yield _arrays(rows, _MARKED)

    return run


def repeated_passages(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per repeated passage of a text: doc_id, first_word, n_words, match_doc_id (a text that shares part of it).

    Words ``first_word`` to ``first_word + n_words`` (counted from 0) lie in matches of ``min_words`` or more with another
    text or with another place of the same text (a phrase said over and over matches itself). Null and empty texts, texts
    under ``min_words`` and rows with a null doc_id have none. Rows of one doc_id with different texts give passages of
    that doc_id for each text. Repeated rows (same doc_id and text) are one text. An empty table gives an empty result.
    Columns besides doc_id and text are not read. ``min_words`` must be K + WINDOW - 1 or more.
    """
    if min_words < K + WINDOW - 1:
        raise ValueError(f"min_words must be {K + WINDOW - 1} or more")
    bounded_batches(documents.sparkSession)
    texts = pick(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key")).filter("doc_id is not null")
    bits = frequent_filter(texts.select("text").mapInArrow(_select, "kmer long"))
    shared = documents.sparkSession.sparkContext.broadcast(bits)
    suffixes = texts.mapInArrow(_contexts(shared, min_words), _SUFFIX)
    ordered = suffixes.repartitionByRange(*_NAMES).sortWithinPartitions(*_NAMES)
    met = materialize(ordered.withColumn("part", F.spark_partition_id()).mapInArrow(_neighbours(min_words), _MET), "suffix-met")
    marks = met.filter("edge is null").select("doc_id", "text_key", "first", "last", "match_doc_id")
    # Partitions in order; two edge rows each.
    edges = met.filter("edge is not null")
    following = Window.orderBy("part", F.col("edge") == "last")
    after = [F.lead(f"e_{c}").over(following).alias(f"f_{c}") for c in _NAMES]
    pairs = edges.select("edge", *(f"e_{c}" for c in _NAMES), *after, F.lead("edge").over(following).alias("edge2")).filter("edge = 'last' and edge2 = 'first'")
    return _joined(marks.unionByName(pairs.drop("edge", "edge2").mapInArrow(_across(min_words), _MARKED)))


def _joined(marks: DataFrame) -> DataFrame:
    """Marks of one text that overlap or touch become one passage. No task sees more than the marks of a text."""
    marks = marks.groupBy("doc_id", "text_key", "first").agg(F.max("last").alias("last"), F.min("match_doc_id").alias("match_doc_id"))
    text = ("doc_id", "text_key")
    before = Window.partitionBy(*text).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumn("new", (F.col("first") > F.coalesce(F.max("last").over(before), F.lit(-1))).cast("int"))
    marks = marks.withColumn("run", F.sum("new").over(Window.partitionBy(*text).orderBy("first")))
    out = marks.groupBy(*text, "run").agg(F.min("first").alias("first_word"), F.max("last").alias("end"), F.min("match_doc_id").alias("match_doc_id"))
    return out.select("doc_id", F.col("first_word").cast("long"), (F.col("end") - F.col("first_word")).cast("long").alias("n_words"), "match_doc_id")
