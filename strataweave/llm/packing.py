"""Cost-balanced packing of documents into sequences of at most ``capacity`` tokens.

A document's cost in a sequence is ``linear * n + quadratic * n * n`` (attention within the document). Documents are
dealt by hash into groups of about ``GROUP_DOCS`` or fewer; each group is packed by itself in one task's memory. Whole
``capacity``-token runs of a long document become sequences of their own. What is left is placed longest first, each in
the cheapest sequence with room for it; if none has room the piece is cut at the largest gap and its rest goes back in
line. A group's sequences are sized before it starts: as many full ones as its tokens fill, then one for each binary
digit of the remainder, so nothing is padded (a power of two needs no padding).
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm import tokens
from strataweave.llm.common import bounded_batches, pick

CAPACITY = 4096
GROUP_DOCS = 1000
#: Bytes of text a group may hold on average: long documents make smaller groups.
GROUP_BYTES = 16 << 20
#: Cost of a token by itself, and of each pair of tokens of one document in one sequence.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


def plan_group(lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; ``lengths`` in any order, ties broken by position."""
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    line: list[tuple[int, int, int]] = []
    for d, n in enumerate(lengths):
        whole = n // capacity
        for k in range(whole):
            pieces.append((d, k * capacity, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            line.append((-(n % capacity), d, whole * capacity))
    total = -sum(x[0] for x in line)
    sizes = [capacity] * (total // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if total % capacity >> b & 1]
    room, cost, used = np.array(sizes, np.int64), np.zeros(len(sizes)), np.zeros(len(sizes), np.int64)
    heapq.heapify(line)
    while line:
        n, d, start = heapq.heappop(line)
        n = -n
        fits = room >= n
        at = int(np.argmin(np.where(fits, cost, np.inf))) if fits.any() else int(np.argmax(room))
        put = min(n, int(room[at]))
        pieces.append((d, start, put, sequence + at, int(used[at])))
        room[at] -= put
        used[at] += put
        cost[at] += linear * put + quadratic * put * put
        if put < n:
            heapq.heappush(line, (put - n, d, start + put))
    return pieces


def _pack(path: str, capacity: int, linear: float, quadratic: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        group, held = None, []
        for b in batches:
            for g, d, text in zip(b.column("grp").to_pylist(), b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                if g != group and held:
                    yield _packed(group, held, capacity, linear, quadratic)
                    held = []
                group = g
                held.append((d, encoder.ids(text.as_py())))
        if held:
            yield _packed(group, held, capacity, linear, quadratic)

    return run


def _packed(group: int, docs: list[tuple], capacity: int, linear: float, quadratic: float) -> pa.RecordBatch:
    rows = plan_group([len(ids) for _, ids in docs], capacity, linear, quadratic)
    size: dict[int, int] = {}
    for _, _, n, s, _ in rows:
        size[s] = size.get(s, 0) + n
    out = [
        (docs[d][0], start, n, zlib.crc32(docs[d][1][start : start + n].astype("<u4")), len(docs[d][1]), group << 32 | s, offset, size[s])
        for d, start, n, s, offset in rows
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], [f.split()[0] for f in _SCHEMA.split(", ")])


def pack(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens.

    Null or empty text is the end id alone. Repeated rows are packed each by itself (same doc_id, other pieces); an
    empty table gives an empty result. ``capacity`` must be a power of two. Columns besides doc_id and text are not read.
    Groups are dealt by doc_id and text, so a repeated doc_id does not gather; equal rows lie side by side in one group.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    bounded_batches(documents.sparkSession)
    docs, size = documents.select(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    groups = max(1, round(docs / group_docs), size // GROUP_BYTES)
    rows = pick(documents, "doc_id", "text").select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).alias("grp"), F.col("doc_id").cast("long"), "text")
    dealt = rows.repartition("grp").sortWithinPartitions("grp", "doc_id", F.xxhash64("text"))
    return dealt.mapInArrow(_pack(tokenizer or tokens.default_path(), capacity, linear, quadratic), _SCHEMA)
