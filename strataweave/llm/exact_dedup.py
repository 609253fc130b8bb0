"""Exact deduplication by Grace hashing.

Level 0 of the partitioning is Spark's own shuffle by content hash; below it each task keeps an open-addressing table
of complete contents. Once the table holds ``budget`` bytes, contents it has no slot for go to spill files, one per
value of the next hash bits, and each file is worked off the same way, so memory stays bounded whatever a partition
holds. Every input partition is combined with the same table before the shuffle: a group of copies, however large,
sends one row per input partition, not one per copy.

Spill files live in one task and in Spark's own local folders, as its shuffle spills do: a task that is lost takes them
along and starts anew. Rows learn their group by SHA-256; that no two contents share one is checked, not taken for granted.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.common import SPACE, bounded_batches, join_group_facts, materialize, pick, smaller, whole_rows

#: Content bytes a task's table may hold before it spills.
TABLE_BYTES = 64 << 20
FANOUT_BITS = 4
_OUT = pa.schema([("sha", pa.binary()), ("text", pa.string()), ("keep_id", pa.int64()), ("n", pa.int64()), ("same", pa.int64())])


class OpenTable:
    """Linear-probing table: a slot holds an entry's number; equal hashes are told apart by complete content."""

    def __init__(self, slots: int = 1024):
        self.slots = np.full(slots, -1, np.int64)
        self.hash: list[int] = []
        self.content: list[bytes] = []
        self.value: list[list] = []
        self.bytes = 0

    def find(self, h: int, content: bytes) -> tuple[int, int]:
        """(entry or -1, slot): where the content is, or where it would go."""
        mask = len(self.slots) - 1
        at = h & mask
        while (entry := int(self.slots[at])) >= 0:
            if self.hash[entry] == h and self.content[entry] == content:
                return entry, at
            at = (at + 1) & mask
        return -1, at

    def put(self, slot: int, h: int, content: bytes, value: list) -> None:
        self.slots[slot] = len(self.hash)
        self.hash.append(h)
        self.content.append(content)
        self.value.append(value)
        self.bytes += len(content) + 100
        if 2 * len(self.hash) > len(self.slots):
            old, mask = self.hash, 2 * len(self.slots) - 1
            self.slots = np.full(mask + 1, -1, np.int64)
            for entry, h in enumerate(old):
                at = h & mask
                while self.slots[at] >= 0:
                    at = (at + 1) & mask
                self.slots[at] = entry


def _merge(own: list, other: list) -> None:
    """[smallest id (null if there is no other), rows, rows with that id] of two parts of a group, into the first."""
    if own[0] == other[0]:
        own[2] += other[2]
    elif own[0] is None or other[0] is not None and other[0] < own[0]:
        own[0], own[2] = other[0], other[2]
    own[1] += other[1]


def grace_groups(rows: Iterator[tuple[bytes, bytes, list]], budget: int, folder: str, level: int = 0) -> Iterator[tuple[bytes, bytes, list]]:
    """Groups (hash, content, [smallest id, rows, rows with it]) of rows (sha, content, the same), in bounded memory."""
    table, files = OpenTable(), {}
    for sha, content, value in rows:
        h = int.from_bytes(sha[:8], "little")
        entry, slot = table.find(h, content)
        if entry >= 0:
            _merge(table.value[entry], value)
        elif table.bytes < budget or not table.hash:
            table.put(slot, h, content, list(value))
        else:
            part = (h >> (FANOUT_BITS * (level % 12) + 8)) & ((1 << FANOUT_BITS) - 1)
            if part not in files:
                path = f"{folder}/{level}-{part}.arrow"
                schema = pa.schema([("sha", pa.binary()), ("c", pa.large_binary()), ("id", pa.int64()), ("n", pa.int64()), ("same", pa.int64())])
                files[part] = [path, pa.ipc.new_file(path, schema), schema, []]
            files[part][3].append((sha, content, *value))
            if len(files[part][3]) >= 256:
                _flush(files[part])
    if table.hash:
        for h, content, value in zip(table.hash, table.content, table.value, strict=True):
            yield h, content, value
    del table
    for spill in files.values():
        _flush(spill)
        spill[1].close()
        below = f"{folder}/{level}.d"
        os.makedirs(below, exist_ok=True)
        yield from grace_groups(_spilled(spill[0]), budget, below, level + 1)
        os.remove(spill[0])


def _flush(spill: list) -> None:
    if spill[3]:
        spill[1].write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*spill[3]), spill[2], strict=True)], schema=spill[2]))
        spill[3] = []


def _spilled(path: str) -> Iterator[tuple[bytes, bytes, list]]:
    with pa.OSFile(path) as f:
        reader = pa.ipc.open_file(f)
        for i in range(reader.num_record_batches):
            for sha, content, *value in zip(*(c.to_pylist() for c in reader.get_batch(i).columns), strict=True):
                yield sha, content, value


def _combine(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        def rows():
            for b in batches:
                values = zip(*(b.column(c).to_pylist() for c in ("keep_id", "n", "same")), strict=True)
                for sha, text, value in zip(b.column("sha").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), values, strict=True):
                    yield sha, text, list(value)

        # Spark tells its workers its local folders; a folder of the machine serves only outside of one.
        folder = tempfile.mkdtemp(prefix="grace-", dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
        try:
            held: list[tuple] = []
            size = 0
            for _, content, value in grace_groups(rows(), budget, folder):
                held.append((hashlib.sha256(content).digest(), content, *value))
                size += len(content)
                if size > 4 << 20:
                    yield _batch(held)
                    held, size = [], 0
            if held:
                yield _batch(held)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return run


def _batch(held: list[tuple]) -> pa.RecordBatch:
    sha, content, *values = zip(*held, strict=True)
    columns = [pa.array(sha, pa.binary()), pa.array(content, pa.binary()).cast(pa.string()), *(pa.array(v, pa.int64()) for v in values)]
    return pa.RecordBatch.from_arrays(columns, schema=_OUT)


def normalised(text=None):
    """Each run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col("text") if text is None else text, F.lit("")), rf"[{SPACE}]+", " ")


def content_groups(documents: DataFrame, budget: int = TABLE_BYTES) -> DataFrame:
    """One row per distinct normalised text: sha (binary), keep_id (smallest doc_id), n, same (rows with keep_id).

    Texts are compared in full. The result is a table in the shared folder.
    """
    bounded_batches(documents.sparkSession)
    rows = pick(documents, "doc_id", "text").select(
        F.unhex(F.sha2(normalised(), 256)).alias("sha"), normalised().alias("text"), F.col("doc_id").cast("long").alias("keep_id"), *(F.lit(1).cast("long").alias(c) for c in ("n", "same"))
    )
    schema = "sha binary, text string, keep_id long, n long, same long"
    once = rows.mapInArrow(_combine(budget), schema)
    return materialize(once.repartition("sha").mapInArrow(_combine(budget), schema).drop("text"), "exact-groups")


def _copied(groups: DataFrame) -> tuple[DataFrame, int]:
    """(groups of two rows or more, all rows). Raises ValueError if such a group shares its SHA-256 with another text."""
    many = groups.filter("n > 1")
    shared = groups.join(smaller(many.select("sha"), 40), "sha", "left_semi").groupBy("sha").count().filter("count > 1")
    if shared.limit(1).count():
        raise ValueError("two different texts share one SHA-256")
    return many, groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def exact_dedup(documents: DataFrame, budget: int = TABLE_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Of equal texts the smallest doc_id stays (a null doc_id only if no other is there).
    Repeated rows: rows with the kept doc_id all count as kept. An empty table gives an empty result. Columns besides
    doc_id and text are not read.
    """
    many, total = _copied(content_groups(documents, budget))
    rows = pick(documents, "doc_id", "text").select("doc_id", F.unhex(F.sha2(normalised(), 256)).alias("sha"))
    out = join_group_facts(rows, many.select("sha", "keep_id", F.col("n").alias("group_size")), "sha", "group_size", total)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(documents: DataFrame, budget: int = TABLE_BYTES) -> DataFrame:
    """The rows of ``documents``, all columns, less all but one of each group of equal texts (the smallest doc_id stays).

    Null text counts as empty; a null doc_id stays only where no other is there. Of rows equal in doc_id and text one
    stays, whichever. An empty table gives an empty one. Columns of any name may stand beside doc_id and text.
    """
    many, total = _copied(content_groups(documents, budget))
    rows = whole_rows(documents).withColumn("sha", F.unhex(F.sha2(normalised(F.col("row.text")), 256)))
    met = join_group_facts(rows, many, "sha", "n", total)
    staying = F.col("n").isNull() | F.col("row.doc_id").cast("long").eqNullSafe(F.col("keep_id"))
    # Rows that repeat the one that stays are few, if any: only they are compared once more.
    once = met.filter(staying & (F.coalesce("same", F.lit(1)) == 1)).select("row")
    twice = rows.join(smaller(many.filter("same > 1").select("sha", "keep_id"), 48), "sha").filter(F.col("row.doc_id").cast("long").eqNullSafe(F.col("keep_id")))
    return once.unionByName(twice.dropDuplicates(["sha"]).select("row")).select("row.*")
