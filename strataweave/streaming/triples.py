"""Incremental triples: the column context is fixed, so emission is a stateless stream; profiles run per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.operators import emit as E
from strataweave.operators.profile import column_stats
from strataweave.plans.interpret import Context


def emit_stream(rows: DataFrame, row_id: str, ctx: Context, concepts: DataFrame, disjoint: DataFrame) -> DataFrame:
    """Triples of a streaming table under a context analysed before; broadcast joins only, no state, append mode."""
    out = E.emit(rows, row_id, ctx.columns, ctx.predicates, ctx.primary, ctx.sibling, F.broadcast(concepts), disjoint)
    return out.unionByName(E.links(rows, row_id, ctx.primary, ctx.links)) if ctx.links else out


def profile_batches(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """A profile of each micro-batch, handed to ``sink(stats, batch_id)``; top-k and distinct counts need a whole batch."""
    return rows.writeStream.foreachBatch(lambda df, i: sink(column_stats(df), i)).option("checkpointLocation", checkpoint).start()


def windowed_activity(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per window and event type, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
