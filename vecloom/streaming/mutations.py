"""A stream of changes applied to a VectorTable, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.mutate import latest
from ..plans.table import VectorTable


def apply_changes(table: VectorTable, changes: DataFrame) -> None:
    """Applies rows (seq, op, key, vector): of each key the last one counts."""
    last = latest(changes.withColumn("key", F.col("key").cast("string"))).persist()
    table.insert(last.where("op != 'delete'").select("key", "vector"))
    table.delete(last.where("op = 'delete'").select("key"))
    last.unpersist()


def follow(table: VectorTable, changes: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts a query that applies a stream of changes. A batch that is run again after a failure writes the same last
    changes again, which leaves the table as it was."""
    return changes.writeStream.foreachBatch(lambda df, _: apply_changes(table, df)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
