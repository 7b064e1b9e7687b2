"""Appends a stream to a versioned table, each micro-batch once.

A batch's rows are written as a new segment, and the state that names the segment also notes the
stream and the batch's number. If a batch comes again after a failure, the note is there and nothing
is added; if the failure came before the state was written, the folder is one that no state names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brindle.sources.snapshots import Store
from brindle.sql.errors import EngineError


def append_batch(store: Store, database: str, table: str, stream: str, rows: DataFrame, batch: int) -> bool:
    """Adds one micro-batch; False if it was there already."""
    described = store.state()["databases"].get(database, {}).get("tables", {}).get(table)
    if described is None:
        raise EngineError(f'table "{table}" does not exist')
    if described.get("streams", {}).get(stream, -1) >= batch:
        return False
    fields = store.schema(described).fields
    path, n = store.write(store.with_keys(rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields))))
    added = False

    def change(state: dict) -> None:
        nonlocal added
        here = state["databases"][database]["tables"][table]
        added = here.setdefault("streams", {}).get(stream, -1) < batch
        if added:
            here["streams"][stream] = batch
            here["segments"] += [path] if n else []

    store.publish(change)
    return added


def ingest(stream_df: DataFrame, store: Store, table: str, name: str, checkpoint: str, database: str = "main", **trigger) -> StreamingQuery:
    """Starts a query that appends stream_df to the table; ``trigger`` as in DataStreamWriter.trigger."""

    def each(rows: DataFrame, batch: int) -> None:
        append_batch(store, database, table, name, rows, batch)

    writer = stream_df.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(**trigger) if trigger else writer).start()
