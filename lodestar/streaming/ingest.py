"""Streaming writes: a stream of log rows folded into stored nodes, and appended with a trigger."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lodestar.operators.store import SET, fold

NODES = "internal_id long, id string, embedding array<float>, deleted boolean, deleted_at long"
STATE = "seq long, embedding array<float>"


class StoredVector(StatefulProcessor):
    """Keeps each id's stored vector; a batch of its rows is folded in order on top of that."""

    def __init__(self, metric: str = "cosine"):
        self.metric = metric

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getValueState("stored", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable")
        name = key[0]
        before = self.stored.get() if self.stored.exists() else None
        feed = [(name, before[0], SET, list(before[1]))] if before else []
        feed += [(name, int(s), op, None if v is None else list(v)) for s, op, v in zip(frame["seq"], frame["op"], frame["embedding"], strict=True)]
        found = list(fold(iter(feed), self.metric))
        live = next((n for n in found if not n[3]), None)
        if live:
            self.stored.update((int(live[0]), [float(x) for x in live[2]]))
        elif self.stored.exists():
            self.stored.clear()
        # A node stored earlier is told again only when it has been deleted since.
        told = [n for n in found if not (before and n[0] == before[0] and not n[3])]
        yield pd.DataFrame(told, columns=["internal_id", "id", "embedding", "deleted", "deleted_at"])

    def close(self) -> None:
        pass


def fold_stream(log: DataFrame, metric: str = "cosine") -> DataFrame:
    """Changes of the stored nodes, as rows (internal_id, id, embedding, deleted, deleted_at).

    State is one vector for each live id, in the state store; restarts go on from the checkpoint.
    """
    return log.groupBy("id").transformWithStateInPandas(StoredVector(metric), NODES, "Update", "None")


def append_stream(log: DataFrame, path: str, checkpoint: str, seconds: int = 15, once: bool = False) -> StreamingQuery:
    """Write the stream as Parquet every ``seconds``, exactly once; ``once``: what is there, then stop."""
    writer = log.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def upsert_stream(log: DataFrame, handle, checkpoint: str, once: bool = False) -> StreamingQuery:
    """``handle(batch, number)`` for each micro-batch, with the stream's checkpoint."""
    writer = log.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
