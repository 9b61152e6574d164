"""The same conform and upsert for rows that keep arriving.

Rules and checks keep no state, so they run on a streaming DataFrame as they are. Writing goes through
``foreachBatch``: the batch number is the run id, and a batch that was already committed is not applied again
when a restarted query repeats it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.conform import ROW_INDEX, conform
from ..pipeline import execute
from ..plans.spec import Plan
from ..sources.row_index import with_row_index
from ..sources.store import Store


def accepted_stream(stream: DataFrame, plan: Plan, spec, index: str) -> DataFrame:
    """Accepted rows of a stream whose rows carry their own position."""
    return conform(stream, plan, spec, index).accepted()


def batch_writer(
    store: Store, plan: Plan, name: str, clock: Callable[[], str], detect_changes: bool = True
) -> Callable[[DataFrame, int], None]:
    plan.require_approved(store.spec)

    def write(batch: DataFrame, number: int) -> None:
        run_id = f"{name}_{number:08d}"
        if store.committed(run_id) or batch.isEmpty():
            return
        rows = batch if ROW_INDEX in batch.columns else with_row_index(batch)
        execute(store, rows, plan, run_id, clock(), actor=name, detect_changes=detect_changes)

    return write


def start(
    stream: DataFrame, store: Store, plan: Plan, name: str, checkpoint: str, clock: Callable[[], str], **trigger
) -> StreamingQuery:
    writer = batch_writer(store, plan, name, clock)
    return (
        stream.writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint).queryName(name)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
