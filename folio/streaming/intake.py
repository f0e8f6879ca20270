"""New upload files -> validated, deduplicated, registered papers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from folio.plans.submit import submit
from folio.schemas import MAX_UPLOAD_BYTES, UPLOAD
from folio.sources.store import PaperStore


def stream_uploads(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """A ``binaryFile`` stream; ``maxFilesPerTrigger`` bounds a micro-batch."""
    return (
        spark.readStream.format("binaryFile")
        .schema(UPLOAD)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .option("recursiveFileLookup", "true")
        .load(path)
    )


def register_batch(
    store: PaperStore,
    max_bytes: int = MAX_UPLOAD_BYTES,
    batch_offset: int = 0,
    compact_every: int | None = None,
) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` body: dedup + raw write + insert for one micro-batch.

    With ``compact_every=N`` the store is compacted after every N-th batch, so
    reads keep touching only the folders written since (run compaction from
    one stream only).
    """

    def run(batch_df: DataFrame, batch_id: int) -> None:
        submit(store, batch_df.select(*UPLOAD.fieldNames()), batch_offset + batch_id, max_bytes, replies=False)
        if compact_every and (batch_id + 1) % compact_every == 0:
            store.compact()

    return run


def start_intake(
    uploads: DataFrame,
    store: PaperStore,
    checkpoint: str,
    max_bytes: int = MAX_UPLOAD_BYTES,
    available_now: bool = False,
    batch_offset: int = 0,
    compact_every: int | None = None,
) -> StreamingQuery:
    w = uploads.writeStream.foreachBatch(register_batch(store, max_bytes, batch_offset, compact_every)).option(
        "checkpointLocation", checkpoint
    )
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
