"""Arriving TEI -> its papers running -> Document -> done / failed.

Two streams meet: TEI as it lands, and registrations (the ``papers`` folders of
the store). TEI that comes before its paper is registered waits in the state of
the stream, by content hash, and goes on with the registration; TEI of a
registered paper goes on at once. Either arrival starts a micro-batch, so
nothing waits for a later run. New TEI for a failed paper is another attempt; a
paper that is done stays as it is.

State: a flag for each registered paper, and the texts that wait, which leave it
with the registration. Equal texts of one paper wait once. The Documents are made in
``foreachBatch`` by ``plans.process``, under the micro-batch's own number, so a replayed
micro-batch lands on the same folders.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folio.operators import engines
from folio.plans.process import process
from folio.session import ship_package
from folio.sources.store import INSERTS_SCHEMA, PaperStore

# Parse batches are numbered apart from intake batches in the same store.
PARSE_BATCH_OFFSET = 1 << 40
TEI_TABLE = "paper_id string, source_hash string, tei string"


def stream_tei(spark: SparkSession, path: str, max_files_per_trigger: int = 100) -> DataFrame:
    """A growing Parquet table of TEI (``paper_id, source_hash, tei``) as a stream."""
    return spark.readStream.schema(TEI_TABLE).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)


def stream_registrations(store: PaperStore, max_files_per_trigger: int = 1000) -> DataFrame:
    """The store's registered papers as a stream: ``(id, content_hash)``."""
    store.make("papers")
    return (
        store.spark.readStream.schema(INSERTS_SCHEMA)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .option("basePath", f"{store.root}/papers")
        .parquet(f"{store.root}/papers")
        .select("id", "content_hash")
    )


def wait_for_paper(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One key's TEI, once its paper is registered; before that it is kept in the state."""
    registered, waiting = state.get if state.exists else (False, [])
    ready: list[str | None] = []
    fresh = list(waiting)
    for pdf in batches:
        registered = registered or bool(pdf["registered"].any())
        fresh += pdf["tei"][~pdf["registered"]].tolist()
    if registered:
        ready, fresh = fresh, []
    if fresh or registered:
        # Not more than one copy of a text, in the order of arrival.
        state.update((registered, list(dict.fromkeys(fresh))))
    yield pd.DataFrame({"key": [key[0]] * len(ready), "tei": pd.Series(ready, dtype=object)})


def matched(tei: DataFrame, registrations: DataFrame, tei_key: str = "source_hash") -> DataFrame:
    """``(<tei_key>, tei)`` of registered papers, as soon as both sides are there."""
    paper_key = {"source_hash": "content_hash", "paper_id": "id"}[tei_key]
    ship_package(tei.sparkSession)
    both = tei.where(F.col(tei_key).isNotNull()).select(F.col(tei_key).alias("key"), "tei", F.lit(False).alias("registered"))
    both = both.unionByName(registrations.select(F.col(paper_key).alias("key"), F.lit(None).cast("string").alias("tei"), F.lit(True).alias("registered")))
    out = both.groupBy("key").applyInPandasWithState(
        wait_for_paper, "key string, tei string", "registered boolean, waiting array<string>", "update", GroupStateTimeout.NoTimeout
    )
    return out.withColumnRenamed("key", tei_key)


def parse_batch(
    store: PaperStore,
    engine: engines.Engine = engines.TEI_ENGINE,
    batch_offset: int = PARSE_BATCH_OFFSET,
    tei_key: str = "source_hash",
) -> Callable[[DataFrame, int], None]:
    def run(batch_df: DataFrame, batch_id: int) -> None:
        # The stateful step runs once: its rows are written before they are read twice.
        ready = store.write_work(batch_df, batch_offset + batch_id, "ready")
        if not ready.isEmpty():
            process(store, ready, batch_offset + batch_id, engine, tei_key, probe=True, retry_failed=True)

    return run


def start_parse(
    tei_stream: DataFrame,
    store: PaperStore,
    checkpoint: str,
    available_now: bool = False,
    tei_key: str = "source_hash",
) -> StreamingQuery:
    rows = matched(tei_stream, stream_registrations(store), tei_key)
    w = rows.writeStream.outputMode("update").foreachBatch(parse_batch(store, tei_key=tei_key)).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
