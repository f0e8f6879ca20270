"""Live paper status from the status-log stream.

A streaming aggregation keeps one summary row per paper (the latest value of
each column with its key, and the attempt count), of fixed size however many
log rows the paper has; each micro-batch emits only the papers it changed
(update mode). Those rows are appended under ``batch=N`` and the newest row per
paper is the current summary, which ``apply_summary`` joins to the inserted
papers exactly as the batch fold does. ``compact_summaries`` replaces the
snapshots so far by their newest rows. A stream that compacts as it runs does so
once the snapshots after the base are as large as the base, so all its compactions
together write no more than a small multiple of what the stream wrote, however
many micro-batches there are.

A replayed batch writes its log folder again, under new file names, so the
stream sees its rows twice. They are known by ``(paper_id, batch, step, seq)``:
a second copy that arrives within ``REPLAY`` of the first is dropped, and that
state is let go of with the watermark on the time of arrival (the files' own;
the time that a row is *about* can be any, late rows are folded by it).

State is kept by the RocksDB provider, set in a session of the stream's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from folio.operators import lifecycle
from folio.schemas import STATUS_LOG, UNTIL
from folio.sources.store import PaperStore

REPLAY = "1 day"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def status_session(spark: SparkSession) -> SparkSession:
    """A session for a status stream: same context, own SQL settings.

    The state store has one partition per shuffle partition, fixed at the
    stream's first run, so it is sized to the cluster's cores.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return own


def stream_store_log(spark: SparkSession, store: PaperStore, max_files_per_trigger: int = 100, replay: str = REPLAY) -> DataFrame:
    """The store's status log as a stream: new ``step=S/batch=N`` files as they land, each row once."""
    schema = T.StructType([*STATUS_LOG.fields, UNTIL, T.StructField("batch", T.LongType()), T.StructField("step", T.IntegerType())])
    log = (
        status_session(spark)
        .readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .option("basePath", f"{store.root}/log")
        .parquet(f"{store.root}/log")
    )
    arrived = log.withColumn("arrived", F.col("_metadata.file_modification_time")).withWatermark("arrived", replay)
    return arrived.dropDuplicatesWithinWatermark(["paper_id", "batch", "step", "seq"]).drop("arrived")


def stream_status(log_stream: DataFrame) -> DataFrame:
    """Per-paper summary of a status-log stream (a streaming ``groupBy``)."""
    return lifecycle.summarise_log(log_stream)


def start_status(log_stream: DataFrame, out_path: str, checkpoint: str, available_now: bool = False, compact_every: int | None = None) -> StreamingQuery:
    """``compact_every=N``: after every N-th batch the snapshots are compacted if they have outgrown their base."""

    def write(batch_df: DataFrame, batch_id: int) -> None:
        batch_df.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        if compact_every and (batch_id + 1) % compact_every == 0 and _outgrown(batch_df.sparkSession, out_path):
            compact_summaries(batch_df.sparkSession, out_path)

    w = (
        stream_status(log_stream)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def _folders(files: PaperStore) -> tuple[int, list[int]]:
    """The last batch in the newest base (-1 if there is none), and the batches after it."""
    upto = max((n for n in files._children("base", "upto") if files.exists(f"base/upto={n}/_SUCCESS")), default=-1)
    return upto, files._batches("", after=upto)


def _outgrown(spark: SparkSession, path: str) -> bool:
    """Are the batches after the newest base at least as large as it?"""
    files = PaperStore(spark, path)
    upto, batches = _folders(files)
    return upto < 0 or sum(files.size(f"batch={n}") for n in batches) >= files.size(f"base/upto={upto}")


def _snapshots(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Summary rows with the batch that wrote them, and the last batch: of the newest base and the batches after it."""
    upto, batches = _folders(PaperStore(spark, path))
    parts = []
    if batches:
        after = spark.read.option("basePath", path).parquet(*[f"{path}/batch={n}" for n in batches])
        parts.append(after.withColumn("batch", F.col("batch").cast("long")))
    if upto >= 0:
        parts.append(spark.read.parquet(f"{path}/base/upto={upto}").withColumn("batch", F.lit(upto).cast("long")))
    if not parts:
        raise FileNotFoundError(path)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, max([upto, *batches])


def latest_summaries(spark: SparkSession, path: str) -> DataFrame:
    """The newest summary row per paper (partial aggregation, one shuffle)."""
    return _newest(_snapshots(spark, path)[0])


def _newest(snap: DataFrame) -> DataFrame:
    cols = [c for c in snap.columns if c not in ("paper_id", "batch")]
    latest = F.max_by(F.struct(*cols), F.col("batch")).alias("s")
    return snap.groupBy("paper_id").agg(latest).select("paper_id", "s.*")


def compact_summaries(spark: SparkSession, path: str) -> int:
    """Write the newest row per paper as a base; later reads take it and the batches after it. Returns the last batch in it."""
    snap, last = _snapshots(spark, path)
    _newest(snap).write.mode("overwrite").parquet(f"{path}/base/upto={last}")
    return last
