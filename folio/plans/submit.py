"""Entry point A as a batch job: register a batch of uploads.

O1 scan -> O7-O9 gate -> O10 keys -> O16 first-wins dedup -> O18 new papers
-> O4 raw bytes -> O5 insert; O17 answers every upload.

The bytes are read once, in the scan stage: one narrow job checks the magic
number, hashes them and writes them with their keys (``PaperStore.write_raw``).
Everything after reads the key columns of that table, so no exchange ever
carries bytes, whatever the size of the batch. As in a put-before-commit
service, raw objects are written before the rows that point to them; a replay
of the batch overwrites both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators import intake
from folio.schemas import MAX_UPLOAD_BYTES
from folio.sources.store import PaperStore

OUTCOME_REJECTED = "rejected"


def submit(
    store: PaperStore, uploads: DataFrame, batch: int, max_bytes: int = MAX_UPLOAD_BYTES, replies: bool = True
) -> DataFrame | None:
    """Register ``uploads`` (a binaryFile-shaped DataFrame) as batch ``batch``.

    Returns the replies (one per upload), written to the batch's work folder,
    or None with ``replies=False`` (a stream has no caller to answer).
    """
    keys = store.write_raw(intake.classify_raw(uploads, max_bytes), batch).drop("content")
    ok = keys.where(F.col("reject_reason").isNull())

    # Only this batch's hashes are looked up: the store is probed, not folded whole.
    before = store.scan_papers(exclude=batch, only=ok.select("content_hash"))
    new = intake.new_papers(intake.dedup_batch(ok), before)
    new = store.write_work(new, batch, "new")
    store.append_papers(intake.paper_rows(new), batch)
    if not replies:
        return None

    answers = intake.resolve_uploads(ok, before)
    rejected = keys.where(F.col("reject_reason").isNotNull()).select(
        "path",
        F.lit(None).cast("string").alias("id"),
        F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("string").alias("content_hash"),
        F.lit(None).cast("string").alias("result_key"),
        F.lit(OUTCOME_REJECTED).alias("outcome"),
        "reject_reason",
    )
    out = answers.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(rejected)
    return store.write_work(out, batch, "replies")
