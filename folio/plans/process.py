"""Entry point B as a batch job: parse the pending papers.

O22 pending -> O19a running -> O23-O32 TEI to Document -> O6 documents ->
O19b done / O19c failed. The step the reference leaves as a TODO (fetch,
parse, store the result) is the parse of the TEI the parse service
produced for each paper, looked up by content hash or paper id.

The parse runs once: its output (Documents and errors) is written to the
batch's work folder, and both the document sink and the done/failed log
rows are read from there. Log rows of one batch are ordered by ``step``
(running before done/failed) and ``seq``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.operators import engines, intake, lifecycle, tei
from folio.sources.store import PaperStore

KEYS = {"source_hash": "content_hash", "paper_id": "id"}


def winners(tei_side: DataFrame, todo: DataFrame, key: str) -> DataFrame:
    """``(paper_id, _key, _hash, _d, _n)``: the digest of the TEI that each paper to parse
    gets, and how many rows have it. Texts are hashed where they are read; only digests move."""
    found = tei_side.select(F.col(key).alias("_key"), F.sha2("tei", 256).alias("_d")).join(todo, F.col("_key") == todo[key])
    same = found.groupBy("id", "content_hash", "_d").agg(F.count(F.lit(1)).alias("_n"))
    best = same.groupBy("id", "content_hash").agg(F.min(F.struct(F.col("_d").isNull().alias("none"), "_d", "_n")).alias("w"))
    return best.select(F.col("id").alias("paper_id"), F.col(key).alias("_key"), F.col("content_hash").alias("_hash"), "w._d", "w._n")


def jobs_of(tei_side: DataFrame, won: DataFrame, key: str) -> DataFrame:
    """``(paper_id, content_hash, tei)``, one row per paper.

    The inner join lets AQE build either side, so the (usually larger) TEI side
    is streamed and the parse keeps its parallelism. Only papers whose TEI
    is there several times over have texts grouped.
    """
    rows = tei_side.withColumn("_own", F.sha2("tei", 256))
    joined = rows.join(won, (F.col(key) == F.col("_key")) & F.col("_own").eqNullSafe(F.col("_d")))
    joined = joined.select("paper_id", F.col("_hash").alias("content_hash"), "tei", "_n")
    single = joined.where("_n = 1").drop("_n")
    if won.where("_n > 1").isEmpty():
        return single
    return single.unionByName(joined.where("_n > 1").drop("_n").dropDuplicates(["paper_id"]))


def process(
    store: PaperStore,
    tei_input: DataFrame,
    batch: int,
    engine: engines.Engine = engines.TEI_ENGINE,
    tei_key: str = "source_hash",
    probe: bool = False,
    retry_failed: bool = False,
    retry: lifecycle.Retry = lifecycle.RETRY,
) -> DataFrame:
    """Parse the pending papers that have TEI; those without stay ``queued``.

    The papers are held by a lease (``retry.lease`` seconds): if this job is
    lost, a later batch takes them up again once it has run out, and a failed
    paper is left alone for the wait that its attempts so far give.

    ``tei_input`` has ``tei`` and ``tei_key`` (``source_hash`` or
    ``paper_id``). Several rows for one paper give one Document, from the
    text with the smallest digest (a NULL text only if there is no other). ``probe`` folds only the papers named by
    the TEI (a small batch against a large store); ``retry_failed`` takes up
    failed papers again. Returns ``(paper_id, status, result_key, error)`` per
    processed paper.
    """
    key = KEYS[tei_key]
    tei_side = tei_input.select(F.col(tei_key).alias(key), "tei").where(F.col(key).isNotNull())
    keys = tei_side.select(key)
    if probe:
        keys = store.write_work(keys.distinct(), batch, "tei_keys")
    current = store.scan_papers(exclude=batch, only=keys if probe else None, key=key, with_attempts=True)
    # Only keys are matched first: no text crosses a shuffle for a paper that is not parsed now.
    todo = lifecycle.pending(current, retry_failed, retry=retry).join(keys, key, "left_semi")
    todo = store.write_work(todo.select("id", "content_hash", "attempts"), batch, "pending")

    now = F.current_timestamp()
    running = todo.select(F.col("id").alias("paper_id"))
    store.append_log(lifecycle.mark_running(running, seq=0, until=lifecycle.later(now, F.lit(retry.lease))), batch, step=0)

    won = store.write_work(winners(tei_side, todo, key), batch, "tei")
    jobs = jobs_of(tei_side, won, key)
    docs = engine.apply(jobs, tei_col="tei", source_hash="content_hash", keep=["paper_id", "content_hash"])
    parsed = store.write_work(docs, batch, "parsed")

    # The JSON text says a Document over again, so it is made on the way to the sink and not stored before.
    good = tei.document_json(parsed.where(F.col("parse_error").isNull()))
    store.write_documents(good.drop("parse_error").withColumn("result_key", intake.result_key(F.col("paper_id"))), batch)
    written = store.documents(batch).select("paper_id", "result_key")
    bad = parsed.where(F.col("parse_error").isNotNull()).select("paper_id", F.col("parse_error").alias("error"))
    tried = todo.select(F.col("id").alias("paper_id"), (F.col("attempts") + 1).alias("attempts"))
    again = lifecycle.later(now, lifecycle.wait(F.col("attempts"), retry))
    failed = lifecycle.mark_failed(bad.join(tried, "paper_id"), seq=1, until=again)
    final = lifecycle.mark_done(written, seq=1).unionByName(failed)
    store.append_log(final, batch, step=1)
    return store.log(after=batch - 1, before=batch + 1).where(F.col("step") == 1).select(
        "paper_id", F.col("to_status").alias("status"), "result_key", "error"
    )
