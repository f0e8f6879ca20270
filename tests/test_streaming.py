"""Streams: intake over files with availableNow, replay of a micro-batch, live status."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from folio.operators import intake, lifecycle
from folio.schemas import PAPERS, STATUS_LOG
from folio.sources.store import PaperStore
from folio.streaming import intake as intake_stream
from folio.streaming import parse as parse_stream
from folio.streaming import status as status_stream

T0 = dt.datetime(2024, 1, 1)


def _write(d, name, body, t):
    p = os.path.join(d, name)
    with open(p, "wb") as f:
        f.write(body)
    os.utime(p, (t, t))


def test_intake_stream_and_replay(spark):
    src = tempfile.mkdtemp(prefix="folio-src-")
    root = tempfile.mkdtemp(prefix="folio-st-")
    _write(src, "a.pdf", b"%PDF-one", 1_700_000_000)
    _write(src, "b.pdf", b"%PDF-one", 1_700_000_001)
    _write(src, "c.pdf", b"not a pdf", 1_700_000_002)
    store = PaperStore(spark, f"{root}/store")
    stream = intake_stream.stream_uploads(spark, src, max_files_per_trigger=1)
    intake_stream.start_intake(stream, store, f"{root}/ckpt", max_bytes=1024, available_now=True).awaitTermination()
    papers = store.scan_papers().collect()
    assert [p.source_ref for p in papers] == ["a.pdf"]

    # new files later: only they are read
    _write(src, "d.pdf", b"%PDF-two", 1_700_000_003)
    stream = intake_stream.stream_uploads(spark, src, max_files_per_trigger=1)
    intake_stream.start_intake(stream, store, f"{root}/ckpt", max_bytes=1024, available_now=True).awaitTermination()
    assert sorted(p.source_ref for p in store.scan_papers().collect()) == ["a.pdf", "d.pdf"]

    # a re-run of an already-committed micro-batch (as after a crash) changes nothing
    batch_df = spark.read.format("binaryFile").load(os.path.join(src, "d.pdf"))
    last = max(store._children("papers", "batch"))
    intake_stream.register_batch(store, 1024)(batch_df, last)
    assert store.scan_papers().count() == 2 and store.raw().select("content_hash").distinct().count() == 2


def test_intake_stream_compacts_periodically(spark):
    src = tempfile.mkdtemp(prefix="folio-src-")
    root = tempfile.mkdtemp(prefix="folio-cmp-")
    for i in range(4):
        _write(src, f"p{i}.pdf", f"%PDF-{i}".encode(), 1_700_000_000 + i)
    store = PaperStore(spark, f"{root}/store")
    stream = intake_stream.stream_uploads(spark, src, max_files_per_trigger=1)
    intake_stream.start_intake(
        stream, store, f"{root}/ckpt", max_bytes=1024, available_now=True, compact_every=2
    ).awaitTermination()
    assert store._children("base", "v") == [1, 2]
    assert store._base()[1] == {("papers", -1): [(0, 3)]}
    assert sorted(p.source_ref for p in store.scan_papers().collect()) == ["p0.pdf", "p1.pdf", "p2.pdf", "p3.pdf"]


def _register(spark, store, hashes):
    rows = [(h, f"{h}.pdf") for h in hashes]
    firsts = spark.createDataFrame(rows, "content_hash string, path string")
    store.append_papers(intake.paper_rows(firsts), batch=1)


def test_parse_stream_takes_late_tei(spark):
    root = tempfile.mkdtemp(prefix="folio-ps-")
    store = PaperStore(spark, f"{root}/store")
    _register(spark, store, ["h1", "h2"])

    def arrive(rows):
        spark.createDataFrame(rows, parse_stream.TEI_TABLE).write.mode("append").parquet(f"{root}/tei")
        stream = parse_stream.stream_tei(spark, f"{root}/tei")
        parse_stream.start_parse(stream, store, f"{root}/ckpt", available_now=True).awaitTermination()
        return {p.content_hash: p.status for p in store.scan_papers().collect()}

    assert arrive([(None, "h1", "<TEI>")]) == {"h1": "failed", "h2": "queued"}
    assert arrive([(None, "h2", "<TEI/>"), (None, "h2", "<TEI/>")]) == {"h1": "failed", "h2": "done"}
    assert arrive([(None, "h1", "<TEI/>")]) == {"h1": "done", "h2": "done"}
    assert store.documents().count() == 2


def test_parse_stream_keeps_early_tei_until_the_registration(spark):
    root = tempfile.mkdtemp(prefix="folio-early-")
    store = PaperStore(spark, f"{root}/store")
    rows = [(None, "h1", "<TEI/>"), (None, "h1", "<TEI/>"), (None, "h2", "<TEI>"), (None, "h3", "<TEI/>"), (None, None, "<TEI/>")]
    spark.createDataFrame(rows, parse_stream.TEI_TABLE).write.parquet(f"{root}/tei")

    def run():
        stream = parse_stream.stream_tei(spark, f"{root}/tei")
        parse_stream.start_parse(stream, store, f"{root}/ckpt", available_now=True).awaitTermination()
        return {p.content_hash: (p.status, p.attempts) for p in store.scan_papers(with_attempts=True).collect()}

    assert run() == {}
    _register(spark, store, ["h1", "h2"])  # no new TEI: the registration alone starts the parse
    assert run() == {"h1": ("done", 1), "h2": ("failed", 1)}
    assert store.documents().count() == 1 and run() == {"h1": ("done", 1), "h2": ("failed", 1)}


def test_status_snapshots_compact(spark):
    root = tempfile.mkdtemp(prefix="folio-cs-")
    store = PaperStore(spark, f"{root}/store")
    _register(spark, store, ["h1", "h2"])
    ids = store.scan_papers().select(F.col("id").alias("paper_id"))
    for n, rows in enumerate((lifecycle.mark_running(ids), lifecycle.mark_done(ids.limit(1)), lifecycle.mark_running(ids.limit(1)))):
        store.append_log(rows.withColumn("at", F.lit(T0 + dt.timedelta(minutes=n)).cast("timestamp")), batch=n, step=0)
        log = status_stream.stream_store_log(spark, store)
        status_stream.start_status(log, f"{root}/status", f"{root}/ckpt", available_now=True).awaitTermination()
        if n == 1:
            before = {r.paper_id: r.asDict(True) for r in status_stream.latest_summaries(spark, f"{root}/status").collect()}
            status_stream.compact_summaries(spark, f"{root}/status")
            assert {r.paper_id: r.asDict(True) for r in status_stream.latest_summaries(spark, f"{root}/status").collect()} == before
    live = status_stream.latest_summaries(spark, f"{root}/status").collect()
    assert sorted((r._status, r._attempts) for r in live) == [("running", 1), ("running", 2)]


def test_live_status_counts_a_replayed_batch_once(spark):
    root = tempfile.mkdtemp(prefix="folio-rp-")
    store = PaperStore(spark, f"{root}/store")
    _register(spark, store, ["h1"])
    ids = store.scan_papers().select(F.col("id").alias("paper_id"))
    for _ in range(2):  # the second write is the replay: same folder, other file names
        store.append_log(lifecycle.mark_running(ids), batch=2, step=0)
        log = status_stream.stream_store_log(spark, store)
        status_stream.start_status(log, f"{root}/status", f"{root}/ckpt", available_now=True).awaitTermination()
    live = status_stream.latest_summaries(spark, f"{root}/status").collect()
    assert [r._attempts for r in live] == [1] == [r.attempts for r in lifecycle.attempts(store.log()).collect()]


def test_status_stream_matches_batch_fold(spark):
    root = tempfile.mkdtemp(prefix="folio-ss-")
    rows = []
    seqs = {"a": ["running", "failed", "running"], "b": ["running", "done"], "c": []}
    n = 0
    for pid, steps in seqs.items():
        for st in steps:
            n += 1
            rows.append((pid, T0 + dt.timedelta(minutes=n), n, st, "1.0" if st == "done" else None,
                         f"result/{pid}.json" if st == "done" else None, "e" if st == "failed" else None))
    log = spark.createDataFrame(rows, STATUS_LOG)
    log.repartition(3).write.parquet(f"{root}/log")
    stream = spark.readStream.schema(STATUS_LOG).option("maxFilesPerTrigger", 1).parquet(f"{root}/log")
    status_stream.start_status(stream, f"{root}/status", f"{root}/ckpt", available_now=True).awaitTermination()
    papers = spark.createDataFrame(
        [(p, f"h{p}", "upload", None, "queued", "raw", None, None, None, T0, T0) for p in seqs], PAPERS
    )
    live = lifecycle.apply_summary(papers, status_stream.latest_summaries(spark, f"{root}/status"), with_attempts=True)
    batch = lifecycle.fold_status(papers, log, with_attempts=True)
    key = F.col("id")
    assert sorted(map(tuple, live.orderBy(key).collect())) == sorted(map(tuple, batch.orderBy(key).collect()))


def test_intake_parse_and_live_status_chain(spark):
    src = tempfile.mkdtemp(prefix="folio-chain-src-")
    root = tempfile.mkdtemp(prefix="folio-chain-")
    _write(src, "x.pdf", b"%PDF-x", 1_700_000_000)
    _write(src, "y.pdf", b"%PDF-y", 1_700_000_001)
    store = PaperStore(spark, f"{root}/store")
    up = intake_stream.stream_uploads(spark, src, max_files_per_trigger=1)
    intake_stream.start_intake(up, store, f"{root}/ck1", max_bytes=1024, available_now=True).awaitTermination()

    import hashlib

    hx = hashlib.sha256(b"%PDF-x").hexdigest()
    spark.createDataFrame([(None, hx, "<TEI/>")], parse_stream.TEI_TABLE).write.parquet(f"{root}/tei")
    parse_stream.start_parse(
        parse_stream.stream_tei(spark, f"{root}/tei"), store, f"{root}/ck2", available_now=True
    ).awaitTermination()

    log = status_stream.stream_store_log(spark, store)
    status_stream.start_status(log, f"{root}/status", f"{root}/ck3", available_now=True).awaitTermination()
    live = lifecycle.apply_summary(store.inserts().drop("batch"), status_stream.latest_summaries(spark, f"{root}/status"))
    got = {r.source_ref: (r.status, r.error) for r in live.collect()}
    assert got["x.pdf"][0] == "done"
    assert got["y.pdf"] == ("queued", None)
    folded = {r.source_ref: (r.status, r.error) for r in store.scan_papers().collect()}
    assert folded == got


def test_status_stream_compacts_when_the_base_is_outgrown(spark):
    root = tempfile.mkdtemp(prefix="folio-og-")
    rows = [(f"p{n}", T0, n, "running", None, None, None) for n in range(2000)]
    spark.createDataFrame(rows, STATUS_LOG).coalesce(1).write.parquet(f"{root}/log")
    for n in range(5):  # a few papers of many change
        late = [(f"p{n}", T0 + dt.timedelta(minutes=n + 1), n, "failed", None, None, f"e{n}")]
        spark.createDataFrame(late, STATUS_LOG).coalesce(1).write.mode("append").parquet(f"{root}/log")
    own = status_stream.status_session(spark)
    own.conf.set("spark.sql.shuffle.partitions", "1")
    stream = own.readStream.schema(STATUS_LOG).option("maxFilesPerTrigger", 1).parquet(f"{root}/log")
    status_stream.start_status(stream, f"{root}/status", f"{root}/ckpt", available_now=True, compact_every=1).awaitTermination()
    # six batches; the base of the first is not written again for each of the others
    assert PaperStore(spark, f"{root}/status")._children("base", "upto") == [0]
    live = {r.paper_id: (r._status, r._attempts) for r in status_stream.latest_summaries(spark, f"{root}/status").collect()}
    assert len(live) == 2000 and live["p7"] == ("running", 1) and [live[f"p{n}"] for n in range(5)] == [("failed", 1)] * 5


def test_fold_of_a_longer_log_takes_no_more_micro_batches(spark, monkeypatch):
    from folio.plans import queries
    from folio.session import checkpoint_root

    d, n = tempfile.mkdtemp(prefix="folio-ev-"), F.col("id")
    kinds = F.array(*[F.lit(k) for k in ("signup", "click", "error", "view", "purchase")])
    events = spark.range(400).select(
        n.alias("event_id"),
        (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(secs=n)).alias("ts"),
        (n % 7).alias("user_id"),
        F.get(kinds, (n % 5).cast("int")).alias("event_type"),
        F.concat(F.lit("e"), n.cast("string")).alias("props"),
    )
    events.write.parquet(f"{d}/events.parquet")
    monkeypatch.setattr(queries, "ROWS_PER_FILE", 10)
    monkeypatch.setattr(queries, "MICRO_BATCHES", 3, raising=False)
    runs = f"{checkpoint_root(spark).removeprefix('file:')}/folio/stream_fold"
    before = set(os.listdir(runs)) if os.path.isdir(runs) else set()
    live = queries.stream_fold(spark, d).collect()
    (run,) = set(os.listdir(runs)) - before
    assert 1 < len(PaperStore(spark, f"{runs}/{run}/status")._children("", "batch")) <= 3
    assert sorted(map(str, live)) == sorted(map(str, queries.status_fold(spark, d).collect())) and len(live) == 7
