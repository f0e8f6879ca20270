"""Sources, sinks and the two batch jobs on files in a fresh temporary folder."""

from __future__ import annotations

import hashlib
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from folio.operators import intake, lifecycle
from folio.plans.process import process
from folio.plans.submit import submit
from folio.sources import tei as tei_source
from folio.sources import uploads as upload_source
from folio.sources.store import PaperStore

CAP = 64


def _h(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


@pytest.fixture()
def files():
    d = tempfile.mkdtemp(prefix="folio-up-")
    items = {
        "a.pdf": b"%PDF-same bytes",
        "b.pdf": b"%PDF-same bytes",
        "c.pdf": b"%PDF-unique",
        "nope.pdf": b"nope",
        "short.pdf": b"%PD",
        "big.pdf": b"%PDF-" + b"x" * 200,
        "empty.pdf": b"",
    }
    for i, (name, body) in enumerate(items.items()):
        p = os.path.join(d, name)
        with open(p, "wb") as f:
            f.write(body)
        os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
    return d


def test_scan_pushes_size_filter(spark, files):
    df = upload_source.scan_uploads(spark, files, max_bytes=CAP)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(length), LessThanOrEqual(length,64)]" in plan
    names = sorted(os.path.basename(r.path) for r in df.collect())
    # Spark's file sources do not list zero-length files: the empty upload
    # (never a PDF) gets no row at all.
    assert names == ["a.pdf", "b.pdf", "c.pdf", "nope.pdf", "short.pdf"]
    classified = upload_source.scan_classified(spark, files, CAP)
    # the over-size branch never reads bytes: its scan does not select content
    scans = [ln for ln in classified._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in ln]
    assert any("GreaterThan(length,64)" in ln and "content" not in ln.split("ReadSchema")[1] for ln in scans)
    rej = {os.path.basename(r.path): r.reject_reason for r in classified.collect()}
    assert rej["big.pdf"] == intake.REJECT_TOO_LARGE
    assert rej["nope.pdf"] == rej["short.pdf"] == intake.REJECT_NOT_PDF
    assert "empty.pdf" not in rej
    assert rej["a.pdf"] is None and rej["c.pdf"] is None
    for name in ("no bytes.pdf", "50%+1.pdf"):
        open(os.path.join(files, name), "wb").close()
    every = {os.path.basename(r.path): r for r in upload_source.scan_classified(spark, files, CAP, with_empty=True).collect()}
    assert len(every) == len(rej) + 3
    for name in ("empty.pdf", "no bytes.pdf", "50%+1.pdf"):
        assert (every[name].length, every[name].reject_reason) == (0, intake.REJECT_NOT_PDF)


def test_submit_then_replay_is_idempotent(spark, files):
    store = PaperStore(spark, tempfile.mkdtemp(prefix="folio-store-"))
    up = upload_source.scan_classified(spark, files, CAP).drop("reject_reason")
    replies = {os.path.basename(r.path): r for r in submit(store, up, batch=1, max_bytes=CAP).collect()}
    assert replies["a.pdf"].outcome == intake.OUTCOME_ACCEPTED
    assert replies["b.pdf"].outcome == intake.OUTCOME_EXISTING
    assert replies["a.pdf"].id == replies["b.pdf"].id
    assert replies["nope.pdf"].outcome == "rejected" and replies["big.pdf"].reject_reason == intake.REJECT_TOO_LARGE
    papers = store.scan_papers().collect()
    assert sorted(p.content_hash for p in papers) == sorted([_h(b"%PDF-same bytes"), _h(b"%PDF-unique")])
    assert {p.source_ref for p in papers} == {"a.pdf", "c.pdf"}
    raw = store.raw_content(_h(b"%PDF-unique")).collect()
    assert bytes(raw[0].content) == b"%PDF-unique" and raw[0].raw_key == f"raw/{_h(b'%PDF-unique')}.pdf"

    # replaying batch 1 rewrites the same folders: same papers, no copies
    submit(store, up, batch=1, max_bytes=CAP)
    assert store.scan_papers().count() == 2
    assert sorted(r.content_hash for r in store.raw().collect()) == sorted([_h(b"%PDF-same bytes")] * 2 + [_h(b"%PDF-unique")])

    # a later batch with the same files: everything already known
    again = submit(store, up, batch=2, max_bytes=CAP).where(F.col("outcome") != "rejected").collect()
    assert {r.outcome for r in again} == {intake.OUTCOME_EXISTING}
    assert store.scan_papers().count() == 2


def test_process_done_failed_and_compaction(spark, files):
    store = PaperStore(spark, tempfile.mkdtemp(prefix="folio-store-"))
    up = upload_source.scan_uploads(spark, files, CAP)
    submit(store, up, batch=1, max_bytes=CAP)
    good = "<TEI><teiHeader><fileDesc><titleStmt><title> Same </title></titleStmt></fileDesc></teiHeader></TEI>"
    tei = spark.createDataFrame([(_h(b"%PDF-same bytes"), good)], "source_hash string, tei string")
    out = {r.paper_id: r for r in process(store, tei, batch=2).collect()}
    papers = {p.content_hash: p for p in store.scan_papers().collect()}
    same, uniq = papers[_h(b"%PDF-same bytes")], papers[_h(b"%PDF-unique")]
    assert same.status == "done" and same.schema_version == "1.0" and same.result_key == f"result/{same.id}.json"
    assert uniq.status == "queued" and uniq.error is None and uniq.result_key is None
    assert out[same.id].status == "done"
    docs = store.documents(2).collect()
    assert [d.metadata.title for d in docs] == ["Same"] and docs[0].result_key == same.result_key
    out_dir = tempfile.mkdtemp(prefix="folio-json-") + "/docs"
    store.export_json(2, out_dir)
    import json as _json

    lines = [ln for f in sorted(os.listdir(out_dir)) if f.startswith("part-") for ln in open(os.path.join(out_dir, f))]
    rec = _json.loads(lines[0])
    assert rec["result_key"] == same.result_key and rec["document"]["metadata"]["title"] == "Same"
    # nothing pending any more: a second run processes nothing
    assert process(store, tei, batch=3).count() == 0
    # compaction keeps the state
    assert store.compact() == 1
    after = {p.id: (p.status, p.result_key, p.error) for p in store.scan_papers().collect()}
    assert after == {p.id: (p.status, p.result_key, p.error) for p in papers.values()}


def test_compaction_with_two_numbering_ranges(spark, files):
    from folio.streaming.parse import PARSE_BATCH_OFFSET

    store = PaperStore(spark, tempfile.mkdtemp(prefix="folio-store-"))
    up = upload_source.scan_uploads(spark, files, CAP)
    submit(store, up.where(F.col("path").endswith("a.pdf")), batch=1, max_bytes=CAP)
    tei = spark.createDataFrame([(_h(b"%PDF-same bytes"), "<TEI/>")], "source_hash string, tei string")
    process(store, tei, batch=PARSE_BATCH_OFFSET + 1)
    assert store.compact() == 1
    # writers continue in both ranges after the compaction
    submit(store, up.where(F.col("path").endswith("c.pdf")), batch=2, max_bytes=CAP)
    process(store, tei, batch=PARSE_BATCH_OFFSET + 2)
    got = {p.source_ref: p.status for p in store.scan_papers().collect()}
    assert got == {"a.pdf": "done", "c.pdf": "queued"}
    assert store.compact() == 2
    assert {p.source_ref: p.status for p in store.scan_papers().collect()} == got
    # the new base holds every folder; nothing is read twice
    assert store.scan_papers().count() == 2


def test_tei_files_source(spark):
    d = tempfile.mkdtemp(prefix="folio-tei-")
    with open(os.path.join(d, "p1.xml"), "wb") as f:
        f.write(b"<TEI/>")
    with open(os.path.join(d, "p2.tei.xml"), "wb") as f:
        f.write(b"<TEI>\xff\xfe</TEI>")
    got = {r.paper_id: r.tei for r in tei_source.scan_tei_files(spark, d).collect()}
    assert got == {"p1": "<TEI/>", "p2": None}


def test_small_tei_files_are_written_by_many_tasks(spark):
    from folio.plans import queries
    from folio.session import checkpoint_root

    d = tempfile.mkdtemp(prefix="folio-docs-")
    spark.range(32 * 200).select(F.col("id").alias("doc_id")).write.parquet(f"{d}/documents.parquet")
    runs = f"{checkpoint_root(spark).removeprefix('file:')}/folio/tei_scan"
    before = set(os.listdir(runs)) if os.path.isdir(runs) else set()
    rows = queries.tei_scan(spark, d).where("kind = 'files'").collect()
    (run,) = set(os.listdir(runs)) - before
    tasks = [n[:10] for _, _, names in os.walk(f"{runs}/{run}/files") for n in names if n.startswith("part-")]
    assert len(tasks) == 200 and max(tasks.count(t) for t in set(tasks)) <= 128
    assert sorted(int(r.paper_id) for r in rows) == list(range(200)) and all(r.title == f"L{r.paper_id}" for r in rows)


def test_tei_table_source_string_and_bytes(spark):
    d = tempfile.mkdtemp(prefix="folio-teitab-")
    spark.createDataFrame([("p1", "h1", "<TEI/>")], "paper_id string, source_hash string, tei string").write.parquet(
        f"{d}/s"
    )
    spark.createDataFrame(
        [("p1", "h1", bytearray(b"<TEI/>")), ("p2", "h2", bytearray(b"<TEI>\xc3\x28</TEI>"))],
        "paper_id string, source_hash string, tei binary",
    ).write.parquet(f"{d}/b")
    assert [tuple(r) for r in tei_source.scan_tei(spark, f"{d}/s").collect()] == [("p1", "h1", "<TEI/>")]
    got = {r.paper_id: r.tei for r in tei_source.scan_tei(spark, f"{d}/b").collect()}
    assert got == {"p1": "<TEI/>", "p2": None}


def test_submit_never_reads_bytes_of_oversize_files(spark, files):
    listing = spark.read.format("binaryFile").load(files)
    keys = intake.classify_keys(listing, CAP)
    scans = [ln for ln in keys._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in ln]
    with_content = [ln for ln in scans if "content:binary" in ln]
    assert with_content and all("LessThanOrEqual(length,64)" in ln for ln in with_content)
    got = {os.path.basename(r.path): (r.reject_reason, r.content_hash is not None) for r in keys.collect()}
    assert got["big.pdf"] == (intake.REJECT_TOO_LARGE, False)
    assert got["a.pdf"] == (None, True) and got["nope.pdf"] == (intake.REJECT_NOT_PDF, False)


GOOD = "<TEI><teiHeader><fileDesc><titleStmt><title>T</title></titleStmt></fileDesc></teiHeader></TEI>"


def _status(store):
    return {p.source_ref: p.status for p in store.scan_papers().collect()}


def test_late_failed_and_doubled_tei(spark, files):
    store = PaperStore(spark, tempfile.mkdtemp(prefix="folio-store-"))
    submit(store, upload_source.scan_uploads(spark, files, CAP), batch=1, max_bytes=CAP)
    schema = "source_hash string, tei string"
    a, c = _h(b"%PDF-same bytes"), _h(b"%PDF-unique")
    process(store, spark.createDataFrame([(a, "<TEI>"), (None, GOOD), ("unknown", GOOD)], schema), batch=2)
    assert _status(store) == {"a.pdf": "failed", "c.pdf": "queued"}
    both = spark.createDataFrame([(a, GOOD), (c, GOOD), (c, GOOD), (c, None)], schema)
    process(store, both, batch=3)
    assert _status(store) == {"a.pdf": "failed", "c.pdf": "done"}
    process(store, both, batch=4, retry_failed=True, probe=True)
    assert _status(store) == {"a.pdf": "done", "c.pdf": "done"}
    assert store.documents().groupBy("paper_id").count().where("count > 1").count() == 0


def test_tei_files_are_joined_by_paper_id(spark, files):
    store = PaperStore(spark, tempfile.mkdtemp(prefix="folio-store-"))
    submit(store, upload_source.scan_uploads(spark, files, CAP), batch=1, max_bytes=CAP)
    pid = next(p.id for p in store.scan_papers().collect() if p.source_ref == "c.pdf")
    d = tempfile.mkdtemp(prefix="folio-tei-")
    with open(os.path.join(d, f"{pid}.xml"), "w") as f:
        f.write(GOOD)
    process(store, tei_source.scan_tei_files(spark, d), batch=2, tei_key="paper_id")
    assert _status(store) == {"a.pdf": "queued", "c.pdf": "done"}


def test_compaction_between_steps_and_during_an_insert(spark, files):
    store = PaperStore(spark, tempfile.mkdtemp(prefix="folio-store-"))
    up = upload_source.scan_uploads(spark, files, CAP)
    submit(store, up.where(F.col("path").endswith("a.pdf")), batch=1, max_bytes=CAP)
    ids = store.write_work(store.scan_papers().select(F.col("id").alias("paper_id")), 1, "ids")
    store.append_log(lifecycle.mark_running(ids), batch=2, step=0)
    os.makedirs(f"{store.root}/papers/batch=3/_temporary")  # an insert that has not committed
    store.compact()
    store.append_log(lifecycle.mark_done(ids), batch=2, step=1)
    assert _status(store) == {"a.pdf": "done"}
    submit(store, up.where(F.col("path").endswith("c.pdf")), batch=3, max_bytes=CAP)
    assert _status(store) == {"a.pdf": "done", "c.pdf": "queued"}
    store.compact()
    assert _status(store) == {"a.pdf": "done", "c.pdf": "queued"}
    assert store._base()[1][("papers", -1)] == [(1, 1), (3, 3)]


def test_lost_job_frees_its_papers_when_the_lease_ends(spark, files):
    store = PaperStore(spark, tempfile.mkdtemp(prefix="folio-store-"))
    submit(store, upload_source.scan_uploads(spark, files, CAP), batch=1, max_bytes=CAP)
    ids = store.write_work(store.scan_papers().select(F.col("id").alias("paper_id")), 1, "ids")
    now = F.current_timestamp()
    # a job that died after its running rows: one lease is over, the other is not
    over = F.when(F.col("paper_id") == ids.orderBy("paper_id").first()[0], F.lit(-60)).otherwise(F.lit(3600))
    store.append_log(lifecycle.mark_running(ids, until=lifecycle.later(now, over)), batch=2, step=0)
    lost = [r.id for r in lifecycle.stuck(store.scan_papers(with_attempts=True)).collect()]
    assert lost == [ids.orderBy("paper_id").first()[0]]
    both = spark.createDataFrame([(_h(b"%PDF-same bytes"), GOOD), (_h(b"%PDF-unique"), GOOD)], "source_hash string, tei string")
    assert [r.paper_id for r in process(store, both, batch=3).collect()] == lost
    after = {p.id: (p.status, p.attempts) for p in store.scan_papers(with_attempts=True).collect()}
    assert sorted(after.values()) == [("done", 2), ("running", 1)]


def test_failed_papers_wait_longer_each_time(spark, files):
    store = PaperStore(spark, tempfile.mkdtemp(prefix="folio-store-"))
    submit(store, upload_source.scan_uploads(spark, files, CAP), batch=1, max_bytes=CAP)
    bad = spark.createDataFrame([(_h(b"%PDF-unique"), "<TEI>")], "source_hash string, tei string")
    retry = lifecycle.Retry(backoff=1000, attempts=3)
    assert process(store, bad, batch=2, retry=retry).count() == 1
    f = store.scan_papers(with_attempts=True).where("status = 'failed'")
    assert f.select(((F.unix_micros("until") - F.unix_micros("updated_at")) / 1_000_000).cast("int")).first()[0] == 1000
    assert process(store, bad, batch=3, retry_failed=True, retry=retry).count() == 0
    for tries, seconds in ((1, 1000), (2, 2000), (5, 16_000), (60, 86_400)):
        assert spark.range(1).select(lifecycle.wait(F.lit(tries), retry)).first()[0] == seconds
    in_time = lifecycle.pending(f, retry_failed=True, at=lifecycle.later(F.current_timestamp(), F.lit(1100)), retry=retry)
    assert in_time.count() == 1
    assert lifecycle.pending(f.withColumn("attempts", F.lit(3).cast("long")).withColumn("until", F.lit(None).cast("timestamp")), True, retry=retry).count() == 0


def test_no_exchange_carries_bytes(spark, files):
    """The one job that reads bytes has no exchange; what follows reads keys only, broadcast joins or not."""
    store = PaperStore(spark, tempfile.mkdtemp(prefix="folio-store-"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        up = upload_source.list_uploads(spark, files)
        raw = intake.classify_raw(up, CAP)
        plan = raw._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "content:binary" in plan
        submit(store, up, batch=1, max_bytes=CAP)
        known = store.scan_papers(only=store.uploads(1).select("content_hash"))
        new = intake.new_papers(intake.dedup_batch(store.uploads(1).where("content_hash is not null")), known)
        plan = new._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in plan and "content:binary" not in plan and "content#" not in plan.replace("content_hash#", "")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert store.scan_papers().count() == 2


def _scans(df):
    """(files read, rows read) of the file scans of an executed plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.executedPlan().collectLeaves() if "Adaptive" in plan.getClass().getName() else plan.collectLeaves()
    out = []
    for i in range(leaves.size()):
        m = leaves.apply(i).metrics()
        if m.contains("numFiles"):
            out.append((m.apply("numFiles").value(), m.apply("numOutputRows").value()))
    return out


def test_lookups_skip_the_files_of_other_buckets(spark):
    store = PaperStore(spark, tempfile.mkdtemp(prefix="folio-store-"))
    firsts = spark.range(400).select(F.sha2(F.col("id").cast("string"), 256).alias("content_hash"), F.lit("x.pdf").alias("path"))
    store.append_papers(intake.paper_rows(firsts), batch=1)
    ids = store.scan_papers().select(F.col("id").alias("paper_id"))
    store.append_log(lifecycle.mark_done(ids), batch=2, step=1)
    version = store.compact(rows_per_bucket=2)
    some = store.scan_papers().orderBy("id").limit(3).collect()
    assert len(store._children("base", "v")) == 1 and store._digits(version) == 2
    all_files = _scans(store.base_table(version, "papers"))[0][0]
    for key in ("id", "content_hash"):
        keys = spark.createDataFrame([(r[key],) for r in some], f"{key} string")
        found = store.scan_papers(only=keys, key=key)
        assert sorted(r.id for r in found.collect()) == sorted(r.id for r in some)
        own = keys.select((intake.paper_id(F.col(key)) if key == "content_hash" else F.col(key)).alias("paper_id"))
        files, rows = _scans(store.base_table(version, "papers", store._buckets(version, own)))[0]
        assert files <= 3 < all_files and rows < 40
    one = store.paper(content_hash=some[0].content_hash).collect()
    assert [(r.id, r.status) for r in one] == [(some[0].id, "done")] == [(r.id, r.status) for r in store.paper(paper_id=some[0].id).collect()]
    assert store.paper(paper_id="nope").count() == 0


def test_small_buckets_do_not_make_a_folder_for_each_few_papers(spark):
    store = PaperStore(spark, tempfile.mkdtemp(prefix="folio-store-"))
    firsts = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("content_hash"), F.lit("x.pdf").alias("path"))
    store.append_papers(intake.paper_rows(firsts), batch=1)
    version = store.compact(rows_per_bucket=8)
    assert len(os.listdir(f"{store.root}/base/v={version}/papers")) <= 256 + 2  # _SUCCESS and its checksum
    some = store.scan_papers().orderBy("id").limit(3).collect()
    assert len(some) == 3 == store.scan_papers(only=spark.createDataFrame([(r.id,) for r in some], "id string"), key="id").count()
    assert store.paper(paper_id=some[1].id).first().content_hash == some[1].content_hash and store.scan_papers().count() == 3000


def test_buckets_grow_with_the_papers():
    from folio.sources.store import digits_for

    for rows, per in ((0, 8), (400, 2), (90_000, 8), (90_000, 1 << 20), (1 << 28, 1 << 20), (1 << 36, 1 << 20)):
        folders = 16 ** digits_for(rows, per)
        assert folders <= max(256, rows / 4096)
        assert per < 1 << 20 or rows / folders <= 1 << 20


def test_unreachable_store_is_an_error(spark):
    with pytest.raises(Exception, match="(?i)nosuchscheme"):
        PaperStore(spark, "nosuchscheme://x/y").scan_papers()
