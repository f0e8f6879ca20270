"""The driver query set: one DataFrame per operator group, over whole tables.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame whose columns
are scalars (arrays are joined with ``|``), so the DuckDB oracle in
``folio.plans.oracles`` can compute the same rows from the same tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import engines, intake, lifecycle, tei
from folio.plans import inputs
from folio.plans.parallel import spread
from folio.plans.process import process
from folio.plans.submit import submit
from folio.schemas import TEI_PARTS, UPLOAD
from folio.session import checkpoint_root, ship_package
from folio.sources import tei as tei_source
from folio.sources import uploads as uploads_source
from folio.sources.store import PaperStore
from folio.streaming import intake as intake_stream
from folio.streaming import parse as parse_stream
from folio.streaming import status as status_stream

Query = Callable[[SparkSession, str], DataFrame]


def _docs(spark: SparkSession, sf_dir: str, parts=TEI_PARTS) -> DataFrame:
    """T parsed into Documents, keyed by ``doc_id`` (only the TEI ``parts`` a query reads)."""
    t = inputs.tei_inputs(spread(inputs.table(spark, sf_dir, "documents")))
    return tei.to_document(t, keep=["doc_id"], parts=parts)


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.uploads(inputs.table(spark, sf_dir, "documents"))


def _keyed_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.with_keys(intake.accepted(_uploads(spark, sf_dir)))


def _batch_and_earlier(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The keys of the accepted uploads, and the papers of an earlier batch: its French ones.

    As in ``submit``, the bytes are read and hashed in one narrow pass whose keys are written; every
    join reads those.
    """
    path = f"{_scratch(spark, 'keys')}/keys"
    _keyed_accepted(spark, sf_dir).select("path", "modificationTime", "length", "content_hash", "lang").write.parquet(path)
    keys = spark.read.parquet(path)
    return keys, inputs.registered(keys.where(F.col("lang") == F.lit("fr")))


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L as current papers: the calls are reduced to a summary per paper, in which those from before it show."""
    events = inputs.table(spark, sf_dir, "events")
    return lifecycle.fold_status(inputs.event_papers(events), inputs.event_updates(events), since_created=True)


# ------------------------------------------------------------ TEI (O23+) --


def doc_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, ("title",)).select("doc_id", F.col("metadata.title").alias("title"))


def doc_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("metadata.authors")
    return _docs(spark, sf_dir, ("paper",)).select(
        "doc_id", F.array_join(a, "|").alias("authors"), F.size(a).cast("long").alias("n_authors")
    )


def doc_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, ("paper",)).select("doc_id", F.col("metadata.doi").alias("doi"))


def doc_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, ("abstract",)).select("doc_id", F.col("metadata.abstract").alias("abstract"))


def doc_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tei.explode_sections(_docs(spark, sf_dir, ("body",)), ["doc_id"])
    return s.select("doc_id", F.col("pos").cast("long").alias("pos"), "level", "heading", "markdown")


def doc_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tei.explode_references(_docs(spark, sf_dir, ("back",)), ["doc_id"])
    return r.select(
        "doc_id",
        F.col("pos").cast("long").alias("pos"),
        "raw",
        "title",
        F.array_join("authors", "|").alias("authors"),
        "doi",
    )


def doc_author_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = tei.explode_authors(_docs(spark, sf_dir, ("paper",)), ["doc_id"])
    return a.select("doc_id", F.col("pos").cast("long").alias("pos"), "author")


def doc_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, ("body",)).select("doc_id", "markdown")


def doc_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    return d.select(
        "doc_id",
        "schema",
        "engine",
        "source_hash",
        F.col("metadata.title").alias("title"),
        F.col("metadata.doi").alias("doi"),
        F.size("metadata.authors").cast("long").alias("n_authors"),
        F.size("sections").cast("long").alias("n_sections"),
        F.size("references").cast("long").alias("n_references"),
        F.length("markdown").cast("long").alias("markdown_chars"),
        "parse_error",
    )


def doc_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = inputs.tei_inputs(spread(inputs.table(spark, sf_dir, "documents")))
    at = F.timestamp_micros(F.lit(1_774_747_800_000_000) + F.col("doc_id") * F.lit(7_250_100))
    return tei.document_json(tei.to_document(t, keep=["doc_id"], parsed_at=at)).select("doc_id", "json")


def doc_json_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O33 without the parse time: equal JSON for equal content (change detection)."""
    return tei.document_json(_docs(spark, sf_dir), with_parsed_at=False).select("doc_id", "json")


def tei_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O23 gate over T (all good), T with one fault each, and H (web pages, none rooted at TEI)."""
    docs = inputs.tei_inputs(spread(inputs.table(spark, sf_dir, "documents")))
    t = docs.select(F.lit("tei").alias("kind"), F.col("doc_id").alias("row_id"), "tei")
    broken = docs.select(
        F.lit("broken").alias("kind"), F.col("doc_id").alias("row_id"), inputs.broken(F.col("doc_id"), F.col("tei")).alias("tei")
    )
    h = spread(inputs.table(spark, sf_dir, "pages")).select(
        F.lit("page").alias("kind"), F.col("page_id").alias("row_id"), F.col("html").alias("tei")
    )
    parsed = tei.parse_tei(t.unionByName(broken).unionByName(h), out="d", parts=())
    return parsed.select("kind", "row_id", F.col("parse_error").isNull().alias("ok"), "parse_error")


# ---------------------------------------------------------- intake (O7+) --


def upload_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = intake.classify_uploads(_uploads(spark, sf_dir), inputs.GATE_MAX_BYTES)
    return u.select("path", "length", "reject_reason")


def upload_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _keyed_accepted(spark, sf_dir)
    return k.select("path", "content_hash", "raw_key", "id", intake.result_key(F.col("id")).alias("result_key"))


def batch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = intake.dedup_batch(_keyed_accepted(spark, sf_dir))
    return d.select("content_hash", "path", F.col("n_uploads").cast("long").alias("n_uploads"))


def insert_or_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.resolve_uploads(*_batch_and_earlier(spark, sf_dir))


def new_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, earlier = _batch_and_earlier(spark, sf_dir)
    rows = intake.paper_rows(intake.new_papers(intake.dedup_batch(keys), earlier))
    return rows.select("id", "content_hash", "source_type", "source_ref", "status", "raw_key")


def _all_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.registered(_keyed_accepted(spark, sf_dir))


def _lookup_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of every upload, accepted or not: lookups that hit and miss."""
    u = _uploads(spark, sf_dir)
    return u.select(intake.content_hash(F.col("content")).alias("content_hash"))


def paper_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _lookup_hashes(spark, sf_dir).select(intake.paper_id(F.col("content_hash")).alias("id"))
    found = lifecycle.get_papers(_all_papers(spark, sf_dir), ids)
    return found.select("id", "status", "content_hash", "source_ref")


def paper_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lifecycle.get_papers_by_hash(_all_papers(spark, sf_dir), _lookup_hashes(spark, sf_dir))
    return found.select("id", "status", "content_hash", "raw_key")


def paper_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.paper_view(_folded(spark, sf_dir))


def papers_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O14 over a naive registration: every accepted upload inserted, no dedup, and every rule broken by some rows."""
    k = _keyed_accepted(spark, sf_dir).select("doc_id", "path", "content_hash")
    fault = F.col("doc_id") % 17
    rows = k.select("doc_id", intake.paper_id(F.col("content_hash")).alias("id"), "content_hash", intake.raw_key(F.col("content_hash")).alias("raw_key"))
    at = F.timestamp_seconds(F.lit(1_704_067_200))
    planted = rows.select(
        F.when(fault != 1, F.col("id")).alias("id"),
        F.when(fault != 2, F.col("content_hash")).alias("content_hash"),
        F.when(fault == 3, F.lit("email")).when(fault != 5, F.lit("upload")).alias("source_type"),
        F.when(fault == 4, F.lit("parsing")).when(fault != 6, F.lit("queued")).alias("status"),
        F.when(fault != 7, F.col("raw_key")).alias("raw_key"),
        F.when(fault != 8, at).alias("created_at"),
        F.when(fault != 9, at).alias("updated_at"),
    )
    return lifecycle.audit_papers(planted).select("rule", F.col("violations").cast("long").alias("violations"))


def engine_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route each document's requested feature set to capable engines."""
    want = (F.col("n_chars") % 64).cast("int")
    d = inputs.table(spark, sf_dir, "documents").select("doc_id", want.alias("want"))
    return d.select("doc_id", "want", F.explode(engines.engines_for(F.col("want"))).alias("engine"))


# -------------------------------------------------------- lifecycle (O19+) --


def status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _folded(spark, sf_dir)
    return f.select(
        "id",
        "status",
        "schema_version",
        "result_key",
        "error",
        F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("updated_at"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Few rows a salt, so the given tables reach the salted join.
    papers, log = inputs.status_log(inputs.table(spark, sf_dir, "events"), rows_per_salt=8)
    f = lifecycle.fold_status(papers, log, with_attempts=True)
    return f.select("id", F.col("attempts").cast("long").alias("attempts"))


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O22 over a papers table holding both the U registrations (no log rows
    yet) and the L papers (mostly processed)."""
    events = inputs.table(spark, sf_dir, "events")
    everything = inputs.event_papers(events).unionByName(_all_papers(spark, sf_dir))
    folded = lifecycle.fold_status(everything, inputs.event_updates(events), since_created=True)
    return lifecycle.pending(folded).select("id", "content_hash")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, title, n_sections, markdown)`` for every document."""
    d = _docs(spark, sf_dir, ("title", "body"))
    return d.select(
        "doc_id",
        F.col("metadata.title").alias("title"),
        F.size("sections").cast("long").alias("n_sections"),
        "markdown",
    )


# ------------------------------------------------------ streams and jobs --


def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint root for this run."""
    return f"{checkpoint_root(spark)}/folio/{name}/{uuid.uuid4().hex}"


#: At least so many rows a file of the status log, and so many files a micro-batch. A larger log has larger
#: files (up to MOST_ROWS_PER_FILE, then more of them) and larger micro-batches, MICRO_BATCHES of them at most: each has a cost of its own.
ROWS_PER_FILE, MOST_ROWS_PER_FILE, FILES_PER_BATCH, MICRO_BATCHES = 2_000, 100_000, 2, 24
#: Uploads arrive in so many waves of upload time, each as many files as its scan has tasks and one micro-batch.
WAVES = 4


def stream_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U arrives in waves of upload time; the stream runs on after each.

    A wave is a range of ids (and so of upload times) between the table's smallest and
    largest; it is written by a parallel job and registered in one micro-batch, in which the
    earliest upload names a paper.
    """
    root = _scratch(spark, "stream_intake")
    docs = inputs.table(spark, sf_dir, "documents")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    store = PaperStore(spark, f"{root}/store")
    edges = [low + (high - low + 1) * k // WAVES for k in range(WAVES + 1)] if low is not None else []
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        wave = inputs.uploads(docs.where((F.col("doc_id") >= a) & (F.col("doc_id") < b))).select(*UPLOAD.fieldNames())
        wave.write.parquet(f"{root}/src/wave={k}")
        stream = spark.readStream.schema(UPLOAD).option("maxFilesPerTrigger", 1 << 30).parquet(f"{root}/src")
        intake_stream.start_intake(stream, store, f"{root}/ckpt", available_now=True).awaitTermination()
    return store.scan_papers().select("id", "content_hash", "source_type", "source_ref", "status", "raw_key")


def stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status log L as a stream; live summaries folded into papers."""
    root = _scratch(spark, "stream_fold")
    events = inputs.table(spark, sf_dir, "events")
    papers, log = inputs.event_papers(events), inputs.event_updates(events)
    rows = events.count()
    files = max(1, -(-rows // MOST_ROWS_PER_FILE), min(-(-rows // ROWS_PER_FILE), FILES_PER_BATCH * MICRO_BATCHES))
    log.repartitionByRange(files, "at").write.parquet(f"{root}/log")
    written = len(spark.read.schema(log.schema).parquet(f"{root}/log").inputFiles())
    per_batch = max(FILES_PER_BATCH, -(-written // MICRO_BATCHES))
    own = status_stream.status_session(spark)
    stream = own.readStream.schema(log.schema).option("maxFilesPerTrigger", per_batch).parquet(f"{root}/log")
    q = status_stream.start_status(stream, f"{root}/status", f"{root}/ckpt", available_now=True, compact_every=2)
    q.awaitTermination()
    folded = lifecycle.apply_summary(papers, status_stream.latest_summaries(spark, f"{root}/status"), since_created=True)
    return folded.select(
        "id",
        "status",
        "schema_version",
        "result_key",
        "error",
        F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("updated_at"),
    )


def store_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L written in parts that know no order of time, papers registered in two
    halves, the store compacted between any two writes: the same papers as one fold."""
    store = PaperStore(spark, _scratch(spark, "store_late_rows"))
    papers, log = inputs.status_log(inputs.table(spark, sf_dir, "events"))
    log = store.write_work(log, 0, "log")
    papers = store.write_work(papers, 0, "papers")
    late = F.col("content_hash") < F.lit("8")
    part = F.pmod(F.col("seq"), F.lit(3))
    store.append_papers(papers.where(~late), batch=1)
    store.append_log(log.where(part == 2), batch=2, step=0)
    store.compact()
    store.append_log(log.where(part == 0), batch=3, step=1)
    store.compact(rows_per_bucket=8)
    store.append_papers(papers.where(late), batch=4)  # after the log rows that are about them
    store.compact()
    store.append_log(log.where(part == 1), batch=3, step=0)
    f = store.scan_papers(with_attempts=True)
    return f.select(
        "id",
        "status",
        "schema_version",
        "result_key",
        "error",
        F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("updated_at"),
        F.col("attempts").cast("long").alias("attempts"),
    )


#: When the papers of L are looked at, and how they are retried, so that some are free, some held and some given up.
LEASES_AT = "2024-01-31 00:00:00"
LEASES = lifecycle.Retry(lease=6 * 3600, backoff=60, longest=43_200, attempts=20)


def pending_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be taken up at ``LEASES_AT``: queued papers, expired leases, failed papers whose wait is over."""
    papers, log = inputs.status_log(inputs.table(spark, sf_dir, "events"))
    log = log.withColumn("until", F.when(F.col("to_status") == F.lit("running"), lifecycle.later(F.col("at"), F.lit(LEASES.lease))))
    f = lifecycle.fold_status(papers, log, with_attempts=True)
    at = F.lit(LEASES_AT).cast("timestamp")
    due = lifecycle.pending(f, retry_failed=True, at=at, retry=LEASES).select("id", F.lit(True).alias("pending"))
    lost = lifecycle.stuck(f, at=at, retry=LEASES).select("id", F.lit(True).alias("stuck"))
    rows = f.withColumn("next", lifecycle.next_attempt(LEASES)).join(due, "id", "left").join(lost, "id", "left")
    return rows.select(
        "id",
        "status",
        F.col("attempts").cast("long").alias("attempts"),
        F.date_format("next", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("next_attempt"),
        F.coalesce("pending", F.lit(False)).alias("pending"),
        F.coalesce("stuck", F.lit(False)).alias("stuck"),
    )


def raw_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U registered in one pass; the stored objects by key, with their size and digest as stored."""
    store = PaperStore(spark, _scratch(spark, "raw_store"))
    submit(store, _uploads(spark, sf_dir).select(*UPLOAD.fieldNames()), batch=1, replies=False)
    stored = store.raw().select("content_hash", "raw_key", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("digest"))
    return stored.groupBy("content_hash", "raw_key", "bytes", "digest").agg(F.count(F.lit(1)).alias("n_uploads"))


#: Uploads that share a file where a query works on real files, and the size cap over such files.
PER_FILE, FILE_CAP = 32, 75_000
#: Small files that one task writes.
FILES_PER_TASK = 64


def upload_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U as real files, the payloads of neighbouring documents line by line in each, and
    an empty file; some are over a small cap."""
    root = _scratch(spark, "upload_scan")
    group = F.floor(F.col("doc_id") / PER_FILE).alias("part")
    u = _uploads(spark, sf_dir).select("doc_id", group, F.col("content").cast("string").alias("value"))
    u.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").text(f"{root}/files")
    spark.range(0).select(F.lit("").alias("value")).coalesce(1).write.text(f"{root}/files/none")  # one file of no bytes
    found = uploads_source.scan_classified(spark, f"{root}/files", FILE_CAP, with_empty=True)
    h = F.when(F.col("reject_reason").isNull(), intake.content_hash(F.col("content")))
    part = F.regexp_extract("path", r"part=(\d+)/[^/]*$", 1)
    return found.select(F.when(part != "", part).cast("long").alias("part"), "length", "reject_reason", h.alias("content_hash"))


def _title_tei(doc_id: Column) -> Column:
    return F.concat(F.lit("<TEI><teiHeader><fileDesc><titleStmt><title>L"), doc_id.cast("string"), F.lit("</title></titleStmt></fileDesc></teiHeader></TEI>"))


def tei_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: TEI from a table of strings, a table of bytes (some not UTF-8) and a folder of files, parsed."""
    root = _scratch(spark, "tei_scan")
    t = inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), "doc_id", _title_tei(F.col("doc_id")).alias("tei"))
    none = F.lit(None).cast("string").alias("source_hash")
    t.select("paper_id", none, "tei").write.parquet(f"{root}/string")
    body = F.encode("tei", "UTF-8")
    t.select("paper_id", none, F.when(F.col("doc_id") % 6 == 0, F.concat(body, F.lit(bytearray(b"\xc3\x28")))).otherwise(body).alias("tei")).write.parquet(f"{root}/binary")
    # One file for each group of neighbouring documents, in a folder named by the paper.
    groups = t.select(F.floor(F.col("doc_id") / PER_FILE).alias("paper_id")).distinct()
    files = groups.select("paper_id", _title_tei(F.col("paper_id")).alias("value"))
    # A task's time goes by its files, not by their bytes, from which Spark would plan one task.
    tasks = max(spark.sparkContext.defaultParallelism, -(-t.count() // (PER_FILE * FILES_PER_TASK)))
    files.repartition(tasks).write.partitionBy("paper_id").text(f"{root}/files")
    kinds = {
        "string": tei_source.scan_tei(spark, f"{root}/string"),
        "binary": tei_source.scan_tei(spark, f"{root}/binary"),
        "files": tei_source.scan_tei_files(spark, f"{root}/files", glob="*.txt"),
    }
    rows = None
    for kind, df in kinds.items():
        one = df.select(F.lit(kind).alias("kind"), "paper_id", "source_hash", "tei")
        rows = one if rows is None else rows.unionByName(one)
    d = tei.to_document(rows, keep=["kind", "paper_id"], parts=("title",))
    return d.select("kind", "paper_id", F.col("metadata.title").alias("title"), F.col("parse_error").isNotNull().alias("rejected"))


def _plain(batch):
    """A Python engine's function: Markdown is the input without its language mark; one language is refused."""
    import pandas as pd

    lang = batch["tei"].str.slice(0, 2)
    refused = lang == "de"
    return pd.DataFrame(
        {
            "markdown": batch["tei"].str.slice(3).where(~refused, None),
            "parse_error": pd.Series("no engine for this language", index=batch.index).where(refused, None),
        }
    )


PLAIN_ENGINE = engines.python_engine("plain", engines.Feature.BODY, _plain, "markdown string, parse_error string")


def engine_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U registered, then parsed by an engine that is a Python function over Arrow batches."""
    ship_package(spark)
    store = PaperStore(spark, _scratch(spark, "engine_python"))
    docs = inputs.table(spark, sf_dir, "documents")
    submit(store, inputs.uploads(docs).select(*UPLOAD.fieldNames()), batch=1, replies=False)
    named = store.scan_papers().select("content_hash", "source_ref")
    ref = F.concat(F.col("doc_id").cast("string"), F.lit(".pdf"))
    work = docs.select(ref.alias("source_ref"), F.concat("lang", F.lit(":"), "text").alias("tei")).join(named, "source_ref")
    process(store, work.select(F.col("content_hash").alias("source_hash"), "tei"), batch=2, engine=PLAIN_ENGINE)
    d = store.documents(2).select(F.col("paper_id").alias("id"), "engine", "markdown")
    return store.scan_papers().join(d, "id", "left").select("id", "status", "error", "engine", "markdown")


def stream_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TEI that comes before its paper's registration, after it, twice, broken, or never.

    By doc_id: a third of the TEI is there before anything is registered, a third comes with
    the registration, the rest after it (and again after a broken one).
    """
    root = _scratch(spark, "stream_parse")
    store = PaperStore(spark, f"{root}/store")
    docs = inputs.table(spark, sf_dir, "documents")
    u = inputs.uploads(docs).select(*UPLOAD.fieldNames())
    # The TEI of a paper is that of the upload which names it.
    keyed = store.write_work(intake.with_keys(intake.accepted(inputs.uploads(docs))).select("doc_id", "path", "content_hash"), 0, "keyed")
    first = keyed.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))
    good = _title_tei(F.col("doc_id"))
    t = first.where(F.col("doc_id") % 13 != 0).select(
        "doc_id",
        F.lit(None).cast("string").alias("paper_id"),
        F.col("content_hash").alias("source_hash"),
        F.when(F.col("doc_id") % 11 == 0, F.regexp_replace(good, "</TEI>", "")).otherwise(good).alias("tei"),
    )
    t = store.write_work(t, 0, "tei")

    def arrive(rows: DataFrame) -> None:
        rows.select("paper_id", "source_hash", "tei").write.mode("append").parquet(f"{root}/tei")

    def run() -> None:
        parse_stream.start_parse(parse_stream.stream_tei(spark, f"{root}/tei"), store, f"{root}/ckpt", available_now=True).awaitTermination()

    arrive(t.where(F.col("doc_id") % 3 == 0))
    run()  # nothing is registered: all of it waits
    arrive(t.where(F.col("doc_id") % 3 == 1).unionByName(t.where((F.col("doc_id") % 3 == 1) & (F.col("doc_id") % 11 != 0))))
    submit(store, u, batch=1, replies=False)
    run()
    arrive(t.where(F.col("doc_id") % 3 == 2))
    run()
    arrive(t.where((F.col("doc_id") % 3 == 2) & (F.col("doc_id") % 11 == 0)))  # a second attempt fails too
    run()
    d = store.documents().select(F.col("paper_id").alias("id"), F.col("metadata.title").alias("title"))
    papers = store.scan_papers(with_attempts=True).join(d, "id", "left")
    return papers.select("id", "status", "title", F.col("attempts").cast("long").alias("attempts"))


def process_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry points A then B: register U, then parse every pending paper from its TEI."""
    root = _scratch(spark, "process_papers")
    store = PaperStore(spark, root)
    docs = spread(inputs.table(spark, sf_dir, "documents"))
    submit(store, inputs.uploads(docs).select(*UPLOAD.fieldNames()), batch=1, replies=False)
    # The parse service's output: TEI per distinct upload, from its first document; some is
    # missing, some broken, some there twice.
    h = intake.content_hash(inputs.payload_bytes())
    first = docs.select(h.alias("source_hash"), "doc_id").groupBy("source_hash").agg(F.min("doc_id").alias("doc_id"))
    tei_by_hash = inputs.tei_inputs(docs.join(first.select("doc_id"), "doc_id", "left_semi"))
    tei_by_hash = tei_by_hash.where(F.col("doc_id") % 13 != 0).withColumn(
        "tei", F.when(F.col("doc_id") % 11 == 0, inputs.broken(F.col("doc_id"), F.col("tei"))).otherwise(F.col("tei"))
    )
    # Every fifth row comes twice, without a second scan, join and build.
    copies = F.when(F.col("doc_id") % 5 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    tei_by_hash = tei_by_hash.withColumn("copy", F.explode(copies))
    # The parse reads stored TEI more than once, as it would that of the service.
    process(store, store.write_work(tei_by_hash.select("source_hash", "tei"), 0, "service"), batch=2)
    papers = store.scan_papers()
    d = store.documents(2).select(
        F.col("paper_id").alias("id"),
        F.col("metadata.title").alias("title"),
        F.size("sections").cast("long").alias("n_sections"),
    )
    return papers.join(d, "id", "left").select("id", "status", "result_key", "error", "title", "n_sections")


def store_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3 over a store compacted between the steps of a batch and before a later batch."""
    store = PaperStore(spark, _scratch(spark, "store_compact"))
    papers = store.write_work(_all_papers(spark, sf_dir), 0, "papers")
    first = papers.where(F.col("content_hash") < F.lit("8"))
    store.append_papers(first, batch=1)
    ids = first.select(F.col("id").alias("paper_id"))
    store.append_log(lifecycle.mark_running(ids), batch=2, step=0)
    store.compact()
    store.append_log(lifecycle.mark_done(ids), batch=2, step=1)
    store.append_papers(papers.where(F.col("content_hash") >= F.lit("8")), batch=3)
    store.compact()
    return store.scan_papers().select("id", "content_hash", "status", "result_key")


def doc_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first slice of the build plan, also ``entry``: title, section count, Markdown."""
    return flagship(spark, sf_dir)


QUERIES: dict[str, Query] = {
    # TEI -> Document
    "doc_flagship": doc_flagship,
    "doc_title": doc_title,
    "doc_authors": doc_authors,
    "doc_doi": doc_doi,
    "doc_abstract": doc_abstract,
    "doc_sections": doc_sections,
    "doc_references": doc_references,
    "doc_author_rows": doc_author_rows,
    "doc_markdown": doc_markdown,
    "doc_core": doc_core,
    "doc_json": doc_json,
    "doc_json_content": doc_json_content,
    "tei_reject": tei_reject,
    # intake
    "upload_classify": upload_classify,
    "upload_keys": upload_keys,
    "batch_dedup": batch_dedup,
    "insert_or_get": insert_or_get,
    "new_papers": new_papers,
    "paper_by_id": paper_by_id,
    "paper_by_hash": paper_by_hash,
    "paper_view": paper_view,
    "papers_audit": papers_audit,
    "engine_features": engine_features,
    # lifecycle
    "status_fold": status_fold,
    "attempts": attempts,
    "pending": pending,
    # streams and jobs
    "stream_intake": stream_intake,
    "stream_fold": stream_fold,
    "store_late_rows": store_late_rows,
    "pending_leases": pending_leases,
    "raw_store": raw_store,
    "upload_scan": upload_scan,
    "tei_scan": tei_scan,
    "engine_python": engine_python,
    "stream_parse": stream_parse,
    "process_papers": process_papers,
    "store_compact": store_compact,
}
