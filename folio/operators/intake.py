"""Upload intake: validate, fingerprint, deduplicate, insert-or-get.

Input rows look like a ``binaryFile`` scan: ``path, modificationTime,
length, content``. ``content`` is only touched by the magic-byte check and
the hash, both in the scan stage; every shuffle below carries keys only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators import skew
from folio.schemas import MAX_UPLOAD_BYTES, PDF_MAGIC

# Fixed values (must equal the reference's reply texts).
REJECT_TOO_LARGE = "expected a PDF in form field 'file' (max 50MB)"
REJECT_NOT_PDF = "file is not a PDF"

OUTCOME_ACCEPTED = "accepted"  # 202: a new paper was registered
OUTCOME_EXISTING = "existing"  # 200: the same bytes are already a paper


# ------------------------------------------------------------- O7-O9 gate --


def size_ok(length: Column, max_bytes: int = MAX_UPLOAD_BYTES) -> Column:
    """The size cap; on a ``binaryFile`` scan this filter is pushed down."""
    return length <= F.lit(max_bytes)


def is_pdf(content: Column) -> Column:
    """At least five bytes and they are ``%PDF-``."""
    return F.coalesce(F.substring(content, 1, len(PDF_MAGIC)) == F.lit(bytearray(PDF_MAGIC)), F.lit(False))


def classify_uploads(df: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """Add ``reject_reason``: size first, then magic; NULL = accepted."""
    reason = F.when(~size_ok(F.col("length"), max_bytes), F.lit(REJECT_TOO_LARGE)).when(
        ~is_pdf(F.col("content")), F.lit(REJECT_NOT_PDF)
    )
    return df.withColumn("reject_reason", reason)


def classify_raw(uploads: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """O7-O10 for a ``binaryFile``-shaped input: ``path, modificationTime, length,
    reject_reason, content_hash, raw_key, content`` (the last three for accepted files only).

    Files over the cap are classified from their length alone: the input is
    split by size first, so on a ``binaryFile`` source (a scan or a stream's
    micro-batch) the bytes of an over-size file are never read.
    """
    ok = F.col("reject_reason").isNull()
    small = classify_uploads(uploads.where(size_ok(F.col("length"), max_bytes)), max_bytes)
    small = small.withColumn("content_hash", F.when(ok, content_hash(F.col("content")))).select(
        "path",
        "modificationTime",
        "length",
        "reject_reason",
        "content_hash",
        raw_key(F.col("content_hash")).alias("raw_key"),
        F.when(ok, F.col("content")).alias("content"),
    )
    large = uploads.where(~size_ok(F.col("length"), max_bytes)).select(
        "path",
        "modificationTime",
        "length",
        F.lit(REJECT_TOO_LARGE).alias("reject_reason"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("content_hash", "string"), ("raw_key", "string"), ("content", "binary"))],
    )
    return small.unionByName(large)


def classify_keys(uploads: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """``classify_raw`` without the bytes."""
    return classify_raw(uploads, max_bytes).drop("raw_key", "content")


def accepted(df: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    return df.where(size_ok(F.col("length"), max_bytes) & is_pdf(F.col("content")))


# ---------------------------------------------------------------- O10 keys --


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def paper_id(hash_col: Column) -> Column:
    """32 lowercase hex, derived from the content hash.

    A random id would change when a task is retried; this one is the same
    on every replay, which is what makes re-running a batch idempotent.
    """
    return F.substring(F.sha2(F.concat(F.lit("paper:"), hash_col), 256), 1, 32)


def raw_key(hash_col: Column) -> Column:
    return F.concat(F.lit("raw/"), hash_col, F.lit(".pdf"))


def result_key(id_col: Column) -> Column:
    return F.concat(F.lit("result/"), id_col, F.lit(".json"))


def file_name(path: Column) -> Column:
    """Last path segment: what an upload form reports as the file name."""
    return F.regexp_extract(path, r"([^/]*)$", 1)


def with_keys(df: DataFrame) -> DataFrame:
    """``content_hash``, ``raw_key`` and ``id`` for every row."""
    h = content_hash(F.col("content"))
    return df.withColumn("content_hash", h).withColumns(
        {"raw_key": raw_key(F.col("content_hash")), "id": paper_id(F.col("content_hash"))}
    )


def keys_only(df: DataFrame) -> DataFrame:
    """Drop the bytes: what may cross a shuffle."""
    return df.select("path", "modificationTime", "length", "content_hash")


# ----------------------------------------------------- O16-O18 dedup/insert --


def dedup_batch(keyed: DataFrame) -> DataFrame:
    """One row per content hash; the earliest upload (time, then path) names it.

    ``min_by`` aggregates partially before the shuffle, so a hash uploaded
    millions of times costs one row per map task, not one per upload.
    """
    first = F.min_by(
        F.struct("path", "modificationTime", "length"), F.struct("modificationTime", "path")
    ).alias("first")
    return (
        keys_only(keyed)
        .groupBy("content_hash")
        .agg(first, F.count(F.lit(1)).alias("n_uploads"))
        .select(
            "content_hash",
            F.col("first.path").alias("path"),
            F.col("first.modificationTime").alias("modificationTime"),
            F.col("first.length").alias("length"),
            "n_uploads",
        )
    )


def known_for(papers: DataFrame, keys: DataFrame, key: str = "content_hash") -> DataFrame:
    """Rows of the (large) ``papers`` whose ``key`` occurs in the (small) batch ``keys``.

    A left-semi join with the batch on the right: AQE can build the batch
    side into a broadcast hash table when its runtime size is small, and the
    large table is then scanned and probed, never shuffled. An anti- or
    outer join with the batch on the left could only build ``papers``.
    """
    return papers.join(keys.select(key).distinct(), key, "left_semi")


def new_papers(firsts: DataFrame, papers: DataFrame) -> DataFrame:
    """First uploads whose hash is not a paper yet.

    The anti-join runs against the batch's known hashes only (see
    ``known_for``), so the papers table is probed, not shuffled.
    """
    known = known_for(papers.select("content_hash"), firsts)
    return firsts.join(known, "content_hash", "left_anti")


def paper_rows(new: DataFrame, created_at: Column | None = None) -> DataFrame:
    """``papers`` rows with the table defaults (status queued, NULL results)."""
    ts = created_at if created_at is not None else F.current_timestamp()
    return new.select(
        paper_id(F.col("content_hash")).alias("id"),
        "content_hash",
        F.lit("upload").alias("source_type"),
        file_name(F.col("path")).alias("source_ref"),
        F.lit("queued").alias("status"),
        raw_key(F.col("content_hash")).alias("raw_key"),
        F.lit(None).cast("string").alias("schema_version"),
        F.lit(None).cast("string").alias("result_key"),
        F.lit(None).cast("string").alias("error"),
        ts.alias("created_at"),
        ts.alias("updated_at"),
    )


def resolve_uploads(keyed: DataFrame, papers: DataFrame, rows_per_salt: int = skew.ROWS_PER_SALT) -> DataFrame:
    """Every accepted upload answered with a paper.

    ``accepted`` for the first upload of a hash that is not a paper yet,
    ``existing`` otherwise (a known hash, or a later copy in the same
    batch). One file may be a large share of all uploads, so the join that
    answers them is salted (``operators.skew``): one salt for each
    ``rows_per_salt`` uploads of a hash. (AQE's skew join does not reach it, as its other
    side is a join in the same stage.)
    """
    uploads = keyed.select("path", "content_hash")
    firsts = dedup_batch(keyed).select("content_hash", F.col("path").alias("_first_path"), "n_uploads")
    known = known_for(papers.select("content_hash", "id", "status", "result_key"), firsts).select(
        "content_hash",
        F.col("id").alias("_k_id"),
        F.col("status").alias("_k_status"),
        F.col("result_key").alias("_k_result_key"),
    )
    # Both lookup tables have one row per hash: join them first, so the
    # uploads take part in a single join.
    per_hash = firsts.join(known, "content_hash", "left")
    j = skew.salted_left_join(uploads, per_hash, "content_hash", "n_uploads", rows_per_salt)
    is_known = F.col("_k_id").isNotNull()
    return j.select(
        "path",
        F.coalesce(F.col("_k_id"), paper_id(F.col("content_hash"))).alias("id"),
        F.when(is_known, F.col("_k_status")).otherwise(F.lit("queued")).alias("status"),
        "content_hash",
        F.when(is_known, F.col("_k_result_key")).alias("result_key"),
        F.when(~is_known & (F.col("path") == F.col("_first_path")), F.lit(OUTCOME_ACCEPTED))
        .otherwise(F.lit(OUTCOME_EXISTING))
        .alias("outcome"),
    )
