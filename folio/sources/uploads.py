"""O1: upload scan over a folder of files (``binaryFile``).

The size cap (O7) is a filter on ``length``, which the ``binaryFile``
reader evaluates from the file listing: files over the cap are never
opened. Over-size files are reported from the listing alone (``content``
is not selected, so it is not read).

Spark's file scans leave out files of no bytes. ``empty_uploads`` finds them:
the file index of a scan holds them all the same, so they are its files without
those that the scan has rows for.
"""

from __future__ import annotations

from pyspark.sql import Column as AnyColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column

from folio.operators import intake
from folio.schemas import MAX_UPLOAD_BYTES, UPLOAD


def _reader(spark: SparkSession, glob: str | None, recursive: bool):
    r = spark.read.format("binaryFile")
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r


def list_uploads(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """Every file as a ``binaryFile`` row; bytes are read only for the rows and
    columns a later step keeps (``intake.classify_keys`` keeps them for files
    within the cap only)."""
    return _reader(spark, glob, recursive).load(path).select(*UPLOAD.fieldNames())


def scan_uploads(
    spark: SparkSession, path: str, max_bytes: int = MAX_UPLOAD_BYTES, glob: str | None = None, recursive: bool = True
) -> DataFrame:
    """Files within the cap: ``path, modificationTime, length, content``."""
    df = _reader(spark, glob, recursive).load(path)
    return df.where(intake.size_ok(F.col("length"), max_bytes)).select(*UPLOAD.fieldNames())


def _plain_path(c: AnyColumn) -> AnyColumn:
    """A path without its scheme and its slashes, decoded, as the index (a URI) and the scan (a path) both give it."""
    return F.regexp_replace(c, r"^file:/+", "/")


def empty_uploads(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """Files of no bytes: ``path, modificationTime, length, content`` (no time is known, and no content).

    The list of files goes from the driver's index, where Spark keeps it for any scan,
    to a DataFrame as one array of paths, without passing through Python; no bytes are read.
    """
    scan = _reader(spark, glob, recursive).load(path)
    files = Column(spark.sparkContext._jvm.org.apache.spark.sql.functions.lit(scan._jdf.inputFiles()))
    uri = spark.range(1).select(F.explode(files).alias("uri"))
    # A URI escapes with percent signs only; a plus sign is itself.
    every = uri.select(_plain_path(F.url_decode(F.replace("uri", F.lit("+"), F.lit("%2B")))).alias("path"))
    filled = scan.select(_plain_path(F.col("path")).alias("path"))
    return every.join(filled, "path", "left_anti").select(
        "path",
        F.lit(None).cast("timestamp").alias("modificationTime"),
        F.lit(0).cast("long").alias("length"),
        F.lit(None).cast("binary").alias("content"),
    )


def scan_classified(
    spark: SparkSession,
    path: str,
    max_bytes: int = MAX_UPLOAD_BYTES,
    glob: str | None = None,
    recursive: bool = True,
    with_empty: bool = False,
) -> DataFrame:
    """Every file with ``reject_reason`` (O9); bytes are read only for files within the cap.

    ``with_empty``: files of no bytes too, which are rejected as any that is no PDF.
    """
    listing = _reader(spark, glob, recursive).load(path)
    small = intake.classify_uploads(
        listing.where(intake.size_ok(F.col("length"), max_bytes)).select(*UPLOAD.fieldNames()), max_bytes
    )
    large = listing.where(~intake.size_ok(F.col("length"), max_bytes)).select(
        "path",
        "modificationTime",
        "length",
        F.lit(None).cast("binary").alias("content"),
        F.lit(intake.REJECT_TOO_LARGE).alias("reject_reason"),
    )
    out = small.unionByName(large)
    if with_empty:
        out = out.unionByName(intake.classify_uploads(empty_uploads(spark, path, glob, recursive), max_bytes))
    return out
