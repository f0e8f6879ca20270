"""O2: TEI input, one document per row, keyed by paper id and source hash.

TEI produced by a parse service arrives either as a table
``(paper_id, source_hash, tei)`` (Parquet, ``tei`` as string or bytes) or as
a folder of ``<paper_id>.xml`` files or of ``paper_id=<id>`` folders with a file each. Bytes that are not valid UTF-8 become
a NULL ``tei``, which the parser reports as an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decode_utf8(c: Column) -> Column:
    """Bytes -> string, NULL when the bytes are not valid UTF-8."""
    s = c.cast("string")
    return F.when(F.is_valid_utf8(s), s)


def scan_tei(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    df = spark.read.format(fmt).load(path)
    tei = F.col("tei")
    if isinstance(df.schema["tei"].dataType, T.BinaryType):
        tei = decode_utf8(tei)
    return df.select(F.col("paper_id").cast("string"), F.col("source_hash").cast("string"), tei.alias("tei"))


def scan_tei_files(spark: SparkSession, path: str, glob: str = "*.xml") -> DataFrame:
    """A folder of ``<paper_id>.xml`` files, or of files in ``paper_id=<id>`` folders (``source_hash`` unknown: NULL)."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract(F.col("path"), r"([^/]*)$", 1)
    folder = F.regexp_extract(F.col("path"), r"/paper_id=([^/]+)/[^/]*$", 1)
    return df.select(
        F.coalesce(F.nullif(folder, F.lit("")), F.regexp_replace(name, r"(\.tei)?\.xml$", "")).alias("paper_id"),
        F.lit(None).cast("string").alias("source_hash"),
        decode_utf8(F.col("content")).alias("tei"),
    )
