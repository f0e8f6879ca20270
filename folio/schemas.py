"""Fixed schemas: the ``papers`` relation, the status log, TEI input, Document.

Every container element of the TEI input is typed as an array of structs, so
repeated containers (two ``abstract`` elements, two ``analytic`` blocks, two
``persName`` in one author) keep all their children; every text element is
``ARRAY<STRUCT<_VALUE: ARRAY<STRING>>>`` so that only the element's own
character data is read (text of inline children such as ``<ref>`` is dropped)
and a repeated scalar can be resolved as "last one wins".
"""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data model (must equal the reference's).
SCHEMA_VERSION = "1.0"
SOURCE_TYPES = ("upload", "url", "doi")
STATUSES = ("queued", "running", "done", "failed")
MAX_UPLOAD_BYTES = 50 << 20  # 50 MiB
PDF_MAGIC = b"%PDF-"

# ---------------------------------------------------------------- papers --

PAPERS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("content_hash", T.StringType(), False),
        T.StructField("source_type", T.StringType(), False),
        T.StructField("source_ref", T.StringType(), True),
        T.StructField("status", T.StringType(), False),
        T.StructField("raw_key", T.StringType(), False),
        T.StructField("schema_version", T.StringType(), True),
        T.StructField("result_key", T.StringType(), True),
        T.StructField("error", T.StringType(), True),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("updated_at", T.TimestampType(), False),
    ]
)

# One row per UPDATE: (paper_id, at, seq) orders the rows of one paper.
STATUS_LOG = T.StructType(
    [
        T.StructField("paper_id", T.StringType(), False),
        T.StructField("at", T.TimestampType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("to_status", T.StringType(), False),
        T.StructField("schema_version", T.StringType(), True),
        T.StructField("result_key", T.StringType(), True),
        T.StructField("error", T.StringType(), True),
    ]
)

# A log row may end its own effect: a ``running`` row holds its paper until then (a lease), a
# ``failed`` row keeps it from the next attempt until then. Logs without the column have NULL there.
UNTIL = T.StructField("until", T.TimestampType(), True)

# What the fold keeps of the log for each paper: the latest value of each column with the key
# ``(at, seq)`` that set it, so that two summaries merge into that of both logs.
_KEY = T.StructType([T.StructField("at", T.TimestampType()), T.StructField("seq", T.LongType())])
SUMMARY = T.StructType(
    [
        T.StructField("paper_id", T.StringType()),
        T.StructField("_k", _KEY),
        T.StructField("_status", T.StringType()),
        T.StructField("_until", T.TimestampType()),
        T.StructField("_done_k", _KEY),
        T.StructField("_sv", T.StringType()),
        T.StructField("_rk", T.StringType()),
        T.StructField("_close_k", _KEY),
        T.StructField("_err", T.StringType()),
        T.StructField("_attempts", T.LongType()),
    ]
)

UPLOAD = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("modificationTime", T.TimestampType(), False),
        T.StructField("length", T.LongType(), False),
        T.StructField("content", T.BinaryType(), True),
    ]
)

# ------------------------------------------------------------- TEI input --

TEXT = "ARRAY<STRUCT<_VALUE: ARRAY<STRING>>>"
AUTHOR = f"ARRAY<STRUCT<persName: ARRAY<STRUCT<forename: {TEXT}, surname: {TEXT}>>>>"
IDNO = "ARRAY<STRUCT<_type: STRING, _VALUE: ARRAY<STRING>>>"
BIBL = f"ARRAY<STRUCT<analytic: ARRAY<STRUCT<author: {AUTHOR}, title: {TEXT}, idno: {IDNO}>>>>"
CORRUPT = "_corrupt_record"

# The TEI subtrees each Document field reads. A query that needs only some
# fields parses with a schema holding only those subtrees: the parser then
# skips the rest instead of building arrays of structs for it.
TEI_PARTS = ("title", "paper", "abstract", "body", "back")
_HEADER_PARTS = {
    "title": f"titleStmt: ARRAY<STRUCT<title: {TEXT}>>",
    "paper": f"sourceDesc: ARRAY<STRUCT<biblStruct: {BIBL}>>",
}
_TEXT_PARTS = {
    "abstract": f"front: ARRAY<STRUCT<abstract: ARRAY<STRUCT<div: ARRAY<STRUCT<p: {TEXT}>>>>>>",
    "body": f"body: ARRAY<STRUCT<div: ARRAY<STRUCT<head: {TEXT}, p: {TEXT}>>>>",
    "back": f"back: ARRAY<STRUCT<div: ARRAY<STRUCT<listBibl: ARRAY<STRUCT<biblStruct: {BIBL}>>>>>>",
}


def tei_schema(parts=TEI_PARTS) -> str:
    """``from_xml`` schema for the requested TEI parts (always with the corrupt-record column)."""
    header = [f for p, f in _HEADER_PARTS.items() if p in parts]
    text = [f for p, f in _TEXT_PARTS.items() if p in parts]
    fields = []
    if header:
        fields.append(f"teiHeader: ARRAY<STRUCT<fileDesc: ARRAY<STRUCT<{', '.join(header)}>>>>")
    if text:
        fields.append(f"text: ARRAY<STRUCT<{', '.join(text)}>>")
    fields.append(f"{CORRUPT}: STRING")
    return f"STRUCT<{', '.join(fields)}>"


TEI_DDL = tei_schema()

# -------------------------------------------------------------- Document --

SECTION = T.StructType(
    [
        T.StructField("level", T.IntegerType(), False),
        T.StructField("heading", T.StringType(), False),
        T.StructField("markdown", T.StringType(), False),
    ]
)
REFERENCE = T.StructType(
    [
        T.StructField("raw", T.StringType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("authors", T.ArrayType(T.StringType(), False), False),
        T.StructField("doi", T.StringType(), False),
    ]
)
METADATA = T.StructType(
    [
        T.StructField("title", T.StringType(), False),
        T.StructField("authors", T.ArrayType(T.StringType(), False), False),
        T.StructField("doi", T.StringType(), False),
        T.StructField("abstract", T.StringType(), False),
        T.StructField("year", T.IntegerType(), True),
    ]
)
FIGURE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("caption", T.StringType()),
        T.StructField("asset_key", T.StringType()),
    ]
)
TABLE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("caption", T.StringType()),
        T.StructField("markdown", T.StringType()),
    ]
)
CHUNK = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("section", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("tokens", T.IntegerType()),
    ]
)

# Declared-only fields (year, figures, tables, chunks, warnings) are kept as
# always-NULL columns so the shape matches schema version 1.0.
DOCUMENT = T.StructType(
    [
        T.StructField("schema", T.StringType(), False),
        T.StructField("engine", T.StringType(), False),
        T.StructField("source_hash", T.StringType(), True),
        T.StructField("parsed_at", T.TimestampType(), False),
        T.StructField("metadata", METADATA, False),
        T.StructField("sections", T.ArrayType(SECTION, False), False),
        T.StructField("references", T.ArrayType(REFERENCE, False), False),
        T.StructField("figures", T.ArrayType(FIGURE), True),
        T.StructField("tables", T.ArrayType(TABLE), True),
        T.StructField("markdown", T.StringType(), False),
        T.StructField("chunks", T.ArrayType(CHUNK), True),
        T.StructField("warnings", T.ArrayType(T.StringType()), True),
    ]
)
