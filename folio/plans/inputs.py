"""Inputs derived by Spark from the driver's tables.

The reference takes PDFs over HTTP and TEI from an external service; the
driver supplies Parquet tables instead. These derivations turn whole
tables into the shapes the operators consume, so every query's work grows
with the tables:

* **U** uploads: one file per ``documents`` row. Its bytes are the text,
  prefixed with ``%PDF-`` except for every fifth document (those are the
  non-PDF uploads).
* **T** TEI: one TEI document per ``documents`` row, built by column
  expressions from the text (title = first line, one ``div`` per line, ...).
* **L** status log: ``events`` read as API calls over time. A user's first
  ``signup`` registers a paper; ``click`` marks it running, ``error`` failed,
  ``view`` and ``purchase`` done. Later signups re-submit known bytes and
  change nothing. Calls are ordered by ``(ts, event_id)``.
* **H** pages: ``pages.html`` offered as TEI (none has a TEI root).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.text import bound, replace
from folio.operators import intake, lifecycle, skew

# Cap of the query that shows the size gate; all other queries use the library's 50 MiB.
GATE_MAX_BYTES = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------- U ---


def payload(doc_id: Column, text: Column) -> Column:
    return F.when(doc_id % 5 == 0, text).otherwise(F.concat(F.lit("%PDF-"), text))


def payload_bytes() -> Column:
    """A document's file; a string is UTF-8 already, so nothing is encoded."""
    return payload(F.col("doc_id"), F.col("text")).cast("binary")


def uploads(documents: DataFrame) -> DataFrame:
    """U: ``(path, modificationTime, length, content)`` plus ``doc_id, lang``."""
    content = payload_bytes()
    return documents.select(
        F.concat(F.lit("upload/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id")).alias("modificationTime"),
        F.octet_length(content).cast("long").alias("length"),
        content.alias("content"),
        "doc_id",
        "lang",
    )


def registered(keyed_accepted: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Papers after registering a batch into an empty table (O16 -> O18 -> O5)."""
    firsts = intake.dedup_batch(keyed_accepted)
    return intake.paper_rows(firsts, created_at)


# ------------------------------------------------------------------- T ---


def xml_escape(c: Column) -> Column:
    return replace(c, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def _doi_value(n: Column) -> Column:
    return F.concat(F.lit("10."), (F.lit(1000) + n % 9000).cast("string"), F.lit("/doc."), n.cast("string"))


def _el(name: str, *content: Column | str, attrs: str = "") -> Column:
    """One element around strings and columns, on one line."""
    parts = [c if isinstance(c, Column) else F.lit(c) for c in content]
    return F.concat(F.lit(f"<{name}{attrs}>"), *parts, F.lit(f"</{name}>"))


def tei_document(doc_id: Column, text: Column, lang: Column, source: Column) -> Column:
    """T: one synthetic TEI string per document.

    The text comes before the header, and what must not be read stands beside
    what must: nested divs, ``monogr`` titles and ids, a title before the last,
    names of another case, a DOCTYPE with a subset, analytic, abstract and ``listBibl`` blocks more than once.
    """
    return bound(F.split(text, "\n", -1), lambda lines: _tei_of_lines(doc_id, lines, lang, source))


def _tei_of_lines(doc_id: Column, lines: Column, lang: Column, source: Column) -> Column:
    first = xml_escape(F.get(lines, 0))
    second = xml_escape(F.get(lines, 1))

    def div(line: Column, i: Column) -> Column:
        inner = F.when(i % 7 == 3, F.lit("<div><head>inner</head><p>not read</p></div>")).otherwise("")
        head = F.when(i % 3 == 0, _el("head", " L", i.cast("string"), " ")).otherwise("")
        blank = F.when(i % 5 == 4, F.lit("<div><head>\n</head><p/></div>\n")).otherwise("")
        blank = F.concat(blank, F.when(i % 7 == 5, F.lit("<DIV><head>other</head><p>not read</p></DIV><div><HEAD>no</HEAD><P>no</P></div>")).otherwise(""))
        return F.concat(blank, _el("div", inner, _el("p", " ", xml_escape(line), " <ref>[1]</ref>"), head), F.lit("\n"))

    def doi(n: Column, kind: str) -> Column:
        return _el("idno", _doi_value(n), attrs=f' type="{kind}"')

    def ref(k: Column) -> Column:
        n = (doc_id + k).cast("string")
        person = _el("author", _el("persName", _el("surname", k.cast("string")), "<forename>R</forename>"))
        article = _el("analytic", _el("title", "Ref ", n), person, doi(doc_id + k, "DOI"))
        volume = _el("monogr", "<title>Journal</title>", doi(doc_id, "DOI"))
        return _el("listBibl", _el("biblStruct", volume, article))

    ks = F.filter(F.sequence(F.lit(1).cast("long"), F.greatest(doc_id % 4, F.lit(1)).cast("long")), lambda k: k <= doc_id % 4)
    surname = _el("surname", xml_escape(lang))
    full = _el("analytic", _el("author", _el("persName", surname, _el("forename", xml_escape(source)))), "<idno type=\"PII\">S1</idno>")
    own_doi = F.when(doc_id % 7 == 0, F.lit("")).when(doc_id % 2 == 0, doi(doc_id, "doi")).otherwise(doi(doc_id, "DOI"))
    more = _el("analytic", own_doi, _el("author", _el("persName", surname)))
    summary = F.concat(
        _el("abstract", _el("div", _el("p", first))),
        F.when(second.isNotNull(), _el("abstract", _el("div", _el("p", second)))).otherwise(""),
    )
    source_desc = _el("sourceDesc", _el("biblStruct", "<monogr><title>Series</title></monogr>", full, more))
    return F.concat(
        F.when(doc_id % 2 == 0, F.lit("<?xml version=\"1.0\" encoding=\"utf-8\"?><!-- made from a text --><!DOCTYPE TEI [<!ENTITY x \"<html>\"> ]>\n")).otherwise(""),
        _el(
            "TEI",
            _el(
                "text",
                _el("body", F.array_join(F.transform(lines, div), "")),
                _el("front", summary),
                _el("back", _el("div", F.array_join(F.transform(ks, ref), ""))),
            ),
            _el("teiHeader", _el("fileDesc", source_desc, _el("titleStmt", "<title>draft</title>", _el("title", " ", first, " ")))),
            attrs=' xmlns="http://www.tei-c.org/ns/1.0"',
        ),
    )


def broken(doc_id: Column, tei: Column) -> Column:
    """T with a fault per row, by turns: no end tag, an unknown entity, a foreign encoding, a root of another case, a foreign version."""
    body = F.regexp_replace(tei, r"^<\?xml[^>]*>", "")
    return (
        F.when(doc_id % 5 == 0, F.regexp_replace(tei, "</TEI>$", ""))
        .when(doc_id % 5 == 1, F.regexp_replace(tei, "</TEI>$", "&nosuch;</TEI>"))
        .when(doc_id % 5 == 3, F.regexp_replace(tei, "(</?)TEI", "$1Tei"))
        .when(doc_id % 5 == 2, F.concat(F.lit("<?xml version='1.0' encoding='ISO-8859-1'?>"), body))
        .otherwise(F.concat(F.lit("<?xml version='1.1'?>"), body))
    )


def tei_inputs(documents: DataFrame) -> DataFrame:
    """T: ``(doc_id, tei, source_hash)``; the hash is the upload's content hash."""
    return documents.select(
        "doc_id",
        tei_document(F.col("doc_id"), F.col("text"), F.col("lang"), F.col("source")).alias("tei"),
        intake.content_hash(payload_bytes()).alias("source_hash"),
    )


# ------------------------------------------------------------------- L ---


def event_papers(events: DataFrame) -> DataFrame:
    """Papers registered by each user's first signup (O16 first-wins)."""
    first = F.min_by(F.struct("ts", "event_id"), F.struct("ts", "event_id")).alias("f")
    firsts = events.where(F.col("event_type") == F.lit("signup")).groupBy("user_id").agg(first)
    pid = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    h = F.sha2(F.concat(F.lit("user:"), F.col("user_id").cast("string")), 256)
    return firsts.select(
        pid.alias("id"),
        h.alias("content_hash"),
        F.lit("upload").alias("source_type"),
        F.lit(None).cast("string").alias("source_ref"),
        F.lit("queued").alias("status"),
        intake.raw_key(h).alias("raw_key"),
        F.lit(None).cast("string").alias("schema_version"),
        F.lit(None).cast("string").alias("result_key"),
        F.lit(None).cast("string").alias("error"),
        F.col("f.ts").alias("created_at"),
        F.col("f.ts").alias("updated_at"),
    )


# Fixed mapping of event types to UPDATEs.
EVENT_STATUS = {"click": "running", "error": "failed", "view": "done", "purchase": "done"}


def event_updates(events: DataFrame) -> DataFrame:
    """Status-changing calls (before the existence check), in one pass over ``events``."""
    to_status = None
    for event, status in EVENT_STATUS.items():
        hit = F.col("event_type") == F.lit(event)
        to_status = F.when(hit, F.lit(status)) if to_status is None else to_status.when(hit, F.lit(status))
    e = events.where(F.col("event_type").isin(*EVENT_STATUS)).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("paper_id"),
        F.col("ts"),
        F.col("event_id"),
        to_status.alias("to_status"),
        F.col("props"),
    )
    return lifecycle.log_rows(e, F.col("to_status"), F.col("ts"), F.col("event_id"), error=F.col("props"))


def status_log(events: DataFrame, rows_per_salt: int = skew.ROWS_PER_SALT) -> tuple[DataFrame, DataFrame]:
    """L: ``(papers, log)`` where the log holds only updates that hit a row (for counts of them)."""
    papers = event_papers(events)
    return papers, lifecycle.applicable(event_updates(events), papers, rows_per_salt)
