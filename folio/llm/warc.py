"""WARC archives: writing with revisit records, and reading back by boundary-chain verification.

``write_warc`` writes one record per page with Spark's text writer, the two
line ends after a record being its line separator: uncompressed archives on
any file system Spark writes to, committed as any other job. Of equal
payloads of at least ``least`` bytes the one with the smallest page_id is a
response and the others are revisits of it. Only (page_id, digest) is
shuffled; the table of revisits is written first, so that Spark knows its
size when it plans the join with the pages.

``read_warc`` lets Spark split the archives anywhere. Tasks cut their byte
range at the record magic, which payloads may contain too, and emit each
candidate with the offset of its successor. Within a split the chains are
followed from every candidate to where they leave it, across splits by
pointer jumping from the start of the file, in rounds that grow with the
logarithm of the splits. Only candidates on the chain from the file's start
are records; the others are part of a payload, which is put together again
from a second read of just those pieces. What stands between two magics is the
same however Spark splits the files, so pieces are found again by their file, length
and hash, not by a place in a split: the second read may be split in any other way.

Defined cases: an archive without records gives no rows; null html is an empty payload; a null url is left out and line
ends in it become spaces; a null page_id never is the smallest; rows equal in
page_id and payload are the same kind of record; in a damaged archive the
records before the damage are returned.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import materialise
from folio.session import checkpoint_root

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def payload(html: Column) -> Column:
    return F.coalesce(html, F.lit(""))


def revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that repeat another one's payload."""
    p = pages.select("page_id", F.sha2(payload(F.col("html")).cast("binary"), 256).alias("digest"), F.octet_length(payload(F.col("html"))).alias("n")).where(F.col("n") >= least).select("page_id", "digest")
    first = p.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and refers_to is not null")
    return p.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def write_warc(pages: DataFrame, path: str | None = None, least: int = 100, date: str = "1970-01-01T00:00:00Z") -> str:
    """Archive ``pages`` (page_id, url, html) and return the folder, by default a new one in the shared checkpoint folder."""
    path = path or f"{checkpoint_root(pages.sparkSession).rstrip('/')}/folio-warc-{uuid.uuid4().hex}"
    again = materialise(revisits(pages, least), "revisits").withColumnsRenamed({"page_id": "__id", "digest": "__digest"})
    body = payload(F.col("html"))
    rows = pages.select("page_id", "url", body.alias("body"), F.sha2(body.cast("binary"), 256).alias("digest"))
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left")
    is_revisit = F.col("refers_to").isNotNull()
    length = F.octet_length("body").cast("string")

    def urn(c: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))

    lines = [
        F.concat(F.lit("WARC-Type: "), F.when(is_revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn("page_id")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]+", " ")),  # null: no line
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Length: "), length),
        F.when(is_revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(is_revisit, F.concat(F.lit("WARC-Refers-To: "), urn("refers_to"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(is_revisit, "0").otherwise(length)),
    ]
    record = F.concat(F.lit(MAGIC), F.concat_ws("\r\n", *lines), F.lit(END), F.when(is_revisit, "").otherwise(F.col("body")))
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)
    return path


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, nth, value): the bytes after each magic, in order within a split; the
    first piece of a file is what stands before any magic."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    raw = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("file_size"))
    raw = raw.withColumn("piece", F.xxhash64("value"))
    return raw.withColumn("nth", F.monotonically_increasing_id())


def header(name: str) -> Column:
    got = F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*?)[ \t]*(?:\r\n|$)", 1)
    return F.when(got != "", got)


def parsed(p: DataFrame) -> DataFrame:
    """Header fields and the digest of the payload, as far as a piece has it."""
    p = p.withColumn("head", F.substring_index("value", END, 1)).withColumn("whole", F.octet_length("value"))
    p = p.withColumn("head_bytes", F.octet_length("head") + len(END)).withColumn("length", F.when(F.col("head_bytes") <= F.col("whole"), header("Content-Length").try_cast("long")))
    body = F.substring(F.col("value").cast("binary"), F.col("head_bytes") + 1, F.col("length").cast("int"))
    return p.select(
        "file",
        "split",
        "nth",
        "piece",
        "file_size",
        F.col("whole").cast("long").alias("bytes"),
        F.col("head_bytes").cast("long").alias("head_bytes"),
        "length",
        header("WARC-Type").alias("record_type"),
        F.regexp_extract(header("WARC-Record-ID"), r"<urn:page:(-?\d+)>", 1).try_cast("long").alias("page_id"),
        header("WARC-Target-URI").alias("url"),
        F.regexp_extract(header("WARC-Payload-Digest"), r"^sha256:([0-9a-f]{64})$", 1).alias("declared_digest"),
        header("X-Payload-Length").try_cast("long").alias("declared_bytes"),
        F.regexp_extract(header("WARC-Refers-To"), r"<urn:page:(-?\d+)>", 1).try_cast("long").alias("refers_to"),
        F.when(F.col("head_bytes") + F.col("length") <= F.col("whole"), F.sha2(body, 256)).alias("content_sha256"),
    )


def with_offsets(p: DataFrame) -> DataFrame:
    """Byte offset of each piece's magic: running sums within a split, then over a file's splits."""
    step = F.col("bytes") + len(MAGIC)
    split = Window.partitionBy("file", "split")
    inside = F.sum(step).over(split.orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - step
    sums = p.groupBy("file", "split").agg(F.sum(step).alias("sum"))
    base = sums.withColumn("base", F.sum("sum").over(Window.partitionBy("file").orderBy("split")) - F.col("sum")).drop("sum")
    # The first piece of a file has no magic before it: everything shifts by its length.
    rows = p.withColumn("inside", inside).join(base, ["file", "split"])
    return rows.withColumn("offset", F.col("base") + F.col("inside") - len(MAGIC)).drop("base", "inside")


def _split_exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where the chain from each candidate of a split leaves it."""
    pdf = pdf.sort_values("offset", ascending=False)
    leaves: dict[int, int] = {}
    for at, to in zip(pdf["offset"].tolist(), pdf["successor"].tolist(), strict=True):
        leaves[at] = leaves.get(to, to)
    return pd.DataFrame({"file": pdf["file"], "offset": pdf["offset"], "leaves": list(leaves.values())})


def _on_chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a split that the chain from its entry passes."""
    to = dict(zip(pdf["offset"].tolist(), pdf["successor"].tolist(), strict=True))
    at, seen = pdf["entry"].iloc[0], set()
    while at in to:
        seen.add(at)
        at = to[at]
    return pdf.loc[pdf["offset"].isin(seen), ["file", "offset"]]


def chain(candidates: DataFrame, rounds: int = 64) -> DataFrame:
    """(file, offset) of the candidates (file, split, offset, successor) reached from offset 0."""
    narrow = candidates.select("file", "split", "offset", "successor")
    jumps = materialise(narrow.groupBy("file", "split").applyInPandas(_split_exits, "file string, offset long, leaves long"), "jumps")
    reached = jumps.where("offset = 0").select("file", "offset")
    count = reached.count()
    for _ in range(rounds):
        # Everything reached jumps as far as is known, and the jumps double.
        reached = materialise(reached.unionByName(reached.join(jumps, ["file", "offset"]).select("file", F.col("leaves").alias("offset"))).distinct(), "reached")
        now = reached.count()
        if now == count:
            break
        count = now
        far = jumps.select("file", F.col("offset").alias("leaves"), F.col("leaves").alias("next"))
        jumps = materialise(jumps.join(far, ["file", "leaves"], "left").select("file", "offset", F.coalesce("next", "leaves").alias("leaves")), "jumps")
    # A file's end is among the reached offsets and no candidate; each split has one entry at most.
    entries = reached.join(narrow, ["file", "offset"]).groupBy("file", "split").agg(F.min("offset").alias("entry"))
    return narrow.join(entries, ["file", "split"]).groupBy("file", "split").applyInPandas(_on_chain, "file string, offset long")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: file, offset, record_type, page_id, url, refers_to, payload_bytes, payload_digest, content_sha256.

    ``content_sha256`` is that of the record's own content, ``payload_digest``
    and ``payload_bytes`` are those of the full payload: the content's for a
    response, the declared ones for a revisit.
    """
    found = materialise(with_offsets(parsed(pieces(spark, path))), "warc-pieces")
    successor = F.col("offset") + len(MAGIC) + F.col("head_bytes") + F.col("length") + len(END)
    candidates = found.where("offset >= 0 and length is not null and length >= 0").withColumn("successor", successor).where(F.col("successor") <= F.col("file_size"))
    records = materialise(candidates.join(chain(candidates), ["file", "offset"]), "warc-records")
    # A record whose payload has the magic in it: its first piece is shorter than it says.
    broken = records.where("bytes + 10 < successor - offset")
    if not broken.isEmpty():
        parts = materialise(_parts(found, records), "warc-parts")
        key = ["file", "bytes", "piece"]
        again = pieces(spark, path).withColumn("bytes", F.octet_length("value").cast("long")).select(*key, "value")
        text = again.join(parts.select(*key).distinct(), key, "left_semi").dropDuplicates(key)
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "value"))), lambda x: x["value"]), MAGIC)
        whole = text.join(parts, key).groupBy("file", F.col("start").alias("offset")).agg(joined.alias("value"), F.first("head_bytes").alias("head_bytes"), F.first("length").alias("length"))
        whole = whole.select("file", "offset", F.sha2(F.substring(F.col("value").cast("binary"), (F.col("head_bytes") + 1).cast("int"), F.col("length").cast("int")), 256).alias("sha"))
        records = records.join(whole, ["file", "offset"], "left").withColumn("content_sha256", F.coalesce("sha", "content_sha256"))
    response = F.col("record_type") == "response"
    return records.select(
        "file",
        "offset",
        "record_type",
        "page_id",
        "url",
        "refers_to",
        F.when(response, F.col("length")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(response, F.col("content_sha256")).otherwise(F.col("declared_digest")).alias("payload_digest"),
        "content_sha256",
    )


def _parts(found: DataFrame, records: DataFrame) -> DataFrame:
    """(file, bytes, piece, offset, start, head_bytes, length): the pieces of records cut by a magic in their payload.

    The record a piece belongs to is the last one that starts at or before it: within the piece's split
    by a window, else the last of the splits before, from a row for each split.
    """
    starts = records.select("file", "offset", F.struct(F.col("offset").alias("start"), "successor", "head_bytes", "length", "bytes").alias("r"))
    all_pieces = found.where("offset >= 0").select("file", "split", "bytes", "piece", "offset").join(starts, ["file", "offset"], "left")
    last = all_pieces.groupBy("file", "split").agg(F.max("r").alias("r"))
    before = F.last("r", ignorenulls=True).over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    carried = last.select("file", "split", before.alias("carried"))
    within = F.last("r", ignorenulls=True).over(Window.partitionBy("file", "split").orderBy("offset"))
    owned = all_pieces.withColumn("r", within).join(carried, ["file", "split"]).withColumn("r", F.coalesce("r", "carried"))
    return owned.where("offset < r.successor and r.bytes + 10 < r.successor - r.start").select("file", "bytes", "piece", "offset", "r.start", "r.head_bytes", "r.length")
