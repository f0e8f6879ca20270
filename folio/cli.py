"""Command line for the batch jobs and streams (``python -m folio ...``).

The service's entry points map to commands over a paper store:

=====================  ==============================================
service                command
=====================  ==============================================
POST /papers           ``submit --store S --uploads DIR --batch N``
GET /papers/{id}       ``get --store S --id ID`` (or ``--hash H``)
parse worker           ``process --store S --tei PATH --batch N``, or as a
                       stream ``stream-parse --store S --tei PATH --checkpoint C``
(operations)           ``compact --store S``, ``stuck --store S``
upload stream          ``stream-intake --store S --uploads DIR --checkpoint C``
live status            ``stream-status --store S --out DIR --checkpoint C``
=====================  ==============================================

Every command runs on the active Spark session (``spark-submit`` supplies
one on a cluster); replies and papers are printed as JSON lines.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from folio.operators import lifecycle
from folio.plans.process import process
from folio.plans.submit import submit
from folio.schemas import MAX_UPLOAD_BYTES
from folio.sources import tei as tei_source
from folio.sources import uploads as upload_source
from folio.sources.store import PaperStore
from folio.streaming import intake as intake_stream
from folio.streaming import parse as parse_stream
from folio.streaming import status as status_stream


def _print_json(df, limit: int | None = None) -> None:
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("j"))
    if limit is not None:
        rows = rows.limit(limit)
    for r in rows.toLocalIterator():
        print(r.j)


def _tei(spark: SparkSession, path: str, fmt: str):
    """TEI and the column that names its paper: files are named by paper id, tables carry the hash."""
    if fmt == "xml":
        return tei_source.scan_tei_files(spark, path), "paper_id"
    return tei_source.scan_tei(spark, path, fmt), "source_hash"


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    ap = argparse.ArgumentParser(prog="folio")
    sub = ap.add_subparsers(dest="cmd", required=True)

    p = sub.add_parser("submit", help="register a folder of uploads as one batch")
    p.add_argument("--store", required=True)
    p.add_argument("--uploads", required=True)
    p.add_argument("--batch", type=int, required=True)
    p.add_argument("--max-bytes", type=int, default=MAX_UPLOAD_BYTES)
    p.add_argument("--replies", help="folder for the replies, a JSON line per upload; without it their numbers are printed")

    p = sub.add_parser("process", help="parse the pending papers from their TEI")
    p.add_argument("--store", required=True)
    p.add_argument("--tei", required=True, help="TEI table (source_hash, tei) or folder of .xml files")
    p.add_argument("--tei-format", default="parquet", choices=["parquet", "json", "orc", "xml"])
    p.add_argument("--batch", type=int, required=True)
    p.add_argument("--retry-failed", action="store_true", help="parse failed papers again")
    p.add_argument("--lease", type=int, default=lifecycle.RETRY.lease, help="seconds that a paper stays with a job that does not end")
    p.add_argument("--backoff", type=int, default=lifecycle.RETRY.backoff, help="seconds before the second attempt, doubled for each later one")
    p.add_argument("--max-attempts", type=int, default=lifecycle.RETRY.attempts)

    p = sub.add_parser("stuck", help="papers whose job was lost: running beyond their lease (the next process takes them up)")
    p.add_argument("--store", required=True)

    p = sub.add_parser("stream-parse", help="parse papers as their TEI arrives (Structured Streaming)")
    p.add_argument("--store", required=True)
    p.add_argument("--tei", required=True, help="Parquet table (paper_id, source_hash, tei)")
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--max-files-per-trigger", type=int, default=100)
    p.add_argument("--available-now", action="store_true", help="process what is there, then stop")

    p = sub.add_parser("stream-status", help="keep the live status of every paper (Structured Streaming)")
    p.add_argument("--store", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--max-files-per-trigger", type=int, default=100)
    p.add_argument("--available-now", action="store_true", help="process what is there, then stop")

    p = sub.add_parser("get", help="the public view of a paper, by id or content hash")
    p.add_argument("--store", required=True)
    g = p.add_mutually_exclusive_group(required=True)
    g.add_argument("--id")
    g.add_argument("--hash")

    p = sub.add_parser("compact", help="fold all batches written so far into a new base")
    p.add_argument("--store", required=True)

    p = sub.add_parser("stream-intake", help="register uploads as they arrive (Structured Streaming)")
    p.add_argument("--store", required=True)
    p.add_argument("--uploads", required=True)
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--max-files-per-trigger", type=int, default=1000)
    p.add_argument("--max-bytes", type=int, default=MAX_UPLOAD_BYTES)
    p.add_argument("--compact-every", type=int, default=None)
    p.add_argument("--available-now", action="store_true", help="process what is there, then stop")

    args = ap.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    store = PaperStore(spark, args.store)

    if args.cmd == "submit":
        up = upload_source.list_uploads(spark, args.uploads)
        replies = submit(store, up, args.batch, args.max_bytes)
        if args.replies:
            replies.select(F.to_json(F.struct(*replies.columns)).alias("value")).write.mode("overwrite").text(args.replies)
        else:
            _print_json(replies.groupBy("outcome").agg(F.count(F.lit(1)).alias("uploads")))
    elif args.cmd == "process":
        tei, key = _tei(spark, args.tei, args.tei_format)
        retry = lifecycle.Retry(lease=args.lease, backoff=args.backoff, attempts=args.max_attempts)
        out = process(store, tei, args.batch, tei_key=key, retry_failed=args.retry_failed, retry=retry)
        _print_json(out.groupBy("status").agg(F.count(F.lit(1)).alias("papers")))
    elif args.cmd == "stream-parse":
        stream = parse_stream.stream_tei(spark, args.tei, args.max_files_per_trigger)
        parse_stream.start_parse(stream, store, args.checkpoint, args.available_now).awaitTermination()
    elif args.cmd == "stream-status":
        log = status_stream.stream_store_log(spark, store, args.max_files_per_trigger)
        status_stream.start_status(log, args.out, args.checkpoint, args.available_now).awaitTermination()
    elif args.cmd == "get":
        found = store.paper(paper_id=args.id, content_hash=args.hash)
        view = lifecycle.paper_view(found).select("json").limit(1).collect()
        if not view:
            print(json.dumps({"error": "paper not found"}))
            return 1
        print(view[0].json)
    elif args.cmd == "stuck":
        _print_json(lifecycle.stuck(store.scan_papers(with_attempts=True)).select("id", "attempts", "until"))
    elif args.cmd == "compact":
        print(json.dumps({"base_version": store.compact()}))
    elif args.cmd == "stream-intake":
        stream = intake_stream.stream_uploads(spark, args.uploads, args.max_files_per_trigger)
        q = intake_stream.start_intake(
            stream,
            store,
            args.checkpoint,
            max_bytes=args.max_bytes,
            available_now=args.available_now,
            compact_every=args.compact_every,
        )
        q.awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())
