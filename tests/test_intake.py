"""Upload intake: gate, keys, first-wins dedup, insert-or-get."""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from folio.operators import intake
from folio.schemas import UPLOAD

T0 = dt.datetime(2024, 1, 1)


def _uploads(spark, items):
    rows = [(p, T0 + dt.timedelta(seconds=i), len(b), bytearray(b)) for i, (p, b) in enumerate(items)]
    return spark.createDataFrame(rows, UPLOAD)


def test_classify_size_then_magic(spark):
    df = _uploads(
        spark,
        [
            ("a/ok.pdf", b"%PDF-1.7 body"),
            ("a/nope.pdf", b"nope"),
            ("a/short.pdf", b"%PD"),
            ("a/empty.pdf", b""),
            ("a/big.pdf", b"%PDF-" + b"x" * 100),
            ("a/bigbad.pdf", b"y" * 200),
        ],
    )
    got = {r.path: r.reject_reason for r in intake.classify_uploads(df, max_bytes=64).collect()}
    assert got == {
        "a/ok.pdf": None,
        "a/nope.pdf": intake.REJECT_NOT_PDF,
        "a/short.pdf": intake.REJECT_NOT_PDF,
        "a/empty.pdf": intake.REJECT_NOT_PDF,
        "a/big.pdf": intake.REJECT_TOO_LARGE,
        "a/bigbad.pdf": intake.REJECT_TOO_LARGE,
    }


def test_keys(spark):
    body = b"%PDF-abc"
    df = intake.with_keys(_uploads(spark, [("x/p.pdf", body)]))
    r = df.collect()[0]
    h = hashlib.sha256(body).hexdigest()
    assert r.content_hash == h
    assert r.raw_key == f"raw/{h}.pdf"
    assert r.id == hashlib.sha256(f"paper:{h}".encode()).hexdigest()[:32]
    assert len(r.id) == 32 and all(c in "0123456789abcdef" for c in r.id)


def test_dedup_first_wins_and_no_content_in_shuffle(spark):
    df = intake.with_keys(
        _uploads(spark, [("z/late-name.pdf", b"%PDF-same"), ("a/early.pdf", b"%PDF-same"), ("b/other.pdf", b"%PDF-other")])
    )
    d = intake.dedup_batch(df)
    got = {r.content_hash: (r.path, r.n_uploads) for r in d.collect()}
    same = hashlib.sha256(b"%PDF-same").hexdigest()
    # earliest modification time wins, not the smallest path
    assert got[same] == ("z/late-name.pdf", 2)
    plan = d._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Exchange" in line:
            assert "content" not in line.replace("content_hash", "")


def test_insert_or_get(spark):
    df = intake.with_keys(
        _uploads(spark, [("a.pdf", b"%PDF-known"), ("b.pdf", b"%PDF-new"), ("c.pdf", b"%PDF-new")])
    )
    known = intake.paper_rows(intake.dedup_batch(df.where(F.col("path") == "a.pdf")))
    out = {r.path: r.asDict() for r in intake.resolve_uploads(df, known).collect()}
    assert out["a.pdf"]["outcome"] == intake.OUTCOME_EXISTING
    assert out["b.pdf"]["outcome"] == intake.OUTCOME_ACCEPTED
    assert out["c.pdf"]["outcome"] == intake.OUTCOME_EXISTING
    assert out["b.pdf"]["id"] == out["c.pdf"]["id"]
    assert all(v["status"] == "queued" for v in out.values())
    new = intake.new_papers(intake.dedup_batch(df), known).collect()
    assert [r.path for r in new] == ["b.pdf"]


def test_paper_rows_defaults(spark):
    df = intake.with_keys(_uploads(spark, [("dir/sub/paper one.pdf", b"%PDF-q")]))
    r = intake.paper_rows(intake.dedup_batch(df)).collect()[0]
    assert r.source_type == "upload" and r.source_ref == "paper one.pdf" and r.status == "queued"
    assert r.schema_version is None and r.result_key is None and r.error is None
    assert r.created_at == r.updated_at
