"""Status log and fold: the UPDATE semantics, audit and lookups."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from folio.operators import lifecycle
from folio.schemas import PAPERS, STATUS_LOG

T0 = dt.datetime(2024, 1, 1)


def _papers(spark, ids):
    rows = [(i, f"h{i}", "upload", None, "queued", f"raw/h{i}.pdf", None, None, None, T0, T0) for i in ids]
    return spark.createDataFrame(rows, PAPERS)


def _log(spark, steps):
    """steps: list of (paper_id, to_status, error)."""
    rows = []
    for n, (pid, st, err) in enumerate(steps):
        at = T0 + dt.timedelta(minutes=n + 1)
        rows.append(
            (pid, at, n, st, "1.0" if st == "done" else None, f"result/{pid}.json" if st == "done" else None,
             err if st == "failed" else None)
        )
    return spark.createDataFrame(rows, STATUS_LOG)


SEQUENCES = [
    ([], "queued", False, None),
    (["running"], "running", False, None),
    (["running", "failed"], "failed", False, "e"),
    (["running", "failed", "running"], "running", False, "e"),
    (["running", "failed", "running", "done"], "done", True, None),
    (["running", "done", "running"], "running", True, None),
    (["running", "done", "failed"], "failed", True, "e"),
]


@pytest.mark.parametrize("steps,status,has_result,error", SEQUENCES)
def test_fold_sequences(spark, steps, status, has_result, error):
    papers = _papers(spark, ["p"])
    log = _log(spark, [("p", s, "e") for s in steps] + [("ghost", "done", None)])
    rows = lifecycle.fold_status(papers, log, with_attempts=True).collect()
    assert len(rows) == 1, "updates of unknown ids must not create rows"
    r = rows[0]
    assert r.status == status
    assert (r.schema_version == "1.0") == has_result
    assert (r.result_key == "result/p.json") == has_result
    assert r.error == error
    assert r.attempts == steps.count("running")
    assert r.updated_at == (T0 + dt.timedelta(minutes=len(steps)) if steps else T0)


def test_same_timestamp_ordered_by_seq(spark):
    papers = _papers(spark, ["p"])
    rows = [("p", T0, 5, "done", "1.0", "result/p.json", None), ("p", T0, 4, "running", None, None, None)]
    r = lifecycle.fold_status(papers, spark.createDataFrame(rows, STATUS_LOG)).collect()[0]
    assert r.status == "done"


def test_writers(spark):
    ids = spark.createDataFrame([("p",)], "paper_id string")
    at = F.lit(T0).cast("timestamp")
    run = lifecycle.mark_running(ids, at, 0).collect()[0]
    assert (run.to_status, run.schema_version, run.result_key, run.error) == ("running", None, None, None)
    done = lifecycle.mark_done(ids, at, 1).collect()[0]
    assert (done.to_status, done.schema_version, done.result_key, done.error) == ("done", "1.0", "result/p.json", None)
    errs = spark.createDataFrame([("p", "boom")], "paper_id string, error string")
    failed = lifecycle.mark_failed(errs, at, 2).collect()[0]
    assert (failed.to_status, failed.schema_version, failed.error) == ("failed", None, "boom")


def test_applicable_drops_unknown_and_early(spark):
    papers = _papers(spark, ["p"]).withColumn("created_at", F.lit(T0 + dt.timedelta(minutes=2)))
    log = _log(spark, [("p", "running", None), ("p", "done", None), ("q", "done", None)])
    kept = lifecycle.applicable(log, papers).collect()
    assert [(r.paper_id, r.to_status) for r in kept] == [("p", "done")]


def test_fold_since_created_equals_the_fold_of_applicable_rows(spark):
    rows, start = [], {}
    steps = ["running", "done", "failed", "running", "failed", "done"]
    for n in range(60):  # each paper has its own calls, some or all of them before it exists
        pid = f"p{n}"
        start[pid] = n % 8
        for k in range(n % 7):
            st = steps[(n * 5 + k * k) % 6]
            done = st == "done"
            rows.append((pid, T0 + dt.timedelta(minutes=k - k % 2), k, st, "1.0" if done else None, f"r{n}.{k}" if done else None, f"e{k}" if st == "failed" else None))
    log = spark.createDataFrame(rows + [("ghost", T0, 0, "done", "1.0", "r", None)], STATUS_LOG)
    at = F.lit(T0) + F.make_dt_interval(mins=F.element_at(F.create_map(*[F.lit(v) for kv in start.items() for v in kv]), F.col("id")))
    papers = _papers(spark, list(start)).withColumn("created_at", at)
    whole = lifecycle.fold_status(papers, log, since_created=True)
    filtered = lifecycle.fold_status(papers, lifecycle.applicable(log, papers))
    assert sorted(map(str, whole.collect())) == sorted(map(str, filtered.collect()))
    assert sorted(map(str, whole.collect())) != sorted(map(str, lifecycle.fold_status(papers, log).collect()))
    with pytest.raises(ValueError, match="applicable"):
        lifecycle.fold_status(papers, log, with_attempts=True, since_created=True)


def test_pending(spark):
    papers = _papers(spark, ["a", "b"])
    folded = lifecycle.fold_status(papers, _log(spark, [("a", "running", None)]))
    assert [r.id for r in lifecycle.pending(folded).collect()] == ["b"]


def test_lookups_and_view(spark):
    papers = _papers(spark, ["a", "b"])
    assert [r.id for r in lifecycle.get_paper(papers, "a").collect()] == ["a"]
    assert lifecycle.get_paper(papers, "zzz").count() == 0
    assert [r.id for r in lifecycle.get_paper_by_hash(papers, "hb").collect()] == ["b"]
    ids = spark.createDataFrame([("a",), ("nope",)], "id string")
    assert [r.id for r in lifecycle.get_papers(papers, ids).collect()] == ["a"]
    folded = lifecycle.fold_status(papers, _log(spark, [("a", "done", None)]))
    view = {r.id: r.json for r in lifecycle.paper_view(folded).collect()}
    assert view["a"] == '{"id":"a","status":"done","content_hash":"ha","result_key":"result/a.json"}'
    assert view["b"] == '{"id":"b","status":"queued","content_hash":"hb"}'


def test_audit_planted_faults(spark):
    good = [(f"i{n}", f"h{n}", "upload", None, "queued", "raw", None, None, None, T0, T0) for n in range(3)]
    faults = [
        ("i0", "hx", "upload", None, "queued", "raw", None, None, None, T0, T0),  # duplicate id
        ("iy", "h1", "upload", None, "queued", "raw", None, None, None, T0, T0),  # duplicate hash
        ("iz", "hz", "email", None, "queued", "raw", None, None, None, T0, T0),  # bad source_type
        ("iw", "hw", "upload", None, "parsing", "raw", None, None, None, T0, T0),  # bad status
        ("iv", "hv", "upload", None, "queued", None, None, None, None, T0, T0),  # NULL raw_key
    ]
    schema = PAPERS.fromJson(PAPERS.jsonValue())
    for f in schema.fields:
        f.nullable = True
    got = {r.rule: r.violations for r in lifecycle.audit_papers(spark.createDataFrame(good + faults, schema)).collect()}
    assert got["id unique"] == 1
    assert got["content_hash unique"] == 1
    assert got["source_type in domain"] == 1
    assert got["status in domain"] == 1
    assert got["raw_key not null"] == 1
    assert got["id not null"] == 0 and got["created_at not null"] == 0
