"""Plan shape: partial aggregation before every shuffle of a hot key, pushdown, no Python."""

from __future__ import annotations

import datetime as dt
from collections import Counter

from pyspark.sql import functions as F

from folio.operators import intake, lifecycle
from folio.schemas import PAPERS, STATUS_LOG, UPLOAD

T0 = dt.datetime(2024, 1, 1)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _partial_before_exchange(plan: str) -> bool:
    """Some partial aggregate sits below a hash exchange."""
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            if any("partial_" in later for later in lines[i + 1 :]):
                return True
    return False


def _skewed_log(spark, n=3000):
    # one paper holds a third of all rows
    rows = [("hot" if i % 3 == 0 else f"p{i}", T0 + dt.timedelta(seconds=i), i, "running", None, None, None) for i in range(n)]
    return spark.createDataFrame(rows, STATUS_LOG)


def test_fold_aggregates_partially_and_is_correct_under_skew(spark):
    log = _skewed_log(spark)
    papers = spark.createDataFrame([("hot", "h", "upload", None, "queued", "r", None, None, None, T0, T0)], PAPERS)
    s = lifecycle.summarise_log(log)
    assert _partial_before_exchange(_plan(s))
    r = lifecycle.fold_status(papers, log, with_attempts=True).collect()[0]
    assert r.attempts == 1000 and r.status == "running"


def test_dedup_aggregates_partially(spark):
    rows = [(f"f{i}", T0 + dt.timedelta(seconds=i), 8, bytearray(b"%PDF-hot" if i % 3 == 0 else f"%PDF-{i}".encode())) for i in range(300)]
    keyed = intake.with_keys(spark.createDataFrame(rows, UPLOAD))
    d = intake.dedup_batch(keyed)
    assert _partial_before_exchange(_plan(d))
    hot = [r for r in d.collect() if r.n_uploads > 1]
    assert len(hot) == 1 and hot[0].n_uploads == 100 and hot[0].path == "f0"


def test_lookups_dedup_before_shuffle(spark):
    papers = spark.createDataFrame([(f"i{i}", f"h{i}", "upload", None, "queued", "r", None, None, None, T0, T0) for i in range(10)], PAPERS)
    ids = spark.createDataFrame([("i1",)] * 500 + [("i2",), ("zz",)], "id string")
    out = lifecycle.get_papers(papers, ids)
    assert sorted(r.id for r in out.collect()) == ["i1", "i2"]
    assert "partial" in _plan(out) or "HashAggregate" in _plan(out)


def test_no_python_in_operator_queries(spark):
    import __spark_entry__ as e

    from support import SF_SMALL

    for name, q in e.queries().items():
        if name.startswith(("stream_", "process_")):
            continue
        plan = _plan(q(spark, SF_SMALL))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_scan_prunes_columns(spark):
    import __spark_entry__ as e

    from support import SF_SMALL

    plan = _plan(e.queries()["engine_features"](spark, SF_SMALL))
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in plan
    plan = _plan(e.queries()["status_fold"](spark, SF_SMALL))
    assert "value" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_batch_lookup_probes_the_big_table(spark):
    import tempfile

    big = spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("content_hash"))
    # As in ``submit``: the batch's keys are a written table, so the planner
    # knows its size from the files and plans the broadcast statically.
    path = tempfile.mkdtemp(prefix="folio-batch-") + "/keys"
    spark.createDataFrame([(f"{i:064x}",) for i in range(5)], "content_hash string").write.parquet(path)
    batch = spark.read.parquet(path)
    out = intake.known_for(big, batch)
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" in final and "LeftSemi" in final and "BuildRight" in final
    # the large side is scanned and probed in place: no hash exchange over it
    assert "Exchange hashpartitioning(content_hash" not in final.split("BroadcastExchange")[0]


def test_hot_paper_is_salted_and_results_match(spark):
    from folio.operators import skew

    n = 6000
    rows = [("hot" if i % 3 == 0 else f"p{i % 50}", T0 + dt.timedelta(seconds=i), i, "running", None, None, None) for i in range(n)]
    log = spark.createDataFrame(rows, STATUS_LOG)
    ids = ["hot"] + [f"p{i}" for i in range(50)] + ["ghost"]
    papers = spark.createDataFrame(
        [(p, f"h{p}", "upload", None, "queued", "r", None, None, None, T0 + dt.timedelta(seconds=10), T0) for p in ids], PAPERS
    )
    hot = skew.hot_keys(log, "paper_id", rows_per_salt=300).collect()
    assert [tuple(r) for r in hot] == [("hot", 7)]
    salted = lifecycle.applicable(log, papers, rows_per_salt=300)
    plain = log.join(
        papers.select(F.col("id").alias("pid"), "created_at"),
        (F.col("paper_id") == F.col("pid")) & (F.col("at") >= F.col("created_at")),
        "left_semi",
    )
    assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, plain.collect()))
    # a later fold of the salted output shuffles again, after partial aggregation
    assert _partial_before_exchange(_plan(lifecycle.summarise_log(salted)))


def test_fold_reads_its_log_once(spark):
    import __spark_entry__ as e

    from support import SF_SMALL

    for name in ("status_fold", "paper_view"):
        plan = _plan(e.queries()[name](spark, SF_SMALL))
        assert plan.count("FileScan") == 2, name  # the papers and the log, each once


def test_uploads_of_a_hot_hash_are_split(spark):
    """Half of all uploads are one file: the join that answers them deals them to many tasks."""
    import tempfile

    n = 20_000
    path = tempfile.mkdtemp(prefix="folio-hot-") + "/keys"
    i = F.col("id")
    h = F.sha2(F.when(i % 2 == 0, F.lit("hot")).otherwise(i.cast("string")), 256)
    keys = spark.range(n).select(
        F.concat(F.lit("f"), i.cast("string"), F.lit(".pdf")).alias("path"),
        F.timestamp_seconds(i).alias("modificationTime"),
        F.lit(8).cast("long").alias("length"),
        h.alias("content_hash"),
    )
    keys.write.parquet(path)
    keys = spark.read.parquet(path)
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        known = intake.paper_rows(intake.dedup_batch(keys.where("path = 'f1.pdf'")))
        out = intake.resolve_uploads(keys, known, rows_per_salt=n // 100)
        task = F.spark_partition_id().alias("task")
        rows = out.select("path", "content_hash", "outcome", task).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(rows) == len({r.path for r in rows}) == n
    tasks = Counter(r.task for r in rows)
    assert max(tasks.values()) < n // 2  # unsplit, one task has the hot hash and its share of the others
    odd = n // 2
    outcomes = Counter(r.outcome for r in rows)
    assert outcomes == {intake.OUTCOME_ACCEPTED: odd, intake.OUTCOME_EXISTING: n - odd}
    assert {r.path for r in rows if r.outcome == intake.OUTCOME_ACCEPTED} >= {"f0.pdf", "f3.pdf"}
