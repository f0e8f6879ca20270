"""Paper lifecycle: lookups, constraint audit, status log and its fold.

The three UPDATEs of the ``papers`` table (running / done / failed) become
rows appended to a status log ``(paper_id, at, seq, to_status,
schema_version, result_key, error)``. The current table is the fold of the
inserted rows with that log: per paper, each column takes its value from
the latest log row (ordered by ``(at, seq)``) that sets it:

=========  ==========================  =================================
column     set by                      value
=========  ==========================  =================================
status     every row                   ``to_status``
sv, rk     done                        schema version, result key
error      done (clears), failed       NULL on done, the message on failed
updated_at every row                   ``at`` of the latest row
=========  ==========================  =================================

There is no transition guard: ``done -> running`` is legal, as an UPDATE
keyed only by id is. An update for an id with no paper changes nothing.

The fold is mergeable: a summary keeps, besides each value, the key that set
it, so summaries of any parts of the log, in any order, merge into the summary
of the whole (``merge_summaries``); log rows are summaries of one row. A
compacted store keeps summaries, so late rows count by their time and attempts
add up.

A ``running`` row is a lease: it holds its paper until ``until``. A worker that
is lost leaves a lease that runs out, after which the paper is pending again;
a failed paper is tried again after a time that doubles with its attempts
(``Retry``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators import skew
from folio.operators.intake import result_key
from folio.schemas import SCHEMA_VERSION, SOURCE_TYPES, STATUSES, SUMMARY, UNTIL


# ----------------------------------------------------------- O11-O13 reads --


def get_paper(papers: DataFrame, paper_id: str) -> DataFrame:
    """The paper with this id; an empty result is the "not found" answer."""
    return papers.where(F.col("id") == F.lit(paper_id))


def get_papers(papers: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """O11, batch form: papers whose id is in ``ids`` (left-semi join).

    The lookups are de-duplicated first (a partial aggregate), so an id asked
    for millions of times is one row per map task before the shuffle.
    """
    return papers.join(ids.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")


def get_paper_by_hash(papers: DataFrame, content_hash: str) -> DataFrame:
    """Lookup by content hash."""
    return papers.where(F.col("content_hash") == F.lit(content_hash))


def get_papers_by_hash(papers: DataFrame, hashes: DataFrame, hash_col: str = "content_hash") -> DataFrame:
    """O12, batch form (lookups de-duplicated map-side, as in ``get_papers``)."""
    return papers.join(hashes.select(F.col(hash_col).alias("content_hash")).distinct(), "content_hash", "left_semi")


def paper_view(papers: DataFrame, with_json: bool = True) -> DataFrame:
    """The public reply ``{id, status, content_hash, result_key?}``.

    ``result_key`` is left out of the JSON when it is NULL or empty.
    """
    rk = F.when(F.col("result_key") != F.lit(""), F.col("result_key"))
    out = papers.select("id", "status", "content_hash", rk.alias("result_key"))
    if with_json:
        out = out.withColumn("json", F.to_json(F.struct("id", "status", "content_hash", "result_key")))
    return out


# ----------------------------------------------------------- O14 audit ------


def audit_papers(papers: DataFrame) -> DataFrame:
    """Violations of the table constraints, one row per rule, from one scan.

    One aggregate over three grouping sets: all rows for the row rules (NOT
    NULL, CHECK domains), each id and each hash for the two keys, whose
    violations are ``rows - distinct keys`` over non-NULL keys. Only the keys and the
    rules' outcomes reach it, reduced in the tasks before the shuffle.
    """
    not_null = ("id", "content_hash", "source_type", "status", "raw_key", "created_at", "updated_at")
    rules = {f"{c} not null": F.col(c).isNull() for c in not_null}
    rules["source_type in domain"] = ~F.col("source_type").isin(*SOURCE_TYPES)
    rules["status in domain"] = ~F.col("status").isin(*STATUSES)
    broken = [F.coalesce(e, F.lit(False)).cast("long").alias(f"r{i}") for i, e in enumerate(rules.values())]
    rows = papers.select("id", "content_hash", *broken)
    sums = [F.sum(f"r{i}").alias(f"r{i}") for i in range(len(rules))]
    keys = ("id", "content_hash")
    grouped = rows.groupingSets([[F.col("id")], [F.col("content_hash")], []], *keys).agg(
        *[F.grouping(k).alias(f"no_{k}") for k in keys], F.count(F.lit(1)).alias("n"), *sums
    )
    of_id = (F.col("no_id") == 0) & F.col("id").isNotNull()
    of_hash = (F.col("no_content_hash") == 0) & F.col("content_hash").isNotNull()
    of_all = (F.col("no_id") == 1) & (F.col("no_content_hash") == 1)
    counts = {name: F.max(F.when(of_all, F.col(f"r{i}"))) for i, name in enumerate(rules)}
    counts["id unique"] = F.sum(F.when(of_id, F.col("n") - 1))
    counts["content_hash unique"] = F.sum(F.when(of_hash, F.col("n") - 1))
    one = grouped.agg(*[F.coalesce(e, F.lit(0)).alias(f"c{i}") for i, e in enumerate(counts.values())])
    entries = [F.struct(F.lit(name).alias("rule"), F.col(f"c{i}").alias("violations")) for i, name in enumerate(counts)]
    return one.select(F.inline(F.array(*entries)))


# ----------------------------------------------------------- O19 writers ----


def log_rows(
    df: DataFrame,
    to_status: Column,
    at: Column | None = None,
    seq: Column | int = 0,
    error: Column | None = None,
    result_key_col: Column | None = None,
    until: Column | None = None,
) -> DataFrame:
    """Status-log rows for UPDATEs whose target status may differ per row.

    ``to_status`` decides which columns the row sets: ``done`` sets the
    schema version and result key and clears ``error``; ``failed`` sets
    ``error``; ``running`` sets neither. ``until`` is the end of a lease or of
    the wait for the next attempt.
    """
    pid = F.col("paper_id").cast("string")
    done = to_status == F.lit("done")
    rk = result_key_col if result_key_col is not None else result_key(pid)
    err = error if error is not None else F.lit(None)
    return df.select(
        pid.alias("paper_id"),
        _at(at).alias("at"),
        _seq(seq).cast("long").alias("seq"),
        to_status.alias("to_status"),
        F.when(done, F.lit(SCHEMA_VERSION)).alias("schema_version"),
        F.when(done, rk).alias("result_key"),
        F.when(to_status == F.lit("failed"), err).cast("string").alias("error"),
        (until if until is not None else F.lit(None)).cast("timestamp").alias(UNTIL.name),
    )


def _at(at: Column | None) -> Column:
    return at if at is not None else F.current_timestamp()


def _seq(seq: Column | int) -> Column:
    return seq if isinstance(seq, Column) else F.lit(seq)


def mark_running(ids: DataFrame, at: Column | None = None, seq: Column | int = 0, until: Column | None = None) -> DataFrame:
    """Status only; ``error`` is left as it is. ``until``: when the lease runs out."""
    return log_rows(ids, F.lit("running"), at, seq, until=until)


def mark_done(ids: DataFrame, at: Column | None = None, seq: Column | int = 1) -> DataFrame:
    """Schema version and result key set, ``error`` cleared."""
    rk = F.col("result_key") if "result_key" in ids.columns else None
    return log_rows(ids, F.lit("done"), at, seq, result_key_col=rk)


def mark_failed(errors: DataFrame, at: Column | None = None, seq: Column | int = 1, until: Column | None = None) -> DataFrame:
    """``error`` set; schema version and result key are left as they are. ``until``: when to try again."""
    return log_rows(errors, F.lit("failed"), at, seq, error=F.col("error"), until=until)


def applicable(updates: DataFrame, papers: DataFrame, rows_per_salt: int = skew.ROWS_PER_SALT) -> DataFrame:
    """Updates that hit a row: the paper exists and was created at or before ``at``.

    This is ``UPDATE ... WHERE id = $1`` evaluated at the time of the update;
    an update of no row is dropped, not an error. The join is salted for
    papers with many updates (``operators.skew``): one salt for each
    ``rows_per_salt`` of them.
    """
    created = papers.select(F.col("id").alias("paper_id"), F.col("created_at").alias("_created"))
    return skew.salted_semi_join(
        updates,
        created,
        "paper_id",
        condition=F.col("at") >= F.col("_created"),
        salt_source=F.xxhash64(F.col("seq")),
        rows_per_salt=rows_per_salt,
    )


# ----------------------------------------------------------- O20-O22 fold ---


def summary_rows(log: DataFrame) -> DataFrame:
    """Each log row as the summary of itself (``schemas.SUMMARY``): a projection."""
    k = F.struct("at", "seq")
    done = F.col("to_status") == F.lit("done")
    closes = F.col("to_status").isin("done", "failed")
    columns = {
        "paper_id": F.col("paper_id"),
        "_k": k,
        "_status": F.col("to_status"),
        "_until": F.col(UNTIL.name) if UNTIL.name in log.columns else F.lit(None),
        "_done_k": F.when(done, k),
        "_sv": F.when(done, F.col("schema_version")),
        "_rk": F.when(done, F.col("result_key")),
        "_close_k": F.when(closes, k),
        "_err": F.when(F.col("to_status") == F.lit("failed"), F.col("error")),
        "_attempts": (F.col("to_status") == F.lit("running")).cast("long"),
    }
    return log.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in SUMMARY.fields])


def merge_summaries(summaries: DataFrame) -> DataFrame:
    """One summary per paper from summaries of parts of its log that share no row.

    All aggregates are partial-aggregation friendly: a paper with millions
    of log rows is reduced map-side before the shuffle on ``paper_id``.
    """
    return summaries.groupBy("paper_id").agg(
        F.max("_k").alias("_k"),
        F.max_by("_status", "_k").alias("_status"),
        F.max_by("_until", "_k").alias("_until"),
        F.max("_done_k").alias("_done_k"),
        F.max_by("_sv", "_done_k").alias("_sv"),
        F.max_by("_rk", "_done_k").alias("_rk"),
        F.max("_close_k").alias("_close_k"),
        F.max_by("_err", "_close_k").alias("_err"),
        F.sum("_attempts").alias("_attempts"),
    )


def summarise_log(log: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Per paper, the latest value of each column over the log, and over a summary of earlier rows."""
    rows = summary_rows(log)
    return merge_summaries(rows if base is None else rows.unionByName(base.select(*SUMMARY.fieldNames())))


SUMMARY_COLUMNS = tuple(SUMMARY.fieldNames()[1:])


def apply_summary(papers: DataFrame, summary: DataFrame, with_attempts: bool = False, since_created: bool = False) -> DataFrame:
    """Current rows from the inserted rows and a per-paper log summary.

    A ``left`` join from ``papers``: summaries of unknown ids vanish.
    ``with_attempts`` adds ``attempts`` and ``until``, which ``pending`` needs for leases.

    ``since_created`` leaves out the log rows from before a paper was created, without a join of
    the log itself: a value is that of the latest row which sets it, so if that row is too
    early all are. A count has no such row, so attempts need ``applicable`` on the log.
    """
    if since_created and with_attempts:
        raise ValueError("attempts cannot be told from a summary: filter the log with applicable()")
    j = papers.join(summary, papers["id"] == summary["paper_id"], "left")

    def has(key: str) -> Column:
        return F.col(f"{key}.at") >= F.col("created_at") if since_created else F.col(key).isNotNull()

    return j.select(
        "id",
        "content_hash",
        "source_type",
        "source_ref",
        F.coalesce(F.when(has("_k"), F.col("_status")), F.col("status")).alias("status"),
        "raw_key",
        F.when(has("_done_k"), F.col("_sv")).otherwise(F.col("schema_version")).alias("schema_version"),
        F.when(has("_done_k"), F.col("_rk")).otherwise(F.col("result_key")).alias("result_key"),
        F.when(has("_close_k"), F.col("_err")).otherwise(F.col("error")).alias("error"),
        "created_at",
        F.coalesce(F.when(has("_k"), F.col("_k.at")), F.col("updated_at")).alias("updated_at"),
        *([F.coalesce(F.col("_attempts"), F.lit(0)).alias("attempts"), F.col("_until").alias(UNTIL.name)] if with_attempts else []),
    )


def fold_status(
    papers: DataFrame, log: DataFrame, with_attempts: bool = False, base: DataFrame | None = None, since_created: bool = False
) -> DataFrame:
    """Current ``papers`` from the inserted rows and the log (and a summary of its earlier rows).

    The log is summarised per paper first (partial aggregation, then one
    shuffle of one row per paper and map task), then joined to ``papers``
    from the left, so log rows of unknown ids vanish; ``since_created`` as in ``apply_summary``.
    """
    return apply_summary(papers, summarise_log(log, base), with_attempts, since_created)


def attempts(log: DataFrame) -> DataFrame:
    """Parse attempts per paper (each attempt marks the paper running)."""
    return log.groupBy("paper_id").agg(F.count_if(F.col("to_status") == F.lit("running")).alias("attempts"))


@dataclass(frozen=True)
class Retry:
    """Seconds of a lease; seconds before the second attempt, doubled for each later one up to
    ``longest``; and how often a paper is tried at all."""

    lease: int = 3600
    backoff: int = 0
    longest: int = 86_400
    attempts: int = 25


RETRY = Retry()


def later(at: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(at.cast("timestamp")) + seconds.cast("long") * F.lit(1_000_000))


def wait(attempts: Column, retry: Retry = RETRY) -> Column:
    """Seconds to wait after a failure with so many attempts made."""
    doubled = F.lit(retry.backoff) * F.pow(F.lit(2.0), F.least(F.greatest(attempts, F.lit(1)), F.lit(40)) - 1)
    return F.least(doubled, F.lit(float(retry.longest))).cast("long")


def next_attempt(retry: Retry = RETRY) -> Column:
    """When a paper (folded ``with_attempts``) may be taken up: NULL if it is done or was tried too often.

    A running paper is free when its lease ends, a failed one when its wait is over. Rows that
    do not say until when get what ``retry`` has.
    """
    running, failed = F.col("status") == F.lit("running"), F.col("status") == F.lit("failed")
    until = F.col(UNTIL.name)
    return (
        F.when(F.col("status") == F.lit("queued"), F.col("created_at"))
        .when(F.col("attempts") >= F.lit(retry.attempts), F.lit(None))
        .when(running, F.coalesce(until, later(F.col("updated_at"), F.lit(retry.lease))))
        .when(failed, F.coalesce(until, later(F.col("updated_at"), wait(F.col("attempts"), retry))))
    )


def pending(papers: DataFrame, retry_failed: bool = False, at: Column | None = None, retry: Retry = RETRY) -> DataFrame:
    """Papers waiting to be parsed; with ``retry_failed`` also those whose last attempt failed.

    Over a fold ``with_attempts`` a paper whose lease has run out by ``at`` (default: now) waits
    too, and a failed one only after its wait.
    """
    if "attempts" not in papers.columns:
        return papers.where(F.col("status").isin("queued", *(["failed"] if retry_failed else [])))
    taken = F.col("status").isin("queued", "running", *(["failed"] if retry_failed else []))
    return papers.where(taken & (next_attempt(retry) <= _at(at)))


def stuck(papers: DataFrame, at: Column | None = None, retry: Retry = RETRY) -> DataFrame:
    """Running papers (of a fold ``with_attempts``) whose lease has run out: their worker is lost."""
    ends = F.coalesce(F.col(UNTIL.name), later(F.col("updated_at"), F.lit(retry.lease)))
    return papers.where((F.col("status") == F.lit("running")) & (ends <= _at(at)))
