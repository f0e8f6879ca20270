"""Exact dedup with a heavy-hitter split, in DataFrame functions only.

``approx_top_k`` is Spark's frequent-items sketch, a mergeable Misra-Gries
summary: ``tracked`` counters per task, merged in one aggregate, so any
digest with more than about ``rows / tracked`` copies is in it. Its digests
are only candidates; a second aggregate over them gives the exact count and
the largest id, and these verified winners (``heavy`` rows at most, about
100 bytes each) are broadcast. Copies of a winner are settled in the scan
stage and never shuffled by digest; all other rows take an ordinary shuffle
and a window by digest, where no digest has more than the summary's share.

Defined cases: null text equals the empty text; of rows with equal text the
largest id stays, null ids come last, and of rows with the same text *and*
the same id exactly one stays (they are interchangeable to the operator).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import without

OUTPUT = ["keep_id", "group_size", "kept", "text_sha256"]


def with_digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``text_sha256``: lower-case hex of the text's UTF-8 bytes."""
    return without(docs, OUTPUT).withColumn("text_sha256", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def heavy_hitters(digests: DataFrame, id_col: str = "doc_id", heavy: int = 1024, tracked: int = 16384) -> DataFrame:
    """(text_sha256, keep_id, group_size): exact figures of the most frequent digests, ``heavy`` rows at most."""
    found = digests.agg(F.expr(f"approx_top_k(text_sha256, {heavy}, {tracked})").alias("top")).select(F.explode("top").alias("t")).select(F.col("t.item").alias("text_sha256")).where("text_sha256 is not null")
    return (
        digests.join(F.broadcast(found), "text_sha256")  # at most `heavy` rows
        .groupBy("text_sha256")
        .agg(F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )


def mark(docs: DataFrame, winners: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` (with ``text_sha256``) with ``keep_id``, ``group_size`` and ``kept``.

    ``winners`` is the result of ``heavy_hitters`` over the same rows.
    """
    top = winners.select("text_sha256", F.col("keep_id").alias("__keep"), F.col("group_size").alias("__size"))
    split = without(docs, OUTPUT[:3]).join(F.broadcast(top), "text_sha256", "left")  # bounded, see heavy_hitters
    settled = F.col("__size").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("__keep"))
    away = split.where(settled).select(*docs_columns(split), F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"), F.lit(False).alias("kept"))
    # The winners' own rows go through the shuffle too, so that repeated ids leave one row.
    rest = split.where(~settled)
    group = Window.partitionBy("text_sha256")
    order = group.orderBy(F.col(id_col).desc_nulls_last())
    rest = rest.select(
        *docs_columns(split),
        F.max(id_col).over(group).alias("keep_id"),
        F.coalesce(F.col("__size"), F.count(F.lit(1)).over(group)).alias("group_size"),
        (F.row_number().over(order) == 1).alias("kept"),
    )
    return rest.unionByName(away)


def docs_columns(split: DataFrame) -> list[str]:
    return [c for c in split.columns if c not in ("__keep", "__size")]
