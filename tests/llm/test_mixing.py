"""Mixing against a sort of all rows of a source, with weights that crowd the keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.llm import mixing


def brute_taken(rows, targets):
    """{(doc_id, source): taken} by one sort of each source's rows."""
    out = {}
    for source, target in targets.items():
        own = sorted((r for r in rows if r.source == source), key=lambda r: (r.key, r.doc_id, r.size))
        total, goal = sum(r.size for r in own), round(target)
        epochs = goal // total if total else 0
        left = goal - epochs * total
        for r in own:
            part = max(0, min(r.size, left))
            left -= part
            out[(r.doc_id, source)] = epochs * r.size + part
    return out


def test_a_cut_among_crowded_keys_is_sliced_again(llm):
    """Low weights put most keys of source a beyond the last slice of 1 - exp(-key)."""
    rows = llm.range(6000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 10 < 7, "a").when(F.col("id") % 10 < 9, "b").alias("source"),
        F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"),
    )
    quality = F.when(F.col("source") == "a", F.lit(0.001)).otherwise(F.lit(1.0))
    sized = mixing.with_keys(rows, quality=quality)
    for rows_per_bin in (1, 50, 100_000):
        got = mixing.mix(sized.drop("text"), rows_per_bin=rows_per_bin).collect()
        want = brute_taken(got, {r.source: r.target for r in got})
        assert {(r.doc_id, r.source): r.taken for r in got} == want


def test_equal_keys_and_own_columns(llm):
    """One id a thousand times has one key; a caller's columns of the outputs' names stay the caller's."""
    rows = llm.createDataFrame([(7, "a b c", "s", -1, "own")] * 1000 + [(8, "a b", "t", -2, "mine")], "doc_id long, text string, source string, size long, Taken string")
    got = mixing.mix(mixing.with_keys(rows), rows_per_bin=10)
    per = {r.source: r for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("taken").alias("most")).collect()}
    assert all(abs(r.taken - r.target) <= 1 and r.most <= 6 for r in per.values())
    mixed = mixing.apply_mix(rows)
    assert mixed.columns == rows.columns
    assert {(r.source, r["size"], r.Taken) for r in mixed.collect()} == {("s", -1, "own"), ("t", -2, "mine")}
