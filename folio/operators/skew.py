"""Salting for joins whose key may be hot (one key with a large share of all rows).

A sort-merge join puts every row of one key into one task. Here the rows of
each key are counted first (a partial aggregate); a key with more rows than
one task should take gets ``ceil(rows / rows_per_salt)`` salts, so a task's
share of a key stays the same however hot the key is, and every hot key is
split. Its rows on the other side are copied once per salt. Other keys keep
salt 0 and are not copied. The join then runs on ``(key, salt)``, and the
result is no longer partitioned by the key alone, so a later ``groupBy(key)``
aggregates partially before its shuffle.

The table of hot keys has at most ``rows / rows_per_salt`` rows. It carries
no broadcast hint: the planner broadcasts it when its size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = "_salt"
ROWS_PER_SALT = 100_000


def hot_keys(df: DataFrame, key: str, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """``(key, _salts)`` of every key with more than ``rows_per_salt`` rows."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    salts = F.ceil(F.col("_n") / F.lit(rows_per_salt)).cast("int")
    return counts.where((F.col("_n") > F.lit(rows_per_salt)) & F.col(key).isNotNull()).select(key, salts.alias("_salts"))


def salted_semi_join(
    large: DataFrame,
    small: DataFrame,
    key: str,
    condition: Column | None = None,
    salt_source: Column | None = None,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """``large LEFT SEMI JOIN small ON large.key = small.key [AND condition]``, salted.

    ``small`` must name its key column ``key`` too; ``condition`` may use the
    columns of both sides (``small``'s other columns should be uniquely
    named). ``salt_source`` spreads a hot key's rows (default: a hash of all
    columns of ``large``).
    """
    hot = hot_keys(large, key, rows_per_salt)
    src = salt_source if salt_source is not None else F.xxhash64(*[F.col(c) for c in large.columns])
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    left = large.join(hot, key, "left").withColumn(SALT, F.pmod(src, salts.cast("long"))).drop("_salts")
    right_key = f"_r_{key}"
    right = (
        small.join(hot, key, "left")
        .withColumn("_r_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts.cast("long") - 1)))
        .drop("_salts")
        .withColumnRenamed(key, right_key)
    )
    cond = (F.col(key) == F.col(right_key)) & (F.col(SALT) == F.col("_r_salt"))
    if condition is not None:
        cond = cond & condition
    return left.join(right, cond, "left_semi").drop(SALT)


def salted_left_join(large: DataFrame, small: DataFrame, key: str, rows: str, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """``large LEFT JOIN small USING (key)``, salted, where ``small`` has one row per key of ``large``
    with the number of its rows there in the column ``rows`` (which is dropped).

    The copies of a row of ``small`` follow from its own count; only the salts of ``large`` need
    the table of hot keys.
    """
    salts = F.greatest(F.ceil(F.col(rows) / F.lit(rows_per_salt)).cast("long"), F.lit(1).cast("long"))
    hot = small.where(F.col(rows) > F.lit(rows_per_salt)).select(key, salts.alias("_salts"))
    src = F.xxhash64(*[F.col(c) for c in large.columns])
    left = large.join(hot, key, "left").withColumn(SALT, F.pmod(src, F.coalesce(F.col("_salts"), F.lit(1).cast("long")))).drop("_salts")
    right = small.withColumn(SALT, F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop(rows)
    return left.join(right, [key, SALT], "left").drop(SALT)
