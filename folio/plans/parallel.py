"""Parallelism for CPU-heavy narrow stages.

Parsing XML costs far more CPU per byte than reading it. A caller whose
input has few row groups (a small file written at once) may ask for a
round-robin exchange before the parse, by argument or by the session setting
``folio.parse.partitions``. Without either the plan has no exchange, whatever
the size of the input: set the read split size instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

SETTING = "folio.parse.partitions"


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    n = partitions or int(df.sparkSession.conf.get(SETTING, "0"))
    return df.repartition(n) if n else df
