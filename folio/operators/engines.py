"""Parse engines: a registry of named Document producers with feature masks.

An engine is a name, a bitset of the features it extracts, a resource
profile, and a DataFrame transformation that turns TEI (or any input the
engine understands) into Document rows. The registry is a handful of
entries known when the job is written, so filtering it or routing rows by
it is a projection over literals, never a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from enum import IntEnum, IntFlag

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.operators import tei
from folio.schemas import DOCUMENT, SCHEMA_VERSION


class Feature(IntFlag):
    # Fixed values (bit positions must equal the reference's).
    METADATA = 1
    BODY = 2
    REFERENCES = 4
    TABLES = 8
    FORMULAS = 16
    FIGURES = 32


class Profile(IntEnum):
    CPU = 0
    GPU = 1


def has(supported: int, want: int) -> bool:
    """Any-bit overlap; ``has(x, 0)`` is always False."""
    return (supported & want) != 0


@dataclass(frozen=True)
class Engine:
    name: str
    supported: int
    profile: Profile
    transform: Callable[..., DataFrame] = field(compare=False)

    def apply(self, df: DataFrame, **kwargs) -> DataFrame:
        return self.transform(df, **kwargs)


def _tei_engine(df: DataFrame, **kwargs) -> DataFrame:
    return tei.to_document(df, engine=tei.ENGINE_NAME, **kwargs)


TEI_ENGINE = Engine(
    name=tei.ENGINE_NAME,
    supported=Feature.METADATA | Feature.REFERENCES | Feature.BODY,
    profile=Profile.CPU,
    transform=_tei_engine,
)

REGISTRY: tuple[Engine, ...] = (TEI_ENGINE,)


def engines_df(spark: SparkSession, registry: Sequence[Engine] = REGISTRY) -> DataFrame:
    """The registry as a DataFrame ``(name, supported, profile)``."""
    rows = [(e.name, int(e.supported), e.profile.name.lower()) for e in registry]
    return spark.createDataFrame(rows, "name string, supported int, profile string")


def engines_with(engines: DataFrame, want: int | Column) -> DataFrame:
    """Engines whose features overlap ``want`` (any bit)."""
    w = want if isinstance(want, Column) else F.lit(int(want))
    return engines.where(F.col("supported").bitwiseAND(w) != F.lit(0))


def engines_for(want: Column, registry: Sequence[Engine] = REGISTRY) -> Column:
    """O15 per row: names of the registered engines that can serve ``want``."""
    entries = F.array(*[F.struct(F.lit(e.name).alias("name"), F.lit(int(e.supported)).alias("supported")) for e in registry])
    return F.transform(F.filter(entries, lambda e: e["supported"].bitwiseAND(want) != F.lit(0)), lambda e: e["name"])


def apply_engine(df: DataFrame, engine: Engine = TEI_ENGINE, **kwargs) -> DataFrame:
    """Run an engine's transformation (``df.transform`` style)."""
    return engine.apply(df, **kwargs)


def python_engine(
    name: str,
    supported: int,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    profile: Profile = Profile.CPU,
) -> Engine:
    """Wrap a pandas batch function as an engine (``mapInPandas``, Arrow batches).

    For engines that have no column-expression form. ``fn`` maps a batch with
    the columns ``keep``, ``tei`` and ``source_hash`` to one row for each of
    its rows, in order, with ``schema``: any of the Document columns,
    ``parse_error`` and columns of its own. The ``keep`` columns are carried
    past ``fn``; Document columns it does not make are filled in (the fixed
    ones) or NULL, so the result can be stored like any engine's.
    """

    def run(
        df: DataFrame, tei_col: str = "tei", source_hash: str = "source_hash", keep: Sequence[str] | None = None
    ) -> DataFrame:
        keep = list(keep if keep is not None else [c for c in df.columns if c != tei_col])
        given = {"tei": F.col(tei_col), "source_hash": F.col(source_hash)}
        src = df.select(*keep, *[c.alias(n) for n, c in given.items() if n not in keep])
        carried = keep if "source_hash" in keep else [*keep, "source_hash"]
        made = [f for f in T.StructType.fromDDL(schema).fields if f.name not in carried]
        document = {f.name: f.dataType for f in DOCUMENT.fields} | {"parse_error": T.StringType()}
        for f in made:
            want = document.get(f.name, f.dataType).simpleString()
            if f.dataType.simpleString() != want:
                raise TypeError(f"engine {name}: column {f.name} must be {want}")
        names = [f.name for f in made]

        def batches(it: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
            for pdf in it:
                got = fn(pdf)
                if len(got) != len(pdf):
                    raise ValueError(f"engine {name}: {len(got)} rows for {len(pdf)}")
                yield pd.concat([pdf[carried].reset_index(drop=True), got[names].reset_index(drop=True)], axis=1)

        out = src.mapInPandas(batches, T.StructType([src.schema[c] for c in carried] + made))
        if "parse_error" not in names:
            out = out.withColumn("parse_error", F.lit(None).cast("string"))
        fixed = {"schema": F.lit(SCHEMA_VERSION), "engine": F.lit(name), "parsed_at": F.current_timestamp()}
        columns = {
            n: F.col(n) if n in out.columns else F.when(F.col("parse_error").isNull(), fixed.get(n, F.lit(None))).cast(t)
            for n, t in document.items()
        }
        own = [n for n in [*keep, *names] if n not in columns]
        return out.select(*own, *[c.alias(n) for n, c in columns.items()])

    return Engine(name=name, supported=supported, profile=profile, transform=run)
