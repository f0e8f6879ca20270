"""A training-data pipeline over ``documents``: language ID, exact dedup, near dedup, mixing, packing.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame``. ``run``
writes every stage's result as Parquet in the shared checkpoint folder and
reads it back as the next one's input. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import exact_dedup, jaccard_join, langid, mixing, packing
from folio.llm.common import DOC_COLUMNS, documents, materialise
from folio.session import ship_package

#: A document nearer to n-grams at random than to its own language (`langid.misfits`) is rejected.
MOST_MISFIT = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those that are in no language of the labelled rows.

    The measure is a mean per n-gram with an allowance for short texts, so it does not depend on
    length. A text between two languages stays (ties take the first by name), and without any
    labelled row no language is known and nothing stays.
    """
    ship_package(spark)
    model = langid.fit(docs)
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("misfit") <= MOST_MISFIT)
    return langid.predict(docs.select(DOC_COLUMNS), model).where(known).select(DOC_COLUMNS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    marked = exact_dedup.with_digest(docs.select(DOC_COLUMNS))
    winners = materialise(exact_dedup.heavy_hitters(marked.select("doc_id", "text_sha256")), "winners")
    return exact_dedup.mark(marked, winners).where("kept").select(DOC_COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by similar shingle sets, one stays."""
    ship_package(spark)
    return jaccard_join.keep_one(docs.select(DOC_COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document; one document of a source may be cut to its share."""
    return mixing.apply_mix(docs.select(DOC_COLUMNS), quality=mixing.quality_weight(F.col("text")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, each with its place in a sequence."""
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("jaccard_join", near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL can train the language model or tokenize; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
