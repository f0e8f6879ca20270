"""Every registered query against its DuckDB oracle on the smallest tables."""

from __future__ import annotations

import os
import sys

import pytest

from support import ROOT, SF_SMALL

sys.path.insert(0, os.path.join(ROOT, "tools"))


@pytest.fixture(scope="module")
def results(spark):
    from compare import compare

    return compare(spark, SF_SMALL, verbose=False)


def test_all_oracles_match(results):
    bad = {k: v for k, v in results.items() if v[0] == "MISMATCH"}
    assert not bad, bad


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["doc_id", "title", "n_sections", "markdown"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    from folio.plans import oracles, queries

    assert set(queries.QUERIES) == set(oracles.ORACLES)
