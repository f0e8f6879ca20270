from __future__ import annotations

import pandas as pd

from folio.operators import engines
from folio.operators.engines import Feature


def test_feature_bits():
    assert [int(f) for f in Feature] == [1, 2, 4, 8, 16, 32]
    assert int(engines.TEI_ENGINE.supported) == 7
    assert not engines.has(7, 0)
    assert engines.has(7, Feature.REFERENCES | Feature.TABLES)
    assert not engines.has(7, Feature.TABLES)


def test_engines_with_and_for(spark):
    e = engines.engines_df(spark)
    assert [r.name for r in engines.engines_with(e, Feature.BODY).collect()] == ["grobid"]
    assert engines.engines_with(e, 0).count() == 0
    assert engines.engines_with(e, Feature.FIGURES).count() == 0
    df = spark.createDataFrame([(m,) for m in range(64)], "want int")
    got = {r.want: r.names for r in df.select("want", engines.engines_for(df.want).alias("names")).collect()}
    assert all(got[m] == (["grobid"] if m & 7 else []) for m in range(64))


def test_apply_engine_and_python_engine(spark):
    df = spark.createDataFrame([(1, "<TEI/>", "h")], "id int, tei string, source_hash string")
    out = engines.apply_engine(df, engines.TEI_ENGINE, keep=["id"]).collect()[0]
    assert out.engine == "grobid" and out.parse_error is None

    def upper(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": pdf["id"], "markdown": pdf["tei"].str.upper()})

    eng = engines.python_engine("upper", Feature.BODY, upper, "id int, markdown string")
    assert engines.apply_engine(df, eng).collect()[0].markdown == "<TEI/>"


def test_python_engine_in_process(spark, tmp_path):
    import json

    import pytest

    from folio.operators import intake
    from folio.plans.process import process
    from folio.sources.store import PaperStore

    def shout(pdf: pd.DataFrame) -> pd.DataFrame:
        bad = pdf["tei"].isna()
        return pd.DataFrame({"markdown": pdf["tei"].str.upper(), "parse_error": bad.map({True: "nothing to read", False: None})})

    eng = engines.python_engine("shout", Feature.BODY, shout, "markdown string, parse_error string")
    store = PaperStore(spark, f"file://{tmp_path}/store")
    firsts = spark.createDataFrame([("h1", "a.pdf"), ("h2", "b.pdf")], "content_hash string, path string")
    store.append_papers(intake.paper_rows(firsts), batch=1)
    tei = spark.createDataFrame([("h1", "some text"), ("h2", None)], "source_hash string, tei string")
    process(store, tei, batch=2, engine=eng)
    assert {p.content_hash: (p.status, p.error) for p in store.scan_papers().collect()} == {
        "h1": ("done", None),
        "h2": ("failed", "nothing to read"),
    }
    doc = json.loads(store.documents(2).collect()[0].json)
    assert (doc["engine"], doc["schema"], doc["source_hash"], doc["markdown"]) == ("shout", "1.0", "h1", "SOME TEXT")
    with pytest.raises(TypeError, match="markdown must be string"):
        engines.python_engine("bad", 1, shout, "markdown int").apply(tei)
