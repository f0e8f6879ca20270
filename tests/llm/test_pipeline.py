"""The pipeline's stages, each against what it must keep and drop."""

from __future__ import annotations

import base64
import random

import corpus_pipeline as pipeline
from brute import WORD, brute_links
from folio.llm.common import DOC_COLUMNS, materialise

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_a_whole_table(llm):
    docs = llm.read.parquet(f"{SMALL}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    kept = []
    for name, stage in pipeline.STAGES:
        docs = materialise(stage(llm, docs, SMALL), name)
        if name != "packing":
            assert docs.columns == DOC_COLUMNS
        kept.append({r.doc_id for r in docs.select("doc_id").distinct().collect()})
        if name == "mixing":
            words = sum(len(WORD.findall(r.text)) for r in docs.collect())
    language, exact, near, mixed, packed = kept
    assert language == set(before)  # every document there has a language
    last = {}
    for d, t in before.items():
        last[t] = max(d, last.get(t, -1))
    assert exact == set(last.values())
    _, classes = brute_links({d: before[d] for d in exact})
    assert near == set(classes.values())
    sizes = sum(len(WORD.findall(before[d])) for d in near)
    assert abs(words - 1.5 * sizes) <= 25  # a rounding for each source
    assert packed == mixed <= near


def test_language_stage_rejects_noise_of_any_length_and_keeps_short_texts(llm):
    docs = llm.read.parquet(f"{SMALL}/documents.parquet").select(DOC_COLUMNS)
    dice = random.Random(5)
    noise, clean, at = [], [], 10_000_000
    for n in (60, 600, 30_000):
        for t in (dice.randbytes(n // 2).hex(), base64.b64encode(dice.randbytes(n)).decode(), "".join(dice.choices("0123456789.,;|", k=n)) + " abc", "".join(dice.choices("αβγδεζηθικλμνξοπρστυφχψω ", k=n))):
            noise.append((at + len(noise), t, None, "planted", len(t)))
    for r in docs.where("lang is not null").limit(40).collect():
        t = " ".join(r.text.split()[:3])
        clean.append((2 * at + len(clean), t, None, "planted", len(t)))
    rows = docs.unionByName(llm.createDataFrame(noise + clean, DOCS))
    kept = {r.doc_id for r in pipeline.language_id(llm, rows, SMALL).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.collect()} | {r[0] for r in clean}


def test_rejects_and_odd_rows(llm, odd):
    rows = odd.select(DOC_COLUMNS)
    first = pipeline.language_id(llm, rows, SMALL)
    assert {r.doc_id for r in first.collect()}.isdisjoint({4, 5, 8})
    docs = first
    for name, stage in pipeline.STAGES[1:]:
        docs = materialise(stage(llm, docs, SMALL), name)
    assert docs.count() > 0
    nothing = llm.createDataFrame([], DOCS)
    for name, stage in pipeline.STAGES:
        nothing = materialise(stage(llm, nothing, SMALL), name)
    assert nothing.count() == 0
