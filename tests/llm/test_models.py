"""The trained operators against plain versions of their definitions."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from folio.llm import langid, queries, toxicity
from folio.llm.common import mix64

SMALL = "/root/testdata/sf0.001"


def test_toxicity_training_follows_the_non_negative_risk():
    """Full batches of dense rows: the same steps from the estimator's own gradient, by differences."""
    rng = np.random.default_rng(1)
    x = (rng.random((40, 6)) < 0.4).astype(float)
    positive = np.arange(40) % 4 == 0
    x[positive, 0] = 1
    prior, decay, rate, epochs = 0.3, 1e-3, 0.05, 12
    flat, lengths = np.concatenate([np.flatnonzero(r) for r in x]).astype(np.int32), x.sum(axis=1).astype(int)
    w, bias = toxicity.train(flat, lengths, positive, 6, prior, epochs=epochs, batch=1000, rate=rate, decay=decay)

    data = np.column_stack([x, np.ones(40)])
    p, u = data[positive], data[~positive]

    def parts(w):
        plus, minus = np.logaddexp(0, -p @ w).mean(), np.logaddexp(0, p @ w).mean()
        return prior * plus, np.logaddexp(0, u @ w).mean() - prior * minus

    def gradient(w):
        keep = parts(w)[1] >= 0
        risk = lambda v: parts(v)[0] + (parts(v)[1] if keep else 0) + decay / 2 * (v[:-1] ** 2).sum()
        return np.array([(risk(w + e) - risk(w - e)) / 2e-5 for e in np.eye(7) * 1e-5])

    v, m, s = np.append(np.zeros(6), math.log(prior / (1 - prior))), np.zeros(7), np.zeros(7)
    mean = np.zeros(7)
    for step in range(1, epochs + 1):
        g = gradient(v)
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g**2
        v = v - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        if step > epochs // 2:
            mean += v / (epochs - epochs // 2)
    assert np.abs(np.append(w, bias) - mean).max() < 1e-3


def test_toxicity_query_scores_are_those_of_its_model(llm):
    """Every text's score from its words and their prefixes, one by one."""
    docs = llm.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    labels = llm.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "toxic")
    seen = queries.fold("doc_id", 3) != 1
    model = toxicity.fit(docs.where(seen), labels.where(seen))
    weight = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    got = {r.doc_id: r for r in queries.op2_toxicity(llm, SMALL).collect()}
    for r in docs.collect():
        _, hashes = toxicity.features(pa.RecordBatch.from_arrays([pa.array([r.text])], ["text"]))
        g = model.bias + sum(weight.get(h, 0.0) for h in set(hashes.tolist()))
        assert math.isclose(got[r.doc_id].score, 1 / (1 + math.exp(-g)), rel_tol=1e-6, abs_tol=1e-9)
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.7)


def test_language_posteriors_in_a_dictionary(llm):
    docs = llm.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.select("doc_id", "text", "lang").collect()
    learned = [r for r in rows if fold_of(r.doc_id, 5) != 0 and r.text is not None and r.lang is not None]

    def grams(text):
        t = text.lower()
        for n in (1, 2, 3):
            for i in range(len(t)):
                piece = (t + "  ")[i : i + n]
                h = ord(piece[0]) + (n << 40)
                for c in piece[1:]:
                    h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
                yield h

    counts, texts = defaultdict(Counter), Counter()
    for r in learned:
        counts[r.lang].update(grams(r.text))
        texts[r.lang] += 1
    keys = np.array(sorted({h for c in counts.values() for h in c}), dtype=np.uint64)
    bucket = dict(zip(keys.tolist(), (mix64(keys + np.uint64(0)) % np.uint64(1 << 16)).tolist(), strict=True))
    hashed = {lang: Counter() for lang in counts}
    for lang, c in counts.items():
        for h, n in c.items():
            hashed[lang][bucket[h]] += n
    total = {lang: sum(c.values()) for lang, c in hashed.items()}
    got = {r.doc_id: r for r in queries.op7_language_id(llm, SMALL).collect()}
    for r in rows[:40]:
        if not r.text or not any(map(str.isalpha, r.text)):
            assert got[r.doc_id].lang_pred == "und"
            continue
        logs = {}
        for lang in hashed:
            s = math.log(texts[lang] / sum(texts.values()))
            for h in grams(r.text):
                b = bucket.get(h, int(mix64(np.array([h], dtype=np.uint64))[0] % np.uint64(1 << 16)))
                s += math.log((hashed[lang][b] + 0.5) / (total[lang] + 0.5 * (1 << 16)))
            logs[lang] = s
        best = max(logs, key=logs.get)
        assert got[r.doc_id].lang_pred == best
        assert math.isclose(got[r.doc_id].score, 1 / sum(math.exp(v - logs[best]) for v in logs.values()), abs_tol=1e-3)


def fold_of(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n
