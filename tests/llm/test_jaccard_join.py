"""The n-gram Jaccard join: rows without ids, and recall at the threshold."""

from __future__ import annotations

import random

from brute import brute_links, shingles

from folio.llm import jaccard_join


def test_rows_without_an_id_are_joined_in_proportion(llm, monkeypatch):
    """Pairs of near copies that share one id, or have none: no class meets the rows of all others."""
    rows = []
    for k in range(200):
        w = [f"t{k}w{i}" for i in range(60)]
        rows += [(None if k < 150 else 7, " ".join([*w, "one"])), (None if k % 2 else 7, " ".join([*w, "two"]))]
    rows += [(100 + k, " ".join([*[f"u{k}w{i}" for i in range(60)], "end"])) for k in range(50)]
    df = llm.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen, whole = [], jaccard_join.member_texts

    def counted(*args):
        out = whole(*args)
        seen.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "member_texts", counted)
    got = jaccard_join.jaccard_join(df).collect()
    assert seen == [400] and len(got) == len(rows)
    links, _ = brute_links({k: t for k, (_, t) in enumerate(rows)})
    assert sorted(r.n_links for r in got) == sorted(links[k] for k in range(len(rows)))
    assert {r.n_links for r in got if r.doc_id and r.doc_id >= 100} == {0}


def test_recall_near_the_threshold(llm):
    """Pairs of similarity 0.80 to 0.85 among unrelated texts: the formula's recall, measured."""
    rng = random.Random(3)
    docs, pairs, d = [], [], 0
    while len(pairs) < 300:
        w = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        v = list(w)
        for i in rng.sample(range(120), 3):
            v[i] = f"x{rng.randrange(10**6)}"
        a, b = shingles(" ".join(w)), shingles(" ".join(v))
        if 0.8 <= len(a & b) / len(a | b) < 0.85:
            pairs.append(d)
            docs += [(d, " ".join(w)), (d + 1, " ".join(v))]
            d += 2
    docs += [(d + k, " ".join(f"y{rng.randrange(10**6)}" for _ in range(120))) for k in range(600)]
    got = {r.doc_id: r.n_links for r in jaccard_join.jaccard_join(llm.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert sum(got[p] == 1 for p in pairs) >= 0.95 * len(pairs)
    assert sum(got.values()) == sum(got[p] + got[p + 1] for p in pairs)
