"""Periodic runs against a period-by-period search."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from brute import WORD, runs

from folio.llm import periodic, queries

CHECK = "/root/testdata/sf0.01"


def found(texts: list[list[int]], least: int = 24, times: int = 3) -> list[list[tuple[int, int, int]]]:
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    text, *rest = periodic.find(np.array([x for t in texts for x in t], dtype=np.uint64), at, least, times)
    rows = list(zip(*[x.tolist() for x in rest], strict=True))
    return [[r for r, k in zip(rows, text.tolist(), strict=True) if k == i] for i in range(len(texts))]


@pytest.mark.parametrize("least,times", [(24, 3), (6, 3), (4, 3), (9, 4)])
def test_runs_of_random_texts(least, times):
    rng = random.Random(least * times)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 6)):
            k = rng.choice([1, 2, 3, 6])
            w = [rng.randint(0, k) for _ in range(rng.choice([0, 1, 5, 30, 80]))]
            w += ([rng.randint(0, k) for _ in range(rng.randint(1, 12))] * 30)[: rng.randint(0, 120)]
            w += [rng.randint(0, k) for _ in range(rng.choice([0, 1, 5, 30]))]
            texts.append(w * rng.choice([1, 1, 1, 3]))
        assert found(texts, least, times) == [runs(t, least, times) for t in texts]


def test_edges_of_the_definition():
    period = list(range(10))
    texts = [[7] * 24, [7] * 23, (period * 3)[:29], period * 3, [1, 2] * 12 + [1], [1, 2, 1, 2] * 6, period * 3 + [9] * 24, []]
    assert found(texts) == [[(0, 24, 1)], [], [], [(0, 30, 10)], [(0, 25, 2)], [(0, 24, 2)], [(0, 30, 10), (29, 25, 1)], []]


def test_query_against_brute_force(llm):
    docs = llm.read.parquet(f"{CHECK}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    planted = 0
    for r in queries.op12_periodic_runs(llm, CHECK).collect():
        w = WORD.findall(texts.pop(r.doc_id) or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        want = runs(w)
        assert r.n_runs == len(want)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{p}\n" for s, k, p in want).encode()).hexdigest()
        gone = {i for s, k, p in want for i in range(s + p, s + k)}
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
        best = min(want, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        assert (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
    assert not texts and planted > 50


def test_odd_rows(llm, odd, empty):
    rows = periodic.detect(odd.selectExpr("*", "1 as runs", "2 as collapsed")).collect()
    assert len(rows) == odd.count() and {r.score for r in rows} == {0}
    assert all(r.n_words == 0 and r.runs == [] and r.collapsed == "" for r in rows if r.doc_id in (4, 5) or r.text is None)
    long = next(r for r in rows if r.doc_id == 6)
    assert [tuple(x) for x in long.runs] == [(0, 60_000, 977)] and len(long.collapsed.split()) == 977
    assert periodic.detect(empty).count() == 0
    assert queries.with_planted_runs(odd.where("doc_id is null")).count() == 2
