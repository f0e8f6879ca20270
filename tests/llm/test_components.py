"""Components against a union-find, with stars whose centre holds most edges."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from folio.llm import components as c


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("centre", [0, 5_000, 10_000_000])
def test_a_hot_centre_is_dealt_out(llm, monkeypatch, centre):
    """The centre is the smallest, a middle and the largest node of its star."""
    monkeypatch.setattr(c, "LEAST_HOT", 20)
    dice = random.Random(centre)
    edges = [(centre, k) for k in range(1, 9_000, 3)] + [(20_000 + k, 20_001 + k) for k in range(0, 90, 3)]
    edges += [(dice.randrange(30_000, 30_400), dice.randrange(30_000, 30_400)) for _ in range(150)] + [(None, 3), (7, 7)]
    df = llm.createDataFrame(edges, "a long, b long").repartition(3)
    ends = df.selectExpr("greatest(a, b) a", "least(a, b) b")
    own = llm.range(1).select(F.xxhash64(F.lit(centre).cast("long"))).first()[0]
    assert own in c.hot_nodes(ends, "a") + c.hot_nodes(ends, "b")
    want = brute(edges)
    assert {r.node: r.component for r in c.components(df).collect()} == want
    as_bytes = df.selectExpr("unhex(lpad(hex(a), 16, '0')) a", "unhex(lpad(hex(b), 16, '0')) b")
    got = c.components(as_bytes).collect()
    assert {int.from_bytes(r.node): int.from_bytes(r.component) for r in got} == want


def test_no_edges(llm):
    assert c.components(llm.createDataFrame([], "a long, b long")).count() == 0
