"""Sharding: the search against all capacities, and the laws of the result."""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from folio.llm import queries, sharding

DOCS = "doc_id long, text string"


def best(sizes: list[int], shards: int) -> int:
    """The smallest size of the largest of at most ``shards`` stretches, by a table over all prefixes."""
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    worst = list(sums)
    for _ in range(shards - 1):
        worst = [min(max(worst[j], sums[i] - sums[j]) for j in range(i + 1)) for i in range(len(sums))]
    return worst[-1]


def test_search_in_few_points_is_exact(llm):
    rng = random.Random(7)
    for trial in range(4):
        sizes = [rng.choice([9, 10, 25, 700 if trial % 2 else 30]) for _ in range(120)]
        ends = [sum(sizes[: k + 1]) for k in range(len(sizes))]
        units = llm.createDataFrame([(e,) for e in [*ends, None]], "end long")
        cuts = sharding.cut(units, ends[-1], max(sizes), 5, points=16)
        assert cuts[-1] == ends[-1] and set(cuts) <= set(ends) and len(cuts) <= 5
        assert max(b - a for a, b in zip([0, *cuts], cuts, strict=False)) == best(sizes, 5)


def test_oversized_groups_fill_a_shard_each():
    assert sharding.oversized([(90, b"a"), (10, b"b"), (2, b"c")], 110, 4) == [(90, b"a"), (10, b"b")]
    assert sharding.oversized([(5, b"a"), (5, b"b")], 100, 4) == []
    assert sharding.oversized([(90, b"a"), (5, b"b")], 95, 1) == []


def shards_of(rows) -> dict[int, list]:
    out = defaultdict(list)
    for r in rows:
        out[r.shard].append(r)
    return out


def test_a_hot_group_and_its_parts(llm):
    rows = [(k if k % 5 else None, "the same text " * 40) for k in range(400)] + [(1000 + k, f"text {k} " * (k % 7)) for k in range(800)]
    docs = llm.createDataFrame(rows, DOCS).withColumn("slot", F.lit("clash")).repartition(3)
    got = sharding.shard(docs, shards=6, parts=8, groups_per_bin=16, points=32).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", *sharding.OUTPUT}
    by_shard, sizes = shards_of(got), defaultdict(int)
    for r in got:
        sizes[bytes(r.text_sha256)] += r.size
    homes = defaultdict(set)
    for k, own in by_shard.items():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        for r in own:
            homes[bytes(r.text_sha256)].add(k)
    assert all(len(x) == 1 for x in homes.values())
    hot = max(sizes, key=sizes.get)
    assert {bytes(r.text_sha256) for r in by_shard[0]} == {hot}  # alone
    rest = [n for h, n in sorted(sizes.items()) if h != hot]
    assert max(sum(r.size for r in own) for k, own in by_shard.items() if k) == best(rest, 5)
    again = sharding.shard(docs.repartition(5), shards=6, parts=300, groups_per_bin=900, points=1 << 16).collect()
    assert sorted((r.doc_id or 0, r.slot, r.shard) for r in got if r.doc_id) == sorted((r.doc_id or 0, r.slot, r.shard) for r in again if r.doc_id)


def test_query_is_near_equal(llm):
    rows = queries.op11_sharding(llm, "/root/testdata/sf0.01").collect()
    sizes = [sum(r.size for r in own) for own in shards_of(rows).values()]
    assert len(sizes) == 24 and max(sizes) <= 1.1 * sum(sizes) / 24


def test_odd_rows(llm, odd, empty):
    got = sharding.shard(odd, shards=3).collect()
    assert len(got) == odd.count() and {r.score for r in got} == {0}
    none = [r for r in got if r.size == 8]
    assert {r.doc_id for r in none} == {None, 4} and {r.text_crc32 for r in none} == {0} and len({r.shard for r in none}) == 1
    for own in shards_of(got).values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    assert sharding.shard(empty).count() == 0
