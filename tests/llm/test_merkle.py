"""The Merkle manifest against a recursive version in Python."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from folio.llm import merkle, queries

SMALL = "/root/testdata/sf0.001"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def build(nodes: list[str], arity: int) -> tuple[str, list[list[str]]]:
    """The root, and for each node the digests beside it up to the root."""
    beside, own = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        groups = [range(k, min(k + arity, len(nodes))) for k in range(0, len(nodes), arity)]
        for g in groups:
            for k in g:
                for leaf in own[k]:
                    beside[leaf] += [nodes[j] for j in g if j != k]
        own = [[leaf for k in g for leaf in own[k]] for g in groups]
        nodes = [sha("".join(nodes[k] for k in g)) for g in groups]
    return nodes[0], beside


def brute(rows, arity: int = 16) -> dict:
    """(doc_id, leaf) -> (subroot, root, proof) of rows (source, doc_id, leaf)."""
    parts = defaultdict(list)
    for source, doc_id, leaf in rows:
        parts[source].append((doc_id is not None, doc_id, leaf))
    names = sorted(parts, key=lambda s: (s is not None, (s or "").encode()))
    trees = [build([x[2] for x in sorted(parts[s])], arity) for s in names]
    root, above = build([t[0] for t in trees], arity)
    out = {}
    for s, (sub, beside), up in zip(names, trees, above, strict=True):
        for (_, doc_id, leaf), own in zip(sorted(parts[s]), beside, strict=True):
            out[doc_id, leaf] = (sub, root, sha("".join(own + up)))
    return out


def test_query_against_brute_force(llm):
    docs = llm.read.parquet(f"{SMALL}/documents.parquet").collect()
    leaves = {r.doc_id: leaf_of([r.doc_id, r.source, r.lang, r.n_chars, r.text]) for r in docs}
    want = brute([(r.source, r.doc_id, leaves[r.doc_id]) for r in docs])
    rows = queries.op13_merkle_manifest(llm, SMALL).collect()
    assert {r.doc_id: r.leaf for r in rows} == leaves
    assert {(r.doc_id, r.leaf): (r.subroot, r.root, r.proof_sha256) for r in rows} == want
    upper = {r.doc_id for r in docs if r.text and any("A" <= c <= "Z" for c in r.text)}
    for r in rows:
        tampered = r.doc_id in upper and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        assert r.verified == (not tampered) == (r.folded_root == r.root)


@pytest.mark.parametrize("arity,ranges", [(2, 3), (3, 1), (16, 5)])
def test_trees_of_any_shape(llm, arity, ranges):
    rows = [("hot", k, f"text {k}") for k in range(130)] + [(f"s{k}", k, "one") for k in range(20)] + [(None, k, "none") for k in range(3)] + [("é", 5, "a"), ("z", 5, "a"), ("z", 5, "b"), ("z", None, "c")]
    df = llm.createDataFrame(rows, "source string, doc_id long, text string").repartition(4)
    leaves = merkle.with_leaves(df, ("source", "doc_id", "text")).drop("text")
    got = merkle.manifest(leaves, arity=arity, rows_per_range=-(-len(rows) // ranges))
    got = got.withColumn("proof", merkle.sha(merkle.proof(F.col("path")))).withColumn("folded", merkle.fold_up(F.col("leaf"), F.col("path"))).collect()
    want = brute([(s, d, leaf_of([s, d, t])) for s, d, t in rows], arity)
    assert len(got) == len(rows)
    for r in got:
        assert (r.subroot, r.root, r.proof) == want[r.doc_id, r.leaf] and r.folded == r.root


def test_odd_rows(llm, odd, empty):
    rows = merkle.manifest(merkle.with_leaves(odd.withColumn("path", F.lit(7)).withColumn("root", F.lit(7))).drop("text")).collect()
    assert len(rows) == odd.count() and {r.score for r in rows} == {0}
    assert len({r.root for r in rows}) == 1 and len({r.subroot for r in rows}) == 3
    same = [r for r in rows if r.doc_id == 1]
    assert len(same) == 2 and same[0].leaf == same[1].leaf
    checked = merkle.manifest(merkle.with_leaves(odd).drop("text")).withColumn("ok", merkle.fold_up(F.col("leaf"), F.col("path")) == F.col("root"))
    assert checked.where("ok").count() == odd.count()
    assert merkle.manifest(merkle.with_leaves(empty).drop("text")).count() == 0
    one = merkle.manifest(merkle.with_leaves(odd.where("doc_id = 8")).drop("text")).collect()
    assert [(r.leaf == r.subroot == r.root, r.path) for r in one] == [(True, [])]
