"""N-gram Jaccard join by chosen paths.

Finds the documents whose sets of word shingles (``words`` words, shorter
texts as one shingle) have a Jaccard similarity of ``threshold`` or more.

1. Documents with the same shingle set are one class (``set_id``, a 128-bit
   digest of the sorted set). Each class has a sketch of ``hashes`` minhashes.
2. Chosen paths: in each of ``runs`` runs, all classes start in one bucket. A
   bucket draws one or two of the sketch positions (mean 1 / threshold) and
   its classes go to a child bucket for each drawn position's value, i.e. a
   shingle that they share. Only buckets with more than ``small`` classes are
   split again, to ``depth`` levels. Counts are pre-aggregated per bucket, so
   a bucket with a third of all classes is split without being gathered.
3. Small buckets are brute-forced on the sketches, which gives a spanning
   forest of the pairs above a lower threshold instead of the pairs. What is
   still large after ``depth`` shared draws is linked as a star. Components of
   these candidates (``components``) only decide what is compared next.
4. Exact check: within each candidate component all pairs of classes are
   compared on their whole shingle sets. A component of over ``block`` shingles
   is dealt to blocks and every pair of blocks to one task, so a hot group is
   split and no pair is emitted: a task returns, for each class, its number
   of links and a spanning forest.

A pair at the threshold survives a level with the chance given by
``survival``; ``runs_for`` repeats the runs until the worst case, a pair that
stays in large buckets all the way down, reaches the target recall. A pair
missed by all runs is still compared if its component joins it otherwise.

Result: one row per document with ``set_id``, ``set_size`` (documents of the
class), ``class_id`` (the smallest doc_id of its component of exact links),
``n_links`` (other documents at the threshold or above, copies included) and
``n_set_links`` (other classes).

Defined cases: a text without a word has no shingles and is linked to
nothing: ``set_id`` null, ``n_links`` 0, its own class. Repeated rows are
copies. Rows with a null doc_id take part, and a class all of whose ids are
null has a null ``class_id``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import SPACE, materialise, mix64, prefix_hash, span_hash, text_bytes, text_chunks, word_spans
from folio.llm.components import components

_SEEDS = mix64(np.arange(1, 513, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
OUTPUT = ["set_id", "set_size", "class_id", "n_links", "n_set_links"]


def survival(threshold: float, depth: int) -> float:
    """Chance that a pair at the threshold shares a bucket ``depth`` levels down, in one run."""
    two = 1 / threshold - 1  # chance of a second draw
    lost = 0.0
    for _ in range(depth):
        one = 1 - threshold + threshold * lost
        lost = (1 - two) * one + two * one * one
    return 1 - lost


def runs_for(threshold: float, depth: int, recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, depth)))


def shingle_sets(batch: pa.RecordBatch, column: str, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    starts, ends, at = word_spans(data, offsets, ~SPACE)
    sums = prefix_hash(data)
    # A shingle is its words in order, whatever the white space between them.
    h = span_hash(sums, starts, ends)
    n = np.diff(at)
    grams = h.copy()
    for k in range(1, words):
        shifted = np.zeros_like(h)
        shifted[:-k] = h[k:]
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + shifted
    grams = mix64(grams)
    out = []
    for k in range(len(n)):
        if n[k] >= words:
            out.append(np.unique(grams[at[k] : at[k + 1] - words + 1]))
        elif n[k]:
            whole = np.asarray([n[k]], dtype=np.uint64)
            for x in h[at[k] : at[k + 1]]:
                whole = mix64(whole * np.uint64(31) ^ x)
            out.append(whole)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def set_id(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def minhashes(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """Rows of ``hashes`` unsigned 32-bit minhashes; every set has an element."""
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)
    low = (np.concatenate(sets) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = np.empty((len(sets), hashes), dtype=np.uint32)
    for k in range(hashes):
        a, b = np.uint32(int(_SEEDS[2 * k]) & 0xFFFFFFFF | 1), np.uint32(int(_SEEDS[2 * k + 1]) & 0xFFFFFFFF)
        x = low ^ b
        x = (x ^ (x >> np.uint32(16))) * a
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA6B)
        out[:, k] = np.minimum.reduceat(x, at[:-1])
    return out


def signatures(docs: DataFrame, doc_id: str, text: str, words: int, hashes: int) -> DataFrame:
    """(doc_id, set_id, n, sketch, bits) per row; ``bits`` has the lowest byte of each minhash, enough
    to compare by, as unequal ones agree once in 256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            sets = shingle_sets(chunk, "text", words)
            full = [k for k, s in enumerate(sets) if len(s)]
            sketches: list[bytes | None] = [None] * len(sets)
            bits: list[bytes | None] = [None] * len(sets)
            if full:
                rows = minhashes([sets[k] for k in full], hashes)
                for k, r in zip(full, rows, strict=True):
                    sketches[k], bits[k] = r.astype("<u4").tobytes(), r.astype(np.uint8).tobytes()
            ids = [set_id(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array(ids, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sketches, pa.binary()), pa.array(bits, pa.binary())], ["doc_id", "set_id", "n", "sketch", "bits"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, set_id binary, n long, sketch binary, bits binary")


def _children(level: int, runs: int, hashes: int, threshold: float):
    """(set_id, path) of the children from (set_id, sketch, path); at level 0 one root for each run and no path."""
    two = int((1 / threshold - 1) * 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            ids = b.column(0)
            data = b.column(1).cast(pa.large_binary())
            sketch = np.frombuffer(data.buffers()[2], dtype="<u4")
            first = np.frombuffer(data.buffers()[1], dtype=np.int64)[data.offset] // 4
            sketch = sketch[first : first + m * hashes].reshape(m, hashes)
            if level:
                paths = [b.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)]
            else:
                paths = [np.full(m, _SEEDS[300] + np.uint64(r * 7919), dtype=np.uint64) for r in range(runs)]
            for path in paths:
                draw = mix64(path + np.uint64(level + 1))
                for second in (False, True):
                    own = np.flatnonzero((draw >> np.uint64(20)) % np.uint64(1000) < np.uint64(two)) if second else np.arange(m)
                    if not len(own):
                        continue
                    # the second position is never the first again
                    at = draw[own] % np.uint64(hashes)
                    if second:
                        at = (at + np.uint64(1) + (draw[own] >> np.uint64(40)) % np.uint64(hashes - 1)) % np.uint64(hashes)
                    value = sketch[own, at.astype(np.int64)].astype(np.uint64)
                    child = mix64(mix64(path[own] + at + np.uint64(1)) ^ value)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(own)), pa.array(child.view(np.int64))], ["set_id", "path"])

    return run


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links: fewer than ``n`` of them join the same rows."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(left.tolist(), right.tolist(), strict=True):
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _small_buckets(hashes: int, least: int):
    """Rows sorted by path: a spanning forest of the pairs with ``least`` equal minhashes, per bucket."""

    def links(paths: np.ndarray, ids: list[bytes], sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for d in range(1, len(paths)):
            same = np.flatnonzero(paths[:-d] == paths[d:])
            if not len(same):
                break
            for part in np.array_split(same, len(same) // 65536 + 1):
                near = part[(sketch[part] == sketch[part + d]).sum(axis=1) >= least]
                left.append(near)
                right.append(near + d)
        if left:
            pairs = _forest(len(paths), np.concatenate(left), np.concatenate(right))
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in pairs], pa.binary()), pa.array([ids[j] for _, j in pairs], pa.binary())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = pa.concat_tables([held, t]) if held is not None else t
            paths = held.column("path").to_numpy()
            last = int(np.searchsorted(paths, paths[-1])) if len(paths) else 0  # the last bucket may go on
            if last:
                yield from done(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield from done(held)

    def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
        sketch = np.frombuffer(b"".join(t.column("bits").to_pylist()), dtype=np.uint8).reshape(t.num_rows, hashes)
        yield from links(t.column("path").to_numpy(), t.column("set_id").to_pylist(), sketch)

    return run


def candidates(classes: DataFrame, threshold: float, hashes: int, small: int, depth: int, runs: int, slack: float) -> DataFrame:
    """(a, b): links that join every pair of classes to compare, from (set_id, sketch, bits)."""
    least = math.ceil((threshold - slack) * hashes)
    level_rows, found = classes.select("set_id", "sketch"), []
    for level in range(depth):
        # Only ids and paths move here; the sketches are joined to what shares a bucket.
        rows = materialise(level_rows.mapInArrow(_children(level, runs, hashes, threshold), "set_id binary, path long"), f"level{level}")
        counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        counted = materialise(rows.join(counts, "path"), f"bucket{level}")
        tiny = counted.where(F.col("m") <= small).select("set_id", "path").join(classes.select("set_id", "bits"), "set_id").select("path", "set_id", "bits")
        found.append(tiny.repartition("path").sortWithinPartitions("path").mapInArrow(_small_buckets(hashes, least), "a binary, b binary"))
        large = counted.where(F.col("m") > small)
        if large.isEmpty():
            break
        level_rows = large.select("set_id", "path").join(classes.select("set_id", "sketch"), "set_id").select("set_id", "sketch", "path")
    else:
        centre = large.groupBy("path").agg(F.min("set_id").alias("b"))
        found.append(large.join(centre, "path").select(F.col("set_id").alias("a"), "b").where("a <> b"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def overlaps(one: list[np.ndarray], two: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of sorted sets, as a matrix; a slab of shared shingles at a time."""
    a, b = np.concatenate(one), np.concatenate(two)
    row_a = np.repeat(np.arange(len(one)), [len(s) for s in one])
    row_b = np.repeat(np.arange(len(two)), [len(s) for s in two])
    shared = np.intersect1d(a, b)
    out = np.zeros((len(one), len(two)), dtype=np.float32)
    if not len(shared):
        return out

    def places(x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        col = np.searchsorted(shared, x)
        col[col == len(shared)] = 0
        hit = shared[col] == x
        order = np.argsort(col[hit], kind="stable")
        return col[hit][order], rows[hit][order]

    (ca, ra), (cb, rb) = places(a, row_a), places(b, row_b)
    for k in range(0, len(shared), width):
        dense = []
        for c, r, n in ((ca, ra, len(one)), (cb, rb, len(two))):
            i, j = np.searchsorted(c, [k, k + width])
            m = np.zeros((n, min(width, len(shared) - k)), dtype=np.float32)
            m[r[i:j], c[i:j] - k] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def _compare(threshold: float, rows: int = 1024):
    """Rows sorted by task, side: exact links of the classes in a task (see ``exact_links``)."""

    def linked(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
        inter = overlaps(one, two)
        size = np.asarray([len(s) for s in one])[:, None] + np.asarray([len(s) for s in two])[None, :]
        # inter / (size - inter) >= threshold, in whole numbers where the threshold allows
        return inter * (1 + threshold) >= threshold * size - 1e-6

    def blocks(t: pa.Table) -> Iterator[pa.RecordBatch]:
        # Repeated ids of documents give a class twice; its rows are equal and adjacent.
        names = t.column("set_id").to_pylist()
        t = t.take(pa.array([k for k, x in enumerate(names) if not k or names[k - 1] != x]))
        side = t.column("side").to_numpy()
        ids, docs = t.column("set_id").to_pylist(), t.column("set_size").to_numpy()
        sets = [np.frombuffer(x, dtype="<u8") for x in t.column("shingles").to_pylist()]
        n_sets, n_docs = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
        edges: list[tuple[int, int]] = []
        split = int((side == 0).sum())
        own = t.column("own")[0].as_py()  # a block meets itself
        for i in range(0, split, rows):
            for j in range(i if own else split, len(ids), rows):
                a, b = slice(i, min(i + rows, split)), slice(j, min(j + rows, len(ids)))
                hit = linked(sets[a], sets[b])
                if own and i == j:
                    hit = np.triu(hit, 1)
                n_sets[a] += hit.sum(axis=1)
                n_sets[b] += hit.sum(axis=0)
                n_docs[a] += hit @ docs[b]
                n_docs[b] += hit.T @ docs[a]
                left, right = np.nonzero(hit)
                edges += _forest(len(ids), left + i, right + j)
        e = np.asarray(edges, dtype=np.int64).reshape(-1, 2)
        pairs = _forest(len(ids), e[:, 0], e[:, 1])
        some = np.flatnonzero(n_sets).tolist()
        out = [(ids[k], None, int(n_sets[k]), int(n_docs[k])) for k in some] + [(ids[i], ids[j], 0, 0) for i, j in pairs]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["a", "b", "n_set_links", "n_doc_links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            tasks = batch.column("task").to_pylist()
            i = 0
            for j in range(1, len(tasks) + 1):
                if j == len(tasks) or tasks[j] != tasks[i]:
                    if held and held[-1].column("task")[0].as_py() != tasks[i]:
                        yield from blocks(pa.Table.from_batches(held))
                        held = []
                    held.append(batch.slice(i, j - i))
                    i = j
        if held:
            yield from blocks(pa.Table.from_batches(held))

    return run


def member_texts(members: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(text, and the columns of ``members`` but the id): a text for each class to compare, or a few
    rows of the id that stands for it, one of which has the class's text.

    An id that stands for one class is joined by the id. Ids that stand for several, and the
    null id, say too little: their rows are told apart by their own set, one text a set.
    """
    rest = [c for c in members.columns if c != "doc_id"]
    own = members.withColumnRenamed("doc_id", "__id")
    shared = materialise(members.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("__shared")), "shared-ids")
    if shared.isEmpty():
        return docs.join(own, F.col("doc_id") == F.col("__id")).select("text", *rest)
    single = own.join(shared, F.col("__id") == F.col("__shared"), "left_anti").where("__id is not null")
    plain = docs.join(single, F.col("doc_id") == F.col("__id")).select("text", *rest)
    rows = docs.where("doc_id is null").unionByName(docs.join(shared, F.col("doc_id") == F.col("__shared"), "left_semi"))
    texts = with_set_id(rows.select("text"), words).where("__set is not null").dropDuplicates(["__set"])
    several = members.join(shared, F.col("doc_id").eqNullSafe(F.col("__shared")), "left_semi").drop("doc_id")
    return plain.unionByName(texts.join(several, F.col("__set") == F.col("set_id")).select("text", *rest))


def exact_links(members: DataFrame, docs: DataFrame, threshold: float, words: int, block: int) -> DataFrame:
    """(a, b, n_set_links, n_doc_links) from (doc_id, set_id, set_size, n, component) of the classes to compare.

    Rows with ``b`` are links (a spanning forest per task), rows without it
    are counts. ``docs`` is (doc_id, text).
    """

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, limit=1 << 18):
            sets = shingle_sets(chunk, "text", words)
            keep = [k for k, (s, i) in enumerate(zip(sets, chunk.column("set_id").to_pylist(), strict=True)) if len(s) and set_id(s) == i]
            if keep:
                rest = chunk.select(["set_id", "set_size", "component", "blocks"]).take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array([sets[k].astype("<u8").tobytes() for k in keep], pa.binary())], ["set_id", "set_size", "component", "blocks", "shingles"])

    size = members.groupBy("component").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    dealt = members.join(size, "component").select("doc_id", "set_id", "set_size", "component", "blocks")
    rows = member_texts(dealt, docs, words)
    sets = rows.mapInArrow(shingles, "set_id binary, set_size long, component binary, blocks int, shingles binary")
    own = F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")
    # Block x meets every block y once: as side 0 of (x, y) for x <= y, as side 1 of (y, x) for x > y.
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda y: F.struct(F.least(F.col("x"), y).alias("lo"), F.greatest(F.col("x"), y).alias("hi"), (F.col("x") > y).cast("int").alias("side")))
    task = F.concat_ws(":", F.hex("component"), F.col("met.lo").cast("string"), F.col("met.hi").cast("string"))
    tasks = sets.withColumn("x", own).withColumn("met", F.explode(met)).select(task.alias("task"), F.col("met.side").alias("side"), (F.col("met.lo") == F.col("met.hi")).alias("own"), "set_id", "set_size", "shingles")
    return tasks.repartition("task").sortWithinPartitions("task", "side", "set_id").mapInArrow(_compare(threshold), "a binary, b binary, n_set_links long, n_doc_links long")


def _joined(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, threshold: float = 0.8, recall: float = 0.995, hashes: int = 64, small: int = 128, depth: int = 4, slack: float = 0.18, block: int = 1 << 20) -> DataFrame:
    """``jaccard_join`` with ``set_id`` in bytes and ``head``: whether the row's set is the one of its
    component that has the smallest (doc_id, set_id), null ids last."""
    sig = materialise(signatures(docs, doc_id, text, words, hashes), "signatures")
    classes = sig.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("set_size"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bits").alias("bits"))
    classes = materialise(classes, "classes")
    edges = candidates(classes, threshold, hashes, small, depth, runs_for(threshold, depth, recall), slack)
    groups = components(edges).withColumnRenamed("node", "set_id")
    members = classes.select("set_id", "doc_id", "set_size", "n").join(groups, "set_id")
    links = exact_links(members, docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), threshold, words, block)
    links = materialise(links, "links")
    found = components(links.where("b is not null").select("a", "b")).withColumnRenamed("node", "set_id")
    counts = links.where("b is null").groupBy(F.col("a").alias("set_id")).agg(F.sum("n_set_links").alias("n_set_links"), F.sum("n_doc_links").alias("n_doc_links"))
    known = classes.select("set_id", "doc_id", "set_size").join(found, "set_id", "left").join(counts, "set_id", "left")
    # The component's smallest doc_id: a sum in the tasks, then a join back on the component's own key.
    known = known.withColumn("component", F.coalesce("component", "set_id"))
    head = known.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "set_id")).alias("first"))
    known = materialise(known.join(head, "component").select("set_id", "set_size", F.col("first.doc_id").alias("class_id"), (F.col("set_id") == F.col("first.set_id")).alias("head"), F.coalesce("n_set_links", F.lit(0)).alias("n_set_links"), F.coalesce("n_doc_links", F.lit(0)).alias("n_doc_links")), "known")
    out = sig.select("doc_id", "set_id").join(known, "set_id", "left")
    return out.select(
        "doc_id",
        "set_id",
        F.coalesce("set_size", F.lit(1)).alias("set_size"),
        F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("n_doc_links") + F.col("set_size") - 1, F.lit(0)).alias("n_links"),
        F.coalesce("n_set_links", F.lit(0)).alias("n_set_links"),
        F.coalesce("head", F.lit(True)).alias("head"),
    )


def jaccard_join(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, and the columns of ``OUTPUT``. The options are those of ``_joined``."""
    return _joined(docs, **options).withColumn("set_id", F.lower(F.hex("set_id"))).drop("head")


def with_set_id(docs: DataFrame, words: int) -> DataFrame:
    """``docs`` with ``__set``: the row's own ``set_id``, null for a text without a word."""
    schema = T.StructType([*docs.schema.fields, T.StructField("__set", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            ids = [set_id(s) if len(s) else None for s in shingle_sets(chunk, "text", words)]
            yield pa.RecordBatch.from_arrays([*chunk.columns, pa.array(ids, pa.binary())], schema.names)

    return docs.mapInArrow(run, schema)


def keep_one(docs: DataFrame, words: int = 5, **options) -> DataFrame:
    """``docs`` without near copies: of each class of linked documents one row stays, the one with
    the smallest (doc_id, set_id), null ids last. Rows that share an id are decided each by its text."""
    # Documents that are linked to nothing stay as they are: only the others take part in the join.
    linked = _joined(docs, words=words, **options).where("n_links > 0")
    fate = linked.groupBy("doc_id", "set_id").agg(F.first(F.col("head") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("__stays"))
    fate = fate.withColumnRenamed("doc_id", "__id").withColumnRenamed("set_id", "__own")
    rows = with_set_id(docs, words).join(fate, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__set") == F.col("__own")), "left")
    single = rows.where(F.col("__stays").isNull()).select(docs.columns)
    # Rows with the id and the set of a head: one of them.
    order = Window.partitionBy("doc_id", "__set").orderBy(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    heads = rows.where("__stays").withColumn("__k", F.row_number().over(order)).where("__k = 1").select(docs.columns)
    return single.unionByName(heads)
