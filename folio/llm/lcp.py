"""Document fingerprints by locally consistent parsing.

A text's code points are the first level's symbols. At each level runs of
equal symbols are merged, deterministic coin tossing turns the symbols into
labels below six (twice the place of the lowest bit in which a symbol differs
from the one before it, plus that bit, four times over), local minima of the
labels start phrases, and a phrase's name, a hash of its symbols, is the next
level's symbol. Where phrases start depends on a few symbols around only, so
equal substrings get the same names inside, at any offset. Phrases of the
third level have about 25 code points.

The fingerprint is a minhash sketch of the phrase names of the levels
``LEVELS``, ``SLOTS`` values of 16 bits in hex; the likeness of two
fingerprints is the share of equal slots, an estimate of the Jaccard
similarity of their sets of phrases. Work is ``numpy`` over chunks of about
1 MB of text.

Defined cases: equal texts have equal fingerprints; empty text (null counts
as it) has the empty fingerprint, like to itself and to nothing else; a text
too short for a phrase of a level has itself as its only phrase.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import materialise, mix64, span_hash, span_sums

LEVELS = (2, 3)
SLOTS = 64
_SEEDS = mix64(np.arange(1, 2 * SLOTS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def coin_toss(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below six, unequal for neighbours; ``first`` marks where a text starts."""
    labels = symbols
    for _ in range(4):
        before = np.empty_like(labels)
        before[1:] = labels[:-1]
        before[first] = labels[first] ^ np.uint64(1)
        diff = labels ^ before
        place = np.bitwise_count((diff & (~diff + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
        labels = np.uint64(2) * place + ((labels >> place) & np.uint64(1))
    return labels


def next_level(symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of each text; ``at``: where texts start in ``symbols`` (n + 1 entries)."""
    if not len(symbols):
        return symbols, at
    edge = np.zeros(len(symbols) + 1, dtype=bool)
    edge[at] = True
    edge = edge[:-1]
    # runs of a symbol become one symbol
    new = edge.copy()
    new[1:] |= symbols[1:] != symbols[:-1]
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, len(symbols))).astype(np.uint64)
    runs = symbols[starts]
    runs = np.where(lengths > 1, mix64(runs + lengths * np.uint64(0x9E3779B97F4A7C15)), runs)
    first = np.flatnonzero(edge[starts])
    # two runs with the same new name may meet; then the coin has nothing to tell and the phrase goes on
    labels = coin_toss(runs, first)
    low = np.zeros(len(runs), dtype=bool)
    low[1:-1] = (labels[1:-1] < labels[:-2]) & (labels[1:-1] < labels[2:])
    head = edge[starts]
    ends_text = np.append(head[1:], True)
    low &= ~ends_text
    low[1:] &= ~head[:-1]  # the first phrase has two symbols at least
    low |= head
    phrase = np.flatnonzero(low)
    stop = np.append(phrase[1:], len(runs))
    names = span_hash(span_sums(runs), phrase, stop)
    return names, np.searchsorted(starts[phrase], at)


def phrases(texts: list[str], levels: tuple[int, ...] = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """The phrase names of ``levels`` of each text, end to end, and which text each is from."""
    raw = "".join(texts).encode("utf-32-le", "surrogatepass")
    symbols = mix64(np.frombuffer(raw, dtype=np.uint32).astype(np.uint64) + np.uint64(1))
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    names, owner = [], []
    for level in range(1, max(levels) + 1):
        symbols, at = next_level(symbols, at)
        if level in levels:
            names.append(mix64(symbols + np.uint64(level)))
            owner.append(np.repeat(np.arange(len(texts)), np.diff(at)))
    return np.concatenate(names), np.concatenate(owner)


def sketches(texts: list[str]) -> list[np.ndarray | None]:
    """``SLOTS`` 16-bit values per text; None for the empty text."""
    names, owner = phrases(texts)
    order = np.argsort(owner, kind="stable")
    names, owner = names[order], owner[order]
    starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, dtype=np.int64)
    low = (names & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    high = (names >> np.uint64(32)).astype(np.uint32)
    out: list[np.ndarray | None] = [None] * len(texts)
    rows = np.empty((len(starts), SLOTS), dtype=np.uint16)
    for k in range(SLOTS if len(starts) else 0):
        x = (low ^ np.uint32(int(_SEEDS[2 * k]) & 0xFFFFFFFF)) * np.uint32(int(_SEEDS[2 * k + 1]) & 0xFFFFFFFF | 1) + high
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x7FEB352D)
        m = np.minimum.reduceat(x, starts)
        rows[:, k] = ((m * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
    for i, t in enumerate(owner[starts].tolist()):
        out[t] = rows[i]
    return out


def fingerprint(sketch: np.ndarray | None) -> str:
    return "" if sketch is None else sketch.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is None and b is None)
    return float((a == b).mean())


def edit(text: str, following: str) -> str:
    """The last quarter of the text replaced by as many first characters of the following one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def compare_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of ``edit`` with the document after it by id (the first after
    the last); see ``RESULT``. Rows with equal ids are ordered by text, null ids come first.

    Texts move once, dealt by ranges of the id. A range lacks the document
    after its last one: it gives back its first and last rows, two for each
    range, which are matched in a second step.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def results(part: list[tuple[int | None, str]]) -> pa.RecordBatch:
        """Of all rows but the last."""
        own = sketches([t for _, t in part])
        edited = [edit(part[k][1], part[k + 1][1]) for k in range(len(part) - 1)]
        changed = sketches(edited) if edited else []
        out = [
            (i, len(t), hashlib.sha256(edited[k].encode()).hexdigest(), fingerprint(own[k]), fingerprint(changed[k]), likeness(own[k], changed[k]), likeness(own[k], own[k + 1]))
            for k, (i, t) in enumerate(part[:-1])
        ]
        return _batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        size, head = 0, True
        for b in batches:
            for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if head:
                    yield _batch([(row[0], None, None, None, None, None, None)], row[1], 0)
                    head = False
                held.append(row)
                size += len(row[1])
                if size > 1 << 19 and len(held) > 1:
                    yield results(held)
                    held, size = held[-1:], len(held[-1][1])
        if len(held) > 1:
            yield results(held)
        if held:
            yield _batch([(held[-1][0], None, None, None, None, None, None)], held[-1][1], 1)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                yield results([(i, t), (None, n)]).select(range(7))

    wide = f"{RESULT}, text string, tail int"
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    out = materialise(dealt.mapInArrow(run, wide), "fingerprints")
    ends = out.where("tail is not null").select("doc_id", "text", "tail")
    # In order of id, a head comes before the tail of its own range, also where they are one row.
    order = Window.orderBy(F.col("doc_id").asc_nulls_first(), "text", "tail")
    numbered = ends.withColumn("__n", F.row_number().over(order))
    count = F.count(F.lit(1)).over(Window.partitionBy())
    numbered = materialise(numbered.withColumn("__of", count), "range-ends")
    heads = numbered.where("tail = 0").select(F.col("text").alias("next"), F.col("__n").alias("h"))
    tails = numbered.where("tail = 1").withColumn("h", F.col("__n") % F.col("__of") + 1)
    last = tails.join(heads, "h").select("doc_id", "text", "next").mapInArrow(pairs, RESULT)
    return out.where("tail is null").drop("text", "tail").unionByName(last)


def _batch(rows: list[tuple], text: str | None = None, tail: int | None = None) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in RESULT.split(", ")]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    n = len(rows)
    return pa.RecordBatch.from_arrays([*columns, pa.array([text] * n, pa.string()), pa.array([tail] * n, pa.int32())], [*names, "text", "tail"])
