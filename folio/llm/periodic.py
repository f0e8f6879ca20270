"""Periodic runs of words, found with a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) that is at least ``least`` words and ``times`` periods long and
that no neighbouring word extends keeping the period. Words stand between ASCII
white space and are compared by 64-bit hashes of their bytes.

Dictionary: for every power of two L, each place of a text has a name, equal
for two places exactly if the L words from there are the same. The names of
length 2L come from pairs of names of length L, by one sort. A place whose
factor occurs once in its text has no name, and neither have its longer
factors, so ordinary prose is out of the dictionary after a few lengths.

Proposals: successor occurrences of a factor within a stretch of twice its
length form an arithmetic progression, whose difference is a period of the
stretch. A run of period q, three periods long or more, has a factor of length
L at its start with L / 2 < q <= L whose next occurrence is q further on: with
a whole period inside, it cannot occur in between. So per length only
successors at distances in (L / 2, L] propose, and of a progression, and of
neighbouring places with the same distance, only the first.

Extension: each proposal is extended to both sides by the longest common
extension of the two occurrences, which is a descent through the lengths of the
dictionary. Stretches that are too short go, equal ones are one run, with the
smallest period proposed.

Texts are worked on in chunks of about a megabyte, end to end, and names hold
the number of the text, so that numpy handles many texts at once. Nothing is
shuffled; a task holds one chunk, or one text if that is longer, and its
dictionary of four bytes for each word and length.

Defined cases: null and empty texts have no words, no runs and an empty
``collapsed``; repeated rows get equal results each; columns named ``n_words``,
``runs`` or ``collapsed`` are replaced, all others are kept; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folio.llm.common import SPACE, prefix_hash, span_hash, text_bytes, text_chunks, without, word_spans

OUTPUT = ["n_words", "runs", "collapsed"]
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
NONE = np.int32(-1)


def _named(keys: np.ndarray, places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of all ``n`` places by ``keys`` (of ``places``; a key that occurs once gives none), and
    the places with a name, by name and then place."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = k[1:] != k[:-1]
    again = ~new
    again[:-1] |= ~new[1:]  # with an equal neighbour on either side
    names = np.full(n, NONE, dtype=np.int32)
    order = order[again]
    names[places[order]] = np.cumsum(new[again], dtype=np.int32)
    return names, places[order]


def dictionary(words: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(names, places by name) for the lengths 1, 2, 4, ... until nothing repeats in any text.

    ``at``: where each text starts in ``words`` (texts + 1 entries).
    """
    n = len(words)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    _, word = np.unique(words, return_inverse=True)
    names, places = _named(text * np.int64(n + 1) + word, np.arange(n), n)
    length = 1
    while len(places):
        yield names, places
        # Of both halves; names hold the text, so a pair across two texts never is one of a single text,
        # but it must not be named at all.
        first = np.flatnonzero(names[: max(n - length, 0)] != NONE)
        first = first[(names[first + length] != NONE) & (text[first] == text[first + length])]
        names, places = _named(names[first] * np.int64(n + 1) + names[first + length], first, n)
        length *= 2


def _proposals(places: np.ndarray, names: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the successor occurrences that propose a period at this length."""
    distance = places[1:] - places[:-1]
    near = (names[places[1:]] == names[places[:-1]]) & (distance <= length) & (2 * distance > length)
    # Within a progression only its first step proposes.
    near[1:] &= ~(near[:-1] & (distance[1:] == distance[:-1]))
    here, apart = places[:-1][near], distance[near]
    order = np.lexsort((here, apart))
    here, apart = here[order], apart[order]
    first = np.ones(len(here), dtype=bool)
    first[1:] = (here[1:] != here[:-1] + 1) | (apart[1:] != apart[:-1])
    return here[first], apart[first]


def _extended(levels: list[np.ndarray], here: np.ndarray, apart: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The whole stretch (start, end) that keeps the distance around each proposal."""
    right, left = here + apart, here.copy()
    for k in range(len(levels) - 1, -1, -1):
        names, step = levels[k], 1 << k
        inside = np.minimum(right, n - 1)
        same = (right < n) & (names[inside] != NONE) & (names[inside] == names[inside - apart])
        right = right + step * same
    for k in range(len(levels) - 1, -1, -1):
        names, step = levels[k], 1 << k
        back = np.maximum(left - step, 0)
        same = (left >= step) & (names[back] != NONE) & (names[back] == names[np.minimum(back + apart, n - 1)])
        left = left - step * same
    return left, right


def find(words: np.ndarray, at: np.ndarray, least: int = 24, times: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start in it, length and period of every run of the texts that lie end to end in ``words``."""
    n, levels, here, apart = len(words), [], [], []
    for names, places in dictionary(words, at):
        a, b = _proposals(places, names, 1 << len(levels))
        here.append(a)
        apart.append(b)
        levels.append(names)
    if not levels:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    p = np.concatenate(apart)
    start, end = _extended(levels, np.concatenate(here), p, n)
    long = end - start >= np.maximum(least, times * p)
    start, end, p = start[long], end[long], p[long]
    order = np.lexsort((p, end, start))
    start, end, p = start[order], end[order], p[order]
    first = np.ones(len(start), dtype=bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, p = start[first], end[first], p[first]
    text = np.searchsorted(at, start, side="right") - 1
    order = np.lexsort((p, start, text))
    return text[order], (start - at[text])[order], (end - start)[order], p[order]


def _repeats(n: int, at: np.ndarray, text: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words some run contains after its first period."""
    depth = np.zeros(n + 1, dtype=np.int64)
    np.add.at(depth, at[text] + start + period, 1)
    np.add.at(depth, at[text] + start + length, -1)
    return np.cumsum(depth[:-1]) > 0


def detect(docs: DataFrame, text: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length, period in words, by start and then period)
    and ``collapsed``, the text's words without those that repeat a run's first period, joined by a space."""
    rest = without(docs, OUTPUT)
    schema = T.StructType([*rest.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, text):
            data, offsets = text_bytes(chunk.column(chunk.schema.get_field_index(text)))
            starts, ends, at = word_spans(data, offsets, ~SPACE)
            found = find(span_hash(prefix_hash(data), starts, ends), at, least, times)
            drop = _repeats(len(starts), at, *found)
            raw, rows = data.tobytes(), chunk.num_rows
            collapsed = []
            for i in range(rows):
                own = raw[offsets[i] : offsets[i + 1]].split()
                gone = drop[at[i] : at[i + 1]]
                collapsed.append(b" ".join([w for w, d in zip(own, gone.tolist(), strict=True) if not d] if gone.any() else own))
            counts = np.bincount(found[0], minlength=rows)
            runs = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found[1:]], [f.name for f in RUN]))
            yield pa.RecordBatch.from_arrays([*chunk.columns, pa.array(np.diff(at), pa.int64()), runs, pa.array(collapsed, pa.binary()).cast(pa.string())], schema.names)

    return rest.mapInArrow(run, schema)
