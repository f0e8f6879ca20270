"""Harmonic packing of tokenized documents into fixed-length sequences.

A document's ids are cut into whole sequences, then pieces of half, a
quarter, ... of a sequence down to ``shortest``, then a rest. A piece longer
than ``capacity / (j + 1)`` and at most ``capacity / j`` belongs to class j,
and a bin of class j takes exactly j pieces. The cut sizes fill their bins
without padding; only rests, shorter than ``shortest``, leave any, less than
one piece in each bin. Every task fills its own bins: no shuffle, no state
between tasks, memory bounded by the open bins (fewer than j pieces for each
class met). At the end of a task the pieces of its open bins are packed
together, longest first, so a task leaves about one padded sequence.

Sequence ids are (partition, counter), hence the same on a retried task.

Defined cases: a null or empty text is the end id alone; a very long text
becomes many whole sequences; repeated rows are packed like any other.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import text_chunks, texts

CAPACITY = 2048
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The tokenizer's own pattern, for lower-case Latin-1 text (its normalizer leaves that as it is).
LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")


class Known(dict):
    """What ``make`` gave for each key: ``most`` keys are kept, none over 64 characters."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        out = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[key] = out
        return out


class CachedTokenizer:
    """Ids of a text as little-endian unsigned 32-bit bytes, with what it has seen kept.

    Text in Latin-1 is split by ``LATIN`` and each new part goes straight to
    the tokenizer's model. For any other text the whole tokenizer gets each
    new word: it drops white space and merges nothing across it, so ids of a
    text are those of its words end to end. ``parts`` are kept at most, none
    over 64 characters.
    """

    def __init__(self, path: str, parts: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.latin, self.words = Known(self._part, parts), Known(self._whole, parts)
        self.as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # The shortcut is for the tokenizer it stands for; with another one every word goes through whole.
        probe = "Abc,é. ÉTÉ!! it's ein-fach x27²½ I'LL µª\xa0b ß\x1cq"
        self.short = self._latin(probe) == b"".join(map(self._whole, probe.split(" ")))

    def _whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        mapped = part if part.isascii() and part.isprintable() else self.as_bytes.pre_tokenize_str(part)[0][0]
        return array("I", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()

    def _latin(self, text: str) -> bytes:
        return b"".join(map(self.latin.__getitem__, LATIN.findall(text.lower())))

    def __call__(self, text: str) -> bytes:
        if self.short and not any(s in text for s in self.special):
            try:
                text.encode("latin-1")
                return self._latin(text)
            except UnicodeEncodeError:
                pass
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> CachedTokenizer:
    return CachedTokenizer(path)


def cuts(n: int, capacity: int = CAPACITY, shortest: int = 128) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids."""
    out = [capacity] * (n // capacity)
    n %= capacity
    size = capacity // 2
    while n and size >= shortest and size * 2 * (capacity // (size * 2)) == capacity:
        if n >= size:
            out.append(size)
            n -= size
        size //= 2
    return [*out, n] if n else out


class HarmonicBins:
    """The open bins of one task; ``add`` and ``close`` yield (piece, bin, offset) of filled bins."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.open, self.bins = capacity, {}, 0

    def _fill(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for p in pieces:
            yield p, self.bins, at
            at += p[2]
        self.bins += 1

    def add(self, piece: tuple) -> Iterator[tuple]:
        """``piece``: (doc_id, start, length, ...)."""
        j = self.capacity // piece[2]
        held = self.open.setdefault(j, [])
        held.append(piece)
        if len(held) == j:
            yield from self._fill(self.open.pop(j))

    def close(self) -> Iterator[tuple]:
        rest, held, room = sorted((p for x in self.open.values() for p in x), key=lambda p: -p[2]), [], self.capacity
        self.open = {}
        lo, hi = 0, len(rest) - 1
        while lo <= hi:  # the longest that is left, then the shortest ones, while they fit
            if rest[lo][2] <= room:
                p, lo = rest[lo], lo + 1
            elif rest[hi][2] <= room:
                p, hi = rest[hi], hi - 1
            else:
                yield from self._fill(held)
                held, room = [], self.capacity
                continue
            held.append(p)
            room -= p[2]
        if held:
            yield from self._fill(held)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece, with its ids (``ids``: little-endian unsigned 32-bit); see ``SCHEMA``."""
    path = path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokenizer(path), np.asarray([end_id], dtype="<u4").tobytes()
        bins, first = HarmonicBins(capacity), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        out: list[tuple] = []
        held = 0

        def emit() -> pa.RecordBatch:
            rows = [(p[0], p[1], p[2], p[3], first + b, at, p[4]) for p, b, at in out]
            kinds = [pa.int64()] * 6 + [pa.binary()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for chunk in text_chunks(batches):
            for k, t in zip(chunk.column(0).to_pylist(), texts(chunk), strict=True):
                ids = encode(t) + end
                n, start = len(ids) // 4, 0
                for size in cuts(n, capacity):
                    out += bins.add((k, start, size, n, ids[4 * start : 4 * (start + size)]))
                    start += size
                    held += size
                if held >= 1 << 19:
                    if out:
                        yield emit()
                    out, held = [], 0
        out += bins.close()
        if out:
            yield emit()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)
