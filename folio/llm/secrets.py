"""Secret scans with multipart credential linking.

Plain patterns give spans that are reported by themselves: an assignment to
a secret's name, an access key id, a long hex string. Weak candidates are
parts that say nothing alone: an account name in an assignment (``id``), an
unnamed random-looking token (``key``), and an endpoint (``url``). A join of
intervals within a scope, the stretch of text between blank lines, reports a weak
candidate only when the same scope has a complementary part beside it, one that
does not overlap it, however far off (``reach`` can bound the distance in code points): a key needs
an identifier or an endpoint, an identifier or an endpoint needs a secret.
Access key ids count as identifiers, assignments and long hex strings as
secrets. Of weak candidates that overlap, an endpoint goes before an account name and
that before a key, so a path within an address is no key.

A key changes between letters and digits often and has many different
characters (``looks_random``); words, dates and paths of words do not.

Scopes never cross documents, so nothing is shuffled. Each candidate meets the
sorted starts and ends of the complements of its scope by binary search; no pairs
are made.

Defined cases: null text counts as empty; all offsets are code points, ends
exclusive; spans of one kind never overlap, base spans of different kinds may; a
span of a weak kind that overlaps a base span is dropped in favour of that;
an empty table gives an empty table; columns named ``base`` or ``spans`` are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folio.llm.common import text_chunks, texts, without

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: Runs of the class from where they start, so the least length can stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ACCOUNT = re.compile(r"""\b(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})""", re.ASCII | re.IGNORECASE)
RANDOM = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
ENDPOINT = re.compile(r"""\b[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]{3,}|\b(?:\d{1,3}\.){3}\d{1,3}:\d{2,5}\b""", re.ASCII)
SCOPE_END = re.compile(r"\r?\n[ \t]*\r?\n")
#: Least changes between letters and digits, as a share of the places for one, and least bits a character.
CHANGES, BITS = 0.12, 3.0
IDENTIFIERS, SECRETS = ("id", "access", "url"), ("assign", "hex", "key")

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "key", "id", "url")
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def looks_random(token: str) -> bool:
    """Digits and letters of any case well mixed, in many different characters: hex, base32, base36, UUIDs and base64 alike."""
    digit = [c.isdigit() for c in token if c.isalnum()]
    changes = sum(a != b for a, b in zip(digit, digit[1:], strict=False))
    if changes < 3 or changes < CHANGES * (len(digit) - 1):
        return False
    n = len(token)
    return -sum(c / n * log2(c / n) for c in Counter(token).values()) >= BITS


def weak_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates outside the base spans and each other; never reported without a complement."""
    out: list[tuple[str, int, int]] = []
    taken = [(s[1], s[2]) for s in base]
    for kind, pattern in (("url", ENDPOINT), ("id", ACCOUNT), ("key", RANDOM)):
        starts, ends = sorted(a for a, _ in taken), sorted(b for _, b in taken)
        own = [
            (kind, m.start(), m.end())
            for m in pattern.finditer(text)
            # as many taken spans begin before its end as end before its start: none overlaps it
            if bisect_left(starts, m.end()) == bisect_right(ends, m.start()) and (kind != "key" or looks_random(m[0]))
        ]
        out += own
        taken += [(a, b) for _, a, b in own]
    return out


def beside(spans: list[tuple[int, int]], reach: int | None):
    """A test whether any of ``spans`` lies before or after an interval without overlapping it, within ``reach``."""
    starts, ends = sorted(a for a, _ in spans), sorted(b for _, b in spans)

    def test(a: int, b: int) -> bool:
        before, after = bisect_right(ends, a), bisect_left(starts, b)
        if before and (reach is None or ends[before - 1] >= a - reach):
            return True
        return after < len(starts) and (reach is None or starts[after] <= b + reach)

    return test


def linked(text: str, base: list[tuple[str, int, int]], reach: int | None = None) -> list[tuple[str, int, int]]:
    """The weak candidates that have a complement in their scope."""
    weak = weak_spans(text, base)
    if not weak:
        return []
    cuts = [m.start() for m in SCOPE_END.finditer(text)]
    scopes: dict[int, list[tuple[str, int, int]]] = {}
    for s in (*weak, *base):
        scopes.setdefault(bisect_right(cuts, s[1]), []).append(s)
    out = []
    for parts in scopes.values():
        identifier, secret = (beside([(a, b) for k, a, b in parts if k in kinds], reach) for kinds in (IDENTIFIERS, SECRETS))
        out += [s for s in parts if s[0] == "key" and identifier(s[1], s[2])]
        out += [s for s in parts if s[0] in ("id", "url") and secret(s[1], s[2])]
    return out


def scan(docs: DataFrame, text: str = "text", reach: int | None = None) -> DataFrame:
    """``docs`` with ``spans`` and ``base``: arrays of (kind, start, end) by start, then kind as in ``KINDS``."""
    docs = without(docs, ["base", "spans"])
    schema = T.StructType([*docs.schema.fields, T.StructField("base", T.ArrayType(SPAN)), T.StructField("spans", T.ArrayType(SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for chunk in text_chunks(batches, text):
            all_base, all_spans = [], []
            for t in texts(chunk, text):
                base = base_spans(t)
                spans = sorted(base + linked(t, base, reach), key=lambda s: (s[1], KINDS.index(s[0])))
                for to, found in ((all_base, base), (all_spans, spans)):
                    to.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
            yield pa.RecordBatch.from_arrays([*chunk.columns, pa.array(all_base, kind), pa.array(all_spans, kind)], [*chunk.schema.names, "base", "spans"])

    return docs.mapInArrow(run, schema)
