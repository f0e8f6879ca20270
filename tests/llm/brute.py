"""Brute-force versions that several tests compare with."""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text: str | None) -> frozenset:
    w = WORD.findall(text or "")
    return frozenset(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_links(texts: dict) -> tuple[Counter, dict]:
    sets, shared, holders = {d: shingles(t) for d, t in texts.items()}, Counter(), defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    for own in holders.values():
        shared.update(itertools.combinations(own, 2))
    links, root = Counter(), {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return links, {d: find(d) for d in texts}


def runs(w: list, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence, period by period."""
    out: dict[tuple[int, int], int] = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, times * p):
                out.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in out.items())
