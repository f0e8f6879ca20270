"""Sharding into near-equal bytes by a minimax contiguous partition, in DataFrame functions only.

Rows with equal text are one atomic group and go to one shard. Groups are put
in order, and the shards are stretches of that order with the smallest possible
size of the largest one: the capacity is found by binary search, each capacity
checked by filling one shard after the other greedily, and the order is cut
where that filling ends its shards.

Order. A group that is as large as the share of a shard, or larger, is a shard
by itself, whatever its neighbours: such groups come first, by size, and the
others share the shards that are left, in the order of their SHA-256.

Sums. The bytes and rows before each group are running sums in three levels: in
a bin of the digest's leading bits, over the bins of a stretch, and over the
stretches; the number of bins follows that of the groups, so no window grows
with the table or with a group. A group with more than a thousandth of all rows
(at most ``parts`` groups, a broadcast) is split by the MD5 of the ids, so its
rows are numbered and joined part by part.

Search. The driver gets ``points`` ends of groups, not all: of each cell of w
bytes the last end. Filling these with capacity C + w reaches at least as far as
filling all ends with C, so the least capacity found lies within w of the true
one, and each cut between those of the two fillings. The next round takes only
ends between these bounds, in smaller cells, until every end there is taken and
the search is exact; the bounds shrink to about a hundredth each time.

Defined cases: a null text has no bytes and is in the group of the empty text;
rows with equal ids and text are interchangeable; null ids come first in a
group; fewer groups than shards leave the last shards empty; an empty table
gives an empty table; columns with the names of the output are replaced, all
others but the text are kept.
"""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import materialise, without

OUTPUT = ["size", "text_crc32", "text_sha256", "shard", "slot"]
#: Bytes of a row besides its text.
ROW_BYTES = 8


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``size``, ``text_crc32`` and ``text_sha256`` (binary)."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rest = without(docs, OUTPUT)
    return rest.select(
        *[c for c in rest.columns if c != text],
        (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.unhex(F.sha2(body, 256)).alias("text_sha256"),
    )


def _leading(digest: Column, bits: int) -> Column:
    """The first ``bits`` (32 at most) of a digest, as a number."""
    return F.shiftright(F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long"), 32 - bits)


def oversized(largest: list[tuple[int, bytes]], total: int, shards: int) -> list[tuple[int, bytes]]:
    """Of the largest groups (size, digest), in order, those that fill a shard by themselves."""
    out: list[tuple[int, bytes]] = []
    for size, digest in largest:
        if shards - len(out) < 2 or size * (shards - len(out)) < total:
            break
        out.append((size, digest))
        total -= size
    return out


def filled(ends: list[int], capacity: int, shards: int) -> list[int]:
    """The ends of the shards that greedy filling with ``capacity`` gives, as far as it gets."""
    cuts, at = [], 0
    for _ in range(shards):
        k = bisect_right(ends, at + capacity)
        if not k or ends[k - 1] <= at:
            break
        at = ends[k - 1]
        cuts.append(at)
    return cuts


def least_capacity(ends: list[int], low: int, high: int, shards: int) -> int:
    """The smallest capacity in [low, high] whose greedy filling reaches the last end; ``high`` does."""
    while low < high:
        middle = (low + high) // 2
        cuts = filled(ends, middle, shards)
        if cuts and cuts[-1] == ends[-1]:
            high = middle
        else:
            low = middle + 1
    return low


def cut(units: DataFrame, total: int, largest: int, shards: int, points: int) -> list[int]:
    """The ends of the minimax shards, from the running sums ``end`` of the groups in order."""
    if not total or shards < 1:
        return []
    ends = units.where("end is not null").select("end")
    low, high = max(-(-total // shards), largest), -(-total // shards) + largest
    windows, cell = [(0, total)], max(1, -(-total // points))
    while True:
        # Per cell the last end (a cell of one byte has every end); `high` is enough for all ends, so a cell more is for these.
        near = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in windows])
        inside = ends.where(F.exists(near, lambda w: (F.col("end") >= w["a"]) & (F.col("end") <= w["b"])) & F.col("end").between(windows[0][0], windows[-1][1]))
        kept = sorted({r[0] for r in inside.groupBy(F.floor(F.col("end") / F.lit(cell))).agg(F.max("end")).select("max(end)").collect()} | {total})
        found = least_capacity(kept, low, high + cell, shards)
        if cell == 1:  # every end that matters was there
            return filled(kept, found, shards)
        low, high = max(low, found - cell), found
        windows = _joined(list(zip(_padded(filled(kept, low, shards), shards), _padded(filled(kept, high + cell, shards), shards), strict=True)))
        # Fewer bytes between the bounds than points: every end is taken.
        cell = max(1, min(-(-sum(b - a + 1 for a, b in windows) // points), cell // 64))


def _padded(cuts: list[int], shards: int) -> list[int]:
    return cuts + [cuts[-1] if cuts else 0] * (shards - len(cuts))


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _before(units: DataFrame, bits: int) -> DataFrame:
    """``units`` (front, text_sha256, part, n, bytes, last) with the rows and bytes before each, in order.

    ``front`` is the place of an oversized group among these, null for all others, which follow.
    """
    halves = bits // 2
    u = units.withColumn("__bin", F.when(F.col("front").isNotNull(), F.lit(-1).cast("long")).otherwise(_leading(F.col("text_sha256"), bits)))
    u = u.withColumn("__stretch", F.shiftright("__bin", halves))
    bins = u.groupBy("__stretch", "__bin").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    stretches = bins.groupBy("__stretch").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    over = Window.orderBy("__stretch")  # 2^(bits - halves) rows
    stretches = stretches.select("__stretch", (F.sum("n").over(over) - F.col("n")).alias("__n2"), (F.sum("bytes").over(over) - F.col("bytes")).alias("__b2"))
    over = Window.partitionBy("__stretch").orderBy("__bin")  # 2^halves rows
    bins = bins.select("__stretch", "__bin", (F.sum("n").over(over) - F.col("n")).alias("__n1"), (F.sum("bytes").over(over) - F.col("bytes")).alias("__b1"))
    base = bins.join(stretches, "__stretch").select("__bin", (F.col("__n1") + F.col("__n2")).alias("__n0"), (F.col("__b1") + F.col("__b2")).alias("__b0"))
    over = Window.partitionBy("__bin").orderBy("front", "text_sha256", "part")
    u = u.withColumn("__n", F.sum("n").over(over) - F.col("n")).withColumn("__b", F.sum("bytes").over(over) - F.col("bytes"))
    return u.join(base, "__bin").select("front", "text_sha256", "part", "n", "bytes", "last", (F.col("__n0") + F.col("__n")).alias("rows_before"), (F.col("__b0") + F.col("__b")).alias("bytes_before"))


def shard(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", parts: int = 1024, groups_per_bin: int = 4096, points: int = 1 << 16) -> DataFrame:
    """``docs`` without the text, with ``size``, ``text_crc32``, ``text_sha256``, ``shard`` and ``slot``, the row's place in it.

    A row's place follows the order of the groups, and within a group the MD5 of its id and the id.
    """
    rows = materialise(sized(docs, text), "shard-rows")
    groups = materialise(rows.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")), "shard-groups")
    n_rows, total, n_groups = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    top = [(r["bytes"], bytes(r["text_sha256"])) for r in groups.orderBy(F.desc("bytes"), "text_sha256").limit(shards + 1).collect()]
    front = oversized(top, total, shards)

    # Groups with many rows, in parts; at most `parts` groups have more than a `parts`th of all rows.
    share = max(1, n_rows // parts)
    heavy = groups.where(F.col("n") > share).select("text_sha256", F.ceil(F.col("n") / share).cast("long").alias("__parts"))
    order = F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    rows = rows.join(F.broadcast(heavy), "text_sha256", "left").withColumn("__order", order)
    rows = rows.withColumn("part", F.when(F.col("__parts").isNotNull(), F.shiftright(F.col("__order") * F.col("__parts"), 32)).otherwise(F.lit(0)).cast("int"))
    split = rows.where("__parts is not null").groupBy("text_sha256", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    # A group ends where its last part does; the others' ends are no place to cut at.
    split = split.withColumn("last", F.max("part").over(Window.partitionBy("text_sha256")) == F.col("part"))
    whole = groups.join(F.broadcast(heavy), "text_sha256", "left_anti")
    units = whole.select("text_sha256", F.lit(0).alias("part"), "n", "bytes", F.lit(True).alias("last")).unionByName(split)
    place = F.lit(None).cast("int")
    for k, (_, digest) in enumerate(front):
        place = F.when(F.col("text_sha256") == F.lit(bytearray(digest)), F.lit(k)).otherwise(place)
    # As many bins as give about `groups_per_bin` groups each.
    bits = min(32, max(2, math.ceil(math.log2(max(1, n_groups / groups_per_bin)))))
    units = _before(units.withColumn("front", place), bits)
    ahead = sum(size for size, _ in front)
    end = F.when(F.col("last") & F.col("front").isNull(), F.col("bytes_before") + F.col("bytes") - F.lit(ahead))
    units = materialise(units.withColumn("end", end), "shard-units")

    left = [t for t in top if t not in front]
    cuts = cut(units, total - ahead, left[0][0] if left else 0, shards - len(front), points)
    # Where each shard ends, in bytes of the whole order; a group lies in the first that ends after its start.
    bounds, at = [], 0
    for size, _ in front:
        at += size
        bounds.append(at)
    bounds += [at + c for c in cuts]
    ends = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    units = units.withColumn("shard", F.size(F.filter(ends, lambda b: b <= F.col("bytes_before"))))
    first = {r["shard"]: r["rows"] for r in units.groupBy("shard").agg(F.min("rows_before").alias("rows")).collect()}  # a row per shard
    start = F.element_at(F.array(*[F.lit(first.get(k, 0)).cast("long") for k in range(max(1, shards))]), F.col("shard") + 1)
    units = units.select("text_sha256", "part", "shard", (F.col("rows_before") - start).alias("__start"))
    nth = F.row_number().over(Window.partitionBy("text_sha256", "part").orderBy("__order", F.col(doc_id).asc_nulls_first()))
    out = rows.join(units, ["text_sha256", "part"]).withColumn("slot", F.col("__start") + nth - 1)
    return out.select(*[c for c in rows.columns if c not in ("part", "__parts", "__order", *OUTPUT)], *OUTPUT)
