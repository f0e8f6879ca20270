"""Merkle manifest of a dataset with nested-interval labels.

Every row is a leaf, the SHA-256 of its columns with their lengths. The leaves of
a part (a source) are in order, every ``arity`` consecutive nodes become one node
of the next level, the hash of their digests, and so on up to one node, the
part's root. The parts' roots, in order of the parts, are the leaves of the same
kind of tree, whose root is the dataset's.

Labels: a node carries its level and the interval of leaf ranks it covers. The
nodes of a level fall into buckets of the interval length of the level above, so
that a node's parent is found by an equi-join on (part, bucket), checked by
containment; a node's siblings are the nodes that cover the rest of the parent's
interval, those before its own and those after. Level by level from the top,
nodes get their path: the digests to the left and right of it and of each of its
ancestors. A proof is these digests from the leaf up.

Ranks: leaves are dealt to ranges of (part, order) by sampling and sorted in
them; a rank is the place in the range and the sum of the part's rows in the
ranges before, from a row for each range and part. No window holds a part, so a
hot part is spread over many tasks. At every level a group is at most ``arity``
nodes. Each level is written to the shared checkpoint folder.

Defined cases: a null value is hashed as ``-``; null parts come first, null ids
come first in their part, rows with equal ids are ordered by their leaf, and equal
rows are interchangeable; a part of one row has its leaf as root; empty texts
have length 0; an empty table has no leaves and no root; columns with the names
of the output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import materialise, without

ARITY = 16
#: The hashed columns, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
OUTPUT = ["leaf", "subroot", "root", "path"]


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(fields: list[Column]) -> Column:
    """Hash of the fields, each with its length in bytes, so that no two lists of values give the same text."""

    def one(c: Column) -> Column:
        value = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return sha(F.concat(*[one(c) for c in fields]))


def _digests(nodes: Column | str) -> Column:
    return F.array_join(F.transform(nodes, lambda n: n["digest"]), "")


def ranked(rows: DataFrame, part: str, order: list[str], ranges: int) -> DataFrame:
    """``rows`` with ``rank``, from 0 in each part, and ``part_rows``.

    ``__row``, a number written with the rows, parts even equal rows from each other.
    """
    by = [F.col(c).asc_nulls_first() for c in (part, *order, "__row")]
    dealt = rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    dealt = dealt.withColumn("__range", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id())
    dealt = materialise(dealt, "merkle-ranges")
    counts = dealt.groupBy(F.col(part).alias("__part"), F.col("__range").alias("__r")).agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__n"))
    # A row for each range that a part has rows in: at most ``ranges`` of a part.
    before = F.sum("__n").over(Window.partitionBy("__part").orderBy("__r")) - F.col("__n")
    total = F.sum("__n").over(Window.partitionBy("__part"))
    starts = counts.select("__part", "__r", (before - F.col("__first")).alias("__shift"), total.alias("part_rows"))
    out = dealt.join(starts, F.col("__range").eqNullSafe(F.col("__r")) & F.col(part).eqNullSafe(F.col("__part")))
    return out.withColumn("rank", F.col("__place") + F.col("__shift")).drop("__row", "__range", "__place", "__part", "__r", "__shift")


def levels_of(leaves: DataFrame, arity: int) -> list[DataFrame]:
    """Nodes (part, part_rows, lo, hi, digest) of each level; those above the leaves have ``children`` too.

    ``leaves`` are (part, part_rows, rank, digest) and any other columns, which the leaves' level keeps.
    A part ends at the level where it has one node.
    """
    nodes = leaves.withColumnsRenamed({"rank": "lo"}).withColumn("hi", F.col("lo"))
    most = nodes.agg(F.max("part_rows")).first()[0] or 0
    out, width = [nodes], 1
    while width < most:
        below = out[-1].where(F.col("part_rows") > width)
        width *= arity
        bucket = F.col("lo") - F.col("lo") % width
        up = below.groupBy("part", "part_rows", bucket.alias("bucket")).agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children"))
        up = up.select("part", "part_rows", F.col("bucket").alias("lo"), F.element_at("children", -1)["hi"].alias("hi"), sha(_digests("children")).alias("digest"), "children")
        out.append(materialise(up, f"merkle-level{len(out)}"))
    return out


def _tops_at(levels: list[DataFrame], k: int, arity: int) -> DataFrame:
    """The nodes of a level that are their part's root."""
    return levels[k].where((F.col("part_rows") <= arity**k) & (F.col("part_rows") > (arity ** (k - 1) if k else 0)))


def roots(levels: list[DataFrame], arity: int) -> DataFrame:
    """(part, digest) of each part's root."""
    out = None
    for k in range(len(levels)):
        own = _tops_at(levels, k, arity).select("part", "digest")
        out = own if out is None else out.unionByName(own)
    return out


def with_paths(levels: list[DataFrame], tops: DataFrame | None, arity: int) -> DataFrame:
    """The leaves with ``path`` and ``subroot``: the siblings (left, right) of the leaf and of each of
    its ancestors, followed by what ``tops`` (part, above, subroot) has for the part's root, if given."""

    def started(own: DataFrame) -> DataFrame:
        if tops is None:
            return own.withColumn("path", F.expr(NO_PATH)).withColumn("subroot", F.lit(None).cast("string"))
        found = tops.withColumnsRenamed({"part": "__part", "above": "path"})
        return own.join(found, F.col("part").eqNullSafe(F.col("__part"))).drop("__part")

    upper = None
    for k in range(len(levels) - 1, -1, -1):
        nodes = levels[k]
        got = started(_tops_at(levels, k, arity))
        if upper is not None:
            width = arity ** (k + 1)
            parents = upper.select(*[F.col(c).alias(f"__{c}") for c in ("part", "lo", "hi", "children", "path", "subroot")])
            below = nodes.where(F.col("part_rows") > arity**k).withColumn("__bucket", F.col("lo") - F.col("lo") % width)
            inside = below.join(parents, F.col("part").eqNullSafe(F.col("__part")) & (F.col("__bucket") == F.col("__lo")) & (F.col("hi") <= F.col("__hi")))
            # The rest of the parent's interval: before and after the node's own.
            left = _digests(F.filter("__children", lambda c: c["hi"] < F.col("lo")))
            right = _digests(F.filter("__children", lambda c: c["lo"] > F.col("hi")))
            path = F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("__path"))
            got = got.unionByName(inside.select(*nodes.columns, F.col("__subroot").alias("subroot"), path.alias("path")))
        if k:
            upper = materialise(got, f"merkle-path{k}")
    return got


NO_PATH = "cast(array() as array<struct<left: string, right: string>>)"


def fold_up(digest: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, digest, lambda d, p: sha(F.concat(p["left"], d, p["right"])))


def proof(path: Column) -> Column:
    """All sibling digests of a path in one text, from the leaf up, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def with_leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``docs`` with ``leaf``, the hash of ``fields``."""
    return without(docs, OUTPUT).withColumn("leaf", leaf([F.col(c) for c in fields]))


def manifest(leaves: DataFrame, part: str = "source", order: str = "doc_id", arity: int = ARITY, rows_per_range: int = 1 << 16) -> DataFrame:
    """``leaves`` (rows with ``leaf``) with ``subroot``, ``root`` and ``path``, whose fold over the leaf is the root.

    All columns go through the sort: leave texts out.
    """
    rest = without(leaves, OUTPUT[1:])
    rows = rest.select(F.struct(*rest.columns).alias("row"), F.col(part).alias("part"), F.col(order).alias("order"), F.col("leaf").alias("digest"))
    rows = materialise(rows.withColumn("__row", F.monotonically_increasing_id()), "merkle-rows")
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // rows_per_range))
    levels = levels_of(materialise(ranked(rows, "part", ["order", "digest"], ranges), "merkle-ranks"), arity)

    # The parts' roots are the leaves of a tree of its own.
    parts = roots(levels, arity).select(F.lit(0).alias("part"), F.col("part").alias("name"), "digest")
    parts = materialise(parts.withColumn("__row", F.monotonically_increasing_id()), "merkle-parts")
    high = levels_of(materialise(ranked(parts, "part", ["name"], ranges), "merkle-part-ranks"), arity)
    root = (roots(high, arity).first() or {"digest": None})["digest"]
    tops = with_paths(high, None, arity).select(F.col("name").alias("part"), F.col("path").alias("above"), F.col("digest").alias("subroot"))
    paths = with_paths(levels, materialise(tops, "merkle-tops"), arity)
    return paths.select("row.*", "subroot", F.lit(root).cast("string").alias("root"), "path")
