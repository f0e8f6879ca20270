"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every document has a size in words and a key ``-ln(u) / weight`` with ``u``
from a digest of its id: taking the smallest keys first samples without
replacement, in proportion to the weights. Per source, whole epochs come
first and the rest of the target is the documents with the smallest keys
whose sizes prefix-sum to it.

Only the documents near the cut need that prefix sum. Keys map to slices in
order, sizes are pre-aggregated per (source, slice) in the tasks, and a
running sum over the slices finds the slice the cut lies in; rows with a
smaller key than its are taken whole, rows with a larger one not at all. A
cut's slice with more than ``rows_per_bin`` rows is sliced again between its
own smallest and largest key, as often as it takes: the slices follow the
rows whatever the weights are. A window then sorts only the rows of the last
slice. One window holds a row per slice (``SLICES`` a source at most, as it
is a fan-out and no limit), the other about ``rows_per_bin`` rows; only rows
of one key, so of one id and weight, cannot be told apart by slices.

Defined cases: null text has size 0 and is never taken; a null source is a
source of its own, last in order; equal keys (repeated ids) are ordered by
size, and rows equal in both are interchangeable; no documents or no words
give targets of 0; null or non-positive quality weights count as 1; columns
named like an output are replaced by ``mix`` and kept by ``apply_mix``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import materialise, without

#: Slices a pass cuts a range of keys into; a pass over a smaller range follows where that is too coarse.
SLICES = 1 << 12
#: Columns that ``with_keys`` and ``mix`` add.
OUTPUT = ("size", "key", "source_size", "target", "taken")

#: Possessive, as a word has one end only: no states are kept for going back.
WORD = r"[^\x20\x09-\x0D]++"
#: Characters that count against a document's quality weight.
JUNK = "0123456789!|*#$%&@<>{}[]=_~^"
#: Mixing weights, dealt to the sources in order and repeated.
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sampling_key(doc_id: Column, weight: Column, seed: str = "mix") -> Column:
    """-ln(u) / weight; u in (0, 1) from the first 52 bits of md5(seed:id)."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long")
    return -F.log((bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))) / F.when(weight > 0, weight.cast("double")).otherwise(F.lit(1.0))


def quality_weight(text: Column) -> Column:
    """Fourth power of the share of characters outside ``JUNK``, 0.01 at least; 1 for empty text.

    A power and not a product: a product would read the text once per factor.
    """
    n = F.length(text)
    junk = F.regexp_count(text, F.lit(f"[{re.escape(JUNK)}]"))
    return F.when(n > 0, F.greatest(F.lit(0.01), F.pow((n - junk) / n, F.lit(4)))).otherwise(F.lit(1.0))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row per source.

    The total is ``share`` of all sizes. A source is capped at ``most`` times
    its size; what it cannot take is shared among the others by weight, until
    none is above its cap. In closed form: with the sources in order of
    cap / weight, a prefix is capped, and the first level ``rest / weights``
    that no later source's ratio is below holds for all later ones. Its input
    is one row per source, never a row per document.
    """
    dealt = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("__at") - 1, F.lit(len(weights))) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("__at", F.row_number().over(by_name)).withColumn("__w", dealt.cast("long")).withColumn("__cap", F.col("source_size") * most)
    by_ratio = Window.orderBy((F.col("__cap") / F.col("__w")).asc(), F.col("__at").asc())
    whole = Window.partitionBy()
    # Level if exactly the sources before this one are capped, as a fraction of whole numbers: (3 * all / 2 - caps) / weights.
    s = (
        s.withColumn("__num", share[0] * F.sum("source_size").over(whole) - share[1] * (F.sum("__cap").over(by_ratio) - F.col("__cap")))
        .withColumn("__den", share[1] * (F.sum("__w").over(whole) - F.sum("__w").over(by_ratio) + F.col("__w")))
        .withColumn("__fits", F.col("__cap") * F.col("__den") >= F.col("__num") * F.col("__w"))
    )
    level = F.first(F.when(F.col("__fits"), F.struct("__num", "__den")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    s = s.withColumn("__level", level)
    return s.select(
        "source",
        "source_size",
        F.when(F.col("__level").isNull(), F.col("__cap").cast("double")).otherwise((F.col("__w") * F.col("__level.__num")) / F.col("__level.__den")).alias("target"),
    )


def with_keys(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: Column | None = None, seed: str = "mix") -> DataFrame:
    """``docs`` with ``size`` in words and the sampling ``key``; ``quality`` is an expression over ``docs``."""
    q = F.lit(1.0) if quality is None else quality
    rest = without(docs, ["size", "key"]).columns
    # The key uses the weight more than once: it is a column first, so that the text is read once for it.
    weighed = docs.select(*rest, word_count(F.col(text)).alias("size"), q.alias("__quality"))
    return weighed.select(*rest, "size", sampling_key(F.col(doc_id), F.col("__quality"), seed).alias("key"))


def mix(sized: DataFrame, doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, rows_per_bin: int = 4096) -> DataFrame:
    """Rows of ``with_keys`` with ``source_size``, ``target`` (their source's) and ``taken`` words, repeats included."""
    sized = without(sized, ["source_size", "target", "taken"])
    name = F.col(source).cast("string")
    # Keys of weight 1 spread evenly over 1 - exp(-key).
    slice_ = F.least(F.floor((1 - F.exp(-F.col("key"))) * SLICES), F.lit(SLICES - 1))
    totals = materialise(sized.groupBy(name.alias("source"), slice_.alias("slice")).agg(*slice_sums()), "mix-slices")
    goal = targets(totals.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("rest", F.round("target").cast("long") - F.col("epochs") * F.col("source_size"))
    goal = materialise(goal, "mix-targets")
    cuts = materialise(cut_slices(totals.withColumn("below", F.lit(0).cast("long")), goal), "mix-cuts")
    wide = (F.col("n") > rows_per_bin) & (F.col("low") < F.col("high"))
    while not cuts.where(wide).isEmpty():
        # The ends of a range fall into different slices, so every pass leaves fewer rows.
        ranges = cuts.where(wide).select(F.col("source").alias("s"), "low", "high", "below")
        inner = sized.join(ranges, name.eqNullSafe(F.col("s")) & F.col("key").between(F.col("low"), F.col("high")))
        place = F.least(F.floor((F.col("key") - F.col("low")) / (F.col("high") - F.col("low")) * SLICES), F.lit(SLICES - 1))
        finer = inner.groupBy(F.col("s").alias("source"), place.alias("slice"), "below").agg(*slice_sums())
        cuts = materialise(cuts.where(~wide).unionByName(cut_slices(finer, goal)), "mix-cuts")
    marks = cuts.select(F.col("source").alias("s"), "low", "high", "below")
    goal = goal.join(marks, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    goal = materialise(goal.select(F.struct(*goal.columns).alias("__goal")), "mix-goals")  # a row per source
    rows = sized.join(goal, name.eqNullSafe(F.col("__goal.source")))
    at_cut = F.coalesce(F.col("key").between(F.col("__goal.low"), F.col("__goal.high")), F.lit(False))
    plain = rows.where(~at_cut).withColumn("__part", F.when(F.col("key") < F.col("__goal.low"), F.col("size")).otherwise(F.lit(0)))
    in_slice = Window.partitionBy("__goal.source").orderBy("key", doc_id, "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.col("__goal.below") + F.sum("size").over(in_slice) - F.col("size")
    sorted_ = rows.where(at_cut).withColumn("__part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("__goal.rest") - before)))
    taken = F.col("__goal.epochs") * F.col("size") + F.col("__part")
    return plain.unionByName(sorted_).select(*sized.columns, F.col("__goal.source_size").alias("source_size"), F.col("__goal.target").alias("target"), taken.alias("taken"))


def slice_sums() -> list[Column]:
    """What a slice is known by: its words, its rows, its smallest and largest key."""
    return [F.sum("size").alias("slice_size"), F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")]


def cut_slices(slices: DataFrame, goal: DataFrame) -> DataFrame:
    """(source, low, high, n, below): per source the slice in which the sizes reach ``rest``, and
    the words of all smaller keys. ``slices`` has the words below its whole range as ``below``."""
    under = F.col("below") + F.sum("slice_size").over(Window.partitionBy("source").orderBy("slice")) - F.col("slice_size")
    return (
        slices.withColumn("under", under)
        .join(goal.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
        .where("under < rest and rest <= under + slice_size")
        .select("source", "low", "high", "n", F.col("under").alias("below"))
    )


def apply_mix(docs: DataFrame, text: str = "text", quality: Column | None = None, **options) -> DataFrame:
    """``docs`` as the mix takes them: a row for each repeat; where only some words of a document
    are taken, its text ends with the last of them. ``n_chars``, if there, is that of the row."""
    own = {c: f"__own_{c}" for c in docs.columns if c.lower() in OUTPUT}
    weighed = docs.withColumn("__q", F.lit(1.0) if quality is None else quality).withColumnsRenamed(own)
    # The rows are used more than once below: words and marks are counted once, before.
    sized = materialise(with_keys(weighed, text=text, quality=F.col("__q")).drop("__q"), "mix-rows")
    mixed = mix(sized, **options).where("taken > 0")
    repeats = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / F.col("size"))))
    rows = mixed.withColumn("__repeat", repeats).withColumn("__words", F.col("taken") - F.col("__repeat") * F.col("size"))
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), F.col("__words").cast("int")), "")
    rows = rows.withColumn(text, F.when(F.col("__words") >= F.col("size"), F.col(text)).otherwise(first))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return rows.select([F.col(own.get(c, c)).alias(c) for c in docs.columns])
