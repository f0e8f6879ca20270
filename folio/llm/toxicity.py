"""Toxicity by non-negative positive-unlabelled learning.

Training sees confirmed toxic texts and unlabelled text only: labels of
harmless text are not used but for the class prior. A linear classifier over
the presence of word features is fitted in ``numpy`` by the non-negative risk
estimator: with prior p, positive risk R+ and the risks R- of calling
positives and unlabelled texts negative, it minimises
``p R+(P) + max(0, R-(U) - p R-(P))``; while the second term would be
negative it has no gradient, so that the fit cannot gain from it.

Features are the words (ASCII lower case, letters and non-ASCII bytes) and
their first four to six bytes, as 64-bit hashes of whole texts. Feature
counts are summed in Spark over the training sample, at most ``positives``
toxic and ``unlabelled`` other texts, drawn in order of a digest of the id;
those in at least ``least`` toxic texts whose log share there exceeds that in the
others by ``least_lift``, and by ``least_gain`` over all these texts together, make
the model: thresholds of evidence, the same at every size, and no number of features. The driver gets the sample as rows of the indices of those features.
Scoring reads every whole text in the tasks.

Defined cases: null or empty text has no features and gets the score of the
bias; repeated rows score alike; without toxic training rows every score is
the prior (0 where there are no labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import LETTER, LOWER, prefix_hash, span_hash, text_bytes, text_chunks, without, word_spans

PREFIXES = (4, 5, 6)


@dataclass(frozen=True)
class Model:
    """``keys``: sorted feature hashes; a text's logit is ``bias`` plus the weights of those it has."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float


def features(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the features of each text, with repeats."""
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    data = LOWER[data]
    starts, ends, at = word_spans(data, offsets, LETTER)
    sums = prefix_hash(data)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    rows, hashes = [row], [span_hash(sums, starts, ends)]
    for n in PREFIXES:
        long = ends - starts > n
        rows.append(row[long])
        # a prefix is not the word of the same bytes
        hashes.append(span_hash(sums, starts[long], starts[long] + n) ^ np.uint64(0x5851F42D4C957F2D))
    return np.concatenate(rows), np.concatenate(hashes)


def sample(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> DataFrame:
    """(doc_id, positive): ids of the training sample, ``positives + unlabelled`` rows at most."""
    order = F.md5(F.concat(F.lit("sample:"), F.col("doc_id").cast("string")))
    toxic = labels.where("toxic = 1 and doc_id is not null").select("doc_id").distinct()
    known = docs.select("doc_id").where("doc_id is not null").distinct()
    p = known.join(toxic, "doc_id", "left_semi").orderBy(order).limit(positives).withColumn("positive", F.lit(True))
    u = known.orderBy(order).limit(unlabelled).withColumn("positive", F.lit(False))
    return p.unionByName(u)


def class_prior(labels: DataFrame) -> float:
    """Share of toxic rows among the labelled ones."""
    return float(labels.where("toxic is not null").agg(F.avg("toxic")).first()[0] or 0.0)


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None, positives: int = 20_000, unlabelled: int = 40_000, least: int = 3, least_lift: float = 0.5, least_gain: float = 8.0, seed: int = 7) -> Model:
    """From ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), training rows only."""
    prior = class_prior(labels) if prior is None else prior
    # The sample has a fixed bound, see its parameters; texts are not shuffled.
    chosen = F.broadcast(sample(docs, labels, positives, unlabelled).withColumnRenamed("doc_id", "__id"))
    rows = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("__id")).select("text", "positive")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, limit=4 << 20):
            row, h = features(chunk)
            positive = chunk.column("positive").to_numpy(zero_copy_only=False)
            # each feature once for a text
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))[: len(h)]
            row, h = row[new], h[new]
            keys, where = np.unique(h, return_inverse=True)
            p = np.bincount(where, weights=positive[row], minlength=len(keys)).astype(np.int64)
            n = np.bincount(where, minlength=len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(p), pa.array(n - p)], ["key", "p", "u"])

    sums = rows.mapInArrow(count, "key long, p long, u long").groupBy("key").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where(F.col("p") >= least)
    n_p, n_u = (rows.groupBy().agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()) or (0, 0)
    if not n_p or not n_u:
        return Model(np.zeros(0, dtype=np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))) if 0 < prior < 1 else (-40.0 if prior <= 0 else 40.0))
    lift = F.log(((F.col("p") + 0.5) / n_p) / ((F.col("u") + 0.5) / n_u))
    best = sums.where((lift > least_lift) & (F.col("p") * lift > least_gain)).select("key").toArrow()  # of the sample's features, whose number its bound bounds
    keys = np.sort(best.column("key").to_numpy().view(np.uint64))

    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            found = [x.tobytes() for x in present(chunk, keys)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), chunk.column("positive")], ["at", "positive"])

    data = rows.mapInArrow(active, "at binary, positive boolean").toArrow()
    at = data.column("at").to_pylist()
    flat = np.frombuffer(b"".join(at), dtype=np.int32)
    weights, bias = train(flat, np.asarray([len(x) // 4 for x in at]), data.column("positive").to_numpy(), len(keys), prior, seed)
    return Model(keys, weights, bias)


def present(chunk: pa.RecordBatch, keys: np.ndarray, column: str = "text") -> list[np.ndarray]:
    """Places in ``keys`` of the features of each text, each once."""
    row, h = features(chunk, column)
    if not len(keys):
        return [np.zeros(0, dtype=np.int32)] * chunk.num_rows
    at = np.searchsorted(keys, h)
    at[at == len(keys)] = 0
    hit = keys[at] == h
    pairs = np.unique(row[hit].astype(np.int64) * len(keys) + at[hit])
    cut = np.searchsorted(pairs, np.arange(1, chunk.num_rows) * len(keys))
    return [(x % len(keys)).astype(np.int32) for x in np.split(pairs, cut)]


class Rows:
    """Sparse 0/1 rows: the columns of all of them end to end, and how many each has."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.lengths = flat, lengths
        self.starts = np.cumsum(lengths) - lengths

    def take(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ids, column) of the entries of some rows."""
        n = self.lengths[ids]
        place = np.repeat(np.arange(len(ids)), n)
        inside = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
        return place, self.flat[np.repeat(self.starts[ids], n) + inside]


def train(flat: np.ndarray, lengths: np.ndarray, positive: np.ndarray, n: int, prior: float, seed: int = 7, epochs: int = 60, batch: int = 2048, rate: float = 0.05, decay: float = 2e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model by the non-negative risk estimator, with Adam."""
    rng = np.random.default_rng(seed)
    rows = Rows(flat, lengths)
    prior = min(max(prior, 1e-3), 0.999)
    w = np.zeros(n + 1)
    w[n] = np.log(prior / (1 - prior))  # the bias is the weight of a feature that all have
    m, v, step = np.zeros(n + 1), np.zeros(n + 1), 0
    p_all, u_all = np.flatnonzero(positive), np.flatnonzero(~positive)
    batches = max(1, len(u_all) // batch)
    average = np.zeros(n + 1)

    def logits(place: np.ndarray, column: np.ndarray, size: int) -> np.ndarray:
        return w[n] + np.bincount(place, weights=w[column], minlength=size)

    def gradient(place: np.ndarray, column: np.ndarray, each: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(column, weights=each[place], minlength=n), each.sum()) / len(each)

    for epoch in range(epochs):
        p_parts = np.array_split(rng.permutation(p_all), batches)
        for p_ids, u_ids in zip(p_parts, np.array_split(rng.permutation(u_all), batches), strict=True):
            if not len(p_ids):
                p_ids = rng.choice(p_all, 1)
            xp, xu = rows.take(p_ids), rows.take(u_ids)
            gp, gu = logits(*xp, len(p_ids)), logits(*xu, len(u_ids))
            sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
            # logistic loss: l(g, +1) = log(1 + e^-g), l(g, -1) = log(1 + e^g)
            negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            d_positive = prior * gradient(*xp, sp - 1)
            d_negative = gradient(*xu, su) - prior * gradient(*xp, sp)
            grad = d_positive + d_negative if negative >= 0 else d_positive
            grad = grad + decay * np.append(w[:n], 0)
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if epoch >= epochs // 2:
            average += w / (epochs - epochs // 2)
    return average[:n], float(average[n])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of being toxic."""
    docs = without(docs, ["score"])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for chunk in text_chunks(batches, text):
            g = np.asarray([m.bias + m.weights[x].sum() for x in present(chunk, m.keys, text)])
            yield pa.RecordBatch.from_arrays([*chunk.columns, pa.array(1 / (1 + np.exp(-np.clip(g, -500, 500))))], [*chunk.schema.names, "score"])

    return docs.mapInArrow(run, schema)
