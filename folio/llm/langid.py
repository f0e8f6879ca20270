"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts every n-gram of every labelled text in the tasks (``numpy``)
and sums ``(lang, bucket, n)`` rows in Spark, so what reaches the driver is
the summed table: at most ``buckets`` rows per language, whatever the corpus.
Scoring broadcasts the log-probability matrix (buckets x languages, 4 bytes
each) and adds up the matrix rows of each text's n-grams.

A posterior goes to 1 with a text's length, whatever the text is. Whether it
is a text of its language at all is told by ``misfit``: its mean
log-likelihood per n-gram, on a scale from the language's own texts to
n-grams at random, both from the same counts.

Defined cases: null text, and text without a letter, is ``und`` with score
and misfit 0; columns named like an output are replaced; rows with a null language do not train; ties take the first language by
name; without any training row everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import mix64, text_chunks, without

UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """``logp``: (buckets + 1) x languages, the last row zero; ``prior``: log share per language;
    ``typical``, ``spread``: mean and standard deviation of an n-gram's ``logp`` in a language's own
    texts; ``background``: mean ``logp`` of a bucket."""

    langs: list[str]
    logp: np.ndarray
    prior: np.ndarray
    typical: np.ndarray
    spread: np.ndarray
    background: np.ndarray
    orders: tuple[int, ...]
    buckets: int


def ngram_buckets(rows: list[str], orders: tuple[int, ...], buckets: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Per order, the bucket of the n-gram that starts at each position of the padded texts
    (``buckets`` where none does), and where each text starts (n + 1 entries)."""
    pad = max(orders) - 1
    lowered = [r.lower() for r in rows]
    lens = np.fromiter((len(r) + pad for r in lowered), dtype=np.int64, count=len(rows))
    at = np.concatenate(([0], np.cumsum(lens)))
    tail = " " * pad
    raw = "".join([r + tail for r in lowered]).encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(raw, dtype=np.uint32).astype(np.uint64)
    none = np.zeros(len(codes), dtype=bool)
    for k in range(1, pad + 1):
        none[at[1:] - k] = True
    out = []
    for n in orders:
        h = codes + np.uint64(n << 40)
        for k in range(1, n):
            shifted = np.zeros_like(codes)
            shifted[:-k] = codes[k:]
            h = h * np.uint64(0x9E3779B97F4A7C15) + shifted
        idx = (mix64(h) % np.uint64(buckets)).astype(np.int64)
        idx[none] = buckets
        out.append(idx)
    return out, at


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", orders: tuple[int, ...] = (1, 2, 3), buckets: int = 1 << 16, alpha: float = 0.5) -> Model:
    """Counts over all rows with a text and a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for chunk in text_chunks(batches):
            by: dict[str, list[str]] = {}
            for t, c in zip(chunk.column(0).to_pylist(), chunk.column(1).to_pylist(), strict=True):
                by.setdefault(c, []).append(t)
            for c, rows in by.items():
                sums = total.setdefault(c, np.zeros(buckets + 2, dtype=np.int64))
                for idx in ngram_buckets(rows, orders, buckets)[0]:
                    sums[:-1] += np.bincount(idx, minlength=buckets + 1)
                sums[-1] += len(rows)
        for c, sums in total.items():
            sums[buckets] = 0
            at = np.flatnonzero(sums)
            # the number of texts goes under bucket -1
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(at), pa.string()), pa.array(np.where(at == buckets + 1, -1, at), pa.int64()), pa.array(sums[at], pa.int64())], ["lang", "bucket", "n"])

    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    summed = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(summed["lang"].unique())
    counts, texts_of = np.zeros((buckets, len(langs))), np.zeros(len(langs))
    for k, c in enumerate(langs):
        own = summed[summed["lang"] == c]
        grams = own[own["bucket"] >= 0]
        counts[grams["bucket"].to_numpy(), k] = grams["n"].to_numpy()
        texts_of[k] = own.loc[own["bucket"] < 0, "n"].sum()
    logp = np.zeros((buckets + 1, len(langs)), dtype=np.float32)
    logp[:-1] = np.log((counts + alpha) / (counts.sum(axis=0) + alpha * buckets))
    prior = np.log(np.maximum(texts_of, 1) / max(texts_of.sum(), 1))
    background = logp[:-1].mean(axis=0, dtype=np.float64)
    seen = counts.sum(axis=0)
    share = counts / np.maximum(seen, 1)
    typical = np.where(seen > 0, (share * logp[:-1]).sum(axis=0), background)
    spread = np.sqrt(np.maximum((share * (logp[:-1] - typical) ** 2).sum(axis=0), 0))
    return Model(langs, logp, prior, typical, spread, background, orders, buckets)


def likelihoods(model: Model, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Texts x languages: log-likelihoods; and the n-grams of each text."""
    grams, at = ngram_buckets(rows, model.orders, model.buckets)
    total = np.zeros((len(rows), len(model.langs)))
    filled = np.flatnonzero(at[1:] > at[:-1])
    if len(filled):
        for idx in grams:
            total[filled] += np.add.reduceat(model.logp[idx], at[:-1][filled], axis=0, dtype=np.float64)
    return total, (np.diff(at) - (max(model.orders) - 1)) * len(model.orders)


def posteriors(model: Model, total: np.ndarray) -> np.ndarray:
    """Texts x languages: naive Bayes posteriors of the log-likelihoods."""
    total = total + model.prior
    total -= total.max(axis=1, keepdims=True)
    p = np.exp(total)
    return p / p.sum(axis=1, keepdims=True)


def misfits(model: Model, total: np.ndarray, n_grams: np.ndarray, allowed: float = 3.0) -> np.ndarray:
    """Texts x languages: where a text's mean log-likelihood per n-gram lies between that of the language's
    own texts (0) and that of n-grams in buckets at random (1). ``allowed`` standard errors for the text's
    length are let off; a language that tells no n-grams apart fits all texts."""
    n = np.maximum(n_grams, 1)[:, None]
    gap = model.typical - model.background
    short = model.typical - total / n - allowed * model.spread / np.sqrt(n)
    return np.divide(short, gap, out=np.zeros_like(short), where=np.broadcast_to(gap > 1e-6, short.shape))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (the posterior of that language) and ``misfit`` (see ``misfits``)."""
    docs = without(docs, ["lang_pred", "score", "misfit"])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("misfit", T.DoubleType())]
    schema = T.StructType([*docs.schema.fields, *added])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for chunk in text_chunks(batches, text):
            raw = chunk.column(chunk.schema.get_field_index(text)).to_pylist()
            known = [k for k, t in enumerate(raw) if m.langs and t is not None and any(map(str.isalpha, t))]
            langs, scores, misfit = [UNKNOWN] * len(raw), np.zeros(len(raw)), np.zeros(len(raw))
            if known:
                total, n_grams = likelihoods(m, [raw[k] for k in known])
                p = posteriors(m, total)
                best = p.argmax(axis=1)
                misfit[known] = misfits(m, total, n_grams)[np.arange(len(known)), best]
                for k, b in zip(known, best, strict=True):
                    langs[k] = m.langs[b]
                scores[known] = np.minimum(p[np.arange(len(known)), best], 1.0)
            yield pa.RecordBatch.from_arrays([*chunk.columns, pa.array(langs, pa.string()), pa.array(scores), pa.array(misfit)], [*chunk.schema.names, "lang_pred", "score", "misfit"])

    return docs.mapInArrow(score, schema)
