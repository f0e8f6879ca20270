"""LM scoring with a log-bilinear model trained by noise-contrastive estimation.

Tokens are words between ASCII white space, with A-Z in lower case, and one
end token a text. Words are 64-bit hashes throughout.

Counts. Every task counts the words of its training texts and Spark sums them
over the whole corpus: (word, c), and from it N and V. The ``frequent`` words
with the largest counts are broadcast (16 bytes each); all others, a small
share of all tokens, are looked up by a join on the word.

Model. A word's probability is that of its class times that of the word in its
class, both log-bilinear, and every training word has an output vector. The
``classes`` most frequent words and the end token are classes of their own; all
others, seen or not, are dealt by their hash to ``GROUPS`` groups at most, as
context and as what is predicted first. The context of a class is the two classes
before; with vectors per class and place, ``q = left[w1] + right[w2]`` predicts
the next class by ``q . out[w] + bias[w]``. Each task trains on its own texts,
all of them, in minibatches that share their noise samples, so that a step is a
few matrix products; the tasks' parameters are averaged by numbers of tokens, in
``rounds`` rounds over disjoint parts of the training texts. Averages are
taken per block of parameters in two levels, so nothing grows with the corpus.
A table of the logs of the normalising sums of all contexts comes from batched
matrix products, one row of contexts a task, and makes the probabilities of
the classes sum to one.

Words of a group. A group's known words are dealt by their hash to cells of about
``CELL_WORDS`` words, as many as the vocabulary needs; a cell's share of its group is
that of its counts, and the unseen words of a group have the share of half a
token. Within its cell a word has an output vector and a bias, and its context is
the cluster of the class before: the contexts' ``right`` vectors at length one, in
``CLUSTERS`` clusters. Every task sums its tokens to (word, cluster, count), the
sums meet by cell in two levels, so a cell gets at most a row per word and cluster
however large the corpus, and ``fit_cell`` trains its words by noise-contrastive
estimation with the cell's word shares as noise. As there are few contexts the
expected noise is used, not a sample, and a step is two matrix products. The
softmax over the cell then gives each word's normalised log-probabilities, one for each cluster.
Those of the ``frequent`` words are broadcast (2 * CLUSTERS bytes each), those of
all others stay in a table and are joined on the word. They are fixed-point numbers.

Defined cases: null or empty text is the end token alone; repeated rows count
each time; without training rows every word is unseen and N is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import LOWER, SPACE, materialise, prefix_hash, span_hash, text_bytes, text_chunks, without, word_spans

#: Stands for the end token; no word has this hash but by chance.
END = np.uint64(0x8E5B2F1D3C4A6907)
#: Words that are no class of their own, in a cell; the cells are dealt to groups, the classes of such words.
CELL_WORDS, GROUPS, CLUSTERS = 1024, 512, 32


def tokens(chunk: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, end tokens included, and where each text starts (n + 1 entries)."""
    data, offsets = text_bytes(chunk.column(chunk.schema.get_field_index(column)))
    data = LOWER[data]
    starts, ends, at = word_spans(data, offsets, ~SPACE)
    n = len(offsets) - 1
    out = np.empty(len(starts) + n, dtype=np.uint64)
    at = at + np.arange(n + 1)
    last = at[1:] - 1
    inner = np.ones(len(out), dtype=bool)
    inner[last] = False
    out[inner] = span_hash(prefix_hash(data), starts, ends)
    out[last] = END
    return out, at


def count_tokens(docs: DataFrame, text: str = "text", held: int = 1 << 19) -> DataFrame:
    """(word, c) over all texts; a task gives its counts whenever it has ``held`` different words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "c"])

        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            w, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return w, np.bincount(where, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

        for chunk in text_chunks(batches):
            parts.append(np.unique(tokens(chunk)[0], return_counts=True))
            if sum(len(p[0]) for p in parts) > held:
                words, counts = merged()
                parts = [(words, counts)]
                if len(words) > held // 2:
                    yield batch()
                    parts = []
        if parts:
            words, counts = merged()
            yield batch()

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """``classes``: sorted word hashes, whose class is their place; then the groups of all other
    words and, as context only, the start."""

    classes: np.ndarray
    left: np.ndarray
    right: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    noise: np.ndarray
    groups: int = 1
    cells: int = 1
    log_z: np.ndarray | None = None
    cluster: np.ndarray | None = None  # of each class as context
    centres: np.ndarray | None = None

    @property
    def other(self) -> int:
        return len(self.classes)

    @property
    def start(self) -> int:
        return len(self.classes) + self.groups


def initial(classes: np.ndarray, shares: np.ndarray, width: int, seed: int, cells: int = 1) -> Model:
    rng = np.random.default_rng(seed)
    n = len(shares)
    noise = np.maximum(shares, 1e-9) / np.maximum(shares, 1e-9).sum()
    vectors = [rng.normal(0, 0.1, (m, width)).astype(np.float32) for m in (n + 1, n + 1, n)]
    return Model(classes, *vectors, np.log(noise).astype(np.float32), noise, n - len(classes), cells)


def cell_of(words: np.ndarray, cells: int) -> np.ndarray:
    """A word's cell; ``cells`` is a multiple of the number of groups."""
    return ((words >> np.uint64(20)) % np.uint64(cells)).astype(np.int64)


def group_of(words: np.ndarray, groups: int) -> np.ndarray:
    return cell_of(words, groups)  # = cell_of(words, cells) % groups


def class_ids(model: Model, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each token and of the two before it."""
    ids = model.other + group_of(words, model.groups)
    if len(model.classes):
        k = np.minimum(np.searchsorted(model.classes, words), len(model.classes) - 1)
        hit = model.classes[k] == words
        ids[hit] = k[hit]
    one = np.empty_like(ids)
    one[1:] = ids[:-1]
    one[at[:-1]] = model.start
    two = np.empty_like(ids)
    two[1:] = one[:-1]
    two[at[:-1]] = model.start
    return ids, one, two


def _scatter(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Add ``values`` to ``rows``, of which there are fewer than 2^16: a radix sort, then a sum for each row."""
    small = rows.astype(np.uint16)
    order = np.argsort(small, kind="stable")
    r = small[order]
    starts = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
    into[r[starts]] += np.add.reduceat(values.take(order, axis=0), starts, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    """Noise-contrastive steps with Adagrad rates, on one task's tokens."""

    def __init__(self, model: Model, seed: int, noise: int = 64, rate: float = 0.1):
        self.p = [model.left.copy(), model.right.copy(), model.out.copy(), model.bias.copy()]
        self.seen = [np.full_like(x, 1e-2) for x in self.p]
        self.grads, self.work = [np.empty_like(x) for x in self.p], [np.empty_like(x) for x in self.p]
        self.model, self.k, self.rate = model, noise, rate
        self.rng = np.random.default_rng(seed)
        self.cumulative = np.cumsum(model.noise)
        self.log_kp = np.log(noise * model.noise).astype(np.float32)

    def step(self, ids: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        left, right, out, bias = self.p
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(self.k)), len(self.cumulative) - 1)
        q = left.take(two, axis=0)
        q += right.take(one, axis=0)
        own, others = out.take(ids, axis=0), out[noise]
        # chance of each being data: sigma(s - log(k p_noise))
        g_true = _sigmoid(np.einsum("ij,ij->i", q, own) + (bias[ids] - self.log_kp[ids]))
        g_true -= 1
        g_true /= len(ids)
        g_false = q @ others.T
        g_false += bias[noise] - self.log_kp[noise]
        g_false = _sigmoid(g_false)
        g_false /= len(ids)
        dq = g_false @ others
        own *= g_true[:, None]
        dq += own
        grads = self.grads
        for g in grads:
            g.fill(0)
        _scatter(grads[0], two, dq)
        _scatter(grads[1], one, dq)
        np.add.at(grads[2], noise, g_false.T @ q)
        q *= g_true[:, None]
        _scatter(grads[2], ids, q)
        grads[3] += np.bincount(ids, weights=g_true, minlength=len(bias)).astype(np.float32)
        np.add.at(grads[3], noise, g_false.sum(axis=0))
        for x, s, g, w in zip(self.p, self.seen, grads, self.work, strict=True):
            g *= 64  # of the size of a step on 64 tokens; the rate below is Adagrad's
            np.multiply(g, g, out=w)
            s += w
            np.sqrt(s, out=w)
            g *= self.rate
            g /= w
            x -= g


def train_round(docs: DataFrame, model: Model, text: str = "text", batch: int = 2048, blocks: int = 64) -> Model:
    """One pass: every task trains from ``model`` on its texts; the average by tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    size = sum(x.size for x in (model.left, model.right, model.out, model.bias))
    width = -(-size // blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        trainer, seen = Trainer(shared.value, shard + 1), 0
        for chunk in text_chunks(batches):
            parts = class_ids(shared.value, *tokens(chunk))
            order = trainer.rng.permutation(len(parts[0]))
            for i in range(0, len(order), batch):
                own = order[i : i + batch]
                trainer.step(*(x[own] for x in parts))
            seen += len(order)
        if seen:
            flat = np.concatenate([x.ravel() for x in trainer.p]).astype(np.float32)
            rows = [(k, shard // 256, float(seen), (flat[k * width : (k + 1) * width].astype(np.float64) * seen).tobytes()) for k in range(blocks)]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.float64(), pa.binary()), strict=True)], ["block", "part", "n", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, dtype=np.float64) for x in pdf["sums"]], axis=0)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "n": [pdf["n"].sum()], "sums": [total.tobytes()]})

    sums = docs.select(F.col(text).alias("text")).mapInArrow(run, "block int, part int, n double, sums binary")
    few = sums.groupBy("block", "part").applyInPandas(add, "block int, n double, sums binary")
    rows = few.groupBy("block").applyInPandas(add, "block int, n double, sums binary").orderBy("block").collect()
    if not rows:
        return model
    flat = np.concatenate([np.frombuffer(bytes(r["sums"]), dtype=np.float64) / r["n"] for r in rows]).astype(np.float32)
    out, i = [], 0
    for x in (model.left, model.right, model.out, model.bias):
        out.append(flat[i : i + x.size].reshape(x.shape))
        i += x.size
    return Model(model.classes, *out, model.noise, model.groups, model.cells)


def normalise(spark: SparkSession, model: Model) -> Model:
    """The model with the log of the normalising sum of every context."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for two in b.column(0).to_pylist():
                z = np.empty(len(m.right), dtype=np.float32)
                for part in _slabs(len(m.right), len(m.out)):
                    logits = (m.left[two] + m.right[part]) @ m.out.T
                    logits += m.bias
                    top = logits.max(axis=1)
                    logits -= top[:, None]
                    np.exp(logits, out=logits)
                    z[part] = np.log(logits.sum(axis=1)) + top
                yield pa.RecordBatch.from_arrays([pa.array([two], pa.int64()), pa.array([z.astype(np.float32).tobytes()], pa.binary())], ["two", "z"])

    n = len(model.left)
    rows = spark.range(0, n, 1, max(1, min(n // 32, 64))).mapInArrow(run, "two long, z binary").collect()
    table = np.empty((n, n), dtype=np.float32)
    for r in rows:
        table[r["two"]] = np.frombuffer(bytes(r["z"]), dtype=np.float32)
    model.log_z = table
    return model


def log10_classes(model: Model, ids: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Normalised log10 probability of each token's class in its context."""
    logits = np.einsum("ij,ij->i", model.left[two] + model.right[one], model.out[ids]) + model.bias[ids]
    return (logits - model.log_z[two, one]).astype(np.float64) / np.log(10)


def _slabs(n: int, width: int) -> list[slice]:
    """Parts of ``n`` contexts with about 2^18 logits each, which stay in a core's cache."""
    step = max(1, (1 << 18) // width)
    return [slice(k, min(k + step, n)) for k in range(0, n, step)]


def with_clusters(model: Model, steps: int = 20, seed: int = 5) -> Model:
    """The model with the clusters of its contexts: spherical k-means on the ``right`` vectors at length one."""
    r = model.right / np.maximum(np.linalg.norm(model.right, axis=1, keepdims=True), 1e-6)
    k = min(CLUSTERS, len(r))
    centres = r[np.random.default_rng(seed).choice(len(r), k, replace=False)]
    for _ in range(steps):
        own = (r @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, r)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-6, sums / np.maximum(norm, 1e-6), centres).astype(np.float32)
    model.cluster = (r @ centres.T).argmax(axis=1).astype(np.uint8)
    model.centres = np.zeros((CLUSTERS, r.shape[1]), dtype=np.float32)
    model.centres[:k] = centres
    return model


#: Log-probabilities of words of groups are kept as whole numbers of this part of a nat, down to -32.
FINE = 1024


def fixed(logs: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(logs * FINE), -32768, 0).astype(np.int16)


def fit_cell(centres: np.ndarray, seen: np.ndarray, noise: float = 16.0, steps: int = 25, prior: float = 1.0) -> np.ndarray:
    """Normalised log-probabilities (contexts, words) of a cell's words, from their counts in each context.

    Noise-contrastive estimation of biases and vectors: of ``1 + noise`` draws in a context
    one is data, the others are words by their shares in the cell. With
    ``a = score - log(noise * share)`` the loss is
    ``- seen log sigma(a) - noise * tokens(context) * share * log sigma(-a)``, the noise in
    expectation. A step divides the gradient by a bound of the curvature, so it never overshoots.
    """
    x, n = seen.shape
    c = seen.sum(axis=0)
    share = c / c.sum()
    log_noise = np.log(noise * share).astype(np.float32)
    expected = (noise * seen.sum(axis=1))[:, None] * share[None]
    places = np.zeros((centres.shape[1] + 1, n), dtype=np.float32)
    places[-1] = np.log(share)
    r = np.column_stack([centres, np.ones(x, dtype=np.float32)])
    # Bias and vector share a step: the curvature of both is within that of (1 + length) times sigma'.
    length = (r * r).sum(axis=1)
    total = seen + expected
    for _ in range(steps):
        s = 1 / (1 + np.exp(-np.clip(r @ places - log_noise, -30, 30)))
        grad = r.T @ (seen - total * s)
        grad[:-1] -= prior * places[:-1]
        places += grad / (length @ (total * np.maximum(s * (1 - s), 0.01)) + prior)
    logits = r @ places
    top = logits.max(axis=1, keepdims=True)
    return (logits - top - np.log(np.exp(logits - top).sum(axis=1, keepdims=True))).astype(np.float32)


PACKED = "cell int, part int, words binary, clusters binary, counts binary"


def _packed(cell: np.ndarray, word: np.ndarray, cluster: np.ndarray, c: np.ndarray, part: int) -> pa.RecordBatch:
    """Equal (word, cluster) summed, a row of arrays for each cell."""
    order = np.lexsort((cluster, word, cell))
    cell, word, cluster, c = cell[order], word[order], cluster[order], c[order]
    new = np.ones(len(cell), dtype=bool)
    new[1:] = (word[1:] != word[:-1]) | (cluster[1:] != cluster[:-1])
    at = np.flatnonzero(new)
    c = np.add.reduceat(c, at) if len(at) else c
    cell, word, cluster = cell[at], word[at], cluster[at]
    cuts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, dtype=np.int64)
    spans = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(cell)], strict=True)) if len(cuts) else []
    columns = [pa.array([x[i:j].tobytes() for i, j in spans], pa.binary()) for x in (word.astype(np.uint64), cluster.astype(np.uint8), c.astype(np.int64))]
    return pa.RecordBatch.from_arrays([pa.array(cell[cuts].astype(np.int32)), pa.array([part] * len(spans), pa.int32()), *columns], ["cell", "part", "words", "clusters", "counts"])


def _unpacked(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kinds = (("words", np.uint64), ("clusters", np.uint8), ("counts", np.int64))
    return tuple(np.concatenate([np.frombuffer(x, dtype=k) for x in pdf[n]]) for n, k in kinds)


def fit_words(train: DataFrame, model: Model, totals: np.ndarray, text: str = "text", held: int = 1 << 20) -> DataFrame:
    """(word, c, logs): the counts of all words of groups and their log-probabilities given the group, by cluster.

    ``totals``: the training tokens of each group.
    """
    shared = train.sparkSession.sparkContext.broadcast((model, totals))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m, parts, part = shared.value[0], [], TaskContext.get().partitionId() // 256
        for chunk in text_chunks(batches):
            words, at = tokens(chunk)
            ids, one, _ = class_ids(m, words, at)
            own = ids >= m.other
            parts.append((words[own], m.cluster[one[own]]))
            if sum(len(x[0]) for x in parts) > held:
                w, k = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield _packed(cell_of(w, m.cells), w, k, np.ones(len(w), dtype=np.int64), part)
                parts = []
        if parts:
            w, k = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield _packed(cell_of(w, m.cells), w, k, np.ones(len(w), dtype=np.int64), part)

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        w, k, c = _unpacked(pdf)
        return _packed(np.full(len(w), pdf["cell"].iloc[0]), w, k, c, int(pdf["part"].iloc[0])).to_pandas()

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        m, per_group = shared.value
        w, k, c = _unpacked(pdf)
        known, place = np.unique(w, return_inverse=True)
        seen = np.zeros((CLUSTERS, len(known)), dtype=np.float32)
        np.add.at(seen, (k, place), c)
        counts = np.bincount(place, weights=c).astype(np.int64)
        group = per_group[int(pdf["cell"].iloc[0]) % m.groups]
        # Of the group's tokens the cell has its share, unseen words that of half a token.
        logs = fit_cell(m.centres, seen) + np.float32(np.log(counts.sum() / (group + 0.5)))
        return pd.DataFrame({"word": known.view(np.int64), "c": counts, "logs": [x.tobytes() for x in np.ascontiguousarray(fixed(logs).T)]})

    packed = train.select(F.col(text).alias("text")).mapInArrow(sums, PACKED)
    return packed.groupBy("cell", "part").applyInPandas(merged, PACKED).groupBy("cell").applyInPandas(fitted, "word long, c long, logs binary")


@dataclass
class Counts:
    """Of the frequent words, sorted; ``n`` and ``v`` of all training tokens. ``logs`` has the
    log-probabilities of the words of a group in it, by cluster and in units of 1 / FINE (zeros for a class of its own), ``unseen`` that
    of an unseen word of each group."""

    words: np.ndarray
    c: np.ndarray
    n: int
    v: int
    logs: np.ndarray
    unseen: np.ndarray


def fit(train: DataFrame, text: str = "text", classes: int = 1024, frequent: int = 1 << 18, width: int = 32, rounds: int = 2, seed: int = 11) -> tuple[Model, Counts, DataFrame]:
    """Model, broadcast counts and the table (word, c, logs) of all training words that are not broadcast."""
    spark = train.sparkSession
    counts = materialise(count_tokens(train, text), "word-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # The lowest count that at most `frequent` words reach, from a row for each different count: as many as
    # there are different sizes of counts, which the square root of twice the tokens bounds.
    reach = F.sum("k").over(Window.orderBy(F.desc("c")))
    least = counts.groupBy("c").agg(F.count(F.lit(1)).alias("k")).withColumn("reach", reach).where(F.col("reach") <= frequent).agg(F.min("c")).first()[0]
    top = counts.where(F.col("c") >= least if least is not None else F.lit(False)).toPandas().sort_values(["c", "word"], ascending=[False, True])
    words, c = top["word"].to_numpy(dtype=np.int64).view(np.uint64), top["c"].to_numpy(dtype=np.int64)
    own, own_c = words[:classes], c[:classes]
    if len(words) and END not in own:  # the end token always is a class
        k = int(np.flatnonzero(words == END)[0]) if END in words else None
        own, own_c = np.append(own[:-1], END), np.append(own_c[:-1], c[k] if k is not None else 1)
    order = np.argsort(own)
    own, own_c = own[order], own_c[order]
    groups = min(max(-(-(int(v) - len(own)) // CELL_WORDS), 1), GROUPS)
    cells = groups * max(1, -(-(int(v) - len(own)) // (CELL_WORDS * groups)))
    in_group = np.zeros(groups)
    for r in counts.groupBy(F.pmod(F.shiftrightunsigned("word", 20), F.lit(groups)).alias("g")).agg(F.sum("c").alias("c")).collect():
        in_group[r["g"]] = r["c"]
    in_group -= np.bincount(group_of(own, groups), weights=own_c, minlength=groups)
    model = initial(own, np.append(own_c, in_group) / max(n, 1), width, seed, cells)
    for r in range(rounds):
        part = train.where(F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(rounds)) == r)
        model = train_round(part, model, text)
    model = with_clusters(model)
    fitted = materialise(fit_words(train, model, in_group, text), "lm-words")
    order = np.argsort(words)
    known = Counts(words[order], c[order], int(n), int(v), np.zeros((len(words), CLUSTERS), dtype=np.int16), np.log(0.5 / (in_group + 0.5)))
    limit = least if least is not None else np.iinfo(np.int64).max
    few = fitted.where(F.col("c") >= limit).select("word", "logs").toArrow()  # at most `frequent` rows
    for b in few.to_batches():
        if b.num_rows:
            known.logs[np.searchsorted(known.words, b.column("word").to_numpy().view(np.uint64))] = _logs(b.column("logs"))
    return normalise(spark, model), known, fitted.where(F.col("c") < limit)


def _logs(column: pa.Array) -> np.ndarray:
    """A row of CLUSTERS numbers for each value, read in place."""
    column = column.cast(pa.large_binary())
    offsets, data = column.buffers()[1:3]
    first = np.frombuffer(offsets, dtype=np.int64)[column.offset]
    return np.frombuffer(data, dtype=np.int16, offset=first, count=len(column) * CLUSTERS).reshape(-1, CLUSTERS)


def score(docs: DataFrame, model: Model, known: Counts, counts: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` (without the text) with n_tokens, n_known, train_tokens, base_score and score."""
    added = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rest = without(docs, added)
    keep = [c for c in rest.columns if c != text]
    shared = docs.sparkSession.sparkContext.broadcast((model, known))
    partial = [("n_tokens", T.LongType()), ("n_fast", T.LongType()), ("logs", T.DoubleType()), ("model_logs", T.DoubleType())]
    rare = T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("cluster", T.ByteType())]))
    schema = T.StructType([*[rest.schema[c] for c in keep], *[T.StructField(f"__{n}", t) for n, t in partial], T.StructField("__rare", rare)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, k = shared.value
        logs = np.log10(k.c + 0.5)
        for chunk in text_chunks(batches, text):
            words, at = tokens(chunk, text)
            ids, one, two = class_ids(m, words, at)
            place = np.minimum(np.searchsorted(k.words, words), max(len(k.words) - 1, 0))
            hit = k.words[place] == words if len(k.words) else np.zeros(len(words), dtype=bool)
            value = np.zeros(len(words))
            value[hit] = logs[place[hit]]
            # Of the word in its group: as an unseen one, which the join puts right for those in the table.
            cluster = m.cluster[one]
            grouped = ids >= m.other
            within = np.zeros(len(words))
            known_ = np.flatnonzero(grouped & hit)
            within[known_] = k.logs[place[known_], cluster[known_]] / FINE
            rest_ = np.flatnonzero(grouped & ~hit)
            within[rest_] = k.unseen[ids[rest_] - m.other]

            def sums(x: np.ndarray, at: np.ndarray = at) -> np.ndarray:
                return np.add.reduceat(x, at[:-1])

            n = np.diff(at)
            rare_at = np.concatenate(([0], np.cumsum(sums((~hit).astype(np.int64)))))
            items = pa.StructArray.from_arrays([pa.array(words[~hit].view(np.int64)), pa.array(cluster[~hit].astype(np.int8))], ["word", "cluster"])
            lists = pa.ListArray.from_arrays(pa.array(rare_at, pa.int32()), items)
            columns = [pa.array(n), pa.array(sums(hit.astype(np.int64))), pa.array(sums(value)), pa.array(sums(log10_classes(m, ids, one, two)) + sums(within) / np.log(10))]
            yield pa.RecordBatch.from_arrays([*[chunk.column(c) for c in keep], *columns, lists], schema.names)

    def better(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How much more likely a word of the table is than an unseen one of its group."""
        m, k = shared.value
        for b in batches:
            if b.num_rows:
                x = _logs(b.column("logs"))[np.arange(b.num_rows), b.column("cluster").to_numpy()] / FINE
                x -= k.unseen[group_of(b.column("word").to_numpy().view(np.uint64), m.groups)]
                yield pa.RecordBatch.from_arrays([b.column("__row"), b.column("c"), pa.array(x)], ["__row", "c", "more"])

    scored = materialise(rest.mapInArrow(run, schema).withColumn("__row", F.monotonically_increasing_id()), "lm-parts")
    # Rare words: joined to their counts and logs, then summed per text.
    words = scored.select("__row", F.inline("__rare"))
    found = words.join(counts, "word").select("__row", "word", "cluster", "c", "logs").mapInArrow(better, "__row long, c long, more double")
    found = found.groupBy("__row").agg(F.sum(F.log10(F.col("c") + 0.5)).alias("__more"), F.sum("more").alias("__better"), F.count(F.lit(1)).alias("__found"))
    rows = scored.drop("__rare").join(found, "__row", "left")
    # An unseen word has c = 0.
    missing = F.col("__n_tokens") - F.col("__n_fast") - F.coalesce("__found", F.lit(0))
    more = F.coalesce("__more", F.lit(0.0)) + missing * float(np.log10(0.5))
    base = F.col("__logs") + more - F.col("__n_tokens") * float(np.log10(known.n + 0.5 * (known.v + 1)))
    model_score = F.col("__model_logs") + F.coalesce("__better", F.lit(0.0)) / float(np.log(10))
    return rows.select(
        *keep,
        F.col("__n_tokens").alias("n_tokens"),
        (F.col("__n_fast") + F.coalesce("__found", F.lit(0))).alias("n_known"),
        F.lit(known.n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        model_score.alias("score"),
    )
