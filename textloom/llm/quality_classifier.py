"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network with
temperature-calibrated probabilities.

Every word has two names, its letters and its shape (``Xxxx,`` is ``Aa,``), and each name a bucket and
a sparse random index vector. A bucket's word vector is the sum of the index vectors around its
occurrences in all documents: the neighbours of the same kind and the other name of the word. A
document is the mean and the spread of its words' vectors, and four figures of its length and
repetition. A network with one hidden layer is trained on labelled documents on the driver; one number, the
temperature, is fitted on a fifth of them that training leaves out.

Defined results
---------------
* Null text is empty text: its vectors are 0 and it gets the score that the network gives those.
* Labels that are null are no labels. Rows with the same id all get the labels of that id.
* Without labels of both kinds to learn from, every score is the share of 1 among the labels,
  smoothed to (ones + 1) / (labels + 2).
* A null id is not held out. Repeated rows and ids are scored one by one. Texts of any length are taken whole,
  pooled in parts. An empty table gives an empty table; other columns are not read.
* Words whose names share a bucket share its vector: of n different words that is a share of about
  1 - exp(-n / ``BUCKETS``), most of them rare ones; frequent words are the bulk of a bucket's sum.

At scale
--------
One pass over the texts sums word vectors: a task sends a row for each bucket it met, at most
``BUCKETS``, whatever its input. A second one makes a vector of ``FEATURES`` floats for each document.
The driver gets ``BUCKETS`` word vectors and about the ``SAMPLE`` labelled documents whose id has the least
hash: both bounds are parameters, and only the labelled sample is bounded by one. The sample's ids are drawn
from the labels first, so that no other document's vector is shuffled or sent.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.vocabulary import blocks
from textloom.plans.lineage import checkpointed

#: Production parameters: buckets of word names, dimensions, labelled documents to learn from, hidden
#: units, passes over the sample, the score from which 1 is predicted.
BUCKETS, DIMS, SAMPLE, HIDDEN, EPOCHS, FROM = 32768, 32, 20_000, 32, 60, 0.7
FEATURES = 3 * DIMS + 4
#: Words that a worker remembers, and the longest of them; words of a text that are pooled at once.
MOST_WORDS, LONG, AT_ONCE = 700_000, 64, 1 << 18
SEED = 5


def index_vectors() -> np.ndarray:
    """For each bucket a vector with two 1 and two -1; zeros for the gap between documents."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    out = np.zeros((BUCKETS + 1, DIMS), np.int32)
    for row in out[:BUCKETS]:
        row[rng.choice(DIMS, 4, replace=False)] = (1, 1, -1, -1)
    return out


class Names(dict):
    """A word to its two buckets, as letters * BUCKETS + shape."""

    runs = re.compile(r"(.)\1+", re.DOTALL)

    def __missing__(self, word: str) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        letters = "".join(filter(str.isalnum, word)).lower()
        kinds = ("0" if c.isdigit() else c if not c.isalpha() else "A" if c.isupper() else "a" for c in word)
        shape = self.runs.sub(r"\1", "".join(kinds))
        bucket = lambda x: zlib.crc32(x.encode()) % BUCKETS
        n = bucket("w" + letters) * BUCKETS + bucket("s" + shape)
        if len(word) <= LONG:
            self[word] = n
        return n


_NAMES = Names()


def named(text: str | None) -> np.ndarray:
    words = (text or "").split()
    return np.fromiter(map(_NAMES.__getitem__, words), np.int64, len(words))


def context_sums(texts: list[str], index: np.ndarray, total: np.ndarray) -> None:
    """Adds to ``total`` what is around the words of some texts."""
    gap = np.array([BUCKETS * BUCKETS + BUCKETS], np.int64)  # a bucket of its own for both names
    parts = [gap]
    for text in texts:
        parts += [named(text), gap]
    both = np.concatenate(parts)
    letters = np.where(both == gap, BUCKETS, both // BUCKETS)
    shapes = np.where(both == gap, BUCKETS, both % BUCKETS)
    for d in range(DIMS):
        column = index[:, d].astype(np.float64)  # a copy in one piece, whose numbers need no conversion after the lookup
        of_letters, of_shapes = column[letters], column[shapes]
        for own, near, other in ((letters, of_letters, of_shapes), (shapes, of_shapes, of_letters)):
            around = other.copy()
            around[1:] += near[:-1]
            around[:-1] += near[1:]
            total[:, d] += np.bincount(own, around, BUCKETS + 1).astype(np.int64)


def word_vectors(texts: DataFrame) -> np.ndarray:
    """The word vector of each bucket, of length 1 or 0, from all texts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = index_vectors(), np.zeros((BUCKETS + 1, DIMS), np.int64)
        for batch in batches:
            for block in blocks(batch.column(0).to_pylist(), 4_000_000):
                context_sums(block, index, total)
        met = np.flatnonzero(np.any(total[:BUCKETS], axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), *(pa.array(total[met, d]) for d in range(DIMS))], ["bucket", *(f"v{d}" for d in range(DIMS))])

    sums = texts.mapInArrow(add, "bucket int, " + ", ".join(f"v{d} long" for d in range(DIMS)))
    rows = sums.groupBy("bucket").agg(*(F.sum(f"v{d}").alias(f"v{d}") for d in range(DIMS))).toPandas()
    out = np.zeros((BUCKETS, DIMS), np.float32)
    found = rows.drop(columns="bucket").to_numpy(np.float64)
    norm = np.linalg.norm(found, axis=1, keepdims=True)
    out[rows["bucket"].to_numpy()] = found / np.where(norm > 0, norm, 1)
    return out


def pooled(text: str | None, vectors: np.ndarray) -> np.ndarray:
    both = named(text)
    out = np.zeros(FEATURES, np.float32)
    n = len(both)
    if n:
        total = np.zeros((3, DIMS))
        for i in range(0, n, AT_ONCE):
            letters, shapes = (vectors[x] for x in (both[i : i + AT_ONCE] // BUCKETS, both[i : i + AT_ONCE] % BUCKETS))
            total += letters.sum(0, np.float64), np.square(letters, dtype=np.float64).sum(0), shapes.sum(0, np.float64)
        mean, square, shape = total / n
        out[: 3 * DIMS] = np.concatenate((mean, np.sqrt(np.maximum(0, square - mean**2)), shape))
        threes = both[:-2] * 31 + both[1:-1] * 7 + both[2:]
        same = np.count_nonzero(both[1:] == both[:-1]) / n
        out[3 * DIMS :] = np.log1p(n), len(np.unique(both)) / n, same, len(np.unique(threes)) / max(1, n - 2)
    return out


class Network:
    """Two layers over standardised features; ``score`` is calibrated."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.prior = float((y.sum() + 1) / (len(y) + 2))
        self.trained = len(np.unique(y)) == 2
        if not self.trained:
            return
        rng = np.random.Generator(np.random.PCG64(SEED))
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mean) / self.scale
        order = rng.permutation(len(x))
        kept_out, used = order[: len(x) // 5], order[len(x) // 5 :]
        self.layers = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        first, second, step = [np.zeros_like(w) for w in self.layers], [np.zeros_like(w) for w in self.layers], 0
        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(used), max(1, len(used) // 256)):
                step += 1
                for w, g, m, v in zip(self.layers, self._gradients(x[part], y[part]), first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        logits, truth = self._logits(x[kept_out]), y[kept_out]
        if len(truth):
            tried = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
            losses = [np.mean(np.logaddexp(0, logits / t) - truth * logits / t) for t in tried]
            self.temperature = float(tried[int(np.argmin(losses))])

    def _logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh(x @ a + b) @ c + d[0]

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        a, b, c, d = self.layers
        hidden = np.tanh(x @ a + b)
        error = (1 / (1 + np.exp(-(hidden @ c + d[0]))) - y) / len(y)
        back = np.outer(error, c) * (1 - hidden**2)
        decay = 1e-4
        return [x.T @ back + decay * a, back.sum(0), hidden.T @ error + decay * c, np.array([error.sum()])]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(x), self.prior)
        z = np.clip(self._logits((x - self.mean) / self.scale) / self.temperature, -500, 500)
        return np.round(1 / (1 + np.exp(-z)), 9)  # sums of a batch may differ in their last digits


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, x)`` for each document."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    vectors = word_vectors(rows.select("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate([np.zeros(0, np.float32), *(pooled(t.as_py(), vectors) for t in batch.column(1))])
            ends = np.arange(0, len(x) + 1, FEATURES, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(x, pa.float32()))], ["id", "x"])

    return rows.mapInArrow(pool, f"id {kind}, x array<float>")


def least_hashed(truth: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` of ``(id, y)``, those whose ids have the least hashes. A threshold on the hash, set
    from the number of labels, keeps what tasks send near the sample's size."""
    space = 1 << 31
    place = F.pmod(F.xxhash64("id"), F.lit(space))
    n = truth.count()
    share = 1.0 if n <= sample else sample / n
    near = truth.where(place < math.ceil(space * share))
    return checkpointed(near.orderBy(place, "id", "y").limit(sample))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """Each document's id, ``held_out``, ``score`` and ``predicted``; learns from the labels of ids
    that are not held out."""
    made = checkpointed(features(docs, id_col, text_col))
    truth = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
    drawn = least_hashed(truth, sample)
    picked = made.join(F.broadcast(drawn), "id").orderBy(F.xxhash64("id"), "id", "y", "x").limit(sample).toPandas()
    x = np.array(picked["x"].tolist(), np.float64).reshape(len(picked), FEATURES)
    network = Network(x, picked["y"].to_numpy(np.float64))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(network.score(np.array(x.tolist(), np.float64).reshape(len(x), FEATURES)))

    out = made.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), score("x").alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= FROM, 1).otherwise(0))
