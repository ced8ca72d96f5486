"""Top-k search against all pairs, and the classifier's held-out accuracy."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import quality_classifier, topk_search

from .helpers import SCHEMA, corpus


def expected(rows, k=5, every=50):
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.setdefault(i, set()).add(tuple(math.floor(256 * x) for x in v))
    out = []
    for q in sorted(whole):
        if q % every == 0:
            best = {}
            for c, vectors in whole.items():
                if c != q:
                    scores = [sum(a * b for a, b in zip(x, y)) for x in whole[q] for y in vectors if len(x) == len(y)]
                    if scores:
                        best[c] = max(scores)
            ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
            out += [(q, n + 1, c, s) for n, (c, s) in enumerate(ranked)]
    return sorted(out)


def vectors(n, dims=8, seed=2):
    rng = random.Random(seed)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(dims)]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(40)]  # a common vector, with ties
    rows += [(None, rows[0][1]), (900, None), (950, [None] * dims), (1000, [math.nan] * dims), (1050, [math.inf] * dims), (1100, [1.0]), (1101, [2.0]), (1150, []), (1152, [])]
    rows += [rows[50], (50, rows[7][1]), (0, [0.0] * dims)]
    return rows


@pytest.mark.parametrize("block, part", [(512, 16), (1 << 22, 64), (1 << 22, 8192)])
def test_best_matches(spark, monkeypatch, block, part):
    for name, value in (("BLOCK", block), ("PART", part), ("CHUNK", 3), ("PILOT", 2)):
        monkeypatch.setattr(topk_search, name, value)
    rows = vectors(300)
    rows += [(77, [x + y for x, y in zip(rows[0][1], [k / 100] * 8)]) for k in range(9)]  # more vectors of an id than places
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).repartition(3)
    assert sorted(map(tuple, topk_search.best_matches(table).collect())) == expected(rows)


@pytest.mark.parametrize("size", [1e5, 1e6, 1e13])
def test_scores_are_exact_integers(spark, size):
    """Beyond what a double or a float holds; beyond a long, the limit."""
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-size, size) for _ in range(64)]) for i in range(120)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk_search.best_matches(table).collect()))
    if size < 1e13:
        assert got == expected(rows)
    else:
        assert {r[3] for r in got} == {2**63 - 1} and len(got) == 15


def test_few_candidates_and_none(spark):
    few = [(0, [1.0, 2.0]), (1, [-1.0, 0.5]), (2, [3.0, 0.0])]
    table = spark.createDataFrame(few, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk_search.best_matches(table).collect())) == expected(few)
    assert topk_search.best_matches(table.limit(0)).collect() == []
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in topk_search.best_matches(table, asked, k=1).collect()] == [2]


def test_reading_stops_early():
    """With a clear winner the lists are not read to their ends, nor where an earlier part has one."""
    rng = np.random.default_rng(1)
    rows = rng.integers(-100, 100, (2000, 16))
    queries, ids = np.full((20, 16), 100), np.full(20, -1)
    lists = topk_search.SortedLists(np.arange(2000), rows)
    lists.search(ids, queries, 1, np.full(20, 16.0 * 400 * 100))
    assert lists.read <= lists.all * 0.41
    rows[77] = 400
    lists = topk_search.SortedLists(np.arange(2000), rows)
    found = topk_search.best(*lists.search(ids, queries, 1), 1)
    assert set(found[1].tolist()) == {77} and set(found[2].tolist()) == {16 * 400 * 100} and lists.read < lists.all / 2


def test_classifier(spark):
    rng = random.Random(4)
    good = lambda: " ".join("".join(rng.choices(["an", "er", "th", "in", "on"], k=rng.randint(1, 3))) for _ in range(60)) + "."
    bad = lambda: " ".join("".join(rng.choices(["an", "er", "th", "in", "on"], k=2)) + rng.choice(["###", "$$$"]) for _ in range(60))
    rows = [(i, bad() if i % 4 == 0 else good(), "en", "s", 0) for i in range(600)]
    docs = spark.createDataFrame(rows + corpus(10)[10:], SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(600)] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality_classifier.scored(docs, labels).collect()
    assert len(out) == len(rows) + len(corpus(10)[10:])
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    for r in out:
        text = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["held_out"] == (zlib.crc32(text.encode()) % 4 == 2)
    right = [r["predicted"] == int(r["doc_id"] % 4 != 0) for r in out if r["held_out"] and r["doc_id"] is not None and 20 < r["doc_id"] < 600]
    assert len(right) > 100 and sum(right) >= 0.97 * len(right)
    again = quality_classifier.scored(docs.repartition(5), labels.repartition(2)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_word_vectors_against_plain_sums(spark):
    """A name's vector is the sum of the index vectors of its neighbours' names of the same kind, and of
    the word's other name."""
    texts = [r[1] for r in corpus(12)]
    index, n = quality_classifier.index_vectors(), quality_classifier.BUCKETS
    total = np.zeros((n, quality_classifier.DIMS))
    for text in texts:
        names = [divmod(quality_classifier.Names()[w], n) for w in (text or "").split()]
        for i, both in enumerate(names):
            for kind in (0, 1):
                around = [both[1 - kind], *(names[k][kind] for k in (i - 1, i + 1) if 0 <= k < len(names))]
                total[both[kind]] += index[around].sum(0)
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    got = quality_classifier.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3).na.fill(""))
    assert np.allclose(got, total / np.where(norm > 0, norm, 1), atol=1e-6)


def test_shapes_are_whole_and_long_texts_are_pooled_in_parts(monkeypatch):
    names = quality_classifier.Names()
    ends = {names["aA1-" * 9 + x] % quality_classifier.BUCKETS for x in "+*/"}
    assert len(ends) == 3
    vectors = np.random.default_rng(3).normal(size=(quality_classifier.BUCKETS, quality_classifier.DIMS)).astype(np.float32)
    text = " ".join(f"word{i % 700}" for i in range(5000))
    whole = quality_classifier.pooled(text, vectors)
    monkeypatch.setattr(quality_classifier, "AT_ONCE", 97)
    assert np.allclose(whole, quality_classifier.pooled(text, vectors), atol=1e-5)
    both = quality_classifier.named(text)
    assert np.allclose(whole[: quality_classifier.DIMS], vectors[both // quality_classifier.BUCKETS].mean(0), atol=1e-5)


def test_temperature_calibrates():
    """Scores of a noisy label lie near its frequencies, and the temperature is no worse than none."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4000, 10))
    chance = 1 / (1 + np.exp(-1.5 * x[:, 0] + x[:, 1]))
    y = (rng.random(4000) < chance).astype(float)
    network = quality_classifier.Network(x[:2000], y[:2000])
    score = network.score(x[2000:])
    bins = np.digitize(score, np.linspace(0, 1, 6)[1:-1])
    gaps = [abs(score[bins == b].mean() - y[2000:][bins == b].mean()) * (bins == b).mean() for b in np.unique(bins)]
    assert sum(gaps) < 0.08
    loss = lambda t: np.mean(np.logaddexp(0, z / t) - y[2000:] * z / t)
    z = network._logits((x[2000:] - network.mean) / network.scale)
    assert loss(network.temperature) <= loss(1.0) + 1e-6


def test_held_out_labels_are_never_read(spark):
    rows = corpus(60)
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = [(i, i % 3 == 0) for i in range(60)]
    told = lambda flip: spark.createDataFrame([(i, int(y != (flip and zlib.crc32(str(i).encode()) % 4 == 2))) for i, y in labels], "doc_id long, quality int")
    one, two = (sorted(map(str, quality_classifier.scored(docs, told(flip)).collect())) for flip in (False, True))
    assert one == two


def test_sample_is_bounded_and_by_least_hash(spark):
    truth = spark.range(3000).selectExpr("id", "cast(id % 2 as double) as y")
    drawn = {r["id"] for r in quality_classifier.least_hashed(truth, 500).collect()}
    order = [r["id"] for r in truth.orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 31))).limit(500).collect()]
    assert 400 < len(drawn) <= 500 and drawn == set(order[: len(drawn)])


def test_classifier_without_labels(spark):
    docs = spark.createDataFrame(corpus(5), SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality_classifier.scored(docs, none).collect()} == {0.5}
    assert quality_classifier.scored(docs.limit(0), none).collect() == []
