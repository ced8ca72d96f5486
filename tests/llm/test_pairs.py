"""Near dedup and substring dedup against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import near_dedup, substring_dedup
from textloom.plans.components import components

from .helpers import SCHEMA, corpus, kept_words, near_components, shingles


@pytest.fixture(scope="module")
def rows():
    return corpus()


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def test_near_dedup(spark, rows):
    out = near_dedup.components_of(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert Counter(map(tuple, out.collect())) == near_components(pairs(rows))


def odd_groups():
    """A group of near copies and a common line, each larger than a node that is compared at once."""
    base = [f"w{i}" for i in range(80)]
    line = [f"common{i}" for i in range(12)]
    texts = [" ".join(base[:j] + [f"new{j}"] + base[j + 1 :]) for j in range(0, 80, 2)]
    texts += [" ".join(line + [f"u{j}x{k}" for k in range(12)]) for j in range(40)]
    texts += [" ".join(line + [f"u{j}x{k}" for k in range(12)] + ["end"]) for j in range(0, 40, 4)]
    return list(enumerate(texts))


@pytest.mark.parametrize("small, capacity, shingles", [(6, 32768, 1 << 20), (4, 12, 1 << 20), (6, 12, 400), (2048, 32768, 300)])
def test_near_dedup_where_nodes_are_branched(spark, monkeypatch, small, capacity, shingles):
    """In a task, by shuffles, and with groups that are taken by blocks."""
    for name, value in (("SMALL", small), ("CAPACITY", capacity), ("SHINGLES", shingles)):
        monkeypatch.setattr(near_dedup, name, value)
    rows = odd_groups()
    out = near_dedup.components_of(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, out.collect())) == near_components(rows)


def test_near_dedup_in_blocks(spark, monkeypatch):
    """Where levels run out, nodes are compared in blocks and no link is lost."""
    rows = [(i, f"{'same words all over again here ' * 3}{i % 7} tail{i}") for i in range(40)]
    for name, value in (("SMALL", 2), ("CAPACITY", 4), ("LEVELS", 1)):
        monkeypatch.setattr(near_dedup, name, value)
    monkeypatch.setattr(near_dedup, "trees_for", lambda *a: 4)
    out = near_dedup.components_of(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, out.collect())) == near_components(rows)


def test_one_of_each_keeps_columns(spark, rows):
    """A single row of each component, repeated rows and groups without ids included."""
    rows = [r for r in rows if "id that is taken" not in str(r[1])]
    more = [*rows, *rows[:9], (None, rows[4][1] + " x", "en", "s1", 0), (None, "no id " * 9, "en", "s1", 1), (None, "no id " * 9, "de", "s1", 2)]
    docs = spark.createDataFrame(more, SCHEMA).selectExpr("*", "'x' as id", "1 as kept", "2 as digest")
    out = near_dedup.one_of_each(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    full = Counter(r["doc_id"] for r in kept if shingles(r["text"]))
    labels = Counter({k[2] for k in near_components(pairs(more)) if k[1]})
    assert full == labels
    assert sorted(map(str, (r[:5] for r in kept if not shingles(r["text"])))) == sorted(map(str, (r for r in more if not shingles(r[1]))))


def test_trees_and_threshold():
    assert near_dedup.trees_for(0.99) < near_dedup.trees_for() <= 9
    assert near_dedup.least_agreeing() < near_dedup.COORDINATES * 0.75


def test_recall_of_trees_that_choose_from_the_same_tokens():
    """At any depth, and with the agreement that real pairs at 0.75 to 0.78 have."""
    trees = near_dedup.trees_for()
    assert all(near_dedup.missed(trees, levels=depth) <= 1 - near_dedup.RECALL for depth in (1, 3, 5, 8, near_dedup.LEVELS))
    rng, lost = np.random.default_rng(2), []
    for k in range(400):
        own = rng.integers(0, 2**64, 1000, np.uint64)
        other = own.copy()
        changed = 124 + k % 19  # similarity (1000 - changed) / (1000 + changed): 0.78 to 0.75
        other[:changed] = rng.integers(0, 2**64, changed, np.uint64)
        p, stays = (near_dedup.minwise(own) == near_dedup.minwise(other)).mean(), 1.0
        for _ in range(near_dedup.LEVELS):
            stays = 1 - (1 - p * stays) ** near_dedup.BRANCHES
        lost.append((1 - stays) ** trees)
    assert np.mean(lost) <= 1 - near_dedup.RECALL


def test_tokens_come_from_all_coordinates(spark):
    """Two classes that agree in all but the first 24 values stay together at most nodes."""
    n = near_dedup.COORDINATES
    sig = lambda x: np.array([x if k < 24 else k for k in range(n)], np.uint16).tobytes()
    rows = [(node, 0, digest, sig(x)) for node in range(200) for x, digest in ((1001, "a"), (1002, "b"))]
    out = near_dedup.Join.children(spark.createDataFrame(rows, "node long, at int, digest string, sig binary"))
    found = {k: {r["node"] for r in out.where(f"digest = '{k}'").collect()} for k in "ab"}
    assert len(found["a"]) == 400 and len(found["a"] & found["b"]) > 300


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert near_dedup.components_of(none).collect() == []
    assert near_dedup.one_of_each(none).collect() == []
    assert substring_dedup.removed(none).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200 + i) for i in range(30)] + [(7, 7)]
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 1 for i in range(1, 41)} | {100: 100} | {200 + i: 100 for i in range(30)}


@pytest.mark.parametrize("at_once", [50, 1_000_000])
def test_substring_dedup(spark, rows, monkeypatch, at_once):
    monkeypatch.setattr(substring_dedup, "WORDS_AT_ONCE", at_once)
    out = substring_dedup.removed(spark.createDataFrame(rows, SCHEMA).repartition(3), buckets=5)
    assert Counter(map(tuple, out.collect())) == kept_words(pairs(rows))


def test_substring_dedup_of_many_copies(spark):
    rows = [(i, "some page " + " ".join(f"w{k}" for k in range(30)) + f" tail {i}") for i in range(60)]
    out = substring_dedup.removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert Counter(map(tuple, out.collect())) == kept_words(rows)


def test_recall_on_planted_pairs(spark):
    """Production parameters, 10,000 pairs at similarity 0.75 to 0.79; shared passages make nodes that branch."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    passages = [[word() for _ in range(20)] for _ in range(4)]
    rows, planted = [], {}
    for i in range(10_000):
        body = [*passages[i % 4][: rng.randint(8, 20)], *(word() for _ in range(rng.randint(60, 160)))]
        n = len(body) - 4
        m = next(m for m in range(n, 0, -1) if 4 * (n - m) >= 3 * (n + m))  # last words to change
        m -= rng.randint(0, m // 8)
        planted[2 * i] = (n - m) / (n + m)
        rows += [(2 * i, " ".join(body)), (2 * i + 1, " ".join([*body[: len(body) - m], *(word() for _ in range(m))]))]
    assert min(planted.values()) >= 0.75 and max(planted.values()) < 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.components_of(docs).collect()}
    lost = [i for i in planted if found[i + 1] != i]
    wrong = [i for i in planted if found[i] != i or found[i + 1] not in (i, i + 1)]
    assert not wrong and len(lost) <= 1, (len(wrong), len(lost))


def test_compared_already_takes_all_bits_of_a_coordinate():
    """Two roots that agree in 16 bits of 32 are two nodes, so their pair still has to be compared."""
    sig = np.arange(near_dedup.COORDINATES, dtype=np.uint16).tobytes()
    for high, pairs in (((1, 1), []), ((1, 2), [(0, 1), (1, 0)])):
        columns = {"node": [7, 7], "at": [1, 1], "digest": [b"a", b"b"], "label": [b"a", b"b"], "size": [2, 2], "n": [90, 90], "mask": [1, 1]}
        table = pa.table(columns | {"high": [np.array([h, 5], np.uint16).tobytes() for h in high], "sig": [sig, sig]})
        x, y = near_dedup.Node(table, 75).similar(np.arange(2), np.arange(2))
        assert sorted(zip(x.tolist(), y.tolist())) == pairs
