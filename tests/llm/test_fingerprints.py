"""Fingerprints: peeling against sets of digests, and the query against plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import fingerprints as fp
from textloom.llm import queries

from .helpers import SCHEMA, corpus


def split(*sets):
    """What peeling finds for the pair of the first two sets of digests, and for that of the last two."""
    found = fp.Digests(list(sets))
    keys, pair, sign = fp.differences(found, fp.first_sketches(found), np.array([0, len(sets) - 2]), np.array([1, len(sets) - 1]))
    return [set(keys[(pair == p) & (sign == s)].tolist()) for p in (0, 1) for s in (1, -1)]


def printed(text):
    found = fp.Digests([fp.digests(text)])
    return fp.packed(found, fp.first_sketches(found))[0]


def jaccard(a, b):
    a, b = Counter(fp.paragraphs(a)), Counter(fp.paragraphs(b))
    every = sum((a | b).values())
    return sum((a & b).values()) / every if every else 1.0


@pytest.mark.parametrize("left,right,both", [(0, 0, 0), (0, 0, 50), (3, 2, 5000), (40, 0, 7), (0, 300, 1), (2000, 1500, 900), (1, 0, 0)])
def test_peeling_recovers_what_differs(left, right, both):
    rng = np.random.default_rng(left + 7 * right + both)
    keys = np.unique(rng.integers(0, 2**63, left + right + both, np.uint64))
    rng.shuffle(keys)
    mine, theirs = set(keys[:left].tolist()), set(keys[left + both :].tolist())
    assert split(keys[: left + both], keys[left:], keys[left:], keys[: left + both]) == [mine, theirs, theirs, mine]


def test_a_sketch_that_is_too_small_fails_and_a_larger_one_is_made():
    keys = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    found = fp.Digests([keys[:200], keys[200:], keys[:0], keys[:5]])
    first = fp.first_sketches(found)
    *_, failed = first.rows(np.array([0, 3])).minus(first.rows(np.array([1, 2]))).peeled()
    assert failed.tolist() == [True, False]
    about = first.rows(np.array([0, 3])).minus(first.rows(np.array([1, 2]))).differing()
    assert 100 < about[0] < 1200 and about[1] == 5
    assert split(keys[:200], keys[200:], keys[:0], keys[:5]) == [set(keys[:200].tolist()), set(keys[200:].tolist()), set(), set(keys[:5].tolist())]


def test_paragraphs_repeats_and_digests():
    assert fp.paragraphs("A b. C d!\n\n e\r\n \n. f") == ["A b.", "C d!", "e", ".", "f"]
    assert len(fp.digests("x\nx\ny\nx")) == 4 and len(set(fp.digests("x\nx\ny\nx").tolist())) == 4
    assert set(fp.digests("x\nx").tolist()) < set(fp.digests("x\nx\nx").tolist())


def expected(rows):
    """By full sort; ties by nothing, so only rows with distinct ids and texts."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = {}
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        out[i] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), round(jaccard(text, changed), 12), round(jaccard(text, following), 12))
    return out


@pytest.mark.parametrize("part_bytes", [1500, 1 << 26])
def test_query_against_plain_python(spark, tmp_path, part_bytes):
    rng = random.Random(2)
    rows = [r for r in {r[0]: r for r in corpus(150)}.values()]
    rows = [(r[0], r[1] and r[1].replace(" a", ". a"), *r[2:]) for r in rows] + [(-5, "lowest. of\nall", None, None, 1)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("guest", F.lit(1)).repartition(4)
    got = fp.fingerprinted(docs, part_bytes=part_bytes).collect()
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"], round(r["near_edited"], 12), round(r["near_next"], 12)) for r in got} == expected([(r[0], r[1]) for r in rows])
    texts = dict((r[0], r[1] or "") for r in rows)
    assert all(r["fingerprint"] == printed(texts[r["doc_id"]]) for r in got)


def test_query_on_repeated_rows_and_odd_ids(spark, tmp_path):
    rows = corpus(60)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_fingerprints(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    again = fp.fingerprinted(spark.createDataFrame(rows, SCHEMA).repartition(5), part_bytes=900).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_one_row_follows_itself_and_no_row_none(spark):
    docs = spark.createDataFrame([("k", "a b. c")], "name string, text string")
    (row,) = fp.fingerprinted(docs, id_col="name").collect()
    assert (row["name"], row["n_chars"], row["near_next"]) == ("k", 6, 1.0)
    assert fp.fingerprinted(docs.limit(0), id_col="name").collect() == []


def test_changed_paragraphs(spark):
    old, new = "one. two. two. three\nfour", "one. two. THREE\nfour. five"
    rows = spark.createDataFrame([(1, old, new), (2, None, ""), (3, old, old)], "k int, old string, new string")
    out = {r["k"]: (r["removed"], r["added"]) for r in fp.changed_paragraphs(rows, "old", "new").collect()}
    assert out == {1: (["two.", "three", "four"], ["THREE", "four.", "five"]), 2: ([], []), 3: ([], [])}
