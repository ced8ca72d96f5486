"""Periodic runs against a scan of every stretch, and the query against plain Python."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from textloom.llm import periodic_runs, queries

from .helpers import SCHEMA, corpus, words


def brute(w, least=24, times=3):
    """Every maximal stretch of each period; those that have a smaller period go."""
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            end = i
            while end + q < len(w) and w[end] == w[end + q]:
                end += 1
            length = end - i + q
            if length >= max(least, times * q) and not any(all(w[x] == w[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = max(end, i + 1)
    return sorted(out)


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_a_scan(seed):
    rng = random.Random(seed)
    w = []
    for _ in range(rng.randint(1, 6)):
        w += [rng.choice("abc") if seed % 2 else rng.randrange(5000) for _ in range(rng.randint(0, 40))]
        unit = [rng.choice("ab") if seed % 3 else rng.randrange(9) for _ in range(rng.randint(1, 12))]
        w += (unit * 9)[: rng.randint(1, 9 * len(unit))]
    assert periodic_runs.runs(w) == brute(w)
    assert periodic_runs.runs(w, 4, 2) == brute(w, 4, 2)


def test_borders():
    assert periodic_runs.runs([]) == [] and periodic_runs.runs(["x"] * 23) == []
    assert periodic_runs.runs(["x"] * 24) == [(0, 24, 1)]
    assert periodic_runs.runs(list("abcdefgh") * 3) == [(0, 24, 8)] and periodic_runs.runs(list("abcdefghi") * 3)[:-1] == []
    assert periodic_runs.runs(list(range(9)) * 3 + [7]) == [(0, 27, 9)] and periodic_runs.runs((list(range(9)) * 3)[:-1]) == []
    assert periodic_runs.runs(["a"] * 30 + ["b"] * 30) == [(0, 30, 1), (30, 30, 1)]
    assert periodic_runs.greatest([(5, 30, 3), (0, 40, 4), (0, 20, 2)]) == (0, 20, 2)
    assert len(periodic_runs.runs(list(range(7000)) * 3)) == 1  # 13 planes


def expected(rows):
    out = Counter()
    for i, text in rows:
        w, h = words(text), None if i is None else zlib.crc32(str(i).encode())
        if h is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = brute(w) if len(w) < 2000 else [(0, len(w), 1)]
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        gone = {x for s, length, q in found for x in range(s + q, s + length)}
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[(i, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))] += 1
    return out


NAMES = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_against_plain_python(spark, tmp_path):
    rows = [r for r in corpus(200) if len(r[1] or "") < 5000 or set(r[1]) <= set("x w")]
    rows += [(900 + k, " ".join(["alpha beta"] * k), "en", "s", 0) for k in (11, 12, 40)]
    spark.createDataFrame(rows, SCHEMA).withColumn("Runs", F.lit("clash")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert Counter(tuple(r[c] for c in NAMES) for r in got.collect()) == expected([(r[0], r[1]) for r in rows])
    assert any(r["n_runs"] and zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0 for r in got.collect())


def test_operator_keeps_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b " * 20, "x"), (2, None, "y")], "k long, body string, period string")
    out = periodic_runs.with_runs(docs, text_col="body")
    assert out.columns[:2] == ["k", "body"]
    one, two = sorted(out.collect(), key=lambda r: r["k"])
    assert (one["collapsed"], one["runs"][0].asDict(), one["exponent_milli"]) == ("a b", {"start": 0, "length": 40, "period": 2}, 20000)
    assert (two["collapsed"], two["runs"], two["period"]) == ("", [], None)
    assert periodic_runs.with_runs(docs.limit(0), text_col="body").collect() == []
