"""Pattern sets and large dictionaries against trying everything."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import grams, matching, patterns

PATTERNS = [
    "hello", "(?i)HELLO wor", "foo|barbaz", "foo(d|l|t)ing", "a{3}b+cde", "x[abc]yz", "(one|two) (three|four)five", "colou?r", "^start", "end$",
    r"\d+ items", r"item\d{2}", "(?:very )+long", "un[^d]one", "a.c", "zz", "(abc)\\1", r"cafés", "é+t[eé]s", "(?i)straße", "mid(?=dle)", "(?<!x)word", r"\bwhole\b",
    "tab\tstop", r"q\.e\.d", "[a-c]lpha", "(?s)first.*last", "ab(cd|(ef|gh)ij)kl", "a(b|cde)*f", r"\p{Lu}pper", "[[a-z]&&[^b]]zed", r"\Qa.b\E!", "(?x) spaced out", r"\h+horiz", "nothing here to find",
]


@pytest.mark.parametrize("pattern", [p for p in PATTERNS if not re.search(r"\\[pQh]|&&", p)])
def test_any_match_holds_a_literal_of_every_group(pattern):
    """Random texts around what the pattern is made of: where it matches, each group has a literal in the text."""
    rng = random.Random(pattern)
    parts = re.findall(r"\w+|\W", pattern) + ["a", "b", "c", " ", "foo", "d", "x", "3", "items", "ing", "kl", "five", "r", "é", "\n", "aaa", "bbb"]
    groups = patterns.required(pattern)
    parts += [x for group in groups for x in group]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))
        text = rng.choice([text, text.upper(), text.lower()])
        if re.search(pattern, text):
            assert all(any(x in patterns.lower(text) for x in group) for group in groups), text


def test_groups():
    assert patterns.required("hello") == [["hello"]]
    assert patterns.required("(?i)HEL+O wor[ld]d") == [["hel"], ["o wordd", "o world"]]
    assert patterns.required("foo(d|l)ing.*(one|twofold)x") == [["fooding", "fooling"], ["onex", "twofoldx"]]
    assert patterns.required("(ab+cde|xyz.)") == [["cde", "xyz"]]
    assert patterns.required("a.c") == patterns.required("(abc|d)") == patterns.required(r"\p{L}abc") == patterns.required("abc)") == []


def test_first_bytes_are_found_in_their_own_texts(monkeypatch):
    monkeypatch.setattr(patterns, "AT_ONCE", 5)
    known = patterns.Literals([(7, 0, "abc"), (7, 1, "long literal"), (7, 1, "été"), (9, 0, "abcde"), (9, 0, "xyz"), (9, 1, "abc"), (9, 0, "long literally")])
    texts = ["abc", "abcde", "ab", "c long literal abc", "", "abété", "étéabc", "xyz", "abc xyz", "ab"]
    data = np.frombuffer("".join(texts).encode() + bytes(8), np.uint8)
    ends = np.cumsum([len(t.encode()) for t in texts])
    text, pattern = known.candidates(data, ends, known.first())
    assert list(zip(text.tolist(), pattern.tolist())) == [(1, 9), (3, 7), (6, 7), (8, 9)]
    assert list(patterns._slices(np.array([1, 1, patterns.TOGETHER + 9, patterns.TOGETHER + 10]))) == [(0, 2), (2, 3), (3, 4)]


def test_texts_stay_in_their_partitions(spark, monkeypatch):
    """Only found pairs are shuffled; literals too many to be sent are joined to grams, with the same rows."""
    docs = spark.createDataFrame([(1, "Hello there"), (2, "nothing"), (2, "where hello"), (3, "HELLLO")], "id int, text string")
    rules = spark.createDataFrame([(1, "(?i)hel+o"), (1, "nothing"), (2, "there|where")], "pattern_id int, pattern string")
    found = patterns.matches(docs, rules)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    rows = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(patterns, "BROADCAST_BYTES", 0)
    assert rows == sorted(map(tuple, patterns.matches(docs, rules).collect())) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1)]


def test_matches_equal_a_product(spark):
    rng = random.Random(4)
    words = ["hello", "HELLO world", "foolding", "fooling", "barbaz", "aaabbcde", "xbyz", "two fourfive", "color", "start", "end", "12 items", "item77", "very very long", "unxone", "abc", "zz", "cafés", "ééts étés", "straße",
             "middle", "word", "xword", "whole", "tab\tstop", "q.e.d", "alpha", "first\nx last", "abefijkl", "abghijkl", "Upper", "azed", "a.b!", "spacedout", " horiz", "\U0001f600"]
    texts = [(i % 190, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(200)] + [(None, "hello"), (7, None), (8, "")]
    docs = spark.createDataFrame(texts, "doc_id int, text string").repartition(3)
    rules = spark.createDataFrame(list(enumerate(PATTERNS)), "pattern_id int, pattern string")
    got = {tuple(r) for r in patterns.matches(docs, rules, "doc_id").collect()}
    every = docs.crossJoin(rules).where(F.col("doc_id").isNotNull() & F.regexp_like("text", "pattern")).select("doc_id", "pattern_id").distinct()
    assert got == {tuple(r) for r in every.collect()} and len({p for _, p in got}) > 25
    assert patterns.matches(docs.limit(0), rules, "doc_id").collect() == [] == patterns.matches(docs, rules.limit(0), "doc_id").collect()
    assert {r["pattern_id"] for r in patterns.matches(docs, rules.where("pattern = 'zz'"), "doc_id").collect()} == {PATTERNS.index("zz")}


def test_patterns_with_literals_do_not_meet_every_text(spark):
    docs = spark.createDataFrame([(1, "hello there"), (2, "nothing")], "id int, text string")
    rules = spark.createDataFrame([(1, "hel+o"), (2, "there|where")], "pattern_id int, pattern string")
    plan = patterns.matches(docs, rules)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_occurrences_of_a_large_dictionary(spark):
    rng = random.Random(6)
    letters = "abcé\U0001f600"
    words = sorted({"".join(rng.choices(letters, k=rng.choice([1, 2, 3, 4, 6, 7, 9, 15, 17, 30]))) for _ in range(3000)})
    keys = ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(60)] + ["".join(words[k : k + 3]) for k in range(0, 300, 7)]
    rows = grams.occurrences(spark.createDataFrame([(k,) for k in set(keys)], "key string"), "key", spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, idx int"), "word")
    got = sorted((r["key"], r["word"], r["at"]) for r in rows.collect())
    assert got == sorted((k, w, i) for k in set(keys) for w in words for i in range(len(k)) if k.startswith(w, i))
    first = matching.first_substring_match(spark.createDataFrame([("xxab",)], "key string"), "key", spark.createDataFrame([("a",), ("ab",), ("",)], "word string")).collect()
    assert [tuple(r) for r in first] == [("xxab", "ab", 2)]
    assert grams.occurrences(spark.createDataFrame([("ab",)], "key string"), "key", spark.createDataFrame([], "word string, idx int"), "word").columns == ["key", "word", "idx", "at"]
