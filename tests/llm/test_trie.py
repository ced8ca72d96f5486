"""The prefix trie against plain Python over all prefixes."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from textloom.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def sequences(rows, rebuild):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, role, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    if not rebuild:
        return own
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def brute(seqs):
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = defaultdict(list)
    for key in members:
        if key:
            kids[key[:-1]].append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        leaves[key] = sum(leaves[k] for k in kids[key]) or 1
        own = (len(members[key]) - 1) * len(key[-1][1].encode()) if key else 0
        saved[key] = own + sum(saved[k] for k in kids[key])
    ends = lambda key: hashlib.sha256(",".join(str(c) for c in sorted(members[key]) if len(seqs[c]) == len(key)).encode()).hexdigest()
    return Counter((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], ends(k)) for k, m in members.items())


def talks(seed, n=60, long=12):
    rng = random.Random(seed)
    rows, known = [], []
    for c in range(-3, n):
        if c % 9 == 4:
            continue
        turns = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é", None, "a longer text " * 3])) for _ in range(rng.randint(1, long))]
        if known and c % 3:
            turns = rng.choice(known)[: rng.randint(0, long)] + turns[: rng.randint(0, 2)] or turns
        known.append(turns)
        rows += [(c * (1 if seed % 2 else 1000003), rng.choice([k, k, k, None]) if seed == 2 else k, *t) for k, t in enumerate(turns)]
    rng.shuffle(rows)
    return rows + rows[:4] + [(None, 1, "user", "of no conversation")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_query_against_plain_python(spark, tmp_path, seed):
    rows = talks(seed)
    spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("clash")).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries.op11_prefix_trie(spark, str(tmp_path))
    assert out.columns == list(prefix_trie.NAMES)
    assert Counter(map(tuple, out.collect())) == brute(sequences(rows, True))


def test_long_shared_prefixes_take_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "MOST_TURNS", 4)
    base = [(t, "u", f"text {t}") for t in range(40)]
    rows = [(1, *t) for t in base] + [(2, *t) for t in base] + [(3, *t) for t in base[:30]] + [(4, *t) for t in base[:37]] + [(4, 90, "u", "other")]
    got = Counter(map(tuple, prefix_trie.trie(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == brute(sequences(rows, False))


def test_copies_end_at_one_node_whose_ids_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = [(c, t, "u", f"x{t}") for c in range(100) for t in range(3)]
    assert Counter(map(tuple, prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())) == brute(sequences(rows, False))


def test_one_and_no_conversation(spark):
    rows = [(7, 0, "u", "x"), (7, 1, "a", "y")]
    assert Counter(map(tuple, prefix_trie.trie(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(sequences(rows, False))
    assert prefix_trie.rebuilt_trie(spark.createDataFrame([(None, 0, "u", "x")], SCHEMA)).collect() == []


def test_blocks():
    from itertools import count, islice

    sizes, start = [], 1
    for block in islice(count(), 20):
        sizes.append(prefix_trie.last_of(block) - start + 1)
        start = prefix_trie.last_of(block) + 1
    assert sizes[:5] == [1, 2, 4, 8, 16] and max(sizes) == prefix_trie.MOST_TURNS and sizes[-5:] == [prefix_trie.MOST_TURNS] * 5
