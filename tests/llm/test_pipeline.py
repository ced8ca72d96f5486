"""The pipeline's stages against brute-force versions, each on its own input."""

import hashlib
import math
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from textloom.llm import mixing, quality_rules

from .helpers import SCHEMA, corpus, near_components, shingles, words
from .test_rules import expected_targets


def test_stages(spark, tmp_path):
    rows = corpus(80, seed=9)
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    docs = spark.read.parquet(path)
    held = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, held[-1], str(tmp_path))
        target = str(tmp_path / f"stage{k}")
        out.write.parquet(target)
        held.append(spark.read.parquet(target))
    for out in held[1:-1]:
        assert out.columns == docs.columns
    texts = [Counter((r["doc_id"], r["text"]) for r in x.collect()) for x in held]

    verdict = Counter((r["doc_id"], r["n_words"]) for r in quality_rules.judged(docs).where("kept").collect())
    assert Counter((i, len(words(t))) for i, t in texts[1].elements()) == verdict
    assert all((i, len(words(t))) for i, t in texts[2].elements()) and sum(texts[2].values()) == sum(texts[1].values())

    pairs = [(i, t) for i, t in texts[2].elements()]
    found = near_components(pairs)
    # One row of each component of texts with words; of the others all rows.
    assert {i for i, t in texts[3] if words(t)} == {k[2] for k in found if k[1]} and not texts[3] - texts[2]
    assert sum(n for (i, t), n in texts[3].items() if words(t)) == len(components(texts[2]))
    assert Counter({k: n for k, n in texts[3].items() if not words(k[1])}) == Counter({k: n for k, n in texts[2].items() if not words(k[1])})

    taken = sum(r["taken"] for r in mixing.mixture(held[3]).collect())
    assert sum(len(words(t)) for _, t in texts[4].elements()) == taken
    assert set(texts[4]) <= set(texts[3]) and max(texts[4].values()) <= 2 * max(texts[3].values())

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert texts[5] == Counter({(i, t or ""): n for (i, t), n in texts[4].items()})
    for r in held[5].collect():
        assert r["ids"] == library.encode(r["text"], add_special_tokens=False).ids


def components(texts):
    """The components of texts with words, as sets of texts."""
    own = [[t, shingles(t)] for t in {t for _, t in texts if words(t)}]
    groups = []
    for t, s in own:
        near = [g for g in groups if any(100 * len(s & x) >= 75 * len(s | x) for _, x in g)]
        groups = [g for g in groups if g not in near] + [sum(near, []) + [(t, s)]]
    return groups


def read(df):
    return Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())


def test_line_stage_against_plain_python(spark, tmp_path):
    """The shares of lines told again: at least 5 pages and more than 0.02 of the source's."""
    rows = corpus(80, seed=9)
    pages, on = defaultdict(set), defaultdict(set)
    for _, text, _, source, _ in rows:
        if text is not None:
            pages[source].add(text)
            for line in text.split("\n"):
                on[source, line].add(text)
    bad = {k for k, n in on.items() if words(k[1]) and len(n) >= 5 and len(n) > 0.02 * len(pages[k[0]])}
    cut = lambda text, source: None if text is None else "\n".join(x for x in text.split("\n") if (source, x) not in bad)
    expected = Counter((r[0], cut(r[1], r[3]), r[3]) for r in rows)
    assert read(corpus_pipeline.line_stage(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path))) == expected
    assert expected != Counter((r[0], r[1], r[3]) for r in rows) and any(words(r[1]) for r in expected)


def test_mixing_stage_against_plain_python(spark, tmp_path):
    """The copies told again: the whole part of the rate, and one more by the id's MD5 draw."""
    rows = corpus(80, seed=9)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    target, expected = expected_targets(dict(sizes)), Counter()
    for i, text, _, source, _ in rows:
        rate = target[source] / sizes[source] if sizes[source] else 0.0
        draw = int(hashlib.md5(f"{'' if i is None else i}:20".encode()).hexdigest()[:13], 16) / 2**52
        expected[(i, text, source)] += math.floor(rate) + (draw < rate - math.floor(rate))
    assert read(corpus_pipeline.mixing_stage(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path))) == +expected


def test_run_writes_between_stages(spark, tmp_path, monkeypatch):
    seen = []

    def stage(name):
        def run(spark, docs, sf_dir):
            seen.append((name, len(docs.inputFiles()), docs.count()))
            return docs.where("doc_id % 2 = 0" if name == "first" else "true")

        return name, run

    spark.createDataFrame(corpus(10), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("first"), stage("second"), stage("third")])
    n = corpus_pipeline.run(spark, str(tmp_path)).count()
    assert [x[0] for x in seen] == ["first", "second", "third"] and all(x[1] > 0 for x in seen) and seen[1][2] == seen[2][2] == n


def test_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "MinHash near-dedup", "mixing sources to target weights", "BPE encoding and decoding"]
