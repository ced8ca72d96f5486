"""Lines, dictionaries, word counts, graphs and streams."""

import unicodedata
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from textloom.operators import catalogue, graph, matching, training
from textloom.plans.lineage import checked_broadcast
from textloom.sources import lines
from textloom.streaming import lines as streams


def values(df):
    return sorted(tuple(r) if len(r) > 1 else r[0] for r in df.collect())


def words(spark, *all_words):
    return spark.createDataFrame([(w,) for w in all_words], "word string")


def keys(spark, *all_keys):
    return spark.createDataFrame([(k,) for k in all_keys], "key string")


def test_lines(spark, tmp_path):
    path = tmp_path / "in.txt"
    path.write_bytes(b"line 1\nline 2\n\n#x\nREM y\na\r\nlast")
    assert values(lines.read_lines(spark, str(path), comment_prefix="rem")) == sorted(["line 1", "line 2", "#x", "a\r", "last"])
    assert lines.read_lines(spark, str(path), skip_empty=False).count() == 7
    assert [r["value"] for r in lines.process_lines(lines.read_lines(spark, str(path)), lambda x: x != "#x").collect()] == ["line 1", "line 2"]
    assert lines.read_whole(spark, str(path)).first()["value"].startswith("line 1\nline 2")
    hello = tmp_path / "hello"
    hello.write_text("hello")
    assert lines.file_sizes(spark, str(hello)).first()["length"] == 5  # golden
    table = spark.createDataFrame([(1, "a\n\nb\n"), (2, ""), (3, None), (4, "\n")], "i int, t string")
    assert values(lines.split_lines(table, "t", skip_empty=False)) == [(1, 0, "a"), (1, 1, ""), (1, 2, "b"), (4, 0, "")]
    assert values(lines.split_lines(table, "t")) == [(1, 0, "a"), (1, 2, "b")]


@pytest.mark.parametrize("compression", ["none", "gzip", "snappy"])
def test_lines_round_trip(spark, tmp_path, compression):
    """Golden."""
    out = str(tmp_path / "out")
    made = spark.createDataFrame([(f"line {i}",) for i in range(10)], "value string")
    lines.write_lines(made, out, compression)
    assert values(lines.read_lines(spark, out)) == values(made)


def test_sorted_store(spark, tmp_path):
    path = str(tmp_path / "kv")
    lines.write_sorted(spark.range(100).withColumnRenamed("id", "k"), path, "k")
    assert values(lines.scan_range(spark, path, "k", 7, 10)) == [7, 8, 9]
    lines.save_dictionary(words(spark, "b", "a"), path + "d")
    assert values(lines.open_dictionary(spark, path + "d")) == ["a", "b"]


def test_dictionary(spark):
    """Golden but for the matches' contents."""
    d = words(spark, "a", "yes", "zlib", "ab", "abd", "abcd", "abcde", "aaaa")
    assert matching.record_number(d) == 8
    assert values(matching.is_word(keys(spark, "abcde", "yesp"), "key", d)) == ["abcde"]
    assert values(matching.prefix_matches(keys(spark, "abcde", ""), "key", d).select("word")) == ["a", "ab", "abcd", "abcde"]
    chinese = words(spark, "下载", "下载软件", "下载电影", "下载qq")
    assert values(matching.prefix_matches(keys(spark, "下载软件站"), "key", chinese).select("word", "length")) == [("下载", 6), ("下载软件", 12)]


def test_suffix_first(spark):
    """Golden; the word is derived."""
    assert values(matching.first_substring_match(keys(spark, "abcd"), "key", words(spark, "aabc", "bc"))) == [("abcd", "bc", 1)]
    assert values(matching.first_substring_match(keys(spark, "abcd"), "key", words(spark, "aabc"))) == []
    assert values(matching.substring_matches(keys(spark, "aab"), "key", words(spark, "a", "ab")).select("word", "position")) == [("a", 0), ("a", 1), ("ab", 1)]


def letter_words(text):
    """Runs of letters and marks that begin with a letter, in lower case."""
    runs = ("".join(c for c in g) for k, g in groupby(text or "", lambda c: unicodedata.category(c)[0] in "LM") if k)
    cut = (r.lstrip("".join(c for c in r if unicodedata.category(c)[0] == "M")) if unicodedata.category(r[0])[0] == "M" else r for r in runs)
    return [r.lower() for r in cut if r]


def test_dictionary_over_all_words(spark, tmp_path):
    """Not the first word alone, none cut at an accent, and texts that begin otherwise."""
    texts = ["The été, there LA einé", "12 une\nthe-der", "", None, "éthe \u4e2dla los-los", "(station) their"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: values(catalogue.QUERIES[name](spark, str(tmp_path)))
    index = {w: i for i, w in enumerate(sorted(catalogue.WORDS))}
    every = [(i, at, k) for i, t in enumerate(texts) for at, k in enumerate(letter_words(t))]
    assert run("dict_exact_words") == sorted((i, at, k, index[k], len(k)) for i, at, k in every if k in index)
    distinct = {k for _, _, k in every}
    assert run("dict_prefix_words") == sorted((k, w, index[w], len(w)) for k in distinct for w in index if k.startswith(w))
    places = [(k, w, len(k[:p].encode())) for k in distinct for w in index for p in range(len(k)) if k.startswith(w, p)]
    assert run("dict_substring_words") == sorted(places)
    first = {k: min((x for x in places if x[0] == k), key=lambda x: (x[2], -len(x[1]))) for k in {x[0] for x in places}}
    assert run("dict_first_substring_words") == sorted(first.values())
    assert (0, 3, "la", index["la"], 2) in run("dict_exact_words") and (1, 0, "une", index["une"], 3) in run("dict_exact_words")


def test_staged_conversion_of_every_row(spark, tmp_path):
    """Rows that hold a 'TH' of their own are there too, and stage two converts it alike."""
    rows = [(1, "the cat"), (2, "THE the"), (3, ""), (4, None)]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r["item_id"]: r["staged"] for r in catalogue.QUERIES["staged_conversion"](spark, str(tmp_path)).collect()}
    assert out == {1: "ze cat", 2: "zeE ze", 3: "", 4: None}


def test_indexed_dictionary(spark):
    d = matching.indexed(words(spark, "ALGOL", "ANSI", "ARCO", "ARPA", "ARPANET", "ASCII"))
    found = matching.exact_match(keys(spark, "ALGOL", "nothing"), "key", d).first()
    assert (found["idx"], len(found["word"])) == (0, 5)
    many = spark.range(1000).select(F.format_string("%04d", "id").alias("word")).repartition(7)
    assert all(r["idx"] == int(r["word"]) for r in matching.indexed(many).collect())
    assert values(matching.prefix_matches(keys(spark, "a"), "key", words(spark))) == []


def test_word_counts(spark):
    counts = matching.word_counts(words(spark, "ab", "ab", "abc", "b"))
    assert matching.has(counts, "ab") and not matching.has(counts, "a") and not matching.has(counts, "")
    assert [r[0] for r in matching.search(counts, "a").collect()] == ["ab", "abc"]
    assert [r[0] for r in matching.search(counts, "", 1).collect()] == ["ab"]
    left = matching.without(words(spark, "ab", "ab", "b"), words(spark, "ab", "ab", "ab", "none"))
    assert values(left) == [("ab", 0), ("b", 1)] and not matching.has(left, "ab")
    log = spark.createDataFrame([("a", 1, -1), ("a", 2, 1), ("a", 3, 1), ("a", 4, -1), ("b", 1, -1)], "word string, seq int, op int")
    assert values(matching.replayed(log)) == [("a", 1), ("b", 0)]


EDGES = [
    ("rpc_meta_info_proto", "rpc_option_proto"), ("static_resource", "#pthread"), ("poppy", "rpc_meta_info_proto"), ("poppy", "rpc_option_proto"),
    ("poppy", "static_resource"), ("poppy_mock", "poppy"), ("rpc_channel_test", "poppy"), ("poppy_client", "poppy_swig_wrap"), ("poppy_client", "poppy"),
]


def test_graph(spark):
    """Golden."""
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    assert set(values(graph.dependencies(edges, "poppy"))) == {"rpc_meta_info_proto", "rpc_option_proto", "static_resource", "#pthread"}
    assert {"poppy_client", "poppy_mock"} <= set(values(graph.dependents(edges, "poppy")))
    assert ("poppy_client", "#pthread") in values(graph.closure(edges))
    level = dict(values(graph.levels(edges)))
    assert all(level[a] > level[b] for a, b in EDGES)
    assert values(graph.cyclic(edges)) == []
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    assert values(graph.cyclic(ring)) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        graph.levels(ring)
    assert '"poppy_mock" -> "poppy"' in values(graph.graphviz(edges))


def test_registry(spark):
    names = graph.Registry(spark)
    names.function("twice_it", F.udf(lambda x: x * 2, "int"))
    names.variable("n", 3)
    assert spark.sql("select twice_it(4) as x").first()["x"] == 8 and names.all()["n"] == 3


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.txt").write_text(f"one two\n\n# c\ntwo {i}\n")
    seen = []
    stream = streams.stream_lines(spark, str(folder), comment_prefix="#", files_per_batch=1)
    streams.for_each_batch(stream, lambda df, n: seen.append(sorted(r[0] for r in df.collect())), str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(x for part in seen for x in part) == sorted(["one two"] * 3 + [f"two {i}" for i in range(3)]) and len(seen) == 3
    query = streams.count_words(streams.stream_lines(spark, str(folder))).writeStream.outputMode("complete").format("memory").queryName("word_counts").start()
    query.processAllAvailable()
    query.stop()
    assert dict(values(spark.table("word_counts")))["two"] == 6


def test_linear_models(spark):
    rows = spark.createDataFrame([([float(i % 7), float(i % 3)], int(i % 7 > 3)) for i in range(200)], "x array<double>, y int")
    for kind in ("logistic", "svm"):
        out = training.predict_linear(training.train_linear(rows, kind=kind), rows)
        assert out.where("predicted = y").count() >= 190


def test_checked_broadcast(spark):
    small = spark.range(10).toDF("a")
    plan = lambda limit: small.join(checked_broadcast(small.toDF("a"), limit), "a")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(10_000) and "broadcast" not in plan(10)


def test_lines_stop_at_the_first_refusal_of_a_file_that_spans_tasks(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    for name, stop in (("a", 700), ("b", 3), ("c", None)):
        (folder / name).write_text("".join("STOP\n" if k == stop or k == 900 and stop else f"{name} {k}\n" for k in range(1000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        rows = lines.numbered_lines(spark, str(folder))
        assert rows.rdd.getNumPartitions() > 8
        expected = sorted(f"{n} {k}" for n, end in (("a", 700), ("b", 3), ("c", 1000)) for k in range(end))
        assert sorted(r["value"] for r in lines.until_refused(rows, F.col("value") != "STOP", ["file"], ["block", "at"]).collect()) == expected
        called = spark.sparkContext.accumulator(0)

        def accepts(line):
            called.add(1)
            return line != "STOP"

        out = lines.process_ordered(rows, accepts, ["file"], ["block", "at"])
        assert out.columns == ["file", "block", "at", "value"] and sorted(r["value"] for r in out.collect()) == expected
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    odd = spark.createDataFrame([(None, 1, "x"), (None, 2, None), (None, 3, "y"), (1, 1, "z")], "g int, n int, v string")
    assert sorted(r["v"] for r in lines.until_refused(odd, F.col("v") != "q", ["g"], ["n"]).collect()) == ["x", "z"]


def test_counted_stream_goes_on_after_a_restart_and_forgets_idle_words(spark, tmp_path):
    import datetime
    import random

    rng, day = random.Random(3), datetime.datetime(2024, 1, 1)
    schema = "word string, seq long, op int, ts timestamp"
    log = [(rng.choice("abcd"), k, rng.choice([1, -1, -1]), day + datetime.timedelta(minutes=k)) for k in range(60)]
    folder, path = tmp_path / "log", f"file://{tmp_path}/stream"

    def arrive(rows):
        spark.createDataFrame(rng.sample(rows, len(rows)), schema).coalesce(1).write.mode("append").parquet(str(folder))

    def counts(idle_ms=10**12):
        out = streams.replayed_stream(spark, str(folder), spark.createDataFrame([], schema).schema, path, 1, idle_ms)
        return out.groupBy("word").agg(F.max_by(F.struct("cnt", "expired"), F.struct("seq", "batch")).alias("x")).select("word", "x.*")

    for start in (0, 20):
        arrive(log[start : start + 20])
    counts()
    arrive(log[40:])
    got = {r["word"]: r["cnt"] for r in counts().collect()}  # a new query from the checkpoint
    replayed = matching.replayed(spark.createDataFrame(log, schema))
    assert got == {r["word"]: r["cnt"] for r in replayed.collect()}
    again = {r["word"]: r["cnt"] for r in counts().collect()}
    assert again == got

    path = f"file://{tmp_path}/idle"
    folder = tmp_path / "idle_log"
    hour = 3_600_000
    arrive([("old", 0, 1, day), ("new", 1, 1, day)])
    arrive([("new", 2, 1, day + datetime.timedelta(hours=5))])
    arrive([("new", 3, 1, day + datetime.timedelta(hours=9))])
    arrive([("old", 4, 1, day + datetime.timedelta(hours=9))])
    rows = streams.replayed_stream(spark, str(folder), spark.createDataFrame([], schema).schema, path, 1, 2 * hour).collect()
    assert ("old", 1, True) in {(r["word"], r["cnt"], r["expired"]) for r in rows}
    assert max((r["seq"], r["cnt"]) for r in rows if r["word"] == "old") == (4, 1)  # begins anew


def test_strong_parts_against_reachability(spark):
    import random

    rng = random.Random(12)
    for n, m in ((12, 16), (30, 45), (40, 38)):
        pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        reach = {a: {a2 for b, a2 in pairs if b == a} for a in range(n)}
        for _ in range(n):
            reach = {a: r.union(*(reach[b] for b in r)) if r else r for a, r in reach.items()}
        expected = {a: max(b for b in r if a in reach[b]) for a, r in reach.items() if a in r}
        edges = spark.createDataFrame([*pairs, *list(pairs)[:3]], "src int, dst int")
        assert {r["node"]: r["part"] for r in graph.strong_parts(edges).collect()} == expected
    chain = spark.createDataFrame([(1, 2), (2, 3)], "src int, dst int")
    assert graph.strong_parts(chain).collect() == [] == graph.strong_parts(chain.limit(0)).collect()


def _rounds(monkeypatch, edges):
    kept = []
    monkeypatch.setattr(graph, "checkpointed", lambda df, real=graph.checkpointed: kept.append(real(df)) or kept[-1])
    return {r["node"]: r["part"] for r in graph.strong_parts(edges).collect()}, kept


def test_strong_parts_are_coloured_both_ways_at_once(spark, monkeypatch):
    """A ring of 12 takes 12 rounds, not 12 forward and 12 backward; the edges of the caller are computed once."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        calls.add(1)
        return x

    ring = spark.range(12).select(counted(F.col("id")).alias("src"), ((F.col("id") + 1) % 12).alias("dst"))
    parts, kept = _rounds(monkeypatch, ring)
    assert parts == {i: 11 for i in range(12)}
    assert calls.value == 12 and len(kept) < 20


def test_strong_parts_in_rows(spark):
    """Parts in a row, the greatest nodes rising, falling and mixed; edges twice, loops on and off parts, null ends."""
    for order in ((1, 2, 3, 4), (4, 3, 2, 1), (2, 4, 1, 3)):
        pairs, expected = [(None, 1), (1, None), (500, 500), (101, 101)], {500: 500}
        for k, x in enumerate(order):
            ring = [x * 100 + i for i in (0, 2, 1)]
            pairs += [(a, b) for a, b in zip(ring, ring[1:] + ring[:1])] * 2
            pairs += [(order[k - 1] * 100, x * 100 + 50), (x * 100 + 50, x * 100 + 1)] if k else []
            expected |= {a: x * 100 + 2 for a in ring}
        for kind in ("long", "string"):
            edges = spark.createDataFrame(pairs, "src long, dst long").select(F.col("src").cast(kind), F.col("dst").cast(kind))
            assert {(int(r["node"]), int(r["part"])) for r in graph.strong_parts(edges).collect()} == set(expected.items())


def test_strong_parts_with_hash_tables_and_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(graph, "HASHED_EDGES", 0)
    monkeypatch.setattr(graph, "FRONT_BYTES", -1)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6), (0, 1)], "src int, dst int")
    assert {r["node"]: r["part"] for r in graph.strong_parts(edges).collect()} == {1: 3, 2: 3, 3: 3, 4: 5, 5: 5}
