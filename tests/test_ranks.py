import random

from pyspark.sql import functions as F

from textloom.plans.ranks import numbered


def test_places_overall_and_within_groups_that_span_ranges(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 20 + ["a", "b", None]), rng.choice([None, *range(30)])) for _ in range(700)]
    df = spark.createDataFrame(rows, "g string, x int").repartition(5)
    order = [F.asc_nulls_first("x")]
    got = [tuple(r) for r in numbered(df, order, ["g"]).collect()]
    expected = []
    for g in {r[0] for r in rows}:
        own = sorted((x if x is not None else -1) for h, x in rows if h == g)
        expected += [(g, None if x < 0 else x, k + 1) for k, x in enumerate(own)]
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(got, key=key) == sorted(expected, key=key)
    overall = sorted((r["at"], r["x"] is not None, r["x"]) for r in numbered(df, order, name="at").collect())
    assert [r[0] for r in overall] == list(range(1, 701)) and [r[1:] for r in overall] == sorted(r[1:] for r in overall)
    assert numbered(df.limit(0), order, ["g"]).collect() == []
