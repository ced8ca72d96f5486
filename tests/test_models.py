"""Charsets by scores, and trust-region Newton steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import charsets, training

#: A sentence or two in each of some scripts, with the charset they are written in.
WRITTEN = {
    "utf-8": "Größere Gärten blühen im März, süße Äpfel fallen später. Les élèves français étudient près du château.",
    "gb18030": "我们在学校里学习数学和历史，老师讲得很清楚。今天的天气非常好，大家都去公园。",
    "big5": "我們在學校裡學習數學和歷史，老師講得很清楚。今天的天氣非常好，大家都去公園。",
    "euc_jp": "わたしたちは学校で数学を学びます。今日はとても天気がいいので、みんなで公園へ行きました。",
    "shift_jis": "先生はいつもやさしく説明してくれます。あしたは雨が降るかもしれないとニュースで言っていました。",
    "euc_kr": "우리는 학교에서 수학과 역사를 배웁니다. 오늘은 날씨가 아주 좋아서 모두 공원에 갔습니다.",
    "cp1251": "Мы учимся в школе и читаем книги. Сегодня очень хорошая погода, и все пошли гулять в парк.",
    "koi8_r": "Учитель всегда объясняет спокойно и понятно. Завтра, может быть, пойдёт дождь, говорят в новостях.",
    "iso8859_7": "Μαθαίνουμε μαθηματικά στο σχολείο. Σήμερα ο καιρός είναι πολύ καλός και πήγαμε όλοι στο πάρκο.",
    "latin_1": "Señor, mañana habrá una reunión en el café. Más tarde iré a comprar algún libro en español.",
    "utf-16-le": "The teacher explains everything slowly, and tomorrow it may rain, as they said in the news.",
}


def test_confusion_table(spark):
    rows = spark.createDataFrame([(n, t) for n, t in WRITTEN.items()], "name string, text string")
    model = charsets.fitted(rows)
    halves = rows.select("name", F.explode(F.array(F.left("text", F.length("text") / 2), F.expr("substr(text, length(text) div 2 + 1)"))).alias("text"))
    data = halves.select("name", charsets.encoded(F.col("text"), F.col("name")).alias("data"))
    seen = data.select("name", charsets.detected(spark, model, F.col("data"))["charset"].alias("charset")).groupBy("name", "charset").count()
    assert sorted(map(tuple, seen.collect())) == sorted((n, n, 2) for n in WRITTEN)


def test_text_that_the_model_has_not_seen(spark):
    """Fitted on one half of each text, the other half's script is still told."""
    texts = list(WRITTEN.values())
    model = charsets.fitted(spark.createDataFrame([(t[: len(t) * 2 // 3],) for t in texts], "text string"))
    rest = spark.createDataFrame([(n, t[len(t) * 2 // 3 :]) for n, t in WRITTEN.items()], "name string, text string")
    data = rest.select("name", charsets.encoded(F.col("text"), F.col("name")).alias("data"))
    seen = data.select("name", charsets.detected(spark, model, F.col("data"))["charset"].alias("charset")).collect()
    assert sum(r["name"] == r["charset"] for r in seen) >= 9


def test_letters_are_told_by_what_stands_around_them(spark):
    """A capital begins a text or a sentence, and an accented letter suits its word: cp850 and mac_roman read the same byte as either."""
    texts = ["Éaux. Étre la. Êaux.", "pas êaux, la êaux, des êaux.", "von äeinsch, den Häeinsch.", "une mèere, la fèeu, la crèe, la grèe, la trèe."]
    model = charsets.fitted(spark.createDataFrame([(t,) for t in texts], "text string"))
    given = [("cp850", "Éaux."), ("mac_roman", "pas êaux."), ("mac_roman", "den äeinsch."), ("utf-8", "üü üü üü üü")]
    rows = spark.createDataFrame(given, "name string, text string").select("name", charsets.encoded(F.col("text"), F.col("name")).alias("data"))
    seen = rows.select("name", charsets.detected(spark, model, F.col("data"), ("utf-8", "cp850", "mac_roman"))["charset"].alias("charset"))
    assert [r["charset"] for r in seen.collect()] == [n for n, _ in given]


def test_marks_nulls_and_what_fits_nothing(spark):
    model = charsets.fitted(spark.createDataFrame([(None,), ("",), ("plain text",)], "text string"))
    data = spark.createDataFrame([(0, b"\xef\xbb\xbfx"), (1, b"\xff\xfex\0"), (2, None), (3, b"\xff\xff"), (4, b""), (5, b"plain")], "k int, data binary")
    seen = data.select("k", charsets.detected(spark, model, F.col("data"), ("utf-8", "euc_kr"))["charset"].alias("charset"))
    assert [r["charset"] for r in seen.orderBy("k").collect()] == ["utf-8", "utf-16-le", None, None, "utf-8", "utf-8"]


@pytest.mark.parametrize("most", [charsets.KEYS, 0])
def test_close_readings_meet_their_longer_contexts(spark, monkeypatch, most):
    """The other columns stay, equal ones too; rows without bytes, and those that nothing fits, stay as detected. Contexts
    that are too many for the tasks give the same."""
    monkeypatch.setattr(charsets, "KEYS", most)
    texts = spark.createDataFrame([("Est les sur des et. Ç.",), *[("Das ist gut. Ä.",)] * 20, (None,), ("plain text",)], "text string")
    model, names = charsets.fitted(texts), ("utf-8", "cp850", "mac_roman")
    letter = "Est les sur des et. Ç."
    rows = [(1, letter.encode("cp850")), (1, letter.encode("mac_roman")), (1, letter.encode("cp850")), (2, "Das ist gut. Ä.".encode("mac_roman")), (3, None), (4, b""), (5, b"plain")]
    rows = spark.createDataFrame(rows, "k int, data binary")
    first = rows.where(F.col("data") == F.lit(letter.encode("cp850"))).select(charsets.detected(spark, model, F.col("data"), names).alias("best"))
    assert first.where("best.charset = 'mac_roman' and best.close").count() == 2
    want = [(1, "cp850"), (1, "cp850"), (1, "mac_roman"), (2, "mac_roman"), (3, None), (4, "utf-8"), (5, "utf-8")]
    assert sorted(map(tuple, charsets.distinguished(rows, texts, model, names).collect())) == want
    assert [r["charset"] for r in charsets.distinguished(rows.where("k = 5"), texts, model, names).collect()] == ["utf-8"]


def _points(n=400, size=5):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, size)) * [1, 10, 0.1, 1, 3]
    return x, (x @ [1, -0.3, 2, 0, 0.5] + rng.normal(size=n) > 0.4).astype(int)


def _solved(x, y, cost):
    """The same minimum by plain Newton steps on dense matrices."""
    x, s = np.hstack((x, np.ones((len(x), 1)))), np.where(y > 0, 1.0, -1.0)
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(s * (x @ w)))
        w = w - np.linalg.solve(np.eye(len(w)) + cost * (x.T * (p * (1 - p))) @ x, w - cost * x.T @ (s * p))
    return w


@pytest.mark.parametrize("cost", [0.1, 20.0])
def test_newton_against_dense_matrices(spark, cost):
    x, y = _points()
    rows = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], "x array<double>, y int").repartition(3)
    got = training.newton(rows, cost=cost, exact=1e-11)
    assert np.abs(got.weights - _solved(x, y, cost)).max() < 1e-8
    assert got.losses == sorted(got.losses, reverse=True)


def test_newton_odd_rows(spark):
    x, y = _points(60)
    own = [(a.tolist(), int(b), 1) for a, b in zip(x, y)]
    odd = [(None, 1, 1), ([1.0, None, 1.0, 1.0, 1.0], 0, 1), ([1.0] * 5, None, 1)]
    schema = "x array<double>, y int, at int"
    one, two = (training.newton(spark.createDataFrame(rows, schema)).weights for rows in (own, own + odd))
    assert np.abs(one - two).max() < 1e-8
    assert len(training.newton(spark.createDataFrame([], schema)).weights) == 0
    for bad in ([1.0], [float("nan")] * 5, [float("inf")] * 5):
        with pytest.raises(ValueError):
            training.newton(spark.createDataFrame([*own, (bad, 1, 1)], schema))
