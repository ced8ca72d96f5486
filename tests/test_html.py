"""Tolerant HTML against a reading of the same rules in plain Python."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from textloom.operators import html

SCHEMA = "page_id long, html string, id string"


def found(spark, pages, what=html.texts):
    rows = spark.createDataFrame([(i, p, "x") for i, p in enumerate(pages)], SCHEMA)
    return sorted(tuple(r) for r in what(rows).collect())


def matched(tags):
    """Pairs of a start and an end of one name, as parentheses."""
    pairs, open_ = [], {}
    for at, kind, name in tags:
        if kind == "start":
            open_.setdefault(name, []).append(at)
        elif open_.get(name):
            pairs.append((open_[name].pop(), at, name))
    return pairs


def plain(page):
    """``(at, path, text)`` of a page of simple tags and texts."""
    pieces = re.findall(r"<[^>]*>|[^<]+", page)
    tags = [(i, "end" if p[1] == "/" else "start", p.strip("</>")) for i, p in enumerate(pieces) if p[0] == "<" and p != "<br>"]
    pairs = matched(tags)
    stack, inner = [], []
    for at, way, name in sorted([(a, 1, n) for a, _, n in pairs] + [(b, -1, n) for _, b, n in pairs]):
        if way == 1:
            stack.append((at, name))
        else:
            start, other = stack.pop()
            if other == name:
                inner.append((start, at, name))
    return [(i, "/".join(n for a, b, n in sorted(inner) if a < i < b), p.strip()) for i, p in enumerate(pieces) if p[0] != "<" and p.strip()]


def test_paths_and_texts(spark):
    page = "<!DOCTYPE html><HTML><body class='a>b'><script>if (a<b) '</p>'</script><p>one<br>two &lt;b&gt; &amp;lt;</p><!-- <i>no</i> --><b>three</body></html> end"
    assert [x[2:] for x in found(spark, [page])] == [("html/body/p", "one"), ("html/body/p", "two <b> &lt;"), ("html/body", "three"), ("", "end")]


def test_tags_that_do_not_fit(spark):
    pages = ["</b>a<b>c", "<b>1<i>2</b>3</i>4", "<p>x<p>y</p>z", "a < b <", "", None, "   ", "<div>\n</div>"]
    assert found(spark, pages) == [
        (0, 1, "", "a"), (0, 3, "", "c"), (1, 1, "", "1"), (1, 3, "", "2"), (1, 5, "", "3"), (1, 7, "", "4"),
        (2, 1, "", "x"), (2, 3, "p", "y"), (2, 5, "", "z"), (3, 0, "", "a"), (3, 1, "", "<"), (3, 2, "", "b"), (3, 3, "", "<"),
    ]


def test_links(spark):
    pages = ['<nav><a href="/x">1</a><a HREF=\'y z\'>2</a><a class=q href=/w>3</a><a name="n">4</a><a href="">5</a></nav>']
    assert [x[2:] for x in found(spark, pages, html.links)] == [("nav", "/x"), ("nav", "y z"), ("nav", "/w"), ("nav", "")]


def test_deep_and_long_pages(spark):
    deep = "<i>" * 300 + "x" + "</i>" * 300
    assert found(spark, [deep, "<p>" + "y" * 200_000]) == [(0, 300, "/".join(["i"] * 300), "x"), (1, 1, "", "y" * 200_000)]


def test_tasks_grow_with_the_pages(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "<p>" + "x" * 400 + "</p>") for i in range(50)], "page_id long, html string")
    monkeypatch.setattr(html, "TASK_BYTES", 1000)
    tasks = html.tasks_of(pages)
    assert tasks == 21 and html.tasks_of(pages.limit(0)) == 3
    assert html.placed(html.tokens(pages), tasks).rdd.getNumPartitions() == tasks
    assert sorted(tuple(r) for r in html.texts(pages).collect()) == [(i, 1, "p", "x" * 400) for i in range(50)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert html.texts(empty).collect() == [] and html.links(empty).collect() == []


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["<a>", "</a>", "<b>", "</b>", "<c>", "</c>", "<br>", "t ", "u "]), max_size=30).map("".join), min_size=200, max_size=200))
def test_any_order_of_tags(spark, pages):
    assert found(spark, pages) == [(i, *row) for i, p in enumerate(pages) for row in plain(p)]
