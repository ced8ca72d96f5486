"""CON-5: tolerant HTML as rows in order, with the path of every text and link.

Rules for tags that do not fit together
---------------------------------------
* Comments, declarations and the contents of ``script`` and ``style`` hold no tags and give no text.
* A start and an end of one name belong together as parentheses of that name. An end without a start is
  ignored; a start without an end, and a void element such as ``br``, contains nothing.
* Of elements that cross each other, as in ``<b><i></b></i>``, neither contains anything.
* A ``<`` that begins no tag is text. Null and empty pages have no rows. Ids tell the pages apart.

At scale: one shuffle by id carries the tokens, in as many tasks as the pages have ``TASK_BYTES``, so that a task takes as much whatever
the input; every window is inside a page, whose tokens came from one cell. Only elements, and the rows that are asked for, get paths.
These are made by doubling along the elements' parents, in as many rounds as the depth has binary digits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.plans.lineage import checkpointed

#: Elements that never have an end. Fixed values.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")

#: Bytes of pages that a task takes, about.
TASK_BYTES = 4 << 20

_TOKEN = "|".join((
    r"<!--[\s\S]*?(?:-->|\z)",
    r"<(?i:script)\b[^>]*>[\s\S]*?(?:</(?i:script)[^>]*>|\z)",
    r"<(?i:style)\b[^>]*>[\s\S]*?(?:</(?i:style)[^>]*>|\z)",
    r"""</?[A-Za-z](?:[^>"']+|"[^"]*"|'[^']*')*>""",
    r"<[!?][^>]*>",
    r"[^<]+|<",
))

#: References to characters, the ampersand last. Fixed values.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def tokens(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(id, at, kind, name, token)`` in the order of the page; kind is start, end, void or text."""
    found = F.regexp_extract_all(F.col(f"`{html_col}`"), F.lit(_TOKEN), 0)
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.posexplode(found).alias("at", "token"))
    token = F.col("token")
    name = F.lower(F.regexp_extract(token, "^</?([A-Za-z][A-Za-z0-9:-]*)", 1))
    skipped = token.startswith("<!") | token.startswith("<?") | name.isin("script", "style")
    tag = (name != "") & token.endswith(">")
    kind = F.when(~tag, "text").when(token.startswith("</"), "end").when(name.isin(*VOID) | token.endswith("/>"), "void").otherwise("start")
    return rows.where(~skipped).select("id", "at", kind.alias("kind"), F.when(tag, name).alias("name"), "token")


def _running(way: Column, *keys: str) -> Column:
    return F.sum(way).over(Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))


def _paired(df: DataFrame, level: str, *keys: str) -> Column:
    """Whether a start is followed, or an end preceded, by its counterpart on its level and of its name."""
    w = Window.partitionBy(*keys, level).orderBy("at")
    kind, name = F.col("kind"), F.col("name")
    after = (F.lead("kind").over(w) == "end") & (F.lead("name").over(w) == name)
    before = (F.lag("kind").over(w) == "start") & (F.lag("name").over(w) == name)
    return F.coalesce(F.when(kind == "start", after).when(kind == "end", before), F.lit(False))


def tasks_of(pages: DataFrame, html_col: str = "html") -> int:
    """In how many tasks the tokens go: one for ``TASK_BYTES`` of the pages, and not fewer than the session's."""
    size = pages.agg(F.sum(F.octet_length(F.col(f"`{html_col}`")).cast("long")).alias("n")).first()["n"] or 0
    return max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / TASK_BYTES))


def placed(found: DataFrame, tasks: int) -> DataFrame:
    """``tokens`` with ``level``, the number of elements around each, and ``parent``, the place of the
    innermost one (null outside all); ``opens`` marks the starts of elements that contain something."""
    kind = F.col("kind")
    way = F.when(kind == "start", 1).when(kind == "end", -1).otherwise(0)
    rows = found.repartition(tasks, "id").withColumn("way", way)
    # Parentheses of each name; an end below all before it has no start.
    rows = rows.withColumn("sum", _running(F.col("way"), "id", "name"))
    least = F.least(F.lit(0), F.min("sum").over(Window.partitionBy("id", "name").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    before = F.least(F.lit(0), F.coalesce(F.min("sum").over(Window.partitionBy("id", "name").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("stray", (kind == "end") & (F.col("sum") < before))
    rows = rows.withColumn("own", F.when(kind.isin("start", "end") & ~F.col("stray"), F.col("sum") - least + F.when(kind == "end", 1).otherwise(0)))
    rows = rows.withColumn("fits", _paired(rows, "own", "id", "name") & F.col("own").isNotNull())
    # Parentheses of all names; those of two names cross.
    rows = rows.withColumn("sum", _running(F.when(F.col("fits"), F.col("way")).otherwise(0), "id"))
    rows = rows.withColumn("own", F.when(F.col("fits"), F.col("sum") + F.when(kind == "end", 1).otherwise(0)))
    rows = rows.withColumn("fits", F.col("fits") & _paired(rows, "own", "id"))
    inside = _running(F.when(F.col("fits"), F.col("way")).otherwise(0), "id")
    rows = rows.withColumn("opens", F.col("fits") & (kind == "start")).withColumn("level", inside - F.when(F.col("opens"), 1).otherwise(0))
    # A row of level n lies in the last element that opened on level n - 1: both are keyed by n.
    rows = rows.withColumn("own", F.explode(F.when(F.col("opens"), F.array(F.col("level"), F.col("level") + 1)).otherwise(F.array("level"))))
    opened = F.when(F.col("opens") & (F.col("own") == F.col("level") + 1), F.col("at"))
    last = F.last(opened, ignorenulls=True).over(Window.partitionBy("id", "own").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("parent", F.when(F.col("level") > 0, last)).where(F.col("own") == F.col("level"))
    return rows.select("id", "at", "kind", "name", "token", "level", "opens", "parent")


def with_paths(rows: DataFrame, wanted: Column, tasks: int) -> DataFrame:
    """The ``wanted`` of the ``placed`` rows with ``path``: the names of the elements around them, from the root; "" outside all."""
    rows = rows.withColumn("wanted", wanted).where("wanted or opens")
    rows = checkpointed(rows.select("id", "at", "name", "opens", "parent", "wanted", F.when(F.col("wanted"), F.col("token")).alias("token")))
    made = rows.where("opens").select("id", "at", "name", F.col("parent").alias("up"), F.col("name").alias("path"))
    while True:
        above = made.select("id", F.col("at").alias("up"), F.col("up").alias("next"), F.col("path").alias("front"))
        joined = made.repartition(tasks, "id", "up").join(above.repartition(tasks, "id", "up"), ["id", "up"], "left")
        made = checkpointed(joined.select("id", "at", "name", F.col("next").alias("up"), F.concat_ws("/", "front", "path").alias("path")))
        if made.where("up is not null").isEmpty():
            break
    paths = made.select("id", F.col("at").alias("parent"), "path").repartition(tasks, "id", "parent")
    found = rows.where("wanted").repartition(tasks, "id", "parent").join(paths, ["id", "parent"], "left")
    return found.withColumn("path", F.coalesce("path", F.lit("")))


def plain(text: Column) -> Column:
    """Text with the named references replaced, blanks trimmed and runs of blanks made one space."""
    for mark, sign in ENTITIES:
        text = F.replace(text, F.lit(mark), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f]+", " "))


def texts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(id, at, path, text)`` of every text that is not blank."""
    tasks = tasks_of(pages, html_col)
    rows = with_paths(placed(tokens(pages, id_col, html_col), tasks), F.col("kind") == "text", tasks)
    return rows.select(F.col("id").alias(id_col), "at", "path", plain(F.col("token")).alias("text")).where("text <> ''")


def links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(id, at, path, href)`` of every ``a`` that has an ``href``, in any quotes or none."""
    found = F.col("token").rlike(r"(?i)\shref\s*=")
    href = F.coalesce(*(F.nullif(F.regexp_extract("token", rf"(?i)\shref\s*=\s*{p}", 1), F.lit("")) for p in ('"([^"]*)"', "'([^']*)'", r"""([^\s"'>]+)""")), F.lit(""))
    wanted = F.coalesce((F.col("name") == "a") & F.col("kind").isin("start", "void") & found, F.lit(False))
    tasks = tasks_of(pages, html_col)
    rows = with_paths(placed(tokens(pages, id_col, html_col), tasks), wanted, tasks)
    return rows.select(F.col("id").alias(id_col), "at", "path", href.alias("href"))
