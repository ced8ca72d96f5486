"""Line dedup by site-relative frequency: a line that stands on too large a share of a site's pages
is boilerplate and goes. DataFrame functions only.

Defined results
---------------
* Lines are what ``\\n`` separates. Only lines with a word are judged; blank lines stay.
* Pages of one site with the same text count as one page, in a line's count and in the site's
  total, so a large group of exact copies is not taken for boilerplate.
* A line goes if it is on at least ``min_pages`` pages and on more than ``ratio`` of its site's.
* The default ratio is for a column of hosts. A source mixes hosts, which thins the share of each one's
  lines, so where a source stands for the host the ratio is ``RATIO``.
* A null text stays null and counts as no page; a null site is a site of its own. An empty table
  gives an empty table. Repeated rows are judged alike.
* The other columns are passed on untouched, whatever their names.

At scale
--------
The texts are not shuffled: (site, line, page) digests are made distinct and counted with partial
aggregation, so a hot site or line meets no single task. A site has at most (lines a page / ratio)
boilerplate lines; their table is broadcast below ``BROADCAST_BYTES`` and joined by a shuffle above.
Lines and pages are told apart by 128-bit digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.text import WORD, fresh
from textloom.plans.lineage import checked_broadcast

#: Production parameters: share of a source's pages, fewest pages; share where the site is a host.
RATIO, MIN_PAGES, HOST_RATIO = 0.02, 5, 0.1


def boilerplate(docs: DataFrame, text_col: str = "text", site_col: str = "source", ratio: float = HOST_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """For each site that has any: ``(site, lines)``, the MD5 digests of its boilerplate lines."""
    text = F.col(f"`{text_col}`")
    pages = docs.where(text.isNotNull()).select(
        F.col(f"`{site_col}`").alias("site"),
        F.md5(text.cast("binary")).alias("page"),
        F.array_distinct(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))).alias("lines"),
    )
    totals = pages.select("site", "page").distinct().groupBy("site").agg(F.count("*").alias("pages"))
    on = pages.select("site", "page", F.explode("lines").alias("line")).select("site", "page", F.md5(F.col("line").cast("binary")).alias("line"))
    counted = on.distinct().groupBy("site", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    common = counted.alias("c").join(totals.alias("t"), F.col("c.site").eqNullSafe(F.col("t.site"))).where(F.col("n") > ratio * F.col("pages"))
    return common.groupBy(F.col("c.site").alias("site")).agg(F.sort_array(F.collect_set("line")).alias("lines"))


def without_boilerplate(docs: DataFrame, text_col: str = "text", site_col: str = "source", ratio: float = HOST_RATIO, min_pages: int = MIN_PAGES, counts: bool = False) -> DataFrame:
    """``docs`` with the boilerplate lines taken out of the text.

    ``counts`` adds ``n_lines`` and ``n_dropped`` (longs; 0 for null) at the end, under names made
    longer by underscores where the input has them.
    """
    site, lines = fresh(docs.columns, "bp_site"), fresh(docs.columns, "bp_lines")
    split, kept = fresh(docs.columns, "bp_split"), fresh(docs.columns, "bp_kept")
    bad = checked_broadcast(boilerplate(docs, text_col, site_col, ratio, min_pages)).select(F.col("site").alias(site), F.col("lines").alias(lines))
    text = F.col(f"`{text_col}`")
    cut = (
        docs.join(bad, F.col(f"`{site_col}`").eqNullSafe(F.col(site)), "left")
        .withColumn(split, F.split(text, "\n", -1))
        .withColumn(kept, F.when(F.col(lines).isNull(), F.col(split)).otherwise(F.filter(split, lambda x: ~(x.rlike(WORD) & F.array_contains(F.col(lines), F.md5(x.cast("binary")))))))
    )
    out = [F.array_join(kept, "\n").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        n_lines = F.coalesce(F.size(F.filter(split, lambda x: x.rlike(WORD))), F.lit(0)).cast("long")
        n_dropped = F.coalesce(F.size(split) - F.size(kept), F.lit(0)).cast("long")
        out += [n_lines.alias(fresh(docs.columns, "n_lines")), n_dropped.alias(fresh(docs.columns, "n_dropped"))]
    return cut.select(*out)
