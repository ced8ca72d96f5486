"""Quality rules: base rules, then robust multivariate outliers by minimum covariance determinant.

Every document's counts become a vector of three transformed statistics: how far its log word length, log rate of
punctuation and symbols, and log rate of capitals lie from their medians in its language, times the square root of its
words, since chance alone spreads the rates of a text of n words by 1/sqrt(n). (Beyond ``WORDS`` words the factor stops growing:
there texts differ by more than chance.) Punctuation and capitals rise together, so that a text may be an outlier by their
relation with each of them in its usual range. For each language and source the half of its documents whose covariance has the least determinant is looked for: from each of several fixed
starts, concentration steps take the half that is closest under the present estimate and estimate again,
until no determinant falls any more; the start that ends lowest gives the estimate. It is reweighted once,
and a document whose squared Mahalanobis distance passes the cutoff is rejected. DataFrame functions only.

Defined results
---------------
* Null text: no words, so the base rules fail. A text of fewer than ten words fails too.
* Language or source null: a group like any other.
* A group needs ``MIN_GROUP`` documents that pass the base rules for an estimate of its own. A smaller one is
  judged by the estimate of its whole language, and if that has too few as well, by that of all documents.
* Documents of a group with the same vector count once in its estimate, or a large group of copies would be the core.
* A group whose vectors do not spread in some direction is a singular one: its covariance there is ``FLOOR``, the unit of rounding,
  so that only what differs by more than some units is rejected.
* The half is counted in 256ths of the Mahalanobis distance: documents of equal rounded distance are
  in it or out of it together, so it may be larger by those at its edge.
* Statistics are rounded to hundredths before anything is summed, so sums are exact integers and the
  result does not depend on partitions. Repeated rows and ids are judged one by one.
* Texts of any length are taken whole. Repeated 5-word windows are told apart by 64-bit hashes within one text.
* An empty table gives an empty table. Other columns are not read; ``passing`` passes them on, whatever
  their names.

At scale
--------
One pass over the texts; what follows reads the distinct vectors of each group. A concentration step is one pass over
them: counts and sums for each bin of distance, combined before the shuffle, and running sums over the bins. So no group meets one task. Estimates, a row for each group and
start, are broadcast only where they were measured to stay below ``BROADCAST_BYTES``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.text import WORD, words
from textloom.plans.lineage import BROADCAST_BYTES, checked_broadcast, checkpointed

#: Production parameters. Variance added to each statistic's own, in squared hundredths (below 0.1 % of what documents have);
#: words beyond which the spread of rates no longer falls; fewest documents of an estimate (ten for each
#: statistic); share of the documents in the core; cutoff (chi-squared, 3 degrees, 0.999999).
FLOOR, WORDS, MIN_GROUP, CORE, CUTOFF = 1, 1000, 30, 0.5, 30.665
#: Chi-squared constants for 3 degrees of freedom: 0.975 quantile, and factors that make the
#: covariance of the closest half, and of the closest 0.975, consistent for normal data.
Q975, HALF_FACTOR, REWEIGHT_FACTOR = 9.348, 2.457, 1.078
#: Parts of a unit of distance; quantiles that are the centre of a start, with squared quartile ranges as its
#: variances, besides the start from all documents' moments; share by which a determinant has to fall.
BINS, STARTS, FALL = 256, (0.5, 0.25, 0.75), 1e-3
#: Vectors of one task of a step, so that few vectors make no small tasks and files.
VECTORS_AT_ONCE = 400_000
SYMBOLS = "#*$%&|<>"
SIGNS, CAPITALS = ".,;:!?" + SYMBOLS, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIMS = (0, 1, 2)
PAIRS = tuple((i, j) for i in DIMS for j in DIMS if i <= j)


def counted(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_signs, n_capitals (longs) in
    place of the column ``text``."""
    keep = [c for c in docs.columns if c != "text"]
    text = F.coalesce(F.col("text"), F.lit(""))
    first = docs.select(*keep, text.alias("text"), words(F.col("text")).alias("w"))
    n, lines = F.size("w"), F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    windows = F.transform("w", lambda x, i: F.xxhash64(x, *(F.get(F.col("w"), i + k) for k in range(1, 5))))
    second = first.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        *((F.length("text") - F.length(F.translate("text", x, ""))).cast("long").alias(n) for n, x in (("n_symbols", SYMBOLS), ("n_signs", SIGNS), ("n_capitals", CAPITALS))),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(n >= 5, F.slice(windows, F.lit(1), F.greatest(n - 4, F.lit(0)))).otherwise(F.array().cast("array<bigint>")).alias("seen"),
    )
    counts = [c for c in second.columns if c != "seen"]
    # Windows sorted by hash, then place: those with an equal neighbour are found twice or more.
    placed = F.sort_array(F.transform("seen", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    third = second.select(*counts, F.when(F.size(F.array_distinct("seen")) < F.size("seen"), placed).alias("again"))

    def same(x: Column, i: Column) -> Column:
        return F.coalesce(F.get(F.col("again"), i)["h"] == x["h"], F.lit(False))

    twice = F.filter("again", lambda x, i: same(x, i + 1) | F.when(i > 0, same(x, i - 1)).otherwise(False))
    fourth = third.select(*counts, F.sort_array(F.transform(twice, lambda x: x["i"])).alias("at"))
    reach = F.transform("at", lambda x, i: F.least(F.lit(5), F.coalesce(F.get(F.col("at"), i + 1) - x, F.lit(5))))
    covered = F.aggregate(reach, F.lit(0).cast("long"), lambda total, x: total + x)
    return fourth.select(*counts, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def rates(n_words: Column, word_chars: Column, n_signs: Column, n_capitals: Column) -> list[Column]:
    """Log word length, log rate of signs and log rate of capitals, in thousandths (longs)."""
    n, c = F.greatest(n_words, F.lit(1)), F.greatest(word_chars, F.lit(1))
    raw = (F.log(c / n), F.log(1 + 100 * n_signs / c), F.log(1 + 100 * n_capitals / c))
    return [F.round(1000 * x, 0).cast("long") for x in raw]


def transformed(table: DataFrame) -> DataFrame:
    """``table`` with x0, x1, x2 in place of the rates f0, f1, f2: their distance from the median of the language's documents
    that pass the base rules, times the root of the words, in hundredths (longs)."""
    middle = [F.expr(f"percentile_disc(0.5) within group (order by f{i})").cast("long").alias(f"c{i}") for i in DIMS]
    centres = checked_broadcast(table.where(~F.col("base_failed")).groupBy(F.col("lang").alias("c_lang")).agg(*middle))
    n = F.col("n_words").cast("double")
    factor = F.sqrt(n * WORDS / (n + WORDS))
    x = [F.round((F.col(f"f{i}") - F.col(f"c{i}")) * factor / 10, 0).cast("long").alias(f"x{i}") for i in DIMS]
    kept = [c for c in table.columns if c not in {f"f{i}" for i in DIMS}]
    return table.join(centres, F.col("lang").eqNullSafe(F.col("c_lang")), "left").select(*kept, *x)


def quadratic(d: list[Column], a: dict[tuple[int, int], Column]) -> Column:
    """d' A d for a symmetric A given by its upper triangle."""
    terms = [d[i] * d[j] * a[i, j] * (1.0 if i == j else 2.0) for i, j in PAIRS]
    return reduce(lambda x, y: x + y, terms)


def moments() -> list[Column]:
    """Exact integer sums over rows of x0, x1, x2."""
    return [F.count("*").alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in DIMS), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in PAIRS)]


def estimates(sums: DataFrame, factor: float, *keys: str) -> DataFrame:
    """From moments: centre, inverse covariance and the log of its determinant."""
    n = F.col("n").cast("double")
    mean = sums.select(*keys, n.alias("n"), *(F.col(f"s{i}{j}").cast("double").alias(f"s{i}{j}") for i, j in PAIRS), *((F.col(f"s{i}") / n).alias(f"m{i}") for i in DIMS))

    def cov(i: int, j: int) -> Column:
        spread = (F.col(f"s{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * F.lit(factor)
        return spread + F.lit(float(FLOOR)) if i == j else spread

    with_cov = mean.select(*keys, *(f"m{i}" for i in DIMS), *(cov(i, j).alias(f"c{i}{j}") for i, j in PAIRS))
    c = {(i, j): F.col(f"c{min(i, j)}{max(i, j)}") for i in DIMS for j in DIMS}

    def minor(i: int, j: int) -> Column:
        (r0, r1), (k0, k1) = [x for x in DIMS if x != i], [x for x in DIMS if x != j]
        return (c[r0, k0] * c[r1, k1] - c[r0, k1] * c[r1, k0]) * F.lit(-1.0 if (i + j) % 2 else 1.0)

    det = with_cov.select("*", *(minor(i, j).alias(f"k{i}{j}") for i, j in PAIRS)).withColumn("det", c[0, 0] * F.col("k00") + c[0, 1] * F.col("k01") + c[0, 2] * F.col("k02"))
    return det.select(*keys, *(f"m{i}" for i in DIMS), *((F.col(f"k{i}{j}") / F.col("det")).alias(f"a{i}{j}") for i, j in PAIRS), "det")


def distances(rows: DataFrame, model: DataFrame, small: bool) -> DataFrame:
    """``rows`` with d2, the squared Mahalanobis distance, under each model of their group."""
    d = [F.col(f"x{i}").cast("double") - F.col(f"m{i}") for i in DIMS]
    d2 = quadratic(d, {p: F.col(f"a{p[0]}{p[1]}") for p in PAIRS})
    kept = [c for c in model.columns if c in ("g", "start")]
    return rows.join(F.broadcast(model) if small else model, "g").select(*kept, *(f"x{i}" for i in DIMS), d2.alias("d2"))


def concentrated(rows: DataFrame, model: DataFrame, small: bool) -> DataFrame:
    """The estimates from the closest half under each group's and start's model."""
    bin_ = F.floor(F.sqrt(F.greatest(F.col("d2"), F.lit(0.0))) * BINS)
    bins = distances(rows, model, small).groupBy("g", "start", bin_.alias("bin")).agg(*moments())
    sums = [c for c in bins.columns if c not in ("g", "start", "bin")]
    part = Window.partitionBy("g", "start")
    upto = bins.select("g", "start", "bin", F.sum("n").over(part).alias("every"), *(F.sum(c).over(part.orderBy("bin")).alias(c) for c in sums))
    edge = upto.where(F.col("n") >= F.ceil(CORE * F.col("every"))).groupBy("g", "start").agg(F.min_by(F.struct(*sums), "bin").alias("core"))
    return estimates(edge.select("g", "start", "core.*"), HALF_FACTOR, "g", "start")


def starts(rows: DataFrame) -> DataFrame:
    """The first models of each group: (lower) quantiles with squared quartile ranges as variances, and all moments."""
    long = rows.select("g", F.posexplode(F.array(*(f"x{i}" for i in DIMS))).alias("dim", "x")).groupBy("g", "dim", "x").agg(F.count("*").alias("n"))
    part = Window.partitionBy("g", "dim")
    running = long.withColumn("upto", F.sum("n").over(part.orderBy("x"))).withColumn("all", F.sum("n").over(part))
    at = running.groupBy("g", "dim").agg(*(F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("x"))).cast("double").alias(f"q{k}") for k, q in enumerate(STARTS)))
    wide = at.groupBy("g").agg(F.array(*(F.struct(F.lit(k).alias("start"), *(F.max(F.when(F.col("dim") == i, F.col(f"q{k}"))).alias(f"m{i}") for i in DIMS)) for k in range(len(STARTS)))).alias("of"))
    low, high = (STARTS.index(q) for q in (0.25, 0.75))
    wide = wide.select("*", *(F.greatest(F.get("of", high)[f"m{i}"] - F.get("of", low)[f"m{i}"], F.lit(1.0)).alias(f"r{i}") for i in DIMS))
    width = [(1.0 / (F.col(f"r{i}") * F.col(f"r{i}")) if i == j else F.lit(0.0)).alias(f"a{i}{j}") for i, j in PAIRS]
    centres = wide.select("g", F.explode("of").alias("of"), *(f"r{i}" for i in DIMS)).select("g", "of.*", *width)
    every = estimates(rows.groupBy("g").agg(*moments()), 1.0, "g").withColumn("start", F.lit(len(STARTS)))
    return centres.union(every.select(*centres.columns))


def least_determinant(rows: DataFrame, small: bool) -> DataFrame:
    """Of each group the estimate with the least determinant that any start converges to."""

    def kept(model: DataFrame) -> DataFrame:
        return checkpointed(model.coalesce(1) if small else model)

    model = kept(concentrated(rows, starts(rows), small).withColumn("falls", F.lit(True)))
    columns = [c for c in model.columns if c not in ("g", "start", "falls")]
    while not (left := model.where("falls")).isEmpty():
        # Only models whose determinant fell in the last step take another.
        new = concentrated(rows, left.drop("falls"), small).select("g", "start", F.struct(*columns).alias("new"))
        falls = F.coalesce(F.col("new.det") < F.col("det") * (1 - FALL), F.lit(False))
        both = model.join(F.broadcast(new) if small else new, ["g", "start"], "left")
        model = kept(both.select("g", "start", *(F.when(falls, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in columns), falls.alias("falls")))
    best = F.min_by(F.struct(*columns), F.struct("det", "start")).alias("best")
    return model.groupBy("g").agg(best).select("g", "best.*")


def grouping(rows: DataFrame) -> DataFrame:
    """Of each ``(k_lang, k_source)`` the group ``g`` that judges it, and those that its documents
    are ``members`` of: its own if it is large enough, its language's and that of all where these judge any."""
    sizes = rows.groupBy(F.col("lang").alias("k_lang"), F.col("source").alias("k_source")).agg(F.count("*").alias("n"))
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(x)), F.lit("")) for x in ("k_lang", "k_source"))
    named = sizes.select("*", F.concat(lang, F.lit("\x01"), source).alias("own"), F.concat(lang, F.lit("\x02")).alias("wide"), F.lit("\x03").alias("every"))
    by_lang = named.groupBy("wide").agg(F.sum("n").alias("in_lang"), F.min("n").alias("least")).select("wide", F.col("in_lang") >= MIN_GROUP, F.col("least") < MIN_GROUP).toDF("wide", "lang_fits", "lang_used")
    large, fits = F.col("n") >= MIN_GROUP, F.col("lang_fits")
    g = F.when(large, F.col("own")).when(fits, F.col("wide")).otherwise(F.col("every"))
    out = named.join(by_lang, "wide").withColumn("g", g)
    any_rest = F.lit(not out.where(F.col("g") == F.col("every")).isEmpty())
    feeds = F.array_compact(F.array(F.when(large, F.col("own")), F.when(fits & F.col("lang_used"), F.col("wide")), F.when(any_rest, F.col("every"))))
    return out.select("k_lang", "k_source", "n", "g", feeds.alias("members"))


def same_group() -> Column:
    return F.col("lang").eqNullSafe(F.col("k_lang")) & F.col("source").eqNullSafe(F.col("k_source"))


def prepared(docs: DataFrame) -> DataFrame:
    """Counts, ``base_failed`` and x0, x1, x2 in place of the text; the texts are read once."""
    table = counted(docs).withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    f = rates(*(F.col(c) for c in ("n_words", "word_chars", "n_signs", "n_capitals")))
    return transformed(checkpointed(table.select("*", *(c.alias(f"f{i}") for i, c in zip(DIMS, f)))))


def fitted(table: DataFrame) -> DataFrame:
    """The robust centre and inverse covariance that hold for each ``(k_lang, k_source)``."""
    passed = table.where(~F.col("base_failed")).select("lang", "source", *(f"x{i}" for i in DIMS))
    groups = checkpointed(grouping(passed))
    # Models take some 200 bytes for each group and start.
    measured = groups.agg(F.sum(F.octet_length("g") + 200).alias("size"), F.sum(F.col("n") * F.size("members")).alias("vectors")).first()
    size, parts = measured["size"] or 0, 1 + (measured["vectors"] or 0) // VECTORS_AT_ONCE
    small = size * (len(STARTS) + 1) <= BROADCAST_BYTES
    groups = F.broadcast(groups) if small else groups
    rows = checkpointed(passed.join(groups, same_group()).select(F.explode("members").alias("g"), *(f"x{i}" for i in DIMS)).distinct().coalesce(parts))
    near = distances(rows, least_determinant(rows, small), small).where(F.col("d2") <= Q975)
    model = estimates(near.groupBy("g").agg(*moments()), REWEIGHT_FACTOR, "g").drop("det")
    out = checkpointed(groups.drop("members", "n").join(model, "g").drop("g"))
    return F.broadcast(out) if small else out


def scored(table: DataFrame, model: DataFrame) -> DataFrame:
    """``table`` with ``distance`` (squared Mahalanobis; null where none is estimated) and ``kept``."""
    d = [F.col(f"x{i}").cast("double") - F.col(f"m{i}") for i in DIMS]
    d2 = quadratic(d, {p: F.col(f"a{p[0]}{p[1]}") for p in PAIRS})
    distance = F.when(~F.col("base_failed"), d2).alias("distance")
    out = table.join(model, same_group(), "left").select(*table.columns, distance)
    # One condition over both sides of the join: a filter on a part of it would be pushed below the
    # counts, and count every text again for each use of them.
    return out.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(F.col("distance"), F.lit(0.0)) <= CUTOFF))


def own_columns(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> list[Column]:
    pairs = ((id_col, "id"), (lang_col, "lang"), (source_col, "source"), (text_col, "text"))
    return [F.col(f"`{c}`").alias(a) for c, a in pairs]


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Each document's id, counts, ``base_failed``, ``distance`` and ``kept``."""
    table = prepared(docs.select(*own_columns(docs, id_col, text_col, lang_col, source_col)))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept"]
    return scored(table, fitted(table)).select(F.col("id").alias(id_col), *names)


def passing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents that are kept, with the columns of the input. The texts are counted once and kept with
    their counts in a checkpoint, so that the verdict needs no second pass over them and no shuffle."""
    own = own_columns(docs, id_col, text_col, lang_col, source_col)
    whole = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("whole")
    table = prepared(docs.select(*own, whole))
    columns = [F.col(f"whole.c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return scored(table, fitted(table)).where("kept").select(*columns)
