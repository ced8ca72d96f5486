"""URL parts, predicates, registrable domains and URL encoding, as expressions.

URLs are taken apart by one pattern rather than by ``java.net.URI``, so that hosts with empty labels
or odd characters still have parts. A missing part is null; a text without a scheme has no parts.
"""

from __future__ import annotations

import re

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.text import ascii_lower

#: scheme, user information, host, port, path, query, fragment.
PATTERN = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://(?:([^/?#]*)@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"
#: Schemes whose URLs have a host, and their default ports. Fixed values.
STANDARD = {"http": "80", "https": "443", "ftp": "21", "file": "", "gopher": "70", "ws": "80", "wss": "443"}


def _part(url: Column, k: int) -> Column:
    found = F.regexp_extract(url, PATTERN, k)
    return F.when(found != "", found)


def scheme(url: Column) -> Column:
    """URL-7 (T)."""
    return ascii_lower(_part(url, 1))


def username(url: Column) -> Column:
    """URL-8 (H)."""
    name = F.substring_index(_part(url, 2), ":", 1)
    return F.when(name != "", name)


def password(url: Column) -> Column:
    """URL-8 (H): what follows the first colon of the user information."""
    word = F.regexp_extract(_part(url, 2), "^[^:]*:(.*)$", 1)
    return F.when(word != "", word)


def host(url: Column) -> Column:
    """URL-9 (H; empty labels by a golden test of domains)."""
    return ascii_lower(_part(url, 3))


def port(url: Column) -> Column:
    """URL-10 (H): as text, if the URL names one."""
    return _part(url, 4)


def path(url: Column) -> Column:
    """URL-11 (H)."""
    return _part(url, 5)


def query(url: Column) -> Column:
    """URL-12 (H)."""
    return _part(url, 6)


def ref(url: Column) -> Column:
    """URL-13 (H)."""
    return _part(url, 7)


def request(url: Column) -> Column:
    """URL-14 (H): path and query."""
    asked = F.concat(F.coalesce(path(url), F.lit("/")), F.coalesce(F.concat(F.lit("?"), query(url)), F.lit("")))
    return F.when(is_valid(url), asked)


def parts(url: Column) -> Column:
    """URL-21 (H): all parts as a struct."""
    made = {"scheme": scheme, "user": username, "password": password, "host": host, "port": port, "path": path, "query": query, "ref": ref}
    return F.struct(*(f(url).alias(name) for name, f in made.items()))


def is_valid(url: Column) -> Column:
    """URL-1 (H; X): it has a scheme, and a host unless it is a file's."""
    return F.coalesce(scheme(url).isNotNull() & (host(url).isNotNull() | (scheme(url) == "file")), F.lit(False))


def canonical(url: Column) -> Column:
    """URL-2 (H; X): scheme and host in lower case, no default port, a path of at least a slash."""
    default = F.element_at(F.create_map(*(F.lit(x) for kv in STANDARD.items() for x in kv)), scheme(url))
    named = F.when(port(url).isNotNull() & ~port(url).eqNullSafe(default), F.concat(F.lit(":"), port(url))).otherwise("")
    user = F.coalesce(F.concat(_part(url, 2), F.lit("@")), F.lit(""))
    end = F.coalesce(F.concat(F.lit("#"), ref(url)), F.lit(""))
    return F.when(is_valid(url), F.concat(scheme(url), F.lit("://"), user, F.coalesce(host(url), F.lit("")), named, request(url), end))


def is_standard(url: Column) -> Column:
    """URL-3 (H; X)."""
    return F.coalesce(scheme(url).isin(*STANDARD), F.lit(False))


def is_file(url: Column) -> Column:
    """URL-4 (H)."""
    return scheme(url).eqNullSafe(F.lit("file"))


def is_secure(url: Column) -> Column:
    """URL-5 (H)."""
    return scheme(url).eqNullSafe(F.lit("https"))


_BYTE = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IPV4 = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"


def is_ip(name: Column) -> Column:
    """A host that is an IPv4 address, or a bracketed IPv6 one."""
    return F.coalesce(name.rlike(IPV4) | name.rlike(r"^\[[0-9A-Fa-f:.]+\]$"), F.lit(False))


def host_is_ip(url: Column) -> Column:
    """URL-6 (H)."""
    return is_ip(host(url))


def has(url: Column, part: str) -> Column:
    """URL-15 (H): whether the URL has a scheme, username, password, host, port, path, query or ref."""
    made = {"scheme": scheme, "username": username, "password": password, "host": host, "port": port, "path": path, "query": query, "ref": ref}
    return made[part](url).isNotNull()


def is_host_page(url: Column) -> Column:
    """URL-16 (H; X): no query, and a path of at most a slash."""
    return is_valid(url) & (F.coalesce(path(url), F.lit("/")) == "/") & query(url).isNull()


#: Domain rules that the tests need; callers bring their own list. (name, type): 0 a registry, 1 an
#: exception, 2 every name below. Fixed values.
RULES = (
    ("com", 0), ("net", 0), ("org", 0), ("cn", 0), ("com.cn", 0), ("cc", 0), ("uk", 2), ("jp", 0),
    ("kawasaki.jp", 2), ("city.kawasaki.jp", 1), ("au", 0), ("edu.au", 0), ("qld.edu.au", 0), ("co.uk", 0),
)


def _suffix(labels: Column, n: Column) -> Column:
    return F.when(n > 0, F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")).otherwise("")


def domain_of_host(name: Column, rules: tuple[tuple[str, int], ...] = RULES) -> Column:
    """URL-19 (T): a host's registry and one label more; null for addresses and registries.

    The longest rule that fits decides, an exception before all; a name that no rule knows has its
    last label as registry. The rules are literals, for lists up to some hundred; see ``join_domains``.
    """
    plain, wild, except_ = ("|".join(re.escape(r) for r, k in rules if k == kind) for kind in (0, 2, 1))
    low = ascii_lower(name)
    # A search takes the match that begins first, so the longest rule; the last label is always one.
    ends = [rf"[^.]*\.(?:{wild})"] * bool(wild) + [plain] * bool(plain) + ["[^.]*"]
    registry = F.regexp_extract(low, rf"(?:^|\.)({'|'.join(ends)})\z", 1)
    if except_:
        exception = F.regexp_extract(low, rf"(?:^|\.)((?:{except_}))\z", 1)
        registry = F.when(exception != "", F.regexp_replace(exception, r"^[^.]*\.?", "")).otherwise(registry)
    front = F.left(low, F.length(low) - F.length(registry) - 1)
    return F.when(~is_ip(name) & (F.length(low) > F.length(registry)), F.concat(F.substring_index(front, ".", -1), F.lit("."), registry))


def domain(url: Column, rules: tuple[tuple[str, int], ...] = RULES) -> Column:
    """URL-18 (T)."""
    return domain_of_host(host(url), rules)


def join_domains(df: DataFrame, host_col: str, rules: DataFrame) -> DataFrame:
    """URL-19 for rule tables of any size (``name``, ``type``): the distinct hosts' suffixes are
    exploded and joined. Adds ``domain``."""
    hosts = df.select(F.col(host_col).alias("h")).where(F.col("h").isNotNull()).distinct().withColumn("labels", F.split(ascii_lower(F.col("h")), r"\.", -1))
    ends = hosts.select("h", F.size("labels").alias("all"), F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("n"), "labels")
    keyed = ends.withColumn("name", _suffix(F.col("labels"), F.col("n"))).drop("labels")
    n = F.when(F.col("type") == 1, F.col("n") - 1).when(F.col("type") == 2, F.col("n") + 1).otherwise(F.col("n"))
    fit = keyed.join(rules.select("name", "type"), "name").where((F.col("type") != 2) | (F.col("n") < F.col("all")))
    found = fit.groupBy("h").agg(F.max_by(n, F.struct(F.when(F.col("type") == 1, 1).otherwise(0), n)).alias("registry"))
    made = hosts.join(found, "h", "left").withColumn("registry", F.coalesce("registry", F.lit(1)))
    own = made.select("h", F.when(~is_ip(F.col("h")) & (F.size("labels") > F.col("registry")), _suffix(F.col("labels"), F.col("registry") + 1)).alias("domain"))
    return df.join(own, df[host_col] == own["h"], "left").drop(own["h"])


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """URL-18: rules for ``join_domains`` from files in the format of the public suffix list: one a
    line, up to the first blank; ``//`` begins a comment, ``!`` an exception, ``*.`` a wildcard."""
    rule = F.lower(F.regexp_extract("value", r"^\s*(\S+)", 1))
    kind = F.when(F.col("rule").startswith("!"), 1).when(F.col("rule").startswith("*."), 2).otherwise(0)
    rules = spark.read.text(path).select(rule.alias("rule")).where((F.col("rule") != "") & ~F.col("rule").startswith("//"))
    return rules.select(F.regexp_replace("rule", r"^(!|\*\.)", "").alias("name"), kind.alias("type")).distinct()


def same_domain(a: Column, b: Column) -> Column:
    """URL-20 (H): both have a domain, and the same."""
    return F.coalesce(domain(a) == domain(b), F.lit(False))


@F.pandas_udf(T.StringType())
def resolve(base: pd.Series, relative: pd.Series) -> pd.Series:
    """URL-22 (H): a relative URL on its base."""
    return pd.Series([None if b is None or r is None else urljoin(b, r) for b, r in zip(base, relative)], dtype=object)


#: URL-23: what ``url_encode`` writes for characters that stay. Fixed values.
KEPT = {"%21": "!", "%7E": "~", "%27": "'", "%28": "(", "%29": ")"}


def url_encode(s: Column) -> Column:
    """URL-23 (I): letters, digits and ``-_.!~*'()`` stay, a space is ``+``, other bytes are ``%XX``."""
    out = F.url_encode(s)
    for code, char in KEPT.items():
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def url_decode(s: Column) -> Column:
    """URL-24 (I): ``+`` is a space; a ``%`` that two hex digits do not follow becomes ``?``. Bytes that
    are not UTF-8 become U+FFFD."""
    whole = F.regexp_replace(s, "%(?![0-9A-Fa-f]{2})", "?")
    return F.try_url_decode(whole)


