"""Key-value strings and escaped maps, as expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_value(piece: Column, delimiter: str = "=") -> Column:
    """KV-1 (I): ``struct(key, value, ok)``. The value follows the first run of delimiters. Without a
    delimiter both are empty, with nothing after it the value is; ``ok`` is then false."""
    at = F.instr(piece, F.lit(delimiter))
    key = F.when(at == 0, "").otherwise(F.left(piece, at - 1))
    d = re.escape(delimiter)
    value = F.when(at == 0, "").otherwise(F.regexp_replace(F.substring(piece, at, F.length(piece)), f"^(?:{d})+", ""))
    return F.struct(key.alias("key"), value.alias("value"), (value != "").alias("ok"))


def key_value_pairs(line: Column, delimiter: str = "=", pair_delimiter: str = "&") -> Column:
    """KV-2, KV-3 (I/H): ``struct(pairs, ok)``. Empty pieces are skipped; repeated keys and pieces that
    fail are kept, and one that fails makes ``ok`` false."""
    parts = F.filter(F.split(line, f"\\Q{pair_delimiter}\\E", -1), lambda x: x != "")
    found = F.transform(parts, lambda x: key_value(x, delimiter))
    pairs = F.transform(found, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))
    return F.struct(pairs.alias("pairs"), F.forall(found, lambda x: x["ok"]).alias("ok"))


def first_wins(pairs: Column) -> Column:
    """KV-3, MAP-2: an array of ``struct(key, value)`` as a map; of repeated keys the first counts. The pairs are
    sorted by key and place, so the map is in the order of the keys."""
    placed = F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), i.alias("at"), p["value"].alias("value")))
    # The array in an array, so that a lambda's variable names the sorted one and it is made once.
    first = F.transform(F.array(F.array_sort(placed)), lambda s: F.filter(s, lambda p, i: (i == 0) | (F.get(s, i - 1)["key"] != p["key"])))
    return F.map_from_entries(F.transform(first[0], lambda p: F.struct(p["key"], p["value"])))


def escaped(s: Column) -> Column:
    """MAP-3 (I): a backslash before each comma, colon and backslash."""
    return F.regexp_replace(s, r"([,:\\])", r"\\$1")


def unescaped(s: Column) -> Column:
    """MAP-4 (I): null for a backslash before anything else, or at the end."""
    return F.when(s.rlike(r"(?s)^(?:[^\\]|\\[,:\\])*\z"), F.regexp_replace(s, r"\\([,:\\])", "$1"))


def map_to_string(m: Column) -> Column:
    """MAP-1, ORD-1 (I): ``k:v,k:v`` in the order of the keys, both escaped."""
    entries = F.array_sort(F.map_entries(m))
    return F.array_join(F.transform(entries, lambda e: F.concat(escaped(e["key"]), F.lit(":"), escaped(e["value"]))), ",")


def string_to_map(s: Column) -> Column:
    """MAP-2 (I): null if a part has no colon or a bad escape; a final comma is allowed, and of
    repeated keys the first counts. The original leaves its map partly filled when it fails."""
    item = r"(?:[^\\:]++|\\[,:\\])*+:(?:[^\\,]++|\\[,:\\])*+(?:,|\z)"
    whole = s.rlike(rf"(?s)^(?:{item})*+\z")
    # A part is taken out once and then cut at its first colon without a backslash.
    parts = F.regexp_extract_all(s, F.lit(f"(?s){item}"), F.lit(0))
    cut = r"(?s)^((?:[^\\:]++|\\.)*+):((?:[^\\,]++|\\.)*+),?\z"
    pairs = F.transform(parts, lambda p: F.struct(*(F.regexp_replace(F.regexp_extract(p, cut, k), r"\\([,:\\])", "$1").alias(n) for k, n in ((1, "key"), (2, "value")))))
    return F.when(whole, first_wins(pairs))
