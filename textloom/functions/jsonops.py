"""JSON and structured messages: structs to text and back, flattening, and the text format."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The message of the original's tests.
PERSON = (
    "name struct<first_name string, second_name string>, age int, address string, phone_number array<string>, address_id bigint, people_type string"
)
#: PERSON's required fields.
REQUIRED = ("name",)


def styled(message: Column) -> Column:
    """JSN-1 (T; layout X): indented JSON."""
    return F.to_json(message, {"pretty": "true"})


def fast(message: Column) -> Column:
    """JSN-2 (T): JSON on one line; absent fields are left out."""
    return F.to_json(message)


def to_value(message: Column) -> Column:
    """JSN-3 (H): a variant."""
    return F.parse_json(F.to_json(message))


def from_value(value: Column, schema: str = PERSON, required: tuple[str, ...] = REQUIRED) -> Column:
    """JSN-4 (H)."""
    return from_text(F.to_json(value), schema, required)


def from_text(s: Column, schema: str = PERSON, required: tuple[str, ...] = REQUIRED) -> Column:
    """JSN-5, JSN-7 (T/M): the message; null for text that is no JSON object or lacks a required
    field. Integers are read as integers, so those beyond 2^53 stay exact."""
    read = F.from_json(s, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    good = read.isNotNull() & read["_bad"].isNull()
    for name in required:
        good = good & read[name].isNotNull()
    return F.when(good, read.dropFields("_bad"))


def _flat(value: object, path: str) -> Iterator[tuple[str, str]]:
    if isinstance(value, dict):
        yield path or ".", "{}"
        for key in sorted(value):
            yield from _flat(value[key], f"{'' if path == '.' else path}.{key}")
    elif isinstance(value, list):
        yield path or ".", "[]"
        for i, item in enumerate(value):
            yield from _flat(item, f"{path}[{i}]")
    else:
        yield path or ".", json.dumps(value, ensure_ascii=False)


def flattened(s: Column) -> Column:
    """JSN-6 (T): ``array<struct<path, value>>`` in the order of keys, containers first as ``{}`` and
    ``[]``; null for bad JSON. The root is ``.``; a map's member adds ``.key``, a list's ``[i]``."""
    kind = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())]))

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        def one(x: str | None) -> list[dict] | None:
            try:
                found = json.loads(x) if x is not None else None
            except ValueError:
                return None
            return None if x is None else [{"path": p, "value": v} for p, v in _flat(found, ".")]

        return texts.map(one)

    return run(s)


def text_format(s: Column) -> Column:
    """PB-1 (I): a message in the protobuf text format as JSON text; null for what does not parse.
    Repeated names become lists; names of enumerations are strings."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else _message_json(x))

    return run(s)


def _message_json(text: str) -> str | None:
    token = re.compile(r"""\s*(?:(#[^\n]*)|([A-Za-z_][\w.]*)|("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(-?[0-9][\w.+\-]*)|([:{}<>,;\[\]]))""")
    tokens, at = [], 0
    while text[at:].strip():
        m = token.match(text, at)
        if not m:
            return None
        at = m.end()
        if not m[1]:
            tokens.append(m)
    place = 0

    def value() -> object:
        nonlocal place
        m = tokens[place]
        place += 1
        if m[3]:
            return ast.literal_eval(m[3])
        if m[4]:
            return float(m[4]) if re.search(r"[.eE]", m[4]) and not m[4].startswith("0x") else int(m[4], 0)
        if m[2]:
            return {"true": True, "false": False}.get(m[2], m[2])
        raise ValueError(m[0])

    def message(end: str | None) -> dict:
        nonlocal place
        out: dict = {}
        while place < len(tokens) and (end is None or tokens[place][5] != end):
            name = tokens[place][2]
            if not name:
                raise ValueError("a field's name")
            place += 1
            colon = tokens[place][5] == ":"
            place += colon
            opens = tokens[place][5]
            if opens in ("{", "<"):
                place += 1
                found: object = message({"{": "}", "<": ">"}[opens])
                place += 1
            elif colon:
                found = value()
            else:
                raise ValueError("a colon")
            if place < len(tokens) and tokens[place][5] in (",", ";"):
                place += 1
            out[name] = [*out[name], found] if isinstance(out.get(name), list) else [out[name], found] if name in out else found
        if end and place >= len(tokens):
            raise ValueError("unclosed")
        return out

    try:
        made = message(None)
        return json.dumps(made, ensure_ascii=False) if place == len(tokens) else None
    except (ValueError, IndexError, SyntaxError):
        return None
