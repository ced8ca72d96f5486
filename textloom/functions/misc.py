"""Lists, paths, templates and dictionary-driven conversion."""

from __future__ import annotations

import os
import re
from urllib.parse import quote_plus

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.codec import HTML, JAVASCRIPT, html_escape, javascript_escape


def to_list(col: Column) -> Column:
    """ARR-1 (I): a scalar as a list of one; null and the empty text as none."""
    empty = F.array().cast("array<string>")
    return F.when(col.isNull() | (col == ""), empty).otherwise(F.array(col))


@F.pandas_udf(T.StringType())
def relative_path(path: pd.Series, reference: pd.Series) -> pd.Series:
    """PTH-1 (I): ``path`` as seen from the folder ``reference``; what they share may differ in case."""

    def one(a: str | None, b: str | None) -> str | None:
        if a is None or b is None:
            return None
        x, y = ([p for p in os.path.normpath(v).split("/") if p not in ("", ".")] for v in (a, b))
        same = 0
        while same < min(len(x), len(y)) and x[same].lower() == y[same].lower():
            same += 1
        return "/".join([".."] * (len(y) - same) + x[same:]) or "."

    return pd.Series([one(a, b) for a, b in zip(path, reference)], dtype=object)


#: TPL-2: modifiers and the escapes they stand for.
MODIFIERS = {"h": HTML, "html_escape": HTML, "j": JAVASCRIPT, "javascript_escape": JAVASCRIPT}


def _modified(value: str, modifiers: list[str]) -> str:
    for name in modifiers:
        if name in ("u", "url_query_escape"):
            value = quote_plus(value, safe="-_.!~*'()")
        else:
            for old, new in MODIFIERS.get(name, ()):
                value = value.replace(old, new)
    return value


class Template:
    """TPL-1 (T): a template as a list of texts, variables, sections and includes.

    ``{{NAME:mod}}`` is a variable, ``{{#NAME}}...{{/NAME}}`` a section, shown once for each of its
    dictionaries, ``{{>NAME}}`` an include, ``{{!...}}`` a comment, and ``{{=<< >>=}}`` sets the marks.
    """

    def __init__(self, text: str, strip: str = "DO_NOT_STRIP"):
        self.nodes, self.rest = self._parse(stripped(text, strip), 0, None, ("{{", "}}"))

    def _parse(self, text: str, at: int, section: str | None, marks: tuple[str, str]) -> tuple[list, int]:
        nodes: list = []
        while (start := text.find(marks[0], at)) >= 0:
            nodes.append(text[at:start])
            end = text.find(marks[1], start + len(marks[0]))
            if end < 0:
                raise ValueError(f"unclosed {marks[0]}")
            tag, at = text[start + len(marks[0]) : end], end + len(marks[1])
            kind, name = (tag[0], tag[1:]) if tag[:1] in ("#", "/", ">", "!", "=") else ("", tag)
            if kind == "=":
                marks = tuple(name.rstrip("=").split(" ", 1))  # type: ignore[assignment]
            elif kind == "#":
                inner, at = self._parse(text, at, name, marks)
                nodes.append(("#", name, inner))
            elif kind == "/":
                if name != section:
                    raise ValueError(f"{name} was not open")
                return nodes, at
            elif kind != "!":
                nodes.append((kind or "$", *name.split(":")))
        if section:
            raise ValueError(f"{section} is not closed")
        return [*nodes, text[at:]], len(text)

    def render(self, values: dict, includes: dict[str, "Template"] | None = None) -> str:
        return self._render(self.nodes, [values], includes or {})

    def _render(self, nodes: list, scope: list[dict], includes: dict[str, "Template"]) -> str:
        out = []
        for node in nodes:
            if isinstance(node, str):
                out.append(node)
                continue
            found = next((s[node[1]] for s in reversed(scope) if node[1] in s), None)
            if node[0] == "$":
                out.append(_modified("" if found is None else str(found), [m for m in node[2:] if m]))
            elif node[0] == "#":
                for own in found if isinstance(found, list) else [{}] if found else []:
                    out.append(self._render(node[2], [*scope, own], includes))
            elif node[1] in includes:
                out.append(self._render(includes[node[1]].nodes, scope, includes))
        return "".join(out)


def stripped(text: str, mode: str) -> str:
    """TPL-4 (I): whole, without blank lines, or without white space around lines and their ends."""
    if mode == "STRIP_BLANK_LINES":
        return "".join(x for x in text.splitlines(keepends=True) if x.strip())
    if mode == "STRIP_WHITESPACE":
        return "".join(x.strip() for x in text.splitlines())
    return text


def strip_lines(text: Column, mode: str) -> Column:
    """TPL-4 (I), as an expression."""
    if mode == "STRIP_BLANK_LINES":
        return F.regexp_replace(text, r"(?m)^[ \t\r\f\x0b]*(?:\n|\z)", "")
    if mode == "STRIP_WHITESPACE":
        return F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), "")
    return text


def rendered(template: str, values: Column, strip: str = "DO_NOT_STRIP") -> Column:
    """TPL-1, TPL-2 (T): the template with each row's ``map<string,string>``; a non-empty value also
    shows the section of its name once."""

    @F.pandas_udf(T.StringType())
    def run(maps: pd.Series) -> pd.Series:
        made = Template(template, strip)
        return maps.map(lambda m: None if m is None else made.render(dict(m)))

    return run(values)


def autoescaped(value: Column, context: str) -> Column:
    """TPL-3 (T): a value for HTML text, a quoted or a bare JavaScript place, or a URL attribute. A
    bare place takes numbers and truth values only, else ``null``; a URL needs a web scheme or none,
    else ``#``."""
    if context == "html":
        return html_escape(value)
    if context == "js":
        return javascript_escape(value)
    if context == "js_bare":
        return F.when(value.rlike(r"^(?:true|false|-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|0[xX][0-9A-Fa-f]+)$"), value).otherwise("null")
    if context == "url":
        return F.when(value.rlike(r"(?i)^(?:https?:|ftp:|mailto:)|^[^:]*(?:[/?#]|\z)"), html_escape(value)).otherwise("#")
    raise ValueError(context)


def converted(text: Column, stages: list[dict[str, str]]) -> Column:
    """ZHC-1 (M/T; longest match X): dictionary conversion, one stage after the other; in each, from
    the left, the longest entry is replaced. A stage of single characters is an expression."""
    if all(len(k) == 1 and len(v) == 1 for stage in stages for k, v in stage.items()):
        for stage in stages:
            text = F.translate(text, "".join(stage), "".join(stage.values()))
        return text
    patterns = [(re.compile("|".join(map(re.escape, sorted(s, key=len, reverse=True)))), s) for s in stages if s]

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            for pattern, words in patterns if x is not None else ():
                x = pattern.sub(lambda m, words=words: words[m.group()], x)
            return x

        return texts.map(one)

    return run(text)
