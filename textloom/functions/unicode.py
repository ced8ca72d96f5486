"""Unicode normalisation, collation, and word and sentence breaks."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMS = ("NFC", "NFD", "NFKC", "NFKD")
#: Texts of a batch that are Python strings at the same time.
AT_ONCE = 64


def normalized(s: Column, form: str = "NFC") -> Column:
    """ICU-1 (M): a text in one of the four normal forms; null stays null."""
    if form not in FORMS:
        raise ValueError(f"no normal form: {form}")

    @F.arrow_udf(T.StringType())
    def run(values: pa.Array) -> pa.Array:
        parts = [pa.array([], values.type)]
        for i in range(0, len(values), AT_ONCE):
            texts = values.slice(i, AT_ONCE).to_pylist()
            parts.append(pa.array([None if x is None else unicodedata.normalize(form, x) for x in texts], values.type))
        return pa.concat_arrays(parts)

    # A text of ASCII alone is its own normal form and is not sent.
    ascii_only = F.octet_length(s) == F.char_length(s)
    return F.when(ascii_only, s).otherwise(run(F.when(~ascii_only, s)))


def without_marks(s: Column) -> Column:
    """ICU-1 (M): a text without the marks that stand over or under its letters."""
    return normalized(F.regexp_replace(normalized(s, "NFD"), r"\p{Mn}+", ""), "NFC")


def collated(s: Column, name: str = "UNICODE_CI") -> Column:
    """ICU-1 (M): a text that compares, groups and joins under a collation; Spark's are ICU's."""
    return F.collate(s, name)


def sentences(s: Column, language: str = "", country: str = "") -> Column:
    """ICU-1 (M): the words of each sentence, at the breaks of a locale; no punctuation."""
    return F.sentences(s, F.lit(language), F.lit(country))


def words(s: Column, language: str = "", country: str = "") -> Column:
    """ICU-1 (M): the words of a text, at the breaks of a locale."""
    return F.flatten(sentences(s, language, country))
