"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct pre-tokens of a block of texts stand in one array of symbols. Each adjacent pair that
has a merge is mapped to all places where it occurs; the ranks that have places are applied in
ascending order, each to all its places at once, and the lists of the pairs on both sides of a merge
are updated. Ids of a text are then gathered from its pre-tokens.

Defined results
---------------
* Null and empty texts have no ids, and decode to the empty text.
* Strings of special tokens inside a text become those tokens, as is the library's default.
* Repeated rows and ids are encoded one by one; other columns are passed on or never read.
* Decoding joins the tokens' bytes; bytes that are not UTF-8 become U+FFFD.

At scale
--------
No shuffle. A block ends at 2 million characters, or after one longer text, and a task forgets
its pre-tokens beyond ``MOST_PRETOKENS`` or ``MOST_CHARS`` and at its end, so memory depends on the longest text only.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.vocabulary import MOST_CHARS, MOST_PRETOKENS, Numbers, blocks

#: Production parameters.
VOCABULARY = "byte_bpe_50k.json"
NONE = np.int32(2**31 - 1)


def byte_letters() -> dict[str, int]:
    """The letters in which byte-level vocabularies spell bytes: printable ones stand for
    themselves, the others for code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def pretoken_pattern() -> re.Pattern:
    """``public_tokenizers.PATTERN`` for texts of the basic plane, with its Unicode classes written
    out for ``re``, which looks characters of that plane up in a table."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))

    def ranges(kind: str) -> str:
        found = (m.group() for m in regex.finditer(f"{kind}+", every))
        return "".join(re.escape(x[0]) + (f"-{re.escape(x[-1])}" if len(x) > 1 else "") for x in found)

    pattern = public_tokenizers.PATTERN.replace(r"(?!\S)", r"(?![^\s])")
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", "[^SLN]").replace(r"[^\s]", "[^S]").replace(r"\p{L}", "[L]").replace(r"\p{N}", "[N]").replace(r"\s", "[S]")
    kinds = {"S": ranges(r"\s"), "L": ranges(r"\p{L}"), "N": ranges(r"\p{N}")}
    return re.compile(re.sub(r"\[\^?[SLN]+\]", lambda m: re.sub("[SLN]", lambda k: kinds[k.group()], m.group()), pattern))


class PairIndexBPE:
    """A byte-level BPE vocabulary of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        if odd or model.get("ignore_merges") or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        letters, vocab = byte_letters(), model["vocab"]
        size = 1 + max([*vocab.values(), *(x["id"] for x in spec["added_tokens"])])
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(letters[c] for c in token)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for text, i in self.special.items():
            self.token_bytes[i] = text.encode()
        self.byte_ids = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int32)
        self.edge = size  # a symbol between pre-tokens
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (np.array([vocab[x] for x in col], np.int64) for col in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        keys = left * (size + 1) + right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made, self.twin = made.astype(np.int32), left == right
        self.basic, self.words = pretoken_pattern().findall, regex.compile(public_tokenizers.PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.forget()

    def forget(self) -> None:
        self.places = Numbers()
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * (self.edge + 1) + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in order, and how many each has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        word_of = np.repeat(np.arange(len(words)), size)
        total = len(word_of)
        # One edge before the first word and one after each; a symbol's place counts those before it.
        sym = np.full(total + len(words) + 1, self.edge, np.int32)
        at = np.arange(total) + word_of + 1
        sym[at] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        after = np.arange(1, len(sym) + 1, dtype=np.int32)
        before = np.arange(-1, len(sym) - 1, dtype=np.int32)
        rank = np.append(self.rank_of(sym[:-1], sym[1:]), NONE).astype(np.int32)
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(places: np.ndarray) -> None:
            r = rank[places]
            places, r = places[r < NONE], r[r < NONE]
            if not len(r):
                return
            order = np.argsort(r, kind="stable")
            places, r = places[order], r[order]
            cuts = np.flatnonzero(np.diff(r)) + 1
            for part, x in zip(np.split(places, cuts), r[np.concatenate(([0], cuts))].tolist()):
                if x not in lists:
                    lists[x] = []
                    heapq.heappush(active, x)
                lists[x].append(part)

        add(np.arange(len(sym), dtype=np.int32))
        while active:
            x = heapq.heappop(active)
            parts = lists.pop(x)
            here = np.concatenate(parts) if len(parts) > 1 else parts[0]
            here = here[rank[here] == x]
            if self.twin[x] and len(here) > 1:
                here = np.sort(here)
                here = here[np.concatenate(([True], here[1:] != here[:-1]))]
                # Places whose pairs overlap: of each run, from its left end, every other one.
                chained = np.concatenate(([False], here[1:] == after[here[:-1]]))
                index = np.arange(len(here))
                first = np.maximum.accumulate(np.where(chained, 0, index))
                here = here[(index - first) % 2 == 0]
            if not len(here):
                continue
            gone = after[here]
            rank[gone] = NONE
            sym[gone] = -1
            sym[here] = self.made[x]
            beyond = after[gone]
            after[here] = beyond
            before[beyond] = here
            left = before[here]
            rank[left] = self.rank_of(sym[left], sym[here])
            rank[here] = self.rank_of(sym[here], sym[beyond])
            add(np.concatenate((left, here)))
        live = sym[at] >= 0
        return sym[at][live], np.bincount(word_of[live], minlength=len(words))

    def _pretokens(self, text: str) -> list[str]:
        find = self.basic if len(text.encode("utf-16-le")) == 2 * len(text) else self.words
        if self.cut is None or not any(x in text for x in self.special):
            return find(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.special else find(part)
        return out

    def encode_block(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if self.places.full(MOST_CHARS, MOST_PRETOKENS):
            self.forget()
        numbers = []
        for text in texts:
            tokens = self._pretokens(text)
            numbers.append(np.fromiter(map(self.places.__getitem__, tokens), np.int64, len(tokens)))
        if self.places.waiting:
            new = self.places.waiting
            self.places.waiting = []
            own = [i for i, x in enumerate(new) if x in self.special]
            ids, n = self.encode_words([b"" if x in self.special else x.encode() for x in new])
            if own:
                ids = np.insert(ids, np.cumsum(n)[own], [self.special[new[i]] for i in own])
                n[own] = 1
            self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(n) - n))
            self.lengths = np.concatenate((self.lengths, n))
            self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
        out = []
        for number in numbers:
            n = self.lengths[number]
            end = np.cumsum(n)
            shift = np.repeat(self.starts[number] - (end - n), n)
            out.append(self.ids[shift + np.arange(len(shift))])
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


_MODELS: dict[str, PairIndexBPE] = {}


def model_at(vocabulary: str) -> PairIndexBPE:
    """One model in each Python worker; ``vocabulary`` is a path, or the name of a public one."""
    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    if path not in _MODELS:
        _MODELS[path] = PairIndexBPE(path)
    return _MODELS[path]


def encoded_with(docs: DataFrame, text_col: str, vocabulary: str, added: dict[str, str], make: Callable[[PairIndexBPE, list[np.ndarray]], list[pa.Array]], keep: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, with columns that ``make`` derives from the ids of a block
    of texts. A column of ``docs`` that has the name of an added one is replaced."""
    lower = {x.lower() for x in added}
    kept = [F.col(f"`{c}`") for c in (keep or docs.columns) if c.lower() not in lower]
    rows = docs.select(F.struct(*kept).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    schema = T.StructType([rows.schema["row"], *(T.StructField(x, T._parse_datatype_string(k)) for x, k in added.items())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(vocabulary)
        try:
            for batch in batches:
                start = 0
                for block in blocks(x.as_py() for x in batch.column(1)):
                    columns = make(model, model.encode_block(block))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(block)), *columns], ["row", *added])
                    start += len(block)
        finally:
            model.forget()
            pa.default_memory_pool().release_unused()

    return rows.mapInArrow(encode, schema).select("row.*", *added)


def id_lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids), pa.int32()))


def encoded(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``docs`` with the ids of its texts (array of int) and the texts that they decode to."""
    added = {ids_col: "array<int>", decoded_col: "string"}
    return encoded_with(docs, text_col, vocabulary, added, lambda model, ids: [id_lists(ids), pa.array(map(model.decode, ids), pa.string())])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Each document's id, ``n_tokens``, and SHA-256 digests of its ids, as little-endian unsigned
    32-bit integers, and of the text that they decode to. Neither leaves the worker."""

    def sha(x: bytes) -> str:
        return hashlib.sha256(x).hexdigest()

    def make(model: PairIndexBPE, ids: list[np.ndarray]) -> list[pa.Array]:
        of_ids = [sha(x.astype("<u4").tobytes()) for x in ids]
        return [pa.array([len(x) for x in ids], pa.int64()), pa.array(of_ids), pa.array([sha(model.decode(x).encode()) for x in ids])]

    added = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    return encoded_with(docs, text_col, vocabulary, added, make, [id_col])
