"""Token counts without ids: pieces are counted once for each distinct pre-token, and a document's
count is the sum over its pre-token frequencies.

A pre-token is a run of spaces and what follows up to the next space. With a model whose normaliser
leaves texts alone and whose pieces never continue past a space, no merge crosses such a border, so
the counts of the parts add up to the count of the whole; ``separable`` checks both, and a model that
fails is applied to whole texts.

Defined results
---------------
* Null and empty texts have 0 bytes and 0 tokens.
* Strings that look like special tokens are ordinary text, as is the library's default.
* Texts of any length are counted whole, one at a time where they are longer than a block.
* Repeated rows and ids are counted one by one; other columns are never read.

At scale
--------
No shuffle: the table of distinct pre-tokens belongs to a task, which joins it to the
frequencies of one document at a time. It is emptied when it holds ``MOST_PRETOKENS`` or ``MOST_CHARS``, so
memory depends on the longest text only. The ids of a pre-token exist while it is counted, those of a
document never do. (One table for the corpus would be counted by fewer calls, but would shuffle every
document's distinct pre-tokens twice, which is more bytes than the texts.)
"""

from __future__ import annotations

from collections.abc import Iterator
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from textloom.llm.vocabulary import MOST_CHARS, MOST_PRETOKENS, Numbers, blocks

#: Production parameters.
MODEL, LIMIT = "piece_bpe_32k.model", 4096
SPACE = "▁"
SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PieceCounter:
    """Counts the pieces of texts under a sentencepiece model."""

    def __init__(self, path: str, most: int = MOST_PRETOKENS, chars: int = MOST_CHARS):
        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        self.separable = self._separable(spec)
        if self.separable:
            spec.normalizer_spec.add_dummy_prefix = False  # each pre-token brings its own
        self.model = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.most, self.chars = most, chars
        self.forget()

    @staticmethod
    def _separable(spec) -> bool:
        plain = spec.normalizer_spec
        inner = any(SPACE in p.piece.lstrip(SPACE) for p in spec.pieces)
        own = any(p.type == 4 for p in spec.pieces)  # user-defined pieces match before any merge
        keeps = not plain.precompiled_charsmap and plain.escape_whitespaces and not plain.remove_extra_whitespaces
        return keeps and plain.add_dummy_prefix and not inner and not own and not spec.trainer_spec.treat_whitespace_as_suffix

    @staticmethod
    def pretokens(text: str) -> list[str]:
        """The pre-tokens, each without its first space mark."""
        parts = text.split(" ")
        if "" in parts or SPACE in text:
            return [x[1:] for x in SEGMENT.findall(SPACE + text.replace(" ", SPACE))]
        return parts

    def __call__(self, texts: list[str]) -> list[int]:
        """The number of pieces of each text."""
        if not self.separable:
            return [len(self.model.encode(x)) for x in texts]
        if self.numbers.full(self.chars, self.most):
            self.forget()
        frequencies = []
        for text in texts:
            parts = self.pretokens(text) if text else []
            frequencies.append(np.unique(np.fromiter(map(self.numbers.__getitem__, parts), np.int64, len(parts)), return_counts=True))
        if new := self.numbers.waiting:
            self.numbers.waiting = []
            pieces = np.fromiter(map(len, self.model.encode([SPACE + x for x in new], num_threads=1)), np.int64, len(new))
            self.pieces = np.concatenate((self.pieces, pieces))
        return [int(self.pieces[number] @ n) for number, n in frequencies]

    def forget(self) -> None:
        self.numbers, self.pieces = Numbers(), np.zeros(0, np.int64)


_COUNTERS: dict[str, PieceCounter] = {}


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Each document's id, ``n_bytes``, ``n_tokens`` and ``over_limit``."""
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    name = model or MODEL

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = name if "/" in name else public_tokenizers.path(name)
        if path not in _COUNTERS:
            _COUNTERS[path] = PieceCounter(path)
        pieces = _COUNTERS[path]
        try:
            for batch in batches:
                n = [x for block in blocks(x.as_py() for x in batch.column(1)) for x in pieces(block)]
                size = pa.compute.binary_length(batch.column(1)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n, pa.int64())], [id_col, "n_bytes", "n_tokens"])
        finally:
            pieces.forget()

    out = rows.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
