"""Text sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: a rank file (base64 token and rank on each line); the path must exist on every executor
VOCABULARY = os.environ.get("COTEJO_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# fixed value: how byte-level BPE splits text before merging
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: characters that are handed to the encoder at once; longer texts go in slices that end where its pattern always splits
SLICE = 100_000
#: a blank between two characters that aren't: every alternative of the pattern starts a new piece there
_SPLIT = re.compile(r"(?<=\S) (?=\S)")


@functools.cache
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(tok): int(rank) for tok, rank in map(bytes.split, f)}
    return tiktoken.Encoding("cotejo", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _pieces() -> regex.Pattern:
    return regex.compile(PATTERN)


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """The text in slices of about ``size`` characters, cut only at split points; a slice without any may be longer."""
    pos = 0
    while len(text) - pos > size:
        cut = _SPLIT.search(text, pos + size)
        if cut is None:
            break
        yield text[pos : cut.start()]
        pos = cut.start()
    yield text[pos:]


def count_tokens(text: str | None, path: str = VOCABULARY, size: int = SLICE) -> int:
    """Tokens of the whole text, whatever its length; 0 for null and empty texts.

    Slices end at split points, so their counts add up to that of the whole.  A
    slice that has none for long (a run of blanks or signs, which would exhaust the
    encoder's pattern engine) is split by the same pattern here, piece by piece.
    """
    if not text:
        return 0
    enc, n = _encoder(path), 0
    for part in slices(text, size):
        if len(part) <= 2 * size:
            n += len(enc.encode_ordinary(part))
        else:
            n += sum(len(enc.encode_ordinary(m) if len(m) <= size else enc._core_bpe.encode_single_piece(m.encode("utf-8", "replace"))) for m in (x.group() for x in _pieces().finditer(part)))
    return n


def with_token_counts(docs: DataFrame, text: str, keep: list[str], out: str = "tokens", path: str = VOCABULARY) -> DataFrame:
    """``keep`` columns and the token count of ``text``; the texts themselves go no further."""
    slim = docs.select(*keep, text) if text not in keep else docs.select(*keep)
    schema = T.StructType([f for f in slim.schema.fields if f.name in keep] + [T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pa.array([count_tokens(x.as_py(), path) for x in b.column(text)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), sizes], names=[*keep, out])

    return slim.mapInArrow(run, schema)
