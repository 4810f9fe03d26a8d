"""Encoding of a corpus with a public byte-level BPE vocabulary by tiktoken.

The rank file is local and its path a parameter.  Long texts are cut before tokenising at
places where the pre-tokeniser cuts anyway: before a white-space character that follows a
letter, digit or punctuation mark of ASCII.  No match of the pattern runs from a sign that
isn't white space into one that is, and a look-ahead only looks past white space, so
the pieces' ids joined are those of the whole text.
"""

from __future__ import annotations

import array
import base64
import os
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("TEXTLOOM_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the pre-tokeniser's pattern of the public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 1 << 16  # characters beyond which a text is cut


@lru_cache(maxsize=4)
def encoding(rank_file: str):
    """The vocabulary of a rank file, without special tokens; loaded once per Python worker."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(rank_file), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def rank_path(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZER_DIR, f"{name}.tiktoken")


def pieces(text: str, size: int = LONG) -> Iterator[str]:
    """Parts of ``text`` of about ``size`` characters, cut only where pre-tokens end; joined they are ``text``."""
    start, n = 0, len(text)
    while n - start > size:
        at = start + size
        while at < n and not (text[at] in " \n" and text[at - 1].isascii() and not text[at - 1].isspace() and text[at - 1].isprintable()):
            at += 1
        yield text[start:at]
        start = at
    if start < n:
        yield text[start:]


def encode(text: str | bytes | None, rank_file: str, size: int = LONG) -> list[int]:
    """Ids of ``text``; a null or empty text has none; bytes that are no UTF-8 count as U+FFFD."""
    if not text:
        return []
    if isinstance(text, bytes):
        text = text.decode("utf-8", "replace")
    enc = encoding(rank_file)
    if len(text) <= size:
        return enc.encode_ordinary(text)
    return [i for part in pieces(text, size) for i in enc.encode_ordinary(part)]


def decode(ids: Iterable[int], rank_file: str) -> bytes:
    """The raw bytes that ids stand for; ids need not end at a character."""
    enc = encoding(rank_file)
    return b"".join(enc.decode_single_token_bytes(int(i)) for i in ids)


def _ids(rank_file: str, key_type: pa.DataType) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                lengths, flat = [0], array.array("i")
                for text in part.column(1).to_pylist():
                    flat.extend(encode(text, rank_file))
                    lengths.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(np.asarray(lengths, dtype=np.int32)), pa.array(np.frombuffer(flat, dtype=np.int32) if flat else np.empty(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["key", "ids"])

    return run


def _counts(rank_file: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(encode(text, rank_file)) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["key", "n_tokens"])

    return run


def token_ids(documents: DataFrame, *, record: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``<record>, ids``: one row for each row, without a shuffle; null and empty texts have an empty list."""
    kind = dict(documents.dtypes)[record]
    out = documents.select(F.col(record).alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(_ids(rank_path(tokenizer, folder), None), f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", record)


def token_counts(documents: DataFrame, *, record: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``<record>, n_tokens``: one row for each row; 0 for null and empty texts."""
    kind = dict(documents.dtypes)[record]
    out = documents.select(F.col(record).alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(_counts(rank_path(tokenizer, folder)), f"key {kind}, n_tokens bigint")
    return out.withColumnRenamed("key", record)
