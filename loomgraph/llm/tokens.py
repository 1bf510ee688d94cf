"""Encoding of a corpus with a public tokenizer.

Method: the tiktoken library with a local rank file. A long text is first cut at safe boundaries, so that no call
encodes much more than SEGMENT characters at once, whatever the script. Ids are decoded back as raw bytes.

A boundary is safe if the tokenizer's splitting pattern always ends a piece there: after a letter before anything that is
no letter, after a digit before anything that is no digit, and after punctuation before a digit or white space. No alternative of the pattern has such
neighbours inside a piece, none looks behind, and the only one that looks ahead concerns runs of white space, so the pieces on both sides are those of
the whole text. Letters and digits of all scripts count. A run of one class, such as 100,000 letters without a break, is one piece of the pattern and stays whole.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: the default place of the vocabulary files; every function takes another folder as a parameter
FOLDER = "/opt/tokenizers"
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: characters after which a text is cut at the next safe boundary
SEGMENT = 100_000

# only characters that are known to be of a class are named: what one version of Unicode doesn't know yet makes no boundary
_SAFE = regex.compile(r"(?<=\p{L})(?=[\p{P}\p{S}\p{N}\p{Z}\t\r\n])|(?<=\p{N})(?=[\p{L}\p{P}\p{S}\p{Z}\t\r\n])|(?<=[\p{P}\p{S}])(?=[\p{N}\p{Z}\t\r\n])")


@lru_cache(maxsize=4)
def encoding(name: str = "byte_bpe_50k", folder: str = FOLDER):
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """Pieces of `text`, each cut at the first safe boundary after `size` characters; their ids are those of the text."""
    start = 0
    while len(text) - start > size:
        found = _SAFE.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def encode(text: str | None, tokenizer, size: int = SEGMENT) -> list[int]:
    """Ids without special tokens; strings that look like special tokens are ordinary text. Null and empty: no ids."""
    if not text:
        return []
    if len(text) <= size:
        return tokenizer.encode_ordinary(text)
    return [i for part in segments(text, size) for i in tokenizer.encode_ordinary(part)]


def _encoder(name: str, folder: str, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(name, folder)
        for batch in batches:
            ids = [encode(text.as_py(), tokenizer) for text in batch.column(1)]
            out = pa.array([len(x) for x in ids], pa.int32()) if counts else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), out], names=["doc_id", "n" if counts else "ids"])

    return run


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def token_ids(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(doc_id, ids ARRAY<INT>) of every row of documents (doc_id, text).

    Null and empty texts both have an empty list; blank texts have the ids of their blanks; a text of any length is
    encoded whole; strings that look like special tokens are ordinary text. Repeated rows and rows with a null doc_id are
    kept; an empty table gives no rows; other columns are ignored. One pass without a shuffle.
    """
    return _texts(documents).mapInArrow(_encoder(name, folder, False), "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(doc_id, n INT): the number of ids of `token_ids`, without moving the ids out of the tasks."""
    return _texts(documents).mapInArrow(_encoder(name, folder, True), "doc_id bigint, n int")


def decoded(ids: DataFrame, name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): the tokens' raw bytes are joined before they are read as UTF-8.

    A null list gives a null text, an empty one an empty text; bytes that are no UTF-8 become U+FFFD.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoding(name, folder)
        for batch in batches:
            texts = [None if x is None else tokenizer.decode_bytes(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
