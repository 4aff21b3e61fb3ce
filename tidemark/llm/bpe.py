"""Byte-level BPE encoding and decoding (operator 5).

The tiktoken library works from a local rank file. A text longer than ``split_chars`` is cut where no
match of the pre-split pattern can span: between a character that isn't white space and a blank or line
end, after a letter that no letter follows, and after a digit that no digit follows. Every match lies
within one part, so the ids are those of the whole text. Decoding joins the raw bytes of the ids.

Defined results: a null text counts as empty (no ids, empty bytes); an empty table gives an empty table;
ties and repeated rows are each encoded by themselves; columns of the input other than the text are kept,
but those that bear the name of an output column are replaced by it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import column, importable, lists, pieces, texts

#: Characters after which a long text is cut at the next safe place.
SPLIT_CHARS = 65_536

_SAFE = regex.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \n\t\r])|(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """One encoding for each worker process, read from the rank file on its own machine."""
    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(rank_file, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, split_chars: int = SPLIT_CHARS) -> Iterator[str]:
    """Parts of the text that can be encoded one by one; joined, they are the text."""
    start = 0
    while len(text) - start > split_chars:
        found = _SAFE.search(text, start + split_chars)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def ids_of(enc: tiktoken.Encoding, text: str | None, split_chars: int = SPLIT_CHARS) -> np.ndarray:
    if not text:
        return np.empty(0, np.uint32)
    if len(text) <= split_chars:
        return enc.encode_to_numpy(text, disallowed_special=())
    return np.concatenate([enc.encode_to_numpy(part, disallowed_special=()) for part in safe_parts(text, split_chars)])


def encode(text: Column, rank_file: str, pattern: str, split_chars: int = SPLIT_CHARS) -> Column:
    """array<int> of the text's ids."""

    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        enc = encoding(rank_file, pattern)
        found = [ids_of(enc, x, split_chars) for x in column.to_pylist()]
        return lists(np.concatenate([np.empty(0, np.uint32), *found]).astype(np.int32), np.array([len(x) for x in found], np.int64), pa.int32())

    return run(text)


def decode(ids: Column, rank_file: str, pattern: str) -> Column:
    """The ids' raw bytes; null ids give no bytes."""

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        enc = encoding(rank_file, pattern)
        return pa.array([enc.decode_bytes(x.values.to_numpy().tolist()) if x.is_valid else b"" for x in column], pa.binary())

    return run(ids)


def round_trip(df: DataFrame, rank_file: str, pattern: str, text: str = "text", split_chars: int = SPLIT_CHARS) -> DataFrame:
    """df with ``ids`` (array<int>) and ``decoded`` (binary), made for a bounded part of an Arrow batch at a time."""
    importable(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name.lower() not in ("ids", "decoded")]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            for part in pieces(batch):
                found = [ids_of(enc, x, split_chars) for x in texts(part, text)]
                n = np.array([len(x) for x in found], np.int64)
                ids = lists(np.concatenate(found).astype(np.int32), n, pa.int32())
                decoded = pa.array([enc.decode_bytes(x.tolist()) for x in found], pa.binary())
                yield pa.RecordBatch.from_arrays([*(column(part, c) for c in names), ids, decoded], names=schema.names)

    return df.mapInArrow(run, schema)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """n_tokens and SHA-256 of the ids as decimal text and of the decoded bytes."""
    return encoded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
