"""Best-fit packing of documents into sequences (operator 11).

Each document is its ids and an end id; a document longer than a sequence is cut so that all its pieces but
the first fill a sequence each. Pieces are packed online as a task meets them, the longest of every ``WINDOW``
first: at most ``open_bins`` sequences are open, kept by their free space; a bitset of the free spaces gives the
fullest open sequence that still takes a piece, and where none does and no more may be open, the fullest closes.
A task's memory is its open sequences and a window, whatever it reads.

Sequences that are still open at a task's end and have room for more than ``SLACK`` ids are packed again, by a
sixteenth of the tasks, in rounds until one task is left; each round sees a bounded number of sequences for each
task before it. So only the last task leaves sequences with room, and no piece is moved that was in a closed one.

Ids are those of the tokenizers library. Its file's vocabulary and merges, whose order is checked to be that of the
ids, are read as ranks, by which the tiktoken library makes the same ids in a third of the time; literals of the
file's special tokens become their ids. Texts longer than ``LONG`` characters are encoded in parts, cut before a
blank or line end after a character that isn't white space, where no match of the pre-split pattern can span.
A file of another kind than byte-level BPE with that pattern is refused.

Defined results: a null or empty text is its end id alone; rows that repeat a key are packed each by themselves,
and so are rows with a null key; an empty table gives no rows; other columns of the input play no part, whatever
they are called. Sequence numbers are unique but not dense.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import column, importable, pieces, saved, texts

CAPACITY, OPEN_BINS, WINDOW, SLACK = 2048, 2048, 5_000, 8
#: Tasks of a round whose open sequences one task of the next round packs; characters of a text that are encoded at once.
FAN_IN, LONG = 16, 1 << 20
#: Rows in an Arrow batch of results.
_ROWS = 10_000
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
_KIND = {"key": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.list_(pa.int32())}


class Bins:
    """Open sequences by their free space; each holds the rows that lie in it until it closes."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits, self.at, self.open, self.made = 0, [[] for _ in range(capacity)], 0, 0

    def _taken(self, free: int) -> tuple[int, list]:
        found = self.at[free].pop()
        if not self.at[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def put(self, length: int, row: tuple) -> list[tuple[int, list]]:
        """Places a row of 1 to ``capacity`` ids; returns the (number, [(offset, row)]) of sequences that close thereby."""
        closed = []
        fitting = self.bits >> length
        if length < self.capacity and fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number, rows = self._taken(free)
        else:
            free, number, rows = self.capacity, self.made, []
            self.made += 1
            if self.open == self.most and length < self.capacity:
                closed.append(self._taken((self.bits & -self.bits).bit_length() - 1))
        rows.append((self.capacity - free, row))
        free -= length
        if free:
            self.at[free].append((number, rows))
            self.bits |= 1 << free
            self.open += 1
        else:
            closed.append((number, rows))
        return closed

    def rest(self) -> Iterator[tuple[int, tuple[int, list]]]:
        """(free space, sequence) of all that are open."""
        return ((free, found) for free, held in enumerate(self.at) for found in held)


def windows(rows: Iterator[tuple[int, tuple]], size: int = WINDOW) -> Iterator[tuple[int, tuple]]:
    """The rows, of every ``size`` the longest first."""
    while held := list(islice(rows, size)):
        yield from sorted(held, key=lambda x: -x[0])


def cut(n: int, capacity: int) -> list[int]:
    """Bounds of the pieces of a document of n ids: all but the first have ``capacity``."""
    first = n - (-(-n // capacity) - 1) * capacity
    return [0, *range(first, n + 1, capacity)]


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    """The tokenizer file as tiktoken's ranks, once for a worker."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, split = file["model"], file["pre_tokenizer"] or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"] and not file["normalizer"]
    ids = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if not plain or model["type"] != "BPE" or ids != sorted(ids) or ids[0] < 256:
        raise ValueError(f"{path} isn't byte-level BPE whose ids are in the order of its merges")
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    ranks = {bytes(map(byte.__getitem__, token)): i for token, i in model["vocab"].items() if token not in special}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def ids_of(enc: tiktoken.Encoding, text: str | None) -> np.ndarray:
    parts, start = [np.empty(0, np.uint32)], 0
    while text and start < len(text):
        cut_at = _CUT.search(text, start + LONG) if len(text) - start > LONG else None
        stop = cut_at.start() if cut_at else len(text)
        parts.append(enc.encode_to_numpy(text[start:stop], allowed_special="all"))
        start = stop
    return np.concatenate(parts)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int, with_ids: bool) -> Iterator[tuple[int, tuple]]:
    enc, end = encoding(path), np.array([end_id], np.uint32)
    for batch in batches:
        for part in pieces(batch):
            for key, text in zip(column(part, "key").to_pylist(), texts(part), strict=True):
                ids = np.concatenate([ids_of(enc, text), end]).astype("<u4")
                bounds = cut(len(ids), capacity)
                for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    own = ids[a:b]
                    yield b - a, (key, k, a, b - a, zlib.crc32(own), *([own.astype(np.int32)] if with_ids else []))


def _again(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int, tuple]]:
    for batch in batches:
        rows = zip(*(column(batch, c).to_pylist() for c in names), strict=True)
        yield from ((row[3], row) for row in rows)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of every piece, with its ``ids`` if asked for."""
    spark = docs.sparkSession
    importable(spark)
    names = [*list(_KIND)[:5], *(["ids"] if with_ids else [])]
    schema = "key long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long, open boolean"

    def packed(make, level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bins, base = Bins(capacity, open_bins), (level << 57) | (TaskContext.get().partitionId() << 32)
            out: list[tuple] = []

            def give() -> pa.RecordBatch:
                fields = list(zip(*out, strict=True))
                kinds = [*(_KIND[c] for c in names), pa.int64(), pa.int64(), pa.bool_()]
                out.clear()
                return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(fields, kinds, strict=True)], names=[*names, "sequence_id", "offset", "open"])

            def add(found: list, is_open: bool) -> None:
                out.extend((*row, base + number, offset, is_open) for number, rows in found for offset, row in rows)

            for length, row in windows(make(batches)):
                add(bins.put(length, row), False)
                if len(out) >= _ROWS:
                    yield give()
            for free, found in bins.rest():
                add([found], free > SLACK and not last)
                if len(out) >= _ROWS:
                    yield give()
            if out:
                yield give()

        return run

    asked = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    level = 0
    table, _ = saved(spark, asked.mapInArrow(packed(lambda b: _encoded(b, tokenizer_path, end_id, capacity, with_ids), 0, False), schema), "packed")
    closed = [table.where("not open")]
    tasks = table.where("open").agg(F.countDistinct(F.shiftright("sequence_id", 32))).first()[0]
    while tasks > 1 or not level:
        level, tasks = level + 1, -(-tasks // FAN_IN)
        rest = table.where("open").select(*names)
        rest = rest.repartition(tasks) if tasks > 1 else rest.coalesce(1)
        table, _ = saved(spark, rest.mapInArrow(packed(lambda b: _again(b, names), level, tasks == 1), schema), "packed")
        closed.append(table.where("not open"))
    found = closed[0]
    for more in closed[1:]:
        found = found.unionByName(more)
    return found.drop("open").withColumnRenamed("key", key)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of pack(with_ids=True): each sequence's pieces in the order of their places."""
    placed = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(placed, lambda x: x["ids"])).alias("ids"))


def gaps(packed: DataFrame) -> DataFrame:
    """Sequences whose pieces leave a gap, overlap or exceed the capacity; a good packing has none."""
    before = F.coalesce(F.sum("length").over(Window.partitionBy("sequence_id").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return packed.withColumn("_before", before).groupBy("sequence_id").agg(F.sum("length").alias("used"), F.max((F.col("offset") != F.col("_before")).cast("int")).alias("wrong")).where("wrong = 1")
