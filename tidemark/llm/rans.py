"""Token ids as static range-coded blocks (operator 7).

A data set is a frequency table, shared by all blocks, and a table of blocks. A block holds whole
documents in ascending order of their keys. Its ids are coded by ``LANES`` interleaved range asymmetric
numeral systems: lane j has ids j, j + LANES, ...; states are 64 bits wide, and 32-bit words leave or
enter a state in lane order, so that one step of all lanes is one vector operation. Every
``CHECKPOINT`` steps the block keeps the lanes' states and its position among the words: any part
between two checkpoints can be decoded by itself. Blocks depend on nothing but the frequency table, and
carry the CRC-32 of their ids, which decoding verifies.

Texts are cut where no match of the tokenizer's pre-split pattern can span (before a blank or line end
after a character that isn't white space); each part that is new to a worker is encoded once by the
tokenizers library, many together with line ends between them, so the ids are those of the whole text. That holds for the literals of special tokens
too, which the library replaces by their ids wherever they stand: they have no white space.

The number of files grows with the bytes of text.

Defined results: a null or empty text has no ids but the end id; documents with a null key come first;
repeated keys keep all their rows; an empty table gives no blocks and an empty result; other columns of
the input play no part.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.common import by_batch, column, dropped, freed, importable, lists, pieces, saved

LANES, CHECKPOINT, SCALE_BITS = 512, 128, 20
#: Ids after which a block ends with the document; bytes of text in a file at most and at least, before there are as many as shuffle partitions.
BLOCK_IDS, MOST_BYTES, LEAST_BYTES = 1 << 18, 1 << 28, 1 << 22
_LOW = np.uint64(1) << np.uint64(31)
_HEAD = struct.Struct("<4sIIHBxII")
_MAGIC = b"TRN1"
#: Parts of texts that a worker keeps, their ids, and the longest part that it keeps.
_PARTS, _IDS, _LONGEST = 1_500_000, 8_000_000, 48
#: New parts that are encoded together.
_JOINED = 256
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: What \\s is to Python, for Arrow's regular expressions; texts in which a blank or line end isn't always a cut, or that end with a blank.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD = rf"{_SPACE}{_SPACE}|\x00| \z"


def frequencies(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Counts scaled to the sum 2**bits; what occurs keeps at least 1."""
    total, size = int(counts.sum()), 1 << bits
    if not total:
        return np.zeros(len(counts), np.int64)
    if np.count_nonzero(counts) > size:
        raise ValueError("more kinds of ids than the scale has places")
    f = np.where(counts > 0, np.maximum(1, counts * (size / total)).astype(np.int64), 0)
    order = np.lexsort((np.arange(len(f)), -f))
    while rest := size - int(f.sum()):
        if rest > 0:
            f[order[0]] += rest
        else:  # take from the largest what they can spare
            spare = np.minimum(f[order] - 1, np.maximum(1, f[order] >> 3)).clip(0)
            f[order] -= np.diff(np.minimum(np.cumsum(spare), -rest), prepend=0)
    return f


class Coder:
    """Codes and decodes blocks of ids by one frequency table."""

    def __init__(self, freq: np.ndarray, bits: int = SCALE_BITS, lanes: int = LANES, checkpoint: int = CHECKPOINT):
        self.bits, self.lanes, self.checkpoint = bits, lanes, checkpoint
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.kind = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray) -> bytes:
        bits, lanes = np.uint64(self.bits), self.lanes
        steps = -(-len(ids) // lanes)
        f, s = self.freq[ids], self.start[ids]
        if len(ids) and not f.all():
            raise ValueError("an id that the frequency table lacks")
        x = np.full(lanes, _LOW, np.uint64)
        words, states = [np.empty(0, np.uint32)] * steps, []
        for t in range(steps - 1, -1, -1):
            ft, st = f[t * lanes : (t + 1) * lanes], s[t * lanes : (t + 1) * lanes]
            y = x[: len(ft)]
            full = y >= ft << np.uint64(63 - self.bits)
            words[t] = y[full].astype(np.uint32)
            y[full] >>= np.uint64(32)
            q = y // ft
            y[:] = (q << bits) + (y - q * ft) + st
            if t % self.checkpoint == 0:
                states.append(x.copy())
        at = np.concatenate([[0], np.cumsum([len(w) for w in words])])[: steps + 1][:: self.checkpoint][: len(states)].astype(np.uint32)
        head = _HEAD.pack(_MAGIC, len(ids), self.checkpoint, lanes, self.bits, len(states), zlib.crc32(ids.astype("<u4").tobytes()))
        return b"".join([head, at.astype("<u4").tobytes(), np.array(states[::-1], "<u8").tobytes(), *(w.astype("<u4").tobytes() for w in words)])

    def decode(self, block: bytes, part: int | None = None) -> np.ndarray:
        """The block's ids (verified), or those from checkpoint ``part`` to the next."""
        magic, n, checkpoint, lanes, bits, parts, crc = _HEAD.unpack_from(block)
        if magic != _MAGIC or bits != self.bits:
            raise ValueError("not a block of this coder")
        at = np.frombuffer(block, "<u4", parts, _HEAD.size)
        states = np.frombuffer(block, "<u8", parts * lanes, _HEAD.size + 4 * parts).reshape(parts, lanes)
        words = np.frombuffer(block, "<u4", offset=_HEAD.size + 4 * parts + 8 * parts * lanes).astype(np.uint64)
        found = [self._part(n, checkpoint, lanes, k, states[k].copy(), words[at[k] :]) for k in (range(parts) if part is None else [part])]
        ids = np.concatenate([np.empty(0, np.uint32), *found])
        if part is None and (len(ids) != n or zlib.crc32(ids.astype("<u4").tobytes()) != crc):
            raise ValueError("a block's checksum doesn't fit its ids")
        return ids

    def _part(self, n: int, checkpoint: int, lanes: int, k: int, x: np.ndarray, words: np.ndarray) -> np.ndarray:
        low, bits, pos = np.uint64((1 << self.bits) - 1), np.uint64(self.bits), 0
        first, end = k * checkpoint * lanes, min(n, (k + 1) * checkpoint * lanes)
        out = np.empty(end - first, np.uint32)
        for i in range(first, end, lanes):
            y = x[: min(lanes, end - i)]
            slot = y & low
            kind = self.kind[slot]
            out[i - first : i - first + len(y)] = kind
            y[:] = self.freq[kind] * (y >> bits) + slot - self.start[kind]
            need = np.flatnonzero(y < _LOW)
            y[need] = (y[need] << np.uint64(32)) | words[pos : pos + len(need)]
            pos += len(need)
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Tokenizer.from_file(path)


class Parts:
    """Ids of texts by their parts, each new part being encoded once; one flat store of ids, with a place for each part.

    When the store is full, the parts stay that have come again since it was last made room in.
    """

    def __init__(self, path: str, end_id: int):
        self.encode, self.end = tokenizer(path), end_id
        self.kind = np.dtype("<u2" if max(self.encode.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        line = self.encode.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self._clear()

    def _clear(self) -> None:
        self.rows = pa.array([""])
        self.ids, self.used = np.zeros(1 << 16, self.kind), 1
        self.ids[0] = self.end
        self.at, self.n, self.again = np.zeros(1 << 16, np.int64), np.ones(1 << 16, np.int64), np.zeros(1 << 16, bool)
        self.count = 1

    def _trim(self) -> None:
        """Leaves the end id and the parts that came again; nothing else, if those fill half of the store."""
        again = self.again[: self.count]
        again[0] = True
        at, n = self.at[: self.count][again], self.n[: self.count][again]
        used, count = int(n.sum()), len(n)
        if count > _PARTS // 2 or used > _IDS // 2:
            return self._clear()
        upto = np.cumsum(n)
        ids = self.ids[np.repeat(at - (upto - n), n) + np.arange(used)]
        rows = self.rows.filter(pa.array(again))
        self._clear()
        self._grow(count, used)
        self.rows = rows
        self.ids[:used], self.at[:count], self.n[:count] = ids, upto - n, n
        self.used, self.count = used, count

    def _grow(self, count: int, ids: int) -> None:
        """Makes room for so many more."""
        if self.used + ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(ids, len(self.ids)), self.kind)])
        if self.count + count > len(self.at):
            more = max(count, len(self.at))
            self.at, self.n, self.again = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.at, self.n, self.again))

    @staticmethod
    def _cut(text: str) -> list[str]:
        """Keys of an odd text's parts, and the empty key."""
        return [x if x[0] == "\n" else x[1:] if x[0] == " " and "\n" not in x and x[1:2] not in ("", "\0") else "\0" + x for x in _CUT.split(text)] + [""]

    def keys(self, found: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Keys of all texts' parts, each text's with the empty key at its end, and how many each has.

        A key that begins with NUL is literal, one with a line end too, others lack their blank.
        """
        found = pc.fill_null(found.cast(pa.string()), "")
        parts = pc.split_pattern(pc.binary_join_element_wise("\0", pc.replace_substring(found, "\n", " \n"), " ", ""), " ")
        odd = np.flatnonzero(pc.match_substring_regex(found, _ODD).to_numpy(zero_copy_only=False))
        if len(odd):
            of = np.arange(len(found))
            of[odd] = len(found) + np.arange(len(odd))
            parts = pa.concat_arrays([parts, pa.array([self._cut(x) for x in found.take(pa.array(odd)).to_pylist()], parts.type)]).take(pa.array(of))
        return parts.flatten(), pc.list_value_length(parts).to_numpy()

    def _encoded(self, new: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """The parts' ids, one after another, and how many each has.

        Parts with a blank (``plain``) are encoded together with line ends between them, each of which is an id of its own: no match spans them.
        """
        if self.line is not None and plain:
            joined = [" " + "\n ".join(new[i : i + _JOINED]) + "\n" for i in range(0, len(new), _JOINED)]
            flat = np.concatenate([np.array(self.encode.encode_batch_fast([x], add_special_tokens=False)[0].ids, np.int32) for x in joined])
            ends = np.flatnonzero(flat == self.line)
            if len(ends) == len(new):
                return flat[flat != self.line], np.diff(ends, prepend=-1) - 1
        found = [e.ids for e in self.encode.encode_batch_fast([k[1:] if k[0] == "\0" else k if k[0] == "\n" else " " + k for k in new], add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.int64, int(n.sum())), n

    def _add(self, new: list[str]) -> None:
        """Ids of the parts whose rows come next."""
        plain = np.array([k[0] not in "\0\n" for k in new])
        self._grow(len(new), 0)
        for some in (plain, ~plain):
            at = np.flatnonzero(some)
            if not len(at):
                continue
            ids, n = self._encoded([new[k] for k in at.tolist()], some is plain)
            self._grow(len(new), len(ids))
            self.ids[self.used : self.used + len(ids)] = ids
            self.at[self.count + at], self.n[self.count + at] = self.used + np.cumsum(n) - n, n
            self.used += len(ids)
        self.count += len(new)

    def _keep(self, new: pa.Array) -> None:
        """Keeps the parts that were added last, but for long ones: they hardly come again."""
        short = pc.less_equal(pc.utf8_length(new), _LONGEST).to_numpy(zero_copy_only=False)
        rows = slice(self.count - len(new), self.count)
        at, n = self.at[rows][short], self.n[rows][short]
        self.count = rows.start + len(at)
        self.at[rows.start : self.count], self.n[rows.start : self.count] = at, n
        self.rows = pa.concat_arrays([self.rows, new.filter(pa.array(short))])

    def batch(self, found: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, one after another, and how many each has (with the end id)."""
        if self.count > _PARTS or self.used > _IDS:
            self._trim()
        flat, n_keys = self.keys(found if isinstance(found, pa.Array) else pa.array(found, pa.string()))
        row = pc.fill_null(pc.index_in(flat, value_set=self.rows), -1).to_numpy().copy()
        missing = np.flatnonzero(row < 0)
        self.again[row[row >= 0] if len(missing) else row] = True
        new = None
        if len(missing):
            coded = flat.take(pa.array(missing)).dictionary_encode()
            row[missing], new = self.count + coded.indices.to_numpy(), coded.dictionary
            self._add(new.to_pylist())
        n = self.n[row]
        upto = np.cumsum(n)
        size = int(upto[-1]) if len(upto) else 0
        kind = np.int32 if max(size, len(self.ids)) < 1 << 31 else np.int64
        place = np.repeat((self.at[row] - (upto - n)).astype(kind), n)
        place += np.arange(size, dtype=kind)
        ids = self.ids[place]
        if new is not None:
            self._keep(new)
        return ids, np.diff(np.concatenate([[0], upto])[np.cumsum(n_keys)], prepend=0)


@lru_cache(maxsize=1)
def parts_of(path: str, end_id: int) -> Parts:
    """A worker process's parts, kept from task to task."""
    return Parts(path, end_id)


def _ids(data: pa.BinaryScalar, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), kind)


def blocks(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text", files: int | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Raw blocks in ascending order of the key: (file, block, start: long, keys, lengths, ids: binary), start within the file."""
    spark = docs.sparkSession
    if not files:
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        files = max(1, -(-size // MOST_BYTES), min(-(-size // LEAST_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ordered = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).repartitionByRange(files, "k").sortWithinPartitions("k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, file, block, start = parts_of(path, end_id), TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []

        def out():
            nonlocal held, block, start
            keys, lengths, ids = pa.concat_arrays([k for k, _, _ in held]), np.concatenate([n for _, n, _ in held]), np.concatenate([i for _, _, i in held])
            row = pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (keys, pa.array(lengths, pa.int64()))), pa.array([ids.tobytes()])],
                names=["file", "block", "start", "keys", "lengths", "ids"],
            )
            block, start, held = block + 1, start + len(ids), []
            return row

        for batch in batches:
            for piece in pieces(batch):
                ids, n = parts.batch(column(piece, "t"))
                upto, i = np.concatenate([[0], np.cumsum(n)]), 0
                while i < len(n):  # up to the document that fills the block
                    room = block_ids - sum(len(x) for _, _, x in held)
                    j = min(len(n), int(np.searchsorted(upto, upto[i] + room)))
                    held.append((column(piece, "k").slice(i, j - i), n[i:j], ids[upto[i] : upto[j]]))
                    if upto[j] - upto[i] >= room:
                        yield out()
                    i = j
        if held:
            yield out()

    importable(spark)
    return ordered.mapInArrow(run, "file int, block int, start long, keys array<long>, lengths array<long>, ids binary")


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text", files: int | None = None) -> None:
    """The data set in ``folder``: ``frequencies`` (id, freq) and ``blocks`` (file, block, start, keys, lengths, code)."""
    spark: SparkSession = docs.sparkSession
    kind = Parts(tokenizer_path, end_id).kind
    raw, raw_path = saved(spark, blocks(docs, tokenizer_path, end_id, key, text, files), "raw")
    freed(spark)

    def make_counts():
        def run(batch):
            total = np.bincount(np.concatenate([np.empty(0, kind), *(_ids(x, kind) for x in column(batch, "ids"))]))
            ids = np.flatnonzero(total)
            return {"id": ids.astype(np.int64), "n": total[ids].astype(np.int64)}

        return run

    counted = by_batch(raw, ["ids"], make_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # one row for each id of the vocabulary
    counts = np.zeros(int(max(counted["id"].to_pylist(), default=-1)) + 1, np.int64)
    counts[counted["id"].to_numpy()] = counted["n"].to_numpy()
    freq = frequencies(counts)
    spark.createDataFrame(pa.table({"id": np.arange(len(freq)), "freq": freq})).coalesce(1).write.parquet(f"{folder}/frequencies")

    def make_code():
        coder = Coder(freq)

        def run(batch):
            same = {c: column(batch, c) for c in ("file", "block", "start", "keys", "lengths")}
            return same | {"code": pa.array([coder.encode(_ids(x, kind).astype(np.uint32)) for x in column(batch, "ids")], pa.binary())}

        return run

    by_batch(raw, raw.columns, make_code, "file int, block int, start long, keys array<long>, lengths array<long>, code binary").write.option("compression", "none").parquet(f"{folder}/blocks")
    dropped(spark, raw_path)


def read(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """(key, start, ids: array<int>) of every document, decoded from the blocks; start: ids before it in the data set."""
    return _read(spark, folder, key, "ids array<int>", lambda ids, n: {"ids": lists(ids.astype(np.int32), n, pa.int32())})


def read_digests(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from its decoded ids."""

    def digest(ids: np.ndarray, n: np.ndarray) -> dict:
        data, at = ids.astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(4 * n)])
        return {"n_tokens": n, "ids_crc32": np.array([zlib.crc32(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], np.int64)}

    return _read(spark, folder, key, "n_tokens long, ids_crc32 long", digest)


def _read(spark: SparkSession, folder: str, key: str, more: str, give) -> DataFrame:
    table = spark.read.parquet(f"{folder}/frequencies").orderBy("id").toArrow()
    freq = table["freq"].to_numpy() if table.num_rows else np.zeros(0, np.int64)
    rows = spark.read.parquet(f"{folder}/blocks")
    sizes = rows.groupBy("file").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n")).orderBy("file").toArrow()  # one row for each file
    before = dict(zip(sizes["file"].to_pylist(), np.cumsum(sizes["n"].to_numpy()) - sizes["n"].to_numpy(), strict=True)) if sizes.num_rows else {}

    def make():
        coder = Coder(freq)

        def run(batch):
            parts = []
            for row in range(batch.num_rows):
                n = column(batch, "lengths")[row].values.to_numpy()
                ids = coder.decode(column(batch, "code")[row].as_buffer())
                start = before[column(batch, "file")[row].as_py()] + column(batch, "start")[row].as_py() + np.cumsum(n) - n
                parts.append(pa.RecordBatch.from_pydict({key: column(batch, "keys")[row].values, "start": start, **give(ids, n)}))
            whole = pa.Table.from_batches(parts).combine_chunks()
            return {c: whole[c].chunk(0) if whole.num_rows else pa.array([], whole[c].type) for c in whole.column_names}

        return run

    return by_batch(rows, ["file", "start", "keys", "lengths", "code"], make, f"{key} long, start long, {more}")
