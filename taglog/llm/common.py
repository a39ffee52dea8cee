"""Shared helpers of the corpus operators: Arrow text buffers, word hashing, table reads and checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; a single longer text is a step of its own.
STEP_BYTES = 2 << 20
#: Bytes that the word scanner hashes at once, whatever the length of a text or word.
PIECE = 1 << 20
#: Keys that ``join_counted`` broadcasts at most.
HOT_KEYS = 10_000

_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by whatever file system ``sf_dir`` names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only a local session without the setting gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "taglog-checkpoints"))


def scratch(spark: SparkSession, name: str) -> str:
    """A path that nothing uses yet, under the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder: lineage ends here and lost executors cost no recomputation.

    The shuffle files of the plan are deleted as soon as the checkpoint is written: nothing else reads them.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        fresh = df.select("*")  # a plan of its own, made under the setting
        return fresh.checkpoint(eager=True)
    finally:
        spark.conf.set(_CLEANUP, before)


def join_counted(rows: DataFrame, of: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` joined to ``of`` (one row a key, with how many of the ``total`` rows have it), whatever the skew.

    Keys with more than a ten-thousandth of the rows are joined by broadcast; at most ten thousand keys can have that
    many, which bounds it. The rest is joined by key, and no key of it has more rows than that.
    """
    bar = max(32, total // HOT_KEYS)
    hot = of.where(F.col(count) > bar)
    names = hot.select(key)
    cold = rows.join(F.broadcast(names), key, "left_anti").join(of.where(F.col(count) <= bar), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def random_table(seed: int, n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * _GOLD + np.uint64(seed))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, rows + 1) and UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    if len(col) == 0 or off is None:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], data[off[0] : off[-1]]


def steps(off: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, b
        a = b


_BASE = 0xD1342543DE82EF95  # odd, so invertible modulo 2**64
_POW: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    """base**i and base**-i modulo 2**64 for i <= PIECE."""
    if not _POW:
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.ones(PIECE + 1, np.uint64)
            done = 1
            while done <= PIECE:
                m = min(done, PIECE + 1 - done)
                out[done : done + m] = out[:m] * np.uint64(pow(b, done, 1 << 64))
                done += m
            _POW.append(out)
    return _POW


_BYTE = random_table(7, 256)


class Words:
    """The words of consecutive texts: 64-bit word hashes and where each text's words begin.

    ``keep`` is a 256-entry table giving, for each byte, the byte after lower-casing, or 0 for a separator.
    All of it is vectorised over bytes, in pieces that carry an unfinished word on, so that beside the words' own arrays
    a very long text or word costs no more than a piece; no text or word becomes a Python object.
    """

    def __init__(self, off: np.ndarray, data: np.ndarray, keep: np.ndarray) -> None:
        off = off - off[0]
        n = len(data)
        power, inverse = _power_tables()
        begins = off[:-1][off[:-1] < off[1:]]  # a text's first byte begins a word
        start, end, value = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        open_at, carry = -1, np.uint64(0)
        for a in range(0, n, PIECE):
            z = min(a + PIECE, n)
            m = z - a
            low = keep[data[a:z]]
            word = low != 0
            edge = begins[np.searchsorted(begins, a) : np.searchsorted(begins, z)] - a
            if open_at >= 0 and (not word[0] or len(edge) and edge[0] == 0):
                start.append(np.array([open_at]))
                end.append(np.array([a]))
                value.append(np.array([carry], np.uint64))
                open_at = -1
            s, e = word.copy(), np.zeros(m + 1, bool)
            s[1:] &= ~word[:-1]
            s[edge] |= word[edge]
            s[0] = word[0]  # or goes on from the piece before
            e[1:] = word
            e[1:m] &= ~word[1:]
            inner = edge[edge > 0]
            e[inner] |= word[inner - 1]
            first, last = np.flatnonzero(s), np.flatnonzero(e)
            total = np.zeros(m + 1, np.uint64)
            np.cumsum(_BYTE[low] * power[:m], out=total[1:])
            v = (total[last] - total[first]) * inverse[first]
            first, last = first + a, last + a
            if open_at >= 0:
                v[0] = np.uint64((int(carry) + int(v[0]) * pow(_BASE, a - open_at, 1 << 64)) % (1 << 64))
                first[0] = open_at
                open_at = -1
            if z < n and len(last) and last[-1] == z:
                open_at, carry = int(first[-1]), v[-1]
                first, last, v = first[:-1], last[:-1], v[:-1]
            start.append(first)
            end.append(last)
            value.append(v)
        self.start, self.end = np.concatenate(start), np.concatenate(end)
        self.hash = mix64(np.concatenate(value) + (self.end - self.start).astype(np.uint64))
        self.first = np.searchsorted(self.start, off)  # word index where each text begins; last entry: the end


def keep_table(separators: bytes) -> np.ndarray:
    """Byte table for ``Words``: A-Z lower-cased, the given bytes are separators, all else stands for itself."""
    keep = np.arange(256, dtype=np.uint8)
    keep[65:91] += 32
    keep[np.frombuffer(separators, np.uint8)] = 0
    return keep


#: ``[^\x20\x09-\x0D]+`` over lower-cased text. NUL is a word byte there and gets a stand-in that UTF-8 never holds.
SPACE_WORDS = keep_table(bytes([0x20, *range(0x09, 0x0E)]))
SPACE_WORDS[0] = 0xFF
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` over lower-cased text.
ALNUM_WORDS = keep_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): hashes of each text's n-word shingles in order, and where each text's shingles begin.

    A text of fewer words, but not none, has its whole word sequence as its one shingle.
    """
    w, first = words.hash, words.first
    count = np.diff(first)
    out_n = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    begin = np.zeros(len(count) + 1, np.int64)
    np.cumsum(out_n, out=begin[1:])
    out = np.zeros(begin[-1], np.uint64)
    text = np.repeat(np.arange(len(count)), out_n)
    at = first[:-1][text] + (np.arange(begin[-1]) - begin[:-1][text])
    full = count[text] >= n
    acc = np.zeros(int(full.sum()), np.uint64)
    for k in range(n):
        acc = mix64(acc * _GOLD + w[at[full] + k] + np.uint64(k + 1))
    out[full] = acc
    for i in np.flatnonzero((count > 0) & (count < n)):
        h = np.zeros(1, np.uint64)
        for k in range(int(count[i])):
            h = mix64(h * _GOLD + w[first[i] + k] + np.uint64(k + 1))
        out[begin[i]] = mix64(h + np.uint64(int(count[i]) + 1000))[0]
    return out, begin


def ids_of(batch: pa.RecordBatch, name: str = "doc_id") -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
