"""Shared parts: the shared work folder, Arrow text batches as byte arrays, and word hashes.

Texts are handled as UTF-8 bytes. A batch is cut into chunks of about a megabyte, so that the memory that numpy
needs doesn't follow the size of Spark's Arrow batches; only a single longer text makes a longer chunk.
"""

from __future__ import annotations

import contextlib
import ctypes
import inspect
import os
import tempfile
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers: dict[str, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session's spark.checkpoint.dir. Where the session names
    none, a local one is made on a local master; on a cluster that is an error, as executors wouldn't see it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"spanloom-{uuid.uuid4().hex[:8]}")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def free_name(name: str, *taken) -> str:
    """The name, with underscores before it until none of the columns or data frames has it, in any letter case."""
    used = {c.lower() for t in taken for c in (t.columns if isinstance(t, DataFrame) else [t])}
    while name.lower() in used:
        name = "_" + name
    return name


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: it is computed once and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trimmed(run):
    """The function for tasks, which at its end gives the memory that it has freed back to the system: a worker stays
    for tasks of other stages, and on an executor the JVM needs it then."""

    def back() -> None:
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
        pa.default_memory_pool().release_unused()

    def of_batches(batches):
        yield from run(batches)
        back()

    def of_group(pdf):
        out = run(pdf)
        back()
        return out

    return of_batches if inspect.isgeneratorfunction(run) else of_group


def held_out(column, remainder: int):
    """True where crc32(doc_id as text) mod 5 is the remainder; a null doc_id is never held out."""
    return F.coalesce(F.crc32(column.cast("string")) % 5 == remainder, F.lit(False))


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of pieces of a batch. Every text is followed by one space, so that no
    word spans two texts; text i is bytes[offsets[i] : offsets[i + 1] - 1]. Null texts count as empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    first = 0
    while first < n:
        done = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, done + limit, "right")))
        part = pc.binary_join_element_wise(texts.slice(first, end - first), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + end - first + 1]
        data = np.frombuffer(part.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        yield first, end, data, offsets - offsets[0]
        first = end


def refuse(columns: list[str], *added: str) -> None:
    """Raise if a column that is kept has the name of one that is added."""
    if taken := {c.lower() for c in columns} & set(added):
        raise ValueError(f"columns that are added: {sorted(taken)}")


def row_hash(*columns: str, seed: int = 0):
    """A hash that differs between equal rows, so that copies spread."""
    return F.xxhash64(*columns, F.lit(seed), F.monotonically_increasing_id())


def lowered(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES >> 1, clean=str.lower) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The same as `chunks`, in code points of lower-cased texts, or texts cleaned otherwise, instead of bytes."""
    texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "")
    first, n = 0, len(texts)
    while first < n:
        held, size, end = [], 0, first
        while end < n and (not held or size < limit):
            held.append(clean(texts[end].as_py()))
            size += len(held[-1]) + 1
            end += 1
        offsets = np.cumsum([0, *(len(t) + 1 for t in held)])
        yield first, end, np.frombuffer((" ".join(held) + " ").encode("utf-32-le", "surrogatepass"), np.uint32), offsets
        first = end


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    if n > len(_powers.get("up", ())):
        size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        for k, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: Lower-cases A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that white space alone divides: x20 and x09-x0D.
SOLID = np.ones(256, bool)
SOLID[[32, *range(9, 14)]] = False
#: Bytes of words of ASCII letters, digits and all characters beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs of true values; the last value is false."""
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    return edge[0::2], edge[1::2]


class Words:
    """The words of a chunk, whose last byte is in none: byte places, the text each belongs to, and a 64-bit hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SOLID):
        self.start, self.end = spans(kind[data])
        self.low = LOWER[data]
        up, self._down = _power(len(data) + 1)
        self._sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((self.low.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self._sum[1:])
        #: bounds[i] : bounds[i + 1] are the words of text i.
        self.bounds = np.searchsorted(self.start, offsets)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))
        self.hash = self.of(self.start, self.end)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the lower-cased bytes start:end."""
        return mix((self._sum[end] - self._sum[start]) * self._down[start])


def _kinds() -> np.ndarray:
    """Of every character: 1 within words (letters, digits, marks), 2 a word by itself, 0 between words."""
    kind = np.zeros(0x110000, np.uint8)
    kind[:0x33480] = [c.isalnum() or unicodedata.category(c)[0] == "M" for c in map(chr, range(0x33480))]
    for a, b in SINGLE:
        kind[a:b] *= 2
    return kind


#: Ranges of scripts without spaces between words (fixed values): Thai and Lao, Myanmar, Khmer, Kana, Han.
SINGLE = ((0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3040, 0x3100), (0x31F0, 0x3200), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x33480))
_kind: list[np.ndarray] = []


class AnyWords(Words):
    """The words of a lowered chunk: runs of letters, digits and marks of any script; in scripts without spaces every
    character is a word."""

    def __init__(self, codes: np.ndarray, offsets: np.ndarray):
        if not _kind:
            _kind.append(_kinds())
        kind = _kind[0][codes]
        run = kind == 1
        inner = np.zeros(len(run), bool)
        inner[1:] = run[1:] & run[:-1]
        self.start = np.flatnonzero((kind > 0) & ~inner)
        last = kind > 0
        last[:-1] &= ~inner[1:]
        self.end = np.flatnonzero(last) + 1
        up, self._down = _power(len(codes) + 1)
        self._sum = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self._sum[1:])
        self.bounds = np.searchsorted(self.start, offsets)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))
        self.hash = self.of(self.start, self.end)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of `size` words within a text; a text of fewer words has one, of all its words."""
    h, counts = words.hash, np.diff(words.bounds)
    n = len(h)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        part = np.zeros(n, np.uint64)
        if k < n:
            part[: n - k] = h[k:] * np.uint64((2 * k + 1) * 0xA24BAED4963EE407 & _MASK)
        # words past the end of the text don't count
        left = words.bounds[1:][words.text] - np.arange(n)
        part[left <= k] = 0
        out += part
    place = np.arange(n) - words.bounds[:-1][words.text]
    keep = (place <= np.maximum(counts - size, 0)[words.text])
    return mix(out[keep]), words.text[keep]
