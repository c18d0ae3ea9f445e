"""Best-fit packing of tokenised texts into sequences under several capacities.

The tokeniser runs where the texts are; only the pieces' lengths and checksums move. Pieces are dealt into groups of
a bounded number of pieces, and each group is packed by itself: in order of falling length every piece goes to the
open bin that the rule picks among those that can hold it under every capacity. A group leaves about one sequence
that isn't full, so the loss is about one sequence in a thousand whatever the size of the corpus.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import free_name, materialize, refuse, row_hash, trimmed

#: Pieces packed together in one task.
GROUP_PIECES = 4096
_tokenizers: dict = {}


def _byte_level(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """Tokens of a byte-level vocabulary, written in its printable alphabet, as bytes."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(other)}
    return {bytes(byte[c] for c in token): k for token, k in vocabulary.items() if all(c in byte for c in token)}


def _tokenizer(path: str):
    """The function from a text to its ids. Where a file's merges are in the order of their ids, as in
    byte_bpe_50k.json, the same merges are applied by rank, which is some times as fast; ids are the same."""
    if path not in _tokenizers:
        import tiktoken
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        pre = model.get("pre_tokenizer") or {}
        merges = [x if isinstance(x, str) else " ".join(x) for x in model["model"].get("merges", [])]
        ids = [model["model"]["vocab"].get(x.replace(" ", "")) for x in merges]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not model.get("normalizer") and not model["model"].get("ignore_merges")
        if plain and ids == sorted(ids):
            special = {x["content"] for x in model.get("added_tokens", [])}
            ranks = _byte_level({k: v for k, v in model["model"]["vocab"].items() if k not in special})
            encoding = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            _tokenizers[path] = encoding.encode_ordinary
        else:
            _tokenizers[path] = lambda x: t.encode(x, add_special_tokens=False).ids
    return _tokenizers[path]


#: The split of a byte-level tokeniser, with possessive repeats (fixed value).
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def encode(texts: list[str], path: str) -> Iterator[bytes]:
    """The ids of each whole text, as little-endian unsigned 32-bit numbers."""
    ids = _tokenizer(path)
    for text in texts:
        yield array("I", ids(text)).tobytes()


def token_pieces(docs: DataFrame, tokenizer: str, max_tokens: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every text.

    Every text gets `end_id` at its end. Only texts longer than `max_tokens` are cut, into pieces of that length; the
    first piece takes the rest. A null text counts as empty and is one piece of the end id. Rows with a null or a
    repeated doc_id are kept as they are; other columns are dropped; an empty table gives an empty one."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            # rows in few slices, so that texts as Python strings stay few
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [x or "" for x in part.column(1).to_pylist()]
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), encode(texts, tokenizer), strict=True):
                    ids += end
                    n = len(ids) // 4
                    first = (n - 1) % max_tokens + 1
                    for k, begin in enumerate([0, *range(first, n, max_tokens)]):
                        stop = first if k == 0 else begin + max_tokens
                        rows.append((doc, k, begin, stop - begin, zlib.crc32(ids[4 * begin : 4 * stop])))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fit(items: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, tokens before) of each item, taken in the given order. items: a row for each, a column for each
    resource. rule `norm`: the bin whose weighted residual after the item has the smallest norm; `dot`: the bin with
    the largest weighted dot product of item and residual. Ties go to the oldest bin. An item that no open bin can
    hold under every capacity opens one; one beyond a capacity by itself has a bin of its own."""
    n, resources = items.shape
    size = np.asarray(items, np.float64) / capacity
    left = np.empty((n, resources))
    number = np.empty(n, np.int64)
    used = np.zeros(n, np.int64)
    out, before = np.empty(n, np.int64), np.zeros(n, np.int64)
    least = np.minimum.accumulate(items[::-1, 0])[::-1] / capacity[0]
    is_open = bins = 0
    for i in range(n):
        x = size[i]
        free = left[:is_open]
        can = np.flatnonzero((free[:, 0] >= x[0] - 1e-12))
        if resources > 1 and len(can):
            can = can[(free[can, 1:] >= x[1:] - 1e-12).all(axis=1)]
        if len(can):
            rest = free[can] - x
            score = (weights * free[can] * -x).sum(axis=1) if rule == "dot" else (weights * rest * rest).sum(axis=1)
            at = can[np.argmin(score)]
        else:
            at, is_open = is_open, is_open + 1
            left[at], number[at] = 1.0, bins
            bins += 1
        left[at] -= x
        out[i], before[i] = number[at], used[number[at]]
        used[number[at]] += items[i, 0]
        if i + 1 < n and (left[at] + 1e-12 < np.r_[least[i + 1], np.full(resources - 1, 1e-12)]).any():
            is_open -= 1  # nothing that is left fits: the last open bin takes its place
            left[at], number[at] = left[is_open], number[is_open]
    return out, before


def pack(pieces: DataFrame, max_tokens: int = 2048, max_docs: int | None = None, max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4), rule: str = "norm", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces(doc_id, piece, length, ...).

    Capacities of a sequence: tokens, pieces (`max_docs`, default `max_tokens`) and attention cost, the sum of the
    squares of the pieces' lengths (`max_attention`, default `max_tokens` squared). A piece beyond a capacity by
    itself gets a sequence of its own. Order and ties: longer pieces first, then by doc_id (null first) and piece.
    Other columns stay, whatever their names, but for the two that are added, which are an error; equal rows spread
    over all groups. An empty table gives an empty one."""
    refuse(pieces.columns, "sequence_id", "offset")
    group = free_name("_group", pieces)
    pieces = materialize(pieces, "pieces")
    n = pieces.count()
    groups = max(1, round(n / group_pieces))
    capacity = np.array([max_tokens, max_docs or max_tokens, max_attention or max_tokens**2], np.float64)
    w = np.array(weights, np.float64)

    @trimmed
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], na_position="first")
        length = pdf["length"].to_numpy(np.int64)
        bins, before = fit(np.stack([length, np.ones_like(length), length * length], axis=1), capacity, w, rule)
        return pdf.assign(sequence_id=pdf.pop(group).to_numpy(np.int64) * (1 << 32) + bins, offset=before)

    dealt = pieces.withColumn(group, F.pmod(row_hash("doc_id", "piece", "length"), F.lit(groups)))
    schema = f"{pieces._jdf.schema().toDDL()}, sequence_id long, offset long"
    return dealt.groupBy(group).applyInPandas(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, max_tokens: int = 2048, **options) -> DataFrame:
    """Tokenise and pack whole texts; see token_pieces and pack."""
    return pack(token_pieces(docs, tokenizer, max_tokens), max_tokens, **options)
