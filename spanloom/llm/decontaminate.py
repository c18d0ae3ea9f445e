"""Benchmark decontamination: passages of documents within a small edit distance of a benchmark item.

Candidates come from CGK embeddings. A random walk reads a sequence: at every step it writes down the symbol under it,
and random bits of step and symbol tell how far it moves on. Two sequences at a small edit distance fall into step again
after an edit, so their embeddings agree in most steps: edit distance becomes Hamming distance. Locality-sensitive
hashing samples a few steps of the embedding as a key.

Sequences of words are walked over item-sized windows. Items are put in classes of similar size; a window is as long as
the shortest item of its class. Windows of a text begin every few words, those of an item at each of its words, so some
pair of them always begins in the same place. Where characters are edited few words stay whole, so sequences of
characters are walked too, a short way from every character. How many walks a class takes is found by trying them on
every item of the benchmark, with words and with single characters edited at the limit, until the target recall is
reached or further walks find nothing new. The items are tried in tasks; the driver gets counts.

Keys are shared by chance often, so a candidate is then compared as a whole: the part of the text that the key lines up
must hold as many runs of four characters of the item, no further from their places than the edits can move them, as
the edits must leave whole, and the distances of the item's pieces, each the least anywhere near, must add up to the
limit at most. Both are bounds for any passage within the limit, so they lose none. What is left is verified exactly:
the least edit distance, in characters, between the item and any part of the text around.

The items' index goes to every task, in blocks of a bounded size; documents are only mapped, never shuffled.
"""

from __future__ import annotations

import logging
import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import AnyWords, free_name, lowered

#: Characters of benchmark items whose index is in a task at once; more items take more passes.
BLOCK_CHARS = 1_000_000
#: Steps sampled for a key, steps between them (for one key after the other), and keys of a window.
SAMPLES, APART, KEYS = 2, (1, 2, 3), 16
#: Walks that may find nothing new of an item's copies, one after the other, before it is tried no more.
IDLE = 4
#: Copies of each item with words edited and as many with characters edited, on which walks are tried.
COPIES = 8
#: Characters of the runs that are compared, and parts of a text's item-sized part that tell a run's place.
RUN, CELLS = 4, 32
#: Runs that are compared at once.
SLAB = 1 << 17
#: Pieces of items that are looked for at once; each has 64 characters at most, in a column by their lowest seven bits.
LANES, PIECE, LETTERS = 8192, 64, 128
#: Steps of a walk over characters.
KEY = 9
#: Windows that begin within an item's size.
STRIDES = 4
#: Windows of a text that walk at once.
PART = 1 << 15


def normal(text: str) -> str:
    """Lower case, and single spaces for all white space."""
    return " ".join(text.lower().split())


def edit_distance_within(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance between the pattern and any part of the text, end of the first such part), by the
    bit-parallel columns of Myers, in Python's long integers."""
    m = len(pattern)
    if not m:
        return 0, 0
    places: dict[str, int] = {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, at = m, 0
    for j, c in enumerate(text):
        eq = places.get(c, 0)
        x = eq | down
        d0 = ((((x & up) + up) ^ up) | x) & full
        plus = down | (full & ~(d0 | up))
        minus = up & d0
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = (plus << 1) & full
        up = ((minus << 1) & full) | (full & ~(d0 | plus))
        down = plus & d0
        if score < best:
            best, at = score, j + 1
    return best, at


def size_class(words: int) -> int:
    """The shortest item of the class of an item: any size below eight, then 8, 32, 128 and so on."""
    return words if words < 8 else 8 * 4 ** ((words // 8).bit_length() - 1 >> 1)


class Walk:
    """One random walk over windows of `size` words, and the steps that its keys sample."""

    def __init__(self, size: int, seed: int):
        rng = np.random.default_rng([size, seed])
        samples = min(SAMPLES, size)
        self.steps = 2 * size
        self.stride = max(1, size // STRIDES)
        self.odd = rng.integers(0, 1 << 31, self.steps, np.uint32) * np.uint32(2) + np.uint32(1)
        last = max(0, self.steps - 1 - max(APART) * (samples - 1))
        begins = np.unique(np.linspace(0, last, min(KEYS, 2 * size)).astype(int))
        self.samples = [[min(b + APART[j % len(APART)] * k, self.steps - 1) for k in range(samples)] for j, b in enumerate(begins.tolist())]
        self.factors = rng.integers(0, 1 << 62, (len(begins), samples), np.uint64) * np.uint64(2) + np.uint64(1)

    def keys(self, symbols: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each key of a window (key, place of its last word, whether it holds): symbols are words, each text
        followed by a 0. A key that samples a word twice or reaches the text's end doesn't hold."""
        at = starts.astype(np.intp)
        wanted: dict[int, list[tuple[int, int]]] = {}
        for key, steps in enumerate(self.samples):
            for k, step in enumerate(steps):
                wanted.setdefault(step, []).append((key, k))
        value: list = [np.uint64(0)] * len(self.samples)
        before: list = [-1] * len(self.samples)
        good: list = [True] * len(self.samples)
        for step in range(max(wanted) + 1):
            word = symbols.take(at, mode="clip")
            for key, k in wanted.get(step, ()):
                value[key] = value[key] + word * self.factors[key, k]
                good[key] = good[key] & (at > before[key])
                before[key] = at
            # a 0 never moves on
            at = at + ((word * self.odd[step]) >> np.uint32(31)).view(np.int32)
        return [(v, b, g & (symbols.take(b) != 0)) for v, b, g in zip(value, before, good, strict=True)]


class Table:
    """The keys of a class's items under one walk: sorted keys with items and places, and a bitmap before them."""

    def __init__(self, walk: Walk, items: list[np.ndarray], numbers: list[int]):
        self.walk = walk
        symbols = np.concatenate([np.r_[x, np.uint32(0)] for x in items])
        length = np.array([len(x) for x in items])
        first = np.cumsum(length + 1) - length - 1
        owner = np.repeat(np.arange(len(items)), length)
        starts = np.concatenate([f + np.arange(n) for f, n in zip(first, length, strict=True)])
        found = walk.keys(symbols, starts)
        key = np.concatenate([np.where(g, v + np.uint64(k), 0)[g] for k, (v, _, g) in enumerate(found)])
        item = np.concatenate([owner[g] for _, _, g in found])
        place = np.concatenate([(b - first[owner])[g] for _, b, g in found])
        order = np.argsort(key, kind="stable")
        self.key, self.place, self.item = key[order], place[order].astype(np.int32), np.array(numbers, np.int32)[item[order]]
        self.shift = np.uint64(64 - min(24, max(12, math.ceil(math.log2(24 * len(key) + 1)))))
        self.there = np.zeros(1 << (64 - int(self.shift)), bool)
        self.there[(self.key >> self.shift).astype(np.int64)] = True

    def candidates(self, symbols: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, place of a word in symbols, that word's place in the item) of windows with an item's key."""
        for k, (value, at, good) in enumerate(self.walk.keys(symbols, starts)):
            value = value + np.uint64(k)
            hit = np.flatnonzero(self.there.take((value >> self.shift).view(np.int64)) & good)
            value, at = value[hit], at[hit]
            low = np.searchsorted(self.key, value)
            n = np.searchsorted(self.key, value, "right") - low
            entry = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield self.item[entry], np.repeat(at, n), self.place[entry]


def words_edited(text: str, share: float, rng: np.random.Generator) -> str:
    """The text with so many of its words, at random, left out, replaced, or with another before them, but for words
    whose edit would take more characters than the share of the text's has left."""
    words = text.split()
    left = int(share * len(text) + 1e-9)
    edits = {}
    for place in rng.permutation(len(words))[: int(share * len(words) + 1e-9)].tolist():
        kind = int(rng.integers(3))
        cost = len(words[place]) + (kind != 1)
        if cost <= left:
            left -= cost
            edits[place] = kind
    for place in sorted(edits, reverse=True):
        other = "".join(chr(97 + int(c)) for c in rng.integers(0, 26, len(words[place])))
        words[place : place + 1] = ([], [other], [other, words[place]])[edits[place]]
    return " ".join(words)


def characters_edited(text: str, share: float, rng: np.random.Generator) -> str:
    """The text with so many of its characters, at random, left out, replaced, or with another after them."""
    chars = list(text)
    for place in rng.choice(len(chars), int(share * len(chars) + 1e-9), replace=False).tolist():
        other = "qxz"[int(rng.integers(3))]
        chars[place] = ("", other, chars[place] + other)[int(rng.integers(3))]
    return "".join(chars)


def normalised(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, characters, offsets) of pieces of the texts in their normal form."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    for first, _, codes, offsets in lowered(batch, clean=normal):
        yield first, codes, offsets


def words_of(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The words of texts as 32-bit symbols, none of them 0, and where they begin in the normal form."""
    symbol, start = [], []
    for _, codes, offsets in normalised(texts):
        w = AnyWords(codes, offsets)
        symbol += np.split(symbols(w), w.bounds[1:-1])
        start += np.split(w.start - offsets[w.text], w.bounds[1:-1])
    return symbol, start


def symbols(words: AnyWords) -> np.ndarray:
    return (words.hash >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def mixed(hashes: np.ndarray) -> np.ndarray:
    hashes ^= hashes >> np.uint32(15)
    hashes *= np.uint32(0x85EBCA77)
    return hashes


def runs(codes: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the run of RUN characters at every place."""
    out = np.zeros(len(codes), np.uint32)
    for k in range(min(RUN, len(codes))):
        out[: len(codes) - k] += codes[k:] * np.uint32(pow(0x9E3779B1, k + 1, 1 << 32))
    return mixed(out)


class Characters:
    """One random walk over characters, from every place: at each of KEY steps it writes down the character under it and
    moves on by one, or by two for one in four of steps and characters. All that it wrote is the key. For items, sorted
    keys with items and places, and a bitmap before them."""

    def __init__(self, seed: int, items: list[np.ndarray], numbers: list[int]):
        self.odd = np.random.default_rng([KEY, seed]).integers(0, 1 << 31, KEY, np.uint32) * np.uint32(2) + np.uint32(1)
        walked = [self.keys(x) for x in items]
        places = [np.flatnonzero(end <= len(x)) for x, (_, end) in zip(items, walked, strict=True)]
        key = np.concatenate([k[p] for (k, _), p in zip(walked, places, strict=True)])
        order = np.argsort(key, kind="stable")
        self.key, self.place = key[order], np.concatenate(places)[order]
        self.item = np.repeat(np.array(numbers, np.int64), [len(p) for p in places])[order]
        self.shift = np.uint32(32 - min(26, max(12, math.ceil(math.log2(16 * len(key) + 1)))))
        self.there = np.zeros(1 << (32 - int(self.shift)), bool)
        self.there[self.key >> self.shift] = True

    def keys(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, place after the last character) of the walk from every place."""
        at = np.arange(len(codes), dtype=np.int32)
        out = np.zeros(len(codes), np.uint32)
        for k in range(KEY if len(codes) else 0):
            c = codes.take(at, mode="clip")
            out += c * np.uint32(pow(0x9E3779B1, k + 1, 1 << 32))
            at += 1
            at += (c * self.odd[k]) >> np.uint32(30) == 3
        return mixed(out), at

    def candidates(self, codes: np.ndarray, starts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place in the text, place in the item) of equal keys, of walks from the first so many places."""
        key = self.keys(codes)[0][:starts]
        at = np.flatnonzero(self.there.take(key >> self.shift))
        low = np.searchsorted(self.key, key[at])
        n = np.searchsorted(self.key, key[at], "right") - low
        entry = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.item[entry], np.repeat(at, n), self.place[entry]


class Plan(NamedTuple):
    """Of a class of items: how many walks it takes, and which shares of the copies with words and with characters
    edited these found on trial."""

    walks: int
    words: float = 0.0
    characters: float = 0.0


def tried(text: str, size: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of an item's copies, edited at random over (1 - similarity) of their words or characters, whether characters were
    edited, and the first walk that finds each: -1 if none does before IDLE walks in a row find no more."""
    plain = normal(text)
    rng = np.random.default_rng([size, zlib.crc32(plain.encode("utf-8", "surrogatepass"))])
    begin, copies = [], []
    for edit in (words_edited, characters_edited):
        for _ in range(COPIES):
            before, after = ("x" + "".join("abcdefghijklmnopqrstuvwxyz     "[c] for c in rng.integers(0, 31, 4 * size).tolist()) for _ in range(2))
            begin.append(len(normal(before)) + 1)
            copies.append(normal(f"{before} {edit(plain, 1 - similarity, rng)} {after}"))
    start, walk = np.array(begin), np.full(len(copies), -1)
    k = idle = 0
    while idle < IDLE and (walk < 0).any():
        index, known = Index([text], similarity, {size: Plan(1)}, first=k), (walk >= 0).sum()
        for first, codes, offsets in normalised(copies):
            for copy, _, at in index.hits(AnyWords(codes, offsets), codes, offsets):
                # one that begins elsewhere may have it by chance
                good = copy[np.abs(at - offsets[copy] - start[first + copy]) <= index.edits[0]] + first
                walk[good[walk[good] < 0]] = k
        k += 1
        idle = 0 if (walk >= 0).sum() > known else idle + 1
    return np.arange(len(copies)) >= COPIES, walk


def trials(texts: DataFrame, similarity: float, parts: int) -> DataFrame:
    """size, characters, walk and count: of the copies of all items of a class, with words or with characters edited,
    how many each walk is the first to find; those that none finds at -1. Every item is tried, in so many parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            sizes = [size_class(len(x)) if len(x) else 0 for x in words_of(own)[0]]
            for text, size in zip(own, sizes, strict=True):
                if size:
                    characters, walk = tried(text, size, similarity)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(walk), size)), pa.array(characters), pa.array(walk)], ["size", "characters", "walk"])

    return texts.select("text").repartition(parts, "text").mapInArrow(run, "size long, characters boolean, walk long").groupBy("size", "characters", "walk").count()


def plans(texts: DataFrame, similarity: float, recall: float, parts: int) -> dict[int, Plan]:
    """The plan of each class of items, tried on all of them: the fewest walks that find `recall` of the copies with
    words, and of those with characters, edited at the limit. Where none do, all walks that find any."""
    counts: dict[int, tuple[dict[int, int], dict[int, int]]] = {}
    for size, characters, walk, n in trials(texts, similarity, parts).collect():
        counts.setdefault(size, ({}, {}))[characters][walk] = n
    out = {}
    for size, kinds in sorted(counts.items()):
        for walks in range(1, max(2, 2 + max(w for kind in kinds for w in kind))):
            out[size] = Plan(walks, *(sum(n for w, n in kind.items() if 0 <= w < walks) / sum(kind.values()) for kind in kinds))
            if min(out[size][1:]) >= recall:
                break
        else:
            logging.getLogger(__name__).warning("items of %d words or more: %.2f of copies with words and %.2f with characters edited at the limit are found", size, *out[size][1:])
    return out


class Index:
    """Tables of benchmark items, for each class and walk, and the runs of characters of each."""

    def __init__(self, texts: list[str], similarity: float, plan: dict[int, Plan], first: int = 0):
        self.normal = [normal(x) for x in texts]
        self.edits = np.array([int((1 - similarity) * len(x) + 1e-9) for x in self.normal])
        words, starts = words_of(texts)
        self.start = np.concatenate([np.zeros(0, np.int64), *starts])
        self.first = np.cumsum([0, *map(len, words)])
        codes_of = [codes[a : b - 1] for _, codes, offsets in normalised(texts) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        self.size = np.array([len(x) for x in codes_of], np.int64)
        # runs of a part that can hold the item, and how many of them are the item's own at least
        self.span = np.maximum(1, self.size - RUN + 1 + 2 * self.edits)
        self.least = self.size - RUN + 1 - RUN * self.edits
        self.margin = int((self.span + self.size).max(initial=0)) + RUN
        self.cell = np.array([max(0, math.ceil(math.log2(n / CELLS))) for n in self.span.tolist()], np.int64)
        bits = [max(10, math.ceil(math.log2(16 * max(1, n)))) for n in self.size.tolist()]
        self.shift = np.array([32 - b for b in bits], np.int64)
        self.base = np.cumsum([0, *(1 << b for b in bits)])
        # of each run, the cells in which edits can leave it
        self.cells = np.zeros(int(self.base[-1]), np.uint32)
        pieces = -(-self.size // PIECE)
        self.piece = np.cumsum(np.r_[0, pieces])
        # where the pieces begin in their items, their sizes, and the bits of their characters
        self.begin, self.length = np.zeros((2, int(self.piece[-1])), np.int64)
        self.columns = np.zeros(int(self.piece[-1]) * LETTERS, np.uint64)
        for i, x in enumerate(codes_of):
            own = runs(x)[: max(0, len(x) - RUN + 1)]
            p = np.arange(len(own))
            low, high = (q.astype(np.uint64) for q in (p >> self.cell[i], p + 2 * self.edits[i] >> self.cell[i]))
            np.bitwise_or.at(self.cells, self.base[i] + (own >> np.uint32(self.shift[i])), ((np.uint64(2) << high) - (np.uint64(1) << low)).astype(np.uint32))
            edge = np.arange(pieces[i] + 1) * len(x) // max(1, pieces[i])
            which = slice(self.piece[i], self.piece[i + 1])
            self.begin[which], self.length[which] = edge[:-1], np.diff(edge)
            at = np.repeat(np.arange(pieces[i]), np.diff(edge))
            np.bitwise_or.at(self.columns, (self.piece[i] + at) * LETTERS + (x & np.uint32(LETTERS - 1)), np.uint64(1) << (np.arange(len(x)) - edge[at]).astype(np.uint64))
        classes: dict[int, list[int]] = {}
        for i, x in enumerate(words):
            if len(x):
                classes.setdefault(size_class(len(x)), []).append(i)
        self.tables = [Table(Walk(size, first + k), [words[i] for i in own], own) for size, own in sorted(classes.items()) for k in range(plan[size].walks)]
        self.characters = []
        for k in range(max((plan[size].walks for size in classes), default=0)):
            own = sorted(i for size, own in classes.items() if k < plan[size].walks for i in own)
            self.characters.append(Characters(first + k, [codes_of[i] for i in own], own))

    def near(self, item: np.ndarray, begin: np.ndarray, run: np.ndarray) -> np.ndarray:
        """Whether parts of texts hold as many runs of these items, at places where edits can leave them, as the edits
        must leave; the items begin at these characters if no edit came before. Every edit spoils RUN runs at most."""
        out, a = np.zeros(len(item), bool), 0
        while a < len(item):
            own = item[a : a + max(1, SLAB // int(self.span[item[a]]))]
            own = own[: max(1, SLAB // int(self.span[own].max()))]
            part = slice(a, a + len(own))
            # equal ones follow each other
            new = np.r_[True, own[1:] != own[:-1]]
            items, which = own[new], np.cumsum(new) - 1
            width = int(self.span[items].max())
            cell = np.arange(width) >> self.cell[items][:, None]
            # none past the item's part
            bit = (cell < CELLS) * (np.uint32(1) << np.minimum(cell, CELLS - 1).astype(np.uint32))
            at = np.lib.stride_tricks.sliding_window_view(run, width)[begin[part] - self.edits[own] + self.margin]
            at >>= self.shift[own][:, None]
            at += self.base[own][:, None]
            held = self.cells.take(at, mode="clip")
            held &= bit.take(which, axis=0)
            out[part] = np.bitwise_count(np.packbits(held != 0, axis=1)).sum(axis=1, dtype=np.int64) >= self.least[own]
            a += len(own)
        return out

    def padded(self, codes: np.ndarray) -> np.ndarray:
        """The runs of texts, with so many before and after that an item may begin or end outside."""
        return np.pad(runs(codes).astype(np.int64), self.margin)

    def within(self, item: np.ndarray, low: np.ndarray, high: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Whether the least distances of these items' pieces add up to the items' edits at most, each piece anywhere
        where edits can leave it; the items begin at characters low to high if no edit came before. The columns of
        edit_distance_within for many pieces at once. Characters of equal lowest bits count as equal."""
        n = np.diff(self.piece)[item]
        # some pieces are too far off already, mostly
        good = np.flatnonzero(self.distances(item, low, high, codes, (n + 1) // 2) <= self.edits[item])
        out = np.zeros(len(item), bool)
        out[good] = self.distances(item[good], low[good], high[good], codes, n[good]) <= self.edits[item[good]]
        return out

    def distances(self, item: np.ndarray, low: np.ndarray, high: np.ndarray, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The sums of the least distances of the first so many pieces of items."""
        lane = np.repeat(np.arange(len(item)), n)
        piece = np.arange(len(lane)) - np.repeat(np.cumsum(n) - n - self.piece[item], n)
        begin = (low - self.edits[item])[lane] + self.begin[piece]
        steps = self.length[piece] + (high - low + 2 * self.edits[item])[lane]
        letters, best = (codes & np.uint32(LETTERS - 1)).astype(np.uint8), np.zeros(len(lane), np.int64)
        order, one = np.argsort(steps, kind="stable"), np.uint64(1)
        for p in range(0, len(order), LANES):
            own = order[p : p + LANES]
            at, column, last = begin[own], piece[own] * LETTERS, (self.length[piece[own]] - 1).astype(np.uint64)
            up, down = np.full(len(own), ~np.uint64(0)), np.zeros(len(own), np.uint64)
            score = self.length[piece[own]]
            least = score.copy()
            done = 0
            for cut in range(0, len(own), LANES >> 4):
                # some go on past their ends, where they can only come nearer
                while done < steps[own[cut : cut + (LANES >> 4)][-1]]:
                    x = self.columns.take(letters.take(at, mode="clip") + column)
                    at += 1
                    x |= down
                    d0 = x & up
                    d0 += up
                    d0 ^= up
                    d0 |= x
                    plus = down | ~(d0 | up)
                    minus = up & d0
                    score += (plus >> last & one).view(np.int64)
                    score -= (minus >> last & one).view(np.int64)
                    np.minimum(least, score, out=least)
                    plus <<= one
                    minus <<= one
                    down = plus & d0
                    d0 |= plus
                    up = minus | ~d0
                    done += 1
                best[own[cut : cut + (LANES >> 4)]] = least[: LANES >> 4]
                at, column, last, up, down, score, least = (y[LANES >> 4 :] for y in (at, column, last, up, down, score, least))
        return np.bincount(lane, best, len(item))

    def hits(self, words: AnyWords, codes: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, item, character at which the item begins if no edit came before) of the parts of texts that have an
        item's key and enough of its runs."""
        n, texts = len(words.hash), len(words.bounds) - 1
        # a 0 after every text
        line = np.zeros(n + texts + 1, np.uint32)
        place = np.arange(n) + words.text
        line[place] = symbols(words)
        text_of = np.zeros(len(line), np.int64)
        text_of[place] = words.text
        run = self.padded(codes)
        for a in range(0, n if self.tables else 0, PART):
            seen = [h for t in self.tables for h in t.candidates(line, place[a : a + PART : t.walk.stride])]
            item, at, own = (np.concatenate(x).astype(np.int64) for x in zip(*seen, strict=True))
            text = text_of[at]
            yield self.alike(text, item, words.start[at - text] - self.start[self.first[item] + own], run)
        for a in range(0, len(codes) if self.characters else 0, 4 * PART):
            seen = [walk.candidates(codes[a : a + 4 * PART + 2 * KEY], 4 * PART) for walk in self.characters]
            item, at, own = (np.concatenate(x) for x in zip(*seen, strict=True))
            yield self.alike(np.searchsorted(offsets, at + a, "right") - 1, item, at + a - own, run)

    def alike(self, text: np.ndarray, item: np.ndarray, begin: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What `hits` gives, of these candidates, each once."""
        _, one = np.unique((item << 34) + (begin + (1 << 33)), return_index=True)
        text, item, begin = text[one], item[one], begin[one]
        good = self.near(item, begin, run)
        return text[good], item[good], begin[good]

    def candidates(self, words: AnyWords, codes: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first and last character at which the item begins if no edit came before) of the parts of texts
        that hold a passage, or that are left to be verified one by one."""
        seen = [h for h in self.hits(words, codes, offsets) if len(h[0])]
        if not seen:
            return
        text, item, at = np.unique(np.stack([np.concatenate(x) for x in zip(*seen, strict=True)], axis=1), axis=0).T
        new = np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (at[1:] - at[:-1] > 2 * self.edits[item[1:]])]
        # a long row of them is cut, so that none is much longer than the item
        start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        row = (at - at[start]) // (2 * self.edits[item] + 1)
        new[1:] |= row[1:] != row[:-1]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(at)] - 1
        text, item, low, high = text[first], item[first], at[first], at[last]
        good = self.within(item, low, high, codes)
        yield from zip(*(x[good].tolist() for x in (text, item, low, high)), strict=True)


def _shared(grams: set[int], text: str) -> int:
    """How many places of a text begin a run of three characters of the set."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(c) < 3:
        return 0
    return sum(map(grams.__contains__, ((c[:-2] << 42) ^ (c[1:-1] << 21) ^ c[2:]).tolist()))


def _grams(text: str) -> set[int]:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return set(((c[:-2] << 42) ^ (c[1:-1] << 21) ^ c[2:]).tolist())


def _passages(docs: DataFrame, texts: list[str], similarity: float, plan: dict[int, Plan]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(texts, similarity, plan)
        grams: dict[int, set[int]] = {}
        for batch in batches:
            for first, _, codes, offsets in lowered(batch, clean=normal):
                words = AnyWords(codes, offsets)
                best: dict[tuple[int, int], tuple[int, int]] = {}
                for t, item, low, high in index.candidates(words, codes, offsets):
                    pattern, edits = index.normal[item], int(index.edits[item])
                    known = best.get((t, item), (edits + 1, 0))[0]
                    # as far as the edits can shift either end; around a passage, as far as a better one can overlap it
                    for slack in (edits, edits + len(pattern)):
                        a, b = max(low - slack, int(offsets[t])), min(high + len(pattern) + slack, int(offsets[t + 1]) - 1)
                        if b <= a or not known:
                            break
                        part = codes[a:b].tobytes().decode("utf-32-le", "surrogatepass")
                        if item not in grams:
                            grams[item] = _grams(pattern)
                        # each edit spoils three runs of three characters at most
                        if _shared(grams[item], part) < len(pattern) - 2 - 3 * edits:
                            break
                        at = part.find(pattern)
                        distance, at = (0, at + len(pattern)) if at >= 0 else edit_distance_within(pattern, part)
                        if distance > edits:
                            break
                        if distance < known:
                            known = distance
                            best[t, item] = (distance, max(0, int(np.searchsorted(words.end, a + max(0, at - len(pattern)), "right")) - int(words.bounds[t])))
                if best:
                    rows = [(t + first, i, d, w, 1 - d / len(index.normal[i])) for (t, i), (d, w) in sorted(best.items())]
                    doc, item_id, distance, word, alike = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(item_id, pa.int64()), pa.array(word, pa.int64()), pa.array(distance, pa.int64()), pa.array(alike)], ["doc_id", "item_id", "word", "distance", "similarity"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, word long, distance long, similarity double")


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.92, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, word (about the number of the word at which the passage begins), distance and similarity for
    documents and benchmark items of which the document holds a passage whose edit distance from the whole item is
    (1 - similarity) of the item's characters at most; the best passage found of each pair.

    `recall` is the share of such passages to be found whose edits are scattered at random over (1 - similarity) of
    their words or of their characters; with fewer edits it is higher. All items are on trial; classes of them that miss
    it are logged as warnings, with the shares that they reach. Case and runs of white space don't count. Items
    that are null or without a word match nothing, and so do null and empty texts. Items of equal text are looked for
    once and reported each by its own id; rows with a null id keep it; repeated documents are taken row by row. Other
    columns are dropped, whatever their names; an empty table on either side gives an empty one."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    texts = items.select("text").distinct()
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    plan = plans(texts, similarity, recall, max(docs.sparkSession.sparkContext.defaultParallelism, 8 * blocks))
    out = None
    for k in range(blocks):
        # a block's size is bounded by block_chars, give or take the spread of a hash
        of_block = F.pmod(F.xxhash64("text"), F.lit(blocks)) == k
        rows = [r[0] for r in texts.where(of_block).orderBy(F.length("text"), "text").collect()]
        found = _passages(docs, rows, similarity, plan)
        named = docs.sparkSession.createDataFrame(list(enumerate(rows)), "number long, text string").join(items.where(of_block), "text").select("number", F.col("item_id").alias("own_id"))
        found = found.join(F.broadcast(named), found["item_id"] == F.col("number")).select("doc_id", F.col("own_id").alias("item_id"), "word", "distance", "similarity")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no passage of the benchmark; see contaminated. Rows with a null doc_id stay; other
    columns may have any names."""
    name = free_name("_id", docs)
    bad = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias(name)).where(F.col(name).isNotNull()).distinct()
    return docs.join(bad.hint("merge"), F.col("doc_id") == F.col(name), "left_anti")
