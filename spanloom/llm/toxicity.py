"""Toxicity scores with noisy-channel deobfuscation.

Words that look obfuscated (digits or symbols among letters, letters three times or more, letters spaced out, letters
of other scripts or without a width among them) are lattices of characters: each written character stands for some
letters, repeats stand for one or two, what stands between single letters for nothing. A Viterbi search finds the reading that is likeliest under a character trigram model of
the corpus and the channel's costs. Restored readings are added to the text's words, and a logistic regression on the
presence of hashed words and word beginnings scores it.

The character model is counted over all training texts. The regression is fitted in one task on a bounded sample of
labelled documents. Texts are only mapped.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import ALNUM, SOLID, Words, chunks, materialize, refuse, row_hash, spans, trimmed
from spanloom.llm.linear import logistic, sigmoid
from spanloom.llm.sampling import bounded

#: Letters that a written character may stand for (fixed values).
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "tl", "8": "b", "9": "gq",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "*": "aeiou", "(": "c", "<": "c", "#": "h", "€": "e",
}
SYMBOLS = 28  # 0: any border, 1 to 26: letters, 27: characters beyond ASCII
CLASS = np.zeros(256, np.int64)
CLASS[97:123] = np.arange(1, 27)
CLASS[65:91] = np.arange(1, 27)
CLASS[128:] = 27
BUCKETS = 1 << 18
#: Standard errors by which the shares of toxic and other documents with a feature must lie apart for it to count.
APART = 3.5
#: Features kept at most, labelled documents of each kind in the sample, and bytes of their texts.
FEATURES, SAMPLE, SAMPLE_BYTES = 4096, 2500, 12_000_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LEET = np.zeros(256, bool)
_LEET[[ord(c) for c in STANDS_FOR if c.isascii()]] = True
#: What may end an obfuscated word, and what may stand between its letters.
DASHES = "._-/~,"
_LATE, _DASH = np.zeros(256, bool), np.zeros(256, bool)
_LATE[[*range(48, 58), ord("@"), ord("$")]] = True
_DASH[[ord(c) for c in DASHES]] = True
_BETWEEN = rf"[\s{re.escape(DASHES)}]+"
#: Characters without a width (fixed values).
UNSEEN = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0xFEFF])
#: Cyrillic and Greek letters and the Latin ones that they look like (fixed values).
ALIKE = str.maketrans("абвгдеёзікмнопрстухуѕјһԁԛԝαβγεηικνορτυχω", "a6brdeeзikmhonpctyxysjhdqwabyenikvoptuxw")


def _unusual(data: np.ndarray) -> np.ndarray:
    """Where bytes of a character begin that hides letters: one without a width, a Cyrillic or Greek letter beside a
    Latin one, a letter in a mathematical or wide form, or a white space beyond ASCII between two single letters."""
    a, b, c = data[:-2], data[1:-1], data[2:]
    flag = np.zeros(len(data), bool)
    if not len(a) or data.max() < 128:
        return flag
    letter = _LETTER[data]
    flag[:-2] |= (a == 0xC2) & (b == 0xAD) | (a == 0xEF) & (b == 0xBB) & (c == 0xBF)
    flag[:-2] |= (a == 0xE2) & ((b == 0x80) & (c >= 0x8B) & (c <= 0x8F) | (b == 0x81) & (c >= 0xA0) & (c <= 0xA4))
    flag[:-2] |= (a == 0xEF) & ((b == 0xBC) & (c >= 0xA1) | (b == 0xBD) & (c <= 0x9A)) | (a == 0xF0) & (b == 0x9D) & (c >= 0x90) & (c <= 0x9F)
    other = (a >= 0xCE) & (a <= 0xD1)
    flag[:-2] |= other & letter[2:]
    flag[1:-2] |= other[1:] & letter[:-3]
    if len(data) > 6:
        flag[:-6] |= letter[:-6] & (data[1:-5] == 0xC2) & (data[2:-4] == 0xA0) & letter[3:-3] & (data[4:-2] == 0xC2) & (data[5:-1] == 0xA0)
    return flag


def suspects(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """Places of words that may be obfuscated: with a digit or symbol beside a letter (marks at a word's end but for
    digits, @ and $ don't count), with a letter three times in a row, with single letters between dashes, with letters
    that are hidden (`_unusual`), and runs of four or more words of one character, dashes among them, of which two at
    least are letters, whatever the space between them, line breaks included. Text i begins at offsets[i]; no run
    spans two texts."""
    letter, leet, dash = _LETTER[data], _LEET[data], _DASH[data]
    n = len(data)
    flag = np.zeros(n, bool)
    if n > 4:
        flag[1:-1] |= leet[1:-1] & letter[2:] & (letter[:-2] | leet[:-2])
        flag[:-2] |= leet[:-2] & letter[1:-1] & letter[2:]
        flag[1:-1] |= _LATE[data[1:-1]] & (letter[:-2] | leet[:-2])
        flag[:-2] |= letter[:-2] & (data[:-2] == data[1:-1]) & (data[:-2] == data[2:])
        flag[:-4] |= letter[:-4] & dash[1:-3] & letter[2:-2] & dash[3:-1] & letter[4:]
    start, end = spans(SOLID[data])
    unusual = _unusual(data)
    at = np.unique(np.searchsorted(start, np.flatnonzero(flag | unusual), "right") - 1)
    seen = np.r_[0, np.cumsum(letter | unusual)]
    at = at[seen[end[at]] > seen[start[at]]]
    found = list(zip(start[at].tolist(), end[at].tolist(), strict=True))
    single = (end - start == 1) & (letter | leet | dash)[start] if len(start) else np.zeros(0, bool)
    if single.any():
        text = np.searchsorted(offsets, start, "right")
        same = np.r_[False, text[1:] == text[:-1]]
        # runs of single characters that follow one of the same text
        first, last = spans(np.r_[single & same & np.r_[False, single[:-1]], False])
        for a, b in zip((first - 1).tolist(), last.tolist(), strict=True):
            if b - a >= 4 and letter[start[a:b]].sum() >= 2:
                found.append((int(start[a]), int(end[b - 1])))
    return found


def count_characters(docs: DataFrame) -> np.ndarray:
    """log10 probabilities of a symbol after two others, [28, 28, 28], over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for _, _, data, _ in chunks(batch):
                x = np.concatenate([[0, 0], CLASS[data]])
                total += np.bincount((x[:-2] * SYMBOLS + x[1:-1]) * SYMBOLS + x[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["code", "n"])

    table = docs.select("text").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(SYMBOLS**3)
    n[table["code"].to_numpy(np.int64)] = table["n"]
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two = n.sum(axis=0)
    one = two.sum(axis=0)
    p1 = (one + 1) / (one + 1).sum()
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    p3 = (n + 5 * p2) / (n.sum(axis=2, keepdims=True) + 5)
    return np.log10(p3)


class Decoder:
    """Viterbi over the lattice of a written word or run, with the last two symbols as the state."""

    def __init__(self, model: np.ndarray, size: int = 200_000):
        self.model = model.tolist()
        self.known: dict[str, str] = {}
        self.size = size

    def __call__(self, written: str) -> str:
        found = self.known.get(written)
        if found is None:
            found = self.decode(written)
            if len(self.known) < self.size and len(written) <= 64:
                self.known[written] = found
        return found

    def decode(self, written: str) -> str:
        """The likeliest reading. Where single characters are set apart, what stands between them is nothing or the
        border of two words. Characters without a width go, mathematical and wide letters become plain ones, and beside
        Latin letters those of other scripts become the Latin ones that they look like."""
        text = written if written.isascii() else unicodedata.normalize("NFKC", written.translate(UNSEEN))
        text = text.lower().strip(".,;:?\"'()[]{}")
        if not text.isascii() and re.search("[a-z]", text):
            text = text.translate(ALIKE)
        # of characters with something between, the first is followed by that, and none stands beside another
        apart = len(text) > 2 and re.match(rf"\S{_BETWEEN}\S", text) is not None and re.search(rf"[^\s{re.escape(DASHES)}]{{2}}", text) is None
        # of each state the likelihood and the readings that led there, linked back
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for m in re.finditer(rf"{_BETWEEN}|(.)\1*" if apart else r"(.)\1*", text, re.S):
            c, n = m.group()[0], len(m.group())
            letters = [c] if c.isascii() and c.isalpha() else list(STANDS_FOR.get(c, ""))
            # (letters read, channel cost)
            if letters:
                readings = [(x * k, -0.3 * abs(n - k) if c.isalpha() else -0.2 * n) for x in letters for k in ({1, min(n, 2)})]
            elif apart and m.group(1) is None:
                readings = [("", -0.05), (" ", -1.5 if n == 1 else -0.5)]
            else:
                readings = [("", -0.5 * n)]
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (p, back) in states.items():
                for read, cost in readings:
                    x, y, q = a, b, p + cost
                    for letter in read:
                        z = ord(letter) - 96 if letter != " " else 0
                        q += self.model[x][y][z]
                        x, y = y, z
                    if (x, y) not in new or q > new[x, y][0]:
                        new[x, y] = (q, (back, read))
            states = new
        back = max(((p + self.model[a][b][0], back) for (a, b), (p, back) in states.items()), key=lambda s: s[0])[1]
        out = []
        while back is not None:
            back, read = back
            out.append(read)
        return "".join(reversed(out))


def _features(data: np.ndarray, offsets: np.ndarray, decode: Decoder) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the words and word beginnings of a chunk's texts, restored readings among them."""
    out_text, out_bucket = [], []

    def add(d, o):
        w = Words(d, o, ALNUM)
        size = w.end - w.start
        for k, length in enumerate((4, 5, 6, 0)):
            part = size > length if length else size > 0
            start, end = w.start[part], w.end[part]
            h = w.of(start, start + length if length else end)
            out_bucket.append(((h ^ np.uint64(k)) >> np.uint64(46)).astype(np.int64))
            out_text.append(w.text[part])

    add(data, offsets)
    restored: list[list[str]] = [[] for _ in range(len(offsets) - 1)]
    any_found = False
    for a, b in suspects(data, offsets):
        restored[int(np.searchsorted(offsets, a, "right")) - 1].append(decode(data[a:b].tobytes().decode("utf-8", "replace")))
        any_found = True
    if any_found:
        for _, _, d, o in chunks(pa.RecordBatch.from_arrays([pa.array([" ".join(x) for x in restored])], ["text"]), limit=1 << 40):
            add(d, o)
    return np.concatenate(out_text), np.concatenate(out_bucket)


def _fit(characters: np.ndarray, features: int, prior: float):
    @trimmed
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        decode = Decoder(characters)
        y = pdf["toxic"].to_numpy(np.float32)
        batch = pa.RecordBatch.from_arrays([pa.array(pdf["text"], pa.string())], ["text"])
        pairs = []
        for first, _end, data, offsets in chunks(batch):
            text, bucket = _features(data, offsets, decode)
            pairs.append(np.unique((text + first) * BUCKETS + bucket))
        pairs = np.concatenate(pairs)
        text, bucket = pairs // BUCKETS, pairs % BUCKETS
        pos = np.bincount(bucket, y[text], BUCKETS)
        neg = np.bincount(bucket, 1 - y[text], BUCKETS)
        p, n = max(1, y.sum()), max(1, (1 - y).sum())
        # how far the shares of documents with the feature lie apart, in standard errors
        share = (pos + neg + 1) / (p + n + 2)
        apart = np.abs(pos / p - neg / n) / np.sqrt(share * (1 - share) * (1 / p + 1 / n))
        chosen = np.argsort(-apart, kind="stable")[:features]
        # with so many buckets, some lie this far apart by chance
        chosen = np.sort(chosen[apart[chosen] >= APART])
        column = np.full(BUCKETS, -1, np.int64)
        column[chosen] = np.arange(len(chosen))
        x = np.zeros((len(y), len(chosen)), np.float32)
        there = column[bucket] >= 0
        x[text[there], column[bucket[there]]] = 1
        weight = np.where(y > 0, 0.5 / p, 0.5 / n)
        w = logistic(x, y, rounds=250, strength=1e-4, weight=weight)
        w[-1] += np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)) * 0.5
        return pd.DataFrame({"model": [pickle.dumps((chosen, w))]})

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, float]:
    """(labelled(text, toxic), share of toxic labels): docs(doc_id, text) with labels(doc_id, toxic), by a join of
    about 1.3 times `sample` rows of labels of each kind, those of least hash, whatever the size of the tables."""
    labels = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r[0]: r[1] for r in labels.groupBy("toxic").count().collect()}
    cut = F.lit(False)
    for kind, n in counts.items():
        share = min(1.0, 1.3 * sample / n + 60 / n)
        own = F.col("toxic") == kind
        cut |= own & (row_hash("doc_id", seed=29) < int(-(2**63) + share * 2**64)) if share < 1 else own
    return docs.select("doc_id", "text").join(F.broadcast(labels.where(cut)), "doc_id").select("text", "toxic"), counts.get(1, 0) / max(1, sum(counts.values()))


def train(labelled: DataFrame, corpus: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, features: int = FEATURES, prior: float | None = None) -> dict | None:
    """A model from labelled(text, toxic) and the texts of corpus(text), which labels play no part in. None without a
    labelled row; rows with a null text or label are left out. The regression sees up to `sample` rows of each kind."""
    labelled = labelled.where("text is not null and toxic in (0, 1)").select("text", F.col("toxic").cast("int").alias("toxic"))
    counts = {r[0]: r[1] for r in labelled.groupBy("toxic").count().collect()}
    if not counts:
        return None
    characters = count_characters(corpus)
    if prior is None:
        prior = counts.get(1, 0) / sum(counts.values())
    rows = bounded(labelled, "toxic", sample, sample_bytes).withColumn("_one", F.lit(0))
    fitted = materialize(rows.groupBy("_one").applyInPandas(_fit(characters, features, prior), "model binary"), "toxicity")
    chosen, w = pickle.loads(fitted.first()[0])
    return {"characters": characters, "chosen": chosen, "weights": w}


def score(docs: DataFrame, model: dict | None, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs(text, ...) with score (0 to 1) and predicted (1 if score >= 0.5, else 0).

    Null and empty texts count as texts without a word. Without a model every score is 0. Repeated rows are scored
    each by itself; a column of one of these names in `keep` is an error, others may have any names. An empty table
    gives an empty one."""
    refuse(keep, "score", "predicted")
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = np.full(BUCKETS, -1, np.int64)
        if model:
            column[model["chosen"]] = np.arange(len(model["chosen"]))
            decode, w = Decoder(model["characters"]), model["weights"].astype(np.float64)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for first, end, data, offsets in chunks(batch) if model else ():
                text, bucket = _features(data, offsets, decode)
                c = column[bucket]
                there = c >= 0
                pairs = np.unique(text[there] * len(w) + c[there])
                out[first:end] = sigmoid(np.bincount(pairs // len(w), w[pairs % len(w)], end - first) + w[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    return docs.select(*keep, "text").mapInArrow(run, schema)
