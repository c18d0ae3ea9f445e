"""Quality classifier from weak labels.

Heuristic labellers vote good (1), bad (0) or abstain (-1) on every text. Votes overlap; expectation-maximisation over
the counts of vote patterns, which are few whatever the number of texts, estimates each labeller's accuracy on good and
on bad texts and the posterior of every pattern. The posteriors are the labels on which a linear scorer of hashed byte
n-grams is trained, in one task, on a bounded sample; it then scores all whole texts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import SOLID, Words, chunks, materialize, refuse, row_hash, spans, trimmed
from spanloom.llm.linear import logistic, sigmoid, text_vectors
from spanloom.llm.sampling import bounded

LABELLERS = ("symbols", "capitals", "repetition", "word_length", "bars", "lines", "marks")
#: Texts of each kind in the sample, and bytes of them.
SAMPLE, SAMPLE_BYTES = 2000, 12_000_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def votes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The votes of LABELLERS on each text of a chunk, [texts, labellers]."""
    texts = len(offsets) - 1
    w = Words(data, offsets, SOLID)
    n = np.diff(w.bounds)
    some = np.maximum(n, 1)

    def share(mask: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(of, 1)

    size = np.bincount(w.text, w.end - w.start, texts)
    letters = share(_LETTER[data], np.ones(texts))
    # the commonest word's share, over 44 bits of the hashes
    key = np.sort((w.text.astype(np.uint64) << np.uint64(44)) | (w.hash >> np.uint64(20)))
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.arange(0)
    top = np.zeros(texts)
    np.maximum.at(top, (key[new] >> np.uint64(44)).astype(np.int64), np.diff(np.r_[new, len(key)]))
    first, last = w.low[w.start], w.low[w.end - 1]
    bar = (w.end - w.start == 1) & (first == 124)
    marked = (w.end - w.start > 2) & _SYMBOL[last] & (w.low[np.maximum(w.end - 2, 0)] == last)
    line = data != 10
    line[offsets[1:] - 1] = False
    start, end = spans(line)
    owner = np.searchsorted(offsets, start, "right") - 1
    key = np.sort((owner.astype(np.uint64) << np.uint64(44)) | (w.of(start, end) >> np.uint64(20)))
    again = np.r_[False, key[1:] == key[:-1]] if len(key) else np.zeros(0, bool)
    count = np.bincount(owner, minlength=texts)
    repeated = np.bincount((key >> np.uint64(44)).astype(np.int64), again, texts) / np.maximum(count, 1)
    mean = size / some

    def vote(bad, good):
        return np.where(bad, 0, np.where(good, 1, -1))

    symbols = share(_SYMBOL[data], size)
    capitals = share(_UPPER[data], letters)
    bars, marks = np.bincount(w.text, bar, texts) / some, np.bincount(w.text, marked, texts) / some
    out = np.stack([
        vote(symbols > 0.10, symbols < 0.05), vote((capitals > 0.4) & (letters > 20), capitals < 0.15), vote((top / some > 0.25) & (n >= 8), (top / some < 0.15) & (n >= 8)),
        vote((mean > 14) | (mean < 2.5), (mean > 3.5) & (mean < 10)), vote(bars > 0.1, bars < 0.01), vote((repeated > 0.4) & (count >= 3), (repeated < 0.1) & (count >= 2)), vote(marks > 0.15, marks < 0.02),
    ], axis=1)
    out[n == 0] = -1
    return out.astype(np.int8)


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[np.ndarray, float, dict]:
    """(accuracy[labeller, class], share of good texts, posterior of good for each pattern), by
    expectation-maximisation. The start is each pattern's majority with ties as good; abstentions say nothing."""
    keys = sorted(patterns)
    x = np.array(keys)
    n = np.array([patterns[k] for k in keys], float)
    good, bad = (x == 1).sum(axis=1), (x == 0).sum(axis=1)
    p = np.where(bad == 0, 0.95, np.where(good >= 3 * bad, 0.6, 0.1)).astype(float)
    for _ in range(rounds):
        share = np.clip((n * p).sum() / n.sum(), 1e-3, 1 - 1e-3)
        accuracy = np.empty((x.shape[1], 2))
        for k in range(x.shape[1]):
            for c, q in ((1, p), (0, 1 - p)):
                right, voted = (n * q)[x[:, k] == c].sum(), (n * q)[x[:, k] >= 0].sum()
                # a labeller is right more often than not on good texts; of bad ones it may miss most
                accuracy[k, c] = np.clip((right + (9 if c else 3)) / (voted + 10), 0.02, 0.999)
        log_odds = np.full(len(keys), np.log(share / (1 - share)))
        for k in range(x.shape[1]):
            log_odds += np.where(x[:, k] == 1, np.log(accuracy[k, 1] / (1 - accuracy[k, 0])), np.where(x[:, k] == 0, np.log((1 - accuracy[k, 1]) / accuracy[k, 0]), 0))
        p = sigmoid(log_odds)
    return accuracy, float(share), dict(zip(keys, p.tolist(), strict=True))


def _pattern(row: np.ndarray) -> str:
    return "".join("?" if v < 0 else str(v) for v in row)


def vote_all(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs(text, ...) with `votes`, a character for each labeller: 1, 0 or ?."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_pattern(v) for _, _, data, offsets in chunks(batch) for v in votes(data, offsets)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(out, pa.string())], [*keep, "votes"])

    source = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    return source.mapInArrow(run, docs.select(*keep).schema.add("votes", "string"))


def train(docs: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> dict | None:
    """A model of docs(text): accuracies and posteriors from all texts' votes, and the linear scorer from up to
    `sample` texts of each kind. None for an empty table. Null texts count as empty; no labeller votes on them."""
    counts = {tuple(-1 if c == "?" else int(c) for c in r["votes"]): r["n"] for r in vote_all(docs.select("text"), []).groupBy("votes").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    accuracy, share, posterior = estimate(counts)
    by_name = {_pattern(np.array(k)): p for k, p in posterior.items()}
    good = [k for k, p in by_name.items() if p >= 0.5]
    # only texts of a hash below a cut that leaves the sample whole are voted on again
    n = {True: 0, False: 0}
    for k, m in counts.items():
        n[posterior[k] >= 0.5] += m
    share_of = max(min(1.0, 1.3 * sample / max(1, x) + 60 / max(1, x)) for x in n.values())
    some = docs.where("text is not null").select("text")
    if share_of < 1:
        some = some.where(row_hash("text", seed=23) < int(-(2**63) + share_of * 2**64))
    rows = vote_all(some, ["text"]).withColumn("_good", F.col("votes").isin(good))
    rows = bounded(rows, "_good", sample, sample_bytes).withColumn("_one", F.lit(0))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf["votes"].map(by_name).to_numpy(np.float32)
        batch = pa.RecordBatch.from_arrays([pa.array(pdf["text"], pa.string())], ["text"])
        x = np.stack([v for _, _, data, offsets in chunks(batch) for v in text_vectors(data, offsets, lower=False)])
        weight = np.where(p >= 0.5, 0.5 / max(1, (p >= 0.5).sum()), 0.5 / max(1, (p < 0.5).sum()))
        return pd.DataFrame({"model": [pickle.dumps(logistic(x, p, rounds=400, strength=1e-6, weight=weight))]})

    fitted = materialize(rows.groupBy("_one").applyInPandas(run, "model binary"), "quality").collect()
    return {"accuracy": accuracy, "share": share, "posterior": by_name, "weights": pickle.loads(fitted[0][0]) if fitted else None}


def classify(docs: DataFrame, model: dict | None, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs(text, ...) with votes, posterior (of good, from the votes), score (of good, from the
    linear scorer) and quality (1 if the score is 0.5 or more, else 0).

    A text without a word has no votes; its score is 0. Repeated rows are scored each by itself. Without a model
    posteriors and scores are 0. A column of one of these names in `keep` is an error, others may have any names."""
    refuse(keep, "votes", "posterior", "score", "quality")
    schema = docs.select(*keep).schema.add("votes", "string").add("posterior", "double").add("score", "double").add("quality", "integer")

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model["weights"] if model else None
        for batch in batches:
            names, out = [], np.zeros(batch.num_rows)
            for first, _end, data, offsets in chunks(batch):
                names += [_pattern(v) for v in votes(data, offsets)]
                if w is not None:
                    for k, v in enumerate(text_vectors(data, offsets, lower=False)):
                        if v.any():
                            out[first + k] = sigmoid(float(v @ w[:-1] + w[-1]))
            p = [model["posterior"].get(x, 0.0) if model else 0.0 for x in names]
            none = "?" * len(LABELLERS)
            out[[x == none for x in names]] = 0
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(names, pa.string()), pa.array(p, pa.float64()), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], [*keep, "votes", "posterior", "score", "quality"])

    return docs.select(*keep, "text").mapInArrow(run, schema)
