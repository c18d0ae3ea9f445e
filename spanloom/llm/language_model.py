"""Hashed maximum-entropy language model with a class-factored softmax.

log P(token | before) = log P(class | context) + log P(token | class). The context's features are the bucket of the
word before, of the word before that (a skip feature) and the hashed pair of both; classes are the commonest words and,
for others, the hash of a word's end. Contexts have a bounded number of buckets, so the training tokens of the whole
corpus are first counted by context and class; the model is then trained on these counts by full gradients: each
round, tasks sum the expected counts of their contexts, these sums are added up in one more task, and the driver makes
one preconditioned step. Within a class, words have their counts less a half, and unknown words of that class share
the halves.

Counts of words are exact. The commonest words are looked up in a dictionary of bounded size; only the others' rows are
joined with the table of counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, ShortType

from spanloom.llm.common import Words, chunks, free_name, materialize, mix, refuse, trimmed

#: Buckets of word ends, classes, buckets of the word before and of the one before that, of hashed pairs.
ENDS, CLASSES, FIRST, SECOND, PAIRS = 40, 64, 512, 128, 4096
#: Words of the dictionary.
HOT = 1 << 16
#: The token at the end of a text.
END = np.uint64(0x9D39247E33776D41)
#: Tokens that a task holds before it gives out its counts.
HELD = 6_000_000
ROUNDS = 10


def _tokens(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, end bucket, text) of every token: words, then an end for each text."""
    n, texts = len(w.hash), len(w.bounds) - 1
    place = np.arange(n) + w.text
    ends = w.bounds[1:] + np.arange(texts)
    h = np.empty(n + texts, np.uint64)
    h[place], h[ends] = w.hash, END
    last = w.low[w.end - 1].astype(np.uint64) * np.uint64(256)
    last += np.where(w.end - w.start > 1, w.low[np.maximum(w.end - 2, 0)], 0).astype(np.uint64)
    bucket = np.zeros(n + texts, np.int16)
    bucket[place] = (mix(last + np.uint64(1)) % np.uint64(ENDS)).astype(np.int16)
    text = np.empty(n + texts, np.int64)
    text[place], text[ends] = w.text, np.arange(texts)
    return h, bucket, text


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def out():
        h, first, n = np.unique(np.concatenate([x[0] for x in held]), return_index=True, return_counts=True)
        b = np.concatenate([x[1] for x in held])[first]
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(b), pa.array(n.astype(np.int64))], ["h", "b", "c"])

    for batch in batches:
        for _, _, data, offsets in chunks(batch):
            h, b, _ = _tokens(Words(data, offsets))
            held.append((h, b))
            size += len(h)
            if size >= HELD:
                yield out()
                held, size = [], 0
    if held:
        yield out()


class Dictionary:
    """Index of a word among the commonest, by hash."""

    def __init__(self, hashes: np.ndarray, bits: int = 20):
        self.hashes, self.bits = hashes, np.uint64(64 - bits)
        self.slot = np.full(1 << bits, -1, np.int32)
        at = (hashes >> self.bits).astype(np.int64)
        self.slot[at[::-1]] = np.arange(len(hashes), dtype=np.int32)[::-1]
        lost = np.flatnonzero(self.slot[at] != np.arange(len(hashes)))
        self.lost = lost[np.argsort(hashes[lost])].astype(np.int32)
        self.lost_hash = hashes[self.lost]

    def find(self, h: np.ndarray) -> np.ndarray:
        """The index of each hash, or -1."""
        out = self.slot[(h >> self.bits).astype(np.int64)]
        wrong = np.flatnonzero((out >= 0) & (self.hashes[out] != h)) if len(self.hashes) else np.arange(0)
        if len(wrong):
            out[wrong] = -1
            if len(self.lost):
                k = np.minimum(np.searchsorted(self.lost_hash, h[wrong]), len(self.lost) - 1)
                out[wrong] = np.where(self.lost_hash[k] == h[wrong], self.lost[k], -1)
        return out


def _contexts(h, bucket, text, index) -> tuple[np.ndarray, np.ndarray]:
    """(context, class) of each token. index: its place in the dictionary, most common first, or -1."""
    start_first, start_second = FIRST - 1, SECOND - 1
    tops, first_tops, second_tops = CLASSES - ENDS, FIRST - 1 - ENDS, SECOND - 1 - ENDS
    cls = np.where((index >= 0) & (index < tops), index, tops + bucket)
    one = np.where((index >= 0) & (index < first_tops), index, first_tops + bucket)
    two = np.where((index >= 0) & (index < second_tops), index, second_tops + bucket)
    n = len(h)
    before, before2 = np.full(n, start_first), np.full(n, start_second)
    if n > 1:
        same = text[1:] == text[:-1]
        before[1:][same] = one[:-1][same]
    if n > 2:
        same = text[2:] == text[:-2]
        before2[2:][same] = two[:-2][same]
    return before * SECOND + before2, cls


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (mix(first.astype(np.uint64) * np.uint64(SECOND) + second.astype(np.uint64) + np.uint64(1)) % np.uint64(PAIRS)).astype(np.int64)


def _logits(weights: np.ndarray, context: np.ndarray) -> np.ndarray:
    first, second = context // SECOND, context % SECOND
    return weights[0] + weights[1 + first] + weights[1 + FIRST + second] + weights[1 + FIRST + SECOND + _pair(first, second)]


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _sums(context: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums over contexts for each feature."""
    out = np.zeros((1 + FIRST + SECOND + PAIRS, CLASSES))
    first, second = context // SECOND, context % SECOND
    out[0] = values.sum(axis=0)
    for base, key in ((1, first), (1 + FIRST, second), (1 + FIRST + SECOND, _pair(first, second))):
        order = np.argsort(key, kind="stable")
        k = key[order]
        at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.arange(0)
        if len(at):
            out[base + k[at]] += np.add.reduceat(values[order], at, axis=0)
    return out


def train(docs: DataFrame, hot: int = HOT, rounds: int = ROUNDS) -> dict:
    """A model of docs(text): the table of exact counts, the dictionary, totals and weights.

    Null texts count as empty: one end token. Everything is counted over all rows and whole texts."""
    counts = materialize(docs.select("text").mapInArrow(_count_words, "h long, b short, c long").groupBy("h").agg(F.sum("c").alias("c"), F.min("b").alias("b")), "counts")
    n, v = counts.agg(F.sum("c"), F.count("*")).first()
    top = counts.orderBy(F.desc("c"), "h").limit(hot).toPandas()
    hashes, c = top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    tops = CLASSES - ENDS
    by_end = {r["b"]: (r["n"], r["v"]) for r in counts.groupBy("b").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    tokens, types = np.zeros(CLASSES), np.zeros(CLASSES)
    for b, (x, y) in by_end.items():
        tokens[tops + b], types[tops + b] = x, y
    for i in range(min(tops, len(top))):
        b = tops + int(top["b"].iloc[i])
        tokens[i], types[i] = c[i], 1
        tokens[b] -= c[i]
        types[b] -= 1

    @trimmed
    def count_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Dictionary(hashes)
        total = np.zeros(FIRST * SECOND * CLASSES, np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch):
                h, bucket, text = _tokens(Words(data, offsets))
                context, cls = _contexts(h, bucket, text, known.find(h))
                code, m = np.unique(context * CLASSES + cls, return_counts=True)
                total[code] += m
        code = np.flatnonzero(total)
        for at in range(0, len(code), 1 << 18):
            x = code[at : at + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array((x // CLASSES).astype(np.int32)), pa.array((x % CLASSES).astype(np.int16)), pa.array(total[x])], ["context", "class", "n"])

    # contexts and classes are bounded, and so is the work of a round
    parts = 12
    seen = docs.select("text").mapInArrow(count_contexts, "context int, class short, n long").groupBy("context", "class").agg(F.sum("n").alias("n"))
    seen = materialize(seen.repartition(parts, "context"), "contexts")

    def sums(weights: np.ndarray | None):
        """Observed counts of each feature and class, or those that the model expects."""

        @trimmed
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [[b.column(k).to_numpy(zero_copy_only=False) for k in range(3)] for b in batches]
            if rows:
                context, cls, m = (np.concatenate([r[k] for r in rows]) for k in range(3))
                present, place = np.unique(context, return_inverse=True)
                table = np.zeros((len(present), CLASSES))
                np.add.at(table, (place, cls), m)
                if weights is not None:
                    table = np.exp(_log_softmax(_logits(weights, present.astype(np.int64)))) * table.sum(axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([_sums(present.astype(np.int64), table).tobytes()], pa.binary())], ["one", "sums"])

        @trimmed
        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            # one row for each task before, of a size that doesn't depend on the corpus
            return pd.DataFrame({"sums": [np.sum([np.frombuffer(x) for x in pdf["sums"]], axis=0).tobytes()]})

        shape = (1 + FIRST + SECOND + PAIRS, CLASSES)
        total = seen.mapInArrow(run, "one long, sums binary").groupBy("one").applyInPandas(add, "sums binary").first()
        return np.frombuffer(total[0]).reshape(shape).copy() if total else np.zeros(shape)

    observed = sums(None)
    weights = np.zeros_like(observed)
    weights[0] = np.log(observed[0] + 0.5) - np.log((observed[0] + 0.5).sum())
    for _ in range(rounds):
        expected = sums(weights)
        step = (observed - expected - 0.05 * weights) / (np.maximum(expected, 0.3 * observed) + 2.0)
        weights[1:] += np.clip(0.45 * step[1:], -1.5, 1.5)
    return {"counts": counts, "hashes": hashes, "hot_counts": c, "n": int(n or 0), "v": int(v), "tokens": tokens, "types": types, "weights": weights}


def score(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs(text, ...) with n_tokens, n_known, train_tokens, base_score and score of every whole
    text, as sums of log10 probabilities.

    A null text counts as empty: one end token. Repeated rows are scored each by itself. An empty table gives an
    empty one; a column of one of these names in `keep` is an error, others may have any names."""
    refuse(keep, "n_tokens", "n_known", "train_tokens", "base_score", "score")
    own = {c: free_name(c, *keep) for c in ("_row", "hot", "base", "model", "h", "k", "times", "cold", "cold_base", "cold_model")}
    hashes, hot_counts, weights = model["hashes"], model["hot_counts"], model["weights"].astype(np.float32)
    tokens, types = model["tokens"], model["types"]
    denominator = float(np.log10(model["n"] + 0.5 * (model["v"] + 1)))
    # a class without a training token holds half a token, all of it unknown
    log_tokens = np.log10(np.maximum(tokens, 0.5))
    log_rest = np.log10(0.5 * np.maximum(types, 1)).tolist()

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Dictionary(hashes)
        every = np.arange(FIRST * SECOND)
        table = np.concatenate([_log_softmax(_logits(weights, part)) for part in np.array_split(every, 32)]) / np.float32(np.log(10))
        hot_base, hot_in = np.log10(hot_counts + 0.5), np.log10(hot_counts - 0.5)
        row = TaskContext.get().partitionId() << 40
        kept = [*keep, own["_row"], "n_tokens", own["hot"], own["base"], own["model"]]
        for batch in batches:
            for first, end, data, offsets in chunks(batch):
                n = end - first
                h, bucket, text = _tokens(Words(data, offsets))
                index = known.find(h)
                context, cls = _contexts(h, bucket, text, index)
                value = table[context, cls] - log_tokens[cls]
                hot = index >= 0
                value[hot] += hot_in[index[hot]]
                base = np.zeros(len(h))
                base[hot] = hot_base[index[hot]]
                total = np.bincount(text, minlength=n)
                ids = pa.array(np.arange(row, row + n))
                # cold words of each text, counted: one list for each row
                cold = np.flatnonzero(~hot)
                order = cold[np.lexsort((h[cold], text[cold]))]
                ch, ct, cc = h[order], text[order], cls[order]
                new = np.flatnonzero(np.r_[True, (ch[1:] != ch[:-1]) | (ct[1:] != ct[:-1])]) if len(order) else np.arange(0)
                times = np.diff(np.r_[new, len(order)])
                ends = pa.array(np.searchsorted(ct[new], np.arange(n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (ch[new].view(np.int64), cc[new].astype(np.int16), times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(batch.schema.get_field_index(c)).slice(first, n) for c in keep), ids, pa.array(total.astype(np.int64)), pa.array(np.bincount(text, hot, n).astype(np.int64)),
                    pa.array(np.bincount(text, base, n) - total * denominator), pa.array(np.bincount(text, value, n)), *lists,
                ], [*kept, own["h"], own["k"], own["times"]])
                row += n

    schema = docs.select(*keep).schema
    for name in (own["_row"], "n_tokens", own["hot"]):
        schema = schema.add(name, "long")
    schema = schema.add(own["base"], "double").add(own["model"], "double").add(own["h"], ArrayType(LongType())).add(own["k"], ArrayType(ShortType())).add(own["times"], ArrayType(IntegerType()))
    scored = materialize(docs.select(*keep, "text").mapInArrow(run, schema), "scored")
    row = own["_row"]
    cold = scored.select(F.col(row).alias("row"), F.explode(F.arrays_zip(F.col(own["h"]).alias("h"), F.col(own["k"]).alias("k"), F.col(own["times"]).alias("times"))).alias("z")).select("row", "z.h", "z.k", "z.times")
    # adaptive execution splits the rows of a word that is common outside the dictionary
    found = cold.join(model["counts"].select("h", "c"), "h", "left")
    rest = F.element_at(F.array(*map(F.lit, log_rest)), F.col("k") + 1)
    sums = found.groupBy(F.col("row").alias(row)).agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias(own["cold"]),
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias(own["cold_base"]),
        F.sum(F.col("times") * F.coalesce(F.log10(F.col("c") - 0.5), rest)).alias(own["cold_model"]),
    )
    zero = F.lit(0)
    return scored.select(*keep, row, "n_tokens", own["hot"], own["base"], own["model"]).join(sums, row, "left").select(
        *keep, "n_tokens", (F.col(own["hot"]) + F.coalesce(own["cold"], zero)).alias("n_known"), F.lit(model["n"]).cast("long").alias("train_tokens"),
        (F.col(own["base"]) + F.coalesce(own["cold_base"], zero)).alias("base_score"), (F.col(own["model"]) + F.coalesce(own["cold_model"], zero)).alias("score"),
    )
