"""The trie against one of dictionaries, on one shard and on many."""

import hashlib
import re
import zlib
from math import fmod

import numpy as np
import pytest

from spanloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, shard string, n_convs int"


def rebuilt(rows):
    """{conv_id: [(role, text)]} by the rule of the query; turns with one number in the order of their ids."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(fmod(c, 20)), [])[:h] + mine[h:]
    return out


def brute(convs):
    members = {}
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    children, leaves, saved = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    for node, cs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(cs) - 1) * words
    out = []
    for node, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(convs[c]) == len(node))))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), children.get(node, 0), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(rng, n=150, copies=60, long=(40, 70)):
    """Conversations that share beginnings, a third of them equal, some long, with what else may come."""
    rows, turn = [], lambda k: (["user", "assistant"][k % 2], " ".join(rng.choice(["a", "b ", "\tc\n", "é"], rng.integers(0, 4))))
    for c in range(n):
        rows += [(c, k, *turn(k)) for k in range(rng.integers(1, 7))]
    for c in range(1000, 1000 + copies):
        rows += [(c, k, "user", f"the same {k}") for k in range(5)]
    for i, size in enumerate(long):
        for c in (2000 + i, 2100 + i):
            rows += [(c, k, "user", f"x {k % 3}") for k in range(size)]
    rows += [(3001, None, None, None), (3001, None, "user", None), (3001, 0, None, "t"), (3002, 1, "a", ":b"), (3003, 1, "a:", "b"), (3004, 5, "user", "late"), (3004, 5, "user", "late"), (3004, 5, "user", "other")]
    rows += [(None, 1, "user", "nobody's"), (-7, 0, "user", "x 0"), (-20, 0, "user", "x 0"), (3005, 1, "user", "word " * 30_000)]
    return [rows[k] for k in rng.permutation(len(rows))]


def found(spark, rows):
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in prefix_trie.conversation_trie(df).select(prefix_trie.COLUMNS).collect()), key=repr)


@pytest.fixture()
def shards(spark):
    """Sets the number of shards."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}

    def of(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")

    yield of
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("n", [1, 3, 40])
def test_against_dictionaries(spark, shards, n, monkeypatch):
    shards(n)
    rows = corpus(np.random.default_rng(n))
    assert found(spark, rows) == brute(rebuilt(rows))


def test_turnless_and_empty(spark, shards):
    shards(4)
    # conversations whose turns all give way to an absent one's
    rows = [(c, 0, "user", "x") for c in range(1, 30) if c % 20]
    convs = rebuilt(rows)
    assert any(not t for t in convs.values())
    assert found(spark, rows) == brute(convs)
    assert found(spark, []) == [] and found(spark, [(None, 1, "a", "b")]) == []


def test_random_shards_and_depths():
    """Shards cut anywhere give the same nodes and sums, without Spark."""
    rng = np.random.default_rng(9)
    convs = {c: rng.integers(1, 3, rng.integers(0, 40)).tolist() for c in range(300)}
    path = {c: b"".join(bytes([16, t]) + bytes(14) for t in ts) for c, ts in convs.items()}
    rows = sorted(convs, key=lambda c: (path[c], c))
    batches = list(prefix_trie.shard_rows(0, np.array(rows[::-1]), [path[c] for c in rows[::-1]], np.concatenate([np.array(convs[c], np.int64) for c in rows[::-1]])))
    have = sorted(((r["depth"], r["conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for b in batches for r in b.to_pylist() if r["kind"] != prefix_trie.ENDS))
    want = brute({c: [(t, " ".join("w" * t)) for t in ts] for c, ts in convs.items()})
    assert have == sorted((d, c, n, k, lv, s, e) for c, d, _, n, k, lv, s, e in want)


def test_pieces_of_many_numbers(spark, shards, monkeypatch):
    shards(7)
    rows = [(c, 0, "user", "one") for c in range(0, 6000, 20)] + [(c, 0, "user", "one") for c in range(100_001, 104_000)]
    assert found(spark, rows) == brute(rebuilt(rows))
