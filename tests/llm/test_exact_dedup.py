"""Exact deduplication against brute force, over batches, repeated runs and sessions."""

import hashlib
import re

import numpy as np
import pytest

from spanloom.llm.exact_dedup import compact, create_index, deduplicate, drop_repeated, open_index

SCHEMA = "doc_id long, text string, digest string, keep_id string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "mine", "too") for i, t in rows], SCHEMA)


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute(rows, known=None):
    """(rows sorted, keepers) of a batch; known: keep ids of texts of earlier batches."""
    known, groups = known or {}, {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    out = []
    for t, ids in groups.items():
        order = sorted(ids, key=lambda i: (i is None, i or 0))
        keep = known[t] if t in known else order[0]
        for k, i in enumerate(order):
            out.append((i, keep, len(ids), t not in known and k == 0, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr), {**{t: min(ids, key=lambda i: (i is None, i or 0)) for t, ids in groups.items()}, **known}


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


EDGE = [(7, None), (8, ""), (9, " "), (10, "\t\x0b\n "), (11, " a b"), (12, "a b"), (13, "a\x0cb"), (14, "a b"), (15, "é " * 40_000), (16, "é  " * 40_000), (11, " a b"), (11, " a\n b"), (None, "a b"), (None, "no id"), (None, "no id"), (17, "A b")]


def batch(rng, n, first):
    # half of the rows have one text
    return [(first + k, "the\nsame  text" if k % 2 else " ".join(rng.choice(["x", "y", "z"], 3))) for k in rng.permutation(n).tolist()]


def test_one_batch(spark):
    rows = EDGE + batch(np.random.default_rng(1), 300, 100)
    assert found(deduplicate(table(spark, rows).repartition(5), create_index(spark), 0)) == brute(rows)[0]


def test_hot_and_cold_groups_are_joined_apart(spark):
    rows = [(k, "hot" if k % 3 else f"text {k // 6}") for k in range(9000)]
    assert found(deduplicate(table(spark, rows), create_index(spark), 0)) == brute(rows)[0]


def test_batches_repeated_runs_and_reopening(spark):
    rng = np.random.default_rng(2)
    first, second = EDGE + batch(rng, 40, 100), batch(rng, 60, 50) + [(1, " a b"), (2, "new"), (3, "new"), (4, "no id")]
    index = create_index(spark, buckets=3)
    want, known = brute(first)
    assert found(deduplicate(table(spark, first), index, 0)) == want
    entries = index.rows().count()
    # the batch runs again, as after a lost job
    assert found(deduplicate(table(spark, first), index, 0)) == want
    assert index.rows().count() == entries == len(known)
    again = open_index(spark, index.path)
    want, known = brute(second, known)
    assert found(deduplicate(table(spark, second), again, 1)) == want
    small = compact(again, f"{index.path}-compact")
    assert small.rows().count() == again.rows().count() == len(known)
    assert found(deduplicate(table(spark, second), small, 2)) == brute(second, known)[0]
    assert small.rows().count() == len(known)


def test_index_is_joined_as_it_lies(spark):
    """The anti-join and the join that looks up read buckets: of the index no row is shuffled."""
    from pyspark.sql import functions as F

    index = create_index(spark, buckets=4)
    deduplicate(table(spark, batch(np.random.default_rng(3), 50, 0)), index, 0)
    new = spark.range(10).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest")).groupBy("digest").count()
    plan = new.join(index.rows().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1


def test_empty_and_without_rows_of_their_own(spark):
    index = create_index(spark)
    assert found(deduplicate(table(spark, []), index, 0)) == [] and index.rows().count() == 0
    kept = drop_repeated(table(spark, [(1, "a"), (2, "a "), (3, "a  ")]), index, 1)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2] and kept.columns == ["doc_id", "text", "digest", "keep_id"]
    assert [r.doc_id for r in drop_repeated(table(spark, [(4, "a"), (5, "b")]), index, 2).collect()] == [5]


@pytest.mark.parametrize("kind", ["string", "int"])
def test_ids_of_other_types(spark, kind):
    docs = spark.createDataFrame([("10", "t"), ("9", "t")], "doc_id string, text string")
    docs = docs.withColumn("doc_id", docs.doc_id.cast(kind))
    rows = deduplicate(docs, create_index(spark, id_type=kind), 0).collect()
    assert {r.keep_id for r in rows} == {"10" if kind == "string" else 9}
