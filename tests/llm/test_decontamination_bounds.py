"""Walks are tried on every item of the benchmark, and no candidate within the limit is left out by a share that was
only seen on trial."""

import numpy as np
from test_llm import corpus, docs  # noqa: F401


def test_passages_with_gathered_edits(spark, corpus):  # noqa: F811
    """The start of each passage stays whole, and then every fourth character is another one, up to the limit: far fewer
    of its runs are left than of copies that are edited at random."""
    from spanloom.llm.decontaminate import contaminated, edit_distance_within, normal

    rng = np.random.default_rng(5)
    long = " ".join(t for _, t in corpus).split()
    items = [(100 * n + k, normal(" ".join(long[a : a + n]))) for n in (20, 40) for k, a in enumerate(rng.integers(0, len(long) - 200, 20).tolist())]
    rows = []
    for i, text in items:
        chars = list(text)
        for p in range(len(chars) - 1, len(chars) - 1 - 4 * int(0.2 * len(chars)), -4):
            chars[p] = "zq"[chars[p] == "z"]
        rows.append((i, f"Davor steht etwas. {''.join(chars)} Danach auch."))
    assert all(edit_distance_within(t, normal(r))[0] <= int(0.2 * len(t)) for (_, t), (_, r) in zip(items, rows, strict=True))
    found = {(r.doc_id, r.item_id) for r in contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert np.mean([(i, i) in found for i, _ in items]) >= 0.95


def test_bounds_lose_no_passage():
    """Parts of texts that hold an item within its edits pass both bounds, wherever the edits are."""
    from spanloom.llm.decontaminate import Index, Plan, edit_distance_within

    rng = np.random.default_rng(9)
    letters = list("abcdefgh é数")
    items = ["".join(rng.choice(letters, int(n))) for n in rng.integers(1, 500, 150)]
    index = Index(items, 0.8, dict.fromkeys([*range(1, 8), 8, 32, 128, 512], Plan(1)))
    texts, begin = [], []
    for item, edits in zip(index.normal, index.edits.tolist(), strict=True):
        chars, width = list(item), int(rng.integers(edits, len(item) + 1))
        for p in rng.choice(width, edits, replace=False).tolist():
            chars[p] = ("", "z", chars[p] + "z", "z" + chars[p])[int(rng.integers(4))]
        before = "".join(rng.choice(letters, int(rng.integers(0, 99))))
        begin.append(sum(map(len, texts)) + len(texts) + len(before))
        texts.append(before + "".join(chars) + before)
    codes = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le"), np.uint32)
    own, begin = np.arange(len(items)), np.array(begin)
    assert all(edit_distance_within(x, t)[0] <= e for x, t, e in zip(index.normal, texts, index.edits.tolist(), strict=True))
    assert index.near(own, begin, index.padded(codes)).all() and index.within(own, begin, begin, codes).all()
    other = np.roll(begin, 1)
    assert index.within(own, other, other, codes).mean() < 0.2


def test_every_item_is_on_trial(spark, corpus):  # noqa: F811
    from spanloom.llm.decontaminate import COPIES, trials

    long = " ".join(t for _, t in corpus).split()
    texts = [" ".join(long[7 * k : 7 * k + n]) for n in (9, 40) for k in range(30)] + ["?!", ""]
    table = spark.createDataFrame([(t,) for t in sorted(set(texts))], "text string")
    one, many = ({tuple(r) for r in trials(table, 0.8, parts).collect()} for parts in (1, 7))
    assert one == many
    n = {size: sum(1 for t in {*texts} if (len(t.split()) < 32) == (size == 8) and len(t) > 2) for size in (8, 32)}
    for size in (8, 32):
        for characters in (False, True):
            assert sum(r[3] for r in one if r[:2] == (size, characters)) == COPIES * n[size]
