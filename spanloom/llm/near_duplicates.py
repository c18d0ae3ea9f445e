"""Similarity join of texts on the Jaccard similarity of their word n-grams, by a MinHash LSH forest.

Every text has a label in each of `trees` prefix tries: a string of `depth` minima. Sorted by label, the texts below a
node of a trie are neighbours that share a prefix. The join starts at the full depth. Each round takes the nodes of its
level that unite two nodes or more of the round before, and verifies exactly the pairs that meet there for the first
time in any tree. The similarities of the links found so far tell how many more there must be: a pair of similarity s
shares a prefix of k minima in some tree with probability 1 - (1 - s ** k) ** trees. While the estimated recall is below
the target, prefixes are shortened to the longest at which these links promise it.

Texts with the same words are one class before the join. Nodes of the same members are verified once. A large node is
dealt into blocks, of a bounded number of texts and n-grams, and each pair of blocks is verified by itself, so that no
task holds a whole node and no pair of rows is ever emitted: a cell returns counts and local links only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import AnyWords, free_name, lowered, materialize, mix, shingles, trimmed

#: Texts and n-grams of a block of a large node.
BLOCK, GRAMS = 384, 200_000
#: Bins of similarity between the threshold and 1.
BINS = 20
#: Links at the threshold that are taken for granted in the estimate of recall, so that few links never end it early.
PRIOR = 10


def missed(similarity: float, level: int, trees: int) -> float:
    """The probability that a pair shares no prefix of `level` minima in any tree."""
    return (1 - similarity**level) ** trees


def estimated_recall(bins: dict[int, int], threshold: float, level: int, trees: int) -> float:
    """The share of all links found so far, from the links found in each bin of similarity."""
    found, lost = 0.0, PRIOR * missed(threshold, level, trees)
    for b, n in bins.items():
        m = missed(threshold + (1 - threshold) * b / BINS, level, trees)
        found += n
        lost += n * m / (1 - m)
    return (found + PRIOR - PRIOR * missed(threshold, level, trees)) / (found + PRIOR + lost - PRIOR * missed(threshold, level, trees))


def signatures(docs: DataFrame, ngram: int, trees: int, depth: int) -> DataFrame:
    """doc_id, words1, words2 (a 128-bit hash of the word sequence), n (n-grams), labels (`depth` minima of 16 bits for
    each tree, one after another). Texts without a word are left out."""

    rng = np.random.default_rng(20_011)
    odd = rng.integers(0, 1 << 31, (trees, depth), np.uint32) * np.uint32(2) + np.uint32(1)
    flip = rng.integers(0, 1 << 32, (trees, depth), np.uint32)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, _end, data, offsets in lowered(batch):
                w = AnyWords(data, offsets)
                there = np.flatnonzero(np.diff(w.bounds))
                if not len(there):
                    continue
                grams, text = shingles(w, ngram)
                place = np.arange(len(w.hash)) - w.bounds[:-1][w.text]
                firsts = w.bounds[:-1][there]
                whole = [np.add.reduceat(mix(w.hash * np.uint64(2 * c + 1) + place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), firsts) for c in (1, 2)]
                starts = np.searchsorted(text, there)
                # for the number of distinct n-grams: a stable order by text, then hash
                order = np.lexsort((grams, text))
                g, t = grams[order], text[order]
                new = np.ones(len(g), bool)
                new[1:] = (g[1:] != g[:-1]) | (t[1:] != t[:-1])
                n = np.add.reduceat(new.astype(np.int64), starts)
                x = (grams >> np.uint64(32)).astype(np.uint32)
                labels = np.empty((len(there), trees, depth), ">u2")
                for tree in range(trees):
                    for level in range(depth):
                        least = np.minimum.reduceat((x ^ flip[tree, level]) * odd[tree, level], starts)
                        labels[:, tree, level] = least >> np.uint32(16)
                size = 2 * trees * depth
                column = pa.Array.from_buffers(pa.binary(), len(there), [None, pa.py_buffer(np.arange(len(there) + 1, dtype=np.int32) * size), pa.py_buffer(labels.tobytes())])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(there + first)), *(pa.array(h.view(np.int64)) for h in whole), pa.array(n), column], ["doc_id", "words1", "words2", "n", "labels"])

    return docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").mapInArrow(run, "doc_id long, words1 long, words2 long, n long, labels binary")


def _gram_sets(docs: DataFrame, ngram: int) -> DataFrame:
    """doc_id, grams: the sorted distinct n-gram hashes."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in lowered(batch):
                grams, text = shingles(AnyWords(data, offsets), ngram)
                order = np.lexsort((grams, text))
                g, t = grams[order], text[order]
                new = np.ones(len(g), bool)
                new[1:] = (g[1:] != g[:-1]) | (t[1:] != t[:-1])
                g, t = g[new], t[new]
                ends = np.searchsorted(t, np.arange(end - first + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.ListArray.from_arrays(pa.array(ends), pa.array(g.view(np.int64)))], ["doc_id", "grams"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, grams array<long>")


def _shared_grams(grams: np.ndarray, owner: np.ndarray, members: int) -> np.ndarray:
    """How many n-grams every two members share, in column blocks of a bounded size."""
    _, place, count = np.unique(grams, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)  # the others are in no intersection
    column = np.full(len(count), -1)
    column[shared] = np.arange(len(shared))
    place, owner = column[place], owner[column[place] >= 0]
    place = place[place >= 0]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    common = np.zeros((members, members), np.float32)
    step = max(256, (1 << 21) // members)
    for at in range(0, len(shared), step):
        a, b = np.searchsorted(place, (at, at + step))
        part = np.zeros((members, min(step, len(shared) - at)), np.float32)
        part[owner[a:b], place[a:b] - at] = 1
        common += part @ part.T
    return common


def _verify(threshold: float, level: int, above: int, trees: int, depth: int):
    @trimmed
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links between the members of a cell that meet at this level first, each in the node of the first tree where
        they do: of every member with a link the least one that links lead to and their number; and the number of
        links in each bin of similarity."""
        bucket, low, high = pdf["bucket"].iloc[0], pdf["low"].iloc[0], pdf["high"].iloc[0]
        pdf = pdf.sort_values("rep").reset_index(drop=True)
        rep, block = pdf["rep"].to_numpy(np.int64), pdf["block"].to_numpy()
        sizes = pdf["grams"].map(len).to_numpy(np.int64)
        common = _shared_grams(np.concatenate(pdf["grams"].to_list()), np.repeat(np.arange(len(rep)), sizes), len(rep))
        union = sizes[:, None] + sizes[None, :] - common
        linked = common >= threshold * union - 1e-6
        if low != high:
            linked &= block[:, None] != block[None, :]
        a, b = np.nonzero(np.triu(linked, 1))
        nodes = np.stack(pdf["nodes"].to_list())
        labels = np.stack([np.frombuffer(x, ">u2").reshape(trees, depth) for x in pdf["labels"]])
        own = np.empty(len(a), bool)
        for at in range(0, len(a), 1 << 12):
            x, y = a[at : at + (1 << 12)], b[at : at + (1 << 12)]
            same = np.cumprod(labels[x] == labels[y], axis=2, dtype=np.int8).sum(axis=2)
            first = (same >= level).argmax(axis=1)
            own[at : at + (1 << 12)] = (nodes[x, first] == bucket) & (same.max(axis=1) < above) & (same.max(axis=1) >= level)
        a, b = a[own], b[own]
        links = np.bincount(a, minlength=len(rep)) + np.bincount(b, minlength=len(rep))
        alike = common[a, b] / union[a, b]
        bins = np.bincount(np.clip((alike - threshold) / (1 - threshold + 1e-9) * BINS, 0, BINS - 1).astype(np.int64), minlength=BINS)
        root = np.arange(len(rep))  # the least member that links lead to
        while True:
            before = root.copy()
            least = np.minimum(root[a], root[b])
            np.minimum.at(root, a, least)
            np.minimum.at(root, b, least)
            root = root[root]
            if (root == before).all():
                break
        keep = links > 0
        there = np.flatnonzero(bins)
        told = pd.DataFrame({"rep": rep[keep], "root": rep[root[keep]], "links": links[keep], "bin": -1})
        return pd.concat([told, pd.DataFrame({"rep": 0, "root": 0, "links": bins[there], "bin": there})]) if len(there) else told

    return run


def components(edges: DataFrame) -> DataFrame:
    """(rep, class_id): the least member of the connected component of every end of edges (rep, root), root <= rep.

    Rounds of joining each vertex's least neighbour, alternating with the neighbours of neighbours (large and small
    stars); every round is written to the shared folder. Nothing but a count and a sum reaches the driver."""
    edges = materialize(edges.where("rep <> root").distinct(), "edges")
    state = None
    while True:
        both = edges.select(F.col("rep").alias("v"), F.col("root").alias("u")).union(edges.select(F.col("root").alias("v"), F.col("rep").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("rep"), F.col("m").alias("root"))
        large = large.where("rep <> root").distinct()
        small_least = large.groupBy("rep").agg(F.min("root").alias("m"))
        small = large.join(small_least, "rep").select(F.when(F.col("root") == F.col("m"), F.col("rep")).otherwise(F.col("root")).alias("rep"), F.col("m").alias("root"))
        edges = materialize(small.where("rep <> root").distinct(), "edges")
        # a star forest no longer changes: as many edges with the same hash
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("rep", "root").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select("rep", F.col("root").alias("class_id"))
        state = now


def round_of_links(texts: DataFrame, docs: DataFrame, level: int, above: int, threshold: float, ngram: int, trees: int, depth: int) -> DataFrame:
    """(rep, root, links, bin) of the pairs whose longest common prefix in any tree has `level` minima or more, but
    fewer than `above`."""
    prefix = lambda t, k: F.xxhash64(t, F.substring("labels", t * (2 * depth) + 1, F.lit(2 * k)))
    every = F.sequence(F.lit(0), F.lit(trees - 1))
    exploded = texts.select("rep", "n", F.explode(F.transform(every, lambda t: F.struct(t.alias("tree"), prefix(t, level).alias("key"), (prefix(t, above) if above <= depth else F.lit(0).cast("long")).alias("child")))).alias("k")).select("rep", "n", "k.*")
    several = F.count("*") > 1 if above > depth else F.min("child") != F.max("child")
    found = exploded.groupBy("key").agg(F.count("*").alias("members"), F.min("rep").alias("least"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("sum"), F.sum(F.xxhash64(F.lit(7), "rep").cast("decimal(38,0)")).alias("sum2"), several.alias("several")).where("several")
    # nodes of the same members count as one
    found = found.groupBy("members", "least", "sum", "sum2").agg(F.min("key").alias("bucket"), F.collect_list("key").alias("same"))  # at most one key a tree
    nodes = materialize(found.select("bucket", F.explode("same").alias("key")), "nodes")
    member = materialize(exploded.join(nodes, "key").select("rep", "n", "tree", "key", "child", "bucket"), "members")
    of_rep = member.groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("tree", "bucket"))).alias("m")).select("rep", F.transform(every, lambda t: F.coalesce(F.element_at("m", t), F.lit(0))).alias("nodes"))

    # blocks: a large child has its own, as its members have met before; small ones share theirs
    one = member.where("key = bucket").select("bucket", "rep", "n", "child")
    needed = lambda count, total: F.ceil(F.greatest(count / BLOCK, total / GRAMS)).cast("int")
    sized = one.groupBy("bucket", "child").agg(F.count("*").alias("c"), F.sum("n").alias("g")).withColumn("own", (F.col("c") > BLOCK // 4) & F.lit(above <= depth))
    sized = materialize(sized.withColumn("share", F.when(F.col("own"), needed(F.col("c"), F.col("g"))).otherwise(0)), "children")
    w = Window.partitionBy("bucket").orderBy("child").rowsBetween(Window.unboundedPreceding, -1)
    large = sized.where("own").withColumn("from", F.coalesce(F.sum("share").over(w), F.lit(0)).cast("int")).select("bucket", "child", "from", "share")
    whole = sized.groupBy("bucket").agg(F.sum("share").cast("int").alias("owned"), needed(F.sum(F.when(~F.col("own"), F.col("c")).otherwise(0)), F.sum(F.when(~F.col("own"), F.col("g")).otherwise(0))).alias("rest"))
    dealt = one.join(whole, "bucket").join(large, ["bucket", "child"], "left").withColumn("deal", F.xxhash64("rep", F.lit(3)))
    dealt = dealt.withColumn("block", F.when(F.col("share").isNotNull(), F.col("from") + F.pmod("deal", F.col("share"))).otherwise(F.col("owned") + F.pmod("deal", F.greatest("rest", F.lit(1)))).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("owned") + F.col("rest") - 1), lambda b: F.col("share").isNull() | (b < F.col("from")) | (b >= F.col("from") + F.col("share")))
    cells = dealt.select("rep", "bucket", "block", F.explode(others).alias("other")).select("rep", "bucket", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    reps = member.select(F.col("rep").alias("doc_id")).distinct()
    grams = _gram_sets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(reps.hint("merge"), "doc_id", "left_semi"), ngram).dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "rep")
    grams = materialize(grams.join(of_rep, "rep").join(texts.select("rep", "labels"), "rep"), "grams")
    return materialize(cells.join(grams, "rep").groupBy("bucket", "low", "high").applyInPandas(_verify(threshold, level, above, trees, depth), "rep long, root long, links long, bin int"), "links")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, ngram: int = 5, trees: int = 16, depth: int = 8, recall: float = 0.9999) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, class_id (least doc_id of its group of linked texts), text_id
    (least doc_id with the same words), copies (other rows with the same words) and links (different texts whose
    n-gram sets have a Jaccard similarity of `threshold` or more).

    Words are runs of letters, digits and marks, in lower case; in scripts without spaces every character is one. A
    text of fewer than `ngram` words has one n-gram, of all its words. `recall` is the estimated share of links at
    which prefixes aren't shortened further. Texts that are null, empty or without a word are classes of their own and
    have no links, and so are rows with a null doc_id, whose ids stay null. Rows with a repeated doc_id all have the
    class, text and links of that of its texts whose class is least. Other columns are dropped, whatever their names.
    An empty table gives an empty one."""
    signed = materialize(signatures(docs, ngram, trees, depth), "signatures")
    texts = signed.groupBy("words1", "words2").agg(F.min("doc_id").alias("rep"), (F.count("*") - 1).alias("copies"), F.min_by(F.struct("labels", "n"), "doc_id").alias("s")).select("words1", "words2", "rep", "copies", "s.*")
    # a repeated doc_id can stand for several texts: the join takes one of them
    texts = materialize(texts, "texts")
    joined = texts.groupBy("rep").agg(F.min_by(F.struct("labels", "n"), F.struct("words1", "words2")).alias("s")).select("rep", "s.*")

    rounds, bins, above, level = [], {}, depth + 1, depth
    while level < above:
        found = round_of_links(joined, docs, level, above, threshold, ngram, trees, depth)
        rounds.append(found.where("bin < 0").select("rep", "root", "links"))
        for r in found.where("bin >= 0").groupBy("bin").agg(F.sum("links")).collect():
            bins[r[0]] = bins.get(r[0], 0) + r[1]
        above, level = level, next((k for k in range(level, 1, -1) if estimated_recall(bins, threshold, k, trees) >= recall), 1)
    found = reduce(DataFrame.union, rounds)

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = components(found.select("rep", "root"))
    of_text = texts.select("words1", "words2", "copies", "rep").join(links, "rep", "left").join(classes, "rep", "left")
    of_doc = signed.select("doc_id", "words1", "words2").distinct().join(of_text, ["words1", "words2"])
    of_doc = of_doc.groupBy(F.col("doc_id").alias("_id")).agg(F.min(F.struct(F.coalesce("class_id", "rep").alias("class_id"), "rep", "copies", "links")).alias("s")).select("_id", "s.*")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(of_doc, F.col("doc_id") == F.col("_id"), "left")
    return rows.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("rep", "doc_id").alias("text_id"), F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents of which each is the least doc_id of its class; rows with a null doc_id stay. Of rows with a
    repeated doc_id one stays, that with the least text. Other columns stay and may have any names; nulls, empty texts
    and an empty table as in near_duplicates."""
    classes = near_duplicates(docs, **options)
    name, count, row = (free_name(x, docs) for x in ("_id", "_rows", "_row"))
    kept = classes.where("doc_id = class_id").groupBy(F.col("doc_id").alias(name)).agg(F.count("*").alias(count))
    kept = materialize(kept, "kept")
    # the same join at every size: ids of kept documents grow with the table
    part = lambda test: docs.join(kept.where(test).hint("merge"), F.col("doc_id") == F.col(name), "left_semi")
    one = part(F.col(count) == 1)
    if kept.where(F.col(count) > 1).isEmpty():
        return one.unionByName(docs.where("doc_id is null"))
    columns = [c for c in docs.columns if c != "doc_id"]
    again = part(F.col(count) > 1).groupBy("doc_id").agg(F.min(F.struct("text", *[c for c in columns if c != "text"])).alias(row)).select("doc_id", *[F.col(row)[c].alias(c) for c in columns])
    return one.unionByName(again.select(docs.columns)).unionByName(docs.where("doc_id is null"))
