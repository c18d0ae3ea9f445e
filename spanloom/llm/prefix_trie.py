"""The trie of conversations' common beginnings.

A turn is told by 124 bits of the SHA-256 of its role and text, taken where the row is read; texts aren't shuffled. A
conversation is one row: its turns' ids as one run of bytes, and their word counts. Rows are dealt into shards by ranges
of (ids, conversation), so that conversations that begin alike lie side by side and even copies of one conversation
spread over shards by its number.

Within a shard turn ids are matrices padded with zeros, 16 turns wide; a later matrix holds only the conversations that
are long enough, so memory follows the number of turns and not the longest conversation. Rows are brought into order by
lexsort; a row starts a node at a depth where any column up to there differs from the row above, which is the mask of
changes OR-accumulated along the columns. Members, smallest members and, from the deepest level up, children, leaves and
tokens are added up with reduceat over these starts.

Only nodes on the way to a shard's first or last row can go on in another shard. A shard gives these as boundary nodes,
under a key (chained SHA-256 of the turns), and without what its boundary children hold. They are recombined by key; of
those that several shards have, sums over subtrees are taken in rounds in which every node adds to its ancestor 1, 2, 4,
.. levels up. All other nodes are final as the shard gives them, but for the number of a shared parent.

The list of conversations that end at a node is hashed as one text. The part that a shard has of it is in order; where
several shards have parts, pieces of PIECE numbers are put in order and fed to the hash one after the other, so memory
is bounded, though one node's bytes go through one task, as SHA-256 is sequential.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import materialize, trimmed

#: Turns of a matrix, bytes of a turn's id, and conversation numbers of a piece.
WIDTH, ID, PIECE = 16, 16, 512
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE, BOUNDARY, ENDS = 0, 1, 2
SHARD_SCHEMA = (
    "kind int, shard int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "key binary, parent_key binary, tokens long, own_children long, own_leaves long, own_saved long, piece long, ids string"
)
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def words(text: Column) -> Column:
    """Words that white space divides."""
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns: (id, tokens) in the order of turn). Turns with one number are in the order of their ids."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    # the length of the role parts it from the text; the first byte is never zero, as padding is
    digest = F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256)
    turn = F.struct(F.col("turn").isNotNull().alias("numbered"), F.col("turn").alias("turn"), F.unhex(F.concat(F.lit("1"), F.substring(digest, 1, 2 * ID - 1))).alias("id"), words(text).alias("tokens"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("turn")), lambda t: F.struct(t["id"].alias("id"), t["tokens"].alias("tokens"))).alias("turns"))


def shared_beginnings(found: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations rebuilt: the first h turns of conversation c - c % every, then c's own after its first h, where
    h = crc32(c as text) % most; % has the sign of c."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    base = found.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("above"))
    rows = found.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % every}).join(base, "base", "left")
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return rows.select("conv_id", F.concat(F.coalesce(F.slice("above", F.lit(1), F.col("h")), F.array().cast(found.schema["turns"].dataType)), own).alias("turns"))


def paths(rebuilt: DataFrame) -> DataFrame:
    """(conv_id, path: the ids of all turns, tokens: their words)."""
    whole = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), ""))
    return rebuilt.select("conv_id", whole.alias("path"), F.transform("turns", lambda t: t["tokens"]).alias("tokens"))


class Level:
    """The nodes of one depth: parent (index in the level above), n, conv, tokens of the last turn, some member's row."""

    def __init__(self, parent: np.ndarray, n: np.ndarray, conv: np.ndarray, tokens: np.ndarray):
        self.parent, self.n, self.conv, self.tokens = parent, n, conv, tokens
        self.ends, self.pieces = [NO_ENDS] * len(n), {}


def levels(conv: np.ndarray, ids: np.ndarray, tokens: np.ndarray, bounds: np.ndarray) -> list[Level]:
    """All nodes of a shard, by depth; ids are pairs of 64 bits, row k's turns are bounds[k] : bounds[k + 1]."""
    size = np.diff(bounds)
    out = [Level(np.zeros(1, np.int64), np.array([len(conv)]), np.array([conv.min()]), np.zeros(1, np.int64))]
    at = np.zeros(len(conv), np.int64)
    rank = np.zeros(len(conv), np.int64)
    ending = np.argsort(size, kind="stable")
    ending_at = np.searchsorted(size[ending], np.arange(int(size.max()) + 2))
    _ends(out[0], conv, at, ending[: ending_at[1]])
    for left in range(0, int(size.max()), WIDTH):
        rows = np.flatnonzero(size > left)
        wide = min(WIDTH, int(size.max()) - left)
        turn = bounds[rows][:, None] + left + np.arange(wide)
        there = left + np.arange(wide) < size[rows][:, None]
        matrix = np.zeros((len(rows), wide, 2), np.uint64)
        matrix[there] = ids[turn[there]]
        keys = matrix.reshape(len(rows), -1)
        order = np.lexsort((*keys.T[::-1], rank[rows]))
        rows, matrix, there = rows[order], matrix[order], there[order]
        change = np.ones((len(rows), wide), bool)
        change[1:] = (matrix[1:] != matrix[:-1]).any(axis=2)
        change[1:, 0] |= rank[rows[1:]] != rank[rows[:-1]]
        np.logical_or.accumulate(change, axis=1, out=change)
        for k in range(wide):
            deep = np.flatnonzero(there[:, k])
            start = np.flatnonzero(change[deep, k])
            members = rows[deep]
            head = members[start]
            level = Level(at[head], np.diff(np.append(start, len(deep))), np.minimum.reduceat(conv[members], start), tokens[bounds[head] + left + k])
            at[members] = np.cumsum(change[deep, k]) - 1
            d = left + k + 1
            _ends(level, conv, at, ending[ending_at[d] : ending_at[d + 1]])
            out.append(level)
        rank[rows] = np.cumsum(change[:, -1])
    return out


def _ends(level: Level, conv: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Hashes and pieces of the numbers of conversations that end in the nodes of a level."""
    if not len(rows):
        return
    rows = rows[np.lexsort((conv[rows], at[rows]))]
    start = np.flatnonzero(np.append(True, at[rows[1:]] != at[rows[:-1]]))
    for a, b in zip(start.tolist(), [*start[1:].tolist(), len(rows)], strict=True):
        node = int(at[rows[a]])
        numbers = conv[rows[a:b]]
        whole = hashlib.sha256()
        for k in range(0, len(numbers), PIECE):
            whole.update((("," if k else "") + ",".join(map(str, numbers[k : k + PIECE].tolist()))).encode())
        level.ends[node], level.pieces[node] = whole.hexdigest(), numbers


def _chain(path: bytes) -> list[bytes]:
    """Keys of all beginnings of a path, from the root."""
    h, out = hashlib.sha256(), []
    for k in range(0, len(path) + 1, ID):
        out.append(h.digest())
        h.update(path[k : k + ID])
    return out


def shard_rows(shard: int, conv: np.ndarray, path: list[bytes], tokens: np.ndarray):
    """Record batches of all nodes of a shard, boundary nodes and pieces of their ends."""
    size = np.array([len(p) // ID for p in path])
    bounds = np.concatenate([[0], np.cumsum(size)])
    ids = np.frombuffer(b"".join(path), ">u8").astype(np.uint64).reshape(-1, 2)
    ways = [_chain(end(zip(path, conv.tolist(), strict=True))[0]) for end in (min, max)]
    found = levels(conv, ids, tokens, bounds)
    # indices of boundary nodes by level, with their keys: the first node on the way to the first row, the last to the last
    edge = [{} for _ in found]
    for way, pick in zip(ways, (lambda lv: 0, lambda lv: len(lv.n) - 1), strict=True):
        for d, key in enumerate(way):
            edge[d][pick(found[d])] = key

    done = []
    for d in range(len(found) - 1, -1, -1):
        level = found[d]
        n = len(level.n)
        total, own = np.zeros((3, n), np.int64), np.zeros((3, n), np.int64)
        if done:
            below, sums = found[d + 1], done[-1][0]
            inner = np.ones(len(below.n), bool)
            inner[list(edge[d + 1])] = False
            # children of a node lie side by side
            first = np.flatnonzero(np.append(True, below.parent[1:] != below.parent[:-1]))
            parts = np.stack([np.ones(len(below.n), np.int64), sums[1], sums[2]])
            total[:, below.parent[first]] = np.add.reduceat(parts, first, axis=1)
            own[:, below.parent[first]] = np.add.reduceat(parts * inner, first, axis=1)
        total[1] += total[0] == 0
        total[2] += (level.n - 1) * level.tokens
        done.append((total, own))
    done.reverse()
    for d, (level, (total, own)) in enumerate(zip(found, done, strict=True)):
        yield _node_batch(shard, d, level, found[d - 1] if d else None, total, own, edge[d], edge[d - 1] if d else {})
        for k in edge[d].keys() & level.pieces.keys():
            yield from _piece_batches(shard, edge[d][k], level.pieces[k])


def _batch(n: int, **columns) -> pa.RecordBatch:
    arrays, names = [], []
    for part in SHARD_SCHEMA.split(", "):
        name, kind = part.split()
        kind = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[kind]
        value = columns.get(name)
        arrays.append(pa.nulls(n, kind) if value is None else pa.array(value, kind))
        names.append(name)
    return pa.RecordBatch.from_arrays(arrays, names)


def _node_batch(shard: int, d: int, level: Level, above: Level | None, total: np.ndarray, own: np.ndarray, edge: dict, edge_above: dict) -> pa.RecordBatch:
    n = len(level.n)
    parent = level.parent.tolist()
    return _batch(
        n, kind=[BOUNDARY if k in edge else NODE for k in range(n)], shard=[shard] * n, conv_id=level.conv, depth=[d] * n,
        parent_conv_id=above.conv[level.parent] if above else None, n_convs=level.n, n_children=total[0], n_leaves=total[1], saved_tokens=total[2], ends_sha256=level.ends,
        key=[edge.get(k) for k in range(n)], parent_key=[edge_above.get(p) for p in parent], tokens=level.tokens,
        own_children=own[0], own_leaves=own[1], own_saved=own[2],
    )


def _piece_batches(shard: int, key: bytes, numbers: np.ndarray):
    for k in range(0, len(numbers), PIECE * 256):
        part = [",".join(map(str, numbers[j : j + PIECE].tolist())) for j in range(k, min(len(numbers), k + PIECE * 256), PIECE)]
        yield _batch(len(part), kind=[ENDS] * len(part), shard=[shard] * len(part), key=[key] * len(part), piece=[k // PIECE + j for j in range(len(part))], ids=part)


def _of_shard(batches):
    conv, path, tokens = [], [], []
    for batch in batches:
        conv.append(batch.column(0).to_numpy(zero_copy_only=False))
        path += batch.column(1).to_pylist()
        tokens.append(batch.column(2).flatten().to_numpy(zero_copy_only=False))
    if path:
        yield from shard_rows(TaskContext.get().partitionId(), np.concatenate(conv).astype(np.int64), path, np.concatenate(tokens).astype(np.int64))


def _hashed(batches):
    """Hashes of pieces that come in order."""
    key, h = None, None
    for batch in batches:
        out = []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    out.append((key, h.hexdigest()))
                key, h = k, hashlib.sha256()
            else:
                h.update(b",")
            h.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([x for _, x in out])], ["key", "whole_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()])], ["key", "whole_sha256"])


def _subtree_sums(nodes: DataFrame, values: list[str], most: int) -> DataFrame:
    """(key, values) added up over subtrees, from nodes(key, parent_key, values) of at most so many levels. After a round
    every node holds the sums of the levels down to twice as far as before, and points twice as far up."""
    state, reach = nodes.select("key", F.col("parent_key").alias("up"), *values), 1
    while reach < most:
        given = state.where("up is not null").groupBy(F.col("up").alias("key")).agg(*(F.sum(v).alias(f"_{v}") for v in values))
        above = state.select(F.col("key").alias("up"), F.col("up").alias("next"))
        state = state.join(above, "up", "left").join(given, "key", "left").select("key", F.col("next").alias("up"), *((F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values))
        reach *= 2
        if reach < most:
            state = materialize(state, "trie-sums")
    return state.select("key", *values)


def trie(found: DataFrame) -> DataFrame:
    """All nodes of the trie of paths(conv_id, path, tokens), each conv_id once."""
    found = materialize(found, "trie-paths")
    rows = materialize(found.repartitionByRange("path", "conv_id").mapInArrow(trimmed(_of_shard), SHARD_SCHEMA), "trie-shards")
    edge = rows.where(F.col("kind") == BOUNDARY)
    same = edge.groupBy("key").agg(
        F.count("*").alias("shards"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent_key").alias("parent_key"), F.sum("n_convs").alias("n_convs"), F.min("tokens").alias("tokens"),
        F.sum("own_children").alias("children"), F.sum("own_leaves").alias("leaves"), F.sum("own_saved").alias("saved"),
        F.count_if(F.col("ends_sha256") != NO_ENDS).alias("parts"), F.max(F.when(F.col("ends_sha256") != NO_ENDS, F.col("ends_sha256"))).alias("ends"),
    )
    shared = materialize(same.where("shards > 1"), "trie-shared")
    alone = edge.join(shared.select("key"), "key", "left_anti")

    # children of shared nodes: shared ones, and boundary nodes that turned out to be one shard's own
    ours = alone.select(F.col("parent_key").alias("key"), F.lit(1).alias("c"), F.col("n_leaves").alias("l"), F.col("saved_tokens").alias("s"))
    theirs = shared.select(F.col("parent_key").alias("key"), F.lit(1), F.lit(0), F.lit(0))
    more = ours.union(theirs).where("key is not null").groupBy("key").agg(F.sum("c").alias("c"), F.sum("l").alias("l"), F.sum("s").alias("s"))
    nodes = shared.join(more, "key", "left").withColumn("n_children", F.col("children") + F.coalesce("c", F.lit(0)))
    nodes = nodes.withColumns({"n_leaves": F.col("leaves") + F.coalesce("l", F.lit(0)) + (F.col("n_children") == 0).cast("long"), "saved_tokens": F.col("saved") + F.coalesce("s", F.lit(0)) + (F.col("n_convs") - 1) * F.col("tokens")})
    nodes = materialize(nodes, "trie-joined")
    deepest = nodes.agg(F.max("depth")).first()[0]
    sums = _subtree_sums(nodes, ["n_leaves", "saved_tokens"], 1 if deepest is None else deepest + 1)

    split = nodes.where("parts > 1").select("key")
    pieces = rows.where(F.col("kind") == ENDS).join(split, "key", "left_semi").select("key", "ids", "shard", "piece")
    ends = pieces.repartition("key").sortWithinPartitions("key", "shard", "piece").select("key", "ids").mapInArrow(_hashed, "key binary, whole_sha256 string")
    numbers = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_number"))
    nodes = nodes.drop("n_leaves", "saved_tokens").join(sums, "key").join(ends, "key", "left").join(numbers, "parent_key", "left")
    nodes = nodes.withColumns({"parent_conv_id": F.col("parent_number"), "ends_sha256": F.coalesce("whole_sha256", "ends", F.lit(NO_ENDS))})

    # the number of a shared parent, by shard: a shard's rows are bounded, a parent's children aren't
    held = edge.select("shard", F.col("key").alias("parent_key")).join(numbers, "parent_key")
    local = rows.where(F.col("kind") == NODE).select(*COLUMNS, "shard", "parent_key").unionByName(alone.select(*COLUMNS, "shard", "parent_key"))
    inner = local.where("parent_key is null").select(COLUMNS)
    outer = local.where("parent_key is not null").join(held, ["shard", "parent_key"], "left").withColumn("parent_conv_id", F.coalesce("parent_number", "parent_conv_id")).select(COLUMNS)
    return inner.unionByName(outer).unionByName(nodes.select(COLUMNS))


def conversation_trie(conversations: DataFrame, rebuild=shared_beginnings) -> DataFrame:
    """The trie of conversations(conv_id, turn, role, text), each row a node: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. `rebuild` maps turns(conv_id, turns) before
    the trie is built; None leaves them.

    Turns are ordered by turn, null first, those with one number by their ids, whatever the order of rows; repeated rows
    are turns of their own. A null role or text is empty. Rows without a conv_id take no part; other columns aren't read.
    Without a conversation there is no node, not even a root. A conversation is one row of 40 bytes a turn or less, and
    has to fit into a task."""
    found = turns(conversations)
    return trie(paths(rebuild(found) if rebuild else found))
