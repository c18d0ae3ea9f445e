"""Differences of two snapshots: full outer joins by identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.evidence import Graph

CLAIM = ("field", "key", "value", "level_rank", "n", "first_ns", "last_ns", "sources", "trace_ids")


def _claims_differ(before: Graph, after: Graph) -> DataFrame:
    """graph_id, id, other: nodes of which a claim differs in anything, by a full outer join of single claims."""
    keys = ["graph_id", "node_id", "field", "key", "value"]
    a, b = (g.claims.select(*keys, F.struct(*[c for c in CLAIM if c not in keys]).alias(side)) for g, side in ((before, "x"), (after, "y")))
    return a.join(b, keys, "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select("graph_id", F.col("node_id").alias("id"), F.lit(True).alias("other")).distinct()


def _differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def _map(side: str, name: str) -> Column:
    """Maps as sorted entries; null and empty are the same."""
    entries = F.array_sort(F.map_entries(F.col(f"{side}.{name}")))
    return F.when(F.size(entries) > 0, entries)


def _change(fields: Column | None) -> Column:
    out = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed")
    return out.when(F.size(fields) > 0, "changed")


def diff_nodes(before: Graph, after: Graph) -> DataFrame:
    """graph_id, id, change, fields (in fixed order), before, after: nodes that are added, removed or changed."""
    a = before.nodes.select("graph_id", "id", F.struct("*").alias("a"))
    b = after.nodes.select("graph_id", "id", F.struct("*").alias("b"))
    one = lambda name, test: F.when(test, F.lit(name))
    versions = lambda s: F.array_sort(F.array_distinct(F.filter(F.coalesce(F.col(f"{s}.observed_versions"), F.array().cast("array<string>")), lambda v: v != "")))
    fields = F.array_compact(F.array(
        one("name", _differs(F.col("a.name"), F.col("b.name"))),
        one("version", _differs(F.col("a.version"), F.col("b.version")) | _differs(versions("a"), versions("b"))),
        one("provider", _differs(F.col("a.provider"), F.col("b.provider"))),
        one("digests", _differs(_map("a", "digests"), _map("b", "digests"))),
        one("properties", _differs(_map("a", "properties"), _map("b", "properties"))),
        one("fieldEvidence", F.coalesce("other", F.lit(False))),
        one("evidence.level", _differs(F.col("a.level_rank"), F.col("b.level_rank"))),
    ))
    return _rows(a.join(b, ["graph_id", "id"], "full_outer").join(_claims_differ(before, after), ["graph_id", "id"], "left"), "node", fields)


def diff_edges(before: Graph, after: Graph) -> DataFrame:
    """The same for edges, of which only the level can change."""
    a = before.edges.select("graph_id", "id", F.struct("*").alias("a"))
    b = after.edges.select("graph_id", "id", F.struct("*").alias("b"))
    fields = F.array_compact(F.array(F.when(_differs(F.col("a.level_rank"), F.col("b.level_rank")), F.lit("evidence.level"))))
    return _rows(a.join(b, ["graph_id", "id"], "full_outer"), "edge", fields)


def _rows(joined: DataFrame, entity: str, fields: Column) -> DataFrame:
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    rows = joined.withColumn("fields", F.when(both, fields).otherwise(F.array().cast("array<string>"))).withColumn("change", _change(F.col("fields")))
    return rows.where("change is not null").select("graph_id", F.lit(entity).alias("entity"), "change", "id", "fields", F.col("a").alias("before"), F.col("b").alias("after"))


def report(before: Graph, after: Graph) -> DataFrame:
    """Both diffs as one long table, in order: graph_id, entity, change, id, fields, before and after (JSON)."""
    parts = [d.withColumns({"before": F.to_json("before"), "after": F.to_json("after")}) for d in (diff_nodes(before, after), diff_edges(before, after))]
    return parts[0].unionByName(parts[1]).orderBy("graph_id", F.desc("entity"), "change", "id")


def has_changes(found: DataFrame, graphs: DataFrame) -> DataFrame:
    """graph_id, has_changes of every graph in graphs(graph_id), from rows of a diff."""
    return graphs.select("graph_id").distinct().join(found.select("graph_id", F.lit(True).alias("c")).distinct(), "graph_id", "left").select("graph_id", F.coalesce("c", F.lit(False)).alias("has_changes"))


def contract(g: Graph) -> DataFrame:
    """The core of a graph that two frameworks' traces of one workload share: names and relations, no evidence."""
    nodes = g.nodes.where(F.col("type").isin("agent", "model", "tool")).select("graph_id", F.lit("node").alias("entity"), "id", F.col("type").alias("what"), F.col("provider").alias("other"))
    edges = g.edges.where(F.col("relation").isin("uses", "invokes")).select("graph_id", F.lit("edge"), "from_id", "relation", "to_id")
    return nodes.union(edges).distinct()


def contract_difference(a: Graph, b: Graph) -> DataFrame:
    """Rows that only one of two cores has, with side 1 or 2; none if they agree."""
    x, y = contract(a), contract(b)
    return x.exceptAll(y).withColumn("side", F.lit(1)).union(y.exceptAll(x).withColumn("side", F.lit(2)))
