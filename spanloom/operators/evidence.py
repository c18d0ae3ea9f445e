"""Evidence summaries, claims and their resolution: one set of aggregates for batch, merge and stream."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.attributes import level_name
from spanloom.operators import extract
from spanloom.plans.store import materialize

#: Trace ids kept for each node, edge and value: the smallest.
TRACES = 20


@dataclass
class Graph:
    """nodes, edges and claims of any number of graphs, told apart by graph_id; graphs has a header row for each."""

    nodes: DataFrame
    edges: DataFrame
    claims: DataFrame
    graphs: DataFrame | None = None


#: The version of the tables' layout, and what every header says.
SCHEMA_VERSION = "1"
METADATA = {"privacy.mode": "metadata-only", "normalizer.version": SCHEMA_VERSION}


def headers(ids: DataFrame, source: Column | str, generated_ns: Column | int) -> DataFrame:
    """graph_id, schema_version, generated_ns, source and metadata of ids(graph_id), which may repeat; the source and
    time that are given are aggregates over the rows of a graph, or constants."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    found = ids.groupBy("graph_id").agg(as_column(generated_ns).cast("long").alias("generated_ns"), as_column(source).alias("source"))
    metadata = F.create_map(*[F.lit(x) for kv in METADATA.items() for x in kv])
    return found.select("graph_id", F.lit(SCHEMA_VERSION).alias("schema_version"), "generated_ns", "source", metadata.alias("metadata"))


def single(df: DataFrame) -> DataFrame:
    """Rows of single observations in the shape of summaries."""
    return df.withColumns({"n": F.lit(1).cast("long"), "first_ns": F.col("ts_ns"), "last_ns": F.col("ts_ns"), "sources": F.array_compact(F.array(F.nullif("source", F.lit("")))), "trace_ids": F.array_compact(F.array(F.nullif("trace_id", F.lit(""))))})


def summarise(df: DataFrame, keys: list[str], extra: list[Column]) -> DataFrame:
    """Strongest level, count, first and last time, distinct sources and the smallest distinct trace ids for each key.

    Trace ids are made distinct by (key, id) first and then ranked, the rank being pruned before the exchange, so a
    hot key never gathers them in one buffer."""
    sources = F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources"))))
    main = df.groupBy(*keys).agg(F.max("level_rank").alias("level_rank"), F.sum("n").alias("n"), F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns"), sources.alias("sources"), *extra)
    traces = df.select(*keys, F.explode("trace_ids").alias("t")).distinct()
    traces = traces.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("t"))).where(F.col("r") <= TRACES)
    traces = traces.groupBy(*keys).agg(F.array_sort(F.collect_list("t")).alias("trace_ids"))
    out = main.join(traces, keys, "left")
    return out.withColumns({"trace_ids": F.coalesce("trace_ids", F.array().cast("array<string>")), "level": level_name(F.col("level_rank"))})


def node_summaries(df: DataFrame) -> DataFrame:
    """By id; type, name and provider are the first seen."""
    return summarise(df, ["graph_id", "id"], [F.min_by("type", "seq").alias("type"), F.min_by(F.struct("name"), "seq")["name"].alias("name"), F.min_by("provider", "seq").alias("provider"), F.min("seq").alias("seq")])


def edge_summaries(df: DataFrame) -> DataFrame:
    return summarise(df, ["graph_id", "id"], [F.min("from_id").alias("from_id"), F.min("to_id").alias("to_id"), F.min("relation").alias("relation")])


def claim_summaries(df: DataFrame) -> DataFrame:
    return summarise(df, ["graph_id", "node_id", "field", "key", "value"], [])


def resolve(claims: DataFrame) -> DataFrame:
    """Adds rank (1 wins: strongest, then latest, then smallest value), selected and conflict to claims."""
    field = Window.partitionBy("graph_id", "node_id", "field", "key")
    order = field.orderBy(F.desc("level_rank"), F.desc_nulls_last("last_ns"), "value")
    ranked = claims.withColumns({"rank": F.row_number().over(order), "conflict": F.count("*").over(field) > 1})
    return ranked.withColumn("selected", F.col("rank") == 1).select(*claims.columns, "rank", "conflict", "selected")


def materialise_fields(nodes: DataFrame, claims: DataFrame) -> DataFrame:
    """Adds version, observed_versions, digests and properties from the claims to nodes."""
    resolved = resolve(claims)
    won = F.col("selected")
    pairs = lambda field: F.map_from_entries(F.array_sort(F.collect_list(F.when(won & (F.col("field") == field), F.struct("key", "value")))))
    fields = resolved.groupBy("graph_id", F.col("node_id").alias("id")).agg(
        F.max(F.when(won & (F.col("field") == "version"), F.col("value"))).alias("version"),
        F.array_sort(F.collect_list(F.when(F.col("field") == "version", F.col("value")))).alias("observed_versions"),
        pairs("digest").alias("digests"), pairs("property").alias("properties"),
    )
    nothing = F.create_map().cast("map<string,string>")
    return nodes.join(fields, ["graph_id", "id"], "left").withColumns({"version": F.coalesce("version", F.lit("")), "observed_versions": F.coalesce("observed_versions", F.array().cast("array<string>")), "digests": F.coalesce("digests", nothing), "properties": F.coalesce("properties", nothing)})


def build(obs: DataFrame) -> Graph:
    """The graph of observations whose context is already filled in."""
    # extracted once: six aggregates read it; claims are far fewer, and fields, diffs and policies read them again
    found = materialize(extract.occurrences(obs), "occurrences")
    nodes = node_summaries(single(extract.node_rows(found)).withColumn("seq", F.col("obs_seq")))
    claims = materialize(claim_summaries(single(extract.claim_rows(found))), "claims")
    return Graph(materialise_fields(nodes, claims), edge_summaries(single(extract.edge_rows(found))), claims)
