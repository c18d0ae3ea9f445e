"""Batch scan: observations to a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.attributes import metadata_only, span_key
from spanloom.operators import context, evidence
from spanloom.operators.evidence import Graph


def first_seen(obs: DataFrame) -> DataFrame:
    """Of observations with one span key the first by obs_seq; those without a key all stay."""
    rows = obs.withColumn("_key", span_key(F.col("trace_id"), F.col("span_id")))
    w = Window.partitionBy("graph_id", "_key").orderBy("obs_seq")
    once = rows.where("_key is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return once.unionByName(rows.where("_key is null")).drop("_key")


def scan(obs: DataFrame, hmac_key: bytes | None = None, dedup: bool = False) -> Graph:
    """Context, suppression, extraction and aggregation. Prompt content is hashed with the key, or only noted."""
    rows = first_seen(obs) if dedup else obs
    if hmac_key:
        rows = rows.withColumn("attrs", F.map_concat("attrs", F.map_filter(metadata_only(F.col("attrs"), hmac_key), lambda k, v: k.startswith("aiebom.prompt.") & ~F.array_contains(F.map_keys("attrs"), k))))
    return evidence.build(context.in_context(rows))
