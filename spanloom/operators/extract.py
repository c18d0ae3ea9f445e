"""Entities, relations and claims of observations: one projection without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.attributes import DISCOVERY, PROMPT_HMAC, PROMPT_PRESENT, PROPERTIES, edge_id, has_genai, level_rank, looked_up, lookups, node_id, nonblank, trim, trimmed_values


def _named(span_name: Column, operation: Column, wanted: str) -> Column:
    """The entity in a span name "<operation> <entity>"."""
    return F.when((operation == wanted) & span_name.startswith(wanted + " "), nonblank(F.substr(span_name, F.lit(len(wanted) + 2))))


def with_entities(obs: DataFrame) -> DataFrame:
    """Adds `trimmed`, the attributes as they are looked up, and a struct for each kind of entity: (name, identity,
    version, provider, digest), null where there is none."""
    obs = obs.withColumn("trimmed", trimmed_values(F.col("attrs")))
    obs = obs.withColumn("found", lookups(F.col("trimmed")))
    get = lambda name: looked_up(F.col("found"), name)
    other = lambda key: F.element_at("trimmed", key)
    operation, span_name = get("operation"), get("span_name")
    blank = F.lit(None).cast("string")

    def entity(name: Column, identity: Column, version: Column, provider: Column, digest: Column = blank) -> Column:
        return F.when(name.isNotNull(), F.struct(name.alias("name"), F.coalesce(identity, name).alias("identity"), version.alias("version"), F.coalesce(provider, F.lit("")).alias("provider"), digest.alias("digest")))

    obs = obs.withColumn("own_agent", F.coalesce(get("agent_name"), _named(span_name, operation, "invoke_agent")))
    own, service = F.col("own_agent"), F.when(has_genai(F.col("attrs")) & other(DISCOVERY).isNull(), get("service"))
    agent = entity(F.coalesce(own, service), get("agent_id"), F.coalesce(get("agent_version"), F.when(own.isNull(), other("service.version"))), get("agent_provider"))
    response, model_provider = get("response_model"), get("model_provider")
    model_name = F.coalesce(get("request_model"), response)
    model = entity(model_name, blank, F.when(response != model_name, response), model_provider, F.regexp_replace(get("model_digest"), "^sha256:", ""))
    mcp = entity(get("mcp_name"), get("mcp_id"), get("mcp_version"), get("mcp_provider"))
    tool = entity(F.coalesce(get("tool_name"), _named(span_name, operation, "execute_tool")), blank, get("tool_version"), F.coalesce(get("mcp_name"), model_provider))
    data = entity(get("data_source"), blank, blank, get("data_provider"))
    content = get("prompt_content").isNotNull() | F.coalesce(F.element_at("attrs", PROMPT_PRESENT) == "true", F.lit(False))
    prompt = entity(F.coalesce(get("prompt_name"), F.when(content, F.lit("system-instructions"))), blank, get("prompt_version"), blank, other(PROMPT_HMAC))
    return obs.withColumns({"agent": agent, "model": model, "mcp_server": mcp, "tool": tool, "data_source": data, "prompt": prompt}).drop("found", "own_agent")


KINDS = ("agent", "model", "mcp_server", "tool", "data_source", "prompt")
#: Relations: source, name, target.
RELATIONS = (("agent", "uses", "model"), ("agent", "connects_to", "mcp_server"), ("agent", "invokes", "tool"), ("mcp_server", "provides", "tool"), ("agent", "reads_from", "data_source"), ("agent", "uses_prompt", "prompt"))
EVIDENCE = ("graph_id", "obs_seq", "ts_ns", "level_rank", "source", "trace_id")


def _claims(kind: Column, e: Column, trimmed: Column) -> Column:
    """array of (field, key, value) that an observation says of its entity."""
    said = lambda field, key, value: F.struct(F.lit(field).alias("field"), (F.lit(key) if isinstance(key, str) else key).alias("key"), value.alias("value"))
    prompt = kind == "prompt"
    own = F.array(
        said("version", "", e["version"]),
        said("digest", F.when(prompt, "hmac-sha256").otherwise("sha256"), trim(e["digest"])),
        said("property", "content.retained", F.when(prompt, "false")),
        said("property", "content.hashed", F.when(prompt, F.when(e["digest"].isNotNull(), "true").otherwise("false"))),
    )
    keys = F.coalesce(F.element_at(F.create_map(*[x for k, names in PROPERTIES.items() for x in (F.lit(k), F.array(*map(F.lit, names)))]), kind), F.array().cast("array<string>"))
    kept = F.transform(keys, lambda k: said("property", k, F.element_at(trimmed, k)))
    return F.filter(F.concat(own, kept), lambda c: F.coalesce(c["value"], F.lit("")) != "")


def occurrences(obs: DataFrame) -> DataFrame:
    """One row for each observation with its evidence columns and arrays `nodes` and `edges`."""
    rows = with_entities(obs).withColumn("level_rank", level_rank(F.col("level")))
    there = F.filter(F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("type"), F.col(k).alias("e"))) for k in KINDS]), lambda x: x.isNotNull())
    rows = rows.withColumn("there", there)
    nodes = F.transform("there", lambda x: F.struct(node_id(x["type"], x["e"]["provider"], x["e"]["identity"]).alias("id"), x["type"].alias("type"), x["e"]["name"].alias("name"), x["e"]["provider"].alias("provider"), _claims(x["type"], x["e"], F.col("trimmed")).alias("claims")))
    rows = rows.withColumn("nodes", nodes)
    rows = rows.withColumn("ids", F.map_from_entries(F.transform("nodes", lambda n: F.struct(n["type"], n["id"]))))
    relations = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(r).alias("r"), F.lit(b).alias("b")) for a, r, b in RELATIONS])
    ends = F.filter(F.transform(relations, lambda r: F.struct(F.element_at("ids", r["a"]).alias("a"), r["r"].alias("r"), F.element_at("ids", r["b"]).alias("b"))), lambda r: r["a"].isNotNull() & r["b"].isNotNull())
    edges = F.transform(ends, lambda r: F.struct(edge_id(r["a"], r["r"], r["b"]).alias("id"), r["a"].alias("from_id"), r["b"].alias("to_id"), r["r"].alias("relation")))
    return rows.select(*EVIDENCE, "nodes", edges.alias("edges"))


def node_rows(found: DataFrame) -> DataFrame:
    return found.select(*EVIDENCE, F.inline("nodes"))


def edge_rows(found: DataFrame) -> DataFrame:
    return found.select(*EVIDENCE, F.inline("edges"))


def claim_rows(found: DataFrame) -> DataFrame:
    return node_rows(found).select(*EVIDENCE, F.col("id").alias("node_id"), F.inline("claims"))
