"""Column expressions: attribute lookup, evidence levels, stable identities, and the metadata-only projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Evidence levels from the weakest to the strongest.
LEVELS = ("inferred", "declared", "observed", "verified")

# Attribute keys in order of precedence.
KEYS = {
    "operation": ["gen_ai.operation.name"],
    "span_name": ["otel.span.name"],
    "model_provider": ["gen_ai.provider.name", "gen_ai.system", "llm.provider"],
    "service": ["service.name", "service.namespace", "host.name"],
    "agent_name": ["gen_ai.agent.name", "agent.name"],
    "agent_version": ["gen_ai.agent.version"],
    "agent_provider": ["gen_ai.agent.provider", "service.namespace"],
    "agent_id": ["gen_ai.agent.id"],
    "request_model": ["gen_ai.request.model", "llm.request.model", "gen_ai.model"],
    "response_model": ["gen_ai.response.model", "llm.response.model"],
    "model_digest": ["gen_ai.model.digest", "model.digest"],
    "mcp_name": ["aiebom.mcp.server.name", "aiebom.mcp.server.id", "mcp.server.name", "mcp.server.id", "mcp.server.url"],
    "mcp_id": ["aiebom.mcp.server.id", "mcp.server.id"],
    "mcp_version": ["aiebom.mcp.server.version", "mcp.server.version"],
    "mcp_provider": ["aiebom.mcp.server.provider", "mcp.server.provider"],
    "tool_name": ["gen_ai.tool.name", "gen_ai.tool.call.name", "tool.name", "mcp.tool.name"],
    "tool_version": ["gen_ai.tool.version", "aiebom.mcp.tool.version", "mcp.tool.version"],
    "data_source": ["gen_ai.data_source.id", "gen_ai.retrieval.data_source.id", "db.namespace", "data.source.name"],
    "data_provider": ["db.system.name", "server.address"],
    "prompt_name": ["gen_ai.prompt.template.name", "gen_ai.prompt.template.id"],
    "prompt_version": ["gen_ai.prompt.template.version"],
    "prompt_content": ["gen_ai.system_instructions", "gen_ai.prompt"],
}
PROMPT_PRESENT, PROMPT_HMAC = "aiebom.prompt.content_present", "aiebom.prompt.hmac_sha256"
DISCOVERY = "aiebom.mcp.discovery.source"
LEVEL_KEY = "aiebom.evidence.level"
# Attributes kept as properties of each entity.
PROPERTIES = {
    "agent": ["gen_ai.agent.id", "gen_ai.framework", "dify.app_id", "dify.workflow_id", "deployment.environment.name", "service.namespace", "otel.scope.name", "otel.scope.version", "otel.scope.schema_url"],
    "model": ["gen_ai.operation.name", "gen_ai.request.encoding_formats", "gen_ai.response.finish_reasons", "server.address", "server.port", "otel.scope.name", "otel.scope.version", "otel.scope.schema_url"],
    "mcp_server": ["aiebom.mcp.server.identity_source", "aiebom.mcp.discovery.source", "mcp.protocol.version", "mcp.method.name", "mcp.server.url", "mcp.transport", "network.transport", "server.address", "server.port"],
    "tool": ["gen_ai.tool.type", "aiebom.mcp.discovery.source", "aiebom.mcp.tool.input_schema_sha256", "aiebom.mcp.tool.read_only", "aiebom.mcp.tool.destructive", "aiebom.mcp.tool.annotations_untrusted", "mcp.tool.read_only", "mcp.tool.destructive", "mcp.method.name", "mcp.protocol.version", "network.transport"],
    "data_source": ["db.system.name", "server.address", "server.port"],
}
# Model keys that a summary span loses, and operations of concrete model spans.
SUMMARY_KEYS = ["gen_ai.request.model", "gen_ai.response.model", "gen_ai.model", "llm.request.model", "llm.response.model"]
MODEL_OPERATIONS = ["chat", "text_completion", "generate_content", "embeddings"]
EXTRA_KEPT = ["dify.app_name", "gen_ai.span.kind", "service.version", LEVEL_KEY]


def retained_keys() -> list[str]:
    """The keys of metadata that the projection keeps: all that some rule reads, but no content."""
    read = [k for name, keys in KEYS.items() if name != "prompt_content" for k in keys] + [k for keys in PROPERTIES.values() for k in keys]
    return sorted({*read, *EXTRA_KEPT, DISCOVERY})


def projected_keys() -> list[str]:
    """All keys that `metadata_only` looks at: those that it keeps, and those of prompt content and its hash."""
    return sorted({*retained_keys(), *KEYS["prompt_content"], PROMPT_PRESENT, PROMPT_HMAC})


def trim(c: Column) -> Column:
    """Without white space of any script at either end. Texts that begin and end with a visible ASCII character, as
    nearly all do, are left as they are without a pattern's search."""
    seen = F.ascii(c).between(33, 126) & F.ascii(F.substring(c, -1, 1)).between(33, 126)
    return F.when(seen, c).otherwise(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def trimmed_values(attrs: Column) -> Column:
    """The attributes that aren't blank, trimmed: a column to look up many keys in."""
    return F.map_filter(F.transform_values(attrs, lambda k, v: trim(v)), lambda k, v: v != "")


def lookups(trimmed: Column) -> Column:
    """first_of for every name of KEYS, in their order, as one array; see `looked_up`. A loop over keys instead of an
    expression for each keeps the compiled method small enough for the JVM to optimise."""
    keys = F.array(*[F.array(*map(F.lit, ks)) for ks in KEYS.values()])
    return F.transform(keys, lambda ks: F.get(F.filter(F.transform(ks, lambda k: F.element_at(trimmed, k)), lambda v: v.isNotNull()), F.lit(0)))


def looked_up(values: Column, name: str) -> Column:
    """One of `lookups`."""
    return F.get(values, F.lit(list(KEYS).index(name)))


def nonblank(c: Column) -> Column:
    """Trimmed; null if nothing is left."""
    return F.nullif(trim(c), F.lit(""))


def first_of(attrs: Column, keys: list[str] | str) -> Column:
    """The first attribute that isn't blank, trimmed."""
    return F.coalesce(*[nonblank(F.element_at(attrs, k)) for k in (KEYS[keys] if isinstance(keys, str) else keys)])


def level_rank(level: Column) -> Column:
    """1 to 4 for the levels; 0 for anything else."""
    out = F.lit(0)
    for k, name in enumerate(LEVELS):
        out = F.when(level == name, k + 1).otherwise(out)
    return out.cast("tinyint")


def level_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in ("", *LEVELS)]), rank.cast("int") + 1)


def node_id(kind: str | Column, provider: Column, identity: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    norm = [F.lower(trim(F.coalesce(c, F.lit("")))) for c in (kind, provider, identity)]
    return F.concat(kind, F.lit(":"), F.substring(F.sha2(F.concat_ws("\0", *norm), 256), 1, 24))


def edge_id(source: Column, relation: Column, target: Column) -> Column:
    return F.concat(F.lit("edge:"), F.substring(F.sha2(F.concat_ws("\0", source, relation, target), 256), 1, 24))


def hmac_sha256(message: Column, key: bytes) -> Column:
    """Keyed hash of a text with built-in functions; the pads come from the key on the driver."""
    if len(key) < 32:
        raise ValueError("the key needs 32 bytes at least")
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ x for b in block)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def has_genai(attrs: Column) -> Column:
    return F.exists(F.map_keys(attrs), lambda k: k.startswith("gen_ai.") | k.startswith("mcp."))


def metadata_only(attrs: Column, key: bytes | None = None) -> Column:
    """The retained keys with values that aren't empty, and whether there was prompt content, with its keyed hash."""
    keep = retained_keys()
    kept = F.map_filter(attrs, lambda k, v: k.isin(*keep) & (v != ""))
    content = first_of(attrs, "prompt_content")
    flag = F.when(content.isNotNull() | (F.element_at(attrs, PROMPT_PRESENT) == "true"), F.create_map(F.lit(PROMPT_PRESENT), F.lit("true"))).otherwise(F.create_map().cast("map<string,string>"))
    given = nonblank(F.element_at(attrs, PROMPT_HMAC))
    digest = F.coalesce(given, hmac_sha256(content, key)) if key else given
    mark = F.when(digest.isNotNull(), F.create_map(F.lit(PROMPT_HMAC), digest)).otherwise(F.create_map().cast("map<string,string>"))
    return F.map_concat(kept, flag, mark)


def span_key(trace: Column, span: Column) -> Column:
    """Trace and span id as one lower-case text; null if either is blank."""
    return F.when(nonblank(trace).isNotNull() & nonblank(span).isNotNull(), F.concat(F.lower(trim(trace)), F.lit("\0"), F.lower(trim(span))))


def with_values(attrs: Column, **values: Column) -> Column:
    """attrs with the given keys set where the value isn't null; keys are given with dots as double underscores."""
    return F.map_filter(_put(attrs, {k.replace("__", "."): v for k, v in values.items()}), lambda k, v: v.isNotNull())


def _put(attrs: Column, values: dict[str, Column]) -> Column:
    names = list(values)
    rest = F.map_filter(attrs, lambda k, v: ~k.isin(*names))
    return F.map_concat(rest, F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.coalesce(v, F.element_at(attrs, k)))]))
