"""Observations from the test table of events, the same rows in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of eight events of a user each, as binary trees; some parents are unknown, some rows come twice."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("n", F.row_number().over(w) - 1).withColumns({"block": F.floor(F.col("n") / 8), "pos": F.col("n") % 8 + 1, "k": F.get_json_object("props", "$.k").cast("int")})
    span = lambda c: F.substring(F.md5(F.concat(F.lit("s"), c.cast("string"))), 1, 16)
    trace = F.md5(F.concat_ws(":", F.col("user_id").cast("string"), F.col("block").cast("string")))
    # the events of a trace by place, for the parent at half the place
    places = F.map_from_entries(F.collect_list(F.struct("pos", "event_id")).over(Window.partitionBy("user_id", "block")))
    e = e.withColumn("up", F.element_at(places, F.floor(F.col("pos") / 2).cast("int")))
    parent = F.when(F.col("pos") == 1, "").when(F.col("event_id") % 89 == 0, span(F.concat(F.lit("x"), F.col("event_id").cast("string")))).otherwise(span(F.col("up")))
    kind, k = F.col("event_type"), F.col("k").cast("string")
    root = F.col("pos") == 1
    num = lambda name, m: F.concat(F.lit(name), (F.col("k") % m).cast("string"))
    view, click, buy, error, signup = (~root & (kind == x) for x in ("view", "click", "purchase", "error", "signup"))
    odd = F.col("event_id") % 2 == 1
    named = root & (F.col("user_id") % 5 != 0)
    values = {
        "service.name": F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")),
        "gen_ai.operation.name": F.when(root | signup, "invoke_agent").when(view, "chat").when(click, "execute_tool"),
        "gen_ai.agent.name": F.when(named, F.concat(F.lit("agent-"), (F.col("user_id") % 20).cast("string"))),
        "gen_ai.agent.version": F.when(named, num("1.", 3)),
        "gen_ai.request.model": F.when(view | signup, num("model-", 7)),
        "gen_ai.response.model": F.when(view, F.concat(num("model-", 7), num("-v", 3))),
        "gen_ai.provider.name": F.when(view, F.when(odd, "openai ").otherwise("OpenAI")),
        "server.address": F.when(view, num("api-", 2)),
        "gen_ai.tool.name": F.when(click & ~odd, num("tool-", 11)),
        "otel.span.name": F.when(click & odd, F.concat(F.lit("execute_tool "), num("tool-", 11))).when(signup, F.concat(F.lit("invoke_agent "), num("sub-", 3))),
        "gen_ai.tool.type": F.when(click, "function"),
        "gen_ai.data_source.id": F.when(buy, num("ds-", 5)),
        "db.system.name": F.when(buy, "postgresql"),
        "aiebom.mcp.server.name": F.when(error, num("server-", 4)),
        "mcp.tool.name": F.when(error, num("tool-", 11)),
        "aiebom.mcp.discovery.source": F.when(error, "config"),
    }
    attrs = F.map_filter(F.create_map(*[x for name, v in values.items() for x in (F.lit(name), v.cast("string"))]), lambda _, v: v.isNotNull())
    level = F.when(kind == "error", "declared").when(F.col("value") < 5, "inferred").when(F.col("event_id") % 50 == 0, "verified").otherwise("observed")
    middle = e.select(F.min("ts").alias("a"), F.max("ts").alias("b"))
    rows = e.select(
        F.lit("all").alias("graph_id"), F.col("event_id").alias("obs_seq"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000).alias("ts_ns"), level.alias("level"),
        F.concat(F.lit("src-"), (F.col("user_id") % 3).cast("string")).alias("source"), F.when(F.col("event_id") % 7 == 0, F.upper(trace)).otherwise(trace).alias("trace_id"),
        span(F.col("event_id")).alias("span_id"), parent.alias("parent_span_id"), attrs.alias("attrs"), F.when(F.col("event_id") % 97 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("twice"),
    )
    return rows.withColumn("again", F.explode("twice")).withColumn("obs_seq", F.col("obs_seq") * 2 + F.col("again")).drop("twice", "again")


#: The same rows in SQL; attributes are columns, null where the map has no such key.
OBSERVATIONS_SQL = """
e0 as (
    select *, row_number() over (partition by user_id order by ts, event_id) - 1 as n, cast(json_extract_string(props, '$.k') as integer) as k from events
), e1 as (
    select *, n // 8 as block, n % 8 + 1 as pos from e0
), e2 as (
    select e1.*, u.event_id as up, e1.pos > 1 as inner_span, e1.event_id % 2 = 1 as odd
    from e1 left join e1 u on u.user_id = e1.user_id and u.block = e1.block and u.pos = e1.pos // 2
), e3 as (
    select 'all' as graph_id, event_id, epoch_us(ts) * 1000 + event_id % 1000 as ts_ns,
        case when event_type = 'error' then 'declared' when value < 5 then 'inferred' when event_id % 50 = 0 then 'verified' else 'observed' end as level,
        'src-' || (user_id % 3) as source, md5(user_id || ':' || block) as trace,
        case when event_id % 7 = 0 then upper(md5(user_id || ':' || block)) else md5(user_id || ':' || block) end as trace_id,
        substr(md5('s' || event_id), 1, 16) as span_id,
        case when pos = 1 then '' when event_id % 89 = 0 then substr(md5('sx' || event_id), 1, 16) else substr(md5('s' || up), 1, 16) end as parent_span_id,
        'svc-' || (user_id % 5) as service,
        case when pos = 1 or event_type = 'signup' then 'invoke_agent' when event_type = 'view' then 'chat' when event_type = 'click' then 'execute_tool' end as operation,
        case when pos = 1 and user_id % 5 <> 0 then 'agent-' || (user_id % 20) end as own_agent,
        case when pos = 1 and user_id % 5 <> 0 then '1.' || (k % 3) end as own_version,
        case when inner_span and event_type in ('view', 'signup') then 'model-' || (k % 7) end as request_model,
        case when inner_span and event_type = 'view' then 'model-' || (k % 7) || '-v' || (k % 3) end as response_model,
        case when inner_span and event_type = 'view' then 'OpenAI' end as provider,
        case when inner_span and event_type = 'view' then odd end as odd_provider,
        case when inner_span and event_type = 'view' then 'api-' || (k % 2) end as address,
        case when inner_span and event_type in ('click', 'error') then 'tool-' || (k % 11) end as tool,
        case when inner_span and event_type = 'purchase' then 'ds-' || (k % 5) end as data_source,
        case when inner_span and event_type = 'error' then 'server-' || (k % 4) end as server,
        case when inner_span and event_type = 'signup' then 'sub-' || (k % 3) end as sub_agent,
        event_id % 97 = 0 as twice
    from e2
), obs as (
    select *, event_id * 2 as obs_seq from e3 union all select *, event_id * 2 + 1 from e3 where twice
)
"""


def over(sql: str, variant: str) -> str:
    """The SQL with obs replaced by a query over the same rows, which it sees as obs0."""
    return sql.replace(OBSERVATIONS_SQL, OBSERVATIONS_SQL.replace("obs as (", "obs0 as (") + f", obs as ({variant})")


def otlp_documents(obs: DataFrame, by: list) -> DataFrame:
    """value: an OTLP JSON document for the observations of each value of `by`, a resource for each service. Beside
    their own attributes spans have a quoted integer, a double, and an array of a text and a bool."""
    named = lambda kind, v: F.struct(*(v.alias(kind) if k == kind else F.lit(None).cast("string").alias(k) for k in ("stringValue", "intValue")))
    texts = F.transform(F.map_entries(F.map_filter("attrs", lambda k, v: ~k.isin("service.name", "otel.span.name"))), lambda e: F.to_json(F.struct(e["key"].alias("key"), named("stringValue", e["value"]).alias("value"))))
    more = F.array(
        F.to_json(F.struct(F.lit("aiebom.evidence.level").alias("key"), named("stringValue", F.col("level")).alias("value"))),
        F.to_json(F.struct(F.lit("app.seq").alias("key"), named("intValue", F.col("obs_seq").cast("string")).alias("value"))),
        F.concat(F.lit('{"key":"app.size","value":{"doubleValue":'), (F.col("obs_seq") * 1000).cast("string"), F.lit("}}")),
        F.concat(F.lit('{"key":"app.tags","value":{"arrayValue":{"values":[{"stringValue":"'), F.col("span_id"), F.lit('"},{"boolValue":'), (F.col("obs_seq") % 4 == 2).cast("string"), F.lit("}]}}}")),
    )
    span = F.concat(
        F.lit('{"traceId":"'), "trace_id", F.lit('","spanId":"'), "span_id", F.lit('","parentSpanId":"'), "parent_span_id", F.lit('","name":"'), F.coalesce(F.element_at("attrs", "otel.span.name"), F.lit("")),
        F.lit('","startTimeUnixNano":"'), F.col("ts_ns").cast("string"), F.lit('","attributes":['), F.array_join(F.concat(texts, more), ","), F.lit("]}"),
    )
    spans = obs.groupBy(*by, F.element_at("attrs", "service.name").alias("service")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("obs_seq", span.alias("s")))), lambda x: x["s"]), ",").alias("spans"))
    resource = F.concat(F.lit('{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"'), "service", F.lit('"}}]},"scopeSpans":[{"schemaUrl":"http://schema","scope":{"name":"lib","version":""},"spans":['), "spans", F.lit("]}]}"))
    names = [c for c in spans.columns if c not in ("service", "spans")]
    return spans.groupBy(*names).agg(F.concat(F.lit('{"resourceSpans":['), F.array_join(F.array_sort(F.collect_list(resource)), ","), F.lit("]}")).alias("value"))


def compact_documents(obs: DataFrame) -> DataFrame:
    """value: a compact document for each observation. Some levels are unknown; attributes have a number and a null."""
    from spanloom.operators.bom import rfc3339

    attrs = F.to_json("attrs")
    more = F.concat(F.substr(attrs, F.lit(1), F.length(attrs) - 1), F.lit(',"app.size":'), (F.col("obs_seq") * 1000).cast("string"), F.lit(',"app.none":null,"app.deep":{"b":"<","a":['), F.col("obs_seq").cast("string"), F.lit("]}}"))
    level = F.when(F.col("obs_seq") % 10 == 4, "odd").otherwise(F.col("level"))
    doc = F.concat(
        F.lit('{"source":"'), "source", F.lit('","observations":[{"timestamp":"'), rfc3339(F.col("ts_ns")), F.lit('","level":"'), level, F.lit('","traceId":"'), "trace_id", F.lit('","spanId":"'), "span_id",
        F.lit('","parentSpanId":"'), "parent_span_id", F.lit('","attributes":'), more, F.lit("}]}"),
    )
    return obs.select(doc.alias("value"))


#: Attributes of obs as a list of key=value, with those that documents add.
ATTRIBUTES_SQL = """
    'gen_ai.operation.name=' || operation, 'gen_ai.agent.name=' || own_agent, 'gen_ai.agent.version=' || own_version, 'gen_ai.request.model=' || request_model, 'gen_ai.response.model=' || response_model,
    'gen_ai.provider.name=' || case when odd_provider then 'openai ' else provider end, 'server.address=' || address, 'gen_ai.data_source.id=' || data_source, 'db.system.name=' || case when data_source is not null then 'postgresql' end,
    'aiebom.mcp.server.name=' || server, 'aiebom.mcp.discovery.source=' || case when server is not null then 'config' end, 'mcp.tool.name=' || case when server is not null then tool end,
    'gen_ai.tool.type=' || case when tool is not null and server is null then 'function' end, 'gen_ai.tool.name=' || case when tool is not null and server is null and event_id % 2 = 0 then tool end,
    'otel.span.name=' || case when tool is not null and server is null and event_id % 2 = 1 then 'execute_tool ' || tool when sub_agent is not null then 'invoke_agent ' || sub_agent end, 'service.name=' || service"""
#: obs_seq * 1000 as the text of a double.
SIZE_SQL = "case when obs_seq < 1000 then cast(obs_seq * 1000 as varchar) else regexp_replace(substr(rtrim(cast(obs_seq * 1000 as varchar), '0'), 1, 1) || '.' || substr(rtrim(cast(obs_seq * 1000 as varchar), '0'), 2), '[.]$', '') || 'e+' || lpad(cast(length(cast(obs_seq * 1000 as varchar)) - 1 as varchar), 2, '0') end"


def conversation_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span for each turn of the conversations, each the child of the one before; the first names an agent, those of
    the system hold prompt content."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("conv_id is not null and turn is not null")
    span = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    values = {
        "agent.name": F.when(F.col("before").isNull(), F.concat(F.lit("agent-"), (F.col("conv_id") % 7).cast("string"))),
        "gen_ai.system_instructions": F.when(F.col("role") == "system", F.col("text")), "gen_ai.input.messages": F.when(F.col("role") == "user", F.col("text")), "dify.app_name": F.lit(""),
    }
    attrs = F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    return t.withColumn("before", before).select(
        F.lit("all").alias("graph_id"), (F.col("conv_id") * 100_000 + F.col("turn")).alias("obs_seq"), (F.col("conv_id") * 100_000 + F.col("turn")).alias("ts_ns"), F.lit("observed").alias("level"), F.lit("chat").alias("source"),
        F.col("conv_id").cast("string").alias("trace_id"), span(F.col("turn")).alias("span_id"), F.when(F.col("before").isNull(), "").otherwise(span(F.col("before"))).alias("parent_span_id"), attrs.alias("attrs"),
    )
