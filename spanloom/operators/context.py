"""Agent context along parent links, and suppression of summary models.

Observations: graph_id, obs_seq, ts_ns, level, source, trace_id, span_id, parent_span_id, attrs. Ancestors are found
by pointer doubling: a round joins every open pointer with its target, and a pointer then spans twice the levels, so
rounds follow the logarithm of the longest open path. Agents and summaries are looked for in the same rounds. A huge
trace spreads over all tasks by (trace, span); children of one hot span are split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.attributes import KEYS, MODEL_OPERATIONS, SUMMARY_KEYS, span_key, trimmed_values, with_values
from spanloom.plans.store import materialize, materialize_counted


def explicit_agent(trimmed):
    """struct(id, name, version) of an agent that the span names itself, from its trimmed values; null if it names none."""
    first = lambda *keys: F.coalesce(*[F.element_at(trimmed, k) for k in keys])
    name, ident = first(*KEYS["agent_name"], "dify.app_name"), first(*KEYS["agent_id"], "dify.app_id")
    return F.when(name.isNotNull() | ident.isNotNull(), F.struct(F.coalesce(ident, name).alias("id"), F.coalesce(name, ident).alias("name"), first(*KEYS["agent_version"]).alias("version")))


def keyed(obs: DataFrame) -> DataFrame:
    """Adds key and parent (span keys), both null where an id is blank."""
    return obs.withColumns({"key": span_key(F.col("trace_id"), F.col("span_id")), "parent": span_key(F.col("trace_id"), F.col("parent_span_id"))})


def nearest(spans: DataFrame, values: list[str]) -> DataFrame:
    """(graph_id, key, values): each value of the span itself or of the nearest ancestor that has one, from
    spans(graph_id, key, parent, values) with one row for each key. Missing parents and cycles give null.

    Every round resolves one open pointer at least, unless all that are left lead into cycles; so the rounds end when
    their number stays the same."""
    state = spans.select("graph_id", "key", *values, *(F.when(F.col(v).isNull(), F.col("parent")).alias(f"{v}_at") for v in values))
    left = None
    while True:
        state, now = materialize_counted(state, "context", open=F.count_if(F.array_size(F.array_compact(F.array(*(F.col(f"{v}_at") for v in values)))) > 0), pointers=F.sum(sum(F.col(f"{v}_at").isNotNull().cast("long") for v in values)))
        if not now["open"] or now["pointers"] == left:
            return state.select("graph_id", "key", *values)
        left = now["pointers"]
        rows = state
        for v in values:
            target = state.select("graph_id", F.col("key").alias(f"{v}_at"), F.col(v).alias("found"), F.col(f"{v}_at").alias("next"))
            rows = rows.join(target, ["graph_id", f"{v}_at"], "left").withColumns({f"{v}_at": F.when(F.col("found").isNull(), F.col("next")), v: F.coalesce(v, "found")}).drop("found", "next")
        state = rows.select(state.columns)


def last_spans(rows: DataFrame) -> DataFrame:
    """Of spans that share a key, the last by obs_seq: the one that children take as their parent."""
    return rows.where("key is not null").groupBy("graph_id", "key").agg(F.max_by(F.struct("parent", "agent", "summary", "obs_seq"), "obs_seq").alias("row")).select("graph_id", "key", "row.*")


def filled(attrs, agent):
    """attrs with the agent's id, name and version where they are empty."""
    def fill(key: str, value: str):
        old = F.element_at(attrs, key)
        return F.when(F.coalesce(old, F.lit("")) == "", agent[value]).otherwise(old)

    out = with_values(attrs, gen_ai__agent__id=fill("gen_ai.agent.id", "id"), gen_ai__agent__name=fill("gen_ai.agent.name", "name"), gen_ai__agent__version=fill("gen_ai.agent.version", "version"))
    return F.when(agent.isNotNull(), out).otherwise(attrs)


def in_context(obs: DataFrame, agents: bool = True, summaries: bool = True) -> DataFrame:
    """Observations with empty agent ids, names and versions filled from their own or the nearest ancestor's agent
    (agents), and without the model keys of spans that are the nearest invoke_agent ancestor of a concrete model span
    (summaries)."""
    obs_columns = obs.columns
    obs = obs.withColumn("trimmed", trimmed_values(F.col("attrs")))
    operation = F.lower(F.element_at("trimmed", KEYS["operation"][0]))
    concrete = (F.lower(F.element_at("trimmed", "gen_ai.span.kind")) == "llm") | operation.isin(MODEL_OPERATIONS)
    rows = keyed(obs).withColumns({"agent": explicit_agent(F.col("trimmed")), "summary": F.when(operation == "invoke_agent", F.col("key")), "concrete": F.coalesce(concrete, F.lit(False))}).drop("trimmed")
    rows = materialize(rows, "spans")
    last = materialize(last_spans(rows), "last")
    found = nearest(last.select("graph_id", "key", "parent", "agent", "summary"), [v for v, wanted in (("agent", agents), ("summary", summaries)) if wanted])
    attrs = F.col("attrs")
    if agents:
        above = found.where("agent is not null").select("graph_id", F.col("key").alias("parent"), F.col("agent").alias("inherited"))
        rows = rows.join(above, ["graph_id", "parent"], "left")
        attrs = filled(attrs, F.coalesce("agent", "inherited"))
    if summaries:
        over = rows.where("concrete and parent is not null").select("graph_id", F.col("parent").alias("key")).distinct()
        hit = over.join(found, ["graph_id", "key"]).where("summary is not null").select("graph_id", F.col("summary").alias("key")).distinct()
        hit = hit.join(last.select("graph_id", "key", F.col("obs_seq").alias("hit_seq")), ["graph_id", "key"])
        rows = rows.join(hit, ["graph_id", "key"], "left")
        cleared = F.map_filter(attrs, lambda k, v: ~k.isin(SUMMARY_KEYS))
        attrs = F.when(F.col("obs_seq") == F.col("hit_seq"), cleared).otherwise(attrs)
    return rows.withColumn("attrs", attrs).select(obs_columns)


def inherit_agents(obs: DataFrame) -> DataFrame:
    """Fill empty agent id, name and version of every span from its own or the nearest ancestor's agent."""
    return in_context(obs, summaries=False)


def suppress_summaries(obs: DataFrame) -> DataFrame:
    """Take the model keys from every span that is the nearest invoke_agent ancestor of a concrete model span."""
    return in_context(obs, agents=False)
