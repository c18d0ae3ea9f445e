"""Queries of the evidence-graph operators over the test tables, and the SQL that gives the same rows.

Nested columns are returned as text, lists joined by | and maps as sorted k=v.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dataclasses import replace

from spanloom.functions.attributes import metadata_only
from spanloom.operators import bom, context, diff, evidence, extract, merge, policy, validate
from spanloom.operators.evidence import Graph
from spanloom.plans.scan import first_seen, scan
from spanloom.plans.store import children, fresh_path, hadoop, materialize
from spanloom.sources import snapshots, telemetry
from spanloom.streaming import collector
from spanloom.testtables import ATTRIBUTES_SQL, OBSERVATIONS_SQL, SIZE_SQL, compact_documents, conversation_spans, observations, otlp_documents, over

SUMMARY = ["level", "n", "first_ns", "last_ns"]


def joined(name: str):
    return F.array_join(name, "|").alias(name)


def pairs(name: str):
    return F.array_join(F.transform(F.array_sort(F.map_entries(name)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias(name)


def contextual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(context.in_context(observations(spark, sf_dir)), "observations")


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return evidence.build(context.in_context(observations(spark, sf_dir)))


def sides(spark: SparkSession, sf_dir: str) -> tuple[Graph, Graph]:
    """Two overlapping snapshots: without every fourth, and without the next fourth of the observations."""
    obs = contextual(spark, sf_dir)
    return evidence.build(obs.where("obs_seq % 4 <> 0")), evidence.build(obs.where("obs_seq % 4 <> 2"))


POLICY = policy.Policy(
    minimum_evidence={"tool": "observed", "model": "verified"}, allowed_providers=["OpenAI", "postgresql"], require_providers_for=["data_source", "agent"], require_versions_for=["model", "agent"],
    denied_name_patterns=["^tool-1$", "ds-[34]"], forbid_field_conflicts=True,
    denied_paths=[policy.PathRule("agent-server-tool", policy.Selector(type="agent"), [policy.Selector(type="mcp_server")], ["connects_to", "provides"], policy.Selector(type="tool", name_pattern="tool-[12]"))],
)


def c02_agent_inheritance(spark, sf_dir):
    obs = context.inherit_agents(observations(spark, sf_dir))
    return obs.select("obs_seq", *[F.element_at("attrs", f"gen_ai.agent.{x}").alias(x) for x in ("id", "name", "version")])


def c03_summary_suppression(spark, sf_dir):
    return contextual(spark, sf_dir).select("obs_seq", F.element_at("attrs", "gen_ai.request.model").alias("request_model"))


def d03_nodes(spark, sf_dir):
    return graph(spark, sf_dir).nodes.select("id", "type", "name", "provider", *SUMMARY, joined("sources"), joined("trace_ids"))


def d04_edges(spark, sf_dir):
    return graph(spark, sf_dir).edges.select("id", "from_id", "to_id", "relation", *SUMMARY, joined("sources"), joined("trace_ids"))


def d05_claims(spark, sf_dir):
    return graph(spark, sf_dir).claims.select("node_id", "field", "key", "value", *SUMMARY, joined("sources"), joined("trace_ids"))


def d06_claim_resolution(spark, sf_dir):
    return evidence.resolve(graph(spark, sf_dir).claims).select("node_id", "field", "key", "value", "rank", "conflict")


def d08_materialised_fields(spark, sf_dir):
    return graph(spark, sf_dir).nodes.select("id", "version", joined("observed_versions"), pairs("digests"), pairs("properties"))


def d09_merge(spark, sf_dir):
    return merge.merge(*sides(spark, sf_dir)).nodes.select("id", "type", *SUMMARY, joined("sources"), joined("trace_ids"), "version", joined("observed_versions"))


def d11_graph_summary(spark, sf_dir):
    g = graph(spark, sf_dir)
    return g.nodes.groupBy(F.lit("node").alias("entity"), F.col("type").alias("kind")).agg(F.count("*").alias("n")).union(g.edges.groupBy(F.lit("edge"), "relation").agg(F.count("*")))


def c04_node_diff(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    return diff.diff_nodes(a, b).select("id", "change", joined("fields"))


def c05_edge_diff(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    return diff.diff_edges(a, b).select("id", "change", joined("fields"))


def e04_first_seen(spark, sf_dir):
    return first_seen(observations(spark, sf_dir)).select("obs_seq", "span_id", "ts_ns", "level")


def p10_policy_violations(spark, sf_dir):
    return policy.node_violations(graph(spark, sf_dir), POLICY).select("rule", "node_id", "message")


def c09_denied_paths(spark, sf_dir):
    return policy.denied_path(graph(spark, sf_dir), POLICY.denied_paths[0]).select(joined("path"))


def p10_policy_report(spark, sf_dir):
    g = graph(spark, sf_dir)
    return policy.report(g, policy.violations(g, POLICY))


def m01_components(spark, sf_dir):
    return bom.components(graph(spark, sf_dir)).select("bom_ref", "type", "name", "version", "publisher", F.to_json("hashes").alias("hashes"), F.to_json("properties").alias("properties"))


def m02_properties(spark, sf_dir):
    return bom.properties(graph(spark, sf_dir)).select("bom_ref", F.col("name"), "value")


def m04_header(spark, sf_dir):
    return bom.header(collector.bom_heads(graph(spark, sf_dir))).select("graph_id", "serial_number", "version", "timestamp")


def a08_bom_files(spark, sf_dir):
    """A bill of materials as written: its components and dependencies, counted by type."""
    g, path = graph(spark, sf_dir), fresh_path(spark, "bom")
    snapshots.write_bom(g, collector.bom_heads(g), path)
    found = spark.read.json(f"{path}/components").join(spark.read.json(f"{path}/dependencies").withColumnRenamed("ref", "bom_ref"), ["graph_id", "bom_ref"])
    return found.groupBy("type").agg(F.count("*").alias("components"), F.sum(F.size("depends_on")).alias("depends_on"))


def m03_dependencies(spark, sf_dir):
    return bom.dependencies(graph(spark, sf_dir)).select("ref", joined("depends_on"))


def damaged(g: Graph) -> Graph:
    """A stored graph with everything wrong that validation looks for."""
    n, kind = g.nodes, F.split("node_id", ":")[0]
    twice = n.where("type = 'data_source'")
    nodes = n.withColumns({"version": F.when(F.col("type") == "model", "zzz").otherwise(F.col("version")), "id": F.when(F.col("type") == "mcp_server", "").otherwise(F.col("id"))}).unionByName(twice)
    claims = g.claims.withColumns({
        "key": F.when(F.col("key") == "gen_ai.tool.type", " gen_ai.tool.type").when((kind == "agent") & (F.col("field") == "version"), "x").otherwise(F.col("key")),
        "field": F.when(kind == "data_source", "note").otherwise(F.col("field")), "value": F.when(F.col("key") == "server.address", None).otherwise(F.col("value")),
        "level_rank": F.when(kind == "mcp_server", 9).otherwise(F.col("level_rank")).cast("tinyint"),
    })
    return Graph(nodes, g.edges, claims)


def k01_issues(spark, sf_dir):
    return validate.issues(damaged(graph(spark, sf_dir))).select("entity", "id", "issue").distinct()


def k05_snapshot_digest(spark, sf_dir):
    return validate.snapshot_digests(graph(spark, sf_dir))


def k06_tampered(spark, sf_dir):
    """Rows that tell a snapshot from one with other names of tools and without `provides`."""
    g = graph(spark, sf_dir)
    g = Graph(materialize(g.nodes, "nodes"), materialize(g.edges, "edges"), g.claims)
    other = Graph(g.nodes.withColumn("name", F.when(F.col("type") == "tool", F.upper("name")).otherwise(F.col("name"))), g.edges.where("relation <> 'provides'"), g.claims)
    return validate.tampered(g, other).select("entity", "id", "side")


def x07_claim_rows(spark, sf_dir):
    # written first, as build() does: the optimiser would repeat every entity's expressions in both generators
    found = materialize(extract.occurrences(observations(spark, sf_dir)), "occurrences")
    return extract.claim_rows(found).groupBy("field", "key").agg(F.count("*").alias("n"), F.countDistinct("value").alias("values"))


def w1_scan_with_dedup(spark, sf_dir):
    g = scan(observations(spark, sf_dir), dedup=True)
    return g.edges.groupBy("relation").agg(F.count("*").alias("edges"), F.sum("n").alias("n"))


def flat(obs: DataFrame) -> DataFrame:
    """Observations with their attributes as sorted key=value."""
    text = F.array_join(F.array_sort(F.transform(F.map_entries("attrs"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")
    return obs.select("trace_id", "span_id", "parent_span_id", "ts_ns", "level", "source", text.alias("attrs"))


def written(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Documents as they are read from a folder of text files."""
    path = fresh_path(spark, "lines")
    docs.select("value").write.text(path)
    return telemetry.documents(spark, path)


def a01_otlp_documents(spark, sf_dir):
    docs = otlp_documents(observations(spark, sf_dir), [F.lower("trace_id").alias("t")])
    return flat(telemetry.read_otlp(written(spark, docs)))


def a02_compact_documents(spark, sf_dir):
    return flat(telemetry.read_compact(written(spark, compact_documents(observations(spark, sf_dir)))))


def a03_routed_documents(spark, sf_dir):
    """A mixed folder: documents and observations of each kind, and what is quarantined."""
    obs = observations(spark, sf_dir)
    broken = F.when(F.col("obs_seq") % 3 == 0, F.concat(F.lit("nonsense "), F.col("obs_seq").cast("string"))).when(F.col("obs_seq") % 3 == 1, F.concat(F.lit('{"resourceSpans":"'), F.col("obs_seq").cast("string"), F.lit('"}'))).otherwise(F.lit('{"other":[]}'))
    mixed = otlp_documents(obs.where("obs_seq % 8 = 0"), [F.lower("trace_id").alias("t")]).select("value").union(compact_documents(obs.where("obs_seq % 8 = 2"))).union(obs.where("obs_seq % 8 = 4").select(broken.alias("value"))).union(spark.range(3).select(F.lit("{}").alias("value")))
    docs = materialize(written(spark, mixed), "mixed")
    found, bad = telemetry.read_documents(docs)
    kinds = telemetry.route(docs).groupBy(F.coalesce("kind", F.lit("none")).alias("kind")).agg(F.count("*").alias("n"))
    rows = found.groupBy(F.when(F.col("source").startswith("svc"), "otlp rows").otherwise("compact rows").alias("kind")).agg(F.count("*").alias("n"))
    return kinds.union(rows).union(bad.select(F.lit("quarantined").alias("kind")).groupBy("kind").agg(F.count("*").alias("n")))


def a06_span_table(spark, sf_dir):
    """Spans with binary ids and typed attributes; some times are out of range."""
    obs = observations(spark, sf_dir)
    typed = F.struct(F.lit(None).cast("string").alias("string"), (F.col("obs_seq") % 4 == 2).alias("bool"), F.lit(None).cast("bigint").alias("int"), F.lit(None).cast("double").alias("double"), F.lit(None).cast("binary").alias("bytes"))
    put = lambda name, v: typed.withField("bool", F.lit(None).cast("boolean")).withField(name, v)
    attrs = F.create_map(F.lit("b"), typed, F.lit("i"), put("int", F.col("obs_seq")), F.lit("d"), put("double", F.col("obs_seq") * F.lit(1000.0)), F.lit("x"), put("bytes", F.unhex("span_id")), F.lit("s"), put("string", F.col("level")))
    start = F.when(F.col("obs_seq") % 5 == 0, F.lit(0).cast("decimal(20,0)")).when(F.col("obs_seq") % 5 == 1, F.lit(str(2**64 - 1)).cast("decimal(20,0)")).otherwise(F.col("ts_ns").cast("decimal(20,0)"))
    table = obs.select("graph_id", F.unhex("trace_id").alias("trace_id"), F.unhex("span_id").alias("span_id"), F.unhex("parent_span_id").alias("parent_span_id"), start.alias("start"), F.element_at("attrs", "service.name").alias("service"), attrs.alias("attrs"))
    found = flat(telemetry.read_span_table(table))
    return found.withColumn("ts_ns", F.when(F.col("ts_ns") > F.unix_micros(F.current_timestamp()) * 1000 - 3600 * 10**9, F.lit(-1)).otherwise(F.col("ts_ns")))


def a07_snapshot(spark, sf_dir):
    """A graph written as JSON and read again, strictly."""
    g, path = graph(spark, sf_dir), fresh_path(spark, "snapshot")
    snapshots.write_graph(g, path, "json")
    back = snapshots.read_graph(spark, path, g, "json")
    return back.nodes.select("id", "type", "name", *SUMMARY, "version", joined("observed_versions"), pairs("digests"), pairs("properties"))


def a09_diff_report(spark, sf_dir):
    """The report of both diffs in its order, as it is written."""
    a, b = sides(spark, sf_dir)
    path = fresh_path(spark, "report")
    snapshots.write_report(diff.report(a, b).coalesce(1), path)
    rows = spark.read.schema("entity string, change string, id string, fields array<string>").json(path)
    place = F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("long").alias("place")
    return rows.select(place, "entity", "change", "id", joined("fields"))


def d12_has_changes(spark, sf_dir):
    a, b = sides(spark, sf_dir)
    same = diff.has_changes(diff.report(a, a).withColumn("graph_id", F.lit("same")), a.nodes.select(F.lit("same").alias("graph_id")))
    return diff.has_changes(diff.report(a, b), a.nodes).union(same)


def f02_violations_in_order(spark, sf_dir):
    g = graph(spark, sf_dir)
    path = fresh_path(spark, "violations")
    snapshots.write_report(policy.ordered(policy.violations(g, POLICY)).coalesce(1), path)
    rows = spark.read.schema("rule string, node_id string, message string").json(path)
    return rows.select(F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("long").alias("place"), "rule", "node_id", "message")


def f01_canonical_order(spark, sf_dir):
    path = fresh_path(spark, "ordered")
    g = snapshots.canonical_order(graph(spark, sf_dir))
    g.claims.coalesce(1).write.json(path)
    rows = spark.read.schema("node_id string, field string, key string, value string").json(path)
    return rows.select(F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("long").alias("place"), "node_id", "field", "key", "value")


KEY = b"a key of thirty-two bytes at the least"


def b16_metadata_only(spark, sf_dir):
    obs = conversation_spans(spark, sf_dir)
    return flat(obs.withColumn("attrs", metadata_only(F.col("attrs"), KEY))).select("span_id", "attrs")


def c02_deep_chains(spark, sf_dir):
    obs = context.inherit_agents(conversation_spans(spark, sf_dir))
    return obs.select("obs_seq", F.element_at("attrs", "gen_ai.agent.name").alias("name"))


def x06_prompts(spark, sf_dir):
    g = scan(conversation_spans(spark, sf_dir), KEY)
    return g.claims.where("node_id like 'prompt:%'").select("field", "key", "value", "n")


def x06_prompt_edges(spark, sf_dir):
    g = scan(conversation_spans(spark, sf_dir), KEY)
    return g.edges.where("relation = 'uses_prompt'").select("id", "n")


def c06_backfill(spark, sf_dir):
    """Claims of a graph that kept only those of properties, merged: versions come back as inferred."""
    g = graph(spark, sf_dir)
    back = merge.backfill(g.nodes, g.claims.where("field = 'property'"))
    times = [F.coalesce(c, F.lit(0)).alias(c) for c in ("first_ns", "last_ns")]
    return back.select("node_id", "field", "key", "value", F.col("level_rank").cast("int").alias("level_rank"), "n", *times)


def c09_three_hops(spark, sf_dir):
    """From an agent over a tool it shares with another agent to a model of a provider."""
    g = graph(spark, sf_dir)
    back = g.edges.where("relation = 'invokes'").withColumns({"from_id": F.col("to_id"), "to_id": F.col("from_id"), "relation": F.lit("invoked_by")})
    s = policy.Selector
    rule = policy.PathRule("shared", s(type="agent"), [s(type="tool", minimum_evidence="observed"), s(type="agent", name_pattern="^agent-1")], ["invokes", "invoked_by", "uses"], s(type="model", provider="OPENAI"))
    return policy.denied_path(Graph(g.nodes, g.edges.unionByName(back), g.claims), rule).select(joined("path"))


def c11_dangling(spark, sf_dir):
    """Dependencies and paths of a graph whose servers are missing."""
    g = graph(spark, sf_dir)
    g = Graph(g.nodes.where("type <> 'mcp_server'"), g.edges, g.claims)
    paths = policy.denied_path(g, POLICY.denied_paths[0]).select(F.lit("path").alias("ref"), joined("path").alias("depends_on"))
    return bom.dependencies(g).select("ref", joined("depends_on")).union(paths)


def g03_contract(spark, sf_dir):
    """Two frameworks' spellings of the same spans, of which one has lost some."""
    obs = contextual(spark, sf_dir)
    names = {"gen_ai.request.model": "llm.request.model", "gen_ai.response.model": "llm.response.model", "gen_ai.provider.name": "gen_ai.system", "gen_ai.tool.name": "tool.name"}
    renamed = lambda k: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), k), k)
    other = obs.withColumn("attrs", F.transform_keys("attrs", lambda k, v: renamed(k))).where("level <> 'inferred'")
    return diff.contract_difference(evidence.build(obs), evidence.build(other)).select("entity", "id", "what", "other", "side")


def p01_forbid_inferred(spark, sf_dir):
    weak = evidence.build(contextual(spark, sf_dir).where("level in ('inferred', 'declared')"))
    return policy.node_violations(weak, policy.Policy(forbid_inferred=True)).select("rule", "node_id", "message")


def p08_denied_path_rows(spark, sf_dir):
    found = policy.violations(graph(spark, sf_dir), replace(POLICY, forbid_field_conflicts=False))
    return found.where("rule like 'denied-path:%'").select("rule", "node_id", joined("path"), "message")


def d10_counters(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return collector.counters(obs.withColumn("span_id", F.when(F.col("obs_seq") % 16 == 0, " ").otherwise(F.col("span_id"))))


def streamed(spark: SparkSession, sf_dir: str) -> str:
    """The store of a stream of three files: children first, in two batches, then roots."""
    obs = observations(spark, sf_dir).withColumn("file", F.when(F.col("parent_span_id") == "", 2).otherwise(F.floor(F.col("obs_seq") / 2) % 2))
    path = fresh_path(spark, "stream")
    docs = materialize(otlp_documents(obs, ["file", F.lower("trace_id").alias("t")]), "files")
    for k in range(3):
        # a file each, so that they come in this order
        docs.where(F.col("file") == k).select("value").coalesce(1).write.mode("append").text(f"{path}/in")
    query = collector.collect(spark, f"{path}/in", f"{path}/store", f"{path}/checkpoint", collector.Options(compact_every=2)).trigger(availableNow=True).start()
    query.awaitTermination()
    return f"{path}/store"


def i06_stream_graph(spark, sf_dir):
    store = streamed(spark, sf_dir)
    collector.flush(spark, store)
    g = collector.stored_graph(spark, store)
    return g.nodes.select("id", F.col("type").alias("kind"), *SUMMARY).union(g.edges.select("id", "relation", *SUMMARY))


def i08_stream_counts(spark, sf_dir):
    return collector.stats(spark, streamed(spark, sf_dir)).select(F.col("batch").cast("long").alias("batch"), "received", "accepted", "duplicate", "pending")


def c09_eight_hops(spark, sf_dir):
    """Four tools of one server and five agents in turn, all of which know each other: of some ten thousand paths the
    smallest of each start."""
    g = graph(spark, sf_dir)
    g = Graph(materialize(g.nodes, "nodes"), materialize(g.edges, "edges"), g.claims)
    back = g.edges.where("relation = 'invokes'").withColumns({"from_id": F.col("to_id"), "to_id": F.col("from_id"), "relation": F.lit("invoked_by")})
    tool, agent = policy.Selector(type="tool", provider="Server-1", name_pattern="^tool-[1-5]$"), policy.Selector(type="agent", name_pattern="^agent-1[1-4]$")
    rule = policy.PathRule("ring", policy.Selector(type="agent"), [tool, agent, tool, agent, tool, agent, tool], ["invokes", "invoked_by"] * 4, agent)
    return policy.denied_path(Graph(g.nodes, g.edges.unionByName(back), g.claims), rule).select(joined("path"))


POLICIES = {
    "names": policy.Policy(minimum_evidence={"tool": "observed"}, denied_name_patterns=[f"^tool-{i}$" for i in range(100)], allowed_providers=["OPENAI"]),
    "more": policy.Policy(denied_name_patterns=[f"model-{i}" for i in range(100)], require_versions_for=["Agent"], require_providers_for=["data_source", "agent"], forbid_inferred=True, forbid_field_conflicts=True),
}


def p11_policy_tables(spark, sf_dir):
    """Two policies of a hundred patterns each over three graphs; the second concerns two of them."""
    found = policy.policies_violations(by_source(spark, sf_dir), POLICIES, {"more": ["src-0", "src-2"]})
    return found.select("policy", "graph_id", "rule", "node_id", "message")


def a01_large_documents(spark, sf_dir):
    """The same as a01, each document cut into the texts of its spans before these are parsed."""
    docs = otlp_documents(observations(spark, sf_dir), [F.lower("trace_id").alias("t")])
    return flat(telemetry.read_otlp(written(spark, docs), large=500))


def b01_repeated_keys(spark, sf_dir):
    """Resources and spans name keys twice; the last value of the innermost counts."""
    docs = otlp_documents(observations(spark, sf_dir), [F.lower("trace_id").alias("t")])
    more = '"attributes":[{"key":"app.seq","value":{"intValue":"-1"}},{"key":"app.tags","value":{"boolValue":true}},{"key":"app.seq","value":{"stringValue":"x"}},{"key":"app.size","value":{"arrayValue":{}}},'
    return flat(telemetry.read_otlp(written(spark, docs.withColumn("value", F.replace("value", F.lit('"attributes":['), F.lit(more))))))


def b05_document_sources(spark, sf_dir):
    docs = written(spark, otlp_documents(observations(spark, sf_dir), [F.lower("trace_id").alias("t")]))
    return telemetry.document_sources(docs).groupBy("source").agg(F.count("*").alias("documents"))


def b18_digest_claims(spark, sf_dir):
    """Digests of models, with and without their prefix."""
    model = F.element_at("attrs", "gen_ai.request.model")
    digest = F.concat(F.when(F.col("obs_seq") % 3 == 0, "sha256:").otherwise(""), F.md5(model))
    obs = observations(spark, sf_dir).withColumn("attrs", F.when(model.isNotNull(), F.map_concat("attrs", F.create_map(F.lit("gen_ai.model.digest"), digest))).otherwise(F.col("attrs")))
    found = extract.claim_rows(materialize(extract.occurrences(obs), "occurrences")).where("field = 'digest'")
    return found.groupBy("node_id", "key", "value").agg(F.count("*").alias("n"))


def headed(g: Graph, source: str, generated_ns: int, **said: str) -> Graph:
    """The graph with headers of this source and time, which say more."""
    heads = evidence.headers(g.nodes, source, generated_ns)
    more = F.create_map(*[F.lit(x) for kv in said.items() for x in kv]).cast("map<string,string>")
    return replace(g, graphs=heads.withColumn("metadata", F.map_from_entries(F.concat(F.map_entries("metadata"), F.map_entries(more)))))


def by_source(spark: SparkSession, sf_dir: str) -> Graph:
    """A graph for each source of observations."""
    obs = observations(spark, sf_dir).withColumn("graph_id", F.col("source"))
    return evidence.build(context.in_context(obs))


def d09_merged_headers(spark, sf_dir):
    """Three graphs with headers, merged: of the first only one graph, without a source; later values win."""
    g = by_source(spark, sf_dir)
    only = lambda name: Graph(*(getattr(g, p).where(F.col("graph_id") == name) for p in ("nodes", "edges", "claims")))
    merged = merge.merge(headed(only("src-1"), "", 5, run="1", kept="a"), headed(g, "second", 7, run="2"), headed(g, "third", 6, run="3", last="z"))
    counts = merged.nodes.groupBy("graph_id").agg(F.sum("n").alias("n"))
    return merged.graphs.join(counts, "graph_id").select("graph_id", "schema_version", "generated_ns", "source", pairs("metadata"), "n")


def a07_partitioned_snapshot(spark, sf_dir):
    """Graphs and headers in folders by graph, as JSON and parquet, read again strictly."""
    g = headed(by_source(spark, sf_dir), "scan", 9)
    path, out = fresh_path(spark, "snapshots"), None
    for kind in ("parquet", "json"):
        snapshots.write_graph(g, f"{path}/{kind}", kind, by_graph=True)
        back = snapshots.read_graph(spark, f"{path}/{kind}", g, kind, by_graph=True)
        rows = back.nodes.groupBy("graph_id").agg(F.count("*").alias("nodes"), F.sum("n").alias("n")).join(back.edges.groupBy("graph_id").agg(F.count("*").alias("edges")), "graph_id").join(back.claims.groupBy("graph_id").agg(F.count("*").alias("claims")), "graph_id")
        rows = rows.join(back.graphs, "graph_id").select(F.lit(kind).alias("kind"), "graph_id", "nodes", "n", "edges", "claims", "source", "generated_ns", pairs("metadata"))
        out = rows if out is None else out.union(rows)
    return out


def arriving(spark: SparkSession, path: str, at: int, lines: DataFrame) -> None:
    """A file of lines in a folder, with a time of arrival in seconds."""
    part = fresh_path(spark, "arriving")
    lines.coalesce(1).write.text(part)
    fs, folder = hadoop(spark, path)
    fs.mkdirs(folder)
    name = next(x for x in children(spark, part) if x.startswith("part-"))
    target = hadoop(spark, f"{path}/{at}.txt")[1]
    fs.rename(hadoop(spark, f"{part}/{name}")[1], target)
    fs.setTimes(target, at * 1000, -1)


def i01_clocked_stream(spark, sf_dir):
    """Counts of a stream by its batches, under a clock of arrival times; the batch -1 is what a listener has counted
    while the stream ran. Spans without their roots; a third of them again within the horizon; two observations long
    after, when all that waited is let go; the third once more, beyond the horizon."""
    obs = observations(spark, sf_dir).where("parent_span_id <> ''")
    docs = materialize(otlp_documents(obs, [(F.col("obs_seq") % 6 < 2).alias("third"), F.lower("trace_id").alias("t")]), "files")
    path, lone = fresh_path(spark, "stream"), spark.range(1).select(F.lit('{"observations":[{"attributes":{}}]}').alias("value"))
    again = docs.where("third").select("value")
    for at, lines in ((1000, docs.select("value")), (1050, again), (9000, lone), (9001, lone), (9002, again)):
        arriving(spark, f"{path}/in", at, lines)
    live = collector.LiveCounters()
    spark.streams.addListener(live)
    try:
        options = collector.Options(horizon=3600, wait=100, compact_every=2)
        stream = collector.collect(spark, f"{path}/in", f"{path}/store", f"{path}/checkpoint", options, clock=F.col("_metadata.file_modification_time"))
        query = stream.trigger(availableNow=True).start()
        query.awaitTermination()
        # progress is told a moment later
        live.ended.wait(60)
    finally:
        spark.streams.removeListener(live)
    told = spark.createDataFrame([(-1, live.received, live.accepted, live.duplicate, 0, 0)], "batch long, received long, accepted long, duplicate long, pending long, released_late long")
    return collector.stats(spark, f"{path}/store").select(told.columns).union(told)


def a11_stored_bom(spark, sf_dir):
    """The bill of materials that the stream's last batch has left, from the buckets of all versions."""
    store = streamed(spark, sf_dir)
    collector.flush(spark, store)
    _, components, dependencies = collector.stored_bom(spark, store)
    return components.join(dependencies.withColumnRenamed("ref", "bom_ref"), ["graph_id", "bom_ref"]).select("bom_ref", "type", "name", "version", joined("depends_on"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        c02_agent_inheritance, c03_summary_suppression, c04_node_diff, c05_edge_diff, c09_denied_paths, d03_nodes, d04_edges, d05_claims, d06_claim_resolution, d08_materialised_fields, d09_merge, d11_graph_summary,
        e04_first_seen, k01_issues, k05_snapshot_digest, m01_components, m03_dependencies, p10_policy_report, p10_policy_violations, w1_scan_with_dedup, x07_claim_rows,
        a01_otlp_documents, a02_compact_documents, a03_routed_documents, a06_span_table, a07_snapshot, a08_bom_files, a09_diff_report, b16_metadata_only, c02_deep_chains, c06_backfill, c09_three_hops, c11_dangling,
        d10_counters, d12_has_changes, f01_canonical_order, f02_violations_in_order, g03_contract, i06_stream_graph, i08_stream_counts, k06_tampered, m02_properties, m04_header, p01_forbid_inferred,
        p08_denied_path_rows, x06_prompts, x06_prompt_edges, c09_eight_hops, p11_policy_tables, a01_large_documents, b01_repeated_keys, b05_document_sources, b18_digest_claims, d09_merged_headers, a07_partitioned_snapshot, i01_clocked_stream, a11_stored_bom,
    )
}

_CONTEXT = f"""
with recursive {OBSERVATIONS_SQL}, sp as (
    select distinct trace, span_id, parent_span_id, own_agent, own_version, operation from obs
), walk as (
    select trace, span_id, parent_span_id as p, own_agent as agent, own_version as version, 0 as d from sp
    union all
    select w.trace, w.span_id, s.parent_span_id, s.own_agent, s.own_version, d + 1
    from walk w join sp s on s.trace = w.trace and s.span_id = w.p where w.agent is null and d < 20
), ctx as (
    select trace, span_id, agent, version from walk where agent is not null
), up as (
    select trace, parent_span_id as at, 0 as d from sp where operation = 'chat'
    union
    select u.trace, s.parent_span_id, d + 1 from up u join sp s on s.trace = u.trace and s.span_id = u.at where s.operation is distinct from 'invoke_agent' and d < 20
), hit as (
    select distinct u.trace, u.at from up u join sp s on s.trace = u.trace and s.span_id = u.at where s.operation = 'invoke_agent'
), last_row as (
    select trace, span_id, max(obs_seq) as seq from obs group by all
), f as (
    select o.* exclude (request_model), c.agent, c.version,
        case when h.at is not null and l.seq = o.obs_seq then null else o.request_model end as request_model,
        case o.level when 'inferred' then 1 when 'declared' then 2 when 'observed' then 3 else 4 end as level_rank
    from obs o left join ctx c on c.trace = o.trace and c.span_id = o.span_id
    left join hit h on h.trace = o.trace and h.at = o.span_id left join last_row l on l.trace = o.trace and l.span_id = o.span_id
)"""

_ROWS = _CONTEXT + """, named as (
    select f.*, coalesce(agent, sub_agent, case when server is null then service end) as a_name, coalesce(case when odd_provider then 'openai' else provider end, '') as m_provider from f
), ent as (
    select *, 'agent:' || substr(sha256('agent' || chr(0) || '' || chr(0) || lower(a_name)), 1, 24) as a_id,
        'model:' || substr(sha256('model' || chr(0) || lower(m_provider) || chr(0) || lower(request_model)), 1, 24) as m_id,
        'mcp_server:' || substr(sha256('mcp_server' || chr(0) || '' || chr(0) || lower(server)), 1, 24) as s_id,
        'tool:' || substr(sha256('tool' || chr(0) || lower(coalesce(server, '')) || chr(0) || lower(tool)), 1, 24) as t_id,
        'data_source:' || substr(sha256('data_source' || chr(0) || 'postgresql' || chr(0) || lower(data_source)), 1, 24) as d_id
    from named
), nr as (
    select obs_seq, ts_ns, level_rank, source, trace_id, a_id as id, 'agent' as type, a_name as name, '' as provider from ent where a_name is not null
    union all select obs_seq, ts_ns, level_rank, source, trace_id, m_id, 'model', request_model, m_provider from ent where request_model is not null
    union all select obs_seq, ts_ns, level_rank, source, trace_id, s_id, 'mcp_server', server, '' from ent where server is not null
    union all select obs_seq, ts_ns, level_rank, source, trace_id, t_id, 'tool', tool, coalesce(server, '') from ent where tool is not null
    union all select obs_seq, ts_ns, level_rank, source, trace_id, d_id, 'data_source', data_source, 'postgresql' from ent where data_source is not null
), ends as (
    select obs_seq, ts_ns, level_rank, source, trace_id, a_id as from_id, 'uses' as relation, m_id as to_id from ent where a_name is not null and request_model is not null
    union all select obs_seq, ts_ns, level_rank, source, trace_id, a_id, 'connects_to', s_id from ent where a_name is not null and server is not null
    union all select obs_seq, ts_ns, level_rank, source, trace_id, a_id, 'invokes', t_id from ent where a_name is not null and tool is not null
    union all select obs_seq, ts_ns, level_rank, source, trace_id, s_id, 'provides', t_id from ent where server is not null and tool is not null
    union all select obs_seq, ts_ns, level_rank, source, trace_id, a_id, 'reads_from', d_id from ent where a_name is not null and data_source is not null
), er as (
    select *, 'edge:' || substr(sha256(from_id || chr(0) || relation || chr(0) || to_id), 1, 24) as id from ends
), cr as (
    select obs_seq, ts_ns, level_rank, source, trace_id, a_id as node_id, 'version' as field, '' as key, version as value from ent where a_name is not null and version is not null
    union all select obs_seq, ts_ns, level_rank, source, trace_id, a_id, 'property', 'gen_ai.agent.id', agent from ent where a_name is not null and agent is not null
    union all select obs_seq, ts_ns, level_rank, source, trace_id, m_id, 'version', '', response_model from ent where request_model is not null and response_model is not null
    union all select obs_seq, ts_ns, level_rank, source, trace_id, m_id, 'property', 'gen_ai.operation.name', operation from ent where request_model is not null
    union all select obs_seq, ts_ns, level_rank, source, trace_id, m_id, 'property', 'server.address', address from ent where request_model is not null and address is not null
    union all select obs_seq, ts_ns, level_rank, source, trace_id, s_id, 'property', 'aiebom.mcp.discovery.source', 'config' from ent where server is not null
    union all select obs_seq, ts_ns, level_rank, source, trace_id, t_id, 'property', 'aiebom.mcp.discovery.source', 'config' from ent where tool is not null and server is not null
    union all select obs_seq, ts_ns, level_rank, source, trace_id, t_id, 'property', 'gen_ai.tool.type', 'function' from ent where tool is not null and server is null
    union all select obs_seq, ts_ns, level_rank, source, trace_id, d_id, 'property', 'db.system.name', 'postgresql' from ent where data_source is not null
)"""


def _summary(rows: str, keys: str, extra: str = "") -> str:
    level = "case max(level_rank) when 1 then 'inferred' when 2 then 'declared' when 3 then 'observed' else 'verified' end as level"
    return f"""select {keys}{extra}, {level}, count(*) as n, min(ts_ns) as first_ns, max(ts_ns) as last_ns, array_to_string(list_sort(list_distinct(list(source))), '|') as sources,
        array_to_string(list_slice(list_sort(list_distinct(list(trace_id))), 1, 20), '|') as trace_ids from {rows} group by {keys}"""


_CLAIMS = _ROWS + """, cs as (
    select node_id, field, key, value, max(level_rank) as level_rank, count(*) as n, min(ts_ns) as first_ns, max(ts_ns) as last_ns from cr group by all
), res as (
    select *, cast(row_number() over (partition by node_id, field, key order by level_rank desc, last_ns desc, value) as integer) as rank, count(*) over (partition by node_id, field, key) > 1 as conflict from cs
)"""
_FIELDS = _CLAIMS + """, fields as (
    select n.id, coalesce(max(case when field = 'version' and rank = 1 then value end), '') as version,
        coalesce(array_to_string(list_sort(list(value) filter (where field = 'version')), '|'), '') as observed_versions, '' as digests,
        coalesce(array_to_string(list_sort(list(key || '=' || value) filter (where field = 'property' and rank = 1)), '|'), '') as properties
    from (select distinct id from nr) n left join res on res.node_id = n.id group by n.id
)"""


def _side(rows: str, keys: str, more: str) -> str:
    return f"select {keys}, max(level_rank) as l{more} from {rows} group by {keys}"


_DIFF = _ROWS + """, ca as (select node_id, field, key, value, max(level_rank) l, count(*) n, min(ts_ns) a, max(ts_ns) b, list_sort(list_distinct(list(source))) s, list_slice(list_sort(list_distinct(list(trace_id))), 1, 20) t from cr where obs_seq % 4 <> 0 group by all),
cb as (select node_id, field, key, value, max(level_rank) l, count(*) n, min(ts_ns) a, max(ts_ns) b, list_sort(list_distinct(list(source))) s, list_slice(list_sort(list_distinct(list(trace_id))), 1, 20) t from cr where obs_seq % 4 <> 2 group by all),
wa as (select *, row_number() over (partition by node_id, field, key order by l desc, b desc, value) r from ca), wb as (select *, row_number() over (partition by node_id, field, key order by l desc, b desc, value) r from cb),
fa as (select node_id, max(case when field = 'version' and r = 1 then value end) v, list_sort(list(value) filter (where field = 'version')) o, list_sort(list(key || '=' || value) filter (where field = 'property' and r = 1)) p, list_sort(list(to_json(struct_pack(field, key, value, l, n, a, b, s, t)))) e from wa group by node_id),
fb as (select node_id, max(case when field = 'version' and r = 1 then value end) v, list_sort(list(value) filter (where field = 'version')) o, list_sort(list(key || '=' || value) filter (where field = 'property' and r = 1)) p, list_sort(list(to_json(struct_pack(field, key, value, l, n, a, b, s, t)))) e from wb group by node_id),
na as (select id, max(level_rank) l, arg_min(name, obs_seq) nm, arg_min(provider, obs_seq) pr from nr where obs_seq % 4 <> 0 group by id), nb as (select id, max(level_rank) l, arg_min(name, obs_seq) nm, arg_min(provider, obs_seq) pr from nr where obs_seq % 4 <> 2 group by id),
j as (select coalesce(na.id, nb.id) as id, na.id as x, nb.id as y, na.l as la, nb.l as lb, na.nm as nma, nb.nm as nmb, na.pr as pra, nb.pr as prb, fa.v as va, fb.v as vb, fa.o as oa, fb.o as ob, fa.p as pa, fb.p as pb, fa.e as ea, fb.e as eb
    from na full outer join nb on na.id = nb.id left join fa on fa.node_id = na.id left join fb on fb.node_id = nb.id),
d as (select id, case when x is null then 'added' when y is null then 'removed' else 'changed' end as change, case when x is null or y is null then '' else concat_ws('|',
    case when nma is distinct from nmb then 'name' end, case when va is distinct from vb or oa is distinct from ob then 'version' end, case when pra is distinct from prb then 'provider' end,
    case when pa is distinct from pb then 'properties' end, case when ea is distinct from eb then 'fieldEvidence' end, case when la is distinct from lb then 'evidence.level' end) end as fields from j)
select * from d where change <> 'changed' or fields <> ''"""

ORACLE_SQL: dict[str, str] = {
    "c02_agent_inheritance": _CONTEXT + " select obs_seq, agent as id, agent as name, version from f",
    "c03_summary_suppression": _CONTEXT + " select obs_seq, request_model from f",
    "d03_nodes": _ROWS + " " + _summary("nr", "id, type", ", arg_min(name, obs_seq) as name, arg_min(provider, obs_seq) as provider"),
    "d04_edges": _ROWS + " " + _summary("er", "id, from_id, to_id, relation"),
    "d05_claims": _ROWS + " " + _summary("cr", "node_id, field, key, value"),
    "d06_claim_resolution": _CLAIMS + " select node_id, field, key, value, rank, conflict from res",
    "d08_materialised_fields": _FIELDS + " select id, version, observed_versions, digests, properties from fields",
    "d11_graph_summary": _ROWS + " select 'node' as entity, type as kind, count(distinct id) as n from nr group by type union all select 'edge', relation, count(distinct id) from er group by relation",
    "c04_node_diff": _DIFF,
    "c05_edge_diff": _ROWS + """, a as (select id, max(level_rank) l from er where obs_seq % 4 <> 0 group by id), b as (select id, max(level_rank) l from er where obs_seq % 4 <> 2 group by id)
        select coalesce(a.id, b.id) as id, case when a.id is null then 'added' when b.id is null then 'removed' else 'changed' end as change, case when a.l <> b.l then 'evidence.level' else '' end as fields
        from a full outer join b on a.id = b.id where a.l is distinct from b.l""",
    "e04_first_seen": f"with {OBSERVATIONS_SQL} select min(obs_seq) as obs_seq, span_id, ts_ns, level from obs group by trace, span_id, ts_ns, level",
    "m03_dependencies": _ROWS + " select n.id as ref, coalesce(array_to_string(list_sort(list(distinct er.to_id)), '|'), '') as depends_on from (select distinct id from nr) n left join er on er.from_id = n.id group by n.id",
    "c09_denied_paths": _ROWS + """, e as (select distinct from_id, to_id, relation from er), p as (
        select a.from_id || '|' || a.to_id || '|' || b.to_id as path, a.from_id from e a join e b on a.to_id = b.from_id and b.relation = 'provides' join nr on nr.id = b.to_id
        where a.relation = 'connects_to' and regexp_matches(nr.name, 'tool-[12]'))
        select min(path) as path from p group by from_id""",
    "p10_policy_violations": _CLAIMS + """, nodes as (select id, type, arg_min(name, obs_seq) as name, arg_min(provider, obs_seq) as provider, max(level_rank) as l from nr group by id, type),
        lv as (select *, case l when 1 then 'inferred' when 2 then 'declared' when 3 then 'observed' else 'verified' end as level from nodes), ver as (select distinct node_id from cr where field = 'version')
        select 'minimum-evidence' as rule, id as node_id, 'evidence ' || level || ' is below observed' as message from lv where type = 'tool' and l < 3
        union all select 'minimum-evidence', id, 'evidence ' || level || ' is below verified' from lv where type = 'model' and l < 4
        union all select 'allowed-providers', id, 'provider ' || provider || ' is not allowed' from lv where provider <> '' and lower(provider) not in ('openai', 'postgresql')
        union all select 'require-provider', id, 'provider is required' from lv where type in ('data_source', 'agent') and provider = ''
        union all select 'require-version', id, 'version is required' from lv where type in ('model', 'agent') and id not in (select node_id from ver)
        union all select 'denied-name-pattern[0]', id, 'name ' || name || ' is denied' from lv where name = 'tool-1'
        union all select 'denied-name-pattern[1]', id, 'name ' || name || ' is denied' from lv where regexp_matches(name, 'ds-[34]')
        union all select 'forbid-field-conflict', node_id, field || case when key <> '' then ':' || key else '' end || ' has ' || count(*) || ' values' from cs group by node_id, field, key having count(*) > 1""",
    "x07_claim_rows": f"with {OBSERVATIONS_SQL}" + """, c as (
        select 'version' as field, '' as key, own_version as value from obs where own_version is not null
        union all select 'property', 'gen_ai.operation.name', operation from obs where request_model is not null
        union all select 'version', '', response_model from obs where response_model is not null
        union all select 'property', 'server.address', address from obs where address is not null
        union all select 'property', 'aiebom.mcp.discovery.source', 'config' from obs where server is not null
        union all select 'property', 'aiebom.mcp.discovery.source', 'config' from obs where server is not null and tool is not null
        union all select 'property', 'gen_ai.tool.type', 'function' from obs where tool is not null and server is null
        union all select 'property', 'db.system.name', 'postgresql' from obs where data_source is not null)
        select field, key, count(*) as n, count(distinct value) as "values" from c group by field, key""",
}

# The queries below are put together from those above.
_LEVEL = "case {} when 1 then 'inferred' when 2 then 'declared' when 3 then 'observed' else 'verified' end"
_BOTH = "(select * from {0} where obs_seq % 4 <> 0 union all select * from {0} where obs_seq % 4 <> 2)"
_STAMP = "strftime(make_timestamp({0} // 1000), '%Y-%m-%dT%H:%M:%S') || case when {0} % 1000000000 = 0 then '' else '.' || rtrim(lpad(cast({0} % 1000000000 as varchar), 9, '0'), '0') end || 'Z'"
_PROPERTIES = _FIELDS + f""", ns as (select id, type, max(level_rank) as l, count(*) as n, min(ts_ns) as a, max(ts_ns) as b from nr group by id, type),
    props as (
        select id as bom_ref, 'aibom:node:type' as name, type as value from ns union all select id, 'aibom:evidence:level', {_LEVEL.format('l')} from ns union all select id, 'aibom:evidence:observation-count', cast(n as varchar) from ns
        union all select id, 'aibom:evidence:first-seen', {_STAMP.format('a')} from ns union all select id, 'aibom:evidence:last-seen', {_STAMP.format('b')} from ns
        union all select node_id, 'aibom:attribute:' || key, value from res where field = 'property' and rank = 1 union all select node_id, 'aibom:observed-version', value from res where field = 'version'
        union all select node_id, 'aibom:field-evidence:' || field || case when key <> '' then ':' || key else '' end || ':selected', value from res where rank = 1
        union all select node_id, 'aibom:field-evidence:' || field || case when key <> '' then ':' || key else '' end || ':candidate:' || {_LEVEL.format('level_rank')}, value from res
        union all select node_id, 'aibom:field-conflict', field || case when key <> '' then ':' || key else '' end from res where rank = 1 and conflict
    )"""
_KIND = "case type when 'model' then 'machine-learning-model' when 'data_source' then 'data' else 'application' end"
_NODES = "(select id, type, arg_min(name, obs_seq) as name, arg_min(provider, obs_seq) as provider, max(level_rank) as l from nr group by id, type)"
_SOURCES = "list_sort(list_distinct(list(source))) as sources, list_slice(list_sort(list_distinct(list(trace_id))), 1, 20) as trace_ids"
_COUNTED = "max(level_rank) as level_rank, count(*) as n, min(ts_ns) as first_ns, max(ts_ns) as last_ns"
_TURNS = """t as (select *, lag(turn) over (partition by conv_id order by turn) as b from conversations where conv_id is not null and turn is not null),
    c as (select *, conv_id || ':' || turn as span_id, nullif(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '') as content from t)"""


def _hmac(text: str) -> str:
    block = KEY.ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in block).hex() for x in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({text}))))"


_STREAM = "select * exclude (level, source), case level when 'verified' then 'observed' else level end as level, service as source from obs0"
_OTLP = f"with {OBSERVATIONS_SQL} select trace_id, span_id, parent_span_id, ts_ns, case level when 'verified' then 'observed' else level end as level, service as source, array_to_string(list_sort(list_filter([{ATTRIBUTES_SQL}, 'aiebom.evidence.level=' || level, 'app.seq=' || obs_seq, 'app.size=' || {SIZE_SQL}, 'app.tags=[\"' || span_id || '\",\"' || (obs_seq % 4 = 2) || '\"]', 'otel.scope.name=lib', 'otel.scope.schema_url=http://schema'], lambda x: x is not null)), '|') as attrs from obs"

ORACLE_SQL |= {
    "a01_otlp_documents": _OTLP,
    "a02_compact_documents": f"with {OBSERVATIONS_SQL} select trace_id, span_id, parent_span_id, ts_ns, case when obs_seq % 10 = 4 then 'declared' else level end as level, source, array_to_string(list_sort(list_filter([{ATTRIBUTES_SQL}, 'app.size=' || {SIZE_SQL}, 'app.none=null', 'app.deep={{\"a\":[' || obs_seq || '],\"b\":\"\\u003c\"}}'], lambda x: x is not null)), '|') as attrs from obs",
    "a03_routed_documents": f"""with {OBSERVATIONS_SQL} select 'otlp' as kind, count(distinct trace) + 3 as n from obs where obs_seq % 8 = 0 union all select 'compact', count(*) from obs where obs_seq % 8 = 2 union all select 'none', count(*) from obs where obs_seq % 8 = 4
        union all select 'quarantined', count(*) from obs where obs_seq % 8 = 4 union all select 'otlp rows', count(*) from obs where obs_seq % 8 = 0 union all select 'compact rows', count(*) from obs where obs_seq % 8 = 2""",
    "a06_span_table": f"with {OBSERVATIONS_SQL} select lower(trace_id) as trace_id, span_id, parent_span_id, case when obs_seq % 5 < 2 then -1 else ts_ns end as ts_ns, 'observed' as level, service as source, 'b=' || (obs_seq % 4 = 2) || '|d=' || {SIZE_SQL} || '|i=' || obs_seq || '|s=' || level || '|x=' || base64(unhex(span_id)) as attrs from obs",
    "a07_snapshot": _FIELDS + f", n as (select id, type, arg_min(name, obs_seq) as name, {_LEVEL.format('max(level_rank)')} as level, count(*) as n, min(ts_ns) as first_ns, max(ts_ns) as last_ns from nr group by id, type) select * from n join fields using (id)",
    "a08_bom_files": _ROWS + f", d as (select id, {_KIND} as kind, (select count(distinct to_id) from er where er.from_id = x.id) as targets from {_NODES} x) select kind as type, count(*) as components, cast(sum(targets) as bigint) as depends_on from d group by kind",
    "a09_diff_report": f"select row_number() over (order by entity desc, change, id) as place, * from (select 'node' as entity, change, id, fields from ({_DIFF}) union all select 'edge', change, id, fields from ({ORACLE_SQL['c05_edge_diff']}))",
    "d12_has_changes": f"select 'all' as graph_id, (select count(*) from ({_DIFF})) > 0 as has_changes union all select 'same', false",
    "b16_metadata_only": f"with {_TURNS} select span_id, array_to_string(list_sort(list_filter(['agent.name=' || case when b is null then 'agent-' || (conv_id % 7) end, 'aiebom.prompt.content_present=' || case when role = 'system' and content is not null then 'true' end, 'aiebom.prompt.hmac_sha256=' || case when role = 'system' then {_hmac('content')} end], lambda x: x is not null)), '|') as attrs from c",
    "c02_deep_chains": f"with {_TURNS} select conv_id * 100000 + turn as obs_seq, 'agent-' || (conv_id % 7) as name from c",
    "x06_prompts": f"""with {_TURNS}, s as (select *, {_hmac('content')} as h from c where role = 'system' and content is not null) select 'digest' as field, 'hmac-sha256' as key, h as value, count(*) as n from s group by h
        union all select 'property', 'content.retained', 'false', count(*) from s having count(*) > 0 union all select 'property', 'content.hashed', 'true', count(*) from s having count(*) > 0""",
    "x06_prompt_edges": f"""with {_TURNS}, s as (select 'agent:' || substr(sha256('agent' || chr(0) || '' || chr(0) || 'agent-' || (conv_id % 7)), 1, 24) as a, 'prompt:' || substr(sha256('prompt' || chr(0) || '' || chr(0) || 'system-instructions'), 1, 24) as p from c where role = 'system' and content is not null)
        select 'edge:' || substr(sha256(a || chr(0) || 'uses_prompt' || chr(0) || p), 1, 24) as id, count(*) as n from s group by a, p""",
    "d09_merge": _ROWS + f""", u as {_BOTH.format('nr')}, cu as {_BOTH.format('cr')}, w as (select node_id, value, row_number() over (partition by node_id order by max(level_rank) desc, max(ts_ns) desc, value) as r from cu where field = 'version' group by node_id, value),
        v as (select node_id, max(case when r = 1 then value end) as version, array_to_string(list_sort(list(value)), '|') as observed_versions from w group by node_id), m as ({_summary('u', 'id, type')})
        select m.*, coalesce(version, '') as version, coalesce(observed_versions, '') as observed_versions from m left join v on v.node_id = m.id""",
    "c06_backfill": _CLAIMS + f", ns as (select id, min(ts_ns) as a, max(ts_ns) as b from nr group by id) select node_id, field, key, value, cast(level_rank as integer) as level_rank, n, first_ns, last_ns from cs where field = 'property' union all select node_id, field, key, value, 1, 1, case when rank = 1 then a else 0 end, case when rank = 1 then b else 0 end from res join ns on ns.id = node_id where field = 'version'",
    "c09_three_hops": _ROWS + f""", e as (select distinct from_id, to_id, relation from er), n as {_NODES} select min(a.from_id || '|' || a.to_id || '|' || b.from_id || '|' || c.to_id) as path from e a join e b on b.to_id = a.to_id and b.relation = 'invokes' and b.from_id <> a.from_id join e c on c.from_id = b.from_id and c.relation = 'uses'
        join n t on t.id = a.to_id and t.l >= 3 join n x on x.id = b.from_id and regexp_matches(x.name, '^agent-1') join n m on m.id = c.to_id and lower(m.provider) = 'openai' where a.relation = 'invokes' group by a.from_id""",
    "c11_dangling": _ROWS + ", r as (select distinct id from nr where type <> 'mcp_server' union select from_id from er) select r.id as ref, coalesce(array_to_string(list_sort(list(distinct er.to_id)), '|'), '') as depends_on from r left join er on er.from_id = r.id group by r.id",
    "d10_counters": f"with {OBSERVATIONS_SQL}, k as (select *, obs_seq % 16 = 0 as blank from obs) select 'all' as graph_id, count(*) as received, count(*) filter (where blank) + count(distinct trace || span_id) filter (where not blank) as accepted, count(*) - (count(*) filter (where blank) + count(distinct trace || span_id) filter (where not blank)) as duplicate from k",
    "f01_canonical_order": _CLAIMS + " select row_number() over (order by node_id, field, key, value) as place, node_id, field, key, value from cs",
    "g03_contract": _ROWS + """, x as (select distinct id, type, provider from nr where type in ('agent', 'model', 'tool')), y as (select distinct id, type, provider from nr where type in ('agent', 'model', 'tool') and level_rank > 1),
        ex as (select distinct from_id, relation, to_id from er where relation in ('uses', 'invokes')), ey as (select distinct from_id, relation, to_id from er where relation in ('uses', 'invokes') and level_rank > 1),
        nx as (select id, type, arg_min(provider, obs_seq) as p from nr where type in ('agent', 'model', 'tool') group by id, type), ny as (select id, type, arg_min(provider, obs_seq) as p from nr where type in ('agent', 'model', 'tool') and level_rank > 1 group by id, type)
        select 'node' as entity, id, type as what, p as other, 1 as side from (select * from nx except select * from ny) union all select 'node', id, type, p, 2 from (select * from ny except select * from nx)
        union all select 'edge', from_id, relation, to_id, 1 from (select * from ex except select * from ey) union all select 'edge', from_id, relation, to_id, 2 from (select * from ey except select * from ex)""",
    "i06_stream_graph": over(_ROWS, _STREAM + " where obs_seq % 2 = 0") + f" select id, type as kind, {_LEVEL.format('max(level_rank)')} as level, count(*) as n, min(ts_ns) as first_ns, max(ts_ns) as last_ns from nr group by id, type union all select id, relation, {_LEVEL.format('max(level_rank)')}, count(*), min(ts_ns), max(ts_ns) from er group by id, relation",
    "i08_stream_counts": f"""with recursive {OBSERVATIONS_SQL}, p as (select *, case when parent_span_id = '' then 2 else event_id % 2 end as batch from obs), once as (select distinct trace, span_id, parent_span_id, batch from p),
        reach as (select trace, span_id from once where parent_span_id = '' union all select o.trace, o.span_id from once o join reach r on r.trace = o.trace and r.span_id = o.parent_span_id),
        k as (select batch, count(*) as received, count(distinct trace || span_id) as accepted from p group by batch)
        select batch, received, accepted, received - accepted as duplicate, case batch when 2 then (select count(*) from once) - (select count(*) from reach) else (select cast(sum(j.accepted) as bigint) from k j where j.batch <= k.batch) end as pending from k""",
    "k01_issues": _CLAIMS + f""", n as {_NODES}, r as (select *, split_part(node_id, ':', 1) as kind from res)
        select distinct 'node' as entity, '' as id, 'empty id' as issue from n where type = 'mcp_server' union select 'node', '', 'duplicate id' from n where type = 'mcp_server' having count(*) > 1 union select 'node', id, 'duplicate id' from n where type = 'data_source'
        union select 'node', node_id, 'inconsistent version' from r where kind = 'model' and field = 'version' union select 'claim', node_id, 'untrimmed field or key' from r where key = 'gen_ai.tool.type' union select 'node', node_id, 'inconsistent property' from r where key = 'gen_ai.tool.type'
        union select 'claim', node_id, 'unsupported field' from r where kind = 'data_source' union select 'claim', node_id, 'version with a key' from r where kind = 'agent' and field = 'version' union select 'claim', node_id, 'no values' from r where key = 'server.address'
        union select 'claim', node_id, 'duplicate value' from r where key = 'server.address' group by node_id having count(*) > 1 union select 'node', node_id, 'inconsistent property' from r where key = 'server.address' union select 'claim', node_id, 'invalid level' from r where kind = 'mcp_server'""",
    "k06_tampered": _ROWS + " select 'node' as entity, id, side from (select distinct id from nr where type = 'tool'), (values (1), (2)) v(side) union all select distinct 'edge', id, 1 from er where relation = 'provides'",
    "m02_properties": _PROPERTIES + " select bom_ref, name, value from props",
    "m01_components": _PROPERTIES + f", p as (select bom_ref, to_json(list(struct_pack(name, value) order by name, value)) as properties from props group by bom_ref) select n.id as bom_ref, {_KIND} as type, n.name, f.version, n.provider as publisher, '[]' as hashes, cast(p.properties as varchar) as properties from {_NODES} n join fields f on f.id = n.id join p on p.bom_ref = n.id",
    "m04_header": _ROWS + f", h as (select max(ts_ns) as t from nr), s as (select sha256('collector' || chr(0) || {_STAMP.format('t')}) as d, {_STAMP.format('t')} as moment from h) select 'all' as graph_id, 'urn:uuid:' || substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-' || substr(d, 13, 4) || '-' || substr(d, 17, 4) || '-' || substr(d, 21, 12) as serial_number, 1 as version, moment as timestamp from s",
    "p01_forbid_inferred": _ROWS + f" select 'forbid-inferred' as rule, id as node_id, 'evidence is inferred' as message from (select id, max(level_rank) as l from nr where level_rank < 3 group by id) where l = 1",
    "p08_denied_path_rows": f"select 'denied-path:agent-server-tool' as rule, split_part(path, '|', 1) as node_id, path, 'path ' || replace(path, '|', ' -> ') as message from ({ORACLE_SQL['c09_denied_paths']})",
    "p10_policy_report": f"select 'all' as graph_id, (select count(*) from ({ORACLE_SQL['p10_policy_violations']})) + (select count(*) from ({ORACLE_SQL['c09_denied_paths']})) as violations, false as passed",
    "f02_violations_in_order": f"select row_number() over (order by node_id, rule, message) as place, rule, node_id, message from (select * from ({ORACLE_SQL['p10_policy_violations']}) union all select 'denied-path:agent-server-tool', split_part(path, '|', 1), 'path ' || replace(path, '|', ' -> ') from ({ORACLE_SQL['c09_denied_paths']}))",
    "w1_scan_with_dedup": over(_ROWS, "select * from obs0 where obs_seq % 2 = 0") + " select relation, count(distinct id) as edges, count(*) as n from er group by relation",
    "k05_snapshot_digest": _FIELDS + f""", kn as (select 'all' as graph_id, id, type, arg_min(name, obs_seq) as name, arg_min(provider, obs_seq) as provider, {_COUNTED}, {_SOURCES} from nr group by id, type),
        ke as (select 'all' as graph_id, id, from_id, to_id, relation, {_COUNTED}, {_SOURCES} from er group by all), kc as (select 'all' as graph_id, node_id, field, key, value, {_COUNTED}, {_SOURCES} from cr group by all),
        pr as (select id, list_sort(list(struct_pack(key, value)) filter (where rank = 1 and field = 'property')) as properties, list_sort(list(value) filter (where field = 'version')) as observed_versions from kn left join res on res.node_id = kn.id group by id),
        rows as (
            select sha256(cast(to_json(struct_pack(digests := [], first_ns, graph_id, id, last_ns, level := {_LEVEL.format('level_rank')}, level_rank, n, name, observed_versions := coalesce(pr.observed_versions, []), properties := coalesce(pr.properties, []), provider, sources, trace_ids, type, version)) as varchar)) as d from kn join pr using (id) join fields f using (id)
            union all select sha256(cast(to_json(struct_pack(first_ns, from_id, graph_id, id, last_ns, level := {_LEVEL.format('level_rank')}, level_rank, n, relation, sources, to_id, trace_ids)) as varchar)) from ke
            union all select sha256(cast(to_json(struct_pack(field, first_ns, graph_id, key, last_ns, level := {_LEVEL.format('level_rank')}, level_rank, n, node_id, sources, trace_ids, value)) as varchar)) from kc
        ), l4 as (select substr(d, 1, 4) as p, sha256(string_agg(d, '' order by d)) as d from rows group by 1), l2 as (select substr(p, 1, 2) as p, sha256(string_agg(d, '' order by d)) as d from l4 group by 1) select 'all' as graph_id, sha256(string_agg(d, '' order by d)) as digest from l2""",
}

_META = "normalizer.version=1|privacy.mode=metadata-only"
ORACLE_SQL |= {
    "a01_large_documents": _OTLP,
    "b01_repeated_keys": _OTLP,
    "b05_document_sources": f"with {OBSERVATIONS_SQL} select source, count(*) as documents from (select min(service) as source from obs group by trace) group by source",
    "b18_digest_claims": f"with {OBSERVATIONS_SQL} select 'model:' || substr(sha256('model' || chr(0) || lower(coalesce(case when odd_provider then 'openai' else provider end, '')) || chr(0) || lower(request_model)), 1, 24) as node_id, 'sha256' as key, md5(request_model) as value, count(*) as n from obs where request_model is not null group by all",
    "d09_merged_headers": _ROWS + f""", c as (select source as graph_id, count(*) as n from nr group by source)
        select graph_id, '1' as schema_version, 7 as generated_ns, 'second' as source, 'aggregation.mode=continuous' || case when graph_id = 'src-1' then '|kept=a' else '' end || '|last=z|' || 'normalizer.version=1|privacy.mode=metadata-only|run=3' as metadata, n * case when graph_id = 'src-1' then 3 else 2 end as n from c""",
    "a07_partitioned_snapshot": _ROWS + f""", n as (select source, count(distinct id) as nodes, count(*) as n from nr group by source), e as (select source, count(distinct id) as edges from er group by source), c as (select source, count(distinct node_id || chr(0) || field || chr(0) || key || chr(0) || value) as claims from cr group by source)
        select kind, source as graph_id, nodes, n, edges, claims, 'scan' as source, 9 as generated_ns, '{_META}' as metadata from n join e using (source) join c using (source), (values ('parquet'), ('json')) k(kind)""",
    "i01_clocked_stream": f"""with {OBSERVATIONS_SQL}, w as (select *, obs_seq % 6 < 2 as third from obs where parent_span_id <> ''), k as (select distinct trace, span_id, parent_span_id, third from w),
        c as (select (select count(*) from w) as r, (select count(*) from k) as n, (select count(*) from w where third) as r3, (select count(*) from k where third) as n3,
            (select count(*) from k where third and not exists (select 1 from k p where p.trace = k.trace and p.span_id = k.parent_span_id)) as p3)
        select unnest([0, 1, 2, 3, 4, -1]) as batch, unnest([r, r3, 1, 1, r3, r + 2 * r3 + 2]) as received, unnest([n, 0, 1, 1, n3, n + n3 + 2]) as accepted, unnest([r - n, r3, 0, 0, r3 - n3, r + 2 * r3 - n - n3]) as duplicate, unnest([n, n, 0, 0, p3, 0]) as pending, unnest([0, 0, n, 0, 0, 0]) as released_late from c""",
    "a11_stored_bom": over(_FIELDS, _STREAM + " where obs_seq % 2 = 0") + f", d as (select from_id, array_to_string(list_sort(list(distinct to_id)), '|') as depends_on from er group by from_id) select n.id as bom_ref, {_KIND} as type, n.name, f.version, coalesce(d.depends_on, '') as depends_on from {_NODES} n join fields f on f.id = n.id left join d on d.from_id = n.id",
    "c09_eight_hops": _ROWS + f""", e as (select distinct from_id as a, to_id as t from er where relation = 'invokes'), n as {_NODES}, tools as (select id from n where type = 'tool' and lower(provider) = 'server-1' and regexp_matches(name, '^tool-[1-5]$')),
        agents as (select id from n where type = 'agent' and regexp_matches(name, '^agent-1[1-4]$')), w as (
            select [a] as path, a as at, 0 as k from (select distinct e.a from e)
            union all select list_append(w.path, x.id), x.id, k + 1 from w join (select 1 as odd, e.a as f, e.t as id from e where e.t in (select id from tools) union all select 0, e.t, e.a from e where e.a in (select id from agents)) x on x.f = w.at and x.odd = (w.k + 1) % 2
            where k < 8 and not list_contains(w.path, x.id))
        select array_to_string(min(path), '|') as path from w where k = 8 group by path[1]""",
    "p11_policy_tables": _ROWS + f""", g as (select source as graph_id, id, type, arg_min(name, obs_seq) as name, arg_min(provider, obs_seq) as provider, max(level_rank) as l from nr group by source, id, type), v as (select distinct source as graph_id, node_id from cr where field = 'version'), i as (select unnest(range(100)) as i),
        cf as (select source as graph_id, node_id, field, key, count(distinct value) as n from cr group by all having count(distinct value) > 1)
        select 'names' as policy, graph_id, 'minimum-evidence' as rule, id as node_id, 'evidence ' || {_LEVEL.format('l')} || ' is below observed' as message from g where type = 'tool' and l < 3
        union all select 'names', graph_id, 'allowed-providers', id, 'provider ' || provider || ' is not allowed' from g where provider <> '' and lower(provider) <> 'openai'
        union all select 'names', graph_id, 'denied-name-pattern[' || i || ']', id, 'name ' || name || ' is denied' from g join i on regexp_matches(name, '^tool-' || i || '$')
        union all select 'more', * from (
            select graph_id, 'denied-name-pattern[' || i || ']', id, 'name ' || name || ' is denied' from g join i on regexp_matches(name, 'model-' || i)
            union all select graph_id, 'forbid-inferred', id, 'evidence is inferred' from g where l = 1
            union all select graph_id, 'require-version', id, 'version is required' from g where type = 'agent' and (graph_id, id) not in (select graph_id, node_id from v)
            union all select graph_id, 'require-provider', id, 'provider is required' from g where type in ('data_source', 'agent') and provider = ''
            union all select graph_id, 'forbid-field-conflict', node_id, field || case when key <> '' then ':' || key else '' end || ' has ' || n || ' values' from cf
        ) where graph_id in ('src-0', 'src-2')""",
}
