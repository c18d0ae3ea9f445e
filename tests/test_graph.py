"""Small hand-made cases of the evidence-graph operators."""

import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from spanloom.functions import attributes as at
from spanloom.operators import bom, context, diff, evidence, merge, policy, validate
from spanloom.plans.scan import scan
from spanloom.sources import telemetry

SCHEMA = "graph_id string, obs_seq long, ts_ns long, level string, source string, trace_id string, span_id string, parent_span_id string, attrs map<string,string>"


def obs(spark, *rows):
    return spark.createDataFrame([("g", k, 1000 + k, r.get("level", "observed"), "s", r.get("trace", "t"), r.get("span", f"s{k}"), r.get("parent", ""), r["attrs"]) for k, r in enumerate(rows)], SCHEMA)


def names(df):
    return sorted((r["type"], r["name"]) for r in df.collect())


def test_inheritance_suppression_and_edges(spark):
    g = scan(obs(
        spark,
        {"span": "A", "attrs": {"gen_ai.agent.name": "planner", "gen_ai.operation.name": "invoke_agent", "gen_ai.request.model": "m"}},
        {"span": "b", "parent": "a", "attrs": {"gen_ai.operation.name": "chat", "gen_ai.request.model": "m", "gen_ai.provider.name": "p"}},
        {"span": "c", "parent": "b", "attrs": {"gen_ai.operation.name": "execute_tool", "otel.span.name": "execute_tool search"}},
    ))
    assert names(g.nodes) == [("agent", "planner"), ("model", "m"), ("tool", "search")]
    assert sorted(r["relation"] for r in g.edges.collect()) == ["invokes", "uses"]
    assert g.nodes.where("type = 'model'").first()["provider"] == "p"


def test_cycles_missing_parents_and_self_parents_have_no_agent(spark):
    rows = obs(spark, {"span": "a", "parent": "b", "attrs": {}}, {"span": "b", "parent": "a", "attrs": {}}, {"span": "c", "parent": "c", "attrs": {}}, {"span": "d", "parent": "x", "attrs": {}})
    assert all("gen_ai.agent.name" not in r["attrs"] for r in context.inherit_agents(rows).collect())


def test_deep_chain(spark):
    rows = [{"span": "s0", "attrs": {"agent.name": "root"}}] + [{"span": f"s{k}", "parent": f"s{k - 1}", "attrs": {}} for k in range(1, 40)]
    assert {r["attrs"].get("gen_ai.agent.name") for r in context.inherit_agents(obs(spark, *rows)).collect()} == {"root"}


def test_resolution_and_conflict(spark):
    g = evidence.build(obs(
        spark,
        {"level": "verified", "attrs": {"gen_ai.request.model": "m", "gen_ai.model.digest": "sha256:good"}},
        {"level": "declared", "attrs": {"gen_ai.request.model": "m", "gen_ai.model.digest": "sha256:bad"}},
    ))
    won = evidence.resolve(g.claims).where("selected and field = 'digest'").first()
    assert won["value"] == "good" and won["conflict"]
    assert g.nodes.first()["digests"] == {"sha256": "good"}
    assert validate.issues(g).isEmpty()
    stored = evidence.Graph(g.nodes, g.edges, evidence.resolve(g.claims).withColumn("selected", ~F.col("selected")))
    assert {r["issue"] for r in validate.issues(stored).collect()} == {"inconsistent selected"}
    found = policy.violations(g, policy.Policy(forbid_field_conflicts=True))
    assert [r["message"] for r in found.collect()] == ["digest:sha256 has 2 values"]


def test_merge_is_order_free_and_equals_batch(spark):
    rows = obs(spark, *[{"trace": f"t{k}", "attrs": {"gen_ai.request.model": f"m{k % 2}", "gen_ai.response.model": f"v{k % 3}"}} for k in range(30)])
    a, b = evidence.build(rows.where("obs_seq < 13")), evidence.build(rows.where("obs_seq >= 13"))
    whole = evidence.build(rows)
    digest = lambda g: validate.snapshot_digests(g).first()["digest"]
    assert digest(merge.merge(a, b)) == digest(merge.merge(b, a)) == digest(whole)
    assert digest(merge.merge_touched(a, b)) == digest(whole)
    assert max(len(r["trace_ids"]) for r in whole.nodes.collect()) <= 20
    assert diff.diff_nodes(whole, merge.merge(a, b)).isEmpty()
    assert not diff.diff_nodes(a, whole).isEmpty()


def test_paths_policy_and_bom(spark):
    g = scan(obs(spark, {"attrs": {"gen_ai.agent.name": "a", "mcp.server.name": "srv", "mcp.tool.name": "rm"}}))
    rule = policy.PathRule("x", policy.Selector(type="agent"), [policy.Selector(type="mcp_server")], ["connects_to", "provides"], policy.Selector(name_pattern="^rm$"))
    path = policy.denied_path(g, rule).first()["path"]
    assert len(path) == 3 and path[0].startswith("agent:") and path[2].startswith("tool:")
    assert bom.dependencies(g).count() == 3 and bom.components(g).count() == 3
    with pytest.raises(ValueError):
        policy.validate(policy.Policy(minimum_evidence={"tool": "certain"}))
    with pytest.raises(ValueError):
        policy.java_pattern("(?=a)")


def test_hmac_and_ids(spark):
    key = b"k" * 40
    row = spark.range(1).select(at.hmac_sha256(F.lit("text"), key).alias("h"), at.node_id("model", F.lit(" OpenAI "), F.lit("M")).alias("i")).first()
    assert row["h"] == hmac.new(key, b"text", hashlib.sha256).hexdigest()
    assert row["i"] == "model:" + hashlib.sha256(b"model\0openai\0m").hexdigest()[:24]


def test_content_is_never_kept(spark):
    rows = obs(spark, {"attrs": {"gen_ai.prompt": "MUST_NOT_LEAK", "gen_ai.agent.name": "a", "secret.note": "MUST_NOT_LEAK"}})
    g = scan(rows, hmac_key=b"k" * 32)
    assert ("prompt", "system-instructions") in names(g.nodes)
    text = json.dumps([r.asDict(True) for df in (g.nodes, g.edges, g.claims) for r in df.collect()])
    assert "MUST_NOT_LEAK" not in text


def test_documents(spark):
    otlp = {"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "svc"}}]}, "scopeSpans": [{"scope": {"name": "lib"}, "spans": [{"traceId": "T", "spanId": "S", "name": "chat x", "startTimeUnixNano": "5", "attributes": [{"key": "n", "value": {"intValue": "7"}}, {"key": "d", "value": {"doubleValue": 1234567.0}}, {"key": "l", "value": {"arrayValue": {"values": [{"stringValue": "a<b"}]}}}, {"key": "n", "value": {"boolValue": True}}]}]}]}]}
    compact = {"source": "doc", "observations": [{"timestamp": "2024-01-01T01:00:00.123456789+01:00", "level": "odd", "attributes": {"a": 1000000, "b": None, "c": {"z": 1, "y": "<"}}}]}
    docs = spark.createDataFrame([("g", k, x, 9) for k, x in enumerate([json.dumps(otlp), json.dumps(compact), "{}", "nonsense"])], "graph_id string, doc long, text string, ingest_ns long")
    found, bad = telemetry.read_documents(docs)
    rows = {r["source"]: r for r in found.collect()}
    assert bad.count() == 1 and set(rows) == {"svc", "doc"}
    assert rows["svc"]["ts_ns"] == 5 and rows["svc"]["attrs"] == {"service.name": "svc", "otel.scope.name": "lib", "otel.span.name": "chat x", "n": "true", "d": "1.234567e+06", "l": '["a\\u003cb"]'}
    assert rows["doc"]["level"] == "declared" and rows["doc"]["ts_ns"] % 10**9 == 123456789
    assert rows["doc"]["attrs"] == {"a": "1e+06", "b": "null", "c": '{"y":"\\u003c","z":1}'}


@pytest.mark.parametrize(("x", "text"), [(8080.0, "8080"), (0.5, "0.5"), (999999.0, "999999"), (1e6, "1e+06"), (1234567.0, "1.234567e+06"), (0.00001, "1e-05"), (0.0001, "0.0001"), (-2.5, "-2.5"), (0.0, "0")])
def test_float_text(x, text):
    assert telemetry.float_text(x) == text


def test_readers_keep_order_types_and_broken_documents(spark):
    pairs = {"kvlistValue": {"values": [{"key": "b", "value": {"boolValue": True}}, {"key": "d", "value": {"doubleValue": 2.0}}, {"key": "n", "value": {"kvlistValue": {"values": [{"key": "x", "value": {"intValue": "3"}}]}}}]}}
    spans = [{"traceId": "t", "spanId": str(k), "attributes": [{"key": "p", "value": pairs}]} for k in range(1200)]
    docs = spark.createDataFrame([("g", 2**62 + k, x, 9) for k, x in enumerate([json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": spans}, {"spans": spans[:2]}]}]}), '{"resourceSpans":"x"}', '{"observations":{"a":1}}', '{"resourceSpans":null}', "[1]"])], "graph_id string, doc long, text string, ingest_ns long")
    found, bad = telemetry.read_documents(docs)
    rows = found.orderBy("obs_seq").collect()
    assert [r["span_id"] for r in rows] == [*map(str, range(1200)), "0", "1"] and len({r["obs_seq"] for r in rows}) == 1202
    assert json.loads(rows[0]["attrs"]["p"]) == {"b": "true", "d": "2", "n": '{"x":"3"}'}
    assert sorted(r["text"][:4] for r in bad.collect()) == ["[1]", '{"ob', '{"re']
    named = telemetry.document_sources(spark.createDataFrame([("g", 1, json.dumps({"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": " svc "}}]}}]}), 1), ("g", 2, "{}", 1)], docs.schema))
    assert {r["doc"]: r["source"] for r in named.collect()} == {1: "svc", 2: "otlp"}


def test_double_text_equals_the_helper(spark):
    xs = [8080.0, 0.5, 999999.0, 1e6, 1e-5, 0.0001, -2.5, 0.0, 1e21, 1.5e300, 123456.789, 3.14e-7, float("nan"), float("inf"), 100.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(telemetry.double_text(F.col("x")).alias("t")).collect()
    assert [r["t"] for r in got] == [telemetry.float_text(x) for x in xs]


def test_snapshots_are_strict(spark, tmp_path):
    from spanloom.sources import snapshots

    g = evidence.build(obs(spark, {"attrs": {"gen_ai.request.model": "m"}}))
    for kind in ("parquet", "json"):
        snapshots.write_graph(g, f"{tmp_path}/{kind}", kind)
        back = snapshots.read_graph(spark, f"{tmp_path}/{kind}", g, kind)
        assert validate.snapshot_digests(back).first() == validate.snapshot_digests(g).first()
        other = evidence.Graph(g.nodes.withColumn("extra", F.lit(1)), g.edges, g.claims)
        snapshots.write_graph(other, f"{tmp_path}/{kind}2", kind)
        with pytest.raises(ValueError):
            snapshots.read_graph(spark, f"{tmp_path}/{kind}2", g, kind)


def test_policy_documents():
    text = {"version": "1", "minimumEvidence": {"tool": "observed"}, "deniedPaths": [{"name": "x", "from": {"type": "agent"}, "via": [{"provider": "p"}], "relations": ["a", "b"], "to": {"namePattern": "^x$"}}]}
    found = policy.read_policy(json.dumps(text))
    assert found.minimum_evidence == {"tool": "observed"} and found.denied_paths[0].via[0].provider == "p"
    for change in ({"unknown": 1}, {"minimumEvidence": {"tool": "sure"}}, {"deniedNamePatterns": ["(?=x)"]}, {"deniedPaths": [{"name": "x", "relations": ["a"] * 9}]}, {"deniedPaths": [{"name": "x", "relations": ["a", "b"], "via": [{}, {}]}]}):
        with pytest.raises(ValueError):
            policy.read_policy(json.dumps({**text, **change}))


def test_bom_header_and_times(spark):
    heads = spark.createDataFrame([("g", "src", 1704067200123456780), ("h", "src", 0)], "graph_id string, source string, generated_ns long")
    rows = {r["graph_id"]: r for r in bom.header(heads).collect()}
    assert rows["g"]["timestamp"] == "2024-01-01T00:00:00.12345678Z" and rows["h"]["timestamp"] == "1970-01-01T00:00:00Z"
    d = hashlib.sha256(b"src\0" + b"1970-01-01T00:00:00Z").hexdigest()
    assert rows["h"]["serial_number"] == f"urn:uuid:{d[:8]}-{d[8:12]}-{d[12:16]}-{d[16:20]}-{d[20:32]}"


def document(*spans):
    """(span, parent, attributes) of one trace as a line."""
    attrs = lambda a: [{"key": k, "value": {"stringValue": v}} for k, v in a.items()]
    return json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [{"traceId": "T", "spanId": s, "parentSpanId": p, "startTimeUnixNano": "5", "attributes": attrs(a)} for s, p, a in spans]}]}]})


def test_times_at_the_end_of_a_second(spark):
    """Times within the last nanoseconds of a second stay in it, also before 1970 and at the ends of the range."""
    told = {1705744081999999883: "2024-01-20T09:48:01.999999883Z", 1705744081999999999: "2024-01-20T09:48:01.999999999Z", 1705744082000000000: "2024-01-20T09:48:02Z", -1: "1969-12-31T23:59:59.999999999Z", -(10**9): "1969-12-31T23:59:59Z", -(2**63): "1677-09-21T00:12:43.145224192Z", 2**63 - 1: "2262-04-11T23:47:16.854775807Z"}
    rows = spark.createDataFrame([(ns,) for ns in told], "ns long").withColumn("text", bom.rfc3339(F.col("ns"))).collect()
    assert {r.ns: r.text for r in rows} == told
    ns = 1705744081999999883
    line = json.dumps({"observations": [{"timestamp": told[ns], "attributes": {}}]})
    docs = spark.createDataFrame([("g", 0, line, 7)], "graph_id string, doc long, text string, ingest_ns long")
    assert telemetry.read_compact(docs).first().ts_ns == ns
