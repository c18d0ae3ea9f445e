"""Policies: node rules in one pass over nodes and claims, or as a table for many policies, and bounded directed path
rules as paths that grow in rounds."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.attributes import LEVELS, level_name, trim
from spanloom.operators.evidence import Graph, resolve
from spanloom.plans.store import materialize, materialize_counted

MOST_RELATIONS = 8


@dataclass
class Selector:
    type: str = ""
    name_pattern: str = ""
    provider: str = ""
    minimum_evidence: str = ""


@dataclass
class PathRule:
    name: str
    start: Selector
    via: list[Selector]
    relations: list[str]
    to: Selector


@dataclass
class Policy:
    minimum_evidence: dict[str, str] = field(default_factory=dict)
    allowed_providers: list[str] = field(default_factory=list)
    require_providers_for: list[str] = field(default_factory=list)
    require_versions_for: list[str] = field(default_factory=list)
    denied_name_patterns: list[str] = field(default_factory=list)
    forbid_inferred: bool = False
    forbid_field_conflicts: bool = False
    denied_paths: list[PathRule] = field(default_factory=list)


def java_pattern(pattern: str) -> str:
    """A linear-time pattern in Java's dialect; what only backtracking engines have is refused."""
    if re.search(r"\(\?(?:=|!|<=|<!)|\\[1-9]|\\C", pattern):
        raise ValueError(f"not supported in a pattern: {pattern}")
    out = re.sub(r"\(\?P<", "(?<", pattern)
    out = re.sub(r"\[\[:(\w+):\]\]", lambda m: r"\p{" + m[1].capitalize() + "}", out)
    if "(?m" not in out:
        out = re.sub(r"(?<!\\)\$", r"\\z", out)
    try:
        re.compile(re.sub(r"\\p\{\w+\}", "x", out).replace(r"\z", r"\Z").replace("(?<", "(?P<"))
    except re.error as e:
        raise ValueError(f"bad pattern {pattern}: {e}") from e
    return out


def read_policy(text: str) -> Policy:
    """A policy from its JSON document; unknown members are an error."""
    data = json.loads(text)
    names = {"minimumEvidence": "minimum_evidence", "allowedProviders": "allowed_providers", "requireProvidersFor": "require_providers_for", "requireVersionsFor": "require_versions_for", "deniedNamePatterns": "denied_name_patterns", "forbidInferred": "forbid_inferred", "forbidFieldConflicts": "forbid_field_conflicts"}
    if unknown := set(data) - {*names, "version", "deniedPaths"}:
        raise ValueError(f"unknown members: {sorted(unknown)}")
    of = {"type": "type", "namePattern": "name_pattern", "provider": "provider", "minimumEvidence": "minimum_evidence"}
    selector = lambda x: Selector(**{of[k]: v for k, v in x.items()})
    paths = [PathRule(p["name"], selector(p.get("from", {})), [selector(v) for v in p.get("via", [])], p.get("relations", []), selector(p.get("to", {}))) for p in data.get("deniedPaths", [])]
    policy = Policy(**{names[k]: v for k, v in data.items() if k in names}, denied_paths=paths)
    validate(policy)
    return policy


def validate(policy: Policy) -> None:
    """Raise for what can't be evaluated, before any job runs."""
    selectors = [s for p in policy.denied_paths for s in (p.start, *p.via, p.to)]
    for level in [*policy.minimum_evidence.values(), *(s.minimum_evidence for s in selectors if s.minimum_evidence)]:
        if level not in LEVELS:
            raise ValueError(f"unknown level: {level}")
    for pattern in [*policy.denied_name_patterns, *(s.name_pattern for s in selectors if s.name_pattern)]:
        java_pattern(pattern)
    for p in policy.denied_paths:
        if not 1 <= len(p.relations) <= MOST_RELATIONS:
            raise ValueError(f"{p.name}: 1 to {MOST_RELATIONS} relations")
        if any(not r.strip() for r in p.relations):
            raise ValueError(f"{p.name}: empty relation")
        if len(p.via) not in (0, len(p.relations) - 1) or (p.via and len(p.via) != len(p.relations) - 1):
            raise ValueError(f"{p.name}: via needs a selector for each node between")


def rank(level: str) -> int:
    return LEVELS.index(level) + 1


def node_violations(g: Graph, policy: Policy) -> DataFrame:
    """graph_id, rule, node_id, path, message of the rules on single nodes: one pass over nodes, one over claims."""
    tests: list[Column] = []

    def rule(name: str, test: Column, message: Column) -> None:
        tests.append(F.when(test, F.struct(F.lit(name).alias("rule"), message.alias("message"))))

    level, kind, provider = F.col("level_rank"), F.col("type"), F.coalesce("provider", F.lit(""))
    if policy.forbid_inferred:
        rule("forbid-inferred", level == 1, F.lit("evidence is inferred"))
    for t, least in sorted(policy.minimum_evidence.items()):
        rule("minimum-evidence", (kind == t) & (level < rank(least)), F.concat(F.lit("evidence "), F.col("level"), F.lit(f" is below {least}")))
    if policy.allowed_providers:
        allowed = [p.strip().lower() for p in policy.allowed_providers]
        rule("allowed-providers", (provider != "") & ~F.lower(provider).isin(allowed), F.concat(F.lit("provider "), provider, F.lit(" is not allowed")))
    for name, types, missing in (("require-provider", policy.require_providers_for, trim(provider) == ""), ("require-version", policy.require_versions_for, (trim(F.coalesce("version", F.lit(""))) == "") & (F.size("observed_versions") <= 0))):
        if types:
            rule(name, F.lower(kind).isin([t.strip().lower() for t in types]) & missing, F.lit(name.split("-")[1] + " is required"))
    for i, p in enumerate(policy.denied_name_patterns):
        rule(f"denied-name-pattern[{i}]", F.col("name").rlike(java_pattern(p)), F.concat(F.lit("name "), F.col("name"), F.lit(" is denied")))
    nowhere = F.array().cast("array<string>")
    out = None
    if tests:
        out = g.nodes.select("graph_id", F.col("id").alias("node_id"), F.inline(F.filter(F.array(*tests), lambda v: v.isNotNull()))).select("graph_id", "rule", "node_id", nowhere.alias("path"), "message")
    if policy.forbid_field_conflicts:
        claims = resolve(g.claims).groupBy("graph_id", "node_id", "field", "key").agg(F.count("*").alias("values")).where("values > 1")
        name = F.concat("field", F.when(F.col("key") != "", F.concat(F.lit(":"), "key")).otherwise(""))
        rows = claims.select("graph_id", F.lit("forbid-field-conflict").alias("rule"), "node_id", nowhere.alias("path"), F.concat(name, F.lit(" has "), F.col("values").cast("string"), F.lit(" values")).alias("message"))
        out = rows if out is None else out.unionByName(rows)
    return out


def selects(s: Selector) -> Column:
    test = F.lit(True)
    if s.type:
        test &= F.col("type") == s.type
    if s.provider:
        test &= F.lower("provider") == s.provider.lower()
    if s.name_pattern:
        test &= F.col("name").rlike(java_pattern(s.name_pattern))
    if s.minimum_evidence:
        test &= F.col("level_rank") >= rank(s.minimum_evidence)
    return test


def denied_path(g: Graph, p: PathRule) -> DataFrame:
    """graph_id, path: for each start the smallest simple path that follows the relations through the selectors.

    Backwards first: edges of each step are kept if they end in a node from which the rest can be walked. Then every
    start has one path that grows by its smallest next node, a round for all starts at once; where no node is left that
    the path doesn't hold, its last one is taken back and the next larger is tried. A start is done with its first whole
    path, which is the smallest one, so there is a row for each start, whatever the number of paths. Starts that stand at
    one node look at its next nodes together, a few more than a path can hold, so that a hub's edges are read once a
    round. Rounds are as many as the relations and a few more; what is open then, as so many paths had to be taken back,
    is left to `_all_walks`."""
    steps = [p.start, *(p.via or [Selector()] * (len(p.relations) - 1)), p.to]
    nodes = [g.nodes.where(selects(s)).select("graph_id", "id") for s in steps]
    edges = g.edges.select("graph_id", "from_id", "to_id", "relation")
    goal, hops = nodes[-1], None
    for k in reversed(range(len(p.relations))):
        hop = edges.where(F.col("relation") == p.relations[k]).join(goal.withColumnRenamed("id", "to_id"), ["graph_id", "to_id"], "left_semi").join(nodes[k].withColumnRenamed("id", "from_id"), ["graph_id", "from_id"], "left_semi")
        hop = materialize(hop.select("graph_id", F.lit(k).alias("step"), F.col("from_id").alias("at"), F.col("to_id").alias("next")).distinct(), "hop")
        goal = hop.select("graph_id", F.col("at").alias("id")).distinct()
        hops = hop if hops is None else hops.unionByName(hop)
    # tried: of every node of the path the last of its next ones that was tried
    state, whole = goal.select("graph_id", F.array("id").alias("path"), F.array(F.lit("")).alias("tried")), len(p.relations) + 1
    for _ in range(whole + MOST_BACK):
        state, now = materialize_counted(state, "paths", open=F.count_if(F.size("path") < whole))
        if not now["open"]:
            return state.select("graph_id", "path")
        going = state.where(F.size("path") < whole).withColumns({"step": F.size("path") - 1, "at": F.element_at("path", -1), "last": F.element_at("tried", -1)})
        place = ["graph_id", "step", "at", "last"]
        found = going.select(*place).distinct().join(hops, ["graph_id", "step", "at"]).where(F.col("next") > F.col("last"))
        found = found.withColumn("r", F.row_number().over(Window.partitionBy(*place).orderBy("next"))).where(F.col("r") <= MOST_RELATIONS + 1)
        found = found.groupBy(*place).agg(F.array_sort(F.collect_list("next")).alias("nexts"))
        next_ = F.get(F.filter("nexts", lambda x: ~F.array_contains("path", x)), F.lit(0))
        moved = going.join(found, place, "left").withColumn("next", next_)
        but_last = lambda c: F.slice(c, F.lit(1), F.size(c) - 1)
        ahead = F.col("next").isNotNull()
        moved = moved.select("graph_id", F.when(ahead, F.array_append("path", F.col("next"))).otherwise(but_last("path")).alias("path"), F.when(ahead, F.concat(but_last("tried"), F.array("next", F.lit("")))).otherwise(but_last("tried")).alias("tried"))
        state = state.where(F.size("path") == whole).unionByName(moved.where(F.size("path") > 0))
    state = materialize(state, "paths")
    left = state.where(F.size("path") < whole).select("graph_id", F.col("path")[0].alias("at"))
    return state.where(F.size("path") == whole).select("graph_id", "path").unionByName(_all_walks(left, hops, whole - 1))


def _all_walks(starts: DataFrame, hops: DataFrame, steps: int) -> DataFrame:
    """The smallest path of each of starts(graph_id, at) by all walks at once. Of walks with one start, one end and the
    same nodes between only the smallest goes on, as all of them can be continued alike."""
    walk = starts.select("graph_id", F.array("at").alias("path"), "at")
    for k in range(steps):
        walk = walk.join(hops.where(F.col("step") == k).select("graph_id", "at", "next"), ["graph_id", "at"]).where(~F.array_contains("path", F.col("next"))).select("graph_id", F.array_append("path", F.col("next")).alias("path"), F.col("next").alias("at"))
        walk = walk.groupBy("graph_id", "at", F.col("path")[0].alias("start"), F.array_sort("path").alias("nodes")).agg(F.min("path").alias("path")).select("graph_id", "path", "at")
    return walk.groupBy("graph_id", F.col("path")[0].alias("start")).agg(F.min("path").alias("path")).select("graph_id", "path")


#: Rounds in which paths can be taken back before all walks of a start are looked at.
MOST_BACK = 4
#: Rows of a table of rules that are broadcast; more go another way.
MOST_RULES = 10_000


def rule_table(spark: SparkSession, policies: dict[str, Policy], graphs: dict[str, list[str]] | None = None) -> DataFrame:
    """Node rules of named policies as rows: policy, rule, kind, type, least, allowed, pattern, graphs (null: all)."""
    rows = []
    for name, policy in policies.items():
        validate(policy)
        on = (graphs or {}).get(name)
        if policy.forbid_inferred:
            rows.append((name, "forbid-inferred", "inferred", None, None, None, None, on))
        rows += [(name, "minimum-evidence", "evidence", t, rank(least), None, None, on) for t, least in sorted(policy.minimum_evidence.items())]
        if policy.allowed_providers:
            rows.append((name, "allowed-providers", "allowed", None, None, [x.strip().lower() for x in policy.allowed_providers], None, on))
        rows += [(name, "require-provider", "provider", t.strip().lower(), None, None, None, on) for t in policy.require_providers_for]
        rows += [(name, "require-version", "version", t.strip().lower(), None, None, None, on) for t in policy.require_versions_for]
        rows += [(name, f"denied-name-pattern[{i}]", "pattern", None, None, None, java_pattern(x), on) for i, x in enumerate(policy.denied_name_patterns)]
        if policy.forbid_field_conflicts:
            rows.append((name, "forbid-field-conflict", "conflict", None, None, None, None, on))
    return spark.createDataFrame(rows, "policy string, rule string, kind string, type string, least int, allowed array<string>, pattern string, graphs array<string>")


def policies_violations(g: Graph, policies: dict[str, Policy], graphs: dict[str, list[str]] | None = None) -> DataFrame:
    """policy, graph_id, rule, node_id, path, message of many policies over many graphs, each over all graphs or those
    that are named for it. One theta join of nodes and rules; patterns are tried on distinct names only."""
    spark = g.nodes.sparkSession
    table = rule_table(spark, policies, graphs)
    size = sum(5 + len(p.minimum_evidence) + len(p.require_providers_for) + len(p.require_versions_for) + len(p.denied_name_patterns) for p in policies.values())
    rules = F.broadcast(table) if size <= MOST_RULES else table
    concerns = F.col("r.graphs").isNull() | F.array_contains("r.graphs", F.col("n.graph_id"))
    provider, level, r_type = F.coalesce("n.provider", F.lit("")), F.col("n.level_rank"), F.col("r.type")
    lower = F.lower("n.type") == r_type
    kind = lambda k: F.col("r.kind") == k
    broken = (kind("inferred") & (level == 1)) | (kind("evidence") & (F.col("n.type") == r_type) & (level < F.col("r.least"))) | (kind("allowed") & (provider != "") & ~F.array_contains("r.allowed", F.lower(provider)))
    broken = broken | (kind("provider") & lower & (trim(provider) == "")) | (kind("version") & lower & (trim(F.coalesce("n.version", F.lit(""))) == "") & (F.size("n.observed_versions") <= 0))
    said = F.when(kind("inferred"), "evidence is inferred").when(kind("evidence"), F.concat(F.lit("evidence "), "n.level", F.lit(" is below "), level_name(F.col("r.least")))).when(kind("allowed"), F.concat(F.lit("provider "), provider, F.lit(" is not allowed")))
    said = said.when(kind("provider"), "provider is required").otherwise("version is required")
    nowhere = F.array().cast("array<string>")
    out = g.nodes.alias("n").join(rules.where(~F.col("kind").isin("pattern", "conflict")).alias("r"), broken & concerns)
    out = out.select("r.policy", "n.graph_id", "r.rule", F.col("n.id").alias("node_id"), nowhere.alias("path"), said.alias("message"))
    names = g.nodes.select("name").distinct().alias("n").join(rules.where("kind = 'pattern'").alias("r"), F.expr("n.name rlike r.pattern")).select("n.name", "r.policy", "r.rule", "r.graphs")
    named = g.nodes.alias("n").join(names.alias("r"), (F.col("n.name") == F.col("r.name")) & concerns)
    out = out.unionByName(named.select("r.policy", "n.graph_id", "r.rule", F.col("n.id").alias("node_id"), nowhere.alias("path"), F.concat(F.lit("name "), "n.name", F.lit(" is denied")).alias("message")))
    claims = g.claims.groupBy("graph_id", "node_id", "field", "key").agg(F.count("*").alias("values")).where("values > 1").alias("n").join(rules.where("kind = 'conflict'").alias("r"), concerns)
    name = F.concat("field", F.when(F.col("key") != "", F.concat(F.lit(":"), "key")).otherwise(""))
    out = out.unionByName(claims.select("r.policy", "n.graph_id", "r.rule", "n.node_id", nowhere.alias("path"), F.concat(name, F.lit(" has "), F.col("values").cast("string"), F.lit(" values")).alias("message")))
    for policy, p in ((k, p) for k, v in policies.items() for p in v.denied_paths):
        on = (graphs or {}).get(policy)
        part = g if on is None else Graph(*(t.where(F.col("graph_id").isin(on)) for t in (g.nodes, g.edges, g.claims)))
        out = out.unionByName(_path_rows(part, p).select(F.lit(policy).alias("policy"), "graph_id", "rule", "node_id", "path", "message"))
    return out


def _path_rows(g: Graph, p: PathRule) -> DataFrame:
    return denied_path(g, p).select("graph_id", F.lit(f"denied-path:{p.name}").alias("rule"), F.col("path")[0].alias("node_id"), "path", F.concat(F.lit("path "), F.array_join("path", " -> ")).alias("message"))


def violations(g: Graph, policy: Policy) -> DataFrame:
    """All violations of a policy."""
    validate(policy)
    out = node_violations(g, policy)
    for p in policy.denied_paths:
        rows = _path_rows(g, p)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = g.nodes.where("false").select("graph_id", F.lit("").alias("rule"), F.col("id").alias("node_id"), F.array().cast("array<string>").alias("path"), F.lit("").alias("message"))
    return out


def ordered(found: DataFrame) -> DataFrame:
    """Violations by node, rule, message and path."""
    return found.orderBy("graph_id", "node_id", "rule", "message", "path")


def report(g: Graph, found: DataFrame) -> DataFrame:
    """graph_id, violations, passed of every graph."""
    counts = found.groupBy("graph_id").agg(F.count("*").alias("violations"))
    return g.nodes.select("graph_id").distinct().join(counts, "graph_id", "left").select("graph_id", F.coalesce("violations", F.lit(0)).alias("violations"), F.col("violations").isNull().alias("passed"))
