"""Checks of stored snapshots, canonical rows, and digests that don't depend on order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.attributes import trim
from spanloom.operators.evidence import Graph, resolve


def issues(g: Graph) -> DataFrame:
    """graph_id, entity, id, issue of identities and claims that are wrong, or fields that the claims don't give."""
    out = []
    for entity, df in (("node", g.nodes), ("edge", g.edges)):
        counts = df.groupBy("graph_id", "id").agg(F.count("*").alias("n"))
        out.append(counts.where("id is null or trim(id) = ''").select("graph_id", F.lit(entity).alias("entity"), "id", F.lit("empty id").alias("issue")))
        out.append(counts.where("n > 1 and id is not null").select("graph_id", F.lit(entity), "id", F.lit("duplicate id")))
    key, fld, value = F.col("key"), F.col("field"), F.coalesce("value", F.lit(""))
    tests = [
        ("untrimmed field or key", (trim(fld) != fld) | (trim(key) != key)),
        ("unsupported field", ~trim(fld).isin("version", "digest", "property")),
        ("version with a key", (trim(fld) == "version") & (key != "")),
        ("no key", trim(fld).isin("digest", "property") & (key == "")),
        ("no values", F.col("value").isNull()),
        ("empty or untrimmed value", F.col("value").isNotNull() & ((value == "") | (trim(value) != value))),
        ("invalid level", F.col("value").isNotNull() & ~F.coalesce(F.col("level_rank").between(1, 4), F.lit(False))),
    ]
    found = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in tests]), lambda x: x.isNotNull())
    out.append(g.claims.select("graph_id", F.lit("claim"), "node_id", F.explode(found)))
    twice = g.claims.groupBy("graph_id", "node_id", "field", "key", "value").count().where("count > 1")
    out.append(twice.select("graph_id", F.lit("claim"), "node_id", F.lit("duplicate value")))
    # what the claims say again, against what is stored
    resolved = resolve(g.claims.drop("rank", "selected", "conflict"))
    for stored, derived in (("conflict", "conflict"), ("selected", "selected")):
        if stored in g.claims.columns:
            keys = ["graph_id", "node_id", "field", "key", "value"]
            unlike = g.claims.select(*keys, F.col(stored).alias("stored")).join(resolved.select(*keys, F.col(derived).alias("derived")), keys).where(~F.col("stored").eqNullSafe(F.col("derived")))
            out.append(unlike.select("graph_id", F.lit("claim"), "node_id", F.lit(f"inconsistent {stored}")).distinct())
    won = resolved.where("selected").select("graph_id", F.col("node_id").alias("id"), "field", "key", "value")
    at = g.nodes.select("graph_id", "id", "version", "observed_versions", "digests", "properties")
    joined = at.join(won, ["graph_id", "id"])
    says = F.when(fld == "version", F.col("version")).when(fld == "digest", F.element_at("digests", key)).when(fld == "property", F.element_at("properties", key))
    wrong = joined.where(fld.isin("version", "digest", "property") & ~says.eqNullSafe(F.col("value")))
    out.append(wrong.select("graph_id", F.lit("node"), "id", F.concat(F.lit("inconsistent "), fld)).distinct())
    versions = g.claims.where("field = 'version'").groupBy("graph_id", F.col("node_id").alias("id")).agg(F.array_sort(F.collect_set("value")).alias("said"))
    same = F.array_sort(F.array_distinct(F.filter("observed_versions", lambda v: v != "")))
    out.append(at.join(versions, ["graph_id", "id"]).where(~same.eqNullSafe(F.col("said"))).select("graph_id", F.lit("node"), "id", F.lit("inconsistent observed versions")))
    first, *rest = out
    for df in rest:
        first = first.union(df)
    return first


def _canonical(df: DataFrame) -> Column:
    """A row as JSON with fields by name, sets sorted, and maps as sorted entries."""
    parts = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        kind = f.dataType.typeName()
        c = F.col(f.name)
        parts.append((F.array_sort(F.map_entries(c)) if kind == "map" else F.array_sort(F.array_distinct(c)) if kind == "array" else c).alias(f.name))
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def row_digests(g: Graph) -> DataFrame:
    """graph_id, entity, id, digest of every row."""
    out = None
    for entity, df, ident in (("node", g.nodes, "id"), ("edge", g.edges, "id"), ("claim", g.claims, "node_id")):
        df = df.drop("seq")
        rows = df.select("graph_id", F.lit(entity).alias("entity"), F.col(ident).alias("id"), F.sha2(_canonical(df), 256).alias("digest"))
        out = rows if out is None else out.union(rows)
    return out


#: Hex digits of a row's digest that group rows, then groups: no more than 256 parts each after the first.
LEVELS = (4, 2, 0)


def snapshot_digests(g: Graph) -> DataFrame:
    """graph_id, digest: equal for equal content in any order. Row digests are hashed together by their first digits,
    in several levels, so that no level gathers many in one row."""
    parts = row_digests(g).select("graph_id", F.col("digest").alias("name"), "digest")
    for digits in LEVELS:
        parts = parts.groupBy("graph_id", F.substring("name", 1, digits).alias("name")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), ""), 256).alias("digest"))
    return parts.select("graph_id", "digest")


def tampered(a: Graph, b: Graph) -> DataFrame:
    """Rows that only one of two snapshots has, with side 1 or 2; only graphs whose digests differ are compared."""
    x, y = snapshot_digests(a), snapshot_digests(b).withColumnRenamed("digest", "other")
    unlike = x.join(y, "graph_id", "full_outer").where(~F.col("digest").eqNullSafe(F.col("other"))).select("graph_id")
    r, s = (row_digests(g).join(unlike, "graph_id", "left_semi") for g in (a, b))
    return r.exceptAll(s).withColumn("side", F.lit(1)).union(s.exceptAll(r).withColumn("side", F.lit(2)))
