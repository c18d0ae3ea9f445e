"""URL filter, with DataFrame functions and Spark's own learners alone: allow and block rules by host and path, and
for other urls a logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import free_name, materialize

#: Different labelled urls that the regression is trained on, about, at most.
SAMPLE = 20_000
FEATURES = 1 << 12


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, lower-cased in A-Z; empty for a url without one."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(rules: list[tuple[str, str]], host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does. rules: (verdict, host + path); a rule
    fits its host and all subdomains if the path starts with the rule's. Of equal rules the first counts.

    The list is short and known before the job; it becomes one expression, longest rule first."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    # built from the shortest rule outwards
    for verdict, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams(text: Column, mark: str, sizes: tuple[int, ...] = (3, 4)) -> Column:
    """The character n-grams of a text between two marks, each with the mark before it."""
    chars = F.array(F.concat(F.array(F.lit("^")), F.filter(F.split(text, ""), lambda c: c != ""), F.array(F.lit("$"))))

    def of(c: Column, n: int) -> Column:
        count = F.greatest(F.lit(1), F.size(c) - n + 1)
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.concat_ws("", F.lit(mark), *[F.get(c, i + k) for k in range(n)]))

    # the characters are bound once, so that the work follows the text's length
    return F.flatten(F.transform(chars, lambda c: F.concat(*[of(c, n) for n in sizes])))


def features(df: DataFrame, host: str, path: str, out: str) -> DataFrame:
    """Adds `out`: hashed n-grams of two columns, those of both kept apart."""
    terms = free_name("_terms", df)
    found = df.withColumn(terms, F.concat(grams(F.col(host), "h"), grams(F.col(path), "p")))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol=terms, outputCol=out).transform(found).drop(terms)


def train(labelled: DataFrame, sample: int = SAMPLE):
    """A regression from labelled(host, path, verdict), or the only verdict if there is but one (allow if none).

    Rows with a null verdict are left out. Every different host and path counts once for each verdict, so copies of one
    url don't outweigh the others; of about `sample` of them at most, those of least hash, the regression learns. The
    same rows give the same sample however they lie in files."""
    rows = labelled.where("verdict in ('allow', 'block')").select("host", "path", "verdict")
    n = rows.agg(F.approx_count_distinct(F.struct("host", "path"), 0.01)).first()[0]
    if n > sample:
        rows = rows.where(F.xxhash64("host", "path") < int(-(2**63) + sample / n * 2**64))
    rows = materialize(features(rows.distinct(), "host", "path", "features").withColumn("label", (F.col("verdict") == "block").cast("double")), "urls")
    kinds = {r[0] for r in rows.groupBy("verdict").count().collect()}
    if len(kinds) < 2:
        return kinds.pop() if kinds else "allow"
    return LogisticRegression(featuresCol="features", labelCol="label", regParam=1e-3, maxIter=30).fit(rows)


def judge(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """Adds host, path, rule, verdict (allow or block) and block_score to pages(url, ...).

    verdict: the rule's; for other urls, that of a regression trained on labelled(url, verdict), a small table, or
    where it isn't given, on the urls of pages that a rule fits. A null url, or one without ://, has an empty host and path. Repeated
    rows and other columns stay; columns of the five added names are replaced. An empty table gives an empty one."""

    def parts(df: DataFrame) -> DataFrame:
        return df.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})

    own, features_of, raw, p, guess = (free_name(x, pages) for x in ("_rule", "_features", "_raw", "_p", "_predicted"))
    judged = parts(pages).withColumn(own, matching_rule(rules, F.col("host"), F.col("path")))
    if labelled is None:
        model = train(judged.where(F.col(own).isNotNull()).select("host", "path", F.col(own)["verdict"].alias("verdict")), sample)
    else:
        model = train(parts(labelled).select("host", "path", "verdict"), sample)
    if isinstance(model, str):
        scored = judged.withColumn("block_score", F.lit(1.0 if model == "block" else 0.0))
    else:
        model = model.setFeaturesCol(features_of).setRawPredictionCol(raw).setProbabilityCol(p).setPredictionCol(guess)
        scored = model.transform(features(judged, "host", "path", features_of)).withColumn("block_score", vector_to_array(p)[1]).drop(features_of, raw, p, guess)
    learned = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.withColumns({"rule": F.col(own)["rule"], "verdict": F.coalesce(F.col(own)["verdict"], learned)}).drop(own)
