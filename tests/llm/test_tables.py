"""Learned operators on the given tables: accuracy on rows that they haven't learned from."""

import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="the test tables aren't here")


def test_language_id_held_out(spark):
    from spanloom.llm.queries import op8_language_id

    found = op8_language_id(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_toxicity_held_out(spark):
    """Of held-out documents with an insult in plain spelling nearly all are found, and hardly another one."""
    from spanloom.llm.queries import op4_toxicity

    insults = "trash|pathetic|idiot|worthless|disgusting|stupid|clown|scum|loser|moron"
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.lower("text").rlike(insults).alias("plain"))
    rows = op4_toxicity(spark, SF).join(docs, "doc_id").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("toxic is not null").select("held_out", "plain", "toxic", "predicted").collect()
    plain = [r.predicted for r in rows if r.held_out and r.toxic == 1 and r.plain]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert len(plain) >= 3 and sum(plain) >= 0.7 * len(plain) and sum(clean) <= 0.02 * len(clean)


def test_quality_against_labels(spark):
    """Labels of quality play no part in the fit."""
    from spanloom.llm.queries import op5_quality

    labelled = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    rows = op5_quality(spark, SF).join(labelled, "doc_id").where("label is not null").select("quality", "label").collect()
    good = [r.quality for r in rows if r.label == 1]
    bad = [1 - r.quality for r in rows if r.label == 0]
    assert sum(good) >= 0.95 * len(good) and sum(bad) >= 0.6 * len(bad)


def test_urls_of_rules_held_out(spark):
    """The regression on urls whose verdict rules tell, learned from others of them."""
    from spanloom.llm.queries import URL_RULES
    from spanloom.llm.url_filter import host, judge, matching_rule, path

    # sf0.01 has too few urls that rules tell for a share
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url").withColumns({"h": host(F.col("url")), "p": path(F.col("url"))})
    told = pages.withColumn("told", matching_rule(URL_RULES, F.col("h"), F.col("p"))["verdict"]).where("told is not null").select("page_id", "url", "told")
    learn = told.where("page_id % 5 <> 0").select("url", F.col("told").alias("verdict"))
    found = judge(told.where("page_id % 5 = 0"), [], learn).select("told", "verdict").collect()
    right = sum(r.told == r.verdict for r in found)
    assert len(found) >= 100 and right >= 0.9 * len(found), (right, len(found))
