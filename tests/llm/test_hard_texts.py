"""Texts that no operator may fail on, and columns that none may overwrite."""

import pytest
from pyspark.sql import functions as F

LONG = 100_000
TEXTS = {
    "mail domain": "a@" + "b." * LONG + "com",
    "mails": "a@b.com " * (LONG // 8),
    "mail without end": "a@" * LONG,
    "name": "Mr " + "Anna " * 30_000,
    "hyphens": "Mrs " + "Anna-" * LONG,
    "initials": "Dr " + "A." * LONG,
    "digits": "1" * LONG,
    "grouped digits": "1234 " * LONG,
    "dots": "1." * LONG,
    "phone": "+1" + " 23" * LONG,
    "secret": "password=" + "x" * LONG,
    "keywords": "token " * LONG,
    "marks": "é́" * LONG,
}


def docs(spark):
    return spark.createDataFrame([(k, t, "en", "mine", "too") for k, t in enumerate(TEXTS.values())], "doc_id long, text string, lang string, score string, Lang_Pred string")


def test_surrogates_of_hard_texts(spark):
    from spanloom.llm.pii import pseudonymise

    found = {r.doc_id: r for r in pseudonymise(docs(spark)).collect()}
    texts = list(TEXTS.values())
    assert len(found) == len(texts) and all(r.score == "mine" for r in found.values())
    for k, name in enumerate(TEXTS):
        # what isn't an entity stays; a domain of more labels than there can be is none
        if name in ("mail domain", "mail without end", "digits", "keywords", "marks"):
            assert found[k].text == texts[k], name
    mails = set(found[list(TEXTS).index("mails")].text.split())
    assert len(mails) == 1 and "a@b.com" not in mails
    names = found[list(TEXTS).index("name")].text.split()
    assert names[0] == "Mr" and len(names) == 30_001 and "Anna" not in names


def test_languages_leave_columns_alone(spark):
    from spanloom.llm.language import filter_languages

    rows = docs(spark).unionByName(spark.createDataFrame([(100, "12 !!", "en", "mine", "too"), (101, None, "en", "mine", "too")], docs(spark).schema))
    out = filter_languages(rows)
    assert out.schema.names == rows.schema.names and out.schema["score"].dataType.typeName() == "string"
    found = out.select("doc_id", "score", "Lang_Pred").collect()
    assert {(r.score, r.Lang_Pred) for r in found} == {("mine", "too")} and not {100, 101} & {r.doc_id for r in found}


@pytest.mark.parametrize("operator", ["dedup", "quality"])
def test_other_operators_on_hard_texts(spark, operator):
    if operator == "dedup":
        from spanloom.llm.exact_dedup import create_index, deduplicate

        assert deduplicate(docs(spark), create_index(spark), 0).where("kept").count() == len(TEXTS)
    else:
        from spanloom.llm.quality import classify, train

        d = docs(spark).select("doc_id", "text")
        assert classify(d, train(d), ["doc_id"]).agg(F.count("*")).first()[0] == len(TEXTS)
