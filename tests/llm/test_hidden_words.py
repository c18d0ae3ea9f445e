"""Obfuscated words of every kind, and urls judged from a small labelled table."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

PAGES = "/root/testdata/sf0.1/pages.parquet"
WORDS = ["i      d   i        o t", "i\nd\ni\no\nt", "i/d/i/o/t", "i / d / i / o / t", "i,d,i,o,t", "id​iot", "id­iot", "idiоt", "ｉｄｉｏｔ", "\U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d", "i d i o t", "1d10t", "i.d.i.o.t"]


def flat_decoder():
    from spanloom.llm.toxicity import Decoder

    return Decoder(np.log10(np.full((28, 28, 28), 1 / 28)))


@pytest.mark.parametrize("word", WORDS)
def test_hidden_words_are_found_and_restored(word):
    from spanloom.llm.toxicity import suspects

    text = f"Such {word} here ".encode()
    found = [text[a:b].decode() for a, b in suspects(np.frombuffer(text, np.uint8), np.array([0, len(text)]))]
    assert found == [word] and flat_decoder()(word) == "idiot"


def test_runs_end_with_their_text_and_plain_words_stay():
    from spanloom.llm.toxicity import suspects

    text = b"a b c d "
    assert len(suspects(np.frombuffer(text, np.uint8), np.array([0, 8]))) == 1
    # the same letters in two texts
    assert suspects(np.frombuffer(text, np.uint8), np.array([0, 4, 8])) == []
    for plain in ("", "a", "plain words, nothing else. ", "просто слова ", "höchst gewöhnlich "):
        data = np.frombuffer(plain.encode(), np.uint8)
        assert suspects(data, np.array([0, len(data)])) == []


def test_url_sample_does_not_follow_the_files(spark):
    from spanloom.llm.url_filter import judge

    rows = [(k, f"http://{'casino' if k % 2 else 'garden'}{k}.example.com/p") for k in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labelled = pages.select("url", F.when(F.col("page_id") % 2 == 1, "block").otherwise("allow").alias("verdict"))
    once = {r.page_id: r.verdict for r in judge(pages, [], labelled, sample=100).collect()}
    # other partitions, and one url many times
    again = labelled.union(labelled.where("url like '%casino1.%'").crossJoin(spark.range(200)).select("url", "verdict")).repartition(7, "url")
    assert once == {r.page_id: r.verdict for r in judge(pages.repartition(5), [], again, sample=100).collect()}
    assert sum(once[k] == ("block" if k % 2 else "allow") for k in once) >= 290


@pytest.mark.skipif(not os.path.exists(PAGES), reason="the test tables aren't here")
def test_labelled_table_on_all_pages(spark):
    """Hosts of betting, drugs, adult, advertising and spam against all others."""
    from spanloom.llm.queries import url_labels
    from spanloom.llm.url_filter import judge

    bad = F.col("host").rlike("casino-win|free-bets|ads-track|spam-farm|cheap-pills|adult-x")
    found = judge(spark.read.parquet(PAGES).select("page_id", "url"), [], url_labels(spark)).select(bad.alias("bad"), "verdict").collect()
    blocked = [r.verdict == "block" for r in found if r.bad]
    wrong = [r.verdict == "block" for r in found if not r.bad]
    assert len(blocked) > 100 and sum(blocked) >= 0.9 * len(blocked) and sum(wrong) <= 0.05 * len(wrong)
