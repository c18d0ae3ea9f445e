"""Queries of the operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import held_out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.decontaminate import contaminated

    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from spanloom.llm.packing import pack_documents

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.top_k import quantised, top_k

    return top_k(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), F.col("vec_id") % 20 == 0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.toxicity import labelled_sample, score, train

    docs = documents(spark, sf_dir).select("doc_id", "text", held_out(F.col("doc_id"), 0).alias("held_out"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    learn = docs.where("not held_out")
    sample, prior = labelled_sample(learn, labels.where(~held_out(F.col("doc_id"), 0)))
    return score(docs, train(sample, learn, prior=prior), ["doc_id", "held_out"])


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.quality import classify, train

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return classify(docs, train(docs), ["doc_id"])


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.language_model import score, train

    docs = documents(spark, sf_dir).select("doc_id", "text", held_out(F.col("doc_id"), 1).alias("held_out"))
    return score(docs, train(docs.where("not held_out")), ["doc_id", "held_out"])


#: Rules of the query: (verdict, host and path).
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


#: Labelled urls (fixed values): betting, drugs, adult, advertising and spam hosts against plain ones.
URL_LABELS = """
    block http://casino-games.example.com/en/11
    block https://www.slots-casino.example.net/en/48?page=2
    block https://m.online-casino.example.org/de/85/
    block http://blog.poker-win.example.com/de/25.html
    block https://big-win-lotto.example.net/fr/62#top
    block https://www.lotto-jackpot.example.org/fr/99
    block https://blog.sports-bets.example.net/es/76/
    block https://bets-now.example.org/en/16.html
    block http://www.free-money.example.com/en/53#top
    block https://m.free-spins.example.net/de/90
    block https://blog.cheap-meds.example.org/de/30?page=2
    block https://www.diet-pills.example.net/fr/104.html
    block https://m.pills-direct.example.org/es/44#top
    block http://blog.viagra-cheap.example.com/es/81
    block https://adult-video.example.net/en/21?page=2
    block https://www.adult-chat.example.org/en/58/
    block http://m.xxx-adult.example.com/de/95.html
    block https://blog.sex-cams.example.net/de/35#top
    block https://ads-server.example.org/fr/72
    block http://www.ads-click.example.com/fr/12?page=2
    block https://m.track-ads.example.net/es/49/
    block https://blog.click-track.example.org/es/86.html
    block http://pixel-track.example.com/en/26#top
    block https://www.popup-ads.example.net/en/63
    block https://m.spam-mail.example.org/de/100?page=2
    block http://blog.spam-links.example.com/de/40/
    block https://link-farm.example.net/fr/77.html
    block https://www.content-farm.example.org/fr/17#top
    block http://m.win-prize.example.com/es/54
    block https://blog.crack-warez.example.net/es/91?page=2
    allow http://city-news.example.com/en/11
    allow https://www.morning-news.example.net/en/48?page=2
    allow https://m.weather.example.org/de/85/
    allow http://blog.state-library.example.com/de/25.html
    allow https://library.example.net/fr/62#top
    allow https://www.open-university.example.org/fr/99
    allow http://m.university.example.com/es/39?page=2
    allow https://blog.museum.example.net/es/76/
    allow https://garden.example.org/en/16.html
    allow http://www.home-garden.example.com/en/53#top
    allow https://m.recipes.example.net/de/90
    allow https://blog.kitchen.example.org/de/30?page=2
    allow http://maps.example.com/fr/67/
    allow https://www.docs.example.net/fr/104.html
    allow https://m.developer-docs.example.org/es/44#top
    allow http://blog.forum.example.com/es/81
    allow https://health.example.net/en/21?page=2
    allow https://www.hospital.example.org/en/58/
    allow http://m.science-journal.example.com/de/95.html
    allow https://blog.science.example.net/de/35#top
    allow https://history.example.org/fr/72
    allow http://www.travel.example.com/fr/12?page=2
    allow https://m.train-times.example.net/es/49/
    allow https://blog.school.example.org/es/86.html
    allow http://music.example.com/en/26#top
    allow https://www.concerts.example.net/en/63
    allow https://m.football-club.example.org/de/100?page=2
    allow http://blog.photos.example.com/de/40/
    allow https://books.example.net/fr/77.html
    allow https://www.bookshop.example.org/fr/17#top
    allow http://m.encyclopedia.example.com/es/54
    allow http://blog.education.example.com/es/96#top
    allow https://www.nutrition.example.org/en/73?page=2
    allow https://www.wikis.example.net/en/78#top
    allow https://m.dictionary.example.org/de/18
"""


def url_labels(spark: SparkSession) -> DataFrame:
    """(url, verdict) of the labelled urls."""
    line = F.explode(F.split(F.lit(URL_LABELS.strip()), r"\s*\n\s*")).alias("line")
    parts = F.split("line", " ")
    return spark.range(1).select(line).select(F.get(parts, F.lit(0)).alias("verdict"), F.get(parts, F.lit(1)).alias("url"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.url_filter import judge

    found = judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), URL_RULES, url_labels(spark))
    return found.select("page_id", "host", "path", "rule", "verdict", "block_score")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.language import fit, predict

    docs = documents(spark, sf_dir).withColumn("held_out", held_out(F.col("doc_id"), 0))
    model = fit(docs.where("not held_out"))
    return predict(docs, model, ["doc_id", "held_out"])


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.pii import pseudonymise

    found = pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), report=True)
    return found.select("doc_id", F.size("entities").alias("n_entities"), F.array_join(F.transform("entities", lambda e: e["kind"]), "|").alias("kinds"), "text")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.near_duplicates import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.prefix_trie import conversation_trie

    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.whitening import whiten

    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.llm.exact_dedup import create_index, deduplicate

    return deduplicate(documents(spark, sf_dir), create_index(spark), 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_url_filter": op7_url_filter,
    "op8_language_id": op8_language_id,
    "op9_pii_surrogates": op9_pii_surrogates,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_exact_dedup": op13_exact_dedup,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_top_k": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
            from embeddings
            where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select q.vec_id as query_id, c.vec_id, cast(list_inner_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) as score
            from v q join v c on q.vec_id <> c.vec_id
            where q.vec_id % 20 = 0
        ), r as (
            select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s
        )
        select query_id, rank, vec_id, score from r where rank <= 20
    """,
    # crc32 bit by bit over the decimal digits; a node is its list of turns
    "op11_conversation_trie": r"""
        with t as (
            select conv_id, row_number() over (partition by conv_id order by turn nulls first, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), ':', coalesce(text, '')))) as i, {'role': coalesce(role, ''), 'text': coalesce(text, '')} as turn
            from conversations where conv_id is not null
        ), own as (
            select conv_id, list(turn order by i) as turns from t group by conv_id
        ), h as (
            select conv_id, turns, conv_id - conv_id % 20 as base,
                cast(xor(list_reduce(list_transform(string_split(cast(conv_id as varchar), ''), lambda x: cast(ascii(x) as bigint)),
                    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: case when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end), 4294967295), 4294967295) % 4 as integer) as h
            from own
        ), p as (
            select h.conv_id, coalesce(list_slice(b.turns, 1, h.h), []) || list_slice(h.turns, h.h + 1, len(h.turns)) as path
            from h left join own b on b.conv_id = h.base
        ), m as (
            select conv_id, path, d, list_slice(path, 1, d) as node from p, lateral (select unnest(range(len(path) + 1)) as d)
        ), n as (
            select node, d, min(conv_id) as conv_id, count(*) as n_convs, string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (len(path) = d) as ends,
                case when d = 0 then 0 else len(list_filter(regexp_split_to_array(node[d].text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) end as words
            from m group by node, d
        ), c as (
            select list_slice(node, 1, d - 1) as node, count(*) as n_children from n where d > 0 group by 1
        ), k as (
            select n.*, coalesce(n_children, 0) as n_children from n left join c using (node)
        ), s as (
            select list_slice(node, 1, up) as node, sum(case when n_children = 0 then 1 else 0 end) as n_leaves, sum((n_convs - 1) * words) as saved_tokens
            from (select *, unnest(range(d + 1)) as up from k) group by 1
        )
        select k.conv_id, cast(k.d as bigint) as depth, u.conv_id as parent_conv_id, k.n_convs, k.n_children, cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, sha256(coalesce(k.ends, '')) as ends_sha256
        from k join s using (node) left join n u on k.d > 0 and u.node = list_slice(k.node, 1, k.d - 1)
    """,
    "op13_exact_dedup": r"""
        with d as (
            select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents
        ), g as (
            select text_sha256, min(doc_id) as keep_id, count(*) as group_size from d group by text_sha256
        )
        select doc_id, keep_id, group_size, row_number() over (partition by text_sha256 order by doc_id nulls last) = 1 as kept, text_sha256
        from d join g using (text_sha256)
    """,
}
