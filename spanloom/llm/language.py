"""Language identification by hierarchical discrimination: the family of languages first, then one-versus-one
linear support vector machines between the languages of that family, over hashed byte n-grams of whole texts.

The machines are trained in one task on a bounded sample of labelled documents and sent to the tasks as weights;
documents are only mapped.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import chunks, free_name, materialize, row_hash, trimmed
from spanloom.llm.linear import BUCKETS, sigmoid, svm, text_vectors

#: Families of common languages (fixed values); a language of none is a family by itself.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca"],
    "slavic": ["ru", "pl", "cs", "uk", "sk", "bg", "hr", "sr", "sl"],
}
#: Labelled documents of each language that the machines are trained on.
SAMPLE = 1000
#: Bytes of whole documents in the sample of each language.
SAMPLE_BYTES = 6_000_000


def _fit(families: dict[str, str]):
    @trimmed
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["lang", "rank"]).reset_index(drop=True)
        batch = pa.RecordBatch.from_arrays([pa.array(pdf["text"], pa.string())], ["text"])
        x = np.stack([v for _, _, data, offsets in chunks(batch) for v in text_vectors(data, offsets)])
        lang = pdf["lang"].to_numpy()
        family = np.array([families.get(c, c) for c in lang])
        model = {"families": {f: sorted(set(lang[family == f])) for f in sorted(set(family))}, "family": {}, "pair": {}}
        names = list(model["families"])
        for f in names if len(names) > 2 else names[:1]:
            if len(names) > 1:
                model["family"][f] = svm(x, np.where(family == f, 1, -1))
        for f in names:
            for a, b in combinations(model["families"][f], 2):
                rows = (lang == a) | (lang == b)
                model["pair"][a, b] = svm(x[rows], np.where(lang[rows] == a, 1, -1))
        return pd.DataFrame({"model": [pickle.dumps(model)]})

    return run


def fit(labelled: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, families: dict[str, list[str]] | None = None) -> dict | None:
    """The machines, from labelled(doc_id, text, lang); None without a labelled row.

    The sample is bounded: of each language up to `sample` whole documents, those of least hash, and `sample_bytes`
    bytes in all; rows with a null text or lang are left out."""
    of = {lang: name for name, langs in (families or FAMILIES).items() for lang in langs}
    rows = labelled.where("text is not null and lang is not null").select("lang", "text", row_hash("doc_id", "text").alias("rank"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    # a cut of the hash that leaves some more than the sample, then the exact one
    bound = None
    for lang, n in counts.items():
        share = min(1.0, 1.3 * sample / n + 60 / n)
        cut = F.col("lang") == lang
        if share < 1:
            cut &= F.col("rank") < int(-(2**63) + share * 2**64)
        bound = cut if bound is None else bound | cut
    w = Window.partitionBy("lang").orderBy("rank", "text")
    rows = rows.where(bound).withColumn("row", F.row_number().over(w)).withColumn("bytes", F.sum(F.octet_length("text").cast("long")).over(w))
    rows = rows.where((F.col("row") <= sample) & ((F.col("bytes") <= sample_bytes) | (F.col("row") == 1)))
    model = materialize(rows.select("lang", "text", "rank", F.lit(0).alias("_one")).groupBy("_one").applyInPandas(_fit(of), "model binary"), "languages")
    return pickle.loads(model.first()[0])


def predict(docs: DataFrame, model: dict | None, keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score (0 to 1: the product of the chosen family's and language's shares) to docs(text, ...).

    `und` with score 0 where the text is null, empty or has no letter, or where nothing was learned. Ties go to the
    name that comes first. Columns of these names are replaced; other columns and repeated rows stay as they are."""
    columns = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score")]
    found = docs.select(*columns, "text") if "text" not in columns else docs.select(*columns)
    letters = free_name("_letter", found)
    found = found.withColumn(letters, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    schema = found.select(*columns).schema.add("lang_pred", "string").add("score", "double")

    def weights() -> tuple[list, np.ndarray]:
        names = [*(("family", k) for k in model["family"]), *(("pair", k) for k in model["pair"])]
        return names, np.stack([*(model["family"].values()), *(model["pair"].values())], axis=1) if names else np.zeros((BUCKETS + 1, 0), np.float32)

    def choose(scores: dict) -> tuple[str, float]:
        names = list(model["families"])
        if len(names) == 1:
            family, share = names[0], 1.0
        elif len(names) == 2:
            p = float(sigmoid(2 * scores["family", names[0]]))
            family, share = (names[0], p) if p >= 0.5 else (names[1], 1 - p)
        else:
            p = {f: float(sigmoid(2 * scores["family", f])) for f in names}
            family = max(names, key=p.get)
            share = p[family] / sum(p.values())
        langs = model["families"][family]
        if len(langs) == 1:
            return langs[0], share
        votes = dict.fromkeys(langs, 0.0)
        for a, b in combinations(langs, 2):
            p = float(sigmoid(2 * scores["pair", (a, b)]))
            votes[a] += p
            votes[b] += 1 - p
        best = max(langs, key=votes.get)
        return best, share * votes[best] / (len(langs) - 1)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, w = weights() if model else ([], None)
        for batch in batches:
            letter = batch.column(batch.schema.get_field_index(letters)).to_pylist()
            lang, score = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            for first, _end, data, offsets in chunks(batch) if model else ():
                for k, v in enumerate(text_vectors(data, offsets)):
                    if letter[first + k]:
                        lang[first + k], score[first + k] = choose(dict(zip(names, (v @ w[:-1] + w[-1]).tolist(), strict=True)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(lang), pa.array(score)], [*columns, "lang_pred", "score"])

    return found.mapInArrow(run, schema)


def filter_languages(docs: DataFrame, labelled: DataFrame | None = None, **options) -> DataFrame:
    """The documents whose text has a language, with lang set to the predicted one; `und` documents are rejected.
    Learns from `labelled`, the documents themselves if it isn't given. The columns stay those of docs,
    whatever their names."""
    # columns of docs that are named like those of the prediction go by other names meanwhile
    aside = {c: free_name(f"_own_{c}", docs) for c in docs.columns if c.lower() in ("lang_pred", "score")}
    found = predict(docs.withColumnsRenamed(aside), fit(docs if labelled is None else labelled, **options))
    kind = docs.schema["lang"].dataType
    found = found.where("lang_pred <> 'und'").withColumn("lang", F.col("lang_pred").cast(kind))
    return found.select(*(F.col(aside[c]).alias(c) if c in aside else c for c in docs.columns))
