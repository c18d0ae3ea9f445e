"""The corpus pipeline on a small folder with planted cases."""

import numpy as np
import pytest


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    letters = {"en": "aeiothsnrd", "de": "aeiunßöüch"}
    words = {lang: ["".join(rng.choice(list(x), int(rng.integers(3, 8)))) for _ in range(900)] for lang, x in letters.items()}
    rows = [[k, " ".join(rng.choice(words["en" if k % 2 else "de"], 60)), "en" if k % 2 else "de"] for k in range(60)]
    benchmark = [(k, " ".join(rng.choice(words["en"], 20))) for k in range(5)]
    changed = rows[3][1].split()
    changed[50] = "replaced"
    rows += [[60, rows[1][1], "en"], [61, " ".join(changed), "en"], [62, None, "en"], [63, "", None], [64, "12 !!", "en"]]
    rows += [[65 + k, " ".join(rng.choice(words["en"], 30)) + " " + t + " " + " ".join(rng.choice(words["en"], 30)), "en"] for k, t in benchmark]
    rows[10][1] += " write to Mrs Anna Smith at anna.smith@mail.example.com"
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, {i: t for i, t, _ in rows}


def test_stages(spark, folder):
    """Each stage on what its predecessor kept, written and read again as on a cluster."""
    import corpus_pipeline

    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if k < 4:
            assert out.columns == columns
            out.write.parquet(f"{path}/stage{k}")
            docs = spark.read.schema(out.schema).parquet(f"{path}/stage{k}")
            kept[name] = {r.doc_id: r for r in docs.collect()}
    languages, one, clean, private = kept.values()
    assert set(languages) == set(texts) - {62, 63, 64}
    assert sum(r.lang == ("en" if i % 2 or i >= 60 else "de") for i, r in languages.items()) >= 0.97 * len(languages)
    assert set(one) == set(languages) - {60, 61}
    assert set(clean) == set(one) - {65, 66, 67, 68, 69}
    assert set(private) == set(clean)
    assert all(r.text == texts[i] and r.n_chars == len(r.text) for i, r in private.items() if i != 10)
    new = private[10].text
    assert "Smith" not in new and "anna" not in new and new.startswith(texts[10][:300]) and private[10].n_chars == len(new)
    pieces = out.collect()
    assert {r.doc_id for r in pieces} == set(private)
    used = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 2048


def test_run_on_empty_tables(spark, folder, tmp_path):
    import corpus_pipeline

    path, _ = folder
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
