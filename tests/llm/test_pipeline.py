"""The pipeline's stages on a small table: columns, decisions, and what each leaves."""

from __future__ import annotations

import re

import pytest

import corpus_pipeline as pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    speak = ["the of and to with from", "der die und nicht mit für"]
    rows, labels = [], []
    for i in range(120):
        words = speak[i % 2].split()
        text = " ".join(words[(i * 7 + k * k + k // 3 * i) % len(words)] for k in range(60)) + f" number {i}"
        if i % 4 == 1:
            text += " you IDIOT scum"
        rows.append((i, text, "en" if i % 2 == 0 else "de", "s", len(text)))
        labels.append((i, 1, int(i % 4 == 1)))
    rows += [(200, rows[0][1], "en", "s", 1), (201, "1234 5678", "en", "s", 9), (202, None, None, None, None), (203, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, folder).cache()
        if name != "best_fit_packing":
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
            docs = out
        left[name] = {r.doc_id for r in out.select("doc_id").collect()}
    assert not any(i % 4 == 1 for i in left["toxicity"] if i < 200) and left["toxicity"] >= {i for i in range(120) if i % 4 != 1}
    assert left["language_id"] == left["toxicity"] - {201, 202, 203}
    assert 0 in left["ngram_jaccard_join"] and 200 not in left["ngram_jaccard_join"]
    assert left["substring_dedup"] == left["ngram_jaccard_join"] == left["best_fit_packing"]


def test_run(spark, folder):
    got = pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() >= 1


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def without_near_by_hand(docs):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set() for i, t in docs.items()}
    group = {i: i for i in docs}
    for _ in docs:
        for a in docs:
            for b in docs:
                if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                    group[a] = group[b] = min(group[a], group[b])
    return {i: t for i, t in docs.items() if group[i] == i}


def without_passages_by_hand(docs):
    seen, out = set(), {}
    for i in sorted(docs):
        w, gone = words(docs[i]), set()
        for k in range(len(w) - 19):
            if tuple(w[k : k + 20]) in seen:
                gone.update(range(k, k + 20))
            seen.add(tuple(w[k : k + 20]))
        out[i] = " ".join(x for k, x in enumerate(w) if k not in gone)
    return out


def test_stages_against_plain_forms(spark, folder):
    """Two stages have a plain form; each is held to it on its own input, after the trained stages have decided."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    stages = dict(pipeline.STAGES)
    kept = stages["language_id"](spark, stages["toxicity"](spark, docs, folder), folder).where("doc_id < 45 or doc_id >= 200").cache()
    single = stages["ngram_jaccard_join"](spark, kept, folder).cache()
    assert texts(single) == without_near_by_hand(texts(kept)) and single.count() < kept.count()
    left = stages["substring_dedup"](spark, single, folder)
    assert texts(left) == without_passages_by_hand(texts(single))
    assert all(r.n_chars == len(r.text) for r in left.collect())


@pytest.mark.parametrize("extra", [False, True])
def test_empty_tables_and_clashing_columns(spark, folder, extra):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 9" if extra else "false")
    if extra:
        for name in ("score", "_score", "language", "_share", "starts", "_key", "n_words", "row"):
            docs = docs.selectExpr("*", f"'kept' as `{name}`")
    kinds = docs.dtypes
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.dtypes == kinds and (extra or docs.count() == 0), name
    if extra:
        assert "row" in docs.columns and {r["_score"] for r in docs.collect()} == {"kept"}
    assert pipeline.STAGES[-1][1](spark, docs, folder).columns[0] == "doc_id"
