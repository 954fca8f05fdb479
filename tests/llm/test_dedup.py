"""Near-duplicates and repeated passages against brute force, on texts with every awkward case."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from kindred.llm import capfilters, components, ngramjoin, shared, stars, substrings
from kindred.llm import textwords as tw

DOCS = "doc_id long, text string, lang string, rep string, n long"


def least(n, links):
    label = list(range(n))
    for _ in range(n):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = ["w%d" % i for i in range(60)] + ["é", "日本", "x y"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = text(120), text(30)
    out = [None, "", " \t\n", "one", "one", "two words", "a b c d e", "a b c d e", base, base, text(3000)]
    for k in range(12):  # near copies at all similarities
        parts = base.split(" ")
        for _ in range(k):
            parts[rng.randrange(len(parts))] = "new%d" % rng.randrange(999)
        out.append(" ".join(parts))
    out += [f"{text(25)} {passage}\n{text(25)}" for _ in range(6)] + [text(15) + "  " + " ".join(["go"] * 70), text(19), text(20)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "clash", 1) for i, t in enumerate(texts)], DOCS)


def shingle_sets(texts):
    split = [words(t) for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in split]


@pytest.mark.parametrize(("block", "few"), [(512, 2_000_000), (3, 0)])
def test_ngram_join(documents, texts, block, few, monkeypatch):
    monkeypatch.setattr(ngramjoin, "FEW", few)
    sets = shingle_sets(texts)
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    number = [sum(i in pair for pair in links) for i in range(len(sets))]
    label = least(len(sets), links)
    got = {r.doc_id: r for r in ngramjoin.near_duplicates(documents, block=block).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (number[i], label[i], label[i] == i), texts[i]


def test_ngram_join_odd_tables(spark, documents):
    assert ngramjoin.near_duplicates(documents.where("false")).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None)]
    got = ngramjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and sum(r.doc_id is None for r in got) == 2


def test_band_recall():
    assert (1 - 0.8**ngramjoin.ROWS) ** ngramjoin.BANDS < 1e-3


def removed(texts):
    seen, out = set(), []
    for text in texts:
        w, gone = words(text), set()
        for i in range(len(w) - 19):
            if tuple(w[i : i + 20]) in seen:
                gone.update(range(i, i + 20))
            seen.add(tuple(w[i : i + 20]))
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_substring_dedup(documents, texts, batches):
    done = substrings.without_repeats(documents, batches=batches)
    assert done.columns == [*documents.columns, "n_words", "n_removed"]
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in done.collect()}
    want = removed(texts)
    assert [got[i] for i in range(len(texts))] == want


def test_substring_dedup_odd_tables(spark, documents):
    assert substrings.digest(documents.where("false")).count() == 0
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(1, text), (1, text), (None, text), (7, text + " more")]
    got = substrings.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 0), (1, 0), (7, 30)]


def frames_of(spark, rows):
    frames = spark.createDataFrame(rows, "doc_id long, text string")
    return frames.select("doc_id", substrings.compressed(frames["text"]).alias("frame"))


def test_compaction_by_tiers(spark):
    log = substrings.FingerprintLog(spark, fan=2)
    frames = frames_of(spark, [(i, " ".join(f"a{i}b{k}" for k in range(25))) for i in range(15)])
    for low in range(0, 15, 3):
        log.matches(frames.where(f"doc_id >= {low} and doc_id < {low + 3}")).collect()
    log.compact()
    assert sorted(r.level for r in log.runs) == [0, 2] and log.read(log.runs).select("doc_id").distinct().count() == 15
    for run in log.runs:
        for part in spark.read.parquet(run.path).select("fp", F.input_file_name().alias("f")).toPandas().groupby("f"):
            assert part[1]["fp"].is_monotonic_increasing


def test_log_goes_on_in_another_session(spark, texts):
    """Two sessions, the second of which opens what the first left, give the rows of one run over all."""
    docs = frames_of(spark, [(i, t) for i, t in enumerate(texts)])
    cut = len(texts) // 2
    first = substrings.FingerprintLog(spark, fan=2)
    found = first.deduplicate(docs.where(f"doc_id < {cut}"), docs.where(f"doc_id < {cut}"), None).collect()
    other = spark.newSession()
    again = substrings.FingerprintLog(other, first.path, fan=2)
    assert again.runs == first.runs
    docs = frames_of(other, [(i, t) for i, t in enumerate(texts)])
    found += again.deduplicate(docs.where(f"doc_id >= {cut}"), docs, cut).collect()
    whole = substrings.FingerprintLog(spark)
    docs = frames_of(spark, [(i, t) for i, t in enumerate(texts)])
    once = whole.deduplicate(docs, docs, None).collect()
    assert sorted((r.doc_id, sorted(r.starts)) for r in found) == sorted((r.doc_id, sorted(r.starts)) for r in once)
    with pytest.raises(ValueError, match="windows of 20 words"):
        substrings.FingerprintLog(spark, first.path, window=30)


CLASHING = ["starts", "_key", "_frame", "_copy", "_kept", "n_words", "_row", "_first", "places", "score", "_score", "language", "_share", "_found", "row", "id", "key", "words", "rep", "node", "text_key", "copies"]


@pytest.mark.parametrize("run", [substrings.without_repeats, ngramjoin.without_near_duplicates])
def test_columns_that_clash(spark, run):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(1, text, *(["x"] * len(CLASHING))), (2, "other " + text + " more", *(["y"] * len(CLASHING))), (3, None, *([None] * len(CLASHING)))]
    frame = spark.createDataFrame(rows, f"doc_id long, text string, {', '.join(f'{c} string' for c in CLASHING)}")
    got = run(frame)
    assert [c for c in got.columns if c not in ("n_words", "n_removed")] == [c for c in frame.columns if c != "n_words"] or got.columns == frame.columns
    assert {r["starts"] for r in got.collect()} <= {"x", "y", None} and got.count() in (2, 3)


def test_repeated_ids_with_other_texts(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(1, one), (1, two), (2, one + " end"), (3, two), (1, one), (4, three)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in ngramjoin.without_near_duplicates(frame).collect()) == [(1, one), (1, two), (4, three)]
    got = sorted(tuple(r) for r in ngramjoin.near_duplicates(frame).collect())
    assert got == sorted([(1, 2, 1, True), (1, 1, 1, True), (2, 2, 1, False), (3, 1, 1, False), (1, 2, 1, True), (4, 0, 4, True)])
    vectors = spark.createDataFrame([(1, [1.0, 0.0, 0.0], 0), (1, [0.0, 1.0, 0.0], 0), (2, [1.0, 0.01, 0.0], 0)], "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(r) for r in capfilters.near_duplicates(vectors).collect()) == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False)]


def test_stars(spark):
    keys = {"k1": [1, 2, 3], "k2": [3, 4], "k3": [5], "k4": [1, 2], "k5": [6, 7], "k6": [7, 6]} | {f"c{i}": [i, i + 1] for i in range(20, 60)}
    pairs = {(a, b) for nodes in keys.values() for a in nodes for b in nodes}
    rows = [(k, n) for k, nodes in keys.items() for n in nodes]
    got = stars.stars(spark.createDataFrame(rows, "key string, node long")).collect()
    of = {}
    for r in got:
        of.setdefault(r.node, set()).add(r.leader)
    assert all(a == b or of[a] & of[b] for a, b in pairs) and 5 not in of and len(got) == len(set(got))
    assert all((r.node, r.leader) in pairs for r in got), "a star's nodes share a key with its leader, so chains don't grow"


def test_numbers_as_texts_that_sort(spark):
    numbers = [-(1 << 63), -70000, -1, 0, 1, 255, 1 << 40, (1 << 63) - 1]
    rows = spark.createDataFrame([(n,) for n in [*numbers, None]], "n long").select("n", shared.order_text(F.col("n")).alias("t"))
    got = rows.select("n", "t", shared.ordered_number(F.concat("t", F.lit("ab"))).alias("back")).orderBy("t").collect()
    assert [r.n for r in got] == [*numbers, None] and all(r.n == r.back for r in got)


def test_scratch_is_deleted(spark, documents):
    with shared.scratch(spark):
        before = [len(x) for x in shared._made(spark)]
        substrings.digest(documents).count()
        folders, tables = (list(x[n:]) for x, n in zip(shared._made(spark), before, strict=True))
        assert folders and tables and all(shared.exists(spark, x) for x in folders)
    assert not any(shared.exists(spark, x) for x in folders) and not any(spark.catalog.tableExists(x) for x in tables)


def test_settings_come_back(spark, documents):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), shared.small_batches(spark):
        assert spark.conf.get(key) == "1000"
        1 / 0  # noqa: B018
    substrings.without_repeats(documents.limit(3))
    assert spark.conf.get(key) == own


def test_no_local_folder_stands_in_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.shared_dir(Session())


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(0)
    grams = rng.integers(0, 50, 400).astype(np.uint64)
    grams[200:213] = grams[20:33]
    found = substrings.anchor_places(grams, 13)
    assert {p - 20 for p in found if 20 <= p < 33} & {p - 200 for p in found if 200 <= p < 213}


def test_rolling_hashes_do_not_depend_on_place():
    data, offs = tw.buffer_of(__import__("pyarrow").array(["a bc d", "x  a bc d", None, "é a bc d"]))
    starts, ends, word_offs = tw.word_spans(data, offs)
    hashes = tw.spans_hash(data, starts, ends, tw.BASES[0])
    parts = [hashes[a:b] for a, b in zip(word_offs[:-1], word_offs[1:], strict=True)]
    assert [len(p) for p in parts] == [3, 4, 0, 4]
    assert (parts[0] == parts[1][1:]).all() and (parts[0] == parts[3][1:]).all()


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(9, 9), (None, 3)]
    frame = spark.createDataFrame(links, "a long, b long")
    label = least(500, [x for x in links if None not in x])
    got = {r.node: r.component for r in components.components(frame, "a", "b").collect()}
    assert got == {i: label[i] for x in links if None not in x and x[0] != x[1] for i in x}
    assert components.components(frame.where("false"), "a", "b").count() == 0


@pytest.mark.parametrize("block", [512, 8])
def test_embedding_near_duplicates(spark, block):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(30, 16))
    vectors = [c + rng.normal(size=16) * s for c in centre for s in (0, 0.02, 0.08, 0.15)] + [centre[0] + rng.normal(size=16) * 0.05 for _ in range(40)]
    rows = [(i, [float(x) for x in v], i % 3 if i < 120 else 0) for i, v in enumerate(vectors)]
    n = len(rows)
    rows += [(n, rows[0][1], rows[0][2]), (n + 1, rows[0][1], None), (n + 2, None, 0), (n + 3, [0.0] * 16, 0), (n + 4, [float("nan")] * 16, 0), (n + 5, [1.0, None], 0), (n + 6, [], 0), (n + 7, [1.0, 2.0], 0), (n + 8, [2.0, 4.0], 0)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, key string")
    links = []
    fine = [i for i, v, lab in rows if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for a in fine:
        for b in fine:
            if b < a and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    links.append((a, b))
    label = least(len(rows), links)
    got = {r.vec_id: r for r in capfilters.near_duplicates(frame, block=block).collect()}
    assert len(links) > 100 and len(got) == len(rows)
    for i in range(len(rows)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (sum(i in x for x in links), label[i], label[i] == i), rows[i]
    assert capfilters.near_duplicates(frame.where("false")).count() == 0


def test_cap_filter_recall():
    rng = np.random.default_rng(7)
    u = rng.normal(size=(600, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.normal(size=u.shape)
    w -= (w * u).sum(1, keepdims=True) * u
    v = 0.98 * u + np.sqrt(1 - 0.98**2) * w / np.linalg.norm(w, axis=1, keepdims=True)
    for code in (32, 256):
        a, b = (capfilters.decoded(x, capfilters.TABLES, code, capfilters.WANTED) for x in (u, v))
        assert np.mean([len(np.intersect1d(x, y)) > 0 for x, y in zip(a, b, strict=True)]) >= 0.995
