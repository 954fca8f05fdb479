"""Search, classifiers, packing, extraction and encoding."""

from __future__ import annotations

import hashlib
import html
import os
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.llm import langid, maxscore, packing, pagediff, pieces, quality, toxicity
from kindred.llm.shared import remainder

EDGES = [None, "", " \n\t", "a", "12 345 !!", "é ñ ß 日本 ​ x", "a\x00b", "w " * 20000]


def edge_rows(spark, extra=()):
    rows = [(i, t, "en", 0.5, 1) for i, t in enumerate([*EDGES, *extra])] + [(None, "null id", None, None, None), (3, "a", "en", 0.5, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, predicted int")


# search


def brute(rows, every, k):
    q = {i: np.floor(256 * np.array(v)).astype(np.int64) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for a in (i for i in q if i % every == 0):
        order = sorted((-int(q[a] @ q[b]), b) for b in q if b != a and len(q[b]) == len(q[a]))[:k]
        out |= {(a, n + 1, b, -s) for n, (s, b) in enumerate(order)}
    return out


@pytest.mark.parametrize("shard", [8192, 16])
def test_maxscore(spark, shard):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=12), 1)]) for i in range(140)]
    rows += [(150, rows[0][1]), (151, rows[0][1]), (200, None), (201, [float("nan")] * 12), (202, [1.0, None]), (203, []), (250, [0.5, 0.25]), (251, [0.25, 0.5]), (300, [-1.0] * 12)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in maxscore.top_scores(frame, every=10, shard=shard).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute(rows, 10, 5)
    assert maxscore.top_scores(frame.where("false")).count() == 0
    assert maxscore.top_scores(frame.where("vec_id = 0")).count() == 0


@pytest.mark.parametrize("kind", ["sparse", "dense", "equal", "huge"])
def test_maxscore_shard_prunes_nothing_that_counts(kind):
    rng = np.random.default_rng(8)
    for trial in range(40):
        n = int(rng.integers(1, 300))
        rows = rng.integers(-9, 10, size=(n, 7))
        if kind == "sparse":
            rows *= rng.random((n, 7)) < 0.4
        elif kind == "equal":
            rows = np.repeat(rows[:1], n, axis=0)
        elif kind == "huge":
            rows = rows * 2**24 + rng.integers(0, 9, size=(n, 7))
        shard, query = maxscore.Shard(np.arange(n), rows.astype(np.int64)), rng.integers(-9, 10, 7)
        ids, scores = shard.top(query, trial, 4)
        want = sorted((-int(rows[i] @ query), i) for i in range(n) if i != trial)[:4]
        assert [(-s, i) for i, s in zip(ids, scores, strict=True)] == want


def test_maxscore_touches_few_postings():
    """Vectors whose weight lies in few components, in groups of near copies; rows of the same kind without any."""
    rng = np.random.default_rng(9)
    for copies, most in ((8, 0.25), (1, 0.6)):
        centre = rng.normal(size=(4096 // copies, 64)) * rng.permuted(np.tile(0.85 ** np.arange(64), (4096 // copies, 1)), axis=1)
        rows = np.repeat(centre, copies, axis=0) + rng.normal(size=(4096, 64)) * 0.01
        rows = np.floor(256 * rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.int64)
        shard = maxscore.Shard(np.arange(4096), rows)
        for i in range(0, 4096, 128):
            _, scores = shard.top(rows[i], i, 5)
            assert list(scores) == sorted(np.delete(rows @ rows[i], i))[::-1][:5]
        print(f"{copies} copies: {shard.touched / shard.full:.2f} of all postings touched")
        assert shard.touched < most * shard.full


# classifiers


def test_folds(spark):
    got = spark.range(200).select("id", remainder("id", 5).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 5 for r in got)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    speak = {"aa": "the of and to with from", "bb": "der die und nicht mit für", "cc": "que los de una por año"}
    rows, labels = [], []
    for i in range(400):
        lang = rng.choice(list(speak))
        text = " ".join(rng.choice(speak[lang].split()) for _ in range(rng.randrange(20, 60)))
        toxic, good = rng.random() < 0.3, rng.random() < 0.7
        if toxic:
            text += " you utter IDIOT!"
        if not good:
            text = text.upper().replace(" ", "!! ")
        rows.append((i, text, lang))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(corpus):
    documents, labels = corpus
    got = toxicity.toxicity(documents, labels).join(labels, "doc_id").toPandas()
    held = got[got["held_out"]]
    assert len(held) > 40 and (held["predicted"] == held["toxic"]).mean() >= 0.97 and got["score"].between(0, 1).all()


def test_toxicity_reads_no_held_out_label(spark, corpus):
    documents, labels = corpus
    other = labels.withColumn("toxic", F.when(remainder("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first, second = (toxicity.fit(documents, x) for x in (labels, other))
    assert (first.buckets == second.buckets).all() and (first.weights == second.weights).all()


def test_quality(corpus):
    documents, labels = corpus
    got = quality.quality(documents, labels).join(labels.withColumnRenamed("quality", "good"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert len(held) > 40 and (held["predicted"] == held["good"]).mean() >= 0.97 and got["score"].between(0, 1).all()


@pytest.mark.parametrize("module", [toxicity, quality])
def test_capped_classes_decide_like_all(spark, module):
    """One mark says little of the rarer class, so only a model of the wrong class shares decides by it."""
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(1600):
        marked = rng.random() < 0.3
        rare = rng.random() < (0.2 if marked else 0.02)
        rows.append((i, "THE OF AND mark" if marked else "the of and to"))
        labels.append((i, int(not rare), int(rare)))
    documents, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    run = getattr(module, module.__name__.split(".")[-1])
    whole, capped = (run(documents, labels, per_class=n).agg(F.avg("predicted")).first()[0] for n in (6000, 60))
    assert abs(whole - capped) <= 0.05


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(0)
    x = rng.random((500, 5)).astype(np.float32)
    y = (x[:, 0] + (x[:, 1] > 0.5) > 0.9).astype(float)
    model = quality.train(x, y, trees=6)
    for row in x[:20]:
        total = model.bias
        for t in range(6):
            node = 0
            while node < model.feature.shape[1]:
                node = 2 * node + 1 + int(row[model.feature[t, node]] > model.threshold[t, node])
            total += model.value[t, node - model.feature.shape[1]]
        assert np.isclose(model.scores(row[None])[0], 1 / (1 + np.exp(-total)))
    assert ((model.scores(x) > 0.5) == (y > 0)).mean() > 0.9


def test_languages(corpus):
    documents, _ = corpus
    got = langid.languages(documents).join(documents.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() >= 0.95 and got["score"].between(0, 1).all()


def test_recurrent_gradients():
    rng = np.random.default_rng(0)
    w = langid.initial(3, rng)
    seg, target = rng.integers(97, 105, (7, 5)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    _, g = langid.gradients(seg, target, w)
    for name, at in (("xzf", (99, 2)), ("hnf", (1, 2)), ("hrb", (3, 4)), ("ob", (2, 1)), ("bias", (1,))):
        up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
        up[name][at] += 0.01
        down[name][at] -= 0.01
        slope = (langid.gradients(seg, target, up)[0] - langid.gradients(seg, target, down)[0]) / 0.02
        assert abs(slope - g[name][at]) < 2e-4


def test_every_byte_is_labelled():
    rng = np.random.default_rng(1)
    model = langid.Model(["a", "b"], langid.initial(2, rng))
    texts = [b"x" * 96, b"abc" * 77, b"", b"q"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = langid.pooled(data, offs, model)
    for text, p in zip(texts, got, strict=True):
        total = np.zeros(2)
        for at in range(0, len(text), langid.SEGMENT):
            seg = np.frombuffer(text[at : at + langid.SEGMENT], np.uint8)[:, None]
            states = [langid.run(seg, model.weights, way) for way in "fb"]
            logits = states[0][:, 0] @ model.weights["of"] + states[1][:, 0] @ model.weights["ob"] + model.weights["bias"]
            total += (np.exp(logits) / np.exp(logits).sum(1, keepdims=True)).sum(0)
        assert np.allclose(p, total / len(text) if text else 0.5, atol=1e-4)


def test_classifiers_on_odd_tables(spark, corpus):
    documents, labels = corpus
    odd = edge_rows(spark)
    for run in (toxicity.toxicity, quality.quality):
        got = run(documents.select("doc_id", "text").union(odd.select((F.col("doc_id") + 1000).alias("doc_id"), "text")), labels).where("doc_id is null or doc_id >= 1000").collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
        assert run(odd, labels.where("false")).count() == odd.count()
        assert run(odd.where("false"), labels).count() == 0
    got = {r.doc_id: r for r in langid.languages(odd).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2, 4))
    assert got[3].lang_pred == "en" and langid.languages(odd.where("false")).count() == 0
    assert all(r.lang_pred == "und" for r in langid.languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect())


# packing


def test_packing(spark):
    rng = random.Random(3)
    extra = [" ".join(rng.choice(["alpha", "beta's", "GAMMA", "x9", "日本"]) for _ in range(rng.randrange(1, 900))) for _ in range(60)]
    odd = edge_rows(spark, extra)
    got = packing.packed(odd).toPandas()
    encoder = packing.WordEncoder(packing.tokenizer_path()).tokenizer
    want = []
    for r in odd.collect():
        ids = np.array([*encoder.encode(r.text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want += [(r.doc_id, k, k * 4096, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(np.split(ids, range(4096, len(ids), 4096)))]
    key = lambda x: (x[0] if x[0] is not None else -1, *x[1:])
    rows = [(None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()]
    assert sorted(rows, key=key) == sorted(want, key=key)
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert list(part["offset"]) == [0, *np.cumsum(part["length"])[:-1]] and part["length"].sum() <= 4096
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 4096) + 1
    assert packing.packed(odd.where("false")).count() == 0


def test_compositions_use_every_piece_once():
    rng = np.random.default_rng(5)
    for size in (16, 100):
        counts = np.concatenate([[0], rng.integers(0, 50, size)])
        used = np.zeros(size + 1, np.int64)
        for times, lengths in packing.compose(counts, size):
            assert sum(lengths) <= size and times > 0
            np.add.at(used, lengths, times)
        assert (used == counts).all()
        sequences = sum(t for t, _ in packing.compose(counts, size))
        assert sequences <= 1.05 * -(-(counts * np.arange(size + 1)).sum() // size) + 1


# extraction


PAGE = '<html><head><title>T</title><script>var t="</p>";</script></head><body class="has-sidebar"><header>Top</header><nav><ul><li>One</ul></nav><div class="ad">Buy</div><article><h1>Head &amp; tail</h1><p><b>Bold &eacute;&#33;<br><p>A  b\n c &lt;p&gt; <a title="x>y">l</a></p><aside>S</aside><div id="comments">C</div><form>F</form><p>end</article><footer>F</footer>'


def test_declared_article():
    texts = [t for t, kind in pagediff.lines_of(PAGE) if kind == pagediff.ARTICLE]
    assert texts == ["Head & tail", "Bold é!", "A b c <p> l", "end"]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article class="post category-social tag-advertising"><p>A</p></article>', ["A"]),
        ('<article id="legal-notice-2024"><p>A</p></article>', ["A"]),
        ('<main class="social"><article class="social"><p>A</p></article></main>', ["A"]),
        ('<article><h2 id="social-structure">A</h2><section id="related-work"><p id="notice">B</p></section><h3 id="share">C</h3></article>', ["A", "B", "C"]),
        ('<article><p class="topic-legal">A</p><div class="big ad">X</div><div class="social-share">X</div><article class="comment">X</article><article>B</article></article>', ["A", "B"]),
        ('<div class="comments"><article class="comment">X</article></div><article hidden>X</article><div role="article" class="related">A</div>', ["A"]),
    ],
)
def test_names_of_elements_cut_no_article(page, want):
    assert [t for t, kind in pagediff.lines_of(page) if kind == pagediff.ARTICLE] == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        # a page inside one form, and regions of the site that have no end
        ('<form id="aspnetForm"><nav>X</nav><aside><article>X</article></aside><div id="content"><article><p>A</p></article></div><p>X</p></form>', ["A"]),
        ('<form class="search">X</form><form class="comment-form"><p>X</p></form><article>A<form>X</form>B</article>', ["A", "B"]),
        ("<aside>X<article><p>A</p></article>", ["A"]),
        ('<div class="menu"><ul><li>X<main><p>A</p></main>', ["A"]),
        ("<aside><article>X</article></aside><article>A</article>", ["A"]),
        ('<div class="menu"><article>X</article></div><article>A</article>', ["A"]),
        ('<article><p>A</p><table class="menu"><tr><td>B</td></tr></table><p>C</p></article>', ["A", "B", "C"]),
        ('<div class="content sidebar-right"><article>A</article></div>', ["A"]),
        # regions with names of several words inside the article
        *((f'<article><p>A</p><div class="{name}"><p>X</p></div><p>B</p></article>', ["A", "B"]) for name in ("comments-area", "comment-list", "post-comments", "share-buttons", "related-posts", "ad-slot", "site-footer", "sidebar-left")),
        *((f'<article><p>A</p><div class="{name}"><p>B</p></div></article>', ["A", "B"]) for name in ("share-price", "menu-of-the-day", "advertising-law", "main-content", "post-body", "related-work-summary")),
        # comments as articles, and a banner in the main part
        ('<article><p>A</p></article><article class="comment">X</article><article class="comment-list-item reply">X</article>', ["A"]),
        ("<main><header><p>X</p></header><article><header><h1>A</h1></header><p>B</p></article></main>", ["A", "B"]),
        ("<main><header><h1>A</h1></header><p>B</p></main>", ["A", "B"]),
    ],
)
def test_regions_of_ordinary_pages(page, want):
    assert [t for t, kind in pagediff.lines_of(page) if kind == pagediff.ARTICLE] == want


@pytest.mark.parametrize(
    ("inside", "want"),
    [
        ('<p>A <svg class="i"/>b</p><p>C</p>', ["A b", "C"]),
        ("<p>A <math/>b</p><p>C <math><mi>x</mi></math> d</p>", ["A b", "C x d"]),
        ('<p>A <svg><title/><style/><text>X</text></svg> b</p><p>C <svg><path d="M0"/></svg></p>', ["A b", "C"]),
        ("<p>A <svg><path><p>B</p><div><svg></div>C", ["A", "B", "C"]),
        ("<p>A <button>X</button>b <canvas>X</canvas>c</p>D", ["A b c", "D"]),
        ("<div><button>X</div>A<div><select><option>X<option>X</div><p>B", ["A", "B"]),
        ("<select><option>X</option><p>A</p>", ["A"]),
        ("<button><div>X</div><p>A</p>", ["A"]),
        ("<p>A <object data='x'>b</object> c</p>", ["A b c"]),
        ("<title-bar>A</title-bar><button-group>b</button-group><svg-icon></svg-icon><p>C</p>", ["Ab", "C"]),
        ("<p>A<script>X</script><style >X</style ><template><p>X</p></template><iframe src=x>X</iframe>b</p><textarea>X</textarea>", ["A b"]),
    ],
)
def test_elements_end_where_they_end(inside, want):
    assert [t for t, kind in pagediff.lines_of(f"<article>{inside}</article>") if kind == pagediff.ARTICLE] == want
    assert [t for t, kind in pagediff.lines_of(f"<body>{inside}</body>") if kind == pagediff.PLAIN] == want


def test_longest_common_subsequence():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(10))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        used = pagediff.common(a, b)
        rest = iter(b)
        assert used.sum() == best[-1][-1] and all(x in rest for x, u in zip(a, used, strict=True) if u)


def test_long_alignments():
    """Repeated lines: thousands of matches a line, in time and memory that stay small."""
    began = time.perf_counter()
    a, b = [i % 2 for i in range(3000)], [i // 2 % 2 for i in range(3000)]
    assert pagediff.common(a, b).sum() == pagediff.prefix_lengths(a, b)[-1] >= 1990
    assert pagediff.common([1, *range(2, 40_000)], [*range(40_000, 2, -1)]).sum() == 1
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize(
    "page",
    ["<a " * 20_000, "<div>" * 20_000, '<a "' * 8000, '"' * 1_000_000, "<a '" + '"<b "' * 30_000, "<!--" * 20_000, "<!" * 30_000, "<title" * 20_000, "<title>" * 20_000, "<script " * 20_000, "<p a" + "a" * 60_000 + ">", "<p " + "a =" * 20_000 + ">", "<p>" * 30_000, "<li><p>" * 20_000, "<svg>" * 20_000 + "<p>" * 20_000, "<article>" * 20_000, "</p>" * 30_000, "&" * 100_000, "<button><div>" * 10_000],
    ids=lambda x: x[:12],
)
def test_malformed_pages_take_linear_time(page):
    began = time.perf_counter()
    pagediff.lines_of(page)
    assert time.perf_counter() - began < 1


def nearest_by_hand(pages):
    """Texts of pages that declare no article, from the plainest form of the rule: sort, take neighbours, align by a table."""

    def lcs(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        return best[0][0]

    hosts = {}
    for url, lines in pages:
        host, path = url.removeprefix("http://").split("/", 1)
        if lines:
            known = hosts.setdefault(host, {})
            known[tuple(lines)] = min(known.get(tuple(lines), "~"), "/" + path)
    out = []
    for url, lines in pages:
        host, path = url.removeprefix("http://").split("/", 1)
        order = sorted((p, hashlib.md5(np.array([pagediff.hashed(x) for x in t], "<i8").tobytes()).hexdigest(), t) for t, p in hosts[host].items()) if lines else []
        here = next((i for i, x in enumerate(order) if x[2] == tuple(lines)), 0)
        near = [order[i] for i in (here - 1, here + 1) if 0 <= i < len(order)]
        start = lambda x: len(os.path.commonprefix([x[0], "/" + path]))  # noqa: E731, B023
        out.append((len(lines) - lcs(lines, max(near, key=start)[2])) if near else len(lines))
    return out


def test_differencing_equals_a_plain_form(spark):
    """How many lines stay; which of equal ones go is open."""
    rng = random.Random(12)
    pages = []
    for i in range(160):
        host, words = rng.choice(["a.example", "b.example", "c.example"]), [f"w{rng.randrange(14)}" for _ in range(rng.randrange(9))]
        pages.append((f"http://{host}/{rng.choice(['x', 'xy', 'z'])}/{i}", words))
    pages += [(pages[3][0] + "copy", pages[3][1]), ("http://d.example/1", ["alone"])]
    frame = spark.createDataFrame([(i, url, "".join(f"<div>{x}</div>" for x in lines)) for i, (url, lines) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: len(r.text.split("\n\n")) if r.text else 0 for r in pagediff.main_text(frame).collect()}
    assert [got[i] for i in range(len(pages))] == nearest_by_hand(pages)


def test_pages(spark):
    plain = lambda k: f"<body><div>Menu</div><div>Site</div><p>Story {k} begins</p><p>and {html.escape('<goes>')} on {k}</p><div>Foot</div></body>"
    rows = [(i, f"http://h.example/a/{i}", plain(i)) for i in range(12)] + [(20, "http://other.example/x", plain(20)), (21, None, None), (22, "http://h.example/a/1", ""), (23, "::", PAGE), (24, "http://h.example/a/3", plain(3))]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, n_chars long")
    got = {r.page_id: r for r in pagediff.main_text(frame).collect()}
    assert len(got) == len(rows)
    for i in range(12):
        assert got[i].text == f"Story {i} begins\n\nand <goes> on {i}" and got[i].n_chars == len(got[i].text)
    assert got[20].text.startswith("Menu\n\nSite") and got[21].text == "" and got[22].text == "" and got[23].text.startswith("Head")
    assert pagediff.main_text(frame.where("false")).count() == 0


# pieces


def test_transducer_equals_the_library():
    from sentencepiece import SentencePieceProcessor

    machine, model = pieces.Transducer(pieces.model_path()), SentencePieceProcessor(model_file=pieces.model_path())
    rng = random.Random(4)
    odd = ["a  b", " a", "\tx\n y", "ﬁ Å ①", "a▁b", "", " ", "     ", "日本é🙂 \t z", "a" * 50, "<0x41> <s> </s> <unk>", "▁▁▁▁▁\t▁", "\n" * 9, " " * 37]
    odd += ["".join(rng.choice("aetin  oshrTHE.,é日\n'12▁") for _ in range(rng.randrange(60))) for _ in range(800)]
    for text in odd:
        ids = machine.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(text), text
        assert machine.decode(ids) == text.replace("▁", " ")


def test_arcs_are_compiled_from_the_merges_of_pieces(monkeypatch):
    machine, rng, asked = pieces.Transducer(pieces.model_path()), random.Random(5), []
    texts = ["".join(rng.choice("aetinoshr") for _ in range(rng.randrange(1, 20))) for _ in range(400)]
    merged = machine.merged
    monkeypatch.setattr(machine, "merged", lambda text, *log: asked.append(text) or merged(text, *log))
    for text in texts:
        machine.encode(text)
    assert len(asked) == len(set(asked)) and set(asked) <= set(machine.pieces)
    pairs = [(p, q) for p, arcs in machine.arcs.items() for q in arcs]
    assert len(pairs) > len(asked)
    for p, q in pairs:
        names = [machine.names[p], machine.names[q]]
        assert machine.arcs[p][q] == (merged("".join(names)) == names), names


def test_round_trip(spark):
    odd = edge_rows(spark)
    got = pieces.round_trip(odd).collect()
    assert len(got) == odd.count()
    assert all(r.n_ids == 0 and r.n_chars == 0 for r in got if r.doc_id in (0, 1))
    lengths = {i: len(t or "") for i, t in enumerate(EDGES)}
    assert all(r.n_chars == lengths[r.doc_id] for r in got if r.doc_id is not None)
    assert pieces.round_trip(odd.where("false")).count() == 0


def test_decoding_of_broken_bytes():
    machine = pieces.Transducer(pieces.model_path())
    assert machine.decode(np.array([machine.bytes[0xE6]], "<u4").tobytes()) == "�"


def test_arrow_slices_keep_long_rows_whole():
    from kindred.llm import textwords as tw

    column = pa.array(["a", "b" * 50, None, "c"]).slice(1)
    assert [(a, b, data.tobytes()) for a, b, data, _ in tw.slices(column, 10)] == [(0, 1, b"b" * 50), (1, 3, b"c")]
