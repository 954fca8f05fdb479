"""Small inputs with answers worked out by hand, and properties that must hold."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import vectors as vec
from kindred.operators import aggregate, annotate, encoder, flows, inverted, matrix, neighbours, ontology, quantiles, search, summarize, training
from kindred.operators import quality_control as qc
from kindred.sources import obo, tables
from kindred.streaming import events


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


DAG = [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "E")]


@pytest.fixture(scope="module")
def dag(spark):
    edges = frame(spark, DAG, "parent string, child string")
    return edges, ontology.closure(edges), frame(spark, [(x,) for x in "ABCDE"], "node string")


def pairs(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_lognorm(spark):
    counts = frame(spark, [(1, 0, 1.0), (1, 1, 3.0), (2, 0, 0.0), (2, 1, 0.0)], "cell_id long, gene_idx int, value double")
    got = [r.x for r in matrix.lognorm(counts).orderBy("cell_id", "gene_idx").collect()]
    assert np.allclose(got, [7.82444593, 8.92279162, 0, 0])


def test_pack_round_trip(spark):
    counts = frame(spark, [(1, 2, 1.0), (1, 0, 3.0), (1, 2, 2.0), (2, 1, 4.0)], "cell_id long, gene_idx int, value double")
    assert pairs(matrix.unpack(matrix.pack(counts)), "cell_id", "gene_idx", "value") == {(1, 0, 3.0), (1, 2, 3.0), (2, 1, 4.0)}


def test_align_guards(spark):
    counts = frame(spark, [(1, "a", 1.0), (1, "x", 5.0)], "cell_id long, symbol string, value double")
    target = frame(spark, [(0, "b"), (1, "a")], "gene_idx int, symbol string")
    assert pairs(matrix.align(counts, target), "cell_id", "gene_idx", "value") == {(1, 1, 1.0)}
    with pytest.raises(ValueError):
        matrix.align(counts, target, least_overlap=2)
    with pytest.raises(Exception, match="negative"):
        matrix.align(counts.withColumn("value", -F.col("value")), target).collect()


def test_centroid_is_a_ratio_of_sums(spark):
    counts = frame(spark, [(1, 0, 1.0), (1, 1, 3.0), (2, 0, 2.0), (2, 2, 4.0)], "cell_id long, gene_idx int, value double")
    got = [r.x for r in aggregate.centroid(counts).orderBy("gene_idx").collect()]
    assert np.allclose(got, [8.00670085, 8.00670085, 8.29429961])


def test_null_clusters(spark):
    counts = frame(spark, [(1, 0, 1.0), (2, 0, 2.0)], "cell_id long, gene_idx int, value double")
    clusters = frame(spark, [(1, "a"), (2, None)], "cell_id long, cluster string")
    assert {r.cluster for r in aggregate.cluster_centroids(counts, clusters).collect()} == {"a"}
    assert {r.cluster for r in aggregate.cluster_centroids(counts, clusters, skip_null=False).collect()} == {"a", "nan"}


def test_mito_boundaries(spark):
    metrics = frame(spark, [(1, 100.0, 5, 30.0)], "cell_id long, total_counts double, n_genes long, pct_mt double")
    assert qc.filter_cells(metrics, 1, 30.0).count() == 0
    assert qc.qc_pass(metrics, 30.0).count() == 1
    assert qc.qc_pass(metrics.withColumn("nn_dist", F.lit(0.04))).count() == 0


HITS = [(0, 1, 0.0, "M"), (0, 2, 0.1, "T"), (0, 3, 0.2, "B"), (0, 4, 0.4, "T"), (0, 5, 0.5, "B")]


def test_votes(spark):
    hits = frame(spark, HITS, "query_id long, rank int, dist double, label string")
    got = annotate.predictions(hits).first()
    assert (got.prediction, got.hits, got.vs2nd, got.vs_all, got.min_dist, got.max_dist) == ("T", {"M": 1, "T": 2, "B": 2}, 0.5, 0.4, 0.0, 0.5)
    got = annotate.predictions(hits, weighting=True).first()
    assert got.prediction == "M"
    assert np.allclose([got.weighted_vs2nd, got.weighted_vs_all], [0.9999875002, 0.9999805004])


def test_lists_exclude_each_other(spark):
    rows = frame(spark, [(1, "a"), (2, None)], "id long, label string")
    assert annotate.allowed(rows, blocklist=["a"]).count() == 1
    with pytest.raises(ValueError):
        annotate.allowed(rows, ["a"], ["b"])


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    rows = frame(spark, [(i, [float(y) for y in v]) for i, v in enumerate(x)] + [(998, None), (999, [0.0] * 8)], "id long, vector array<double>")
    asked = rows.withColumnRenamed("id", "query_id")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    dist = 1 - unit @ unit.T
    got = {(r.query_id, r["rank"]): r.id for r in neighbours.nearest(asked, rows, 5).collect()}
    assert len(got) == 1500
    for i in range(300):
        assert [got[i, k + 1] for k in range(5)] == list(np.argsort(dist[i], kind="stable")[:5])
    inside = neighbours.within(asked, rows, 0.5)
    assert inside.count() == int((dist <= 0.5).sum())


def test_self_distance(spark):
    row = frame(spark, [([0.3, 0.4],)], "v array<float>").select(vec.cosine_distance("v", "v").alias("d")).first()
    assert abs(row.d) < 1e-6


def test_index_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = frame(spark, [(i, [float(y) for y in v]) for i, v in enumerate(rng.normal(size=(200, 6)))], "id long, vector array<double>")
    built = inverted.InvertedFile.build(rows, 4)
    built.write(str(tmp_path))
    index, asked = inverted.InvertedFile.read(spark, str(tmp_path)), rows.withColumnRenamed("id", "query_id")
    assert pairs(index.nearest(asked, 3, probes=4), "query_id", "rank", "id") == pairs(neighbours.nearest(asked, rows, 3), "query_id", "rank", "id")


def test_distance_sums(spark):
    rng = np.random.default_rng(2)
    x, label = rng.normal(size=(40, 5)), np.arange(40) % 3
    odd = [(900, 0, [1.0]), (901, 1, None), (902, None, [1.0] * 5), (903, 2, [])]
    rows = frame(spark, [*((i, int(label[i]), [float(y) for y in v]) for i, v in enumerate(x)), *odd], "id long, label int, vector array<double>")
    assert neighbours.distance_sums(rows.where("false")).count() == 0
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for squared, dist in ((False, 1 - unit @ unit.T), (True, ((x[:, None] - x[None]) ** 2).sum(2))):
        for r in neighbours.distance_sums(rows, squared).collect():
            others = (label == r.other) & (np.arange(40) != r.id)
            assert np.isclose(r.total, dist[r.id][others].sum()) and r.n == others.sum()


def test_dag(spark, dag):
    edges, up, nodes = dag
    of = lambda name: frame(spark, [(name,)], "node string")
    assert {a for _, a in pairs(ontology.ancestors(up, of("E")), "node", "ancestor")} == set("ABCD")
    assert {a for _, a in pairs(ontology.descendants(up, of("A")), "node", "descendant")} == set("BCDE")
    assert pairs(ontology.siblings(edges, of("B")), "sibling") == {("C",)} and not pairs(ontology.siblings(edges, of("A")), "sibling")
    assert pairs(ontology.parents(edges, of("D")), "parent") == {("B",), ("C",)}
    assert {(a, b): n for a, b, n in pairs(ontology.similarities(up, nodes), "a", "b", "similarity")}[("B", "C")] == 1
    assert ("D", "E", 3) in pairs(ontology.similarities(up, nodes), "a", "b", "similarity")
    assert pairs(ontology.lowest_common_ancestors(up, frame(spark, [("B", "C")], "a string, b string")), "lca") == {("A",)}


@pytest.mark.parametrize(("allowed", "want"), [("C", {("D", "C")}), ("D", {("E", "D")}), ("A", {("B", "A"), ("C", "A")})])
def test_viable_parent(spark, dag, allowed, want):
    edges, up, nodes = dag
    got = ontology.most_viable_parent(edges, up, nodes, frame(spark, [(allowed,)], "node string"))
    assert {x for x in pairs(got, "node", "parent") if x[1]} >= want and ("D", None) in pairs(got, "node", "parent") or allowed == "C"


def test_cycle(spark):
    with pytest.raises(ValueError):
        ontology.closure(frame(spark, [("A", "B"), ("B", "A")], "parent string, child string"))


def test_obo(spark, tmp_path):
    (tmp_path / "x.obo").write_text("format-version: 1.2\n\n[Term]\nid: X:1\nname: root\n\n[Term]\nid: X:2\nname: leaf\nis_a: X:1 ! root\nrelationship: part_of X:1 ! root\n\n[Term]\nid: X:3\nname: old\nis_obsolete: true\nis_a: X:1\n")
    terms, edges = obo.read_obo(spark, str(tmp_path / "x.obo"))
    assert pairs(terms, "term_id", "name") == {("X:1", "root"), ("X:2", "leaf")} and pairs(edges, "parent", "child") == {("X:1", "X:2")}


def test_weights(spark):
    rows = frame(spark, [("a", "x"), ("a", "x"), ("a", "y"), ("b", "y")], "label string, study string")
    got = sorted(r.weight for r in training.sampler_weights(rows).collect())
    assert np.allclose(got, [1666918321.08] * 3 + [5000254996.08])


def test_triplets(spark):
    points = [(0, "a", 0, [1.0, 0.0]), (1, "a", 1, [0.8, 0.6]), (2, "b", 0, [0.0, 1.0]), (3, "c", 0, [-1.0, 0.0])]
    batch = frame(spark, [(0, *p) for p in points], "batch int, id long, label string, study int, vector array<double>")
    assert {(a, b): round(d, 6) for a, b, d in pairs(training.pair_distances(batch), "a", "b", "dist2")} == {(0, 1): 0.4, (0, 2): 2, (0, 3): 4, (1, 2): 0.8, (1, 3): 3.6, (2, 3): 2}
    assert training.triplets(batch).count() == 0
    for mode in ("hard", "semihard", "random"):
        (got,) = training.triplets(batch, 1.8, mode).collect()
        assert (got.anchor, got.positive, got.negative) == (0, 1, 2) and np.isclose(got.loss, 0.2)
    assert training.triplets(batch, 1.8, related=frame(spark, [("a", "b")], "a string, b string")).count() == 0


def test_subsets_and_ranks(spark):
    rows = frame(spark, [("g1", 1), ("g1", 1), ("g1", 2), ("g1", None), ("g2", 1), ("g2", 1)], "g string, v int")
    assert {r.g for r in summarize.subset_by_unique_values(rows, ["g"], "v", 2).collect()} == {"g1"}
    assert summarize.subset_by_unique_values(rows, ["g"], "v", 2).count() == 4
    scores = frame(spark, [("a", 1.0), ("b", 2.0), ("c", 3.0)], "name string, score double")
    got = summarize.rank_by_score(scores, "name", "score", topn=2).orderBy("name_rank").collect()
    assert [r.name for r in got] == ["b", "c"]


def test_null_semantics(spark):
    rows = frame(spark, [("s1",), (None,), ("s2",)], "study string")
    assert {r.study for r in qc.exclude(rows, frame(spark, [("s1",)], "study string"), "study").collect()} == {None, "s2"}
    assert rows.where(qc.differs("study", "s1")).count() == 2
    assert tables.query(frame(spark, [("a", 1), ("\x00", 2), (None, 3)], "x string, y int"), "y >= 1", ["x"]).count() == 1


def test_mean_vectors_and_centroid_search(spark):
    rows = frame(spark, [(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "b", [-1.0, 0.0])], "id long, label string, vector array<double>")
    assert pairs(search.mean_vectors(rows, "label").selectExpr("label", "vector[0] v"), "label", "v") == {("a", 0.5), ("b", -1.0)}
    embed = lambda c: c.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("gene_idx", "x"))).alias("s")).select(F.hash("cluster").cast("long").alias("query_id"), "cluster", F.col("s.x").alias("vector"))
    centroids = frame(spark, [("p", 0, 1.0), ("p", 1, 0.1)], "cluster string, gene_idx int, x double")
    got = search.search_centroids(centroids, embed, rows.select("id", "vector"), rows.select("id", "label"), k=1).first()
    assert (got.id, got.centroid) == (1, "p")


def test_encoder(spark, tmp_path):
    net = encoder.Encoder.random(12, [7, 5], 4, seed=3)
    net.save(str(tmp_path / "m.npz"))
    again = encoder.Encoder.load(str(tmp_path / "m.npz"))
    rng = np.random.default_rng(0)
    x, base = rng.random((6, 12)), rng.random((6, 12))
    assert np.allclose(net.forward(x), again.forward(x))
    keep = []
    out = net.forward(x, keep)
    grad = net.backward(out, keep, np.ones_like(out))
    step = np.zeros_like(x)
    step[:, 3] = 1e-6
    assert np.allclose(grad[:, 3], ((net.forward(x + step) - net.forward(x - step)) / 2e-6).sum(1), atol=1e-5)
    # integrated gradients add up to the distance where every difference is positive
    up = base + rng.random((6, 12))
    total = ((net.forward(up) - net.forward(base)) ** 2).sum(1)
    assert (net.attributions(up, base).sum(1) >= total - 1e-6).all()


def test_row_ids_and_append(spark, tmp_path):
    rows = frame(spark, [(float(i),) for i in range(50)], "x double").repartition(7)
    assert sorted(r.row_id for r in tables.with_row_ids(rows, "x").collect() if r.row_id == r.x) == list(range(50))
    path = str(tmp_path / "t")
    first = frame(spark, [(0, "a"), (1, "b")], "id long, v string")
    assert (tables.append(first, path, "id"), tables.append(first, path, "id")) == (0, 2)
    tables.compact(spark, path, str(tmp_path / "c"), "id", 1)
    assert [r.id for r in spark.read.parquet(str(tmp_path / "c")).collect()] == [0, 1, 2, 3]
    (tmp_path / "order.tsv").write_text("g1\ng2\n")
    assert pairs(tables.ordered_lines(spark, str(tmp_path / "order.tsv")), "pos", "value") == {(0, "g1"), (1, "g2")}


def test_streams(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("user_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.lit(1.0).alias("value"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = events.tumbling(stream, "10 minutes", [], "1 minute").writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert {r.n for r in spark.table("tumbled").collect()} == {10}
    reference = frame(spark, [(1, [1.0, 0.0], "x"), (2, [0.0, 1.0], "y")], "id long, vector array<double>, label string")
    frame(spark, [(7, [0.9, 0.1])], "query_id long, vector array<double>").write.parquet(str(tmp_path / "q"))
    found = []
    run = events.annotate_stream(spark.readStream.schema("query_id long, vector array<double>").parquet(str(tmp_path / "q")), reference, lambda df, n: found.extend(df.collect()), k=1)
    run.awaitTermination(60)
    assert [r.prediction for r in found] == ["x"]


def test_append_to_one_row_and_to_none(spark, tmp_path):
    path = str(tmp_path / "t")
    none, one, two = (frame(spark, [(i, "x") for i in range(n)], "id long, v string") for n in range(3))
    assert [tables.append(x, path, "id") for x in (none, one, two, one)] == [0, 0, 1, 3]
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3]
    with pytest.raises(ValueError, match="columns"):
        tables.append(one.withColumn("w", F.lit(1)), path, "id")


def test_matrix_and_annotations_written_and_read_again(spark, tmp_path):
    counts = frame(spark, [(0, 0, 1.0), (0, 4, 2.0), (1, 2, 3.0)], "cell_id long, gene_idx int, value double")
    path = str(tmp_path / "x")
    assert [matrix.append_matrix(counts, path, 5) for _ in range(2)] == [0, 2]
    again = spark.read.parquet(path)
    assert pairs(again, "cell_id", "gene_idx", "value") == {(a + k, g, v) for k in (0, 2) for a, g, v in [(0, 0, 1.0), (0, 4, 2.0), (1, 2, 3.0)]}
    with pytest.raises(ValueError, match="4"):
        matrix.append_matrix(counts, path, 4)
    assert matrix.append_matrix(counts, str(tmp_path / "y"), 2, axis="gene_idx") == 0
    assert matrix.dense_row(again, 2, 5).first().row == [1.0, 0.0, 0.0, 0.0, 2.0] and matrix.dense_row(again, 99, 3).first().row == [0.0] * 3
    with pytest.raises(Exception, match="beyond"):
        matrix.dense_row(again, 0, 3).collect()
    assert pairs(matrix.sliced(again, frame(spark, [(2,), (3,)], "cell_id long"), frame(spark, [(2,)], "gene_idx int")), "cell_id", "value") == {(3, 3.0)}
    obs = frame(spark, [(0, "a"), (1, None)], "cell_id long, kind string")
    grown = tables.append_columns(obs, frame(spark, [(2, 7)], "cell_id long, depth int"))
    grown.write.parquet(str(tmp_path / "obs"))
    assert pairs(spark.read.parquet(str(tmp_path / "obs")), "cell_id", "kind", "depth") == {(0, "a", None), (1, None, None), (2, None, 7)}


def test_side_files_and_folders(spark, tmp_path):
    (tmp_path / "labels.tsv").write_text("label\tstudy\nT cell\ts1\nB cell\ts2\n")
    assert pairs(tables.separated(spark, str(tmp_path / "labels.tsv"), "label string, study string"), "label", "study") == {("T cell", "s1"), ("B cell", "s2")}
    for study, sample in (("s1", "a"), ("s1", "b"), ("s2", "a")):
        frame(spark, [(1,)], "cell_id long").write.parquet(str(tmp_path / f"root/study={study}/sample={sample}"))
    assert pairs(tables.study_samples(spark, str(tmp_path / "root")), "study", "sample", "cell_id") == {("s1", "a", 1), ("s1", "b", 1), ("s2", "a", 1)}


def test_checked_counts(spark):
    counts = frame(spark, [(1, 0, 0.0), (1, 1, 2.0)], "cell_id long, gene_idx int, value double")
    assert matrix.check_counts(counts).count() == 2
    with pytest.raises(Exception, match="negative"):
        matrix.check_counts(counts.withColumn("value", F.lit(-1.0))).collect()


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(3)
    values = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 900), np.round(rng.normal(size=900), 1), strict=True)] + [(None, 1.0), (None, 2.0), (7, None), (8, 4.0)]
    rows = frame(spark, values, "g int, v double")
    for q in (0.0, 0.37, 0.5, 0.999, 1.0):
        got = {r.g: r.quantile for r in quantiles.quantiles(rows, "v", q, "g").collect()}
        assert set(got) == {0, 1, 2, None, 8}
        for g in got:
            assert np.isclose(got[g], np.quantile([v for k, v in values if k == g and v is not None], q))
        assert np.isclose(quantiles.quantiles(rows, "v", q).first().quantile, np.quantile([v for _, v in values if v is not None], q))
    assert quantiles.quantiles(rows.where("false"), "v", 0.5, "g").count() == 0


@pytest.mark.parametrize("mode", ["hard", "semihard", "random"])
def test_triplets_against_all_triples(spark, mode):
    rng = np.random.default_rng(4)
    rows = [(b, i, "abc"[rng.integers(3)], int(rng.integers(2)), [float(x) for x in np.round(rng.normal(size=3), 1)]) for b in range(2) for i in range(b * 100, b * 100 + 24)]
    related = [("a", "b")]
    batch = frame(spark, rows, "batch int, id long, label string, study int, vector array<double>")
    dist = lambda x, y: sum((p - q) ** 2 for p, q in zip(x[4], y[4], strict=True))
    want = {}
    for a in rows:
        for p in rows:
            if a[0] == p[0] and a[2] == p[2] and a[1] < p[1] and a[3] != p[3]:
                for n in rows:
                    loss = dist(a, p) - dist(a, n) + 0.5
                    if n[0] == a[0] and n[2] != a[2] and (a[2], n[2]) not in related and (n[2], a[2]) not in related and loss > 0 and (mode != "semihard" or loss < 0.5):
                        want.setdefault((a[0], a[1], p[1]), []).append((-loss, n[1]))
    if mode == "hard":  # the nearest negative of all, not only of those with a loss
        want = {k: v for k, v in want.items() if v}
    got = {(r.batch, r.anchor, r.positive): (r.negative, r.loss) for r in training.triplets(batch, 0.5, mode, frame(spark, related, "a string, b string")).collect()}
    assert set(got) == set(want) and len(got) > 5
    for key, (negative, loss) in got.items():
        options = {n: -x for x, n in want[key]}
        assert np.isclose(options[negative], loss)
        if mode != "random":
            assert negative == min((round(x, 9), n) for x, n in want[key])[1]
    traced = training.triplets(batch, 0.5, mode, trace=True)
    assert {f"{s}_{c}" for s in ("anchor", "positive", "negative") for c in ("label", "study")} < set(traced.columns)
    assert all(r.anchor_label == r.positive_label != r.negative_label for r in traced.collect())


def test_coarse_grained(spark):
    rows = frame(spark, [(1, "D", "s1"), (2, "D", "s2"), (3, "B", "s1"), (4, "B", "s2"), (5, "E", "s1"), (6, "F", "s1")], "cell_id long, label string, study string")
    viable = frame(spark, [("E", "D"), ("F", None)], "node string, parent string")
    assert pairs(training.coarse_grained(rows, viable), "cell_id", "label") == {(1, "D"), (2, "D"), (3, "B"), (4, "B"), (5, "D")}


def test_perturbed_labels(spark, dag):
    edges, _, _ = dag
    rows = frame(spark, [(i, "ABCDE"[i % 5]) for i in range(500)], "cell_id long, label string")
    first, again = (dict(pairs(training.perturbed(rows, edges, "cell_id", 0.4, seed=2), "cell_id", "label")) for _ in range(2))
    changed = {i: ("ABCDE"[i % 5], x) for i, x in first.items() if x != "ABCDE"[i % 5]}
    assert first == again and len(first) == 500
    assert all((parent, child) in DAG for child, parent in changed.values())
    # a draw hits with probability 1 - exp(-0.4), and four labels of five have a parent
    assert 90 < len(changed) < 175
    assert training.perturbed(rows, edges, "cell_id", 0.0).subtract(rows).count() == 0
    assert training.perturbed(rows.where("false"), edges, "cell_id", 0.5).count() == 0


def test_names_and_valid_terms(spark):
    terms = frame(spark, [("X:1", "one"), ("X:2", "two"), ("X:3", None)], "term_id string, name string")
    rows = frame(spark, [(1, "X:1"), (2, "X:2"), (3, "X:9"), (4, None), (5, "X:3")], "cell_id long, label string")
    assert pairs(training.named_labels(rows, terms), "cell_id", "label") == {(1, "one"), (2, "two")}
    named = frame(spark, [(1, "one"), (2, "none")], "cell_id long, label string")
    assert pairs(training.valid_labels(named, terms), "cell_id") == {(1,)}
    with pytest.raises(ValueError):
        training.valid_labels(named.where("cell_id = 2"), terms)
    with pytest.raises(ValueError):
        annotate.allowed(frame(spark, [(1, "a")], "id long, label string"), ["b"])


def test_losses(spark):
    assert training.mixed_loss(2.0, 4.0, 0.25) == 3.5
    got = training.mixed_metric(frame(spark, [(0.5,), (0.1,)], "width double"), frame(spark, [(1.0, 2.0), (3.0, 3.0)], "x double, y double")).first()
    assert np.allclose([got.asw, got.nmse, got.metric], [0.3, 0.1, 0.45])


def test_sampled_rows(spark):
    rows = spark.range(1000).withColumnRenamed("id", "cell_id")
    first, again, other = ({r.cell_id for r in training.sampled_rows(rows, "cell_id", 100, seed).collect()} for seed in (1, 1, 2))
    assert first == again != other and len(first) == 100 and sum(x < 500 for x in first) in range(30, 71)


def test_whole_ways(spark):
    """Counts whose cells point along one axis each: labels, hits and the coherence of a query can be seen at once."""
    net = encoder.Encoder([encoder.Layer(np.eye(4), np.zeros(4))])
    target = frame(spark, [(i, f"g{i}") for i in range(4)], "gene_idx int, symbol string")
    cells = [(i, f"g{i % 4}", 5.0) for i in range(40)] + [(i, "other", 9.0) for i in range(40)] + [(99, "other", 1.0)]
    counts = frame(spark, cells, "cell_id long, symbol string, value double")
    reference = frame(spark, [(i, [1.0 if k == i else 0.0 for k in range(4)], f"t{i}") for i in range(4)], "id long, vector array<double>, label string")
    got = {r.cell_id: r for r in flows.annotate_counts(counts, target, net, reference, 1).collect()}
    assert set(got) == set(range(40)) and all(got[i].hint == f"t{i % 4}" and abs(got[i].min_dist) < 1e-6 and got[i].hint_stat == 1 for i in got)
    placed = matrix.align(counts, target)
    own = frame(spark, [(i,) for i in range(0, 40, 4)], "cell_id long")
    vectors = flows.embedded(counts, target, net).select(F.col("cell_id").alias("id"), "vector")
    meta = vectors.select("id", (F.col("id") % 2).alias("odd"))
    hits, share = flows.search_centroid(placed, own, net, vectors, meta, 10, clusters=2)
    assert {r.id for r in hits.collect()} == set(range(0, 40, 4)) and share == 10
    hits, share = flows.search_centroid(placed, own, net, vectors, meta, 10, max_dist=0.5, equal={"odd": 0}, clusters=None)
    assert {r.id for r in hits.collect()} == set(range(0, 40, 4)) and share is None
    named = frame(spark, [(i, "xy"[i % 4]) for i in range(40) if i % 4 < 2], "cell_id long, cluster string")
    hits = flows.search_cluster_centroids(placed, named, net, vectors, meta, 10).collect()
    assert {(r.centroid, r.id % 4) for r in hits} == {("x", 0), ("y", 1)} and len(hits) == 20
    assert {r.centroid for r in flows.search_cluster_centroids(placed, named, net, vectors, meta, 10, label="y").collect()} == {"y"}


def test_large_nets_are_read_from_a_file(spark, monkeypatch):
    rng, n = np.random.default_rng(5), 500
    net, back = encoder.Encoder.random(n, [8], 4, seed=1), encoder.Decoder.random(4, [8], n, seed=2)
    rows = [(c, int(g), float(x)) for c in range(60) for g, x in zip(rng.choice(n, 5, replace=False), rng.random(5), strict=True)]
    long = frame(spark, rows, "cell_id long, gene_idx int, value double")

    def found():
        tables = encoder.embed(matrix.pack(long), net, kind="double"), encoder.embed_long(long, net, "double"), encoder.reconstruction(matrix.pack(long), net, back)
        return [np.array([[*r[1]] if isinstance(r[1], list) else [*r[1:]] for r in sorted(t.collect())]) for t in tables]

    plain = found()
    monkeypatch.setattr(encoder, "COPIED", 1000)
    held = encoder.at_hand(spark.sparkContext, net.layers[0].weight)
    assert isinstance(held, encoder.Columns) and np.array_equal(held.take(np.array([3, 499, 3])), net.layers[0].weight[:, [3, 499, 3]])
    assert isinstance(encoder.at_hand(spark.sparkContext, np.zeros((2, 5))), np.ndarray)
    with pytest.raises(IndexError):
        held.take(np.array([n]))
    for a, b in zip(plain, found(), strict=True):
        assert len(a) == 60 and np.allclose(a, b, rtol=1e-12, atol=1e-12)


def test_gene_scores(spark):
    rows = [(c, g, float((c + g) % 3)) for c in range(5) for g in range(20) if (c + g) % 3]
    counts, signature = frame(spark, rows, "cell_id long, gene_idx int, x double"), frame(spark, [(3,), (7,), (999,)], "gene_idx int")
    got = {r.cell_id: r.score for r in summarize.score_genes(counts, signature, bins=1, control=100).collect()}
    for c in range(5):
        x = [float((c + g) % 3) for g in range(20)]
        assert np.isclose(got[c], (x[3] + x[7]) / 2 - (sum(x) - x[3] - x[7]) / 18)


def test_inverted_file_finds_enough_by_default(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(40, 16))
    rows = frame(spark, [(i, [float(y) for y in centre[i % 40] + rng.normal(size=16)]) for i in range(3000)], "id long, vector array<double>")
    index = inverted.InvertedFile.build(rows, 25)
    asked = training.sampled_rows(rows, "id", 300, seed=9).withColumnRenamed("id", "query_id")
    exact, near = (pairs(x, "query_id", "id") for x in (neighbours.nearest(asked, rows, 10), index.nearest(asked, 10)))
    print(f"{index.probes_for(10)} of 25 parts probed, recall {len(exact & near) / len(exact):.3f}")
    assert len(exact & near) >= 0.9 * len(exact) and index.probes_for(10) < 25


def test_model_round_trip(spark, tmp_path):
    net = encoder.Encoder.random(6, [4], 3, seed=1)
    genes = frame(spark, [(i, f"g{i}") for i in range(6)], "gene_idx int, symbol string")
    labels, studies = frame(spark, [("a", 0)], "label string, label_int int"), frame(spark, [("s1", "train"), ("s2", "val")], "study string, part string")
    encoder.save_model(str(tmp_path / "m"), net, genes, labels, studies)
    again, order, ints, lists = encoder.load_model(spark, str(tmp_path / "m"))
    x = np.random.default_rng(0).random((5, 6))
    assert np.array_equal(net.forward(x), again.forward(x)) and order.count() == 6 and pairs(ints, "label", "label_int") == {("a", 0)} and lists.count() == 2
    genes.limit(5).write.mode("overwrite").parquet(str(tmp_path / "m/genes"))
    with pytest.raises(ValueError, match="6 genes"):
        encoder.load_model(spark, str(tmp_path / "m"))


def test_symbols_when_no_id_is_known(spark):
    mapping = frame(spark, [("e1", "A"), ("e2", "B")], "id string, symbol string")
    counts = frame(spark, [(1, "x1", "'A'", 2.0), (1, "x2", "C", 3.0)], "cell_id long, name string, symbol string, value double")
    assert pairs(matrix.to_symbols(counts, mapping), "cell_id", "symbol", "value") == {(1, "A", 2.0)}
    assert pairs(matrix.to_symbols(counts.withColumn("name", F.lit("e2")), mapping), "symbol", "value") == {("B", 5.0)}


def test_packed_rows_are_written_long(spark, tmp_path):
    packed = frame(spark, [(0, [1, 3], [1.0, 2.0]), (1, [], [])], "cell_id long, idx array<int>, val array<float>")
    assert [matrix.write_packed(packed, str(tmp_path / "p")) for _ in range(2)] == [0, 1]
    assert pairs(spark.read.parquet(str(tmp_path / "p")), "cell_id", "gene_idx", "value") == {(0, 1, 1.0), (0, 3, 2.0), (1, 1, 1.0), (1, 3, 2.0)}


def test_nan_counts_are_an_error(spark):
    counts = frame(spark, [(1, 0, float("nan"))], "cell_id long, gene_idx int, value double")
    with pytest.raises(Exception, match="NaN"):
        aggregate.cluster_centroids(counts, frame(spark, [(1, "a")], "cell_id long, cluster string")).collect()


def test_nets_on_wide_rows(spark):
    """Long and packed rows give what dense ones do, and none is made dense: a batch of ten million genes would take 80 GB."""
    width, rng = 20_000, np.random.default_rng(5)
    net = encoder.Encoder.random(width, [6], 4, seed=3)
    back = encoder.Decoder([encoder.Layer(rng.normal(size=(5, 4)), rng.normal(size=5), np.ones(5), np.full(5, 2.0), np.ones(5), np.full(5, 0.25)), encoder.Layer(rng.normal(size=(width, 5)), rng.normal(size=width))])
    dense = np.zeros((4, width))
    for row in dense:
        row[rng.choice(width, 50, replace=False)] = rng.integers(1, 9, 50)
    dense[1] = dense[0] / 2
    packed = spark.createDataFrame([(i, np.flatnonzero(row).tolist(), row[row != 0].tolist()) for i, row in enumerate(dense)] + [(i, [i], [1.0]) for i in range(10, 1000)], "cell_id long, idx array<int>, val array<float>").coalesce(1)
    long = packed.where("cell_id < 4").select("cell_id", F.explode(F.arrays_zip("idx", "val")).alias("z")).select("cell_id", F.col("z.idx").alias("gene_idx"), F.col("z.val").alias("value"))

    one_net = encoder.Encoder([encoder.Layer(np.ones((1, 10_000_000), np.int8), np.zeros(1))])
    assert encoder.embed(packed, one_net).where("vector[0] = 1").count() == 994
    want = net.forward(dense)
    for found in (encoder.embed(packed, net, kind="double").where("cell_id < 4"), encoder.embed_long(long, net, "double")):
        assert np.allclose([v for _, v in sorted(map(tuple, found.collect()))], want)
    lost = ((dense - back.forward(want)) ** 2).sum(1)
    for found in (encoder.reconstruction(packed, net, back).where("cell_id < 4"), encoder.reconstruction_long(long, net, back)):
        rows = sorted(map(tuple, found.collect()))
        assert np.allclose([r[1] for r in rows], lost) and np.allclose([r[2] for r in rows], (dense**2).sum(1)) and {r[3] for r in rows} == {width}
    attributed = net.attributions(dense[[0, 2]], dense[[1, 3]])
    sides = spark.createDataFrame([(7, 0, 1), (8, 2, 3)], "pair_id long, anchor long, negative long")
    one = lambda x: packed.select(F.col("cell_id").alias(x), F.col("idx").alias(f"{x}_idx"), F.col("val").alias(f"{x}_val"))
    for found in (encoder.attribute_long(sides, long, net), encoder.attribute(sides.join(one("anchor"), "anchor").join(one("negative"), "negative"), net)):
        got = {(r.pair_id, r.gene_idx): r.value for r in found.collect()}
        assert set(got) == {(7 + i, int(g)) for i, g in zip(*np.nonzero(attributed), strict=True)}
        assert all(np.isclose(got[7 + i, int(g)], attributed[i, g]) for i, g in zip(*np.nonzero(attributed), strict=True))


def test_sums_of_coordinates_keep_all_partitions(spark):
    """Merged partitions would be sized by compressed bytes; sums and what follows by cell take many times that."""
    counts = spark.range(2000).select((F.col("id") % 500).alias("cell_id"), (F.col("id") % 7).alias("gene_idx"), F.lit(1.0).alias("value"))
    summed = matrix.collapsed(counts)
    assert summed.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert summed.agg(F.sum("value")).first()[0] == 2000
