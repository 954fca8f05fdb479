"""Searches that don't compare everything: with bounds, over an inverted file, through a graph; against the exact ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kindred.operators import annotate, flows, graph, inverted, neighbours, search
from kindred.streaming import events


def table(spark, x, first=0, **more):
    values = pa.array(np.asarray(x, np.float64).ravel())
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), values)
    return spark.createDataFrame(pa.table({"id": np.arange(first, first + len(x)), "vector": vectors, **more}))


def clustered(n, d=16, groups=40, spread=0.25, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    own = rng.integers(0, groups, n)
    return centres[own] + spread * rng.normal(size=(n, d)), own


def asked(rows):
    return rows.withColumnRenamed("id", "query_id").select("query_id", "vector")


def pairs(df):
    return {(r.query_id, r.id) for r in df.select("query_id", "id").collect()}


@pytest.fixture(scope="module")
def collection(spark):
    x, own = clustered(6000)
    label = np.where(np.arange(6000) % 1000 == 7, "rare", np.array([f"g{g % 5}" for g in own]))
    # no file of a test is read while another is written: one table in memory serves all
    rows = table(spark, x, label=pa.array(label)).cache()
    return x, rows, inverted.InvertedFile.build(rows, 40), asked(rows.where("id % 60 = 7")).cache()


@pytest.mark.parametrize("kind", ["double", "float"])
def test_hits_of_many_queries_are_ranked_where_they_are_found(spark, collection, monkeypatch, kind):
    _, rows, index, _ = collection
    rows = rows.withColumn("vector", F.col("vector").cast(f"array<{kind}>"))
    queries = asked(rows.where("id % 6 = 1"))
    # rows without metadata take a rank; rows with two come twice; without the index two queries may share an id
    metadata = rows.where("id % 7 > 0").select("id", "label").union(rows.where("id % 5 = 0").select("id", F.lit(None).cast("string")))
    twice = queries.unionByName(rows.where("id = 2").select(F.lit(1).cast("long").alias("query_id"), "vector"))
    columns = ["query_id", "rank", "id", F.round("dist", 9).alias("dist"), "label"]

    def found(by):
        hits = neighbours.within(twice, rows, 0.5, metadata) if by is None else by.within(queries, 0.5, metadata=metadata)
        return hits, sorted(map(repr, hits.select(columns).collect()))

    monkeypatch.setattr(neighbours, "FEW", 1 << 40)
    want = {by: found(by)[1] for by in ((None, index) if kind == "double" else (None,))}
    assert len(want[None]) > 100_000
    most = neighbours.within(twice, rows, 0.5).groupBy("query_id").count().agg(F.max("count")).first()[0]
    monkeypatch.setattr(neighbours, "FEW", 0)
    for by in want:
        hits, got = found(by)
        assert got == want[by]
        # hits aren't dealt by query, nor again by row for the metadata
        assert hits._jdf.queryExecution().optimizedPlan().toString().startswith("MapInArrow")
    # a query with too many hits for a task goes the other way
    monkeypatch.setattr(neighbours, "GATHERED", 4 * (most - 1))
    monkeypatch.setattr(neighbours, "HIT_BYTES", 1 << 20)
    hits, got = found(None)
    assert got == want[None] and "Union" in hits._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_read_by_groups_of_queries_and_not_shuffled(spark, collection, monkeypatch):
    """However many groups, neither hits nor rows are dealt out again; a task holds one group."""
    _, rows, index, _ = collection
    queries = asked(rows.where("id % 6 = 1"))
    monkeypatch.setattr(neighbours, "PACKED", 100)
    want = {by: sorted(map(repr, (neighbours if by is None else by).within(*((queries, rows) if by is None else (queries,)), 0.5).withColumn("dist", F.round("dist", 9)).collect())) for by in (None, index)}
    monkeypatch.setattr(neighbours, "FEW", 0)
    monkeypatch.setattr(neighbours, "GATHERED", 6000)
    for by in (None, index):
        hits = (neighbours if by is None else by).within(*((queries, rows) if by is None else (queries,)), 0.5, metadata=rows.select("id", "label"))
        plan = hits._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionBy" not in plan and "Generate" not in plan
        assert hits.rdd.getNumPartitions() > 20
        assert sorted(map(repr, hits.select("query_id", "rank", "id", F.round("dist", 9).alias("dist")).collect())) == want[by]


def test_a_small_reference_is_searched_by_several_tasks(spark, collection):
    _, rows, _, _ = collection
    queries = asked(rows)
    some = rows.where("id % 60 = 3")
    assert neighbours._shards(some, None) == 1
    hits = neighbours._blocked(queries, some, neighbours._first(5)).withColumn("task", F.spark_partition_id()).toPandas()
    assert hits["task"].nunique() == 4 and hits.groupby("query_id")["task"].nunique().max() == 1
    assert (hits.groupby("query_id").size() == 5).all() and hits["query_id"].nunique() == 6000


@pytest.mark.parametrize("weighting", [False, True])
def test_rows_are_labelled_in_their_place(spark, weighting, monkeypatch):
    """As by dealing out hits: with odd rows and labels, equal distances, and vectors of two sizes."""
    x, own = clustered(400, 8, 6, 0.6)
    x[50:80] = x[50]
    label = pa.array([None if i % 9 == 4 else f"g{g % 4}" for i, g in enumerate(own)])
    odd = spark.createDataFrame([(900, None, "g1"), (901, [0.0] * 8, "g1"), (902, [1.0, 0.0], "g2"), (903, [1.0, 1.0], None), (904, [1.0, float("nan")], "g3")], "id long, vector array<double>, label string")
    rows = table(spark, x, label=label).union(odd).cache()
    queries = rows.select(F.col("id").alias("cell_id"), "vector").union(spark.createDataFrame([(905, [1.0, 2.0, 3.0])], "cell_id long, vector array<double>"))
    for reference, k in ((rows, 7), (rows, 1), (rows.where("id % 9 = 4 or id = 903"), 3), (rows.where("id = 903 or id = 902"), 5), (rows.where("false"), 5)):
        want = {r.query_id: r for r in annotate.annotate(queries.withColumnRenamed("cell_id", "query_id"), reference, k, weighting).collect()}
        found = annotate.annotated_rows(queries, reference, k, weighting)
        assert "Join" not in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and "Window" not in plan and "Aggregate" not in plan
        got = {r.cell_id: r for r in found.collect()}
        assert len(got) == 406 and {i for i, r in got.items() if r.prediction is not None} == set(want)
        for i, r in got.items():
            w = want.get(i)
            if w is None:
                assert r[2:] == (None,) * 9
                continue
            assert (r.prediction, r.hits) == (w.prediction, w.hits)
            assert r.hits_weighted.keys() == w.hits_weighted.keys() and list(r.hits_weighted.values()) == pytest.approx([w.hits_weighted[c] for c in r.hits_weighted], rel=1e-6)
            for c in ("min_dist", "max_dist", "vs2nd", "vs_all", "weighted_vs2nd", "weighted_vs_all"):
                assert r[c] == pytest.approx(w[c], rel=1e-6, abs=1e-12)
    # a reference that is large, or whose ids repeat, goes the other way
    assert annotate.annotated_rows(queries, rows.union(rows.where("id = 3")), 5) is None
    monkeypatch.setattr(neighbours, "SHARD", 100)
    assert annotate.annotated_rows(queries, rows, 5) is None


def test_a_shard_of_a_graph_is_searched_by_several_tasks(spark, collection, tmp_path):
    _, rows, _, _ = collection
    some = rows.where("id < 2500").select("id", "vector")
    world = graph.SmallWorld.build(some, str(tmp_path / "graph"))
    assert world.shards == 1
    queries = asked(some)
    hits = world._run(queries, 5, 32, neighbours.HITS_DDL, False).withColumn("task", F.spark_partition_id()).toPandas()
    assert hits["task"].nunique() > 1 and hits.groupby("query_id")["task"].nunique().max() == 1
    assert (hits.groupby("query_id").size() == 5).all() and hits["query_id"].nunique() == 2500
    near = pairs(neighbours.nearest(queries, some, 5))
    assert len(near & set(zip(hits["query_id"], hits["id"], strict=True))) > 0.95 * len(near)


def test_many_neighbours_take_two_passes(spark, monkeypatch):
    x, _ = clustered(9000, 8, 30)
    monkeypatch.setattr(neighbours, "LARGE", 100)
    monkeypatch.setattr(neighbours, "SHARD", 3000)
    rows, queries = table(spark, x), asked(table(spark, x[:20]))
    assert neighbours._shards(rows, None) == 3
    for k in (100, 2500):
        found = neighbours._nearest(queries, rows, k).groupBy("query_id").count().toPandas()
        assert len(found) == 20 and found["count"].between(k, 2 * k).all()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    order = np.argsort(1 - unit[:20] @ unit.T, axis=1, kind="stable")[:, :2500]
    got = pairs(neighbours.nearest(queries, rows, 2500))
    assert got == {(i, int(j)) for i in range(20) for j in order[i]}
    assert neighbours.nearest(queries, rows, 20_000).count() == 20 * 9000


def test_equal_vectors_are_cut_in_their_shard(spark):
    rows = table(spark, np.ones((3000, 4)))
    queries = asked(rows.limit(1))
    assert neighbours._nearest(queries, rows, 5).count() == 5
    assert [r.id for r in neighbours.nearest(queries, rows, 5).orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_hits_of_one_query_are_ranked_by_many_tasks(spark):
    x, _ = clustered(4000, 8, 30)
    x[100:400] = x[100]
    rows = table(spark, x)
    queries = asked(rows.where("id in (5, 100)"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = neighbours.within(queries, rows, 2.0).withColumn("task", F.spark_partition_id()).toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found.groupby(["query_id", "task"]).size().max() < 3600
    for _, own in found.groupby("query_id"):
        own = own.sort_values(["dist", "id"])
        assert own["rank"].tolist() == list(range(1, 4001)) and sorted(own["id"]) == list(range(4000))


def test_a_shard_is_put_together_in_order():
    x = np.arange(12.0).reshape(6, 2)
    parts = [(np.array([1, 4]), x[:2], np.zeros(2)), (np.array([2]), x[2:3], np.ones(1)), (np.array([7, 8, 9]), x[3:], np.zeros(3))]
    held = neighbours.Shard.of(list(parts))
    assert held.ids.tolist() == [1, 2, 4, 7, 8, 9] and held.matrix[:, 0].tolist() == [0, 4, 2, 6, 8, 10] and held.extra.tolist() == [0, 1, 0, 0, 0, 0]


def test_radius_by_an_index_is_exact_and_skips_most(spark, collection):
    x, rows, index, queries = collection
    for dist in (0.0005, 0.02, 0.3):
        assert pairs(index.within(queries, dist)) == pairs(neighbours.within(queries, rows, dist))
    looked = index.looked_at(queries, 0.02).toPandas()
    assert len(looked) == 100 and looked["n"].mean() < 0.2 * len(x)
    some = rows.where("id % 3 = 0").select("id")
    assert pairs(index.within(queries, 0.02, some)) == pairs(neighbours.within(queries, rows.join(some, "id", "left_semi"), 0.02))


def test_search_exhaustive_by_an_index(spark, collection):
    _, rows, index, queries = collection
    metadata = rows.select("id", "label")
    for equal in (None, {"label": "g3"}):
        a, b = (search.search_exhaustive(queries, rows, metadata, 0.02, equal, i).select("query_id", "id", "label") for i in (None, index))
        assert set(map(tuple, a.collect())) == set(map(tuple, b.collect()))


def test_lists_inside_the_index(spark, collection):
    _, rows, index, queries = collection
    for lists in ({"safelist": ["g1", "rare"]}, {"blocklist": ["g1", "g2"]}):
        want = pairs(neighbours.nearest(queries, annotate.allowed(rows, **lists), 10))
        assert pairs(index.nearest(queries, 10, probes=40, allowed=annotate.condition(**lists))) == want
        a = annotate.annotate(queries, rows, 10, **lists).select("query_id", "prediction", "hits")
        assert len(a.collect()) == 100
    # a label of one row in a thousand: its six rows are spread, so probing must widen
    want = pairs(neighbours.nearest(queries, annotate.allowed(rows, ["rare"]), 5))
    got = pairs(index.nearest(queries, 5, allowed=annotate.condition(["rare"])))
    assert len(got) == len(want) == 500 and len(got & want) >= 0.95 * len(want)
    with pytest.raises(ValueError):
        annotate.annotate(queries, rows, 10, index=index, safelist=["nothing"])


def test_every_way_takes_an_index(spark, collection, tmp_path):
    _, rows, index, queries = collection
    exact = pairs(search.search_nearest(queries, rows, rows.select("id"), 200))
    found = pairs(search.search_nearest(queries, rows, rows.select("id"), 200, index=index))
    assert len(found & exact) >= 0.95 * len(exact)
    labels = {r.query_id: r.prediction for r in annotate.annotate(queries, rows, 20).collect()}
    by_index = {r.query_id: r.prediction for r in annotate.annotate(queries, rows, 20, index=index).collect()}
    assert sum(labels[q] == by_index[q] for q in labels) >= 95 and len(by_index) == 100
    queries.write.parquet(f"{tmp_path}/in")
    got = []
    stream = spark.readStream.schema(queries.schema).parquet(f"{tmp_path}/in")
    events.annotate_stream(stream, rows, lambda df, n: got.extend(df.collect()), 20, f"{tmp_path}/marks", index=index).awaitTermination()
    assert {r.query_id: r.prediction for r in got} == by_index


def test_ten_thousand_neighbours_of_a_million_by_an_index(spark, tmp_path):
    x, _ = clustered(1_000_000, 16, 64, 0.6, seed=5)
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * 16, pa.int32()), pa.array(x.astype(np.float32).ravel()))
    (tmp_path / "rows").mkdir()
    for k in range(8):
        part = slice(k * 125_000, (k + 1) * 125_000)
        pq.write_table(pa.table({"id": np.arange(part.start, part.stop), "vector": vectors[part]}), tmp_path / "rows" / f"{k}.parquet")
    rows = spark.read.parquet(str(tmp_path / "rows"))
    inverted.InvertedFile.build(rows, 64, sample=20_000).write(str(tmp_path / "index"))
    index, queries = inverted.InvertedFile.read(spark, str(tmp_path / "index")), asked(rows.where("id % 50000 = 0"))
    assert index.probes_for(10_000, sample=40) < 32
    exact, found = (d.select("query_id", "id").toPandas() for d in (neighbours.nearest(queries, rows, 10_000), index.nearest(queries, 10_000)))
    both = exact.merge(found)
    assert len(exact) == len(found) == 20 * 10_000 and len(both) >= 0.95 * len(exact)


def test_layers_keep_diverse_links():
    x, _ = clustered(1500, 16, 10)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tables = graph.linked(x.astype(np.float32), (np.arange(1500) % 16 == 0).astype(int), links=8, pool=24)
    assert [t.shape[1] for t in tables] == [16, 8] and not (tables[1][np.arange(1500) % 16 != 0] >= 0).any()
    # a row's own choice: none of those kept is nearer to an earlier one than to the row
    candidates = graph._candidates(x, np.arange(1500), np.arange(5), 24)
    kept = graph._diverse(x, np.arange(5), candidates, 8)
    for i in range(5):
        own = [c for c in kept[i] if c >= 0]
        assert own[0] == np.argsort(-(x @ x[i]))[1]
        for j, c in enumerate(own):
            assert all(x[c] @ x[e] <= x[c] @ x[i] + 1e-12 for e in own[:j])


def test_a_world_is_read_flat_and_walked_without_counting_twice():
    """Rows of a shard become the tables they were written from, and links that several rows share are followed once."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1200, 12))
    x[7] = x[3]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    level = np.minimum(np.arange(1200) % 40 == 0, 1).astype(np.int32) + (np.arange(1200) % 400 == 0)
    raw = pa.array([v.tobytes() for v in x], pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(1200, np.int32)), pa.array(level, pa.int32()), pa.array(np.arange(1200)), raw], ["shard", "level", "id", "raw"])
    rows = [r.select(["place", "ids", "raw", "links"]) for r in graph._built(iter([batch]), 8, 24)]
    world = graph._world(rows)
    of = pa.Table.from_batches(rows).to_pylist()
    assert len(of) == 1199 and of[3]["ids"] == [3, 7] and len(world.tables) == 3
    for k, table in enumerate(world.tables):
        for i, row in enumerate(of):
            assert table[i][table[i] >= 0].tolist() == (row["links"][k] if k < len(row["links"]) else [])
    met = []
    world.small = type("Met", (np.ndarray,), {"take": lambda self, at, axis=None: met.extend(np.ravel(at).tolist()) or np.asarray(self).take(at, axis=axis)})(world.small.shape, world.small.dtype, world.small.tobytes())
    found, _ = world.walk(x[:1].astype(np.float32), np.array([[world.entry]]), world.tables[0], 32)
    assert len(met) == len(set(met)) == world.compared - 1 and 100 < len(met) < 1000
    assert set(found[0][:10].tolist()) <= set(range(1199)) and 0 in found[0]
    # 32-bit queries come in half the bytes
    values = pa.array([x[:5].astype(np.float32)[i].tobytes() for i in range(5)], pa.binary())
    asks = pa.RecordBatch.from_arrays([pa.array(np.zeros(5, np.int32)), pa.array([True] * 5), pa.array(np.zeros(5, np.int32)), pa.array([[i] for i in range(5)]), values, pa.nulls(5, rows[0].column(3).type)], ["task", "asks", "place", "ids", "raw", "links"])
    held = [pa.RecordBatch.from_arrays([pa.array(np.zeros(len(r), np.int32)), pa.array([False] * len(r)), *r.columns], asks.schema.names) for r in rows]
    hits = pa.Table.from_batches(list(graph._searched(iter([*held, asks]), 1, 64, False, True))).to_pylist()
    assert [(h["query_id"], h["id"]) for h in hits] == [(i, i) for i in range(5)] and max(h["dist"] for h in hits) < 1e-6


def test_graph_recall_and_comparisons(spark, tmp_path):
    x, _ = clustered(20_000, 32, 100, 0.6, seed=3)
    rows = table(spark, x)
    index = graph.SmallWorld.build(rows, str(tmp_path), shard=10_000)
    queries = asked(table(spark, clustered(20_000, 32, 100, 0.6, seed=3)[0][::100] + 0.01)).cache()
    exact = pairs(neighbours.nearest(queries, rows, 10))
    shares, recalls = [], []
    for breadth in (16, 64, 256):
        recalls.append(len(pairs(index.nearest(queries, 10, breadth)) & exact) / len(exact))
        work = index.comparisons(queries, 10, breadth).first()
        shares.append(work.compared / work.whole)
    assert recalls[0] >= 0.85 and recalls[1] >= 0.97 and recalls[2] >= 0.99 and recalls == sorted(recalls)
    assert shares[0] < shares[1] < shares[2] and shares[1] < 0.1
    again = graph.SmallWorld.read(spark.newSession(), str(tmp_path))
    assert again.shards == 2 and pairs(again.nearest(queries, 10, 64)) == pairs(index.nearest(queries, 10, 64))
    with pytest.raises(NotImplementedError):
        again.within(queries, 0.1)


def test_graph_with_copies_and_odd_rows(spark, tmp_path):
    x, _ = clustered(400, 8, 4)
    x[100:300] = x[100]
    rows = table(spark, x).union(spark.createDataFrame([(900, None), (901, [0.0] * 8), (902, [1.0])], "id long, vector array<double>"))
    index = graph.SmallWorld.build(rows, str(tmp_path / "a"))
    assert pairs(index.nearest(asked(rows.where("id = 100")), 60)) == {(100, i) for i in range(100, 160)}
    assert index.nearest(asked(rows.where("id >= 900")), 5).count() == 0
    assert index.rows.count() == 201
    none = graph.SmallWorld.build(rows.where("false"), str(tmp_path / "b"))
    assert none.nearest(asked(rows), 5).count() == 0
    one = graph.SmallWorld.build(rows.where("id = 3"), str(tmp_path / "c"))
    assert pairs(one.nearest(asked(rows.where("id < 3")), 5)) == {(i, 3) for i in range(3)}


def test_flows_take_an_index(spark):
    """The arguments reach the search: with all parts probed hits are those of the exact one."""
    from kindred.operators import encoder

    rng = np.random.default_rng(1)
    counts = spark.createDataFrame([(int(c), int(g), float(rng.integers(1, 9))) for c in range(60) for g in rng.choice(12, 5, replace=False)], "cell_id long, gene_idx int, value double")
    net = encoder.Encoder.random(12, [8], 4, seed=2)
    vectors = flows.embedded(counts.select("cell_id", F.concat(F.lit("s"), "gene_idx").alias("symbol"), "value"), spark.createDataFrame([(g, f"s{g}") for g in range(12)], "gene_idx int, symbol string"), net, kind="double")
    reference = vectors.select(F.col("cell_id").alias("id"), "vector", (F.col("cell_id") % 3).cast("string").alias("label")).cache()
    index = inverted.InvertedFile.build(reference, 3)
    index.measured[4, 0.95, "None"] = 3
    clusters = spark.createDataFrame([(c, f"k{c % 2}") for c in range(60)], "cell_id long, cluster string")
    a, b = (flows.search_cluster_centroids(counts, clusters, net, reference, reference.select("id", "label"), 4, kind="double", index=i).select("centroid", "rank", "id") for i in (None, index))
    assert set(map(tuple, a.collect())) == set(map(tuple, b.collect())) and a.count() == 8


def test_blocks_are_smaller_where_shards_are_large():
    """A task holds no more than CELLS distances, and every query still meets the shard once."""
    import pyarrow as pa

    from kindred.operators import neighbours

    def batch(asks, ids):
        n = len(ids)
        raw = pa.array([np.array([1.0, 0.0]).tobytes()] * n, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int64)), pa.array(np.full(n, 16, np.int32)), pa.array([asks] * n), pa.array(ids), pa.array(np.zeros(n)), raw], ["_s", "_k", "_d", "_asks", "_id", "_x", "_raw"])

    seen = []

    def emit(asked, vectors, extra, shard):
        assert len(asked) * len(shard.ids) <= neighbours.CELLS
        seen.extend(asked.tolist())
        return iter(())

    list(neighbours._streamed(iter([batch(False, np.arange(5000)), batch(True, np.arange(3000))]), emit))
    assert seen == list(range(3000))
