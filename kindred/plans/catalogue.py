"""All queries of the library on the star-schema tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import vectors as vec
from kindred.functions.vocabulary import clean_terms, harmonised, has_keyword
from kindred.operators import aggregate, annotate, encoder, flows, graph, inverted, matrix, neighbours, ontology, search, summarize, training
from kindred.operators import quality_control as qc
from kindred.plans import roles
from kindred.plans.roles import CELLS, CLOSURE, COUNTS, DISTANCES, EDGES, GENES, RANKED, VECTORS
from kindred.sources import tables
from kindred.sources.shared import new_folder, settled
from kindred.streaming import events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

MAX_DIST = 0.8


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


# Similarity search


@query(f"WITH {RANKED} SELECT query_id, rank::INT AS rank, id, round(dist, 6) AS dist FROM ranked WHERE rank <= 10")
def knn_topk(spark, d):
    rows = roles.vectors(spark, d)
    return rounded(neighbours.nearest(roles.asked(rows), rows, 10), dist=6)


@query(f"WITH {RANKED}, lens AS (SELECT * FROM ranked WHERE dist <= {MAX_DIST} AND label = 3) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY dist, id)::INT AS rank, id, label, round(dist, 6) AS query_nn_dist FROM lens")
def radius_filtered(spark, d):
    rows = roles.vectors(spark, d)
    hits = search.search_exhaustive(roles.asked(rows), rows, rows.select("id", "label"), MAX_DIST, {"label": 3})
    return rounded(hits.select("query_id", "rank", "id", "label", "query_nn_dist"), query_nn_dist=6)


@query(f"WITH {RANKED} SELECT query_id, rank::INT AS rank, id, label, round(dist, 6) AS query_nn_dist FROM ranked WHERE dist <= {MAX_DIST}")
def radius_all(spark, d):
    rows = roles.vectors(spark, d)
    hits = search.search_nearest(roles.asked(rows), rows, rows.select("id", "label"), max_dist=MAX_DIST)
    return rounded(hits.select("query_id", "rank", "id", "label", "query_nn_dist"), query_nn_dist=6)


@query(ORACLE_SQL["radius_all"])
def radius_by_index(spark, d):
    """Exact, though most rows are skipped where vectors lie in clusters."""
    rows = roles.vectors(spark, d)
    index = inverted.InvertedFile.build(rows, 16)
    hits = search.search_nearest(roles.asked(rows), rows, rows.select("id", "label"), max_dist=MAX_DIST, index=index)
    return rounded(hits.select("query_id", "rank", "id", "label", "query_nn_dist"), query_nn_dist=6)


@query(ORACLE_SQL["radius_filtered"])
def radius_filtered_by_index(spark, d):
    rows = roles.vectors(spark, d)
    index = inverted.InvertedFile.build(rows, 16)
    hits = search.search_exhaustive(roles.asked(rows), rows, rows.select("id", "label"), MAX_DIST, {"label": 3}, index)
    return rounded(hits.select("query_id", "rank", "id", "label", "query_nn_dist"), query_nn_dist=6)


MEANS = f"{VECTORS}, parts AS (SELECT label, i, avg(vector[i]) AS x FROM vectors, range(1, 65) t(i) GROUP BY 1, 2), means AS (SELECT label, list(x ORDER BY i) AS vector FROM parts GROUP BY 1)"


@query(f"WITH {MEANS}, d AS (SELECT m.label AS query_id, v.id, v.label, list_cosine_distance(m.vector, v.vector) AS dist FROM means m, vectors v), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM d) SELECT query_id::BIGINT AS query_id, rank::INT AS rank, id, label, round(dist, 6) AS query_nn_dist FROM r WHERE rank <= 50")
def embedding_centroid_search(spark, d):
    rows = roles.vectors(spark, d)
    means = search.mean_vectors(rows, "label").select(F.col("label").cast("long").alias("query_id"), "vector")
    hits = search.search_nearest(means, rows, rows.select("id", "label"), 50)
    return rounded(hits.select("query_id", "rank", "id", "label", "query_nn_dist"), query_nn_dist=6)


@query(f"WITH {MEANS} SELECT v.id, v.label, round(list_cosine_distance(v.vector, m.vector), 6) AS dist, round(1 - list_cosine_distance(v.vector, m.vector), 6) AS similarity, round(1 / list_cosine_distance(v.vector, m.vector), 4) AS inverse FROM vectors v JOIN means m USING (label)")
def dist2centroid(spark, d):
    rows = roles.vectors(spark, d)
    means = search.mean_vectors(rows, "label").withColumnRenamed("vector", "centroid")
    out = rows.join(means, "label").withColumn("dist", vec.cosine_distance("vector", "centroid"))
    return rounded(out.select("id", "label", "dist", (1 - F.col("dist")).alias("similarity"), (1 / F.col("dist")).alias("inverse")), dist=6, similarity=6, inverse=4)


@query()
def knn_inverted_file(spark, d):
    """Approximate; its recall is tested against the exact search."""
    rows = roles.vectors(spark, d)
    index = inverted.InvertedFile.build(rows, 16)
    return rounded(index.nearest(roles.asked(rows), 10), dist=6)


@query()
def knn_graph(spark, d):
    """Approximate; its recall and how little it compares are tested against the exact search."""
    rows = roles.vectors(spark, d)
    index = graph.SmallWorld.build(rows, new_folder(spark, "graph"))
    return rounded(index.nearest(roles.asked(rows), 10), dist=6)


@query()
def query_coherence(spark, d):
    """K-means has no SQL form; tested by its bounds."""
    rows = roles.vectors(spark, d)
    mean = search.mean_vectors(rows.withColumn("one", F.lit(0)), "one").select(F.lit(0).cast("long").alias("query_id"), "vector")
    hits = neighbours.nearest(mean, rows, 1000)
    return spark.createDataFrame([(search.coherence(roles.asked(rows), hits, rows),)], "coherence double")


@query("SELECT pos, v.vec_id, v.label FROM (SELECT row_number() OVER (ORDER BY vec_id DESC) - 1 AS pos, vec_id FROM embeddings) i JOIN embeddings v USING (vec_id)")
def gather_order(spark, d):
    rows = tables.load(spark, d, "embeddings")
    ids = tables.with_row_ids(rows.select("vec_id", (-F.col("vec_id")).alias("_down")), "_down", name="pos").select("pos", "vec_id")
    return tables.gather(rows.select("vec_id", "label"), ids, "vec_id").select("pos", "vec_id", "label")


# Annotation


def _vote_sql(k: int, where: str = "true", weighted: bool = False) -> str:
    return f"""WITH {DISTANCES}, near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM distances WHERE {where}),
    top AS (SELECT * FROM near WHERE rank <= {k}),
    v AS (SELECT query_id, label, count(*) AS hits, sum(1 / greatest(dist, 1e-6)) AS weight, min(rank) AS first_rank FROM top GROUP BY 1, 2),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {'weight' if weighted else 'hits'} DESC, first_rank) AS w, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC) AS n, count(*) OVER (PARTITION BY query_id) AS labels FROM v)
    SELECT query_id, max(CASE WHEN w = 1 THEN label END) AS prediction,
    round(CASE WHEN max(labels) = 1 THEN 1.0 ELSE max(CASE WHEN n = 1 THEN hits END) / sum(CASE WHEN n <= 2 THEN hits END) END, 6)::DOUBLE AS vs2nd,
    round(max(hits) / sum(hits), 6)::DOUBLE AS vs_all, round(max(weight) / sum(weight), 4)::DOUBLE AS weighted_vs_all FROM o GROUP BY 1"""


def _voted(spark, d, k, weighting=False, **lists):
    rows = roles.vectors(spark, d)
    out = annotate.annotate(roles.asked(rows), annotate.allowed(rows, **lists), k, weighting)
    return rounded(out.select("query_id", "prediction", "vs2nd", "vs_all", "weighted_vs_all"), vs2nd=6, vs_all=6, weighted_vs_all=4)


@query(_vote_sql(50))
def annotate_vote(spark, d):
    return _voted(spark, d, 50)


@query(_vote_sql(50, weighted=True, where="id <> query_id"))
def annotate_vote_weighted(spark, d):
    rows = roles.vectors(spark, d)
    out = annotate.annotate(roles.asked(rows), rows, 50, weighting=True, exclude_self=True)
    return rounded(out.select("query_id", "prediction", "vs2nd", "vs_all", "weighted_vs_all"), vs2nd=6, vs_all=6, weighted_vs_all=4)


@query(_vote_sql(25, where="label IN (1, 3, 5)"))
def annotate_safelist(spark, d):
    return _voted(spark, d, 25, safelist=[1, 3, 5])


@query(_vote_sql(25, where="label IN (1, 3, 5)"))
def annotate_safelist_by_index(spark, d):
    """All parts are probed, so the vote is the exact one."""
    rows = roles.vectors(spark, d)
    index = inverted.InvertedFile.build(rows, 8)
    hits = index.nearest(roles.asked(rows), 25, probes=8, allowed=annotate.condition([1, 3, 5]))
    out = annotate.predictions(hits.join(rows.select("id", "label"), "id"))
    return rounded(out.select("query_id", "prediction", "vs2nd", "vs_all", "weighted_vs_all"), vs2nd=6, vs_all=6, weighted_vs_all=4)


@query(_vote_sql(25, where="label NOT IN (0, 2)"))
def annotate_blocklist(spark, d):
    return _voted(spark, d, 25, blocklist=[0, 2])


@query("SELECT DISTINCT label FROM embeddings WHERE label IS NOT NULL")
def label_classes(spark, d):
    return annotate.classes(roles.vectors(spark, d))


# Counts


LOGNORM_ROWS = "SELECT cell_id, gene_idx, ln(1 + 1e4 * value / sum(value) OVER (PARTITION BY cell_id)) AS x FROM counts"
LOGNORM = f"WITH {COUNTS} SELECT cell_id, gene_idx, round(ln(1 + 1e4 * value / sum(value) OVER (PARTITION BY cell_id)), 6) AS x FROM counts"


@query(LOGNORM)
def lognorm(spark, d):
    return rounded(matrix.lognorm(roles.counts(spark, d)).select("cell_id", "gene_idx", "x"), x=6)


@query(f"WITH {COUNTS} SELECT cell_id, list(gene_idx::INT ORDER BY gene_idx)::VARCHAR AS genes, count(*) AS n FROM counts GROUP BY 1")
def pack_counts(spark, d):
    packed = matrix.pack(roles.counts(spark, d))
    return packed.select("cell_id", F.concat(F.lit("["), F.array_join(F.col("idx").cast("array<string>"), ", "), F.lit("]")).alias("genes"), F.size("idx").cast("long").alias("n"))


@query(f"WITH {COUNTS}, {GENES} SELECT cell_id, symbol, sum(value) AS value FROM counts JOIN genes USING (gene_idx) GROUP BY 1, 2")
def consolidate_symbols(spark, d):
    return matrix.consolidate(roles.lines(spark, d), roles.genes(spark, d))


TARGET = "target AS (SELECT symbol, (row_number() OVER (ORDER BY symbol DESC) - 1)::INT AS gene_idx FROM (SELECT DISTINCT p_name AS symbol FROM part WHERE p_brand < 'Brand#3'))"


@query(f"WITH {COUNTS}, {GENES}, {TARGET} SELECT cell_id, t.gene_idx, sum(value) AS value FROM counts c JOIN genes g ON c.gene_idx = g.gene_idx JOIN target t USING (symbol) GROUP BY 1, 2")
def align_genes(spark, d):
    return matrix.align(matrix.consolidate(roles.lines(spark, d), roles.genes(spark, d)), _target(spark, d), least_overlap=1)


def _target(spark, d):
    names = roles.genes(spark, d).where("brand < 'Brand#3'").select("symbol").distinct()
    counted = tables.with_row_ids(names, "symbol", name="_up").join(F.broadcast(names.agg(F.count("*").alias("_n"))))
    return counted.select("symbol", (F.col("_n") - 1 - F.col("_up")).cast("int").alias("gene_idx"))


@query(f"WITH {COUNTS}, {GENES} SELECT cell_id, symbol, sum(value) AS value FROM counts JOIN genes USING (gene_idx) WHERE gene_idx > 10 GROUP BY 1, 2")
def id2symbol(spark, d):
    named = roles.counts(spark, d).select("cell_id", F.concat(F.lit("'g"), F.col("gene_idx"), F.lit('"')).alias("name"), "value")
    mapping = roles.genes(spark, d).where("gene_idx > 10").select(F.concat(F.lit("g"), F.col("gene_idx")).alias("id"), "symbol")
    return matrix.to_symbols(named, mapping)


QC = f"{COUNTS}, {GENES}, metrics AS (SELECT cell_id, sum(value) AS total_counts, count(*) FILTER (value <> 0) AS n_genes, sum(CASE WHEN starts_with(symbol, 'cold ') THEN value ELSE 0 END) AS total_mt FROM counts JOIN genes USING (gene_idx) GROUP BY 1), qc AS (SELECT *, 100 * total_mt / total_counts AS pct_mt FROM metrics)"


def _metrics(spark, d):
    rows = roles.counts(spark, d).join(roles.genes(spark, d), "gene_idx")
    return qc.qc_metrics(rows, F.col("symbol").startswith("cold "))


@query(f"WITH {QC} SELECT cell_id, total_counts, n_genes, total_mt, round(pct_mt, 6) AS pct_mt FROM qc")
def qc_metrics(spark, d):
    return rounded(_metrics(spark, d), pct_mt=6)


@query(f"WITH {QC} SELECT cell_id, n_genes, round(pct_mt, 6) AS pct_mt FROM qc WHERE pct_mt < 30 AND n_genes >= 3")
def filter_cells(spark, d):
    return rounded(qc.filter_cells(_metrics(spark, d), 3, 30.0).select("cell_id", "n_genes", "pct_mt"), pct_mt=6)


@query(f"WITH {COUNTS} SELECT gene_idx, round(ln(1 + 1e4 * sum(value) / (SELECT sum(value) FROM counts)), 6) AS x FROM counts GROUP BY 1")
def centroid(spark, d):
    return rounded(aggregate.centroid(roles.lines(spark, d)), x=6)


@query(f"WITH {COUNTS}, {CELLS}, s AS (SELECT region AS cluster, gene_idx, sum(value) AS value FROM counts JOIN cells USING (cell_id) GROUP BY 1, 2) SELECT cluster, gene_idx, round(ln(1 + 1e4 * value / sum(value) OVER (PARTITION BY cluster)), 6) AS x FROM s")
def cluster_centroid(spark, d):
    return rounded(aggregate.cluster_centroids(roles.lines(spark, d), roles.cells(spark, d).select("cell_id", F.col("region").alias("cluster"))), x=6)


BULK = "bulk AS (SELECT c.{g}, symbol AS gene, cell_id, sum(value) AS value FROM counts JOIN genes USING (gene_idx) JOIN {cells} c USING (cell_id) GROUP BY 1, 2, 3)"


@query(f"WITH {COUNTS}, {GENES}, {CELLS}, {BULK.format(g='study', cells='cells')}, n AS (SELECT study, count(*) AS cells FROM cells GROUP BY 1 HAVING count(*) >= 2) SELECT study, gene, sum(value) AS sum, count(*) FILTER (value <> 0) AS count_nonzero, any_value(n.cells) AS cells FROM bulk JOIN n USING (study) GROUP BY 1, 2")
def pseudobulk(spark, d):
    counts = matrix.consolidate(roles.lines(spark, d), roles.genes(spark, d)).withColumnRenamed("symbol", "gene")
    return aggregate.pseudobulk(counts, roles.cells(spark, d), ["study"], 2)


@query(f"WITH {QC}, {CELLS}, good AS (SELECT cells.* FROM cells JOIN qc USING (cell_id) WHERE pct_mt <= 20 AND total_counts >= 50 AND n_genes >= 2), {BULK.format(g='study', cells='good')}, n AS (SELECT study, count(*) AS cells FROM good GROUP BY 1) SELECT study, gene, sum(value) AS sum, count(*) FILTER (value <> 0) AS count_nonzero, any_value(n.cells) AS cells FROM bulk JOIN n USING (study) GROUP BY 1, 2")
def pseudobulk_qc(spark, d):
    counts = matrix.consolidate(roles.lines(spark, d), roles.genes(spark, d)).withColumnRenamed("symbol", "gene")
    good = qc.qc_pass(_metrics(spark, d), 20.0, 50, 2).select("cell_id")
    return aggregate.pseudobulk(counts, roles.cells(spark, d).join(good, "cell_id", "left_semi"), ["study"])


@query(f"WITH {COUNTS}, {GENES}, {CELLS}, {BULK.format(g='tissue', cells='cells')}, n AS (SELECT tissue, count(*) AS cells FROM cells GROUP BY 1), m AS (SELECT DISTINCT p_name AS gene FROM part WHERE p_name < 'g') SELECT tissue, gene, CASE WHEN gene IN (SELECT gene FROM m) THEN sum(value) END AS sum, CASE WHEN gene IN (SELECT gene FROM m) THEN count(*) FILTER (value <> 0) END AS count_nonzero, any_value(n.cells) AS cells FROM bulk JOIN n USING (tissue) GROUP BY 1, 2")
def pseudobulk_masked(spark, d):
    counts = matrix.consolidate(roles.lines(spark, d), roles.genes(spark, d)).withColumnRenamed("symbol", "gene")
    measured = roles.genes(spark, d).where("symbol < 'g'").select(F.col("symbol").alias("gene"))
    return aggregate.pseudobulk(counts, roles.cells(spark, d), ["tissue"], 1, measured)


@query()
def embed_cells(spark, d):
    """A network has no SQL form; tested against a plain matrix product."""
    genes = roles.genes(spark, d)
    width = genes.agg(F.max("gene_idx")).first()[0] + 1
    packed = matrix.pack(matrix.lognorm(roles.counts(spark, d)).select("cell_id", "gene_idx", F.col("x").alias("value")))
    out = encoder.embed(packed, encoder.Encoder.random(width, [32], 16, seed=1))
    return out.select("cell_id", F.transform("vector", lambda x: F.round(x, 4)).alias("vector"))


@query(
    f"WITH {COUNTS}, normal AS (SELECT cell_id, gene_idx, ln(1 + 1e4 * value / sum(value) OVER (PARTITION BY cell_id))::FLOAT::DOUBLE AS x FROM counts), "
    "bins AS (SELECT cell_id, bin, coalesce(sum(x) FILTER (gene_idx % 16 = bin), 0) AS v FROM normal, range(16) t(bin) GROUP BY ALL), "
    "hidden AS (SELECT cell_id, bin, (v - bin / 4.0) * 0.5 - 1 AS h FROM bins), bent AS (SELECT cell_id, bin, CASE WHEN h >= 0 THEN h ELSE 0.25 * h END AS h FROM hidden), "
    "outs AS (SELECT cell_id, bin % 8 AS j, sum(CASE WHEN bin < 8 THEN h ELSE -h END) + 0.1 AS y FROM bent GROUP BY ALL), "
    "sized AS (SELECT *, sqrt(sum(y * y) OVER (PARTITION BY cell_id)) AS size FROM outs) "
    "SELECT cell_id, j::INT AS j, round(y / size, 5) AS x FROM sized"
)
def embed_two_layers(spark, d):
    """A hidden layer that is normalised and bent, and an output layer of half its width; weights are such that SQL can say what comes out."""
    width = roles.genes(spark, d).agg(F.max("gene_idx")).first()[0] + 1
    first = (np.arange(width)[None, :] % 16 == np.arange(16)[:, None]).astype(np.int8)
    hidden = encoder.Layer(first, np.zeros(16), np.arange(16) / 4.0, np.full(16, 0.5), np.full(16, -1.0), np.full(16, 0.25))
    last = encoder.Layer(np.concatenate([np.eye(8), -np.eye(8)], axis=1), np.full(8, 0.1))
    packed = matrix.pack(matrix.lognorm(roles.counts(spark, d)).select("cell_id", "gene_idx", F.col("x").alias("value")))
    out = encoder.embed(packed, encoder.Encoder([hidden, last]), kind="double")
    return rounded(out.select("cell_id", F.posexplode("vector").alias("j", "x")), x=5)


@query()
def attribute_genes(spark, d):
    """Integrated gradients have no SQL form; tested against their sum, the distance itself."""
    genes = roles.genes(spark, d)
    width = genes.agg(F.max("gene_idx")).first()[0] + 1
    centres = aggregate.cluster_centroids(roles.counts(spark, d), roles.cells(spark, d).select("cell_id", F.col("region").alias("cluster")))
    rows = settled(centres.select(F.xxhash64("cluster").alias("cell_id"), "cluster", "gene_idx", F.col("x").alias("value")))
    names = rows.select("cell_id", "cluster").distinct()
    anchor, negative = (names.select(F.col("cell_id").alias(x), F.col("cluster").alias(f"{x}_name")) for x in ("anchor", "negative"))
    pairs = anchor.join(negative, F.col("anchor_name") < F.col("negative_name")).withColumn("pair_id", F.xxhash64("anchor_name", "negative_name"))
    return training.ranked_genes(encoder.attribute_long(pairs, rows, encoder.Encoder.random(width, [32], 16, seed=1)))


# Whole ways from counts to hits. The net has one layer, which sums genes by their remainder of 16, so SQL can say what it gives.


BINS = 16
EMBED = "SELECT {by}, list(v / norm ORDER BY bin) AS vector FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY {by})) AS norm FROM (SELECT {by}, bin, coalesce(sum(x) FILTER (gene_idx % 16 = bin), 0) AS v FROM {of}, range(16) t(bin) GROUP BY ALL)) GROUP BY 1"
EMBEDDED = f"{COUNTS}, {CELLS}, normal AS (SELECT cell_id, gene_idx, ln(1 + 1e4 * value / sum(value) OVER (PARTITION BY cell_id))::FLOAT::DOUBLE AS x FROM counts), vecs AS ({EMBED.format(by='cell_id', of='normal')})"
CENTRES = "sums AS (SELECT {by} AS cluster, gene_idx, sum(value) AS value FROM counts JOIN cells USING (cell_id){where} GROUP BY 1, 2), shares AS (SELECT cluster, gene_idx, ln(1 + 1e4 * value / sum(value) OVER (PARTITION BY cluster))::FLOAT::DOUBLE AS x FROM sums), centres AS (" + EMBED.format(by="cluster", of="shares") + ")"


def _binned(spark, d):
    """A net of one layer, as many genes wide as there are."""
    width = roles.genes(spark, d).agg(F.max("gene_idx")).first()[0] + 1
    weight = (np.arange(width)[None, :] % BINS == np.arange(BINS)[:, None]).astype(np.int8)
    return encoder.Encoder([encoder.Layer(weight, np.zeros(BINS))])


def _own_genes(spark, d):
    """The gene order that leaves genes where they are."""
    return roles.genes(spark, d).select("gene_idx", F.concat(F.lit("g"), "gene_idx").alias("symbol"))


def _embedded_cells(spark, d, net):
    named = roles.counts(spark, d).select("cell_id", F.concat(F.lit("g"), "gene_idx").alias("symbol"), "value")
    return settled(flows.embedded(named, _own_genes(spark, d), net, kind="double").select(F.col("cell_id").alias("id"), "vector"))


@query(f"WITH {EMBEDDED}, {CENTRES.format(by="study || '/' || disease", where='')}, d AS (SELECT cell_id, cluster, split_part(cluster, '/', 2) AS label, list_cosine_distance(v.vector, c.vector) AS dist FROM vecs v, centres c), r AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY dist, cluster) AS rank FROM d), top AS (SELECT * FROM r WHERE rank <= 15), v AS (SELECT cell_id, label, count(*) AS hits, min(rank) AS first_rank FROM top GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY hits DESC, first_rank) AS w FROM v), m AS (SELECT cell_id, min(dist) AS min_dist FROM top GROUP BY 1) SELECT cell_id, max(label) FILTER (w = 1) AS hint, round(max(m.min_dist), 5) AS min_dist, round(max(hits) / sum(hits), 6)::DOUBLE AS hint_stat, '{{' || string_agg('\"' || label || '\":' || hits, ',' ORDER BY label) || '}}' AS hits FROM o JOIN m USING (cell_id) GROUP BY 1")
def annotate_dataset(spark, d):
    net, counts = _binned(spark, d), roles.counts(spark, d)
    clusters = roles.cells(spark, d).select("cell_id", F.concat_ws("/", "study", "disease").alias("cluster"))
    centres = flows.embedded_centroids(counts, clusters, net, kind="double")
    reference = settled(centres.select(F.col("query_id").alias("id"), "vector", F.split("cluster", "/")[1].alias("label")))
    named = counts.select("cell_id", F.concat(F.lit("g"), "gene_idx").alias("symbol"), "value")
    out = flows.annotate_counts(named, _own_genes(spark, d), net, reference, 15, kind="double")
    return rounded(out.select("cell_id", "hint", "min_dist", "hint_stat", matrix.hits_json("hits").alias("hits")), min_dist=5, hint_stat=6)


def _unbinned(spark, d):
    """The way back from ``_binned``: every gene gets what its remainder has."""
    return encoder.Decoder([encoder.Layer(_binned(spark, d).layers[0].weight.T.copy(), np.zeros(roles.genes(spark, d).agg(F.max("gene_idx")).first()[0] + 1))])


REBUILT = "genes_of AS (SELECT g % 16 AS bin, count(*) AS genes FROM range((SELECT max(p_partkey) + 1 FROM part)) t(g) GROUP BY 1), {name} AS (SELECT {by}, max(own.xx) - 2 * max(own.xz) + max(of_z.zz) AS error, max(own.xx) AS square FROM (SELECT {by}, sum(x * x) AS xx, sum(x * vector[gene_idx % 16 + 1]) AS xz FROM {of} JOIN {vectors} USING ({by}) GROUP BY 1) own JOIN (SELECT {by}, sum(vector[bin + 1] ** 2 * genes) AS zz FROM {vectors}, genes_of GROUP BY 1) of_z USING ({by}) GROUP BY 1)"


@query(f"WITH {EMBEDDED}, {REBUILT.format(name='rebuilt', by='cell_id', of='normal', vectors='vecs')} SELECT cell_id, round(error, 3) AS error, round(square, 3) AS square FROM rebuilt")
def reconstruction(spark, d):
    net = _binned(spark, d)
    normal = matrix.lognorm(roles.counts(spark, d)).select("cell_id", "gene_idx", F.col("x").alias("value"))
    return rounded(encoder.reconstruction(matrix.pack(normal), net, _unbinned(spark, d)).drop("genes"), error=3, square=3)


@query(
    f"WITH {COUNTS}, {CELLS}, {CENTRES.format(by="study || '/' || disease", where='')}, {REBUILT.format(name='rebuilt', by='cluster', of='shares', vectors='centres')}, v AS (SELECT cluster, split_part(cluster, '/', 2) AS label, vector FROM centres), "
    "p AS (SELECT a.cluster, a.label, b.label AS other, sum(list_sum(list_transform(range(1, 17), lambda i: (a.vector[i] - b.vector[i]) * (a.vector[i] - b.vector[i])))) AS total, count(*) AS n FROM v a JOIN v b ON a.cluster <> b.cluster GROUP BY ALL), "
    "s AS (SELECT cluster, sum(total) FILTER (other = label) / (sum(n) FILTER (other = label) - 1) AS intra, sum(n) FILTER (other = label) AS k, min(total / n) FILTER (other <> label AND n > 1) AS inter FROM p GROUP BY cluster, label), "
    "m AS (SELECT (SELECT avg((inter - intra) / greatest(intra, inter)) FROM s WHERE k > 1 AND inter IS NOT NULL) AS asw, (SELECT sum(error) / sum(square) FROM rebuilt) AS nmse) SELECT round(asw, 5) AS asw, round(nmse, 5) AS nmse, round((1 - asw) / 2 + nmse, 5) AS metric FROM m"
)
def model_metric(spark, d):
    """How well a pair of nets does on the centroids of study and disease: silhouettes by disease, and what is lost on the way back."""
    net, counts = _binned(spark, d), roles.counts(spark, d)
    clusters = roles.cells(spark, d).select("cell_id", F.concat_ws("/", "study", "disease").alias("cluster"))
    centres = aggregate.cluster_centroids(counts, clusters)
    named = tables.with_row_ids(centres.select("cluster").distinct(), "cluster", name="cell_id")
    rows = settled(centres.join(named, "cluster").select("cell_id", "gene_idx", F.col("x").alias("value")))
    vectors = encoder.embed_long(rows, net, kind="double").join(named, "cell_id").select(F.col("cell_id").alias("id"), F.split("cluster", "/")[1].alias("label"), "vector")
    widths = training.silhouette(neighbours.distance_sums(vectors, squared=True))
    return rounded(training.mixed_metric(widths, encoder.reconstruction_long(rows, net, _unbinned(spark, d))), asw=5, nmse=5, metric=5)


def _centroid_sql(by: str, limit: str, where: str = "", name: bool = True) -> str:
    of = "cluster AS centroid, " if name else ""
    return f"WITH {EMBEDDED}, {CENTRES.format(by=by, where=where)}, d AS (SELECT cluster, cell_id AS id, list_cosine_distance(v.vector, c.vector) AS dist FROM vecs v, centres c), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY dist, id) AS rank FROM d) SELECT {of}id, rank::INT AS rank, tissue, round(dist, 6) AS query_nn_dist FROM r JOIN cells ON id = cells.cell_id WHERE {limit}"


def _metadata(spark, d):
    return roles.cells(spark, d).select(F.col("cell_id").alias("id"), "tissue", "data_type")


@query(_centroid_sql("'all'", "rank <= 40", " WHERE tissue = 'BUILDING'", name=False))
def centroid_search(spark, d):
    net = _binned(spark, d)
    chosen = roles.cells(spark, d).where("tissue = 'BUILDING'")
    hits, _ = flows.search_centroid(roles.counts(spark, d), chosen, net, _embedded_cells(spark, d, net), _metadata(spark, d), 40, clusters=None, kind="double")
    return rounded(hits.select("id", "rank", "tissue", "query_nn_dist"), query_nn_dist=6)


@query(_centroid_sql("'all'", "dist <= 0.35", " WHERE tissue = 'BUILDING'", name=False))
def centroid_exhaustive(spark, d):
    net = _binned(spark, d)
    chosen = roles.cells(spark, d).where("tissue = 'BUILDING'")
    hits, _ = flows.search_centroid(roles.counts(spark, d), chosen, net, _embedded_cells(spark, d, net), _metadata(spark, d), max_dist=0.35, clusters=None, kind="double")
    return rounded(hits.select("id", "rank", "tissue", "query_nn_dist"), query_nn_dist=6)


@query(_centroid_sql("region", "rank <= 30"))
def cluster_centroid_search(spark, d):
    net, clusters = _binned(spark, d), roles.cells(spark, d).select("cell_id", F.col("region").alias("cluster"))
    hits = flows.search_cluster_centroids(roles.counts(spark, d), clusters, net, _embedded_cells(spark, d, net), _metadata(spark, d), 30, kind="double")
    return rounded(hits.select("centroid", "id", "rank", "tissue", "query_nn_dist"), query_nn_dist=6)


@query(f"WITH a AS ({_centroid_sql('region', 'dist <= 0.4')}) SELECT centroid, id, row_number() OVER (PARTITION BY centroid ORDER BY rank)::INT AS rank, tissue, query_nn_dist FROM a WHERE tissue = 'MACHINERY'")
def cluster_centroid_exhaustive(spark, d):
    net, clusters = _binned(spark, d), roles.cells(spark, d).select("cell_id", F.col("region").alias("cluster"))
    hits = flows.search_cluster_centroids(roles.counts(spark, d), clusters, net, _embedded_cells(spark, d, net), _metadata(spark, d), max_dist=0.4, equal={"tissue": "MACHINERY"}, kind="double")
    return rounded(hits.select("centroid", "id", "rank", "tissue", "query_nn_dist"), query_nn_dist=6)


@query()
def centroid_coherence(spark, d):
    """K-means has no SQL form; tested by its bounds and on clusters made by hand."""
    net = _binned(spark, d)
    chosen = roles.cells(spark, d).where("tissue = 'BUILDING'")
    _, found = flows.search_centroid(roles.counts(spark, d), chosen, net, _embedded_cells(spark, d, net), _metadata(spark, d), 1000, clusters=10, kind="double")
    return spark.createDataFrame([(found,)], "coherence double")


@query(f"WITH {COUNTS}, {GENES}, {TARGET}, i AS (SELECT row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS pos, o_orderkey AS cell_id FROM orders), p AS (SELECT cell_id, t.gene_idx, sum(value) AS value FROM counts c JOIN genes g ON c.gene_idx = g.gene_idx JOIN target t USING (symbol) GROUP BY 1, 2) SELECT pos, cell_id, gene_idx, round(ln(1 + 1e4 * value / sum(value) OVER (PARTITION BY cell_id)), 6) AS value FROM i JOIN p USING (cell_id)")
def gather_counts(spark, d):
    ids = tables.with_row_ids(tables.load(spark, d, "orders").select(F.col("o_orderkey").alias("cell_id"), (-F.col("o_orderkey")).alias("_down")), "_down", name="pos")
    return rounded(flows.gather_counts(ids, roles.counts(spark, d), roles.genes(spark, d), _target(spark, d)), value=6)


@query(f"WITH {CELLS}, t AS (SELECT cell_id, study, sample, CASE WHEN data_type = 'F' THEN 'train' WHEN tissue = 'BUILDING' THEN 'test' ELSE 'NA' END AS data_type FROM cells), p AS (SELECT cell_id, tissue AS prediction, price AS min_dist FROM cells WHERE price > 100000) SELECT t.*, prediction, min_dist AS prediction_nn_dist, row_number() OVER (ORDER BY study, sample, cell_id) - 1 AS index FROM t LEFT JOIN p USING (cell_id)")
def search_metadata(spark, d):
    cells = roles.cells(spark, d)
    predictions = cells.where("price > 100000").select("cell_id", F.col("tissue").alias("prediction"), F.col("price").alias("min_dist"))
    return flows.search_metadata(cells.select("cell_id", "study", "sample"), cells.where("data_type = 'F'"), cells.where("tissue = 'BUILDING'"), predictions)


@query(f"WITH {COUNTS} SELECT cell_id, gene_idx, value FROM counts WHERE cell_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') AND gene_idx IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#11')")
def matrix_slice(spark, d):
    cells = roles.cells(spark, d).where("data_type = 'P'")
    return matrix.sliced(roles.counts(spark, d), cells, roles.genes(spark, d).where("brand = 'Brand#11'"))


@query("SELECT cell_id, g AS gene_idx, coalesce(value, 0) AS value FROM (SELECT min(l_orderkey) AS cell_id FROM lineitem), range((SELECT max(p_partkey) + 1 FROM part)) t(g) LEFT JOIN (SELECT l_partkey AS g, sum(l_quantity)::DOUBLE AS value FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem) GROUP BY 1) USING (g)")
def matrix_row(spark, d):
    counts = roles.counts(spark, d)
    cell, width = counts.agg(F.min("cell_id")).first()[0], roles.genes(spark, d).agg(F.max("gene_idx")).first()[0] + 1
    return matrix.dense_row(counts, cell, width).select("cell_id", F.posexplode("row").alias("gene_idx", "value")).withColumn("gene_idx", F.col("gene_idx").cast("long"))


@query(f"WITH {COUNTS}, m AS (SELECT gene_idx, sum(x) AS s FROM ({LOGNORM_ROWS}) GROUP BY 1), r AS (SELECT gene_idx, (row_number() OVER (ORDER BY s, gene_idx) - 1) * 25 // count(*) OVER () AS bin FROM m), own AS (SELECT r.* FROM r WHERE gene_idx % 50 = 7), ctl AS (SELECT gene_idx FROM r WHERE bin IN (SELECT bin FROM own) AND gene_idx % 50 <> 7), s AS (SELECT cell_id, sum(CASE WHEN gene_idx IN (SELECT gene_idx FROM own) THEN x ELSE 0 END) / (SELECT count(*) FROM own) - sum(CASE WHEN gene_idx IN (SELECT gene_idx FROM ctl) THEN x ELSE 0 END) / (SELECT count(*) FROM ctl) AS score FROM ({LOGNORM_ROWS}) GROUP BY 1) SELECT cell_id, round(score, 8) AS score FROM s")
def score_genes(spark, d):
    rows = matrix.lognorm(roles.counts(spark, d)).select("cell_id", "gene_idx", "x")
    # every gene of a bin is a control, so no draw is left to chance
    return rounded(summarize.score_genes(rows, roles.genes(spark, d).where("gene_idx % 50 = 7"), control=1 << 30), score=8)


@query(f"WITH {CELLS} SELECT cell_id, tissue || '_' || region AS tissue, size, coalesce(colour, 'lightgray') AS colour FROM (SELECT cell_id, tissue, region, 1 AS size FROM cells) LEFT JOIN (VALUES ('BUILDING', 'red'), ('MACHINERY', 'blue')) c(t, colour) ON t = tissue")
def relabel_leaves(spark, d):
    leaves = roles.cells(spark, d).select("cell_id", "tissue", "region", F.lit(1).alias("size"))
    colours = spark.createDataFrame([("BUILDING", "red"), ("MACHINERY", "blue")], "name string, colour string")
    return summarize.relabelled(leaves, ["region"], "tissue", "_", colours).drop("region")


# Summaries


HITS = f"{CELLS}, hits AS (SELECT cell_id % 7 AS query_id, cells.* FROM cells)"


def _hits(spark, d):
    return roles.cells(spark, d).withColumn("query_id", F.col("cell_id") % 7)


@query(f"WITH {CELLS} SELECT study, sample, data_type, min(cell_id) AS first FROM cells GROUP BY ALL")
def first_index(spark, d):
    return summarize.first_index(roles.cells(spark, d))


@query(f"WITH {HITS}, n AS (SELECT query_id, study, sample, tissue, disease, count(*) AS cells FROM hits GROUP BY ALL), t AS (SELECT study, sample, count(*) AS total FROM cells GROUP BY 1, 2) SELECT query_id, study, sample, tissue, disease, n.cells, total, round(n.cells / total, 6) AS fraction FROM n JOIN t USING (study, sample)")
def sample_rollup(spark, d):
    return rounded(summarize.sample_rollup(_hits(spark, d), roles.cells(spark, d), ["study", "sample", "tissue", "disease"]), fraction=6)


@query(f"WITH {CELLS} SELECT cell_id, study, sample, data_type, cell_id - min(cell_id) OVER (PARTITION BY study, sample, data_type) AS cell_index FROM cells")
def cell_index(spark, d):
    return summarize.cell_index(roles.cells(spark, d)).select("cell_id", "study", "sample", "data_type", "cell_index")


@query(f"WITH {CELLS}, g AS (SELECT sample, tissue FROM cells GROUP BY 1, 2 HAVING count(DISTINCT disease) >= 4) SELECT cell_id, sample, tissue, disease FROM cells JOIN g USING (sample, tissue)")
def subset_unique(spark, d):
    return summarize.subset_by_unique_values(roles.cells(spark, d), ["sample", "tissue"], "disease", 4).select("cell_id", "sample", "tissue", "disease")


@query(f"WITH {CELLS}, g AS (SELECT sample FROM cells GROUP BY 1 HAVING count(*) >= 12) SELECT sample, cell_id, study FROM cells JOIN g USING (sample)")
def subset_frequency(spark, d):
    return summarize.subset_by_frequency(roles.cells(spark, d).select("cell_id", "study", "sample"), ["sample"], 12)


@query(f"WITH {CELLS}, m AS (SELECT study, row_number() OVER (ORDER BY avg(price), study) AS name_rank FROM cells GROUP BY 1) SELECT study, cell_id, price, name_rank::INT AS name_rank FROM cells JOIN m USING (study)")
def rank_by_score(spark, d):
    return summarize.rank_by_score(roles.cells(spark, d).select("cell_id", "study", "price"), "study", "price")


@query(f"WITH {CELLS}, m AS (SELECT study, avg(price) AS p FROM cells GROUP BY 1 ORDER BY p DESC, study LIMIT 5), r AS (SELECT study, row_number() OVER (ORDER BY p, study) AS name_rank FROM m) SELECT study, cell_id, price, name_rank::INT AS name_rank FROM cells JOIN r USING (study)")
def topn_by_score(spark, d):
    return summarize.rank_by_score(roles.cells(spark, d).select("cell_id", "study", "price"), "study", "price", topn=5)


@query(f"WITH {CELLS} SELECT disease, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS percent FROM cells GROUP BY 1")
def proportions(spark, d):
    return rounded(summarize.proportions(roles.cells(spark, d), "disease"), percent=6)


@query(f"WITH {HITS}, a AS (SELECT tissue, count(*) / sum(count(*)) OVER () AS p FROM hits GROUP BY 1), b AS (SELECT tissue, count(*) / sum(count(*)) OVER () AS q FROM cells GROUP BY 1) SELECT tissue, round(100 * p, 6)::DOUBLE AS hit_percent, round(100 * q, 6)::DOUBLE AS all_percent, round(p / q, 6)::DOUBLE AS enrichment FROM a JOIN b USING (tissue)")
def background_enrichment(spark, d):
    a = summarize.proportions(_hits(spark, d), "tissue").select("tissue", F.col("percent").alias("hit_percent"))
    b = summarize.proportions(roles.cells(spark, d), "tissue").select("tissue", F.col("percent").alias("all_percent"))
    return rounded(a.join(b, "tissue").withColumn("enrichment", F.col("hit_percent") / F.col("all_percent")), hit_percent=6, all_percent=6, enrichment=6)


@query(f"WITH {CELLS} SELECT region, study, count(*) AS n FROM cells GROUP BY ROLLUP (region, study) HAVING grouping(region) = 0")
def hits_rollup(spark, d):
    return summarize.nested_counts(roles.cells(spark, d), ["region", "study"])


@query(f"WITH {CELLS} SELECT tissue, " + ", ".join(f"count(*) FILTER (data_type = '{x}') AS {x}" for x in "FOP") + " FROM cells GROUP BY 1")
def hits_heatmap(spark, d):
    return summarize.heatmap(roles.cells(spark, d).withColumn("one", F.lit(1)), "tissue", "data_type", ["F", "O", "P"], "one")


@query(f"WITH {CELLS} SELECT tissue, " + ", ".join(f"coalesce(round(avg(price) FILTER (data_type = '{x}'), 4), 0) AS {x}" for x in "FOP") + " FROM cells GROUP BY 1")
def heatmap_of_means(spark, d):
    return rounded(summarize.heatmap(roles.cells(spark, d), "tissue", "data_type", ["F", "O", "P"], "price", mean=True), F=4, O=4, P=4)


@query(f"WITH {CELLS} SELECT region, study, tissue, round(sum(price), 2) AS size FROM cells GROUP BY ALL")
def leaf_sizes(spark, d):
    return rounded(summarize.leaf_sizes(roles.cells(spark, d), ["region", "study"], "tissue", "price"), size=2)


@query(f"WITH {CELLS}, l AS (SELECT region, study, tissue, count(*) AS size FROM cells GROUP BY ALL) SELECT region, count(DISTINCT study) AS children, sum(size)::BIGINT AS size, count(*) AS leaves FROM l GROUP BY 1")
def size_tree(spark, d):
    cells = roles.cells(spark, d).withColumn("one", F.lit(1))
    made = summarize.tree(summarize.leaf_sizes(cells, ["region", "study"], "tissue", "one"), ["region", "study"], "tissue")
    leaves = F.flatten(F.transform("children", lambda x: x["children"]))
    return made.select("region", F.size("children").cast("long").alias("children"), F.aggregate(leaves, F.lit(0).cast("long"), lambda s, x: s + x["size"]).alias("size"), F.size(leaves).cast("long").alias("leaves"))


@query(f"WITH {CELLS} SELECT study, round(quantile_cont(price, 0.9), 6) AS quantile FROM cells GROUP BY 1")
def group_quantiles(spark, d):
    return rounded(summarize.group_quantiles(roles.cells(spark, d), "study", "price", 0.9), quantile=6)


@query(f"WITH {CELLS} SELECT cell_id, price FROM cells WHERE price >= (SELECT quantile_cont(price, 0.999) FROM cells)")
def above_quantile(spark, d):
    return summarize.above_quantile(roles.cells(spark, d).select("cell_id", "price"), "price", 0.999)


# Filters, vocabularies and joins


VOCABULARY = [("automobile", "vehicle"), ("MACHINERY", "machine"), ("building", "house"), ("household", "house")]
KEYWORDS = ["URGENT", "SPEC"]


@query(f"WITH {CELLS} SELECT cell_id, tissue, CASE lower(tissue) WHEN 'automobile' THEN 'vehicle' WHEN 'machinery' THEN 'machine' WHEN 'building' THEN 'house' WHEN 'household' THEN 'house' ELSE 'other' END AS tissue_group FROM cells")
def clean_vocab(spark, d):
    vocabulary = spark.createDataFrame(VOCABULARY, "term string, group string")
    return clean_terms(roles.cells(spark, d).select("cell_id", "tissue"), "tissue", vocabulary, "tissue_group", "other")


@query(f"WITH {CELLS} SELECT cell_id, replace(replace(disease, '1-', 'one '), '-', ' ') AS disease FROM cells")
def harmonise_labels(spark, d):
    return roles.cells(spark, d).select("cell_id", harmonised(F.col("disease"), [("1-", "one "), ("-", " ")]).alias("disease"))


@query(f"WITH {CELLS} SELECT cell_id, disease FROM cells WHERE contains(disease, 'URGENT') OR contains(disease, 'SPEC')")
def keyword_filter(spark, d):
    return roles.cells(spark, d).where(has_keyword("disease", KEYWORDS)).select("cell_id", "disease")


@query("SELECT event_id, CASE WHEN event_type <> 'click' THEN event_type END AS kind FROM events WHERE (CASE WHEN event_type <> 'click' THEN event_type END) IS DISTINCT FROM 'view'")
def exclude_self_nullsafe(spark, d):
    rows = tables.load(spark, d, "events").select("event_id", F.when(F.col("event_type") != "click", F.col("event_type")).alias("kind"))
    return rows.where(qc.differs("kind", "view"))


@query(f"WITH {CELLS} SELECT cell_id, study, tissue FROM cells WHERE (study, tissue) NOT IN (SELECT n_name, 'BUILDING' FROM nation WHERE n_regionkey = 1)")
def exclude_pairs(spark, d):
    pairs = tables.load(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_name").alias("study"), F.lit("BUILDING").alias("tissue"))
    return qc.exclude(roles.cells(spark, d).select("cell_id", "study", "tissue"), pairs, "study", "tissue").select("cell_id", "study", "tissue")


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'")
def query_filter(spark, d):
    return tables.query(tables.load(spark, d, "orders"), 'o_totalprice > 200000 and o_orderstatus == "F" and o_orderpriority != "5-LOW"', ["o_orderkey", "o_totalprice", "o_orderpriority"])


@query(f"WITH {CELLS} SELECT cell_id, CASE WHEN data_type = 'F' THEN 'train' WHEN tissue = 'BUILDING' THEN 'test' ELSE 'NA' END AS data_type FROM cells")
def split_tag(spark, d):
    cells = roles.cells(spark, d)
    return training.split_tags(cells.select("cell_id"), cells.where("data_type = 'F'"), cells.where("tissue = 'BUILDING'"))


# Ontology


@query(f"WITH RECURSIVE {CLOSURE} SELECT ancestor, descendant, depth FROM pairs")
def closure(spark, d):
    return ontology.closure(roles.edges(spark, d))


@query(f"WITH {EDGES} SELECT parent AS node, child FROM edges")
def children(spark, d):
    return ontology.children(roles.edges(spark, d), roles.nodes(spark, d)).select("node", "child")


@query(f"WITH {EDGES} SELECT child AS node, parent FROM edges WHERE parent < 6")
def parents(spark, d):
    return ontology.parents(roles.edges(spark, d), roles.nodes(spark, d), roles.nodes(spark, d).where("node < 6"))


@query(f"WITH {EDGES} SELECT DISTINCT a.child AS node, b.child AS sibling FROM edges a JOIN edges b USING (parent) WHERE a.child <> b.child")
def siblings(spark, d):
    return ontology.siblings(roles.edges(spark, d), roles.nodes(spark, d))


@query(f"WITH RECURSIVE {CLOSURE} SELECT descendant AS node, ancestor FROM pairs UNION SELECT n_nationkey::INT, n_nationkey::INT FROM nation")
def ancestors(spark, d):
    return ontology.ancestors(ontology.closure(roles.edges(spark, d)), roles.nodes(spark, d), inclusive=True)


@query(f"WITH RECURSIVE {CLOSURE} SELECT ancestor AS node, descendant FROM pairs WHERE descendant < 12")
def descendants(spark, d):
    nodes = roles.nodes(spark, d)
    return ontology.descendants(ontology.closure(roles.edges(spark, d)), nodes, nodes.where("node < 12"))


@query(f"WITH RECURSIVE {CLOSURE} SELECT descendant AS node, ancestor AS related FROM pairs UNION SELECT ancestor, descendant FROM pairs")
def lineage(spark, d):
    return ontology.lineage(ontology.closure(roles.edges(spark, d)), roles.nodes(spark, d))


@query(f"WITH RECURSIVE {CLOSURE} SELECT a.descendant AS a, b.descendant AS b, count(*) AS similarity FROM pairs a JOIN pairs b USING (ancestor) WHERE a.descendant < b.descendant GROUP BY 1, 2")
def onto_similarity(spark, d):
    return ontology.similarities(ontology.closure(roles.edges(spark, d)), roles.nodes(spark, d))


@query(f"WITH RECURSIVE {CLOSURE} SELECT a.descendant AS a, b.descendant AS b, count(*) AS similarity FROM pairs a JOIN pairs b USING (ancestor) WHERE a.descendant < b.descendant AND ancestor > 1 GROUP BY 1, 2")
def onto_similarity_restricted(spark, d):
    """Terms so general that every pair shares them don't count."""
    nodes = roles.nodes(spark, d)
    return ontology.similarities(ontology.closure(roles.edges(spark, d)), nodes, nodes.where("node <= 1"))


@query(f"""WITH RECURSIVE {CLOSURE}, up AS (SELECT descendant AS node, ancestor AS c FROM pairs UNION SELECT n_nationkey::INT, n_nationkey::INT FROM nation),
    common AS (SELECT x.node AS a, y.node AS b, x.c FROM up x JOIN up y ON x.c = y.c AND x.node < y.node)
    SELECT a, b, min(c) AS lca FROM common k WHERE NOT EXISTS (SELECT 1 FROM common j JOIN pairs p ON p.descendant = j.c WHERE j.a = k.a AND j.b = k.b AND p.ancestor = k.c) GROUP BY 1, 2""")
def lca(spark, d):
    nodes = roles.nodes(spark, d)
    asked = nodes.select(F.col("node").alias("a")).join(nodes.select(F.col("node").alias("b")), F.col("a") < F.col("b"))
    return ontology.lowest_common_ancestors(ontology.closure(roles.edges(spark, d)), asked)


@query(f"""WITH RECURSIVE {CLOSURE}, ok AS (SELECT n_nationkey::INT AS node FROM nation WHERE n_nationkey IN (1, 2, 3, 5, 8)),
    good AS (SELECT child AS node, parent FROM edges WHERE parent IN (SELECT node FROM ok)), n AS (SELECT node, count(*) AS k, min(parent) AS one FROM good GROUP BY 1),
    deep AS (SELECT g.node, min(g.parent) AS deep FROM good g JOIN good h ON g.node = h.node JOIN pairs p ON p.descendant = g.parent AND p.ancestor = h.parent GROUP BY 1),
    e AS (SELECT child AS node, count(*) AS k, min(parent) AS only FROM edges GROUP BY 1)
    SELECT x.n_nationkey::INT AS node, CASE WHEN n.k = 1 THEN n.one WHEN n.k > 1 THEN deep.deep WHEN e.k = 1 AND m.k = 1 THEN m.one END AS parent
    FROM nation x LEFT JOIN n ON n.node = x.n_nationkey LEFT JOIN deep ON deep.node = x.n_nationkey LEFT JOIN e ON e.node = x.n_nationkey LEFT JOIN n m ON m.node = e.only""")
def viable_parent(spark, d):
    edges, nodes = roles.edges(spark, d), roles.nodes(spark, d)
    return ontology.most_viable_parent(edges, ontology.closure(edges), nodes, nodes.where("node in (1, 2, 3, 5, 8)"))


@query(f"WITH RECURSIVE {CLOSURE} (SELECT ancestor AS node FROM pairs WHERE descendant = 20 UNION SELECT descendant FROM pairs WHERE ancestor = 2) EXCEPT SELECT ancestor FROM pairs WHERE descendant = 9")
def set_algebra(spark, d):
    pairs = ontology.closure(roles.edges(spark, d))
    up = lambda n: pairs.where(F.col("descendant") == n).select(F.col("ancestor").alias("node"))
    down = pairs.where("ancestor = 2").select(F.col("descendant").alias("node"))
    return up(20).union(down).distinct().subtract(up(9))


# Training


@query(f"WITH {CELLS}, w AS (SELECT cell_id, 1 / ln(1 + count(*) OVER (PARTITION BY disease) / 1e4) / ln(1 + count(*) OVER (PARTITION BY study) / 1e6) AS weight FROM cells) SELECT cell_id, round(least(weight, (SELECT 2 * quantile_cont(weight, 0.999) FROM w)), 4) AS weight FROM w")
def sampling_weights(spark, d):
    rows = roles.cells(spark, d).select("cell_id", F.col("disease").alias("label"), "study")
    return rounded(training.sampler_weights(rows).select("cell_id", "weight"), weight=4)


@query(f"WITH {CELLS}, g AS (SELECT sample % 50 AS label FROM cells GROUP BY 1 HAVING count(DISTINCT study) >= 18) SELECT cell_id, sample % 50 AS label, study FROM cells WHERE sample % 50 IN (SELECT label FROM g)")
def support_filter(spark, d):
    rows = roles.cells(spark, d).select("cell_id", (F.col("sample") % 50).alias("label"), "study")
    return training.with_support(rows, 18).select("cell_id", "label", "study")


@query(f"WITH {CELLS} SELECT cell_id, study, sample FROM cells WHERE study IN (SELECT n_name FROM nation WHERE n_regionkey = 2) AND tissue IN (SELECT tissue FROM cells WHERE study NOT IN (SELECT n_name FROM nation WHERE n_regionkey = 2))")
def study_split(spark, d):
    studies = tables.load(spark, d, "nation").where("n_regionkey = 2").select(F.col("n_name").alias("study"))
    _, val = training.split(roles.cells(spark, d).withColumnRenamed("tissue", "label"), studies)
    return val.select("cell_id", "study", "sample")


@query(f"WITH {CELLS} SELECT DISTINCT disease AS label, (dense_rank() OVER (ORDER BY disease) - 1)::INT AS label_int FROM cells")
def label_encode(spark, d):
    return training.encoded_labels(roles.cells(spark, d).select(F.col("disease").alias("label")))


@query(f"WITH {CELLS} SELECT cell_id, n_name AS label, study FROM (SELECT cell_id, sample % 40 AS label, nullif(study, 'FRANCE') AS study FROM cells) JOIN nation ON label = n_nationkey WHERE study IS NOT NULL")
def label_names(spark, d):
    rows = roles.cells(spark, d).select("cell_id", (F.col("sample") % 40).cast("string").alias("label"), F.nullif("study", F.lit("FRANCE")).alias("study"))
    terms = tables.load(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("term_id"), F.col("n_name").alias("name"))
    return training.named_labels(rows, terms)


@query(f"WITH {CELLS} SELECT cell_id, study AS label FROM cells WHERE study IN (SELECT n_name FROM nation WHERE n_regionkey < 3)")
def valid_terms(spark, d):
    terms = tables.load(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("term_id"), F.col("n_name").alias("name"))
    return training.valid_labels(roles.cells(spark, d).select("cell_id", F.col("study").alias("label")), terms)


@query(f"WITH {COUNTS}, {GENES}, {TARGET}, {CELLS}, l AS (SELECT disease, (dense_rank() OVER (ORDER BY disease) - 1)::INT AS label_int FROM (SELECT DISTINCT disease FROM cells)), p AS (SELECT cell_id, t.gene_idx, sum(value) AS value FROM counts c JOIN genes g ON c.gene_idx = g.gene_idx JOIN target t USING (symbol) GROUP BY 1, 2), x AS (SELECT cell_id, gene_idx, ln(1 + 1e4 * value / sum(value) OVER (PARTITION BY cell_id)) AS x FROM p), k AS (SELECT cell_id, list(gene_idx ORDER BY gene_idx)::VARCHAR AS genes, round(sum(x::FLOAT::DOUBLE), 4) AS total FROM x GROUP BY 1) SELECT c.cell_id, label_int, study, coalesce(genes, '[]') AS genes, coalesce(total, 0) AS total FROM cells c JOIN l USING (disease) LEFT JOIN k USING (cell_id)")
def collate(spark, d):
    cells = roles.cells(spark, d).select("cell_id", F.col("disease").alias("label"), "study")
    symbols = matrix.consolidate(roles.lines(spark, d), roles.genes(spark, d))
    out = training.collated(cells, symbols, _target(spark, d), training.encoded_labels(cells))
    total = F.aggregate(F.col("val").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    genes = F.concat(F.lit("["), F.array_join(F.col("idx").cast("array<string>"), ", "), F.lit("]"))
    return rounded(out.select("cell_id", "label_int", "study", genes.alias("genes"), total.alias("total")), total=4)


@query(
    f"WITH {CELLS}, {EDGES}, rows AS (SELECT cell_id, sample % 25 AS label, study, row_number() OVER (ORDER BY cell_id) - 1 AS pos FROM cells), n AS (SELECT count(*) AS n FROM rows), "
    "drawn AS (SELECT DISTINCT floor((('0x' || substr(md5(i || ':3'), 1, 13))::BIGINT + 0.5) / 4503599627370496 * n)::BIGINT AS pos FROM n, range((SELECT floor(0.3 * n)::BIGINT FROM n)) t(i)), "
    "chosen AS (SELECT pos, arg_min(parent, md5(cell_id || ':' || parent || ':3') || parent) AS parent FROM rows JOIN drawn USING (pos) JOIN edges ON child = label WHERE parent IN (SELECT label FROM rows) GROUP BY 1) "
    "SELECT cell_id, coalesce(parent, label)::INT AS label, study FROM rows LEFT JOIN chosen USING (pos)"
)
def perturbed_labels(spark, d):
    rows = roles.cells(spark, d).select("cell_id", (F.col("sample") % 25).cast("int").alias("label"), "study")
    return training.perturbed(rows, roles.edges(spark, d), "cell_id", 0.3, seed=3)


@query("SELECT round(avg(l_tax), 8) AS asw, round(avg((l_quantity - l_extendedprice) ** 2) / avg(l_quantity ** 2), 4) AS nmse, round((1 - avg(l_tax)) / 2 + avg((l_quantity - l_extendedprice) ** 2) / avg(l_quantity ** 2), 4) AS metric FROM lineitem")
def mixed_metric(spark, d):
    lines = tables.load(spark, d, "lineitem")
    rebuilt = lines.select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return rounded(training.mixed_metric(lines.select(F.col("l_tax").alias("width")), rebuilt), asw=8, nmse=4, metric=4)


def _sample_sql(size: int, batches: int, decay: float, floor: float) -> str:
    """One batch after another, as the sampler is defined."""
    hashed = "(('0x' || substr(md5(cell_id || ':' || {seed}), 1, 13))::BIGINT + 0.5) / 4503599627370496"
    parts = [
        f"WITH {CELLS}, n AS (SELECT cell_id, 1 / ln(1 + count(*) OVER (PARTITION BY disease) / 1e4) / ln(1 + count(*) OVER (PARTITION BY study) / 1e6) AS w FROM cells)",
        "w0 AS (SELECT cell_id, least(w, 2 * (SELECT quantile_cont(w, 0.999) FROM n)) AS w FROM n)",
    ]
    for b in range(batches):
        parts.append(f"b{b} AS (SELECT {b} AS batch, cell_id FROM (SELECT cell_id, row_number() OVER (ORDER BY -ln({hashed.format(seed=1 + b)}) / w, cell_id) AS r FROM w{b}) WHERE r <= {size})")
        parts.append(f"w{b + 1} AS (SELECT w.cell_id, CASE WHEN b.cell_id IS NULL THEN w ELSE least(w, greatest(w * {decay}, {floor})) END AS w FROM w{b} w LEFT JOIN b{b} b USING (cell_id))")
    return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT * FROM b{b}" for b in range(batches))


@query(_sample_sql(100, 3, 0.5, 0.01))
def weighted_sample(spark, d):
    rows = roles.cells(spark, d).select("cell_id", F.col("disease").alias("label"), "study")
    return training.weighted_batches(training.sampler_weights(rows), "cell_id", 100, 3, seed=1, decay=0.5).select("batch", "cell_id")


BATCH = f"{VECTORS}, b AS (SELECT id // 1000 AS batch, id, label, id % 3 AS study, vector FROM vectors)"
SQUARED = "list_sum(list_transform(range(1, 65), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"


def _batches(spark, d):
    return roles.vectors(spark, d).select(F.expr("id div 1000").alias("batch"), "id", "label", (F.col("id") % 3).alias("study"), "vector")


@query(f"WITH {BATCH} SELECT x.batch, x.id AS a, y.id AS b, round({SQUARED.format(a='x.vector', b='y.vector')}, 6) AS dist2 FROM b x JOIN b y ON x.batch = y.batch AND x.id < y.id")
def pdist(spark, d):
    return rounded(training.pair_distances(_batches(spark, d)), dist2=6)


@query(f"""WITH {BATCH}, p AS (SELECT x.batch, x.id AS anchor, y.id AS positive, {SQUARED.format(a='x.vector', b='y.vector')} AS ap FROM b x JOIN b y ON x.batch = y.batch AND x.label = y.label AND x.id < y.id AND x.study <> y.study),
    n AS (SELECT x.id AS anchor, y.id AS negative, {SQUARED.format(a='x.vector', b='y.vector')} AS an FROM b x JOIN b y ON x.batch = y.batch AND x.label <> y.label),
    m AS (SELECT anchor, negative, an FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY an, negative) AS k FROM n) WHERE k = 1)
    SELECT batch, anchor, positive, negative, round(ap - an + 0.05, 6) AS loss FROM p JOIN m USING (anchor) WHERE ap - an + 0.05 > 0""")
def triplets_hard(spark, d):
    return rounded(training.triplets(_batches(spark, d)), loss=6)


SUMS = f"{DISTANCES}, sums AS (SELECT query_id AS id, v.label, d.label AS other, sum(dist) AS total, count(*) AS n FROM distances d JOIN vectors v ON v.id = d.query_id WHERE query_id <> d.id GROUP BY ALL)"
WIDTH = "SELECT id, label, round(intra, 5) AS intra, round(inter, 5) AS inter, round((inter - intra) / greatest(intra, inter), 4) AS width FROM s WHERE k > 1 AND inter IS NOT NULL"


def _widths(spark, d, **ties):
    out = training.silhouette(neighbours.distance_sums(roles.vectors(spark, d)), **ties)
    return rounded(out, intra=5, inter=5, width=4)


@query(f"WITH {SUMS}, s AS (SELECT id, label, sum(total) FILTER (other = label) / (sum(n) FILTER (other = label) - 1) AS intra, sum(n) FILTER (other = label) AS k, min(total / n) FILTER (other <> label AND n > 1) AS inter FROM sums GROUP BY 1, 2) {WIDTH}")
def silhouette(spark, d):
    return _widths(spark, d)


@query(f"""WITH RECURSIVE {CLOSURE}, {SUMS}, t AS (SELECT s.*, s.label = s.other OR EXISTS (SELECT 1 FROM pairs p WHERE p.ancestor = s.label AND p.descendant = s.other) AS own FROM sums s WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.ancestor = s.other AND p.descendant = s.label)),
    s AS (SELECT id, label, sum(total) FILTER (own) / (sum(n) FILTER (own) - 1) AS intra, sum(n) FILTER (own) AS k, min(total / n) FILTER (NOT own AND n > 1) AS inter FROM t GROUP BY 1, 2) {WIDTH}""")
def silhouette_onto(spark, d):
    pairs = ontology.closure(roles.edges(spark, d))
    below = pairs.select(F.col("ancestor").alias("node"), F.col("descendant").alias("related"))
    above = pairs.select(F.col("descendant").alias("node"), F.col("ancestor").alias("related"))
    return _widths(spark, d, descendants=below, ancestors=above)


@query(f"WITH {VECTORS}, p AS (SELECT x.id, x.label, y.label AS other, sum({SQUARED.format(a='x.vector', b='y.vector')}) AS total, count(*) AS n FROM vectors x JOIN vectors y ON x.id <> y.id GROUP BY ALL), s AS (SELECT id, label, sum(total) FILTER (other = label) / (sum(n) FILTER (other = label) - 1) AS intra, sum(n) FILTER (other = label) AS k, min(total / n) FILTER (other <> label AND n > 1) AS inter FROM p GROUP BY 1, 2) SELECT round(avg((inter - intra) / greatest(intra, inter)), 5) AS asw FROM s WHERE k > 1 AND inter IS NOT NULL")
def average_width(spark, d):
    return spark.createDataFrame([(round(training.average_width(roles.vectors(spark, d)), 5),)], "asw double")


@query(f"WITH {COUNTS} SELECT gene_idx, round(avg(value), 6) AS attribution, round(stddev_pop(value), 6) AS std, count(*) AS cells, round(1.96 * stddev_pop(value) / sqrt(count(*)), 6) AS half_width FROM counts GROUP BY 1 ORDER BY avg(value) DESC, gene_idx LIMIT 25")
def top_genes(spark, d):
    return rounded(training.ranked_genes(roles.counts(spark, d), 25), attribution=6, std=6, half_width=6)


@query(f"WITH {COUNTS} SELECT gene_idx, round(avg(value), 6) AS attribution, round(stddev_pop(value), 6) AS std, count(*) AS cells, round(1.96 * stddev_pop(value) / sqrt(count(*)), 6) AS half_width FROM counts GROUP BY 1")
def rank_genes(spark, d):
    return rounded(training.ranked_genes(roles.counts(spark, d)), attribution=6, std=6, half_width=6)


@query(f"WITH {COUNTS}, {GENES}, {CELLS}, pick AS (SELECT study, arg_max(cell_id, price) AS cell_id FROM cells GROUP BY 1) SELECT symbol, count(DISTINCT study) AS studies FROM counts JOIN pick USING (cell_id) JOIN genes USING (gene_idx) GROUP BY 1 HAVING count(DISTINCT study) >= 2")
def genes_by_support(spark, d):
    chosen = training.chosen_samples(roles.cells(spark, d).select("study", "cell_id", "price"), "price")
    rows = roles.counts(spark, d).join(chosen, "cell_id").join(roles.genes(spark, d), "gene_idx")
    return training.gene_studies(rows.select("study", "symbol"), 2)


# Event time


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def event_tumbling(spark, d):
    return rounded(events.tumbling(tables.load(spark, d, "events"), "1 hour", ["event_type"]), value=4)


@query("SELECT s AS start, s + INTERVAL '2 hours' AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS value FROM (SELECT *, unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS s FROM events) GROUP BY ALL")
def event_sliding(spark, d):
    return rounded(events.sliding(tables.load(spark, d, "events"), "2 hours", "1 hour", ["event_type"]), value=4)


@query("WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL '6 hours' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts) AS start, max(ts) + INTERVAL '6 hours' AS \"end\", user_id, count(*) AS n, round(sum(value), 4) AS value FROM s GROUP BY user_id, k")
def event_session(spark, d):
    return rounded(events.sessions(tables.load(spark, d, "events"), "6 hours", ["user_id"]), value=4)
