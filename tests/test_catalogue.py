"""Every query with SQL gives the SQL's rows; the others keep what their docstrings say."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from kindred.plans.catalogue import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, pd.Timestamp | bool | str):
        return x
    return round(float(x), 4) + 0.0


def rows(df: pd.DataFrame) -> list:
    return sorted((tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sql, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), sql.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-6, abs_tol=2e-4)) for p, q in zip(x, y, strict=True)), (x, y)


def test_inverted_file_recall(spark):
    exact, near = (QUERIES[n](spark, DATA).select("query_id", "id").toPandas() for n in ("knn_topk", "knn_inverted_file"))
    found = set(map(tuple, near.to_numpy())) & set(map(tuple, exact.to_numpy()))
    assert len(found) >= 0.9 * len(exact)


def test_graph_recall(spark):
    exact, near = (QUERIES[n](spark, DATA).select("query_id", "id").toPandas() for n in ("knn_topk", "knn_graph"))
    found = set(map(tuple, near.to_numpy())) & set(map(tuple, exact.to_numpy()))
    assert len(near) == len(exact) and len(found) >= 0.95 * len(exact)


def test_coherence_is_bounded(spark):
    assert 0 < QUERIES["query_coherence"](spark, DATA).first()[0] <= 100


def test_weighted_sample_repeats(spark):
    first, again = (sorted(map(tuple, QUERIES["weighted_sample"](spark, DATA).collect())) for _ in range(2))
    assert first == again and len(first) == 300
    assert all(len({c for b, c in first if b == k}) == 100 for k in range(3))


def test_embeddings_are_unit(spark):
    found = QUERIES["embed_cells"](spark, DATA).toPandas()["vector"]
    assert np.allclose([np.linalg.norm(v) for v in found], 1, atol=1e-3)


def test_attributions_are_ranked(spark):
    found = QUERIES["attribute_genes"](spark, DATA).toPandas()
    assert len(found) and (found["attribution"] >= 0).all()


def test_centroid_coherence_is_bounded(spark):
    assert 0 < QUERIES["centroid_coherence"](spark, DATA).first()[0] <= 100


def test_perturbed_labels_are_parents_or_the_same(spark):
    found = QUERIES["perturbed_labels"](spark, DATA).toPandas()
    assert len(found) and found["label"].between(0, 24).all()
