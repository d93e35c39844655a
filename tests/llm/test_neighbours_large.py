"""Recall over tables of more vectors than the trial looks at, with clusters and without."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("panelplan.llm")

from panelplan.llm import neighbours


@pytest.mark.parametrize("clusters", [200, 0])
def test_recall_over_forty_thousand_vectors(spark, clusters):
    rng = np.random.default_rng(clusters)
    n, dims = 40_000, 24
    data = rng.normal(size=(n, dims))
    if clusters:
        data = 0.3 * data + rng.normal(size=(clusters, dims))[rng.integers(clusters, size=n)]
    vectors = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(n)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(data.reshape(-1)), dims).cast(pa.list_(pa.float64()))})).repartition(8)
    got: dict = {}
    for r in neighbours.nearest_neighbours(vectors, F.col("id") % 200 == 0).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hit = 0
    for q in range(0, n, 200):
        d = ((data - data[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hit += len(set(np.argpartition(d, 9)[:10].tolist()) & set(got[q]))
        assert len(got[q]) == 10
    assert hit / (10 * (n // 200)) >= 0.9
