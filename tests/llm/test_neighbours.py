"""Neighbours of unit vectors stay whole when one vector is many times as long."""

import numpy as np
import pytest

from tidemark.llm import ann


@pytest.mark.parametrize("norm", [1.0, 5.0, 10.0])
def test_one_long_vector_costs_no_neighbours(spark, norm):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[7] *= norm
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, "vec_id % 100 = 0", k=20, shard=1000).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q in range(0, 3000, 100):
        score = x @ x[q]
        score[q] = -np.inf
        assert got[q] == set(np.argsort(-score)[:20].tolist())
