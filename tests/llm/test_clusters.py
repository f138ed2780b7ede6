import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from compare import connect, duck_rows, spark_rows
from dockledger.llm import lookup_clusters
from dockledger.llm.queries import ORACLE, op11_lookup_clusters

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), *(T.StructField(c, T.StringType()) for c in ("id", "q", "CLUSTER", "distance"))])


def brute(rows, k, rounds, dims, scale, salt):
    """The contract in plain Python: (vec_id, cluster, distance) with the centroids."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{salt}{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    for r in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]
        if r < rounds:
            for n in range(len(centroids)):
                of = [v for (_, v), (_, c) in zip(kept, found) if c == n]
                if of:
                    centroids[n] = [sum(x) // len(of) for x in zip(*of)]
    return [(i, c, d, centroids[c]) for (i, _), (d, c) in zip(kept, found)]


def odd_vectors(dims):
    rng = random.Random(3)
    vector = lambda: [rng.choice([-1.5, -0.25, 0.0, 0.1, 0.3, 2.0]) + rng.random() / 9 for _ in range(dims)]
    rows = [(i, vector()) for i in range(60)]
    hot = vector()
    rows += [(100 + i, hot) for i in range(40)]  # copies: ties of distance and empty clusters
    rows += [rows[0], rows[0], (None, vector()), (None, None), (200, None), (201, []), (202, [0.5] * (dims - 1)), (203, [0.5] * (dims + 1))]
    rows += [(204 + i, [x, *[0.5] * (dims - 1)]) for i, x in enumerate([None, float("nan"), float("inf"), float("-inf"), 1e30])]
    return rows[:-1], rows[-1]


@pytest.mark.parametrize("k", [3, 40, 500])
def test_clusters_equal_brute_force_on_odd_rows(spark, k):
    rows, _ = odd_vectors(5)
    df = spark.createDataFrame([(*r, *"wxyz") for r in rows], SCHEMA).repartition(4)
    out = lookup_clusters.cluster(df, "vec_id", "embedding", k=k, rounds=3, dims=5, scale=256, salt="2:").collect()
    singles = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = brute(singles, k, 3, 5, 256, "2:")
    assert sorted((str(r.id), r.cluster, r.distance, r.centroid) for r in out) == sorted((str(i), c, d, v) for i, c, d, v in want)
    for r in out:
        assert r.cluster_inertia == sum(d for _, c, d, _ in want if c == r.cluster)
        assert r.inertia == sum(d for _, _, d, _ in want)


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    rows, _ = odd_vectors(5)
    df = spark.createDataFrame([(*r, *"wxyz") for r in rows], SCHEMA)
    run = lambda: sorted(map(str, lookup_clusters.cluster(df, "vec_id", "embedding", k=7, rounds=4, dims=5, scale=256, salt="2:").collect()))
    whole = run()
    monkeypatch.setattr(lookup_clusters, "BLOCK", 3)
    assert run() == whole


def test_component_out_of_range_is_an_error(spark):
    _, huge = odd_vectors(5)
    df = spark.createDataFrame([(*huge, *"wxyz")], SCHEMA)
    with pytest.raises(Exception, match="component out of range"):
        lookup_clusters.cluster(df, "vec_id", "embedding", k=2, rounds=1, dims=5, scale=256, salt="2:").collect()


def test_no_vectors(spark):
    for rows in ([], [(1, None, *"wxyz"), (2, [1.0], *"wxyz")]):
        out = lookup_clusters.cluster(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", k=2, rounds=2, dims=5, scale=256, salt="2:")
        assert out.count() == 0 and out.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert spark_rows(op11_lookup_clusters(spark, sf)) == duck_rows(connect(sf), ORACLE["op11_lookup_clusters"])
