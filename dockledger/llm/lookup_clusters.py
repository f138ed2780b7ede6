"""Centroid clustering by scalar lookup tables.

Vectors become integers, and are stored in blocks: for each dimension the integers that occur in the block, and for each
vector which of them it has. A round tabulates, for each dimension, the squared difference of every occurring integer to
every centroid; the distances of a block are then gathers from these tables and sums, all in integers.

Defined results: vectors of another length, null vectors and vectors with a null or non-finite component are left out; a
null id counts as an empty text where ids are hashed and stays in the result; repeated rows are vectors of their own; with
fewer vectors than centroids there are as many centroids as vectors; an empty table gives an empty result. Only the two
named columns are read, so others may have any name. A component beyond `LARGEST` after scaling raises an error, since
squared distances would no longer fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockledger.llm.common import stored

#: Vectors of a block: bounds the tables of a dimension to BLOCK times centroids, whatever the vectors hold.
BLOCK = 4096
#: Twice this, squared, times 64 dimensions is below 2^63.
LARGEST = 1 << 27


def integers(vectors: DataFrame, id_column: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(id, q): the vectors of `dims` finite components, each component x as floor(scale * x)."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.select(F.col(id_column).alias("id"), v.cast("array<double>").alias(vector))
    q = F.transform(v, lambda x: F.floor(F.when(F.abs(x * scale) <= LARGEST, x * scale).otherwise(F.raise_error(F.lit("component out of range")))))
    return kept.where(F.coalesce((F.size(v) == dims) & finite, F.lit(False))).select("id", q.alias("q"))


def first_centroids(q: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors with the least sha256 of the salt and the id; equal ids in the order of their components."""
    key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [list(r.q) for r in q.orderBy(key, "q").limit(k).collect()]


def blocks(q: DataFrame, dims: int) -> DataFrame:
    """One row a block: ids, the occurring integers of all dimensions, where each dimension starts, positions in them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                rows = np.asarray(part.column(1).flatten()).reshape(-1, dims)
                found = [np.unique(rows[:, d], return_inverse=True) for d in range(dims)]
                starts = np.cumsum([0, *(len(u) for u, _ in found)])
                codes = np.concatenate([c.astype(np.uint16) for _, c in found]).tobytes()
                columns = [pa.array([x], t) for x, t in ((part.column(0).to_pylist(), pa.list_(part.schema.field(0).type)), (np.concatenate([u for u, _ in found]), pa.list_(pa.int64())), (starts, pa.list_(pa.int64())), (codes, pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["ids", "occurring", "starts", "codes"])

    kind = q.schema["id"].dataType.simpleString()
    return q.mapInArrow(pack, f"ids array<{kind}>, occurring array<bigint>, starts array<bigint>, codes binary")


def nearest(occurring: np.ndarray, starts: np.ndarray, codes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each vector of a block (the smaller number of equals) and its squared distance."""
    wide = int(np.abs(occurring).max()) + int(np.abs(centroids).max())
    kind = np.int32 if wide * wide * len(codes) < 1 << 31 else np.int64
    total = np.zeros((codes.shape[1], len(centroids)), kind)
    for d in range(len(codes)):
        table = (occurring[starts[d] : starts[d + 1], None] - centroids[None, :, d]).astype(kind)
        total += np.take(table * table, codes[d], axis=0)
    cluster = total.argmin(axis=1)
    return cluster, np.take_along_axis(total, cluster[:, None], axis=1)[:, 0].astype(np.int64)


def _blocks_of(batches: Iterator[pa.RecordBatch], dims: int):
    for batch in batches:
        for ids, occurring, starts, codes in zip(*(batch.column(i) for i in range(4))):
            yield ids, np.asarray(occurring.values), np.asarray(starts.values), np.frombuffer(codes.as_py(), np.uint16).reshape(dims, -1)


def totals(packed: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, int, list[int]]]:
    """For each non-empty cluster: its vectors, their distances summed, and their components summed."""
    dims, k = len(centroids[0]), len(centroids)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, inertia, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        table = np.array(centroids, np.int64)
        for _, occurring, starts, codes in _blocks_of(batches, dims):
            cluster, distance = nearest(occurring, starts, codes, table)
            count += np.bincount(cluster, minlength=k)
            np.add.at(inertia, cluster, distance)
            for d in range(dims):  # exact: a block's sums are below 2^53
                x = occurring[starts[d] : starts[d + 1]][codes[d]]
                sums[:, d] += np.bincount(cluster, weights=x, minlength=k).astype(np.int64)
        used = np.flatnonzero(count)
        columns = [pa.array(used, pa.int64()), pa.array(count[used]), pa.array(inertia[used])]
        columns += [pa.array(sums[used, d]) for d in range(dims)]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "inertia", *(f"s{d}" for d in range(dims))])

    names = ["n", "inertia", *(f"s{d}" for d in range(dims))]
    parts = packed.mapInArrow(partial, ", ".join(f"{c} bigint" for c in ["cluster", *names]))
    rows = parts.groupBy("cluster").agg(*(F.sum(c).alias(c) for c in names)).collect()  # one row a cluster
    return {r.cluster: (r.n, r.inertia, list(r[3:])) for r in rows}


def cluster(vectors: DataFrame, id_column: str, vector: str, *, k: int, rounds: int, dims: int, scale: int, salt: str) -> DataFrame:
    """Each vector's cluster, squared distance, the inertia of its cluster and of all, and its centroid's components.

    Columns: id, cluster, distance, cluster_inertia, inertia, centroid (array of long). A round assigns every vector to
    the nearest centroid, then moves each non-empty centroid to the floor of its vectors' mean. The driver holds the
    centroids only.
    """
    q = integers(vectors, id_column, vector, dims, scale)
    kind = q.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("cluster", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("distance", "cluster_inertia", "inertia")), T.StructField("centroid", T.ArrayType(T.LongType()))])
    centroids = first_centroids(q, k, salt)
    if not centroids:
        return vectors.sparkSession.createDataFrame([], schema)
    packed = stored(blocks(q, dims), "vector-blocks")
    for _ in range(rounds):
        for c, (n, _, sums) in totals(packed, centroids).items():
            centroids[c] = [s // n for s in sums]
    inertia = {c: x for c, (_, x, _) in totals(packed, centroids).items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, of_cluster = np.array(centroids, np.int64), np.array([inertia.get(c, 0) for c in range(len(centroids))], np.int64)
        for ids, occurring, starts, codes in _blocks_of(batches, dims):
            found, distance = nearest(occurring, starts, codes, table)
            centroid = pa.array(centroids, pa.list_(pa.int64())).take(pa.array(found))
            columns = [ids.values, pa.array(found, pa.int32()), distance, of_cluster[found], np.full(len(found), sum(inertia.values())), centroid]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], schema.names)

    return packed.mapInArrow(assign, schema)


def oracle_sql(k: int, rounds: int, dims: int, scale: int, salt: str) -> str:
    """The same in DuckDB SQL, one common table expression a step, over table embeddings (vec_id, embedding)."""
    steps = [f"""
rows0 AS (SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings WHERE len(embedding) = {dims}),
long0 AS (SELECT r, unnest(e)::DOUBLE AS x, generate_subscripts(e, 1) AS d FROM rows0),
good AS MATERIALIZED (SELECT r FROM long0 GROUP BY r HAVING count(x) = {dims} AND bool_and(isfinite(x))),
q AS MATERIALIZED (SELECT r, d, floor({scale} * x)::BIGINT AS v FROM long0 SEMI JOIN good USING (r)),
start AS (SELECT r, row_number() OVER (ORDER BY sha256('{salt}' || coalesce(vec_id::VARCHAR, '')), list(v ORDER BY d)) - 1 AS c FROM rows0 JOIN q USING (r) GROUP BY r, vec_id),
c0 AS MATERIALIZED (SELECT c, d, v FROM start JOIN q USING (r) WHERE c < {k})"""]  # fmt: skip
    for i in range(rounds + 1):
        steps.append(f"""
d{i} AS (SELECT q.r, t.c, sum((q.v - t.v) * (q.v - t.v))::BIGINT AS distance FROM q JOIN c{i} t USING (d) GROUP BY q.r, t.c),
a{i} AS MATERIALIZED (SELECT r, arg_min(c, (distance, c)) AS c, min(distance) AS distance FROM d{i} GROUP BY r)""")
        if i < rounds:
            steps.append(f"""
m{i} AS (SELECT a{i}.c, q.d, sum(q.v)::BIGINT AS s, count(*) AS n FROM q JOIN a{i} USING (r) GROUP BY a{i}.c, q.d),
c{i + 1} AS MATERIALIZED (SELECT t.c, t.d, coalesce((s - ((s % n) + n) % n) // n, t.v) AS v FROM c{i} t LEFT JOIN m{i} m ON m.c = t.c AND m.d = t.d)""")
    return "WITH " + ",".join(steps) + f""",
final AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY c)
SELECT rows0.vec_id, a.c::INTEGER AS cluster, a.distance, sum(a.distance) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia,
  sum(a.distance) OVER ()::BIGINT AS inertia, final.h AS centroid_sha256
FROM a{rounds} a JOIN rows0 USING (r) JOIN final USING (c)"""
