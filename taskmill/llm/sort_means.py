"""Centroid clustering of whole-number vectors by sort-means."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskmill.llm.common import drop_written, written

#: Components beyond it are refused: squared distances of 64 of them then fit a long.
MOST = 1 << 27
CLUSTERS, ROUNDS, SEED = 40, 5, "2"


def _distances(rows: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    gap = rows - centroid
    return np.einsum("ij,ij->i", gap, gap)


def assign(rows: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) of each row; ties go to the smaller number.

    before has the centroid of each row in the last round. From it the other centroids are
    scanned in the order of their distance from it, and the scan ends where that is strictly
    beyond twice the row's distance: by the triangle inequality those are all farther. Rows
    are taken farthest first, so that those still scanning are always the first ones.
    """
    nearest, least = before.copy(), np.zeros(len(rows), np.int64)
    for c in np.unique(before):
        at = np.flatnonzero(before == c)
        own = _distances(rows[at], centroids[c])
        by = np.argsort(-own, kind="stable")
        at, own = at[by], own[by]
        block, best, found = rows[at], own.copy(), np.full(len(at), c)
        apart = _distances(centroids, centroids[c])
        reach = -4 * own
        for j in np.argsort(apart, kind="stable"):
            active = int(np.searchsorted(reach, -apart[j], side="right"))  # apart <= 4 * own, squared
            if not active:
                break
            if j == c:
                continue
            there = _distances(block[:active], centroids[j])
            better = (there < best[:active]) | ((there == best[:active]) & (j < found[:active]))
            best[:active][better], found[:active][better] = there[better], j
        nearest[at], least[at] = found, best
    return nearest, least


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.int64, copy=False)


def _round(centroids: list[list[int]], last: bool):
    """Rows with their new cluster, then the sums of this task: a row for each cluster, whose
    `members` isn't null."""

    def run(batches):
        centre = np.array(centroids, np.int64)
        members = np.zeros(len(centre), np.int64)
        sums = [[0] * (1 if last else centre.shape[1]) for _ in centre]
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column("vector"))
            near, far = assign(rows, batch.column("cluster").to_numpy().astype(np.int64), centre)
            for c in np.unique(near):
                mine = near == c
                members[c] += int(mine.sum())
                part = [sum(far[mine].tolist())] if last else rows[mine].sum(axis=0).tolist()
                sums[c] = [a + b for a, b in zip(sums[c], part, strict=True)]
            empty = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *([] if last else [batch.column("vector")]), pa.array(near, pa.int32()), pa.array(far, pa.int64()), empty, pa.nulls(len(rows), pa.list_(pa.string()))],
                ["id", *([] if last else ["vector"]), "cluster", "distance", "members", "sums"],
            )
        if members.any():
            some = np.flatnonzero(members)
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, *([] if last else [pa.nulls(len(some), pa.list_(pa.int64()))]), pa.array(some, pa.int32()), none, pa.array(members[some], pa.int64()), pa.array([[str(x) for x in sums[c]] for c in some], pa.list_(pa.string()))],
                ["id", *([] if last else ["vector"]), "cluster", "distance", "members", "sums"],
            )

    return run


def _totals(table: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """members and sums of each cluster: at most a row for each centroid comes to the driver."""
    rows = table.filter("members IS NOT NULL").select("cluster", "members", F.posexplode("sums").alias("place", "part"))
    added = rows.groupBy("cluster", "place").agg(F.sum("members").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    out: dict[int, tuple[int, list[int]]] = {}
    for cluster, group in _by_cluster(added.collect()).items():
        out[cluster] = int(group[0]["n"]), [int(r["total"]) for r in group]
    return out


def _by_cluster(rows) -> dict:
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r["cluster"], r["place"])):
        out.setdefault(r["cluster"], []).append(r)
    return out


def whole_vectors(df: DataFrame, vector: str = "embedding", size: int = 64, scale: int = 256) -> DataFrame:
    """id, vector: floor(scale * x) of each component, for the vectors of `size` components of
    which none is null, not finite or beyond MOST once scaled. Others take no part."""
    made = F.transform(df[vector], lambda x: F.floor(x.cast("double") * scale))
    fit = F.forall(df[vector], lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < MOST) & ~F.isnan(x))
    return df.filter((F.size(df[vector]) == size) & F.coalesce(fit, F.lit(False))).select(df["vec_id"].cast("long").alias("id"), made.cast("array<bigint>").alias("vector"))


def sort_means(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every (id, vector).

    The vectors with the smallest sha256 of `seed:id` are the first centroids (fewer than
    `clusters` if there are fewer; equal ids in order of their vectors; a vector without an id
    can't begin a cluster). Each round is one pass that reads the last round's table, with the
    clusters found then, and writes the next one, with the sums of each task in its last rows.
    Only centroids are kept on the driver. No vectors, or none with an id: no rows.
    """
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    state = written(vectors.select("id", "vector", F.lit(0).alias("cluster"), F.lit(None).cast("long").alias("distance"), F.lit(None).cast("long").alias("members"), F.lit(None).cast("array<string>").alias("sums")), "vectors")
    first = state.filter("id IS NOT NULL").orderBy(order, "vector").limit(clusters).select("vector").collect()
    centroids = [list(r["vector"]) for r in first]
    kind = T.StructType([T.StructField(f.name, f.dataType) for f in state.schema])
    final = T.StructType([f for f in kind if f.name != "vector"])
    if not centroids:
        return state.limit(0).select("id", "cluster", "distance", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    for i in range(rounds):
        new = written(state.filter("members IS NULL").mapInArrow(_round(centroids, False), kind), f"vectors-{i}")
        drop_written(state)
        state = new
        for c, (n, total) in _totals(state).items():
            centroids[c] = [x // n for x in total]
    done = written(state.filter("members IS NULL").mapInArrow(_round(centroids, True), final), "clusters")
    drop_written(state)
    inertia = {c: total[0] for c, (_, total) in _totals(done).items()}
    told = [(c, x, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, x in inertia.items()]
    known = vectors.sparkSession.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # At most a row for each centroid, so that it can be broadcast.
    return done.filter("members IS NULL").select("id", "cluster", "distance").join(F.broadcast(known), "cluster")


def cluster_table(df: DataFrame) -> DataFrame:
    """sort_means() over the whole table of embeddings."""
    out = sort_means(whole_vectors(df))
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
