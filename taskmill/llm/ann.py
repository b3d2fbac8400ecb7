"""Nearest neighbours by stable projections, kd-trees and a chi-square stopping test."""

from __future__ import annotations

import heapq
import io
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from taskmill.llm.common import MOST_TASKS, new_path, open_fs, written

DIMENSIONS, CONFIDENCE, LEAF = 20, 0.9, 256
#: Vectors in one stored tree, and visits of queries to it that one task makes.
SHARD, QUERY_BLOCK = 20_000, 100
#: Rows, by expectation, from which the cells of the index are fitted; cells for each length of vectors.
SAMPLE, MOST_CELLS = 20_000, 4096


def chi_square(x: float, m: int) -> float:
    """The distribution function of chi-square with an even number m of degrees."""
    h = x / 2
    return 1.0 if h > 700 else 1 - exp(-h) * sum(h**i / factorial(i) for i in range(m // 2))


def chi_square_point(p: float, m: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, m) < p else (lo, mid)
    return hi


def projection(d: int, m: int, seed: int = 7) -> np.ndarray:
    """d x m normal numbers, which are 2-stable: a projected squared distance is the true one
    times a chi-square number with m degrees. Where m columns can be, they are made orthogonal
    and equally long, which leaves each column's law and narrows that of the sum."""
    a = np.random.default_rng([seed, d, m]).standard_normal((d, m))
    return np.linalg.qr(a)[0] * np.sqrt(d) if m < d else a


def boxes_apart(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Least squared distance of a point from each box."""
    gap = np.maximum(0, np.maximum(low - q, q - high))
    return np.einsum("ij,ij->i", gap, gap)


class KdTree:
    """A balanced kd-tree over projected rows, which it holds in the order of its leaves."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        low, high, span, child = [], [], [], []

        def build(lo: int, hi: int) -> int:
            rows, node = points[self.order[lo:hi]], len(low)
            low.append(rows.min(0))
            high.append(rows.max(0))
            span.append((lo, hi))
            child.append((-1, -1))
            wide = high[node] - low[node]
            if hi - lo > leaf and (wide > 0).any():
                mid = (hi - lo) // 2
                self.order[lo:hi] = self.order[lo:hi][np.argpartition(rows[:, int(np.argmax(wide))], mid)]
                child[node] = (build(lo, lo + mid), build(lo + mid, hi))
            return node

        build(0, len(points))
        self.low, self.high, self.span, self.child = np.array(low), np.array(high), np.array(span), np.array(child)
        self.points = points[self.order]

    def incremental(self, q: np.ndarray):
        """Yield (least squared projected distance of all that follow, place of a leaf's first row,
        squared projected distances of its rows), nearest leaf first."""
        heap = [(0.0, 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            kids = self.child[node]
            if kids[0] < 0:
                lo, hi = self.span[node]
                gap = self.points[lo:hi] - q
                yield bound, lo, np.einsum("ij,ij->i", gap, gap)
            else:
                for k, b in zip(kids.tolist(), boxes_apart(self.low[kids], self.high[kids], q).tolist(), strict=True):
                    heapq.heappush(heap, (b, k))

    def dump(self, vectors: np.ndarray, ids: np.ndarray) -> bytes:
        """The tree with its rows' vectors and ids, as load() takes it."""
        out = io.BytesIO()
        np.savez(out, low=self.low, high=self.high, span=self.span, child=self.child, points=self.points, vectors=vectors[self.order], ids=ids[self.order])
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes):
        """(tree, vectors, ids), the rows in the tree's order."""
        held = np.load(io.BytesIO(raw), allow_pickle=False)
        tree = cls.__new__(cls)
        for name in ("low", "high", "span", "child", "points"):
            setattr(tree, name, held[name])
        tree.order = np.arange(len(tree.points))
        return tree, held["vectors"], held["ids"]


def search(vectors: np.ndarray, ids: np.ndarray, tree: KdTree, point: np.ndarray, q: np.ndarray, own, k: int, limit: float, worst: float = np.inf):
    """The k nearest (distance, id) of q that the method finds within `worst`, each id once and
    own left out; and how many rows were verified by their true distance.

    Leaves come nearest first by projection. It ends once a row with the k-th true distance
    would, with the wanted confidence, have come nearer than all that follow: their squared
    projected distance is over limit times that distance squared. Rows of a leaf for which that
    holds already are not verified. At distance 0, all rows that may be equal are seen.
    vectors, ids: in the tree's order; point: q's projection.
    """
    best: list[tuple[float, int]] = []
    verified = 0
    for bound, lo, near in tree.incremental(point):
        reach = limit * worst * worst + 1e-9
        if bound > reach:
            break
        rows = lo + np.flatnonzero(near <= reach)
        gap = vectors[rows] - q
        dist = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        verified += len(rows)
        keep = np.flatnonzero((dist <= worst) & (ids[rows] != own))
        if len(keep):
            first: dict[int, float] = {}
            for d, i in sorted(best + list(zip(dist[keep].tolist(), ids[rows[keep]].tolist(), strict=True))):
                first.setdefault(i, d)
            best = [(d, i) for i, d in first.items()][:k]
            worst = best[-1][0] if len(best) == k else worst
    return best, verified


class Cells:
    """Cells of projected space, halved again and again where a sample's rows are: the upper part of the index."""

    def __init__(self, points: np.ndarray, cells: int):
        self.cut: list[tuple[int, float, int, int]] = []
        self.cells = 0
        self.root = self._split(points, cells)

    def _split(self, points: np.ndarray, cells: int) -> int:
        wide = points.max(0) - points.min(0) if len(points) > 1 else np.zeros(1)
        if cells < 2 or not (wide > 0).any():
            self.cells += 1
            return -self.cells
        axis, node = int(np.argmax(wide)), len(self.cut)
        values = np.sort(points[:, axis])
        at = float(values[len(values) * (cells // 2) // cells])
        at = at if at > values[0] else float(values[values > values[0]][0])
        self.cut.append((axis, at, 0, 0))
        below = points[:, axis] < at
        self.cut[node] = (axis, at, self._split(points[below], cells // 2), self._split(points[~below], cells - cells // 2))
        return node

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        out = np.zeros(len(points), np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -node - 1
            elif len(rows):
                axis, at, left, right = self.cut[node]
                below = points[rows, axis] < at
                todo += [(left, rows[below]), (right, rows[~below])]
        return out


def _matrix(column) -> np.ndarray:
    """A list column of vectors of one length as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _by_length(batch: pa.RecordBatch):
    """Yield (d, rows of that length) of a batch with the columns d and vector."""
    d = batch.column(batch.schema.get_field_index("d")).to_numpy()
    for x in np.unique(d):
        yield int(x), batch.take(pa.array(np.flatnonzero(d == x)))


def _projected(m: int):
    def run(batches):
        for batch in batches:
            for d, part in _by_length(batch):
                points = _matrix(part.column(part.schema.get_field_index("vector"))) @ projection(d, m)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("d")), pa.array(list(points), pa.list_(pa.float64()))], ["d", "point"])

    return run


def _placed(m: int, cells: dict[int, Cells]):
    """Rows with their cell as the last column."""

    def run(batches):
        for batch in batches:
            for d, part in _by_length(batch):
                if d in cells:
                    at = cells[d].of(_matrix(part.column(part.schema.get_field_index("vector"))) @ projection(d, m))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(at)], [*part.schema.names, "cell"])

    return run


def _builder(folder: str, m: int):
    """Stores the tree of a shard; (d, cell, path, n, low, high) of it."""

    def run(key, table):
        import uuid

        table = table.combine_chunks()
        vectors = table.column("vector").combine_chunks()
        kind = vectors.type.value_type.to_pandas_dtype()
        vectors = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(table.num_rows, -1)
        tree = KdTree(vectors.astype(np.float64) @ projection(vectors.shape[1], m))
        path = f"{folder}/{uuid.uuid4().hex}.tree"  # a new name for each attempt: the manifest names those that ended well
        fs, inner = open_fs(path)
        fs.create_dir(inner.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(inner) as out:
            out.write(tree.dump(vectors, table.column("vec_id").to_numpy()))
        listed = lambda x: pa.array([x.tolist()], pa.list_(pa.float64()))
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), pa.array([path]), pa.array([table.num_rows], pa.int64()), listed(tree.low[0]), listed(tree.high[0])], ["d", "cell", "path", "n", "low", "high"])

    return run


def _searcher(k: int, m: int, confidence: float):
    """(query_id, vec_id, score) of visits (path, query_id, vector, worst), in order of their paths."""

    def run(batches):
        limit, have, held = chi_square_point(confidence, m), None, None
        for batch in batches:
            out: list = []
            path, own, worst = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for i in range(batch.num_rows):
                if path[i] != have:
                    fs, inner = open_fs(path[i])
                    with fs.open_input_file(inner) as f:
                        held, have = KdTree.load(f.read()), path[i]
                q = batch.column(2)[i].values.to_numpy().astype(np.float64)
                best, _ = search(held[1], held[2], held[0], q @ projection(len(q), m), q, own[i], k, limit, np.inf if worst[i] is None else worst[i])
                out += [(own[i], j, d) for d, j in best]
            names = ("query_id", "vec_id", "score")
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names)

    return run


def _visitor(m: int, confidence: float, cells: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """The cells besides its own that a query has to visit."""

    def run(batches):
        limit = chi_square_point(confidence, m)
        for batch in batches:
            for d, part in _by_length(batch):
                at, low, high = cells[d]
                points = _matrix(part.column(1)) @ projection(d, m)
                home, worst = part.column(3).to_numpy(), part.column(4).to_numpy(zero_copy_only=False).astype(np.float64)
                reach = np.where(np.isnan(worst), np.inf, limit * worst * worst + 1e-9)
                go = [at[(boxes_apart(low, high, p) <= r) & (at != h)] for p, h, r in zip(points, home, reach, strict=True)]
                row = pa.array(np.repeat(np.arange(len(go)), [len(x) for x in go]))
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(row) for i in (0, 1, 2, 4)), pa.array(np.concatenate(go).astype(np.int64))], ["query_id", "vector", "d", "worst", "cell"])

    return run


def valid_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, vector, d of the rows that take part: an id, and a vector that isn't null, empty
    or zero and holds numbers only. Vectors of floats stay so; others become doubles."""
    kind = df.schema[vector_col].dataType
    floats = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    v = F.col(vector_col) if floats else F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).dropna()
    rows = rows.filter(F.size("vector") > 0).filter(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).filter(F.exists("vector", lambda x: x != 0))
    return rows.withColumn("d", F.size("vector"))


class Index:
    """Trees of all rows, stored in the shared folder, and how to find them.

    Rows: valid_vectors(). Repeated rows go first, by partial aggregation, and of equal vectors
    only the k + 1 smallest ids stay (no others can be among a query's k nearest): neither
    a vector nor a row that holds a third of the table meets in one task.

    The cells of the upper part are fitted on rows whose ids hash lowest, SAMPLE by expectation;
    every row is then dealt to a cell. A cell of more than SHARD rows is dealt on by a hash
    of the id. Each shard's tree is built once and stored. Cells, at most MOST_CELLS for each
    length of vectors, are all that the driver holds.
    """

    def __init__(self, rows: DataFrame, k: int = 10, m: int = DIMENSIONS):
        spark, self.k, self.m = rows.sparkSession, k, m
        counts = {r["d"]: r["count"] for r in rows.groupBy("d").count().collect()}  # a row per length of vectors
        share = min(1.0, SAMPLE / max(1, sum(counts.values())))
        some = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
        points: dict[int, list] = {d: [] for d in counts}
        for r in some.mapInArrow(_projected(m), "d int, point array<double>").collect():  # SAMPLE rows by expectation
            points[r["d"]].append(r["point"])
        self.cells = {d: Cells(np.unique(np.array(points[d]).reshape(len(points[d]), m), axis=0), min(MOST_CELLS, -(-n // SHARD))) for d, n in counts.items()}

        equal = F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))
        kept = rows.distinct().withColumn("_at", equal).filter(F.col("_at") <= k + 1).drop("_at")
        dealt = written(kept.mapInArrow(_placed(m, self.cells), T.StructType([*kept.schema.fields, T.StructField("cell", T.LongType())])), "ann-dealt")
        parts = dealt.groupBy("d", "cell").agg(F.ceil(F.count(F.lit(1)) / SHARD).alias("parts"))
        salted = dealt.join(F.broadcast(parts), ["d", "cell"]).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("parts")))  # a row per cell
        build = _builder(new_path(spark, "trees"), m)
        self.trees = written(salted.groupBy("d", "cell", "salt").applyInArrow(build, "d int, cell bigint, path string, n bigint, low array<double>, high array<double>"), "ann-trees")

    def boxes(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length of vectors its cells that hold rows, and their boxes."""
        ends = [f(F.col(name)[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(self.m)]
        rows = self.trees.groupBy("d", "cell").agg(*ends).collect()  # a row per cell
        out = {}
        for d in {r["d"] for r in rows}:
            mine = [r for r in rows if r["d"] == d]
            out[d] = (np.array([r["cell"] for r in mine]), *(np.array([[r[f"{name}{i}"] for i in range(self.m)] for r in mine]) for name in ("low", "high")))
        return out

    def visit(self, visits: DataFrame, confidence: float, name: str) -> DataFrame:
        """What visits (query_id, vector, d, cell, worst) find in all shards of their cells."""
        each = written(visits.join(self.trees.select("d", "cell", "path"), ["d", "cell"]).select("path", "query_id", "vector", F.col("worst").cast("double").alias("worst")), name)
        n = each.groupBy("path").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("blocks"))
        tasks = min(MOST_TASKS, max(1, n.agg(F.sum("blocks")).first()[0] or 0))
        block = F.pmod(F.xxhash64("query_id"), F.col("blocks"))
        dealt = each.join(n, "path").repartition(tasks, "path", block).sortWithinPartitions("path")
        found = dealt.select("path", "query_id", "vector", "worst").mapInArrow(_searcher(self.k, self.m, confidence), "query_id bigint, vec_id bigint, score double")
        return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))

    def nearest(self, queries: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
        """query_id, rank, vec_id, score of the k nearest rows for each query.

        A query is compared with vectors of its own length only, and not with rows of its own
        id. score is the Euclidean distance in double precision, ties go to the smaller id. Rows
        of one id count once, by the least distance. With fewer than k rows, all are returned;
        with none, no row.

        Each query first visits the shards of its own cell. The k-th distance found there
        bounds the rest: it then visits only cells that the chi-square test doesn't rule out.
        """
        asked = queries.select(F.col("vec_id").alias("query_id"), "vector", "d").distinct()
        home = written(asked.mapInArrow(_placed(self.m, self.cells), T.StructType([*asked.schema.fields, T.StructField("cell", T.LongType())])), "ann-home")
        order = W.partitionBy("query_id").orderBy("score", "vec_id")
        first = written(self.visit(home.withColumn("worst", F.lit(None)), confidence, "ann-first"), "ann-found")
        worst = first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == self.k).select("query_id", F.col("score").alias("worst"))
        rest = home.join(worst, "query_id", "left").select("query_id", "vector", "d", "cell", "worst")
        visits = rest.mapInArrow(_visitor(self.m, confidence, self.boxes()), T.StructType([*asked.schema.fields, T.StructField("worst", T.DoubleType()), T.StructField("cell", T.LongType())]))
        found = first.union(self.visit(visits, confidence, "ann-rest")).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        best = found.withColumn("rank", F.row_number().over(order))
        return best.filter(F.col("rank") <= self.k).select("query_id", "rank", "vec_id", "score")


def nearest(index: DataFrame, queries: DataFrame, k: int = 10, m: int = DIMENSIONS, confidence: float = CONFIDENCE) -> DataFrame:
    """Index(index, k, m).nearest(queries, confidence); both tables as valid_vectors() has them."""
    return Index(index, k, m).nearest(queries, confidence)


def search_table(df: DataFrame, every: int = 100, k: int = 10, **options) -> DataFrame:
    """nearest() of the rows whose id is divisible by `every`, against all rows."""
    rows = valid_vectors(df)
    return nearest(rows, rows.filter(F.col("vec_id") % every == 0), k, **options)
