"""Nearest neighbours by largest inner product: stable projections in kd-trees with a chi-square stop.

Inner products become distances by one more component, sqrt(M^2 - |x|^2), M the largest norm; a
query gets 0 there.  A Gaussian matrix projects vectors to ``dims`` dimensions: the projected squared
distance of a pair is its squared distance times a chi-square variable.  A query takes projected
neighbours in order, leaf by leaf of a kd-tree, and verifies them on the whole vectors.  It stops once the
next leaf is so far that a vector nearer than the k-th found would lie beyond it with a probability
below 1 - ``confidence``.

Equal vectors form a class that is searched once; a class keeps its k + 1 smallest ids, all
that any result can need.  Classes lie in blocks, the top cells of a kd-tree whose splits are
fitted on about ``sample`` classes (those with the smallest hashes); every class is assigned.  A
query searches its own block first, then the others whose box passes the same test against its k-th
distance.  A vector is sent to its block only, a query to each block that it visits: a task reads a block's
vectors, of which there are about ``block_rows`` (cells with more are split by hash), and then lets any number of queries pass by, ``chunk`` at a time.

Defined results.  Vectors that are null, zero, of another length than the commonest, or
hold a null or non-finite component, and rows with a null id, take no part.  Repeated ids: one
result row for each vector; a query never finds its own id.  Ties go to the smaller id.  Empty
table: empty result.  Extra columns: ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import hashing
from .common import Workspace, small_batches


def chi_square_quantile(p: float, dims: int) -> float:
    """For an even number of degrees of freedom."""

    def cdf(x: float) -> float:
        term = total = 1.0
        for i in range(1, dims // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1000.0 + 10 * dims
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if cdf(middle) < p else (low, middle)
    return high


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists have one length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(values.ravel()))


def tree_leaves(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows of the leaves of a kd-tree: cells are halved at the median of their widest dimension."""
    open_, done = [np.arange(len(points))], []
    while open_:
        rows = open_.pop()
        if len(rows) <= most:
            done.append(rows)
            continue
        own = points[rows]
        values = own[:, int(np.ptp(own, axis=0).argmax())]
        order = np.argpartition(values, len(rows) // 2)
        open_ += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return done


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances from points to boxes."""
    out = np.zeros((len(points), len(low)))
    for j in range(points.shape[1]):
        x = points[:, j, None]
        out += np.square(np.maximum(0, np.maximum(low[None, :, j] - x, x - high[None, :, j])))
    return out


def splits(points: np.ndarray, parts: int) -> list[tuple[int, float, int, int]]:
    """Nodes (dimension, value, left, right) of a tree with ``parts`` cells; -1 - i stands for cell i."""
    nodes: list = []
    cells = 0

    def make(rows: np.ndarray, n: int) -> int:
        nonlocal cells
        if n == 1 or len(rows) < 2:
            cells += 1
            return -cells
        own = points[rows]
        d = int(np.ptp(own, axis=0).argmax())
        value = float(np.quantile(own[:, d], (n // 2) / n))
        at = len(nodes)
        nodes.append(None)
        left = own[:, d] < value
        nodes[at] = (d, value, make(rows[left], n // 2), make(rows[~left], n - n // 2))
        return at

    make(np.arange(len(points)), max(1, parts))
    return nodes


def cells_of(points: np.ndarray, nodes: list) -> np.ndarray:
    at = np.zeros(len(points), np.int64) if nodes else np.full(len(points), -1)
    while (inner := np.flatnonzero(at >= 0)).size:
        for node in np.unique(at[inner]):
            rows = np.flatnonzero(at == node)
            d, value, left, right = nodes[node]
            at[rows] = np.where(points[rows, d] < value, left, right)
    return -1 - at


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed from the first component on."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j].astype(np.float64) * x[:, j].astype(np.float64)
    return out


class Block:
    """A block's vectors, with the leaves of a kd-tree over their projections."""

    def __init__(self, x: np.ndarray, projected: np.ndarray, ids: pa.ListArray, leaf_rows: int = 256) -> None:
        self.x, self.wide = x, x.astype(np.float64)
        self.counts = ids.value_lengths().to_numpy().astype(np.int64)
        self.first, self.ids = np.cumsum(self.counts) - self.counts, ids.flatten().to_numpy()
        self.leaves = tree_leaves(projected, leaf_rows)
        self.low = np.array([projected[r].min(axis=0) for r in self.leaves])
        self.high = np.array([projected[r].max(axis=0) for r in self.leaves])

    def search(self, queries: np.ndarray, projected: np.ndarray, kth: np.ndarray, norm2: float, k: int, limit: float) -> np.ndarray:
        """Vectors found for each query (queries x k, -1 where there are fewer).  kth: distances already reached."""
        q = queries.astype(np.float64)
        q2 = (q * q).sum(axis=1) + norm2
        best = np.full((len(q), k), np.inf)
        found = np.full((len(q), k), -1, np.int64)
        far = box_distances(projected, self.low, self.high)
        order = np.argsort(far, axis=1)
        far = np.take_along_axis(far, order, axis=1)
        going = np.arange(len(q))
        for turn in range(len(self.leaves)):
            reached = np.minimum(best[going, k - 1], kth[going])
            going = going[far[going, turn] <= limit * reached]
            if not going.size:
                break
            at = order[going, turn]
            for leaf in np.unique(at):
                who, rows = going[at == leaf], self.leaves[leaf]
                d = np.maximum(0, q2[who, None] - 2 * (q[who] @ self.wide[rows].T))
                d = np.concatenate([best[who], d], axis=1)
                names = np.concatenate([found[who], np.broadcast_to(rows, (len(who), len(rows)))], axis=1)
                some = np.argpartition(d, k - 1, axis=1)[:, :k]
                d, names = np.take_along_axis(d, some, axis=1), np.take_along_axis(names, some, axis=1)
                some = np.argsort(d, axis=1)
                best[who], found[who] = np.take_along_axis(d, some, axis=1), np.take_along_axis(names, some, axis=1)
        return found

    def named(self, queries: np.ndarray, found: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, score and id of the ``most`` best ids of each query's vectors."""
        who, at = np.nonzero(found >= 0)
        rows = found[who, at]
        n = self.counts[rows]
        scores, who = np.repeat(exact(queries[who], self.x[rows]), n), np.repeat(who, n)
        ids = self.ids[hashing.ragged(self.first[rows], n)]
        order = np.lexsort((ids, -scores, who))
        who, scores, ids = who[order], scores[order], ids[order]
        few = np.arange(len(who)) - np.searchsorted(who, who) < most
        return who[few], scores[few], ids[few]


class StableIndex:
    def __init__(self, *, k: int = 20, dims: int = 10, confidence: float = 0.98, seed: int = 5, sample: int = 20_000, block_rows: int = 25_000, chunk: int = 4096, id_col: str = "vec_id", vector: str = "embedding") -> None:
        self.k, self.dims, self.confidence, self.seed = k, dims, confidence, seed
        self.sample, self.block_rows, self.chunk = sample, block_rows, chunk
        self.id_col, self.vector = id_col, vector

    def _valid(self, vectors: DataFrame) -> tuple[DataFrame, int, float]:
        """Rows that take part (id, vector), their length, the largest squared norm."""
        v = f"`{self.vector}`"
        rows = vectors.select(F.col(self.id_col).cast("long").alias("id"), F.expr(f"cast({v} as array<float>)").alias("vector"))
        fine = "id is not null and vector is not null and forall(vector, x -> x is not null and not isnan(x) and abs(x) < float('infinity')) and exists(vector, x -> x <> 0)"
        rows = rows.filter(fine)
        norms = rows.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("rows"), F.max(F.expr("aggregate(vector, 0D, (a, x) -> a + cast(x as double) * x)")).alias("m"))
        top = norms.orderBy(F.desc("rows"), F.desc("n")).first()
        return (rows, 0, 0.0) if top is None else (rows.filter(F.size("vector") == top["n"]), top["n"], top["m"])

    def nearest(self, vectors: DataFrame, is_query: Column) -> DataFrame:
        """query_id, rank, vec_id, score for the rows of vectors for which ``is_query`` (of the id, named id) holds."""
        spark = vectors.sparkSession
        small_batches(spark)
        work = Workspace(spark, "neighbours")
        rows, width, norm2 = self._valid(vectors)
        k, dims, limit = self.k, self.dims, chi_square_quantile(self.confidence, self.dims)
        if not width:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        gauss = np.random.default_rng(self.seed).standard_normal((width + 1, dims))

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(1)).astype(np.float32) + np.float32(0)
                names = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in x]
                wide = x.astype(np.float64)
                more = np.sqrt(np.maximum(0, norm2 - (wide * wide).sum(axis=1)))
                p = wide @ gauss[:width]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.binary()), lists(x), lists(p), lists(p + more[:, None] * gauss[width])], names=["id", "cls", "vector", "asked", "placed"])

        rows = work.save(rows.mapInArrow(project, "id long, cls binary, vector array<float>, asked array<double>, placed array<double>"), "rows")
        # k + 1 smallest ids of a class: first within shares of it, then over them
        few = rows.select("cls", "id").distinct().withColumn("share", F.pmod(F.xxhash64("id"), F.lit(16)))
        few = few.withColumn("r", F.row_number().over(Window.partitionBy("cls", "share").orderBy("id"))).filter(F.col("r") <= k + 1)
        few = few.withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy("id"))).filter(F.col("r") <= k + 1)
        few = few.groupBy("cls").agg(F.array_sort(F.collect_list("id")).alias("ids"))
        one = rows.groupBy("cls").agg(F.first("vector").alias("vector"), F.first("asked").alias("asked"), F.first("placed").alias("placed"))
        classes = work.save(one.join(few, "cls"), "classes")

        n = classes.count()
        hashed = F.shiftrightunsigned(F.xxhash64("cls"), 1)
        fitted = classes.filter(hashed < int(min(1, self.sample / max(1, n)) * (2**63 - 1))).select("placed").collect()  # about ``sample`` rows
        nodes = splits(np.array([r[0] for r in fitted]), -(-n // self.block_rows))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = [cells_of(matrix(batch.column(c)), nodes) for c in ("placed", "asked")]
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, own)], names=[*batch.schema.names, "cell", "home"])

        placed = classes.mapInArrow(assign, StructType([*classes.schema.fields, StructField("cell", LongType()), StructField("home", LongType())]))
        placed = work.save(placed, "placed")
        held = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each block
        parts = spark.createDataFrame([(c, -(-m // self.block_rows)) for c, m in held], "cell long, parts long")
        placed = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")))
        each = [f(F.col("placed")[j]).alias(f"{name}{j}") for name, f in (("low", F.min), ("high", F.max)) for j in range(dims)]
        boxes = placed.groupBy("cell", "part").agg(*each).orderBy("cell", "part").collect()  # one row for each part of a block
        keys = [(b["cell"], b["part"]) for b in boxes]
        low, high = (np.array([[b[f"{s}{j}"] for j in range(dims)] for b in boxes]) for s in ("low", "high"))

        asked = rows.filter(is_query).select("cls", F.col("id").alias("query_id")).distinct()
        asked = work.save(asked, "queries")
        wanted = placed.join(asked.select("cls").distinct(), "cls", "left_semi")
        wanted = wanted.select("cls", "vector", "asked", "home")
        found_schema = pa.schema([("cls", pa.binary()), ("score", pa.float64()), ("id", pa.int64())])

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come in the order of blocks, a block's vectors before the queries that come to it."""
            key, rows, block, waiting, n = None, [], None, [], 0

            def answered() -> pa.RecordBatch:
                nonlocal rows, block
                if block is None:
                    own = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
                    block, rows = Block(matrix(own.column(0)), matrix(own.column(1)), own.column(2)), [rows[0]]
                some = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                q = matrix(some.column("vector"))
                found = block.search(q, matrix(some.column("point")), some.column("kth").to_numpy(), norm2, min(k + 4, len(block.x)), limit)
                who, scores, ids = block.named(q, found, k + 1)
                return pa.RecordBatch.from_arrays([some.column("cls").take(pa.array(who)), pa.array(scores), pa.array(ids)], schema=found_schema)

            for batch in batches:
                at = np.stack([batch.column(c).to_numpy() for c in ("cell", "part", "kind")])
                cuts = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1
                for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                    if a == b:
                        continue
                    cell, part, kind = at[:, a].tolist()
                    if waiting and ((cell, part) != key or n >= self.chunk):
                        yield answered()
                        waiting, n = [], 0
                    if (cell, part) != key:
                        key, rows, block = (cell, part), [], None
                    some = batch.slice(a, b - a)
                    if kind == 0:
                        rows.append(some.select(["vector", "point", "ids"]))
                    elif rows:
                        waiting.append(some)
                        n += b - a
            if waiting:
                yield answered()

        held = placed.select("cell", "part", F.lit(0).alias("kind"), "cls", "vector", F.col("placed").alias("point"), "ids", F.lit(None).cast("double").alias("kth"))

        def visit(queries: DataFrame) -> DataFrame:
            come = queries.select("cell", "part", F.lit(1).alias("kind"), "cls", "vector", F.col("asked").alias("point"), F.lit(None).cast("array<long>").alias("ids"), "kth")
            by = ("cell", "part")
            return held.unionByName(come).repartition(*by).sortWithinPartitions(*by, "kind").mapInArrow(task, "cls binary, score double, id long")

        def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = {}
            for i, (cell, _) in enumerate(keys):
                first.setdefault(cell, i)
            for batch in batches:
                cells = batch.column("home").to_pylist()
                points = matrix(batch.column("asked"))
                near = box_distances(points, low, high).argmin(axis=1)
                at = np.array([first.get(c, int(near[i])) for i, c in enumerate(cells)], np.int64)
                yield deal(batch, np.arange(len(at)), at, np.full(len(at), np.inf))

        def deal(batch: pa.RecordBatch, rows_: np.ndarray, at: np.ndarray, kth: np.ndarray) -> pa.RecordBatch:
            own = batch.select(["cls", "vector", "asked"]).take(pa.array(rows_))
            cell, part = (pa.array([keys[i][j] for i in at], pa.int64()) for j in (0, 1))
            return pa.RecordBatch.from_arrays([*own.columns, cell, part, pa.array(kth)], names=[*own.schema.names, "cell", "part", "kth"])

        def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = matrix(batch.column("vector")).astype(np.float64)
                kth = (q * q).sum(axis=1) + norm2 - 2 * batch.column("kth").to_numpy(zero_copy_only=False)
                far = box_distances(matrix(batch.column("asked")), low, high)
                first = {}
                for i, (cell, _) in enumerate(keys):
                    first.setdefault(cell, i)
                near = far.argmin(axis=1)
                done = np.array([first.get(c, int(near[i])) for i, c in enumerate(batch.column("home").to_pylist())])
                passed = far <= limit * np.where(np.isnan(kth), np.inf, np.maximum(kth, 0))[:, None]
                passed[np.arange(len(done)), done] = False
                who, at = np.nonzero(passed)
                yield deal(batch, who, at, np.where(np.isnan(kth), np.inf, kth)[who])

        schema = "cls binary, vector array<float>, asked array<double>, cell long, part long, kth double"
        one = work.save(visit(wanted.mapInArrow(home, schema)), "one")
        reached = one.groupBy(F.col("cls").alias("c")).agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n"))
        reached = reached.select("c", F.when(F.col("n") > k, F.col("kth")).alias("kth"))
        found = one
        if len(keys) > 1:
            again = wanted.join(reached, F.col("cls") == F.col("c"), "left").drop("c")
            found = one.unionByName(work.save(visit(again.mapInArrow(rest, schema)), "two"))
        best = found.withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("score"), "id"))).filter(F.col("r") <= k + 1)
        best = best.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("best"))
        best = work.save(best, "best")
        work.drop("classes", "placed", "one", "two", "rows")
        own = asked.join(best.withColumnRenamed("cls", "c"), F.col("cls") == F.col("c"))
        some = own.select("query_id", F.posexplode(F.slice(F.filter("best", lambda b: b["id"] != F.col("query_id")), 1, k)).alias("at", "b"))
        return some.select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.id").alias("vec_id"), F.col("b.score").alias("score"))
