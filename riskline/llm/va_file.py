"""Exact top-k inner products with a vector-approximation file.

Vectors hold integers. Every dimension is divided into equal cells and the file keeps each vector's cell
numbers, one byte a component, beside the exact vector. For a query the cells alone bound a score from
both sides: the inner product with the cells' lower corners, plus a range that depends on the query only.

A first scan reads cells alone and finds, per query, the kth largest lower bound over all rows; no row
whose upper bound is below it can be a result. A second scan visits the rows left in order of their
upper bound, reads their exact vectors and stops where no further row can reach the kth score found.
Queries are a stated set; blocks of them with a bounded size go to all tasks in turn, and each task
scans its rows in blocks, so memory does not grow with either side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskline.llm.common import prepare, staged

CELLS = 256
#: Queries sent to the executors at once are bounded in bytes (8 a component).
QUERY_BYTES = 16 << 20
#: Rows whose bounds are computed at once, against ``QUERIES_AT_ONCE`` queries.
ROWS_AT_ONCE = 4096
QUERIES_AT_ONCE = 512
#: Upper-bound candidates whose exact vectors are read at once.
STEP = 64


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component x as a double, as long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    """Not null, and no component null, NaN or infinite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of doubles; missing components at the end are 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return values.reshape(-1, width).astype(np.float64)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths])] = values
    return out


class Approximation:
    """The cells of every dimension: ``low`` and ``step`` (integers as doubles)."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low = low
        self.step = np.maximum(1.0, np.ceil((high - low + 1) / CELLS))

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        return ((vectors - self.low) // self.step).astype(np.uint8)

    def corners(self, cells: np.ndarray) -> np.ndarray:
        return self.low + cells * self.step

    def slack(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is added to the score with a cell's corner at least and at most, per query."""
        inside = self.step - 1
        return np.minimum(queries, 0) @ inside, np.maximum(queries, 0) @ inside


def approximation_file(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024
                       ) -> tuple[DataFrame, Approximation | None, int]:
    """(id, cells, vector) of all usable rows as a staged table, its cells' geometry and the dimension.

    Rows with a null id or an unusable vector take no part; a shorter vector counts as ending in zeros."""
    spark = vectors.sparkSession
    prepare(spark)
    raw = F.col(f"`{vector_col}`")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), raw.alias("raw")).where(
        F.col("id").isNotNull() & usable(F.col("raw"))).select("id", scaled(F.col("raw"), scale).alias("vector"))
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    if not width:
        return rows.withColumn("cells", F.lit(b"")), None, 0
    # one aggregate over (dimension) groups: partial minima and maxima, one row a dimension
    ends = rows.select(F.posexplode("vector").alias("d", "x")).groupBy("d").agg(
        F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("n")).collect()
    n = rows.count()
    low, high = np.zeros(width), np.zeros(width)
    for r in ends:
        some_shorter = r["n"] < n
        low[r["d"]] = min(r["low"], 0) if some_shorter else r["low"]
        high[r["d"]] = max(r["high"], 0) if some_shorter else r["high"]
    largest = np.maximum(np.abs(low), np.abs(high))
    if float((largest * largest).sum()) >= 2.0**53:
        raise ValueError("scores reach 2**53, where doubles are no longer exact: use a smaller scale")
    geometry = Approximation(low, high)

    def approximate(batches):
        for batch in batches:
            exact = _matrix(batch.column(1), width)
            cells = geometry.cells(exact)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in cells], pa.binary()),
                 pa.array([r.tobytes() for r in exact.astype(np.int32 if largest.max() < 2**31 else np.int64)], pa.binary())],
                ["id", "cells", "vector"])

    return staged(rows.mapInArrow(approximate, "id bigint, cells binary, vector binary"), "va-file"), geometry, width


def _blocks(batches, width: int):
    """(ids, cells, vectors or None) of at most ``ROWS_AT_ONCE`` rows."""
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(begin, ROWS_AT_ONCE)
            cells = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, width)
            yield part.column(0).to_numpy(), cells, part.column(2) if part.num_columns > 2 else None


def _top_rows(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 1024) -> DataFrame:
    """The ``k`` best rows of every query: ``query_id``, ``rank``, ``vec_id``, ``score``; exact.

    ``is_query`` chooses the queries by columns of ``vectors``. Candidates are all usable rows with
    another id than the query's; fewer than ``k`` give all of them; ties go to the smaller id. A query id
    that is repeated with one vector is one query, with several the one with the largest components; a
    repeated candidate row counts as often as it is there. An empty table gives no rows; other columns
    are not read. Scores must stay below 2**53."""
    spark = vectors.sparkSession
    file, geometry, width = approximation_file(vectors, id_col, vector_col, scale)
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if geometry is None:
        return spark.createDataFrame([], schema)
    ids = vectors.where(is_query).select(F.col(f"`{id_col}`").cast("long").alias("id")).distinct()
    queries = staged(file.select("id", "vector").join(ids, "id", "left_semi").groupBy("id").agg(
        F.max("vector").alias("vector")), "va-queries")
    total = queries.count()
    blocks = max(1, -(-total * width * 8 // QUERY_BYTES))
    out = None
    for block in range(blocks):
        mine = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)
        rows = mine.collect()  # QUERY_BYTES, about
        if not rows:
            continue
        rows.sort(key=lambda r: r["id"])
        part = _search(file, geometry, width, np.array([r["id"] for r in rows]),
                       np.stack([np.frombuffer(bytes(r["vector"]), np.int32 if len(r["vector"]) == 4 * width else np.int64)
                                 for r in rows]).astype(np.float64), k)
        part = part if blocks == 1 else staged(part, "va-results")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def _search(file: DataFrame, geometry: Approximation, width: int, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    context = file.sparkSession.sparkContext
    sent = context.broadcast((ids, queries))

    def lower_bounds(batches):
        ids, queries = sent.value
        least, _ = geometry.slack(queries)
        best = np.full((len(ids), k), -np.inf)
        for row_ids, cells, _ in _blocks(batches, width):
            corners = geometry.corners(cells)
            for a in range(0, len(ids), QUERIES_AT_ONCE):
                part = slice(a, a + QUERIES_AT_ONCE)
                bound = queries[part] @ corners.T + least[part, None]
                bound[ids[part][:, None] == row_ids[None, :]] = -np.inf
                both = np.concatenate([best[part], bound], axis=1)
                best[part] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        q, j = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(best[q, j].astype(np.int64))], ["query", "score"])

    bounds = _top_rows(file.select("id", "cells").mapInArrow(lower_bounds, "query int, score bigint").withColumn(
        "vec_id", F.lit(0)), k).where(F.col("rank") == k).select("query", "score").collect()  # one row a query
    floor = np.full(len(ids), -np.inf)
    for r in bounds:
        floor[r["query"]] = r["score"]
    floors = context.broadcast(floor)

    def exact_scores(batches):
        ids, queries = sent.value
        _, most = geometry.slack(queries)
        floor = floors.value.copy()
        heaps: list[list[tuple[float, int]]] = [[] for _ in range(len(ids))]  # (score, -id), at most k
        for row_ids, cells, exact in _blocks(batches, width):
            corners = geometry.corners(cells)
            for a in range(0, len(ids), QUERIES_AT_ONCE):
                part = slice(a, a + QUERIES_AT_ONCE)
                bound = queries[part] @ corners.T + most[part, None]
                bound[ids[part][:, None] == row_ids[None, :]] = -np.inf
                for q in np.flatnonzero((bound >= floor[part, None]).any(axis=1)):
                    left = np.flatnonzero((bound[q] >= floor[a + q]) & np.isfinite(bound[q]))
                    left = left[np.argsort(-bound[q, left], kind="stable")]
                    best = heaps[a + q]
                    for step in range(0, len(left), STEP):
                        rows = left[step:step + STEP]
                        if bound[q, rows[0]] < floor[a + q]:
                            break
                        raw = exact.take(pa.array(rows)).to_pylist()
                        kind = np.int32 if len(raw[0]) == 4 * width else np.int64
                        scores = np.stack([np.frombuffer(r, kind) for r in raw]).astype(np.float64) @ queries[a + q]
                        best = sorted(best + list(zip(scores.tolist(), (-row_ids[rows]).tolist())), reverse=True)[:k]
                        if len(best) == k:
                            floor[a + q] = max(floor[a + q], best[-1][0])
                    heaps[a + q] = best
        found = [(q, int(s), -i) for q, best in enumerate(heaps) for s, i in best]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int64()),
                                          pa.array([f[2] for f in found], pa.int64())], ["query", "score", "vec_id"])

    found = _top_rows(file.mapInArrow(exact_scores, "query int, score bigint, vec_id bigint"), k)
    names = F.array(*[F.lit(int(i)) for i in ids]) if len(ids) <= 1000 else None
    if names is not None:
        query_id = F.element_at(names, F.col("query") + 1)
        return found.select(query_id.cast("long").alias("query_id"), F.col("rank").cast("int"), "vec_id", "score")
    table = file.sparkSession.createDataFrame([(k_, int(i)) for k_, i in enumerate(ids)], "query int, query_id bigint")
    return found.join(table, "query").select("query_id", F.col("rank").cast("int"), "vec_id", "score")
