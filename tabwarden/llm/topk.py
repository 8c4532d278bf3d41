"""Exact top-k search by inner product: tiled matrix products, partial selection per tile, tree merge of the lists.

Queries are packed into blocks and rows into shards; a tile is one block against one shard. A set of blocks is broadcast
only up to a fixed number of bytes: a larger query set is cut into bands by a hash of the id. Rows are then packed into shards once
and stored, and each band is a pass of its own over the stored shards, whose lists are stored in turn. So neither rows nor queries
are ever shuffled; only lists of k are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, map_batches

#: Queries of a block and rows of a shard.
BLOCK, SHARD = 1024, 4096
#: Bytes of query vectors that may be broadcast at once.
BAND_BYTES = 16 << 20
#: Lists that one task of a merge level joins for a query.
FAN = 32
#: Scaled components have to stay below this, so that they are longs.
LIMIT = 2.0**63
#: Below every score.
NONE = -(2**62)

#: A matrix has `wide` bytes to a whole number.
PACKED = "ids binary, matrix binary, dim int, wide int"
LISTS = "query_id long, vec_id array<long>, score array<long>, task int"


def whole(m: np.ndarray) -> np.ndarray:
    """floor(256 x), as it is; a component that no long can hold is refused."""
    out = np.floor(256 * m)
    if np.abs(out).max(initial=0) >= LIMIT:
        raise OverflowError("floor(256 x) of a component does not fit a long")
    return out


def scaled(vectors: list, ids: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: ids and floor(256 x) of the vectors that are whole and finite."""
    by_dim: dict[int, list] = {}
    for i, v in zip(ids, vectors):
        if v is not None and i is not None:
            by_dim.setdefault(len(v), []).append((i, v))
    out = {}
    for dim, rows in by_dim.items():
        if not dim:
            continue
        m = np.array([[np.nan if x is None else x for x in v] for _, v in rows], dtype=np.float64)
        good = np.isfinite(m).all(axis=1)
        out[dim] = np.array([i for i, _ in rows], dtype=np.int64)[good], whole(m[good])
    return out


def fast(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """scaled() without a Python list per vector, where all lists are whole and of one length."""
    ids, vectors = batch.column(0), batch.column(1)
    if not (ids.null_count or vectors.null_count or vectors.flatten().null_count) and batch.num_rows:
        sizes = np.diff(vectors.offsets.to_numpy(zero_copy_only=False))
        if sizes[0] and (sizes == sizes[0]).all():
            m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, sizes[0])
            good = np.isfinite(m).all(axis=1)
            return {int(sizes[0]): (ids.to_numpy()[good].astype(np.int64), whole(m[good]))}
    return scaled(vectors.to_pylist(), ids.to_pylist())


def pack(size: int):
    """Rows (id, vector) into rows (ids, matrix, dim) of at most `size` vectors of one dimension."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, (ids, m) in fast(batch).items():
                for at in range(0, len(ids), size):
                    part = m[at : at + size]
                    wide = 4 if np.abs(part).max(initial=0) < 2.0**31 else 8
                    yield pa.RecordBatch.from_pydict({
                        "ids": [ids[at : at + size].tobytes()], "matrix": [part.astype(f"i{wide}").tobytes()], "dim": pa.array([dim], pa.int32()),
                        "wide": pa.array([wide], pa.int32()),
                    })

    return work


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b' of whole numbers, in float32 or float64 where every partial sum fits their mantissa, else in longs or in Python's own numbers."""
    bound = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64 if bound < 2**62 else object
    found = a.astype(kind) @ b.astype(kind).T
    if kind is object and found.size and max(abs(int(found.max())), abs(int(found.min()))) >= 2**62:
        raise OverflowError("a score does not fit a long")
    return found


class Best:
    """The k best of each query of a block so far, by score and then smaller id."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int):
        self.ids, self.matrix, self.k = ids, matrix, k
        self.score = np.full((len(ids), k), NONE)
        self.vec = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.full = np.zeros(len(ids), dtype=np.int64)

    def take(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        """ids must rise, so that the first maximum of a row is the one with the smallest id."""
        product = exact_product(self.matrix, matrix)
        if product.dtype.kind == "i":
            product = product.astype(object)
        none = -np.inf
        at = np.searchsorted(ids, self.ids)
        same = np.flatnonzero(ids[np.minimum(at, len(ids) - 1)] == self.ids)
        for q in same:
            stop = np.searchsorted(ids, self.ids[q], "right")
            product[q, at[q] : stop] = none
        rows = np.arange(len(self.ids))
        found_s, found_v = [], []
        for _ in range(min(self.k, len(ids))):
            part = product if len(rows) == len(product) else product[rows]
            col = part.argmax(axis=1)
            value = part[np.arange(len(rows)), col]
            low = self.score[rows, -1]
            good = (value != none) & ((self.full[rows] < self.k) | (value >= low))
            rows, col, value = rows[good], col[good], value[good]
            if not len(rows):
                break
            product[rows, col] = none
            found_s.append((rows, value.astype(np.int64)))
            found_v.append(ids[col])
        if not found_s:
            return
        touched = found_s[0][0]
        place = np.full(len(self.ids), -1)
        place[touched] = np.arange(len(touched))
        s = np.full((len(touched), len(found_s)), NONE)
        v = np.full((len(touched), len(found_s)), np.iinfo(np.int64).max)
        for j, ((r, value), vec) in enumerate(zip(found_s, found_v)):
            s[place[r], j], v[place[r], j] = value, vec
            self.full[r] += 1
        s, v = np.hstack([self.score[touched], s]), np.hstack([self.vec[touched], v])
        order = np.lexsort((v, -s), axis=1)[:, : self.k]
        self.score[touched], self.vec[touched] = np.take_along_axis(s, order, 1), np.take_along_axis(v, order, 1)
        self.full = np.minimum(self.full, self.k)


def tiles(k: int):
    """Rows (shard ids, shard matrix, block, block ids, block matrix) into the lists of this task's rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        best: dict[int, Best] = {}
        last, shard = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                raw, dim, block = batch.column(0)[r].as_buffer(), batch.column(2)[r].as_py(), batch.column(3)[r].as_py()
                if last is None or not raw.equals(last):
                    last, ids = raw, np.frombuffer(raw, np.int64)
                    m = np.frombuffer(batch.column(1)[r].as_buffer(), f"i{batch.column(6)[r].as_py()}").reshape(-1, dim)
                    order = np.argsort(ids, kind="stable")
                    shard = ids[order], m[order]
                if block not in best:
                    q = np.frombuffer(batch.column(4)[r].as_buffer(), np.int64)
                    best[block] = Best(q, np.frombuffer(batch.column(5)[r].as_buffer(), f"i{batch.column(7)[r].as_py()}").reshape(len(q), dim), k)
                best[block].take(*shard)
        task = TaskContext.get().partitionId()
        for b in best.values():
            for at in range(0, len(b.ids), 512):
                part = range(at, min(at + 512, len(b.ids)))
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(b.ids[at : at + 512]),
                    "vec_id": pa.array([b.vec[i, : b.full[i]].tolist() for i in part], pa.list_(pa.int64())),
                    "score": pa.array([b.score[i, : b.full[i]].tolist() for i in part], pa.list_(pa.int64())),
                    "task": pa.array([task] * len(part), pa.int32()),
                })

    return work


def merged(lists: DataFrame, keys: list, k: int) -> DataFrame:
    """Join the lists of each group and keep the first k."""
    pairs = F.flatten(F.collect_list(F.transform(F.arrays_zip("score", "vec_id"), lambda z: F.struct((-z["score"]).alias("s"), z["vec_id"].alias("v")))))
    top = F.slice(F.array_sort(pairs), 1, k)
    out = lists.groupBy(*keys).agg(top.alias("_top"))
    kept = [c for c in out.columns if c != "_top"]
    return out.select(*kept, F.transform("_top", lambda t: -t["s"]).alias("score"), F.col("_top.v").alias("vec_id"))


def top_k(df: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the rows for which `queries` holds, against all other rows.

    Scores are inner products of floor(256 x), ties go to the smaller id. Vectors null, empty or with null or non-finite
    components take no part, nor do rows without id or vectors of another dimension than the query's. Rows that carry the query's id are its own. Repeated
    rows count each; a repeated query id asks with its smallest vector. A component or score that does not fit a long raises
    OverflowError. Other columns are ignored; an empty table gives an empty result.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    asked = df.filter(queries).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    good = F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    one = asked.filter(good & F.col("id").isNotNull()).groupBy("id").agg(F.min("vector").alias("vector"))
    # The number of passes follows from the bytes of the queries; each pass broadcasts BAND_BYTES or so.
    one = keep(one, "topk-queries")
    bands = max(1, math.ceil((one.agg(F.sum(F.size("vector").cast("long") * 8 + 8)).first()[0] or 0) / BAND_BYTES))
    shards = map_batches(rows, pack(SHARD), PACKED)
    shards = shards if bands == 1 else keep(shards, "topk-shards")  # rows are parsed once, however many passes follow
    found = None
    for band in range(bands):
        part = one.filter(F.pmod(F.xxhash64("id"), F.lit(bands)) == band).coalesce(1)
        best = searched(shards, part, k)
        best = best if bands == 1 else keep(best, "topk-band")
        found = best if found is None else found.unionByName(best)
    return found.select("query_id", F.posexplode(F.arrays_zip("score", "vec_id")).alias("pos", "hit")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")
    )


def searched(shards: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, score, vec_id), lists of the k best: one pass over the packed shards for a band of queries."""
    blocks = map_batches(queries, pack(BLOCK), PACKED).select(
        F.monotonically_increasing_id().alias("block"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.col("dim").alias("q_dim"), F.col("wide").alias("q_wide")
    )
    pairs = shards.join(F.broadcast(blocks), F.col("dim") == F.col("q_dim")).select("ids", "matrix", "dim", "block", "q_ids", "q_matrix", "wide", "q_wide")
    found = map_batches(pairs, tiles(k), LISTS)
    # Tree: each level joins at most FAN lists of a query, by the task that made them.
    parts = max(1, shards.rdd.getNumPartitions())
    while parts > FAN:
        found = merged(found, ["query_id", F.floor(F.col("task") / FAN).cast("int").alias("task")], k)
        parts = math.ceil(parts / FAN)
    return merged(found.select("query_id", "score", "vec_id"), ["query_id"], k)


def op1_exact_top_k(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
