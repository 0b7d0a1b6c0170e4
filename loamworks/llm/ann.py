"""Nearest neighbours by randomly rotated one-bit codes.

Unit vectors are rotated at random; the signs of the coordinates, packed, are a
vector's code, and the sum of the coordinates' sizes its correction scalar
(RaBitQ: Gao and Long, 2024).  The inner product of a code with a rotated query,
divided by the scalar, estimates the cosine without bias, within an error that
the scalar bounds.

Equal vectors are one entry with their smallest ids, as many as an answer can
hold.  Codes and queries are dealt into blocks of bounded size, and each pair of
blocks is one unit of work, which sees codes and scalars only.  There are two
passes.  In the first the pairs of blocks give each query's best estimates; the
best of all are compared exactly, which gives one bar for each query.  In the
second the entries whose upper bound reaches the query's bar are found, and only
they meet their vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

#: Bits of a code for each component: the error falls with the square root.
BITS = 8
#: Standard deviations that the estimate's error may reach (beyond 4 in about one of 10,000 comparisons).
ERROR_SPAN = 4.0
ROUNDING = 1e-5  # of single precision
#: Most entries and queries in a block (13 and 8 MB at 64 components), and fewest where cores would idle.
ENTRIES, QUERIES, LEAST = 1 << 17, 1 << 14, 1 << 12
#: Entries and queries that are compared at once.
SLICE, ROWS = 2048, 1024


@lru_cache(8)
def rotation(dim: int) -> np.ndarray:
    """For vectors padded with zeros to BITS times their dimension (long ones less): the rows that matter of a random orthogonal matrix, always the same."""
    size = dim * max(1, min(BITS, 1024 // dim))
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((size, size)))
    return np.ascontiguousarray((q * np.sign(np.diag(r)))[:dim])


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors other than zero times powers of two, so that the largest component is 0.5 to 1: no square of a norm over- or underflows, and no digit changes."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1))[1][:, None])


def turn(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors, rotated."""
    own = scaled(vectors)
    return own / np.linalg.norm(own, axis=1, keepdims=True) @ rotation(vectors.shape[1])


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed codes[vector, byte], correction scalars) of vectors other than zero."""
    turned = turn(vectors)
    return np.packbits(turned > 0, axis=1, bitorder="little"), np.abs(turned).sum(1) / np.sqrt(turned.shape[1])


def estimate(codes: np.ndarray, scalars: np.ndarray, turned: np.ndarray, span: float = ERROR_SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(estimated cosines[query, vector], error bounds[vector]) of rotated queries."""
    size = turned.shape[1]
    ones = np.unpackbits(codes, axis=1, count=size, bitorder="little").astype(np.float32)
    # <code, query> = (2 * sum over set bits - sum of all) / sqrt(size)
    sums = 2 * (turned.astype(np.float32) @ ones.T) - turned.sum(1, keepdims=True).astype(np.float32)
    spread = np.sqrt(np.maximum(1 - scalars**2, 0)) / scalars / np.sqrt(max(size - 1, 1))
    return sums * (1 / (np.sqrt(size) * scalars)).astype(np.float32), span * spread + ROUNDING


def best_estimates(codes: np.ndarray, scalars: np.ndarray, turned: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, entries, estimates) of the ``most`` entries of the best estimates of each query."""
    for r in range(0, len(turned), ROWS):
        some = turned[r : r + ROWS]
        top, at = np.full((len(some), 0), 0.0, np.float32), np.zeros((len(some), 0), np.int64)
        for s in range(0, len(codes), SLICE):
            near = estimate(codes[s : s + SLICE], scalars[s : s + SLICE], some)[0]
            top, at = np.concatenate([top, near], 1), np.concatenate([at, np.broadcast_to(np.arange(s, s + near.shape[1]), near.shape)], 1)
            if top.shape[1] > most:
                keep = np.argpartition(-top, most - 1, axis=1)[:, :most]
                top, at = np.take_along_axis(top, keep, 1), np.take_along_axis(at, keep, 1)
        yield np.repeat(np.arange(r, r + len(some)), top.shape[1]), at.ravel(), top.ravel()


def survivors(codes: np.ndarray, scalars: np.ndarray, turned: np.ndarray, bars: np.ndarray, span: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, entries, estimates) whose upper bound reaches the query's bar."""
    for r in range(0, len(turned), ROWS):
        for s in range(0, len(codes), SLICE):
            near, error = estimate(codes[s : s + SLICE], scalars[s : s + SLICE], turned[r : r + ROWS], span)
            row, found = np.nonzero(near + error.astype(np.float32) >= bars[r : r + ROWS, None])
            yield row + r, found + s, near[row, found]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last whatever the machine's vector unit."""
    out = np.zeros(len(a))
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), strict=True):
        out += x * y
    return out


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows, in double precision."""
    a, b = scaled(a), scaled(b)
    return products(a, b) / (np.sqrt(products(a, a)) * np.sqrt(products(b, b)))


def usable(vector: Column) -> Column:
    """Not null, not zero, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _floats(column: pa.Array | pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist() if isinstance(column, pa.Array) else column), np.float64).reshape(-1, dim)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the embedding, which comes first, by dimension, bytes, code and scalar."""
    for batch in batches:
        vectors = batch.column(0)
        sizes = np.diff(vectors.offsets.to_numpy())
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        begins = np.cumsum(sizes) - sizes
        codes: list[bytes] = [b""] * len(sizes)
        scalars = np.zeros(len(sizes))
        for dim in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == dim)
            packed, scalars[rows] = encode(flat[begins[rows][:, None] + np.arange(dim)])
            for r, c in zip(rows.tolist(), packed, strict=True):
                codes[r] = c.tobytes()
        own = [flat[b : b + n].tobytes() for b, n in zip(begins.tolist(), sizes.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sizes, pa.int32()), pa.array(own, pa.binary()), pa.array(codes, pa.binary()), pa.array(scalars)], names=[*batch.schema.names[1:], "dim", "vector", "code", "scalar"])


def _packed(df: DataFrame, name: str) -> DataFrame:
    """Rows with an embedding, numbered, packed and written."""
    added = [T.StructField("dim", T.IntegerType()), T.StructField("vector", T.BinaryType()), T.StructField("code", T.BinaryType()), T.StructField("scalar", T.DoubleType())]
    others = [c for c in df.columns if c != "embedding"]
    out = df.select("embedding", *others).mapInArrow(_pack, T.StructType([*(df.schema[c] for c in others), *added]))
    return stored(out.select(F.monotonically_increasing_id().alias("n"), "*"), name)


PAIRS = T.StructType([T.StructField("q", T.LongType()), T.StructField("e", T.LongType()), T.StructField("near", T.FloatType())])


def _compared(codes: DataFrame, asked: DataFrame, blocks: tuple[int, int], work) -> DataFrame:
    """Rows (q, e, near) that ``work`` finds in each pair of blocks."""

    def run(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(entries) or not len(queries):
            return pd.DataFrame({f.name: [] for f in PAIRS})
        size = rotation(int(entries["dim"].iloc[0])).shape[1]
        packed = np.frombuffer(b"".join(entries["code"]), np.uint8).reshape(len(entries), -(-size // 8))
        e, q, out = entries["e"].to_numpy(), queries["q"].to_numpy(), []
        for row, found, near in work(packed, entries["scalar"].to_numpy(), queries):
            out.append(pd.DataFrame({"q": q[row], "e": e[found], "near": near}))
        return pd.concat(out)

    def each(column: str, n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(column)

    left = codes.select("*", F.pmod(F.xxhash64("e"), F.lit(blocks[0])).cast("int").alias("block"), each("asked", blocks[1]))
    right = asked.select("*", F.pmod(F.xxhash64("q"), F.lit(blocks[1])).cast("int").alias("asked"), each("block", blocks[0]))
    keys = ["dim", "block", "asked"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, PAIRS)


def _exact(pairs: DataFrame, index: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows (q, ids, own, score) of pairs (q, e)."""
    left = pairs.join(index.select(F.col("n").alias("e"), "ids", "a", "b", "vector"), "e")
    both = left.join(asked.select(F.col("n").alias("q"), F.col("a").alias("qa"), F.col("b").alias("qb"), "dim", F.col("vector").alias("qv")), "q")
    chosen = both.select("q", "ids", ((F.col("a") == F.col("qa")) & (F.col("b") == F.col("qb"))).alias("own"), "dim", "vector", "qv")
    schema = T.StructType([*(chosen.schema[c] for c in ("q", "ids", "own")), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, score = batch.column("dim").to_numpy(), np.zeros(batch.num_rows)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                score[rows] = cosines(*(_floats(batch.column(c).take(pa.array(rows)), dim) for c in ("qv", "vector")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(score)], names=schema.names)

    return chosen.mapInArrow(run, schema)


def nearest(vectors: DataFrame, query: Column, k: int = 5, *, error_span: float = ERROR_SPAN, block_entries: int = ENTRIES, block_queries: int = QUERIES) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k rows of the largest cosine for each query row.

    ``vectors`` has vec_id and embedding (an array of numbers); ``query`` says
    which rows are queries.  A query row's candidates are all rows but itself, of
    its own dimension, rows that repeat its id and vector included; nearest
    first, ties to the smaller vec_id; all of them if there are fewer than k.
    Rows whose vector is null, zero or holds null or non-finite components, and
    rows without id, take no part; components may be of any finite size.  Each
    query row is answered, so rows that repeat give repeated answers.  Equal
    vectors are told by two 64-bit hashes.  Further columns are ignored; an empty
    table gives no rows.

    A neighbour is missed only if its estimate errs by more than ``error_span``
    standard deviations; with an infinite span every pair is compared exactly.
    A block holds about ``block_entries`` codes or ``block_queries`` queries.
    """
    spark, id_type = vectors.sparkSession, vectors.schema["vec_id"].dataType
    rows = vectors.select("vec_id", "embedding", F.coalesce(query, F.lit(False)).alias("query")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = rows.select("vec_id", F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("embedding"), "query")
    rows = rows.select("*", F.xxhash64("embedding").alias("a"), F.xxhash64(F.lit(1), "embedding").alias("b"))
    least = Window.partitionBy("a", "b").orderBy("vec_id")
    first = rows.withColumn("r", F.row_number().over(least)).where(F.col("r") <= k + 1)  # an answer, and the query itself
    index = _packed(first.groupBy("a", "b").agg(F.first("embedding").alias("embedding"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "vector-index")
    asked = _packed(rows.where("query").groupBy("a", "b").agg(F.first("embedding").alias("embedding")), "vector-queries")

    n, m, cores = index.count(), asked.count(), spark.sparkContext.defaultParallelism
    asked_blocks = max(1, -(-m // block_queries))
    blocks = max(1, -(-n // block_entries), min(-(-n // LEAST), 2 * cores // asked_blocks))
    codes = index.select("dim", F.col("n").alias("e"), "code", "scalar")
    turned = asked.select("dim", F.col("n").alias("q"), "vector")
    first_most, all_most = k + 1, 4 * (k + 1)

    def guess(codes: np.ndarray, scalars: np.ndarray, queries: pd.DataFrame):
        return best_estimates(codes, scalars, turn(_floats(queries["vector"], int(queries["dim"].iloc[0]))), first_most)

    def meet(codes: np.ndarray, scalars: np.ndarray, queries: pd.DataFrame):
        return survivors(codes, scalars, turn(_floats(queries["vector"], int(queries["dim"].iloc[0]))), queries["bar"].to_numpy(), error_span)

    best = Window.partitionBy("q").orderBy(F.desc("near"), "e")
    guessed = _compared(codes, turned, (blocks, asked_blocks), guess).withColumn("r", F.row_number().over(best)).where(F.col("r") <= all_most).select("q", "e")
    tried = stored(guessed, "vector-guesses")
    so_far = Window.partitionBy("q").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    summed = _exact(tried, index, asked).select("q", "score", F.sum(F.size("ids")).over(so_far).alias("sum"))
    bars = summed.groupBy("q").agg((F.coalesce(F.max(F.when(F.col("sum") > k, F.col("score"))), F.lit(-2.0)) - ROUNDING).alias("bar"))
    found = _compared(codes, turned.join(stored(bars, "vector-bars"), "q"), (blocks, asked_blocks), meet)
    pairs = found.select("q", "e").union(tried).distinct()

    each = _exact(pairs, index, asked).select("q", "own", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = each.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    lists = top.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score", "own"))).alias("top"))
    lists = lists.join(asked.select(F.col("n").alias("q"), "a", "b"), "q").select("a", "b", "top")
    answers = rows.where("query").select(F.col("vec_id").alias("query_id"), "a", "b").join(lists, ["a", "b"])
    own = F.array_position(F.transform("top", lambda x: x["own"] & (x["vec_id"] == F.col("query_id"))), True)  # the query itself, 0 if it isn't there
    others = F.filter("top", lambda x: x["r"] != own).alias("top")
    ranked = answers.select("query_id", others).select("query_id", F.posexplode(F.slice("top", 1, k)).alias("rank", "x"))
    return ranked.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.vec_id").cast(id_type).alias("vec_id"), "x.score")


#: DuckDB SQL for the five nearest of the vectors whose ids 50 divides, over the table embeddings: all pairs, exactly.
SQL = """
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL
), usable AS MATERIALIZED (
  SELECT r, vec_id, v, sqrt(list_inner_product(v, v)) AS norm FROM vectors
  WHERE len(list_filter(v, lambda x: isfinite(x))) = len(v) AND len(list_filter(v, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) / (q.norm * c.norm) AS score
  FROM usable q JOIN usable c ON len(c.v) = len(q.v) AND c.r <> q.r WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
