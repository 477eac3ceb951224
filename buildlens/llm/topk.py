"""Exact top-k inner products: tiles of queries times shards of candidates, merged as a tree.

Queries are dealt into tiles and candidates into shards of bounded size by hashes of their ids. Each cell (tile,
shard) is one matrix product; a partial selection keeps ``k`` candidates of each query. The kept rows of the cells are
merged shard group by shard group, ``FAN_IN`` at a time, until each query has one list. Products are exact: components
are whole numbers, and a cell whose products could leave the range in which doubles count exactly is multiplied as
64-bit integers, or, where these could overflow, as integers of any length. A component or a score beyond 64 bits raises.

Vectors that are null, empty, or hold a null or a component that is not finite take no part. Vectors meet only those of
equal length. Repeated rows each count; rows with the query's own id are left out. Null ids take no part as queries, and
no row with a null id is a candidate. Ties go to the smaller id. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buildlens.llm.common import table

#: Rows of a tile and of a shard on average, and lists that one merge takes together.
TILE_ROWS, SHARD_ROWS, FAN_IN = 1024, 8192, 16
#: Largest sum of products that doubles hold exactly.
EXACT = 2.0**53
#: Scores and components beyond it have no 64-bit integer.
LIMIT = 2.0**63


def _whole(x: Column) -> Column:
    return F.when(F.abs(x) < F.lit(LIMIT), F.floor(x).cast("long")).otherwise(F.raise_error(F.lit("a component is beyond 64 bits")).cast("long"))


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(id, v): components as floor(scale * x) in doubles, only of vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite)
        .select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: _whole(x * F.lit(scale))).alias("v"))
    )


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        bound = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= bound)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))][:k]


def _cell(k: int):
    def product(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int, int]] = []
        if len(queries) and len(candidates):
            q, c, own = _matrix(queries["v"]), _matrix(candidates["cv"]), candidates["cid"].to_numpy()
            most = float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1]
            kind = float if most < EXACT else np.int64 if most < LIMIT else object
            ct = c.astype(kind).T
            for row, (qid, tile, copies) in enumerate(zip(queries["id"], queries["tile"], queries["copies"])):
                if row % 128 == 0:  # a stripe of the tile at a time bounds the memory of the product
                    block = q[row : row + 128].astype(kind) @ ct
                scores = block[row % 128]
                others = np.flatnonzero(own != qid)
                got = scores[others]
                if kind is object:
                    if not all(-(1 << 63) <= x < 1 << 63 for x in got):
                        raise OverflowError("a score is beyond 64 bits")
                    got = got.astype(np.int64)
                best = others[_best(got, own[others], k)].repeat(min(copies, k))[:k]
                out += [(qid, int(candidates["shard"].iloc[0]), int(own[p]), int(scores[p]), int(tile)) for p in best]
        return pd.DataFrame(out, columns=["query_id", "shard", "vec_id", "score", "tile"])

    return product


def top_k(queries: DataFrame, candidates: DataFrame, k: int, tile_rows: int = TILE_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best candidates of every query; both sides are (id, v).

    Query rows with one id have one list together. Equal ones are worked out once, and each of their pairs counts as often
    as the row is there.
    """
    queries = queries.groupBy("id", "v").agg(F.count(F.lit(1)).alias("copies"))
    n_queries, n_candidates = queries.count(), candidates.count()
    tiles, shards = max(1, math.ceil(n_queries / tile_rows)), max(1, math.ceil(n_candidates / shard_rows))
    spot = lambda n, seed: F.pmod(F.xxhash64("id", "v", F.lit(seed)), F.lit(n)).cast("int")
    dims = F.size("v").alias("dims")
    left = queries.select("id", "v", "copies", dims, spot(tiles, 1).alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    right = candidates.select(F.col("id").alias("cid"), F.col("v").alias("cv"), dims, F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), spot(shards, 2).alias("shard"))
    cell = ["tile", "shard", "dims"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(_cell(k), "query_id long, shard int, vec_id long, score long, tile int")
    found = found.select("query_id", "shard", "vec_id", "score")
    while shards > FAN_IN:
        shards = math.ceil(shards / FAN_IN)
        found = found.withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("int"))
        found = _first(found, ["query_id", "shard"], k).drop("rank")
    return _first(found.drop("shard"), ["query_id"], k).select("query_id", "rank", "vec_id", "score")


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("vec_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors.filter(F.col("id") % 50 == 0), vectors, 5)


QUERIES = {"op10_exact_topk": op10_exact_topk}
SQL = {
    "op10_exact_topk": """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
}
