"""Exact top-k search by inner product, with block-at-a-time pruning.

Vectors are integers: every component x becomes ``floor(64 * x)``. A component is a term whose
weight in a document may be negative, so a block of documents keeps the largest and the
smallest weight of each term. For a query, ``sum(max(q * largest, q * smallest))`` over the
terms bounds every score in the block.

* Documents are dealt into ranges of (coarse cell, id hash) and each range is cut into blocks.
  Vectors of one cell lie together, which makes bounds tight; equal vectors split by the hash.
* A block is a packed forward index: ids and a weight matrix. Blocks of one range form a stripe,
  the unit that travels; its size is fixed, so no task holds more than one stripe and one group
  of queries.
* Pass 1 searches every query in one stripe, that of its own cell, and so gets a lower bound for
  its k-th best score. Pass 2 meets every query group with every other stripe. In both, blocks
  are visited in the order of their bounds until the bounds fall below the k-th score so far;
  only scores at or above the known bound leave the task.
* The best of all stripes are ranked per query (at most k per stripe).

The stated queries meet all rows in blocks; nothing is approximate.

Defined cases: a vector that is NULL or holds a NULL, NaN or infinite component takes no part,
nor does a row without id; vectors of different lengths are compared as if the missing
components were 0; equal rows (same id and vector) are one row; a query never returns a row of
its own id; ties go to the smaller id; scores beyond 64 bits are held at the limit; fewer than k
candidates give them all; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import held, table

SCALE = 64
BLOCK_ROWS = 128
STRIPE_ROWS = 8192
GROUP_ROWS = 2048
FOUND = "query_id bigint, vec_id bigint, score bigint"
_EXACT = 2.0**52
_LIMIT = 2**63 - 1


def usable(vector: Column) -> Column:
    """Whether a vector exists and holds finite numbers only."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, bad), F.lit(False))


def integral(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def _pack(rows: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def _scores(queries: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Inner products as exact 64-bit integers."""
    if not queries.size or not docs.size:
        return np.zeros((len(queries), len(docs)), dtype=np.int64)
    if np.abs(queries).max() * np.abs(docs).max() * queries.shape[1] < _EXACT:
        return (queries @ docs.T).astype(np.int64)
    whole = np.array([[int(x) for x in q] for q in queries], dtype=object) @ np.array([[int(x) for x in d] for d in docs], dtype=object).T
    return np.array([[max(-_LIMIT, min(_LIMIT, x)) for x in row] for row in whole], dtype=np.int64)


class Best:
    """The k best (score, id) of one query so far: higher scores first, then smaller ids."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor = k, floor
        self.scores, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    @property
    def bar(self) -> int:
        """Scores below it cannot count."""
        return max(self.floor, int(self.scores[-1])) if len(self.scores) == self.k else self.floor

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.bar
        scores, ids = np.append(self.scores, scores[good]), np.append(self.ids, ids[good])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def search_blocks(query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, ids: np.ndarray, docs: np.ndarray,
                  k: int, block_rows: int = BLOCK_ROWS) -> pd.DataFrame:
    """The k best of each query among ``docs``, block by block in the order of their bounds."""
    cuts = range(0, len(ids), block_rows)
    high = np.stack([docs[a : a + block_rows].max(axis=0) for a in cuts])
    low = np.stack([docs[a : a + block_rows].min(axis=0) for a in cuts])
    # a small slack keeps rounded bounds above the exact ones
    bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    bounds += np.abs(bounds) * 1e-9 + 1
    best = [Best(k, int(f)) for f in floors]
    order = np.argsort(-bounds, axis=1, kind="stable")
    for turn in range(order.shape[1]):
        # in each turn every query that is still open asks for its next block
        asked: dict[int, list[int]] = {}
        for q in range(len(queries)):
            if bounds[q, order[q, turn]] >= best[q].bar:
                asked.setdefault(int(order[q, turn]), []).append(q)
        if not asked:
            break
        for block, some in asked.items():
            span = slice(block * block_rows, (block + 1) * block_rows)
            scores = _scores(queries[some], docs[span])
            for q, row in zip(some, scores):
                mine = ids[span] != query_ids[q]
                best[q].offer(row[mine], ids[span][mine])
    return pd.DataFrame({
        "query_id": np.repeat(query_ids, [len(b.ids) for b in best]),
        "vec_id": np.concatenate([b.ids for b in best]), "score": np.concatenate([b.scores for b in best]),
    })


def _searcher(k: int, block_rows: int):
    def search(docs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if docs.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        docs = docs.sort_values(["cell", "tie"], kind="stable")
        dims = max(max(map(len, docs["v"])), max(map(len, queries["q"])))
        return search_blocks(
            queries["q_id"].to_numpy(), _pack(queries["q"], dims), queries["floor"].to_numpy(),
            docs["id"].to_numpy(), _pack(docs["v"], dims), k, block_rows,
        )

    return search


def cell(vector: Column) -> Column:
    """A coarse place of a vector: its largest component and that one's sign, then the runner-up."""
    by_size = F.transform(vector, lambda x, i: F.struct(F.abs(x).alias("size"), (i * 2 + F.when(x < 0, 1).otherwise(0)).alias("code")))
    top = F.slice(F.sort_array(by_size, asc=False), 1, 2)
    code = lambda n: F.coalesce(F.get(top, F.lit(n))["code"], F.lit(0))
    return (code(0) * 100_000 + code(1)).cast("long")


def top_k(vectors: DataFrame, queries: Column, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = SCALE, stripe_rows: int = STRIPE_ROWS, group_rows: int = GROUP_ROWS,
          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row that ``queries`` holds for."""
    v = F.col(vector_col)
    rows = (
        vectors.where(F.col(id_col).isNotNull() & usable(v))
        .select(F.col(id_col).cast("long").alias("id"), integral(v, scale).alias("v"), queries.alias("asks"))
        .distinct()
        .withColumn("cell", cell(F.col("v"))).withColumn("tie", F.xxhash64("id", "v"))
    )
    rows = held(rows, "topk-rows")
    n = rows.count()
    stripes = max(1, -(-n // stripe_rows))
    striped = held(
        rows.repartitionByRange(stripes, "cell", "tie").withColumn("stripe", F.spark_partition_id()), "topk-stripes")
    asks = striped.where("asks").select(
        F.col("id").alias("q_id"), F.col("v").alias("q"), F.col("stripe").alias("home"))
    lowest = F.lit(-_LIMIT).cast("long")
    docs = striped.select("id", "v", "cell", "tie", "stripe")
    search = _searcher(k, block_rows)

    # pass 1: at home; the queries of one stripe are some of its rows
    home = held(
        docs.groupBy("stripe").cogroup(asks.withColumn("floor", lowest).groupBy("home"))
        .applyInPandas(search, FOUND), "topk-home")
    floors = home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
    # pass 2: every group of queries at every other stripe
    groups = max(1, -(-asks.count() // group_rows))
    away = (
        asks.join(floors.select(F.col("query_id").alias("q_id"), "kth"), "q_id", "left")
        .select("q_id", "q", "home", F.coalesce("kth", lowest).alias("floor"), F.pmod(F.xxhash64("q_id"), F.lit(groups)).alias("q_grp"),
                F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("away"))
        .where("away <> home")
    )
    spread = docs.withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    found = spread.groupBy("stripe", "grp").cogroup(away.groupBy("away", "q_grp")).applyInPandas(search, FOUND)
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        home.unionByName(found)
        .withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id,
    list_dot_product(q.c::DOUBLE[], d.c::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""
