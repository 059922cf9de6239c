"""Exact top-k search by inner product with a KD-tree per shard.

Repeated rows are dropped, and vectors are dealt into shards of bounded size. Each shard is split at medians of
its widest components into a tree whose nodes carry tight bounding boxes, and
the trees are written as a table. Queries travel in blocks: first to one shard,
whose k-th score is handed on, then to all others, where it prunes from the
start. Inside a tree, nodes are visited best first by the largest inner product
their box allows, until no box can beat the k-th score.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymart.session import fresh_folder

SHARD_ROWS = 16384
LEAF_ROWS = 128
BLOCK_QUERIES = 256
#: A task holds one tree and at most about this many blocks of queries.
LOAD_BLOCKS = 128
TREES = "shard long, dim int, ids binary, vectors binary, left binary, right binary, first binary, last binary, low binary, high binary"
BLOCKS = "block long, dim int, query_ids binary, queries binary, floors binary"
FOUND = "query_id long, vec_id long, score long"
#: Products of smaller integers add up exactly in double precision.
EXACT = 2.0**53


def build_tree(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF_ROWS) -> dict[str, np.ndarray]:
    """Median splits down to ``leaf`` rows; equal vectors are split by place.

    Nodes are numbered from the root 0; a leaf has no children (-1).
    """
    order = np.arange(len(ids))
    left, right, first, last, low, high = [], [], [], [], [], []
    waiting = [(0, len(ids), -1, False)]
    while waiting:
        a, b, parent, is_right = waiting.pop()
        node = len(first)
        if parent >= 0:
            (right if is_right else left)[parent] = node
        rows = vectors[order[a:b]]
        small, large = rows.min(0), rows.max(0)
        left.append(-1)
        right.append(-1)
        first.append(a)
        last.append(b)
        low.append(small)
        high.append(large)
        if b - a > leaf and (large > small).any():
            axis = int(np.argmax(large - small))
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(rows[:, axis], middle)]
            waiting += [(a, a + middle, node, False), (a + middle, b, node, True)]
    return {
        "ids": ids[order], "vectors": vectors[order], "left": np.array(left), "right": np.array(right),
        "first": np.array(first), "last": np.array(last), "low": np.array(low), "high": np.array(high),
    }


def search_tree(tree: dict[str, np.ndarray], ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int):
    """Per query the ``k`` best distinct pairs (score, -vec_id) of a tree.

    ``floors`` are scores that k pairs elsewhere reach already: only pairs of at
    least that score are returned. Rows of the query's own id take no part.
    """
    vectors, rows = tree["vectors"], tree["ids"]
    dim = max(queries.shape[1], 1)
    largest = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * dim
    number = np.float64 if largest < EXACT else object
    vectors, queries = vectors.astype(number), queries.astype(number)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    bounds = up @ tree["high"].astype(number).T + down @ tree["low"].astype(number).T
    left, right = tree["left"].tolist(), tree["right"].tolist()
    first, last = tree["first"].tolist(), tree["last"].tolist()
    out = []
    for at, query in enumerate(queries):
        box, floor, own = bounds[at].tolist(), floors[at], ids[at]
        best: list[tuple] = []
        held: set[tuple] = set()
        waiting = [(-box[0], 0)]
        while waiting:
            bound, node = heapq.heappop(waiting)
            # A box that only reaches the k-th score may hold a smaller id.
            if -bound < floor:
                break
            if left[node] >= 0:
                for child in (left[node], right[node]):
                    if box[child] >= floor:
                        heapq.heappush(waiting, (-box[child], child))
                continue
            part = slice(first[node], last[node])
            scores = vectors[part] @ query
            good = np.flatnonzero(scores >= floor)
            for score, row in zip(scores[good].tolist(), rows[part][good].tolist()):
                pair = (score, -row)
                # Vectors of one id may score the same and take one place.
                if row == own or pair in held:
                    continue
                if len(best) < k:
                    heapq.heappush(best, pair)
                elif pair > best[0]:
                    held.discard(heapq.heapreplace(best, pair))
                else:
                    continue
                held.add(pair)
            if len(best) == k:
                floor = max(floor, best[0][0])
        out.append(best)
    return out


def plant(leaf: int):
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        dim = key[1]
        vectors = np.array(rows["vector"].tolist(), np.int64).reshape(len(rows), dim)
        tree = build_tree(rows["vec_id"].to_numpy(np.int64), vectors, leaf)
        return pd.DataFrame([{"shard": key[0], "dim": dim} | {name: part.astype("<i8").tobytes() for name, part in tree.items()}])

    return run


def gather(key, rows: pd.DataFrame) -> pd.DataFrame:
    vectors = np.array(rows["vector"].tolist(), np.int64)
    return pd.DataFrame(
        [{
            "block": key[0], "dim": key[1], "query_ids": rows["vec_id"].to_numpy("<i8").tobytes(),
            "queries": vectors.astype("<i8").tobytes(), "floors": rows["floor"].to_numpy("<f8").tobytes(),
        }]
    )


def visit(k: int):
    def run(key, trees: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(trees) and len(blocks):
            row, dim = trees.iloc[0], int(key[2])
            tree = {name: np.frombuffer(row[name], "<i8") for name in ("ids", "left", "right", "first", "last")}
            tree["vectors"] = np.frombuffer(row["vectors"], "<i8").reshape(len(tree["ids"]), dim)
            for name in ("low", "high"):
                tree[name] = np.frombuffer(row[name], "<i8").reshape(len(tree["first"]), dim)
            for block in blocks.itertuples():
                ids = np.frombuffer(block.query_ids, "<i8")
                queries = np.frombuffer(block.queries, "<i8").reshape(len(ids), dim)
                found = search_tree(tree, ids, queries, np.frombuffer(block.floors, "<f8"), k)
                out += [(int(query), -other, int(score)) for query, best in zip(ids, found) for score, other in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def integers(table: DataFrame, scale: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``vec_id`` and ``vector`` as whole numbers, without unusable rows."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return table.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & good).select(
        F.col(key).cast("long").alias("vec_id"), whole.alias("vector")
    )


def search(vectors: DataFrame, queries: DataFrame, k: int, shard_rows: int = SHARD_ROWS,
           leaf_rows: int = LEAF_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The ``k`` best rows of ``vectors`` for each row of ``queries``.

    Both tables hold ``vec_id`` and ``vector`` (array of long). Scores are whole
    inner products; ties go to the smaller id; rows with the query's id take no
    part; vectors of another length score nothing. Returns ``query_id``,
    ``rank``, ``vec_id``, ``score``. A query id that is repeated is asked once,
    by its first vector in order; repeated candidates count once per id and
    score, before the ``k`` best are taken. Empty tables give an empty table. Scores must fit into a long.
    """
    spark = vectors.sparkSession
    single = fresh_folder(spark, "vectors")
    vectors.select("vec_id", "vector").distinct().write.parquet(single)
    vectors = spark.read.parquet(single)
    shards = max(1, -(-vectors.count() // shard_rows))
    folder = fresh_folder(spark, "trees")
    # By id and vector, so that an id with many vectors fills no shard alone.
    (
        vectors.withColumns({"shard": F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)), "dim": F.size("vector")})
        .groupBy("shard", "dim")
        .applyInPandas(plant(leaf_rows), TREES)
        .write.parquet(folder)
    )
    trees = spark.read.parquet(folder)
    asked = queries.groupBy(F.col("vec_id")).agg(F.min("vector").alias("vector"))
    blocks = max(1, -(-asked.count() // block_queries))
    asked = asked.withColumns({"block": F.pmod(F.xxhash64("vec_id"), F.lit(blocks)), "dim": F.size("vector")})

    def found(rows: DataFrame, targets) -> DataFrame:
        grouped = rows.groupBy("block", "dim").applyInPandas(gather, BLOCKS)
        sent = grouped.withColumn("shard", F.explode(targets))
        sent = sent.withColumn("load", F.floor(F.col("block") / LOAD_BLOCKS).cast("long"))
        loads = F.sequence(F.lit(0).cast("long"), F.lit((blocks - 1) // LOAD_BLOCKS).cast("long"))
        keys = ["shard", "load", "dim"]
        left = trees.withColumn("load", F.explode(loads)).groupBy(*keys)
        return left.cogroup(sent.groupBy(*keys)).applyInPandas(visit(k), FOUND)

    home = F.pmod(F.col("block"), F.lit(shards))
    seeds = fresh_folder(spark, "seeds")
    found(asked.withColumn("floor", F.lit(float("-inf"))), F.array(home)).write.parquet(seeds)
    near = spark.read.parquet(seeds)
    # A tree gives each pair once, so these are k different ones.
    kth = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
    floored = asked.join(kth, asked["vec_id"] == kth["query_id"], "left").select(
        "vec_id", "vector", "block", "dim",
        F.when(F.col("n") >= k, F.col("kth")).otherwise(F.lit(float("-inf"))).cast("double").alias("floor"),
    )
    others = F.array_except(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")), F.array(home))
    all_found = near.union(found(floored, others)) if shards > 1 else near
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        all_found.distinct()
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op10_vector_search(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    vectors = integers(table, 256)
    return search(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
