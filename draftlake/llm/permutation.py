"""Nearest neighbours by a permutation index: vectors are known by their nearest pivots in order.

The vectors are dealt over blocks of about ``BLOCK`` rows. In a block every vector is posted to the inverted files of its
``PREFIX`` nearest pivots, with the pivot's rank. A query adds up rank differences (footrule distance; a missing pivot counts
as rank ``PREFIX``) over the files of its own nearest pivots, and the ``SHARE`` of the block that is closest by it, ties
included, is ranked again by true distance. Blocks work apart, so neither the index nor a query meets in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from draftlake.session import cut

PIVOTS, PREFIX = 256, 64
SHARE = 0.2
LEAST = 64        # vectors of a block that are ranked again at least
BLOCK = 16_384
CHUNK = 2_048     # queries that visit a block together


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors in double precision that are neither null nor zero, with finite components only."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    return rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")


def orders(block: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The ``prefix`` nearest pivots of each vector, nearest first."""
    distance = (pivots**2).sum(axis=1) - 2 * block @ pivots.T
    prefix = min(prefix, len(pivots))
    near = np.argpartition(distance, prefix - 1, axis=1)[:, :prefix]
    return np.take_along_axis(near, np.argsort(np.take_along_axis(distance, near, axis=1), axis=1, kind="stable"), axis=1)


class InvertedFiles:
    """Postings (row, rank) of each pivot over one block of vectors."""

    def __init__(self, block: np.ndarray, pivots: np.ndarray, prefix: int):
        near = orders(block, pivots, prefix)
        self.prefix, self.size = near.shape[1], len(block)
        flat = near.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.rows, self.ranks = by_pivot // self.prefix, (by_pivot % self.prefix).astype(np.int32)
        self.bounds = np.searchsorted(flat[by_pivot], np.arange(len(pivots) + 1))

    def footrules(self, order: np.ndarray) -> np.ndarray:
        """Footrule distance of every vector of the block to a query's order, less a constant."""
        total = np.zeros(self.size, np.int32)
        for rank, pivot in enumerate(order):
            part = slice(self.bounds[pivot], self.bounds[pivot + 1])
            ranks = self.ranks[part]
            # A shared pivot costs |rank - ranks|; two unshared ones cost prefix - rank each.
            total[self.rows[part]] += np.abs(ranks - rank) - (self.prefix - rank) - (self.prefix - ranks)
        return total


def search_block(ids: np.ndarray, block: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, k: int) -> pd.DataFrame:
    files = InvertedFiles(block, pivots, PREFIX)
    wanted = min(len(block), max(LEAST, math.ceil(SHARE * len(block))))
    found = []
    for query_id, query, order in zip(query_ids, queries, orders(queries, pivots, PREFIX), strict=True):
        rule = files.footrules(order)
        near = np.flatnonzero(rule <= np.partition(rule, wanted - 1)[wanted - 1])
        near = near[ids[near] != query_id]
        distance = np.sqrt(((block[near] - query) ** 2).sum(axis=1))
        best = np.lexsort((ids[near], distance))[:k]
        found.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[near][best], "score": distance[best]}))
    return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def neighbours(vectors: DataFrame, k: int = 10, every: int = 100, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row whose id is divisible by ``every``, by Euclidean distance.

    All rows but the query's own are candidates; ties go to the smaller vec_id; fewer candidates give fewer rows. Vectors
    null, zero or holding a null, NaN or infinite component take no part, nor do rows with a null id, nor vectors of another
    length than most (the longer one if as many). Rows that repeat an id and vector count once; equal vectors under different
    ids are all candidates, but only the ``k + 1`` smallest ids of one vector can be among the nearest and are indexed.
    Pivots are ``PIVOTS`` of the distinct vectors, those of least hash. Other columns are not read; an empty table gives no rows.
    """
    rows = usable(vectors, key, vector).distinct()
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    width = lengths[0]["n"] if lengths else 0
    rows = cut(rows.where(F.size("v") == width))
    w = Window.partitionBy("v").orderBy("vec_id")
    index = rows.withColumn("at", F.row_number().over(w)).where(f"at <= {k + 1}").select("vec_id", "v")
    queries = rows.where(F.col("vec_id") % every == 0)
    chosen = rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(PIVOTS).collect()
    pivots = np.array([r["v"] for r in chosen]) if chosen else np.zeros((0, width))
    shared = rows.sparkSession.sparkContext.broadcast(pivots)
    n = rows.count()
    blocks, parts = max(1, math.ceil(n / BLOCK)), max(1, math.ceil(n / every / CHUNK))
    own = index.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = queries.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return search_block(own["vec_id"].to_numpy(), np.vstack(own["v"]), asked["vec_id"].to_numpy(), np.vstack(asked["v"]), shared.value, k)

    found = own.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(search, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
