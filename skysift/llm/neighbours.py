"""Approximate nearest neighbours: a navigable small-world graph per shard.

Equal vectors are one node; distinct vectors are dealt to shards of bounded size
by hash. A task builds the layered graph of a shard and stores it as one row of flat
arrays. Blocks of queries meet every shard; results are merged by exact distance and
expanded to all rows of equal vectors, so many copies of a vector neither crowd a
graph nor a task.

Defined results: vectors that are null, all zero, or hold null or non-finite parts take
no part, nor do rows without id; rows alike in id and vector count once; queries and
candidates of another length than each other never meet; fewer candidates than k give all.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skysift.session import TableStore

SHARD_ROWS = 4096
QUERY_ROWS = 512
LINKS = 12
EF_BUILD, EF_SEARCH = 64, 96


class Graph:
    """Layered small-world graph over the rows of a matrix; neighbours[level] is an n x width array, -1 where free."""

    def __init__(self, vectors: np.ndarray, neighbours: list[np.ndarray] | None = None, entry: int = 0):
        self.vectors = vectors.astype(np.float32)
        self.neighbours = neighbours or []
        self.entry = entry
        self.stamp = np.zeros(len(vectors), np.int64)
        self.turn = 0

    def search(self, q: np.ndarray, entries: list[tuple[float, int]], ef: int, level: int) -> list[tuple[float, int]]:
        """The ef nearest nodes found on a level, nearest first, as (squared distance, node)."""
        self.turn += 1
        links, stamp, vectors = self.neighbours[level], self.stamp, self.vectors
        near = list(entries)
        heapq.heapify(near)
        best = [(-d, i) for d, i in entries]
        heapq.heapify(best)
        for _, i in entries:
            stamp[i] = self.turn
        while near:
            d, i = heapq.heappop(near)
            if len(best) >= ef and d > -best[0][0]:
                break
            row = links[i]
            row = row[row >= 0]
            row = row[stamp[row] != self.turn]
            if not len(row):
                continue
            stamp[row] = self.turn
            away = vectors[row] - q
            for dist, j in zip(np.einsum("ij,ij->i", away, away).tolist(), row.tolist(), strict=True):
                if len(best) < ef:
                    heapq.heappush(best, (-dist, j))
                    heapq.heappush(near, (dist, j))
                elif dist < -best[0][0]:
                    heapq.heapreplace(best, (-dist, j))
                    heapq.heappush(near, (dist, j))
        return sorted((-d, i) for d, i in best)

    def spread(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Up to `most` nodes, each nearer to the base than to any node taken before; then the nearest of the rest."""
        nodes = np.asarray([i for _, i in found])
        rows = self.vectors[nodes]
        squares = np.einsum("ij,ij->i", rows, rows)
        between = squares[:, None] + squares[None, :] - 2 * rows @ rows.T
        taken: list[int] = []
        closest = np.full(len(nodes), np.inf)
        for k, (d, _) in enumerate(found):
            if d <= closest[k]:
                taken.append(k)
                np.minimum(closest, between[k], out=closest)
                if len(taken) == most:
                    break
        if len(taken) < most:
            left = [k for k in range(len(nodes)) if k not in set(taken)]
            taken += left[: most - len(taken)]
        return nodes[taken].tolist()

    def build(self, seed: int = 5) -> Graph:
        n = len(self.vectors)
        rng = np.random.default_rng(seed)
        levels = np.minimum((-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int), 8)
        self.neighbours = [np.full((n, 2 * LINKS if lv == 0 else LINKS), -1, np.int32) for lv in range(int(levels.max(initial=0)) + 1)]
        for i in range(1, n):
            q, top = self.vectors[i], int(levels[self.entry])
            away = self.vectors[self.entry] - q
            at = [(float(away @ away), self.entry)]
            for lv in range(top, int(levels[i]), -1):
                at = self.search(q, at, 1, lv)
            for lv in range(min(top, int(levels[i])), -1, -1):
                at = self.search(q, at, EF_BUILD, lv)
                chosen = self.spread(at, LINKS)
                self.neighbours[lv][i, : len(chosen)] = chosen
                for j in chosen:
                    self._link(j, i, lv)
            if levels[i] > top:
                self.entry = i
        return self

    def _link(self, j: int, i: int, level: int) -> None:
        row = self.neighbours[level][j]
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = i
            return
        every = np.append(row, i)
        away = self.vectors[every] - self.vectors[j]
        dist = np.einsum("ij,ij->i", away, away)
        order = np.argsort(dist, kind="stable")
        row[:] = self.spread([(float(dist[k]), int(every[k])) for k in order], len(row))

    def nearest(self, q: np.ndarray, ef: int) -> list[int]:
        q = q.astype(np.float32)
        away = self.vectors[self.entry] - q
        at = [(float(away @ away), self.entry)]
        for lv in range(len(self.neighbours) - 1, 0, -1):
            at = self.search(q, at, 1, lv)
        return [i for _, i in self.search(q, at, ef, 0)]


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def prepared(df: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """vec_id, vector, node (smallest id of equal vectors), of each vector the k + 1 rows of smallest id."""
    rows = df.select(df[id_col].cast("long").alias("vec_id"), F.transform(df[vector_col].cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector"))).distinct()
    same = Window.partitionBy("vector").orderBy("vec_id")
    rows = rows.withColumn("_n", F.row_number().over(same)).filter(F.col("_n") <= k + 1)
    return rows.withColumn("node", F.min("vec_id").over(Window.partitionBy("vector"))).select("vec_id", "vector", "node", "_n")


def index(nodes: DataFrame, shards: int) -> DataFrame:
    """One row per shard and vector length: ids, vectors and graph as flat arrays."""
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards))).withColumn("dims", F.size("vector"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        vectors = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
        graph = Graph(vectors).build()
        widths = [a.shape[1] for a in graph.neighbours]
        flat = np.concatenate([a.ravel() for a in graph.neighbours])
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "dims": [pdf["dims"].iloc[0]], "ids": [pdf["node"].to_numpy(np.int64).tobytes()],
                             "vectors": [vectors.tobytes()], "widths": [widths], "links": [flat.tobytes()], "entry": [graph.entry]})

    return dealt.groupBy("shard", "dims").applyInPandas(build, "shard long, dims int, ids binary, vectors binary, widths array<int>, links binary, entry long")


def search(df: DataFrame, store: TableStore, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
           shard_rows: int = SHARD_ROWS, ef: int = EF_SEARCH) -> DataFrame:
    """query_id, rank, vec_id, score for the k nearest rows of each query row (`queries` is a condition on vec_id)."""
    rows = store.write(prepared(df, id_col, vector_col, k), "vectors")
    nodes = rows.filter("vec_id = node").select("node", "vector")
    shards = max(1, -(-nodes.count() // shard_rows))
    graphs = store.write(index(nodes, shards), "index")
    asked = df.select(df[id_col].cast("long").alias("vec_id"), F.transform(df[vector_col].cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vector"))
    asked = store.write(asked.filter(F.col("vec_id").isNotNull() & queries & usable(F.col("vector"))).distinct(), "queries")
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("dims", F.size("vector"))
    dealt = dealt.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    placed = graphs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(left) and len(right):
            g = left.iloc[0]
            ids = np.frombuffer(g["ids"], np.int64)
            vectors = np.frombuffer(g["vectors"], np.float64).reshape(len(ids), -1)
            cuts = np.cumsum([len(ids) * int(w) for w in g["widths"]])
            parts = np.split(np.frombuffer(g["links"], np.int32), cuts[:-1])
            graph = Graph(vectors, [p.reshape(len(ids), int(w)) for p, w in zip(parts, g["widths"], strict=True)], int(g["entry"]))
            for q, v in zip(right["vec_id"], right["vector"], strict=True):
                v = np.asarray(v, np.float64)
                found = graph.nearest(v, max(ef, k + 1))
                away = vectors[found] - v
                dist = np.sqrt((away * away).sum(axis=1))
                order = np.lexsort((ids[found], dist))[: k + 1]
                out += [(int(q), int(ids[found[i]]), float(dist[i])) for i in order]
        return pd.DataFrame(out, columns=["query_id", "node", "score"])

    keys = ["shard", "dims", "block"]
    found = placed.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(look, "query_id long, node long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "node")
    found = found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k + 1).drop("_n")
    members = found.join(rows.select("node", "vec_id"), "node").filter("vec_id <> query_id").select("query_id", "vec_id", "score").distinct()
    final = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return members.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
