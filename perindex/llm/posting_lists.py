"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample, split until their lists are balanced. A vector goes
to the list of its nearest centroid and, near a boundary, to several. Centroids are found by a
walk through their neighbour graph. A query looks into the lists whose centroids are not much
farther than its nearest one. Long lists are dealt into chunks, and equal vectors are one entry
with its smallest ids, so no list or group of copies falls to a single task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perindex.session import materialize

#: Vectors that the centroids are fitted on, on average; and the most centroids (the broadcast is bounded by it).
SAMPLE, CENTROIDS = 40_000, 4096
#: Sample vectors in a list, at most, before it is split; entries of a chunk of a list.
LIST_SAMPLE, CHUNK = 400, 4000
#: A vector joins up to COPIES lists that are at most BOUNDARY times as far as its nearest.
COPIES, BOUNDARY = 4, 1.15
#: A query looks into up to PROBES lists that are at most PRUNE times as far as its nearest.
PROBES, PRUNE = 24, 1.6
#: Neighbours in the centroid graph, and the width of the walk through it.
DEGREE, BEAM = 24, 48


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def fit_centroids(sample: np.ndarray, list_sample: int = LIST_SAMPLE, most: int = CENTROIDS) -> np.ndarray:
    """Centroids by repeated two-means: a cell of more than ``list_sample`` vectors is split in two."""
    rng = np.random.default_rng(7)
    cells, done = [sample], []
    while cells:
        cell = cells.pop()
        if len(cell) <= list_sample or len(cells) + len(done) >= most - 1:
            done.append(cell.mean(axis=0))
            continue
        pair = cell[rng.choice(len(cell), 2, replace=False)].astype(float)
        for _ in range(8):
            side = squared(cell, pair)
            first = side[:, 0] - side[:, 1] <= np.median(side[:, 0] - side[:, 1])  # halves: balanced by design
            if first.all() or not first.any():
                break
            pair = np.stack([cell[first].mean(axis=0), cell[~first].mean(axis=0)])
        if first.all() or not first.any():
            done.append(cell.mean(axis=0))
        else:
            cells += [cell[first], cell[~first]]
    return np.unique(np.array(done), axis=0)


class CentroidGraph:
    """Centroids with their nearest neighbours; the nearest ones of a point by a walk along the links."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        size = len(centroids)
        degree = min(DEGREE, size - 1)
        links = np.zeros((size, degree), int)
        for at in range(0, size, 512):
            far = squared(centroids[at : at + 512], centroids)
            links[at : at + 512] = np.argsort(far, axis=1, kind="stable")[:, 1 : degree + 1]
        self.links = links
        #: Spread entry points, one for each sixteen centroids.
        self.entries = np.arange(0, size, 16) if size > BEAM else np.arange(size)

    def nearest(self, points: np.ndarray, width: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of the ``width`` nearest centroids found for each point, nearest first."""
        width = min(width, len(self.centroids))
        places, distances = [], []
        for at in range(0, len(points), 256):
            block = points[at : at + 256]
            rows = np.arange(len(block))[:, None]
            known = np.full((len(block), len(self.centroids)), np.inf)
            known[:, self.entries] = squared(block, self.centroids[self.entries])
            opened = np.zeros(known.shape, bool)
            while True:
                beam = np.argpartition(known, width - 1, axis=1)[:, :width]
                fresh = ~opened[rows, beam] & np.isfinite(known[rows, beam])
                if not fresh.any() or not self.links.size:
                    break
                who, which = np.nonzero(fresh)
                heads = beam[who, which]
                opened[who, heads] = True
                points_at = np.repeat(who, self.links.shape[1])
                reached = self.links[heads].ravel()
                new = np.isinf(known[points_at, reached])
                points_at, reached = points_at[new], reached[new]
                gap = block[points_at] - self.centroids[reached]
                known[points_at, reached] = np.einsum("ij,ij->i", gap, gap)
            order = np.take_along_axis(beam, np.argsort(known[rows, beam], axis=1, kind="stable"), axis=1)
            places.append(order)
            distances.append(np.sqrt(known[rows, order]))
        return np.concatenate(places), np.concatenate(distances)


def usable(vector: str) -> Column:
    """Whether a vector is not null, not empty, not all zeros, and holds finite numbers only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def entries(vectors: DataFrame, keep: int) -> DataFrame:
    """``(group, embedding, ids)``: each distinct vector with its ``keep`` smallest ids.

    The row limit of each group acts before the shuffle, so copies never meet in one task.
    """
    ranked = Window.partitionBy("embedding").orderBy("vec_id")
    few = vectors.withColumn("n", F.row_number().over(ranked)).filter(F.col("n") <= keep)
    return few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(
        F.xxhash64("embedding").alias("group"), "embedding", "ids"
    )


def _assign(frame: DataFrame, graph: CentroidGraph, copies: int, ratio: float, columns: str) -> DataFrame:
    names = frame.columns

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            points = np.stack(batch["embedding"].to_numpy()).astype(float)
            places, far = graph.nearest(points, max(copies, BEAM))
            good = far[:, :copies] <= ratio * far[:, :1] + 1e-12
            row, which = np.nonzero(good)
            out = batch.iloc[row].reset_index(drop=True)
            out["list"] = places[row, which]
            yield out[[*names, "list"]]

    return frame.mapInPandas(task, f"{columns}, list long")


def search(
    vectors: DataFrame,
    every: int = 100,
    k: int = 10,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest rows of each row whose id is divisible by ``every``, itself left out.

    Distances are Euclidean, in double precision. Unusable vectors and null ids take no part; vectors
    of another length than most are searched among themselves alone. Repeated rows count as one
    row each id. An empty table gives an empty result.
    """
    schema = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("embedding"))
    rows = rows.filter("vec_id is not null").filter(usable("embedding"))
    sizes = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").collect()
    found = None
    for r in sizes:  # as a rule all vectors have one length
        part = _search(rows.filter(F.size("embedding") == r["size"]), r["count"], every, k, schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], schema)


def _search(rows: DataFrame, total: int, every: int, k: int, schema: str) -> DataFrame:
    distinct = materialize(entries(rows, k + 1), "entries")
    count = distinct.count()
    share = int(min(1.0, SAMPLE / count) * (1 << 30)) + 1
    chosen = distinct.filter(F.pmod(F.xxhash64("group", F.lit(3)), F.lit(1 << 30)) < share).select("embedding")
    sample = np.array([r[0] for r in chosen.collect()], float)
    if not len(sample):
        sample = np.array([r[0] for r in distinct.select("embedding").limit(1).collect()], float)
    graph = CentroidGraph(fit_centroids(sample[np.lexsort(sample.T)]))
    listed = materialize(_assign(distinct, graph, COPIES, BOUNDARY, "group long, embedding array<double>, ids array<long>"), "lists")
    # A list of n entries is dealt into chunks; the counts are one row for each list.
    chunks = listed.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    chunks = F.broadcast(chunks)  # at most CENTROIDS rows
    dealt = listed.join(chunks, "list").withColumn("chunk", F.pmod("group", F.col("chunks")).cast("int")).drop("chunks")
    # Equal queries are one query as well.
    queries = rows.filter(F.col("vec_id") % every == 0).select("embedding").distinct()
    probes = _assign(queries, graph, PROBES, PRUNE, "embedding array<double>")
    probes = probes.join(chunks, "list").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

    def near(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(members):
            points = np.stack(members["embedding"].to_numpy())
            order = members["ids"].map(lambda ids: ids[0]).to_numpy()
            for point in queries["embedding"]:
                gap = points - np.asarray(point)
                far = np.sqrt((gap * gap).sum(axis=1))
                best = np.lexsort((order, far))[: k + 1]
                out += [(point, float(far[i]), members["ids"].iat[i]) for i in best]
        return pd.DataFrame(out, columns=["embedding", "score", "ids"])

    hits = probes.groupBy("list", "chunk").cogroup(dealt.groupBy("list", "chunk")).applyInPandas(
        near, "embedding array<double>, score double, ids array<long>"
    )
    # Of the hits of a query the k + 1 nearest entries, each once, hold the answer.
    pairs = hits.select("embedding", "score", F.explode("ids").alias("vec_id")).distinct()
    best = Window.partitionBy("embedding").orderBy("score", "vec_id")
    pairs = pairs.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
    answers = materialize(pairs.groupBy("embedding").agg(
        F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("answers")), "answers")
    asked = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding").distinct()
    others = F.slice(F.filter("answers", lambda a: a["vec_id"] != F.col("query_id")), 1, k)
    return asked.join(answers, "embedding").select("query_id", F.posexplode(others).alias("n", "a")).select(
        "query_id", (F.col("n") + 1).cast("int").alias("rank"), F.col("a.vec_id").alias("vec_id"), F.col("a.score").alias("score")
    )
