"""Exact search of the largest inner products by a pivot-distance index.

An inner product is a distance in disguise: give every vector one more component, so that all have
the length of the longest, and a query a zero there. Then the nearest vectors have the largest
products. Each vector is keyed by its nearest pivot and its distance from it. By the triangle
inequality no vector of an annulus (a run of neighbouring distances) is nearer to a query than the
annulus is to the query's own distance from the pivot. A query first searches the list of its own
pivot, which gives a score that its answers reach; then it visits the other lists, annuli in the order
of their bounds, as long as a bound still reaches that score. Scores are exact integers throughout.

Equal vectors are one entry with its smallest ids. Lists are dealt into parts and queries into shards,
both of bounded size, and a task has one part and one shard, so no list, key or group of copies falls
to a single task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perindex.session import materialize

#: Entries of a list on average, until there are ``PIVOTS`` lists; entries of a part of a list.
LIST, PIVOTS, PART = 2048, 1024, 50_000
#: Entries that the pivots are fitted on, for each pivot, and the most numbers in all of them.
SAMPLE, SAMPLE_NUMBERS = 16, 1 << 22
#: Queries of a shard, queries that are scored at once, entries of an annulus.
SHARD, BLOCK, ANNULUS = 16_384, 2048, 1024
#: A query vector with more rows than this, and than a thousandth of all, is dealt over more tasks.
HOT_ROWS = 10_000
#: Relative slack of bounds, against the rounding of distances.
SLACK = 1e-9

LONG = (1 << 63) - 1
FOUND = "key string, score long, ids array<long>"


def finite(vector: str) -> Column:
    """Whether a vector and all of its components are neither null nor infinite nor NaN."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def whole_numbers(vectors: DataFrame, scale: float, vec_id: str, embedding: str) -> DataFrame:
    """``(vec_id, vector, key)``: the components as integers ``floor(scale * x)``, each pair of id and vector once."""
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("x"))
    rows = rows.filter("vec_id is not null").filter(finite("x"))
    rows = rows.select("vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("vector"))
    key = F.md5(F.array_join(F.col("vector").cast("array<string>"), ",").cast("binary"))
    return rows.withColumn("key", key).distinct()


def entries(rows: DataFrame, keep: int) -> DataFrame:
    """``(key, vector, ids)``: each distinct vector with its ``keep`` smallest ids; the limit acts before the shuffle."""
    ranked = Window.partitionBy("key", "vector").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(ranked)).filter(F.col("n") <= keep)
    return few.groupBy("key", "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact; beyond 64 bits the nearest long."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = int(max(-int(a.min()), int(a.max()))) * int(max(-int(b.min()), int(b.max()))) * a.shape[1]
    if most < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < LONG:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, -LONG - 1, LONG).astype(np.int64)


class Pivots:
    """Pivots in the space with one more component, and distances from them."""

    def __init__(self, sample: np.ndarray, count: int, longest: float) -> None:
        #: The square of the length that all vectors have in that space.
        self.longest = longest
        lifted = self.lift(sample)
        rng = np.random.default_rng(11)
        places = lifted[rng.choice(len(lifted), min(count, len(lifted)), replace=False)]
        for _ in range(6):
            near = self._squared(lifted, places).argmin(axis=1)
            for i in np.unique(near):
                places[i] = lifted[near == i].mean(axis=0)
        self.places = np.unique(places, axis=0)

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        vectors = vectors.astype(float)
        missing = np.sqrt(np.maximum(self.longest - (vectors * vectors).sum(axis=1), 0))
        return np.column_stack([vectors, missing])

    @staticmethod
    def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T, 0)

    def of_vectors(self, vectors: np.ndarray) -> np.ndarray:
        return np.sqrt(self._squared(self.lift(vectors), self.places))

    def of_queries(self, queries: np.ndarray) -> np.ndarray:
        """Distances of queries, which have a zero as the last component."""
        return np.sqrt(self._squared(np.column_stack([queries.astype(float), np.zeros(len(queries))]), self.places))

    def reach(self, queries: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """The largest score of a vector that is ``gap`` or more away from each query."""
        total = (queries.astype(float) ** 2).sum(axis=1)[:, None] + self.longest
        # A distance is the root of a difference of sums, so its square is what is known to within the slack.
        return (total - np.maximum(gap, 0) ** 2) / 2 + SLACK * total


def gaps(distance: np.ndarray, low: np.ndarray, high: np.ndarray, slack: float) -> np.ndarray:
    """Least distance of each query from each annulus, by the triangle inequality."""
    return np.maximum(low[None] - distance, distance - high[None]) - slack


def best_rows(row: np.ndarray, score: np.ndarray, first: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of each row the ``k`` highest scores, ties to the smaller first id."""
    order = np.lexsort((first, ~score, row))  # ~score falls as score grows, without overflow
    row = row[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], *(values[order[kept]] for values in (score, first, place))


def search_part(
    queries: np.ndarray, floor: np.ndarray, distance: np.ndarray, members: np.ndarray, far: np.ndarray, first: np.ndarray,
    pivots: Pivots, k: int,
) -> tuple[tuple[np.ndarray, ...], int]:
    """The ``k`` best members of a part for each query that reach its floor, and the number of scores computed.

    ``distance`` is each query's, ``far`` each member's distance from the pivot of the part.
    """
    order = np.argsort(far, kind="stable")
    members, far, first = members[order], far[order], first[order]
    starts = np.arange(0, len(members), ANNULUS)
    low, high = far[starts], far[np.minimum(starts + ANNULUS, len(members)) - 1]
    slack = math.sqrt(SLACK * pivots.longest)
    found, scored = [], 0
    for at in range(0, len(queries), BLOCK):
        asked = queries[at : at + BLOCK]
        reached = pivots.reach(asked, gaps(distance[at : at + BLOCK, None], low, high, slack))
        least = floor[at : at + BLOCK].copy()
        best = tuple(np.zeros(0, np.int64) for _ in range(4))
        for annulus in np.argsort(-reached.max(axis=0), kind="stable"):
            active = np.flatnonzero(reached[:, annulus] >= least)
            if not len(active):
                continue
            span = slice(starts[annulus], starts[annulus] + ANNULUS)
            scores = products(asked[active], members[span])
            scored += scores.size
            if scores.shape[1] > k:
                top = np.partition(scores, -k, axis=1)[:, -k]
                least[active] = np.maximum(least[active], top)
            row, column = np.nonzero(scores >= least[active, None])
            new = (active[row], scores[row, column], first[span][column], order[span][column])
            best = best_rows(*(np.concatenate(pair) for pair in zip(best, new, strict=True)), k)
            full = np.bincount(best[0], minlength=len(asked)) >= k
            worst = np.full(len(asked), LONG)
            np.minimum.at(worst, best[0], best[1])
            least[full] = np.maximum(least[full], worst[full])
        found.append((best[0] + at, *best[1:]))
    return tuple(np.concatenate(columns) for columns in zip(*found, strict=True)), scored


def as_matrix(packed: pd.Series, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype).reshape(len(packed), -1).astype(np.int64) if len(packed) else np.zeros((0, 0), np.int64)


class PivotIndex:
    """Entries keyed by nearest pivot and distance, in parts, and the searches in them."""

    def __init__(self, rows: DataFrame, k: int) -> None:
        self.k = k
        distinct = materialize(entries(rows, k + 1), "entries")
        norm = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x)
        facts = distinct.agg(
            F.count("*").alias("n"), F.max(norm).alias("longest"), F.max(F.size("vector")).alias("size"),
            F.max(F.greatest(F.array_max("vector"), -1 - F.array_min("vector"))).alias("most"),
        ).first()
        count = max(1, min(PIVOTS, math.ceil(facts["n"] / LIST)))
        wanted = max(1, min(SAMPLE * count, SAMPLE_NUMBERS // max(1, facts["size"])))
        # The smallest digests are a sample that depends on nothing but the vectors.
        sample = np.array([r[0] for r in distinct.select("vector", "key").orderBy("key").limit(wanted).collect()], np.int64)
        self.pivots = Pivots(sample.reshape(len(sample), -1), count, facts["longest"] or 0.0)
        self.dtype = "<i4" if (facts["most"] or 0) < 1 << 31 else "<i8"
        self.index = materialize(self._keyed(distinct), "index")
        #: One row for each list, at most ``PIVOTS``: its range of distances and its parts.
        lists = self.index.groupBy("pivot").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count("*").alias("n"))
        self.lists = pd.DataFrame([r.asDict() for r in lists.orderBy("pivot").collect()])
        self.lists["parts"] = -(-self.lists["n"] // PART)

    def _keyed(self, distinct: DataFrame) -> DataFrame:
        pivots, dtype = self.pivots, self.dtype

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                vectors = np.array(batch["vector"].tolist(), np.int64).reshape(len(batch), -1)
                far = pivots.of_vectors(vectors)
                near = far.argmin(axis=1) if len(batch) else np.zeros(0, int)
                packed = [row.tobytes() for row in vectors.astype(dtype)]
                yield pd.DataFrame({
                    "key": batch["key"], "pivot": near, "far": far[np.arange(len(batch)), near], "packed": packed, "ids": batch["ids"],
                })

        return distinct.mapInPandas(task, "key string, pivot int, far double, packed binary, ids array<long>")

    def _parts(self) -> Column:
        parts = F.create_map(*(F.lit(int(v)) for pair in zip(self.lists["pivot"], self.lists["parts"], strict=True) for v in pair))
        return F.element_at(parts, F.col("pivot"))

    def sharded(self, queries: DataFrame) -> DataFrame:
        """``(key, packed, pivot, shard)``: distinct query vectors, neighbours by pivot in one shard of bounded size."""
        keys = self.index.join(queries.select("key").distinct(), "key", "left_semi").select("key", "packed", "pivot")
        keys = materialize(keys, "queries")
        # Counts of at most PIVOTS lists: full shards for the large ones, shared shards for the others.
        shards, at, room = {}, 0, SHARD
        for r in keys.groupBy("pivot").count().orderBy("pivot").collect():
            if r["count"] > room:
                at, room = at + 1, SHARD
            take = -(-r["count"] // SHARD)
            shards[r["pivot"]] = (at, take)
            at, room = at + take - 1, room - r["count"] if take == 1 else 0
        if not shards:
            return keys.withColumn("shard", F.lit(0))
        first = F.create_map(*(F.lit(v) for p, (a, _) in shards.items() for v in (p, a)))
        take = F.create_map(*(F.lit(v) for p, (_, t) in shards.items() for v in (p, t)))
        spread = F.pmod(F.xxhash64("key"), F.element_at(take, F.col("pivot"))).cast("int")
        return keys.withColumn("shard", F.element_at(first, F.col("pivot")) + spread)

    def _visits(self, queries: DataFrame, own: bool) -> DataFrame:
        """The parts that each query visits: those of its own list, or of the others within its reach."""
        pivots, lists, dtype = self.pivots, self.lists, self.dtype
        low, high = lists["low"].to_numpy(), lists["high"].to_numpy()
        numbers, parts = lists["pivot"].to_numpy(), lists["parts"].to_numpy()
        slack = math.sqrt(SLACK * pivots.longest)

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for start in range(0, len(whole), BLOCK):
                    batch = whole.iloc[start : start + BLOCK].reset_index(drop=True)
                    asked = as_matrix(batch["packed"], dtype)
                    distance = pivots.of_queries(asked)[:, numbers]
                    mine = batch["pivot"].to_numpy()[:, None] == numbers[None]
                    reached = pivots.reach(asked, gaps(distance, low, high, slack))
                    row, which = np.nonzero(mine if own else ~mine & (reached >= batch["floor"].to_numpy()[:, None]))
                    again = np.repeat(np.arange(len(row)), parts[which])
                    part = np.arange(len(again)) - np.repeat(np.cumsum(parts[which]) - parts[which], parts[which])
                    row, which = row[again], which[again]
                    out = batch[["key", "packed", "floor", "shard"]].iloc[row].reset_index(drop=True)
                    yield out.assign(distance=distance[row, which], pivot=numbers[which], part=part)

        return queries.select("key", "packed", "floor", "shard", "pivot").mapInPandas(
            task, "key string, packed binary, floor long, shard int, distance double, pivot int, part int"
        )

    def visit(self, queries: DataFrame, own: bool) -> DataFrame:
        """``(key, score, ids)``: of each visited part the best entries of each query that reach its floor."""
        cell = ["shard", "pivot", "part"]
        visits = materialize(self._visits(queries, own), "visits")
        wanted = visits.select(*(F.col(c).alias(c) for c in cell)).distinct()  # columns of their own, for the cogroup
        dealt = self.index.withColumn("part", F.pmod(F.xxhash64("key"), self._parts()).cast("int"))
        pivots, dtype, k = self.pivots, self.dtype, self.k + 1

        def search(asked: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
            if not len(asked) or not len(members):
                return pd.DataFrame({"key": [], "score": [], "ids": []})
            first = members["ids"].map(lambda ids: ids[0]).to_numpy()
            (row, score, _, place), _ = search_part(
                as_matrix(asked["packed"], dtype), asked["floor"].to_numpy(), asked["distance"].to_numpy(),
                as_matrix(members["packed"], dtype), members["far"].to_numpy(), first, pivots, k,
            )
            return pd.DataFrame({"key": asked["key"].to_numpy()[row], "score": score, "ids": members["ids"].to_numpy()[place]})

        members = dealt.join(wanted, ["pivot", "part"]).select(*cell, "far", "packed", "ids")
        return visits.groupBy(*cell).cogroup(members.groupBy(*cell)).applyInPandas(search, FOUND)

    def search(self, queries: DataFrame) -> DataFrame:
        """``(key, score, vec_id)``: the ``k + 1`` best rows of each distinct query vector, itself among them."""
        sharded = self.sharded(queries)
        near = materialize(self.visit(sharded.withColumn("floor", F.lit(-LONG - 1)), own=True), "near")
        ranked = Window.partitionBy("key").orderBy(F.desc("score"))
        floors = near.select("key", "score").withColumn("n", F.row_number().over(ranked)).filter(F.col("n") <= self.k + 1)
        floors = floors.groupBy("key").agg(
            F.when(F.count("*") > self.k, F.min("score")).otherwise(F.lit(-LONG - 1)).alias("floor")
        )
        rest = self.visit(sharded.join(floors, "key"), own=False)
        rows = near.unionByName(rest).select("key", "score", F.explode("ids").alias("vec_id"))
        best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
        return rows.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= self.k + 1).drop("n")


def dealt_copies(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """Join query rows to the answers of their vectors; vectors with very many rows go to many tasks."""
    counts = materialize(asked.groupBy("key").count(), "counts")
    total = counts.agg(F.sum("count")).first()[0] or 0
    most = max(HOT_ROWS, total // 1000)
    # Fewer than a thousand vectors can have so many rows.
    hot = F.broadcast(counts.filter(F.col("count") > most).select("key", F.ceil(F.col("count") / most).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    asked = asked.join(hot, "key", "left").withColumn("salt", F.pmod(F.xxhash64("query_id"), salts).cast("int")).drop("salts")
    answers = answers.join(hot, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return asked.join(answers, ["key", "salt"]).drop("salt")


def search(
    vectors: DataFrame, every: int = 20, k: int = 20, scale: float = 64.0, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """The ``k`` rows with the largest inner product with each row whose id is divisible by ``every``.

    Components count as ``floor(scale * x)``, and a score is the exact product of such vectors, ties to
    the smaller id; a query's own id is left out. Vectors that are null or hold a null, a NaN or an
    infinity take no part, and neither do null ids. Vectors without a component are at zero from each
    other; vectors of different lengths are searched apart. Rows that repeat an id with an equal vector
    count once. A score beyond 64 bits is the nearest long. Other columns are not carried, an empty
    table gives an empty result.
    """
    schema = "query_id long, rank int, vec_id long, score long"
    rows = whole_numbers(vectors, scale, vec_id, embedding)
    sizes = [r[0] for r in rows.select(F.size("vector").alias("size")).distinct().orderBy("size").collect()]
    found = None
    for size in sizes:  # as a rule all vectors have one length
        part = _search(rows.filter(F.size("vector") == size) if len(sizes) > 1 else rows, every, k)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else vectors.sparkSession.createDataFrame([], schema)


def _search(rows: DataFrame, every: int, k: int) -> DataFrame:
    rows = materialize(rows, "vectors")
    queries = rows.filter(F.col("vec_id") % every == 0)
    best = PivotIndex(rows, k).search(queries)
    answers = materialize(
        best.groupBy("key").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id", "score"))).alias("answers")),
        "answers",
    )
    others = F.slice(F.filter("answers", lambda a: a["vec_id"] != F.col("query_id")), 1, k)
    return dealt_copies(queries.select(F.col("vec_id").alias("query_id"), "key"), answers).select(
        "query_id", F.posexplode(others).alias("n", "a")
    ).select("query_id", (F.col("n") + 1).cast("int").alias("rank"), F.col("a.vec_id").alias("vec_id"), F.col("a.score").alias("score"))


#: The same rows by all products, as plain SQL.
ORACLE = """
with v as (
  select distinct vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as q from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), p as (
  select a.vec_id as query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint as score
  from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) where a.vec_id % 20 = 0
)
select query_id, (row_number() over w)::int as rank, vec_id, score from p
window w as (partition by query_id order by score desc, vec_id) qualify row_number() over w <= 20
"""
