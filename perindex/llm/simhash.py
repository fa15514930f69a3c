"""SimHash fingerprints and their near-duplicate groups, found by a Gray-order index.

Two fingerprints that differ in few bits agree on one of a few bands of bits, so equal bands
bring them together. Within a band's group the fingerprints are sorted by Gray rank, where
neighbours share most bits, and runs of them form the leaves of a tree. A node keeps the bits
in which all below it agree, apart from those its parent keeps already. A search adds up the
differences on the way down and drops a whole run once they are too many.

Equal fingerprints are one node from the start. A group hands on a forest of links, never all
its pairs; the forests of all groups join to components by repeated minimum labels.

A group that stays large when it is dealt again is cut into blocks. Each block is searched for
itself; then all that is not in the group's largest component is held against the whole group,
block by block, so that no task has more than two blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perindex.llm.text_batches import map_columns, whole_text
from perindex.session import materialize, materialize_counted

BITS = 64
#: Children of a node of the tree, and fingerprints that are searched for at once.
FAN_OUT, QUERIES = 16, 512
#: A group with more fingerprints is dealt again, by the bands of its other bits.
GROUP = 4096
#: Members that the groups of one table have in all, on average.
BUCKET_ROWS = 16_384
#: Rows for which one part more is made of a key that may own them all.
SALT_ROWS = 4096
ALL = (1 << BITS) - 1


def shingle_fingerprint(words: list[bytes], width: int) -> int:
    """The majority, bit by bit, of the shingles' hashes; 0 without a word."""
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64, len(shingles))
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, hash)`` of every row; null and empty texts have the fingerprint 0."""

    def make():
        def hashed(keys: list[int], texts: list[str]) -> dict[str, list]:
            # Bytes split at the six ASCII spaces only, and lower() touches A-Z only.
            values = [shingle_fingerprint(t.encode().lower().split(), width) for t in texts]
            return {"doc_id": keys, "hash": [v - (1 << BITS) if v >> (BITS - 1) else v for v in values]}

        return hashed

    columns = [F.col(f"`{doc_id}`").cast("long"), whole_text(text)]
    return map_columns(docs, columns, make, "doc_id long, hash long")


def gray_rank(values: np.ndarray) -> np.ndarray:
    """The place of each value in the reflected Gray order."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """A tree over distinct fingerprints in Gray order; search by accumulated differences."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values[np.argsort(gray_rank(values), kind="stable")]
        ones, zeros = [self.values], [~self.values]  # the bits that all below a node have set, or unset
        while len(ones[-1]) > FAN_OUT:
            starts = np.arange(0, len(ones[-1]), FAN_OUT)
            ones.append(np.bitwise_and.reduceat(ones[-1], starts))
            zeros.append(np.bitwise_and.reduceat(zeros[-1], starts))
        #: From the top down: the bits of each node that its parent lacks, and their values.
        self.levels = []
        for k in range(len(ones) - 1, -1, -1):
            mask = ones[k] | zeros[k]
            if k + 1 < len(ones):
                above = np.arange(len(mask)) // FAN_OUT
                mask = mask & ~(ones[k + 1] | zeros[k + 1])[above]
            self.levels.append((mask, ones[k] & mask))

    def links(self, distance: int):
        """Blocks of ``(i, j)``, places i < j of values that differ in at most ``distance`` bits."""
        size = len(self.values)
        for at in range(0, size, QUERIES):
            stop = min(at + QUERIES, size)
            nodes = len(self.levels[0][0])
            query = np.repeat(np.arange(at, stop), nodes)
            node = np.tile(np.arange(nodes), stop - at)
            spent = np.zeros(len(query), np.uint8)
            for k, (mask, pattern) in enumerate(self.levels):
                if k:
                    count = len(mask)
                    query, spent = np.repeat(query, FAN_OUT), np.repeat(spent, FAN_OUT)
                    node = (node[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
                    below = node < count
                    query, spent, node = query[below], spent[below], node[below]
                spent = spent + np.bitwise_count((self.values[query] ^ pattern[node]) & mask[node])
                # A run whose last place is not behind the query has no later partner.
                reach = (node + 1) * FAN_OUT ** (len(self.levels) - 1 - k) - 1 > query
                if k == len(self.levels) - 1:
                    reach = node > query
                near = (spent <= distance) & reach
                query, spent, node = query[near], spent[near], node[near]
            yield query, node


class Trees:
    """Places joined to trees, whose roots are their smallest places."""

    def __init__(self, size: int) -> None:
        self.parent = np.arange(size)

    def roots(self, places: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[places]
            if (up == places).all():
                return places
            self.parent[places] = self.parent[up]
            places = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.roots(a), self.roots(b)
        while len(a := a[(apart := a != b)]):
            b = b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            a, b = self.roots(a), self.roots(b)

    def links(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each place that is no root, and of its root."""
        top = self.roots(np.arange(len(values)))
        linked = top != np.arange(len(values))
        return values[linked], values[top[linked]]


def forest(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the values of a group just as all their pairs would: value and its root."""
    index, trees = GrayIndex(values), Trees(len(values))
    for a, b in index.links(distance):
        trees.join(a, b)
    return trees.links(index.values)


def forest_between(
    asking: tuple[np.ndarray, np.ndarray], asked: tuple[np.ndarray, np.ndarray], distance: int
) -> tuple[np.ndarray, np.ndarray]:
    """Links between labels that all near pairs of an asking and an asked value would join.

    Both sides are values and their labels; pairs of one label are known already.
    """
    labels, places = np.unique(np.concatenate([asking[1], asked[1]]), return_inverse=True)
    one, other = places[: len(asking[0])], places[len(asking[0]) :]
    trees = Trees(len(labels))
    for at in range(0, len(one), QUERIES):
        for to in range(0, len(other), GROUP):
            apart = np.bitwise_count(asking[0][at : at + QUERIES, None] ^ asked[0][None, to : to + GROUP])
            i, j = np.nonzero(apart <= distance)
            trees.join(one[at + i], other[to + j])
    return trees.links(labels)


def bands(bits: list[int], count: int) -> list[list[int]]:
    return [list(map(int, part)) for part in np.array_split(bits, count)]


def mask_of(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def banded(nodes: DataFrame, key: list[str], parts: list[list[int]], names: tuple[str, str]) -> DataFrame:
    """Each node once for each band: the band's number and the bits within it."""
    masks = F.array(*[
        F.struct(F.lit(k).alias(names[0]), F.col("hash").bitwiseAND(F.lit(mask_of(p))).alias(names[1]))
        for k, p in enumerate(parts)
    ])
    return nodes.select(*key, "hash", F.inline(masks))


def _forests(groups: DataFrame, key: list[str], distance: int, rows: int) -> DataFrame:
    """The forests of all groups; many groups share a task's table, ``rows`` are their members in all."""

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        values = frame["hash"].to_numpy().astype(np.int64).view(np.uint64)
        found = [forest(np.unique(values[at]), distance) for at in frame.groupby(key, sort=False).indices.values()]
        a, b = (np.concatenate([f[side] for f in found]).view(np.int64) for side in (0, 1))
        return pd.DataFrame({"a": a, "b": b})

    buckets = max(1, -(-rows // BUCKET_ROWS))
    bucketed = groups.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    return bucketed.groupBy("bucket").applyInPandas(join, "a long, b long")


def _sizes(groups: DataFrame, key: list[str], group: int, name: str) -> tuple[DataFrame, int, int]:
    """The groups of two and more with their ``size``; members of those up to ``group`` in all, and of larger ones."""
    sizes = materialize(groups.groupBy(*key).agg(F.count("hash").alias("size")).filter("size > 1"), name)
    small, large = sizes.agg(*(
        F.coalesce(F.sum(F.when(side, F.col("size"))), F.lit(0)) for side in (F.col("size") <= group, F.col("size") > group)
    )).first()
    return sizes, small, large


def _between(pairs: DataFrame, key: list[str], distance: int) -> DataFrame:
    """The links between labels that the near pairs of each two blocks join."""

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        values = frame["hash"].to_numpy().astype(np.int64).view(np.uint64)
        labels, asks = frame["label"].to_numpy().astype(np.int64), frame["asks"].to_numpy().astype(bool)
        a, b = forest_between((values[asks], labels[asks]), (values[~asks], labels[~asks]), distance)
        return pd.DataFrame({"a": a, "b": b})

    return pairs.groupBy(*key).applyInPandas(join, "a long, b long")


def _block_links(groups: DataFrame, key: list[str], found: DataFrame, distance: int, group: int, rows: int) -> DataFrame:
    """``found`` and the links of groups that are too large for a task: of ``hash``, ``key`` and ``size``.

    Blocks of each group, cut by a hash, are searched for themselves first, which joins most of a
    family of near copies. What is outside a group's largest component then asks all of the group:
    each two blocks, of asking and of asked values, are a task's.
    """

    def blocks(count: Column) -> Column:
        return F.ceil(count / F.lit(group)).cast("int")

    groups = materialize(groups, "large_groups")
    dealt = groups.withColumn("block", F.pmod(F.xxhash64("hash"), blocks(F.col("size"))).cast("int"))
    found = materialize(found.unionByName(_forests(dealt, [*key, "block"], distance, rows)), "found")
    labels = components(found)
    members = groups.join(labels, "hash", "left").withColumn("label", F.coalesce("label", "hash"))
    members = materialize(members, "members")
    counts = members.groupBy(*key, "label").agg(F.count("hash").alias("n"))
    main = counts.groupBy(*key).agg(
        F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("others")
    ).filter("others > 0")
    members = members.join(main, key)

    def side(rows: DataFrame, asks: bool) -> DataFrame:
        own, other = ("asking", "asked") if asks else ("asked", "asking")
        size = {"asking": blocks(F.col("others")), "asked": blocks(F.col("size"))}
        return rows.withColumn(own, F.pmod(F.xxhash64("hash", F.lit(1)), size[own]).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), size[other] - 1))
        ).select(*key, "asking", "asked", "hash", "label", F.lit(asks).alias("asks"))

    pairs = side(members.filter("label <> main"), True).unionByName(side(members, False))
    return found.unionByName(_between(pairs, [*key, "asking", "asked"], distance))


def links(nodes: DataFrame, distance: int = 4, group: int = GROUP) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all pairs of ``nodes`` within ``distance``.

    ``nodes`` has distinct values ``hash``. Groups of more than ``group`` members are dealt
    again: who agrees on one band and differs in ``distance`` other bits at most agrees on
    a band of the rest too. Groups that are still larger are cut into blocks of about ``group``.
    """
    count = distance + 1
    parts = bands(list(range(BITS)), count)
    first, key = banded(nodes, [], parts, ("band", "bits")), ["band", "bits"]
    sizes, n_small, n_large = _sizes(first, key, group, "band_sizes")
    small = first.join(sizes.filter(F.col("size") <= group).drop("size"), key)
    found = _forests(small, key, distance, n_small)
    if not n_large:
        return found
    large = sizes.filter(F.col("size") > group).drop("size")
    again = None
    for k, part in enumerate(parts):
        rest = [b for b in range(BITS) if b not in part]
        mine = first.filter(F.col("band") == k).join(large.filter(F.col("band") == k), key)
        dealt = banded(mine, key, bands(rest, count), ("band2", "bits2"))
        again = dealt if again is None else again.unionByName(dealt)
    key = [*key, "band2", "bits2"]
    sizes, n_small, n_large = _sizes(again, key, group, "band2_sizes")
    small = again.join(sizes.filter(F.col("size") <= group).drop("size"), key)
    found = found.unionByName(_forests(small, key, distance, n_small))
    if not n_large:
        return found
    return _block_links(again.join(sizes.filter(F.col("size") > group), key), key, found, distance, group, n_large)


def with_least(rows: DataFrame, key: str, value: str, spread: str, salts: int, name: str) -> DataFrame:
    """``rows`` with the smallest ``value`` of their ``key`` as ``name``.

    The rows of a key are dealt into ``salts`` parts by a hash of ``spread``. Each part sends its
    minimum to the key and gets the key's back, so a key that owns most rows is no task's alone.
    """
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    parts = dealt.groupBy(key, "salt").agg(F.min(value).alias(name))
    whole = parts.groupBy(key).agg(F.min(name).alias(name))
    return dealt.join(parts.drop(name).join(whole, key), [key, "salt"]).drop("salt")


def _salts(rows: int) -> int:
    return max(1, -(-rows // SALT_ROWS))


def components(edges: DataFrame) -> DataFrame:
    """``(hash, label)`` of every linked node; the label is the smallest node it reaches.

    Each round hangs the larger neighbours of a node on its smallest one, then the smaller
    ones, and ends when a round changes nothing. The links are stored after each round. A node
    that most links hang on is dealt into parts in every join.
    """
    least, most = F.least("a", "b"), F.greatest("a", "b")
    edges = materialize(edges.filter("a <> b").select(most.alias("a"), least.alias("b")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        salts = _salts(edges.count())
        large = with_least(both, "a", "b", "b", salts, "m").withColumn("m", F.least("a", "m")).filter("b > a")
        large = materialize(large.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "links")
        small = with_least(large, "a", "b", "b", salts, "m").select(
            F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b"))))
        )
        after = materialize(small.filter("a <> b").distinct(), "links")
        if _digest(after) == _digest(edges):
            return after.groupBy(F.col("a").alias("hash")).agg(F.min("b").alias("label"))
        edges = after


def _digest(edges: DataFrame) -> tuple:
    """Count and sum of hashes of distinct links: equal for equal sets."""
    return tuple(edges.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def hex_of(value: str = "hash") -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def group_labels(hashed: DataFrame, distance: int = 4) -> DataFrame:
    """``(hash, label, component_id)`` of each fingerprint of ``(doc_id, hash)`` rows."""
    nodes = hashed.groupBy("hash").agg(F.min("doc_id").alias("first_id"))
    nodes, n_nodes = materialize_counted(nodes, "nodes")
    labels = components(links(nodes.select("hash"), distance))
    labelled = nodes.join(labels, "hash", "left").withColumn("label", F.coalesce("label", "hash"))
    labelled = materialize(labelled, "labelled")
    groups = with_least(labelled, "label", "first_id", "hash", _salts(n_nodes), "component_id")
    return materialize(groups.select("hash", "label", "component_id"), "groups")


def near_duplicates(
    docs: DataFrame, distance: int = 4, width: int = 4, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row for each document: its fingerprint and the smallest ``doc_id`` its links reach.

    Null, empty and white texts share the fingerprint 0 and link like any other. Repeated rows
    give repeated results. A null id is never the smallest, unless all of its component are
    null: then ``component_id`` is null. ``label`` tells components apart in any case.
    """
    hashed = materialize(fingerprints(docs, width, doc_id, text), "fingerprints")
    groups = group_labels(hashed, distance)
    # Many documents may share a fingerprint, which adaptive execution splits; the other side has one row each.
    return hashed.join(groups, "hash").select("doc_id", hex_of().alias("fingerprint"), "component_id", "label")


def one_of_each(docs: DataFrame, distance: int = 4, width: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest id, null ids last.

    All columns stay. Of repeated rows with that id and fingerprint one stays.
    """

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        values = [shingle_fingerprint(t.encode().lower().split(), width) for t in texts]
        return pd.Series(values, dtype="uint64").astype("int64")

    # The row number is stored, so it stays what it is; it tells repeated rows apart.
    marked = materialize(
        docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), fingerprint(whole_text(text)).alias("hash"))
        .withColumn("row", F.monotonically_increasing_id()),
        "marked",
    )
    hashed = marked.select(F.col(f"doc.`{doc_id}`").cast("long").alias("doc_id"), "hash", "row")
    groups = group_labels(hashed.select("doc_id", "hash"), distance)
    # Copies fold into one row for each fingerprint before anything is joined.
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    firsts = hashed.groupBy("hash").agg(F.min_by(F.struct("doc_id", "row"), order).alias("f")).select("hash", "f.*")
    chosen = F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "hash"))
    winners = materialize(firsts.join(groups, "hash").groupBy("label").agg(chosen.alias("row")).select("row"), "winners")
    # Joined by the row, at every size: documents move once, and copies spread as well as any others.
    return marked.join(winners.hint("merge"), "row", "left_semi").select("doc.*")
