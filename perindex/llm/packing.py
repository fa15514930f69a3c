"""Best-fit packing of token pieces into sequences, improved by swaps between bins.

Documents become pieces of at most ``capacity`` tokens. The pieces are dealt into blocks
of bounded size by a hash, so any source or group of copies spreads. A block is packed
best fit first; then items move and change places between its underfull bins, always so
that the sum of squared fill grows, until bins run empty. Bins that stay loosely filled
are taken apart again, and all loose pieces are dealt into the blocks of the next level.
Their number follows the count of loose pieces, so a block of any level is as bounded as
those of the first. The levels end with one block, or when one saves hardly a bin.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perindex.llm.text_batches import map_columns, whole_text
from perindex.llm.word_ids import WordIds
from perindex.session import materialize

#: Pieces in a block, on average.
BLOCK_PIECES = 4096
#: Defaults of ``pack``. The levels go on while one lowers the number of loose bins by this share, or more.
SAVES = 1 / 1024
#: A bin is loose if this share of it, or more, is empty.
LOOSE = 1 / 16

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


def token_pieces(
    docs: DataFrame, vocabulary: str, capacity: int, end_id: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The pieces of every document: its ids and ``end_id``, cut after each ``capacity`` ids.

    A null or empty text is one piece that holds ``end_id`` alone. Every row counts: repeated
    rows give repeated pieces. Other columns are not carried.
    """

    def make():
        encoder, end = WordIds(vocabulary), end_id.to_bytes(4, "little")

        def pieces(ids: list[int], texts: list[str]) -> dict[str, list]:
            rows = []
            for key, value in zip(ids, texts, strict=True):
                data = encoder.encode(value) + end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((key, k, at // 4, len(part) // 4, zlib.crc32(part)))
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            return dict(zip(names, map(list, zip(*rows, strict=True)) if rows else [[]] * 5, strict=True))

        return pieces

    return map_columns(docs, [F.col(f"`{doc_id}`").cast("long"), whole_text(text)], make, PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: the longest item first, each into the fullest bin that takes it."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if some bin has room r
    bins: list[list[int]] = []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        length = lengths[item]
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[at].append(item)
        else:
            room, at = capacity, len(bins)
            bins.append([item])
        left = room - length
        by_room[left].append(at)
        rooms |= 1 << left
    return bins


@lru_cache(maxsize=8192)
def selections(lengths: tuple[int, ...]) -> tuple[list, list]:
    """One item and two items of a bin as ``(length, places)``, one for each combination of lengths.

    Equal lengths exchange alike, so a bin has as many as its few distinct lengths make.
    """
    places: dict[int, list[int]] = {}
    for place, length in enumerate(lengths):
        places.setdefault(length, []).append(place)
    one = [(x, [at[0]]) for x, at in places.items()]
    two = [(x + y, [i, j]) for k, (x, [i]) in enumerate(one) for y, [j] in one[:k]]
    two += [(2 * x, at[:2]) for x, at in places.items() if len(at) > 1]
    return one, two


def exchange(giver: list[int], taker: list[int], room: int) -> tuple[int, list[int], list[int]]:
    """The exchange that carries most from ``giver`` to ``taker``, which has ``room`` left.

    Both are lists of lengths. Looked at: one item moves; one goes for one; two go for
    one; one goes for two. Returns the gain and the places given and taken.
    """
    one, two = selections(tuple(giver))
    back_one, back_two = selections(tuple(taker))
    best = (0, [], [])
    for gives, takes in ((one, [(0, []), *back_one, *back_two]), (two, back_one)):
        # The smallest return that still fits carries most.
        takes = sorted(takes)
        sizes = [size for size, _ in takes]
        for size, places in gives:
            at = bisect_left(sizes, size - room)
            if at < len(sizes) and size - sizes[at] > best[0]:
                best = (size - sizes[at], places, takes[at][1])
    return best


def empty_bins(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search between underfull bins until no exchange between any two of them gains.

    The emptiest bin gives first, to every bin at least as full, the one with most room first. A step
    that carries tokens from a bin to a fuller one raises the sum of squared fill, so the search
    ends. Rounds go on until one changes nothing, or the bins are as few as the tokens need. Two bins
    that did not change since they were last compared are not compared again.
    """
    least = -(-sum(lengths) // capacity)
    fill = {k: sum(lengths[i] for i in b) for k, b in enumerate(bins)}
    held = {k: list(b) for k, b in enumerate(bins)}
    open_ = {k for k in fill if fill[k] < capacity}
    number, step, gained = len(bins), 0, True
    # The steps at which a bin last changed, and at which it last looked at all others.
    changed, searched = dict.fromkeys(open_, 0), dict.fromkeys(open_, -1)
    while gained:
        gained = False
        for giver in sorted(open_, key=lambda k: (fill[k], k)):
            if number <= least:
                break
            while held[giver] and searched[giver] < step:
                since = searched[giver] if searched[giver] >= changed[giver] else -1
                searched[giver] = step
                takers = [k for k in open_ if k != giver and fill[giver] <= fill[k] < capacity and changed[k] > since]
                for taker in sorted(takers, key=lambda k: (fill[k], k)):
                    gain, given, taken = exchange(
                        [lengths[i] for i in held[giver]], [lengths[i] for i in held[taker]], capacity - fill[taker]
                    )
                    if not gain:
                        continue
                    out, back = [held[giver][i] for i in given], [held[taker][i] for i in taken]
                    held[giver] = [x for i, x in enumerate(held[giver]) if i not in given] + back
                    held[taker] = [x for i, x in enumerate(held[taker]) if i not in taken] + out
                    fill[giver] -= gain
                    fill[taker] += gain
                    step += 1
                    changed[giver] = changed[taker] = step
                    gained = True
                    if not held[giver]:
                        number -= 1
                        open_.discard(giver)
                        break
    return [b for b in held.values() if b]


def pack_block(frame: pd.DataFrame, capacity: int, loose_share: float = LOOSE) -> pd.DataFrame:
    """Sequence number, offset and looseness for the pieces of one block."""
    frame = frame.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], kind="stable", ignore_index=True)
    lengths = frame["length"].tolist()
    bins = empty_bins(best_fit(lengths, capacity), lengths, capacity)
    number, offset = np.zeros(len(lengths), dtype="int64"), np.zeros(len(lengths), dtype="int64")
    loose = np.zeros(len(lengths), dtype=bool)
    for k, items in enumerate(bins):
        at = 0
        for item in items:
            number[item], offset[item] = k, at
            at += lengths[item]
        loose[items] = capacity - at >= capacity * loose_share
    return frame.assign(sequence_id=number, offset=offset, loose=loose)


def _pack_level(
    pieces: DataFrame, blocks: int, before: int, level: int, capacity: int, loose_share: float
) -> DataFrame:
    names = [c for c in pieces.columns if c not in ("copy", "block")]

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        block = int(frame["block"].iloc[0])
        packed = pack_block(frame, capacity, loose_share)
        # The blocks of all levels are numbered on, and a bin has bits of its own, so numbers never meet.
        packed["sequence_id"] += (before + block) << 24
        return packed[[*names, "copy", "sequence_id", "offset", "loose"]]

    # The level is hashed too: at an equal number of blocks, other pieces meet.
    block = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", "copy", F.lit(level)), F.lit(blocks))
    return (
        pieces.withColumn("block", block)
        .groupBy("block")
        .applyInPandas(pack, f"{PIECES}, copy long, sequence_id long, offset long, loose boolean")
    )


def _numbered(pieces: DataFrame, chunk: int = BLOCK_PIECES) -> DataFrame:
    """``pieces`` with the number ``copy`` of each among its equals, so that repeated rows spread as others do."""
    names = [F.col(c) for c in pieces.columns]
    counted = pieces.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    chunked = counted.select(*names, "n", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {chunk}"))).alias("c"))
    last = F.least(F.col("n") - 1, F.col("c") * chunk + chunk - 1)
    return chunked.select(*names, F.explode(F.sequence(F.col("c") * chunk, last)).alias("copy"))


def pack(
    pieces: DataFrame, capacity: int, block_pieces: int = BLOCK_PIECES, loose_share: float = LOOSE, saves: float = SAVES
) -> DataFrame:
    """Give every piece a sequence and its place there.

    Bins with ``loose_share`` of their capacity empty, or more, are packed again together with those
    of other blocks, as long as that lowers their number by the share ``saves``.

    ``pieces`` has the columns of ``token_pieces``. An empty table gives an empty result; repeated
    rows are packed each. A level that does not lower the number of bins counts for nothing: the
    bins of the level before stay.
    """
    count, pieces = pieces.count(), _numbered(pieces)
    level, before, loose, open_, done = 0, 0, None, None, None
    while True:
        blocks = max(1, -(-count // block_pieces))
        packed = materialize(_pack_level(pieces, blocks, before, level, capacity, loose_share), f"packed{level}")
        # A bin has one piece at offset 0.
        first = F.col("offset") == 0
        bins, loose_bins, count = packed.agg(
            F.count_if(first), F.count_if(first & F.col("loose")), F.count_if("loose")
        ).first()
        if loose is not None and bins >= loose:
            return done.unionByName(open_).drop("loose", "copy")
        saved = bins if loose is None else loose - bins
        if blocks == 1 or not count or saved < saves * bins:
            done = packed if done is None else done.unionByName(packed)
            return done.drop("loose", "copy")
        closed, open_, loose = packed.filter(~F.col("loose")), packed.filter("loose"), loose_bins
        done = closed if done is None else done.unionByName(closed)
        pieces = open_.drop("loose", "sequence_id", "offset")
        level, before = level + 1, before + blocks


def pack_documents(
    docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Tokenise and pack whole documents; see ``token_pieces`` and ``pack``.

    The pieces, a few numbers for each, are stored once: a lost executor costs no tokenising.
    """
    pieces = materialize(token_pieces(docs, vocabulary, capacity, end_id, doc_id, text), "pieces")
    return pack(pieces, capacity)
