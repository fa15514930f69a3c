"""Chat formatting of the longest logged snapshots of each conversation.

A log may hold a conversation again each time that a turn is added. The hash of a prefix is the
sum of the hashes of its turns, each hashed with its place, so running sums give the hash of
every prefix. A conversation whose whole hash is also a prefix of a longer one is dropped; the
others are rendered. Equal turns are counted as one row first; the distinct ones are dealt into
ranges of their order and numbered from the totals of the ranges before. No task depends on how
turns are numbered: a conversation without numbers spreads as well as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perindex.operators.lookup import lookup_join
from perindex.session import materialize, materialize_counted

#: The most turns of a rendered piece, and of a block of running sums.
BLOCK = 64
#: Blocks whose sums one task adds up; the totals of so many blocks are added up after that.
BLOCKS = 4096
#: Turns for which the conversations of one hash are dealt into one part more.
SALT_ROWS = 65_536

SUMS = [f"s{k}" for k in range(4)]
EQUAL = ["conv_id", "cell", "turn", "role", "digest"]


def _parts(seeded: Column) -> list[Column]:
    """The two halves of a hash as numbers that can be summed over 2 ** 31 rows."""
    return [F.shiftrightunsigned(seeded, 32), seeded.bitwiseAND(F.lit(0xFFFFFFFF))]


def turns_of(logs: DataFrame) -> DataFrame:
    """Turns with the cell of their number; nulls of role and text count as empty, of the turn number as 0."""
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(0))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return logs.select(
        F.col("conv_id"),
        turn.alias("turn"),
        F.floor(turn / BLOCK).alias("cell"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        text.alias("text"),
        F.md5(text.cast("binary")).alias("digest"),
    ).filter("conv_id is not null")


def in_order(turns: DataFrame) -> DataFrame:
    """Distinct turns with their ``copies``, their range ``part`` of the whole order and their place ``seq`` in it.

    Turns of one conversation are ordered by number, role and the MD5 of their text.
    """
    order = ["conv_id", "turn", "role", "digest"]
    equal = turns.groupBy(*EQUAL).agg(F.count(F.lit(1)).alias("copies"))
    ranges = equal.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ranges.withColumn("seq", F.monotonically_increasing_id()).withColumn("part", F.shiftright("seq", 33)), "turns")


def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the copies ``before`` them among those of equal ``keys``, and these keys' ``total``.

    Sums run within a range; the ranges of a key, few even for the largest, start from the totals before.
    """
    own = Window.partitionBy(*keys, "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy(*keys, "part").agg(F.sum("copies").alias("n")).select(
        *keys, "part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("from_part"),
        F.sum("n").over(Window.partitionBy(*keys)).alias("total"),
    )
    inside = rows.withColumn("before", F.coalesce(F.sum("copies").over(own), F.lit(0)))
    return inside.join(ranges, [*keys, "part"]).withColumn("before", F.col("before") + F.col("from_part")).drop("from_part")


def cut(rows: DataFrame, name: str) -> DataFrame:
    """Each row once for each block ``name`` of places it reaches, with its ``copies`` there and those before."""
    end, block = F.col("before") + F.col("copies"), F.col(name)
    blocks = F.sequence(F.floor(F.col("before") / BLOCK), F.floor((end - 1) / BLOCK))
    spans = rows.withColumn("end", end).withColumn(name, F.explode(blocks))
    spans = spans.withColumn("before", F.greatest("before", block * BLOCK))
    return spans.withColumn("copies", F.least("end", (block + 1) * BLOCK) - F.col("before")).drop("end")


def prefix_hashes(ordered: DataFrame) -> DataFrame:
    """``(conv_id, block, place, s0..s3, total)``: the hash of the prefix that ends at each turn, from place 1."""
    spans = cut(numbered(ordered, ["conv_id"]), "block").repartition("conv_id", "block")
    # Copies become rows again only after the shuffle that deals their blocks.
    placed = spans.withColumn("place", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("copies"))))
    hashes = [
        part
        for seed in (1, 2)
        for part in _parts(F.xxhash64(F.lit(seed), F.col("place"), F.col("role"), F.col("digest")))
    ]
    running = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.select("conv_id", "block", "place", "total", *(h.alias(s) for h, s in zip(hashes, SUMS, strict=True)))
    summed = materialize(
        placed.select("conv_id", "block", "place", "total", *(F.sum(s).over(running).alias(s) for s in SUMS)), "sums"
    )
    # A block's last running sums are its totals.
    last = summed.filter((F.col("place") % BLOCK == 0) | (F.col("place") == F.col("total")))
    last = last.select("conv_id", "block", F.floor(F.col("block") / BLOCKS).alias("run"), *SUMS)
    inside = Window.partitionBy("conv_id", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)

    def ahead(window: Window, name: str) -> list[Column]:
        return [F.coalesce(F.sum(s).over(window), F.lit(0)).alias(f"{name}_{s}") for s in SUMS]

    runs = last.groupBy("conv_id", "run").agg(*(F.sum(s).alias(s) for s in SUMS)).select("conv_id", "run", *ahead(across, "run"))
    starts = last.select("conv_id", "run", "block", *ahead(inside, "from")).join(runs, ["conv_id", "run"])
    starts = starts.select("conv_id", "block", *((F.col(f"from_{s}") + F.col(f"run_{s}")).alias(f"from_{s}") for s in SUMS))
    return summed.join(starts, ["conv_id", "block"]).select(
        "conv_id", "block", "place", "total", *((F.col(s) + F.col(f"from_{s}")).alias(s) for s in SUMS)
    )


def maximal(ordered: DataFrame) -> DataFrame:
    """``(conv_id, total)`` of the conversations that are no prefix of a longer one.

    Conversations equal to each other prefix nothing longer: all of them stay, or all go.
    """
    prefixes, n = materialize_counted(prefix_hashes(ordered), "prefixes")
    key = ["place", *SUMS]
    # One row for each distinct prefix, summed up before the shuffle: does it go on anywhere?
    longer = prefixes.filter("place < total").select(*key).distinct()
    # Equal conversations are dealt into parts, and each part asks once.
    salt = F.pmod(F.xxhash64("conv_id"), F.lit(max(1, -(-n // SALT_ROWS)))).cast("int").alias("salt")
    ends = prefixes.filter("place = total").select("conv_id", "total", *key, salt)
    dropped = ends.select(*key, "salt").distinct().join(longer, key, "left_semi")
    return ends.join(dropped, [*key, "salt"], "left_anti").select("conv_id", "total")


def render(logs: DataFrame, kept: DataFrame, ordered: DataFrame) -> DataFrame:
    """The chat text of the kept conversations, in pieces of at most ``BLOCK`` turns each.

    The turns whose numbers fall into one cell of ``BLOCK`` numbers are a piece. Where more turns
    share a cell, by null or repeated numbers, the cell is cut by place. The pieces of a
    conversation, put together by number, are its text. A turn is ``<|im_start|>role``, a line
    end, its text and ``<|im_end|>`` with a line end.
    """
    cells = materialize(numbered(ordered, ["conv_id", "cell"]), "cells")
    at = F.xxhash64("conv_id", "cell")
    # Equal hashes of other cells do no harm: what is cut by place without need comes out the same.
    crowded = cells.filter(F.col("total") > BLOCK).select(at.alias("crowded")).distinct().withColumn("is_crowded", F.lit(True))
    turns = lookup_join(
        turns_of(logs).withColumn("at", at), crowded, "at", "crowded", spread_by=("turn", "role", "digest"), how="left"
    )
    markup = F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"), F.col("text"), F.lit("<|im_end|>\n"))

    def piece(rows: DataFrame, copies: Column, chat: Column) -> DataFrame:
        listed = F.sort_array(F.collect_list(F.struct("turn", "role", "digest", chat.alias("chat"))))
        made = rows.groupBy("conv_id", "cell", "sub").agg(listed.alias("turns"), F.sum(copies).alias("n"))
        return made.select("conv_id", "cell", "sub", "n", F.array_join(F.col("turns.chat"), "").alias("chat"))

    usual = turns.filter("is_crowded is null").withColumn("sub", F.lit(0).cast("long"))
    spans = cut(cells.withColumn("at", at).join(crowded, F.col("at") == F.col("crowded"), "left_semi"), "sub")
    spans = spans.select(*EQUAL, "sub", "copies")
    distinct = turns.filter("is_crowded").groupBy(*EQUAL).agg(F.max("text").alias("text"))
    pieces = piece(usual, F.lit(1), markup).unionByName(
        piece(distinct.join(spans, EQUAL), F.col("copies"), F.repeat(markup, F.col("copies").cast("int")))
    )
    # The pieces of the kept conversations are numbered without their text, in the ranges of the order.
    blocks = cut(cells.drop("total"), "sub").groupBy("conv_id", "cell", "sub").agg(
        F.min("part").alias("part"), F.min("seq").alias("seq"), F.lit(1).alias("copies")
    )
    blocks = numbered(blocks.join(kept.withColumnRenamed("total", "n_turns"), "conv_id"), ["conv_id"])
    blocks = blocks.select("conv_id", "cell", "sub", F.col("before").cast("int").alias("piece"), "n_turns")
    return pieces.join(blocks, ["conv_id", "cell", "sub"]).select(
        "conv_id", "piece", "n_turns", F.col("n").cast("long").alias("n_piece_turns"), "chat"
    )


def collapse_and_render(
    logs: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Drop the conversations that prefix longer ones and render the others.

    Rows without a conversation id are left out. Turns without a number count as number 0, and
    repeated turns are turns. Other columns are not carried, an empty table gives an empty one.
    """
    columns = {"conv_id": conv_id, "turn": turn, "role": role, "text": text}
    logs = logs.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))
    ordered = in_order(turns_of(logs))
    return render(logs, materialize(maximal(ordered), "kept"), ordered)


#: The result over the given table, whose conversations the plain statement compares as joined strings.
ORACLE = f"""
with t as (
  select conv_id, coalesce(turn, 0) as turn, floor(coalesce(turn, 0) / {BLOCK}.0) as cell,
         coalesce(role, '') as role, coalesce("text", '') as body
  from conversations where conv_id is not null
), p as (
  select conv_id,
         row_number() over w as place, count(*) over (partition by conv_id) as total,
         md5(string_agg(md5(role || chr(0) || body), ',') over w) as prefix
  from t window w as (partition by conv_id order by turn, role, md5(body) rows between unbounded preceding and current row)
), kept as (
  select e.conv_id, e.total from p e where e.place = e.total
  and not exists (select 1 from p l where l.place = e.place and l.prefix = e.prefix and l.total > e.total)
), ranked as (
  select *, floor((row_number() over (partition by conv_id, cell order by turn, role, md5(body)) - 1) / {BLOCK}.0) as sub from t
), pieces as (
  select conv_id, cell, sub, count(*) as n,
         string_agg('<|im_start|>' || role || chr(10) || body || '<|im_end|>' || chr(10), '' order by turn, role, md5(body)) as chat
  from ranked group by conv_id, cell, sub
)
select conv_id, row_number() over (partition by conv_id order by cell, sub) - 1 as piece, total as n_turns, n as n_piece_turns, chat
from pieces join kept using (conv_id)
"""
