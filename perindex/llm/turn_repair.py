"""Cheapest repair of the structure of conversations, by divide and conquer in linear space.

A repaired conversation has roles ``(system? (user assistant)+)?``. Four states follow that
pattern, and each row moves between them by an edit: keep, rerole, delete, or inserts before it.
The edits of least cost are not read from a table of all rows. Costs run forward from the start and
backward from the end as vectors of four, one for each state, and meet in the middle; the crossing
of least cost is fixed, and both halves are solved alike. Among equal costs the audit (the initials
of the edits) that comes first in ASCII order wins: a forward vector also ranks the audits that
lead to its states. Audits of one place never begin one another, since each ends with the edit of
the same row, so the ranks alone decide.

A run of rows acts on a vector like one row does, through its costs and ranks from state to state.
So conversations are dealt into parts of bounded length, parts are merged up a tree of bounded
fan-out, crossings are fixed down that tree, and the same division goes on inside each part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perindex.llm.text_batches import map_columns
from perindex.session import materialize

#: Rows in a part, and parts (or nodes) below a node of the tree, as powers of two.
PART_BITS, FAN_BITS = 9, 12
#: States of the pattern: nothing yet, after the system turn, after a user turn, after an assistant turn.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or reroled turn, and the edits that end a conversation in each state.
FOLLOWS = (USER, USER, ASSISTANT, USER)
TAIL = ("", "II", "I", "")
INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
#: Symbols of rows: initial of the role (``x``: any other); capital if cut off; ``d`` if it must go.
SYMBOLS = "dsuaxSUAX"
#: White space of the fault definitions: blank and tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"

#: For each state the states that can follow, each with the cost and the rank of its audit.
Step = tuple[tuple[tuple[int, int, int], ...], ...]


def row_edits(symbol: str) -> dict[tuple[int, int], tuple[int, str]]:
    """The least cost and audit of one row from state to state, with the inserts before it."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    late = TRUNCATED if symbol.isupper() else 0
    for start in range(4):
        state = start
        for inserts in range(3):  # a third one would come back to a state that was there before
            moves = [(state, DELETE, "D")]
            if symbol != "d":
                moves.append((FOLLOWS[state], REROLE + late, "R"))
                kept = {("s", EMPTY): SYSTEM, ("a", USER): ASSISTANT}.get((symbol.lower(), state))
                if symbol in "uU" and state != USER:
                    kept = USER
                if kept is not None:
                    moves.append((kept, late, "K"))
            for end, cost, letter in moves:
                found = (INSERT * inserts + cost, "I" * inserts + letter)
                best[start, end] = min(found, best.get((start, end), found))
            state = FOLLOWS[state]
    return best


EDITS = {symbol: row_edits(symbol) for symbol in SYMBOLS}


def row_step(symbol: str) -> Step:
    rows = []
    for start in range(4):
        ends = sorted((audit, end, cost) for (s, end), (cost, audit) in EDITS[symbol].items() if s == start)
        rows.append(tuple((end, cost, rank) for rank, (_, end, cost) in enumerate(ends)))
    return tuple(rows)


ROW_STEPS = {symbol: row_step(symbol) for symbol in SYMBOLS}


def advance(vector: dict[int, tuple[int, int]], step: Step) -> dict[int, tuple[int, int]]:
    """Move a vector ``state: (cost, rank)`` forward over a step."""
    best: dict[int, tuple[int, int, int]] = {}
    for state, (cost, rank) in vector.items():
        for end, more, order in step[state]:
            found = (cost + more, rank, order)
            if end not in best or found < best[end]:
                best[end] = found
    ranked = sorted(best, key=lambda end: best[end][1:])
    return {end: (best[end][0], rank) for rank, end in enumerate(ranked)}


def retreat(costs: dict[int, int], step: Step) -> dict[int, int]:
    """Move the costs up to the end backward over a step."""
    out = {}
    for state in range(4):
        ways = [more + costs[end] for end, more, _ in step[state] if end in costs]
        if ways:
            out[state] = min(ways)
    return out


def merged(steps: list[Step]) -> Step:
    """One step that acts like all of ``steps``, one after the other."""
    rows = []
    for start in range(4):
        vector = {start: (0, 0)}
        for step in steps:
            vector = advance(vector, step)
        rows.append(tuple((end, cost, rank) for end, (cost, rank) in sorted(vector.items())))
    return tuple(rows)


def crossings(steps: list[Step], entry: int, leave: int) -> list[int]:
    """The states between and around ``steps`` on the way of least cost, then least audit."""
    states = [entry] * len(steps) + [leave]
    todo = [(0, len(steps))]
    while todo:
        low, high = todo.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        vector = {states[low]: (0, 0)}
        for step in steps[low:middle]:
            vector = advance(vector, step)
        costs = {states[high]: 0}
        for step in reversed(steps[middle:high]):
            costs = retreat(costs, step)
        states[middle] = min((vector[s][0] + costs[s], vector[s][1], s) for s in vector.keys() & costs.keys())[2]
        todo += [(low, middle), (middle, high)]
    return states


def last_state(step: Step) -> tuple[int, int]:
    """The state in which a whole conversation ends, and its cost with the closing inserts."""
    cost, _, state = min((cost + INSERT * len(TAIL[end]), rank, end) for end, cost, rank in step[EMPTY])
    return state, cost


@lru_cache(maxsize=50_000)
def part_step(symbols: str) -> Step:
    return merged([ROW_STEPS[s] for s in symbols])


@lru_cache(maxsize=50_000)
def part_audits(symbols: str, entry: int, leave: int) -> list[str]:
    """For each row of a part its inserts and its edit."""
    states = crossings([ROW_STEPS[s] for s in symbols], entry, leave)
    return [EDITS[s][states[i], states[i + 1]][1] for i, s in enumerate(symbols)]


def described(audits: list[str], entry: int, symbols: str, last: bool) -> list[tuple[str, str, str | None]]:
    """For each row the initials of the turns inserted before it, its edit, and its new role.

    The last part of a conversation has a row more without an edit if turns are inserted at its end.
    """
    out, state = [], entry
    for audit, symbol in zip(audits, symbols, strict=True):
        before = ""
        for _ in audit[:-1]:
            state = FOLLOWS[state]
            before += "?sua"[state]
        edit, role = audit[-1], None
        if edit == "R":
            state = FOLLOWS[state]
            role = (None, None, "user", "assistant")[state]
        elif edit == "K":
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[symbol.lower()]
        out.append((before, edit, role))
    if last and TAIL[state]:
        out.append(("ua" if state == SYSTEM else "a", "", None))
    return out


# Steps travel between tasks as 32 numbers: costs and ranks from state to state, -1 where there is no way.


def packed(step: Step) -> list[int]:
    costs, ranks = [-1] * 16, [-1] * 16
    for start, ends in enumerate(step):
        for end, cost, rank in ends:
            costs[4 * start + end], ranks[4 * start + end] = cost, rank
    return costs + ranks


def unpacked(numbers: list[int]) -> Step:
    return tuple(
        tuple((end, numbers[4 * start + end], numbers[16 + 4 * start + end]) for end in range(4) if numbers[4 * start + end] >= 0)
        for start in range(4)
    )


def illegal_pairs(initials: str) -> int:
    return sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


def ordered_rows(logs: DataFrame) -> tuple[DataFrame, int]:
    """The rows with their ``place``, which grows with conversation, turn, role and MD5 of the text; its bits.

    Rows are dealt by ranges of all of this order, so a conversation of any length spreads. Equal rows
    are told apart by where they were read, so many of them spread as well.
    """
    spaceless = F.rtrim("text", F.lit(SPACE))
    first = F.substring("role", 1, 1)
    rows = logs.select(
        "conv_id", "turn", "role", "text",
        F.md5(F.col("text").cast("binary")).alias("digest"),
        # A role without a letter has an initial as well: one that fits nowhere.
        F.when(first.isin("s", "u", "a"), first).otherwise("x").alias("initial"),
        (spaceless == "").alias("blank"),
        (~F.substring(spaceless, -1, 1).isin(".", "!", "?")).alias("open_end"),
        F.monotonically_increasing_id().alias("copy"),
    )
    order = ["conv_id", "turn", "role", "digest", "copy"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("copy")
    rows = materialize(rows.withColumn("place", F.monotonically_increasing_id()), "turns")
    # The id is a partition and a row in it; places need no more bits than the largest ones.
    row = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    partition = F.shiftright("place", 33)
    most = rows.agg(F.max(row).alias("row"), F.max(partition).alias("partition")).first()
    bits = (most["row"] or 0).bit_length()
    place = F.shiftleft(partition, bits) + row
    rows = rows.withColumn("place", place).withColumn("part", F.shiftright(place, PART_BITS))
    return rows, bits + (most["partition"] or 0).bit_length()


def parts_of(rows: DataFrame) -> DataFrame:
    """``(conv_id, part, start, symbols, initials, ...)``: the rows of each part as one symbol each, with fault counts."""
    firsts = rows.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place"))
    firsts = firsts.select("place", F.lit(True).alias("first"))
    slim = rows.select("conv_id", "part", "place", "initial", "blank", "open_end").join(firsts, "place", "left")
    fault = F.when(F.col("blank"), "b").when(F.col("first").isNull(), "d").when(F.col("open_end"), "t").otherwise("")
    slim = slim.withColumn("fault", fault)
    symbol = F.when(F.col("fault").isin("b", "d"), "d").when(F.col("fault") == "t", F.upper("initial")).otherwise(F.col("initial"))
    return slim.groupBy("conv_id", "part").agg(
        F.min("place").alias("start"),
        F.sort_array(F.collect_list(F.struct("place", symbol.alias("symbol"), "initial"))).alias("rows"),
        *(F.count_if(F.col("fault") == letter).alias(name) for letter, name in zip("bdt", FAULTS, strict=True)),
    ).select(
        "conv_id", "part", "start", F.array_join("rows.symbol", "").alias("symbols"),
        F.array_join("rows.initial", "").alias("initials"), *FAULTS,
    )


FAULTS = ("blank", "duplicate", "truncated")
NODE = "conv_id long, node long, step array<long>, first string, last string, illegal long"


def leaves(parts: DataFrame) -> DataFrame:
    def make():
        def nodes(conv_ids, numbers, symbols, initials):
            return {
                "conv_id": conv_ids, "node": numbers, "step": [packed(part_step(s)) for s in symbols],
                "first": [i[0] for i in initials], "last": [i[-1] for i in initials],
                "illegal": [illegal_pairs(i) for i in initials],
            }

        return nodes

    return map_columns(parts, [F.col(c) for c in ("conv_id", "part", "symbols", "initials")], make, NODE)


def gathered(nodes: DataFrame) -> DataFrame:
    """The nodes below each node of the next level, in order: at most ``2 ** FAN_BITS`` of them."""
    child = F.struct("node", "step", "first", "last", "illegal")
    return nodes.groupBy("conv_id", F.shiftright("node", FAN_BITS).alias("node")).agg(
        F.sort_array(F.collect_list(child)).alias("children")
    )


def parents(families: DataFrame) -> DataFrame:
    def make():
        def nodes(conv_ids, numbers, families):
            return {
                "conv_id": conv_ids, "node": numbers,
                "step": [packed(merged([unpacked(c["step"]) for c in family])) for family in families],
                "first": [family[0]["first"] for family in families], "last": [family[-1]["last"] for family in families],
                "illegal": [
                    sum(c["illegal"] for c in family)
                    + sum(illegal_pairs(a["last"] + b["first"]) for a, b in zip(family, family[1:], strict=False))
                    for family in families
                ],
            }

        return nodes

    return map_columns(families, [F.col(c) for c in ("conv_id", "node", "children")], make, NODE, rows=64)


SPANS = "conv_id long, node long, entry int, leave int, last boolean"


def descend(families: DataFrame) -> DataFrame:
    """Fix the states around each child of nodes whose own states ``entry`` and ``leave`` are known."""

    names = ("conv_id", "node", "entry", "leave", "last")

    def make():
        def spans(conv_ids, families, entries, leaves_, lasts):
            rows = []
            for key, family, entry, leave, last in zip(conv_ids, families, entries, leaves_, lasts, strict=True):
                states = crossings([unpacked(c["step"]) for c in family], entry, leave)
                rows += [
                    (key, child["node"], states[i], states[i + 1], last and i == len(family) - 1)
                    for i, child in enumerate(family)
                ]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            return dict(zip(names, map(list, columns), strict=True))

        return spans

    return map_columns(families, [F.col(c) for c in ("conv_id", "children", *names[2:])], make, SPANS, rows=64)


def ends(nodes: DataFrame) -> DataFrame:
    """The states, cost and illegal pairs of whole conversations."""

    def make():
        def whole(conv_ids, numbers, steps, illegal):
            found = [last_state(unpacked(step)) for step in steps]
            return {
                "conv_id": conv_ids, "node": numbers, "entry": [EMPTY] * len(found), "leave": [f[0] for f in found],
                "last": [True] * len(found), "cost": [f[1] for f in found], "illegal": illegal,
            }

        return whole

    return map_columns(nodes, [F.col(c) for c in ("conv_id", "node", "step", "illegal")], make, f"{SPANS}, cost long, illegal long")


EDITED = "conv_id long, part long, start long, edits array<struct<before: string, edit: string, role: string>>, audit string"


def edit_parts(parts: DataFrame, spans: DataFrame) -> DataFrame:
    """The edits of each row of each part, and their initials as a string."""

    def make():
        def edits(conv_ids, numbers, starts, symbols, entries, leaves_, lasts):
            rows = [
                (part_audits(s, entry, leave), described(part_audits(s, entry, leave), entry, s, last))
                for s, entry, leave, last in zip(symbols, entries, leaves_, lasts, strict=True)
            ]
            return {
                "conv_id": conv_ids, "part": numbers, "start": starts,
                "edits": [[dict(zip(("before", "edit", "role"), r, strict=True)) for r in rows_] for _, rows_ in rows],
                "audit": [
                    "".join(audits) + (TAIL[leave] if last else "")
                    for (audits, _), leave, last in zip(rows, leaves_, lasts, strict=True)
                ],
            }

        return edits

    spans = spans.withColumnRenamed("node", "part").withColumnRenamed("conv_id", "conv")
    joined = parts.join(spans.withColumnRenamed("part", "at"), (F.col("part") == F.col("at")) & F.col("conv_id").eqNullSafe(F.col("conv")))
    columns = [F.col(c) for c in ("conv_id", "part", "start", "symbols", "entry", "leave", "last")]
    return map_columns(joined, columns, make, EDITED, rows=500)


class Repair:
    """The repair of all conversations of a table, as tables.

    Rows are taken by turn (nulls first), then role and MD5 of the text. Role and text must not be
    null; a conversation without an id is one like any other. Equal rows are duplicates of each
    other. Other columns are not carried, and an empty table gives empty tables. A conversation may
    hold any share of all rows.

    ``rows`` has the rows in order, ``edits`` their edits by parts, ``costs`` cost and illegal pairs of
    each conversation, ``parts`` its faults.
    """

    def __init__(self, logs: DataFrame) -> None:
        self.rows, bits = ordered_rows(logs.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"))
        bits -= PART_BITS
        self.parts = materialize(parts_of(self.rows), "parts")
        nodes, levels = leaves(self.parts), []
        while bits > 0 or not levels:
            levels.append(materialize(gathered(nodes), "nodes"))
            nodes = parents(levels[-1])
            bits -= FAN_BITS
        self.costs = materialize(ends(nodes), "costs")
        spans = self.costs
        for level in reversed(levels):
            span = spans.select(F.col("conv_id").alias("conv"), F.col("node").alias("at"), "entry", "leave", "last")
            spans = descend(level.join(span, (F.col("node") == F.col("at")) & F.col("conv_id").eqNullSafe(F.col("conv"))))
        self.edits = materialize(edit_parts(self.parts, spans), "edits")

    def repaired(self) -> DataFrame:
        """``(conv_id, place, number, edit, role, text)``: all turns after the repair.

        ``place`` and ``number`` give their order; inserted turns (``I``) have a text without a letter.
        """
        inserted = F.transform(
            F.split("step.before", "(?!^)"),
            lambda c: F.struct(
                F.lit("I").alias("edit"), F.when(c == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text")
            ),
        )
        none = F.array().cast("array<struct<edit: string, role: string, text: string>>")
        edits = self.edits.select("conv_id", "start", F.posexplode("edits").alias("index", "step"))
        turns = edits.select((F.col("start") + F.col("index")).alias("place"), F.col("conv_id").alias("conv"), "step")
        # A tail has the place after the last row, which the next conversation's first row may have too.
        kept = self.rows.join(turns.filter("step.edit in ('K', 'R')"), "place").select(
            "conv_id", "place", F.array(F.struct(F.col("step.edit").alias("edit"), F.coalesce("step.role", "role").alias("role"), "text")).alias("turns"),
            F.lit(1).alias("late"),
        )
        made = turns.filter("step.before <> ''").select(
            F.col("conv").alias("conv_id"), "place", F.concat(inserted, none).alias("turns"), F.lit(0).alias("late")
        )
        both = kept.unionByName(made).select("conv_id", "place", "late", F.posexplode("turns").alias("number", "turn"))
        return both.select("conv_id", "place", (2 * F.col("late") + F.col("number")).alias("number"), "turn.*")

    def audits(self) -> DataFrame:
        """``(conv_id, audit)``: the initials of all edits in order."""
        whole = F.sort_array(F.collect_list(F.struct("part", "audit")))
        return self.edits.groupBy("conv_id").agg(F.array_join(F.transform(whole, lambda p: p["audit"]), "").alias("audit"))

    def faults(self) -> DataFrame:
        """``(conv_id, blank, duplicate, truncated, gaps)`` of each conversation."""
        counts = self.parts.groupBy("conv_id").agg(*(F.sum(f).alias(f) for f in FAULTS))
        turns = self.rows.select("conv_id", "turn").distinct().groupBy("conv_id").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
        )
        return null_safe(counts, turns)


def null_safe(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join by conversation, where a null id is one as well."""
    right = right.withColumnRenamed("conv_id", "conv")
    return left.join(right, F.col("conv_id").eqNullSafe(F.col("conv")), how).drop("conv")


def text_digests(repaired: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of the turns as ``role:text``, joined by line ends.

    A digest is made from one end of a text to the other, so a conversation is read in order by one
    task, batch by batch, and never held.
    """
    turns = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "place", "number")
    turns = turns.select("conv_id", F.concat("role", F.lit(":"), "text").alias("line"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None
        for batch in batches:
            done = []
            for key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is None or key != current:
                    if digest is not None:
                        done.append((current, digest.hexdigest()))
                    current, digest = key, hashlib.sha256(line.encode())
                else:
                    digest.update(b"\n" + line.encode())
            yield result(done)
        if digest is not None:
            yield result([(current, digest.hexdigest())])

    def result(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["conv_id", "repaired_sha256"]
        )

    return turns.mapInArrow(task, "conv_id long, repaired_sha256 string")


def damaged(logs: DataFrame) -> DataFrame:
    """Conversations with faults made by the checksum of conversation and turn; nulls become one blank."""
    def known(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    draw = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.translate(known("text"), ".!?", "")).otherwise(known("text"))
    rows = logs.select(
        "conv_id", "turn", F.when(draw == 4, "user").otherwise(known("role")).alias("role"), text.alias("text"), draw.alias("draw")
    ).filter("draw <> 0")
    return rows.withColumn("copy", F.explode(F.expr("sequence(1, if(draw = 3, 2, 1))"))).drop("draw", "copy")


def repair_damaged(logs: DataFrame) -> DataFrame:
    """One row for each conversation of ``logs``: its faults after damage and its cheapest repair."""
    repair = Repair(damaged(logs))
    known = null_safe(null_safe(repair.faults(), repair.costs.select("conv_id", "cost", "illegal")), repair.audits())
    known = null_safe(known, text_digests(repair.repaired()), "left")
    numbers = ("gaps", *FAULTS, "illegal", "cost")
    return null_safe(logs.select(F.col("conv_id").cast("long")).distinct(), known, "left").select(
        "conv_id", *(F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in numbers),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


#: The same rows as plain SQL: checksums byte by byte, costs and audits of the four states row by row.
ORACLE = r"""
with recursive keys as (
  select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k,
         coalesce(role, ' ') as role_, coalesce("text", ' ') as text_
  from conversations
), crc_table as (
  select list(list_reduce([b] || range(8), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) order by b) as t
  from range(256) r(b)
), drawn as (
  select keys.*, xor(list_reduce([4294967295] || list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::bigint),
                      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 as draw
  from keys, crc_table
), damaged as (
  select conv_id, turn, case when draw = 4 then 'user' else role_ end as role,
         case draw when 1 then '' when 2 then translate(text_, '.!?', '') else text_ end as body
  from drawn, range(2) c(copy) where draw <> 0 and (copy = 0 or draw = 3)
), numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(body)) as k,
         case when role[1] in ('s', 'u', 'a') then role[1] else 'x' end as initial,
         rtrim(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as trimmed
  from damaged
), faulty as (
  select *, case when trimmed = '' then 'blank' when row_number() over (partition by conv_id, role, body order by k) > 1 then 'duplicate'
                 when trimmed[-1] not in ('.', '!', '?') then 'truncated' else '' end as fault,
         lag(initial) over (partition by conv_id order by k) || initial as pair
  from numbered
), inserts(start, state, n) as (
  values (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (2, 2, 2), (3, 3, 0), (3, 2, 1), (3, 3, 2)
), edits(state, finish, letter, price, initial) as (
  values (0, 0, 'D', 2, null), (1, 1, 'D', 2, null), (2, 2, 'D', 2, null), (3, 3, 'D', 2, null),
         (0, 2, 'R', 1, null), (1, 2, 'R', 1, null), (2, 3, 'R', 1, null), (3, 2, 'R', 1, null),
         (0, 1, 'K', 0, 's'), (0, 2, 'K', 0, 'u'), (1, 2, 'K', 0, 'u'), (3, 2, 'K', 0, 'u'), (2, 3, 'K', 0, 'a')
), walk as (
  select distinct conv_id, 0::bigint as k, 0 as state, {'cost': 0, 'audit': ''} as best from faulty
  union all
  select w.conv_id, w.k + 1, e.finish,
         min({'cost': w.best.cost + 5 * i.n + e.price + case when f.fault = 'truncated' and e.letter <> 'D' then 5 else 0 end,
              'audit': w.best.audit || repeat('I', i.n) || e.letter})
  from walk w join faulty f on f.conv_id is not distinct from w.conv_id and f.k = w.k + 1
  join inserts i on i.start = w.state
  join edits e on e.state = i.state and (e.letter = 'D' or f.fault not in ('blank', 'duplicate')) and (e.initial is null or e.initial = f.initial)
  group by w.conv_id, w.k + 1, e.finish
), lengths as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
         count_if(fault = 'blank') as blank, count_if(fault = 'duplicate') as duplicate, count_if(fault = 'truncated') as truncated,
         count_if(pair not in ('su', 'ua', 'au')) as illegal
  from faulty group by conv_id
), whole as (
  select w.conv_id, min({'cost': w.best.cost + case w.state when 1 then 10 when 2 then 5 else 0 end,
                         'audit': w.best.audit || case w.state when 1 then 'II' when 2 then 'I' else '' end}) as best
  from walk w join lengths l on l.conv_id is not distinct from w.conv_id and l.n = w.k group by w.conv_id
), letters as (
  select conv_id, i, best.audit[i] as letter, length(replace(best.audit[1:i], 'I', '')) as k
  from whole, unnest(range(1, length(best.audit) + 1)) r(i)
), kept as (
  select l.conv_id, l.i, l.letter, f.role, f.body, row_number() over (partition by l.conv_id order by l.i) as o,
         first_value(case when l.letter = 'K' and f.initial = 's' then 1 else 0 end) over (partition by l.conv_id order by l.i) as shift
  from letters l left join faulty f on f.conv_id is not distinct from l.conv_id and f.k = l.k where l.letter <> 'D'
), texts as (
  select conv_id, sha256(string_agg(
           case when letter = 'K' then role when (o - shift) % 2 = 1 then 'user' else 'assistant' end || ':' || case when letter = 'I' then '' else body end,
           chr(10) order by i)) as digest
  from kept group by conv_id
)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
       coalesce(illegal, 0) as illegal, coalesce(best.cost, 0)::bigint as cost, coalesce(best.audit, '') as audit,
       coalesce(digest, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join lengths l on l.conv_id is not distinct from c.conv_id
left join whole w on w.conv_id is not distinct from c.conv_id
left join texts t on t.conv_id is not distinct from c.conv_id
"""
