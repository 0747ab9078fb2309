"""Repair of conversations whose turns are out of order, empty, repeated or cut off: the cheapest edits by dynamic programming.

A repaired conversation reads ``(s?(ua)+)?`` in the initials of its roles. While a conversation is read it is in one of
four states; a row moves between them at a cost that depends only on the row's symbol (initial and fault). So a run of
equal symbols is one min-plus matrix raised to the run's length, which is applied through cached binary powers.

Conversations are sorted over range partitions and cut into blocks of at most ``BLOCK`` rows, whatever their length. A
conversation within one block is solved there. One that crosses blocks is solved in three steps that each see small
rows: a matrix per segment, costs from the end backwards over the segments, and the choices of every segment from each
of the four states, of which the chain of states from the start picks one. No task holds more than a block of symbols.
"""

from __future__ import annotations

from typing import NamedTuple

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from voxsift.staging import shuffle_partitions, stage

WHITE = " \t\n\x0b\x0c\r"
#: Rows of a block, as a power of two.
BLOCK_BITS = 13

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the next user or assistant turn; a turn that is inserted or given another role can only be this one.
FOLLOWS = (USER, USER, ASSISTANT, USER)
#: Symbols: initial (s, u, a, other) + 4 * fault.
FAULTS = ("", "truncated", "blank", "duplicate")
NEVER = 1 << 50


def kept_state(state: int, initial: int) -> int | None:
    """The state after a turn with this initial is kept, if it may stand there."""
    if initial == 0:
        return SYSTEM if state == START else None
    if initial == 1:
        return USER if state != USER else None
    if initial == 2:
        return ASSISTANT if state == USER else None
    return None


def row_matrix(symbol: int) -> np.ndarray:
    """Least cost from each state to each state over one row, with any insertions before it."""
    initial, fault = symbol % 4, symbol // 4
    used = np.full((4, 4), NEVER, np.int64)
    for state in range(4):
        used[state, state] = DELETE
        if fault < 2:
            extra = CUT_OFF * fault
            used[state, FOLLOWS[state]] = min(used[state, FOLLOWS[state]], REROLE + extra)
            to = kept_state(state, initial)
            if to is not None:
                used[state, to] = min(used[state, to], KEEP + extra)
    return times(inserts(), used)


def inserts() -> np.ndarray:
    """Least cost of insertions between each two states."""
    one = np.full((4, 4), NEVER, np.int64)
    for state in range(4):
        one[state, state] = 0
        one[state, FOLLOWS[state]] = INSERT
    return times(times(one, one), one)


def times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Min-plus product; entries stay below twice NEVER."""
    return np.minimum((x[:, :, None] + y[None, :, :]).min(axis=1), NEVER)


#: Cost to the end of the conversation after its last row: an empty one or one that ends with an assistant is whole.
AT_END = np.minimum((inserts() + np.array([0, NEVER, NEVER, 0])[None, :]).min(axis=1), NEVER)


class Powers:
    """Binary powers of the matrix of each symbol, made when first asked for."""

    def __init__(self):
        self.of: dict[int, list[np.ndarray]] = {}

    def power(self, symbol: int, bit: int) -> np.ndarray:
        row = self.of.setdefault(symbol, [])
        while len(row) <= bit:
            row.append(times(row[-1], row[-1]) if row else row_matrix(symbol))
        return row[bit]

    def before(self, symbol: int, count: int, after: np.ndarray) -> np.ndarray:
        """Costs to the end before a run, from those after it."""
        for bit in range(count.bit_length()):
            if count >> bit & 1:
                after = np.minimum((self.power(symbol, bit) + after[None, :]).min(axis=1), NEVER)
        return after

    def matrix(self, runs: list[tuple[int, int]]) -> np.ndarray:
        whole = np.where(np.eye(4, dtype=bool), 0, NEVER).astype(np.int64)
        for symbol, count in runs:
            for bit in range(count.bit_length()):
                if count >> bit & 1:
                    whole = times(whole, self.power(symbol, bit))
        return whole


def runs_of(symbols: bytes) -> list[tuple[int, int]]:
    """``(symbol, length)`` of the runs of equal symbols."""
    codes = np.frombuffer(symbols, np.uint8)
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.empty(0, int)
    lengths = np.diff(np.append(starts, len(codes)))
    return [(int(codes[at]), int(n)) for at, n in zip(starts, lengths)]


def chosen(state: int, symbol: int, here: np.ndarray, after: np.ndarray) -> tuple[str, str, int]:
    """Edits of one row as initials, the turns they leave, and the state behind them; of equally cheap edits those
    least in ASCII. Turns: ``k`` the row, ``U`` or ``A`` the row as user or assistant, ``u`` or ``a`` an inserted one."""
    initial, fault, edits, turns = symbol % 4, symbol // 4, "", ""
    while True:
        cost, to = here[state], FOLLOWS[state]
        if DELETE + after[state] == cost:
            return edits + "D", turns, state
        if INSERT + here[to] == cost:
            edits, turns, state = edits + "I", turns + ("u" if to == USER else "a"), to
            continue
        kept = kept_state(state, initial)
        if fault < 2 and kept is not None and KEEP + CUT_OFF * fault + after[kept] == cost:
            return edits + "K", turns + "k", kept
        return edits + "R", turns + ("U" if to == USER else "A"), to


def unrolled(powers: Powers, runs: list[tuple[int, int]], state: int, after: np.ndarray, ends: bool) -> tuple[list[str], list[str], int]:
    """Edits and turns of every row of a segment entered in ``state``, and the state behind it. Costs at the ends of runs
    come from the powers; within a run they are stepped back row by row while the run is unrolled."""
    behind = [after]
    for symbol, count in reversed(runs):
        behind.append(powers.before(symbol, count, behind[-1]))
    behind.reverse()
    edits, turns = [], []
    for (symbol, count), last in zip(runs, behind[1:]):
        one, steps = powers.power(symbol, 0), [last]
        for _ in range(count):
            steps.append(np.minimum((one + steps[-1][None, :]).min(axis=1), NEVER))
        costs = [s.tolist() for s in reversed(steps)]
        for here, there in zip(costs, costs[1:]):
            edit, turn, state = chosen(state, symbol, here, there)
            edits.append(edit)
            turns.append(turn)
    while ends and state not in (START, ASSISTANT):
        edits[-1] += "I"
        turns[-1] += "u" if FOLLOWS[state] == USER else "a"
        state = FOLLOWS[state]
    return edits, turns, state


class Repair(NamedTuple):
    """``conversations``: one row per conversation that has rows: its key, ``n_rows``, ``gaps``, ``blank``, ``duplicate``,
    ``truncated``, ``illegal``, ``cost``, ``audit``. ``turns``: the repaired turns: the key, ``place`` and ``step`` (their
    order), ``role``, ``text``, ``edit``."""

    conversations: DataFrame
    turns: DataFrame


def name_of(key: str) -> Column:
    """The key as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{key}`").cast("string")), F.lit(""))


def placed(rows: DataFrame, key: str, turn: str, role: str, text: str, block_bits: int) -> DataFrame:
    """``name, key, turn, role, text, place, block, initial, seen`` (white space cut from the text's end), written in order."""
    own = rows.select(
        name_of(key).alias("name"), F.col(f"`{key}`").alias("key"), F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = ["name", F.col("turn").asc_nulls_first(), "role", "text", "tie"]
    ordered = own.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    initial = F.array_position(F.array(F.lit("s"), F.lit("u"), F.lit("a")), F.left("role", F.lit(1)))
    end = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    ordered = ordered.select("name", "key", "turn", "role", "text", place.alias("place"), F.when(initial == 0, 3).otherwise(initial - 1).cast("int").alias("initial"), end.alias("end"))
    return stage(ordered, "turns-in-order").withColumn("block", F.shiftright("place", block_bits))


def symbols(rows: DataFrame) -> DataFrame:
    """``name, block, place, turn, symbol``: a row whose role and text stand earlier in its conversation is a duplicate.
    Rows are matched with first places by the place, which no two rows share, so a hot conversation stays spread."""
    visible = F.col("end") != ""
    firsts = rows.where(visible).groupBy("name", "role", F.md5("text").alias("print")).agg(F.min("place").alias("place"))
    found = rows.select("name", "block", "place", "turn", "initial", "end").join(firsts.select("place", F.lit(True).alias("first")), "place", "left")
    fault = F.when(~visible, 2).when(F.col("first").isNull(), 3).when(~F.col("end").isin(".", "!", "?"), 1).otherwise(0)
    return found.select("name", "block", "place", "turn", (F.col("initial") + 4 * fault).alias("symbol"))


def segments(marked: DataFrame) -> DataFrame:
    """``name, block, start, symbols``: the rows of a conversation in one block; their places follow each other."""
    own = F.sort_array(F.collect_list(F.struct("place", "symbol")))  # at most the rows of a block
    grouped = marked.groupBy("name", "block").agg(own.alias("own"))
    return grouped.select("name", "block", F.col("own")[0]["place"].alias("start"), F.col("own")["symbol"].alias("symbols"))


def chained(segs: DataFrame) -> DataFrame:
    """``name, block, entry, after, ends`` of the segments of conversations that cross blocks."""

    @pandas_udf("array<long>")
    def matrix(codes: pd.Series) -> pd.Series:
        powers = Powers()
        return pd.Series([powers.matrix(runs_of(bytes(list(c)))).ravel() for c in codes])

    def backwards(frame: pd.DataFrame) -> pd.DataFrame:
        frame, after, out = frame.sort_values("block"), AT_END, []
        for row in frame[::-1].itertuples():
            out.append((row.name, row.block, after, not out))
            after = np.minimum((np.array(row.matrix).reshape(4, 4) + after[None, :]).min(axis=1), NEVER)
        return pd.DataFrame(out, columns=["name", "block", "after", "ends"])

    @pandas_udf("array<int>")
    def exits(codes: pd.Series, after: pd.Series) -> pd.Series:
        powers = Powers()
        return pd.Series([[unrolled(powers, runs_of(bytes(list(c))), s, np.array(a), False)[2] for s in range(4)] for c, a in zip(codes, after)])

    def forwards(frame: pd.DataFrame) -> pd.DataFrame:
        frame, state, out = frame.sort_values("block"), START, []
        for row in frame.itertuples():
            out.append((row.name, row.block, state, row.after, row.ends))
            state = row.exits[state]
        return pd.DataFrame(out, columns=["name", "block", "entry", "after", "ends"])

    backs = segs.select("name", "block", matrix("symbols").alias("matrix")).groupBy("name").applyInPandas(backwards, "name string, block long, after array<long>, ends boolean")
    known = segs.join(backs, ["name", "block"])
    ways = known.select("name", "block", "after", "ends", exits("symbols", "after").alias("exits"))
    return ways.groupBy("name").applyInPandas(forwards, "name string, block long, entry int, after array<long>, ends boolean")


PIECE = "name string, block long, start long, audit string, cost long, n int, first int, last int, illegal long, edits array<string>, turns array<string>"


def pieces(batches):
    """The choices of each segment, given the state it is entered in and the costs behind it."""
    powers = Powers()
    for batch in batches:
        out = []
        for row in batch.itertuples():
            codes = bytes(list(row.symbols))
            after = AT_END if row.after is None else np.array(row.after)
            edits, turns, _ = unrolled(powers, runs_of(codes), row.entry, after, row.ends)
            audit = "".join(edits)
            starts = np.frombuffer(codes, np.uint8) % 4
            pairs = starts[:-1] * 4 + starts[1:]
            cost = audit.count("D") * DELETE + audit.count("I") * INSERT + audit.count("R") * REROLE
            cost += sum(CUT_OFF for code, edit in zip(codes, edits) if code // 4 == 1 and "D" not in edit)
            out.append((row.name, row.block, row.start, audit, cost, len(codes), int(starts[0]), int(starts[-1]), int((~np.isin(pairs, LEGAL)).sum()), edits, turns))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECE.split(", ")])


#: su, ua and au, as 4 * initial + initial.
LEGAL = (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1)


def repair(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_bits: int = BLOCK_BITS) -> Repair:
    """Finds faults and the cheapest repair of each conversation.

    Rows are taken by turn (nulls first), rows of one turn by role, then text. A null role or text is one space; rows
    with a null key are one conversation; further columns are not looked at, whatever their names. A row's first fault
    counts: blank, duplicate (role and text seen earlier in the conversation), truncated (does not end with ``.``, ``!``
    or ``?``). Keeping a row costs 0, giving it the role user or assistant 2, deleting it 3, which blank and duplicate
    rows require, inserting an empty turn 2; a truncated row that stays adds 1. Among the cheapest repairs the one with
    the least audit in ASCII is taken. Repeated rows are duplicates; an empty table gives empty results. A conversation
    may hold any share of the rows: nothing but its audit and its number of blocks grows with it in one place.
    """
    ordered = placed(rows, key, turn, role, text, block_bits)
    marked = stage(symbols(ordered), "symbols")
    segs = stage(segments(marked), "segments")
    many = segs.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")
    cross = stage(segs.join(many, "name", "left_semi"), "crossing")
    alone = segs.join(many, "name", "left_anti").select("*", F.lit(START).alias("entry"), F.lit(None).cast("array<long>").alias("after"), F.lit(True).alias("ends"))
    known = alone.unionByName(cross.join(chained(cross), ["name", "block"]))
    solved = stage(known.mapInPandas(pieces, PIECE), "repair")

    turn_rows = marked.groupBy("name", "turn").agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.sum((F.floor(F.col("symbol") / 4) == n).cast("long")).alias(fault) for n, fault in enumerate(FAULTS) if fault],
    )
    seen = turn_rows.groupBy("name").agg(
        F.sum("n_rows").alias("n_rows"), *[F.sum(f).alias(f) for f in FAULTS if f],
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
    )
    ordered_pieces = F.sort_array(F.collect_list(F.struct("block", "audit", "first", "last")))
    sums = solved.groupBy("name").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("within"), ordered_pieces.alias("own"))
    meets = F.aggregate(
        F.sequence(F.lit(1), F.size("own") - 1), F.lit(0).cast("long"),
        lambda n, k: n + (~(F.col("own")[k - 1]["last"] * 4 + F.col("own")[k]["first"]).isin(*LEGAL)).cast("long"),
    )
    sums = sums.select(
        "name", "cost", (F.col("within") + F.when(F.size("own") > 1, meets).otherwise(0)).alias("illegal"),
        F.array_join(F.col("own")["audit"], "").alias("audit"),
    )
    keys = ordered.groupBy("name").agg(F.first("key").alias(key))
    found = keys.join(seen, "name").join(sums, "name")
    summary = found.select(key, "n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    each = solved.select("start", F.posexplode(F.arrays_zip("edits", "turns")).alias("at", "x"))
    each = each.select((F.col("start") + F.col("at")).alias("place"), F.col("x.edits").alias("edits"), F.col("x.turns").alias("turns")).where("turns != ''")
    left = each.join(ordered.select("place", F.col("key").alias(key), "role", "text"), "place")
    left = left.select(key, "place", "role", "text", "edits", F.posexplode(F.split("turns", "")).alias("step", "how"))
    inserted = F.col("how").isin("u", "a")
    new_role = F.when(F.lower("how") == "u", "user").when(F.lower("how") == "a", "assistant").otherwise(F.col("role"))
    edit = F.when(inserted, "Insert").when(F.col("how") == "k", "Keep").otherwise("Rerole")
    turns = left.select(key, "place", "step", new_role.alias("role"), F.when(inserted, "").otherwise(F.col("text")).alias("text"), edit.alias("edit"))
    return Repair(summary, turns)


def digests(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """``name, sha256`` of each conversation's ``role:text`` lines. The digest runs along the sorted rows of a partition, so
    of a conversation of any length only a batch of rows is held; its rows do pass through one task, since a digest
    can only be carried on in order."""

    def run(batches):
        name, digest = None, None
        for batch in batches:
            out = []
            for own, line in zip(batch["name"], batch["line"]):
                if digest is None or own != name:
                    if digest is not None:
                        out.append((name, digest.hexdigest()))
                    name, digest = own, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(line.encode())
            yield pd.DataFrame(out, columns=["name", "sha256"])
        if digest is not None:
            yield pd.DataFrame([(name, digest.hexdigest())], columns=["name", "sha256"])

    lines = turns.select(name_of(key).alias("name"), "place", "step", F.concat("role", F.lit(":"), "text").alias("line"))
    lines = lines.repartition("name").sortWithinPartitions("name", "place", "step")
    return lines.select("name", "line").mapInPandas(run, "name string, sha256 string")


def damage(rows: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Rows of ``role`` and ``text`` harmed by a checksum of key and turn: a twentieth each dropped, emptied, stripped of
    sentence ends, repeated, or given to the user. Nulls in role and text become one space."""
    space = F.lit(" ")
    draw = F.crc32(F.concat(F.coalesce(F.col(key).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))) % 20
    text, role = F.coalesce(F.col("text"), space), F.coalesce(F.col("role"), space)
    harmed = rows.select(
        key, turn, draw.alias("draw"),
        F.when(draw == 4, "user").otherwise(role).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
    ).where("draw != 0")
    copies = F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return harmed.select(key, turn, "role", "text", F.explode(copies).alias("copy")).drop("copy")
