"""Conversation repair against all edit sequences, over block borders, and on edge rows."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from compare import differences
from pyspark.sql import functions as F

from voxsift.llm import conversation_repair as repair, queries

SCHEMA = "conv_id long, turn long, role string, text string, cost string, audit string"
WHITE = " \t\n\x0b\x0c\r"


def plain_faults(rows):
    """``(initial, fault)`` of each row, taken in order."""
    seen, out = set(), []
    for role, text in rows:
        body = text.rstrip(WHITE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role[:1], fault))
    return out


def plain_repair(rows):
    """The cheapest edits and the turns they leave, by trying all sequences with at most two insertions in a row."""
    faults, best = plain_faults(rows), None
    options = []
    for (role, text), (initial, fault) in zip(rows, faults):
        own = [("D", 3, None)]
        if fault not in ("blank", "duplicate"):
            extra = fault == "truncated"
            own += [("K", extra, (role, text)), ("R", 2 + extra, ("user", text)), ("R", 2 + extra, ("assistant", text))]
        options.append([("", 0, None)])
        options[-1] += [("I" * n, 2 * n, roles) for n in (1, 2) for roles in itertools.product(("user", "assistant"), repeat=n)]
        options.append(own)
    options.append([("I" * n, 2 * n, roles) for n in (0, 1, 2) for roles in itertools.product(("user", "assistant"), repeat=n)])

    def walk(at, cost, audit, turns, initials):
        nonlocal best
        if best and cost > best[0]:
            return
        if not re.fullmatch(r"s?(ua)*u?", initials):
            return
        if at == len(options):
            if re.fullmatch(r"(s?(ua)+)?", initials) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, turns)
            return
        for letters, price, made in options[at]:
            if not made:
                added = []
            elif set(letters) == {"I"}:
                added = [(role, "") for role in made]
            else:
                added = [made]
            walk(at + 1, cost + price, audit + letters, turns + added, initials + "".join(r[:1] or "-" for r, _ in added))

    walk(0, 0, "", [], "")
    return best


def made_conversations(count, seed=5, longest=5):
    draw = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", ""], ["Yes.", "No!", "why", " ", "Well? \n", "so"]
    return {n: [(draw.choice(roles), draw.choice(texts)) for _ in range(draw.randint(1, longest))] for n in range(count)}


def frame(spark, conversations):
    rows = [(n, t, role, text, "x", "y") for n, own in conversations.items() for t, (role, text) in enumerate(own)]
    return spark.createDataFrame(rows, SCHEMA)


def found(result):
    summary = {r["conv_id"]: r for r in result.conversations.collect()}
    turns = {}
    for r in result.turns.orderBy("place", "step").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    return summary, turns


@pytest.mark.parametrize("bits", [13, 1])
def test_against_all_edit_sequences(spark, bits):
    """With blocks of two rows nearly every conversation crosses blocks."""
    conversations = made_conversations(120)
    result = repair.repair(frame(spark, conversations), block_bits=bits)
    summary, turns = found(result)
    digests = {r["name"]: r["sha256"] for r in repair.digests(result.turns).collect()}
    for n, rows in conversations.items():
        cost, audit, left = plain_repair(rows)
        faults = [f for _, f in plain_faults(rows)]
        initials = [r for r, _ in plain_faults(rows)]
        row = summary[n]
        assert (row["cost"], row["audit"], turns.get(n, [])) == (cost, audit, left), rows
        assert [row[f] for f in ("blank", "duplicate", "truncated")] == [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        assert row["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        assert (row["gaps"], row["n_rows"]) == (0, len(rows))
        lines = "\n".join(f"{role}:{text}" for role, text in left)
        assert digests.get(f"={n}", hashlib.sha256(b"").hexdigest()) == hashlib.sha256(lines.encode()).hexdigest()


def test_one_long_conversation_is_cut_into_blocks(spark):
    """A conversation of most rows gives the same result in one block and in hundreds."""
    rows = spark.range(3000).select(
        F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.pmod(F.xxhash64("id"), F.lit(3)) == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.col("id").cast("string"), F.when(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)) == 0, "").otherwise(".")).alias("text"),
    )
    small, whole = (repair.repair(rows, block_bits=bits) for bits in (4, 13))
    assert small.conversations.collect() == whole.conversations.collect()
    assert repair.digests(small.turns).collect() == repair.digests(whole.turns).collect()
    one = small.conversations.first()
    assert one["cost"] == sum({"K": 0, "R": 2, "D": 3, "I": 2}[c] for c in one["audit"]) + one["truncated"] - cut_deleted(small, one)


def cut_deleted(result, summary):
    """Truncated rows that were deleted: those of the summary less those that stay."""
    stay = result.turns.where("edit != 'Insert'").where(~F.col("text").endswith(".")).count()
    return summary["truncated"] - stay


def test_powers_equal_repeated_steps():
    powers = repair.Powers()
    for symbol in range(16):
        after = repair.AT_END
        for count in range(1, 70):
            after = np.minimum((repair.row_matrix(symbol) + after[None, :]).min(axis=1), repair.NEVER)
            assert (powers.before(symbol, count, repair.AT_END) == after).all()
        assert (powers.matrix([(symbol, 69)]) + repair.AT_END[None, :]).min(axis=1).tolist() == after.tolist()


def test_edge_rows(spark):
    long = "word " * 40_000
    rows = [
        (1, None, "user", "First.", None, None), (1, 3, "user", "First.", None, None), (1, 3, "assistant", long, None, None),  # repeated, truncated, long
        (2, 0, None, None, None, None), (None, 5, "user", "Hi.", None, None), (None, 9, "assistant", "Ho.", None, None),
        (3, 0, "assistant", "A.", None, None), (3, 0, "assistant", "A.", None, None), (4, None, "user", "Q?", None, None), (4, None, "assistant", "B.", None, None),
    ]
    summary, turns = found(repair.repair(spark.createDataFrame(rows, SCHEMA)))
    assert {k: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["audit"]) for k, r in summary.items()} == {
        1: (0, 0, 1, 1, "KKD"), 2: (0, 1, 0, 0, "D"), None: (3, 0, 0, 0, "KK"),
        3: (0, 0, 1, 0, summary[3]["audit"]), 4: (0, 0, 0, 0, summary[4]["audit"]),
    }
    assert turns[1] == [("user", "First."), ("assistant", long)]
    # rows of one turn are taken by role: the assistant's comes first
    assert plain_repair([("assistant", "B."), ("user", "Q?")])[1] == summary[4]["audit"]
    assert plain_repair([("assistant", "A."), ("assistant", "A.")])[1] == summary[3]["audit"]


def test_empty_table(spark):
    result = repair.repair(spark.createDataFrame([], SCHEMA))
    assert result.conversations.count() == 0 and result.turns.count() == 0


def test_query_returns_every_conversation(spark, tmp_path):
    """Conversations whose rows are all dropped keep a row of zeros; nulls count as one space in the checksum."""
    rows = [(n, t, r, "Yes.", "", "") for n in range(60) for t, r in ((0, "user"),)]
    rows += [(None, None, None, None, "", ""), (None, 2, "user", "Hi!", "", ""), (99, 4, None, "x.", "", "")]
    spark.createDataFrame(rows, SCHEMA).drop("cost", "audit").write.parquet(str(tmp_path / "conversations.parquet"))
    query, sql = queries.QUERIES["op13_conversation_repair"], queries.ORACLE["op13_conversation_repair"]
    assert differences(spark, str(tmp_path), query, sql.replace("FROM conversations", f"FROM '{tmp_path}/conversations.parquet/*.parquet'")) is None
    got = query(spark, str(tmp_path)).collect()
    assert len(got) == 62
    empty = [r for r in got if r["repaired_sha256"] == hashlib.sha256(b"").hexdigest() and r["audit"] == ""]
    assert empty and all(r["cost"] == 0 for r in empty)
