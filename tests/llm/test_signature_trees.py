"""Signature trees against all pairs, with small blocks, and on edge rows."""

import itertools
import random
import re

import numpy as np
import pytest

from voxsift.llm import signature_trees as trees

SCHEMA = "doc_id long, text string, n long, print string, label string, component_id string"
WORDS = [a + b for a in ("ba", "ko", "li", "mu", "ne", "ra") for b in ("so", "ti", "vu", "za", "pe", "ga")]


def prose(seed, n):
    draw = random.Random(seed)
    return [draw.choice(WORDS) + draw.choice(WORDS) for _ in range(n)]


def changed(words, seed, many):
    draw, own = random.Random(seed), list(words)
    for at in draw.sample(range(len(own)), many):
        own[at] = f"w{seed}x{at}"
    return own


def shingles(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(found[k : k + words]) for k in range(max(1, len(found) - words + 1))} if found else set()


def all_pairs(rows, words, percent):
    """Component and set size per row; rows of one key are one document."""
    sets = [shingles(text, words) for _, text in rows]
    label = list(range(len(rows)))

    def join(a, b):
        low, high = sorted((label[a], label[b]))
        if low != high:
            label[:] = [low if v == high else v for v in label]

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x and y and (100 * len(x & y) >= percent * len(x | y) or rows[a][0] is not None and rows[a][0] == rows[b][0]):
            join(a, b)
    out = []
    for n, (key, _) in enumerate(rows):
        keys = [k for (k, _), own in zip(rows, label) if own == label[n] and k is not None]
        out.append((key, len(sets[n]), min(keys, default=None)))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    frame = spark.createDataFrame([(k, t, 1, "a", "b", "c") for k, t in rows], SCHEMA)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in trees.ngram_links(frame, **options).collect()), key=repr)


def made_rows():
    """Chains and stars of near copies, a template below the threshold, texts of common lines only, short and long texts."""
    line = prose(900, 30)
    texts = [prose(n, 80) for n in range(12)]
    for n in range(25):  # chains: each a small step from the one before
        texts.append(changed(texts[-1] if n % 8 else texts[n % 12], 100 + n, 2))
    hub = prose(50, 150)
    texts += [hub, *[changed(hub, 200 + n, 3) for n in range(30)]]
    template = prose(60, 70)
    texts += [template + prose(300 + n, 40) for n in range(30)]
    texts += [line * 2 + line[: n + 1] for n in range(12)] + [prose(0, 3), prose(0, 4), prose(0, 5), prose(7, 3000), changed(prose(7, 3000), 5, 30)]
    return list(enumerate(" ".join(t) for t in texts))


@pytest.mark.parametrize("words, percent", [(5, 80), (2, 80), (3, 55), (5, 100)])
@pytest.mark.parametrize("frequent, block", [(64, 512), (3, 8)])
def test_against_all_pairs(spark, monkeypatch, words, percent, frequent, block):
    """Small limits make most n-grams frequent and cut trees into blocks of a few rows."""
    monkeypatch.setattr(trees, "FREQUENT", frequent)
    monkeypatch.setattr(trees, "MOST_FREQUENT", 200 if block == 8 else 100_000)
    monkeypatch.setattr(trees, "COUNTED", 500 if block == 8 else 1 << 20)
    monkeypatch.setattr(trees, "BLOCK", block)
    monkeypatch.setattr(trees, "FAN", 2 if block == 8 else 8)
    rows = made_rows()
    assert found(spark, rows, words=words, percent=percent) == all_pairs(rows, words, percent)


def test_edge_rows(spark):
    base = " ".join(prose(1, 60))
    rows = [(1, base), (2, base.upper()), (2, " ".join(prose(2, 60))), (3, " ".join(prose(2, 60))), (4, None), (5, ""), (6, " \n\t"), (7, "one"), (8, "ONE"),
            (None, base), (None, None), (None, "only this"), (1, base), (9, "..."), (9, "...")]
    assert found(spark, rows) == all_pairs(rows, 5, 80)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_percent_is_checked(spark):
    with pytest.raises(ValueError, match="from 1 to 100"):
        found(spark, [], percent=0)


def test_wide_bitmaps_bound_what_sets_share():
    draw = np.random.default_rng(8)
    for n, m, shared in [(3, 3, 3), (10, 12, 9), (100, 90, 50), (500, 300, 280), (1025, 1024, 1000), (40, 400, 0)]:
        every = draw.integers(0, 2**64, n + m - shared, dtype=np.uint64)
        x, y = every[:n], every[n - shared :]
        assert len(y) == m
        most = trees.most_shared(trees.wide_bitmap(x), trees.wide_bitmap(y), n, m)
        assert shared <= most <= min(n, m)
        if max(n, m) < 2 * min(n, m):
            assert most <= shared + 0.3 * min(n, m) + 2
        assert most == trees.most_shared(trees.wide_bitmap(y), trees.wide_bitmap(x), m, n)


def test_traversal_finds_what_bounds_allow():
    """Every pair of one tree, or of its two sides, whose rows pass the bound comes out once."""
    draw = np.random.default_rng(3)
    count = 300
    bits = draw.integers(0, 2**63, (count, trees.WORDS), dtype=np.uint64) & draw.integers(0, 2**63, (count, trees.WORDS), dtype=np.uint64)
    bits[40:80] = bits[40]
    n = np.sort(np.bitwise_count(bits).sum(axis=1) + draw.integers(0, 20, count)).astype(np.int64)
    tree, label = np.sort(draw.integers(0, 9, count)), draw.integers(0, 40, count)
    side = np.zeros(count, np.int64)
    for own in (2, 5):
        rows = np.flatnonzero(tree == own)
        side[rows[len(rows) // 2 :]] = 1
    rows = trees.Level(n, n, label, label, n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64), bits)
    x, y = trees.dual_traversal(tree, side, rows, 80)
    got = sorted((min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist()))
    pairs = [(a, b) for a in range(count) for b in range(a + 1, count) if tree[a] == tree[b] and (tree[a] not in (2, 5) or side[a] != side[b])]
    a, b = np.array(pairs).T
    want = np.array(pairs)[rows.possible(a, b, 80)].tolist()
    assert want and got == [tuple(p) for p in want]


def test_a_pair_is_made_in_the_first_tree_that_both_rows_name():
    """Two rows in ten trees, each tree in a task of its own: one pair in all; without a tree in common among those
    named, one for each tree; none where the larger bitmaps tell the sets apart."""
    import pandas as pd

    draw = np.random.default_rng(3)
    one = np.unique(draw.integers(0, 2**63, 300, dtype=np.int64)).astype(np.uint64)
    near = np.concatenate([one[:-10], np.unique(draw.integers(0, 2**63, 10, dtype=np.int64)).astype(np.uint64)])
    far = np.concatenate([one[:190], np.unique(draw.integers(0, 2**63, 110, dtype=np.int64)).astype(np.uint64)])

    def pairs(other, named):
        made = 0
        for gram in range(10):
            rows = [(gram, 0, 0, 0, k, k, len(s), trees.bitmap(s), trees.folded(trees.wide_bitmap(s), trees.CARRIED_BITS), names)
                    for k, (s, names) in enumerate(zip((one, other), named))]
            frame = pd.DataFrame(rows, columns=["gram", "one", "two", "side", "node", "label", "n", "bits", "wide", "named"])
            made += len(trees.pairs_of(frame, 80))
        return made

    first = list(range(trees.CARRIED_TREES))
    assert pairs(near, (first, first)) == 1
    assert pairs(near, ([0, 1], [2, 3])) == 10
    assert pairs(near, ([], [])) == 10
    assert pairs(far, ([], [])) == 0
