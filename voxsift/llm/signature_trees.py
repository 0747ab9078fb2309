"""Exact similarity join of texts on word n-grams by signature trees, one tree per shared n-gram.

Equal sets are one node of the search. Two sets as similar as asked for must share one of the first n-grams of each, in an
order all agree on. A first pass over the texts counts n-grams that occur again within a stretch of rows; those counted most
come last in the order, so common lines and templates bring nobody together unless a text has hardly anything else. A second
pass takes each set's first n-grams. The nodes that share one are the leaves of a tree: rows carry a bitmap of their n-grams
and their size, the nodes above them OR-combined bitmaps and ranges of sizes. A tree is walked against itself from the
root: a pair of nodes is dropped if their sizes cannot fit, if all below them is linked already, or if the most that any
two sets below them can have in common, judged by the bitmaps, is too little. A pair of rows that is left is judged by larger
bitmaps, in the first only of the trees that both rows are in, and what remains is compared on whole sets.

A tree of many rows is cut into blocks; the blocks' bitmaps and ranges are the upper level, compared in Spark, and pairs
of blocks that may hold a link go to tasks of their own. Before that, every row is compared with the first row of its
tree: in a large group of near copies nearly all rows are then linked, and links inside a component are not looked for again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from voxsift.llm.common import long_rows
from voxsift.llm.components import connected, extended, with_labels
from voxsift.llm.textbytes import LOWER, mixed, shingle_set
from voxsift.operators.joins import hot_keys, join_salted, join_small
from voxsift.staging import stage

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80
#: Bits of a bitmap, and 64-bit words of it.
BITS, WORDS = 512, 8
#: Bits of an n-gram's hash by which sets meet; whole sets are compared on all 64.
GRAM_BITS = 48
#: An n-gram counted more often comes last in the order; so many at most, the most frequent ones, are kept for it. What is
#: left out of them costs time and loses nothing, as any order will do.
FREQUENT, MOST_FREQUENT = 64, 100_000
#: Most bits of the larger bitmap that rows carry into their trees, and how many of its trees a row names.
CARRIED_BITS, CARRIED_TREES = 2048, 6
#: N-grams counted together in the first pass.
COUNTED = 1 << 20
#: Rows of a block of a tree, and children of a node.
BLOCK = 512
FAN = 8
#: Pairs of nodes compared at once.
STEP = 1 << 15


def first_many(size: int, percent: int) -> int:
    """How many n-grams of a set of this size can be missing from a similar one, and one more."""
    return size - -(-size * percent // 100) + 1


def bitmap(grams: np.ndarray) -> bytes:
    marked = np.zeros(BITS, bool)
    marked[(mixed(grams) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(marked).tobytes()


def fingerprint(grams: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    place = mixed(grams ^ np.arange(len(grams), dtype=np.uint64))
    return np.array([np.bitwise_xor.reduce(place), place.sum() + np.uint64(len(grams))], np.uint64).tobytes()


def set_of(text: str | None, words: int) -> np.ndarray:
    return shingle_set((text or "").encode().translate(LOWER), words)


def short(grams: np.ndarray) -> np.ndarray:
    """The n-grams as they are ordered and met by; still sorted."""
    return (grams >> np.uint64(64 - GRAM_BITS)).astype(np.int64)


def first_pass(docs: DataFrame, words: int) -> DataFrame:
    """``id, n, print`` per row, and rows of ``grams, counts``: n-grams of several different sets among some
    thousands of rows."""

    def passed(batches):
        sets, held = {}, 0
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"].array, batch["text"]):
                grams = set_of(text, words)
                name = fingerprint(grams) if len(grams) else None
                rows.append((None if pd.isna(key) else int(key), len(grams), name, None, None))
                if name is not None and name not in sets:
                    sets[name] = short(grams)
                    held += len(grams)
                if held >= COUNTED:
                    rows.append(repeated(sets))
                    sets, held = {}, 0
            yield pd.DataFrame(rows, columns=names).astype({"id": "Int64"})
        if sets:
            yield pd.DataFrame([repeated(sets)], columns=names).astype({"id": "Int64"})

    def repeated(sets: dict) -> tuple:
        grams, counts = np.unique(np.concatenate([*sets.values(), np.empty(0, np.int64)]), return_counts=True)
        return (None, -1, None, grams[counts > 1], counts[counts > 1])

    names = ["id", "n", "print", "grams", "counts"]
    return stage(docs.select("id", "text").mapInPandas(passed, "id long, n long, print binary, grams array<long>, counts array<long>"), "first-pass")


def frequent_grams(passed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams in order, and their counts, MOST_FREQUENT at most: those above a power of two from which on
    there are no more."""
    rows = passed.where("n < 0").select(F.explode(F.arrays_zip("grams", "counts")).alias("x"))
    counts = rows.groupBy(F.col("x.grams").alias("gram")).agg(F.sum("x.counts").alias("count")).where(F.col("count") > FREQUENT)
    counts = stage(counts, "frequent")
    bar, held = FREQUENT, 0
    for power, n in sorted(counts.groupBy(F.floor(F.log2("count")).alias("power")).count().collect(), reverse=True):  # a row per power of two
        held += n
        if held > MOST_FREQUENT:
            bar = max(FREQUENT, 2 ** (power + 1) - 1)
            break
    found = np.array([tuple(r) for r in counts.where(F.col("count") > bar).collect()], np.int64).reshape(-1, 2)
    found = found[np.argsort(found[:, 0])]
    return found[:, 0], found[:, 1]


def second_pass(docs: DataFrame, words: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``node, print, least, count, n, copy, bits, wide, usual, last`` of each different set: its smallest id and number of rows,
    the MD5 of one text that has it, and its first n-grams, usual and frequent ones."""
    known, times = (docs.sparkSession.sparkContext.broadcast(x) for x in frequent)  # MOST_FREQUENT numbers each at most

    @pandas_udf("n long, print binary, bits binary, wide binary, usual array<long>, last array<long>")
    def sign(texts: pd.Series) -> pd.DataFrame:
        rows, common, counts = [], known.value, times.value
        marked = np.zeros(1 << 20, bool)  # most n-grams are not frequent, which this tells at once
        marked[common & 0xFFFFF] = True
        none = np.empty(0, np.int64)
        for body in texts:
            whole = set_of(body, words)
            if not len(whole):
                rows.append((0, None, None, None, None, None))
                continue
            grams, many, often = short(whole), first_many(len(whole), percent), none
            may = np.flatnonzero(marked[grams & 0xFFFFF])
            if len(may):
                at = np.minimum(np.searchsorted(common, grams[may]), len(common) - 1)
                found = common[at] == grams[may]
                often, at = may[found], at[found]
            if len(often):
                usual = np.delete(grams, often)
                rest = grams[often][np.lexsort((grams[often], counts[at]))][: max(0, many - len(usual))]
            else:
                usual, rest = grams, none
            rows.append((len(whole), fingerprint(whole), bitmap(whole), wide_bitmap(whole), usual[:many], rest))
        return pd.DataFrame(rows, columns=["n", "print", "bits", "wide", "usual", "last"])

    rows = docs.select("id", F.unhex(F.md5("text")).alias("copy"), sign("text").alias("f")).select("id", "copy", "f.*").where("print is not null")
    grouped = rows.groupBy("print").agg(
        F.min("id").alias("least"), F.count(F.lit(1)).alias("count"), *[F.max(c).alias(c) for c in ("n", "copy", "bits", "wide", "usual", "last")]
    )
    return stage(grouped.withColumn("node", F.monotonically_increasing_id()), "kinds")


def trees(kinds: DataFrame) -> DataFrame:
    """``gram, node`` of the n-grams that are among the first ones of two nodes or more."""
    usual = kinds.select(F.explode("usual").alias("gram"), "node").withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("gram")))
    return stage(usual.where("many > 1").select("gram", "node").union(kinds.select(F.explode("last").alias("gram"), "node")), "trees")


def wide_bitmap(grams: np.ndarray) -> bytes:
    """A bitmap with four bits or more for each n-gram, a power of two of them."""
    bits = 4 << max(4, int(len(grams) - 1).bit_length())
    marked = np.zeros(bits, bool)
    marked[(mixed(grams) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(marked).tobytes()


def folded(bitmap: bytes, most: int) -> bytes:
    """A wide bitmap as it would be with ``most`` bits at most."""
    marked = np.frombuffer(bitmap, np.uint8)
    while 8 * len(marked) > most:
        marked = marked[: len(marked) // 2] | marked[len(marked) // 2 :]
    return marked.tobytes()


def most_shared(x: bytes, y: bytes, n: int, m: int) -> int:
    """The most n-grams that two sets of sizes ``n`` and ``m`` with these wide bitmaps can share."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    spare = min(n - int(np.bitwise_count(a).sum()), m - int(np.bitwise_count(b).sum()))
    while len(a) != len(b):  # the larger one as it would be with half the bits: its unused bits grow
        if len(a) > len(b):
            a, spare = a[: len(a) // 2] | a[len(a) // 2 :], None
        else:
            b, spare = b[: len(b) // 2] | b[len(b) // 2 :], None
    if spare is None:
        spare = min(n - int(np.bitwise_count(a).sum()), m - int(np.bitwise_count(b).sum()))
    return spare + int(np.bitwise_count(a & b).sum())


def whole_sets(docs: DataFrame, kinds: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``node, set`` of the given nodes, from one text of each."""

    @pandas_udf("print binary, set array<long>")
    def made(texts: pd.Series) -> pd.DataFrame:
        sets = [set_of(t, words) for t in texts]
        return pd.DataFrame({"print": [fingerprint(s) if len(s) else None for s in sets], "set": [s.view(np.int64) for s in sets]})

    wanted = stage(kinds.select("node", "print", "copy").join(nodes.distinct(), "node", "left_semi"), "wanted")
    rows = docs.select("text", F.unhex(F.md5("text")).alias("copy"), F.monotonically_increasing_id().alias("at"))
    texts = join_small(rows, wanted.select("copy"), ["copy"], spread=F.col("at"), how="left_semi").dropDuplicates(["copy"])
    found = texts.select(made("text").alias("f")).select("f.*")
    return stage(found.join(wanted.select("node", "print"), "print").select("node", "set"), "sets")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()


def likely(pairs: DataFrame, kinds: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that wide bitmaps allow to be linked, written: whole sets are made and moved only for pairs that
    are similar or nearly so."""

    def test(x: pd.Series, y: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([most_shared(*pair) * (100 + percent) >= (pair[2] + pair[3]) * percent for pair in zip(x, y, n, m)], dtype=bool)

    may = pandas_udf(test, "boolean").asNondeterministic()  # else it is worked out again for the filter
    both = pairs.join(kinds.select(F.col("node").alias("a"), F.col("wide").alias("x"), F.col("n").alias("s")), "a")
    both = both.join(kinds.select(F.col("node").alias("b"), F.col("wide").alias("y"), F.col("n").alias("t")), "b")
    return stage(both.select("a", "b", may("x", "y", "s", "t").alias("may")).where("may").select("a", "b"), "likely")


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose whole sets are similar enough, written."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return stage(both.where(common * (100 + percent) >= (F.size("x") + F.size("y")) * percent).select("a", "b"), "links")


def near_enough(pairs: DataFrame, kinds: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that sizes and bitmaps allow to be linked."""

    def test(x: pd.Series, y: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(bits), np.uint64).reshape(len(n), WORDS) for bits in (x, y))
        n, m = n.to_numpy(np.int64), m.to_numpy(np.int64)
        shared = np.bitwise_count(x & y).sum(axis=1, dtype=np.int64)
        spare = np.minimum(n - np.bitwise_count(x).sum(axis=1, dtype=np.int64), m - np.bitwise_count(y).sum(axis=1, dtype=np.int64))
        return pd.Series((np.minimum(n, m) * 100 >= np.maximum(n, m) * percent) & ((shared + spare) * (100 + percent) >= (n + m) * percent))

    may = pandas_udf(test, "boolean").asNondeterministic()  # else it is worked out again for the filter
    both = pairs.join(kinds.select(F.col("node").alias("a"), F.col("bits").alias("x"), F.col("n").alias("s")), "a")
    both = both.join(kinds.select(F.col("node").alias("b"), F.col("bits").alias("y"), F.col("n").alias("t")), "b")
    return both.select("a", "b", may("x", "y", "s", "t").alias("may")).where("may").select("a", "b")


class Level:
    """Nodes of one level of the trees: sizes, labels, surplus (most n-grams of a set below beyond its bits), bitmaps."""

    def __init__(self, low, high, first, last, surplus, bits):
        self.low, self.high, self.first, self.last, self.surplus, self.bits = low, high, first, last, surplus, bits

    def above(self, starts: np.ndarray) -> Level:
        return Level(
            np.minimum.reduceat(self.low, starts), np.maximum.reduceat(self.high, starts), np.minimum.reduceat(self.first, starts),
            np.maximum.reduceat(self.last, starts), np.maximum.reduceat(self.surplus, starts), np.bitwise_or.reduceat(self.bits, starts, axis=0),
        )

    def possible(self, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        """Pairs of nodes below which there may be a link between two components."""
        out = np.zeros(len(x), bool)
        for at in range(0, len(x), STEP):
            a, b = x[at : at + STEP], y[at : at + STEP]
            apart = (self.first[a] != self.last[a]) | (self.first[b] != self.last[b]) | (self.first[a] != self.first[b])
            fit = (self.high[a] * 100 >= self.low[b] * percent) & (self.high[b] * 100 >= self.low[a] * percent)
            shared = np.bitwise_count(self.bits[a] & self.bits[b]).sum(axis=1, dtype=np.int64)
            most = shared + np.minimum(self.surplus[a], self.surplus[b])
            out[at : at + STEP] = apart & fit & (most * (100 + percent) >= (self.low[a] + self.low[b]) * percent)
        return out


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


def dual_traversal(tree: np.ndarray, side: np.ndarray, rows: Level, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows that may be linked. ``tree`` numbers the trees of the batch in order; the rows of a tree are of
    one side, or of two that are compared with each other."""
    levels, starts, of = [rows], [], tree * 2 + side
    while True:
        fresh = np.append(True, of[1:] != of[:-1])
        begin = np.flatnonzero(fresh)
        if levels[-1] is not rows and len(begin) == len(of):
            break
        place = np.arange(len(of)) - np.repeat(begin, np.diff(np.append(begin, len(of))))
        cut = np.flatnonzero(place % FAN == 0)
        levels.append(levels[-1].above(cut))
        starts.append(np.append(cut, len(of)))
        of = of[cut]
    # the roots: a tree of one side against itself, the two sides of another against each other
    own = of // 2
    two = np.flatnonzero(own[1:] == own[:-1])
    alone = np.setdiff1d(np.arange(len(of)), np.concatenate([two, two + 1]))
    x, y = np.concatenate([alone, two]), np.concatenate([alone, two + 1])
    for level, begin in zip(reversed(levels), [*reversed(starts), None]):
        keep = level.possible(x, y, percent)
        if begin is None:
            keep &= x != y
        x, y = x[keep], y[keep]
        if begin is None or not len(x):
            return x, y
        wide, high = begin[x + 1] - begin[x], begin[y + 1] - begin[y]
        nth, across = spread(np.zeros(len(x), np.int64), wide * high), np.repeat(high, wide * high)
        same = np.repeat(x == y, wide * high)
        x, y = np.repeat(begin[x], wide * high) + nth // across, np.repeat(begin[y], wide * high) + nth % across
        keep = ~same | (x <= y)
        x, y = x[keep], y[keep]
    return x, y


def first_tree(tree: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pairs whose ``tree`` is the first that both rows name; ``x`` and ``y`` hold what they name in order, then -1. Rows name
    their first trees, so one that both name comes before all that only one of them does. Pairs that name none in common are
    kept in all trees."""
    out = np.zeros(len(tree), bool)
    for at in range(0, len(tree), STEP):
        own, a, b = tree[at : at + STEP], x[at : at + STEP], y[at : at + STEP]
        both = np.zeros(a.shape, bool)
        for k in range(b.shape[1]):
            both |= (a == b[:, k : k + 1]) & (a >= 0)
        out[at : at + STEP] = ~both.any(axis=1) | (a[np.arange(len(a)), both.argmax(axis=1)] == own)
    return out


def candidates(batches, percent: int):
    """Pairs ``a < b`` of the trees of a partition, whose rows come in order; a tree's rows may run over batches."""
    left = None
    for batch in batches:
        left = batch if left is None else pd.concat([left, batch], ignore_index=True)
        tree = left[["gram", "one", "two"]].to_numpy()
        ends = np.flatnonzero((tree[1:] != tree[:-1]).any(axis=1)) + 1
        if len(ends) and ends[-1] >= BLOCK:
            yield pairs_of(left.iloc[: ends[-1]], percent)
            left = left.iloc[ends[-1] :].reset_index(drop=True)
    if left is not None and len(left):
        yield pairs_of(left, percent)


def pairs_of(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    keys = frame[["gram", "one", "two"]].to_numpy()
    tree = np.cumsum(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))) - 1
    bits = np.frombuffer(b"".join(frame["bits"]), np.uint64).reshape(len(frame), WORDS)
    n, label, node = (frame[c].to_numpy(np.int64) for c in ("n", "label", "node"))
    rows = Level(n, n, label, label, n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64), bits)
    x, y = dual_traversal(tree, frame["side"].to_numpy(np.int64), rows, percent)
    named = np.full((len(frame), CARRIED_TREES), -1, np.int64)
    for row, trees_of_row in zip(named, frame["named"]):
        row[: len(trees_of_row)] = trees_of_row
    keep = first_tree(keys[x, 0], named[x], named[y])
    x, y = x[keep], y[keep]
    wide = frame["wide"].to_list()
    may = [most_shared(wide[i], wide[j], n[i], n[j]) * (100 + percent) >= (n[i] + n[j]) * percent for i, j in zip(x, y)]
    x, y = x[np.array(may, bool)], y[np.array(may, bool)]
    pairs = np.unique(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])], axis=1), axis=0)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def block_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """``gram, one, two`` with one <= two: pairs of blocks of a tree that may hold a link, judged by their sizes, labels and
    bitmaps. Blocks are of one range of sizes, so that most pairs fall by that."""
    def words(bits):
        return [F.conv(F.hex(F.substring(bits, 1 + 8 * k, 8)), 16, -10).cast("long").alias(f"w{k}") for k in range(WORDS)]

    parts = rows.select("gram", "block", "n", "label", *words(F.col("bits")))
    surplus = F.col("n") - sum((F.bit_count(f"w{k}") for k in range(WORDS)), F.lit(0))
    nodes = parts.groupBy("gram", "block").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.min("label").alias("first"), F.max("label").alias("last"),
        F.max(surplus).alias("surplus"), *[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)],
    )
    nodes = stage(nodes, "blocks")
    x = nodes.select("gram", *[F.col(c).alias(f"x_{c}") for c in nodes.columns[1:]])
    y = nodes.select("gram", *[F.col(c).alias(f"y_{c}") for c in nodes.columns[1:]])
    apart = (F.col("x_first") != F.col("x_last")) | (F.col("y_first") != F.col("y_last")) | (F.col("x_first") != F.col("y_first"))
    fit = (F.col("x_high") * 100 >= F.col("y_low") * percent) & (F.col("y_high") * 100 >= F.col("x_low") * percent)
    shared = sum((F.bit_count(F.col(f"x_w{k}").bitwiseAND(F.col(f"y_w{k}"))) for k in range(WORDS)), F.lit(0))
    most = (shared + F.least("x_surplus", "y_surplus")) * (100 + percent) >= (F.col("x_low") + F.col("y_low")) * percent
    return x.join(y, "gram").where((F.col("x_block") <= F.col("y_block")) & fit & apart & most).select("gram", F.col("x_block").alias("one"), F.col("y_block").alias("two"))


def open_trees(met: DataFrame, labels: DataFrame) -> DataFrame:
    """``gram, node, label, many`` of the trees of three rows or more that are of several components; the two rows of a
    smaller one have been compared already."""
    rows = stage(with_labels(met, labels, "node", "label"), "labelled-trees")
    sizes = rows.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("many"))
    several = stage(sizes.where("low < high and many > 2").select("gram", "many"), "several")
    return join_salted(rows, several, ["gram"], F.col("node"), hot=hot_keys(several, ["gram"], "many"))


def walked(met: DataFrame, labels: DataFrame, kinds: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a < b`` of rows of different components found by walking the trees, each in one tree where the rows name one in
    common."""
    fold = pandas_udf(lambda wide: wide.map(lambda bits: folded(bits, CARRIED_BITS)), "binary")
    rows = stage(open_trees(met, labels), "open")
    named = rows.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("gram")), 1, CARRIED_TREES).alias("named"))
    rows = rows.join(kinds.select("node", "n", "bits", fold("wide").alias("wide")), "node").join(named, "node")
    # the blocks of a large tree: ranges of sizes, each divided by a hash of the row
    band = F.when(F.col("many") <= BLOCK, 0).otherwise(1 + F.floor(F.log(F.col("n").cast("double")) / float(np.log(1.1))))
    rows = stage(rows.withColumn("band", band.cast("long")).drop("many"), "open-trees")
    blocks = rows.groupBy("gram", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    block = F.shiftleft("band", 40) + F.pmod(F.xxhash64("node"), F.col("blocks"))
    rows = rows.join(blocks, ["gram", "band"]).withColumn("block", F.when(F.col("band") == 0, 0).otherwise(block).cast("long")).drop("band", "blocks")
    carried = ["node", "label", "n", "bits", "wide", "named"]
    single = rows.where("block = 0").select("gram", F.lit(0).cast("long").alias("one"), F.lit(0).cast("long").alias("two"), F.lit(0).alias("side"), *carried)
    large = rows.where("block != 0")
    pairs = stage(block_pairs(large, percent), "block-pairs")
    left = large.join(pairs.withColumnRenamed("one", "block"), ["gram", "block"]).select("gram", F.col("block").alias("one"), "two", F.lit(0).alias("side"), *carried)
    right = large.join(pairs.where("one < two").withColumnRenamed("two", "block"), ["gram", "block"]).select("gram", "one", F.col("block").alias("two"), F.lit(1).alias("side"), *carried)
    dealt = single.union(left).union(right).repartition("gram", "one", "two").sortWithinPartitions("gram", "one", "two", "side", "n", "label")
    return stage(dealt.mapInPandas(lambda batches: candidates(batches, percent), "a long, b long").distinct(), "pairs")


def ngram_links(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """``key, n_shingles, component_id`` for every row of ``docs``.

    A-Z are lower-cased; words are divided by ASCII white space. A text's set are its different runs of ``words`` words;
    with fewer, the whole sequence as one; texts that are null, empty or only white space have none and link with
    nothing. Texts are linked if 100 * intersection >= percent * union, for any ``percent`` from 1 to 100, and no link is
    missed; ``component_id`` is the smallest key reachable over links. Rows with equal keys are one document, also if their
    texts differ; rows without a key reach others, or null. Repeated rows and equal sets cost one search. ``key`` is an
    integer; other columns are not looked at. An empty table gives an empty result.
    """
    if not 1 <= percent <= 100:
        raise ValueError(f"percent {percent} is not from 1 to 100")
    long_rows(docs.sparkSession, 400)
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    passed = first_pass(docs, words)
    signed = passed.where("n >= 0").select("id", "n", "print")
    kinds = second_pass(docs, words, percent, frequent_grams(passed))
    met = trees(kinds)

    leaders = stage(met.groupBy("gram").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("many")), "leaders")
    near = join_salted(met, leaders.select("gram", "a"), ["gram"], F.col("node"), hot=hot_keys(leaders, ["gram"], "many"))
    near = stage(near_enough(near.where("node != a").select("a", F.col("node").alias("b")).distinct(), kinds, percent), "near")
    near = likely(near, kinds, percent)
    sets = whole_sets(docs, kinds, ends(near), words)
    labels = connected(similar(near, sets, percent))
    more = likely(walked(met, labels, kinds, percent), kinds, percent)
    sets = sets.union(whole_sets(docs, kinds, ends(more).join(sets.select("node"), "node", "left_anti"), words))
    labels = extended(labels, similar(more, sets, percent))

    hot = hot_keys(kinds, ["print"], "count")
    nodes = kinds.select("print", "node")
    of_row = join_salted(signed.where("print is not null").select("id", "print", "n", F.monotonically_increasing_id().alias("at")), nodes, ["print"], F.col("at"), hot=hot)
    # a key with several texts is one document
    several = of_row.where("id is not null").groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b")
    met_again = of_row.join(several.select("id", "a"), "id").where("node != a").select("a", F.col("node").alias("b")).distinct()
    labels = extended(labels, stage(met_again, "same-key"))

    known = stage(with_labels(kinds.select("print", "node", "least", "count"), labels, "node", "label"), "labelled")
    least = known.groupBy("label").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("n")).where("n > 1")
    known = join_small(known, least.select("label", "component"), ["label"], spread=F.col("node"), how="left")
    found = known.select("print", F.coalesce("component", "least").alias("component"))
    rows = signed.select("id", "n", "print", F.monotonically_increasing_id().alias("at"))
    linked = join_salted(rows.where("print is not null"), found, ["print"], F.col("at"), hot=hot)
    alone = rows.where("print is null").withColumn("component", F.col("id"))
    every = linked.select("id", "n", "component").union(alone.select("id", "n", "component"))
    return every.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
