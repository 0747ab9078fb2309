"""Best-fit packing of documents into bins of a fixed number of tokens, under conflicts.

Bins are ordered by what is left in them, and each carries a bitmap of its duplicate clusters and bitmaps of its
sources. A piece goes to the tightest bin that has room and no conflict: the search starts at the smallest
sufficient rest and goes on to the next larger one until a compatible bin is found.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[^\x20\x09-\x0D]+"
CAPACITY = 2048
#: Most pieces of one source in a bin.
SAME_SOURCE = 2
#: Pieces packed together by one task; more pieces make more shards.
SHARD_PIECES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


class Bins:
    """Open bins by the room left in them.

    ``rooms`` has bit r set if some bin has r tokens left. Bins with the same room, the same clusters and the same
    sources are alike to every piece, so the search looks at each such kind once.
    """

    def __init__(self, capacity: int, same_source: int):
        self.capacity, self.same_source = capacity, same_source
        self.rooms = 0
        self.kinds: dict[int, dict[tuple, list[int]]] = defaultdict(dict)
        self.count = 0

    def place(self, size: int, cluster: int, source: int) -> tuple[int, int]:
        """Number of the bin and first token of the piece in it. ``cluster`` and ``source`` are bitmaps of one bit."""
        rest = self.rooms >> size
        room = size
        while rest:
            skip = (rest & -rest).bit_length() - 1
            room += skip
            for kind in self.kinds[room]:
                if not kind[0] & cluster and not kind[-1] & source:
                    return self._put(room, kind, size, cluster, source)
            rest >>= skip + 1
            room += 1
        self.count += 1
        empty = (0,) * (1 + self.same_source)
        self.kinds[self.capacity].setdefault(empty, []).append(self.count - 1)
        self.rooms |= 1 << self.capacity
        return self._put(self.capacity, empty, size, cluster, source)

    def _put(self, room: int, kind: tuple, size: int, cluster: int, source: int) -> tuple[int, int]:
        number = self.kinds[room][kind].pop()
        if not self.kinds[room][kind]:
            del self.kinds[room][kind]
            if not self.kinds[room]:
                self.rooms &= ~(1 << room)
        layers, bit = [], source
        for layer in kind[1:]:  # the n-th piece of a source sets its bit in the n-th bitmap
            layers.append(layer | bit)
            bit &= layer
        left = room - size
        if left:
            self.kinds[left].setdefault((kind[0] | cluster, *layers), []).append(number)
            self.rooms |= 1 << left
        return number, self.capacity - room


def pack_shard(pieces: pd.DataFrame, capacity: int, same_source: int) -> pd.DataFrame:
    """Longest first; equal lengths in order of the key. Only clusters with two pieces or more need a bit."""
    pieces = pieces.sort_values(["size", "_key", "piece"], ascending=[False, True, True], kind="stable")
    shared = pieces["cluster"].value_counts()
    bit_of = {c: 1 << n for n, c in enumerate(shared.index[shared > 1])}
    source_bit: dict[str, int] = {}
    bins, places = Bins(capacity, same_source), []
    for size, cluster, source in zip(pieces["size"], pieces["cluster"], pieces["source"]):
        bit = source_bit.setdefault(source, 1 << len(source_bit)) if source is not None else 0
        places.append(bins.place(int(size), bit_of.get(cluster, 0), bit))
    out = pieces[["shard", "_key", "piece"]].copy()
    out["bin"], out["first"] = [p[0] for p in places], [p[1] for p in places]
    out["position"] = out.groupby("bin")["first"].rank(method="first").astype("int32") - 1
    return out[["shard", "bin", "position", "first", "_key", "piece"]]


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", size: Column | None = None, cluster: Column | None = None, capacity: int = CAPACITY, same_source: int = SAME_SOURCE) -> DataFrame:
    """One row per piece: ``bin_id``, ``position`` and ``first_token`` in the bin, ``key``, ``piece``,
    ``start_token`` and ``n_tokens`` in the document, and the source.

    ``size`` gives the tokens of a document (its words by default), ``cluster`` its duplicate cluster (equal texts by
    default). A document longer than a bin is divided into full bins and a rest; pieces of a document may share
    no bin with each other or with pieces of its cluster, and a bin holds at most ``same_source`` pieces of a source.
    Null sources never conflict. Null and empty texts have no tokens and no piece. Rows with the same key and text
    are separate copies: each is packed, in an order of their own numbers. Pieces are dealt to shards by a hash of
    the whole row, so neither a hot source nor a large cluster meets in one task; a shard holds about SHARD_PIECES
    pieces at any size of the table.
    """
    tokens = word_count(F.col(text)) if size is None else size
    group = F.xxhash64(F.col(text)) if cluster is None else F.xxhash64(cluster)
    rows = docs.select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"), tokens.cast("long").alias("n"), group.alias("cluster"))
    counted = (F.col("n") + capacity - 1) / capacity
    total = rows.agg(F.sum(F.floor(counted))).first()[0] or 0
    shards = int(total // SHARD_PIECES + 1)
    pieces = (
        rows.where("n > 0")
        .withColumn("piece", F.explode(F.sequence(F.lit(0), (F.floor(counted) - 1).cast("int"))))
        .withColumn("size", F.least(F.lit(capacity), F.col("n") - F.col("piece").cast("long") * capacity))
        .withColumn("_key", F.to_binary(F.sha2(F.to_json(F.struct("id", "source", "n", "cluster")), 256), F.lit("hex")))
    )
    # rows alike in every column differ in nothing that the packing sees, so any order of them gives the same bins
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("_key", "piece"), F.lit(shards)))

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        out = pack_shard(frame, capacity, same_source)
        out = out.join(frame[["id", "source", "size"]])
        out["bin_id"] = out["shard"] * (1 << 32) + out["bin"]
        out["start_token"] = out["piece"].astype("int64") * capacity
        return out.rename(columns={"first": "first_token", "size": "n_tokens"})[names]

    kind = dict(rows.dtypes)["id"]
    names = ["bin_id", "position", "first_token", "id", "piece", "start_token", "n_tokens", "source"]
    schema = f"bin_id long, position int, first_token int, id {kind}, piece int, start_token long, n_tokens long, source string"
    return dealt.groupBy("shard").applyInPandas(packed, schema).withColumnRenamed("id", key)
