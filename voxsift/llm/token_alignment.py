"""Alignment of two tokenizers over the same bytes, and how often each pair of token ids is linked across all texts.

The ends of both token sequences are byte offsets. Where tokens stand one to one, the two arrays are equal at a constant
index shift; doubling steps find how far that holds, so such stretches are jumped over. What lies between is an irregular
group, found by moving on whichever side is behind until both end together; the shift changes there.

Texts are worked on in chunks of bounded size. Before a space that follows other text no encoder of the given kinds joins
anything, so a text is a row of segments (mostly words) that are encoded and aligned alike wherever they stand: the
different segments of a chunk are laid end to end and aligned once. A chunk also lists its different id pairs once, so
counts are added up and looked up per chunk and not per occurrence; a pair holds no more rows than there are chunks,
however common it is.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from voxsift.llm.common import long_rows
from voxsift.staging import stage

FOLDER = "/opt/tokenizers"
FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of a chunk of texts; a longer text is a chunk of its own.
CHUNK_CHARS = 3_000_000
#: Groups of more links than this are counted by their different ids instead of link by link.
WIDE = 4096


def byte_alphabet() -> dict[str, int]:
    """Byte of each character in the printable form of byte-level tokens: printable Latin-1 stands for itself, the other
    bytes follow from code point 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(others)}


def first_tokenizer(path: str) -> tuple[object, list[bytes]]:
    """An encoder of the byte-level file and the bytes of each id.

    Where the file's merges make its ids in order, ranks and merges say the same, and the faster encoder over ranks is
    taken, split by the byte-level pattern; any other file goes to the general library.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        raw = file.read()
    data, alphabet = json.loads(raw), byte_alphabet()
    added = {a["content"]: a["id"] for a in data["added_tokens"]}
    vocabulary = {token: n for token, n in data["model"]["vocab"].items() if token not in added}
    table = [b""] * (max([*vocabulary.values(), *added.values()]) + 1)
    for token, n in vocabulary.items():
        table[n] = bytes(alphabet[c] for c in token)
    merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
    ordered = all(vocabulary.get("".join(m)) == 256 + n for n, m in enumerate(merges)) and len(vocabulary) == 256 + len(merges)
    splitter = data["pre_tokenizer"] or {}
    usual = splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space")
    if ordered and usual and not data["normalizer"] and not data["model"].get("ignore_merges"):
        ranks = {table[n]: n for n in vocabulary.values()}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), table
    plain = Tokenizer.from_str(raw)
    plain.encode_special_tokens = True
    return plain, table


#: Fixed value: how byte-level encoders of this kind divide a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def second_tokenizer(path: str) -> tuple[object, list[bytes]]:
    """A processor of the piece file and the bytes of each id."""
    import sentencepiece

    with open(path, "rb") as file:
        pieces = sentencepiece.SentencePieceProcessor(model_proto=file.read())
    names = [pieces.id_to_piece(n) for n in range(pieces.get_piece_size())]
    table = [bytes([int(name[3:5], 16)]) if pieces.is_byte(n) else name.replace("▁", " ").encode() for n, name in enumerate(names)]
    return pieces, table


def irregular_groups(x: list[int], y: list[int]) -> list[tuple[int, int, int, int]]:
    """Groups that are not one token against one, as ``(from, to)`` in either sequence.

    ``x`` and ``y`` are strictly growing ends with the same last value. All other tokens stand one to one.
    """
    i = j = 0
    n, m, found = len(x), len(y), []
    while i < n:
        step = 1
        while step <= n - i and step <= m - j and x[i : i + step] == y[j : j + step]:
            i, j, step = i + step, j + step, step * 2
        while step > 1:  # the stretch ends within the last step
            step //= 2
            if step <= n - i and step <= m - j and x[i : i + step] == y[j : j + step]:
                i, j = i + step, j + step
        if i == n:
            break
        at, other, end, stop = i, j, x[i], y[j]
        while end != stop:
            if end < stop:
                i += 1
                end = x[i]
            else:
                j += 1
                stop = y[j]
        i, j = i + 1, j + 1
        found.append((at, i, other, j))
    return found


def links(a: np.ndarray, b: np.ndarray, groups: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links as index of a first token, code of the id pair (``first id * 2^32 + second id``), and number; a group of one
    token against one, or a small one, has a row per link, a wide one a row per different pair."""
    high = a.astype(np.int64) << 32
    irregular = np.array(groups, np.int64).reshape(-1, 4)
    spans_a, spans_b = irregular[:, 1] - irregular[:, 0], irregular[:, 3] - irregular[:, 2]
    alone_a, alone_b = np.ones(len(a), bool), np.ones(len(b), bool)
    alone_a[spread(irregular[:, 0], spans_a)] = False
    alone_b[spread(irregular[:, 2], spans_b)] = False
    sizes = spans_a * spans_b
    small = sizes <= WIDE
    rows, many = irregular[small], sizes[small]
    nth = spread(np.zeros(len(rows), np.int64), many)
    width = np.repeat(spans_b[small], many)
    left, right = np.repeat(rows[:, 0], many) + nth // width, np.repeat(rows[:, 2], many) + nth % width
    where = [np.flatnonzero(alone_a), left]
    codes = [high[alone_a] + b[alone_b], high[left] + b[right]]
    times = [np.ones(len(where[0]) + len(left), np.int64)]
    for at, to, other, end in irregular[~small]:
        ids, n = np.unique(high[at:to], return_counts=True)
        others, m = np.unique(b[other:end], return_counts=True)
        codes.append((ids[:, None] + others[None, :]).ravel())
        times.append((n[:, None] * m[None, :]).ravel())
        where.append(np.full(len(codes[-1]), at))
    return np.concatenate(where), np.concatenate(codes), np.concatenate(times)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` of each range, one after another."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


def group_texts(a: list[str], b: list[str], groups: list[tuple[int, int, int, int]]) -> tuple[list[str], np.ndarray]:
    """``a1,a2|b1,b2`` of each group in order, and the index of its first token."""
    out, at = [], np.ones(len(a), bool)
    i = j = 0
    for start, to, other, end in [*groups, (len(a), len(a), len(b), len(b))]:
        out += map("|".join, zip(a[i:start], b[j:other]))
        if start < to:
            out.append(f"{','.join(a[start:to])}|{','.join(b[other:end])}")
            at[start + 1 : to] = False
        i, j = to, end
    return out, np.flatnonzero(at)


#: A text, with a space before it, cut before each space that follows something that is neither white space nor the sign
#: that stands for a space in pieces; white space at the end stays with what it follows.
SEGMENT = re.compile(r" [^ ]*(?:(?<=[\s▁]) [^ ]*| +\Z)*")


def separable(first: object, second: object) -> bool:
    """Whether segments may be encoded on their own: the first encoder divides texts by the byte-level pattern, in which
    nothing goes on from other text into a space, and no piece of the second holds a space behind other text."""
    pieces = [second.id_to_piece(n) for n in range(second.get_piece_size())]
    return hasattr(first, "encode_ordinary") and not any("▁" in p.lstrip("▁") for p in pieces)


class Tools:
    """Both encoders with what is needed of their ids; made once per task from what was sent."""

    def __init__(self, first: object, bytes_a: list[bytes], second: object, bytes_b: list[bytes]):
        self.first, self.bytes_a, self.second, self.bytes_b = first, bytes_a, second, bytes_b
        self.size_a, self.size_b = (np.array([len(t) for t in x], np.int64) for x in (bytes_a, bytes_b))
        self.shown = [str(n) for n in range(max(len(bytes_a), len(bytes_b)))]

    def ids(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of a text that begins with the added space."""
        if hasattr(self.first, "encode_ordinary"):
            return self.first.encode_ordinary(text), self.second.encode(text[1:])
        return self.first.encode(text, add_special_tokens=False).ids, self.second.encode(text[1:])

    def encoded(self, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all segments one after another and their numbers per segment, for both encoders, and which segments both
        give back; the others have no ids. Segments are encoded in a row where that changes nothing, else one by one."""
        data = [n.encode() for n in names]
        whole, a, b = np.ones(len(names), bool), [], []
        n_a, n_b = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        for low, high in in_a_row(names):
            x, y = self.ids("".join(names[low:high]))
            own = b"".join(data[low:high])
            if self.gives(x, y, own):
                ends = np.cumsum([len(d) for d in data[low:high]])
                n_a[low:high], n_b[low:high] = per_segment(self.size_a[x], ends), per_segment(self.size_b[y], ends)
                a.append(x)
                b.append(y)
                continue
            for k in range(low, high):
                x, y = self.ids(names[k])
                whole[k] = self.gives(x, y, data[k])
                if whole[k]:
                    n_a[k], n_b[k] = len(x), len(y)
                    a.append(x)
                    b.append(y)
        return np.fromiter(chain.from_iterable(a), np.int64), n_a, np.fromiter(chain.from_iterable(b), np.int64), n_b, whole

    def gives(self, a: list[int], b: list[int], data: bytes) -> bool:
        return b"".join(map(self.bytes_a.__getitem__, a)) == data and b"".join(map(self.bytes_b.__getitem__, b)) == data


#: Characters of segments that are encoded in one call.
ROW_CHARS = 10_000


def in_a_row(names: list[str]):
    """Ranges of segments that may be encoded as one text: all but the last of a range end in something that is neither
    white space nor the sign of a space, so that the next one's space begins anew."""
    low = chars = 0
    for k, own in enumerate(names):
        chars += len(own)
        if own[-1].isspace() or own[-1] == "▁" or chars >= ROW_CHARS:
            yield low, k + 1
            low, chars = k + 1, 0
    if low < len(names):
        yield low, len(names)


def per_segment(sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many tokens of these sizes end within each segment, given the segments' ends."""
    return np.bincount(np.searchsorted(ends, np.cumsum(sizes)), minlength=len(ends))


class Segments:
    """The different segments of a chunk of texts, encoded and aligned.

    Per segment: ``whole`` (both encoders give its bytes back), numbers of tokens ``n_a`` and ``n_b``, of ``groups`` and
    ``links``, its groups as ``text``, and its different pairs with their numbers of links (``slots`` into ``codes``,
    ``times``) from ``starts[k]`` to ``starts[k + 1]``.
    """

    def __init__(self, names: list[str], tools: Tools):
        a, self.n_a, b, self.n_b, self.whole = tools.encoded(names)
        groups = irregular_groups(np.cumsum(tools.size_a[a]).tolist(), np.cumsum(tools.size_b[b]).tolist())
        segment_of = np.repeat(np.arange(len(names)), self.n_a)
        where, codes, times = links(a, b, groups)
        self.codes, slot = np.unique(codes, return_inverse=True)
        own, place = np.unique(segment_of[where] * max(1, len(self.codes)) + slot, return_inverse=True)
        self.times = np.zeros(len(own), np.int64)
        np.add.at(self.times, place, times)
        of, self.slots = np.divmod(own, max(1, len(self.codes)))
        self.starts = np.searchsorted(of, np.arange(len(names) + 1))
        self.links = sums(self.times, self.starts)
        texts, at = group_texts(list(map(tools.shown.__getitem__, a)), list(map(tools.shown.__getitem__, b)), groups)
        firsts = np.searchsorted(segment_of[at], np.arange(len(names) + 1))
        self.groups = np.diff(firsts)
        self.text = [";".join(texts[x:y]) for x, y in zip(firsts, firsts[1:])]

    def rows_with(self, row: np.ndarray, own: np.ndarray) -> np.ndarray:
        """In how many rows each pair is, from the different segments ``own`` of each ``row``, which is sorted."""
        n, out = self.starts[own + 1] - self.starts[own], np.zeros(len(self.codes), np.int64)
        cuts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))[::64] if len(row) else []  # some rows at a time
        for low, high in zip(cuts, [*cuts[1:], len(row)]):
            slots = self.slots[spread(self.starts[own[low:high]], n[low:high])]
            seen = np.unique((np.repeat(row[low:high] - row[low], n[low:high]) << 32) + slots)
            out += np.bincount(seen & 0xFFFFFFFF, minlength=len(out))
        return out


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of ``values`` from each start to the next."""
    before = np.concatenate([[0], np.cumsum(values)])
    return before[starts[1:]] - before[starts[:-1]]


DOC = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, segments array<int>, times array<int>"
#: Of a chunk: its pairs and in how many of its texts each is; its segments' pairs.
CHUNK = "codes array<long>, held array<long>, starts array<int>, slots array<int>, links array<long>"
WRITTEN = pa.schema(
    [("chunk", pa.int64()), ("key", pa.string()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()),
     ("groups", pa.string()), ("segments", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("codes", pa.list_(pa.int64())),
     ("held", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("slots", pa.list_(pa.int32())), ("links", pa.list_(pa.int64()))]
)


def encoded_chunk(number: int, keys: list, texts: list, tools: Tools, apart: bool, with_groups: bool) -> pa.RecordBatch:
    """A row per text, and one of the chunk behind them."""
    cut = [(SEGMENT.findall(" " + t) if apart else [" " + t]) if t else [] for t in texts]
    names = list(dict.fromkeys(chain.from_iterable(cut)))
    index = dict(zip(names, range(len(names))))
    ids = [list(map(index.__getitem__, own)) for own in cut]
    del cut, index
    found = Segments(names, tools)
    sizes = np.array([len(own) for own in ids], np.int64)
    row, every = np.repeat(np.arange(len(keys)), sizes), np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum()))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    good = (sizes > 0) & (sums(found.whole[every], starts) == sizes)
    counts = [np.where(good, sums(x[every], starts), 0).tolist() for x in (found.n_a, found.n_b, found.groups, found.links)]
    shown = [";".join(map(found.text.__getitem__, own)) if ok else "" for own, ok in zip(ids, good)]
    digests = [hashlib.sha256(x.encode()).hexdigest() if ok else "" for x, ok in zip(shown, good)]
    del ids
    of, times = np.unique((row * max(1, len(names)) + every)[good[row]], return_counts=True)
    row, own = np.divmod(of, max(1, len(names)))
    held = found.rows_with(row, own)
    own, times = (np.split(x, np.searchsorted(row, np.arange(1, len(keys)))) for x in (own, times))
    rows = list(zip([number] * len(keys), keys, *counts, digests, shown if with_groups else [""] * len(keys), own, times))
    rows.append((number, *[None] * 9))
    none = [None] * len(keys)
    columns = [*map(list, zip(*rows)), *[[*none, x] for x in (found.codes, held, found.starts, found.slots, found.times)]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, WRITTEN)], schema=WRITTEN)


def align(
    docs: DataFrame, key: str = "doc_id", text: str = "text", first: str = f"{FOLDER}/{FIRST}", second: str = f"{FOLDER}/{SECOND}",
    with_groups: bool = False, chunk_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``docs``.

    Space + text is encoded by the byte-level file ``first``, the text by the piece file ``second``, which adds the space;
    names of special tokens inside a text are plain text. Offsets where tokens of both end cut them into groups; every
    two tokens of a group are linked. The count of an id pair is the number of rows that hold it linked; ``n_best`` counts links
    whose count is the highest of their first id, ties included, ``count_sum`` adds up the counts of all links. Texts
    that are null, empty, or that an encoder does not give back byte by byte have no tokens: zeros and ''. ``with_groups``
    adds the groups themselves as ``a1,a2|b1;a3|b2,b3``. Repeated rows count as often as they stand there, rows with a
    null key too; columns other than ``key`` and ``text`` are not looked at. Whole texts are encoded, however long; an empty table
    gives an empty result. The two files are read by the driver and sent along (a few MB).
    """
    spark = docs.sparkSession
    long_rows(spark)
    tools = (*first_tokenizer(os.fspath(first)), *second_tokenizer(os.fspath(second)))
    apart = separable(tools[0], tools[2])
    sent = spark.sparkContext.broadcast(tools)  # objects of the libraries, some MB

    def encoded(batches):
        tools = Tools(*sent.value)
        number, keys, texts, chars = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for key, body in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                keys.append(key)
                texts.append(body)
                chars += len(body or "") + 1
                if chars >= chunk_chars:
                    yield encoded_chunk(number, keys, texts, tools, apart, with_groups)
                    number, keys, texts, chars = number + 1, [], [], 0
        if keys:
            yield encoded_chunk(number, keys, texts, tools, apart, with_groups)

    # the key goes along as text, so that a null or a large number comes back as it was
    kind = docs.schema[key].dataType
    own = docs.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").alias("text"))
    done = stage(own.mapInArrow(encoded, f"chunk long, key string, {DOC}, {CHUNK}"), "token-chunks")
    lists = done.where("codes is not null").select("chunk", F.posexplode(F.arrays_zip("codes", "held")).alias("slot", "x"))
    lists = lists.select("chunk", "slot", F.col("x.codes").alias("code"), F.col("x.held").alias("held"))
    counts = stage(lists.groupBy("code").agg(F.sum("held").alias("count")), "pair-counts").withColumn("id", F.shiftright("code", 32))
    top = counts.groupBy("id").agg(F.max("count").alias("top"))  # at most one row per id of the first tokenizer
    counts = counts.join(F.broadcast(top), "id").select("code", "count", (F.col("count") == F.col("top")).alias("best"))
    looked_up = lists.select("chunk", "slot", "code").join(counts, "code").select(F.col("chunk").alias("of"), "slot", "count", "best")

    def summed(rows: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("slot")
        count, best = table["count"].to_numpy(np.int64), table["best"].to_numpy(bool)
        last = rows[rows["starts"].notna()].iloc[0]
        starts, slots, times = (np.asarray(last[c], np.int64) for c in ("starts", "slots", "links"))
        total, bests = sums(count[slots] * times, starts), sums(best[slots] * times, starts)
        rows = rows[rows["starts"].isna()]
        of = [(np.asarray(x, np.int64), np.asarray(n, np.int64)) for x, n in zip(rows["segments"], rows["times"])]
        values = {"n_best": [int((bests[x] * n).sum()) for x, n in of], "count_sum": [int((total[x] * n).sum()) for x, n in of]}
        return rows[["key", *kept]].astype({c: "int64" for c in kept if c.startswith("n_")}).assign(**values)

    kept = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if with_groups else [])]
    types = "key string, " + ", ".join(f"{c} {'string' if c.startswith('groups') else 'long'}" for c in kept) + ", n_best long, count_sum long"
    rows = done.select("chunk", "key", *kept, "segments", "times", "starts", "slots", "links")
    result = rows.groupBy("chunk").cogroup(looked_up.groupBy("of")).applyInPandas(summed, types)
    last = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else [])]
    return result.select(F.col("key").cast(kind).alias(key), *last)
