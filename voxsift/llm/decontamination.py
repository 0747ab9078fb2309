"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The words of a text stream through the automaton, which holds at each word the longest run of words ending there
that occurs in some item. A run as long as the window (or a whole item, if that is shorter) makes its words hit.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from voxsift.llm.common import long_rows, sent
from voxsift.llm.textbytes import ALNUM, byte_array, word_bounds, word_hashes
from voxsift.staging import stage

WINDOW = 13
#: A text is contaminated when at least one word in this many is hit.
ONE_WORD_IN = 20
#: Most words of the items in one automaton, which is broadcast; more items go in further passes.
BLOCK_WORDS = 200_000

FOUND = "n_words long, hits array<struct<start:long,end:long>>, items array<string>, longest long"


def normal_words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word: A-Z lower-cased, other ASCII than letters and digits separates."""
    codes = byte_array(text.encode().translate(ALNUM))
    starts, ends = word_bounds(codes)
    return word_hashes(codes, starts, ends), starts, ends


class Automaton:
    """Generalised suffix automaton of word sequences, with the items in which each state's runs occur."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.window = window
        self.length, self.link, self.step = [0], [-1], [{}]
        sequences = []
        for name, text in sorted(set(items)):
            words = normal_words(text)[0]
            if len(words):
                sequences.append((name, words))
        vocabulary = [w for _, w in sequences]
        self.vocabulary = np.unique(np.concatenate(vocabulary)) if vocabulary else np.empty(0, np.uint64)
        sequences = [(name, np.searchsorted(self.vocabulary, w).tolist()) for name, w in sequences]
        for _, words in sequences:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self.least = min((min(len(w), window) for _, w in sequences), default=window)
        self._name(sequences)

    def _extend(self, last: int, word: int) -> int:
        step, link, length = self.step, self.link, self.length
        if word in step[last]:
            return self._split(last, word)
        new = len(length)
        length.append(length[last] + 1)
        step.append({})
        link.append(0)
        at = last
        while at != -1 and word not in step[at]:
            step[at][word] = new
            at = link[at]
        link[new] = 0 if at == -1 else self._split(at, word)
        return new

    def _split(self, at: int, word: int) -> int:
        """The state of the run that ``word`` makes of the longest run of ``at``; a clone where needed."""
        step, link, length = self.step, self.link, self.length
        to = step[at][word]
        if length[to] == length[at] + 1:
            return to
        clone = len(length)
        length.append(length[at] + 1)
        step.append(dict(step[to]))
        link.append(link[to])
        link[to] = clone
        while at != -1 and step[at].get(word) == to:
            step[at][word] = clone
            at = link[at]
        return clone

    def _name(self, sequences) -> None:
        """Items of each state holding a whole window, and short items ending at each state."""
        length, link, window = self.length, self.link, self.window
        order = sorted(range(1, len(length)), key=length.__getitem__)
        self.top = [-1] * len(length)  # the state of the last `window` words
        for state in order:
            above = link[state]
            self.top[state] = self.top[above] if length[above] >= window else state if length[state] >= window else -1
        self.items: list[list[str]] = [[] for _ in length]
        own: list[list[tuple[int, str]]] = [[] for _ in length]
        for name, words in sequences:
            state = 0
            for word in words:
                state = self.step[state][word]
                top = self.top[state]
                if top >= 0 and (not self.items[top] or self.items[top][-1] != name):
                    self.items[top].append(name)
            if len(words) < window:
                own[state].append((len(words), name))
        self.short: list[list[tuple[int, str]]] = [[] for _ in length]
        for state in order:
            self.short[state] = own[state] + self.short[link[state]]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[str], int]:
        """Number of words, merged spans of hit words, the items that occur, and the longest run shared."""
        if not text:
            return 0, [], [], 0
        hashes = normal_words(text)[0]
        if not len(hashes) or not len(self.vocabulary):
            return len(hashes), [], [], 0
        ids = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = np.concatenate(([False], self.vocabulary[ids] == hashes, [False]))
        edges = np.flatnonzero(known[1:] != known[:-1])
        spans, items, longest = [], set(), 0
        for first, end in zip(edges[::2], edges[1::2]):
            if end - first >= self.least:  # a run of words of which each is in some item
                longest = max(longest, self._run(ids[first:end].tolist(), int(first), spans, items))
        return len(hashes), merged(spans), sorted(items), longest

    def _run(self, words: list[int], first: int, spans: list, items: set) -> int:
        length, link, step, window = self.length, self.link, self.step, self.window
        state = matched = longest = 0
        for at, word in enumerate(words, first + 1):
            while word not in step[state] and state:
                state = link[state]
                matched = length[state]
            if word in step[state]:
                state = step[state][word]
                matched += 1
            longest = max(longest, matched)
            if matched >= window:
                spans.append((at - window, at))
                items.update(self.items[self.top[state]])
            for size, name in self.short[state]:
                if size <= matched:
                    spans.append((at - size, at))
                    items.add(name)
        return longest


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without these words and what stands between them."""
    _, starts, ends = normal_words(text)
    data, out, at = text.encode(), [], 0
    for start, end in spans:
        out.append(data[at : starts[start]])
        at = ends[end - 1]
    return b"".join([*out, data[at:]]).decode()


def item_blocks(items: DataFrame, key: str, text: str) -> list[DataFrame]:
    """Items in parts whose words fit in one automaton; an item is never divided."""
    rows = items.select(F.col(key).cast("string").alias("name"), F.col(text).alias("body")).where("name is not null and body is not null")
    words = rows.agg(F.sum(F.regexp_count("body", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")))).first()[0] or 0
    parts = math.ceil(words / BLOCK_WORDS) or 1
    part = F.pmod(F.xxhash64("name", "body"), F.lit(parts))
    return [rows.where(part == n) for n in range(parts)] if parts > 1 else [rows]


def find_contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Adds ``n_words``, ``hits`` (spans of hit words, end exclusive), ``items`` (sorted as strings), ``longest``,
    ``n_hit`` and ``contaminated``.

    Null and empty texts have no words and are clean. Items without id, text or words are left out; an id with
    several texts counts once if any of them occurs. Each text is judged on its own, whole; columns of these names
    are replaced. Items are read to the driver in blocks of at most BLOCK_WORDS words; beyond one block the rows
    are staged between passes.
    """
    long_rows(docs.sparkSession)
    names = [part.split()[0] for part in ("n_words long", "hits array", "items array", "longest long")]
    rows = docs.drop(*names, "n_hit", "contaminated")
    kept = [F.col(f"`{c}`") for c in rows.columns]
    blocks = item_blocks(items, item_key, item_text)
    for n, block in enumerate(blocks):
        automaton = Automaton([(r["name"], r["body"]) for r in block.collect()], window)
        shared = sent(docs.sparkSession, automaton)

        @pandas_udf(FOUND)
        def scan(texts: pd.Series) -> pd.DataFrame:
            automaton = shared()
            return pd.DataFrame([automaton.scan(t) for t in texts], columns=names)

        if n == 0:
            rows = rows.withColumn("_found", scan(F.col(text))).select(*kept, "_found.*")
        else:
            more = F.col("_found")
            rows = stage(rows, "decontamination").withColumn("_found", scan(F.col(text))).select(
                *kept, "n_words", F.concat("hits", more["hits"]).alias("hits"),
                F.array_sort(F.array_union("items", more["items"])).alias("items"),
                F.greatest("longest", more["longest"]).alias("longest"),
            )
    if len(blocks) > 1:

        @pandas_udf("array<struct<start:long,end:long>>")
        def join_spans(hits: pd.Series) -> pd.Series:
            return pd.Series([merged([(h["start"], h["end"]) for h in own]) for own in hits])

        rows = rows.withColumn("hits", join_spans("hits"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    rows = rows.withColumn("n_hit", n_hit)
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * ONE_WORD_IN >= F.col("n_words")))


def remove_contamination(docs: DataFrame, items: DataFrame, text: str = "text", spans_from: int | None = None, **options) -> DataFrame:
    """Documents that are not contaminated, with the columns they had.

    With ``spans_from``, hit spans of at least so many words are also cut out of the documents that stay.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    found = find_contamination(docs.withColumn("_row", F.struct(*columns)).select("_row", F.col(f"`{text}`").alias("_text")), items, "_text", **options)
    clean = found.where(~F.col("contaminated"))
    if spans_from is None:
        return clean.select("_row.*")

    @pandas_udf("string")
    def cut(texts: pd.Series, hits: pd.Series) -> pd.Series:
        long = [[(h["start"], h["end"]) for h in own if h["end"] - h["start"] >= spans_from] for own in hits]
        return pd.Series([without_spans(t, own) if own else t for t, own in zip(texts, long)])

    shorter = F.when(F.size("hits") > 0, cut("_text", "hits")).otherwise(F.col("_text"))
    return clean.select(*[shorter.alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns])
