"""Text expressions: tokens, query cleaning, highlighting, sentences."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Characters a search query may keep, and the markup around a hit.
QUERY_NOISE = "[^a-zA-Z0-9 ]"
HIGHLIGHT_OPEN = '<div style="background-color: yellow; display: inline;">'
HIGHLIGHT_CLOSE = "</div>"
# Letters and digits of every script, so that accented words stay whole.
WORD_BREAK = r"[^\p{L}\p{N}]+"
SENTENCE = r"([^.!?]+[.!?]*)"

# Words of some texts that are counted at once, about; one text is counted whole.
WORDS_AT_ONCE = 1_000_000

# Private-use characters standing for the markup while the text around it is escaped.
_OPEN, _CLOSE = "\ue000", "\ue001"


def tokens(text: Column, min_chars: int = 1, below_bytes: int | None = None) -> Column:
    """Lower-cased words of ``text`` in order; with ``below_bytes``, only those shorter than that many bytes."""
    every = F.split(F.lower(text), WORD_BREAK)
    words = F.array_remove(every, "") if min_chars == 1 else F.filter(every, lambda w: F.length(w) >= min_chars)
    return words if below_bytes is None else F.filter(words, lambda w: F.octet_length(w) < below_bytes)


_RUNS = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType())]))


@F.arrow_udf(_RUNS)
def _counted(words: pa.Array) -> pa.Array:
    """The distinct words of each list in order, with their counts; some lists at a time."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
    cuts = np.flatnonzero(np.diff(ends // WORDS_AT_ONCE)) + 1
    return pa.concat_arrays([_counted_part(words.slice(low, high - low)) for low, high in zip([0, *cuts], [*cuts, len(words)])])


def _counted_part(words: pa.Array) -> pa.Array:
    coded = pc.list_flatten(words).dictionary_encode()
    names, order = coded.dictionary, pc.sort_indices(coded.dictionary)
    place = np.empty(len(names), np.int64)
    place[order.to_numpy()] = np.arange(len(names))
    row, wide = pc.list_parent_indices(words).to_numpy().astype(np.int64), max(1, len(names))
    found, count = np.unique(row * wide + place[coded.indices.to_numpy()], return_counts=True)
    row, place = np.divmod(found, wide)
    ends = np.searchsorted(row, np.arange(len(words) + 1)).astype(np.int32)
    values = pa.StructArray.from_arrays([names.take(order.take(pa.array(place))), pa.array(count.astype(np.int32))], names=["term", "tf"])
    missing = np.append(pc.is_null(words).to_numpy(zero_copy_only=False), False)
    return pa.ListArray.from_arrays(pa.array(ends, mask=missing) if missing.any() else pa.array(ends), values)


def with_term_runs(df: DataFrame, token_column: str, out: str = "_runs") -> DataFrame:
    """``df`` with its distinct tokens and their counts as ``array<struct<term, tf>>``, to be written; ``term_counts`` makes rows of them at once."""
    return df.withColumn(out, _counted.asNondeterministic()(token_column))


def term_counts(df: DataFrame, token_column: str, keep: list[str]) -> DataFrame:
    """One row per row of ``df`` and distinct token: ``keep``, ``term``, ``tf``.

    Each token list is counted inside its own row, so no rows move between tasks.
    """
    rows = with_term_runs(df.select(*keep, F.col(token_column).alias("_words")), "_words")
    return rows.select(*keep, F.explode("_runs").alias("_run")).select(*keep, "_run.term", "_run.tf")


def term_positions(df: DataFrame, token_column: str, keep: list[str]) -> DataFrame:
    """As ``term_counts``, with the sorted positions (from 0) of the term instead of their number."""
    size = F.size("_sorted")
    placed = F.transform(token_column, lambda t, i: F.struct(t.alias("term"), i.alias("at")))
    starts = F.filter(
        F.sequence(F.lit(1), F.greatest(size, F.lit(1))),
        lambda i: (i <= size)
        & ((i == 1) | (F.element_at("_sorted", i)["term"] != F.get("_sorted", i - 2)["term"])),
    )
    runs = F.transform(
        "_starts",
        lambda start, i: F.struct(
            F.element_at("_sorted", start)["term"].alias("term"),
            F.slice("_sorted", start, F.coalesce(F.get("_starts", i + 1), size + 1) - start)["at"].alias("positions"),
        ),
    )
    return (
        df.select(*keep, F.sort_array(placed).alias("_sorted"))
        .withColumn("_starts", starts)
        .select(*keep, F.explode(runs).alias("_run"))
        .select(*keep, "_run.term", "_run.positions")
    )


def clean_query(text: Column) -> Column:
    return F.regexp_replace(text, QUERY_NOISE, "")


def highlight(text: Column, query: str, escape_html: bool = False) -> Column:
    """Every word of ``query`` found in ``text``, any case, wrapped in the markup.

    One pass over the original text, longest word first, so inserted markup is never matched again.
    ``escape_html`` escapes the text itself.
    """
    words = sorted(dict.fromkeys(query.split()), key=lambda w: (-len(w), w))
    opening, closing = (_OPEN, _CLOSE) if escape_html else (HIGHLIGHT_OPEN, HIGHLIGHT_CLOSE)
    marked = text
    if words:
        pattern = "(?iu)(" + "|".join(_quote(w) for w in words) + ")"
        marked = F.regexp_replace(text, pattern, f"{opening}$1{closing}")
    if not escape_html:
        return marked
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"),
                           (_OPEN, HIGHLIGHT_OPEN), (_CLOSE, HIGHLIGHT_CLOSE)):
        marked = F.replace(marked, F.lit(plain), F.lit(escaped))
    return marked


def _quote(word: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", word)


def sentences(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep``, the sentence's number in its text (from 0) and the sentence."""
    parts = F.filter(
        F.transform(F.regexp_extract_all(F.col(text), F.lit(SENTENCE), 0), lambda s: F.trim(s)), lambda s: s != ""
    )
    return df.select(*keep, F.posexplode(parts).alias("position", "sentence"))
