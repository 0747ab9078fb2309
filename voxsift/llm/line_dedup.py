"""Deletes later copies of long repeated runs of sentences and lines, found by the hashes of the shortest runs that are long enough.

A text is a sequence of units: its sentences, cut at line ends too, or its lines if asked for. Every repeated run is
covered by repeated *least runs*: from each unit on, and up to each unit, the fewest units with enough words. Least
runs are made only around units that can betray a copy: every stretch with enough words holds an *anchor*, a unit
that no other of the stretch outranks by words, then by hash, so both copies of a run share one. Anchors are about a
third of all units; they alone are shuffled and counted before anything else is. Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxsift.staging import stage

#: Where units end; joined again, units give the text.
LINE_END = r"(?<=\n)"
SENTENCE_END = r"(?<=\n)|(?<=[.!?] )"
#: What else than a line's end ends a unit, where plain strings say it.
PLAIN_ENDS = {LINE_END: (), SENTENCE_END: (". ", "! ", "? ")}
#: Words that a repeated run must have.
MIN_WORDS = 40
#: Units on either side that are looked at to tell an anchor; where these do not decide, the unit is one.
NEAR = 6

DOC = ["doc", "copy"]


def pieces_of(text: Column, unit_end: str) -> Column:
    return F.split(text, unit_end)


def solid(piece: Column) -> Column:
    """Whether a piece has a word."""
    return piece.rlike(r"[^\x20\x09-\x0D]")


def body_of(piece: Column) -> Column:
    """A piece without white space at its ends, each white space in it a space."""
    ends = F.btrim(piece, F.lit(" \t\n\x0b\x0c\r"))
    inside = ends.contains("\t") | ends.contains("\n") | ends.contains("\x0b") | ends.contains("\x0c") | ends.contains("\r")
    return F.when(inside, F.regexp_replace(ends, r"[\t-\r]", " ")).otherwise(ends)


def bodies_of(text: Column, unit_end: str) -> Column:
    """The bodies of a text's pieces, one for each. Known ends become line ends, at which a text is cut without a pattern."""
    if unit_end not in PLAIN_ENDS:
        return F.transform(pieces_of(text, unit_end), body_of)
    for end in PLAIN_ENDS[unit_end]:
        text = F.replace(text, F.lit(end), F.lit(end[:-1] + "\n"))
    for white in "\t\x0b\x0c\r":
        text = F.replace(text, F.lit(white), F.lit(" "))
    return F.transform(F.split(text, "\n"), lambda body: F.trim(body))


def words_of(body: Column) -> Column:
    spaces = F.octet_length(body) - F.octet_length(F.replace(body, F.lit(" "), F.lit("")))
    return F.when(body.contains("  "), F.size(F.split(body, " +"))).otherwise(spaces + 1)


def units_of(docs: DataFrame, unit_end: str) -> DataFrame:
    """``doc, copy, n_pieces, at, unit, words``: the number of all units; of those with a word their places among all, hashes and numbers of words.

    ``copy`` is a hash of the text, so rows that share a key but not the text stay apart.
    """
    bodies = docs.select(*DOC, bodies_of(F.col("text"), unit_end).alias("bodies"))

    def of_units(value: Callable[[Column, Column], Column]) -> Column:
        return F.filter(F.transform("bodies", lambda body, at: F.when(body != "", value(body, at))), lambda x: x.isNotNull())

    unit, words = of_units(lambda body, at: F.xxhash64(body)), of_units(lambda body, at: words_of(body))
    return bodies.select(*DOC, F.size("bodies").alias("n_pieces"), of_units(lambda body, at: at).alias("at"), unit.alias("unit"), words.alias("words"))


def exploded(rows: DataFrame, structs: Column) -> DataFrame:
    """``doc, copy`` and the fields of each struct. A plain ``explode`` is given a filter for empty arrays, which makes the array again."""
    return rows.select(*DOC, F.explode_outer(structs).alias("x")).where("x is not null").select(*DOC, "x.*")


def score(unit: Column, words: Column) -> Column:
    return F.shiftleft(F.least(words, F.lit(32767)).cast("long"), 48) + unit.bitwiseAND(F.lit(2**48 - 1))


def with_anchors(units: DataFrame, min_words: int) -> DataFrame:
    """``units`` and ``tops``, the places of units that outrank or equal a stretch around them with enough words."""

    def side(at: Column, own: Column, step: int) -> Column:
        """Words of the neighbours on one side up to the first that outranks the unit."""
        words = F.lit(min_words).cast("long")
        for k in range(NEAR, 0, -1):
            other = F.get("scores", at + k * step)
            words = F.when(other <= own, F.shiftright(other, 48) + words).otherwise(F.lit(0).cast("long"))
        return words

    def stands_out(own: Column, at: Column) -> Column:
        return F.shiftright(own, 48) + side(at, own, -1) + side(at, own, 1) >= min(min_words, 32767)

    rows = units.select("*", F.zip_with("unit", "words", score).alias("scores"))
    tops = F.filter(F.transform("scores", lambda own, at: F.when(stands_out(own, at), at)), lambda at: at.isNotNull())
    return rows.select(*units.columns, tops.alias("tops"))


def anchors(units: DataFrame) -> DataFrame:
    """``doc, copy, pos, score`` of each anchor."""
    return exploded(units, F.transform("tops", lambda at: F.struct(at.alias("pos"), score(F.get("unit", at), F.get("words", at)).alias("score"))))


def least_runs(units: DataFrame, min_words: int) -> DataFrame:
    """``doc, copy, start, length, first_at, last_at, head, run``: the least runs that hold one of the units ``marks``,
    with the hashes of their first unit and of all their units in order.

    A list of each word's unit tells where a run ends without adding up words for each.
    """
    min_words = max(min_words, 1)
    some_words = F.transform("words", lambda w, at: F.array_repeat(at, F.least(w, F.lit(min_words))))
    rows = units.select(*DOC, "at", "unit", F.array_sort("marks").alias("marks"), F.flatten(some_words).alias("owner"))
    begun = F.filter(F.transform("owner", lambda o, k: F.when((k == 0) | (o != F.get("owner", k - 1)), k)), lambda k: k.isNotNull())
    rows = rows.select("*", F.concat(begun, F.array(F.size("owner"))).alias("begun"))

    def last_from(at: Column) -> Column:
        """The last unit of the least run from a unit on, null if the words are too few."""
        return F.get("owner", F.get("begun", at) + (min_words - 1))

    def first_to(at: Column) -> Column:
        return F.get("owner", F.get("begun", at + 1) - min_words)

    def code(start: Column, length: Column) -> Column:
        return F.shiftleft(start.cast("long"), 32) + length

    def begins(mark: Column, k: Column) -> Column:
        """First units of least runs that hold a mark and none before it: less than enough words lie between."""
        return F.sequence(F.greatest(first_to(mark - 1) + 1, F.get("marks", k - 1) + 1, F.lit(0)), mark)

    def ends(mark: Column, k: Column) -> Column:
        return F.sequence(mark, F.least(last_from(mark + 1) - 1, F.get("marks", k + 1) - 1, F.size("unit") - 1))

    rows = rows.select("*", F.flatten(F.transform("marks", begins)).alias("begins"), F.flatten(F.transform("marks", ends)).alias("ends"))
    onward = F.transform("begins", lambda i: code(i, last_from(i) - i + 1))
    back = F.transform("ends", lambda j: code(first_to(j), j - first_to(j) + 1))
    codes = F.filter(F.array_distinct(F.concat(onward, back)), lambda code: code.isNotNull())
    rows = rows.select(*DOC, "at", "unit", codes.alias("codes"))

    def run(code: Column) -> Column:
        start, length = F.shiftright(code, 32).cast("int"), code.bitwiseAND(F.lit(2**32 - 1)).cast("int")
        held = F.transform(F.sequence(start, start + length - 1), lambda k: F.get("unit", k))
        return F.struct(
            start.alias("start"), length.alias("length"), F.get("at", start).alias("first_at"), F.get("at", start + length - 1).alias("last_at"),
            F.get("unit", start).alias("head"), F.xxhash64(held).alias("run"),
        )

    return exploded(rows, F.transform("codes", run))


def later_copies(docs: DataFrame, min_words: int, unit_end: str) -> DataFrame:
    """``doc, copy, n_pieces, gone`` of each text: stretches from one place to another in which all units are to be deleted, null if none."""
    units = stage(with_anchors(units_of(docs, unit_end), min_words), "units")
    marked = anchors(units)
    again = marked.groupBy("score").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("score")
    marks = marked.join(again, "score").groupBy(*DOC).agg(F.collect_set("pos").alias("marks"))
    runs = stage(least_runs(units.join(marks, DOC), min_words), "runs")
    place = F.struct("doc", "copy", "start")
    kind = ["length", "head", "run"]
    kinds = runs.groupBy(*kind).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copies = runs.join(kinds, kind).where(place != F.col("first"))
    along = Window.partitionBy(*DOC).orderBy("first_at")
    apart = F.col("first_at") > F.coalesce(F.max("last_at").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    part = F.sum(F.col("apart").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = copies.repartition(*DOC).groupBy(*DOC, "first_at").agg(F.max("last_at").alias("last_at"))
    merged = ends.withColumn("apart", apart).withColumn("part", part).groupBy(*DOC, "part")
    stretch = merged.agg(F.min("first_at").alias("a"), F.max("last_at").alias("b"))
    gone = stretch.groupBy(*DOC).agg(F.collect_list(F.struct("a", "b")).alias("gone"))
    return units.select(*DOC, "n_pieces").dropDuplicates(DOC).join(gone, DOC, "left")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, unit_end: str = SENTENCE_END) -> DataFrame:
    """``docs`` with later copies deleted from ``text``, plus ``n_units`` and ``deleted`` (places of deleted units).

    A run of consecutive units with at least ``min_words`` words that equals one before it (in order of ``key``, a
    number, then of a hash of the text, then of place) is deleted; its first copy stays. Units are compared without
    white space at their ends, and units without a word are passed over. Copies may lie in one text and overlap, so of
    a unit repeated in a row the first stays. Rows with a null key come last. Rows equal in key and text are one document:
    nothing is deleted from one because of the other, and both get the same text. Null texts stay null, with no unit. Columns
    named ``n_units`` and ``deleted`` are replaced; others stay.
    """
    last = F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1))
    keyed = docs.withColumn("_doc", last).withColumn("_copy", F.xxhash64(F.col(text)))
    plain = keyed.where(F.col(text).isNotNull()).select(F.col("_doc").alias("doc"), F.col("_copy").alias("copy"), F.col(text).alias("text"))
    found = stage(later_copies(plain, min_words, unit_end).select(F.col("doc").alias("_doc"), F.col("copy").alias("_copy"), "n_pieces", "gone"), "deleted")
    rows = keyed.join(found.hint("merge"), ["_doc", "_copy"], "left")  # as long as the texts: not to be broadcast
    cut = F.struct("gone", pieces_of(F.col(text), unit_end).alias("pieces"))
    rows = rows.withColumn("gone", F.when(F.col("gone").isNotNull(), cut))

    def goes(piece: Column, at: Column) -> Column:
        return F.exists("gone.gone", lambda g: (g["a"] <= at) & (at <= g["b"])) & solid(piece)

    rest = F.array_join(F.filter("gone.pieces", lambda piece, at: ~goes(piece, at)), "")
    places = F.filter(F.transform("gone.pieces", lambda piece, at: F.when(goes(piece, at), at)), lambda at: at.isNotNull())
    body = F.when(F.col("gone").isNull(), F.col(text)).otherwise(rest)
    out = [body.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c not in ("n_units", "deleted")]
    n_units = F.when(F.col(text).isNull() | (F.col(text) == ""), F.lit(0)).otherwise(F.col("n_pieces"))
    return rows.select(*out, n_units.alias("n_units"), F.when(F.col("gone").isNull(), F.array().cast("array<int>")).otherwise(places).alias("deleted"))
