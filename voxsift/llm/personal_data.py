"""Personal data by patterns, and by contexts that are learned from what the patterns find.

Emails, IP addresses, card and phone numbers that match fixed patterns are the seeds. The words to the left of a seed
make a lexical pattern; a graph joins these patterns with the identifiers (tokens with a digit or an at sign) that
follow them. Scores pass over the graph for a few rounds: a pattern is as good as what it finds, an identifier as good as
the patterns that find it. Identifiers that good patterns find and no seed covers are added. Only DataFrame and SQL
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxsift.staging import stage

#: Kinds in their order. The patterns find the same spans, leftmost and without overlap, as the plain ones do
#: ([A-Za-z0-9._%+-]+@... and so on), in time linear in the text: a run of characters is entered at its start only.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no span of the kind; a cheap test before the search.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9](?:[ -]?[0-9]){13}", "phone": r"\+[0-9]"}
IDENTIFIER = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*"
MARK = "\u0001"
#: Pieces of a text whose lengths are summed in one go.
BLOCK = 256
#: Characters to the left of an identifier in which its two context words are looked for.
CONTEXT_CHARS = 80

ROUNDS = 3
#: A pattern counts if it precedes this many identifiers, of which nearly all are of one kind.
LEAST_FOUND = 5
LEAST_SCORE = 0.8

SPAN = "array<struct<start:int,kind:int,end:int,body:string>>"


def matches(text: Column, pattern: str) -> Column:
    """``start, body, left`` of every match: places are code points, ``left`` the text since the match before.

    Matches are put between marks and the text is cut there, so every second piece is a match. Starts are sums of
    lengths, made block by block, so that the work does not grow with the square of the number of matches.
    """
    pieces = F.split(F.regexp_replace(F.translate(text, MARK, "\u0002"), pattern, f"{MARK}$0{MARK}"), MARK)

    def placed(pieces: Column) -> Column:
        lengths = F.transform(pieces, F.char_length)
        blocks = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int"))
        zero = F.lit(0)

        def total(values: Column, start: Column, count: Column) -> Column:
            return F.aggregate(F.slice(values, start + 1, count), zero, lambda a, b: a + b)

        def in_block(lengths: Column, sums: Column, b: Column) -> Column:
            first = b * BLOCK
            inside = F.sequence(first, F.least(first + BLOCK, F.size(lengths)) - 1)
            before = total(sums, zero, b)
            return F.transform(
                F.filter(inside, lambda i: i % 2 == 1),
                lambda i: F.struct(
                    (before + total(lengths, first, i - first)).alias("start"), F.get(pieces, i).alias("body"), F.get(pieces, i - 1).alias("left")
                ),
            )

        whole = F.transform(F.array(lengths), lambda ls: F.struct(ls.alias("ls"), F.transform(blocks, lambda b: total(ls, b * BLOCK, F.lit(BLOCK))).alias("sums")))
        return F.get(F.transform(whole, lambda w: F.flatten(F.transform(blocks, lambda b: in_block(w["ls"], w["sums"], b)))), F.lit(0))

    return F.get(F.transform(F.array(pieces), placed), F.lit(0))


def valid(kind: str, body: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(body, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (p.try_cast("int") <= 255))
    if kind == "card":
        digits = F.regexp_replace(body, "[ -]", "")
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.regexp_replace(body, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Spans of all kinds that hold, in order of start and kind."""

    def of_kind(n: int, kind: str) -> Column:
        good = F.filter(matches(text, PATTERNS[kind]), lambda m: valid(kind, m["body"]))
        end = lambda m: (m["start"] + F.char_length(m["body"])).alias("end")
        spans = F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(n).alias("kind"), end(m), m["body"].alias("body")))
        return F.when(text.rlike(HINTS[kind]), spans).otherwise(F.array().cast(SPAN))

    return F.sort_array(F.concat(*[of_kind(n, kind) for n, kind in enumerate(KINDS)]))


def identifiers(text: Column) -> Column:
    """``start, body, context`` of tokens with a digit or an at sign that follow a word."""

    def context(piece: Column) -> Column:
        near = F.lower(F.substring(piece, -CONTEXT_CHARS, CONTEXT_CHARS))
        return F.regexp_replace(F.regexp_extract(near, r"(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]+$", 0), r"[\x20\x09-\x0D]+", " ")

    rows = F.transform(matches(text, IDENTIFIER), lambda m: F.struct(m["start"].alias("start"), m["body"].alias("body"), context(m["left"]).alias("context")))
    return F.when(text.rlike("[0-9@]"), F.filter(rows, lambda m: m["context"] != "")).otherwise(F.array().cast("array<struct<start:int,body:string,context:string>>"))


def learned(found: DataFrame) -> DataFrame:
    """``row, start, end, kind, body`` of identifiers that the bootstrapped patterns add.

    Each round scores the patterns by the identifiers they find and then the identifiers by the best pattern that finds
    them; seeds keep their score of 1. A word pair or an identifier may be frequent: rows are counted by pair before any join.
    """
    rows = found.select("row", "base", F.explode("tokens").alias("t"))
    over = F.filter("base", lambda s: (s["start"] < F.col("t.start") + F.char_length("t.body")) & (s["end"] > F.col("t.start")))
    tokens = rows.select("row", "t.*", F.get(over, F.lit(0))["kind"].alias("seed"))
    tokens = stage(tokens, "identifiers")
    pairs = tokens.groupBy("context", "body").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed"))
    often = tokens.groupBy("context").agg(F.count(F.lit(1)).alias("all")).where(F.col("all") >= LEAST_FOUND)
    graph = stage(pairs.join(often, "context"), "graph")
    one_hot = F.explode(F.array(*[F.lit(n) for n in range(len(KINDS))]))
    score = graph.select("body", "context", "n", "all", one_hot.alias("kind"), "seed").withColumn("score", F.coalesce((F.col("seed") == F.col("kind")).cast("double"), F.lit(0.0)))
    good = None
    for _ in range(ROUNDS):
        good = score.groupBy("context", "kind").agg((F.sum(F.col("n") * F.col("score")) / F.max("all")).alias("trust"))
        good = stage(good.where(F.col("trust") >= LEAST_SCORE), "patterns")
        best = score.select("body", "context", "kind").distinct().join(good, ["context", "kind"]).groupBy("body", "kind").agg(F.max("trust").alias("by"))
        score = score.join(best, ["body", "kind"], "left").withColumn("score", F.greatest("score", F.coalesce("by", F.lit(0.0)))).drop("by")
    top = good.groupBy("context").agg(F.max(F.struct("trust", (-F.col("kind")).alias("kind"))).alias("top"))
    new = tokens.where("seed is null").join(top.select("context", (-F.col("top.kind")).alias("kind")), "context")
    return new.select("row", "start", "kind", (F.col("start") + F.char_length("body")).alias("end"), "body")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, base, added``: spans with ``start, kind, end, body``, sorted by start and kind (a place in KINDS).

    Places are code points, ends exclusive. Matches that fail their check are dropped and not tried again. Null and
    empty texts have no spans. Rows alike in key and text get the same spans; with few or no seeds nothing is added.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    row = F.xxhash64(F.col(key), body)
    found = docs.select(F.col(key).alias("id"), row.alias("row"), base_spans(body).alias("base"), identifiers(body).alias("tokens"))
    found = stage(found, "personal-data")
    added = learned(found).distinct().groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "body"))).alias("added"))
    whole = found.select("id", "row", "base").join(added, "row", "left")
    return whole.select(F.col("id").alias(key), "base", F.coalesce("added", F.array().cast(SPAN)).alias("added"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(kind: str, spans: Column) -> Column:
    number = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")
