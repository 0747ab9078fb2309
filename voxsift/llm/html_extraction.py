"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the page.

A page is read into blocks of text with the tags and class words above them. Features of a block and of its text give
scores for main text and for the rest, neighbouring blocks are tied by transition scores, and the best sequence is found
by Viterbi. Weights are fitted on labelled pages by the gradient of the conditional likelihood.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from voxsift.llm.common import long_rows, sent

DIMENSIONS = 1 << 12
TRAIN_PAGES = 200
STEPS = 80

# Names of HTML elements.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW_TAGS = frozenset("script style noscript template textarea iframe svg title select button".split())
# Of these the page is raw to its end if they aren't closed; the others are then taken for any other element.
TO_THE_END = ("script", "style", "textarea")
# An open p, li and so on ends where one of its kind begins.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*?)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
NAME = re.compile(r"[a-z]+")
SPACE = re.compile(r"[ \t\n\r\f\v]+")


@dataclass
class Block:
    """White space made single, the element it stands in, the names of that and those above, their class words, and
    characters inside links."""

    text: str
    own: str
    tags: frozenset[str]
    names: frozenset[str]
    linked: int


def blocks_of(page: str | None) -> list[Block]:
    """Blocks with text in page order. Markup that isn't closed is closed where the page ends; scripts, styles, comments
    and form fields are no text. An element shares the names above with its parent, so nesting costs nothing."""
    out: list[Block] = []
    none: frozenset[str] = frozenset()
    stack: list[tuple[str, frozenset[str], frozenset[str]]] = []  # an open element; names and class words of it and all above
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = SPACE.sub(" ", entities.unescape("".join(parts))).strip(" ")
        if text:
            own, tags, names = stack[-1] if stack else ("", none, none)
            out.append(Block(text, own, tags, names, linked))
        parts.clear()
        linked = 0

    page, at, unclosed = page or "", 0, set()

    def raw_end(tag: str, page: str, at: int) -> int | None:
        """Where the content of a raw element ends; the page is searched once for one that is nowhere closed."""
        if tag in unclosed:
            return None
        end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
        if end is None:
            unclosed.add(tag)
        return end.end() if end else None

    while True:
        found = TOKEN.search(page, at)
        piece = page[at : found.start()] if found else page[at:]
        if piece:
            parts.append(piece)
            if opened["a"]:
                linked += len(piece.strip())
        if not found:
            break
        at = found.end()
        closing, tag = found[1], (found[2] or "").lower()
        if not tag:
            continue
        if closing:
            if opened[tag]:
                if tag in BLOCK_TAGS:
                    flush()
                last = None
                while last != tag:
                    last = stack.pop()[0]
                    opened[last] -= 1
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in RAW_TAGS:
            if (found[3] or "").endswith("/"):
                continue
            end = raw_end(tag, page, at)
            if end is not None or tag in TO_THE_END:
                at = len(page) if end is None else end
                continue
        if tag in BLOCK_TAGS:
            flush()
            ends = CLOSES.get(tag, ("p",) if tag not in ("body", "html") else ())
            for depth in range(len(stack) - 1, -1, -1) if any(opened[t] for t in ends) else ():
                if stack[depth][0] in ends:
                    opened.subtract(t for t, _, _ in stack[depth:])
                    del stack[depth:]
                    break
                if stack[depth][0] in ("ul", "ol", "table", "div", "section", "article", "nav", "aside", "main", "body"):
                    break
        if tag not in VOID_TAGS:
            words = frozenset(w for _, v in ATTRIBUTE.findall(found[3] or "") for w in NAME.findall(v.lower()))
            _, tags, names = stack[-1] if stack else ("", none, none)
            stack.append((tag, tags if tag in tags else tags | {tag}, names if words <= names else names | words))
            opened[tag] += 1
    flush()
    return out


def hashed(name: str) -> int:
    value = 2166136261
    for byte in name.encode():
        value = (value ^ byte) * 16777619 & 0xFFFFFFFF
    return value % DIMENSIONS


class Numbers(dict):
    """Feature numbers, made when first asked for."""

    def __missing__(self, name: str) -> int:
        self[name] = number = hashed(name)
        return number


def features(blocks: list[Block], numbers: Numbers) -> list[list[int]]:
    """Feature numbers of each block: its own tag, the tags and class words above, and the look of its text."""
    out = []
    total = len(blocks)
    for k, block in enumerate(blocks):
        text, n = block.text, len(block.text)
        words = text.count(" ") + 1
        own = ["bias", "own:" + block.own, f"words:{min(words, 200).bit_length()}"]
        own += ["tag:" + t for t in block.tags]
        own += ["name:" + w for w in block.names]
        own.append(f"link:{min(4, 4 * block.linked // n)}")
        own.append(f"stop:{min(3, text.count('.') + text.count(','))}")
        own.append("end:" + (text[-1] if text[-1] in ".!?:,;" else "w"))
        own.append("mark:" + str(any(c in text for c in "©®|»›·")))
        own.append(f"place:{min(3, k)}:{min(3, total - 1 - k)}")
        out.append([numbers[f] for f in own])
    return out


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Field:
    """``weights[feature, label]`` and ``steps[label, next label]``; label 1 is main text."""

    weights: np.ndarray
    steps: np.ndarray

    def scores(self, found: list[list[int]]) -> np.ndarray:
        return np.array([self.weights[f].sum(axis=0) for f in found])

    def decode(self, found: list[list[int]]) -> list[int]:
        """The most likely labels, by Viterbi; ties go to the rest."""
        if not found:
            return []
        (s00, s01), (s10, s11) = self.steps.tolist()
        scores = self.scores(found).tolist()
        a, b = scores[0]
        back = []
        for x, y in scores[1:]:
            to0, to1 = a + s00 >= b + s10, a + s01 >= b + s11
            back.append((0 if to0 else 1, 0 if to1 else 1))
            a, b = x + (a + s00 if to0 else b + s10), y + (a + s01 if to1 else b + s11)
        label = 0 if a >= b else 1
        labels = [label]
        for pair in reversed(back):
            label = pair[label]
            labels.append(label)
        return labels[::-1]


def fit(pages: list[tuple[list[list[int]], list[int]]], steps: int = STEPS, penalty: float = 1e-3) -> Field:
    """Adam on the conditional log likelihood, with the expectations of forward and backward sums."""
    field = Field(np.zeros((DIMENSIONS, 2)), np.zeros((2, 2)))
    pages = [(f, np.array(y)) for f, y in pages if f]
    first = [np.zeros_like(field.weights), np.zeros_like(field.steps)]
    second = [np.zeros_like(field.weights), np.zeros_like(field.steps)]
    flat = [(np.concatenate([np.array(x) for x in f]), np.repeat(np.arange(len(f)), [len(x) for x in f])) for f, _ in pages]
    for step in range(1, steps + 1 if pages else 1):
        slopes = [penalty * field.weights, penalty * field.steps]
        for (found, truth), (index, row) in zip(pages, flat):
            n = len(truth)
            unary = np.stack([np.bincount(row, weights=field.weights[index, k], minlength=n) for k in (0, 1)], axis=1)
            ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
            ahead[0] = unary[0]
            for t in range(1, n):
                ahead[t] = unary[t] + log_sum(ahead[t - 1][:, None] + field.steps, 0)
            for t in range(n - 2, -1, -1):
                behind[t] = log_sum(field.steps + (unary[t + 1] + behind[t + 1])[None, :], 1)
            total = log_sum(ahead[-1], 0)
            error = np.exp(ahead + behind - total)
            error[np.arange(n), truth] -= 1
            for k in (0, 1):
                slopes[0][:, k] += np.bincount(index, weights=error[row, k], minlength=DIMENSIONS) / len(pages)
            if n > 1:
                both = np.exp(ahead[:-1, :, None] + field.steps[None] + (unary[1:] + behind[1:])[:, None, :] - total).sum(axis=0)
                np.add.at(both, (truth[:-1], truth[1:]), -1)
                slopes[1] += both / len(pages)
        for k, part in enumerate((field.weights, field.steps)):
            first[k] = 0.9 * first[k] + 0.1 * slopes[k]
            second[k] = 0.999 * second[k] + 0.001 * slopes[k] ** 2
            part -= 0.1 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return field


#: Labelled layouts. Each entry is (markup around a text, main text or not); {} is filled with running text, {w} with a few
#: words. They are the labelled pages on which the field learns what the given pages don't show: sidebars, forms, comments.
SHELLS = ["<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="post-body" class="entry">{}</div>', '<div role="main"><section>{}</section></div>']
MAIN_PARTS = ["<h1>{w}</h1>", "<p>{}</p>", "<p>{}</p>", "<p><b>{w}</b> {}", "<h2>{w}</h2><p>{}</p>", "<blockquote>{}</blockquote>", "<ul><li>{}</li><li>{w}</li></ul>", "<p>{w}</p>", "<pre>{w}</pre>", "<table><tr><td>{w}</td><td>{}</td></tr></table>"]
REST_PARTS = [
    '<nav><ul><li><a href="/a">{w}</a></li><li><a href="/b">{w}</a></li></ul></nav>', '<header><a href="/">{w}</a><p>{w}</p></header>',
    '<div class="menu"><a href="/x">{w}</a> <a href="/y">{w}</a></div>', '<aside><h3>{w}</h3><p>{}</p></aside>', '<div class="sidebar"><p>{}</p><a href="/z">{w}</a></div>',
    '<div class="ad">{}</div>', '<div class="banner advert">{w}</div>', '<div class="cookie notice">{}</div>', '<form class="search"><label>{w}</label><p>{w}</p></form>',
    '<div class="comments"><h3>{w}</h3><div class="comment"><p>{}</p></div><div class="comment"><p>{}</p></div></div>', '<section id="comments"><p>{}</p><p>{}</p></section>',
    '<footer>&copy; {w} &middot; {}</footer>', '<div class="footer"><p>{w}</p><a href="/t">{w}</a></div>', '<div class="related"><ul><li><a href="/r">{w}</a></li></ul></div>',
    '<div class="share social"><a href="/s">{w}</a></div>', '<div class="newsletter popup"><p>{}</p></div>', '<p class="breadcrumb"><a href="/">{w}</a> / <a href="/c">{w}</a></p>',
]


def layouts(words: list[str], count: int = 150) -> list[tuple[list[Block], list[int]]]:
    """Pages made of the labelled layouts, filled with ``words``; some parts of the rest stand inside the main part."""
    draw = random.Random(11)
    pages = []

    def filled(part: str) -> str:
        def some(low: int, high: int) -> str:
            return " ".join(draw.choice(words) for _ in range(draw.randint(low, high)))

        part = re.sub(r"\{w\}", lambda _: some(1, 6).capitalize(), part)
        return re.sub(r"\{\}", lambda _: ". ".join(some(3, 20).capitalize() for _ in range(draw.randint(1, 5))) + ".", part)

    for _ in range(count):
        parts = [(p, 0) for p in draw.sample(REST_PARTS, draw.randint(1, 4))]
        inside = [(draw.choice(MAIN_PARTS), 1) for _ in range(draw.randint(2, 8))]
        if draw.random() < 0.3:
            inside.insert(draw.randint(1, len(inside)), (draw.choice(REST_PARTS[5:10]), 0))
        after = [(p, 0) for p in draw.sample(REST_PARTS, draw.randint(1, 3))]
        shell = draw.choice(SHELLS)
        blocks, truth = [], []
        for k, (group, wrap) in enumerate(((parts, "{}"), (inside, shell), (after, "{}"))):
            for part, label in group:
                found = blocks_of("<html><body>" + wrap.format(filled(part)) + "</body></html>")
                blocks += found
                truth += [label] * len(found)
        pages.append((blocks, truth))
    return pages


def landmarks(blocks: list[Block]) -> list[int] | None:
    """Labels of a page that marks its article itself: inside it, and in no part that is named otherwise."""
    if not any("article" in b.tags for b in blocks):
        return None
    rest = {"nav", "aside", "footer", "header", "form"}
    named = {"ad", "ads", "advert", "comment", "comments", "sidebar", "cookie", "notice", "menu", "share", "related", "banner", "newsletter"}
    return [int("article" in b.tags and not rest & set(b.tags) and not named & b.names) for b in blocks]


def train(pages: DataFrame, html: str = "html", most: int = TRAIN_PAGES) -> Field:
    """Fits the field on the labelled layouts and on at most ``most`` pages that mark their article themselves.

    The pages are those with the lowest hash of their markup: a bounded sample, at any size of the table.
    """
    long_rows(pages.sparkSession)
    rows = pages.select(F.col(html).alias("h")).where("h is not null").orderBy(F.xxhash64("h"), "h").limit(most)
    own = [(found, truth) for found in (blocks_of(r["h"]) for r in rows.toLocalIterator()) if (truth := landmarks(found))]
    words = sorted({w.strip(".,") for found, _ in own for b in found for w in b.text.split(" ")[:40]} - {""}) or ["word"]
    numbers = Numbers()
    return fit([(features(found, numbers), truth) for found, truth in own + layouts(words)])


def extract(pages: DataFrame, field: Field, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with ``text``: the blocks of main text in page order, joined by two line breaks; empty if there is none.

    Null and empty markup gives an empty text. Character references are decoded and white space inside a block is one
    space. A column named ``text`` is replaced, others stay; every row is read on its own.
    """
    shared = sent(pages.sparkSession, field)

    @pandas_udf("string")
    def main_text(markup: pd.Series) -> pd.Series:
        field, numbers = shared(), Numbers()
        out = []
        for page in markup:
            found = blocks_of(page)
            labels = field.decode(features(found, numbers))
            out.append("\n\n".join(b.text for b, label in zip(found, labels) if label))
        return pd.Series(out, dtype="object")

    return pages.withColumn(text, main_text(F.col(html)))
