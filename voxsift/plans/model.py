"""Calling an external model from a Spark job.

A model is given as a factory: ``make_complete(settings)`` runs once per Python worker (open the
connection there) and returns ``complete(prompts: pandas.Series) -> pandas.Series`` of reply texts.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

# Defaults of the model settings and the request size for embeddings.
MAX_TOKENS = 500
TEMPERATURE = 0.1
EMBEDDING_CHUNK = 100
# Requests begun and not yet taken up, for each thread; and prompts that are Python texts at once, about.
AHEAD = 4
PROMPTS_AT_ONCE = 256


@dataclass(frozen=True)
class ModelSettings:
    """Handed to the factory on the worker. ``key`` stays out of the printed form and of plans."""

    name: str = ""
    endpoint: str = ""
    key: str = field(default="", repr=False)
    max_tokens: int = MAX_TOKENS
    temperature: float = TEMPERATURE
    more: dict = field(default_factory=dict)


Complete = Callable[[pd.Series], pd.Series]
MakeComplete = Callable[[ModelSettings], Complete]


def model_call(
    prompt: Column, make_complete: MakeComplete, settings: ModelSettings, threads: int = 1, chunk: int = 1
) -> Column:
    """``struct<reply, error>`` for each prompt; a prompt whose call raises gets the message as error.

    Each task sends ``threads`` requests of ``chunk`` prompts at a time and keeps the row order. The
    column is marked nondeterministic, so the optimizer never runs a call twice.
    """

    @F.arrow_udf(_CALLED)
    def call(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ask = partial(_answers, make_complete(settings))
        with ThreadPoolExecutor(threads) as pool:
            for prompts in batches:
                yield _called(_in_order(pool, ask, _pieces(prompts, chunk), threads))

    return call.asNondeterministic()(prompt)


_CALLED = T.StructType([T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())])


def _pieces(prompts: pa.Array, chunk: int) -> Iterator[list[str | None]]:
    """The prompts of each request; only some of a batch are Python texts at once."""
    step = chunk * max(1, PROMPTS_AT_ONCE // chunk)
    for low in range(0, len(prompts), step):
        texts = prompts.slice(low, step).to_pylist()
        yield from (texts[i : i + chunk] for i in range(0, len(texts), chunk))


def _in_order(pool: ThreadPoolExecutor, ask: Callable, pieces: Iterable, threads: int) -> Iterator:
    """Answers in the order of ``pieces``, of which few are begun ahead; one thread needs no pool."""
    if threads == 1:
        yield from map(ask, pieces)
        return
    begun: deque = deque()
    for piece in pieces:
        begun.append(pool.submit(ask, piece))
        if len(begun) >= AHEAD * threads:
            yield begun.popleft().result()
    while begun:
        yield begun.popleft().result()


def _called(answers: Iterable[list[tuple[str | None, str | None]]]) -> pa.Array:
    parts, held = [], []

    def put() -> None:
        columns = zip(*held) if held else ((), ())
        parts.append(pa.StructArray.from_arrays([pa.array(list(c), pa.string(), from_pandas=True) for c in columns], names=["reply", "error"]))
        held.clear()

    for piece in answers:
        held.extend(piece)
        if len(held) >= PROMPTS_AT_ONCE:
            put()
    put()
    return pa.concat_arrays(parts)


def _answers(complete: Complete, prompts: list[str | None]) -> list[tuple[str | None, str | None]]:
    """(reply, error) in prompt order; NULL prompts are not sent."""
    asked = [p for p in prompts if p is not None]
    if not asked:
        return [(None, None)] * len(prompts)
    try:
        replies = list(complete(pd.Series(asked, dtype=object)))
        if len(replies) != len(asked):
            raise ValueError(f"{len(asked)} prompts, {len(replies)} replies")
        reply = iter(replies)
        return [(None, None) if p is None else (next(reply), None) for p in prompts]
    except Exception as failure:
        if len(prompts) > 1:  # find the prompts at fault, the others keep their replies
            return [a for p in prompts for a in _answers(complete, [p])]
        return [(None, str(failure) or type(failure).__name__)]


def embedding_call(text: Column, make_embed: Callable, settings: ModelSettings, chunk: int = EMBEDDING_CHUNK) -> Column:
    """``array<float>`` for each text from ``make_embed(settings)(texts) -> list of vectors``, in chunks."""

    @F.pandas_udf("array<float>")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = make_embed(settings)
        for texts in batches:
            vectors: list = []
            for i in range(0, len(texts), chunk):
                vectors.extend(embed(texts.iloc[i : i + chunk].tolist()))
            yield pd.Series(vectors, dtype=object)

    return call.asNondeterministic()(text)
