"""Model hooks: what a model does to a column or a table, with stand-ins that need no model.

A hook is a plain callable; :func:`batched` makes one of a real model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from quern.functions import text as T


class Retriever(Protocol):
    """All queries at once: (qid, text) -> (qid, rank, doc_id, score)."""

    def __call__(self, queries: DataFrame, k: int) -> DataFrame: ...


def echo_choice(prompt: Column, vote_idx: Column, n_options: int = 3) -> Column:
    """A vote that depends on prompt and turn alone."""
    return F.char(65 + F.pmod(F.xxhash64(prompt, vote_idx), F.lit(n_options)))


def sentence_claims(question: Column) -> Column:
    """The question's sentences as its propositions."""
    return T.sentences(question)


def batched(load: Callable[[], Callable[..., Any]], returns: str, *, rows: int = 256) -> Callable[..., Column]:
    """A hook on columns from a model that is loaded once a worker process and asked for ``rows`` rows at a time.

    ``load()`` gives a function from equally long lists, one a column, to a list of results of the type ``returns``.
    A worker process serves many tasks, and keeps the model between them.
    """
    key = f"{load.__module__}.{load.__qualname__}:{id(load)}"

    @pandas_udf(returns)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        import sys
        import types

        # The function comes anew with each task; modules stay as long as the process.
        models = sys.modules.setdefault("_quern_models", types.ModuleType("_quern_models")).__dict__
        if key not in models:
            models[key] = load()
        for columns in batches:
            lists = [c.tolist() for c in (columns if isinstance(columns, tuple) else (columns,))]  # a single column comes by itself
            out: list = []
            for at in range(0, len(lists[0]), rows):
                out.extend(models[key](*[x[at : at + rows] for x in lists]))
            yield pd.Series(out)

    return lambda *columns: run(*columns)


def letter_encoder() -> Callable[[list], list]:
    """A stand-in for an encoder: how often each of the 26 letters occurs."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return lambda texts: [[float((t or "").lower().count(c)) for c in letters] for t in texts]


def shared_words() -> Callable[[list, list], list]:
    """A stand-in for a re-ranker or an entailment model: the share of the second text's distinct words that the first holds."""

    def score(premises: list, hypotheses: list) -> list:
        held = [(set((p or "").lower().split()), set((h or "").lower().split())) for p, h in zip(premises, hypotheses, strict=True)]
        return [len(a & b) / len(b) if b else 0.0 for a, b in held]

    return score


@dataclass(frozen=True)
class Hooks:
    """What models do; a hook that is None leaves its step out, or takes the stand-in of the operator.

    On columns: ``generate`` a vote from prompt and turn; ``decompose`` a question's entities;
    ``propose`` its propositions; ``entails`` premise and hypothesis to 0..1 (adds ``support``,
    each proposition's entailment by the context); ``rerank`` query and document to a score;
    ``judge`` a prompt to a text with a JSON object; ``similarity`` answer and reference to a
    score (for measures that need a model).
    On tables: ``encode`` queries(qid, text) to (qid, embedding); ``compress`` pool and queries
    to (qid, context); ``search`` queries to live hits(qid, query_idx, rank, title, url, snippet).
    """

    generate: Callable[[Column, Column], Column] = echo_choice
    decompose: Callable[[Column], Column] = T.capitalised_terms
    propose: Callable[[Column], Column] = sentence_claims
    entails: Callable[[Column, Column], Column] | None = None
    rerank: Callable[[Column, Column], Column] | None = None
    judge: Callable[[Column], Column] | None = None
    similarity: Callable[[Column, Column], Column] | None = None
    encode: Callable[[DataFrame], DataFrame] | None = None
    compress: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    search: Callable[[DataFrame], DataFrame] | None = None
