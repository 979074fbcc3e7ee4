"""Models and language models as injected callables. Nothing here reaches a network: callers bring the callable.

An encoder takes a list of texts and gives one vector each; a scorer takes a list of pairs of texts and gives one number each; a
generator takes a prompt and a model's name and gives a text."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def embedder(load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64):
    """A column function text -> array<float> of unit length; load runs once in each worker."""

    @F.pandas_udf("array<float>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            out = []
            texts = part.fillna("").tolist()
            for at in range(0, len(texts), batch):
                vectors = np.asarray(model(texts[at : at + batch]), np.float32)
                norms = np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
                out += list(vectors / norms)
            yield pd.Series(out, index=part.index, dtype=object)

    return encode


def scorer(load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], batch: int = 64):
    """A column function (query, passage) -> double for reranking; call it after the cut to the first few."""

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, passages in parts:
            pairs = list(zip(queries.fillna(""), passages.fillna(""), strict=True))
            out = [float(x) for at in range(0, len(pairs), batch) for x in model(pairs[at : at + batch])]
            yield pd.Series(out, index=queries.index, dtype=float)

    return score


def with_fallback(generate: Callable[[str, str], str], models: Iterable[str], allowed: Iterable[str]) -> Callable[[str], tuple[str, str]]:
    """A generator that tries the allowed models in order; an empty answer counts as a failure; the last failure is raised."""
    chain = [m for m in dict.fromkeys(models) if m in set(allowed)]
    if not chain:
        raise ValueError("no model is allowed")

    def call(prompt: str) -> tuple[str, str]:
        failure: Exception | None = None
        for model in chain:
            try:
                answer = generate(prompt, model)
                if answer and answer.strip():
                    return answer, model
                failure = ValueError(f"{model} gave an empty text")
            except Exception as e:  # any failure of a model means the next one
                failure = e
        raise failure

    return call


def generate_column(rows: DataFrame, prompt: str, load: Callable[[], Callable[[str], tuple[str, str]]], out: str = "answer") -> DataFrame:
    """Adds a generated text, the model that gave it, and the failure if none did. Rows that are done belong in a left anti join before."""

    def run(frames):
        call = load()
        for frame in frames:
            answers, names, failures = [], [], []
            for p in frame[prompt].fillna(""):
                try:
                    a, m = call(p)
                    f = None
                except Exception as e:
                    a, m, f = None, None, str(e)
                answers.append(a), names.append(m), failures.append(f)
            yield frame.assign(**{out: answers, f"{out}_model": names, f"{out}_failure": failures})

    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInPandas(run, f"{kinds}, `{out}` string, `{out}_model` string, `{out}_failure` string")
