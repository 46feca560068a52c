"""Plug-ins by name: embedders, compressors and retrievers; log parsers have their own in operators.logs."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T


class Retriever(Protocol):
    """Anything that turns a question into ranked hits ``(rank, file, score)``."""

    def __call__(self, files: DataFrame, query: str, k: int) -> DataFrame: ...


EMBEDDERS: dict[str, Callable[[Column], Column]] = {"hash": T.hash_embedding}
RETRIEVERS: dict[str, Retriever] = {}


def register_embedder(name: str, embed: Callable[[list[str]], list[list[float]]], dimension: int) -> None:
    """``embed`` maps a list of texts to vectors, which are scaled to unit length; batches arrive by Arrow and a wrong dimension ends the job."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out = embed(texts.fillna("").tolist())
        if any(len(v) != dimension for v in out):
            raise ValueError(f"{name}: a vector is not of dimension {dimension}")
        return pd.Series([[x / max(sum(y * y for y in v) ** 0.5, 1e-6) for x in v] for v in out])

    EMBEDDERS[name] = run


def register_retriever(name: str, retriever: Retriever) -> None:
    RETRIEVERS[name] = retriever
