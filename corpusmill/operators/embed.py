"""Vectors for texts: native feature hashing or a pluggable model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.base import strip
from corpusmill.functions.tokens import hashing_vector, tokens
from corpusmill.operators.once import with_once

DEFAULT_DIMS = 64
SUB_BATCH = 100

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def embed(df: DataFrame, col: str = "chunk_text", dims: int = DEFAULT_DIMS, out: str = "embedding") -> DataFrame:
    """Add a unit vector of hashed words; null for blank text. Row-local; only the words go to the Arrow worker and only the vectors come back."""
    return with_once(df, out, F.when(F.length(strip(F.col(col))) > 0, hashing_vector(tokens(F.col(col)), dims)))


def embed_with(
    df: DataFrame, make_embedder: Callable[[], Embedder], col: str = "chunk_text", out: str = "embedding", sub_batch: int = SUB_BATCH
) -> DataFrame:
    """Add vectors from a model. The client is made once per task; texts go out in sub-batches; blank text gets null."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_embedder()
        for frame in frames:
            texts = frame[col].tolist()
            vectors: list[Sequence[float] | None] = [None] * len(texts)
            for start in range(0, len(texts), sub_batch):
                at = [i for i in range(start, min(start + sub_batch, len(texts))) if texts[i] and texts[i].strip()]
                if at:
                    for i, vector in zip(at, model([texts[i] for i in at]), strict=True):
                        vectors[i] = [float(x) for x in vector]
            yield frame.assign(**{out: vectors})

    return df.mapInPandas(run, schema)
