"""Encoders as vectorised UDFs, and content-keyed incremental encoding."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as fv
from ..functions.identity import text_key
from ..sources.vectors import ROW_BYTES, VersionedTable, store_vectors
from .shuffle import lookup_join

Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(dim: int = 256) -> Encoder:
    """A deterministic encoder needing no model: signed word hashing.

    It stands in where no learned encoder is at hand; thresholds do not carry over.
    """
    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        seen: dict[str, tuple[int, int]] = {}
        for row, text in enumerate(texts):
            for word in text.lower().split():
                if word not in seen:
                    digest = hashlib.md5(word.encode()).digest()
                    seen[word] = int.from_bytes(digest[:4], "big") % dim, 1 - 2 * (digest[4] & 1)
                slot, sign = seen[word]
                out[row, slot] += sign
        return out
    return encode


def encoder_udf(encoder: Encoder | Callable[[], Encoder], prefix: str = "passage",
                model: str = fv.DEFAULT_MODEL, lazy: bool = False):
    """`encoder` as a vectorised UDF from text to a unit vector.

    With `lazy`, `encoder` is a factory called once per Python worker (to load a model).
    Models of the E5 family get the `query: ` or `passage: ` prefix they expect.
    """
    head = f"{prefix}: " if "e5" in model.lower() else ""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = encoder() if lazy else encoder
        for texts in batches:
            matrix = np.asarray(run([head + t for t in texts]), dtype=np.float64)
            norms = np.linalg.norm(matrix, axis=1, keepdims=True)
            unit = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)
            yield pd.Series(list(unit.astype(np.float32)))
    return encode


def text_normalizer(normalize: Callable[[str], str]):
    """A language normaliser as a vectorised UDF, for `functions.text.normalize`."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(normalize)
    return run


def missing_texts(texts: DataFrame, text: str, store: DataFrame, model: str = fv.DEFAULT_MODEL,
                  force: bool = False) -> DataFrame:
    """T8, the plan: distinct `(key, text)` the store does not hold (all of them with `force`)."""
    wanted = (texts.select(text_key(F.col(text), model).alias("key"), F.col(text).alias("text"))
              .dropDuplicates(["key"]))
    return wanted if force else wanted.join(store.select("key"), "key", "left_anti")


def embed(texts: DataFrame, text: str, store: VersionedTable, udf, model: str = fv.DEFAULT_MODEL,
          force: bool = False, vector: str = "vector") -> DataFrame:
    """`texts` with a vector each; only unknown texts are encoded, the store is extended."""
    known = store.read()
    todo = missing_texts(texts, text, known, model, force)
    if not todo.isEmpty():
        fresh = todo.select("key", F.lit(model).alias("model"), udf(F.col("text")).alias("vector"))
        store_vectors(store, known, fresh)
    held = store.read().select("key", F.col("vector").alias(vector))
    keyed = texts.withColumn("_key", text_key(F.col(text), model))
    return lookup_join(keyed, held.withColumnRenamed("key", "_key"), "_key", texts.columns,
                       row_bytes=ROW_BYTES).drop("_key")
