"""Token ids and token counts of a column of texts."""

from __future__ import annotations

import gc
import importlib.util
import os
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.bpe import Encoder

_ENCODERS: dict[str, Encoder] = {}


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of a public vocabulary file: in the folder TOKENIZERS_DIR, or where the package of vocabularies is installed."""
    folder = os.environ.get("TOKENIZERS_DIR")
    if not folder:
        found = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(found.origin) if found else "/opt/tokenizers"
    return os.path.join(folder, name)


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary in a Python worker, so that what it has learnt serves later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
        gc.freeze()
        gc.set_threshold(200_000, 50, 50)  # states are many small tuples without cycles
    return _ENCODERS[path]


def encode(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids): the token ids of each row's text, without special tokens.

    A null or empty text has an empty list. Repeated rows, null keys and further columns are no matter: one row comes
    out for each that goes in. Texts of any length are encoded whole. No shuffle.
    """
    path = path or vocabulary()
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        one = encoder(path).encode
        for batch in batches:
            ids = [one(x) for x in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int64)
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))], [key, "ids"])

    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, schema)


def count(df: DataFrame, key: str, text: str, name: str = "n_tokens", path: str | None = None) -> DataFrame:
    """(key, name): how many tokens each row's text has, 0 for null and empty texts. No shuffle."""
    path = path or vocabulary()
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(name, T.LongType())])

    def run(batches):
        one = encoder(path).count
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(x) for x in batch.column(1).to_pylist()], pa.int64())], [key, name])

    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, schema)


def decode(df: DataFrame, key: str, ids: str, path: str | None = None) -> DataFrame:
    """(key, text): the text of each row's ids; a null list gives a null text. No shuffle."""
    path = path or vocabulary()
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("text", T.StringType())])

    def run(batches):
        decoder = encoder(path).decoder()
        for batch in batches:
            texts = [None if x is None else decoder.feed(x) + decoder.end() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return df.select(F.col(key), F.col(ids)).mapInArrow(run, schema)
