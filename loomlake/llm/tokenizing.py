"""Token ids and token counts of a text column, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomlake.llm.byte_bpe import Decoder, encoder_for

#: Folder of the public vocabularies; a parameter of every function below.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"


def _vocabulary(df: DataFrame, folder: str):
    """The vocabulary file (under 1 MB, a fixed table) as a broadcast."""
    return df.sparkSession.sparkContext.broadcast((Path(folder) / VOCABULARY).read_bytes())


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids array<int>): byte_bpe_50k without special tokens; the empty list for an empty and a null text.

    One row per input row, whatever other columns there are.  Each text is read
    in windows, so a very long text costs no more memory than its ids.
    """
    data = _vocabulary(df, folder)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_for(data.value)
        for b in batches:
            keys, flat, offsets = b.column(0), [], [0]
            for t in b.column(1):
                flat += enc.encode(t.as_py())
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.array(flat, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([keys, ids], names=[key, "ids"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(work, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """(key, n_tokens)."""
    data = _vocabulary(df, folder)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_for(data.value)
        for b in batches:
            n = pa.array([len(enc.encode(t.as_py())) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n], names=[key, "n_tokens"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(work, f"`{key}` {kind}, n_tokens long")


def decoded(df: DataFrame, key: str = "doc_id", folder: str = TOKENIZERS) -> DataFrame:
    """(key, text) from (key, ids)."""
    data = _vocabulary(df, folder)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = Decoder(encoder_for(data.value).v)
        for b in batches:
            texts = pa.array([dec.decode(x.as_py() or []) for x in b.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), texts], names=[key, "text"])

    kind = dict(df.dtypes)[key]
    return df.select(key, "ids").mapInArrow(work, f"`{key}` {kind}, text string")
