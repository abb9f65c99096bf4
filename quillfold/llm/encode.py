"""Token ids and token counts of a corpus."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillfold.llm import bpe

#: Where the public vocabulary files lie; a parameter of every operator here.
TOKENIZERS = os.environ.get("QUILLFOLD_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.tiktoken"


def _batches(rank_file: str, counts_only: bool, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(rank_file)
        for batch in batches:
            texts = [x or "" for x in batch.column("_text").to_pylist()]
            for a, b in bpe.groups(texts):
                flat, ends = enc.encode(texts[a:b], counts_only)
                cols = [batch.column(k).slice(a, b - a) for k in keys]
                if counts_only:
                    cols.append(pa.array(np.diff(ends), pa.int64()))
                else:
                    cols.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=[*keys, "n_tokens" if counts_only else "ids"])

    return run


def encode_texts(docs: DataFrame, keys: list[str], text: str = "text", tokenizers: str = TOKENIZERS, rank_file: str = BYTE_BPE) -> DataFrame:
    """``keys`` and ``ids``, the list of token ids of each row's text, without special tokens.

    An empty and a null text give an empty list; a repeated row gives a
    repeated result; extra columns are not read. Nothing is shuffled: each
    partition streams through one Arrow stage, in groups of some 150,000
    characters, so a very long text costs memory in proportion to itself alone.
    """
    schema = T.StructType([*(docs.schema[k] for k in keys), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    rows = docs.select(*keys, F.col(text).alias("_text"))
    return rows.mapInArrow(_batches(os.path.join(tokenizers, rank_file), False, keys), schema)


def encode_offsets(docs: DataFrame, keys: list[str], text: str = "text", tokenizers: str = TOKENIZERS, rank_file: str = BYTE_BPE) -> DataFrame:
    """``keys``, ``ids`` and ``starts``: for each id the offset of its token in the text's UTF-8 bytes.

    The bytes from one start to the next are the token's own, so any run of ids
    decodes to a slice of the text without decoding what is before it. Null and
    empty texts give two empty lists.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(os.path.join(tokenizers, rank_file))
        for batch in batches:
            texts = [x or "" for x in batch.column("_text").to_pylist()]
            for a, b in bpe.groups(texts):
                flat, ends = enc.encode(texts[a:b])
                bounds = pa.array(ends.astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in (flat, enc.starts_of(flat, ends))]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in keys), *lists], names=[*keys, "ids", "starts"])

    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([*(docs.schema[k] for k in keys), T.StructField("ids", ints), T.StructField("starts", ints)])
    return docs.select(*keys, F.col(text).alias("_text")).mapInArrow(run, schema)


def count_tokens(docs: DataFrame, keys: list[str], text: str = "text", tokenizers: str = TOKENIZERS, rank_file: str = BYTE_BPE) -> DataFrame:
    """``keys`` and ``n_tokens``; null and empty texts have 0."""
    schema = T.StructType([*(docs.schema[k] for k in keys), T.StructField("n_tokens", T.LongType())])
    rows = docs.select(*keys, F.col(text).alias("_text"))
    return rows.mapInArrow(_batches(os.path.join(tokenizers, rank_file), True, keys), schema)
