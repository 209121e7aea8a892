"""Problem 6: the whole corpus as ids of a public byte-level tokenizer.

Results by case: a null text and an empty text both give an empty list; a null id stays null; repeated rows
stay repeated; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import numpy as np

from .byte_bpe import encoder_of

#: Where the public vocabulary files lie; a parameter of every query that needs one.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"


def ranks(spark: SparkSession, folder: str = TOKENIZERS, name: str = BYTE_BPE_50K):
    """The bytes of a rank file as a broadcast value (under 1 MB), so that only the driver needs the file."""
    with open(f"{folder}/{name}", "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and `ids` (array<int>) of every row."""

    def run(batches):
        encoder = encoder_of(vocabulary.value)
        for batch in batches:
            packed = [encoder.packed(t) if t else b"" for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(packed) + 1, np.int64)
            np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def count(docs: DataFrame, vocabulary, keep: list[str], text: str = "text", tokens: str = "tokens") -> DataFrame:
    """The columns `keep` of every row and the number of ids of its text (0 for null)."""

    def run(batches):
        encoder = encoder_of(vocabulary.value)
        for batch in batches:
            counts = [len(encoder.packed(t)) // 4 if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(counts, pa.int64())], names=[*kept, "n"])

    kept = [f"k{i}" for i in range(len(keep))]
    schema = ", ".join(f"{k} {docs.schema[c].dataType.simpleString()}" for k, c in zip(kept, keep))
    out = docs.select(*[F.col(c).alias(k) for k, c in zip(kept, keep)], F.col(text).alias("text")).mapInArrow(run, f"{schema}, n bigint")
    return out.toDF(*keep, tokens)


def decode(encoded: DataFrame, vocabulary, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """`key` and the `text` that the ids stand for; a null list gives a null text."""

    def run(batches):
        encoder = encoder_of(vocabulary.value)
        for batch in batches:
            texts = [None if i is None else encoder.decode(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
