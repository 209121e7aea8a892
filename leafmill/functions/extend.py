"""Places where a caller's own functions go in (UDF1-UDF8)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def words(text: str) -> list[tuple[int, int]]:
    """Begin and end of each run without white space: the default tokenizer."""
    import re

    return [m.span() for m in re.finditer(r"\S+", text)]


def token_spans(c: Column, tokenizer: Callable[[str], list[tuple[int, int]]] = words) -> Column:
    """Token spans by any tokenizer (UDF1), Arrow batches at a time."""

    @F.pandas_udf(SPANS)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"start": a, "end": b} for a, b in tokenizer(t)])

    return run(c)


def estimated(c: Column, estimator: Callable[[Column], Column]) -> Column:
    """Tokens by a caller's estimator (UDF2), which stays an expression."""
    return F.greatest(estimator(c), F.lit(1)).cast("bigint")


def validated(df: DataFrame, validator: Callable[[DataFrame], Column]) -> DataFrame:
    """Adds `problem`, what a caller's validator finds wrong with a row (UDF3); null for nothing."""
    return df.withColumn("problem", validator(df))


def at_time(df: DataFrame, clock: Callable[[], str]) -> DataFrame:
    """Adds `at` by a caller's clock, which is asked once (UDF4)."""
    return df.withColumn("at", F.lit(clock()).cast("timestamp"))


def compacted(history: DataFrame, callback: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """History after a caller's compaction, which must keep its columns (UDF5)."""
    out = history.transform(callback)
    if out.columns != history.columns:
        raise ValueError(f"a compaction keeps the columns {history.columns}, not {out.columns}")
    return out


def dispatched(calls: DataFrame, name: str, handlers: dict[str, Callable[[DataFrame], DataFrame]], empty: DataFrame) -> DataFrame:
    """Rows of each handler for the calls of its name (UDF6); calls without a handler give none."""
    out = empty
    for key, handler in sorted(handlers.items()):
        out = out.unionByName(handler(calls.filter(F.col(name) == key)))
    return out


def extracted(files: DataFrame, key: str, content: str, extractor: Callable[[bytes], list[str]]) -> DataFrame:
    """Pages by a caller's extractor (UDF8): key, page (from 1), text."""
    kind = files.schema[key].dataType.simpleString()

    def run(parts):
        for part in parts:
            rows = [(k, i, t) for k, raw in zip(part["key"], part["content"]) for i, t in enumerate(extractor(bytes(raw)), 1)]
            yield pd.DataFrame(rows, columns=["key", "page", "text"])

    rows = files.select(F.col(key).alias("key"), F.col(content).alias("content")).filter("content is not null")
    return rows.mapInPandas(run, f"key {kind}, page bigint, text string").withColumnRenamed("key", key)
