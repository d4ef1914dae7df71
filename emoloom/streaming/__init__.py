"""Stateless operators on streams.

Cleaning and the per-row features keep no state, so they run unchanged on a
streaming table; nothing here claims more than that."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import features as X, text as T


def scored(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with cleaned text and the sentiment and lexicon features; of a table or a stream."""
    rows = df.withColumn("processed_text", T.cleaned(F.col(text)))
    rows = rows.withColumn("_tok", T.tokens(F.col("processed_text")))
    tok = F.col("_tok")
    return rows.withColumns(X.sentiment(tok) | X.emotion_lexicon(tok)).drop("_tok")


def files(spark, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def written(df: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Runs the stream over what there is, then stops."""
    return df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
