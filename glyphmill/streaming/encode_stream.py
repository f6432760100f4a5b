"""Encoding of a stream: stateless, so the batch operator serves as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.encode import Encoder, encode_documents

SCHEMA = "doc_id bigint, text string"


def document_stream(spark: SparkSession, folder: str, schema: str = SCHEMA, kind: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(kind).load(folder)


def encode_to(stream: DataFrame, encoder: Encoder, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes encoded documents as Parquet, each exactly once."""
    encoded = encode_documents(stream, encoder)
    return encoded.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
