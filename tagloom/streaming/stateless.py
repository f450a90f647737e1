"""The row-local steps on a stream.

Cleaning, encoding of tokens into chunks and thresholding keep no state, so
the batch operators run unchanged on a streaming DataFrame. This module only
names the composition; it adds no operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tagloom.operators.cleaning import clean_notes


def clean_notes_stream(notes: DataFrame, category: str | None, path: str, checkpoint: str, min_chars: int = 50) -> StreamingQuery:
    """Clean arriving notes and append them to a Parquet folder, then stop."""
    cleaned = clean_notes(notes, category, min_chars)
    writer = cleaned.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path)
    return writer.trigger(availableNow=True).start()
