"""Row-local operators over streaming DataFrames.

Operators that look at one row, or at one row and a static table, take a streaming DataFrame as it is. Ordered operators
(windows, running sums, look-back) need whole sequences and stay batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.clips import frame_reject_reason
from ..functions.codes import decode_enum
from ..operators.pixels import apply_palette, compose_rgba, split_layers


def coloured_stream(pixels: DataFrame, palette: DataFrame, variant: str = "A") -> DataFrame:
    """A stream of pixels with its layers and composed colours; the palette is static."""
    return compose_rgba(split_layers(apply_palette(pixels, palette), variant))


def validated_stream(frames: DataFrame) -> DataFrame:
    """A stream of frames with the reason for which each is rejected, null if none."""
    return frames.withColumn("reason", frame_reject_reason(*[F.col(c) for c in ("count", "w", "h", "data_size", "chunks")]))


def unsupported_methods_stream(resources: DataFrame, time: str, late: str = "10 minutes") -> DataFrame:
    """Each unsupported method once within the watermark."""
    unknown = resources.where(decode_enum(F.col("method"), "family") == "unsupported").select("method", time)
    return unknown.withWatermark(time, late).dropDuplicatesWithinWatermark(["method"])


def write_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
