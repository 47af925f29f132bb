"""Palettes as tables (idx, r, g, b): merging, varying, cycling, fading and remapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clips import truncated

RGB = ("r", "g", "b")


def full_palette(entries: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """All 256 colours: those listed, up to 255, and black for the rest."""
    keys = keys or []
    base = entries.select(*keys).distinct() if keys else entries.sparkSession.range(1).select()
    every = base.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(255))))
    return every.join(entries.select(*keys, "idx", *RGB), [*keys, "idx"], "left").select(*keys, "idx", *[F.coalesce(c, F.lit(0)).alias(c) for c in RGB])


def merge_palette(to: DataFrame, source: DataFrame) -> DataFrame:
    """Colours of source marked used replace those of to."""
    new = source.select("idx", F.col("used").alias("_u"), *[F.col(c).alias(f"_{c}") for c in RGB])
    on = to.join(new, "idx", "left")
    return on.select("idx", *[F.when(F.coalesce("_u", F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in RGB])


def vary(start: DataFrame, target: DataFrame, percent: int, first: int = 0, last: int = 255) -> DataFrame:
    """start moved percent of the way to target within a range of indices."""
    other = target.select("idx", *[F.col(c).alias(f"_{c}") for c in RGB])
    on = start.join(other, "idx")
    moved = lambda c: F.when(F.col("idx").between(first, last), F.col(c) + truncated((F.col(f"_{c}") - F.col(c)) * percent, 100)).otherwise(F.col(c))
    return on.select("idx", *[moved(c).alias(c) for c in RGB])


def cycle(palette: DataFrame, cyclers: DataFrame) -> DataFrame:
    """Slot first + j takes the colour of first + (shift + j) % n, for each cycler (first, n, shift). Overlapping cyclers are an error."""
    slots = cyclers.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select((F.col("first") + F.col("j")).alias("idx"), (F.col("first") + F.pmod(F.col("shift") + F.col("j"), F.col("n"))).alias("_from"))
    slots = slots.groupBy("idx").agg(F.count("*").alias("_n"), F.first("_from").alias("_from"))
    slots = slots.withColumn("_from", F.when(F.col("_n") > 1, F.raise_error(F.lit("cyclers overlap")).cast("int")).otherwise(F.col("_from"))).drop("_n")
    on = palette.join(slots, "idx", "left").select("idx", F.coalesce("_from", "idx").alias("_from"))
    return on.join(palette.withColumnRenamed("idx", "_from"), "_from").select("idx", *RGB)


def fade(palette: DataFrame, percent: int, first: int, last: int) -> DataFrame:
    """Brightness to percent, at most 255, for indices first to last (235 at most)."""
    to = min(last, 235)
    return palette.select("idx", *[F.when(F.col("idx").between(first, to), F.least(F.lit(255), truncated(F.col(c) * percent, 100))).otherwise(F.col(c)).alias(c) for c in RGB])


def gamma(palette: DataFrame, table: DataFrame) -> DataFrame:
    """Each channel through a table (value, to)."""
    out = palette
    for c in RGB:
        t = table.select(F.col("value").alias(c), F.col("to").alias(f"_{c}"))
        out = out.join(t, c).drop(c).withColumnRenamed(f"_{c}", c)
    return out.select("idx", *RGB)


def invert(palette: DataFrame, first: int, end: int) -> DataFrame:
    """255 - c for indices from first up to, but not including, end."""
    on = (F.col("idx") >= first) & (F.col("idx") < end)
    return palette.select("idx", *[F.when(on, 255 - F.col(c)).otherwise(F.col(c)).alias(c) for c in RGB])


def remap_range(idx: Column, first: int, last: int, base: int) -> Column:
    return F.when(idx.between(first, last), F.pmod(idx + base, F.lit(256))).otherwise(idx)


def remap_percent(palette: DataFrame, percent: int) -> DataFrame:
    """Each colour scaled to percent, then the index of the nearest colour (squared distance, the lowest index on ties): idx, to. The colours, one for each index from 0 to 255, are one value beside each row, so no two tables are crossed."""
    one = palette.where(F.col("idx").between(0, 255)).groupBy("idx").agg(*[F.first(c).alias(c) for c in RGB])
    colours = one.agg(F.collect_list(F.struct("idx", *RGB)).alias("colours")).scalar()
    scaled = palette.select("idx", *[truncated(F.col(c) * percent, 100).alias(c) for c in RGB], colours.alias("_colours"))
    distance = lambda p: sum(((F.col(c) - p[c]) * (F.col(c) - p[c]) for c in RGB), F.lit(0))
    return scaled.select("idx", F.array_min(F.transform("_colours", lambda p: F.struct(distance(p).alias("d"), p["idx"].alias("to"))))["to"].alias("to"))
