"""Frames as pixel tables (clip_id, frame_no, x, y, idx) and what is done with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bytes import align_up, wrap
from .ordered import scan

SKIP = 255
REMAP_FROM = {"pc": 236, "mac": 237}
TRACKS = ("BASE", "REMAP", "ALPHA", "LUMINANCE")
CHANNELS = ("base_r", "base_g", "base_b", "remap_mask", "remap_r", "remap_g", "remap_b", "alpha")


def classify_pixel(idx: Column, platform: str = "pc") -> Column:
    """skip, remap or base."""
    return F.when(idx == SKIP, "skip").when(idx >= REMAP_FROM[platform], "remap").otherwise("base")


def apply_palette(pixels: DataFrame, palette: DataFrame, keys: tuple[str, ...] = ("idx",)) -> DataFrame:
    """pixels with r, g, b, by an equi-join; what is broadcast is left to the sizes that the optimizer knows."""
    return pixels.join(palette.select(*keys, "r", "g", "b"), list(keys))


def split_layers(coloured: DataFrame, variant: str = "A", platform: str = "pc") -> DataFrame:
    """Adds base_r/g/b, remap_mask, remap_r/g/b, alpha. Variant B keeps base colours under remapped pixels."""
    kind = classify_pixel(F.col("idx"), platform)
    base = (kind == "base") | ((kind == "remap") & F.lit(variant == "B"))
    on = lambda cond, c: F.when(cond, F.col(c)).otherwise(0).cast("int")
    return coloured.select(
        "*", *[on(base, c).alias(f"base_{c}") for c in "rgb"], F.when(kind == "remap", 255).otherwise(0).alias("remap_mask"),
        *[on(kind == "remap", c).alias(f"remap_{c}") for c in "rgb"], F.when(kind == "skip", 0).otherwise(255).alias("alpha"),
    )


def luminance(r: Column, g: Column, b: Column, idx: Column) -> Column:
    """Integer luminance in single precision; 0 for skipped pixels."""
    f = lambda c: c.cast("float")
    w = lambda x: F.lit(x).cast("float")
    return F.when(idx == SKIP, 0).otherwise((w(0.299) * f(r) + w(0.587) * f(g) + w(0.114) * f(b)).cast("int"))


def compose_rgba(layered: DataFrame) -> DataFrame:
    """Adds out_r, out_g, out_b, out_a: remapped colours over base colours."""
    pick = lambda c: F.when(F.col("alpha") == 0, 0).when(F.col("remap_mask") > 0, F.col(f"remap_{c}")).otherwise(F.col(f"base_{c}"))
    return layered.select("*", *[pick(c).alias(f"out_{c}") for c in "rgb"], F.when(F.col("alpha") == 0, 0).otherwise(255).alias("out_a"))


def alpha_mask(idx: Column) -> Column:
    """Inverted: 255 where nothing is drawn, outside the frame (null) too."""
    return F.when(F.coalesce(idx, F.lit(SKIP)) == SKIP, 255).otherwise(0)


def unpivot_channels(layered: DataFrame, keys: list[str], with_index: bool = False) -> DataFrame:
    """A row per pixel and channel: keys, layer, value."""
    names = [*CHANNELS, *(["pixel_index"] if with_index else [])]
    wide = layered.withColumn("pixel_index", F.col("idx").cast("int")) if with_index else layered
    return wide.select(*keys, *names).unpivot(keys, names, "layer", "value")


def unpivot_tracks(layered: DataFrame, keys: list[str]) -> DataFrame:
    """A row per pixel and track, with r, g, b."""
    lum = luminance(F.col("r"), F.col("g"), F.col("b"), F.col("idx"))
    mask = alpha_mask(F.col("idx"))
    of = {"BASE": ("base_r", "base_g", "base_b"), "REMAP": ("remap_r", "remap_g", "remap_b")}
    tracks = [F.struct(F.lit(t).alias("layer"), *[(F.col(of[t][i]) if t in of else mask if t == "ALPHA" else lum).cast("int").alias(f"v{c}") for i, c in enumerate("rgb")]) for t in TRACKS]
    return layered.select(*keys, F.explode(F.array(*tracks)).alias("t")).select(*keys, "t.*")


def clip_to(df: DataFrame, w: int, h: int) -> DataFrame:
    return df.where((F.col("x") >= 0) & (F.col("x") < w) & (F.col("y") >= 0) & (F.col("y") < h))


def shift(df: DataFrame, dx: Column | int, dy: Column | int) -> DataFrame:
    return df.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy})


def visible_bbox(pixels: DataFrame, by: list[str], visible: Column | None = None) -> DataFrame:
    """min_x, min_y, max_x, max_y, w, h of the pixels that are not skipped; nulls where there are none."""
    seen = (F.col("idx") != SKIP) if visible is None else visible
    at = lambda c: F.when(seen, F.col(c))
    box = pixels.groupBy(*by).agg(F.min(at("x")).alias("min_x"), F.min(at("y")).alias("min_y"), F.max(at("x")).alias("max_x"), F.max(at("y")).alias("max_y"))
    return box.select("*", (F.col("max_x") - F.col("min_x") + 1).alias("w"), (F.col("max_y") - F.col("min_y") + 1).alias("h"))


def tight_crop(pixels: DataFrame, by: list[str]) -> DataFrame:
    """pixels moved so that their group's visible box starts at (0, 0), cut to it."""
    box = visible_bbox(pixels, by)
    on = pixels.join(box, by)
    return on.where(F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y"))).select(*[c for c in pixels.columns if c not in ("x", "y")], (F.col("x") - F.col("min_x")).alias("x"), (F.col("y") - F.col("min_y")).alias("y"))


def max_extents(cels: DataFrame, by: list[str]) -> DataFrame:
    """Even width and height that hold all cels; sums wrap at 16 bits. Frames without pictures, too large ones and ones with over 100 cels are left out."""
    ok = cels.where(F.col("video_size").between(1, 1_000_000) & (F.col("count") <= 100))
    most = ok.groupBy(*by).agg(F.max(wrap(F.col("x") + F.col("w"))).alias("w"), F.max(wrap(F.col("y") + F.col("h"))).alias("h"))
    return most.select(*by, align_up(F.col("w"), 2).alias("max_w"), align_up(F.col("h"), 2).alias("max_h"))


def fragment_bbox(fragments: DataFrame, by: list[str], mode: str = "spec") -> DataFrame:
    """min_x, min_y, max_x, max_y; fragments have no height, so max_y is null, or in mode compat what it starts with, -32767."""
    top = F.lit(None if mode == "spec" else -32767).cast("bigint")
    return fragments.groupBy(*by).agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max(F.col("x") + F.col("width")).alias("max_x"), top.alias("max_y"))


def has_mixed_size(frames: DataFrame, by: list[str], w: Column, h: Column) -> DataFrame:
    return frames.groupBy(*by).agg(F.bool_or((F.col("w") != w) | (F.col("h") != h)).alias("mixed"))


def expand_rows(rows: DataFrame, height: Column, scale: Column, row: str = "k") -> DataFrame:
    """Source rows k = 0, 1, ... of max(1, height * scale / 100) stretched to height rows: a row per output row, out_row."""
    h = height.cast("bigint")
    source = F.greatest(F.lit(1).cast("bigint"), F.floor(h * scale / 100))
    k = F.col(row)
    start, stop = F.floor(k * h / source), F.floor((k + 1) * h / source)
    return rows.where(k < source).where(stop > start).withColumn("out_row", F.explode(F.sequence(start, stop - 1)))


def expand_runs(runs: DataFrame, keys: list[str], count: str = "count", order: str = "ord") -> DataFrame:
    """Runs (order, value, count) to single values at places pos."""
    at = scan(runs.where(F.col(count) > 0), keys, [order], count, "sum", before=True, out="_at").withColumn("_at", F.coalesce("_at", F.lit(0).cast("bigint")))
    return at.withColumn("pos", F.explode(F.sequence(F.col("_at"), F.col("_at") + F.col(count) - 1))).select(*keys, "pos", "value")


def collapse_runs(values: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Neighbouring equal values as runs (run, start, count, value)."""
    by = Window.partitionBy(*keys).orderBy(*order)
    new = F.when(F.lag("value").over(by).eqNullSafe(F.col("value")) & (F.row_number().over(by) > 1), 0).otherwise(1)
    numbered = values.withColumn("_new", new).withColumn("_n", F.row_number().over(by) - 1)
    numbered = numbered.withColumn("run", F.sum("_new").over(by) - 1)
    return numbered.groupBy(*keys, "run").agg(F.min("_n").alias("start"), F.count("*").alias("count"), F.first("value").alias("value"))


def normalize_u8(value: Column) -> Column:
    return (value.cast("float") / F.lit(255).cast("float")).cast("float")


def overlay_runs(runs: DataFrame, line: list[str], order: list[str], value: str = "idx") -> DataFrame:
    """Runs (line, order, start, count, value) laid over one another: line, start, count, value, where the last writer shows.

    Each line is cut at every run's ends. Between two neighbouring cuts all pixels have the same writers, so one row takes the
    place of as many pixels; neighbouring intervals of one value become one run again. A line is a row of a frame, so
    windows see at most twice the runs of it.
    """
    live = runs.where(F.col("count") > 0).select(*line, *order, "start", (F.col("start") + F.col("count")).alias("_end"), value)
    by = Window.partitionBy(*line).orderBy("_from")
    cuts = live.select(*line, F.explode(F.array("start", "_end")).alias("_from")).distinct().withColumn("_to", F.lead("_from").over(by)).where("_to is not null")
    cuts = cuts.select(*[F.col(k).alias(f"_{k}") for k in line], "_from", "_to")
    same = [live[k].eqNullSafe(cuts[f"_{k}"]) for k in line]
    on = live.join(cuts, [*same, F.col("start") <= F.col("_from"), F.col("_from") < F.col("_end")])
    top = on.groupBy(*line, "_from", "_to").agg(F.max_by(value, F.struct(*order)).alias(value))
    joined = (F.lag("_to").over(by) == F.col("_from")) & F.lag(value).over(by).eqNullSafe(F.col(value))
    numbered = top.withColumn("_new", F.when(joined, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(by))
    return numbered.groupBy(*line, "_run", value).agg(F.min("_from").alias("start"), (F.max("_to") - F.min("_from")).alias("count")).select(*line, "start", "count", value)


def runs_bbox(runs: DataFrame, by: list[str], value: str = "idx") -> DataFrame:
    """visible_bbox() from runs: their ends are all that it needs."""
    seen = lambda c: F.when((F.col(value) != SKIP) & (F.col("count") > 0), c)
    box = runs.groupBy(*by).agg(F.min(seen(F.col("start"))).alias("min_x"), F.min(seen(F.col("y"))).alias("min_y"), F.max(seen(F.col("start") + F.col("count") - 1)).alias("max_x"), F.max(seen(F.col("y"))).alias("max_y"))
    return box.select("*", (F.col("max_x") - F.col("min_x") + 1).alias("w"), (F.col("max_y") - F.col("min_y") + 1).alias("h"))
