"""Catalogue and summary reports as tables, and their text or JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bytes import hex_lower
from ..functions.clips import canvas_size
from ..operators.ordered import first_per_group


def catalog_lines(index: DataFrame) -> DataFrame:
    """type, number, line of a merged index."""
    volume = F.when(F.col("volume") == 0, F.lit("")).otherwise(F.concat(F.lit(", Volume: "), F.col("volume").cast("string")))
    line = F.concat(F.col("number").cast("string"), F.lit(" -> Offset: "), F.col("offset").cast("string"), F.lit(" (0x"), hex_lower(F.col("offset")), F.lit(")"), volume)
    return index.select("type", "number", line.alias("line"))


def write_catalog(index: DataFrame, path: str) -> None:
    catalog_lines(index).orderBy("type", "number").select("line").write.text(path)


def position_lines(positions: DataFrame) -> DataFrame:
    """clip_id, ord, line: all positions, duplicates too, padded to 10, 6 and 6 characters."""
    pad = lambda c, n: F.rpad(F.col(c).cast("string"), F.greatest(F.lit(n), F.length(F.col(c).cast("string"))), F.lit(" "))
    return positions.select("clip_id", "ord", F.concat(pad("clip_id", 10), pad("x", 6), pad("y", 6)).alias("line"))


def write_positions(positions: DataFrame, path: str) -> None:
    position_lines(positions).orderBy("clip_id", "ord").select("line").write.text(path)


def write_cues(cues: DataFrame, path: str) -> None:
    cues.select(F.col("cue_no").alias("index"), F.col("t").alias("time"), F.col("v").alias("value")).orderBy("index").write.csv(path, header=True)


def nest_clips(fragments: DataFrame) -> DataFrame:
    """A row per clip: clip_id, frames as an ordered array of (frame, fragments as an ordered array of (x, y, width)). Clips without frames have no row."""
    frames = fragments.groupBy("clip_id", "frame_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("fragment_no", "x", "y", "width"))), lambda f: F.struct(f["x"].alias("x"), f["y"].alias("y"), f["width"].alias("width"))).alias("fragments"))
    return frames.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct(F.col("frame_no").alias("frame"), "fragments"))).alias("frames"))


def clips_json(fragments: DataFrame) -> DataFrame:
    return nest_clips(fragments).select("clip_id", F.to_json(F.struct(F.col("clip_id").alias("robot"), "frames")).alias("json"))


def first_position_lines(fragments: DataFrame, valid: Column | None = None) -> DataFrame:
    """clip_id, line of each clip's first fragment of its first frame; clips where that one is not valid are left out."""
    top = first_per_group(fragments, ["clip_id"], ["frame_no", "fragment_no"], valid)
    return top.select("clip_id", F.format_string("%4d %4d %4d", F.col("clip_id").cast("int"), F.col("x").cast("int"), F.col("y").cast("int")).alias("line"))


def write_by_clip(df: DataFrame, path: str) -> None:
    """One folder per clip."""
    df.write.partitionBy("clip_id").parquet(path)


def clip_metadata(clips: DataFrame, extents: DataFrame, positions: DataFrame, canvas: tuple[Column | int, Column | int] | None = None) -> DataFrame:
    """A row per clip from its header (clip_id, frames, fps, palette_size, has_audio), its extents (clip_id, max_w, max_h) and its position (clip_id, x, y): each has one row a clip. canvas overrides the size of the canvas of clips with a position; it may be columns of clips."""
    given = [] if canvas is None else [(v if isinstance(v, Column) else F.lit(v)).alias(n) for v, n in zip(canvas, ("_cw", "_ch"), strict=True)]
    on = clips.select("clip_id", "frames", "fps", "palette_size", "has_audio", *given).join(extents, "clip_id", "left").join(positions.select("clip_id", "x", "y"), "clip_id", "left")
    seconds = F.when(F.col("fps") > 0, F.round(F.col("frames") / F.greatest(F.col("fps"), F.lit(1)), 2))
    w, h = canvas_size(F.col("x").isNotNull(), F.col("max_w"), F.col("max_h"), (F.col("_cw"), F.col("_ch")) if given else None)
    return on.select("clip_id", "frames", "fps", seconds.alias("seconds"), w.alias("canvas_w"), h.alias("canvas_h"), "x", "y", "has_audio", F.floor(F.col("palette_size") / 3).alias("colours"))


def cel_positions(cels: DataFrame, extents: DataFrame | None = None) -> DataFrame:
    """clip_id, frame_no, x, y, w, h of each frame's first cel. With extents (clip_id, max_w, max_h), as in mode compat, w and h are the clip's, or the usual canvas where it has none."""
    first = cels.groupBy("clip_id", "frame_no").agg(F.min_by(F.struct("x", "y", "w", "h"), "cel_no").alias("_c")).select("clip_id", "frame_no", "_c.*")
    if extents is None:
        return first
    usable = lambda c: F.when((F.col("max_w") > 0) & (F.col("max_h") > 0), F.col(c))
    w, h = canvas_size(F.lit(False), usable("max_w"), usable("max_h"))
    return first.drop("w", "h").join(extents, "clip_id", "left").select("clip_id", "frame_no", "x", "y", w.alias("w"), h.alias("h"))


def clip_json_pieces(fragments: DataFrame) -> DataFrame:
    """clip_id, frame_no, fragment_no, piece: the JSON of clips_json() cut behind each fragment. In order of the first three the pieces give it whole. Only a frame's fragments meet in a window; where a clip begins and ends comes from an aggregate."""
    w = Window.partitionBy("clip_id", "frame_no").orderBy("fragment_no", "x", "y", "width")
    ends = fragments.groupBy(F.col("clip_id").alias("_clip")).agg(F.min("frame_no").alias("_first"), F.max("frame_no").alias("_last"))
    flagged = fragments.select("clip_id", "frame_no", "fragment_no", "x", "y", "width", (F.row_number().over(w) == 1).alias("_opens"), F.lead(F.lit(1)).over(w).isNull().alias("_closes"))
    rows = flagged.join(ends, flagged["clip_id"].eqNullSafe(ends["_clip"]))
    opens, closes, text = F.col("_opens"), F.col("_closes"), lambda x: F.lit(x)
    clip_json, frame_json = F.to_json(F.struct(F.col("clip_id").alias("robot"))), F.to_json(F.struct(F.col("frame_no").alias("frame")))
    head = lambda j, name: F.concat(F.substring(j, F.lit(1), F.length(j) - 1), text(f',"{name}":['))
    piece = F.concat(
        F.when(opens & (F.col("frame_no") == F.col("_first")), head(clip_json, "frames")).otherwise(""), F.when(opens, head(frame_json, "fragments")).otherwise(""),
        F.to_json(F.struct("x", "y", "width")),
        F.when(~closes, text(",")).when(F.col("frame_no") < F.col("_last"), text("]},")).otherwise(text("]}]}")),
    )
    return rows.select("clip_id", "frame_no", "fragment_no", "x", "y", "width", piece.alias("piece"))


def write_clips_json(fragments: DataFrame, path: str, parts: int | None = None) -> None:
    """Writes clips_json() as text: files in order of name, a line behind each fragment, a JSON document a clip. A clip of any size is written in order by as many tasks as its fragments fill, none of which holds it."""
    order = ["clip_id", "frame_no", "fragment_no", "x", "y", "width"]
    pieces = clip_json_pieces(fragments)
    (pieces.repartitionByRange(parts, *order) if parts else pieces.repartitionByRange(*order)).sortWithinPartitions(*order).select("piece").write.text(path)
