"""Placement, time and rendering arithmetic of clips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Screen sizes in the order in which a clip's size is tried.
RESOLUTIONS = [(630, 450), (640, 480), (640, 400), (320, 240), (320, 200)]


def channel(position: Column) -> Column:
    """0 for even, 1 for odd sample positions."""
    return F.pmod(position, F.lit(2))


def duration(frames: Column, fps: Column) -> Column:
    return F.try_divide(frames.cast("double"), fps.cast("double"))


def samples_per_frame(fps: Column, rate: int = 22050) -> Column:
    # the greatest() only keeps the unused branch from dividing by zero
    return F.when(fps > 0, F.floor(F.lit(rate) / F.greatest(fps, F.lit(1)))).otherwise(F.lit(rate // 10))


def expected_samples(frames: Column, fps: Column, rate: int = 22050) -> Column:
    return frames * samples_per_frame(fps, rate)


def fit_resolution(w: Column, h: Column, mode: str = "compat") -> Column:
    """A screen size that holds (w, h) as struct(w, h), or (w, h) itself. "compat": the first of the list; "spec": the least in area."""
    own = F.struct(w.cast("int").alias("w"), h.cast("int").alias("h"))
    order = RESOLUTIONS if mode == "compat" else sorted(RESOLUTIONS, key=lambda s: s[0] * s[1])
    out = own
    for a, b in reversed(order):
        out = F.when((w <= a) & (h <= b), F.struct(F.lit(a).alias("w"), F.lit(b).alias("h"))).otherwise(out)
    return out


def render_mode(found: Column, x: Column, y: Column, rule: str = "A") -> Column:
    """canvas or crop. Rule A asks for a position; rule B also for one other than (0, 0)."""
    ok = found if rule == "A" else found & ((x != 0) | (y != 0))
    return F.when(F.coalesce(ok, F.lit(False)), F.lit("canvas")).otherwise(F.lit("crop"))


def canvas_size(found: Column, max_w: Column, max_h: Column, canvas: tuple[Column | int, Column | int] | None = None) -> tuple[Column, Column]:
    """Width and height of what a clip is drawn on: with a position the given canvas (where it is null or not above 0, the
    usual one), else the extents of its pictures, or the usual canvas if it has none."""
    def one(i: int, most: Column) -> Column:
        usual = F.lit(RESOLUTIONS[0][i])
        given = F.lit(None).cast("int") if canvas is None else canvas[i] if isinstance(canvas[i], Column) else F.lit(canvas[i])
        return F.when(F.coalesce(found, F.lit(False)), F.when(given > 0, given).otherwise(usual)).otherwise(F.coalesce(most, usual))

    return one(0, max_w), one(1, max_h)


def place(px: Column, py: Column, cx: Column, cy: Column, h: Column, mode: str = "compose", canvas: Column | bool = True) -> tuple[Column, Column]:
    """Where a cel goes. "compose" adds the clip's position on a canvas; "helper" also takes the cel's height off y."""
    on = F.lit(canvas) if isinstance(canvas, bool) else canvas
    x, y = cx + F.when(on, px).otherwise(F.lit(0)), cy + F.when(on, py).otherwise(F.lit(0))
    return (x, y - h) if mode == "helper" else (x, y)


def centred(w: Column, h: Column, screen: tuple[int, int] = (640, 480)) -> tuple[Column, Column]:
    half = lambda a, b: truncated(F.lit(a) - b, 2)
    return half(screen[0], w), half(screen[1], h)


def truncated(numerator: Column, denominator: int) -> Column:
    """Integer division toward zero."""
    q = numerator / F.lit(denominator)
    return F.when(numerator >= 0, F.floor(q)).otherwise(F.ceil(q)).cast("bigint")


def lowres_to_screen(v: Column, ratio: tuple[int, int]) -> Column:
    return truncated(v * ratio[0], ratio[1])


def manual_scale(x: Column, s: Column) -> Column:
    return truncated(x * s, 128)


def valid_position(id_: Column, x: Column, y: Column) -> Column:
    """Bounds of positions found in scripts."""
    return id_.between(1, 9999) & x.between(-100, 740) & y.between(-100, 580)


def valid_fragment(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Bounds of fragments found in frames."""
    return x.between(-100, 700) & y.between(-100, 550) & w.between(1, 640) & h.between(1, 480)


def frame_reject_reason(count: Column, w: Column, h: Column, data_size: Column, chunks: Column) -> Column:
    """Why a frame is skipped: the first rule that it breaks, or null."""
    return (
        F.when(count > 10, F.lit("count")).when((w <= 0) | (h <= 0), F.lit("empty")).when(w.cast("bigint") * h >= 20_000_000, F.lit("area"))
        .when(~data_size.between(1, 200_000), F.lit("data_size")).when(~chunks.between(1, 100), F.lit("chunks"))
    )


def call_site(opcode: Column, id_: Column, argc: Column) -> Column:
    return (opcode == 0x76) & id_.isin(57, 67, 74, 84) & argc.between(4, 6)
