"""Sound packets to samples: difference codes, channels, overlay and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bytes import wrap_signed
from ..functions.codes import magnitude
from .ordered import BUCKET, _same, overlay, scan, with_neighbours

RUNWAY = 8


def attach_audio(frames: DataFrame, most: int = 10 << 20) -> DataFrame:
    """Where each frame's sound header lies: after its pictures. Frames without either, and bad sizes, carry none."""
    ok = (F.col("packet_size") > 0) & (F.col("video_size") > 0)
    at = frames.where(ok).withColumn("audio_pos", F.col("record_pos") + F.col("video_size")).withColumn("audio_size", F.col("packet_size") - F.col("video_size"))
    return at.where((F.col("audio_pos") >= 0) & F.col("audio_size").between(1, most))


def wrapping_cumsum(codes: DataFrame, packet: list[str], order: list[str], code: str = "code") -> DataFrame:
    """Adds sample: the running sum of the codes' steps, from 0 in each packet, in 16 bits. Packets are short, so tasks are even whatever a clip's length."""
    w = Window.partitionBy(*packet).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return codes.withColumn("sample", wrap_signed(F.sum(magnitude(F.col(code))).over(w)))


def saturating_samples(codes: DataFrame, packet: list[str], order: str = "ord", code: str = "code", block: int = 128, levels: int = 2) -> DataFrame:
    """packet, order and sample: as wrapping_cumsum, but each step is clipped to 16 bits, so that order matters.

    A clipped addition is a function x -> min(high, max(low, x + shift)), and such functions are closed under composition. So
    a packet is folded in blocks of so many neighbouring places of order: each block's functions are composed, the starts
    of blocks follow from the functions of those before (which are folded in blocks again, levels times), and each block's
    samples from its start. No list is longer than a block, but for the last level's.
    """
    bits = (block - 1).bit_length()
    own = codes.select(*packet, F.col(order).cast("bigint").alias("at"), magnitude(F.col(code)).cast("bigint").alias("shift"), F.lit(-32768).cast("bigint").alias("low"), F.lit(32767).cast("bigint").alias("high"))
    blocks = _blocks(own, packet, bits)
    starts = _starts(_composed(blocks, packet), packet, bits, levels - 1).select(*[F.col(k).alias(f"_{k}") for k in [*packet, "at"]], "start")
    on = blocks.join(starts, _same(blocks, starts, [*packet, "at"]))
    return on.select(*packet, F.explode(_walk("f", "start")).alias("_s")).select(*packet, F.col("_s.at").alias(order), F.col("_s.value").cast("int").alias("sample"))


def _blocks(functions: DataFrame, packet: list[str], bits: int | None) -> DataFrame:
    """Functions (at, shift, low, high) listed in order in blocks of places (at: the block's number), or all of a packet in one."""
    block = F.lit(0).cast("bigint") if bits is None else F.shiftright("at", bits)
    return functions.groupBy(*packet, block.alias("_block")).agg(F.array_sort(F.collect_list(F.struct("at", "shift", "low", "high"))).alias("f")).withColumnRenamed("_block", "at")


def _clip(value: Column, f: Column) -> Column:
    return F.greatest(f["low"], F.least(f["high"], value))


def _composed(blocks: DataFrame, packet: list[str]) -> DataFrame:
    """Each block's functions as one function."""
    none = F.struct(F.lit(0).cast("bigint").alias("shift"), F.lit(-(1 << 40)).alias("low"), F.lit(1 << 40).alias("high"))
    both = lambda a, f: F.struct((a["shift"] + f["shift"]).alias("shift"), _clip(a["low"] + f["shift"], f).alias("low"), _clip(a["high"] + f["shift"], f).alias("high"))
    return blocks.select(*packet, "at", F.aggregate("f", none, both).alias("_f")).select(*packet, "at", "_f.*")


def _walk(functions: str, start: str) -> Column:
    """(at, before, value) of each function of a block, from the value at its start."""
    first = F.struct(F.col(start).alias("now"), F.array().cast("array<struct<at:bigint,before:bigint,value:bigint>>").alias("out"))
    step = lambda a, f: F.struct(_clip(a["now"] + f["shift"], f).alias("now"), F.concat(a["out"], F.array(F.struct(f["at"].alias("at"), a["now"].alias("before"), _clip(a["now"] + f["shift"], f).alias("value")))).alias("out"))
    return F.aggregate(functions, first, step, lambda a: a["out"])


def _starts(functions: DataFrame, packet: list[str], bits: int, levels: int) -> DataFrame:
    """at and start: the value that each function of a packet begins with, 0 for the first."""
    blocks = _blocks(functions, packet, bits if levels else None)
    if levels:
        starts = _starts(_composed(blocks, packet), packet, bits, levels - 1).select(*[F.col(k).alias(f"_{k}") for k in [*packet, "at"]], "start")
        blocks = blocks.join(starts, _same(blocks, starts, [*packet, "at"]))
    else:
        blocks = blocks.withColumn("start", F.lit(0).cast("bigint"))
    return blocks.select(*packet, F.explode(_walk("f", "start")).alias("_s")).select(*packet, F.col("_s.at").alias("at"), F.col("_s.before").alias("start"))


def saturating_cumsum(codes: DataFrame, packet: list[str], order: str = "ord", code: str = "code") -> DataFrame:
    """(packet, samples): the samples of saturating_samples() as one list a packet."""
    listed = F.array_sort(F.collect_list(F.struct(order, "sample")))
    return saturating_samples(codes, packet, order, code).groupBy(*packet).agg(F.transform(listed, lambda s: s["sample"]).alias("samples"))


def stereo_cumsum(codes: DataFrame, packet: list[str], order: str = "ord", code: str = "code") -> DataFrame:
    """wrapping_cumsum with left and right codes taking turns."""
    return wrapping_cumsum(codes.withColumn("side", F.pmod(F.col(order), F.lit(2))), [*packet, "side"], [order], code)


def skip_runway(samples: DataFrame, order: str = "ord", n: int = RUNWAY) -> DataFrame:
    return samples.where(F.col(order) >= n)


def interleave(packets: DataFrame, primers: DataFrame, total: str = "total") -> DataFrame:
    """Places of samples in the clip. packets: clip_id, frame_no, abs_pos, ord (runway skipped), sample, total; primers: clip_id, side (0 even, 1 odd), ord, sample, total. Adds rank, the order of writing: even primer, odd primer, frames."""
    a = primers.select("clip_id", (2 * F.col("ord") + F.col("side")).cast("bigint").alias("pos"), F.col("side").cast("bigint").alias("rank"), F.col("sample").alias("value"), total)
    b = packets.select("clip_id", (F.col("abs_pos") + 2 * (F.col("ord") - RUNWAY)).cast("bigint").alias("pos"), (F.col("frame_no") + 2).cast("bigint").alias("rank"), F.col("sample").alias("value"), total)
    return a.unionByName(b).where((F.col("pos") >= 0) & (F.col("pos") < F.col(total)))


def resolve(samples: DataFrame, mode: str = "spec") -> DataFrame:
    """One sample a place: the first writer's (spec) or the last one's (compat)."""
    return overlay(samples, ["clip_id", "pos"], ["rank"], mode="first" if mode == "spec" else "last")


def interpolate(samples: DataFrame, sizes: DataFrame, mode: str = "spec", bucket_rows: int = BUCKET) -> DataFrame:
    """All places 0..size-1 of each clip. spec: places without a sample get half the sum of their neighbours' (a missing neighbour: the other; none: 0). compat: all even places from their odd neighbours, then all odd ones from the new even ones. A place depends on the next one or two, so clips are cut into buckets whose border rows are known on both sides."""
    marked = _dense(samples, sizes, bucket_rows)
    if mode == "spec":
        near = with_neighbours(marked.drop("_size"), "pos", 1, 1, bucket_rows)
        w = Window.partitionBy("clip_id", "_bucket").orderBy("pos")
        prev, following = F.lag("value").over(w), F.lead("value").over(w)
        filled = F.coalesce(F.shiftright(prev + following, 1), prev, following, F.lit(0))
        return near.withColumn("value", F.coalesce("value", filled).cast("int")).where(~F.col("_guest")).select("clip_id", "pos", "value")
    pairs = marked.withColumn("k", F.floor(F.col("pos") / 2)).where(F.col("pos") < 2 * F.floor(F.col("_size") / 2))
    odd = pairs.where(F.col("pos") % 2 == 1).select("clip_id", "k", F.coalesce("value", F.lit(0)).alias("o"), (F.col("k") + 1 == F.floor(F.col("_size") / 2)).alias("_end"))
    k = Window.partitionBy("clip_id", "_bucket").orderBy("k")
    even = with_neighbours(odd, "k", 2, 1, bucket_rows).withColumn("e", F.coalesce(F.shiftright(F.col("o") + F.lag("o").over(k), 1), F.col("o")))
    new = even.withColumn("o2", F.shiftright(F.col("e") + F.lead("e").over(k), 1))
    # the last odd place repeats the odd one before it, or the only even one
    new = new.withColumn("o2", F.when(F.col("_end"), F.coalesce(F.lag("o2").over(k), "e")).otherwise(F.col("o2"))).where(~F.col("_guest"))
    return new.select("clip_id", F.explode(F.array(F.struct((2 * F.col("k")).cast("bigint").alias("pos"), F.col("e").cast("int").alias("value")), F.struct((2 * F.col("k") + 1).cast("bigint").alias("pos"), F.col("o2").cast("int").alias("value")))).alias("s")).select("clip_id", "s.*")


def _dense(samples: DataFrame, sizes: DataFrame, bucket_rows: int) -> DataFrame:
    """A row a place; a clip's places are made by many tasks, a bucket each."""
    size, n = F.col("_size").cast("bigint"), F.lit(bucket_rows).cast("bigint")
    buckets = sizes.where("size > 0").select("clip_id", F.col("size").alias("_size")).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((size - 1) / n)))).repartition("clip_id", "_b")
    every = buckets.withColumn("pos", F.explode(F.sequence(F.col("_b") * n, F.least(size, (F.col("_b") + 1) * n) - 1))).drop("_b")
    return every.join(samples.select("clip_id", F.col("pos").cast("bigint").alias("pos"), "value"), ["clip_id", "pos"], "left")


def audio_packet_stats(samples: DataFrame) -> DataFrame:
    """Packets and samples of each clip and channel."""
    return samples.groupBy("clip_id", "channel").agg(F.countDistinct("frame_no").alias("packets"), F.count("*").alias("samples"))


def drop_consumed(packets: DataFrame, order: list[str], end: str = "end", bucket_rows: int | None = BUCKET) -> DataFrame:
    """Packets that end beyond all that has been read of their channel before."""
    read = scan(packets, ["clip_id", "channel"], order, end, "max", bucket_rows, before=True, out="_read")
    return read.where(F.col(end) > F.coalesce("_read", F.lit(0).cast("bigint"))).drop("_read")
