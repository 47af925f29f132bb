"""What the catalogue's operators do with one huge sequence, against windows, loops and pixel forms."""

import json
import random
import struct
import time
from pathlib import Path

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from reelgrid.functions import bytes as by
from reelgrid.functions import codes
from reelgrid.operators import durable, ordered, pixels, sound
from reelgrid.plans import reports
from reelgrid.sources import files

c = F.col


@pytest.mark.parametrize("how", ["sum", "max", "last"])
@pytest.mark.parametrize("before", [False, True])
def test_scan_equals_a_window(spark, how, before):
    rng = random.Random(how)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, *range(-300, 300)]), i, rng.choice([None, None, *range(-50, 50)])) for i in range(1500)]
    rows += [("long", 10**12 * i, i, i if i % 3 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, pos long, tie int, v long").repartition(5)
    one = {"sum": F.sum, "max": F.max, "last": lambda x: F.last(x, ignorenulls=True)}[how]
    w = Window.partitionBy("k").orderBy("pos", "tie").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    want = sorted(df.select("k", "pos", "tie", one("v").over(w).alias("s")).collect(), key=repr)
    for bucket, levels in ((16, 2), (4, 3), (1024, 2), (2, 5), (None, 2)):
        got = ordered.scan(df, ["k"], ["pos", "tie"], "v", how, bucket, before=before, levels=levels, out="s").select("k", "pos", "tie", "s")
        assert sorted(got.collect(), key=repr) == want, (bucket, levels)
    assert ordered.scan(df.where("false"), ["k"], ["pos", "tie"], "v", how).count() == 0


def spread(df):
    """Rows of each partition that has any."""
    return sorted(r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())


def test_one_huge_clip_spreads(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        clip = F.when(c("id") < 90_000, 0).otherwise(c("id"))
        rows = spark.range(100_000).select(clip.alias("clip_id"), c("id").alias("frame_no"), (c("id") % 7).alias("packet_size"), (c("id") % 2).alias("channel"))
        offsets = ordered.record_offsets(rows, ["clip_id"], ["frame_no"], bucket_rows=512)
        sizes = spread(offsets)
        assert len(sizes) > 4 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
        assert offsets.where("frame_no = 89999").first()["record_pos"] == sum(i % 7 for i in range(89999))
        samples = rows.where("clip_id = 0 and frame_no % 3 = 0").select("clip_id", c("frame_no").alias("pos"), c("packet_size").cast("int").alias("value"))
        filled = sound.interpolate(samples, spark.createDataFrame([(0, 90_000)], "clip_id long, size long"), bucket_rows=512)
        sizes = spread(filled)
        assert sum(sizes) == 90_000 and len(sizes) > 4 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_all_running_operators_by_small_buckets(spark):
    rng = random.Random(8)
    rows = [(k % 3, i, rng.randrange(256), rng.randrange(90)) for k in range(3) for i in range(200)]
    df = spark.createDataFrame(rows, "clip_id int, ord long, code int, offset long").withColumns({"channel": c("ord") % 2, "end": c("offset") + 2 * c("ord"), "tag": F.when(c("code") > 200, c("code"))})
    for make in (
        lambda n: ordered.fill_tags(df, ["clip_id"], ["ord"], bucket_rows=n),
        lambda n: ordered.carry_forward(df, ["clip_id"], ["ord"], "tag", bucket_rows=n),
        lambda n: ordered.monotone_valid(df, ["clip_id"], ["ord"], c("code") > 20, bucket_rows=n),
        lambda n: sound.drop_consumed(df, ["ord"], bucket_rows=n),
    ):
        assert sorted(make(8).collect()) == sorted(make(None).collect())
    top, want = {}, []
    for clip, i, code, offset in rows:
        ok = code > 20 and (offset == 0 or offset >= top.get(clip, 0))
        want.append((clip, i, ok))
        if ok:
            top[clip] = max(top.get(clip, 0), offset)
    assert sorted((r["clip_id"], r["ord"], r["valid"]) for r in ordered.monotone_valid(df, ["clip_id"], ["ord"], c("code") > 20, bucket_rows=16).collect()) == want


def test_ranks_from_bucket_counts(spark):
    df = spark.range(3000).select((c("id") % 2).alias("type"), (c("id") * 37 % 3001).alias("number"))
    want = df.select("type", "number", F.row_number().over(Window.partitionBy("type").orderBy("number")).alias("rank")).collect()
    assert sorted(ordered.ranked(df, ["type"], ["number"], bucket_rows=64).collect()) == sorted(want)


def test_pairs_with_ids_follow_a_loop(spark):
    rng = random.Random(2)
    for length in (3, 40, 700):
        values = [rng.choice([rng.randrange(0, 700), rng.randrange(-1500, 0), rng.randrange(400, 12000)]) for _ in range(length)]
        want = []
        for i in range(length - 5):
            a, b = values[i], values[i + 1]
            if not (0 <= a <= 630 and 0 <= b <= 450):
                continue
            for j in range(max(0, i - 10), i):
                if 1 <= values[j] <= 9999 and all(-1000 <= v <= 10000 for v in values[j + 1 : i]):
                    want.append((i, values[j], a, b))
                    break
        df = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "s string, pos long, value long")
        out = ordered.pair_with_preceding_id(df, ["s"], bucket_rows=16)
        assert sorted(tuple(r)[1:] for r in out.collect()) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_context_of_matches(spark):
    rng = random.Random(3)
    ops = [rng.choice("abcc") for _ in range(500)]
    df = spark.createDataFrame([(1, i, o, None if i % 11 == 0 else i) for i, o in enumerate(ops)], "s int, pos long, op string, v long")
    want = [(i, [j for j in range(max(0, i - 7), min(500, i + 8)) if j % 11]) for i in range(499) if ops[i] == "a" and ops[i + 1] == "b"]
    out = ordered.match_context(df, ["s"], "pos", c("op") == "a", c("op") == "b", "v", 7, bucket_rows=4)
    assert sorted((r["pos"], r["context"]) for r in out.collect()) == want


def test_last_writer_follows_a_loop(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(2), rng.randrange(30), i, rng.choice([255, rng.randrange(250)])) for i in range(600)]
    rng.shuffle(rows)
    shown, heard = {}, {}
    for clip, pos, rank, v in sorted(rows, key=lambda r: r[2]):
        shown[clip, pos] = v
        heard.setdefault((clip, pos), v)
    df = spark.createDataFrame(rows, "clip_id int, pos int, rank int, value int").repartition(6)
    for mode, want in (("last", shown), ("first", heard)):
        assert {(r["clip_id"], r["pos"]): r["value"] for r in ordered.overlay(df, ["clip_id", "pos"], ["rank"], mode=mode).collect()} == want


@pytest.mark.parametrize(("block", "levels"), [(2, 4), (8, 2), (128, 1)])
def test_clipped_sums_follow_a_loop(spark, block, levels):
    rng = random.Random(block)
    rows, want = [], []
    for packet in range(3):
        now, turn = 0, rng.randrange(40)
        for i in range(rng.choice([1, 90, 700])):
            code = rng.randrange(100, 128) + (128 if (i // 40 + turn) % 2 else 0) if rng.random() < 0.8 else rng.randrange(256)
            now = max(-32768, min(32767, now + codes.MAGNITUDES[code & 127] * (-1 if code & 128 else 1)))
            rows.append((packet, i, code))
            want.append((packet, i, now))
    out = sound.saturating_samples(spark.createDataFrame(rows, "packet int, ord int, code int").repartition(3), ["packet"], block=block, levels=levels)
    assert sorted((r["packet"], r["ord"], r["sample"]) for r in out.collect()) == want
    assert any(abs(v) > 32766 for _, _, v in want)


def test_a_packet_of_a_million_codes(spark):
    df = spark.range(1_000_000).select(F.lit(1).alias("packet"), c("id").alias("ord"), (c("id") * 7919 % 256).cast("int").alias("code"))
    now, total = 0, 0
    for i in range(1_000_000):
        k = i * 7919 % 256
        now = max(-32768, min(32767, now + codes.MAGNITUDES[k & 127] * (-1 if k & 128 else 1)))
        total += now
    out = sound.saturating_samples(df, ["packet"]).agg(F.count("*"), F.sum("sample"), F.max_by("sample", "ord")).first()
    assert tuple(out) == (1_000_000, total, now)


def test_first_position_in_bytes(spark):
    rng = random.Random(6)
    raws = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 2, 40, 200, 3000)] + [bytes(2000) + b"\x07\x00" + bytes(50), b"\xff\xff" * 600]
    fits = lambda v, p: (v > 0) & (v < 1000) & (p % 3 == 0)
    want = [next((p for p in range(5, len(r) - 1) if 0 < struct.unpack_from("<H", r, p)[0] < 1000 and p % 3 == 0), None) for r in raws]
    df = spark.createDataFrame(list(enumerate(raws)), "i int, content binary")
    for piece in (3, 64, 512):
        got = df.select("i", by.first_u16(c("content"), 5, F.length("content") - 2, fits, piece).alias("p")).orderBy("i").collect()
        assert [r["p"] for r in got] == want, piece


def test_runs_equal_pixels(spark):
    rng = random.Random(7)
    rows = [(k % 4, rng.randrange(3), rng.randrange(6), i, rng.randrange(-5, 300), rng.choice([0, -2, 1, 80, 90, 200]), rng.choice([255, 3, 4, 240])) for k in range(4) for i in range(40)]
    shown = {}
    for clip, frame, y, cel, start, count, idx in sorted(rows, key=lambda r: r[3]):
        shown |= {(clip, frame, y, x): idx for x in range(start, start + count)}
    df = spark.createDataFrame(rows, "clip_id int, frame_no int, y int, cel_no int, start long, count long, idx int")
    over = pixels.overlay_runs(df, ["clip_id", "frame_no", "y"], ["cel_no"])
    out = over.collect()
    assert {(r["clip_id"], r["frame_no"], r["y"], x): r["idx"] for r in out for x in range(r["start"], r["start"] + r["count"])} == shown
    assert sum(r["count"] for r in out) == len(shown) and len(shown) >= 10 * len(out)
    flat = spark.createDataFrame([(*k[:2], k[3], k[2], v) for k, v in shown.items()], "clip_id int, frame_no int, x long, y int, idx int")
    assert sorted(pixels.runs_bbox(over, ["clip_id", "frame_no"]).collect()) == sorted(pixels.visible_bbox(flat, ["clip_id", "frame_no"]).collect())


def test_long_chain_in_few_rounds(spark):
    n, step = 100_000, 30
    links = spark.range(n).select(F.lit(1).alias("f"), (2 + c("id") * step).alias("pos"), (2 + (c("id") + 1) * step).alias("to"))
    decoys = spark.range(20_000).select(F.lit(1).alias("f"), (3 + c("id") * step).alias("pos"), (9 + (c("id") + 1) * step).alias("to"))
    out = files.follow_chain(links.unionByName(decoys), spark.createDataFrame([(1, 2), (2, 2)], "f int, pos long"), ["f"])
    assert tuple(out.agg(F.count("*"), F.max("rec"), F.sum(F.when(c("pos") == 2 + c("rec") * step, 1)), F.countDistinct("rec")).first()) == (n, n - 1, n, n)


def test_chain_in_pieces_equals_a_loop(spark):
    """Chains across pieces, false candidates that meet them or leave them, repeated and false starts, null keys."""
    rng = random.Random(3)
    keys, links = [None, "a", "b", "c"], {}
    for k in keys[:3]:
        for p in rng.sample(range(3000), 1100):
            links[k, p] = p + rng.choice([1, 2, 3, 5, 40, 700])
    starts = [(k, p) for k in keys for p in (*rng.sample(range(60), 12), 5)] + [("a", 5), ("b", -4)]
    want = []
    for k, p in starts:
        rec = 0
        while (k, p) in links:
            want.append((k, p, rec))
            p, rec = links[k, p], rec + 1
    rows = spark.createDataFrame([(k, p, to) for (k, p), to in links.items()], "k string, pos int, to int").repartition(5)
    begun = spark.createDataFrame(starts, "k string, pos int")
    for piece in (16, 512, 4096):
        got = files.follow_chain(rows, begun, ["k"], piece)
        assert sorted((tuple(r) for r in got.select("k", "pos", "rec").collect()), key=repr) == sorted(want, key=repr), piece
    assert files.follow_chain(rows, begun.where("false"), ["k"]).count() == 0
    assert files.follow_chain(rows.where("false"), begun, ["k"]).count() == 0


def test_links_in_a_circle_are_an_error(spark):
    links = spark.createDataFrame([(1, 2, 30), (1, 30, 60), (1, 60, 2)], "f int, pos long, to long")
    with pytest.raises(Exception, match="links lead in a circle"):
        files.follow_chain(links, spark.createDataFrame([(1, 2)], "f int, pos long"), ["f"]).collect()


def test_chains_leave_little_in_the_shared_folder(spark):
    """40,000 files of 10 records: the links of all rounds together took 40 bytes and more a record."""
    n = 10
    size = lambda: sum(p.stat().st_size for p in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).rglob("*") if p.is_file())
    durable.durable(spark.range(1))
    before = size()
    files_ = spark.range(40_000).select(c("id").alias("f"))
    links = files_.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("f", (2 + c("i") * (22 + c("f") % 7)).alias("pos"), (2 + (c("i") + 1) * (22 + c("f") % 7)).alias("to"))
    out = files.follow_chain(links, files_.select("f", F.lit(2).alias("pos")), ["f"])
    assert tuple(out.agg(F.count("*"), F.max("rec"), F.sum(F.when(c("pos") == 2 + c("rec") * (22 + c("f") % 7), 1))).first()) == (40_000 * n, n - 1, 40_000 * n)
    assert (size() - before) / (40_000 * n) < 15


def test_chain_equals_the_fold(spark):
    rng = random.Random(1)
    body = b""
    for _ in range(300):
        n = rng.randrange(30)
        body += struct.pack("<BBHHHHhhHhI", 0, 100, 1, 1, 0, 0, 5, -6, n, 1, 0) + bytes(rng.choice([0, 100]) for _ in range(n))
    df = spark.createDataFrame([(1, body + b"\0" * 9), (2, b"")], "k int, content binary")
    fold = files.explode_chained(df, c("content"), F.lit(0), F.lit(1000), size_at=14, most=1000).select("k", "rec", "rec_pos").collect()
    links = files.chain_candidates(df, ["k"], c("content"), lambda p: by.u8(c("content"), p) == 0, size_at=14)
    out = files.follow_chain(links, df.select("k", F.lit(0).alias("pos")), ["k"])
    assert sorted((r["k"], r["rec"], r["pos"]) for r in out.collect()) == sorted(tuple(r) for r in fold) and len(fold) >= 300


@pytest.mark.parametrize("ended", [True, False])
def test_long_shard_is_read_in_proportion(spark, ended):
    """9,000 directory entries, or a short directory and 9,000 records behind it, from an expression; each entry once looked through all of them."""
    n = 9000
    directory = b"".join(struct.pack("<BH", 0x80 | i % 22, i) for i in range(n)) if not ended else struct.pack("<BHBH", 0x83, 6, 0xFF, 6 + 6 * n)
    body = b"".join(struct.pack("<HI", i, 70_000 * i) for i in range(n)) if ended else b""
    df = spark.createDataFrame([(1, (directory + body).hex()), (2, "FF0300"), (3, "FF")], "volume int, digits string").select("volume", F.unhex("digits").alias("content"))
    began = time.monotonic()
    out = files.read_directory(df)
    found = sorted(tuple(r) for r in out.select("volume", "ord", "type", "offset").collect() if r["volume"] == 1)
    assert found == ([(1, 0, 3, 6), (1, 1, 31, 6 + 6 * n)] if ended else [(1, i, i % 22, i) for i in range(n)])
    if ended:
        sections = ordered.section_sizes(out, ["volume"], ["ord"], c("file_size")).where("type <> 31")
        records = files.explode_fixed_records(df, sections, df.select("volume", F.lit(6).alias("width"))).collect()
        assert sorted((r["type"], r["number"], r["offset"], r["volume"], r["rec"], r["rec2"]) for r in records) == [(0x83, i, 70_000 * i, 1, 3, i) for i in range(n)]
    assert time.monotonic() - began < 40


def test_volume_is_read_by_ranges(spark, tmp_path):
    path, n, size = tmp_path / "RESSCI.001", 400, 500_000
    with path.open("wb") as f:  # 200 MB
        for i in range(n):
            f.write(struct.pack("<BHIIH", 0, i, size - 13, size, 2) + bytes([i % 256]) * (size - 13))
    volumes = spark.createDataFrame([(1, f"file:{path}", n * size)], "volume int, path string, length long")
    wanted = spark.createDataFrame([(0x88, i, i * size, 1) for i in range(0, n, 20)] + [(0x88, n, n * size - 5, 1), (0x88, n + 1, n * size + 9, 1)], "type int, number int, offset long, volume int")
    out = files.read_resources(wanted, volumes, parts=4)
    assert out.rdd.getNumPartitions() > 2
    rows = {r["number"]: r for r in out.select("*", F.length("content").alias("n"), F.hex(F.substring("content", 7, 1)).alias("byte"), F.spark_partition_id().alias("task")).drop("content").collect()}
    assert all(rows[i]["n"] == size - 13 and rows[i]["byte"] == f"{i % 256:02X}" and rows[i]["reason"] is None and rows[i]["dialect"] == "13" for i in range(0, n, 20))
    assert rows[n]["reason"] == rows[n + 1]["reason"] == "short header" and rows[n]["n"] is None
    assert len({r["task"] for r in rows.values()}) > 1
    some = spark.createDataFrame([(str(path), 0, 3, "x"), (str(path), -1, 3, "y"), (str(path), n * size - 1, 2, "z"), (str(path), n * size, 0, "w")], "path string, offset long, length long, name string")
    assert {r["name"]: r["content"] and bytes(r["content"]) for r in files.read_ranges(some).collect()} == {"x": b"\0\0\0", "y": None, "z": None, "w": b""}


def test_json_of_a_huge_clip(spark, tmp_path):
    big = spark.range(120_000).select(F.lit(7).alias("clip_id"), F.floor(c("id") / 40).alias("frame_no"), (c("id") % 40).alias("fragment_no"), (c("id") % 9).alias("x"), (c("id") % 5).alias("y"), (c("id") % 3).alias("width"))
    small = spark.createDataFrame([(1, 3, 0, 1, 2, 3), (1, 3, 2, 4, 5, 6), (1, 9, 0, 0, 0, 0), (2, 0, 0, 1, 1, 1)], "clip_id int, frame_no long, fragment_no long, x long, y long, width long")
    every = big.unionByName(small)
    reports.write_clips_json(every, str(tmp_path / "json"), parts=6)
    parts = sorted(p for p in (tmp_path / "json").glob("part-*.txt"))
    assert len(parts) >= 5
    text, found, at = "".join(p.read_text() for p in parts), [], 0
    decoder = json.JSONDecoder()
    while at < len(text.rstrip()):
        doc, at = decoder.raw_decode(text, at)
        found.append(doc)
        at += 1
    want = [json.loads(r["json"]) for r in reports.clips_json(every).orderBy("clip_id").collect()]
    assert found == want


def test_canvas_may_be_overridden(spark):
    clips = spark.createDataFrame([(1, 10, 5, 9, True), (2, 10, 0, 9, False), (3, 10, 5, 9, True)], "clip_id int, frames int, fps int, palette_size int, has_audio boolean")
    extents = spark.createDataFrame([(2, 100, 60)], "clip_id int, max_w long, max_h long")
    at = spark.createDataFrame([(1, 5, 6)], "clip_id int, x int, y int")
    sizes = lambda canvas: [(r["canvas_w"], r["canvas_h"]) for r in reports.clip_metadata(clips, extents, at, canvas).orderBy("clip_id").collect()]
    assert sizes(None) == [(630, 450), (100, 60), (630, 450)]
    assert sizes((640, 480)) == [(640, 480), (100, 60), (630, 450)]
    assert sizes((0, 480)) == [(630, 480), (100, 60), (630, 450)]
