"""Worked examples, sequential models and generated files."""

import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelgrid.functions import bytes as by
from reelgrid.functions import clips, codes, text
from reelgrid.operators import keyed, ordered, palettes, pixels, sound
from reelgrid.plans import reports
from reelgrid.sources import files, infer
from reelgrid.streaming import rowlocal

c = F.col


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_worked_examples(spark):
    lit = F.lit
    x, y = clips.place(lit(257), lit(257), lit(0), lit(267), lit(267), "helper")
    assert tuple(one(spark, x, y)) == (257, 257)
    assert tuple(one(spark, codes.magnitude(lit(0x2A)), codes.magnitude(lit(0xA5)))) == (584, -544)  # the table itself; a printed example that says -560 does not follow it
    assert [one(spark, clips.channel(lit(p)))[0] for p in (39844, 42049, 44254, 46459)] == [0, 1, 0, 1]
    assert [one(spark, palettes.remap_range(lit(i), 10, 20, 5))[0] for i in (9, 10, 20, 21)] == [9, 15, 25, 21]
    assert tuple(one(spark, *clips.centred(lit(320), lit(280)), *clips.centred(lit(400), lit(400)))) == (160, 100, 120, 40)
    assert one(spark, text.frame_name(lit(123456)))[0] == "frame_123456"
    assert len(codes.MAGNITUDES) == 128 and codes.MAGNITUDES[-1] == 0x4000
    with pytest.raises(Exception, match="not a size"):
        one(spark, *text.parse_size(lit("wide")))


def test_little_endian_reads_bytes_not_characters(spark):
    raw = "é€x".encode()
    df = spark.createDataFrame([(raw,)], "content binary")
    assert df.select(by.u32(c("content"), 1)).first()[0] == struct.unpack_from("<I", raw, 1)[0]
    assert df.select(by.u32(c("content"), 3)).first()[0] is None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 255), min_size=1, max_size=60))
def test_difference_codes_follow_a_loop(spark, values):
    at, want, clipped, low = 0, [], [], 0
    for v in values:
        step = codes.MAGNITUDES[v & 127] * (-1 if v & 128 else 1)
        at = (at + step + 32768) % 65536 - 32768
        low = max(-32768, min(32767, low + step))
        want.append(at)
        clipped.append(low)
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "packet int, ord int, code int")
    assert [r["sample"] for r in sound.wrapping_cumsum(df, ["packet"], ["ord"]).orderBy("ord").collect()] == want
    assert sound.saturating_cumsum(df, ["packet"]).first()["samples"] == clipped


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(-32768, 32767), min_size=2, max_size=17))
def test_interpolation_follows_two_passes(spark, values):
    n = len(values) // 2
    buf = list(values)
    odd = [buf[2 * k + 1] for k in range(n)]
    even = [odd[0]] + [(odd[k] + odd[k - 1]) >> 1 for k in range(1, n)]
    new = [(even[k] + even[k + 1]) >> 1 for k in range(n - 1)]
    new.append(new[-1] if new else even[0])
    want = [v for pair in zip(even, new, strict=True) for v in pair]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "clip_id int, pos long, value int")
    size = spark.createDataFrame([(1, len(values))], "clip_id int, size long")
    assert [r["value"] for r in sound.interpolate(df, size, "compat").orderBy("pos").collect()] == want


def test_gaps_are_filled_between_neighbours(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 2, 13), (1, 5, -3)], "clip_id int, pos long, value int")
    size = spark.createDataFrame([(1, 7)], "clip_id int, size long")
    assert [r["value"] for r in sound.interpolate(df, size).orderBy("pos").collect()] == [10, 11, 13, 13, -3, -3, -3]


def test_row_expansion_matches_the_remainder_loop(spark):
    rng = random.Random(4)
    for _ in range(6):
        h, scale = rng.randrange(1, 120), rng.randrange(1, 130)
        s = max(1, h * scale // 100)
        want, at, left = [], 0, 0
        for k in range(s):
            n = (left + h) // s
            left = (left + h) % s
            want += [(k, at + i) for i in range(n)]
            at += n
        rows = spark.range(s).select(c("id").alias("k"))
        got = pixels.expand_rows(rows, F.lit(h), F.lit(scale)).select("k", "out_row").orderBy("out_row").collect()
        assert [tuple(r) for r in got] == want


def test_lookback_follows_a_scan(spark):
    rng = random.Random(9)
    ops = [rng.choice(["push", "push", "call", "nop"]) for _ in range(300)]
    vals, argc = [rng.randrange(500) for _ in ops], [4 + rng.randrange(3) for _ in ops]
    want = []
    for i, op in enumerate(ops):
        if op == "call":
            got = [vals[j] for j in range(max(0, i - 50), i) if ops[j] == "push"][: argc[i]][::-1]
            if len(got) >= 5:
                want.append((i, got[0], got[3], got[4], got[2], got[5] if len(got) > 5 else 128))
    df = spark.createDataFrame([(1, i, ops[i], vals[i], argc[i]) for i in range(len(ops))], "s int, pos int, op string, v int, n int")
    got = ordered.lookback_args(df, ["s"], "pos", c("op") == "call", c("op") == "push", c("v"), c("n")).orderBy("pos").collect()
    assert [tuple(r)[1:] for r in got] == want and want


def clip_file(big, version=5, frames=3, palette=None):
    e = ">" if big else "<"
    palette = palette or b""
    head = struct.pack("<H", 0x16) + b"SOL\0" + struct.pack(e + "HHhHHHHhhBBHhhhh4i", version, 2048, 0, 0, frames, len(palette), 0, 320, -7, bool(palette), 1, 0, 10, 1, 2, 3, 100, 200, 300, -400) + bytes(8)
    assert len(head) == 60
    return head + palette


def palette_block(first, colours, shared):
    body = b"".join(bytes(x) if shared else b"\1" + bytes(x) for x in colours)
    entry = bytearray(22)
    entry[10], entry[17] = first, shared
    entry[14:16] = struct.pack("<H", len(colours))
    head = bytearray(13 + 2)
    head[10] = 1
    return bytes(head) + bytes(entry) + body


def test_clip_files(spark, tmp_path):
    pal = palette_block(250, [(i, i + 1, i + 2) for i in range(10)], 1)
    (tmp_path / "90.RBT").write_bytes(clip_file(False, palette=pal))
    (tmp_path / "1000.rbt").write_bytes(clip_file(True, 6))
    (tmp_path / "x7.rbt").write_bytes(clip_file(True, 9))
    (tmp_path / "other.txt").write_bytes(b"")
    listed = files.list_media(spark, str(tmp_path)).collect()
    assert [r["path"].rsplit("/", 1)[1] for r in listed] == ["1000.rbt", "90.RBT", "x7.rbt"]
    rows = {r["clip_id"]: r for r in files.decode_header(files.read_clips(spark, str(tmp_path))).collect()}
    assert set(rows) == {90, 1000}
    assert rows[90]["big_endian"] is False and rows[1000]["big_endian"] is True and rows[1000]["version"] == 6
    assert all((r["frames"], r["x_res"], r["y_res"], r["fps"], r["area_3"], r["has_audio"]) == (3, 320, -7, 10, -400, True) for r in rows.values())
    assert files.read_clips(spark, str(tmp_path), mode="first").count() == 2
    got = files.palette_entries(spark.createDataFrame([(90, pal)], "clip_id int, palette binary")).orderBy("idx").collect()
    assert [(r["idx"], r["r"], r["g"], r["b"]) for r in got] == [(250 + i, i, i + 1, i + 2) for i in range(6)]
    assert palettes.full_palette(files.palette_entries(spark.createDataFrame([(90, palette_block(0, [(9, 8, 7)], 0))], "clip_id int, palette binary")), ["clip_id"]).agg(F.sum("r"), F.sum("b"), F.count("*")).first() == (9, 7, 256)


def test_index_shards(spark, tmp_path):
    def shard(entries, width):
        types = sorted(entries)
        at, directory, body = 3 * (len(types) + 1), b"", b""
        for t in types:
            directory += struct.pack("<BH", 0x80 | t, at + len(body))
            body += b"".join(struct.pack("<H", n) + struct.pack("<I", o)[: width - 2] for n, o in entries[t])
        return directory + struct.pack("<BH", 0xFF, at + len(body)) + body

    (tmp_path / "RESMAP.001").write_bytes(shard({0: [(1, 100), (2, 70000)], 3: [(5, 9)]}, 6))
    (tmp_path / "RESMAP.002").write_bytes(shard({0: [(2, 300)], 30: [(1, 1)]}, 5))
    maps = files.load_volumes(spark, str(tmp_path))
    directory = files.read_directory(maps)
    sections = ordered.section_sizes(directory, ["volume"], ["ord"], c("file_size")).where("type <> 31")
    records = files.explode_fixed_records(maps, sections, infer.infer_width(sections, ["volume"]))
    got = {(r["type"], r["number"], r["volume"]): r["offset"] for r in records.collect()}
    assert got == {(0x88, 1, 1): 100, (0x88, 2, 1): 70000, (0x83, 5, 1): 9, (0x88, 2, 2): 300}
    assert {(r["number"], r["type"]): (r["offset"], r["volume"]) for r in keyed.merge_index(records).collect()}[2, 0x88] == (300, 2)


def test_resource_headers(spark):
    volume = bytearray(200)
    volume[0:13] = struct.pack("<BHIIH", 0, 7, 20, 40, 2)
    volume[50:56] = struct.pack("<BH", 5, 8) + b"\x0a\0\0"
    volume[56:63] = b"\xff" * 7
    volume[80:90] = struct.pack("<BH", 0x85, 9) + b"\x0b\0\0" + b"\x04" + b"\x63\0\0"
    volume[90:93] = b"\xff" * 3
    df = spark.createDataFrame([(bytes(volume), o, 200) for o in (0, 50, 80, 190)], "content binary, offset int, volume_size long")
    rows = [(r["dialect"], r["header_size"], r["method"], r["packed_size"], r["size"], r["reason"]) for r in files.decode_resource_header(df).orderBy("offset").collect()]
    assert rows[0] == ("13", 13, 2, 20, 40, None)
    assert rows[1] == ("6", 6, 0, 10, 10, None)
    assert rows[2] == ("10", 10, 4, 11, 99, None)
    assert rows[3][-1] == "short header"


def test_chained_records_and_cues(spark):
    cel = lambda w, h, n: struct.pack("<BBHHHHhhHhI", 0, 100, w, h, 0, 0, 5, -6, n, 1, 0) + bytes(n)
    frame = struct.pack("<H", 3) + cel(10, 20, 7) + cel(11, 21, 0) + cel(12, 22, 300)[:30]
    df = spark.createDataFrame([(frame,)], "content binary")
    chain = files.explode_chained(df, c("content"), F.lit(2), by.u16(c("content"), 0), size_at=14, most=10)
    got = files.decode_cels(chain, c("content"), c("rec_pos")).orderBy("rec").collect()
    assert [(r["rec"], r["rec_pos"], r["w"], r["h"], r["x"], r["y"], r["data_size"]) for r in got] == [(0, 2, 10, 20, 5, -6, 7), (1, 31, 11, 21, 5, -6, 0), (2, 53, 12, 22, 5, -6, 300)]
    cues = struct.pack("<256i", *range(-3, 253)) + struct.pack("<256H", *range(65000, 65256))
    got = files.explode_cues(spark.createDataFrame([(4, cues)], "clip_id int, content binary"), c("content"), F.lit(0)).orderBy("cue_no").collect()
    assert (got[0]["t"], got[0]["v"], got[255]["t"], got[255]["v"], len(got)) == (-3, 65000, 252, 65255, 256)


def test_positions_with_comments(spark):
    lines = ["# id x y", "", "260 257 257 more", "170 -12 40", "9 40000 1", "12 5"]
    df = spark.createDataFrame(list(enumerate(lines)), "ord int, line string")
    assert [tuple(r) for r in files.read_positions(df).orderBy("ord").collect()] == [(260, 257, 257, 2), (170, -12, 40, 3)]
    assert [r["x"] for r in files.read_positions(df, wrap=True).orderBy("ord").collect()] == [257, -12, -25536]


def test_sinks(spark, tmp_path):
    index = spark.createDataFrame([(0x88, 10, 255, 1), (0x88, 9, 16, 0)], "type int, number int, offset int, volume int")
    reports.write_catalog(index.coalesce(1), str(tmp_path / "catalog"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "catalog")).collect()] == ["9 -> Offset: 16 (0x10)", "10 -> Offset: 255 (0xff), Volume: 1"]
    cues = spark.createDataFrame([(1, 5, 6), (0, 3, 4)], "cue_no int, t int, v int")
    reports.write_cues(cues.coalesce(1), str(tmp_path / "cues"))
    assert spark.read.csv(str(tmp_path / "cues"), header=True).columns == ["index", "time", "value"]
    reports.write_positions(spark.createDataFrame([(3, 0, -5, 12)], "clip_id int, ord int, x int, y int"), str(tmp_path / "pos"))
    assert spark.read.text(str(tmp_path / "pos")).first()[0] == "3         -5    12    "
    reports.write_by_clip(spark.createDataFrame([(3, 1), (4, 2)], "clip_id int, v int"), str(tmp_path / "clips"))
    assert sorted(p.name for p in (tmp_path / "clips").glob("clip_id=*")) == ["clip_id=3", "clip_id=4"]


def test_row_local_operators_take_streams(spark, tmp_path):
    spark.createDataFrame([(1, 0, 0, 0, 5), (1, 0, 1, 0, 240), (1, 0, 2, 0, 255)], "clip_id int, frame_no int, x int, y int, idx int").write.parquet(str(tmp_path / "in"))
    palette = spark.createDataFrame([(i, i, i, i) for i in range(256)], "idx int, r int, g int, b int")
    stream = spark.readStream.schema("clip_id int, frame_no int, x int, y int, idx int").parquet(str(tmp_path / "in"))
    rowlocal.write_parquet(rowlocal.coloured_stream(stream, palette), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = {r["x"]: (r["out_r"], r["out_a"], r["remap_mask"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: (5, 255, 0), 1: (240, 255, 255), 2: (0, 0, 0)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "clip_id int, frame_no int, x int, y int, idx int")
    assert pixels.visible_bbox(empty, ["clip_id"]).count() == 0
    assert ordered.record_offsets(spark.createDataFrame([], "clip_id int, frame_no int, packet_size int"), ["clip_id"], ["frame_no"]).count() == 0
    all_skipped = spark.createDataFrame([(1, 0, 0, 0, 255)], empty.schema)
    assert pixels.visible_bbox(all_skipped, ["clip_id"]).first()["w"] is None
