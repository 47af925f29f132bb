"""The registered queries: each operator over a table derived from the driver's tables, with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bytes as by
from ..functions import clips as fc
from ..functions import codes as fk
from ..functions import text as ft
from ..operators import keyed, ordered, palettes, pixels, sound
from ..sources import files, infer
from . import fixtures as fx
from . import reports

Query = Callable[[SparkSession, str], DataFrame]
_all: dict[str, tuple[Query, str]] = {}
c = F.col


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _all[f.__name__] = (f, sql.strip())
        return f

    return add


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _all.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all.items()}


def _coloured(spark: SparkSession, d: str) -> DataFrame:
    return pixels.apply_palette(fx.pixels(spark, d), fx.palette(spark))


def _layers(spark: SparkSession, d: str, variant: str = "A") -> DataFrame:
    return pixels.split_layers(_coloured(spark, d), variant)


COLOURED = f"{fx.PIXELS}, {fx.PALETTE}, col AS (SELECT p.*, r, g, b FROM pixels p JOIN palette USING (idx))"


def _layer_sql(variant: str) -> str:
    base = "idx < 236" if variant == "A" else "idx < 255"
    return (
        COLOURED + ", lay AS (SELECT *, " + ", ".join(f"CASE WHEN {base} THEN {x} ELSE 0 END AS base_{x}" for x in "rgb") + ", CASE WHEN idx BETWEEN 236 AND 254 THEN 255 ELSE 0 END AS remap_mask, "
        + ", ".join(f"CASE WHEN idx BETWEEN 236 AND 254 THEN {x} ELSE 0 END AS remap_{x}" for x in "rgb") + ", CASE WHEN idx = 255 THEN 0 ELSE 255 END AS alpha FROM col)"
    )


LUMA = "CASE WHEN idx = 255 THEN 0 ELSE CAST(trunc(CAST(0.299 AS FLOAT) * CAST(r AS FLOAT) + CAST(0.587 AS FLOAT) * CAST(g AS FLOAT) + CAST(0.114 AS FLOAT) * CAST(b AS FLOAT)) AS INTEGER) END"


# ---- pixels and layers


@query(f"""WITH {COLOURED}, f AS (SELECT *, {LUMA} AS luma FROM col)
SELECT clip_id, min(x) FILTER (idx <> 255) AS min_x, min(y) FILTER (idx <> 255) AS min_y, max(x) FILTER (idx <> 255) AS max_x, max(y) FILTER (idx <> 255) AS max_y,
count(*) FILTER (idx < 236) AS base_pixels, CAST(sum(luma) FILTER (idx < 236) AS BIGINT) AS base_luma, count(*) FILTER (idx BETWEEN 236 AND 254) AS remap_pixels, CAST(sum(luma) FILTER (idx BETWEEN 236 AND 254) AS BIGINT) AS remap_luma FROM f GROUP BY clip_id""")
def flagship_clip_boxes(spark: SparkSession, d: str) -> DataFrame:
    """For each clip, the visible box and the luminance of its layers."""
    df = _coloured(spark, d).withColumn("luma", pixels.luminance(c("r"), c("g"), c("b"), c("idx"))).withColumn("kind", pixels.classify_pixel(c("idx")))
    seen, of = lambda x: F.when(c("idx") != 255, c(x)), lambda k, x: F.when(c("kind") == k, x)
    return df.groupBy("clip_id").agg(
        F.min(seen("x")).alias("min_x"), F.min(seen("y")).alias("min_y"), F.max(seen("x")).alias("max_x"), F.max(seen("y")).alias("max_y"),
        F.count(of("base", F.lit(1))).alias("base_pixels"), F.sum(of("base", c("luma"))).alias("base_luma"), F.count(of("remap", F.lit(1))).alias("remap_pixels"), F.sum(of("remap", c("luma"))).alias("remap_luma"),
    )


@query(f"WITH {fx.PIXELS} SELECT clip_id, CASE WHEN idx = 255 THEN 'skip' WHEN idx >= 236 THEN 'remap' ELSE 'base' END AS kind, count(*) AS n FROM pixels GROUP BY ALL")
def prj01_classify_pixel(spark: SparkSession, d: str) -> DataFrame:
    return fx.pixels(spark, d).groupBy("clip_id", pixels.classify_pixel(c("idx")).alias("kind")).agg(F.count("*").alias("n"))


_SUMS = ["base_r", "base_g", "base_b", "remap_mask", "remap_r", "remap_g", "remap_b", "alpha"]


def _sums(df: DataFrame, names: list[str]) -> DataFrame:
    return df.groupBy("clip_id", "frame_no").agg(*[F.sum(n).alias(n) for n in names])


@query(f"WITH {_layer_sql('A')} SELECT clip_id, frame_no, {', '.join(f'CAST(sum({n}) AS BIGINT) AS {n}' for n in _SUMS)} FROM lay GROUP BY ALL")
def prj02_split_layers_a(spark: SparkSession, d: str) -> DataFrame:
    return _sums(_layers(spark, d), _SUMS)


@query(f"WITH {_layer_sql('B')} SELECT clip_id, frame_no, {', '.join(f'CAST(sum({n}) AS BIGINT) AS {n}' for n in _SUMS)} FROM lay GROUP BY ALL")
def prj02_split_layers_b(spark: SparkSession, d: str) -> DataFrame:
    return _sums(_layers(spark, d, "B"), _SUMS)


@query(f"WITH {COLOURED} SELECT clip_id, frame_no, x, y, {LUMA} AS luma FROM col")
def prj03_luminance(spark: SparkSession, d: str) -> DataFrame:
    return _coloured(spark, d).select("clip_id", "frame_no", "x", "y", pixels.luminance(c("r"), c("g"), c("b"), c("idx")).alias("luma"))


@query(f"WITH {_layer_sql('A')} SELECT clip_id, frame_no, {', '.join(f'CAST(sum(CASE WHEN alpha = 0 THEN 0 WHEN remap_mask > 0 THEN remap_{x} ELSE base_{x} END) AS BIGINT) AS out_{x}' for x in 'rgb')}, CAST(sum(alpha) AS BIGINT) AS out_a FROM lay GROUP BY ALL")
def prj04_compose_rgba(spark: SparkSession, d: str) -> DataFrame:
    return _sums(pixels.compose_rgba(_layers(spark, d)), ["out_r", "out_g", "out_b", "out_a"])


@query(f"WITH {fx.PIXELS} SELECT clip_id, frame_no, CAST(sum(CASE WHEN idx = 255 THEN 255 ELSE 0 END) AS BIGINT) AS mask FROM pixels GROUP BY ALL")
def prj05_alpha_mask(spark: SparkSession, d: str) -> DataFrame:
    return _sums(fx.pixels(spark, d).withColumn("mask", pixels.alpha_mask(c("idx"))), ["mask"])


@query(f"WITH {_layer_sql('A')}, l AS (UNPIVOT (SELECT clip_id, {', '.join(_SUMS)}, idx AS pixel_index FROM lay) ON {', '.join(_SUMS)}, pixel_index INTO NAME layer VALUE value) SELECT clip_id, layer, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM l GROUP BY ALL")
def prj06_unpivot_channels(spark: SparkSession, d: str) -> DataFrame:
    out = pixels.unpivot_channels(_layers(spark, d), ["clip_id", "frame_no", "x", "y"], with_index=True)
    return out.groupBy("clip_id", "layer").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(f"""WITH {_layer_sql('A')}, t AS (
SELECT clip_id, 'BASE' AS layer, base_r AS vr, base_g AS vg, base_b AS vb FROM lay UNION ALL SELECT clip_id, 'REMAP', remap_r, remap_g, remap_b FROM lay
UNION ALL SELECT clip_id, 'ALPHA', 255 - alpha, 255 - alpha, 255 - alpha FROM lay UNION ALL SELECT clip_id, 'LUMINANCE', {LUMA}, {LUMA}, {LUMA} FROM lay)
SELECT clip_id, layer, CAST(sum(vr) AS BIGINT) AS vr, CAST(sum(vg) AS BIGINT) AS vg, CAST(sum(vb) AS BIGINT) AS vb FROM t GROUP BY ALL""")
def prj06_unpivot_tracks(spark: SparkSession, d: str) -> DataFrame:
    out = pixels.unpivot_tracks(_layers(spark, d), ["clip_id", "frame_no", "x", "y"])
    return out.groupBy("clip_id", "layer").agg(*[F.sum(f"v{x}").alias(f"v{x}") for x in "rgb"])


def _placed(spark: SparkSession, d: str, mode: str) -> DataFrame:
    at = keyed.lookup_first(fx.cels(spark, d).withColumnsRenamed({"x": "cx", "y": "cy"}).withColumn("key", c("clip_id") % 40), fx.positions(spark, d).withColumnRenamed("clip_id", "key"), ["key"], ["ord"], ["x", "y"])
    x, y = fc.place(c("x"), c("y"), c("cx"), c("cy"), c("h"), mode, c("found"))
    return at.select("clip_id", "frame_no", "cel_no", x.alias("sx"), y.alias("sy"))


_FIRST = "first AS (SELECT clip_id AS key, arg_min(x, ord) AS px, arg_min(y, ord) AS py FROM positions GROUP BY 1)"


@query(f"WITH {fx.CELS}, {fx.POSITIONS}, {_FIRST} SELECT clip_id, frame_no, cel_no, x + coalesce(px, 0) AS sx, y + coalesce(py, 0) AS sy FROM cels LEFT JOIN first ON key = clip_id % 40")
def prj07_place_compose(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d, "compose")


@query(f"WITH {fx.CELS}, {fx.POSITIONS}, {_FIRST} SELECT clip_id, frame_no, cel_no, x + coalesce(px, 0) AS sx, y + coalesce(py, 0) - h AS sy FROM cels LEFT JOIN first ON key = clip_id % 40")
def prj07_place_helper(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d, "helper")


@query(f"WITH {fx.PIXELS} SELECT clip_id, frame_no, x + 2 AS x, y - 3 AS y, idx FROM pixels WHERE x + 2 < 7 AND y - 3 >= 0 AND y - 3 < 5")
def prj08_shift_and_clip(spark: SparkSession, d: str) -> DataFrame:
    return pixels.clip_to(pixels.shift(fx.pixels(spark, d), 2, -3), 7, 5).select("clip_id", "frame_no", "x", "y", "idx")


@query(f"WITH {fx.PIXELS}, vis AS (SELECT * FROM pixels WHERE idx % 3 > 0 OR idx = 255), box AS (SELECT clip_id, frame_no, min(x) FILTER (idx <> 255) AS a, max(x) FILTER (idx <> 255) AS b, min(y) FILTER (idx <> 255) AS c, max(y) FILTER (idx <> 255) AS d FROM vis GROUP BY ALL) SELECT v.clip_id, v.frame_no, x - a AS x, y - c AS y, idx FROM vis v JOIN box USING (clip_id, frame_no) WHERE x BETWEEN a AND b AND y BETWEEN c AND d")
def prj08_tight_crop(spark: SparkSession, d: str) -> DataFrame:
    return pixels.tight_crop(fx.pixels(spark, d).where("idx % 3 > 0 or idx = 255"), ["clip_id", "frame_no"]).select("clip_id", "frame_no", "x", "y", "idx")


@query("SELECT o_orderkey, CAST(ceil(o_orderkey / 2048.0) * 2048 AS BIGINT) AS record, CAST(ceil(o_custkey / 2.0) * 2 AS BIGINT) AS even FROM orders")
def prj09_align_up(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "orders").select("o_orderkey", by.align_up(c("o_orderkey"), 2048).alias("record"), by.align_up(c("o_custkey"), 2).alias("even"))


@query(f"""WITH {fx.CELS} SELECT CASE WHEN "count" > 10 THEN 'count' WHEN w <= 0 OR h <= 0 THEN 'empty' WHEN w * h >= 20000000 THEN 'area' WHEN data_size NOT BETWEEN 1 AND 200000 THEN 'data_size' WHEN chunks NOT BETWEEN 1 AND 100 THEN 'chunks' END AS reason, count(*) AS n FROM cels GROUP BY 1""")
def prj10_validate_frames(spark: SparkSession, d: str) -> DataFrame:
    reason = fc.frame_reject_reason(c("count"), c("w"), c("h"), c("data_size"), c("chunks"))
    return fx.cels(spark, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {fx.POSITIONS} SELECT ord, x, y FROM positions WHERE ord BETWEEN 1 AND 9999 AND x BETWEEN -100 AND 740 AND y BETWEEN -100 AND 580")
def prj11_valid_positions(spark: SparkSession, d: str) -> DataFrame:
    return fx.positions(spark, d).where(fc.valid_position(c("ord"), c("x"), c("y"))).select("ord", "x", "y")


@query(f"WITH {fx.CELS} SELECT clip_id, count(*) AS n FROM cels WHERE x BETWEEN -100 AND 700 AND y BETWEEN -100 AND 550 AND w BETWEEN 1 AND 640 AND h BETWEEN 1 AND 480 GROUP BY 1")
def prj11_valid_fragments(spark: SparkSession, d: str) -> DataFrame:
    return fx.cels(spark, d).where(fc.valid_fragment(c("x"), c("y"), c("w"), c("h"))).groupBy("clip_id").agg(F.count("*").alias("n"))


def _case(names: str, expr: str, default: str) -> str:
    return f"CASE {expr} " + " ".join("WHEN {} THEN '{}'".format(*x.split(":")) for x in names.split("|")) + f" ELSE '{default}' END"


# Fixed values, stated for the SQL on its own: names and families by code, and type codes by section index.
_TYPES = "128:Script|129:Sound|130:Memory|131:Text|132:Font|133:Cursor|134:Vocab|135:Pic|136:View|137:Patch|138:Bitmap|139:Palette|141:Audio|142:Sync|143:Message|144:Chunk|145:Heap|146:Audio36|147:Sync36|148:RobotData|149:AudioMap"
_METHODS = "0:None|3:RLE Simple|4:RLE Advanced|5:Huffman|6:LZ-Bit|10:RLE+Huffman|12:LZ Advanced|14:STACpack Old|32:LZS/STACpack|49:LZSS 0x31|52:RLE 0x34|56:Huffman V56|60:DPCM Audio|123:STACpack/LZS (0x7B)"
_FAMILIES = "0:none|3:rle|4:rle|5:huffman|6:lz|8:none|10:rle+huffman|12:lz|13:lz|14:stac|32:stac|49:lz|52:rle|56:huffman|123:stac"
_CODES = "[136, 135, 128, 131, 129, 130, 134, 132, 133, 137, 138, 139, 140, 141, 142, 143, 144, 145, 146, 147, 148, 149]"


@query(f"SELECT p_partkey, {_case(_TYPES, '(p_size + 120)', 'Unknown')} AS type_name, {_case(_METHODS, 'p_size', 'Unknown')} AS method_name, {_case(_FAMILIES, 'p_size', 'unsupported')} AS family FROM part")
def prj12_decode_enum(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "part").select("p_partkey", fk.decode_enum(c("p_size") + 120, "type").alias("type_name"), fk.decode_enum(c("p_size"), "method").alias("method_name"), fk.decode_enum(c("p_size"), "family").alias("family"))


@query(f"SELECT p_partkey, {_CODES}[p_size % 32 + 1] AS type FROM part WHERE p_size % 32 <= 21")
def prj13_remap_code(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "part").select("p_partkey", fk.remap_code(c("p_size") % 32).alias("type")).where("type is not null")


@query(f"""WITH {fx.CELS}, r AS (SELECT clip_id, frame_no, cel_no, w, h, CASE WHEN w <= 630 AND h <= 450 THEN [630, 450] WHEN w <= 640 AND h <= 480 THEN [640, 480] WHEN w <= 640 AND h <= 400 THEN [640, 400] WHEN w <= 320 AND h <= 240 THEN [320, 240] WHEN w <= 320 AND h <= 200 THEN [320, 200] ELSE [w, h] END AS a,
CASE WHEN w <= 320 AND h <= 200 THEN [320, 200] WHEN w <= 320 AND h <= 240 THEN [320, 240] WHEN w <= 640 AND h <= 400 THEN [640, 400] WHEN w <= 630 AND h <= 450 THEN [630, 450] WHEN w <= 640 AND h <= 480 THEN [640, 480] ELSE [w, h] END AS b FROM cels)
SELECT clip_id, frame_no, cel_no, CAST(a[1] AS INTEGER) AS w, CAST(a[2] AS INTEGER) AS h, CAST(b[1] AS INTEGER) AS spec_w, CAST(b[2] AS INTEGER) AS spec_h FROM r""")
def prj14_fit_resolution(spark: SparkSession, d: str) -> DataFrame:
    a, b = fc.fit_resolution(c("w"), c("h")), fc.fit_resolution(c("w"), c("h"), "spec")
    return fx.cels(spark, d).select("clip_id", "frame_no", "cel_no", a.alias("a"), b.alias("b")).select("clip_id", "frame_no", "cel_no", c("a.w").alias("w"), c("a.h").alias("h"), c("b.w").alias("spec_w"), c("b.h").alias("spec_h"))


@query(f"WITH {fx.PACKETS} SELECT clip_id, frame_no, packet_size % 2 AS channel FROM packets")
def prj15_channel(spark: SparkSession, d: str) -> DataFrame:
    return fx.packets(spark, d).select("clip_id", "frame_no", fc.channel(c("packet_size")).alias("channel"))


@query(f"WITH {fx.CLIPS} SELECT clip_id, CASE WHEN fps = 0 THEN NULL ELSE frames / CAST(fps AS DOUBLE) END AS seconds, frames * CASE WHEN fps > 0 THEN 22050 // fps ELSE 2205 END AS samples FROM clips")
def prj16_duration(spark: SparkSession, d: str) -> DataFrame:
    return fx.clips(spark, d).select("clip_id", fc.duration(c("frames"), c("fps")).alias("seconds"), fc.expected_samples(c("frames"), c("fps")).alias("samples"))


@query("""WITH s AS (SELECT p_partkey, CAST(p_size + 20 AS BIGINT) AS height, CAST(40 + p_partkey % 100 AS BIGINT) AS scale FROM part), k AS (SELECT p_partkey, height, greatest(1, height * scale // 100) AS n FROM s), r AS (SELECT p_partkey, height, n, unnest(range(n)) AS k FROM k)
SELECT p_partkey, k, unnest(range(k * height // n, (k + 1) * height // n)) AS out_row FROM r""")
def prj17_expand_rows(spark: SparkSession, d: str) -> DataFrame:
    part = fx.table(spark, d, "part").select("p_partkey", (c("p_size") + 20).cast("bigint").alias("height"), (40 + c("p_partkey") % 100).alias("scale"))
    n = F.greatest(F.lit(1).cast("bigint"), F.floor(c("height") * c("scale") / 100))
    rows = part.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    return pixels.expand_rows(rows, c("height"), c("scale")).select("p_partkey", "k", "out_row")


@query("""WITH r AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ord, l_suppkey % 4 AS value, l_linenumber AS count FROM lineitem)
SELECT k, row_number() OVER (PARTITION BY k ORDER BY ord, i) - 1 AS pos, value FROM (SELECT *, unnest(range(count)) AS i FROM r)""")
def prj18_expand_runs(spark: SparkSession, d: str) -> DataFrame:
    return pixels.expand_runs(_runs(spark, d), ["k"])


def _runs(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return fx.table(spark, d, "lineitem").select(c("l_orderkey").alias("k"), F.row_number().over(w).alias("ord"), (c("l_suppkey") % 4).alias("value"), c("l_linenumber").cast("bigint").alias("count"))


@query("""WITH r AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ord, l_suppkey % 4 AS value FROM lineitem),
n AS (SELECT *, CASE WHEN lag(value) OVER (PARTITION BY k ORDER BY ord) = value THEN 0 ELSE 1 END AS new FROM r), g AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY ord) - 1 AS run FROM n)
SELECT k, CAST(run AS BIGINT) AS run, min(ord) - 1 AS start, count(*) AS count, min(value) AS value FROM g GROUP BY k, run""")
def prj18_collapse_runs(spark: SparkSession, d: str) -> DataFrame:
    return pixels.collapse_runs(_runs(spark, d).drop("count"), ["k"], ["ord"])


@query(f"WITH {fx.PIXELS} SELECT DISTINCT idx, CAST(CAST(idx AS FLOAT) / CAST(255 AS FLOAT) AS FLOAT) AS v FROM pixels")
def prj19_normalize(spark: SparkSession, d: str) -> DataFrame:
    return fx.pixels(spark, d).select("idx").distinct().select("idx", pixels.normalize_u8(c("idx")).alias("v"))


@query(f"WITH {fx.CLIPS}, {fx.POSITIONS}, {_FIRST} SELECT clip_id, CASE WHEN px IS NULL THEN 'crop' ELSE 'canvas' END AS rule_a, CASE WHEN px IS NULL OR (px = 0 AND py = 0) THEN 'crop' ELSE 'canvas' END AS rule_b FROM clips LEFT JOIN first ON key = clip_id")
def prj20_render_mode(spark: SparkSession, d: str) -> DataFrame:
    at = keyed.lookup_first(fx.clips(spark, d), fx.positions(spark, d), ["clip_id"], ["ord"], ["x", "y"])
    return at.select("clip_id", fc.render_mode(c("found"), c("x"), c("y")).alias("rule_a"), fc.render_mode(c("found"), c("x"), c("y"), "B").alias("rule_b"))


@query(f"""WITH {fx.EVENTS}, n AS (SELECT *, lead(k) OVER (PARTITION BY stream ORDER BY pos) AS id, lead(k, 2) OVER (PARTITION BY stream ORDER BY pos) % 9 AS argc FROM ev) SELECT stream, pos, id, argc FROM n WHERE op = 'purchase' AND id IN (57, 67, 74, 84) AND argc BETWEEN 4 AND 6""")
def prj21_call_sites(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("stream").orderBy("pos")
    rows = fx.events(spark, d).withColumns({"opcode": F.when(c("op") == "purchase", 0x76).otherwise(0), "id": F.lead("k").over(w), "argc": F.lead("k", 2).over(w) % 9})
    return rows.where(fc.call_site(c("opcode"), c("id"), c("argc"))).select("stream", "pos", "id", "argc")


# ---- joins and merges


@query(f"WITH {fx.CLIPS}, {fx.POSITIONS}, {_FIRST} SELECT clip_id, px AS x, py AS y, px IS NOT NULL AS found FROM clips LEFT JOIN first ON key = clip_id")
def jon01_lookup_first(spark: SparkSession, d: str) -> DataFrame:
    return keyed.lookup_first(fx.clips(spark, d).select("clip_id"), fx.positions(spark, d), ["clip_id"], ["ord"], ["x", "y"])


@query(f"WITH {fx.CLIPS}, {fx.POSITIONS}, l AS (SELECT clip_id, arg_max(x, ord) AS x, arg_max(y, ord) AS y FROM positions GROUP BY 1) SELECT clip_id, x, y, x IS NOT NULL AS found FROM clips LEFT JOIN l USING (clip_id)")
def jon02_lookup_last(spark: SparkSession, d: str) -> DataFrame:
    return keyed.lookup_last(fx.clips(spark, d).select("clip_id"), fx.positions(spark, d), ["clip_id"], ["ord"], ["x", "y"])


@query(f"WITH {fx.POSITIONS}, extra AS (SELECT s_suppkey % 60 AS clip_id, s_suppkey AS ord, s_suppkey % 300 AS x, s_suppkey % 200 AS y FROM supplier) SELECT clip_id, ord, x, y, false AS added FROM positions UNION ALL SELECT clip_id, ord, x, y, true FROM extra WHERE clip_id NOT IN (SELECT clip_id FROM positions)")
def jon03_merge_missing(spark: SparkSession, d: str) -> DataFrame:
    k = c("s_suppkey")
    extra = fx.table(spark, d, "supplier").select((k % 60).alias("clip_id"), k.alias("ord"), (k % 300).alias("x"), (k % 200).alias("y"))
    return keyed.merge_missing(fx.positions(spark, d).withColumn("clip_id", c("clip_id").cast("bigint")), extra, ["clip_id"])


_WANTED = "wanted AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'Z' END AS type, p_partkey AS number FROM part)"


@query(f"""WITH {fx.MERGED}, {_WANTED}, volumes AS (SELECT i AS volume, 30000 + 9000 * i AS volume_size FROM range(1, 6) t(i)), f AS (SELECT w.type, w.number, m.volume AS v, m."offset" AS o, data_size, volume_size FROM wanted w LEFT JOIN merged m USING (type, number) LEFT JOIN volumes ON volumes.volume = coalesce(m.volume, 1))
SELECT type, number, v AS volume, o AS "offset", CASE WHEN o IS NULL THEN 'not_indexed' WHEN volume_size IS NULL THEN 'volume_not_loaded' WHEN o + 13 > volume_size THEN 'bad_offset' WHEN data_size <= 0 OR o + 13 + data_size > volume_size THEN 'bad_payload' ELSE 'ok' END AS status FROM f""")
def jon04_resolve_resources(spark: SparkSession, d: str) -> DataFrame:
    k = c("p_partkey")
    wanted = fx.table(spark, d, "part").select(F.when(k % 3 == 0, "A").when(k % 3 == 1, "N").otherwise("Z").alias("type"), k.alias("number"))
    raw = fx.index(spark, d)
    best = raw.groupBy("type", "number").agg(F.max_by(F.struct("offset", "volume", "data_size"), F.struct("volume", "rec", "rec2", "offset")).alias("v")).select("type", "number", "v.*")
    volumes = spark.range(1, 6).select(c("id").cast("int").alias("volume"), (30000 + 9000 * c("id")).alias("volume_size"))
    return keyed.resolve_resources(wanted, best, volumes)


@query(f"WITH {COLOURED} SELECT clip_id, CAST(sum(r) AS BIGINT) AS r, CAST(sum(g) AS BIGINT) AS g, CAST(sum(b) AS BIGINT) AS b, count(*) AS n FROM col GROUP BY 1")
def jon05_apply_palette(spark: SparkSession, d: str) -> DataFrame:
    return _coloured(spark, d).groupBy("clip_id").agg(*[F.sum(x).alias(x) for x in "rgb"], F.count("*").alias("n"))


@query(f"""WITH {fx.INDEX}, w AS (SELECT p_partkey AS number, p_partkey * 7919 % 2003 AS pick_ord FROM part WHERE p_size < 20), f AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY type, volume, rec, rec2, "offset") AS n FROM idx) SELECT number, type, volume, "offset", pick_ord FROM f JOIN w USING (number) WHERE n = 1""")
def jon06_pick(spark: SparkSession, d: str) -> DataFrame:
    wanted = fx.table(spark, d, "part").where("p_size < 20").select(c("p_partkey").alias("number"), (c("p_partkey") * 7919 % 2003).alias("ord"))
    return keyed.pick(fx.index(spark, d), wanted, "number", ["type", "volume", "rec", "rec2", "offset"]).select("number", "type", "volume", "offset", "pick_ord")


@query(f"""WITH {fx.EVENTS}, s AS (SELECT stream, pos, CASE WHEN k % 17 = 0 THEN -5000 WHEN k % 3 = 0 THEN value % 500 ELSE value * 10 END AS value, count(*) OVER (PARTITION BY stream) AS n, lead(CASE WHEN k % 17 = 0 THEN -5000 WHEN k % 3 = 0 THEN value % 500 ELSE value * 10 END) OVER (PARTITION BY stream ORDER BY pos) AS b FROM ev),
p AS (SELECT a.stream, a.pos, a.value AS x, a.b AS y, j.pos AS jp, j.value AS id FROM s a JOIN s j ON a.stream = j.stream AND j.pos BETWEEN a.pos - 10 AND a.pos - 1 WHERE a.value BETWEEN 0 AND 630 AND a.b BETWEEN 0 AND 450 AND a.pos < a.n - 5 AND j.value BETWEEN 1 AND 9999 AND NOT EXISTS (SELECT 1 FROM s m WHERE m.stream = a.stream AND m.pos > j.pos AND m.pos < a.pos AND m.value NOT BETWEEN -1000 AND 10000))
SELECT stream, pos, arg_min(id, jp) AS id, any_value(x) AS x, any_value(y) AS y FROM p GROUP BY stream, pos""")
def jon08_pair_with_preceding_id(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(c("k") % 17 == 0, -5000).when(c("k") % 3 == 0, c("value") % 500).otherwise(c("value") * 10)
    return ordered.pair_with_preceding_id(fx.events(spark, d).select("stream", "pos", v.cast("bigint").alias("value")), ["stream"])


_OFFSETS = "ofs AS (SELECT *, coalesce(sum(packet_size) OVER (PARTITION BY clip_id ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 4096 AS record_pos FROM packets)"


def _offsets(spark: SparkSession, d: str) -> DataFrame:
    return ordered.record_offsets(fx.packets(spark, d), ["clip_id"], ["frame_no"], base=2100)


@query(f"WITH {fx.PACKETS}, {_OFFSETS} SELECT clip_id, frame_no, CAST(record_pos + video_size AS BIGINT) AS audio_pos, packet_size - video_size AS audio_size FROM ofs WHERE packet_size > 0 AND video_size > 0 AND packet_size - video_size BETWEEN 1 AND 10485760")
def jon09_attach_audio(spark: SparkSession, d: str) -> DataFrame:
    return sound.attach_audio(_offsets(spark, d)).select("clip_id", "frame_no", "audio_pos", "audio_size")


@query(f"""WITH {fx.MERGED} SELECT type, number, "offset", volume FROM merged""")
def set02_merge_index(spark: SparkSession, d: str) -> DataFrame:
    return keyed.merge_index(fx.index(spark, d))


@query(f"WITH {fx.POSITIONS} SELECT clip_id, ord, 0 AS ord_part FROM positions WHERE ord % 2 = 0 UNION ALL SELECT clip_id, ord, 1 FROM positions WHERE ord % 3 = 0")
def set01_append(spark: SparkSession, d: str) -> DataFrame:
    p = fx.positions(spark, d).select("clip_id", "ord")
    return keyed.append_all([p.where("ord % 2 = 0"), p.where("ord % 3 = 0")])


@query(f"SELECT DISTINCT p_size AS method FROM part WHERE {_case(_FAMILIES, 'p_size', 'unsupported')} = 'unsupported'")
def agg09_unsupported_methods(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "part").where(fk.decode_enum(c("p_size"), "family") == "unsupported").select(c("p_size").alias("method")).distinct()


# ---- aggregates


@query(f"WITH {fx.INDEX} SELECT type, count(*) AS n, count(DISTINCT number) AS distinct_n FROM idx GROUP BY 1")
def agg01_count_by_type(spark: SparkSession, d: str) -> DataFrame:
    return keyed.counts_by_type(fx.index(spark, d))


@query(f"WITH {fx.PIXELS} SELECT clip_id, frame_no, min(x) FILTER (idx > 250 AND idx < 255) AS min_x, min(y) FILTER (idx > 250 AND idx < 255) AS min_y, max(x) FILTER (idx > 250 AND idx < 255) AS max_x, max(y) FILTER (idx > 250 AND idx < 255) AS max_y, max(x) FILTER (idx > 250 AND idx < 255) - min(x) FILTER (idx > 250 AND idx < 255) + 1 AS w, max(y) FILTER (idx > 250 AND idx < 255) - min(y) FILTER (idx > 250 AND idx < 255) + 1 AS h FROM pixels GROUP BY ALL")
def agg02_visible_bbox(spark: SparkSession, d: str) -> DataFrame:
    return pixels.visible_bbox(fx.pixels(spark, d), ["clip_id", "frame_no"], (c("idx") > 250) & (c("idx") < 255))


_EXTENTS = """ext AS (SELECT clip_id, w + w % 2 AS max_w, h + h % 2 AS max_h FROM (SELECT clip_id, max(((x + w) % 65536 + 65536) % 65536) AS w, max(((y + h) % 65536 + 65536) % 65536) AS h FROM cels WHERE video_size BETWEEN 1 AND 1000000 AND "count" <= 100 GROUP BY 1))"""


@query(f"WITH {fx.CELS}, {_EXTENTS} SELECT * FROM ext")
def agg03_max_extents(spark: SparkSession, d: str) -> DataFrame:
    return pixels.max_extents(fx.cels(spark, d), ["clip_id"])


@query(f"WITH {fx.CELS} SELECT clip_id, min(x) AS min_x, min(y) AS min_y, max(x + width) AS max_x, CAST(NULL AS BIGINT) AS max_y FROM cels GROUP BY 1")
def agg04_fragment_bbox(spark: SparkSession, d: str) -> DataFrame:
    return pixels.fragment_bbox(fx.cels(spark, d), ["clip_id"])


@query("SELECT *, total - success AS failed, CASE WHEN total > success THEN 1 ELSE 0 END AS exit_code FROM (SELECT count(*) AS total, count(*) FILTER (o_orderstatus <> 'F') AS success FROM orders)")
def agg05_run_summary(spark: SparkSession, d: str) -> DataFrame:
    return keyed.run_summary(fx.table(spark, d, "orders").select((c("o_orderstatus") != "F").alias("ok")))


@query(f"WITH {fx.CELS}, v AS (SELECT clip_id, x BETWEEN -100 AND 700 AND y BETWEEN -100 AND 550 AND w BETWEEN 1 AND 640 AND h BETWEEN 1 AND 480 AS ok FROM cels) SELECT clip_id, count(*) FILTER (ok) AS valid, count(*) AS total, CAST(count(*) FILTER (ok) AS DOUBLE) / count(*) AS ratio FROM v GROUP BY 1")
def agg06_valid_ratio(spark: SparkSession, d: str) -> DataFrame:
    return keyed.valid_ratio(fx.cels(spark, d).withColumn("valid", fc.valid_fragment(c("x"), c("y"), c("w"), c("h"))), ["clip_id"])


@query(f"WITH {fx.CELS} SELECT clip_id, bool_or(w % 5 <> 0 OR h % 2 <> 0) AS mixed FROM cels GROUP BY 1")
def agg07_has_mixed_size(spark: SparkSession, d: str) -> DataFrame:
    own = fx.cels(spark, d).select("clip_id", (c("w") % 5).alias("w"), (c("h") % 2).alias("h"))
    return pixels.has_mixed_size(own, ["clip_id"], F.lit(0), F.lit(0))


@query(f"WITH {fx.EVENTS} SELECT count(DISTINCT stream) AS scripts, count(*) AS matches FROM ev WHERE op = 'purchase' AND k > 50")
def agg08_match_summary(spark: SparkSession, d: str) -> DataFrame:
    return keyed.match_summary(fx.events(spark, d).where("op = 'purchase' and k > 50"), "stream")


@query(f"""WITH {fx.CELS}, f AS (SELECT clip_id, frame_no, string_agg(x || ':' || y || ':' || width, ',' ORDER BY fragment_no) AS s, count(*) AS n FROM cels GROUP BY ALL) SELECT clip_id, count(*) AS frames, CAST(sum(n) AS BIGINT) AS fragments, string_agg(frame_no || '=' || s, ';' ORDER BY frame_no) AS listed FROM f GROUP BY 1""")
def agg10_nest_clips(spark: SparkSession, d: str) -> DataFrame:
    nested = reports.nest_clips(fx.cels(spark, d))
    one = lambda f: F.concat(f["frame"].cast("string"), F.lit("="), F.array_join(F.transform(f["fragments"], lambda g: F.concat_ws(":", g["x"].cast("string"), g["y"].cast("string"), g["width"].cast("string"))), ","))
    total = F.aggregate("frames", F.lit(0).cast("bigint"), lambda a, f: a + F.size(f["fragments"]))
    return nested.select("clip_id", F.size("frames").cast("bigint").alias("frames"), total.alias("fragments"), F.array_join(F.transform("frames", one), ";").alias("listed"))


@query(f"""WITH {fx.CLIPS}, {fx.CELS}, {_EXTENTS}, {fx.POSITIONS}, {_FIRST} SELECT c.clip_id, frames, fps, CASE WHEN fps > 0 THEN round(frames / CAST(fps AS DOUBLE), 2) END AS seconds, CASE WHEN px IS NULL THEN coalesce(max_w, 630) ELSE 630 END AS canvas_w, CASE WHEN px IS NULL THEN coalesce(max_h, 450) ELSE 450 END AS canvas_h, px AS x, py AS y, has_audio, palette_size // 3 AS colours FROM clips c LEFT JOIN ext USING (clip_id) LEFT JOIN first ON key = c.clip_id""")
def agg11_clip_rollup(spark: SparkSession, d: str) -> DataFrame:
    own = fx.clips(spark, d)
    at = keyed.lookup_first(own.select("clip_id"), fx.positions(spark, d), ["clip_id"], ["ord"], ["x", "y"])
    return reports.clip_metadata(own, pixels.max_extents(fx.cels(spark, d), ["clip_id"]), at)


@query(f"WITH {fx.INDEX} SELECT count(DISTINCT (type, number)) AS resources, count(DISTINCT volume) AS volumes FROM idx")
def agg12_catalog_totals(spark: SparkSession, d: str) -> DataFrame:
    return keyed.catalog_totals(fx.index(spark, d))


@query(f"WITH {fx.CODES} SELECT packet AS clip_id, ord % 2 AS channel, count(DISTINCT ord // 10) AS packets, count(*) AS samples FROM codes GROUP BY ALL")
def agg13_audio_packet_stats(spark: SparkSession, d: str) -> DataFrame:
    return sound.audio_packet_stats(fx.codes(spark, d).select(c("packet").alias("clip_id"), fc.channel(c("ord")).alias("channel"), F.floor(c("ord") / 10).alias("frame_no")))


# ---- ordered rows


@query(f"WITH {fx.PACKETS}, {_OFFSETS} SELECT clip_id, frame_no, CAST(record_pos AS BIGINT) AS record_pos FROM ofs")
def win01_record_offsets(spark: SparkSession, d: str) -> DataFrame:
    return _offsets(spark, d).select("clip_id", "frame_no", "record_pos")


@query(f"""WITH {fx.PACKETS}, {_OFFSETS} SELECT clip_id, frame_no, CAST((((coalesce(lead(o) OVER (PARTITION BY clip_id ORDER BY frame_no), 70000) - o) % 65536) + 65536) % 65536 AS BIGINT) AS size FROM (SELECT clip_id, frame_no, record_pos * 37 % 65536 AS o FROM ofs)""")
def win02_section_sizes(spark: SparkSession, d: str) -> DataFrame:
    directory = _offsets(spark, d).select("clip_id", "frame_no", (c("record_pos") * 37 % 65536).alias("offset"))
    return ordered.section_sizes(directory, ["clip_id"], ["frame_no"], F.lit(70000)).select("clip_id", "frame_no", "size")


# Fixed values, stated for the SQL on its own: the magnitudes of difference codes.
_MAG = """[
0, 8, 16, 32, 48, 64, 80, 96, 112, 128, 144, 160, 176, 192, 208, 224,
240, 256, 272, 288, 304, 320, 336, 352, 368, 384, 400, 416, 432, 448, 464, 480,
496, 512, 520, 528, 536, 544, 552, 560, 568, 576, 584, 592, 600, 608, 616, 624,
632, 640, 648, 656, 664, 672, 680, 688, 696, 704, 712, 720, 728, 736, 744, 752,
760, 768, 776, 784, 792, 800, 808, 816, 824, 832, 840, 848, 856, 864, 872, 880,
888, 896, 904, 912, 920, 928, 936, 944, 952, 960, 968, 976, 984, 992, 1000, 1008,
1016, 1024, 1088, 1152, 1216, 1280, 1344, 1408, 1472, 1536, 1600, 1664, 1728, 1792, 1856, 1920,
1984, 2048, 2304, 2560, 2816, 3072, 3328, 3584, 3840, 4096, 5120, 6144, 7168, 8192, 12288, 16384
]"""
_SAMPLES = fx.CODES + f", st AS (SELECT *, ord // 10 AS part, {_MAG}[code % 128 + 1] * CASE WHEN code >= 128 THEN -1 ELSE 1 END AS step FROM codes), sm AS (SELECT packet, part, ord, CAST(((sum(step) OVER (PARTITION BY packet, part ORDER BY ord) + 32768) % 65536 + 65536) % 65536 - 32768 AS BIGINT) AS sample FROM st)"


def _samples(spark: SparkSession, d: str, size: int = 10) -> DataFrame:
    return sound.wrapping_cumsum(fx.codes(spark, d).withColumn("part", F.floor(c("ord") / size)), ["packet", "part"], ["ord"])


@query(f"WITH {_SAMPLES} SELECT packet, ord, sample FROM sm")
def win03_wrapping_cumsum(spark: SparkSession, d: str) -> DataFrame:
    return _samples(spark, d).select("packet", "ord", "sample")


@query(f"WITH {_SAMPLES} SELECT packet, part, count(*) AS n, CAST(sum(sample) AS BIGINT) AS total FROM sm WHERE ord % 10 >= 8 GROUP BY ALL")
def win04_skip_runway(spark: SparkSession, d: str) -> DataFrame:
    return sound.skip_runway(_samples(spark, d).withColumn("in_part", c("ord") % 10), "in_part").groupBy("packet", "part").agg(F.count("*").alias("n"), F.sum("sample").alias("total"))


# frames of 16 codes, of which 8 are runway; a frame's samples start at 6 * its number, so frames overlap
_PLACED = (
    fx.CODES + f", st AS (SELECT *, ord // 16 AS part, ord % 16 AS o, {_MAG}[code % 128 + 1] * CASE WHEN code >= 128 THEN -1 ELSE 1 END AS step FROM codes), sm AS (SELECT packet, part, o, CAST(((sum(step) OVER (PARTITION BY packet, part ORDER BY ord) + 32768) % 65536 + 65536) % 65536 - 32768 AS BIGINT) AS sample FROM st), "
    "tot AS (SELECT packet AS clip_id, count(*) AS total FROM codes GROUP BY 1), pl AS (SELECT packet AS clip_id, o * 2 + side AS pos, side AS rank, sample + side AS value FROM sm, range(2) t(side) WHERE part = 0 AND o < 4 UNION ALL SELECT packet, 6 * part + part % 2 + 2 * (o - 8), part + 2, sample FROM sm WHERE o >= 8), "
    "il AS (SELECT pl.*, total FROM pl JOIN tot USING (clip_id) WHERE pos >= 0 AND pos < total)"
)


def _interleaved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    codes = fx.codes(spark, d)
    total = codes.groupBy("packet").agg(F.count("*").alias("total"))
    own = sound.wrapping_cumsum(codes.withColumns({"frame_no": F.floor(c("ord") / 16), "o": c("ord") % 16}), ["packet", "frame_no"], ["ord"]).drop("ord").withColumnRenamed("o", "ord").join(total, "packet").withColumnRenamed("packet", "clip_id")
    frames = sound.skip_runway(own).withColumn("abs_pos", 6 * c("frame_no") + c("frame_no") % 2)
    primers = own.where("frame_no = 0 and ord < 4").withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("sample", c("sample") + c("side"))
    return sound.interleave(frames, primers), total.select(c("packet").alias("clip_id"), c("total").alias("size"))


@query(f"WITH {_PLACED} SELECT clip_id, pos, rank, value FROM il")
def win05_interleave(spark: SparkSession, d: str) -> DataFrame:
    return _interleaved(spark, d)[0].select("clip_id", "pos", "rank", "value")


@query(f"WITH {_PLACED} SELECT clip_id, pos, arg_min(value, rank) AS value, arg_max(value, rank) AS compat FROM il GROUP BY ALL")
def win06_overlay_sound(spark: SparkSession, d: str) -> DataFrame:
    placed, _ = _interleaved(spark, d)
    return sound.resolve(placed).join(sound.resolve(placed, "compat").withColumnRenamed("value", "compat"), ["clip_id", "pos"])


@query(f"WITH {fx.PIXELS} SELECT clip_id, x, y, arg_max(idx, frame_no) AS idx FROM pixels GROUP BY ALL")
def win06_overlay_pixels(spark: SparkSession, d: str) -> DataFrame:
    return ordered.overlay(fx.pixels(spark, d), ["clip_id", "x", "y"], ["frame_no"], "idx")


@query(f"WITH {_PLACED}, r AS (SELECT clip_id, pos, arg_min(value, rank) AS value FROM il GROUP BY ALL), e AS (SELECT clip_id, unnest(range(total)) AS pos FROM tot) SELECT clip_id, pos, coalesce(value, 0) AS value FROM e LEFT JOIN r USING (clip_id, pos)")
def win07_densify(spark: SparkSession, d: str) -> DataFrame:
    placed, sizes = _interleaved(spark, d)
    return ordered.densify(sound.resolve(placed), ["clip_id"], sizes)


@query(f"""WITH {_PLACED}, r AS (SELECT clip_id, pos, arg_min(value, rank) AS v FROM il GROUP BY ALL), e AS (SELECT clip_id, unnest(range(total)) AS pos FROM tot), j AS (SELECT clip_id, pos, v, lag(v) OVER w AS p, lead(v) OVER w AS n FROM e LEFT JOIN r USING (clip_id, pos) WINDOW w AS (PARTITION BY clip_id ORDER BY pos))
SELECT clip_id, pos, CAST(coalesce(v, CAST(floor((p + n) / 2.0) AS BIGINT), p, n, 0) AS INTEGER) AS value FROM j""")
def win08_interpolate_spec(spark: SparkSession, d: str) -> DataFrame:
    placed, sizes = _interleaved(spark, d)
    return sound.interpolate(sound.resolve(placed), sizes)


@query(f"""WITH {_PLACED}, r AS (SELECT clip_id, pos, arg_max(value, rank) AS v FROM il GROUP BY ALL), e AS (SELECT clip_id, total, unnest(range(total)) AS pos FROM tot),
o AS (SELECT clip_id, pos // 2 AS k, coalesce(v, 0) AS o FROM e LEFT JOIN r USING (clip_id, pos) WHERE pos % 2 = 1 AND pos < total // 2 * 2),
ev2 AS (SELECT clip_id, k, coalesce(CAST(floor((o + lag(o) OVER (PARTITION BY clip_id ORDER BY k)) / 2.0) AS BIGINT), o) AS e FROM o),
od AS (SELECT clip_id, k, e, CAST(floor((e + lead(e) OVER (PARTITION BY clip_id ORDER BY k)) / 2.0) AS BIGINT) AS o2 FROM ev2), f AS (SELECT clip_id, k, e, coalesce(o2, lag(o2) OVER (PARTITION BY clip_id ORDER BY k), e) AS o2 FROM od)
SELECT clip_id, 2 * k AS pos, CAST(e AS INTEGER) AS value FROM f UNION ALL SELECT clip_id, 2 * k + 1, CAST(o2 AS INTEGER) FROM f""")
def win08_interpolate_compat(spark: SparkSession, d: str) -> DataFrame:
    placed, sizes = _interleaved(spark, d)
    return sound.interpolate(sound.resolve(placed, "compat"), sizes, "compat")


def _lookback_sql(pick: str) -> str:
    return f"""WITH {fx.EVENTS}, l AS (SELECT stream, pos, op, 4 + k % 3 AS argc, list(value) FILTER (op = 'click') OVER (PARTITION BY stream ORDER BY pos ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS p FROM ev),
a AS (SELECT stream, pos, list_reverse({pick}) AS a FROM l WHERE op = 'purchase') SELECT stream, pos, a[1] AS id, a[4] AS x, a[5] AS y, a[3] AS priority, coalesce(a[6], 128) AS scale FROM a WHERE len(a) >= 5"""


def _lookback(spark: SparkSession, d: str, mode: str) -> DataFrame:
    return ordered.lookback_args(fx.events(spark, d), ["stream"], "pos", c("op") == "purchase", c("op") == "click", c("value"), 4 + c("k") % 3, mode=mode)


@query(_lookback_sql("p[1:argc]"))
def win09_lookback_compat(spark: SparkSession, d: str) -> DataFrame:
    return _lookback(spark, d, "compat")


@query(_lookback_sql("p[greatest(1, len(p) - argc + 1):len(p)]"))
def win09_lookback_spec(spark: SparkSession, d: str) -> DataFrame:
    return _lookback(spark, d, "spec")


@query(f"WITH {fx.EVENTS} SELECT stream, pos, last_value(CASE WHEN op = 'purchase' THEN k END IGNORE NULLS) OVER (PARTITION BY stream ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tag FROM ev")
def win10_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.events(spark, d).withColumn("tag", F.when(c("op") == "purchase", c("k")))
    return ordered.carry_forward(rows, ["stream"], ["pos"], "tag").select("stream", "pos", "tag")


@query(f"""WITH {fx.INDEX}, b AS (SELECT *, number % 5 > 0 AS base FROM idx), m AS (SELECT *, coalesce(max("offset") FILTER (base) OVER (PARTITION BY type, number ORDER BY volume, rec, rec2, "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM b) SELECT type, number, volume, count(*) FILTER (base AND ("offset" = 0 OR "offset" >= top)) AS valid, count(*) AS n FROM m GROUP BY ALL""")
def win11_monotone_valid(spark: SparkSession, d: str) -> DataFrame:
    out = ordered.monotone_valid(fx.index(spark, d), ["type", "number"], ["volume", "rec", "rec2", "offset"], c("number") % 5 > 0, place=F.shiftleft(c("volume").cast("bigint"), 40) + c("rec"), levels=3)
    return out.groupBy("type", "number", "volume").agg(F.count_if("valid").alias("valid"), F.count("*").alias("n"))


@query(f"WITH {fx.CELS}, f AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY frame_no, fragment_no) AS n FROM cels) SELECT clip_id, frame_no, x, y FROM f WHERE n = 1 AND x BETWEEN -100 AND 700 AND y BETWEEN -100 AND 550 AND w BETWEEN 1 AND 640 AND h BETWEEN 1 AND 480")
def win12_first_per_group(spark: SparkSession, d: str) -> DataFrame:
    return ordered.first_per_group(fx.cels(spark, d), ["clip_id"], ["frame_no", "fragment_no"], fc.valid_fragment(c("x"), c("y"), c("w"), c("h"))).select("clip_id", "frame_no", "x", "y")


_U16 = "b AS (SELECT doc_id, encode(text) AS content, octet_length(encode(text)) AS size FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, size, pos, CAST('0x' || hex(content[pos + 2:pos + 2]) || hex(content[pos + 1:pos + 1]) AS BIGINT) AS v FROM (SELECT *, unnest(range(50, size - 4)) AS pos FROM b WHERE size >= 100))"


@query(f"WITH {_U16} SELECT doc_id, min(pos) FILTER (v % 1000 BETWEEN 1 AND 39 AND pos + 2 + 2 * (v % 1000) <= size) AS first_pos FROM w GROUP BY 1")
def win13_first_satisfying(spark: SparkSession, d: str) -> DataFrame:
    size = F.length("content")

    def fits(v: F.Column, pos: F.Column) -> F.Column:
        return (v % 1000).between(1, 39) & (pos + 2 + 2 * (v % 1000) <= size)

    return fx.contents(spark, d).where(size >= 100).select("doc_id", by.first_u16(c("content"), 50, size - 5, fits).alias("first_pos"))


@query(f"""WITH {fx.EVENTS}, m AS (SELECT stream, pos, op, lead(op) OVER (PARTITION BY stream ORDER BY pos) AS nx, list(k) OVER (PARTITION BY stream ORDER BY pos ROWS BETWEEN 40 PRECEDING AND 40 FOLLOWING) AS ctx FROM ev) SELECT stream, pos, list_aggregate(ctx, 'string_agg', ',') AS context FROM m WHERE op = 'click' AND nx = 'purchase'""")
def win14_match_context(spark: SparkSession, d: str) -> DataFrame:
    out = ordered.match_context(fx.events(spark, d), ["stream"], "pos", c("op") == "click", c("op") == "purchase", "k")
    return out.select("stream", "pos", F.array_join("context", ",").alias("context"))


@query(f"WITH {fx.PACKETS} SELECT clip_id, frame_no, packet_size FROM packets WHERE frame_no < 3")
def lim02_limit_frames(spark: SparkSession, d: str) -> DataFrame:
    return ordered.limit_frames(fx.packets(spark, d), 3).select("clip_id", "frame_no", "packet_size")


@query(f"WITH {fx.EVENTS} SELECT stream, pos FROM ev WHERE pos < 5 OR pos % 10 = 0")
def lim03_thin(spark: SparkSession, d: str) -> DataFrame:
    return ordered.thin(fx.events(spark, d), index="pos").select("stream", "pos")


@query(f"WITH {fx.EVENTS}, v AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY pos) AS n FROM ev WHERE k < 80) SELECT stream, pos FROM v WHERE n <= 10 OR pos % 10 = 0")
def lim03_thin_valid(spark: SparkSession, d: str) -> DataFrame:
    return ordered.thin_valid(fx.events(spark, d), ["stream"], ["pos"], c("k") < 80, index="pos").select("stream", "pos")


@query(f"""WITH {fx.INDEX}, n AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY number, volume, rec, rec2, "offset") AS n FROM idx) SELECT type, number, volume, "offset" FROM n WHERE n <= 100""")
def lim04_head_per_group(spark: SparkSession, d: str) -> DataFrame:
    return ordered.head_per_group(fx.index(spark, d), ["type"], ["number", "volume", "rec", "rec2", "offset"], 100).select("type", "number", "volume", "offset")


@query(f"""WITH {fx.MERGED} SELECT type, number, "offset", row_number() OVER (PARTITION BY type ORDER BY number) AS rank FROM merged""")
def lim01_sorted_index(spark: SparkSession, d: str) -> DataFrame:
    """The merged index in order of (type, number), with each entry's rank in its type."""
    merged = keyed.merge_index(fx.index(spark, d))
    return ordered.ranked(merged.select("type", "number", "offset"), ["type"], ["number"], bucket_rows=1 << 12).orderBy("type", "number")


# ---- sources and inference, as tables


@query("SELECT page_id, coalesce(try_cast(regexp_extract(regexp_extract(url, '([^/\\\\]+)$', 1), '^\\s*([+-]?\\d+)', 1) AS INTEGER), 0) AS key, upper(regexp_extract(regexp_extract(url, '([^/\\\\]+)$', 1), '\\.([^.]*)$', 1)) AS ext FROM pages")
def src02_key_from_path(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "pages").select("page_id", ft.key_from_path(c("url")).alias("key"), ft.extension_upper(c("url")).alias("ext"))


@query(f"WITH {fx.POSITIONS} SELECT clip_id, ord, x, y FROM positions WHERE clip_id >= 0")
def src04_first_available(spark: SparkSession, d: str) -> DataFrame:
    p = fx.positions(spark, d)
    return keyed.first_available([p.where("clip_id < 0"), p, p.where("ord % 2 = 0")]).select("clip_id", "ord", "x", "y")


_NUM = "'^\\s*([+-]?\\d+)\\s+([+-]?\\d+)\\s+([+-]?\\d+)'"


@query(f"WITH {fx.LINES} SELECT CAST(regexp_extract(line, {_NUM}, 1) AS INTEGER) AS clip_id, CAST(regexp_extract(line, {_NUM}, 2) AS SMALLINT) AS x, CAST(regexp_extract(line, {_NUM}, 3) AS SMALLINT) AS y, ord FROM lines WHERE line NOT LIKE '#%' AND regexp_matches(line, {_NUM})")
def src05_read_positions(spark: SparkSession, d: str) -> DataFrame:
    return files.read_positions(fx.lines(spark, d))


@query(f"""WITH {fx.LINES}, p AS (SELECT ord, line, regexp_matches(line, {_NUM}) AS simple, contains(line, 'Robot ') AND contains(line, 'at (x=') AS worded FROM lines)
SELECT CAST(CASE WHEN simple THEN regexp_extract(line, {_NUM}, 1) ELSE regexp_extract(line, 'Robot (\\d+)', 1) END AS INTEGER) AS clip_id, CAST(CASE WHEN simple THEN regexp_extract(line, {_NUM}, 2) ELSE regexp_extract(line, 'x=(-?\\d+)', 1) END AS INTEGER) AS x, CAST(CASE WHEN simple THEN regexp_extract(line, {_NUM}, 3) ELSE regexp_extract(line, 'y=(-?\\d+)', 1) END AS INTEGER) AS y, ord FROM p WHERE simple OR worded""")
def src06_parse_position_lines(spark: SparkSession, d: str) -> DataFrame:
    return files.parse_position_lines(fx.lines(spark, d))


@query(f"""WITH {fx.LINES}, p AS (SELECT ord, line, regexp_matches(line, {_NUM}) AS simple, contains(line, 'Robot ') AND contains(line, 'at (x=') AS worded FROM lines),
r AS (SELECT CAST(CASE WHEN simple THEN regexp_extract(line, {_NUM}, 1) ELSE regexp_extract(line, 'Robot (\\d+)', 1) END AS INTEGER) % 50 AS clip_id, CAST(CASE WHEN simple THEN regexp_extract(line, {_NUM}, 2) ELSE regexp_extract(line, 'x=(-?\\d+)', 1) END AS INTEGER) AS x, CAST(CASE WHEN simple THEN regexp_extract(line, {_NUM}, 3) ELSE regexp_extract(line, 'y=(-?\\d+)', 1) END AS INTEGER) AS y, ord FROM p WHERE simple OR worded)
SELECT clip_id, arg_max(x, ord) AS x, arg_max(y, ord) AS y, max(ord) AS ord FROM r GROUP BY 1""")
def src06_last_position_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = files.parse_position_lines(fx.lines(spark, d)).withColumn("clip_id", c("clip_id") % 50)
    return files.last_positions(lines).select("clip_id", "x", "y", "ord")


@query(f"WITH {fx.CELS}, {fx.PALETTE} SELECT k AS clip_id, i AS idx, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b FROM (SELECT DISTINCT clip_id % 5 AS k FROM cels) CROSS JOIN range(256) t(i) LEFT JOIN palette ON palette.idx = i AND (i + k) % 3 > 0")
def src11_palette_dimension(spark: SparkSession, d: str) -> DataFrame:
    some = fx.cels(spark, d).select((c("clip_id") % 5).alias("clip_id")).distinct()
    every = some.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(255))))
    return palettes.full_palette(pixels.apply_palette(every, fx.palette(spark)).where((c("idx") + c("clip_id")) % 3 > 0), ["clip_id"])


@query(f"""WITH {fx.INDEX}, s AS (SELECT *, row_number() OVER (PARTITION BY number % 50 ORDER BY rec, volume, rec2, "offset", type) AS n FROM idx), t AS (SELECT number % 50 AS g, n, rec, volume, rec2, "offset", type, CASE WHEN number % 50 > 25 THEN "offset" * 2000 ELSE "offset" END AS o6, 128 + number % 24 AS type9, number AS number9, CASE WHEN number % 3 = 0 THEN 0 ELSE n * 10 + number % 7 * (number % 50) END AS o9 FROM s WHERE n <= 100),
b AS (SELECT *, type9 BETWEEN 128 AND 149 AND o9 < 150000000 AND number9 < 100000 AS base FROM t), m AS (SELECT *, coalesce(max(o9) FILTER (base) OVER (PARTITION BY g ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM b),
v AS (SELECT g, count(*) FILTER (o6 < 150000000) AS v6, count(*) FILTER (base AND (o9 = 0 OR o9 >= top)) AS v9, count(*) AS n FROM m GROUP BY 1)
SELECT g, v6, v9, CASE WHEN v6 >= n * 0.5 AND v6 > v9 THEN 'six' WHEN v9 >= n * 0.5 THEN 'nine' ELSE 'unknown' END AS format FROM v""")
def src13_sniff_format(spark: SparkSession, d: str) -> DataFrame:
    number = c("number")
    rows = ordered.head_per_group(fx.index(spark, d).withColumn("g", number % 50), ["g"], ["rec", "volume", "rec2", "offset", "type"], 100, number="n")
    rows = rows.select("g", "n", F.lit(0).alias("number6"), F.when(number % 50 > 25, c("offset") * 2000).otherwise(c("offset")).alias("offset6"), (128 + number % 24).alias("type9"), number.alias("number9"), F.when(number % 3 == 0, 0).otherwise(c("n") * 10 + number % 7 * (number % 50)).alias("offset9"))
    return infer.sniff_format(rows, ["g"], ["n"])


@query(f"""WITH {fx.INDEX}, s AS (SELECT number, type, sum(data_size) AS size FROM idx GROUP BY ALL), v AS (SELECT number, type, CASE WHEN size = 0 THEN NULL WHEN size % 6 = 0 AND size % 5 <> 0 THEN 6 WHEN size % 5 = 0 AND size % 6 <> 0 THEN 5 END AS vote FROM s) SELECT number, coalesce(arg_min(vote, type) FILTER (vote IS NOT NULL), 6) AS width FROM v GROUP BY 1""")
def src14_infer_width(spark: SparkSession, d: str) -> DataFrame:
    sections = fx.index(spark, d).groupBy("number", "type").agg(F.sum("data_size").alias("size"))
    return infer.infer_width(sections, ["number"])


@query(f"""WITH {fx.PACKETS}, f AS (SELECT clip_id, frame_no, packet_size AS a, video_size + 7 AS b FROM packets WHERE frame_no < 8), cand AS (SELECT * FROM (VALUES (0, 0, 'A'), (1, 0, 'B'), (2, 6, 'A'), (3, 6, 'B')) t(cand, base, ord)),
p AS (SELECT clip_id, cand, base, ord, base + coalesce(sum(CASE WHEN ord = 'A' THEN b ELSE a END) OVER (PARTITION BY clip_id, cand ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM f, cand), s AS (SELECT clip_id, cand, base, ord, count(*) FILTER (pos * 7 % 11 < 5) AS score FROM p GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY score DESC, cand) AS n FROM s) SELECT clip_id, base AS cand_base, ord AS cand_order, score FROM n WHERE n = 1""")
def src15_resolve_order(spark: SparkSession, d: str) -> DataFrame:
    frames = fx.packets(spark, d).select("clip_id", "frame_no", c("packet_size").alias("a_size"), (c("video_size") + 7).alias("b_size"))
    return infer.resolve_order(frames, ["clip_id"], ["frame_no"], c("cand_pos") * 7 % 11 < 5)


@query(f"WITH {fx.CODES}, t AS (SELECT *, coalesce(last_value(CASE WHEN code >= 128 THEN code % 128 END IGNORE NULLS) OVER (PARTITION BY packet ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 255) AS tag FROM codes) SELECT packet, ord, code, tag FROM t WHERE code < 128")
def src16_fill_tags(spark: SparkSession, d: str) -> DataFrame:
    return ordered.fill_tags(fx.codes(spark, d), ["packet"], ["ord"]).select("packet", "ord", "code", "tag")


# ---- reports


@query(f"""WITH {fx.MERGED} SELECT type, number, number || ' -> Offset: ' || "offset" || ' (0x' || lower(to_hex("offset")) || ')' || CASE WHEN volume = 0 THEN '' ELSE ', Volume: ' || volume END AS line FROM merged""")
def snk01_catalog_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.catalog_lines(keyed.merge_index(fx.index(spark, d)))


@query(f"WITH {fx.POSITIONS} SELECT clip_id, ord, rpad(CAST(clip_id AS VARCHAR), 10, ' ') || rpad(CAST(x AS VARCHAR), 6, ' ') || rpad(CAST(y AS VARCHAR), 6, ' ') AS line FROM positions")
def snk02_positions_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.position_lines(fx.positions(spark, d))


@query(f"""WITH {fx.CELS}, f AS (SELECT clip_id, frame_no, '{{"frame":' || frame_no || ',"fragments":[' || string_agg('{{"x":' || x || ',"y":' || y || ',"width":' || width || '}}', ',' ORDER BY fragment_no) || ']}}' AS s FROM cels GROUP BY clip_id, frame_no) SELECT clip_id, '{{"robot":' || clip_id || ',"frames":[' || string_agg(s, ',' ORDER BY frame_no) || ']}}' AS json FROM f GROUP BY 1""")
def snk04_clips_json(spark: SparkSession, d: str) -> DataFrame:
    return reports.clips_json(fx.cels(spark, d))


@query(f"WITH {fx.CELS}, f AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY frame_no, fragment_no) AS n FROM cels) SELECT clip_id, format('{{:4d}} {{:4d}} {{:4d}}', clip_id, x, y) AS line FROM f WHERE n = 1 AND w BETWEEN 1 AND 640")
def snk05_first_position_text(spark: SparkSession, d: str) -> DataFrame:
    return reports.first_position_lines(fx.cels(spark, d), c("w").between(1, 640))


@query(f"WITH {fx.CELS} SELECT clip_id, frame_no, arg_min(x, cel_no) AS x, arg_min(y, cel_no) AS y, arg_min(w, cel_no) AS w, arg_min(h, cel_no) AS h FROM cels GROUP BY ALL")
def snk08_cel_positions(spark: SparkSession, d: str) -> DataFrame:
    return reports.cel_positions(fx.cels(spark, d))


# ---- scalar functions


@query("""WITH b AS (SELECT doc_id, encode(text) AS t FROM documents WHERE octet_length(encode(text)) >= 8), h AS (SELECT doc_id, [CAST('0x' || hex(t[i:i]) AS BIGINT) FOR i IN range(1, 9)] AS v FROM b)
SELECT doc_id, v[1] + 256 * v[2] AS le16, v[2] + 256 * v[1] AS be16, CAST((v[1] + 256 * v[2] + 32768) % 65536 - 32768 AS BIGINT) AS s16, v[3] + 256 * v[4] + 65536 * v[5] + 16777216 * v[6] AS le32, v[6] + 256 * v[5] + 65536 * v[4] + 16777216 * v[3] AS be32, v[1] + 256 * v[2] + 65536 * v[3] AS le24,
v[1] % 32 AS low5, v[1] % 128 AS low7, v[1] // 128 AS top, (v[1] + 256 * v[2] + 65536 * v[3]) // 262144 % 64 AS vol18, (v[1] + 256 * v[2] + 65536 * v[3]) % 262144 AS off18, lower(to_hex(v[1] + 256 * v[2])) AS hex16 FROM h""")
def fn01_byte_reads(spark: SparkSession, d: str) -> DataFrame:
    b = c("content")
    rows = fx.contents(spark, d).where(F.length("content") >= 8)
    vol, off = by.packed_offset(by.u24(b, 0), "18")
    return rows.select(
        "doc_id", by.u16(b, 0).alias("le16"), by.u16(b, 0, True).alias("be16"), by.s16(b, 0).alias("s16"), by.u32(b, 2).alias("le32"), by.u32(b, 2, True).alias("be32"), by.u24(b, 0).alias("le24"),
        by.bits(by.u8(b, 0), 0x1F).alias("low5"), by.bits(by.u8(b, 0), 0x7F).alias("low7"), by.bits(by.u8(b, 0), 1, 7).alias("top"), vol.alias("vol18"), off.alias("off18"), by.hex_lower(by.u16(b, 0)).alias("hex16"),
    )


@query("SELECT l_orderkey, CAST(sum(o & 4194303) + sum(((o >> 30) & 3) << 22) AS BIGINT) AS off22, CAST(sum((o >> 22) & 255) AS BIGINT) AS vol22 FROM (SELECT l_orderkey, CAST(floor(l_extendedprice * 40000) AS BIGINT) AS o FROM lineitem) GROUP BY 1")
def fn02_packed_offset(spark: SparkSession, d: str) -> DataFrame:
    vol, off = by.packed_offset(F.floor(c("l_extendedprice") * 40000).cast("bigint"), "22")
    return fx.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(off).alias("off22"), F.sum(vol).alias("vol22"))


@query(f"WITH {fx.CODES} SELECT DISTINCT code, {_MAG}[code % 128 + 1] * CASE WHEN code >= 128 THEN -1 ELSE 1 END AS step FROM codes")
def fn04_sign_magnitude(spark: SparkSession, d: str) -> DataFrame:
    return fx.codes(spark, d).select("code", fk.magnitude(c("code")).alias("step")).distinct()


@query("SELECT o_orderkey, 'frame_' || CASE WHEN o_orderkey < 10000 THEN lpad(CAST(o_orderkey AS VARCHAR), 4, '0') ELSE CAST(o_orderkey AS VARCHAR) END AS name FROM orders")
def fn06_frame_name(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "orders").select("o_orderkey", ft.frame_name(c("o_orderkey")).alias("name"))


@query("SELECT p_partkey, CAST(p_size * 10 AS INTEGER) AS w, CAST(p_partkey % 500 AS INTEGER) AS h FROM part")
def fn08_parse_size(spark: SparkSession, d: str) -> DataFrame:
    w, h = ft.parse_size(F.concat((c("p_size") * 10).cast("string"), F.lit("x"), (c("p_partkey") % 500).cast("string")))
    return fx.table(spark, d, "part").select("p_partkey", w.alias("w"), h.alias("h"))


@query("SELECT label, vec_id, array_to_string([CAST(floor(v * 100) AS BIGINT) FOR v IN embedding], ',') AS listed FROM embeddings")
def fn09_number_list(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "embeddings").select("label", "vec_id", ft.number_list(F.transform("embedding", lambda v: ft.whole(v * F.lit(100).cast("float")))).alias("listed"))


@query(f"WITH {fx.CELS} SELECT clip_id, frame_no, cel_no, CAST(trunc((640 - w) / 2.0) AS BIGINT) AS cx, CAST(trunc((480 - h) / 2.0) AS BIGINT) AS cy FROM cels")
def fn10_centred(spark: SparkSession, d: str) -> DataFrame:
    x, y = fc.centred(c("w"), c("h"))
    return fx.cels(spark, d).select("clip_id", "frame_no", "cel_no", x.alias("cx"), y.alias("cy"))


# ---- palettes of documents' own colours: a palette per part size


def _own_palette(spark: SparkSession, d: str, which: int) -> DataFrame:
    rows = fx.table(spark, d, "part").withColumn("idx", (c("p_partkey") * 7 % 256).cast("int")).groupBy("idx").agg(F.sum("p_partkey").alias("s"), F.sum("p_size").alias("z"))
    return rows.select("idx", (c("s") * (which + 3) % 256).alias("r"), (c("z") * (which + 5) % 256).alias("g"), ((c("s") + c("z")) * (which + 1) % 256).alias("b"), (c("z") % 3 > 0).alias("used"))


def _own_sql(which: int, name: str) -> str:
    return f"{name} AS (SELECT idx, CAST(s * {which + 3} % 256 AS BIGINT) AS r, CAST(z * {which + 5} % 256 AS BIGINT) AS g, CAST((s + z) * {which + 1} % 256 AS BIGINT) AS b, z % 3 > 0 AS used FROM (SELECT CAST(p_partkey * 7 % 256 AS INTEGER) AS idx, sum(p_partkey) AS s, sum(p_size) AS z FROM part GROUP BY 1))"


_PQ = f"WITH {_own_sql(0, 'p')}, {_own_sql(9, 'q')}"


@query(f"{_PQ} SELECT idx, " + ", ".join(f"CASE WHEN q.used THEN q.{x} ELSE p.{x} END AS {x}" for x in "rgb") + " FROM p LEFT JOIN q USING (idx)")
def doc01_merge_palette(spark: SparkSession, d: str) -> DataFrame:
    return palettes.merge_palette(_own_palette(spark, d, 0), _own_palette(spark, d, 9))


@query(f"{_PQ} SELECT idx, " + ", ".join(f"CAST(CASE WHEN idx BETWEEN 10 AND 200 THEN p.{x} + trunc((q.{x} - p.{x}) * 37 / 100.0) ELSE p.{x} END AS BIGINT) AS {x}" for x in "rgb") + " FROM p JOIN q USING (idx)")
def doc02_vary(spark: SparkSession, d: str) -> DataFrame:
    return palettes.vary(_own_palette(spark, d, 0), _own_palette(spark, d, 9), 37, 10, 200)


@query(f"{_PQ} SELECT p.idx, s.r, s.g, s.b FROM p JOIN p s ON s.idx = CASE WHEN p.idx BETWEEN 20 AND 29 THEN 20 + (3 + p.idx - 20) % 10 WHEN p.idx BETWEEN 40 AND 63 THEN 40 + (7 + p.idx - 40) % 24 ELSE p.idx END")
def doc03_cycle(spark: SparkSession, d: str) -> DataFrame:
    cyclers = spark.createDataFrame([(20, 10, 3), (40, 24, 7)], "first int, n int, shift int")
    return palettes.cycle(_own_palette(spark, d, 0).drop("used"), cyclers)


@query(f"{_PQ} SELECT idx, " + ", ".join(f"CASE WHEN idx BETWEEN 5 AND 235 THEN least(255, {x} * 140 // 100) ELSE {x} END AS {x}" for x in "rgb") + " FROM p")
def doc04_fade(spark: SparkSession, d: str) -> DataFrame:
    return palettes.fade(_own_palette(spark, d, 0), 140, 5, 255)


@query(f"{_PQ} SELECT idx, " + ", ".join(f"{x} * {x} // 255 AS {x}" for x in "rgb") + " FROM p")
def doc05_gamma(spark: SparkSession, d: str) -> DataFrame:
    table = spark.range(256).select(c("id").alias("value"), F.floor(c("id") * c("id") / 255).alias("to"))
    return palettes.gamma(_own_palette(spark, d, 0).drop("used"), table)


@query(f"{_PQ} SELECT idx, " + ", ".join(f"CASE WHEN idx >= 30 AND idx < 90 THEN 255 - {x} ELSE {x} END AS {x}" for x in "rgb") + " FROM p")
def doc06_invert(spark: SparkSession, d: str) -> DataFrame:
    return palettes.invert(_own_palette(spark, d, 0), 30, 90)


@query(f"WITH {fx.PIXELS} SELECT clip_id, CAST(sum(CASE WHEN idx BETWEEN 10 AND 20 THEN (idx + 250) % 256 ELSE idx END) AS BIGINT) AS total FROM pixels GROUP BY 1")
def doc07_remap_range(spark: SparkSession, d: str) -> DataFrame:
    return fx.pixels(spark, d).groupBy("clip_id").agg(F.sum(palettes.remap_range(c("idx"), 10, 20, 250)).alias("total"))


@query(f"{_PQ}, s AS (SELECT idx, r * 60 // 100 AS r, g * 60 // 100 AS g, b * 60 // 100 AS b FROM p) SELECT s.idx, arg_min(p.idx, ((s.r - p.r) * (s.r - p.r) + (s.g - p.g) * (s.g - p.g) + (s.b - p.b) * (s.b - p.b)) * 256 + p.idx) AS \"to\" FROM s, p GROUP BY 1")
def doc08_remap_percent(spark: SparkSession, d: str) -> DataFrame:
    return palettes.remap_percent(_own_palette(spark, d, 0), 60)


@query(f"WITH {fx.CELS} SELECT clip_id, frame_no, cel_no, CAST(trunc(x * 640 / 320.0) AS BIGINT) AS sx, CAST(trunc(y * 480 / 200.0) AS BIGINT) AS sy, CAST(trunc(x * 200 / 480.0) AS BIGINT) AS inverse, CAST(trunc(x * (cel_no + 77) / 128.0) AS BIGINT) AS scaled FROM cels")
def doc09_screen_scaling(spark: SparkSession, d: str) -> DataFrame:
    at = lambda v, r: fc.lowres_to_screen(c(v), r)
    return fx.cels(spark, d).select("clip_id", "frame_no", "cel_no", at("x", (640, 320)).alias("sx"), at("y", (480, 200)).alias("sy"), at("x", (200, 480)).alias("inverse"), fc.manual_scale(c("x"), c("cel_no") + 77).alias("scaled"))


@query(f"WITH {fx.EVENTS}, e AS (SELECT stream AS clip_id, pos % 2 AS channel, pos, CAST(pos * 3 + k AS BIGINT) AS \"end\" FROM ev), m AS (SELECT *, coalesce(max(\"end\") OVER (PARTITION BY clip_id, channel ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rd FROM e) SELECT clip_id, channel, pos, \"end\" FROM m WHERE \"end\" > rd")
def doc11_drop_consumed(spark: SparkSession, d: str) -> DataFrame:
    p = fx.events(spark, d).select(c("stream").alias("clip_id"), (c("pos") % 2).alias("channel"), "pos", (c("pos") * 3 + c("k")).cast("bigint").alias("end"))
    return sound.drop_consumed(p, ["pos"])


@query(f"WITH {fx.CODES}, st AS (SELECT packet, ord, ord % 2 AS side, {_MAG}[code % 128 + 1] * CASE WHEN code >= 128 THEN -1 ELSE 1 END AS step FROM codes) SELECT packet, ord, side, CAST(((sum(step) OVER (PARTITION BY packet, side ORDER BY ord) + 32768) % 65536 + 65536) % 65536 - 32768 AS BIGINT) AS sample FROM st")
def doc12_stereo(spark: SparkSession, d: str) -> DataFrame:
    return sound.stereo_cumsum(fx.codes(spark, d), ["packet"]).select("packet", "ord", "side", "sample")


@query(f"""WITH RECURSIVE {fx.CODES}, st AS (SELECT packet, ord, {_MAG}[code % 128 + 1] * CASE WHEN code >= 128 THEN -1 ELSE 1 END AS step FROM codes), f AS (SELECT packet, ord, greatest(-32768, least(32767, step)) AS sample FROM st WHERE ord = 0 UNION ALL SELECT st.packet, st.ord, greatest(-32768, least(32767, f.sample + st.step)) FROM f JOIN st ON st.packet = f.packet AND st.ord = f.ord + 1) SELECT packet, count(*) AS n, CAST(sum(sample) AS BIGINT) AS total, CAST(arg_max(sample, ord) AS INTEGER) AS last FROM f GROUP BY 1""")
def doc12_saturating(spark: SparkSession, d: str) -> DataFrame:
    out = sound.saturating_samples(fx.codes(spark, d), ["packet"])
    return out.groupBy("packet").agg(F.count("*").alias("n"), F.sum("sample").alias("total"), F.max_by("sample", "ord").alias("last"))


# ---- binary layouts: bytes written from the tables by expressions, read back by the operators


def _le(v: F.Column, n: int, big: F.Column | bool = False) -> F.Column:
    """n bytes of an integer as hexadecimal digits, little-endian (or as the column big says)."""
    digits = [F.lpad(F.hex(F.shiftright(v.cast("bigint"), 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(n)]
    little = F.concat(*digits)
    return little if big is False else F.when(big, F.concat(*reversed(digits))).otherwise(little)


@query(f"""WITH {fx.CLIPS} SELECT clip_id, clip_id % 2 = 1 AS big_endian, 5 + clip_id % 2 AS version, 2000 + clip_id AS audio_block_size, frames, palette_size, clip_id % 640 AS x_res, -(clip_id % 480) AS y_res, has_audio, fps, clip_id * 100 AS area_0, -clip_id AS area_3 FROM clips WHERE clip_id % 7 > 0""")
def src08_decode_header(spark: SparkSession, d: str) -> DataFrame:
    k, big = c("clip_id"), c("clip_id") % 2 == 1
    e = lambda v, n: _le(v, n, big)
    header = [
        F.lit("1600534F4C00"), e(5 + k % 2 + F.when(k % 7 == 0, 40).otherwise(0), 2), e(2000 + k, 2), e(F.lit(0), 2), F.lit("0000"), e(c("frames"), 2), e(c("palette_size"), 2), e(F.lit(0), 2), e(k % 640, 2), e(-(k % 480), 2),
        F.lit("00"), F.when(c("has_audio"), "01").otherwise("00"), F.lit("0000"), e(c("fps"), 2), e(F.lit(1), 2), e(F.lit(2), 2), e(F.lit(3), 2), e(k * 100, 4), e(F.lit(5), 4), e(F.lit(6), 4), e(-k, 4), F.lit("00" * 8),
    ]
    out = files.decode_header(fx.clips(spark, d).select("clip_id", F.unhex(F.concat(*header)).alias("content")))
    return out.select("clip_id", "big_endian", "version", "audio_block_size", "frames", "palette_size", "x_res", "y_res", "has_audio", "fps", "area_0", "area_3")


@query("""WITH p AS (SELECT p_partkey // 500 AS volume, p_partkey % 4 AS rec, p_partkey % 65536 AS number, CAST(floor(p_retailprice * 10) AS BIGINT) AS "offset" FROM part)
SELECT CASE rec WHEN 0 THEN 136 WHEN 1 THEN 135 WHEN 2 THEN 128 ELSE 131 END AS type, number, "offset", volume, rec, row_number() OVER (PARTITION BY volume, rec ORDER BY number) - 1 AS rec2 FROM p""")
def src07_explode_fixed_records(spark: SparkSession, d: str) -> DataFrame:
    k = c("p_partkey")
    parts = fx.table(spark, d, "part").select(F.floor(k / 500).alias("volume"), (k % 4).alias("t"), (k % 65536).alias("number"), F.floor(c("p_retailprice") * 10).alias("o"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("number", "o"))), lambda s: F.concat(_le(s["number"], 2), _le(s["o"], 4)))
    sections = parts.groupBy("volume", "t").agg(F.concat_ws("", rows).alias("hex"))
    shard = sections.groupBy("volume").agg(F.array_sort(F.collect_list(F.struct("t", "hex"))).alias("s"))
    n = F.size("s")
    at = lambda i: (n + 1) * 3 + F.aggregate(F.slice("s", 1, i), F.lit(0), lambda a, x: a + (F.length(x["hex"]) / 2).cast("int"))
    directory = F.concat_ws("", F.transform("s", lambda x, i: F.concat(_le(x["t"] + 128, 1), _le(at(i), 2))))
    content = F.unhex(F.concat(directory, F.lit("FF"), _le(at(n), 2), F.concat_ws("", F.transform("s", lambda x: x["hex"]))))
    maps = shard.select("volume", content.alias("content"))
    directories = files.read_directory(maps)
    sized = ordered.section_sizes(directories, ["volume"], ["ord"], c("file_size")).where("type <> 31")
    width = maps.select("volume", F.lit(6).alias("width"))
    return files.explode_fixed_records(maps, sized, width)


@query("""WITH o AS (SELECT o_orderkey, o_custkey % 200 + 1 AS n, CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 200 + 1 < 150 THEN 13 WHEN o_orderkey % 3 = 1 THEN 10 ELSE 6 END AS h FROM orders)
SELECT o_orderkey, CAST(h AS VARCHAR) AS dialect, CASE h WHEN 13 THEN n % 33 WHEN 10 THEN n % 9 ELSE 0 END AS method, n AS packed_size, CASE h WHEN 13 THEN n * 2 WHEN 10 THEN n * 3 ELSE n END AS size,
CASE WHEN n > 150 THEN 'size over volume' WHEN h + n > 150 THEN 'payload past end' END AS reason FROM o""")
def src09_decode_resource_header(spark: SparkSession, d: str) -> DataFrame:
    k, n = c("o_orderkey"), c("n")
    rows = fx.table(spark, d, "orders").select("o_orderkey", (c("o_custkey") % 200 + 1).alias("n"))
    long = F.concat(F.lit("00"), _le(k % 65536, 2), _le(n, 4), _le(n * 2, 4), _le(n % 33, 2))
    mid = F.concat(F.lit("81"), _le(k % 65536, 2), _le(n, 3), _le(n % 9, 1), _le(n * 3, 3), F.lit("FFFFFF"))
    short = F.concat(F.lit("01"), _le(k % 65536, 2), _le(n, 3), F.lit("FFFFFFFFFFFFFF"))
    content = F.unhex(F.concat(F.when(k % 3 == 0, long).when(k % 3 == 1, mid).otherwise(short), F.lit("00" * 200)))
    out = files.decode_resource_header(rows.select("o_orderkey", content.alias("content"), F.lit(0).alias("offset"), F.lit(150).cast("bigint").alias("volume_size")))
    return out.select("o_orderkey", "dialect", "method", "packed_size", "size", "reason")


@query(f"""WITH {fx.CELS}, n AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY frame_no, cel_no) - 1 AS rec, chunks % 40 AS ds FROM cels), s AS (SELECT *, 2 + coalesce(sum(22 + ds) OVER (PARTITION BY clip_id ORDER BY rec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM n)
SELECT clip_id, rec, CAST(pos AS BIGINT) AS rec_pos, ds AS rec_size, w, h, x, y FROM s""")
def src10_explode_chained(spark: SparkSession, d: str) -> DataFrame:
    chain = files.explode_chained(_chained(spark, d), c("content"), F.lit(2), by.u16(c("content"), 0), size_at=14, most=1000)
    return files.decode_cels(chain, c("content"), c("rec_pos")).select("clip_id", "rec", "rec_pos", "rec_size", "w", "h", "x", "y")


def _chained(spark: SparkSession, d: str) -> DataFrame:
    """clip_id and content: a count and then all of a clip's cels with their data, one behind another.

    Cels in the order of frame_no and cel_no (fixtures.cels): those that differ in neither key nor l_quantity have the same bytes, so
    their order does not matter, and rows move once, with four numbers beside the key.
    """
    cels = F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))

    def one(r: F.Column) -> F.Column:
        w, h, x, y = r["l_partkey"] * 3 % 660, r["l_suppkey"] * 5 % 490, r["l_partkey"] % 720 - 40, r["l_suppkey"] * 7 % 520 - 30
        ds = F.floor(r["l_quantity"] * 2 + 3) % 40
        return F.concat(F.lit("0064"), _le(w, 2), _le(h, 2), F.lit("00000000"), _le(x, 2), _le(y, 2), _le(ds, 2), F.lit("010000000000"), F.repeat(F.lit("AB"), ds.cast("int")))

    content = F.unhex(F.concat(_le(F.size(cels), 2), F.concat_ws("", F.transform(F.array_sort(cels), one))))
    return fx.table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("clip_id")).agg(content.alias("content"))


@query(f"WITH {fx.CLIPS} SELECT clip_id, CAST(i AS INTEGER) AS cue_no, clip_id * 7 + i * 3 - 900 AS t, (clip_id * 31 + i * 257) % 65536 AS v FROM clips, range(256) r(i)")
def src12_explode_cues(spark: SparkSession, d: str) -> DataFrame:
    k, big, i256 = c("clip_id"), c("clip_id") % 2 == 1, F.sequence(F.lit(0), F.lit(255))
    t = F.concat_ws("", F.transform(i256, lambda i: _le(k * 7 + i * 3 - 900, 4, big)))
    v = F.concat_ws("", F.transform(i256, lambda i: _le((k * 31 + i * 257) % 65536, 2, big)))
    rows = fx.clips(spark, d).select("clip_id", big.alias("big"), F.unhex(F.concat(t, v)).alias("content"))
    return files.explode_cues(rows, c("content"), F.lit(0), c("big"))


# ---- rows of the inventory that share an operator with another


@query(f"WITH {fx.CODES} SELECT code, code % 32 AS low5, code % 128 AS low7, code // 128 AS top, count(*) AS n FROM codes GROUP BY ALL")
def fn03_masks(spark: SparkSession, d: str) -> DataFrame:
    return fx.codes(spark, d).groupBy("code", by.bits(c("code"), 0x1F).alias("low5"), by.bits(c("code"), 0x7F).alias("low7"), by.bits(c("code"), 1, 7).alias("top")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, lower(to_hex(o_orderkey)) AS hex FROM orders")
def fn05_hex(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "orders").select("o_orderkey", by.hex_lower(c("o_orderkey")).alias("hex"))


@query("SELECT page_id, regexp_extract(url, '([^/\\\\]+)$', 1) AS name, regexp_extract(regexp_extract(url, '([^/\\\\]+)$', 1), '^(.*?)(?:\\.[^.]*)?$', 1) AS stem, regexp_extract(regexp_extract(url, '([^/\\\\]+)$', 1), '^([^.]*)', 1) AS first FROM pages")
def fn07_path_parts(spark: SparkSession, d: str) -> DataFrame:
    u = c("url")
    return fx.table(spark, d, "pages").select("page_id", ft.file_name(u).alias("name"), ft.stem(u).alias("stem"), ft.stem(u, last_dot=False).alias("first"))


@query(f"""WITH {fx.POSITIONS}, m AS (SELECT clip_id, x, 0 AS prio FROM positions WHERE clip_id < 12 UNION ALL SELECT s_suppkey % 30, s_suppkey % 300, 1 FROM supplier WHERE s_suppkey % 30 NOT IN (SELECT clip_id FROM positions WHERE clip_id < 12)) SELECT clip_id, count(*) AS n, CAST(sum(x) AS BIGINT) AS total, max(prio) = 1 AS added FROM m GROUP BY 1""")
def set03_keyed_union(spark: SparkSession, d: str) -> DataFrame:
    k = c("s_suppkey")
    extra = fx.table(spark, d, "supplier").select((k % 30).alias("clip_id"), (k % 300).alias("x"))
    merged = keyed.merge_missing(fx.positions(spark, d).where("clip_id < 12").select(c("clip_id").cast("bigint").alias("clip_id"), "x"), extra, ["clip_id"])
    return merged.groupBy("clip_id").agg(F.count("*").alias("n"), F.sum("x").alias("total"), F.bool_or("added").alias("added"))


@query(f"WITH {fx.CODES} SELECT DISTINCT code FROM codes")
def set04_distinct(spark: SparkSession, d: str) -> DataFrame:
    return fx.codes(spark, d).select("code").distinct()


@query(f"""WITH {fx.CLIPS}, {fx.CELS}, {_EXTENTS}, {fx.POSITIONS}, {_FIRST}, w AS (SELECT *, CASE WHEN clip_id % 3 = 0 THEN 640 + clip_id % 7 WHEN clip_id % 3 = 1 THEN 0 END AS cw, 480 AS ch FROM clips) SELECT c.clip_id, frames, fps, CASE WHEN fps > 0 THEN round(frames / CAST(fps AS DOUBLE), 2) END AS seconds,
CASE WHEN px IS NULL THEN coalesce(max_w, 630) WHEN cw > 0 THEN cw ELSE 630 END AS canvas_w, CASE WHEN px IS NULL THEN coalesce(max_h, 450) ELSE ch END AS canvas_h, px AS x, py AS y, has_audio, palette_size // 3 AS colours FROM w c LEFT JOIN ext USING (clip_id) LEFT JOIN first ON key = c.clip_id""")
def snk07_clip_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of clips on canvases of given sizes, some of them null or zero."""
    own = fx.clips(spark, d)
    at = keyed.lookup_first(own.select("clip_id"), fx.positions(spark, d), ["clip_id"], ["ord"], ["x", "y"])
    k = c("clip_id")
    canvas = (F.when(k % 3 == 0, 640 + k % 7).when(k % 3 == 1, 0), F.lit(480).cast("bigint"))
    return reports.clip_metadata(own, pixels.max_extents(fx.cels(spark, d), ["clip_id"]), at, canvas)


@query(f"WITH {fx.CELS}, {_EXTENTS}, f AS (SELECT clip_id, frame_no, arg_min(x, cel_no) AS x, arg_min(y, cel_no) AS y FROM cels GROUP BY ALL) SELECT clip_id, frame_no, x, y, CASE WHEN max_w > 0 AND max_h > 0 THEN max_w ELSE 630 END AS w, CASE WHEN max_w > 0 AND max_h > 0 THEN max_h ELSE 450 END AS h FROM f LEFT JOIN ext USING (clip_id)")
def snk08_cel_positions_compat(spark: SparkSession, d: str) -> DataFrame:
    return reports.cel_positions(fx.cels(spark, d), pixels.max_extents(fx.cels(spark, d), ["clip_id"]))


@query(f"WITH {fx.CELS} SELECT clip_id, frame_no, min(x) AS min_x, min(y) AS min_y, max(x + width) AS max_x, CAST(-32767 AS BIGINT) AS max_y FROM cels GROUP BY ALL")
def agg04_fragment_bbox_compat(spark: SparkSession, d: str) -> DataFrame:
    return pixels.fragment_bbox(fx.cels(spark, d), ["clip_id", "frame_no"], "compat")


@query(f"WITH {fx.CLIPS} SELECT clip_id, 3 + clip_id % 5 AS version, frames FROM clips WHERE 3 + clip_id % 5 BETWEEN 4 AND 6")
def src08_decode_header_v4(spark: SparkSession, d: str) -> DataFrame:
    k = c("clip_id")
    content = F.unhex(F.concat(F.lit("1600534F4C00"), _le(3 + k % 5, 2), _le(k, 2), F.lit("00000000"), _le(c("frames"), 2), F.lit("00" * 44)))
    return files.decode_header(fx.clips(spark, d).select("clip_id", content.alias("content")), versions=(4, 6)).select("clip_id", "version", "frames")


# ---- runs instead of pixels, chains by pointer jumping, JSON in pieces


@query(f"WITH {fx.PIXEL_RUNS} SELECT clip_id, y, idx, count(*) AS n, CAST(sum(x) AS BIGINT) AS total_x FROM shown GROUP BY ALL")
def win06_overlay_runs(spark: SparkSession, d: str) -> DataFrame:
    shown = pixels.overlay_runs(fx.pixel_runs(spark, d), ["clip_id", "y"], ["ord"])
    middle = (c("count") * (2 * c("start") + c("count") - 1) / 2).cast("bigint")
    return shown.groupBy("clip_id", "y", "idx").agg(F.sum("count").alias("n"), F.sum(middle).alias("total_x"))


@query(f"WITH {fx.PIXEL_RUNS} SELECT clip_id, min(x) FILTER (idx <> 255) AS min_x, min(y) FILTER (idx <> 255) AS min_y, max(x) FILTER (idx <> 255) AS max_x, max(y) FILTER (idx <> 255) AS max_y, max(x) FILTER (idx <> 255) - min(x) FILTER (idx <> 255) + 1 AS w, max(y) FILTER (idx <> 255) - min(y) FILTER (idx <> 255) + 1 AS h FROM shown GROUP BY 1")
def agg02_runs_bbox(spark: SparkSession, d: str) -> DataFrame:
    return pixels.runs_bbox(pixels.overlay_runs(fx.pixel_runs(spark, d), ["clip_id", "y"], ["ord"]), ["clip_id"])


@query(f"WITH {fx.PIXEL_RUNS}, {fx.PALETTE}, l AS (SELECT clip_id, s.idx, r, g, b FROM shown s JOIN palette USING (idx)) SELECT clip_id, " + ", ".join(f"CAST(sum(CASE WHEN idx < 236 THEN {x} ELSE 0 END) AS BIGINT) AS base_{x}, CAST(sum(CASE WHEN idx BETWEEN 236 AND 254 THEN {x} ELSE 0 END) AS BIGINT) AS remap_{x}" for x in "rgb") + ", CAST(sum(CASE WHEN idx = 255 THEN 0 ELSE 255 END) AS BIGINT) AS alpha FROM l GROUP BY 1")
def prj02_split_runs(spark: SparkSession, d: str) -> DataFrame:
    """Sums of the layers, from runs: a run's pixels have the same layers."""
    shown = pixels.overlay_runs(fx.pixel_runs(spark, d), ["clip_id", "y"], ["ord"])
    layers = pixels.split_layers(pixels.apply_palette(shown, fx.palette(spark)))
    return layers.groupBy("clip_id").agg(*[F.sum(c(n) * c("count")).alias(n) for n in [*[f"{k}_{x}" for k in ("base", "remap") for x in "rgb"], "alpha"]])


@query(f"""WITH {fx.CELS}, n AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY frame_no, cel_no) - 1 AS rec, chunks % 40 AS ds FROM cels) SELECT clip_id, rec, CAST(2 + coalesce(sum(22 + ds) OVER (PARTITION BY clip_id ORDER BY rec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM n""")
def src10_follow_chain(spark: SparkSession, d: str) -> DataFrame:
    blob = _chained(spark, d)
    links = files.chain_candidates(blob, ["clip_id"], c("content"), lambda p: F.hex(by.part(c("content"), p, 2)) == "0064", 2, size_at=14)
    return files.follow_chain(links, blob.select("clip_id", F.lit(2).alias("pos")), ["clip_id"]).select("clip_id", "rec", "pos")


@query(f"""WITH {fx.CELS}, f AS (SELECT clip_id, frame_no, '{{"frame":' || frame_no || ',"fragments":[' || string_agg('{{"x":' || x || ',"y":' || y || ',"width":' || width || '}}', ',' ORDER BY fragment_no) || ']}}' AS s FROM cels GROUP BY clip_id, frame_no), j AS (SELECT '{{"robot":' || clip_id || ',"frames":[' || string_agg(s, ',' ORDER BY frame_no) || ']}}' AS json, clip_id FROM f GROUP BY clip_id) SELECT clip_id, CAST(length(json) AS BIGINT) AS n, md5(json) AS md5 FROM j""")
def snk04_json_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The JSON in pieces, put together again."""
    pieces = reports.clip_json_pieces(fx.cels(spark, d))
    whole = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("frame_no", "fragment_no", "piece"))), lambda p: p["piece"]))
    return pieces.groupBy("clip_id").agg(whole.alias("json")).select("clip_id", F.length("json").cast("bigint").alias("n"), F.md5("json").alias("md5"))


@query(f"WITH {fx.CELS} SELECT clip_id, frame_no, cel_no, CAST(trunc(x * w / 128.0) AS BIGINT) AS scaled FROM cels")
def doc10_manual_scale(spark: SparkSession, d: str) -> DataFrame:
    return fx.cels(spark, d).select("clip_id", "frame_no", "cel_no", fc.manual_scale(c("x"), c("w")).alias("scaled"))
