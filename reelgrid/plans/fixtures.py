"""Tables of clips, indexes, positions and sounds derived from the driver's tables, each with the same derivation in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as 8 x 8 rasters: clip_id, frame_no, x, y, idx."""
    v = table(spark, sf_dir, "embeddings").select(F.col("label").alias("clip_id"), F.col("vec_id").alias("frame_no"), F.posexplode("embedding").alias("p", "v"))
    return v.select("clip_id", "frame_no", (F.col("p") % 8).alias("x"), F.floor(F.col("p") / 8).cast("int").alias("y"), F.pmod(F.floor(F.col("v") * 1024), F.lit(256)).cast("int").alias("idx"))


PIXELS = "pixels AS (SELECT label AS clip_id, vec_id AS frame_no, p % 8 AS x, p // 8 AS y, CAST(((CAST(floor(v * 1024) AS BIGINT) % 256) + 256) % 256 AS INTEGER) AS idx FROM (SELECT label, vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings))"


def pixel_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of pixels written one over another: clip_id, y, ord, start, count, idx."""
    c = F.col
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("clip_id"), (c("l_suppkey") % 2).alias("y"), F.row_number().over(w).alias("ord"), (c("l_partkey") % 60).alias("start"), (c("l_quantity") + 7).cast("bigint").alias("count"), (c("l_suppkey") % 8 * 32 + 31).alias("idx"))


PIXEL_RUNS = "runs AS (SELECT l_orderkey AS clip_id, l_suppkey % 2 AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ord, l_partkey % 60 AS start, CAST(floor(l_quantity + 7) AS BIGINT) AS count, l_suppkey % 8 * 32 + 31 AS idx FROM lineitem), shown AS (SELECT clip_id, y, x, arg_max(idx, ord) AS idx FROM (SELECT *, start + unnest(range(count)) AS x FROM runs) GROUP BY ALL)"


def palette(spark: SparkSession, _: str = "") -> DataFrame:
    i = F.col("idx")
    return spark.range(256).select(F.col("id").cast("int").alias("idx")).select("idx", (7 * i % 256).alias("r"), ((13 * i + 5) % 256).alias("g"), ((29 * i + 11) % 256).alias("b"))


PALETTE = "palette AS (SELECT CAST(i AS INTEGER) AS idx, 7 * i % 256 AS r, (13 * i + 5) % 256 AS g, (29 * i + 11) % 256 AS b FROM range(256) t(i))"


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of clips: clip_id, frame_no, packet_size, video_size."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    size = F.col("l_quantity").cast("int")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("clip_id"), (F.row_number().over(w) - 1).alias("frame_no"), size.alias("packet_size"), F.greatest(F.lit(0), size - 3 * F.col("l_linenumber")).alias("video_size"))


PACKETS = "packets AS (SELECT l_orderkey AS clip_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS frame_no, CAST(floor(l_quantity) AS INTEGER) AS packet_size, greatest(0, CAST(floor(l_quantity) AS INTEGER) - 3 * l_linenumber) AS video_size FROM lineitem)"


def cels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cels: clip_id, frame_no, cel_no, x, y, w, h, data_size, chunks, count, video_size, width, fragment_no."""
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("clip_id"), c("l_linenumber").alias("frame_no"), (F.row_number().over(w) - 1).alias("cel_no"), (c("l_partkey") % 720 - 40).alias("x"), (c("l_suppkey") * 7 % 520 - 30).alias("y"), (c("l_partkey") * 3 % 660).alias("w"), (c("l_suppkey") * 5 % 490).alias("h"),
        F.floor(c("l_extendedprice") * 3).cast("bigint").alias("data_size"), F.floor(c("l_quantity") * 2 + 3).cast("bigint").alias("chunks"), (c("l_linenumber") + c("l_suppkey") % 8).alias("count"), F.floor(c("l_extendedprice") * 20).cast("bigint").alias("video_size"),
    ).select("*", c("w").alias("width"), c("cel_no").alias("fragment_no"))


CELS = "cels AS (SELECT *, w AS width, cel_no AS fragment_no FROM (SELECT l_orderkey AS clip_id, l_linenumber AS frame_no, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS cel_no, l_partkey % 720 - 40 AS x, l_suppkey * 7 % 520 - 30 AS y, l_partkey * 3 % 660 AS w, l_suppkey * 5 % 490 AS h, CAST(floor(l_extendedprice * 3) AS BIGINT) AS data_size, CAST(floor(l_quantity * 2 + 3) AS BIGINT) AS chunks, l_linenumber + l_suppkey % 8 AS count, CAST(floor(l_extendedprice * 20) AS BIGINT) AS video_size FROM lineitem))"


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw index records: type, number, volume, rec, rec2, offset, data_size."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(c("l_returnflag").alias("type"), c("l_partkey").alias("number"), c("l_linenumber").alias("volume"), c("l_orderkey").alias("rec"), c("l_suppkey").alias("rec2"), F.floor("l_extendedprice").cast("bigint").alias("offset"), F.floor(c("l_quantity")).cast("bigint").alias("data_size"))


INDEX = "idx AS (SELECT l_returnflag AS type, l_partkey AS number, l_linenumber AS volume, l_orderkey AS rec, l_suppkey AS rec2, CAST(floor(l_extendedprice) AS BIGINT) AS \"offset\", CAST(floor(l_quantity) AS BIGINT) AS data_size FROM lineitem)"
MERGED = INDEX + ", merged AS (SELECT type, number, \"offset\", volume, data_size FROM (SELECT *, row_number() OVER (PARTITION BY type, number ORDER BY volume DESC, rec DESC, rec2 DESC, \"offset\" DESC) AS n FROM idx) WHERE n = 1)"


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("clip_id"), k.alias("ord"), (k % 841 - 100).alias("x"), (k % 681 - 100).alias("y"))


POSITIONS = "positions AS (SELECT c_nationkey AS clip_id, c_custkey AS ord, c_custkey % 841 - 100 AS x, c_custkey % 681 - 100 AS y FROM customer)"


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips that may have positions: clip_id, frames, fps, palette_size, has_audio, big_endian."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("clip_id"), (k * 37 % 211).alias("frames"), (k % 16).alias("fps"), (k * 11 % 1200).alias("palette_size"), (k % 3 == 0).alias("has_audio"))


CLIPS = "clips AS (SELECT s_suppkey AS clip_id, s_suppkey * 37 % 211 AS frames, s_suppkey % 16 AS fps, s_suppkey * 11 % 1200 AS palette_size, s_suppkey % 3 = 0 AS has_audio FROM supplier)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of operations: stream, pos, op, value (int), k."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), (F.row_number().over(w) - 1).alias("pos"), F.col("event_type").alias("op"), F.floor("value").cast("bigint").alias("value"), F.get_json_object("props", "$.k").cast("int").alias("k"))


EVENTS = "ev AS (SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS op, CAST(floor(value) AS BIGINT) AS value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference codes: packet, ord, code."""
    high = F.when(F.col("op").isin("error", "view"), 128).otherwise(0)
    return events(spark, sf_dir).select(F.col("stream").alias("packet"), F.col("pos").alias("ord"), (F.col("k") + high).alias("code"))


CODES = EVENTS + ", codes AS (SELECT stream AS packet, pos AS ord, k + CASE WHEN op IN ('error', 'view') THEN 128 ELSE 0 END AS code FROM ev)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position lines, every seventh a comment: ord, line; some without a third number."""
    c = F.col
    text = F.when(c("ord") % 11 == 0, F.concat_ws(" ", "clip_id", "x")).when(c("ord") % 13 == 0, F.concat(F.lit("Robot "), c("clip_id"), F.lit(" found at (x="), c("x"), F.lit(", y="), c("y"), F.lit(")"))).otherwise(F.concat_ws(" ", "clip_id", "x", "y", F.lit("trailing")))
    return positions(spark, sf_dir).select("ord", F.when(c("ord") % 7 == 0, F.concat(F.lit("#"), text)).otherwise(text).alias("line"))


LINES = POSITIONS + ", lines AS (SELECT ord, CASE WHEN ord % 7 = 0 THEN '#' || line ELSE line END AS line FROM (SELECT ord, CASE WHEN ord % 11 = 0 THEN clip_id || ' ' || x WHEN ord % 13 = 0 THEN 'Robot ' || clip_id || ' found at (x=' || x || ', y=' || y || ')' ELSE clip_id || ' ' || x || ' ' || y || ' trailing' END AS line FROM positions))"


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes: doc_id, content."""
    return table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
