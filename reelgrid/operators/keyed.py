"""Keyed lookups with precedence, merges of shards, and the aggregates of catalogues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lookup_first(left: DataFrame, right: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """left with values of the first matching row of right (nulls if none) and found."""
    best = right.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_v"))
    return _with(left, best, keys, values)


def lookup_last(left: DataFrame, right: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """As lookup_first, with the last matching row."""
    best = right.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v"))
    return _with(left, best, keys, values)


def _with(left: DataFrame, best: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return left.join(best, keys, "left").select(*left.columns, *[F.col(f"_v.{v}").alias(v) for v in values], F.col("_v").isNotNull().alias("found"))


def merge_missing(primary: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """primary, and the rows of extra whose key it lacks; added tells them apart."""
    more = extra.join(primary.select(*keys).distinct(), keys, "left_anti")
    return primary.withColumn("added", F.lit(False)).unionByName(more.select(*primary.columns).withColumn("added", F.lit(True)))


def first_available(frames: list[DataFrame]) -> DataFrame:
    """The rows of the first of some DataFrames that has any."""
    tagged = reduce(DataFrame.unionByName, [f.withColumn("_prio", F.lit(i)) for i, f in enumerate(frames)])
    best = tagged.agg(F.min("_prio").alias("_prio"))  # one row
    return tagged.join(F.broadcast(best), "_prio").drop("_prio")


def append_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of some DataFrames, with ord_part, the place of the one they come from."""
    return reduce(DataFrame.unionByName, [f.withColumn("ord_part", F.lit(i)) for i, f in enumerate(frames)])


def merge_index(index: DataFrame) -> DataFrame:
    """One row per (type, number): the highest shard's, and in it the last record's. An aggregate with partial results, so a hot key costs nothing more."""
    return index.groupBy("type", "number").agg(F.max_by(F.struct("offset", "volume"), F.struct("volume", "rec", "rec2")).alias("_v")).select("type", "number", "_v.offset", "_v.volume")


def resolve_resources(wanted: DataFrame, index: DataFrame, volumes: DataFrame, header: int = 13) -> DataFrame:
    """wanted (type, number) with offset, volume, size and status: not_indexed, volume_not_loaded, bad_offset, bad_payload or ok. volumes: volume, volume_size. Payload sizes come from index's data_size if it has one."""
    has_size = "data_size" in index.columns
    own = index.select("type", "number", "offset", "volume", *(["data_size"] if has_size else []))
    found = wanted.join(own, ["type", "number"], "left").withColumn("_indexed", F.col("offset").isNotNull()).withColumn("volume", F.coalesce("volume", F.lit(1)))
    found = found.join(volumes.select("volume", "volume_size"), "volume", "left")
    bad = F.lit(False)
    if has_size:
        bad = (F.col("data_size") <= 0) | (F.col("offset") + header + F.col("data_size") > F.col("volume_size"))
    status = F.when(~F.col("_indexed"), "not_indexed").when(F.col("volume_size").isNull(), "volume_not_loaded").when(F.col("offset") + header > F.col("volume_size"), "bad_offset").when(bad, "bad_payload").otherwise("ok")
    return found.select(*wanted.columns, F.when(F.col("_indexed"), F.col("volume")).alias("volume"), "offset", status.alias("status"))


def pick(resources: DataFrame, wanted: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of resources for each key of wanted (key, ord), with ord."""
    first = resources.join(wanted.select(key), key, "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
    return first.join(wanted.select(key, F.col("ord").alias("pick_ord")), key)


def counts_by_type(index: DataFrame) -> DataFrame:
    """type, n (its rows) and distinct_n (its distinct numbers), by one aggregation."""
    return index.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("number").alias("distinct_n"))


def run_summary(results: DataFrame, ok: str = "ok") -> DataFrame:
    """total, success, failed, exit_code: one row."""
    out = results.agg(F.count("*").alias("total"), F.count_if(F.col(ok)).alias("success"))
    return out.withColumn("failed", F.col("total") - F.col("success")).withColumn("exit_code", F.when(F.col("failed") > 0, 1).otherwise(0))


def valid_ratio(frames: DataFrame, by: list[str], valid: str = "valid") -> DataFrame:
    out = frames.groupBy(*by).agg(F.count_if(F.col(valid)).alias("valid"), F.count("*").alias("total"))
    return out.withColumn("ratio", F.try_divide(F.col("valid").cast("double"), F.col("total").cast("double")))


def match_summary(calls: DataFrame, script: str = "script_id") -> DataFrame:
    return calls.agg(F.countDistinct(script).alias("scripts"), F.count("*").alias("matches"))


def catalog_totals(index: DataFrame) -> DataFrame:
    return index.agg(F.countDistinct("type", "number").alias("resources"), F.countDistinct("volume").alias("volumes"))
