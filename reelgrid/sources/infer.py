"""Layouts inferred by vote: record format, record width, table order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import head_per_group, monotone_valid, record_offsets


def infer_width(sections: DataFrame, by: list[str], default: int = 6) -> DataFrame:
    """Record width: the vote of the first section, by type, whose size is a multiple of just one of 5 and 6."""
    size = F.col("size")
    vote = F.when(size == 0, None).when((size % 6 == 0) & (size % 5 != 0), 6).when((size % 5 == 0) & (size % 6 != 0), 5)
    return sections.withColumn("_v", vote).groupBy(*by).agg(F.coalesce(F.min_by("_v", F.when(F.col("_v").isNotNull(), F.col("type"))), F.lit(default)).alias("width"))


def sniff_format(rows: DataFrame, by: list[str], order: list[str], sample: int = 100, threshold: float = 0.5) -> DataFrame:
    """six, nine or unknown per group, by the first sample records read both ways.

    rows: type6, number6, offset6 and type9, number9, offset9 (nulls where a reading has no such record).
    """
    top = head_per_group(rows, by, order, sample)
    ok6 = (F.col("offset6") < 150_000_000) & (F.col("number6") < 65536)
    base9 = F.col("type9").between(0x80, 0x95) & (F.col("offset9") < 150_000_000) & (F.col("number9") < 100_000)
    marked = monotone_valid(top.withColumn("offset", F.col("offset9")), by, order, F.coalesce(base9, F.lit(False)), bucket_rows=None)
    votes = marked.groupBy(*by).agg(F.count_if(ok6).alias("v6"), F.count_if("valid").alias("v9"), F.greatest(F.count("offset6"), F.count("offset9")).alias("n"))
    six = (F.col("v6") >= F.col("n") * threshold) & (F.col("v6") > F.col("v9"))
    return votes.select(*by, "v6", "v9", F.when(six, "six").when(F.col("v9") >= F.col("n") * threshold, "nine").otherwise("unknown").alias("format"))


def resolve_order(frames: DataFrame, by: list[str], order: list[str], plausible: Column, first: int = 8) -> DataFrame:
    """The base offset and table order whose first records look most like frames.

    frames: a_size and b_size (the two tables) in order, and what plausible reads from them. plausible may use cand_pos (the
    record's place) and cand_base. Candidates are tried as (0, A), (0, B), (6, A), (6, B); the first of the best wins.
    """
    top = head_per_group(frames, by, order, first)
    tried = F.array(*[F.struct(F.lit(i).alias("cand"), F.lit(b).alias("cand_base"), F.lit(o).alias("cand_order")) for i, (b, o) in enumerate(((0, "A"), (0, "B"), (6, "A"), (6, "B")))])
    every = top.withColumn("_c", F.explode(tried)).select("*", "_c.*").drop("_c")
    every = every.withColumn("cand_size", F.when(F.col("cand_order") == "A", F.col("b_size")).otherwise(F.col("a_size")))
    every = record_offsets(every, [*by, "cand"], order, "cand_size", F.col("cand_base"), 1, bucket_rows=None).withColumnRenamed("record_pos", "cand_pos")
    votes = every.groupBy(*by, "cand", "cand_base", "cand_order").agg(F.count_if(plausible).alias("score"))
    return votes.groupBy(*by).agg(F.max_by(F.struct("cand_base", "cand_order", "score"), F.struct("score", -F.col("cand"))).alias("_v")).select(*by, "_v.*")
