"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a row of slots of block words each. Slot k takes the golden-ratio point frac(k * 0.381966...), and the interval
of cumulative target shares that holds the point names its source; a source's slots are ranked, and slot r takes words
[r * block, (r + 1) * block) of the source's stream, its documents in the order of a hash, one after another, and again
from the start. How much a source gives is what its slots hold: within a few blocks of its target, from the first slots to
the last, and never more than most times its size. Blocks and the number of slots both grow with the root of the input.

Sizes are counted once, next to the texts; only (doc_id, source, size) rows move. Running totals, of documents' places
and of slots' ranks, are taken in two levels (within bounded buckets, then over the buckets), so a source with a third of
all rows is never in one task. Per-source tables have one row a source and pass through one task: sources may be millions,
not billions.

Null texts and texts without a word have size 0 and take no part. A null source is a source. Rows that share a doc_id are
documents of their own; rows that are equal in all columns are alike. Extra columns are ignored. An empty table gives no
rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, lookup, ready, runs_by, saved, text_hash

#: 2**32 / (golden ratio squared), rounded: multiples of it modulo 2**32 are the golden-ratio points.
STEP, ONE = 1640531527, 1 << 32


def _rest(docs: DataFrame) -> Column:
    """A hash of all columns that can be hashed."""
    return F.xxhash64(*[docs[f.name] for f in docs.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"])


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and hashes of the text (h) and of the row (g) that tell apart rows with one doc_id."""
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), text_hash().alias("h"), _rest(docs).alias("g"))


def targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source: rank (by code point, null last), weight, source_size, target and cap (the most whole words that it may give).

    The targets sum to share times all sizes, by weight, but none above most times its source's size: each is the lesser
    of that and level * weight, for the one level that gives the sum.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    ranked = per.withColumn("rank", rank).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    by = Window.orderBy(F.col("_cap") / F.col("weight"), "rank")
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("_level", level)
    fits = F.col("_level") * F.col("weight") <= F.col("_cap")
    ranked = ranked.withColumn("_at", F.min(F.when(fits, F.struct((F.col("_cap") / F.col("weight")).alias("r"), F.col("rank"), F.col("_level").alias("level")))).over(every)["level"])
    target = F.when(F.col("_at").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_at") * F.col("weight")))
    return ranked.select("source", "rank", "weight", "source_size", target.alias("target"), F.floor("_cap").cast("long").alias("cap"))


def placed(sized: DataFrame) -> DataFrame:
    """sized with at: the words of its source before it, in the order of a hash of doc_id and row. There are as many buckets as rows in a bucket, so a task of either level grows with the root of the input only."""
    buckets = max(1, math.isqrt(sized.count()))
    # buckets are ranges of the order's first key, so that the order within and over buckets is one order
    top = F.shiftrightunsigned(F.xxhash64("doc_id", "g", F.lit("mix")), 33)
    rows = sized.withColumn("_o", top).withColumn("_b", F.floor(F.col("_o") * F.lit(buckets) / F.lit(float(1 << 31))))
    inside = Window.partitionBy("source", "_b").orderBy("_o", "doc_id", "g", "h").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("source", "_b").agg(F.sum("size").alias("_n"))
    base = base.select("source", "_b", F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("_base"))
    rows = rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long")))
    right = base.select(F.col("source").alias("_s"), F.col("_b").alias("_b2"), "_base")
    joined = rows.join(right, rows["source"].eqNullSafe(right["_s"]) & (rows["_b"] == right["_b2"]))
    return joined.select("doc_id", "source", "size", "h", "g", (F.col("_base") + F.col("_in")).alias("at"))


def block_of(per: DataFrame) -> int:
    """Words in a slot: with T words in the mix there are 32 times the root of T slots."""
    total = per.agg(F.sum("target")).first()[0] or 0.0
    return max(1, math.isqrt(int(total)) // 32)


def schedule(per: DataFrame, block: int, cells: int = 4096) -> DataFrame:
    """slot, rank (the source's), r (the slot's place among the source's), for as many slots as the targets of per fill."""
    per = per.where("target > 0").select("rank", "target")
    total = math.ceil((per.agg(F.sum("target")).first()[0] or 0.0) / block)
    chunk = max(1, math.isqrt(total))  # as many chunks as slots in a chunk
    every = Window.orderBy("rank")
    whole = F.sum("target").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    share = per.withColumn("_hi", F.when(F.row_number().over(every) == F.count("*").over(Window.partitionBy()), F.lit(ONE)).otherwise(F.floor(F.sum("target").over(every) / whole * F.lit(float(ONE)))).cast("long"))
    share = share.withColumn("_lo", F.lag("_hi", 1, 0).over(every)).where("_lo < _hi")
    share = share.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") / (ONE // cells)), F.floor((F.col("_hi") - 1) / (ONE // cells)))))
    point = (F.pmod(F.col("slot"), F.lit(ONE)) * F.lit(STEP)) % F.lit(ONE)
    slots = per.sparkSession.range(total).select(F.col("id").alias("slot")).withColumn("_u", point).withColumn("_cell", F.floor(F.col("_u") / (ONE // cells)))
    found = lookup_range(slots, share).withColumn("_chunk", F.floor(F.col("slot") / chunk))
    inside = F.row_number().over(Window.partitionBy("rank", "_chunk").orderBy("slot"))
    found = saved(found.withColumn("_i", inside), "slots")
    counts = found.groupBy("rank", "_chunk").agg(F.max("_i").alias("_n"))
    before = Window.partitionBy("rank").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("rank", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_base"))
    return found.join(counts, ["rank", "_chunk"]).select("slot", "rank", (F.col("_base") + F.col("_i") - 1).alias("r"))


def lookup_range(slots: DataFrame, share: DataFrame) -> DataFrame:
    """Each slot's source: an equal join on cells of the unit interval, then the exact interval within the cell."""
    return slots.join(share, "_cell").where("_u >= _lo and _u < _hi").select("slot", "rank")


def mix(located: DataFrame, per: DataFrame, block: int) -> DataFrame:
    """The mix of what placed() gives, as spans of documents: slot, place (words before it in the slot), source, doc_id, h, g, at, pass, start, length."""
    slots = saved(schedule(per, block), "schedule")
    made = slots.groupBy("rank").agg(F.count("*").alias("_made"))
    gives = F.least(F.col("_made") * block, F.col("cap"))
    right = per.join(made, "rank").select("source", "rank", gives.alias("gives"), "source_size")
    docs = lookup(located, right, ["source"])
    # the source's stream runs through its documents again and again; spans are cut at what its slots take
    last = F.floor((F.col("gives") - F.col("at") - 1) / F.col("source_size"))
    docs = docs.where("gives > at").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    docs = docs.withColumn("_a", F.col("at") + F.col("pass") * F.col("source_size")).withColumn("_z", F.least(F.col("_a") + F.col("size"), F.col("gives")))
    docs = docs.withColumn("r", F.explode(F.sequence(F.floor(F.col("_a") / block), F.floor((F.col("_z") - 1) / block))))
    begin = F.greatest(F.col("_a"), F.col("r") * block)
    length = F.least(F.col("_z"), (F.col("r") + 1) * block) - begin
    docs = docs.select("rank", "r", "source", "doc_id", "h", "g", "at", "pass", (begin - F.col("r") * block).alias("place"), (begin - F.col("_a")).alias("start"), length.alias("length"))
    return docs.join(slots, ["rank", "r"]).drop("rank", "r")


def mixed_sizes(docs: DataFrame, block: int | None = None, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, first_slot (the first slot that takes from it, null if none does)."""
    sized = saved(sizes(docs), "sizes")
    per = saved(targets(sized, weights, share, most), "targets")
    located = saved(placed(sized.where("size > 0")), "placed")
    # within a source, a document with a word is named by its place
    taken = mix(located, per, block or block_of(per)).groupBy("source", "at").agg(F.sum("length").alias("taken"), F.min("slot").alias("first_slot"))
    got = located.join(taken.select(F.col("source").alias("_source"), F.col("at").alias("_at"), "taken", "first_slot"), _same(["source", "at"]), "left")
    got = got.select("doc_id", "source", "h", "size", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "first_slot")
    out = got.unionByName(sized.where("size = 0").select("doc_id", "source", "h", "size", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot")))
    return lookup(out, per.select("source", "source_size", "target"), ["source"]).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def _same(names: list[str]) -> Column:
    on = None
    for n in names:
        one = F.col(n).eqNullSafe(F.col(f"_{n}"))
        on = one if on is None else on & one
    return on


def mixed_documents(docs: DataFrame, block: int | None = None, part_words: int = 4_000_000, unpacked: int = 64_000_000, **options) -> DataFrame:
    """The mix as documents, in the order of its slots: a row of docs for each time that the mix takes from it, at the first
    slot that does, its text cut to the words taken (a text taken whole is unchanged). n_chars, if there, is counted anew.
    Partitions are ranges of slots of about part_words words; written and read in order, they are the mix."""
    ready(docs.sparkSession)
    sized = saved(sizes(docs), "sizes")
    per = saved(targets(sized, **options), "targets")
    block = block or block_of(per)
    words = per.agg(F.sum("target")).first()[0] or 0.0
    total, parts = math.ceil(words / block), max(1, math.ceil(words / part_words))
    spans = mix(saved(placed(sized.where("size > 0")), "placed"), per, block)
    # two hashes name a row
    key = lambda h, g: (F.xxhash64(F.col("doc_id").isNull(), "doc_id", h, F.col("source").isNull(), "source").alias("_key"), F.xxhash64(g, h).alias("_row"))
    taken = spans.groupBy(*key("h", "g"), "at", "pass").agg(F.min(F.struct("slot", "place")).alias("_first"), F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end"))
    taken = taken.groupBy("_key", "_row").agg(F.collect_list(F.struct("_first.slot", "_first.place", "start", "end")).alias("_taken"))
    # rows that are equal in all columns: one stands for all, with what the mix takes from any of them
    others = [c for c in docs.columns if c != "text"]
    own = docs.select(F.struct(*[docs[c] for c in others]).alias("_doc"), F.col("text").cast("string").alias("_text"), "doc_id", F.col("source").cast("string").alias("source"), text_hash().alias("_h"), _rest(docs).alias("_g"))
    own = own.select("_doc", "_text", *key("_h", "_g"))
    joined = own.dropDuplicates(["_key", "_row"]).join(taken, ["_key", "_row"]).select("_doc", "_text", "_taken")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, zstd = re.compile(WORD), pa.Codec("zstd")
        for batch in batches:
            rows, texts, sizes_, slots, places = [], [], [], [], []
            for i, (text, spans_) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                at = [m.span() for m in word.finditer(text)]
                for s in spans_:
                    whole = s["start"] == 0 and s["end"] == len(at)
                    data = (text if whole else text[at[s["start"]][0] : at[s["end"] - 1][1]]).encode("utf-8", "surrogatepass")
                    texts.append(zstd.compress(data, asbytes=True))
                    sizes_.append(len(data))
                    rows.append(i)
                    slots.append(s["slot"])
                    places.append(s["place"])
            more = [pa.array(texts, pa.binary()), *[pa.array(x, pa.int64()) for x in (sizes_, slots, places)]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *more], names=["_doc", "_packed", "_size", "_slot", "_place"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = pa.Codec("zstd")
        for batch in batches:
            packed, sizes_ = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            # what comes out is bounded by its own bytes, not by those of the compressed texts
            for a, b in runs_by(sizes_, unpacked):
                texts = [zstd.decompress(x, decompressed_size=n, asbytes=True).decode("utf-8", "surrogatepass") if n else "" for x, n in zip(packed[a:b], sizes_[a:b], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(texts, pa.string())], names=["_doc", "_text"])

    zero = F.lit(0).cast("long")
    packed = joined.select("_doc", F.lit(b"").alias("_packed"), zero.alias("_size"), zero.alias("_slot"), zero.alias("_place")).schema
    columns = {c: F.col(f"_doc.{c}") for c in others} | {"text": F.col("_text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    part = F.least(F.floor(F.col("_slot") * F.lit(parts) / F.lit(float(max(1, total)))), F.lit(parts - 1)).cast("int")
    # texts are compressed on their way to their slots
    ordered = joined.mapInArrow(work, packed).repartitionById(parts, part).sortWithinPartitions("_slot", "_place")
    return ordered.mapInArrow(unpack, joined.select("_doc", "_text").schema).select(*[columns[c].alias(c) for c in docs.columns])
