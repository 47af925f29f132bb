"""Near duplicates by SimHash, linked by meet-in-the-middle ball hashing.

Fingerprints that differ in at most 4 of 64 bits differ in at most 2 of one 32-bit half. Each half sends out its ball of
half that radius, itself and its 32 one-bit variants, so two halves within 2 bits meet at a variant; fingerprints that meet
are checked in full. (The ball of radius 2 over all 64 bits has 2,081 variants instead of 66.) A half's variants that
gather more than most fingerprints, as large groups of near copies do, are not compared there: their fingerprints send out
the whole 64-bit ball, 2,081 variants, where all that meet are within 4 bits and need no comparison. So no link is lost,
no task holds more than most fingerprints at once and no group is paired with itself.

Equal fingerprints are one node from the start. Components come from links by alternating large-star and small-star
steps, each a join and an aggregate, until nothing changes.

Null texts are empty; texts without a word have fingerprint 0 and are linked like any other. Rows with a null doc_id take
part, but give no component its id; a component without any doc_id has a null id. Rows that share a doc_id are judged each
for itself. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, ready, saved, text_hash

RADIUS = 4


def majority(hashes: Iterable[np.ndarray]) -> int:
    """The fingerprint of 64-bit hashes that come in pieces: a bit is 1 if it is set in over half of them; without hashes 0."""
    counts, n = np.zeros(64, np.int64), 0
    for h in hashes:
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprint(text: str | None, width: int = 4, seed: int = 42, at_once: int = 1 << 16) -> int:
    """The SimHash of a whole text's word shingles, repeats included, as an unsigned 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    n = max(1, len(words) - width + 1)

    def pieces() -> Iterator[np.ndarray]:
        for a in range(0, n, at_once):
            b = min(n, a + at_once)
            ends = [starts[i + width] - 1 for i in range(a, b)] if len(words) >= width else [len(joined)]
            cut = map(joined.__getitem__, map(slice, starts[a:b], ends))
            yield np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(seed)), np.uint64, b - a)

    return majority(pieces())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, h (tells apart rows with one doc_id), fp (signed 64-bit)."""
    ready(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["doc_id", "h", "fp"])

    return docs.select("doc_id", text_hash().alias("h"), F.col("text").cast("string")).mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h long, fp long")


def _within(group: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A forest that spans the links (at most radius bits) within a group of distinct fingerprints."""
    out, rest = [], group
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found, rest = rest[near], rest[~near]
                out += zip(repeat(int(x)), found.tolist())
                front += list(found)
    return out


def links(nodes: DataFrame, radius: int = RADIUS, most: int = 32_768) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints of the column fp whose components are those of all pairs within radius bits."""
    spark = nodes.sparkSession
    ready(spark)
    masks = {half: [0] + [1 << (b + 32 * half) for b in range(32)] for half in (0, 1)}
    if radius != RADIUS:
        raise ValueError("half of a half's radius is one bit for a radius of 4 only")

    def key(half: int) -> Column:
        own = F.shiftrightunsigned("fp", 32) if half else F.col("fp").bitwiseAND(0xFFFFFFFF)
        flips = F.array(*[F.lit(m >> (32 * half)) for m in masks[half]])
        return F.transform(flips, lambda m: own.bitwiseXOR(m) + half * (1 << 32))

    variants = nodes.select("fp", F.explode(F.concat(key(0), key(1))).alias("key"))
    dealt = variants.repartition("key").sortWithinPartitions("key", "fp")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fps, large in _groups(batches, most):
            pairs: list[tuple[int, int, bool]] = []
            if large:
                pairs = [(x, x, True) for x in fps.view(np.int64).tolist()]
            else:
                cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
                sizes = np.diff(cuts)
                two = cuts[:-1][sizes == 2]
                near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
                signed = fps.view(np.int64)
                pairs += zip(signed[near].tolist(), signed[near + 1].tolist(), repeat(False))
                for a, n in zip(cuts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                    got = np.array(_within(fps[a : a + n], radius), np.uint64).reshape(-1, 2).view(np.int64)
                    pairs += zip(got[:, 0].tolist(), got[:, 1].tolist(), repeat(False))
            if pairs:
                u, v, whole = zip(*pairs, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(whole)], names=["u", "v", "whole"])

    found = saved(dealt.select("key", "fp").mapInArrow(work, "u long, v long, whole boolean"), "met")
    crowded = found.where("whole").select(F.col("u").alias("fp")).distinct()
    return _ordered(found.where("not whole").select("u", "v").unionByName(_star(crowded)))


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(keys, fingerprints, False) for whole groups of sorted rows, some groups at a time; (.., .., True) for parts of a group of more than most."""
    keys, fps, over = np.empty(0, np.int64), np.empty(0, np.uint64), None
    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy()])
        fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
        if not len(keys):
            continue
        if over is not None:
            n = int(np.searchsorted(keys, over, side="right"))
            if n:
                yield keys[:n], fps[:n], True
            if n == len(keys):
                keys, fps = keys[n:], fps[n:]
                continue
            keys, fps, over = keys[n:], fps[n:], None
        last = int(np.searchsorted(keys, keys[-1]))
        yield from _cut(keys[:last], fps[:last], most)
        keys, fps = keys[last:], fps[last:]
        if len(keys) > most:
            yield keys, fps, True
            over, keys, fps = keys[0], keys[:0], fps[:0]
    if len(keys):
        yield from _cut(keys, fps, most)


def _cut(keys: np.ndarray, fps: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Takes groups of more than most out of a batch of whole groups."""
    if not len(keys):
        return
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    large = np.flatnonzero(np.diff(cuts) > most)
    for i in large:
        yield keys[cuts[i] : cuts[i + 1]], fps[cuts[i] : cuts[i + 1]], True
    if len(large):
        rest = np.repeat(np.diff(cuts) <= most, np.diff(cuts))
        keys, fps = keys[rest], fps[rest]
    if len(keys):
        yield keys, fps, False


def _star(nodes: DataFrame) -> DataFrame:
    """Links by the whole ball of radius 2: all fingerprints that meet at a variant are linked to the least of them."""
    masks = np.array([0] + [1 << i for i in range(64)] + [(1 << i) | (1 << j) for i in range(64) for j in range(i)], np.uint64)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for a in range(0, len(fps), 64):
                part = fps[a : a + 64]
                yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ masks).ravel().view(np.int64)), pa.array(np.repeat(part.view(np.int64), len(masks)))], names=["key", "fp"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first = None, 0
        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            new = np.r_[keys[:1] != key if key is not None else [True], keys[1:] != keys[:-1]]
            heads = np.maximum.accumulate(np.where(new, np.arange(len(keys)), -1))
            lead = np.where(heads < 0, first, fps[np.maximum(heads, 0)])
            key, first = keys[-1], lead[-1]
            far = lead != fps
            yield pa.RecordBatch.from_arrays([pa.array(lead[far]), pa.array(fps[far])], names=["u", "v"])

    met = nodes.mapInArrow(emit, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    return met.mapInArrow(work, "u long, v long")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct()


def components(pairs: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node, root (the least node of its component) for every node of the pairs (u, v)."""
    edges, mark = saved(_ordered(pairs), "edges"), None
    for _ in range(most_rounds):
        both, before = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), edges
        # aggregates are written before they are joined, so that adaptive execution can split a star's centre
        least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        # large star: a node's greater neighbours go to its least one
        large = _ordered(both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").unionByName(least.select(F.col("m").alias("u"), F.col("u").alias("v"))))
        large = saved(large, "large")
        low = saved(large.groupBy(F.col("v").alias("n")).agg(F.min("u").alias("m")), "low")
        # small star: a node and its lesser neighbours go to its least one
        small = large.join(low, large["v"] == low["n"]).select(F.col("m").alias("u"), F.col("u").alias("v"))
        edges = saved(_ordered(small.unionByName(low.select(F.col("m").alias("u"), F.col("n").alias("v")))), "edges")
        for table in (least, large, low, before):
            drop(table)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, h, fp, component_id (the least doc_id of the component), and keeper: whether this row is the component's chosen one (least doc_id, then least h)."""
    prints = saved(fingerprints(docs), "prints")
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("lead")
    nodes = saved(prints.groupBy("fp").agg(lead), "nodes")
    roots = components(links(nodes.select("fp")))
    per = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "lead", F.coalesce("root", "fp").alias("root"))
    per = saved(per, "roots")
    # written before the join, so that adaptive execution can split a large component's root
    best = saved(per.groupBy("root").agg(F.min("lead").alias("lead")), "best")
    found = per.select("fp", "root").join(best, "root").select("fp", "lead")
    # copies share a fingerprint: the join may be skewed on the side of the documents, which adaptive execution splits
    out = prints.join(found, "fp")
    same = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("h") == F.col("lead.h"))
    return out.select("doc_id", "h", "fp", F.col("lead.doc_id").alias("component_id"), same.alias("keeper"))


def hexadecimal(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def rows_named(docs: DataFrame, named: DataFrame) -> DataFrame:
    """One row of docs for each (doc_id, h) of named."""
    # two hashes name a row, so that the join and the choice among equal rows share one shuffle of the texts
    name = lambda h: F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id"), h).alias("_k")
    keep = named.select(name(F.col("h")), F.col("h").alias("_t")).distinct()
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), name(text_hash()), text_hash().alias("_t"))
    # rows that share doc_id and text: the one of least hash over what other columns can be hashed
    rest = [F.col(f"_doc.{f.name}") for f in docs.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    first = F.row_number().over(Window.partitionBy("_k", "_t").orderBy(F.xxhash64(*rest)))
    return own.join(keep, ["_k", "_t"], "left_semi").withColumn("_n", first).where("_n = 1").select("_doc.*")


def one_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the least doc_id."""
    return rows_named(docs, grouped(docs).where("keeper"))
