"""Nearest neighbours by an inverted multi-index.

Both halves of the vectors are quantised separately, by k-means over a bounded sample; a vector's cell is its pair of
centroids. A query visits cells in order of summed squared distance to the two centroids, by a heap over the two sorted
lists, until the cells visited hold a given share of all entries, and the entries are ranked by their exact distance. That
share is fitted: it is the least at which queries of the sample find recall_target of their true neighbours.

Cells hold any number of entries: they are cut into blocks of bounded size, and neighbouring blocks form shards of bounded
size. A task reads a shard's entries, keeps them, and answers the queries sent to it one batch after another. A query is
sent once to each shard that holds a cell it visits; what comes back is its best k of each shard.

A vector that occurs many times is indexed in at most k + 1 rows, those of the smallest ids: with ties going to smaller ids,
no other row of it can be among the k nearest of any query, so this loses nothing. Vectors that are null, zero, of another
length than most, or that hold null or non-finite components take no part. Rows that share an id are entries of their own,
but no query finds its own id. Queries that are equal in id and vector are one; different vectors under one id are queries of
their own, each with its ranks from 1, told apart by query_key, a hash of the vector. Extra columns are ignored. Empty tables
give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, saved


def valid(vectors: DataFrame) -> DataFrame:
    """id and v (array of double) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    df = vectors.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    # adding 0.0 turns -0.0 into 0.0
    return df.select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        for d in range(x.shape[1]):
            total = np.bincount(own, x[:, d], k)
            count = np.bincount(own, minlength=k)
            centres[:, d] = np.where(count > 0, total / np.maximum(count, 1), centres[:, d])
    return centres


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin(_squares(x[a : a + 4096], centres), axis=1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def cells_of(x: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    half = books[0].shape[1]
    return _nearest(x[:, :half], books[0]) * len(books[1]) + _nearest(x[:, half:], books[1])


def traverse(q: np.ndarray, books: tuple[np.ndarray, np.ndarray], counts: np.ndarray, need: float) -> list[int]:
    """Cells with entries in order of summed squared distance, until they hold need entries."""
    half, k2 = books[0].shape[1], len(books[1])
    d1, d2 = _squares(q[None, :half], books[0])[0], _squares(q[None, half:], books[1])[0]
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2, i1, i2 = d1[o1].tolist(), d2[o2].tolist(), o1.tolist(), o2.tolist()
    heap, out, have = [(s1[0] + s2[0], 0, 0)], [], 0
    while heap and have < need:
        _, i, j = heapq.heappop(heap)
        cell = i1[i] * k2 + i2[j]
        if counts[cell]:
            out.append(cell)
            have += int(counts[cell])
        # (i, j) is reached from (i, j - 1) alone, or for j = 0 from (i - 1, 0): each pair enters the heap once
        if j + 1 < len(s2):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(s1):
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
    return out


def fit_share(sample: np.ndarray, books: tuple[np.ndarray, np.ndarray], k: int, recall_target: float, queries: int = 200) -> float:
    """The least share of entries at which the sample's own queries find recall_target of their k nearest."""
    cells, half = cells_of(sample, books), books[0].shape[1]
    counts = np.bincount(cells, minlength=len(books[0]) * len(books[1]))
    shares, upto = [], np.zeros(len(counts))
    for i in range(0, len(sample), max(1, len(sample) // queries)):
        d = ((sample - sample[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        # the heap's order in full, here by one sort of all pairs
        sums = _squares(sample[i][None, :half], books[0])[0][:, None] + _squares(sample[i][None, half:], books[1])[0]
        order = np.argsort(sums.ravel(), kind="stable")
        upto[order] = np.cumsum(counts[order])
        shares += (upto[cells[np.argsort(d, kind="stable")[:k]]] / len(sample)).tolist()
    return float(np.quantile(shares, recall_target)) if shares else 1.0


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, recall_target: float = 0.94, sample: int = 20_000, centres: int | None = None, most_centres: int = 512, shard_entries: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance), query_key: the k nearest found of each query.

    sample bounds the rows that the codebooks and the visited share are fitted on. A half's codebook has centres entries;
    by default their number grows with the rows, but slower than their root, so that cells take more rows as tables grow and
    a query's walk over cells stays short beside its distances. most_centres bounds it, and so the cell counts
    (most_centres squared) that the driver holds.
    """
    spark = vectors.sparkSession
    ready(spark)
    entries = saved(valid(vectors), "vectors")
    sizes = entries.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes or sizes[0]["n"] < 2:
        dim = sizes[0]["n"] if sizes else 0
    else:
        dim = sizes[0]["n"]
    entries = entries.where(F.size("v") == dim)
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    index = saved(entries.withColumn("_n", first).where(F.col("_n") <= k + 1).drop("_n"), "distinct")
    total = index.count()
    schema = "query_id long, rank int, vec_id long, score double, query_key long"
    if total == 0:
        return spark.createDataFrame([], schema)
    some = index.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toPandas()["v"]
    fitted = np.array([np.asarray(x, float) for x in some])
    half = max(1, dim // 2)
    centres = max(1, min(centres or round(10 * total**0.28), most_centres, len(fitted) // 20))
    books = (k_means(fitted[:, :half], centres), k_means(fitted[:, half:], centres) if dim > half else np.zeros((1, 0)))
    share = fit_share(fitted, books, k, recall_target)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dim)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cells_of(x, books))], names=["id", "v", "cell"])

    celled = saved(index.select("id", "v").mapInArrow(assign, "id long, v array<double>, cell long"), "cells")
    counts = np.zeros(len(books[0]) * len(books[1]), np.int64)
    for row in celled.groupBy("cell").count().collect():
        counts[row["cell"]] = row["count"]
    before = np.cumsum(counts) - counts
    need = max(share * total, 4 * (k + 1))

    def shard(cell: np.ndarray, part: np.ndarray) -> np.ndarray:
        """A cell's entries are spread by hash over as many places as it has entries; places follow the cells' order."""
        return (before[cell] + part % np.maximum(counts[cell], 1)) // shard_entries

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to = shard(b.column(2).to_numpy(), b.column(3).to_numpy())
            n = len(to)
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(np.zeros(n, np.int8)), b.column(0), b.column(1), pa.array(b.column(2).to_numpy()[:, None].tolist(), pa.list_(pa.int64())), pa.nulls(n, pa.int64())], names=["shard", "kind", "id", "v", "cells", "key"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, v, q, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _matrix(b.column(1), dim), b.column(2).to_pylist(), strict=True):
                sent: dict[int, list[int]] = {}
                for c in traverse(q, books, counts, need):
                    for s in range(before[c] // shard_entries, (before[c] + counts[c] - 1) // shard_entries + 1):
                        sent.setdefault(int(s), []).append(c)
                out += [(s, 1, i, v, cs, key) for s, cs in sent.items()]
            for a in range(0, len(out), 1024):
                s, kind, i, v, cs, key = zip(*out[a : a + 1024], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(kind, pa.int8()), pa.array(i, pa.int64()), pa.array(v, pa.list_(pa.float64())), pa.array(cs, pa.list_(pa.int64())), pa.array(key, pa.int64())], names=["shard", "kind", "id", "v", "cells", "key"])

    sent = "shard long, kind byte, id long, v array<double>, cells array<long>, key long"
    asked = valid(queries).where(F.size("v") == dim).dropDuplicates(["id", "v"]).select("id", "v", F.xxhash64("v").alias("key"))
    both = celled.select("id", "v", "cell", F.shiftrightunsigned(F.xxhash64("id"), 1).alias("part")).mapInArrow(place, sent).unionByName(asked.mapInArrow(ask, sent))
    dealt = both.repartition("shard").sortWithinPartitions("shard", "kind")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, x, ids, own = None, [], None, None, None
        for b in batches:
            shards, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero(np.r_[True, (shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1]), True])
            for at, to in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = b.slice(at, to - at)
                if shards[at] != now:
                    now, held, x = shards[at], [], None
                if kinds[at] == 0:
                    held.append((part.column(2).to_numpy(), _matrix(part.column(3), dim), part.column(4).flatten().to_numpy()))
                    continue
                if x is None and held:
                    ids, x, own = (np.concatenate(c) for c in zip(*held, strict=True))
                    order = np.argsort(own, kind="stable")
                    ids, x, own, held = ids[order], x[order], own[order], []
                if x is None:
                    continue
                q_ids, keys, found, scores = [], [], [], []
                for i, q, cells, key in zip(part.column(2).to_pylist(), _matrix(part.column(3), dim), part.column(4).to_pylist(), part.column(5).to_pylist(), strict=True):
                    lo, hi = np.searchsorted(own, cells, "left"), np.searchsorted(own, cells, "right")
                    rows = np.concatenate([np.arange(a, z) for a, z in zip(lo.tolist(), hi.tolist(), strict=True)])
                    rows = rows[ids[rows] != i]
                    d = np.sqrt(((x[rows] - q) ** 2).sum(axis=1))
                    if len(d) > k:
                        near = d <= np.partition(d, k - 1)[k - 1]
                        rows, d = rows[near], d[near]
                    best = np.lexsort((ids[rows], d))[:k]
                    q_ids += [i] * len(best)
                    keys += [key] * len(best)
                    found += ids[rows][best].tolist()
                    scores += d[best].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(q_ids, pa.int64()), pa.array(found, pa.int64()), pa.array(scores, pa.float64()), pa.array(keys, pa.int64())], names=["query_id", "vec_id", "score", "query_key"])

    near = dealt.mapInArrow(answer, "query_id long, vec_id long, score double, query_key long")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_key")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
